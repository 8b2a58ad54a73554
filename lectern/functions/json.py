"""JSON texts of any length, read without a size limit.

A text is read by schema, which has no limit on its length and takes the last of repeated
keys in every session. NaN and infinities are read as numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.frames import bind

OPTIONS = {"allowSingleQuotes": "false", "maxStringLen": str((1 << 31) - 1), "maxNumLen": str((1 << 31) - 1)}

# Follows the text inside a list, so that anything left over after the first JSON value
# shows up as a missing second element (the parser itself stops after one value).
_END = "␞ end of text ␞"


def read_json(col: Column, schema: str) -> Column:
    return F.from_json(col, schema, OPTIONS)


def whole_json(col: Column) -> Column:
    """The text itself when all of it is one JSON value, else null."""
    pair = read_json(F.concat(F.lit("["), col, F.lit(f',"{_END}"]')), "array<string>")
    return bind(pair, lambda p: F.when((F.size(p) == 2) & (F.get(p, F.lit(1)) == _END), col))


def _starts(json: Column, mark: str) -> Column:
    return F.startswith(F.ltrim(json, F.lit(" \t\n\r")), F.lit(mark))


def is_object(json: Column) -> Column:
    return _starts(json, "{")


def is_list(json: Column) -> Column:
    return _starts(json, "[")


def keys(json: Column) -> Column:
    """The keys of an object; null for other values."""
    return F.map_keys(read_json(json, "map<string,string>"))


def has_key(found: Column, key: str) -> Column:
    """Whether ``keys`` have the key, be its value null or not; false without keys."""
    return F.coalesce(F.array_contains(found, key), F.lit(False))

"""Row shapes shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

MESSAGE = T.StructType(
    [T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]
)
MESSAGES = T.ArrayType(MESSAGE)

# One wide question/answer row for all corpora; columns a corpus lacks are null.
QA_COLUMNS = (
    "key",
    "corpus",
    "question",
    "answer",
    "context",
    "support",
    "distractors",
    "fact",
    "all_choices",
)
QA_ARRAYS = ("distractors", "all_choices")

# A shape keeps its text as paragraphs of runs.
SHAPE = T.StructType(
    [
        T.StructField("shape_name", T.StringType()),
        T.StructField("shape_type", T.StringType()),
        T.StructField("paragraphs", T.ArrayType(T.ArrayType(T.StringType()))),
    ]
)
# A picture names its stored copy, the first one with its content in the deck, and its size
# where the format is known. Its bytes are kept apart, so that no query on pictures reads
# them, and only once per stored copy.
PICTURE = T.StructType(
    [
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("shape_name", T.StringType()),
        T.StructField("image_format", T.StringType()),
        T.StructField("sha1", T.StringType()),
        T.StructField("image_path", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
    ]
)
TABLES = T.ArrayType(T.ArrayType(T.ArrayType(T.StringType())))

# One row per slide; a deck that cannot be opened gives one row per failed
# reading (text, images) with no slide number and a message in ``error``.
DECK_ROW = T.StructType(
    [
        T.StructField("deck", T.StringType()),
        T.StructField("slide_number", T.IntegerType()),
        T.StructField("shapes", T.ArrayType(SHAPE)),
        T.StructField("tables", TABLES),
        T.StructField("notes", T.StringType()),
        T.StructField("pictures", T.ArrayType(PICTURE)),
        T.StructField("blobs", T.ArrayType(T.BinaryType())),
        T.StructField("error", T.StringType()),
    ]
)

QUIZ_ITEM = "struct<question:string,options:array<string>,correct_index:int,rationale:string>"

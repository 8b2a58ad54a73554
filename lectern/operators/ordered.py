"""Running values over ordered groups, for groups of any size.

A window over a group keeps the group in one task. So a group is cut into chunks by a value:
a number that never falls along the order, such as the day of a timestamp. Windows run per
group and chunk, and what a chunk needs from the ones before it comes from one summary row per
group and chunk. All running values of a call are made together: rows are shuffled by group and
chunk once, and the summaries join them there. How large a chunk may get is up to the value,
and nothing is counted or written to find out.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.frames import once

#: Steps are folded in blocks of so many, and blocks again in blocks of so many.
BLOCK = 128
#: Bounds that no counter reaches.
FAR = 1 << 62


@dataclass(frozen=True)
class Ordered:
    """Rows with the columns that group and order them, and ``chunk``."""

    df: DataFrame
    group: tuple[str, ...]
    order: tuple[str, ...]

    @property
    def chunk(self) -> list[str]:
        return [*self.group, "chunk"]

    def add(self, name: str, value: Column) -> Ordered:
        return replace(self, df=self.df.withColumn(name, value))


@dataclass(frozen=True)
class Sum:
    """The sum of ``value`` up to and including each row."""

    value: Column


@dataclass(frozen=True)
class Last:
    """The last ``value`` that is not null, up to each row or (``before``) ahead of it."""

    value: Column
    before: bool = False


@dataclass(frozen=True)
class Clamp:
    """A counter from 0 that each row moves by ``shift`` and then keeps in ``lo..hi``. With
    ``lo`` and ``hi`` 0 a row sets it back."""

    shift: Column
    lo: Column
    hi: Column


def ordered(df: DataFrame, group: list[str], order: list[str], chunk: Column) -> Ordered:
    """``df`` ready for running values; ``order`` must be unique within a group, ``chunk`` must
    not fall along it, and neither it nor the columns of ``group`` may be null."""
    return Ordered(df.withColumn("chunk", chunk), tuple(group), tuple(order))


# A step maps x to least(hi, greatest(lo, x + shift)); steps of this form compose to the form.
# Expressions over lists of steps are SQL texts, which are parsed once.

STEP = "struct<shift: bigint, lo: bigint, hi: bigint>"


def _step(clamp: Clamp) -> Column:
    parts = {"shift": clamp.shift, "lo": clamp.lo, "hi": clamp.hi}
    return F.struct(*[v.cast("long").alias(c) for c, v in parts.items()])


def _applied(step: str, x: str) -> str:
    return f"least({step}.hi, greatest({step}.lo, {x} + {step}.shift))"


def _then(first: str, second: str, names: list[str]) -> str:
    """Several steps by name, each after the first one of its name."""

    def one(a: str, b: str) -> str:
        lo, hi = _applied(b, f"{a}.lo"), _applied(b, f"{a}.hi")
        return f"named_struct('shift', {a}.shift + {b}.shift, 'lo', {lo}, 'hi', {hi})"

    return "named_struct(" + ", ".join(f"'{n}', {one(f'{first}.`{n}`', f'{second}.`{n}`')}" for n in names) + ")"


def _none(names: list[str]) -> str:
    """Steps that change nothing."""
    still = f"named_struct('shift', 0L, 'lo', {-FAR}L, 'hi', {FAR}L)"
    return "named_struct(" + ", ".join(f"'{n}', {still}" for n in names) + ")"


def _folded(steps: str, names: list[str]) -> str:
    return f"aggregate({steps}, {_none(names)}, (a, b) -> {_then('a', 'b', names)})"


def _prefixes(steps: str, names: list[str]) -> str:
    """Of each step all up to it, folded."""
    kind = ", ".join(f"`{n}`: {STEP}" for n in names)
    latest = f"coalesce(get(done, size(done) - 1), {_none(names)})"
    # The one before is bound to a name, since it is used several times.
    added = f"transform(array({latest}), a -> {_then('a', 'b', names)})"
    return f"aggregate({steps}, cast(array() as array<struct<{kind}>>), (done, b) -> concat(done, {added}))"


def _blocks(df: DataFrame, keys: list[str], order: list[str], names: list[str]) -> DataFrame:
    """Rows of each group in blocks: ``_b``, ``_rows`` and the folded steps up to each,
    ``_steps``. One shuffle, by ``keys``."""
    by = Window.partitionBy(*keys).orderBy(*order)
    rest = [c for c in df.columns if c not in keys]
    numbered = df.select("*", (F.row_number().over(by) - 1).alias("_n"))
    gathered = F.collect_list(F.struct("_n", *rest)).alias("_rows")
    blocks = numbered.groupBy(*keys, F.floor(F.col("_n") / BLOCK).alias("_b")).agg(gathered)
    blocks = blocks.withColumn("_rows", F.expr("array_sort(_rows, (a, b) -> a._n - b._n)"))
    steps = "transform(_rows, r -> named_struct(" + ", ".join(f"'{n}', r.`{n}`" for n in names) + "))"
    return once(blocks, _steps=F.expr(_prefixes(steps, names)))


TOTAL = "get(_steps, size(_steps) - 1)"


def _totals(df: DataFrame, keys: list[str], order: list[str], names: list[str]) -> DataFrame:
    """One row per group with all its steps folded."""
    blocks = _blocks(df.select(*keys, *order, *names), keys, order, names)
    in_order = F.expr(f"transform(sort_array(collect_list(struct(_b, {TOTAL} AS _total))), b -> b._total)")
    groups = blocks.groupBy(*keys).agg(in_order.alias("_totals"))
    groups = once(groups, _all=F.expr(_folded("_totals", names)))
    return groups.select(*keys, *[F.col(f"_all.{n}").alias(n) for n in names])


def _composed(df: DataFrame, keys: list[str], order: list[str], names: list[str]) -> DataFrame:
    """``df`` with the steps in columns ``names`` folded over each group up to each row."""
    rest = [c for c in df.columns if c not in keys]
    blocks = _blocks(df, keys, order, names)
    outer = F.floor(F.col("_b") / BLOCK).alias("_outer")
    blocks = blocks.select("*", F.expr(TOTAL).alias("_total"), outer)

    def earlier(*more: str) -> Window:
        by = Window.partitionBy(*keys, *more).orderBy("_b")
        return by.rowsBetween(Window.unboundedPreceding, -1)

    # What lies ahead of a block: whole blocks of blocks, then blocks of its own one.
    blocks = blocks.select("*", F.collect_list("_total").over(earlier("_outer")).alias("_near"))
    closed = F.expr(f"CASE WHEN _b % {BLOCK} = {BLOCK - 1} THEN {_folded('concat(_near, array(_total))', names)} END")
    blocks = blocks.select("*", closed.alias("_closed"))
    blocks = blocks.select("*", F.collect_list("_closed").over(earlier()).alias("_far"))
    blocks = once(blocks, _ahead=F.expr(_folded("concat(_far, _near)", names)))
    steps = f"transform(_steps, s -> {_then('_ahead', 's', names)})"
    fields = ", ".join(f"'{c}', {'s' if c in names else 'r'}.`{c}`" for c in rest)
    rows = F.expr(f"zip_with(_rows, {steps}, (r, s) -> named_struct({fields}))")
    return blocks.select(*keys, F.inline(rows))


def running(rows: Ordered, **values: Sum | Last | Clamp) -> Ordered:
    """``rows`` with a column for each running value; clamps are ints."""
    sums = {n: v for n, v in values.items() if isinstance(v, Sum)}
    lasts = {n: v for n, v in values.items() if isinstance(v, Last)}
    clamps = {n: v for n, v in values.items() if isinstance(v, Clamp)}
    made = {n: f"_at_{n}" for n in values}
    steps = [made[n] for n in clamps]
    order = list(rows.order)

    def frame(end: int) -> Window:
        window = Window.partitionBy(*rows.chunk).orderBy(*order)
        return window.rowsBetween(Window.unboundedPreceding, end)

    df = rows.df.select(
        "*",
        *[F.sum(v.value).over(frame(0)).alias(made[n]) for n, v in sums.items()],
        *[F.last(v.value, ignorenulls=True).over(frame(-v.before)).alias(made[n]) for n, v in lasts.items()],
        *[_step(v).alias(made[n]) for n, v in clamps.items()],
    )
    if clamps:
        df = _composed(df, rows.chunk, order, steps)

    # One row per group and chunk.
    latest = [
        F.max_by(v.value, F.when(v.value.isNotNull(), F.struct(*order))).alias(made[n]) for n, v in lasts.items()
    ]
    totals = [F.sum(v.value).alias(made[n]) for n, v in sums.items()]
    summary = rows.df.groupBy(*rows.chunk).agg(*totals, *latest) if totals or latest else None
    if clamps:
        narrow = rows.df.select(*rows.chunk, *order, *[_step(v).alias(made[n]) for n, v in clamps.items()])
        ends = _composed(_totals(narrow, rows.chunk, order, steps), list(rows.group), ["chunk"], steps)
        summary = ends if summary is None else summary.join(ends, rows.chunk)
    by_chunk = Window.partitionBy(*rows.group).orderBy("chunk")
    earlier = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    carried = {n: F.sum(made[n]).over(earlier) for n in sums}
    carried |= {n: F.last(made[n], ignorenulls=True).over(earlier) for n in lasts}
    carried |= {n: F.last(F.expr(_applied(made[n], "0L"))).over(earlier) for n in clamps}
    carry = (
        summary.select(
            *rows.chunk, F.row_number().over(by_chunk).alias("_nth"), *[c.alias(f"_to_{n}") for n, c in carried.items()]
        )
        .filter(F.col("_nth") > 1)
        .drop("_nth")
    )
    df = df.join(carry, rows.chunk, "left")

    done = {n: F.col(made[n]) + F.coalesce(f"_to_{n}", F.lit(0)) for n in sums}
    done |= {n: F.coalesce(made[n], f"_to_{n}") for n in lasts}
    done |= {n: F.expr(_applied(made[n], f"coalesce(_to_{n}, 0L)")).cast("int") for n in clamps}
    kept = [c for c in rows.df.columns if c not in values]
    return replace(rows, df=df.select(*kept, *[done[n].alias(n) for n in values]))


def running_sum(rows: Ordered, name: str, value: Column) -> Ordered:
    """One running sum."""
    return running(rows, **{name: Sum(value)})

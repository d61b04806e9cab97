"""Quantity logs: set, add, remove, delete and clear events to quantities, as a closed form over two windows.

A log of usual length is one window. Longer ones are cut into blocks of their order: an event takes x to max(lo, x + d), and so does any
run of events, so blocks are folded apart and stitched by a scan over one row a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.staging import staged
from .skew import in_blocks

KEY = ["session_id", "menu_id", "item_id", "variant_id"]
ORDER = ["ts", "event_id"]
#: A line with more events than this is folded in blocks of about so many.
BLOCK_ROWS = 1_000_000


def _known(events: DataFrame) -> DataFrame:
    return events.filter(F.col("op").isin("set", "add", "remove", "delete", "clear"))


def _same_line(a: DataFrame, b: DataFrame) -> Column:
    """Rows of one line; a null in the key is a value like others, as it is to windows. ``b`` has its key's names with a mark."""
    on = F.lit(True)
    for k in KEY:
        on = on & a[k].eqNullSafe(b[f"_{k}"])
    return on


def _marked_key() -> list[Column]:
    return [F.col(k).alias(f"_{k}") for k in KEY]


def _split(events: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """The events of lines of usual length, and those of long lines with ``_block``: numbers in the log's order, so that each line's blocks
    hold successive events. Lines are counted first (partial counts); the long ones' events are ranged by line and order together and staged, which fixes
    their blocks."""
    counts = events.groupBy(*KEY).agg(F.count("*").alias("n")).filter(F.col("n") > block_rows)
    long_lines = staged(counts, "long-lines")
    rows = long_lines.agg(F.sum("n")).first()[0]
    if not rows:
        return events, None
    long_lines = long_lines.select(*_marked_key())
    usual = events.join(long_lines, _same_line(events, long_lines), "left_anti")
    own = events.join(long_lines, _same_line(events, long_lines), "left_semi")
    return usual, staged(in_blocks(own, rows, block_rows, *KEY, *ORDER), "blocks")


def _fold(events: DataFrame, by: list[str]) -> DataFrame:
    """``events`` with ``_segment``, how many set, delete or clear events there were so far, ``_p``, the value without the floor at 0 since
    the last of them, and ``_low``, the lowest ``_p`` since then."""
    c = F.col
    order = Window.partitionBy(*by).orderBy(*ORDER)
    reset = c("op").isin("set", "delete", "clear")
    out = events.withColumn("_segment", F.sum(F.when(reset, 1).otherwise(0)).over(order))
    base = F.when(c("op") == "set", F.greatest(F.floor(F.coalesce("qty", F.lit(0))), F.lit(0)).cast("bigint"))
    step = F.when(c("op") == "add", F.lit(1)).when(c("op") == "remove", F.lit(-1)).otherwise(F.coalesce(base, F.lit(0).cast("bigint")))
    inner = Window.partitionBy(*by, "_segment").orderBy(*ORDER)
    return out.withColumn("_p", F.sum(step.cast("bigint")).over(inner)).withColumn("_low", F.min("_p").over(inner))


def _above(p: Column, low: Column, start: Column) -> Column:
    """The quantity where the value without floor went from ``start`` to ``start + p``, by way of ``start + low``."""
    return start + p - F.least(F.lit(0).cast("bigint"), start + low)


def _scanned(folded: DataFrame) -> DataFrame:
    """(KEY, _block, start, end): the quantity before and after each block. Blocks are one row each, so a line's are few.

    A block without a reset takes x to max(lo, x + d) with d its last _p and lo = d - _low; one with a reset ends at a known value, which
    begins a run of blocks. With D the sum of d in a run, the end is D + max(0, the highest lo - D so far).
    """
    c, zero = F.col, F.lit(0).cast("bigint")
    last = folded.groupBy(*KEY, "_block").agg(F.max_by(F.struct("_segment", "_p", "_low"), F.struct(*ORDER)).alias("l"))
    known = _above(c("l._p"), c("l._low"), zero)
    own = last.select(*KEY, "_block", (c("l._segment") > 0).alias("known"), F.when(c("l._segment") > 0, known).otherwise(c("l._p")).alias("d"), F.when(c("l._segment") > 0, known).otherwise(c("l._p") - c("l._low")).alias("lo"))
    order = Window.partitionBy(*KEY).orderBy("_block")
    own = own.withColumn("run", F.sum(F.when(c("known"), 1).otherwise(0)).over(order))
    inner = Window.partitionBy(*KEY, "run").orderBy("_block")
    own = own.withColumn("sum", F.sum("d").over(inner))
    own = own.withColumn("end", c("sum") + F.greatest(zero, F.max(c("lo") - c("sum")).over(inner)))
    return own.select(*KEY, "_block", F.coalesce(F.lag("end").over(order), zero).alias("start"), "end")


def running_quantities(events: DataFrame, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``events`` (KEY, ts, event_id, op, qty) with ``quantity`` after each, in (ts, event_id) order.

    set, delete and clear begin a segment with a known value; add and remove go up and down from it but never under 0. So with P the
    value without that floor, the quantity is P less the lowest P so far where that is negative.
    """
    own = _known(events)
    usual, blocks = _split(own, block_rows)
    zero = F.lit(0).cast("bigint")
    out = _fold(usual, KEY).withColumn("quantity", _above(F.col("_p"), F.col("_low"), zero)).select(*own.columns, "quantity")
    if blocks is None:
        return out
    folded = _fold(blocks, [*KEY, "_block"])
    starts = _scanned(folded).select(*_marked_key(), F.col("_block").alias("_b"), F.col("start").alias("_start"))
    on = _same_line(folded, starts) & (folded["_block"] == starts["_b"])
    start = F.when(F.col("_segment") == 0, F.col("_start")).otherwise(zero)
    return out.unionByName(folded.join(starts, on).withColumn("quantity", _above(F.col("_p"), F.col("_low"), start)).select(*own.columns, "quantity"))


def quantities(events: DataFrame, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(KEY, qty) after all events, lines of quantity 0 left out."""
    usual, blocks = _split(_known(events), block_rows)
    folded = _fold(usual, KEY).withColumn("quantity", _above(F.col("_p"), F.col("_low"), F.lit(0).cast("bigint")))
    out = folded.groupBy(*KEY).agg(F.max_by("quantity", F.struct(*ORDER)).alias("qty"))
    if blocks is not None:
        out = out.unionByName(_scanned(_fold(blocks, [*KEY, "_block"])).groupBy(*KEY).agg(F.max_by("end", "_block").alias("qty")))
    return out.filter("qty > 0")

"""Joins whose keys may be hot: counted, and the hot ones spread over tasks. Groups that are cut into blocks of their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.staging import staged

#: A key with over one in so many of the left rows is hot; so there are fewer than that many. The most right rows of hot keys that are broadcast.
SHARE, BROADCAST_ROWS = 1000, 100_000
#: Rows of a partition that is cut into blocks.
RANGE_ROWS = 1_000_000


def in_blocks(df: DataFrame, rows: int, block_rows: int, *order: str) -> DataFrame:
    """``df`` of so many ``rows`` with ``_block``: numbers that rise with ``order``, of about ``block_rows`` successive rows each.

    Rows are ranged into partitions, which are cut into blocks: small blocks share a partition, so that tasks don't grow in number
    with small blocks. Stage the result, which fixes the blocks."""
    tasks = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, min(-(-rows // block_rows), max(tasks, -(-rows // RANGE_ROWS))))
    # A partition's number and a row's number in it, from the 34th bit and below.
    row = F.monotonically_increasing_id()
    own = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_block", row)
    part, place = F.shiftright("_block", 33), F.col("_block").bitwiseAND((1 << 33) - 1)
    return own.withColumn("_block", F.shiftleft(part, 33) + F.floor(place / block_rows))


def broadcastable(df: DataFrame) -> bool:
    """Whether Spark takes ``df`` for small enough to broadcast it of its own accord."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size <= int(df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())


def join_spread(left: DataFrame, right: DataFrame, on: list[str], *, share: int = SHARE, broadcast_rows: int = BROADCAST_ROWS, salts: int | None = None) -> DataFrame:
    """The inner join of ``left`` and ``right`` on ``on``, where few keys may hold most rows of ``left``.

    Left rows are counted by key first (partial counts, one row a key is shuffled), so ``left`` should be cheap to read twice. Hot
    keys' right rows are broadcast if they are few; else every left row of a hot key takes one of ``salts`` numbers by its
    content, each right row is copied to all of them, and both are joined by key and number. The others meet by an ordinary join.
    """
    if broadcastable(right):
        return left.join(right, on)
    counts = staged(left.dropna(subset=on).groupBy(*on).agg(F.count("*").alias("n")), "key-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(counts.filter(F.col("n") > total // share).select(*on))
    hot_left, hot_right = left.join(hot, on, "left_semi"), right.join(hot, on, "left_semi")
    rest = left.join(hot, on, "left_anti").join(right, on)
    if hot_right.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return rest.unionByName(hot_left.join(F.broadcast(hot_right), on))
    n = salts or 2 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = hot_left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(n)).cast("int"))
    copies = hot_right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rest.unionByName(salted.join(copies, [*on, "_salt"]).drop("_salt"))

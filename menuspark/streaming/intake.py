"""Incremental page intake: new pages are parsed, joined to their menus, and the menus' duplicates are looked for again.

The working menus are an append-only log of Parquet tables, partitioned by version and by a hash of the menu. A batch reads the latest
rows of the menus it touches and writes those menus alone, as a new version; nothing is overwritten. A menu's version counts once
the table ``menus`` has it, which is written last, so a batch that fails on the way leaves every menu as it was. ``working`` reads the
tables as they stand and ``compact`` drops what newer versions have replaced. There may be one writer at a time.

Of a working menu its names' trigrams and its similar pairs are kept as well. A batch's dishes meet the menu's, which don't meet each other
anew: their pairs stand as they were, but for dishes that the last batch merged, whose prices and images may have changed. A store without
these tables gets them with the next batch.

Pages of one menu that come in one batch are merged together. Ids are hashes of menu, page and line, so a batch that is
repeated after a failure makes the same items and replaces them.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.lexicon import UNCATEGORIZED
from ..operators import dedupe, menu
from ..plans.parse import parse_pages
from ..sources.pages import flatten_blocks
from ..sources.staging import staged

ITEMS = "menu_id string, item_id string, item_pos bigint, name string, description string, category_id string, variants array<struct<id:string,label:string,price_agorot:bigint,needs_review:boolean>>, price_kind string, confidence double, needs_review boolean, review_reasons array<string>, source_image_ids array<string>, origin string"
CATEGORIES = "menu_id string, category_id string, name string, order bigint"
PAIRS = "menu_id string, pos_a bigint, pos_b bigint, target_id string, source_id string, score double, auto boolean, reason string"
NAMES = "menu_id string, item_id string, normal string, grams array<string>, fresh boolean"
#: ``menus`` comes last: its row makes the others of the same version count. ``names`` and ``pairs`` are what finding duplicates keeps.
TABLES = {"items": ITEMS, "categories": CATEGORIES, "suggestions": PAIRS, "names": NAMES, "pairs": PAIRS, "menus": "menu_id string, confirmed boolean"}
BUCKETS = 64
NO_HINTS = "menu_id string, page_id string, hint_no int, values array<bigint>, bbox struct<x0:double,y0:double,x1:double,y1:double>"


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    schema = f"{TABLES[name]}, version string, bucket int"
    try:
        return spark.read.schema(schema).parquet(f"{path}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return _none(spark, schema)


def _none(spark: SparkSession, schema: str) -> DataFrame:
    """No rows, which the optimizer knows: what they are joined to isn't read for them."""
    return spark.createDataFrame([], schema).limit(0)


def _latest(menus: DataFrame) -> DataFrame:
    return menus.groupBy("menu_id").agg(F.max("version").alias("version"))


def working(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One of the TABLES under ``path`` as it stands: each menu's rows of its latest version. An empty store gives an empty table."""
    latest = _latest(_read(spark, path, "menus"))
    return _read(spark, path, name).join(latest, ["menu_id", "version"], "left_semi").drop("version", "bucket")


def _bucket(buckets: int):
    return F.pmod(F.hash("menu_id"), F.lit(buckets))


def _append(path: str, tables: dict[str, DataFrame], versions: list[str], buckets: int) -> str:
    """Write the tables as a version that sorts after ``versions``; an attempt that fails leaves one that nothing points to. Spark cuts
    large buckets by its advisory partition size, so a task's rows don't grow with the batch."""
    number = max((int(v.partition("-")[0]) for v in versions), default=0) + 1
    version = f"{number:012d}-{uuid.uuid4().hex}"
    for name in TABLES:
        tables[name].withColumn("bucket", _bucket(buckets)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{path}/{name}/version={version}")
    return version


def _without(df: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """``df`` less the rows one of whose ``columns`` is among the items ``ids`` (menu_id, item_id)."""
    for c in columns:
        df = df.join(ids.withColumnRenamed("item_id", c), ["menu_id", c], "left_anti")
    return df


def merged_in(items: DataFrame, kept: DataFrame, names: DataFrame, pairs: DataFrame) -> dict[str, DataFrame]:
    """The tables items, suggestions, names and pairs after duplicates among ``items`` are merged. ``kept``: (menu_id, item_id) of those
    that were there before; ``names`` and ``pairs``: what was stored of them."""
    names = names.join(kept, ["menu_id", "item_id"], "left_semi")
    fresh = dedupe.names_of(items.join(names, ["menu_id", "item_id"], "left_anti")).withColumn("fresh", F.lit(True))
    names = staged(names.unionByName(fresh), "stored-names")
    stale = names.filter("not fresh").select("menu_id", "item_id")
    for end in ("target_id", "source_id"):
        pairs = pairs.join(stale.withColumnRenamed("item_id", end), ["menu_id", end], "left_semi")
    pairs = staged(pairs.unionByName(dedupe.duplicate_pairs(items, names=names)), "similar")
    found = staged(dedupe.leaders(pairs), "found")
    auto = found.filter("auto")
    targets, sources = (auto.select("menu_id", F.col(end).alias("item_id")).distinct() for end in ("target_id", "source_id"))
    left = _without(names, sources, "item_id").drop("fresh").join(targets.withColumn("fresh", F.lit(True)), ["menu_id", "item_id"], "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))
    return {
        "items": dedupe.merge_items(items, auto), "suggestions": found.filter("not auto"), "names": left,
        "pairs": _without(pairs, targets.unionByName(sources), "target_id", "source_id"),
    }


def take_in(pages: DataFrame, path: str, *, buckets: int = BUCKETS) -> None:
    """One batch of page records into the working menus under ``path``: items, categories, menus (not confirmed any more) and
    suggestions. Pages without a menu_id are left out; a batch without pages writes nothing."""
    spark = pages.sparkSession
    own = staged(pages.filter("menu_id is not null"), "intake")
    touched = own.select("menu_id").distinct()
    hit = [r[0] for r in touched.select(_bucket(buckets).alias("b")).distinct().collect()]  # at most the number of buckets
    if not hit:
        return
    parsed = parse_pages(flatten_blocks(own), _none(spark, NO_HINTS), own)
    latest = staged(_latest(_read(spark, path, "menus").filter(F.col("bucket").isin(hit)).join(touched, "menu_id", "left_semi")), "latest")
    versions = [r[0] for r in latest.select("version").distinct().collect()]  # at most the batches since the last compaction
    old = {name: _read(spark, path, name).filter(F.col("bucket").isin(hit) & F.col("version").isin(versions)).join(latest, ["menu_id", "version"], "left_semi").drop("version", "bucket") for name in ("items", "categories", "names", "pairs")}
    names = parsed.categories.select("menu_id", "name", F.col("order").alias("seq"))
    categories = staged(menu.ensure_categories(old["categories"], names), "categories")
    columns = old["items"].columns
    # The dishes are put together once: which old ones stay, after which place the new ones come, and the union all read them.
    new = staged(parsed.items.select(*columns), "new-items")
    kept = staged(old["items"].join(new.select("menu_id", "item_id"), ["menu_id", "item_id"], "left_anti"), "kept")
    last = kept.groupBy("menu_id").agg(F.max("item_pos").alias("last"))
    # A page's headings become the menu's categories of the same name; dishes meet them by the ids that they have.
    headings = parsed.categories.select("menu_id", F.col("category_id").alias("heading_id"), F.col("name").alias("category_name"))
    known = menu.attach_categories(headings, categories).select("menu_id", "heading_id", F.col("category_id").alias("known_id"))
    new = new.withColumnRenamed("category_id", "heading_id").join(known, ["menu_id", "heading_id"], "left").withColumn("category_id", F.coalesce("known_id", F.lit(UNCATEGORIZED)))
    # Places of a batch are 0, 1, 2 and so on in each menu.
    new = staged(new.join(last, "menu_id", "left").withColumn("item_pos", F.coalesce("last", F.lit(-1)) + 1 + F.col("item_pos")).select(*columns), "numbered")
    merged = merged_in(kept.unionByName(new), kept.select("menu_id", "item_id"), old["names"], old["pairs"])
    _append(path, {**merged, "categories": categories, "menus": touched.withColumn("confirmed", F.lit(False))}, versions, buckets)


def compact(spark: SparkSession, path: str, *, buckets: int = BUCKETS) -> int:
    """Write all menus' latest rows as one version and delete the versions before it, failed attempts included. Returns how many
    versions were in use. Run it between batches: whoever reads the old versions meanwhile loses them."""
    versions = [r[0] for r in _read(spark, path, "menus").select("version").distinct().collect()]
    if versions:
        new = _append(path, {name: working(spark, path, name) for name in TABLES}, versions, buckets)
        for name in reversed(TABLES):
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
            fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
            for found in fs.listStatus(folder):
                if found.getPath().getName().startswith("version=") and found.getPath().getName() != f"version={new}":
                    fs.delete(found.getPath(), True)
    return len(versions)


def start_intake(pages: DataFrame, path: str, checkpoint: str, *, buckets: int = BUCKETS, **trigger) -> StreamingQuery:
    """Start the stream of page records (the schema of ``sources.pages.PAGES``)."""
    return pages.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(lambda df, _: take_in(df, path, buckets=buckets)).start()

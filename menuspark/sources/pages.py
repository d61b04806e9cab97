"""Recognised pages: nested blocks to flat, ordered lines; the images' work list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
WORD = f"struct<text:string,confidence:double,bbox:{BOX}>"
LINE = f"struct<text:string,confidence:double,bbox:{BOX},words:array<{WORD}>>"
PAGES = f"menu_id string, page_id string, page_seq int, page_width double, confidence double, blocks array<struct<paragraphs:array<struct<lines:array<{LINE}>>>>>"


def read_pages(spark: SparkSession, path: str, *, form: str = "json") -> DataFrame:
    """Page records with the fixed schema; nothing is inferred."""
    return spark.read.schema(PAGES).format(form).load(path)


def _box(box: Column) -> Column:
    """A missing box is all zeros."""
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("x0", "y0", "x1", "y1")])
    return F.coalesce(box.cast(BOX), zero)


def flatten_blocks(pages: DataFrame) -> DataFrame:
    """(menu_id, page_id, line_no, text, confidence, bbox, words) of all lines, in page order. A missing text is '' (a line's: its words
    joined), a missing confidence 0."""
    at, keys = ["block_no", "paragraph_no", "no"], ["menu_id", "page_id"]
    out = pages.select(*keys, F.posexplode("blocks").alias("block_no", "b"))
    out = out.select(*keys, "block_no", F.posexplode("b.paragraphs").alias("paragraph_no", "p"))
    out = out.select(*keys, "block_no", "paragraph_no", F.posexplode("p.lines").alias("no", "l"))
    word = lambda w: F.struct(F.coalesce(w["text"], F.lit("")).alias("text"), F.coalesce(w["confidence"].cast("double"), F.lit(0.0)).alias("confidence"), _box(w["bbox"]).alias("bbox"))
    words = F.transform(F.coalesce("l.words", F.array().cast(f"array<{WORD}>")), word)
    out = out.select(*keys, *at, words.alias("words"), "l")
    text = F.coalesce("l.text", F.array_join(F.transform("words", lambda w: w["text"]), " "))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*at)) - 1
    return out.select(*keys, number.alias("line_no"), text.alias("text"), F.coalesce(F.col("l.confidence").cast("double"), F.lit(0.0)).alias("confidence"), _box(F.col("l.bbox")).alias("bbox"), "words")


def pending_pages(images: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Images to work on: the given ids (image_id), else those that are not done."""
    return images.filter(F.col("status") != "done") if ids is None else images.join(ids.select("image_id").distinct(), "image_id", "left_semi")


def restore_images(stored: DataFrame, meta: DataFrame) -> DataFrame:
    """Stored images that the session knows, in creation order (``pos``), interrupted ones pending again."""
    known = meta.withColumn("status", F.when(F.col("status") == "processing", "pending").otherwise(F.col("status")))
    out = stored.select("menu_id", "image_id", "created_at").join(known.drop("created_at"), ["menu_id", "image_id"])
    return out.withColumn("pos", F.row_number().over(Window.partitionBy("menu_id").orderBy("created_at", "image_id")) - 1)

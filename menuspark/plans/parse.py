"""From recognised lines to categories, items and statistics.

The page's order is carried by windows over (menu, page) by line number: the heading above a line, whether a dish was begun since
that heading, and the dish a line goes on with. Usual pages are partitioned by page once; the windows, the hint join and the
groupings use that partitioning. Long pages are cut into blocks of lines that a scan stitches together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..functions.columns import computed
from ..functions.lexicon import NO_NAME, REASONS, UNCATEGORIZED
from ..operators import lines as L
from ..operators.menu import attach_categories, category_id, make_variant
from ..operators.skew import in_blocks
from ..sources.staging import staged

PAGE, LINE = L.PAGE, L.LINE


@dataclass(frozen=True)
class ParseOptions:
    min_price: int = L.MIN_PRICE
    max_price: int = L.MAX_PRICE
    confidence: float = L.CONFIDENCE
    #: Pages with more lines or hints than the one are cut into blocks of about as many lines as the other.
    long_page: int = 10_000
    block_lines: int = 10_000


@dataclass
class Parsed:
    items: DataFrame
    categories: DataFrame
    stats: DataFrame


def split_price_rows(lines: DataFrame, options: ParseOptions = ParseOptions()) -> DataFrame:
    """Lines with text, with ``clean`` text, ``hits`` and ``price_only``: rows that hold nothing but prices."""
    out = computed(lines, clean=T.clean_line_text(F.col("text"))).filter(F.length("clean") > 0)
    out = L.detect_prices(out, min_price=options.min_price, max_price=options.max_price)
    return computed(out, price_only=(F.size("hits") > 0) & (F.length(L.strip_prices(F.col("words"), F.col("hits"))) == 0))


def hint_pool(split: DataFrame, hints: DataFrame) -> DataFrame:
    """The price column's hints, and the price-only rows as hints after them, in line order."""
    rows = split.filter("price_only").select(*PAGE, F.struct(F.lit(1).alias("rank"), F.col("line_no").cast("bigint").alias("no")).alias("hint_no"), F.transform("hits", lambda h: h["value"]).alias("values"), _box("bbox"))
    own = hints.select(*PAGE, F.struct(F.lit(0).alias("rank"), F.col("hint_no").cast("bigint").alias("no")).alias("hint_no"), F.col("values").cast("array<bigint>").alias("values"), _box("bbox"))
    return own.unionByName(rows)


def _box(name: str) -> Column:
    return F.struct(*[F.col(f"{name}.{c}").cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]).alias(name)


def classify_lines(lines: DataFrame, hints: DataFrame, options: ParseOptions = ParseOptions()) -> DataFrame:
    """Usable lines with what each one is: ``is_header``, ``emits`` a dish, ``continues`` one, and ``heading``, ``item_no``.

    Prices are detected once and staged. Pages of usual length are windows; pages of more than ``options.long_page`` lines or hints
    go by blocks of about ``options.block_lines`` lines, with the same results."""
    split = staged(split_price_rows(lines, options), "price-rows")
    pool = hint_pool(split, hints)
    size = split.select(*PAGE, F.lit(1).alias("l"), F.lit(0).alias("h")).unionByName(pool.select(*PAGE, F.lit(0).alias("l"), F.lit(1).alias("h"))).groupBy(*PAGE).agg(F.sum("l").alias("l"), F.sum("h").alias("h"))
    long = staged(size.filter(F.greatest("l", "h") > options.long_page).select(*PAGE), "long-pages")
    if long.isEmpty():
        return _by_page(split, pool)
    whole = _by_page(split.join(long, PAGE, "left_anti"), pool.join(long, PAGE, "left_anti"))
    return whole.unionByName(_by_blocks(split.join(long, PAGE, "left_semi"), pool.join(long, PAGE, "left_semi"), options.block_lines))


def _kinds(usable: DataFrame) -> DataFrame:
    """Lines with ``median_height``, with what each is by itself: ``is_header``, ``named``, ``fits`` a name, ``wordy``, ``market``."""
    c = F.col
    out = usable.withColumn("is_header", (F.size("hits") == 0) & L.is_likely_header(c("clean"), L.line_height(c("bbox")), c("median_height")))
    # Neither counts for headings and lines with prices.
    bare = (F.size("hits") == 0) & ~c("is_header")
    out = computed(out, market=F.when(bare, T.market_pattern(c("clean"))), wordy=F.when(bare, T.is_continuation(c("clean"))).otherwise(False))
    return out.withColumn("named", (F.size("hits") > 0) | c("market").isNotNull()).withColumn("fits", F.length("clean").between(2, 40))


def _carried(kinds: DataFrame, by: list[str]) -> DataFrame:
    """With the ``heading`` so far, the ``segment`` it begins and whether a dish was ``begun`` in that before the line, within ``by``."""
    c, order = F.col, Window.partitionBy(*by).orderBy("line_no")
    out = kinds.withColumn("heading", F.last(F.when(c("is_header"), T.heading_name(c("clean"))), ignorenulls=True).over(order))
    out = out.withColumn("segment", F.sum(F.when(c("is_header"), 1).otherwise(0)).over(order))
    # The last heading and the last dish before the line, in the same order, so that one sort serves all.
    out = out.withColumn("_head", F.last(F.when(c("is_header"), c("line_no")), ignorenulls=True).over(order))
    out = out.withColumn("_dish", F.last(F.when(_starts(), c("line_no")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    return out.withColumn("begun", c("_dish").isNotNull() & (c("_head").isNull() | (c("_dish") > c("_head")))).drop("_head", "_dish")


def _starts() -> Column:
    return ~F.col("is_header") & (F.col("named") | F.col("fits"))


def _settled(carried: DataFrame, by: list[str]) -> DataFrame:
    """With ``continues``, ``emits`` and ``item_no``, the number of dishes so far within ``by``."""
    c = F.col
    out = carried.withColumn("continues", ~c("is_header") & ~c("named") & c("begun") & c("wordy"))
    out = out.withColumn("emits", ~c("is_header") & (c("named") | (c("fits") & ~(c("begun") & c("wordy")))))
    return out.withColumn("item_no", F.sum(F.when(c("emits"), 1).otherwise(0)).over(Window.partitionBy(*by).orderBy("line_no")))


def _by_page(split: DataFrame, pool: DataFrame) -> DataFrame:
    usable = L.reconcile_with_hints(L.hint_for_line(split.filter("not price_only").repartition(*PAGE), pool, bins=False))
    usable = usable.withColumn("median_height", F.percentile(L.line_height(F.col("bbox")), F.lit(0.5)).over(Window.partitionBy(*PAGE)))
    return _settled(_carried(_kinds(usable), PAGE), PAGE)


def _by_blocks(split: DataFrame, pool: DataFrame, block_lines: int) -> DataFrame:
    """The same for long pages. Lines are ranged by page and number; each block is carried through apart, and a scan over one row a
    block gives each what came before it: the heading, whether a dish was begun since, and then how many dishes there were."""
    c, block = F.col, [*PAGE, "_block"]
    own = split.filter("not price_only")
    blocks = staged(in_blocks(own, own.count(), block_lines, *LINE), "page-blocks")
    usable = L.reconcile_with_hints(L.hint_for_line(blocks, pool)).join(L.median_height(blocks), PAGE)
    local = staged(_carried(_kinds(usable), block), "block-lines")
    before = Window.partitionBy(*PAGE).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.struct("line_no", "segment", (c("begun") | _starts()).alias("begun"), "heading")).alias("z")
    ends = local.groupBy(*block).agg(last).select(*block, c("z.heading").alias("heading"), F.when(c("z.begun") | (c("z.segment") > 0), c("z.begun")).alias("begun"))
    starts = ends.select(*block, F.last("heading", ignorenulls=True).over(before).alias("_heading"), F.last("begun", ignorenulls=True).over(before).alias("_begun"))
    whole = local.join(starts, block).withColumn("heading", F.coalesce("heading", "_heading")).withColumn("begun", c("begun") | ((c("segment") == 0) & F.coalesce("_begun", F.lit(False))))
    out = staged(_settled(whole, block).drop("_heading", "_begun"), "block-items")
    dishes = out.groupBy(*block).agg(F.count_if("emits").alias("n"))
    dishes = dishes.select(*block, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n"))
    return out.join(dishes, block).withColumn("item_no", c("item_no") + c("_n")).drop("_block", "_n")


def page_items(classified: DataFrame, options: ParseOptions = ParseOptions()) -> DataFrame:
    """One row per dish of a page: (menu_id, page_id, line_no, category_name, name, description, variants, price_kind, ...)."""
    c = F.col
    text = F.transform(F.array_sort(F.collect_list(F.when(c("continues"), F.struct("line_no", "clean")))), lambda x: x["clean"])
    more = classified.filter("emits or continues").groupBy(*PAGE, "item_no").agg(
        F.max(F.when(c("emits"), F.struct("line_no", "clean", "words", "hits", "market", "confidence", "heading", "inferred"))).alias("row"), F.nullif(F.array_join(text, " "), F.lit("")).alias("description")
    )
    out = more.select(*PAGE, "row.*", "description")
    priced = F.size("hits") > 0
    labels = F.when(F.size("hits") > 1, T.detect_variant_labels(c("clean"))).otherwise(F.array().cast("array<string>"))  # one price has no label
    key = F.concat_ws("\x1f", c("menu_id").cast("string"), c("page_id").cast("string"), c("line_no").cast("string"))
    name = L.strip_prices(c("words"), c("hits"))
    unsure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), c("confidence").cast("double") / 100))
    out = computed(out, _key=key, _name=name, _labels=labels, confidence=unsure, _rest=T.clean_line_text(c("market.rest")))
    no_price = F.array(make_variant(F.substring(F.sha2(F.concat(F.lit("variant\x1f"), c("_key")), 256), 1, 20), review=F.lit(True)))
    ambiguous = (F.size("hits") > 1) & (F.size("_labels") != F.size("hits"))
    reasons = F.array_compact(F.array(
        F.when(c("_name") == "", REASONS["no_name"]), F.when(ambiguous, REASONS["ambiguous"]), F.when(c("confidence") < options.confidence, REASONS["unsure"]),
        F.when(T.is_promo(c("clean")), REASONS["promo"]), F.when(c("inferred"), REASONS["inferred"])))
    reasons = F.when(priced, reasons).when(c("market").isNotNull(), F.array(c("market.note"))).otherwise(F.array(F.lit(REASONS["no_price"])))
    or_else = lambda a, b: F.when(a == "", b).otherwise(a)
    return out.select(
        *PAGE, "line_no", F.substring(F.sha2(F.concat(F.lit("item\x1f"), c("_key")), 256), 1, 20).alias("item_id"), c("heading").alias("category_name"),
        F.when(priced, or_else(c("_name"), F.lit(NO_NAME))).when(c("market").isNotNull(), or_else(c("_rest"), c("clean"))).otherwise(c("clean")).alias("name"), "description",
        F.when(priced, L.build_variants(c("hits"), c("_labels"), c("_key"))).otherwise(no_price).alias("variants"),
        F.when(priced, "fixed").when(c("market").isNotNull(), c("market.kind")).otherwise("unknown").alias("price_kind"), "confidence",
        (~priced | (F.size(reasons) > 0)).alias("needs_review"), reasons.alias("review_reasons"), F.array(c("page_id").cast("string")).alias("source_image_ids"), F.lit("ocr").alias("origin"),
    )


def page_categories(classified: DataFrame, pages: DataFrame) -> DataFrame:
    """(menu_id, category_id, name, order): headings of all pages of a menu, once each, by first place."""
    seq = pages.select(*PAGE, "page_seq")
    heads = classified.filter("is_header").select(*PAGE, "line_no", F.col("heading").alias("name")).join(seq, PAGE)
    first = heads.groupBy("menu_id", "name").agg(F.min(F.struct("page_seq", "line_no")).alias("at"))
    order = (F.row_number().over(Window.partitionBy("menu_id").orderBy("at")) - 1).cast("bigint")
    return first.select("menu_id", category_id(F.col("menu_id"), F.col("name")).alias("category_id"), "name", order.alias("order"))


def parse_stats(classified: DataFrame, items: DataFrame, pages: DataFrame) -> DataFrame:
    """(menu_id, page_id, lines, items_found, flagged) for each page."""
    count = classified.groupBy(*PAGE).agg(F.count("*").alias("lines"))
    found = items.groupBy(*PAGE).agg(F.count("*").alias("items_found"), F.count_if("needs_review").alias("flagged"))
    out = pages.select(*PAGE).join(count, PAGE, "left").join(found, PAGE, "left")
    return out.select(*PAGE, *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("lines", "items_found", "flagged")])


def parse_pages(lines: DataFrame, hints: DataFrame, pages: DataFrame, options: ParseOptions = ParseOptions()) -> Parsed:
    """All pages of all menus. Items are numbered (item_pos) by page_seq and line in their menu. The classified lines are staged, as
    items, categories and statistics all come from them."""
    classified = staged(classify_lines(lines, hints, options), "lines")
    items = page_items(classified, options)
    categories = page_categories(classified, pages)
    numbered = items.join(pages.select(*PAGE, "page_seq"), PAGE)
    pos = (F.row_number().over(Window.partitionBy("menu_id").orderBy("page_seq", "line_no")) - 1).cast("bigint")
    named = attach_categories(numbered.withColumn("item_pos", pos), categories)
    named = named.withColumn("category_id", F.when(F.col("category_name").isNull(), UNCATEGORIZED).otherwise(F.col("category_id")))
    columns = ["menu_id", "item_id", "item_pos", "name", "description", "category_id", "variants", "price_kind", "confidence", "needs_review", "review_reasons", "source_image_ids", "origin"]
    return Parsed(named.select(*columns, "page_id", "line_no"), categories, parse_stats(classified, items, pages))

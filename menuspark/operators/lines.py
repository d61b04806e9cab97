"""Recognised lines: prices on a line, the price column's hints, headings and variants.

Lines are rows keyed (menu_id, page_id, line_no) with text, confidence (0 to 100), bbox and words (text, confidence, bbox) in
reading order. A line's own rules are higher-order functions over its words, so they need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import money, text as T
from ..functions.columns import bound, computed
from ..functions.lexicon import OPTION
from ..sources.staging import staged
from .skew import join_spread

# The results depend on them.
MIN_PRICE, MAX_PRICE, EDGE_BAND, CONFIDENCE = 300, 300_000, 0.35, 0.72
BAND_FRACTION, BAND_SCALE, BAND_PADDING, MIN_OVERLAP = 0.18, 2, 40, 0.5
HITS = "array<struct<value:bigint,index:int,x0:double,x1:double,explicit:boolean>>"
PAGE = ["menu_id", "page_id"]
LINE = [*PAGE, "line_no"]


def detect_prices(lines: DataFrame, *, min_price: int = MIN_PRICE, max_price: int = MAX_PRICE) -> DataFrame:
    """``lines`` with ``hits``: the numbers that act as prices, in reading order.

    A number counts if it is marked as currency, or lies in the outer 35 % of the row at its more crowded edge, or is alone and
    the row's first or last word. Numbers beside units and percentages don't.
    """
    raw = lambda i: F.get("_t", i)
    box = lambda w, x: w["bbox"][x].cast("double")
    word = lambda w, i: F.struct(i.alias("index"), box(w, "x0").alias("x0"), box(w, "x1").alias("x1"), raw(i).alias("raw"))
    is_number = lambda t: F.replace(t, F.lit("₪"), F.lit("")).rlike(r"^\d{1,5}(?:[.,]\d{1,2})?\z") | t.rlike(r"^₪[\s ]*\d")
    # Few words are numbers, and only their neighbours are looked up in the lists.
    out = computed(lines, _t=F.transform("words", lambda w: T.clean_word(w["text"])))
    out = computed(out, _w=F.filter(F.transform("words", word), lambda w: is_number(w["raw"])))
    out = computed(out, _w=F.transform("_w", lambda w: w.withField("value", money.parse_money(w["raw"]))))
    n = F.size("_t")

    def counts(w: Column) -> Column:
        before, after = raw(w["index"] - 1), raw(w["index"] + 1)
        percent = F.coalesce(after.startswith("%"), F.lit(False)) | w["raw"].endswith("%")
        inside = (w["index"] != 0) & (w["index"] != n - 1)
        return w["value"].between(min_price, max_price) & ~percent & ~T.is_unit_word(after) & ~(inside & T.is_unit_word(before))

    def candidate(w: Column) -> Column:
        explicit = w["raw"].contains("₪") | T.is_currency_word(raw(w["index"] - 1)) | T.is_currency_word(raw(w["index"] + 1))
        return F.struct(w["value"].alias("value"), w["index"].alias("index"), w["x0"].alias("x0"), w["x1"].alias("x1"), explicit.alias("explicit"))

    out = computed(out, _c=F.transform(F.filter("_w", counts), candidate))
    low, high = F.array_min(F.transform("words", lambda w: box(w, "x0"))), F.array_max(F.transform("words", lambda w: box(w, "x1")))
    band = F.greatest(F.lit(1.0), high - low) * EDGE_BAND
    out = computed(out, _e=F.filter("_c", lambda c: c["explicit"]), _l=F.filter("_c", lambda c: c["x1"] <= low + band), _r=F.filter("_c", lambda c: c["x0"] >= high - band))
    alone = (F.size("_c") == 1) & F.exists("_c", lambda c: (c["index"] == 0) | (c["index"] == n - 1))
    chosen = (
        F.when(F.size("_e") > 0, F.col("_e"))
        .when((F.size("_l") == 0) & (F.size("_r") == 0), F.when(alone, F.col("_c")).otherwise(F.filter("_c", lambda c: F.lit(False))))
        .when(F.size("_l") >= F.size("_r"), F.col("_l"))
        .otherwise(F.col("_r"))
    )
    out = computed(out, _h=chosen)
    direction = T.line_direction(F.array_join(F.transform("words", lambda w: w["text"]), ""))
    sign = F.when((F.size("_h") > 1) & (direction == "rtl"), -1.0).otherwise(1.0)  # one price has no order
    ordered = F.array_sort(F.transform("_h", lambda c: F.struct((sign * c["x0"]).alias("k"), c["index"].alias("index"), c.alias("c"))))
    hits = F.transform(ordered, lambda o: F.struct(o["c"]["value"].alias("value"), o["c"]["index"].cast("int").alias("index"), o["c"]["x0"].alias("x0"), o["c"]["x1"].alias("x1"), o["c"]["explicit"].alias("explicit")))
    return computed(out, hits=F.coalesce(hits, F.array().cast(HITS))).drop("_t", "_w", "_c", "_e", "_l", "_r", "_h")


def strip_prices(words: Column, hits: Column) -> Column:
    """A line's text without its price words and the currency words beside them."""
    own = F.transform(F.filter(hits, lambda h: h["index"] >= 0), lambda h: h["index"])

    def left(at: Column) -> Column:
        beside = lambda i: F.array_contains(at, i - 1) | F.array_contains(at, i + 1)
        return F.filter(words, lambda w, i: ~(F.array_contains(at, i) | (beside(i) & T.is_currency_word(w["text"]))))

    kept = F.when(F.size(own) == 0, words).otherwise(bound(own, left))
    return T.clean_line_text(F.array_join(F.transform(kept, lambda w: T.clean_word(w["text"])), " "))


# The price column.


def detect_price_side(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(menu_id, page_id, side): where a page's numerals lie, in its left or right 18 %; a tie is left, none is null."""
    word = lines.select(*PAGE, F.explode("words").alias("w")).filter(money.trim(F.col("w.text")).rlike(r"^\d{1,4}(?:[.,]\d{1,2})?\z"))
    centre = (F.col("w.bbox.x0") + F.col("w.bbox.x1")) / 2
    wide = F.col("page_width") > 0
    out = pages.select(*PAGE, "page_width").join(word.select(*PAGE, centre.alias("centre")), PAGE, "left")
    left = F.count_if(wide & (F.col("centre") <= F.col("page_width") * BAND_FRACTION)).alias("n_left")
    right = F.count_if(wide & (F.col("centre") > F.col("page_width") * BAND_FRACTION) & (F.col("centre") >= F.col("page_width") * (1 - BAND_FRACTION))).alias("n_right")
    out = out.groupBy(*PAGE).agg(left, right)
    return out.select(*PAGE, F.when(F.col("n_left") + F.col("n_right") > 0, F.when(F.col("n_left") >= F.col("n_right"), "left").otherwise("right")).alias("side"))


def band_origin(width: Column, side: Column) -> Column:
    return F.when(side == "left", F.lit(0.0)).otherwise(F.round(width * (1 - BAND_FRACTION)))


def band_width(width: Column) -> Column:
    return F.greatest(F.lit(1.0), F.round(width * BAND_FRACTION))


def to_page_box(box: Column, width: Column, side: Column) -> Column:
    """A box in the enlarged strip, in page coordinates."""
    back = lambda c: (box[c] - BAND_PADDING) / BAND_SCALE
    origin = band_origin(width, side)
    return F.struct((origin + back("x0")).alias("x0"), back("y0").alias("y0"), (origin + back("x1")).alias("x1"), back("y1").alias("y1"))


def to_price_hints(strip_lines: DataFrame, *, min_price: int = MIN_PRICE, max_price: int = MAX_PRICE) -> DataFrame:
    """Hints (menu_id, page_id, hint_no, values, bbox) of digits-only strip lines (text, bbox, page_width, side)."""
    tokens = F.transform(F.split("text", rf"{money.SPACE}+"), lambda t: F.regexp_replace(t, r"[^\d.,]", ""))
    values = F.filter(F.transform(F.filter(tokens, lambda t: t != ""), money.parse_money), lambda v: F.coalesce(v.between(min_price, max_price), F.lit(False)))
    out = strip_lines.select(*PAGE, F.col("line_no").alias("hint_no"), values.alias("values"), to_page_box(F.col("bbox"), F.col("page_width"), F.col("side")).alias("bbox"))
    return out.filter(F.size("values") > 0)


def vertical_overlap(a: Column, b: Column) -> Column:
    """The common height of two boxes as a share of the smaller one."""
    common = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    smaller = F.least(a["y1"] - a["y0"], b["y1"] - b["y0"])
    return F.when((common > 0) & (smaller > 0), common / F.nullif(smaller, F.lit(0.0))).otherwise(0.0)


def hint_for_line(lines: DataFrame, hints: DataFrame, *, min_overlap: float = MIN_OVERLAP, bins: bool = True) -> DataFrame:
    """``lines`` with ``hint`` = struct(values, x0, x1, y0, y1): all hints of the page on the line's row, their distinct values in
    hint order; null without one. A box without a height, or no box, is on no row. ``min_overlap`` is above 0.

    With ``bins`` both sides meet by rows of the page, so that work grows with lines, hints and links, and a page is spread over
    tasks. Without, by page: a page's partitioning serves the join and the grouping, but each line looks at all of its page's hints."""
    solid = lambda df, s: df.filter((_height(s) > 0) & (_height(s) < float("inf")))
    a, b = solid(lines.select(*LINE, F.col("bbox").alias("a")), "a"), solid(hints.select(*PAGE, "hint_no", "values", F.col("bbox").alias("b")), "b")
    pairs = (_by_rows(a, b) if bins else a.join(b, PAGE)).filter(vertical_overlap(F.col("a"), F.col("b")) >= min_overlap)
    values = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("hint_no", "values"))), lambda x: x["values"])))
    found = pairs.groupBy(*LINE).agg(F.struct(values.alias("values"), F.min("b.x0").cast("double").alias("x0"), F.max("b.x1").cast("double").alias("x1"), F.min("b.y0").cast("double").alias("y0"), F.max("b.y1").cast("double").alias("y1")).alias("hint"))
    return lines.join(found, LINE, "left")


def _height(box: str) -> Column:
    return (F.col(f"{box}.y1") - F.col(f"{box}.y0")).cast("double")


def _by_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of lines and hints whose boxes ``a`` and ``b`` share a row of the page, each pair once, in the row where the lower of the two
    begins. Rows are as high as the page's mean box, so boxes lie in three rows on average at most, however uneven they are. The
    heights are staged: both sides must cut a page alike."""
    rows = staged(a.select(*PAGE, _height("a").alias("h")).unionByName(b.select(*PAGE, _height("b").alias("h"))).groupBy(*PAGE).agg(F.avg("h").alias("high")), "row-heights")
    row = lambda y: F.floor(y.cast("double") / F.col("high"))
    dealt = lambda df, s: join_spread(df, rows, PAGE).withColumn("row", F.explode(F.sequence(row(F.col(f"{s}.y0")), row(F.col(f"{s}.y1")))))
    met = dealt(a, "a").join(dealt(b, "b").drop("high"), [*PAGE, "row"])
    return met.filter(F.col("row") == F.greatest(row(F.col("a.y0")), row(F.col("b.y0"))))


def prefer_reading(page: Column, column: Column) -> Column:
    """The longer number, as recognition loses digits; the column's on a tie."""
    return F.when(F.length(page.cast("string")) > F.length(column.cast("string")), page).otherwise(column)


def reconcile_with_hints(lines: DataFrame) -> DataFrame:
    """``hits`` of lines with ``hits`` and ``hint`` corrected by the hint, with ``corrected`` and ``inferred``. A row with more
    prices than its hint stays; else both sides are paired by value and the hint's other values are adopted."""
    n, m = F.size("hits"), F.size("hint.values")
    use = F.col("hint").isNotNull() & (m >= n)
    ordered = F.array_sort(F.transform("hits", lambda h, i: F.struct(h["value"].alias("value"), i.alias("i"), h.alias("h"))))
    rebuilt = F.transform(
        F.array_sort("hint.values"),
        lambda v, i: F.coalesce(
            F.when(i < n, F.struct(prefer_reading(F.try_element_at("_o", i + 1)["value"], v).cast("bigint").alias("value"), F.try_element_at("_o", i + 1)["h"]["index"].alias("index"), F.try_element_at("_o", i + 1)["h"]["x0"].alias("x0"), F.try_element_at("_o", i + 1)["h"]["x1"].alias("x1"), F.try_element_at("_o", i + 1)["h"]["explicit"].alias("explicit"))),
            F.struct(v.cast("bigint").alias("value"), F.lit(-1).alias("index"), F.col("hint.x0").alias("x0"), F.col("hint.x1").alias("x1"), F.lit(False).alias("explicit")),
        ),
    )
    out = computed(computed(lines, _o=ordered), _b=F.when(use, rebuilt))
    changed = F.exists(F.transform("_o", lambda o, i: o["value"] != F.try_element_at("_b", i + 1)["value"]), lambda x: F.coalesce(x, F.lit(True)))
    out = out.withColumn("corrected", F.coalesce(F.when(use, changed), F.lit(False))).withColumn("inferred", F.coalesce(use & ((n == 0) | (m > n)), F.lit(False)))
    return computed(out, hits=F.coalesce("_b", "hits")).drop("_o", "_b")


# What a line is.


def build_variants(hits: Column, labels: Column, key: Column) -> Column:
    """Variants of a row's prices: one is unlabelled; several take the labels found in the text if there are as many, else
    numbered options for review. ``key`` makes their ids."""
    confident = F.size(labels) == F.size(hits)
    id_ = lambda i: F.substring(F.sha2(F.concat(F.lit("variant\x1f"), key, F.lit("\x1f"), i.cast("string")), 256), 1, 20)
    option = lambda i: F.concat(F.lit(f"{OPTION} "), (i + 1).cast("string"))
    label = lambda i: F.when(F.size(hits) > 1, F.when(confident, F.try_element_at(labels, i + 1)).otherwise(option(i)))
    return F.transform(hits, lambda h, i: F.struct(id_(i).alias("id"), label(i).alias("label"), h["value"].cast("bigint").alias("price_agorot"), ((F.size(hits) > 1) & ~confident).alias("needs_review")))


def line_height(box: Column) -> Column:
    return F.greatest(F.lit(0.0), (box["y1"] - box["y0"]).cast("double"))


def is_likely_header(text: Column, height: Column, median: Column) -> Column:
    tall = (median > 0) & (height >= median * 1.25) & (T.word_count(text) <= 4)
    return (F.length(text) > 0) & (F.length(text) <= 34) & (T.is_category_word(text) | F.coalesce(tall, F.lit(False)))


def median_height(lines: DataFrame) -> DataFrame:
    """(menu_id, page_id, median_height): exact, the mean of the middle two for an even count."""
    return lines.groupBy(*PAGE).agg(F.percentile(line_height(F.col("bbox")), 0.5).alias("median_height"))

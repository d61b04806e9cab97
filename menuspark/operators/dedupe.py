"""Duplicate dishes of a menu: similar pairs from different images, leaders, merges.

Pairs: small menus are joined with themselves; in large ones only distinct names meet that share a trigram of their prefixes. Dice >= t
means an overlap of at least t / (2 - t) of either side's trigrams, so two such names share one among the first
n - ceil(t / (2 - t) n) + 1 of each in any one order: no pair is lost. The order is from the menu's rarest trigram to its commonest.

Where items come in batches only pairs with a fresh end are looked for: fresh items meet all, the others meet the fresh ones alone.

Leaders: an item belongs to the earliest leader it is similar to, and an item that belongs to one doesn't lead. Menus with few
pairs are folded in order; others go by rounds, in which every item that has no earlier rival left is settled at once, and what rounds
settle too slowly is folded as a sorted stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import money, text as T
from ..sources.staging import staged
from .skew import join_spread

SMALL_MENU, FOLD_PAIRS = 300, 5_000


def with_normal_names(items: DataFrame) -> DataFrame:
    """``items`` with ``normal`` and ``grams``. Only names that aren't in NFKC form for certain go through pandas."""
    plain = items.filter(~T.needs_nfkc(F.col("name"))).withColumn("normal", T.normalize_name(F.col("name")))
    other = items.filter(T.needs_nfkc(F.col("name"))).withColumn("normal", T.normalize_name(F.col("name"), is_nfkc=False))
    return plain.unionByName(other).withColumn("grams", T.trigrams(F.col("normal")))


def price_set() -> Column:
    """An item's prices in order, repeats included."""
    return F.array_sort(F.filter(F.transform("variants", lambda v: v["price_agorot"]), lambda p: p.isNotNull()))


def prices_compatible(a: Column, b: Column) -> Column:
    return (F.size(a) == 0) | (F.size(b) == 0) | (a == b)


def same_image(a: Column, b: Column) -> Column:
    """Every image of a is one of b's, neither being without."""
    return (F.size(a) > 0) & (F.size(b) > 0) & (F.size(F.array_except(a, b)) == 0)


def names_of(items: DataFrame) -> DataFrame:
    """(menu_id, item_id, normal, grams) of the items with a name: what finding pairs needs of it, to be kept for later batches."""
    own = items.select("menu_id", "item_id", "name").filter(money.trim(F.col("name")) != "")
    return with_normal_names(own).select("menu_id", "item_id", "normal", "grams")


def duplicate_pairs(items: DataFrame, *, threshold: float = T.SIMILARITY_THRESHOLD, small_menu: int = SMALL_MENU, names: DataFrame | None = None) -> DataFrame:
    """(menu_id, pos_a, pos_b, target_id, source_id, score, auto, reason) of all similar pairs, a before b. Names and their trigrams are
    made once and staged, as every side of every join reads them. ``names``: those made before (``names_of``) with a column ``fresh``; then
    the pairs with a fresh end, and no others, are found."""
    if names is None:
        own = with_normal_names(items.select("menu_id", "item_id", "item_pos", "name", "variants", "source_image_ids").filter(money.trim(F.col("name")) != ""))
    else:
        own = items.select("menu_id", "item_id", "item_pos", "variants", "source_image_ids").join(names.select("menu_id", "item_id", "normal", "grams", "fresh"), ["menu_id", "item_id"])
    more = [] if names is None else ["fresh"]
    own = staged(own.select("menu_id", "item_id", F.col("item_pos").alias("pos"), "normal", "grams", price_set().alias("prices"), F.col("source_image_ids").alias("images"), *more), "names")
    large = staged(own.groupBy("menu_id").agg(F.count("*").alias("n")).filter(F.col("n") > small_menu).select("menu_id"), "large-menus")
    if large.isEmpty():
        return _scored(_all_candidates(own, threshold), threshold)
    small = _all_candidates(own.join(large, "menu_id", "left_anti"), threshold)
    return _scored(small, threshold).unionByName(_scored(_prefix_candidates(own.join(large, "menu_id", "left_semi"), threshold), threshold))


def _side(own: DataFrame, s: str) -> DataFrame:
    return own.select("menu_id", *[F.col(c).alias(f"{c}_{s}") for c in own.columns if c != "menu_id"])


def _sides(own: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """What meets what as a and b: everything, or all pairs with a fresh end, each once."""
    if "fresh" not in own.columns:
        return [(_side(own, "a"), _side(own, "b"))]
    fresh = own.filter("fresh")
    return [(_side(fresh, "a"), _side(own, "b")), (_side(own.filter("not fresh"), "a"), _side(fresh, "b"))]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _near_sizes(a: Column, b: Column, threshold: float) -> Column:
    """Whether names of so many trigrams can be similar at all."""
    return F.least(a, b) >= F.greatest(a, b) * _share(threshold) - 1e-9


def _share(threshold: float) -> float:
    """The share of either side's trigrams that similar names have in common at least."""
    return threshold / (2 - threshold)


def _all_candidates(own: DataFrame, threshold: float) -> DataFrame:
    near = (F.col("pos_a") < F.col("pos_b")) & _near_sizes(F.size("grams_a"), F.size("grams_b"), threshold)
    return _union([a.join(b, "menu_id").filter(near) for a, b in _sides(own)])


def prefixes(names: DataFrame, threshold: float) -> DataFrame:
    """(menu_id, normal, n, g): each name's n - ceil(share n) + 1 rarest trigrams, by how many names of the menu have them; n counts all. A word that
    thousands of dishes begin with is so common that its trigrams come last and stay out."""
    more = [c for c in names.columns if c == "fresh"]
    every = staged(names.select("menu_id", "normal", F.size("grams").alias("n"), *more, F.explode("grams").alias("g")), "grams")
    counts = staged(every.groupBy("menu_id", "g").agg(F.count("*").alias("names")), "gram-counts")
    ranked = join_spread(every, counts, ["menu_id", "g"]).withColumn("nth", F.row_number().over(Window.partitionBy("menu_id", "normal").orderBy("names", "g")))
    return ranked.filter(F.col("nth") <= F.greatest(F.lit(1), F.col("n") - F.ceil(F.col("n") * _share(threshold) - 1e-9) + 1)).select("menu_id", "normal", "n", "g", *more)


def _prefix_candidates(own: DataFrame, threshold: float) -> DataFrame:
    """Pairs of a large menu's distinct names that share a prefix trigram, and equal names, as items."""
    more = [F.max("fresh").alias("fresh")] if "fresh" in own.columns else []
    names = staged(own.groupBy("menu_id", "normal").agg(F.first("grams").alias("grams"), *more), "distinct-names")
    tokens = staged(prefixes(names, threshold), "prefixes")
    met = _union([join_spread(a.withColumnRenamed("g_a", "g"), b.withColumnRenamed("g_b", "g"), ["menu_id", "g"]) for a, b in _sides(tokens)])
    met = met.filter((F.col("normal_a") < F.col("normal_b")) & _near_sizes(F.col("n_a"), F.col("n_b"), threshold)).select("menu_id", "normal_a", "normal_b").distinct()
    sets = names.select("menu_id", "normal", "grams")
    left, right = (sets.select("menu_id", F.col("normal").alias(f"normal_{s}"), F.col("grams").alias(f"grams_{s}")) for s in "ab")
    similar = met.join(left, ["menu_id", "normal_a"]).join(right, ["menu_id", "normal_b"])
    similar = similar.filter(T.dice(F.col("normal_a"), F.col("normal_b"), F.col("grams_a"), F.col("grams_b")) >= threshold).select("menu_id", F.col("normal_a").alias("x"), F.col("normal_b").alias("y"))
    equal = names.filter("fresh") if more else names
    both = staged(similar.unionByName(similar.select("menu_id", F.col("y").alias("x"), F.col("x").alias("y"))).unionByName(equal.select("menu_id", F.col("normal").alias("x"), F.col("normal").alias("y"))), "similar-names")
    partners = both.select("menu_id", F.col("x").alias("normal_a"), F.col("y").alias("normal_b"))
    return _union([join_spread(join_spread(a, partners, ["menu_id", "normal_a"]), b, ["menu_id", "normal_b"]).filter("pos_a < pos_b") for a, b in _sides(own)])


def _scored(pairs: DataFrame, threshold: float) -> DataFrame:
    c = F.col
    out = pairs.filter(~same_image(c("images_a"), c("images_b"))).withColumn("score", T.dice(c("normal_a"), c("normal_b"), c("grams_a"), c("grams_b"))).filter(c("score") >= threshold)
    compatible = prices_compatible(c("prices_a"), c("prices_b"))
    auto = (c("normal_a") == c("normal_b")) & compatible
    return out.select("menu_id", "pos_a", "pos_b", c("item_id_a").alias("target_id"), c("item_id_b").alias("source_id"), "score", auto.alias("auto"), T.duplicate_reason(c("score"), auto, compatible).alias("reason"))


def leaders(pairs: DataFrame, *, fold_pairs: int = FOLD_PAIRS) -> DataFrame:
    """Those of the pairs that stand when items are taken in order: each item is consumed once, by its earliest leader."""
    pairs = staged(pairs, "pairs")  # they are read several times, and cost more to find than to keep
    size = pairs.groupBy("menu_id").agg(F.count("*").alias("n"))
    small = size.filter(F.col("n") <= fold_pairs).select("menu_id")
    large = size.filter(F.col("n") > fold_pairs).select("menu_id")
    folded = _fold(pairs.join(small, "menu_id", "left_semi"))
    if large.isEmpty():
        return folded
    return folded.unionByName(_rounds(pairs.join(large, "menu_id", "left_semi")))


def _fold(pairs: DataFrame) -> DataFrame:
    """In order within a menu: a pair stands if neither end has been consumed."""
    edge = F.array_sort(F.collect_list(F.struct("pos_a", "pos_b")))
    start = F.struct(F.array().cast("array<bigint>").alias("used"), F.array().cast("array<struct<pos_a:bigint,pos_b:bigint>>").alias("kept"))

    def step(acc: Column, e: Column) -> Column:
        free = ~F.array_contains(acc["used"], e["pos_a"]) & ~F.array_contains(acc["used"], e["pos_b"])
        return F.when(free, F.struct(F.array_append(acc["used"], e["pos_b"]).alias("used"), F.array_append(acc["kept"], e).alias("kept"))).otherwise(acc)

    own = pairs.select("menu_id", F.col("pos_a").cast("bigint").alias("pos_a"), F.col("pos_b").cast("bigint").alias("pos_b"))
    kept = own.groupBy("menu_id").agg(edge.alias("e")).select("menu_id", F.explode(F.aggregate("e", start, step)["kept"]).alias("k")).select("menu_id", "k.pos_a", "k.pos_b")
    return pairs.join(kept, ["menu_id", "pos_a", "pos_b"], "left_semi")


def _rounds(pairs: DataFrame) -> DataFrame:
    """The same without collecting a menu: in each round the items without an earlier undecided neighbour lead, and their
    neighbours are consumed. Rounds are staged. They settle most at once but for long chains of similar names, which give one item a
    round: once a round leaves over half of its pairs, the rest is folded as a stream."""
    left, gone = staged(pairs.select("menu_id", "pos_a", "pos_b"), "pairs"), None
    before = left.count()
    while before:
        lead = left.select("menu_id", F.col("pos_a").alias("pos")).distinct().join(left.select("menu_id", F.col("pos_b").alias("pos")).distinct(), ["menu_id", "pos"], "left_anti")
        consumed = staged(left.join(lead.withColumnRenamed("pos", "pos_a"), ["menu_id", "pos_a"], "left_semi").select("menu_id", F.col("pos_b").alias("pos")).distinct(), "consumed")
        rest = left.join(lead.withColumnRenamed("pos", "pos_a"), ["menu_id", "pos_a"], "left_anti")
        for end in ("pos_a", "pos_b"):
            rest = rest.join(consumed.withColumnRenamed("pos", end), ["menu_id", end], "left_anti")
        left = staged(rest, "pairs")
        after = left.count()
        if 2 * after > before:
            consumed, after = consumed.unionByName(staged(_streamed(left), "consumed")), 0
        gone = consumed if gone is None else gone.unionByName(consumed)
        before = after
    # Who was never consumed leads, also an item whose rivals all went before it was looked at.
    settled = pairs if gone is None else pairs.join(gone.withColumnRenamed("pos", "pos_a"), ["menu_id", "pos_a"], "left_anti")
    first = settled.groupBy("menu_id", "pos_b").agg(F.min("pos_a").alias("pos_a"))
    return settled.join(first, ["menu_id", "pos_a", "pos_b"], "left_semi")


def _streamed(pairs: DataFrame) -> DataFrame:
    """(menu_id, pos) of the items that folding in order consumes. A menu's pairs come sorted by Spark, outside the heap; a task holds the
    positions of the menu it is at that have been consumed, nothing else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        menu, used = None, set()
        for batch in batches:
            keep = []
            for k, (m, a, b) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)):
                if m != menu:
                    menu, used = m, set()
                if a not in used and b not in used:
                    used.add(b)
                    keep.append(k)
            taken = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(2)], names=["menu_id", "pos"])

    schema = StructType([pairs.schema["menu_id"], StructField("pos", pairs.schema["pos_b"].dataType)])
    return pairs.select("menu_id", "pos_a", "pos_b").repartition("menu_id").sortWithinPartitions("menu_id", "pos_a", "pos_b").mapInArrow(run, schema)


def find_duplicates(items: DataFrame, **more) -> DataFrame:
    return leaders(duplicate_pairs(items, **more))


def dismiss_pairs(pairs: DataFrame, dismissed: DataFrame) -> DataFrame:
    """Suggestions (not automatic) without the dismissed (menu_id, target_id, source_id)."""
    return pairs.filter("not auto").join(dismissed, ["menu_id", "target_id", "source_id"], "left_anti")


def merge_items(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sources merged into targets (menu_id, target_id, source_id), in the sources' order: variants by label and price, the
    longer description, the higher confidence, review only if all need it, reasons and images united. Null lists count as empty.

    Only items of the pairs are grouped. No group is collected: single values are partial aggregates, and lists are exploded,
    reduced to first places in tasks before the shuffle, and put together from what is distinct."""
    lead = staged(pairs.select("menu_id", F.col("source_id").alias("item_id"), "target_id"), "merges")
    ends = lead.select("menu_id", "item_id").unionByName(lead.select("menu_id", F.col("target_id").alias("item_id"))).distinct()
    lists = ("review_reasons", "source_image_ids")
    alone = items.join(ends, ["menu_id", "item_id"], "left_anti").withColumns({c: F.array_distinct(c) for c in lists})
    group, fields, place = ["menu_id", "leader"], [c for c in items.columns if c != "menu_id"], F.struct("is_source", "item_pos")
    own = items.join(ends, ["menu_id", "item_id"], "left_semi").join(lead, ["menu_id", "item_id"], "left")
    own = staged(own.select("menu_id", F.coalesce("target_id", "item_id").alias("leader"), F.col("target_id").isNotNull().alias("is_source"), "item_pos", F.struct(*fields).alias("i")), "merging")
    review = F.bool_and("i.needs_review")
    out = own.groupBy(*group).agg(
        F.min_by("i", place).alias("t"), F.min_by("i.description", F.struct(-F.length(F.coalesce("i.description", F.lit(""))), "is_source", "item_pos")).alias("description"),
        F.max("i.confidence").alias("confidence"), F.when(F.max(F.col("i.needs_review").isNull()) & F.coalesce(review, F.lit(True)), F.lit(None)).otherwise(review).alias("needs_review"),
    )
    for name in ("variants", *lists):
        values = own.select(*group, "is_source", "item_pos", F.posexplode(f"i.{name}").alias("nth", "v"))
        out = out.join((_distinct_variants if name == "variants" else _distinct_values)(values, group).withColumnRenamed("all", name), group, "left")
    new = {c: F.coalesce(F.col(c), F.array().cast(items.schema[c].dataType)) for c in ("variants", *lists)} | {c: F.col(c) for c in ("description", "confidence", "needs_review")}
    merged = out.select("menu_id", *[new.get(c, F.col(f"t.{c}")).alias(c) for c in fields])
    return alone.select(*items.columns).unionByName(merged.select(*items.columns))


def _in_place(at: str) -> Column:
    """The values of collected (is_source, item_pos, nth, v), in order."""
    return F.transform(F.array_sort(at), lambda x: x["v"])


def _distinct_values(values: DataFrame, group: list[str]) -> DataFrame:
    first = values.groupBy(*group, "v").agg(F.min(F.struct("is_source", "item_pos", "nth")).alias("at")).select(*group, "at.*", "v")
    return first.groupBy(*group).agg(F.collect_list(F.struct("is_source", "item_pos", "nth", "v")).alias("at")).select(*group, _in_place("at").alias("all"))


def _distinct_variants(values: DataFrame, group: list[str]) -> DataFrame:
    """All of the target's variants; of a label and price it doesn't have, the sources' first."""
    place = F.struct("is_source", "item_pos", "nth", "v")
    key = [F.coalesce("v.label", F.lit("")).alias("label"), F.col("v.price_agorot").alias("price")]
    each = values.groupBy(*group, *key).agg(F.min(place).alias("first"), F.collect_list(F.when(~F.col("is_source"), place)).alias("own"))
    kept = each.select(*group, F.when(F.size("own") > 0, F.col("own")).otherwise(F.array("first")).alias("at"))
    return kept.groupBy(*group).agg(F.flatten(F.collect_list("at")).alias("at")).select(*group, _in_place("at").alias("all"))


def apply_auto_merges(items: DataFrame, **more) -> tuple[DataFrame, DataFrame]:
    """Items with the automatic pairs merged, and the other pairs as suggestions."""
    found = find_duplicates(items, **more)
    return merge_items(items, found.filter("auto")), found.filter("not auto")

"""Menus: items, variants and categories; prices, edits, groups and selections.

Items are rows keyed (menu_id, item_id) with an array of variant structs (id, label, price_agorot, needs_review).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import money, text as T
from ..functions.lexicon import NO_CATEGORY, NO_NAME, REASONS, UNCATEGORIZED
from .skew import join_spread

VARIANT = "struct<id:string,label:string,price_agorot:bigint,needs_review:boolean>"
PRICE_KINDS = ("fixed", "market", "byWeight", "unknown")


# Prices.


def has_usable_price(kind: Column, price: Column) -> Column:
    return F.coalesce((kind == "fixed") & (price > 0), F.lit(False))


def item_has_any_usable_price() -> Column:
    return F.coalesce((F.col("price_kind") == "fixed") & F.exists("variants", lambda v: F.coalesce(v["price_agorot"] > 0, F.lit(False))), F.lit(False))


def needs_review() -> Column:
    return F.col("needs_review") | F.exists("variants", lambda v: v["needs_review"])


def items_needing_review(items: DataFrame) -> DataFrame:
    return items.filter(needs_review())


def variants_of(items: DataFrame) -> DataFrame:
    """One row per variant, with the item's columns and variant_pos."""
    out = items.select(*[c for c in items.columns if c != "variants"], F.posexplode("variants").alias("variant_pos", "v"))
    return out.select(*[c for c in out.columns if c != "v"], F.col("v.id").alias("variant_id"), F.col("v.label").alias("label"), F.col("v.price_agorot").alias("price_agorot"), F.col("v.needs_review").alias("variant_needs_review"))


# Selections.


def resolve_selections(selections: DataFrame, items: DataFrame) -> DataFrame:
    """Selections with item and variant; those that name a missing one go. An unusable price is null and counts 0. A popular dish's
    selections are spread over tasks."""
    own = variants_of(items.select("menu_id", "item_id", "category_id", "price_kind", "variants")).select("menu_id", "item_id", "variant_id", "category_id", "price_kind", F.col("price_agorot").alias("p"))
    out = join_spread(selections, own, ["menu_id", "item_id", "variant_id"])
    price = F.when(has_usable_price(F.col("price_kind"), F.col("p")), F.col("p"))
    out = out.withColumn("price_agorot", price).drop("p", "price_kind")
    return out.withColumn("line_total_agorot", F.coalesce("price_agorot", F.lit(0)) * F.col("qty").cast("bigint"))


def prune_selections(selections: DataFrame, items: DataFrame) -> DataFrame:
    """Only selections whose item and variant exist."""
    keys = ["menu_id", "item_id", "variant_id"]
    return selections.join(variants_of(items.select("menu_id", "item_id", "variants")).select(*keys), keys, "left_semi")


def drop_orphans(selections: DataFrame, removed_items: DataFrame, removed_variants: DataFrame | None = None) -> DataFrame:
    """Selections without those of removed items (menu_id, item_id) and variants (menu_id, item_id, variant_id)."""
    out = selections.join(removed_items.select("menu_id", "item_id"), ["menu_id", "item_id"], "left_anti")
    return out if removed_variants is None else out.join(removed_variants, ["menu_id", "item_id", "variant_id"], "left_anti")


def selected_per_category(resolved: DataFrame) -> DataFrame:
    """(session_id, category_id, units) over all resolved selections, without a price too."""
    return resolved.groupBy("session_id", "category_id").agg(F.sum(F.col("qty").cast("bigint")).alias("units"))


def add_to_order(selections: DataFrame, added: DataFrame) -> DataFrame:
    """An order with a suggestion's lines: quantities of a variant add up."""
    keys = ["session_id", "menu_id", "item_id", "variant_id"]
    return selections.select(*keys, "qty").unionByName(added.select(*keys, "qty")).groupBy(*keys).agg(F.sum("qty").alias("qty"))


# Candidates.


def select_candidates(items: DataFrame, categories: DataFrame) -> DataFrame:
    """One row per usable variant. Spark broadcasts the categories where they are small enough."""
    out = variants_of(items).filter(has_usable_price(F.col("price_kind"), F.col("price_agorot")))
    names = categories.select("menu_id", "category_id", F.col("name").alias("category_name"))
    out = out.join(names, ["menu_id", "category_id"], "left")
    return out.select("menu_id", "item_id", "item_pos", "variant_id", "variant_pos", F.coalesce(F.nullif("name", F.lit("")), F.lit(NO_NAME)).alias("name"), F.col("label").alias("variant_label"), "category_id", F.coalesce("category_name", F.lit(NO_CATEGORY)).alias("category_name"), "price_agorot")


def confirmed_only(df: DataFrame, menus: DataFrame) -> DataFrame:
    return df.join(menus.filter("confirmed").select("menu_id"), "menu_id", "left_semi")


def category_names(items: DataFrame, categories: DataFrame) -> DataFrame:
    """Items with category_name, the default where the category is unknown."""
    names = categories.select("menu_id", "category_id", F.col("name").alias("category_name"))
    return items.join(names, ["menu_id", "category_id"], "left").withColumn("category_name", F.coalesce("category_name", F.lit(NO_CATEGORY)))


# Groups and counters.


def items_by_category(items: DataFrame, categories: DataFrame) -> DataFrame:
    """(menu_id, category_id, name, order, item_ids): categories with items, by order; items of unknown categories last."""
    known = categories.select("menu_id", "category_id", "name", "order")
    count = categories.groupBy("menu_id").agg(F.count("*").alias("n"))
    out = items.select("menu_id", "item_id", "item_pos", "category_id").join(known, ["menu_id", "category_id"], "left").join(count, "menu_id", "left")
    orphan = F.col("order").isNull()
    out = out.withColumn("category_id", F.when(orphan, UNCATEGORIZED).otherwise(F.col("category_id"))).withColumn("name", F.when(orphan, NO_CATEGORY).otherwise(F.col("name")))
    out = out.withColumn("rank", F.when(orphan, F.coalesce("n", F.lit(0))).otherwise(F.col("order")).cast("bigint"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("item_pos", "item_id"))), lambda x: x["item_id"])
    return out.groupBy("menu_id", "category_id", "name", F.col("rank").alias("order")).agg(listed.alias("item_ids"))


def review_counts(items: DataFrame) -> DataFrame:
    """(menu_id, items, priced, flagged, confirmable): priced means an amount above 0, of whatever kind."""
    priced = F.exists("variants", lambda v: F.coalesce(v["price_agorot"] > 0, F.lit(False)))
    out = items.groupBy("menu_id").agg(F.count("*").alias("items"), F.count_if(priced).alias("priced"), F.count_if(needs_review()).alias("flagged"))
    return out.withColumn("confirmable", F.col("priced") > 0)


def image_counts(items: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items per image, and (menu_id, failed): how many images of a menu failed."""
    count = items.select("menu_id", F.explode("source_image_ids").alias("image_id")).groupBy("menu_id", "image_id").agg(F.count("*").alias("item_count"))
    return count, images.groupBy("menu_id").agg(F.count_if(F.col("status") == "error").alias("failed"))


def search_menu(items: DataFrame, query: str, category_id: str | None = None) -> DataFrame:
    """Items whose normalised name or description holds the normalised query; a blank query keeps all."""
    found = items if category_id is None else items.filter(F.col("category_id") == category_id)
    needle = T.normalize_name(F.lit(query))
    has = lambda c: F.contains(T.normalize_name(F.coalesce(F.col(c), F.lit(""))), needle)
    return found.filter((needle == "") | has("name") | has("description"))


# Edits. None changes an item's id or place.


def upsert_items(items: DataFrame, new: DataFrame) -> DataFrame:
    """New versions replace items of their id in their place; unknown ids are added after the menu's last item, in the order
    of the given item_pos."""
    keys, rest = ["menu_id", "item_id"], [c for c in items.columns if c not in ("menu_id", "item_id", "item_pos")]
    a, b = items.withColumn("had", F.lit(True)), new.select(*keys, F.col("item_pos").alias("new_pos"), *[F.col(c).alias(f"new_{c}") for c in rest], F.lit(True).alias("has"))
    out = a.join(b, keys, "full_outer")
    merged = out.select(*keys, "item_pos", "new_pos", "had", *[F.when(F.col("has"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in rest])
    last = F.coalesce(F.max("item_pos").over(Window.partitionBy("menu_id")), F.lit(-1))
    added = F.row_number().over(Window.partitionBy("menu_id", F.col("had").isNull()).orderBy("new_pos", "item_id"))
    merged = merged.withColumn("item_pos", F.when(F.col("had").isNull(), (last + added).cast("bigint")).otherwise(F.col("item_pos").cast("bigint")))
    return merged.select(*keys, "item_pos", *rest).select(*items.columns)


def update_items(items: DataFrame, where: Column, patch: dict[str, Column]) -> DataFrame:
    """Columns patched where the condition holds; ids can't be."""
    own = {k: v for k, v in patch.items() if k not in ("menu_id", "item_id")}
    return items.withColumns({k: F.when(F.coalesce(where, F.lit(False)), v).otherwise(F.col(k)) for k, v in own.items()})


def remove_items(items: DataFrame, removed: DataFrame) -> DataFrame:
    return items.join(removed.select("menu_id", "item_id"), ["menu_id", "item_id"], "left_anti")


def make_variant(id: Column, label: Column | None = None, price: Column | None = None, review: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(id.cast("string").alias("id"), (none if label is None else label).cast("string").alias("label"), (none if price is None else price).cast("bigint").alias("price_agorot"), (F.lit(False) if review is None else review).alias("needs_review"))


def update_variant(variants: Column, variant_id: Column, patch: dict[str, Column]) -> Column:
    own = {k: v for k, v in patch.items() if k != "id"}
    fields = ("id", "label", "price_agorot", "needs_review")
    return F.transform(variants, lambda v: F.struct(*[F.when(v["id"] == variant_id, own[f]).otherwise(v[f]).alias(f) if f in own else v[f].alias(f) for f in fields]))


def add_variant(variants: Column, variant: Column) -> Column:
    return F.array_append(variants, variant.cast(VARIANT))


def remove_variant(variants: Column, variant_id: Column) -> Column:
    """The last variant of an item is never removed."""
    return F.when(F.size(variants) > 1, F.filter(variants, lambda v: v["id"] != variant_id)).otherwise(variants)


def ensure_categories(existing: DataFrame, names: DataFrame) -> DataFrame:
    """``existing`` categories and new ones for (menu_id, name, seq) that no category has after trimming: blank ones get the
    default name; order counts on from the menu's categories. Ids are hashes of menu and name."""
    wanted = names.select("menu_id", money.trim(F.col("name")).alias("wanted"), "seq").groupBy("menu_id", "wanted").agg(F.min("seq").alias("seq"))
    new = wanted.join(existing.select("menu_id", F.col("name").alias("wanted")), ["menu_id", "wanted"], "left_anti")
    count = existing.groupBy("menu_id").agg(F.count("*").alias("n"))
    new = new.join(count, "menu_id", "left").withColumn("order", (F.coalesce("n", F.lit(0)) + F.row_number().over(Window.partitionBy("menu_id").orderBy("seq")) - 1).cast("bigint"))
    new = new.withColumn("name", F.when(F.col("wanted") == "", NO_CATEGORY).otherwise(F.col("wanted"))).withColumn("category_id", category_id(F.col("menu_id"), F.col("wanted")))
    own = ["menu_id", "category_id", "name", "order"]
    return existing.select(*own[:3], F.col("order").cast("bigint").alias("order")).unionByName(new.select(*own))


def category_id(menu: Column, name: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x1f", F.lit("category"), menu.cast("string"), name), 256), 1, 20)


def rename_category(categories: DataFrame, menu_id, category: str, name: str) -> DataFrame:
    return categories.withColumn("name", F.when((F.col("menu_id") == menu_id) & (F.col("category_id") == category), name).otherwise(F.col("name")))


def attach_categories(parsed: DataFrame, categories: DataFrame) -> DataFrame:
    """Parsed items (menu_id, category_name) get the menu's category of that name, else none."""
    own = categories.groupBy("menu_id", F.col("name").alias("category_name")).agg(F.min_by("category_id", "order").alias("category_id"))
    return parsed.drop("category_id").join(own, ["menu_id", "category_name"], "left").withColumn("category_id", F.coalesce("category_id", F.lit(UNCATEGORIZED)))


def remove_images(items: DataFrame, removed: DataFrame) -> DataFrame:
    """Without items that come from one removed image (menu_id, image_id) alone; other items lose it from their sources."""
    gone = removed.groupBy("menu_id").agg(F.collect_set("image_id").alias("gone"))
    out = items.join(gone, "menu_id", "left")
    hit = F.coalesce(F.exists("source_image_ids", lambda i: F.array_contains("gone", i)), F.lit(False))
    out = out.filter(~(hit & (F.size("source_image_ids") == 1)))
    kept = F.when(F.col("gone").isNull(), F.col("source_image_ids")).otherwise(F.filter("source_image_ids", lambda i: ~F.array_contains("gone", i)))
    return out.withColumn("source_image_ids", kept).select(*items.columns)


def with_item_defaults(raw: DataFrame) -> DataFrame:
    """Missing fields of items get their defaults; an item without variants gets one without a price. New ids are hashes of
    menu and place, so a repeated task makes the same ones."""
    place = F.concat_ws("\x1f", F.col("menu_id").cast("string"), F.col("item_pos").cast("string"))
    none = F.lit(None)
    has = lambda c, kind: F.col(c).cast(kind) if c in raw.columns else none.cast(kind)
    variants = F.coalesce(has("variants", f"array<{VARIANT}>"), F.array().cast(f"array<{VARIANT}>"))
    first = F.array(make_variant(F.substring(F.sha2(F.concat(F.lit("variant"), place), 256), 1, 20))).cast(f"array<{VARIANT}>")
    variants = F.transform(variants, lambda v: F.struct(v["id"].alias("id"), v["label"].alias("label"), v["price_agorot"].alias("price_agorot"), F.coalesce(v["needs_review"], F.lit(False)).alias("needs_review")))
    return raw.select(
        "menu_id", "item_pos", F.coalesce(has("item_id", "string"), F.substring(F.sha2(F.concat(F.lit("item"), place), 256), 1, 20)).alias("item_id"),
        F.coalesce(has("name", "string"), F.lit("")).alias("name"), has("description", "string").alias("description"),
        F.coalesce(has("category_id", "string"), F.lit(UNCATEGORIZED)).alias("category_id"), F.when(F.size(variants) > 0, variants).otherwise(first).alias("variants"),
        F.coalesce(has("price_kind", "string"), F.lit("fixed")).alias("price_kind"), F.coalesce(has("confidence", "double"), F.lit(1.0)).alias("confidence"),
        F.coalesce(has("needs_review", "boolean"), F.lit(False)).alias("needs_review"), F.coalesce(has("review_reasons", "array<string>"), F.array().cast("array<string>")).alias("review_reasons"),
        F.coalesce(has("source_image_ids", "array<string>"), F.array().cast("array<string>")).alias("source_image_ids"), F.coalesce(has("origin", "string"), F.lit("manual")).alias("origin"),
    )


def add_manual_items(items: DataFrame, requests: DataFrame, categories: DataFrame) -> DataFrame:
    """An empty flagged item for each request (menu_id, seq, category_id or null) after the menu's items: its category is the
    given one, else the menu's first, else none."""
    first = categories.groupBy("menu_id").agg(F.min_by("category_id", "order").alias("first_category"))
    last = items.groupBy("menu_id").agg(F.max("item_pos").alias("last"))
    new = requests.join(first, "menu_id", "left").join(last, "menu_id", "left")
    new = new.withColumn("item_pos", (F.coalesce("last", F.lit(-1)) + F.row_number().over(Window.partitionBy("menu_id").orderBy("seq"))).cast("bigint"))
    new = new.withColumn("category_id", F.coalesce("category_id", "first_category", F.lit(UNCATEGORIZED))).withColumns({"needs_review": F.lit(True), "review_reasons": F.array(F.lit(REASONS["manual"]))})
    made = with_item_defaults(new.select("menu_id", "item_pos", "category_id", "needs_review", "review_reasons"))
    return items.unionByName(made.select(*items.columns))

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from menuspark.functions import text as T
from menuspark.operators import dedupe
from tests.fixtures import ITEMS, item
from tests.test_functions import plain_dice


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), ITEMS)


def test_pairs(spark):
    same = [item("a", 0, "חומוס הבית", 3200, "1"), item("b", 1, "חומוס הבית", 3200, "2")]
    found = dedupe.find_duplicates(frame(spark, *same)).collect()
    assert [(r["target_id"], r["source_id"], r["auto"]) for r in found] == [("a", "b", True)]
    assert dedupe.find_duplicates(frame(spark, item("a", 0, "חומוס הבית", 1, "1"), item("b", 1, "חומוס הבית", 1, "1"))).count() == 0
    differ = dedupe.find_duplicates(frame(spark, item("a", 0, "בירה מהחבית", 2200, "1"), item("b", 1, "בירה מהחבית", 3200, "2"))).first()
    assert not differ["auto"] and "גדלים" in differ["reason"]
    assert dedupe.find_duplicates(frame(spark, item("a", 0, "חומוס הבית", 1, "1"), item("b", 1, "שניצל עוף", 2, "2"))).count() == 0
    assert dedupe.find_duplicates(frame(spark, item("a", 0, "", 1, "1"), item("b", 1, " ", 1, "2"))).count() == 0


def test_auto_merges(spark):
    items = frame(spark, item("a", 0, "חומוס הבית", 3200, "1", "עם שמן זית"), item("b", 1, "חומוס הבית", 3200, "2"), item("c", 2, "בירה מהחבית", 2200, "1"), item("d", 3, "בירה מהחבית", 3200, "2"))
    merged, suggestions = dedupe.apply_auto_merges(items)
    got = {r["item_id"]: r for r in merged.collect()}
    assert sorted(got) == ["a", "c", "d"] and suggestions.count() == 1
    assert got["a"]["description"] == "עם שמן זית" and got["a"]["source_image_ids"] == ["1", "2"] and len(got["a"]["variants"]) == 1
    gone = suggestions.select("menu_id", "target_id", "source_id")
    assert dedupe.dismiss_pairs(suggestions, gone).count() == 0


def test_merge_keeps_sizes_in_order(spark):
    items = frame(spark, item("a", 5, "x", 3200, "1", "ab", review=True), item("b", 2, "x", 4200, "2", "cd", label="L", review=True), item("c", 3, "x", [3200, None], "1", "longest", review=False))
    pairs = spark.createDataFrame([("m", "a", "b"), ("m", "a", "c")], "menu_id string, target_id string, source_id string")
    got = dedupe.merge_items(items, pairs).collect()
    assert len(got) == 1 and got[0]["item_id"] == "a" and got[0]["item_pos"] == 5 and not got[0]["needs_review"]
    assert [(v["label"], v["price_agorot"]) for v in got[0]["variants"]] == [(None, 3200), ("L", 4200), (None, None)]
    assert got[0]["description"] == "longest" and got[0]["source_image_ids"] == ["1", "2"]


def merged_one_by_one(items, pairs):
    """A source after the other taken into its target, as dicts by (menu_id, item_id)."""
    out = {(i["menu_id"], i["item_id"]): i | {c: list(dict.fromkeys(i[c] or [])) for c in ("review_reasons", "source_image_ids")} for i in items}
    key = lambda v: (v["label"] or "", v["price_agorot"])
    position = {(i["menu_id"], i["item_id"]): i["item_pos"] for i in items}
    for menu, target, source in sorted(pairs, key=lambda p: position[p[0], p[2]]):
        a, b = out[menu, target], out.pop((menu, source))
        variants = list(a["variants"])
        for v in b["variants"]:
            if key(v) not in map(key, variants):
                variants.append(v)
        longer = len(b["description"] or "") > len(a["description"] or "")
        out[menu, target] = a | {
            "variants": variants, "description": (b if longer else a)["description"], "confidence": max(a["confidence"], b["confidence"]), "needs_review": a["needs_review"] and b["needs_review"],
            "review_reasons": list(dict.fromkeys(a["review_reasons"] + b["review_reasons"])), "source_image_ids": list(dict.fromkeys(a["source_image_ids"] + b["source_image_ids"])),
        }
    return out


def test_merges_equal_merging_one_by_one(spark):
    rng = random.Random(21)
    rows, pairs = [], []
    for m in range(4):
        for k in range(40):
            r = list(item(f"{k:02d}", (k * 17) % 40, f"n{k}", [rng.choice([None, 100, 200, 300]) for _ in range(rng.randrange(4))], rng.choice("123"), rng.choice([None, "", "ab", "cd", "longer", "longed"]), menu=f"m{m}"))
            r[6] = [(i, rng.choice([None, "", "L"]), p, n) for i, _, p, n in r[6]]
            r[8], r[9], r[10], r[11] = rng.random(), rng.random() < 0.7, rng.choices("xyz", k=rng.randrange(3)), rng.choices("1234", k=rng.randrange(4))
            rows.append(tuple(r))
        pairs += [(f"m{m}", f"{rng.randrange(8):02d}", f"{k:02d}") for k in range(8, 40) if rng.random() < 0.8]
    df = frame(spark, *rows)
    want = merged_one_by_one([r.asDict(recursive=True) for r in df.collect()], pairs)
    got = dedupe.merge_items(df, spark.createDataFrame(pairs, "menu_id string, target_id string, source_id string")).collect()
    assert {(r["menu_id"], r["item_id"]): r.asDict(recursive=True) for r in got} == want and len(got) == len(want)


def test_merge_of_nothing_and_of_null_lists(spark):
    none = spark.createDataFrame([], "menu_id string, target_id string, source_id string")
    one, two = list(item("a", 0, "x", 100, "1")), list(item("b", 1, "x", 100, "2"))
    two[6] = two[10] = two[11] = None
    df = frame(spark, tuple(one), tuple(two))
    assert dedupe.merge_items(df, none).count() == 2 and dedupe.merge_items(df.limit(0), none).count() == 0
    got = dedupe.merge_items(df, spark.createDataFrame([("m", "a", "b")], none.schema)).collect()
    assert len(got) == 1 and got[0]["source_image_ids"] == ["1"] and got[0]["review_reasons"] == [] and len(got[0]["variants"]) == 1


def test_a_leader_with_many_sources(spark):
    """60,000 sources of one dish: no row of any shuffle holds the group."""
    n, c = 60_000, F.col("id")
    variant = F.struct(c.cast("string").alias("id"), F.lit(None).cast("string").alias("label"), (c % 50).alias("price_agorot"), F.lit(False).alias("needs_review"))
    df = spark.range(n).select(
        F.lit("m").alias("menu_id"), c.cast("string").alias("item_id"), c.alias("item_pos"), F.lit("x").alias("name"), F.lit("d").alias("description"), F.lit("c").alias("category_id"), F.array(variant).alias("variants"),
        F.lit("fixed").alias("price_kind"), (c / n).alias("confidence"), F.lit(True).alias("needs_review"), F.array((c % 7).cast("string")).alias("review_reasons"), F.array((c % 9).cast("string")).alias("source_image_ids"), F.lit("ocr").alias("origin"),
    )
    r = dedupe.merge_items(df, df.filter("item_id <> '0'").select("menu_id", F.lit("0").alias("target_id"), F.col("item_id").alias("source_id"))).collect()
    assert len(r) == 1 and [v["price_agorot"] for v in r[0]["variants"]] == list(range(50)) and r[0]["source_image_ids"] == [str(k) for k in range(9)]
    assert r[0]["confidence"] == (n - 1) / n and r[0]["item_id"] == "0" and r[0]["needs_review"]


def sequential(rows, threshold=0.74):
    used, out = set(), []
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a[1] in used or b[1] in used or (a[11] and b[11] and set(a[11]) <= set(b[11])):
                continue
            if plain_dice(a[3], b[3]) >= threshold:
                out.append((a[1], b[1]))
                used.add(b[1])
    return out


@pytest.mark.parametrize(("small_menu", "fold_pairs"), [(300, 5000), (0, 5000), (300, 0), (0, 0)])
def test_leaders_equal_the_sequential_rule(spark, small_menu, fold_pairs):
    rng = random.Random(9)
    rows, want = [], []
    for m in range(3):
        own = []
        for i in range(30):
            base = rng.choice(["chicken soup", "green salad", "cold widget", "lemon cake"])
            name = "".join(c if rng.random() > 0.08 else rng.choice("abx") for c in base)
            own.append(item(f"{m}-{i:02d}", i, name, 100, rng.choice(["1", "2", "3", None]), menu=f"m{m}"))
        rows += own
        want += sequential(own)
    pairs = dedupe.duplicate_pairs(frame(spark, *rows), small_menu=small_menu)
    got = sorted((r["target_id"], r["source_id"]) for r in dedupe.leaders(pairs, fold_pairs=fold_pairs).collect())
    assert got == sorted(want) and len(got) > 20


def test_prefixes_are_of_the_rarest_trigrams(spark):
    """Of 30,000 dishes that all begin with the same words none has a trigram of these in its prefix. Names end in one of 16 letters, so the
    rarest trigrams that any has are in a sixteenth of the names."""
    names = spark.range(30_000).select(F.lit("m").alias("menu_id"), F.concat(F.lit("grilled chicken "), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 12)).alias("normal"))
    found = dedupe.prefixes(names.withColumn("grams", T.trigrams(F.col("normal"))), 0.74)
    most = found.groupBy("g").count().agg(F.max("count")).first()[0]
    assert found.select("normal").distinct().count() == 30_000 and most < 1.1 * 30_000 / 16
    assert found.filter(F.lit("  grilled chicken ").contains(F.substring("g", 1, 3)) & F.col("g").endswith("#1")).isEmpty()


def test_long_and_equal_names_in_a_large_menu(spark):
    long = "green salad " * 420
    rows = [item("a", 0, long, 100, "1"), item("b", 1, long + "x", 100, "2"), item("c", 2, "soup", 100, "1"), item("d", 3, "soup", 100, "2"), item("e", 4, "Soup!", 200, "3"), item("f", 5, "a", 100, "2")]
    for small_menu in (300, 0):
        found = dedupe.duplicate_pairs(frame(spark, *rows), small_menu=small_menu)
        assert sorted((r["target_id"], r["source_id"]) for r in found.collect()) == [("a", "b"), ("c", "d"), ("c", "e"), ("d", "e")]


def test_a_chain_of_names_takes_few_jobs(spark):
    """2,000 names of which each is similar to the next alone: the sequential rule, in some 30 jobs (each shuffle is one) and not a round for every name."""
    chain = [("m", k, k + 1, f"{k}", f"{k + 1}", False) for k in range(2_000)] + [("n", 2 * k, 2 * k + 1, "x", "y", True) for k in range(50)]
    pairs = spark.createDataFrame(chain, "menu_id string, pos_a long, pos_b long, target_id string, source_id string, auto boolean")
    spark.sparkContext.setJobGroup("chain", "")
    try:
        got = sorted((r["menu_id"], r["pos_a"], r["pos_b"]) for r in dedupe.leaders(pairs, fold_pairs=0).collect())
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    used, want = set(), []
    for m, a, b, *_ in sorted(chain):
        if (m, a) not in used and (m, b) not in used:
            used.add((m, b))
            want.append((m, a, b))
    assert got == sorted(want) and jobs < 40, jobs


@pytest.mark.parametrize("small_menu", [300, 0])
def test_fresh_items_meet_all_and_others_only_them(spark, small_menu):
    rng = random.Random(5)
    rows = [item(f"{i:02d}", i, "".join(c if rng.random() > 0.08 else rng.choice("abx") for c in rng.choice(["chicken soup", "green salad", "lemon cake"])), 100, rng.choice(["1", "2", "3"]), menu=f"m{i % 2}") for i in range(50)]
    items = frame(spark, *rows)
    pairs = lambda df: {(r["target_id"], r["source_id"], r["auto"], r["reason"]): df for r in df.collect()}.keys()
    fresh = F.col("item_id").isin("07", "08", "30", "49")
    got = dedupe.duplicate_pairs(items, small_menu=small_menu, names=dedupe.names_of(items).withColumn("fresh", fresh))
    full = {p for p in pairs(dedupe.duplicate_pairs(items, small_menu=small_menu)) if {p[0], p[1]} & {"07", "08", "30", "49"}}
    assert full and pairs(got) == full and got.count() == len(full)

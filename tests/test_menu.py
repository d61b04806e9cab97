from __future__ import annotations

from pyspark.sql import functions as F

from menuspark.operators import budget, menu
from menuspark.sources import pages as S
from tests.fixtures import ITEMS, item


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), ITEMS)


def ids(df):
    return sorted(r["item_id"] for r in df.collect())


def test_budget_summaries(spark):
    cases = {1: ([(10_000, 1)], 1200), 2: ([(10_000, 1)], 0), 3: ([(1_999, 3), (4_550, 1)], 0), 4: ([(60_000, 1)], 1200), 5: ([(52_000, 1)], 1200), 6: ([(53_571, 1)], 1200), 7: ([(53_572, 1)], 1200), 8: ([], 1200), 9: ([(6_800, 2), (3_200, 1), (None, 4), (100, -2)], 1200)}
    sessions = spark.createDataFrame([(i, 4, 15_000, bp) for i, (_, bp) in cases.items()] + [(10, 0, 0, 0)], "session_id long, diners int, per_person_agorot long, tip_bp int")
    lines = spark.createDataFrame([(i, p, q) for i, (own, _) in cases.items() for p, q in own], "session_id long, price_agorot long, qty int")
    got = {r["session_id"]: r for r in budget.compute_budget(sessions, lines).collect()}
    assert got[1]["tip_agorot"] == 1200 and got[1]["estimated_total_agorot"] == 11_200 and got[1]["remaining_agorot"] == 48_800 and got[1]["status"] == "comfortable"
    assert got[2]["max_food_subtotal_agorot"] == 60_000 and got[3]["food_subtotal_agorot"] == 10_547
    assert got[4]["status"] == "over" and abs(got[4]["overspend_agorot"] - 7_200) < 1e-6 and got[4]["remaining_food_budget_agorot"] == 0
    assert got[5]["status"] == "close" and got[6]["status"] == "close" and got[7]["status"] == "over"
    assert got[8]["food_subtotal_agorot"] == 0 and got[9]["food_subtotal_agorot"] == 16_800 and got[10]["fraction_used"] == 0


def test_budget_forms(spark):
    rows = [("2", "150", "12"), ("", "", ""), ("0", "x", "-1"), ("101", "0", "101"), ("3 people", "12,50", "12,5%"), ("2.9", "₪100", ".5")]
    got = budget.validate_budget(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, diners string, per_person string, tip string")).orderBy("i").collect()
    assert [r["valid"] for r in got] == [True, False, False, False, True, True]
    assert got[1]["diners_error"] == budget.DINERS_MISSING and got[2]["per_person_error"] == budget.PER_PERSON_WRONG and got[3]["tip_error"] == budget.TIP_HIGH and got[3]["diners_error"] == budget.DINERS_MANY
    assert (got[4]["diners_value"], got[4]["per_person_agorot"], got[4]["tip_bp"]) == (3, 1250, 1250) and got[5]["diners_value"] == 2 and got[5]["tip_bp"] == 50


def test_prices_and_review(spark):
    items = frame(spark, item("a", 0, "A", 3200, "i"), item("b", 1, "B", 9000, "i", kind="market"), item("c", 2, "C", None, "i", review=True), item("d", 3, "D", [0, 500], "i"))
    usable = {r["item_id"]: r["u"] for r in items.withColumn("u", menu.item_has_any_usable_price()).collect()}
    assert usable == {"a": True, "b": False, "c": False, "d": True} and ids(menu.items_needing_review(items)) == ["c"]
    counts = menu.review_counts(items).first()
    assert tuple(counts)[1:] == (4, 3, 1, True)


def test_selections(spark):
    items = frame(spark, item("a", 0, "A", 3200, "i"), item("b", 1, "B", 9000, "i", kind="market"))
    chosen = spark.createDataFrame([(1, "m", "a", "a-0", 2), (1, "m", "b", "b-0", 1), (1, "m", "x", "x-0", 1), (1, "m", "a", "a-9", 1)], "session_id long, menu_id string, item_id string, variant_id string, qty int")
    got = {r["item_id"]: (r["price_agorot"], r["line_total_agorot"]) for r in menu.resolve_selections(chosen, items).collect()}
    assert got == {"a": (3200, 6400), "b": (None, 0)} and menu.prune_selections(chosen, items).count() == 2
    assert {(r["category_id"], r["units"]) for r in menu.selected_per_category(menu.resolve_selections(chosen, items)).collect()} == {("c", 3)}
    removed = spark.createDataFrame([("m", "a")], "menu_id string, item_id string")
    assert menu.drop_orphans(chosen, removed).count() == 2
    added = menu.add_to_order(chosen, chosen.filter("item_id = 'a'"))
    assert {(r["variant_id"], r["qty"]) for r in added.collect()} == {("a-0", 4), ("b-0", 1), ("x-0", 1), ("a-9", 2)}


def test_categories(spark):
    cats = spark.createDataFrame([("m", "c1", "ראשונות", 0)], "menu_id string, category_id string, name string, order int")
    names = spark.createDataFrame([("m", " ראשונות ", 0), ("m", "קינוחים", 1), ("m", "  ", 2), ("m", "קינוחים ", 3), ("n", "x", 0)], "menu_id string, name string, seq int")
    out = {(r["menu_id"], r["name"]): r["order"] for r in menu.ensure_categories(cats, names).collect()}
    assert out == {("m", "ראשונות"): 0, ("m", "קינוחים"): 1, ("m", "ללא קטגוריה"): 2, ("n", "x"): 0}
    assert menu.rename_category(cats, "m", "c1", "new").first()["name"] == "new"
    items = frame(spark, item("a", 1, "A", 1, "i", category="c1"), item("b", 0, "B", 1, "i", category="c1"), item("g", 2, "G", 1, "i", category="ghost"))
    groups = menu.items_by_category(items, cats).orderBy("order").collect()
    assert [(g["name"], g["item_ids"]) for g in groups] == [("ראשונות", ["b", "a"]), ("ללא קטגוריה", ["g"])]
    assert {r["item_id"]: r["category_name"] for r in menu.category_names(items, cats).collect()}["g"] == "ללא קטגוריה"
    own = {r["item_id"]: (r["name"], r["category_name"]) for r in menu.select_candidates(frame(spark, item("a", 0, "", 5, "i", category="c1"), item("g", 1, "G", 7, "i", category="ghost")), cats).collect()}
    assert own == {"a": ("(ללא שם)", "ראשונות"), "g": ("G", "ללא קטגוריה")}


def test_edits(spark):
    items = frame(spark, item("a", 0, "A", 3200, "i1"), item("b", 1, "B", 1, "i2"))
    new = frame(spark, item("b", 7, "B2", 2, "i2"), item("z", 9, "Z", 3, "i2"), item("y", 8, "Y", 3, "i2"))
    got = [(r["item_id"], r["item_pos"], r["name"]) for r in menu.upsert_items(items, new).orderBy("item_pos").collect()]
    assert got == [("a", 0, "A"), ("b", 1, "B2"), ("y", 2, "Y"), ("z", 3, "Z")]
    assert ids(menu.update_items(items, F.col("item_id") == "a", {"name": F.lit("N"), "item_id": F.lit("hacked")})) == ["a", "b"]
    assert ids(menu.remove_items(items, items.filter("item_id = 'a'"))) == ["b"]
    v = items.filter("item_id = 'a'").select(
        menu.update_variant(F.col("variants"), F.lit("a-0"), {"price_agorot": F.lit(3500).cast("long"), "id": F.lit("x")}).alias("u"), menu.add_variant(F.col("variants"), menu.make_variant(F.lit("v2"), price=F.lit(4000))).alias("n"), menu.remove_variant(F.col("variants"), F.lit("a-0")).alias("r"),
    ).first()
    assert (v["u"][0]["id"], v["u"][0]["price_agorot"], len(v["n"]), len(v["r"])) == ("a-0", 3500, 2, 1)
    both = frame(spark, item("a", 0, "A", 1, "i1"), item("b", 1, "B", 1, None), item("c", 2, "C", 1, "i2")).withColumn("source_image_ids", F.when(F.col("item_id") == "c", F.array(F.lit("i1"), F.lit("i2"))).otherwise(F.col("source_image_ids")))
    left = menu.remove_images(both, spark.createDataFrame([("m", "i1")], "menu_id string, image_id string"))
    assert {r["item_id"]: r["source_image_ids"] for r in left.collect()} == {"b": [], "c": ["i2"]}
    raw = spark.createDataFrame([("m", 0, "N", None), ("m", 1, None, [])], "menu_id string, item_pos long, name string, variants array<struct<id:string,label:string,price_agorot:bigint,needs_review:boolean>>")
    made = menu.with_item_defaults(raw).orderBy("item_pos").collect()
    assert [(r["name"], len(r["variants"]), r["price_kind"], r["confidence"], r["category_id"], r["origin"]) for r in made] == [("N", 1, "fixed", 1.0, "uncategorized", "manual"), ("", 1, "fixed", 1.0, "uncategorized", "manual")]
    cats = spark.createDataFrame([("m", "c2", "B", 1), ("m", "c1", "A", 0)], "menu_id string, category_id string, name string, order int")
    asked = spark.createDataFrame([("m", 0, None), ("m", 1, "c2"), ("q", 0, None)], "menu_id string, seq int, category_id string")
    extra = menu.add_manual_items(items, asked, cats).filter("origin = 'manual'").collect()
    assert sorted((r["menu_id"], r["item_pos"], r["category_id"], r["needs_review"]) for r in extra) == [("m", 2, "c1", True), ("m", 3, "c2", True), ("q", 0, "uncategorized", True)]


def test_search(spark):
    items = frame(spark, item("a", 0, "Fresh Lemonade", 1, "i"), item("b", 1, "שְׁנִיצֶל", 1, "i", description="with LEMON"), item("c", 2, "Soup", 1, "i", category="d"))
    assert ids(menu.search_menu(items, " lemon! ")) == ["a", "b"] and ids(menu.search_menu(items, "שניצל")) == ["b"]
    assert ids(menu.search_menu(items, "  ")) == ["a", "b", "c"] and ids(menu.search_menu(items, "", "d")) == ["c"]
    count, failed = menu.image_counts(items, spark.createDataFrame([("m", "error"), ("m", "done")], "menu_id string, status string"))
    assert count.first()["item_count"] == 3 and failed.first()["failed"] == 1


def test_pages(spark):
    word = {"text": "a", "confidence": None, "bbox": None}
    blocks = [{"paragraphs": [{"lines": [{"text": None, "confidence": None, "bbox": None, "words": [word, {"text": None, "confidence": 5.0, "bbox": (1.0, 2.0, 3.0, 4.0)}]}]}, {"lines": None}]}, {"paragraphs": [{"lines": [{"text": "t", "confidence": 9.0, "bbox": None, "words": None}]}]}]
    df = spark.createDataFrame([("m", "p", 0, 10.0, 1.0, blocks), ("m", "q", 1, 10.0, 1.0, None)], S.PAGES)
    got = S.flatten_blocks(df).orderBy("line_no").collect()
    assert [(r["line_no"], r["text"], r["confidence"], len(r["words"])) for r in got] == [(0, "a ", 0.0, 2), (1, "t", 9.0, 0)]
    assert tuple(got[0]["words"][0]["bbox"]) == (0, 0, 0, 0) and got[0]["words"][1]["text"] == ""
    images = spark.createDataFrame([("m", "a", "done"), ("m", "b", "processing"), ("m", "c", "error")], "menu_id string, image_id string, status string")
    assert sorted(r["image_id"] for r in S.pending_pages(images).collect()) == ["b", "c"]
    assert [r["image_id"] for r in S.pending_pages(images, images.filter("image_id = 'a'")).collect()] == ["a"]
    stored = spark.createDataFrame([("m", "b", 1), ("m", "a", 2), ("m", "x", 0)], "menu_id string, image_id string, created_at long")
    assert [(r["image_id"], r["status"]) for r in S.restore_images(stored, images).orderBy("pos").collect()] == [("b", "pending"), ("a", "done")]

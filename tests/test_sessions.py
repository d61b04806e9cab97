from __future__ import annotations

import json

from pyspark.sql import functions as F

from menuspark.sources import menus, sessions as S

ITEM = {"id": "i1", "name": "x", "categoryId": "c", "variants": [{"id": "v1", "priceAgorot": 3200}]}
GOOD = {"version": 1, "step": "select", "budget": {"diners": 4, "perPersonAgorot": 15000, "tipBp": 1200}, "menu": {"categories": [{"id": "c", "name": "n", "order": 0}], "items": [ITEM], "confirmed": True}, "selections": [{"itemId": "i1", "variantId": "v1", "qty": 2}], "images": [{"id": "p", "name": "p", "rotationDeg": 90, "status": "done"}], "updatedAt": 5}


def change(path, value):
    out = json.loads(json.dumps(GOOD))
    at = out
    for p in path[:-1]:
        at = at[p]
    if value is ...:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return json.dumps(out)


def test_sessions_are_rejected_whole(spark):
    bad = {
        "{not json": "corrupt", change(["version"], 0): "version", change(["budget", "diners"], -3): "diners", change(["budget", "diners"], 1.5): "diners", change(["budget", "perPersonAgorot"], 10**9): "per_person", change(["budget", "tipBp"], 10_001): "tip",
        change(["step"], "x"): "step", change(["menu", "items", 0, "variants"], []): "items", change(["menu", "items", 0, "variants", 0, "priceAgorot"], -1): "items", change(["menu", "items", 0, "priceKind"], "x"): "items", change(["menu", "categories", 0, "id"], ""): "categories",
        change(["selections", 0, "qty"], 100): "selections", change(["selections", 0, "qty"], 0): "selections", change(["images", 0, "status"], "x"): "images", change(["updatedAt"], ...): "updated_at", change(["selections"], ...): "selections",
    }
    rows = [(0, json.dumps(GOOD)), *((i + 1, t) for i, t in enumerate(bad))]
    good, rejected = S.load_sessions(spark.createDataFrame([*rows, (99, None)], "session_id long, json string"))
    assert [r["session_id"] for r in good.collect()] == [0]
    reasons = {r["session_id"]: r["reasons"] for r in rejected.collect()}
    assert all(want in reasons[i + 1] for i, want in enumerate(bad.values())) and 99 in reasons
    tables = S.session_tables(good)
    item = tables["items"].first()
    assert (item["price_kind"], item["confidence"], item["needs_review"], item["origin"], item["variants"][0]["price_agorot"]) == ("fixed", 1.0, False, "ocr", 3200)
    assert tables["selections"].first()["qty"] == 2 and tables["images"].first()["item_count"] == 0 and tables["menus"].first()["confirmed"]


def test_round_trip(spark, tmp_path):
    good, _ = S.load_sessions(spark.createDataFrame([(i, json.dumps(GOOD)) for i in range(20)], "session_id long, json string"))
    S.save_sessions(good, str(tmp_path / "s"), buckets=4)
    back, bad = S.load_sessions(spark.read.parquet(str(tmp_path / "s")).select("session_id", "json"))
    assert bad.count() == 0 and back.count() == 20
    assert back.select(F.col("session.updatedAt").alias("u")).filter("u > 1600000000000").count() == 20
    strip = lambda df: sorted((r["session_id"], r["session"].asDict(True) | {"updatedAt": 0}) for r in df.collect())
    assert [str(x) for x in strip(back)] == [str(x) for x in strip(good)]


def test_menus_are_written(spark, tmp_path):
    from menuspark.plans.parse import Parsed

    parsed = Parsed(*(spark.createDataFrame([("m", i) for i in range(3)], "menu_id string, v int") for _ in range(3)))
    menus.write_menu(parsed, str(tmp_path / "menu"), buckets=2)
    assert menus.read_menu(spark, str(tmp_path / "menu")).items.count() == 3


def test_a_bucket_is_written_by_many_tasks(spark, tmp_path):
    """A task's rows don't grow with the bucket: large buckets are cut, and stay in their folder."""
    good, _ = S.load_sessions(spark.createDataFrame([(i, json.dumps(GOOD)) for i in range(4_000)], "session_id long, json string").repartition(8))
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "16k")
    try:
        S.save_sessions(good, str(tmp_path / "s"), buckets=2)
    finally:
        spark.conf.unset(size)
    files = [len(list((tmp_path / "s" / f"bucket={b}").glob("*.parquet"))) for b in (0, 1)]
    assert min(files) > 1 and sorted(r["session_id"] for r in spark.read.parquet(str(tmp_path / "s")).select("session_id").collect()) == list(range(4_000))

from __future__ import annotations

import datetime as dt
import random
import shutil

from pyspark.sql import functions as F

from menuspark.operators import budget, menu, quantities
from menuspark.plans import views
from menuspark.sources import pages as P
from menuspark.streaming import intake, totals
from tests.fixtures import HEBREW, page

T0 = dt.datetime(2024, 1, 1)


def log(rng, n):
    ops = ["add", "add", "remove", "set", "delete", "clear"]
    return [(rng.randrange(4), "m", rng.choice("ab"), "v", T0 + dt.timedelta(seconds=rng.randrange(50)), i, rng.choice(ops), rng.randrange(-1, 5)) for i in range(n)]


SCHEMA = "session_id long, menu_id string, item_id string, variant_id string, ts timestamp, event_id long, op string, qty int"


def test_quantities_equal_the_loop(spark):
    events = log(random.Random(3), 300)
    now: dict = {}
    for s, m, i, v, _, _, op, q in sorted(events, key=lambda e: (e[4], e[5])):
        before = now.get((s, i), 0)
        now[s, i] = {"add": before + 1, "remove": max(0, before - 1), "set": max(0, q)}.get(op, 0)
    got = {(r["session_id"], r["item_id"]): r["qty"] for r in quantities.quantities(spark.createDataFrame(events, SCHEMA)).collect()}
    assert got == {k: q for k, q in now.items() if q}


def test_long_logs_are_folded_in_blocks(spark):
    """Every quantity after every event, whatever the blocks, resets or none, a null in the key included."""
    rng = random.Random(8)
    for ops in (["add", "remove", "remove"], ["add", "add", "remove", "remove", "set", "delete"], ["add", "remove"]):
        events = [(rng.choice([1, 1, 1, 2, None]), "m", "a", "v", T0 + dt.timedelta(seconds=i // 3), i, rng.choice(ops) if rng.random() < 0.9 else "add", rng.randrange(5)) for i in range(900)]
        now, want = {}, {}
        for s, _, _, _, _, i, op, q in events:
            before = now.get(s, 0)
            want[i] = now[s] = {"add": before + 1, "remove": max(0, before - 1), "set": q}.get(op, 0)
        df = spark.createDataFrame(events, SCHEMA).repartition(3)
        for rows in (40, 10_000):
            got = {r["event_id"]: r["quantity"] for r in quantities.running_quantities(df, block_rows=rows).collect()}
            assert got == want
            assert {r["session_id"]: r["qty"] for r in quantities.quantities(df, block_rows=rows).collect()} == {k: v for k, v in now.items() if v}
    assert quantities.running_quantities(df.limit(0)).count() == 0


def test_one_hot_line_is_many_tasks(spark):
    log = spark.range(200_000).select(F.lit(1).alias("session_id"), *[F.lit(1).alias(k) for k in quantities.KEY[1:]], F.col("id").alias("ts"), F.col("id").alias("event_id"), F.when(F.col("id") % 3 == 0, "remove").otherwise("add").alias("op"), F.lit(None).cast("int").alias("qty"))
    usual, blocks = quantities._split(log, 10_000)
    assert usual.count() == 0
    sizes = [r["count"] for r in blocks.groupBy("_block").count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 30_000
    assert quantities.quantities(log, block_rows=10_000).first()["qty"] == quantities.quantities(log).first()["qty"] == 66_667


def test_live_totals_equal_the_batch(spark, sf_dir, tmp_path):
    events = views.table(spark, sf_dir, "events")
    # Three batches, in time order.
    for k, part in enumerate([events.filter("event_id % 1000 < 300"), events.filter("event_id % 1000 between 300 and 600"), events.filter("event_id % 1000 > 600")]):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    ordered = views.qty_events(spark, sf_dir)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    sessions, items = views.live_sessions(spark, sf_dir), views.items(spark, sf_dir)
    got: dict = {}

    def sink(df, number):
        for r in df.collect():
            got[r["session_id"]] = r["food_subtotal_agorot"]

    # One batch with all events: order within a batch is the log's.
    whole = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    totals.start_live_totals(views.as_qty_events(whole), sessions, items, sink, str(tmp_path / "c1")).awaitTermination()
    want = budget.compute_budget(sessions, menu.resolve_selections(quantities.quantities(ordered), items))
    assert got == {r["session_id"]: r["food_subtotal_agorot"] for r in want.collect()}
    # In several batches the state carries over.
    got.clear()
    totals.start_live_totals(views.as_qty_events(stream), sessions, items, sink, str(tmp_path / "c2")).awaitTermination()
    assert got.keys() == {r["session_id"] for r in want.collect()}


def test_settled_sessions_leave_the_state(spark, tmp_path):
    """State carries a session over batches; its rows go once the watermark has passed its idle time."""
    day = lambda k: T0 + dt.timedelta(days=k)
    batches = [
        [(1, 1, "a", "v", day(0), 1, "add", None), (1, 1, "b", "v", day(0), 2, "set", 4), (2, 1, "a", "v", day(0), 3, "set", 2)],
        [(1, 1, "a", "v", day(1), 4, "add", None), (1, 1, "b", "v", day(1), 5, "delete", None)],
        [(3, 1, "a", "v", day(20), 6, "add", None)],
        [(3, 1, "a", "v", day(21), 7, "add", None)],
        [(1, 1, "a", "v", day(22), 8, "add", None)],
    ]
    schema = "session_id long, menu_id long, item_id string, variant_id string, ts timestamp, event_id long, op string, qty int"
    path, seen, states = tmp_path / "in", {}, []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
        stream = spark.readStream.schema(schema).parquet(str(path))
        items = spark.createDataFrame([], "menu_id long, item_id string, category_id string, price_kind string, variants array<struct<id:string,label:string,price_agorot:bigint,needs_review:boolean>>")
        sessions = spark.createDataFrame([(i, 1, 10_000, 0) for i in (1, 2, 3)], "session_id long, diners int, per_person_agorot long, tip_bp int")
        lines: dict = {}
        query = totals.start_live_totals(stream, sessions, items, lambda df, n: lines.update({r["session_id"]: r for r in df.collect()}), str(tmp_path / "c"), watermark="1 day", idle="7 days")
        query.awaitTermination()
        seen[k] = set(lines)
        states.append(query.recentProgress[-1].stateOperators[0].numRowsTotal)
    assert seen == {0: {1, 2}, 1: {1}, 2: {3}, 3: {3}, 4: {1}}
    assert states[0] >= states[1] > states[3] and states[3] < states[0]


def record(menu_id, page_id, seq, rows):
    lines = [{"text": t, "confidence": c, "bbox": b, "words": [{"text": x, "confidence": y, "bbox": z} for x, y, z in w]} for _, _, _, t, c, b, w in page(rows)]
    return (menu_id, page_id, seq, 1000.0, 90.0, [{"paragraphs": [{"lines": lines}]}])


def test_intake(spark, tmp_path):
    first = spark.createDataFrame([record("m", "a", 0, HEBREW), record("n", "x", 0, HEBREW[:4])], P.PAGES)
    again = spark.createDataFrame([record("m", "b", 1, HEBREW)], P.PAGES)
    path = str(tmp_path / "menus")
    intake.take_in(first, path, buckets=4)
    items = lambda: intake.working(spark, path, "items")
    assert items().filter("menu_id = 'm'").count() == 10 and items().filter("menu_id = 'n'").count() == 2

    def written():
        return sorted(str(x) for x in (tmp_path / "menus").rglob("*.parquet"))

    before = written()
    for _ in range(2):  # a batch that is repeated changes nothing
        intake.take_in(again, path, buckets=4)
        mine = items().filter("menu_id = 'm'").collect()
        assert len(mine) == 10 and sorted({tuple(r["source_image_ids"]) for r in mine}) == [("a", "b")]
        assert intake.working(spark, path, "categories").filter("menu_id = 'm'").count() == 3
    assert set(before) < set(written())  # nothing was overwritten
    assert items().filter("menu_id = 'n'").count() == 2 and not intake.working(spark, path, "menus").filter("confirmed").count()
    all_rows = lambda: {name: sorted(map(str, intake.working(spark, path, name).collect())) for name in intake.TABLES}
    now = all_rows()
    # A batch that failed before the menus were written: its rows don't count.
    items().withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{path}/items/version=000000000009-failed")
    assert all_rows() == now
    assert intake.compact(spark, path, buckets=4) == 3 and all_rows() == now
    assert {x.parent.parent.name for x in (tmp_path / "menus").rglob("*.parquet")} == {next((tmp_path / "menus" / "menus").glob("version=*")).name}
    assert intake.compact(spark, str(tmp_path / "none")) == 0 and not intake.working(spark, str(tmp_path / "none"), "items").count()


def test_batches_into_one_menu_equal_the_full_search(spark, tmp_path):
    """A menu that three batches touch, with dishes that are read twice, merged, and met again: the same tables as a store that has kept
    neither names nor pairs, which looks for all pairs anew in each batch."""
    other = [*HEBREW[:2], *HEBREW[4:]]
    batches = [[("m", "a", 0, HEBREW), ("n", "x", 0, HEBREW[:6])], [("m", "b", 1, other)], [("m", "b", 1, HEBREW), ("m", "c", 2, other), ("n", "y", 1, other)]]
    kept, anew = str(tmp_path / "kept"), str(tmp_path / "anew")
    for k, rows in enumerate(batches):
        df = spark.createDataFrame([record(*r) for r in rows], P.PAGES)
        intake.take_in(df, kept, buckets=2)
        for name in ("names", "pairs"):
            shutil.rmtree(f"{anew}/{name}", ignore_errors=True)
        intake.take_in(df, anew, buckets=2)
        for name in ("items", "categories", "suggestions") if k else ():
            a, b = (sorted(map(str, intake.working(spark, p, name).collect())) for p in (kept, anew))
            assert a == b
    assert intake.working(spark, kept, "names").filter("fresh").count() < intake.working(spark, kept, "names").count()


def test_a_batch_puts_its_dishes_together_once(spark, tmp_path, monkeypatch):
    """What a batch's dishes are put together from is aggregated once, also where the menu has dishes that may be replaced."""
    first, again = (spark.createDataFrame([record("m", p, k, HEBREW)], P.PAGES) for k, p in enumerate("ab"))
    path, plans, staged = str(tmp_path / "menus"), [], intake.staged

    def watched(df, name):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return staged(df, name)

    intake.take_in(first, path, buckets=2)
    monkeypatch.setattr(intake, "staged", watched)
    intake.take_in(again, path, buckets=2)
    assert [name for name, plan in plans if "collect_list" in plan] == ["new-items", "found"]  # the latter folds pairs
    assert sorted(r["item_pos"] for r in intake.working(spark, path, "items").collect()) == list(range(10))


def test_a_large_bucket_is_several_files(spark, tmp_path):
    """One bucket's rows aren't one task's."""
    tables = {name: spark.createDataFrame([], schema) for name, schema in intake.TABLES.items()}
    tables["menus"] = spark.range(0, 400_000, 1, 8).select(F.sha2(F.col("id").cast("string"), 256).alias("menu_id"), F.lit(False).alias("confirmed"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1MB")
    try:
        intake._append(str(tmp_path), tables, [], 1)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "menus").rglob("*.parquet"))) > 3
    assert intake.working(spark, str(tmp_path), "menus").count() == 400_000

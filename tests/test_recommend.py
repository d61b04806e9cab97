from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from menuspark.operators import recommend as R

MENU = [("סלט", 3800, "s", "ראשונות"), ("חומוס", 3200, "s", "ראשונות"), ("שניצל", 6800, "m", "עיקריות"), ("פסטה", 5900, "m", "עיקריות"), ("לימונדה", 1800, "d", "שתייה"), ("בירה", 2200, "d", "שתייה"), ("קינוח", 2900, "e", "קינוחים")]


def pooled(spark, sessions, menus, units=(), rules=R.RuleSet()):
    """sessions: (id, menu, total, tip, subtotal); menus: {menu: [(name, price, category, category name)]}."""
    rows = [(i, m, max(0, t * 10_000 // (10_000 + b) - s), s, t, b) for i, m, t, b, s in sessions]
    df = spark.createDataFrame(rows, "session_id long, menu_id string, remaining_food_budget_agorot long, food_subtotal_agorot long, total_budget_agorot long, tip_bp long")
    dishes = [(m, f"i{k}", k, f"v{k}", 0, n, None, c, cn, p) for m, own in menus.items() for k, (n, p, c, cn) in enumerate(own)]
    cand = spark.createDataFrame(dishes, "menu_id string, item_id string, item_pos long, variant_id string, variant_pos int, name string, variant_label string, category_id string, category_name string, price_agorot long")
    return R.pool(df, cand, spark.createDataFrame(list(units), "session_id long, category_id string, units long"), rules)


def sequential(dishes, budget, subtotal, total, tip, units, rules):
    """Depth first, one node after another."""
    own = sorted((d for d in dishes if d[1] >= rules.min_price_agorot and 0 < d[1] <= budget), key=lambda d: -d[1])
    nodes, found = 0, []

    def visit(start, spent, path, used):
        nonlocal nodes
        if nodes >= rules.node_budget:
            return
        nodes += 1
        if spent and (subtotal + spent) * (10_000 + tip) <= total * 10_000:
            names, again = len({own[i][3] for i, _ in path}), sum(q - 1 for _, q in path)
            found.append((-(spent / budget + names * rules.diversity_bonus - again * rules.duplicate_penalty), len(path), nodes, [(own[i][0], q) for i, q in path], spent))
        if len(path) == rules.max_distinct_items:
            return
        for i in range(start, len(own)):
            for q in range(1, rules.max_qty_per_item + 1):
                if used.get(own[i][2], 0) + q <= rules.max_per_category and spent + own[i][1] * q <= budget:
                    visit(i + 1, spent + own[i][1] * q, [*path, (i, q)], used | {own[i][2]: used.get(own[i][2], 0) + q})

    if budget > 0:
        visit(0, 0, [], dict(units))
    return [(x[3], x[4], -x[0]) for x in sorted(found, key=lambda x: x[:3])[: rules.max_suggestions]]


def results(df):
    out = {}
    for r in df.orderBy("session_id", "rank").collect():
        out.setdefault(r["session_id"], []).append(([(x["name"], x["qty"]) for x in r["lines"]], r["added_subtotal_agorot"], pytest.approx(r["score"], abs=1e-12)))
    return out


@pytest.mark.parametrize("joins", [True, False])
def test_equals_the_sequential_search(spark, joins):
    rng = random.Random(1337)
    sessions, menus, units, want = [], {"menu": MENU}, [], {}
    for k, (total, tip) in enumerate(itertools.product([5_000, 12_000, 20_000, 33_333, 60_000], [0, 1_250])):
        sessions.append((k, "menu", total, tip, 0))
    for k in range(10, 24):
        menus[f"r{k}"] = [(f"d{i}", 500 + rng.randrange(9_000), f"c{i % 4}", f"n{i % 3}") for i in range(3 + rng.randrange(7))]
        sessions.append((k, f"r{k}", 3_000 + rng.randrange(40_000), rng.randrange(2_000), rng.randrange(5_000)))
        units += [(k, "c1", rng.randrange(1, 4))]
    for i, m, t, b, s in sessions:
        budget = max(0, t * 10_000 // (10_000 + b) - s)
        want[i] = sequential(menus[m], budget, s, t, b, {c: u for j, c, u in units if j == i}, R.RuleSet())
    out = R.recommend(pooled(spark, sessions, menus, units), joins=joins)
    assert results(out) == {i: w for i, w in want.items() if w}
    for r in out.collect():
        tip, total = next((b, t) for i, _, t, b, _ in sessions if i == r["session_id"])
        assert r["new_subtotal_agorot"] * (10_000 + tip) <= total * 10_000 and r["leftover_agorot"] >= 0 and r["reasons"] and r["description"]


@pytest.mark.parametrize("joins", [True, False])
def test_the_node_budget_cuts(spark, joins):
    rules = R.RuleSet(node_budget=150)
    menus = {"m": [(f"d{i}", 900 + 37 * i, f"c{i % 5}", f"c{i % 5}") for i in range(12)]}
    want = sequential(menus["m"], 12_000, 0, 12_000, 0, {}, rules)
    assert results(R.recommend(pooled(spark, [(1, "m", 12_000, 0, 0)], menus, rules=rules), rules, joins=joins)) == {1: want}


def test_rules_and_texts(spark):
    menus = {"m": MENU, "drinks": [d for d in MENU if d[2] == "d"], "cheap": [("x", 50, "s", "s"), ("שניצל", 6800, "m", "m")], "beer": [("בירה", 2200, "d", "d")]}
    sessions = [(1, "m", 11_200, 1_200, 0), (2, "drinks", 60_000, 0, 0), (3, "cheap", 20_000, 0, 0), (4, "m", 20_000, 1_200, 20_000), (5, "m", 20_000, 1_200, 40_000), (6, "m", 60_000, 0, 0), (7, "beer", 2_500, 0, 0)]
    out = R.recommend(pooled(spark, sessions, menus, [(6, "d", 3)]))
    got = {}
    for r in out.orderBy("session_id", "rank").collect():
        got.setdefault(r["session_id"], []).append(r)
    assert got.keys() == {1, 2, 3, 6, 7} and got[1][0]["added_subtotal_agorot"] > 9_000
    assert all(sum(x["qty"] for x in r["lines"]) <= 3 for r in got[2]) and all(x["name"] != "x" for r in got[3] for x in r["lines"])
    assert all(x["category_name"] != "שתייה" for r in got[6] for x in r["lines"])
    assert got[7][0]["reasons"] == ["נשאר ₪3.00 מהתקציב הכולל, כולל טיפ", "מנצל כמעט את כל התקציב שנותר לאוכל", "תוספת בודדת ופשוטה להזמנה"] and got[7][0]["description"] == "בירה"
    line = F.array(F.struct(F.lit("A").alias("name"), F.lit("L").alias("variant_label"), F.lit(2).alias("qty")), F.struct(F.lit("B").alias("name"), F.lit(None).cast("string").alias("variant_label"), F.lit(1).alias("qty")))
    assert spark.range(1).select(R.describe(line)).first()[0] == "A (L) ×2 + B"


def test_equal_sessions_are_one_problem(spark):
    """Ten thousand sessions on one menu with equal money are searched once; other money, tip or ordered units are problems of their own."""
    alike = [(k, "m", 11_200, 1_200, 0) for k in range(10_000)]
    others = [(20_000, "m", 11_300, 1_200, 0), (20_001, "m", 11_200, 0, 0), (20_002, "m", 11_200, 1_200, 0), (20_003, "m", 11_200, 1_200, 0), (20_004, "m", 100, 0, 500)]
    units = [(20_002, "d", 3), (20_003, "d", 3), (5, "d", 0)]
    rows = [(i, m, max(0, t * 10_000 // (10_000 + b) - s), s, t, b) for i, m, t, b, s in alike + others]
    df = spark.createDataFrame(rows, "session_id long, menu_id string, remaining_food_budget_agorot long, food_subtotal_agorot long, total_budget_agorot long, tip_bp long")
    dishes = spark.createDataFrame([("m", f"i{k}", k, f"v{k}", 0, n, None, c, cn, p) for k, (n, p, c, cn) in enumerate(MENU)], "menu_id string, item_id string, item_pos long, variant_id string, variant_pos int, name string, variant_label string, category_id string, category_name string, price_agorot long")
    ordered = spark.createDataFrame(units, "session_id long, category_id string, units long")
    first, members = R.problems(df, ordered)
    assert sorted(r["session_id"] for r in first.collect()) == [0, 20_000, 20_001, 20_002] and members.count() == 10_004
    got = results(R.recommend_sessions(df, dishes, ordered))
    assert len(got) == 10_004 and all(got[k] == got[0] for k in (1, 5, 9_999)) and got[20_003] == got[20_002] != got[0]
    for i, (t, b, u) in {0: (11_200, 1_200, {}), 20_000: (11_300, 1_200, {}), 20_001: (11_200, 0, {}), 20_003: (11_200, 1_200, {"d": 3})}.items():
        assert got[i] == sequential(MENU, t * 10_000 // (10_000 + b), 0, t, b, u, R.RuleSet())


@pytest.mark.parametrize("node_budget, together", [(120_000, 1_000_000), (60, 1_000_000), (60, 1), (120_000, 5_000)])
def test_families_equal_the_sequential_search(spark, monkeypatch, node_budget, together):
    """Sessions of a menu that differ in money take theirs from one search, in small batches, with and without a binding node budget and
    where a family is too large to be searched together."""
    monkeypatch.setattr(R, "TOGETHER", together)
    monkeypatch.setattr(R, "LOOKED_AT", 500)
    monkeypatch.setattr(R, "PIECE", 10)
    rng, rules = random.Random(7), R.RuleSet(node_budget=node_budget)
    menus = {f"r{k}": [(f"d{i}", 500 + 100 * rng.randrange(60), f"c{i % 4}", f"n{i % 3}") for i in range(2 + 3 * k)] for k in range(4)}
    sessions, units, want, count = [], [], {}, {}
    for k in range(120):
        total, tip, subtotal = rng.choice([900, 4_000, 12_000, 12_500, 20_000, 45_000]), rng.choice([0, 1_250]), rng.choice([0, 300])
        sessions.append((k, f"r{k % 4}", max(0, total * 10_000 // (10_000 + tip) - subtotal), subtotal, total, tip))
        units += [(k, "c1", k % 3), (k, "other", 1)]
    # A budget that the whole total doesn't cover: nodes beyond that total count, but aren't suggested.
    sessions.append((500, "r3", 20_000, 8_000, 24_000, 1_000))
    every = R.RuleSet(node_budget=node_budget, max_suggestions=10**9)
    for k, m, budget, subtotal, total, tip in sessions:
        own = {c: u for s, c, u in units if s == k}
        want[k] = sequential(menus[m], budget, subtotal, total, tip, own, rules)
        paths = sequential(menus[m], budget, 0, budget, 0, own, every)
        count[k] = (len(paths), max((spent for _, spent, _ in paths), default=0))
    df = spark.createDataFrame(sessions, "session_id long, menu_id string, remaining_food_budget_agorot long, food_subtotal_agorot long, total_budget_agorot long, tip_bp long")
    dishes = [(m, f"i{k}", k, f"v{k}", 0, n, None, c, cn, p) for m, own in menus.items() for k, (n, p, c, cn) in enumerate(own)]
    cand = spark.createDataFrame(dishes, "menu_id string, item_id string, item_pos long, variant_id string, variant_pos int, name string, variant_label string, category_id string, category_name string, price_agorot long")
    rows = R._with_dishes(df, cand, spark.createDataFrame(units, "session_id long, category_id string, units long"), rules).toArrow()
    search = lambda answer: [r for b in R._search_families(rules, answer)(iter(rows.combine_chunks().to_batches(max_chunksize=9))) for r in b.to_pylist()]
    got: dict[int, list] = {}
    for r in sorted(search(R._suggested), key=lambda r: (r["session_id"], r["rank"])):
        got.setdefault(r["session_id"], []).append(([(x["name"], x["qty"]) for x in r["lines"]], r["spent"], pytest.approx(r["score"], abs=1e-12)))
    assert got == {k: w for k, w in want.items() if w}
    assert {r["session_id"]: (r["nodes"], r["most"]) for r in search(R._counted)} == {k: c for k, c in count.items() if c[0]}


def test_pools_are_neither_sorted_nor_shuffled(spark):
    """A session's places come from its menu's, so nothing follows the join of sessions and dishes."""
    sessions = [(k, "m", t, 0, 0) for k, t in enumerate([1_000, 1_800, 2_199, 2_200, 6_000, 60_000])]
    menu = [*MENU, ("תה", 1800, "d", "שתייה"), ("x", 50, "s", "s")]
    out = pooled(spark, sessions, {"m": menu}, [(4, "d", 2)])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Repartition" not in plan
    prices = sorted((p for _, p, _, _ in menu if p >= 100), reverse=True)
    for k, _, t, _, _ in sessions:
        own = out.filter(F.col("session_id") == k).orderBy("idx").collect()
        assert [(r["idx"], r["price_agorot"]) for r in own] == list(enumerate(p for p in prices if p <= t))
        assert all(r["units"] == (2 if (k, r["category_id"]) == (4, "d") else 0) for r in own)

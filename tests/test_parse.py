from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from menuspark.operators import lines as L
from menuspark.plans import parse, views
from tests.fixtures import HEBREW, HINTS, LINES, PAGES, line, page


def lines_of(spark, rows):
    return spark.createDataFrame([(m, p, n, t, c, b, w) for m, p, n, t, c, b, w in rows], LINES)


def hits(spark, *rows):
    df = L.detect_prices(lines_of(spark, [line(t, no=i, **o) for i, (t, o) in enumerate(rows)]))
    return [[h["value"] for h in r["hits"]] for r in df.orderBy("line_no").collect()]


def parsed(spark, rows, hints=(), **more):
    pages = spark.createDataFrame([("m", "p", 0, 1000.0)], PAGES)
    return parse.parse_pages(lines_of(spark, rows), spark.createDataFrame(list(hints), HINTS), pages, **more)


def test_detect_prices(spark):
    got = hits(
        spark, (["שניצל", "עוף", "68"], {}), (["Fresh", "Lemonade", "18"], {"ltr": True}), (["מנת", "פוקצ׳ה", "180", "גרם", "29"], {}), (["בירה", "לבנה", "5", "%", "אלכוהול"], {}),
        (["יין", "הבית", "₪", "39"], {}), (["בירה", "מהחבית", "קטן", "גדול", "22", "32"], {}), (["מנה", "1"], {}), (["מנה", "99999"], {}), (["בקבוק", "330ml"], {}), (["₪12", "x", "₪30"], {"ltr": True}),
    )
    assert got == [[6800], [1800], [2900], [], [3900], [2200, 3200], [], [], [], [1200, 3000]]


def test_hebrew_page(spark):
    out = parsed(spark, page(HEBREW))
    items = {r["name"]: r for r in out.items.collect()}
    names = {r["category_id"]: r["name"] for r in out.categories.collect()}
    assert [r["name"] for r in out.categories.orderBy("order").collect()] == ["מנות ראשונות", "עיקריות", "שתייה"]
    by = lambda part: next(r for n, r in items.items() if part in n)
    price = lambda r: [v["price_agorot"] for v in r["variants"]]
    assert price(by("חומוס")) == [3200] and "גרגרים" in by("חומוס")["description"]
    assert price(by("פוקצ׳ה")) == [2900] and price(by("שניצל")) == [6800] and names[by("שניצל")["category_id"]] == "עיקריות"
    assert by("דג")["price_kind"] == "market" and price(by("דג")) == [None] and by("דג")["needs_review"]
    assert by("אנטריקוט")["price_kind"] == "byWeight" and by("פסטה")["price_kind"] == "unknown" and by("פסטה")["needs_review"]
    assert price(by("בירה")) == [2200, 3200] and [v["label"] for v in by("בירה")["variants"]] == ["קטן", "גדול"]
    assert price(by("Lemonade")) == [1800] and price(by("יין")) == [3900]
    assert all(r["source_image_ids"] == ["p"] for r in items.values())
    stats = out.stats.first()
    assert (stats["lines"], stats["items_found"]) == (14, 10) and stats["flagged"] > 0
    assert [r["item_pos"] for r in out.items.orderBy("item_pos").collect()] == list(range(10))


def test_flags(spark):
    promo = parsed(spark, [line(["ארוחה", "עסקית", "מבצע", "89"])]).items.first()
    assert promo["needs_review"] and "מבצע" in " ".join(promo["review_reasons"])
    assert parsed(spark, [line(["משהו", "מטושטש", "45"], confidence=40.0)]).items.first()["needs_review"]


@pytest.mark.parametrize(
    ("tokens", "values", "y", "want", "flagged"),
    [
        (["שניצל", "עוף", "8"], [6800], 100, [6800], False), (["שניצל", "עוף", "68"], [6800], 100, [6800], False), (["קרפצ׳יו", "סלק"], [4200], 100, [4200], True),
        (["שניצל", "עוף", "68"], [9900], 500, [6800], False), (["בירה", "מהחבית", "קטן", "גדול", "22", "32"], [9900], 100, [2200, 3200], False),
        (["בירה", "מהחבית", "קטן", "גדול", "2", "3"], [2200, 3200], 100, [2200, 3200], None),
    ],
)
def test_reconciliation(spark, tokens, values, y, want, flagged):
    out = parsed(spark, [line(tokens)], [("m", "p", 0, values, (10.0, float(y), 60.0, float(y + 24)))]).items.first()
    assert [v["price_agorot"] for v in out["variants"]] == want
    assert flagged is None or out["needs_review"] == flagged


def test_price_rows_are_hints(spark):
    rows = [line(["שניצל", "עוף"], no=0), line(["68"], no=1), line(["סלט"], y=300, no=2)]
    out = parsed(spark, rows)
    got = {r["name"]: r for r in out.items.collect()}
    assert [v["price_agorot"] for v in got["שניצל עוף"]["variants"]] == [6800] and got["שניצל עוף"]["needs_review"]
    assert out.stats.first()["lines"] == 2


def test_pages_share_categories(spark):
    rows = page(HEBREW, page_id="a") + page(HEBREW, page_id="b")
    pages = spark.createDataFrame([("m", "a", 1, 1000.0), ("m", "b", 0, 1000.0)], PAGES)
    out = parse.parse_pages(lines_of(spark, rows), spark.createDataFrame([], HINTS), pages)
    assert out.categories.count() == 3 and out.items.count() == 20
    assert out.items.orderBy("item_pos").first()["source_image_ids"] == ["b"]


def test_price_column(spark):
    strip = [("m", "p", n, t, 90.0, (40.0, float(a), 120.0, float(b)), []) for n, (a, b, t) in enumerate([(240, 288, "32"), (440, 488, "1"), (640, 688, "22 32")])]
    df = lines_of(spark, strip).withColumn("page_width", F.lit(1000.0)).withColumn("side", F.lit("left"))
    hints = L.to_price_hints(df)
    assert [r["values"] for r in hints.orderBy("hint_no").collect()] == [[3200], [2200, 3200]]
    box = spark.range(1).select(L.to_page_box(F.struct(F.lit(40.0).alias("x0"), F.lit(140.0).alias("y0"), F.lit(140.0).alias("x1"), F.lit(190.0).alias("y1")), F.lit(1000.0), F.lit("left")).alias("b"), L.band_origin(F.lit(1000.0), F.lit("right")), L.band_width(F.lit(1000.0))).first()
    assert tuple(box["b"]) == (0, 50, 50, 75) and (box[1], box[2]) == (820, 180)
    found = L.hint_for_line(lines_of(spark, [line(["שניצל", "8"], no=0), line(["שניצל", "8"], y=900, no=1)]), hints).orderBy("line_no").collect()
    assert found[0]["hint"]["values"] == [3200] and found[1]["hint"] is None
    sides = [line(["a", "68"], menu="m", page="l", no=0), line(["b", "18"], ltr=True, page="n", no=0), line(["x", "y"], page="o", no=0)]
    sides[0][6][1] = ("68", 92.0, (20.0, 0.0, 70.0, 24.0))
    sides[1][6][1] = ("18", 92.0, (940.0, 0.0, 990.0, 24.0))
    pages = spark.createDataFrame([("m", p, 0, w) for p, w in (("l", 1000.0), ("n", 1000.0), ("o", 1000.0), ("z", 0.0))], PAGES)
    assert {r["page_id"]: r["side"] for r in L.detect_price_side(lines_of(spark, sides), pages).collect()} == {"l": "left", "n": "right", "o": None, "z": None}


def test_median(spark):
    rows = [line(["x"], height=h, no=i) for i, h in enumerate([10, 30, 20, 24])]
    assert L.median_height(lines_of(spark, rows)).first()["median_height"] == 22


@pytest.mark.parametrize("long_page", [10_000, 5])
def test_windows_equal_the_sequential_rule(spark, long_page):
    """Headings, dishes and continuations on random pages, against a loop with two variables; pages of over five lines by blocks."""
    rng = random.Random(11)
    kinds = {"head": ["Drinks"], "price": ["Dish", "one", "45"], "market": ["Fish", "market", "price"], "wordy": ["w", "x", "y", "zz"], "with": ["with", "oil"], "short": ["Soup"], "tiny": ["q"], "long": ["l" * 45]}
    rows, want = [], {}
    for p in range(25):
        menu, own, last, head = [], [], None, None
        for no in range(rng.randrange(1, 14) if p else 90):
            k = rng.choice(list(kinds))
            menu.append((kinds[k], {"ltr": True}))
            if k == "head":
                head, last = "Drinks", None
            elif k in ("price", "market"):
                own.append([no, head, []])
                last = own[-1]
            elif k in ("wordy", "with") and last:
                last[2].append(" ".join(kinds[k]))
            elif k not in ("tiny", "long"):
                own.append([no, head, []])
                last = own[-1]
        rows += page(menu, page_id=f"p{p}")
        want |= {(f"p{p}", no): (h, " ".join(d) or None) for no, h, d in own}
    pages = spark.createDataFrame([("m", f"p{p}", p, 1000.0) for p in range(25)], PAGES)
    out = parse.parse_pages(lines_of(spark, rows), spark.createDataFrame([], HINTS), pages, parse.ParseOptions(long_page=long_page, block_lines=long_page))
    named = out.items.join(out.categories.select("category_id", F.col("name").alias("head")), "category_id", "left")
    assert {(r["page_id"], r["line_no"]): (r["head"], r["description"]) for r in named.collect()} == want


def test_blocks_equal_pages(spark):
    """All that is known of a line, with tall headings, price rows and hints: pages by blocks of seven lines and as windows."""
    rng = random.Random(5)
    kinds = [(["Drinks"], {}), (["Big", "one"], {"height": 40}), (["Dish", "45"], {}), (["Dish"], {}), (["45"], {}), (["with", "oil"], {}), (["Fish", "market", "price"], {}), (["Beer", "22", "32"], {})]
    rows = [r for p, n in enumerate((120, 3, 40, 8)) for r in page([(t, {"ltr": True} | o) for t, o in rng.choices(kinds, k=n)], page_id=f"p{p}")]
    hints = [("m", f"p{p}", n, [rng.randrange(10, 300) * 100], (10.0, float(y), 60.0, float(y + 24))) for p in range(4) for n, y in enumerate(rng.sample(range(0, 4000, 7), 60))]
    get = lambda long_page: {(r["page_id"], r["line_no"]): r.asDict(recursive=True) for r in parse.classify_lines(
        lines_of(spark, rows), spark.createDataFrame(hints, HINTS), parse.ParseOptions(long_page=long_page, block_lines=long_page)).drop("segment").collect()}
    whole, blocks = get(10_000), get(7)
    assert whole == blocks and any(r["inferred"] for r in whole.values()) and any(r["continues"] for r in whole.values())


@pytest.mark.parametrize("scale", [1.0, 1e-4])
def test_hints_by_rows(spark, scale):
    """Boxes of every height, one as high as the page, flat and turned ones, against all pairs; also where pages are measured in shares."""
    rng = random.Random(3)

    def boxes(n):
        out = []
        for k in range(n):
            y = rng.uniform(-200, 2000)
            high = rng.choice([0.0, -5.0, 12.0, 24.0, 24.0, 30.0, rng.uniform(1, 400), 2500.0 if k == 7 else 20.0])
            out.append((0.0, y * scale, 10.0, (y + high) * scale))
        return out

    lines = [("m", p, n, "x", 90.0, b, []) for p in "ab" for n, b in enumerate(boxes(80))]
    hints = [("m", p, n, [rng.randrange(5)], b) for p in "ab" for n, b in enumerate(boxes(60))] + [("m", "c", 0, [1], (0.0, 0.0, 1.0, 1.0)), ("m", "a", 99, [1], None)]
    df, pool = lines_of(spark, lines), spark.createDataFrame(hints, HINTS)
    want = {}
    for _, p, n, _, _, a, _ in lines:
        near = [(no, v) for _, q, no, v, b in hints if b and p == q and min(a[3] - a[1], b[3] - b[1]) > 0 and (min(a[3], b[3]) - max(a[1], b[1])) / min(a[3] - a[1], b[3] - b[1]) >= 0.5]
        want[p, n] = list(dict.fromkeys(v[0] for _, v in sorted(near))) or None
    for bins in (True, False):
        got = {(r["page_id"], r["line_no"]): r["hint"] and r["hint"]["values"] for r in L.hint_for_line(df, pool, bins=bins).collect()}
        assert got == want
    assert any(want.values())


def test_many_hints_on_a_page(spark):
    """30,000 lines and hints of one page: 900 million pairs, of which 30,000 are looked at."""
    box = lambda y: F.struct(F.lit(0.0).alias("x0"), y.cast("double").alias("y0"), F.lit(9.0).alias("x1"), (y + 20).cast("double").alias("y1"))
    rows = spark.range(30_000).select(F.lit("m").alias("menu_id"), F.lit("p").alias("page_id"), F.col("id").alias("line_no"), box(F.col("id") * 30).alias("bbox"))
    hints = spark.range(30_000).select(F.lit("m").alias("menu_id"), F.lit("p").alias("page_id"), F.col("id").alias("hint_no"), F.array("id").alias("values"), box(F.col("id") * 30 + 4).alias("bbox"))
    assert L.hint_for_line(rows, hints).filter(F.col("hint.values")[0] == F.col("line_no")).count() == 30_000


def test_lines_of_one_file_are_many_tasks(spark, tmp_path):
    """Reading a line is much work for few bytes: lines of one file are spread before it."""
    spark.range(2_000).selectExpr("id as p_partkey", "cast(id % 50 as int) as p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    sizes = [r[0] for r in views.right_lines(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) >= 4 and sum(sizes) == 2_000 and max(sizes) < 1_000

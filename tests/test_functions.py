from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from menuspark.functions import money, text as T


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]


def test_parse_money(spark):
    want = {
        "12": 1200, "12.5": 1250, "12.50": 1250, "0.99": 99, "12,50": 1250, "₪45": 4500, "45 ₪": 4500, '45 ש"ח': 4500, "45 שח": 4500, "45 NIS": 4500, "45 nis": 4500,
        "1,234.50": 123_450, "1.234,50": 123_450, "1.234.56": None, "12.005": 1201, "1.005": 100, "": None, "abc": None, "12-14": None, "12 14": None,
        "-5": None, None: None, " ‏32‎ ": 3200, " 12 ": 1200, "1,234": 123_400, "12,345.6": 1_234_560, "1000000": 100_000_000, "1000001": None, "12.": None, ".5": None, "45 שקלים": 4500, "12,5,0": None,
    }
    assert column(spark, list(want), money.parse_money) == list(want.values())
    assert column(spark, [0.1 + 0.2, -1.0, float("nan"), 12.005, 2e6], money.parse_number, "double") == [30, None, None, 1201, None]


def test_formats_and_helpers(spark):
    assert column(spark, [1200.0, 1250.0, 5.0, 1200.5, 1200.4, 123450.0], money.format_amount, "double") == ["12.00", "12.50", "0.05", "12.01", "12.00", "1,234.50"]
    assert column(spark, [1250.0, -1250.0, 123450.0, -0.4, 0.0], money.format_ils, "double") == ["₪12.50", "-₪12.50", "₪1,234.50", "-₪0.00", "₪0.00"]
    assert column(spark, [12.0, 12.5, 0.0], money.percent_to_bp, "double") == [1200, 1250, 0]
    assert column(spark, [0.5, -0.5, 2.4], money.round_half_away, "double") == [1, -1, 2]
    assert column(spark, [100.0, 100.5, -1.0, float("nan"), None, 1e8, 1e8 + 1], money.is_valid_agorot, "double") == [True, False, False, False, False, True, False]
    assert column(spark, [1250], money.bp_to_percent, "int") == [12.5]
    assert column(spark, [0.0, 0.5, 1.7], money.meter, "double") == [0, 50, 100]


def test_budget_boundary(spark):
    df = spark.createDataFrame([(53_571,), (53_572,)], "s long")
    assert [r[0] for r in df.select(money.is_within_budget(F.col("s"), F.lit(1200), F.lit(60_000))).collect()] == [True, False]
    df = spark.createDataFrame([(60_000, 1200), (60_000, 0), (0, 1200), (-5, 0), (10**14, 1250)], "t long, b int")
    assert [r[0] for r in df.select(money.max_food_subtotal(F.col("t"), F.col("b"))).collect()] == [53_571, 60_000, 0, 0, 10**14 * 10_000 // 11_250]
    assert column(spark, [5000], lambda c: money.marginal_cost(c, F.lit(1200)), "long") == [5600.0]


def test_names(spark):
    got = column(spark, ["שְׁנִיצֶל, עוף!", "Fresh  Lemonade", "A–B (c)/d*", None, ""], T.normalize_name)
    assert got == ["שניצל עוף", "fresh lemonade", "a b c d", None, ""]
    assert column(spark, ["ﬁsh ①", "plain", "שלום", None], lambda c: T.normalize_name(c, is_nfkc=False)) == ["fish 1", "plain", "שלום", None]
    assert column(spark, ["ﬁsh", "plain-1", "שְׁלום", "é", None], T.needs_nfkc) == [True, False, False, True, False]


def plain_dice(a: str, b: str) -> float:
    from collections import Counter

    if not a or not b:
        return 0.0
    x, y = (Counter(f"  {t}  "[i : i + 3] for i in range(len(t) + 2)) for t in (a, b))
    return 1.0 if a == b else 2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values()))


def test_similarity(spark):
    pairs = [("חומוס הבית", "חומוס הבית"), ("חומוס הבית", "חומוס הביח"), ("חומוס הבית", "שניצל עוף"), ("cold widget", "old widget"), ("aaaa", "aaaaaa"), ("", "a"), ("ab", "ba"), ("banana bananas", "bananas banana")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = [r[1] for r in df.select("i", T.similarity(F.col("a"), F.col("b"))).orderBy("i").collect()]
    assert got == pytest.approx([plain_dice(*p) for p in pairs])
    assert got[0] == 1 and got[1] >= T.SIMILARITY_THRESHOLD and got[2] < 0.3


def test_line_rules(spark):
    assert column(spark, ["a .... b", "‏ a — b", "x..y", "a . b"], T.clean_line_text) == ["a b", "a — b", "x y", "a . b"]
    assert column(spark, ["אב ab", "abc א", "12"], T.line_direction) == ["rtl", "ltr", "rtl"]
    assert column(spark, ["גרם", "ML.", "%", "x", ""], T.is_unit_word) == [True, True, True, False, False]
    assert column(spark, ["Drinks:", "קינוחים", "drinks and more"], T.is_category_word) == [True, True, False]
    assert column(spark, ["עם שמן", "one two three four", "served hot", "withx y", "a b"], T.is_continuation) == [True, True, True, False, False]
    assert column(spark, ["קטן גדול", "large small", "אבsmall", "smallish", "חצי ליטר", "Glass of wine"], T.detect_variant_labels) == [["קטן", "גדול"], ["גדול", "קטן"], ["קטן"], [], ["חצי", "חצי ליטר"], ["כוס"]]
    assert column(spark, ["מבצע", "1 + 1", "11 + 1", "combo meal", "אבcombo", "20 % off", "plain"], T.is_promo) == [True, True, False, True, True, True, False]
    got = column(spark, ["דג לפי מחיר שוק", "steak per kg per kg", "S.Q.", "plain"], T.market_pattern)
    assert [(g["kind"], g["rest"].split()) if g else None for g in got] == [("market", ["דג", "לפי"]), ("byWeight", ["steak", "per", "kg"]), ("market", ["."]), None]
    assert [r["kind"] for r in column(spark, ["Failed to load x", "out of memory", "other"], T.classify_ocr_error)] == ["network", "memory", "other"]

from __future__ import annotations

import math
import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from menuspark.llm import toxicity


def plain_segments(scores: list[float], at: int = 0) -> list[tuple[int, int, float]]:
    """By definition: the best segment, and the same left and right of it."""
    best = max(((sum(scores[i : j + 1]), -i, -j) for i in range(len(scores)) for j in range(i, len(scores))), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    s, i, j = best[0], -best[1], -best[2]
    return plain_segments(scores[:i], at) + [(at + i, at + j, s)] + plain_segments(scores[j + 1 :], at + j + 1)


def test_all_maximal_segments():
    rng = random.Random(2)
    for _ in range(300):
        scores = [rng.choice([-0.31, -0.31, rng.uniform(0.1, 2)]) for _ in range(rng.randrange(0, 25))]
        got = toxicity.segments([(i, s) for i, s in enumerate(scores) if s > 0], -0.31)
        want = plain_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(got, want))


def test_held_out_accuracy(spark, sf_dir):
    base = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(base + "/documents.parquet"), spark.read.parquet(base + "/labels.parquet")
    model = toxicity.fit(docs, labels)
    held = docs.join(labels, "doc_id").filter(F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    out = toxicity.score(held, model).select("toxic", (F.col("toxicity.score") >= 0.5).cast("int").alias("p")).toPandas()
    assert (out["toxic"] == out["p"]).mean() > 0.97
    assert out[out["toxic"] == 1]["p"].mean() > 0.85


def test_passages_and_odd_rows(spark):
    model = toxicity.Model({"idiot": 6.0, "vile": 5.0}, -0.05, rate=1.0, k=0.01, slope=4.0, shift=-8.0)
    calm = "word " * 400
    rows = [(1, calm + "you idiot, you vilest IDIOT!" + " word" * 400, "a"), (2, calm, "b"), (3, None, "c"), (None, "", "d"), (5, "x" * 200_000, "e"), (5, "x" * 200_000, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    out = toxicity.score(docs, model).collect()
    assert [r["score"] for r in out] == ["a", "b", "c", "d", "e", "e"]
    passages = out[0]["toxicity"]["passages"]
    assert len(passages) == 1 and rows[0][1][passages[0]["start"] : passages[0]["end"]] == "idiot, you vilest IDIOT"
    assert out[0]["toxicity"]["score"] > 0.5 > out[1]["toxicity"]["score"] and out[1]["toxicity"]["passages"] == []
    assert out[2]["toxicity"]["score"] == out[3]["toxicity"]["score"] == out[1]["toxicity"]["score"]


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 0), (None, 1)], "doc_id long, toxic int")
    assert [r["toxicity"]["score"] < 0.5 for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()] == [True, True]
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels.limit(0))).count() == 0


def test_log_odds_by_hand(spark):
    counts = {"a": (40, 1), "b": (3, 300), "c": (0, 7), "d": (5, 5)}
    n1, n0 = 500, 4000
    rows = [(f, *c) for f, c in counts.items()]
    for r in toxicity.log_odds(spark.createDataFrame(rows, "feature string, ones long, zeros long"), n1, n0, prior=0.1).collect():
        y1, y0 = counts[r["feature"]]
        a, total = 0.1 * (y1 + y0), 0.1 * (n1 + n0)
        odds = lambda y, n: (y + a) / (n + total - y - a)
        delta = math.log(odds(y1, n1)) - math.log(odds(y0, n0))
        assert math.isclose(r["delta"], delta, rel_tol=1e-9) and math.isclose(r["z"], delta / math.sqrt(1 / (y1 + a) + 1 / (y0 + a)), rel_tol=1e-9)


def plain_score(model: toxicity.Model, text: str) -> float:
    """The probability by definition: a score for every token, segments by recursion, the sum statistic tried for each r."""
    def of(w):
        own = [f for f in model.listed if w == f or (len(f) >= toxicity.LEAST and w.startswith(f))]
        return model.listed[max(own, key=len)] if own else model.other

    words = re.findall(r"\w+", text.lower())
    found = sorted((s for _, _, s in plain_segments([of(w) for w in words])), reverse=True)
    best = total = 0.0
    for r, s in enumerate(found, 1):
        x = model.rate * s - math.log(model.k * len(words))
        if total + x <= total:
            break
        total += x
        p = -math.log(-math.expm1(-math.exp(-total))) if r == 1 and total < 30 else total - (r - 1) * math.log(total) + math.log(math.factorial(r)) + math.log(math.factorial(r - 1))
        best = max(best, p - (r - 1) * math.log(2))
    return 1 / (1 + math.exp(-(model.slope * math.log1p(min(best, 500)) + model.shift)))


def test_scores_equal_the_definition(spark):
    rng = random.Random(9)
    model = toxicity.Model({"idio": 3.0, "idiot": 5.5, "vile": 4.0, "bad": 1.2, "dumb": 3.3}, -0.2137, rate=0.8, k=0.2, slope=2.0, shift=-3.0)
    words = ["calm", "words", "idiot", "idiots", "idiocy", "viler", "bad", "badly", "dumb", "du", "x" * 50]
    rows = [(i, " ".join(rng.choice(words[:2] * 6 + words) for _ in range(rng.randrange(0, 60)))) for i in range(60)]
    got = {r["doc_id"]: r["toxicity"]["score"] for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert all(abs(got[i] - plain_score(model, t)) < 1e-8 for i, t in rows)
    assert max(got.values()) > 0.8 > 0.2 > min(got.values())


def test_a_very_long_token(spark):
    """A word of a million letters costs no more than its letters, also behind a listed head."""
    began = time.monotonic()
    rows = [(i, ("idiot fool " if i % 2 else "calm sea ") * 40 + ("idiot" + "x" * 1_000_000 if i < 3 else "")) for i in range(1, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert {"idiot", "fool"} <= model.listed.keys() and model.longest <= toxicity.LONGEST
    got = {r["doc_id"]: r["toxicity"]["score"] for r in toxicity.score(docs, model).collect()}
    assert all((got[i] > 0.5) == (i % 2 == 1) for i, _ in rows) and time.monotonic() - began < 90


def test_the_background_solves_its_equation():
    listed = np.array([3.0, 2.5, 4.0] * 10)
    rate = toxicity._background(listed, 50_000.0, -0.05)
    total = (50_000 - 30) / 50_000 * math.exp(rate * -0.05) + sum(math.exp(rate * s) for s in listed) / 50_000
    assert 0.05 < rate < 2 and abs(total - 1) < 1e-6

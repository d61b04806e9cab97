"""Toxicity by maximum-scoring segments.

Every token has a log-odds score: how much likelier it is in toxic texts than in others, under an informative Dirichlet
prior (Monroe, Colaresi and Quinn, 2008). A token is a word; its features are its beginnings of ``LEAST`` to ``LONGEST`` letters
(a shorter word's is itself), and a word takes the score of its longest listed feature, so that unseen endings of a known
stem count. Features whose z-score is under ``least_z`` or whose score is under ``LEAST_DELTA`` are not listed; all unlisted tokens share one negative score.

A linear scan (Ruzzo and Tompa, 1999) finds all maximal-scoring segments of a whole text. Under the scores' background
their maxima follow an extreme-value law with parameters lambda and K (Karlin and Altschul, 1990); segments with an expected
number of chance occurrences of at most ``MOST_EXPECTED`` are the toxic passages. The best segments together give the text
one p-value, by Karlin and Altschul's sum statistic, and one logistic curve turns its logarithm into a probability.

Learning is bounded: at most ``sample_docs`` labelled documents a class. Scoring reads every token of every text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import crc_fold, slices, staged

LEAST, LONGEST, FOLDS, SAMPLE_DOCS, LEAST_Z, LEAST_DELTA, PRIOR = 4, 32, 5, 6000, 4.0, 2.5, 0.05
MOST_EXPECTED, THRESHOLD = 0.05, 0.5
PASSAGES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("expected", T.DoubleType())]))
WORD = re.compile(r"\w+")


@dataclass
class Model:
    listed: dict[str, float]
    other: float  # the score of an unlisted token
    rate: float = 1.0  # lambda
    k: float = 1.0
    slope: float = 1.0
    shift: float = 0.0
    heads: frozenset[str] = field(default_factory=frozenset)
    longest: int = 0

    def __post_init__(self):
        self.heads = frozenset(w[:LEAST] for w in self.listed)
        self.longest = max(map(len, self.listed), default=0)

    def of(self, word: str) -> float | None:
        """The score of the longest listed beginning of a word."""
        if word in self.listed:
            return self.listed[word]
        for n in range(min(len(word) - 1, self.longest), LEAST - 1, -1):
            if word[:n] in self.listed:
                return self.listed[word[:n]]
        return None

    def hits(self, text: str) -> tuple[list[tuple[int, float]], int]:
        """The places and scores of listed tokens, and the number of tokens."""
        words, heads = WORD.findall(text.lower()), self.heads
        at = [i for i, w in enumerate(words) if w[:LEAST] in heads]
        return [(i, s) for i in at if (s := self.of(words[i])) is not None], len(words)


def segments(hits: list[tuple[int, float]], other: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first token, last token, score). Only listed tokens can begin or end one, so the scan
    goes from one to the next, with the unlisted ones between as one step: linear in the listed tokens."""
    left: list[float] = []  # total before the segment
    right: list[float] = []  # total after it
    spans: list[tuple[int, int]] = []
    link: list[int] = []  # the next segment to the left with a smaller total before it
    total, last = 0.0, -1
    for i, s in hits:
        total += other * (i - last - 1)
        before, total, last = total, total + s, i
        if s <= 0:
            continue
        span, low = (i, i), before
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= low:
                j = link[j]
            if j < 0 or right[j] >= total:
                break
            low, span = left[j], (spans[j][0], i)
            del left[j:], right[j:], spans[j:], link[j:]
        left.append(low)
        right.append(total)
        spans.append(span)
        link.append(j)
    return [(a, b, r - q) for (a, b), q, r in zip(spans, left, right)]


def evidence(model: Model, found: list[tuple[int, int, float]], tokens: int) -> float:
    """-ln of the p-value of the text's best segments together; each number r of segments is tried at the price 2**-r."""
    normal = sorted((model.rate * s - math.log(model.k * max(tokens, 1)) for _, _, s in found), reverse=True)
    best, total = 0.0, 0.0
    for r, s in enumerate(normal, 1):
        total += s
        if s <= 0:
            break
        if r == 1:
            p = total if total > 30 else -math.log(-math.expm1(-math.exp(-total)))
        else:
            p = total - (r - 1) * math.log(max(total, 1e-9)) + math.lgamma(r + 1) + math.lgamma(r)
        best = max(best, p - (r - 1) * math.log(2))
    return min(best, 500.0)


def _curve(e: np.ndarray) -> np.ndarray:
    return np.log1p(e)


def probability(model: Model, e: float) -> float:
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, model.slope * float(_curve(np.array(e))) + model.shift))))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, occurrences in texts of label 1, of label 0); the feature "" has all tokens."""
    for batch in slices(batches, 2048):
        words: tuple[Counter, Counter] = (Counter(), Counter())
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words[label].update(WORD.findall((text or "").lower()))
        found: dict[str, list[int]] = {}
        for label in (0, 1):
            for w, n in words[label].items():
                for m in range(min(LEAST, len(w)), min(LONGEST, len(w)) + 1):
                    found.setdefault(w[:m], [0, 0])[label] += n
        totals = [sum(words[0].values()), sum(words[1].values())]
        keys = [*found, ""]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([*(found[k][1] for k in found), totals[1]], pa.int64()), pa.array([*(found[k][0] for k in found), totals[0]], pa.int64())], ["feature", "ones", "zeros"])


def log_odds(counts: DataFrame, n1: int, n0: int, *, prior: float = PRIOR) -> DataFrame:
    """(feature, delta, z) by the informative Dirichlet prior: ``prior`` times all tokens are pseudo-tokens of each class,
    shared out as all tokens are."""
    pseudo = prior * (n1 + n0)
    a = F.lit(prior) * (F.col("ones") + F.col("zeros"))
    one, zero = F.col("ones") + a, F.col("zeros") + a
    delta = F.log(one / (n1 + pseudo - one)) - F.log(zero / (n0 + pseudo - zero))
    return counts.select("feature", "ones", "zeros", delta.alias("delta"), (delta / F.sqrt(1 / one + 1 / zero)).alias("z"))


def _observe(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, 2048):
            labels, tokens, scores, listed = batch.column(1).to_pylist(), [], [], []
            for text in batch.column(0).to_pylist():
                hits, n = model.hits(text or "")
                tokens.append(n)
                scores.append([s for _, _, s in segments(hits, model.other)])
                listed.append([s for _, s in hits])
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(tokens, pa.int64()), pa.array(scores, pa.list_(pa.float64())), pa.array(listed, pa.list_(pa.float64()))], ["label", "tokens", "scores", "listed"])

    return run


def _background(listed: np.ndarray, tokens: float, other: float) -> float:
    """lambda: the positive root of sum(p * exp(lambda * s)) = 1 over the scores of texts of label 0."""
    share = max(tokens - len(listed), 1) / max(tokens, 1)
    value = lambda x: share * math.exp(x * other) + np.exp(np.minimum(x * listed, 600)).sum() / max(tokens, 1) - 1
    low, high = 1e-6, 1e-6
    while value(high) < 0 and high < 4:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return min(max(low, 0.05), 2.0)


def fit(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, folds: int = FOLDS, least_z: float = LEAST_Z) -> Model:
    """Learn from labelled rows whose fold, crc32(id as text) mod ``folds``, is not 0: of each class the ``sample_docs``
    ids with the smallest hashes, staged once. All features that pass are listed; at ``LEAST_Z`` each of them occurs some dozens of
    times in the sample, which bounds the list."""
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)").filter(crc_fold(F.col("id"), folds) != 0)
    ones, total = known.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    chosen = [known.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(sample_docs) for k in (0, 1)]
    sample = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen[0].unionByName(chosen[1])), "id").select("text", "label")
    sample = staged(sample, "toxicity-sample")
    counts = sample.mapInArrow(_features, "feature string, ones long, zeros long").groupBy("feature").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros")).cache()
    n1, n0 = counts.filter("feature = ''").select("ones", "zeros").first() or (0, 0)
    shift = math.log(max(ones, 0.5) / max(total - ones, 0.5)) if total else 0.0
    if not n1 or not n0:  # one class, or nothing, to learn from
        counts.unpersist()
        return Model({}, -1.0, slope=0.0, shift=shift)
    top = log_odds(counts.filter("feature != ''"), n1, n0).filter((F.col("z") >= least_z) & (F.col("delta") >= LEAST_DELTA)).select("feature", "delta").collect()
    counts.unpersist()
    listed = {r["feature"]: r["delta"] for r in top}
    seen = sample.mapInArrow(_observe(spark.sparkContext.broadcast(Model(listed, -0.01))), "label int, tokens long, scores array<double>, listed array<double>").select("label", "tokens", F.size("listed").alias("n"))
    share = {r["label"]: (r["n"] or 0) / max(r["tokens"], 1) for r in seen.groupBy("label").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).collect()}
    other = math.log((1 - min(share.get(1, 0), 0.9)) / (1 - min(share.get(0, 0), 0.89))) - 1e-3
    model = Model(listed, min(other, -1e-3))
    got = sample.mapInArrow(_observe(spark.sparkContext.broadcast(model)), "label int, tokens long, scores array<double>, listed array<double>").toPandas()
    zero = got[got["label"] == 0]
    background = np.concatenate([np.asarray(x, float) for x in zero["listed"]] or [np.zeros(0)])
    model.rate = _background(background, float(zero["tokens"].sum()), model.other)
    most = np.array([max(x, default=0.0) for x in zero["scores"]])
    size = np.maximum(zero["tokens"].to_numpy(float), 1)
    model.k = float(np.clip(len(zero) / (size * np.exp(-model.rate * most)).sum(), 1e-6, 10.0))
    x = _curve(np.array([evidence(model, [(0, 0, s) for s in own], n) for own, n in zip(got["scores"], got["tokens"])]))
    model.slope, model.shift = _logistic(x, got["label"].to_numpy(float))
    sampled = got["label"].mean()
    model.shift += shift - math.log(sampled / (1 - sampled))
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton's method for one logistic curve, with a small ridge; equal weights for the classes' sums as sampled."""
    w, design, ridge = np.zeros(2), np.stack([x, np.ones_like(x)], axis=1), np.diag([1e-2, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -50, 50)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge, design.T @ (y - p) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 0.0)), float(w[1])


def _score(shared, names: list[str]):
    passage = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, 2048):
            scores, passages = [], []
            for text in batch.column(0).to_pylist():
                text = text or ""
                hits, tokens = model.hits(text)
                found = segments(hits, model.other)
                scores.append(round(probability(model, evidence(model, found, tokens)), 9))
                expected = [model.k * tokens * math.exp(-model.rate * s) for _, _, s in found]
                strong = [(a, b, s, e) for (a, b, s), e in zip(found, expected) if e <= MOST_EXPECTED]
                if strong:
                    lowered = text.lower()
                    at = [m.span() for m in WORD.finditer(lowered)]
                    strong = [{"start": at[a][0], "end": at[b][1], "score": s, "expected": e} for a, b, s, e in strong]
                passages.append(strong)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores, pa.float64()), pa.array(passages, passage)], names)

    return run


def score(docs: DataFrame, model: Model, *, text_col: str = "text", to: str = "toxicity") -> DataFrame:
    """``docs`` with ``to`` = struct(score, passages): the probability of the toxic label from the whole text alone (null as
    empty: a text without tokens has no evidence), and each significant passage's start and end in the lower-cased text,
    its score and its expected number by chance. All other columns stay, whatever their names."""
    rest = [c for c in docs.columns if c != to]
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.struct(*[docs[c] for c in rest]).alias("row"))
    schema = rows.select("row").schema.add("score", "double").add("passages", PASSAGES)
    out = rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model), schema.names), schema)
    return out.select("row.*", F.struct("score", "passages").alias(to))

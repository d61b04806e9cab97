from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from menuspark.llm import quality


def plain_logit(net: quality.Network, raw: bytes) -> float:
    """The network window by window."""
    size = max(len(raw), 1)
    padded = raw + bytes(quality.WIDTH + 1)
    chunks = []
    for at in range(0, size, quality.CHUNK):
        best = np.full(quality.FILTERS, -np.inf)
        for i in range(at, min(at + quality.CHUNK, size)):
            best = np.maximum(best, sum(net.embed[padded[i + w]] @ net.taps[w] for w in range(quality.WIDTH)))
        chunks.append(np.maximum(best + net.bias, 0))
    return float(np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)]) @ net.out + net.shift)


def random_network(seed=3) -> quality.Network:
    rng = np.random.default_rng(seed)
    return quality.Network(rng.normal(size=(256, quality.EMBED)), rng.normal(size=(quality.WIDTH, quality.EMBED, quality.FILTERS)), rng.normal(size=quality.FILTERS), rng.normal(size=2 * quality.FILTERS), 0.3)


def test_scores_equal_the_plain_network():
    net = random_network()
    texts = [b"", b"a", b"x" * 251, b"y" * 252, b"z" * 256, b"q" * 257, bytes(range(256)) * 5, "größe ß ".encode() * 99]
    assert np.allclose(quality.logits(net, texts), [plain_logit(net, t) for t in texts], rtol=1e-4, atol=1e-3)


def test_the_last_bytes_of_a_long_text_count():
    net = random_network()
    a, b = b"a" * 100_000, b"a" * 99_990 + b"%$#@!%$#@!"
    assert quality.logits(net, [a])[0] != quality.logits(net, [b])[0]


def test_learns_junk(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")
    labels = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/labels.parquet")
    net = quality.fit(docs, labels)
    out = quality.score(docs, net).join(labels, "doc_id").filter(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).toPandas()
    good = (out["quality_score"] >= quality.THRESHOLD).astype(int) == out["quality"]
    assert len(out) > 50 and good.mean() > 0.93
    assert set(docs.columns) < set(out.columns)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5.0), (2, "", 6.0), (None, "abc", 7.0), (None, "abc", 7.0), (3, "l" * 120_000, None)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (9, 0)], "doc_id long, quality int")
    out = quality.score(docs, quality.fit(docs, labels)).collect()
    assert [r["doc_id"] for r in out] == [1, 2, None, None, 3]
    assert out[0]["quality_score"] == out[1]["quality_score"] and all(0 <= r["quality_score"] <= 1 for r in out)
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels.limit(0))).count() == 0


def test_the_sample_is_bounded_and_has_every_chunk(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(quality, "train", lambda samples, share: taken.append((samples, share)))
    rows = [(i, f"text {i} " * 400) for i in range(60)] + [(3, "again " * 300)] * 50 + [(61, "x" * (1 << 20 | 1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(62)], "doc_id long, quality int")
    quality.fit(docs, labels)
    (samples, share), = taken
    own = [(data, valid, k) for data, valid, k in samples]
    trained = [i for i in range(60) if __import__("zlib").crc32(str(i).encode()) % 5]
    want = [(*quality.sample_chunks(t.encode()), i % 2) for i, t in rows if i in trained and i != 61]
    assert sorted(own) == sorted(want) and 0 < share < 1
    assert all(sum(valid) == max(len(data) - 5 * len(valid), 0) or valid[-1] < quality.CHUNK for data, valid, _ in own)
    taken.clear()
    quality.fit(docs, labels, sample_docs=5, sample_bytes=9_000)
    own = taken[0][0]
    assert 0 < len(own) <= 10 and all(sum(sum(v) for _, v, k in own if k == label) <= 9_000 for label in (0, 1))

"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded and convolved by learned filters. Filters' responses are max-pooled over chunks of
``CHUNK`` window starts; chunks overlap by a window's width less one, so every window of the whole text is in one. The
pooled chunks are combined, by mean and by maximum, into one logistic unit.

Learning is bounded: at most ``sample_docs`` labelled documents a class, of ``SAMPLE_TEXT`` bytes at most each and ``sample_bytes``
in all; every chunk of theirs is learned from. Scoring reads every byte of every text. There the embedding and each filter tap are one table of 256 rows,
so a response is a sum of table rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import as_bytes, crc_fold, slices, staged

WIDTH, CHUNK, EMBED, FILTERS = 6, 256, 8, 32
SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_TEXT, EPOCHS, BATCH, STEPS, FOLDS, THRESHOLD = 2000, 16 << 20, 1 << 20, 7, 32, 600, 5, 0.3
_LOW = np.float32(-1e9)


@dataclass
class Network:
    embed: np.ndarray  # 256 x EMBED
    taps: np.ndarray  # WIDTH x EMBED x FILTERS
    bias: np.ndarray  # FILTERS
    out: np.ndarray  # 2 FILTERS, of the mean and of the maximum
    shift: float  # the output's bias, which carries the classes' true shares

    @property
    def tables(self) -> np.ndarray:
        return np.einsum("be,wef->wbf", self.embed, self.taps).astype(np.float32)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _pooled(net_tables: np.ndarray, data: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Maximum response of each filter over each chunk's windows. data: the chunks' bytes end to end and WIDTH - 1 more;
    valid: how many windows of each chunk count."""
    chunks, filters = len(valid), net_tables.shape[2]
    out = np.empty((chunks, filters), np.float32)
    step = 16
    acc, tap = np.empty((step * CHUNK, filters), np.float32), np.empty((step * CHUNK, filters), np.float32)
    for at in range(0, chunks, step):
        n = min(step, chunks - at)
        a, t = acc[: n * CHUNK], tap[: n * CHUNK]
        for w in range(WIDTH):
            seen = data[at * CHUNK + w : (at + n) * CHUNK + w]
            np.take(net_tables[w], seen, axis=0, out=t if w else a, mode="clip")
            if w:
                a += t
        a = a.reshape(n, CHUNK, filters)
        for i in np.flatnonzero(valid[at : at + n] < CHUNK):
            a[i, valid[at + i] :] = _LOW
        out[at : at + n] = a.max(axis=1)
    return out


def _chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' chunks end to end, the windows that count in each, and each text's number of chunks. A text fills whole
    chunks with zeros after it, WIDTH - 1 at least; an empty text is one chunk of one window of zeros."""
    lengths = np.array([max(len(t), 1) for t in texts])
    counts = -(-(lengths + WIDTH - 1) // CHUNK)
    real = -(-lengths // CHUNK)
    data = b"".join([t.ljust(n * CHUNK, b"\0") for t, n in zip(texts, counts)])
    number = np.concatenate([np.arange(n) for n in counts])
    valid = np.clip(np.repeat(lengths, counts) - number * CHUNK, 0, CHUNK)
    return np.frombuffer(data + bytes(WIDTH - 1), np.uint8), np.where(np.repeat(real, counts) > number, valid, 0), counts


def logits(net: Network, texts: list[bytes], tables: np.ndarray | None = None) -> np.ndarray:
    data, valid, counts = _chunks(texts)
    hidden = np.maximum(_pooled(net.tables if tables is None else tables, data, valid) + net.bias, 0)
    hidden[valid == 0] = 0
    ends = np.cumsum(counts)
    starts = ends - counts
    real = np.add.reduceat((valid > 0).astype(np.int64), starts)
    mean = np.add.reduceat(hidden, starts, axis=0) / real[:, None]
    most = np.maximum.reduceat(hidden, starts, axis=0)
    return np.concatenate([mean, most], axis=1) @ net.out + net.shift


def sample_chunks(raw: bytes) -> tuple[bytes, list[int]]:
    """All chunks of a text, each with the WIDTH - 1 bytes after it, and the windows that count in each."""
    size, length = CHUNK + WIDTH - 1, max(len(raw), 1)
    starts = range(0, length, CHUNK)
    return b"".join([raw[i : i + size].ljust(size, b"\0") for i in starts]), [min(CHUNK, length - i) for i in starts]


def _strongest(tables: np.ndarray, x: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each filter's strongest window in each chunk, and its response; few chunks at a time, whatever the batch holds."""
    where, top = np.empty((len(x), FILTERS), np.int64), np.empty((len(x), FILTERS), np.float32)
    for at in range(0, len(x), 32):
        own = x[at : at + 32]
        act = tables[0][own[:, :CHUNK]]
        for w in range(1, WIDTH):
            act += tables[w][own[:, w : w + CHUNK]]
        act[np.arange(CHUNK) >= valid[at : at + 32, None]] = _LOW
        where[at : at + 32] = best = act.argmax(axis=1)
        top[at : at + 32] = np.take_along_axis(act, best[:, None], axis=1)[:, 0]
    return where, top


def train(samples: list[tuple[bytes, list[int], int]], share: float, *, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """From (chunk bytes, windows that count, label) of a balanced sample; ``share``: of label 1 among all. Adam on the
    log loss. A maximum passes its gradient to one window, so only that window's bytes are touched."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.5, (256, EMBED)), rng.normal(0, 0.3, (WIDTH, EMBED, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, 2 * FILTERS), 0.0)
    labels = np.array([s[2] for s in samples], np.float64)
    ones = labels.mean() if len(labels) else 0.5
    prior = np.log(share / (1 - share)) if 0 < share < 1 else np.sign(share - 0.5) * 20.0
    if not len(labels) or not 0 < ones < 1:  # one class, or nothing, to learn from: the share alone decides
        net.out[:] = 0
        net.shift = float(prior)
        return net
    size = CHUNK + WIDTH - 1
    counts = np.array([len(s[1]) for s in samples])
    first = np.cumsum(counts) - counts
    data = np.frombuffer(b"".join([s[0] for s in samples]), np.uint8).reshape(-1, size)
    valid = np.concatenate([s[1] for s in samples]).astype(np.int64)
    params = [net.embed, net.taps, net.bias, net.out, np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    epochs = max(epochs, -(-STEPS // -(-len(samples) // BATCH)))  # a small sample is seen more often
    for epoch in range(epochs):
        order = rng.permutation(len(samples))
        for at in range(0, len(order), BATCH):
            docs = order[at : at + BATCH]
            n = counts[docs]
            rows = np.concatenate([np.arange(first[d], first[d] + counts[d]) for d in docs])
            doc = np.repeat(np.arange(len(docs)), n)
            tables, x = net.tables, data[rows]
            where, top = _strongest(tables, x, valid[rows])
            hidden = np.maximum(top + net.bias, 0)
            starts = np.cumsum(n) - n
            mean, most = np.add.reduceat(hidden, starts, axis=0) / n[:, None], np.maximum.reduceat(hidden, starts, axis=0)
            both = np.concatenate([mean, most], axis=1)
            error = (sigmoid(both @ net.out + params[4][0]) - labels[docs]) / len(docs)
            g_out = both.T @ error + 1e-4 * net.out
            up = error[:, None] * net.out
            g_hidden = (up[:, :FILTERS] / n[:, None])[doc]
            g_hidden += np.where(hidden == most[doc], up[:, FILTERS:][doc], 0)
            g_hidden *= hidden > 0
            g_bias, g_embed, g_taps = g_hidden.sum(axis=0), np.zeros_like(net.embed), np.zeros_like(net.taps)
            for w in range(WIDTH):
                byte = np.take_along_axis(x, where + w, axis=1)  # chunks x FILTERS
                per = np.zeros((256, FILTERS))
                np.add.at(per, (byte, np.broadcast_to(np.arange(FILTERS), byte.shape)), g_hidden)
                g_embed += per @ net.taps[w].T
                g_taps[w] = net.embed.T @ per
            step += 1
            rate = 0.01 * min(1, step / 30) * (1 - 0.8 * epoch / epochs)
            for i, g in enumerate([g_embed, g_taps, g_bias, g_out, np.array([error.sum()])]):
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.001 * (g * g - v[i])
                params[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net.shift = float(params[4][0]) + float(prior - np.log(ones / (1 - ones)))
    return net


def fit(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, folds: int = FOLDS) -> Network:
    """Learn from the labelled rows whose fold, crc32(id as text) mod ``folds``, is not 0. Of each class the
    ``sample_docs`` ids with the smallest hashes are taken, and of their rows, in that order, as many as stay within ``sample_docs``
    rows and ``sample_bytes`` bytes; rows of over ``SAMPLE_TEXT`` bytes are left out. That bounds what is broadcast and what comes
    to the driver."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)").filter(crc_fold(F.col("id"), folds) != 0)
    ones, total = known.agg(F.sum("label"), F.count("*")).first()
    chosen = [known.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(sample_docs) for k in (0, 1)]
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = staged(docs.select(F.col(id_col).cast("long").alias("id"), text.alias("data")).join(sample, "id").filter(F.length("data") <= SAMPLE_TEXT), "quality-sample")
    order = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id", F.xxhash64("data"), "data").rowsBetween(Window.unboundedPreceding, 0)
    got = rows.withColumn("so_far", F.sum(F.length("data")).over(order)).withColumn("number", F.count("*").over(order)).filter((F.col("so_far") <= sample_bytes) & (F.col("number") <= sample_docs)).toPandas()
    got = got.sort_values(["id", "label", "data"], kind="stable")
    return train([(*sample_chunks(bytes(d)), int(k)) for d, k in zip(got["data"], got["label"])], (ones or 0) / total if total else 0.5)


def _score(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = net.tables
        for batch in slices(batches, 2048):
            texts, found, at = as_bytes(batch.column(0)), [], 0
            while at < len(texts):  # as many texts at once as make about a megabyte
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) < 1 << 20):
                    size += len(texts[end])
                    end += 1
                found.append(sigmoid(logits(net, texts[at:end], tables)))
                at = end
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.concatenate(found).round(9) if found else [], pa.float64())], names)

    return run


def score(docs: DataFrame, net: Network, *, text_col: str = "text", to: str = "quality_score") -> DataFrame:
    """``docs`` with the column ``to``: the probability of label 1, from the whole text alone (null as empty). All other
    columns stay, whatever their names. Scores are rounded to nine places, so that equal texts get
    equal ones whatever batch they are in."""
    rest = [c for c in docs.columns if c != to]
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.struct(*[docs[c] for c in rest]).alias("row"))
    schema = rows.select("row").schema.add("score", "double")
    out = rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(net), schema.names), schema)
    return out.select("row.*", F.col("score").alias(to))

"""SimHash near-duplicates by anchor-point covering.

The anchors are the words of a covering code. A fingerprint's halves each give 31 bits (the top bit of a half is left
out, which can only bring fingerprints closer) and the code is the perfect Hamming [31, 26] code: 2**26 anchors,
covering radius R = 1, so every word has exactly one anchor within 1.

Two fingerprints at distance <= 5 have a half in which they differ in t <= 2 bits. That half has a word at distance 1 at
most from both, whose anchor is within R + 1 = 2 of both. So each half is replicated to its anchors within R + t/2
(16 of them, or 1 for a word of the code), and each pair within the threshold meets at an anchor: none is lost. The
one-sided bound R + t would need 156 anchors for the same pairs.

Copies are one fingerprint before that. At an anchor, a search over shrinking sets finds the links: it gives one edge for
each fingerprint it reaches, not all pairs. Anchors with more than ``cell_rows`` fingerprints are dealt out as blocks
against blocks, so no task gets an unbounded group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import as_bytes, join_counted, parts, slices, staged
from .components import connected_components

SEED, BITS, MAX_DISTANCE = 42, 64, 4
CELL_ROWS = 4096
_U64 = np.uint64


def fingerprint(raw: bytes, shingle_words: int = 4) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; 0 if there is no word."""
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle_words + 1
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[shingle_words - 1 :].tolist())])
    ones = np.zeros(BITS, np.int64)
    table = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    for at in range(0, n, 65_536):
        ones += np.unpackbits(table[at : at + 65_536], axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(shingle_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            found = np.array([fingerprint(x, shingle_words) for x in as_bytes(batch.column(1))], _U64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["id", "fp"])

    return run


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4) -> DataFrame:
    """(id, fp): the fingerprint as a signed long. Null texts count as empty."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_fingerprints(shingle_words), "id long, fp long")


_PAIR = np.arange(1, 32)


def anchors(half: np.ndarray) -> np.ndarray:
    """For 31-bit words, the words of the Hamming code within distance 2: a row of 16, repeats where there are fewer."""
    bits = (half[:, None] >> np.arange(31)) & 1
    syndrome = np.bitwise_xor.reduce(np.where(bits > 0, _PAIR, 0), axis=1)
    out = np.empty((len(half), 16), np.int64)
    out[:, 0] = np.where(syndrome > 0, half ^ (1 << np.maximum(syndrome - 1, 0)), half)
    for s in np.unique(syndrome):
        rows = syndrome == s
        if s == 0:
            out[rows, 1:] = out[rows, :1]
        else:
            first = [i for i in range(1, 32) if i < i ^ s]  # pairs of places whose sum is s: two flips reach the code
            masks = np.array([1 << (i - 1) ^ 1 << ((i ^ s) - 1) for i in first if i ^ s], np.int64)
            out[rows, 1:] = half[rows, None] ^ masks
    return out


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy()
        for side in (0, 1):
            key = anchors((fps >> 32 * side) & 0x7FFFFFFF)
            real = np.ones(key.shape, bool)
            real[key[:, 1] == key[:, 0], 1:] = False
            yield pa.RecordBatch.from_arrays([pa.array(key[real] | side << 31), pa.array(np.broadcast_to(fps[:, None], key.shape)[real])], ["anchor", "fp"])


def _links(fps: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """A forest that links what is within the distance: each fingerprint is compared with those not reached yet."""
    left = np.unique(fps)
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count((left ^ x).view(_U64)) <= distance
            if near.any():
                found = left[near]
                left = left[~near]
                queue += list(found)
                yield from ((int(x), int(y)) for y in found)


def _compare(distance: int):
    """Rows come sorted by (anchor, lo, hi). Small groups are compared at once by shifting the columns."""

    def at_once(key: np.ndarray, fps: np.ndarray) -> list[np.ndarray]:
        start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
        size = np.diff(np.append(start, len(fps)))
        found = []
        small = np.repeat(size <= 24, size)
        group, own = np.repeat(np.arange(len(size)), size)[small], fps[small]
        for shift in range(1, 24):
            a, b = own[:-shift], own[shift:]
            hit = (group[:-shift] == group[shift:]) & (np.bitwise_count((a ^ b).view(_U64)) <= distance)
            found.append(np.stack([a[hit], b[hit]], axis=1))
            if not (group[:-shift] == group[shift:]).any():
                break
        for s, n in zip(start[size > 24], size[size > 24]):
            if pairs := list(_links(fps[s : s + n], distance)):
                found.append(np.array(pairs, np.int64))
        return found

    def emit(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        pairs = np.concatenate([np.zeros((0, 2), np.int64), *found])
        pairs = np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1), axis=0)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_key, rest_fp = np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
        for batch in batches:
            key = np.concatenate([rest_key, np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)])
            fps = np.concatenate([rest_fp, batch.column(3).to_numpy()])
            if not len(fps):
                continue
            last = np.flatnonzero((key != key[-1]).any(axis=1))
            cut = last[-1] + 1 if len(last) else 0  # the last group may go on in the next batch
            rest_key, rest_fp = key[cut:], fps[cut:]
            if cut:
                yield from emit(at_once(key[:cut], fps[:cut]))
        if len(rest_fp):
            yield from emit(at_once(rest_key, rest_fp))

    return run


def linked_fingerprints(fps: DataFrame, *, max_distance: int = MAX_DISTANCE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Edges (u, v) over distinct fingerprints ``fps`` (fp): a pair at ``max_distance`` or less is joined by a path of
    such edges. ``max_distance`` may be 0 to 5, what the anchors cover."""
    if not 0 <= max_distance <= 5:
        raise ValueError("the anchors cover distances 0 to 5")
    cells = fps.select("fp").repartition(parts(fps.sparkSession)).mapInArrow(_replicate, "anchor long, fp long")
    hot = cells.groupBy("anchor").count().filter(F.col("count") > cell_rows).select("anchor", F.ceil(F.col("count") / cell_rows).cast("long").alias("blocks"))
    hot = staged(hot, "hot-anchors")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    blocks = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi")))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1), lambda j: F.struct(F.least(mine, j).alias("lo"), F.greatest(mine, j).alias("hi"))))
    dealt = cells.join(hot, "anchor", "left").select("anchor", "fp", F.explode(blocks).alias("b")).select("anchor", "b.lo", "b.hi", "fp")
    dealt = dealt.repartition(parts(fps.sparkSession), "anchor", "lo", "hi").sortWithinPartitions("anchor", "lo", "hi")
    return dealt.mapInArrow(_compare(max_distance), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, max_distance: int = MAX_DISTANCE, cell_rows: int = CELL_ROWS, hot_share: int = 1000) -> DataFrame:
    """One row per row of ``docs``: (id, fingerprint as 16 hex digits, component_id: the smallest id that links reach).

    Null and empty texts have the fingerprint zero and are linked like any other. Rows that repeat get equal rows back.
    A null id is never the smallest; a component of null ids alone has a null component_id. An empty table gives an
    empty one.
    """
    own = staged(fingerprints(docs, id_col=id_col, text_col=text_col, shingle_words=shingle_words), "fingerprints")
    fps = staged(own.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    roots = connected_components(linked_fingerprints(fps, max_distance=max_distance, cell_rows=cell_rows))
    member = staged(fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "members")
    least = member.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    label = staged(join_counted(member, least, "root", member.count(), hot_share, by="members").select("fp", "n", "component_id"), "labels")
    out = join_counted(own, label, "fp", fps.agg(F.sum("n")).first()[0] or 0, hot_share)
    return out.select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

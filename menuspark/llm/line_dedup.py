"""Line deduplication with two Bloom filters.

1. Each task hashes its lines' keys and sends every hash it has once, with a mark if it had it in two documents, to the
   shard of the hash.
2. A shard adds the hashes to a filter of once-seen ones; a hash that this filter has already goes to a second filter, of
   twice-seen ones. A filter errs only by holding more, so no repeat is missed.
3. Only lines that the twice-seen filters hold are suspects. They are counted by task first and then shuffled with their
   full key: an exact confirmation, which also chooses the first occurrence.
4. The confirmed keys are taken from the documents: from a broadcast set if its counted size is within ``BROADCAST_BYTES``,
   else by a join of the suspects.

Hot lines cost a row per task, as both shuffles get each key once from a batch. No document's text is shuffled, except by
the join of step 4. There are as many shards as the counted hashes need. The broadcast filters stay within ``filter_bytes`` at every
size: they are folded in half until they fit. A folded filter still misses nothing, but holds more: within 64 MB about 0.05 % of
the other lines are suspects at 22 million repeated hashes, 2 % at 67 million, 15 % at 134 million.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import BROADCAST_BYTES, as_bytes, join_counted, parts, slices, staged

ONCE_BITS, TWICE_BITS, PROBES, SHARD_HASHES, MOST_FOLDS = 16, 24, 4, 4_000_000, 10
_U64 = np.uint64


def line_keys(raw: bytes) -> list[bytes]:
    """The keys of a text's lines: A-Z in lower case, ASCII white space stripped at both ends."""
    return [x.strip() for x in raw.lower().split(b"\n")]


def line_key(line: Column) -> Column:
    """The same as a column expression."""
    lower = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(lower, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")


class Bloom:
    """A Bloom filter over 64-bit hashes. Bits set are a superset of what was added: no false negatives."""

    def __init__(self, bits: int, data: bytes | None = None):
        self.bits = max(64, -(-bits // 8) * 8)
        self.data = np.zeros(self.bits // 8, np.uint8) if data is None else np.frombuffer(data, np.uint8)

    @staticmethod
    def positions(hashes: np.ndarray, bits) -> Iterator[np.ndarray]:
        step = (hashes >> _U64(33)) * _U64(0x9E3779B97F4A7C15) | _U64(1)
        at = hashes * _U64(0xD6E8FEB86659FD93)
        for _ in range(PROBES):
            at = at + step
            yield (at >> _U64(16)) % _U64(bits) if np.isscalar(bits) else (at >> _U64(16)) % bits

    def add(self, hashes: np.ndarray) -> None:
        for p in self.positions(hashes, self.bits):
            np.bitwise_or.at(self.data, (p >> _U64(3)).astype(np.int64), np.left_shift(1, (p & _U64(7)).astype(np.uint8), dtype=np.uint8))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for p in self.positions(hashes, self.bits):
            found &= (self.data[(p >> _U64(3)).astype(np.int64)] >> (p & _U64(7)).astype(np.uint8)) & 1 > 0
        return found


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([xxhash.xxh3_64_digest(k) for k in keys]), ">u8").astype(_U64)


def _long_enough(least: int) -> Callable[[bytes], bool]:
    return (lambda k: len(k) >= least) if least <= 1 else (lambda k: len(k) >= least and len(k.decode("utf-8", "replace")) >= least)


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> _U64(32)) * _U64(shards) >> _U64(32)).astype(np.int64)


def _pack(shards: int, least: int, twice_in_one: bool):
    """Step 1: (shard, hashes seen in one document, hashes seen in more), as packed 64-bit integers, for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enough = _long_enough(least)
        for batch in slices(batches, 4096):
            keys: list[bytes] = []
            for raw in as_bytes(batch.column(0)):
                own = line_keys(raw)
                keys += filter(enough, own if twice_in_one else set(own))
            if not keys:
                continue
            values, counts = np.unique(_hashes(keys), return_counts=True)
            shard = _shard(values, shards)
            at = np.flatnonzero(np.diff(shard, prepend=-1))
            out = [(int(shard[a]), values[a:b][counts[a:b] == 1].tobytes(), values[a:b][counts[a:b] > 1].tobytes()) for a, b in zip(at, [*at[1:], len(shard)])]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary()))], ["shard", "once", "twice"])

    return run


def _split(shards: int):
    """The same rows for a multiple of the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for once, twice in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                a, b = np.frombuffer(once, _U64), np.frombuffer(twice, _U64)
                x, y = _shard(a, shards), _shard(b, shards)
                own = np.unique(np.concatenate([x, y]))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([a[x == s].tobytes() for s in own], pa.binary()), pa.array([b[y == s].tobytes() for s in own], pa.binary())], ["shard", "once", "twice"])

    return run


def _fold(folds: int):
    """Filters of 2**-folds the size: bits that meet are joined. A place is its hash modulo the size, so it stays right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.bitwise_or.reduce(np.frombuffer(x, np.uint8).reshape(1 << folds, -1), axis=0).tobytes() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([8 * len(x) for x in data], pa.int64()), pa.array(data, pa.binary())], ["shard", "bits", "data"])

    return run


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2. The rows come sorted by shard; the first of a shard says how many hashes are to come."""
    shard, once, found = None, None, []

    def done():
        values = np.unique(np.concatenate(found)) if found else np.zeros(0, _U64)
        unit = 8 << MOST_FOLDS
        twice = Bloom(max(1, -(-TWICE_BITS * len(values) // unit)) * unit)
        twice.add(values)
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([twice.bits], pa.int64()), pa.array([twice.data.tobytes()], pa.binary())], ["shard", "bits", "data"])

    for batch in batches:
        for s, n, a, b in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if s != shard:
                if shard is not None:
                    yield done()
                shard, once, found = s, Bloom(ONCE_BITS * n), []
            one, more = np.frombuffer(a, _U64), np.frombuffer(b, _U64)
            found += [one[once.has(one)], more]
            once.add(one)
            once.add(more)
    if shard is not None:
        yield done()


class _Suspects:
    """The twice-seen filters of all shards."""

    def __init__(self, shards: int, rows: list):
        self.shards, self.bits, self.start = shards, np.full(shards, 8, _U64), np.zeros(shards, np.int64)
        blocks, at = [np.zeros(1, np.uint8)], 1
        for r in sorted(rows, key=lambda r: r["shard"]):
            self.bits[r["shard"]], self.start[r["shard"]] = r["bits"], at
            blocks.append(np.frombuffer(r["data"], np.uint8))
            at += len(blocks[-1])
        self.data = np.concatenate(blocks)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        shard = _shard(hashes, self.shards)
        bits, start, found = self.bits[shard], self.start[shard], np.ones(len(hashes), bool)
        for p in Bloom.positions(hashes, bits):
            found &= (self.data[start + (p >> _U64(3)).astype(np.int64)] >> (p & _U64(7)).astype(np.uint8)) & 1 > 0
        return found


def _count(least: int, filters, first: bool):
    """Step 3, before its shuffle: (key, documents, first document and line) of the suspects in each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enough = _long_enough(least)
        for batch in slices(batches, 4096):
            n: dict[bytes, int] = {}
            at: dict[bytes, tuple] = {}
            ids = batch.column(1).to_pylist()
            for doc, raw in zip(ids, as_bytes(batch.column(0))):
                own = line_keys(raw)
                for k in filter(enough, set(own)):
                    n[k] = n.get(k, 0) + 1
                if first:
                    for i, k in enumerate(own):
                        if enough(k) and (k not in at or (doc is not None and (at[k][0] is None or (doc, i) < at[k]))):
                            at[k] = (doc, i)
            keys = list(n)
            if not keys:
                continue
            keys = [k for k, s in zip(keys, filters.value.has(_hashes(keys))) if s]
            where = [at.get(k, (None, None)) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([n[k] for k in keys], pa.int64()), pa.array([w[0] for w in where], pa.int64()), pa.array([w[1] for w in where], pa.int32())], ["key", "n_docs", "first_doc", "first_line"])

    return run


def line_filters(docs: DataFrame, *, text_col: str = "text", min_docs: int = 2, min_code_points: int = 1, filter_bytes: int = BROADCAST_BYTES):
    """Steps 1 and 2: the broadcast twice-seen filters of the lines of ``docs``."""
    spark = docs.sparkSession
    shards = max(parts(spark), 1)
    text = docs.select(F.col(text_col).cast("string").alias("text"))
    packed = text.mapInArrow(_pack(shards, min_code_points, min_docs < 2), "shard int, once binary, twice binary")
    packed = staged(packed, "line-hashes")
    hashes = F.sum(F.expr("(length(once) + length(twice)) div 8"))
    most = packed.groupBy("shard").agg(hashes.alias("n")).agg(F.max("n")).first()[0] or 0
    if most > SHARD_HASHES:
        shards *= -(-most // SHARD_HASHES)
        packed = packed.mapInArrow(_split(shards), packed.schema)
    size = packed.groupBy("shard").agg(hashes.alias("n"))
    by_shard = packed.join(F.broadcast(size), "shard").select("shard", "n", "once", "twice").repartition(shards, "shard").sortWithinPartitions("shard")
    table = staged(by_shard.mapInArrow(_filters, "shard int, bits long, data binary"), "line-filters")
    total, folds = table.agg(F.sum("bits")).first()[0] or 0, 0
    while total >> folds > 8 * filter_bytes and folds < MOST_FOLDS:
        folds += 1
    return spark.sparkContext.broadcast(_Suspects(shards, (table.mapInArrow(_fold(folds), table.schema) if folds else table).collect()))


def repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, min_code_points: int = 1, first: bool = False, filter_bytes: int = BROADCAST_BYTES, filters=None) -> DataFrame:
    """Keys found in at least ``min_docs`` rows of ``docs``: (key binary, n_docs, first_doc, first_line).

    Each row counts as a document, also if rows or ids repeat or are null. The last two columns are null unless ``first``.
    ``filters``: those of ``line_filters``, if they are there already.
    """
    filters = filters or line_filters(docs, text_col=text_col, min_docs=min_docs, min_code_points=min_code_points, filter_bytes=filter_bytes)
    suspects = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("id")).mapInArrow(_count(min_code_points, filters, first), "key binary, n_docs long, first_doc long, first_line int")
    place = F.min(F.when(F.col("first_line").isNotNull(), F.struct(F.col("first_doc").isNull().alias("none"), "first_doc", "first_line")))
    return suspects.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), place.alias("at")).filter(F.col("n_docs") >= min_docs).select("key", "n_docs", "at.first_doc", "at.first_line")


def _apply(dropped, names: list[str], keep_first: bool):
    """Step 4. ``dropped``: the broadcast set; None if the third column has each row's own keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            lines, gone, kept = [], [], []
            ids, rest = batch.column(0).to_pylist(), 2 + (dropped is None)
            own_drops = batch.column(2).to_pylist() if dropped is None else None
            for n, (doc, raw) in enumerate(zip(ids, as_bytes(batch.column(1)))):
                drop = {d["key"]: (d["first_doc"], d["first_line"]) for d in own_drops[n] or ()} if dropped is None else dropped.value
                keys = line_keys(raw)
                if keep_first:
                    out = [i for i, k in enumerate(keys) if k in drop and drop[k] != (doc, i)]
                else:
                    out = [i for i, k in enumerate(keys) if k in drop]
                lines.append(len(keys))
                gone.append(len(out))
                if out:
                    own, away = raw.split(b"\n"), set(out)
                    raw = b"\n".join([x for i, x in enumerate(own) if i not in away])
                kept.append(raw)
            yield pa.RecordBatch.from_arrays([*batch.columns[rest:], pa.array(lines, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names)

    return run


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, min_code_points: int = 1, keep: str = "none", filter_bytes: int = BROADCAST_BYTES, set_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with line_stats = struct(n_lines, n_dropped, kept): the text without the lines whose key is in at least
    ``min_docs`` rows.

    ``keep``: "none" drops them everywhere; "first" leaves each its occurrence with the smallest (id, line). A null or
    empty text is one empty line; keys under ``min_code_points`` are never dropped; a text may lose all its lines and
    is then empty. Equal rows get equal results (with "first", all rows of the smallest id keep the line; a null id
    comes last). All columns of ``docs`` stay, whatever their names; an own column line_stats is replaced.
    """
    first = keep == "first"
    filters = line_filters(docs, text_col=text_col, min_docs=min_docs, min_code_points=min_code_points, filter_bytes=filter_bytes)
    found = staged(repeated_lines(docs, id_col=id_col, text_col=text_col, min_docs=min_docs, min_code_points=min_code_points, first=first, filters=filters), "line-repeats")
    rest = [c for c in docs.columns if c != "line_stats"]
    row = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.struct(*[docs[c] for c in rest]).alias("row"))
    schema = T.StructType([row.schema["row"], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())])
    n, size, rows = found.agg(F.count("*"), F.coalesce(F.sum(F.length("key")), F.lit(0)), F.coalesce(F.sum("n_docs"), F.lit(0))).first()
    if size + 100 * n <= set_bytes:
        drop = {bytes(r["key"]): (r["first_doc"], r["first_line"]) for r in found.collect()}
        out = row.mapInArrow(_apply(docs.sparkSession.sparkContext.broadcast(drop), schema.names, first), schema)
    else:
        out = _with_drops(row, found, filters, rows).mapInArrow(_apply(None, schema.names, first), schema)
    return out.select("row.*", F.struct("n_lines", "n_dropped", "kept").alias("line_stats"))


def _suspect_rows(filters):
    """(id, hash, key) of each row's suspects, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            keys, at = [], []
            for n, raw in enumerate(as_bytes(batch.column(2))):
                own = list(set(line_keys(raw)))
                keys += (found := [k for k, s in zip(own, filters.value.has(_hashes(own))) if s])
                at += [n] * len(found)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(keys, pa.binary())], ["id", "hash", "key"])

    return run


def _with_drops(row: DataFrame, found: DataFrame, filters, rows: int) -> DataFrame:
    """(id, text, drops, row) for any number of confirmed keys: the suspects of each row meet them by key, ``rows`` times in all, and
    rows get their keys back by id and text hash. Keys with over a thousandth of the meetings are fewer than a thousand and are
    broadcast; so none is a hot key of the join."""
    hashed = row.withColumn("hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    keyed = hashed.select("id", "hash", "text").mapInArrow(_suspect_rows(filters), "id long, hash long, key binary")
    met = join_counted(keyed, found.withColumnRenamed("n_docs", "n"), "key", rows)
    mine = met.groupBy(F.col("id").alias("its_id"), F.col("hash").alias("its_hash")).agg(F.collect_set(F.struct("key", "first_doc", "first_line")).alias("drops"))
    both = hashed.join(mine, F.col("id").eqNullSafe(F.col("its_id")) & (F.col("hash") == F.col("its_hash")), "left")
    return both.select("id", "text", "drops", "row")


def sha256_text(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


__all__ = ["Bloom", "dedup_lines", "line_filters", "line_key", "line_keys", "repeated_lines", "sha256_text"]

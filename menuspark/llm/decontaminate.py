"""Benchmark decontamination by the q-gram lemma.

A passage that aligns with a benchmark window of m bytes within e edits shares at least m + 1 - q - q*e of its q-grams with
it, on diagonals (place in the document less place in the item) that lie within e of each other. So:

1. a window starts at each byte of the benchmark's items; an index has all q-grams of the items with their places;
2. every q-gram of a whole document is looked up; hits are counted by item, window and diagonal band. Bands start every
   ``STEP`` diagonals and are e wider, so all hits of one passage are in one band;
3. bands that reach the bound are verified by a banded alignment of the window against that region of the document.

The lookup loses nothing within the edit budget: every passage of ``WINDOW`` (100) bytes or more of an item is found, wherever
it begins, and items of ``Q`` to ``WINDOW`` bytes are found whole. Shorter passages of longer items are no leaks. Documents are only mapped: no shuffle but of the verified hits.
The index, some 30 bytes for each of the benchmark, is broadcast; a benchmark of more than ``block_bytes`` goes over the documents in
blocks of items, one after another.

Repetition doesn't multiply. Long items are indexed as units of ``UNIT`` windows, equal ones once. Where the q-grams of a batch would
meet over ``MOST_HITS`` places, the batch is halved; a single text is cut into segments that overlap by a window and its edits, of which equal ones are
searched once (a megabyte of one letter or of a short phrase has a few distinct ones); then the units are halved. What is found is the same.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import BROADCAST_BYTES, slices, staged

Q, WINDOW, EDIT_SHARE, STEP = 10, 100, 0.08, 16
BLOCK_BYTES, BATCH_BYTES, LEAST_BITS = BROADCAST_BYTES // 32, 1 << 20, 21
UNIT, SEGMENT, MOST_HITS = 1024, 1024, 1_000_000
_U64 = np.uint64
_SPACED = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def normal(text: str | None) -> bytes:
    """Lower case; ASCII characters other than letters and digits are spaces; single spaces between words."""
    return b" ".join((text or "").lower().encode("utf-8", "replace").translate(_SPACED).split())


def budget(m: int) -> int:
    """The edits allowed for a window of m bytes: ``EDIT_SHARE`` of it, but fewer if the lemma's bound would be under 1."""
    return max(0, min(int(EDIT_SHARE * m), (m - Q) // Q))


def windows(size: int) -> list[tuple[int, int]]:
    """(start, length) of an item's windows: one at each byte that has WINDOW bytes from it. So every passage of WINDOW bytes is
    one. An item shorter than a window is one; under Q bytes, none."""
    if size < Q:
        return []
    if size <= WINDOW:
        return [(0, size)]
    return [(s, WINDOW) for s in range(size - WINDOW + 1)]


def grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q bytes at each place; ``data`` ends with Q bytes of padding."""
    n = len(data) - Q
    eight = np.empty(-(-(n + Q - 8) // 8) * 8, _U64)
    padded = np.concatenate([data, np.zeros(24, np.uint8)])
    for shift in range(8):
        eight[shift::8] = padded[shift : shift + len(eight)].view("<u8")
    return eight[:n] * _U64(0x9E3779B97F4A7C15) + eight[Q - 8 : Q - 8 + n] * _U64(0xC2B2AE3D27D4EB4F)


@dataclass
class Index:
    ids: list  # of items
    owners: list[list[tuple[int, int]]]  # of each unit, the items that hold it and where
    texts: list[bytes]  # of items
    units: list[bytes]
    size: np.ndarray  # of each unit: its windows' length, edits allowed and q-grams needed
    edits: np.ndarray
    least: np.ndarray
    keys: np.ndarray  # distinct q-gram hashes, sorted
    first: np.ndarray  # of each, where its places begin
    item: np.ndarray  # of each place, its unit
    place: np.ndarray
    window_at: np.ndarray  # of each unit, its first window
    bitmap: np.ndarray  # of the hashes' top bits
    shift: np.uint64


def build(items: list[tuple[object, str | None]]) -> Index:
    ids, texts, found = [i for i, _ in items], [normal(t) for _, t in items], {}
    for number, whole in enumerate(texts):
        if len(whole) < UNIT + WINDOW:
            found.setdefault(whole, []).append((number, 0))
        else:  # each window is in one unit
            for at in range(0, len(whole) - WINDOW + 1, UNIT):
                found.setdefault(whole[at : at + UNIT + WINDOW - 1], []).append((number, at))
    units, owners = list(found), list(found.values())
    size = np.array([min(len(t), WINDOW) for t in units], np.int64)
    edits = np.array([budget(int(m)) for m in size], np.int64)
    hashes, item, place = [np.zeros(0, _U64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for j, t in enumerate(units):
        if len(t) >= Q:
            h = grams(np.frombuffer(t + bytes(Q), np.uint8))[: len(t) - Q + 1]
            hashes.append(h)
            item.append(np.full(len(h), j, np.int32))
            place.append(np.arange(len(h), dtype=np.int32))
    h, j, p = np.concatenate(hashes), np.concatenate(item), np.concatenate(place)
    order = np.lexsort((p, j, h))
    h, j, p = h[order], j[order], p[order]
    keys, first = np.unique(h, return_index=True)
    bits = max(LEAST_BITS, (4 * len(keys)).bit_length())
    shift, bitmap = _U64(64 - bits), np.zeros(1 << bits, bool)
    bitmap[(keys >> shift).astype(np.int64)] = True
    window_at = np.cumsum([0, *(0 if len(t) < Q else max(1, len(t) - WINDOW + 1) for t in units)])
    return Index(ids, owners, texts, units, size, edits, size + 1 - Q - Q * edits, keys, np.append(first, len(h)).astype(np.int32), j, p, window_at, bitmap, shift)


def _ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Repeats of 0..n-1 by count, and first[i] + 0..count[i]-1 beside them."""
    which = np.repeat(np.arange(len(count)), count)
    inner = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    return which, np.repeat(first, count) + inner


def align(pattern: list[bytes], region: list[bytes], width: int, most: np.ndarray) -> np.ndarray:
    """The fewest edits between each whole pattern and any part of its region, over ``width`` diagonals: pattern byte i
    meets region byte i + k, 0 <= k < width. All pairs go through the rows together; a pair leaves once all its edits are
    over its ``most``, as they never fall, and gets more than that."""
    sizes = np.array([len(p) for p in pattern])
    rows = int(sizes.max(initial=0))
    p = np.frombuffer(b"".join([x.ljust(rows, b"\0") for x in pattern]), np.uint8).reshape(len(pattern), rows)
    t = np.frombuffer(b"".join([x[: rows + width].ljust(rows + width, b"\1") for x in region]), np.uint8).reshape(len(pattern), rows + width)
    k = np.arange(width, dtype=np.int16)
    now = np.zeros((len(pattern), width), np.int16)
    best = np.where(sizes == 0, 0, rows + 1)
    pair = np.arange(len(pattern))
    for i in range(rows):
        change = now + (t[:, i : i + width] != p[:, i : i + 1])
        change[:, :-1] = np.minimum(change[:, :-1], now[:, 1:] + 1)
        now = np.minimum.accumulate(change - k, axis=1) + k
        done = sizes[pair] == i + 1
        if done.any():
            best[pair[done]] = now[done].min(axis=1)
        if i % 4 == 3:
            stay = (now.min(axis=1) <= most[pair]) & (sizes[pair] > i + 1)
            if stay.sum() < 0.8 * len(pair):
                p, t, now, pair = p[stay], t[stay], now[stay], pair[stay]
                if not len(pair):
                    break
    return best


def _segments(text: bytes, overlap: int) -> list[bytes]:
    """Pieces of a text in which every passage of ``overlap`` bytes is whole, without repeats."""
    return list(dict.fromkeys(text[at : at + SEGMENT + overlap] for at in range(0, max(1, len(text) - overlap), SEGMENT)))


def find_units(index: Index, texts: list[bytes]) -> dict[tuple[int, int, int], int]:
    """(text's number, unit's number, start in the unit) of each window that a text holds, with its edits; texts as ``normal`` gives
    them."""
    if not len(index.keys):
        return {}
    overlap = WINDOW + 2 * int(index.edits.max()) + Q
    found: dict[tuple[int, int, int], int] = {}
    todo = [([(n, t) for n, t in enumerate(texts)], 0, len(index.units))]
    while todo:
        own, low, high = todo.pop()
        one = own[0][1]
        smallest = len(own) == 1 and len(one) <= 2 * SEGMENT + overlap
        got = _find(index, [t for _, t in own], low, high, math.inf if smallest and high - low == 1 else MOST_HITS)
        if got is not None:
            for n, unit, start, e in got:
                key = own[n][0], unit, start
                found[key] = min(e, found.get(key, e))
        elif len(own) > 1:
            todo += [(own[: len(own) // 2], low, high), (own[len(own) // 2 :], low, high)]
        elif not smallest:
            todo.append(([(own[0][0], part) for part in _segments(one, overlap)], low, high))
        else:
            todo += [(own, low, (low + high) // 2), (own, (low + high) // 2, high)]
    return found


def find(index: Index, texts: list[bytes]) -> list[tuple[int, int, int, int]]:
    """(text's number, item's number, start in the item, edits) of each window that a text holds."""
    return [(n, item, at + start, e) for (n, unit, start), e in find_units(index, texts).items() for item, at in index.owners[unit]]


def _find(index: Index, texts: list[bytes], low: int, high: int, most_hits: float) -> list[tuple[int, int, int, int]] | None:
    """(text's number, unit's number, start in the unit, edits) for the units from ``low`` to ``high``; None if q-grams meet more than
    ``most_hits`` places."""
    gap = bytes(Q)
    data = np.frombuffer(gap.join(texts) + gap, np.uint8)
    begin = np.cumsum([0, *(len(t) + Q for t in texts)])
    h = grams(data)
    maybe = np.flatnonzero(index.bitmap[(h >> index.shift).astype(np.int64)])
    at = np.minimum(np.searchsorted(index.keys, h[maybe]), len(index.keys) - 1)
    hit = index.keys[at] == h[maybe]
    where, at = maybe[hit], at[hit]
    first, last = index.first[at].astype(np.int64), index.first[at + 1].astype(np.int64)
    if (low, high) != (0, len(index.units)) and len(at):  # a q-gram's places are sorted by unit
        grams_here, back = np.unique(at, return_inverse=True)
        cut = [[a + np.searchsorted(index.item[a:b], edge) for a, b in zip(index.first[grams_here].tolist(), index.first[grams_here + 1].tolist())] for edge in (low, high)]
        first, last = (np.array(x, np.int64)[back] for x in cut)
    if int((last - first).sum()) > most_hits:
        return None
    which, post = _ranges(first, last - first)
    where, item, place = where[which], index.item[post], index.place[post]
    # Places count from the beginning of the hit's own text, so what is found doesn't depend on the batch. The shift is the
    # longest unit's length and more, so diagonals are never negative.
    text = np.searchsorted(begin, where, side="right") - 1
    shift = WINDOW + max(map(len, index.units))
    diagonal = where - begin[text] - place + shift
    bands = (max(map(len, texts)) + shift) // STEP + 2
    # A band without enough hits of its item can't have enough of a window.
    coarse = (text * len(index.units) + item) * bands + diagonal // STEP
    for _ in range(2):
        near, count = np.unique(coarse, return_counts=True)
        total = count.copy()
        for d in (-1, 1):
            pos = np.minimum(np.searchsorted(near, near + d), len(near) - 1)
            total += np.where(near[pos] == near + d, count[pos], 0)
        keep = total[np.searchsorted(near, coarse)] >= index.least[item]
        if keep.all():
            break
        text, item, place, diagonal, coarse = text[keep], item[keep], place[keep], diagonal[keep], coarse[keep]
    if not len(item):
        return []
    # Each hit counts for the windows of its item that hold its q-gram, in the band of its diagonal and the one before. These
    # windows are a range; so counts change at the ranges' ends only, and are added up along the windows.
    begins = index.window_at[item] + np.maximum(place - (index.size[item] - Q), 0)
    ends = np.minimum(index.window_at[item] + place + 1, index.window_at[item + 1])
    band, windows_all = diagonal // STEP, int(index.window_at[-1]) + 1
    also = diagonal - (band - 1) * STEP <= STEP + index.edits[item]
    row, place = (text * bands + band), place + np.cumsum([0, *map(len, index.units)])[item]
    row, begins, ends, place = (np.concatenate([x, x[also] - less]) for x, less in ((row, 1), (begins, 0), (ends, 0), (place, 0)))
    # The lemma speaks of the window's q-grams: one that meets several in the document counts once in a band.
    once = np.unique(row * sum(map(len, index.units)) + place, return_index=True)[1]
    row, begins, ends = row[once] * windows_all, begins[once], ends[once]
    key, back = np.unique(np.concatenate([row + begins, row + ends]), return_inverse=True)
    count = np.cumsum(np.bincount(back[: len(row)], minlength=len(key)) - np.bincount(back[len(row) :], minlength=len(key)))
    held = np.flatnonzero(count > 0)
    item = np.searchsorted(index.window_at, key[held] % windows_all, side="right") - 1
    enough = count[held] >= index.least[item]
    held, item = held[enough], item[enough]
    which, key = _ranges(key[held], key[held + 1] - key[held])
    item, owner, band = item[which], key // windows_all // bands, key // windows_all % bands
    start = key % windows_all - index.window_at[item]
    if not len(item):
        return []
    most = int(index.edits.max())
    width = STEP + 3 * most + 1
    low = begin[owner] + band * STEP - shift + start - most  # where the region begins
    # A window that the text holds as it is needs no bands. Repetition gives the same window and region again and again: each such pair is
    # aligned once.
    triple = (owner * len(index.units) + item) * int(np.diff(index.window_at).max()) + start
    _, where, back = np.unique(triple, return_index=True, return_inverse=True)
    held, exact = {}, np.zeros(len(where), bool)
    for k, (o, j, s) in enumerate(zip(*(x[where].tolist() for x in (owner, item, start)))):
        own = o, index.units[j][s : s + int(index.size[j])]
        if own not in held:
            held[own] = own[1] in texts[o]
        exact[k] = held[own]
    found = dict.fromkeys(zip(*(x[where[exact]].tolist() for x in (owner, item, start))), 0)
    rest = np.flatnonzero(~exact[back])
    for at in range(0, len(rest), 1 << 14):
        own_rest = rest[at : at + (1 << 14)]
        asked: dict[tuple[bytes, bytes, int], list[tuple[int, int, int]]] = {}
        for o, j, s, a in zip(*(x[own_rest].tolist() for x in (owner, item, start, low))):
            own = index.units[j][s : s + int(index.size[j])]
            first, b = int(begin[o]), a + len(own) + width
            region = b"\1" * max(0, min(first - a, b - a)) + texts[o][max(a - first, 0) : max(b - first, 0)]
            asked.setdefault((own, region, int(index.edits[j])), []).append((o, j, s))
        pairs = list(asked)
        for k in range(0, len(pairs), 1024):
            part = pairs[k : k + 1024]
            for pair, e in zip(part, align([x[0] for x in part], [x[1] for x in part], width, np.array([x[2] for x in part])).tolist()):
                if e <= pair[2]:
                    for triple_found in asked[pair]:
                        found[triple_found] = min(e, found.get(triple_found, e))
    return [(*triple_found, e) for triple_found, e in found.items()]


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        holders = [Counter(item for item, _ in x) for x in index.owners]
        for batch in slices(batches, 2048):
            ids, texts, at = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            out: dict[tuple[int, int], tuple[int, int]] = {}
            while at < len(texts):
                end, size, own = at, 0, []
                while end < len(texts) and (end == at or size < BATCH_BYTES):
                    own.append(normal(texts[end]))
                    size += len(own[-1])
                    end += 1
                by_unit: dict[tuple[int, int], tuple[int, int]] = {}
                for (n, unit, _), edits in find_units(index, own).items():
                    fewest, windows = by_unit.get((n, unit), (edits, 0))
                    by_unit[n, unit] = min(fewest, edits), windows + 1
                for (n, unit), (edits, starts) in by_unit.items():
                    for item, times in holders[unit].items():
                        fewest, windows = out.get((at + n, item), (edits, 0))
                        out[at + n, item] = min(fewest, edits), windows + times * starts
                at = end
            rows = [(ids[n], n, item, e, windows) for (n, item), (e, windows) in sorted(out.items())]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([index.ids[r[2]] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int32()), pa.array([r[4] for r in rows], pa.int32())], ["id", "item_id", "edits", "windows"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, item_id, edits, windows) for each document row and benchmark item of which it holds a window within the edit
    budget: the fewest edits, and how many windows. Null and empty texts hold nothing; items under ``Q`` bytes once
    normalised are in nothing; rows that repeat give rows that repeat; null ids stay null."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for b in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).orderBy("item", "text").collect()
        shared = spark.sparkContext.broadcast(build([tuple(r) for r in own]))
        part = rows.mapInArrow(_search(shared), "id long, item_id long, edits int, windows int")
        if blocks > 1:  # then one index is held at a time
            part = staged(part, "leaks")
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **more) -> DataFrame:
    """``docs`` without the rows whose id holds a benchmark window. Rows with a null id stay. The ids are staged first: then
    Spark knows their size and shuffles the texts only if there are too many to broadcast."""
    ids = staged(contaminated(docs, benchmark, id_col=id_col, **more).select(F.col("id").alias("__leaked_id")).distinct(), "leaks")
    return docs.join(ids, docs[id_col] == ids["__leaked_id"], "left_anti")

"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

A model file gives the pieces. Its scores are taken as they are for a unigram model; a BPE model's scores are merge ranks
and no log probabilities, so there the k-th best piece gets Zipf's log score, -ln(k) less a constant ("zipf").

Spaces become the marker U+2581, with one before the text. No piece has a marker after another character, and none has a
newline (``Pieces`` looks), so the best path of a text is the best paths of its words, one after another: each distinct
word of a batch is searched once, all words of a length together by numpy, with the trie's steps as array lookups. A word
over ``LONG`` bytes, as a line is in scripts without spaces, is first cut wherever no piece reaches across, again by numpy for all
starts at once; a part that is still longer is searched alone, in linear time. A character that no piece covers costs the lowest score less 10 and
is written as its bytes. Decoding joins the pieces and bytes, turns markers into spaces and takes the first one away.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import as_bytes, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁".encode()
LONG, UNKNOWN_COST, CACHE_BYTES, WORD_BYTES, BATCH_BYTES, CUT_BYTES = 64, 10.0, 24 << 20, 150, 2 << 20, 1 << 20


class DoubleArray:
    """A trie of byte strings in two arrays: from node s by byte c to t = base[s] + c, if check[t] == s. value[t] is the
    key's number, or -1 where no key ends."""

    def __init__(self, keys: list[bytes]):
        order = sorted(range(len(keys)), key=keys.__getitem__)
        base, check, value = [0], [0], [-1]
        todo, free, wide = [(0, 0, len(order), 0)], 1, 1
        while todo:
            node, lo, hi, depth = todo.pop()
            while lo < hi and len(keys[order[lo]]) == depth:
                value[node] = order[lo]
                lo += 1
            if lo == hi:
                continue
            children: dict[int, list[int]] = {}
            for i in range(lo, hi):
                children.setdefault(keys[order[i]][depth], [i, i])[1] = i + 1
            codes = list(children)
            # One child goes to the first free place; several look on from where several last found room.
            if len(codes) == 1:
                while free < len(check) and (check[free] >= 0 or free <= codes[0]):
                    free += 1
                at = max(free, codes[0] + 1) - codes[0]
            else:
                at = max(1, wide - codes[0])
            while any(at + c < len(check) and check[at + c] >= 0 for c in codes):
                at += 1
            if len(codes) > 1:
                wide = max(wide, at + codes[0] - 64)
            if (more := at + codes[-1] + 1 - len(check)) > 0:
                base += [0] * more
                check += [-1] * more
                value += [-1] * more
            base[node] = at
            for c in codes:
                check[at + c] = node
            todo += [(at + c, a, b, depth + 1) for c, (a, b) in children.items()]
        self.base, self.check, self.value = (np.array(x + [y] * 256, np.int32) for x, y in ((base, 0), (check, -1), (value, -1)))


class Pieces:
    """A model: pieces, log scores, trie."""

    def __init__(self, pieces: list[bytes], ids: list[int], scores: list[float], byte_ids: list[int], table: list[bytes], prefix: bool = True):
        self.trie = DoubleArray(pieces)
        self.ids, self.scores = np.array(ids, np.int32), np.array(scores, np.float64)
        self.byte_ids, self.table, self.prefix = np.array(byte_ids, np.int32), table, prefix
        self.longest = max(map(len, pieces), default=1)
        self.unknown = float(min(scores, default=0.0)) - UNKNOWN_COST
        if any(MARK in _after_marks(p) for p in pieces):
            words = rb"[\s\S]+"  # pieces cross words: a text is one word
        elif any(b"\n" in p for p in pieces):
            words = rb" +[^ ]*|[^ ]+"
        else:
            words = rb" +[^ \n]*|[^ \n]+|\n"
        self.words = re.compile(words)
        self.cache: dict[bytes, bytes] = {}
        self.held = 0  # bytes of the cache, with ``WORD_BYTES`` for each entry's own
        self.lists: tuple | None = None

    def __getstate__(self):
        return self.__dict__ | {"cache": {}, "held": 0, "lists": None}

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The piece ids of each text (UTF-8)."""
        split = [self.words.findall(self.spaced(t)) for t in texts]
        if self.held > CACHE_BYTES:
            self.cache, self.held = {}, 0
        missing = {w: w.replace(b" ", MARK) for w in set().union(*split) - self.cache.keys()}
        long = [w for w, m in missing.items() if len(m) > LONG]
        parts = {w: self._cut(missing.pop(w)) for w in long}
        missing |= {p: p for p in set().union(*parts.values()) - self.cache.keys()}
        order = sorted(missing, key=lambda w: len(missing[w]))
        for at in range(0, len(order), 65_536):
            own = order[at : at + 65_536]
            found = self._search([missing[w] for w in own])
            self.cache |= zip(own, found)
            self.held += sum(map(len, own)) + sum(map(len, found)) + WORD_BYTES * len(own)
        cache = self.cache
        if not parts:
            return [np.frombuffer(b"".join([cache[w] for w in own]), np.int32) for own in split]
        long = {w: b"".join([cache[p] for p in own]) for w, own in parts.items()}
        return [np.frombuffer(b"".join([long[w] if w in long else cache[w] for w in own]), np.int32) for own in split]

    def _cut(self, word: bytes) -> list[bytes]:
        """The word's parts between places that no piece and no character reaches across: the best path of the word is the best
        paths of these."""
        data, size = np.frombuffer(word, np.uint8), len(word)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        ends, far = [], 0
        for low in range(0, size, CUT_BYTES):
            high = min(low + CUT_BYTES, size)
            codes = data[low : min(high + self.longest, size)].astype(np.int32)
            own = codes[: high - low]
            rows = np.flatnonzero(own & 0xC0 != 0x80)
            lead = own[rows]
            reach = np.zeros(len(own), np.int64)
            reach[rows] = np.minimum(rows + np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4))), size - low)
            node = np.zeros(len(rows), np.int32)
            for j in range(self.longest):
                inside = rows + j < len(codes)
                rows, node = rows[inside], node[inside]
                to = base[node] + codes[rows + j]
                ok = check[to] == node
                rows, node = rows[ok], to[ok]
                if not len(rows):
                    break
                whole = rows[value[node] >= 0]
                reach[whole] = np.maximum(reach[whole], whole + j + 1)
            furthest = np.maximum(np.maximum.accumulate(reach) + low, far)
            far = int(furthest[-1])
            place = np.arange(low + 1, high + 1)
            ends += place[furthest <= place].tolist()
        return [word[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def spaced(self, text: bytes) -> bytes:
        """With the space before it; a marker in the text itself is a space as well."""
        return (b" " if self.prefix and text else b"") + text.replace(MARK, b" ")

    def decode(self, ids) -> bytes:
        text = b"".join([self.table[i] for i in ids]).replace(MARK, b" ")
        return text[1:] if self.prefix and text.startswith(b" ") else text

    def _search(self, words: list[bytes]) -> list[bytes]:
        """The ids, as bytes, of words that are sorted by length."""
        sizes = np.array([len(w) for w in words])
        found: list[bytes] = []
        for size in np.unique(sizes):
            own = words[np.searchsorted(sizes, size) : np.searchsorted(sizes, size, side="right")]
            if size > LONG:
                found += [self.one(w).tobytes() for w in own]
            else:
                found += self._together(np.frombuffer(b"".join(own), np.uint8).reshape(len(own), size))
        return found

    def _together(self, text: np.ndarray) -> list[bytes]:
        """Viterbi over words of one length, each a row of bytes."""
        n, size = text.shape
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        best = np.full((size + 1, n), -np.inf)
        best[0] = 0
        back, piece = np.zeros((size + 1, n), np.int16), np.full((size + 1, n), -1, np.int32)
        columns = np.ascontiguousarray(text.T).astype(np.int32)
        starts = columns & 0xC0 != 0x80
        width = np.where(columns < 0x80, 1, np.where(columns < 0xE0, 2, np.where(columns < 0xF0, 3, 4)))
        for i in range(size):
            rows = np.flatnonzero(starts[i])
            if not len(rows):
                continue
            unknown = rows
            length = np.minimum(width[i, rows], size - i)
            single = np.zeros(n, bool)
            node, score = np.zeros(len(rows), np.int32), best[i, rows]
            for j in range(i, min(i + self.longest, size)):
                to = base[node] + columns[j, rows]
                ok = check[to] == node
                if not ok.any():
                    break
                rows, node, score = rows[ok], to[ok], score[ok]
                number = value[node]
                ends = number >= 0
                at, number = rows[ends], number[ends]
                if not len(at):
                    continue
                total = score[ends] + self.scores[number]
                single[at[width[i, at] == j + 1 - i]] = True
                better = total > best[j + 1, at]
                at = at[better]
                best[j + 1, at], back[j + 1, at], piece[j + 1, at] = total[better], i, number[better]
            left = ~single[unknown]
            at, to = unknown[left], i + length[left]
            total = best[i, at] + self.unknown
            better = total > best[to, at]
            at, to = at[better], to[better]
            best[to, at], back[to, at], piece[to, at] = total[better], i, -1
        # Backwards, all words a step at a time; unknown characters give their bytes.
        rows, pos = np.arange(n), np.full(n, size)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while len(rows):
            number, start = piece[pos, rows], back[pos, rows].astype(np.int64)
            known = number >= 0
            steps.append((rows[known], self.ids[number[known]]))
            for k in range(4):
                more = ~known & (pos - 1 - k >= start)
                if more.any():
                    steps.append((rows[more], self.byte_ids[columns[(pos - 1 - k)[more], rows[more]]]))
            go = start > 0
            rows, pos = rows[go], start[go]
        row = np.concatenate([s[0] for s in steps])[::-1]
        ids = np.concatenate([s[1] for s in steps])[::-1]
        order = np.argsort(row, kind="stable")
        data, ends = ids[order].astype(np.int32).tobytes(), np.cumsum(np.bincount(row, minlength=n)) * 4
        return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def one(self, word: bytes) -> np.ndarray:
        """The same for one word of any length."""
        if self.lists is None:
            self.lists = self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist(), self.scores.tolist()
        base, check, value, scores = self.lists
        size = len(word)
        best, back, piece = [-math.inf] * (size + 1), [0] * (size + 1), [-1] * (size + 1)
        best[0] = 0.0
        for i in range(size):
            if word[i] & 0xC0 == 0x80:
                continue
            c = word[i]
            width = min(1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4, size - i)
            node, single, now = 0, False, best[i]
            for j in range(i, min(i + self.longest, size)):
                to = base[node] + word[j]
                if check[to] != node:
                    break
                node = to
                number = value[node]
                if number >= 0:
                    single |= j + 1 - i == width
                    total = now + scores[number]
                    if total > best[j + 1]:
                        best[j + 1], back[j + 1], piece[j + 1] = total, i, number
            if not single and now + self.unknown > best[i + width]:
                best[i + width], back[i + width], piece[i + width] = now + self.unknown, i, -1
        out, pos = [], size
        while pos:
            out += [int(self.ids[piece[pos]])] if piece[pos] >= 0 else [int(self.byte_ids[b]) for b in reversed(word[back[pos] : pos])]
            pos = back[pos]
        return np.array(out[::-1], np.int32)


def _after_marks(piece: bytes) -> bytes:
    while piece.startswith(MARK):
        piece = piece[len(MARK) :]
    return piece


def load(path: str = MODEL, *, scores: str = "zipf", prefix: bool = True) -> Pieces:
    """Read a SentencePiece model with byte fallback; ``scores``: "zipf" or "file"; ``prefix``: whether texts get a marker
    before them, as the model was made for."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    number = range(model.get_piece_size())
    table = [model.id_to_piece(i).encode() for i in number]
    byte_ids = [0] * 256
    for i in number:
        if model.is_byte(i):
            byte_ids[int(table[i][3:5], 16)] = i
            table[i] = bytes([int(table[i][3:5], 16)])
        elif model.is_control(i):
            table[i] = b""
    normal = [i for i in number if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    own = {i: model.get_score(i) for i in normal}
    if scores == "zipf":
        total = math.log(sum(1 / k for k in range(1, len(normal) + 1)))
        own = {i: -math.log(k) - total for k, i in enumerate(sorted(normal, key=lambda i: (-own[i], i)), 1)}
    return Pieces([table[i] for i in normal], normal, [own[i] for i in normal], byte_ids, table, prefix)


def _groups(texts: list[bytes], most: int = BATCH_BYTES) -> Iterator[slice]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= most):
            size += len(texts[end])
            end += 1
        yield slice(at, end)
        at = end


def _encode(shared, names: list[str], kinds: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        first = int(model.byte_ids.min()), int(model.byte_ids.max())
        for batch in slices(batches, 2048):
            texts = as_bytes(batch.column(0))
            for part in _groups(texts):
                found = model.encode(texts[part])
                rest = [c.slice(part.start, part.stop - part.start) for c in batch.columns[1:]]
                size = np.array([len(x) for x in found], np.int64)
                if "ids" in kinds:
                    own = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *found])))]
                else:
                    own = [pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in found]), pa.array([hashlib.sha256(model.decode(x.tolist())).hexdigest() for x in found])]
                if "decoded" in kinds:
                    own.append(pa.array([model.decode(x.tolist()).decode("utf-8", "replace") for x in found], pa.string()))
                own += [pa.array(size), pa.array([int(((x >= first[0]) & (x <= first[1])).sum()) for x in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([*rest, *own], names)

    return run


def encode(docs: DataFrame, model: Pieces, *, text_col: str = "text", to: str = "pieces", decoded: bool = False) -> DataFrame:
    """``docs`` with ``to`` = struct(ids, n_pieces, n_byte_pieces) of the whole text. Null and empty texts have no pieces.
    ``decoded``: the struct also has the text that decoding the ids gives, made by the same worker. All other columns stay, whatever
    their names."""
    return _with(docs, model, text_col, to, {"ids": "array<int>"} | ({"decoded": "string"} if decoded else {}))


def digests(docs: DataFrame, model: Pieces, *, text_col: str = "text", to: str = "pieces") -> DataFrame:
    """As ``encode``, but with digests in place of the ids: ids_sha256, of the ids as little-endian 32-bit integers, and
    decoded_sha256, of the text that decoding the ids gives."""
    return _with(docs, model, text_col, to, {"ids_sha256": "string", "decoded_sha256": "string"})


def _with(docs: DataFrame, model: Pieces, text_col: str, to: str, own: dict[str, str]) -> DataFrame:
    rest = [c for c in docs.columns if c != to]
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.struct(*[docs[c] for c in rest]).alias("row"))
    names = ["row", *own, "n_pieces", "n_byte_pieces"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    types = rows.limit(0).select("row", *[F.lit(None).cast(t).alias(k) for k, t in (own | {"n_pieces": "bigint", "n_byte_pieces": "bigint"}).items()]).schema
    out = rows.mapInArrow(_encode(shared, names, list(own)), types)
    return out.select("row.*", F.struct(*names[1:]).alias(to))


def _decode(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, 2048):
            texts = [None if x is None else model.decode([i for i in x if i is not None]).decode("utf-8", "replace") for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], names)

    return run


def decode(df: DataFrame, model: Pieces, *, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """``df`` with ``to``: the text of the piece ids. Null ids give null; bytes that make no UTF-8 become U+FFFD."""
    rest = [c for c in df.columns if c != to]
    rows = df.select(F.col(ids_col).cast("array<int>").alias("ids"), F.struct(*[df[c] for c in rest]).alias("row"))
    types = rows.limit(0).select("row", F.lit(None).cast("string").alias("decoded")).schema
    out = rows.mapInArrow(_decode(df.sparkSession.sparkContext.broadcast(model), types.names), types)
    return out.select("row.*", F.col("decoded").alias(to))

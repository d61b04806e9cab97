"""Spelling variants of words, by asymmetric q-chunks.

Words at one edit from each other meet without comparing all pairs. Of two such words let r be the one that isn't longer, of length L,
and q = L div 2. r contributes two disjoint chunks of q letters, its first and its last; the other, s, all its positional grams
of q letters. One edit touches at most one chunk, so the other is a gram of s: a first chunk at its own place, a last one at its
place or, where s is longer, one further. The join is on (gram, place, length of s); grams further than one place from either
end's chunk have nothing to meet and are left out before they are spread. What meets is verified by its edit distance.

A gram that many words share would bring all pairs of them. Where more than ``MOST_PAIRS`` would meet under a key, its
words go to another round instead: without the chunk, what is left of two near words is at one edit too, so it is cut into
chunks of half the length, under the key of the round before. Each round halves what is left, no pair is lost, and rounds end when no key is
full or nothing is left to cut.

Defined results: a null or empty text has no words; a null id reads as an empty one; rows that repeat a document count again; a table without rows gives none.
Only the two named columns are read, so others may have any name.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import as_bytes, join_counted, slices, staged

MIN_LETTERS, MIN_COUNT, RATIO, SLIP_EVERY = 6, 5, 5, 199
MOST_PAIRS, FLUSH_WORDS, SLICE_CHARS = 4096, 200_000, 1 << 20


def _runs(text: bytes, min_letters: int) -> Iterator[list[bytes]]:
    """The text's letter runs of ``min_letters`` or more, A-Z lower-cased, as Latin-1: one byte a letter. Long texts come in slices that
    end where a run does."""
    letters = text.lower().decode().encode("latin-1", "replace")
    found = re.compile(rb"[a-z\xc0-\xff]{%d,}" % min_letters)
    outside = re.compile(rb"[^a-z\xc0-\xff]")
    at = 0
    while at < len(letters):
        stop = outside.search(letters, at + SLICE_CHARS)
        stop = stop.start() if stop else len(letters)
        yield found.findall(letters, at, stop)
        at = stop


def _counts(min_letters: int, slip_every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            some = [(w.decode("latin-1"), n) for w, n in counts.items() if n]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], names=["word", "n"])

        crc = zlib.crc32
        for batch in slices(batches):
            for doc, text in zip(as_bytes(batch.column(0)), as_bytes(batch.column(1)), strict=True):
                start = crc(doc + b":")
                for runs in _runs(text, min_letters):
                    counts.update(runs)
                    slips = {}
                    for w in set(runs):
                        h = crc(w if w.isascii() else w.decode("latin-1").encode(), start)
                        if not h % slip_every:
                            slips[w] = h % len(w)
                    if slips:
                        for w, n in Counter(w for w in runs if w in slips).items():
                            counts[w] -= n
                            if len(w) > min_letters:
                                counts[w[: slips[w]] + w[slips[w] + 1 :]] += n
                    if len(counts) >= FLUSH_WORDS:
                        yield out()
        yield out()

    return run


def count_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, slip_every: int = SLIP_EVERY) -> DataFrame:
    """(word, n) of words with ``min_letters`` letters and ``min_count`` occurrences. Where ``slip_every`` divides the checksum h of
    ``id:word``, the word's letter h mod length is left out first."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(_counts(min_letters, slip_every), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _spread(rows: DataFrame, places: Column) -> DataFrame:
    """A row for each (place, q, length) of a word's rest: the key it meets others under, and what is left without the gram."""
    at = rows.withColumn("at", F.explode(F.array_distinct(places)))
    p, q = F.col("at.place"), F.col("at.q")
    gram = F.substring("rest", p + 1, q)
    rest = F.concat(F.substring(F.col("rest"), F.lit(1), p), F.substring(F.col("rest"), p + q + 1, F.char_length("rest")))
    return at.select(F.xxhash64("path", gram, F.col("at.meets"), F.col("at.length")).alias("key"), (q == 0).alias("last"), "word", "n", rest.alias("rest"))


def _place(place: Column, q: Column, length: Column, meets: Column) -> Column:
    return F.struct(place.cast("int").alias("place"), q.cast("int").alias("q"), length.cast("int").alias("length"), meets.cast("int").alias("meets"))


def _chunks(rows: DataFrame) -> DataFrame:
    size = F.char_length("rest")
    q = F.floor(size / 2)
    places = F.array(_place(F.lit(0), q, size, F.lit(0)), _place(F.lit(0), q, size + 1, F.lit(0)), _place(size - q, q, size, size - q), _place(size - q, q, size + 1, size - q + 1))
    return _spread(rows, places)


def _grams(rows: DataFrame) -> DataFrame:
    size = F.char_length("rest")

    def grams(q: Column) -> Column:
        near = F.filter(F.sequence(F.lit(0), (size - q).cast("int")), lambda p: (p <= 1) | (p >= size - q - 1))
        return F.transform(near, lambda p: _place(p, q, size, p))

    return _spread(rows, F.concat(grams(F.floor(size / 2)), grams(F.floor(F.greatest(size - 1, F.lit(0)) / 2))))


def near_pairs(words: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(a, n_a, b, n_b) for each pair of ``words`` (word, n) at exactly one inserted, deleted or replaced letter, once; a is the shorter, of
    equal lengths the smaller."""
    r = s = words.select(F.lit(0).cast("long").alias("path"), F.col("word").alias("rest"), "word", "n")
    found = None
    while True:
        chunks, grams = _chunks(r), _grams(s)
        counts = chunks.groupBy("key").agg(F.count("*").alias("m"), F.max("last").alias("last")).join(grams.groupBy("key").agg(F.count("*").alias("k")), "key")
        counts = staged(counts.select("key", "m", "k", ((F.col("m") * F.col("k") > most_pairs) & ~F.col("last")).alias("full")), "keys")
        m, k, any_full = counts.agg(F.sum("m"), F.sum("k"), F.max("full")).first()
        if m is None:
            now = None
        else:
            chunks = staged(join_counted(chunks, counts.select("key", "full", F.col("m").alias("times")), "key", m, by="times"), "chunks")
            grams = staged(join_counted(grams, counts.select("key", "full", F.col("k").alias("times")), "key", k, by="times"), "grams")
            left = chunks.filter("not full").select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
            right = grams.filter("not full").select("key", F.col("word").alias("b"), F.col("n").alias("n_b"))
            shorter = (F.char_length("a") < F.char_length("b")) | ((F.char_length("a") == F.char_length("b")) & (F.col("a") < F.col("b")))
            now = left.join(right, "key").filter(shorter & (F.levenshtein("a", "b", 1) == 1)).select("a", "n_a", "b", "n_b").distinct()
            now = staged(now, "pairs")
        found = now if found is None else found if now is None else found.unionByName(now)
        if not any_full:
            break
        r = chunks.filter("full").select(F.col("key").alias("path"), "rest", "word", "n")
        s = grams.filter("full").select(F.col("key").alias("path"), "rest", "word", "n")
    if found is None:
        return words.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("word").alias("b"), F.col("n").alias("n_b")).limit(0)
    return found.distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): each word of ``forms`` (word, form) with the last form that is reached. Steps double each round."""
    now = staged(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        targets = now.groupBy("root").agg(F.count("*").alias("times"))
        steps = staged(onward.join(targets, "root"), "steps")
        total = steps.agg(F.sum("times")).first()[0]
        if not total:
            return now
        moved = join_counted(now, steps, "root", total, by="times").select("word", F.col("next").alias("root"))
        now = staged(moved.unionByName(now.join(steps.select("root"), "root", "left_anti").select("word", "root")), "forms")


def spelling_variants(words: DataFrame, *, ratio: int = RATIO, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of ``words`` (word, n)."""
    words = staged(words.select("word", "n"), "words")
    pairs = staged(near_pairs(words, most_pairs), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    near = best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.minus")).alias("near_n"))
    known = words.join(near, "word", "left")
    is_form = F.col("near_n") >= ratio * F.col("n")
    known = staged(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")), "variants")
    roots = _roots(known.filter("form is not null").select("word", "form"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

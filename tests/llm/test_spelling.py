from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from menuspark.llm import spelling as sp


def _near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _variants(words: dict[str, int]) -> dict:
    near = {w: [v for v in words if _near(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


@pytest.mark.parametrize("most_pairs", [30, sp.MOST_PAIRS])
def test_pairs_equal_brute_force(spark, most_pairs):
    rng = random.Random(most_pairs)
    words = {"".join(rng.choices("abé", k=rng.randrange(6, 9))) for _ in range(150)} | {"station" + x for x in "abcdefgh"} | {"k" * n for n in (6, 7, 8)}
    if most_pairs == sp.MOST_PAIRS:
        words |= {"k" * 3000, "k" * 3001, "a" + "k" * 2999, "b" + "k" * 2999}
    counts = {w: rng.choice([5, 6, 25, 30, 125, 126, 625, 626, 4000]) for w in words}
    table = spark.createDataFrame([(w, n, "clash") for w, n in counts.items()], "word string, n long, path string")
    got = {r["word"]: tuple(r)[1:] for r in sp.spelling_variants(table, most_pairs=most_pairs).collect()}
    assert got == _variants(counts)


def _words(docs) -> dict[str, int]:
    counts = Counter()
    for doc, text in docs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def test_words_of_whole_texts(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdÀé×ÿ", k=rng.randrange(4, 9))) for _ in range(60)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=200)) + "ŒSSS_日本 ÉCOLES éCOLES Ecoles") for i in range(60)]
    docs += [(None, "same words again and again"), (None, None), (7, ""), *[(8, "repeated row repeated row")] * 6, (9, "aaaaaaa" * 40_000 + " long text " * 50_000)]
    table = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, word int")
    monkeypatch.setattr(sp, "FLUSH_WORDS", 50)
    got = {r["word"]: r["n"] for r in sp.count_words(table).collect()}
    assert got == _words(docs)
    assert sp.spelling_variants(sp.count_words(table.limit(0))).count() == 0

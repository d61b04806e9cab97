from __future__ import annotations

import random
import time
import tracemalloc

import numpy as np
import pytest

from menuspark.llm import decontaminate as d

WORDS = [a + b + c for a in "the on in er an re".split() for b in "th ed ti st es".split() for c in "ion and ing ou ea".split()]


def plain_edits(pattern: bytes, text: bytes) -> int:
    """Fewest edits between the pattern and any part of the text: the whole table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text: str, edits: int) -> str:
    out = list(text)
    for _ in range(edits):
        i = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[i] = rng.choice("xyzq")
        elif kind == 1:
            out.insert(i, rng.choice("xyzq"))
        else:
            del out[i]
    return "".join(out)


def test_normal():
    assert d.normal("  Ünd\tA-b.C\n%%% x!") == "ünd a b c x".encode() and d.normal(None) == b""


def test_find_equals_brute_force():
    rng = random.Random(4)
    items = [(i, prose(rng, n)) for i, n in enumerate([9, 14, 20, 33, 48, 1])]
    index = d.build(items)
    texts = []
    for k in range(60):
        item = items[k % 5][1]
        a = rng.randrange(0, max(1, len(item) - 60))
        piece = item if k % 3 else item[a : a + rng.randrange(60, 220)]
        texts.append(d.normal(prose(rng, rng.randrange(0, 30)) + " " + edited(rng, piece, rng.randrange(0, 22)) + " " + prose(rng, rng.randrange(0, 30))))
    texts += [b"", b"a", d.normal(items[0][1]), d.normal(items[4][1]) * 3]
    got = {(n, j, s): e for n, j, s, e in d.find(index, texts)}
    want = {}
    for n, t in enumerate(texts):
        for j, item in enumerate(index.texts):
            for s, e in plain_windows(item, t).items():
                if e <= d.budget(min(len(item), d.WINDOW)):
                    want[n, j, s] = e
    assert len(want) > 40 and got.keys() == want.keys()
    assert all(got[k] >= want[k] for k in want) and sum(got[k] != want[k] for k in want) == 0


@pytest.mark.parametrize("block_bytes", [1 << 21, 700])
def test_leaks_in_documents(spark, sf_dir, block_bytes):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = {(r["id"], r["item_id"]) for r in d.contaminated(docs, items, block_bytes=block_bytes).collect()}
    texts = {r["doc_id"]: d.normal(r["text"]) for r in docs.collect()}
    want = {(i, r["item_id"]) for r in items.collect() for i, t in texts.items() if d.normal(r["text"]) in t}
    assert want and want <= got
    for i, j in got - want:  # beside whole items only real passages
        item = d.normal(next(r["text"] for r in items.collect() if r["item_id"] == j))
        assert any(plain_edits(item[s : s + m], texts[i]) <= d.budget(m) for s, m in d.windows(len(item)))


def test_odd_rows(spark):
    rng = random.Random(8)
    item = prose(rng, 30)
    docs = spark.createDataFrame([(1, item, 1), (1, item, 1), (None, item.upper(), 2), (2, None, 3), (3, "", 4), (4, prose(rng, 20_000) + " " + item, 5)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, item), (8, None), (9, "ab"), (None, "")], "item_id long, text string")
    got = sorted(((r["id"], r["item_id"], r["edits"]) for r in d.contaminated(docs, items).collect()), key=str)
    assert got == sorted([(1, 7, 0), (1, 7, 0), (None, 7, 0), (4, 7, 0)], key=str)
    kept = d.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "3", "None"]
    assert d.contaminated(docs.limit(0), items).count() == 0 and d.contaminated(docs, items.limit(0)).count() == 0


def test_long_items_and_batches_of_one_short_document():
    rng = random.Random(11)
    items = [(0, prose(rng, 400)), (1, prose(rng, 14)), (2, prose(rng, 160))]
    index = d.build(items)
    long, texts = index.texts[0], [b"a b"]
    for a in range(0, len(long) - 200, 150):
        texts += [long[a : a + 200], b"x " + long[a + 20 : a + 190] + b" y", index.texts[1]]
    together = d.find(index, texts)
    for n, t in enumerate(texts):
        alone = {(j, s, e) for _, j, s, e in d.find(index, [t])}
        want = {(j, s, 0) for j, item in enumerate(index.texts) for s, m in d.windows(len(item)) if item[s : s + m] in t}
        assert want <= alone and alone == {(j, s, e) for k, j, s, e in together if k == n}
        for j, s, e in alone - want:
            assert plain_edits(index.texts[j][s : s + d.WINDOW], t) == e
    assert len({s for _, j, s, _ in together if j == 0}) > 40


def test_every_passage_of_a_window_is_found():
    rng = random.Random(12)
    index = d.build([(0, prose(rng, 31)), (1, prose(rng, 60))])
    item = index.texts[0]
    for a in range(0, len(item) - d.WINDOW + 1, 7):
        for n in (100, 117, 149):
            piece = item[a : a + n]
            spoilt = b"zq " + piece[:30] + b"#" + piece[31:70] + piece[72:100] + b" qz"
            if len(piece) == n:
                assert any(j == 0 and e == 0 for _, j, _, e in d.find(index, [b"zq " + piece + b" qz"])), (a, n)
                assert (0, 0, a) in {x[:3] for x in d.find(index, [spoilt])}, (a, n)
    got = {x[:3]: x[3] for x in d.find(index, [b"zq " + item[20:136] + b" qz"])}
    assert {s for _, j, s in got if not got[0, j, s]} == set(range(20, 37))


def plain_windows(item: bytes, text: bytes) -> dict[int, int]:
    """The fewest edits between each window of an item and any part of the text, by the whole tables of all windows."""
    own = d.windows(len(item))
    if not own:
        return {}
    pattern = np.array([list(item[s : s + m]) for s, m in own])
    t, k = np.frombuffer(text, np.uint8), np.arange(len(text) + 1)
    row = np.zeros((len(own), len(text) + 1), np.int64)
    for i in range(pattern.shape[1]):
        new = np.full_like(row, i + 1)
        new[:, 1:] = np.minimum(row[:, :-1] + (pattern[:, i : i + 1] != t), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - k, axis=1) + k
    return {s: int(e) for (s, _), e in zip(own, row.min(axis=1))}


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_windows_of_documents_equal_brute_force(spark, partitions):
    """(id, item, edits, windows) of every row, however the rows are dealt out."""
    rng = random.Random(21)
    items = [(1, prose(rng, 12)), (2, prose(rng, 30)), (3, prose(rng, 60)), (4, prose(rng, 3))]
    texts = {}
    for k in range(40):
        item = items[k % 4][1]
        a = rng.randrange(0, max(1, len(item) - 120))
        texts[k] = prose(rng, rng.randrange(0, 25)) + " " + edited(rng, item[a : a + rng.randrange(90, 260)], rng.choice([0, 3, 8, 9, 12])) + " " + prose(rng, rng.randrange(0, 25))
    want = {}
    for k, text in texts.items():
        for j, item in items:
            found = {s: e for s, e in plain_windows(d.normal(item), d.normal(text)).items() if e <= d.budget(min(len(d.normal(item)), d.WINDOW))}
            if found:
                want[k, j] = (min(found.values()), len(found))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(partitions)
    got = {(r["id"], r["item_id"]): (r["edits"], r["windows"]) for r in d.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and len({i for i, _ in want}) > 15 and len(want) < 40


REPEATED = ["a" * 300, "0 " * 150, "a phrase of thirty bytes, say. " * 12, "ab" * 200 + "c" * 120]


@pytest.mark.parametrize("most_hits", [500, 3_000])
def test_repetition_equals_brute_force(monkeypatch, most_hits):
    monkeypatch.setattr(d, "MOST_HITS", most_hits)
    monkeypatch.setattr(d, "SEGMENT", 64)
    monkeypatch.setattr(d, "UNIT", 40)
    rng = random.Random(most_hits)
    items = [(i, t) for i, t in enumerate([*(x[:125] for x in REPEATED), "a" * 60, prose(rng, 12)])]
    index = d.build(items)
    texts = [d.normal(x) for x in ("a" * 200, "0 " * 100, "b" + REPEATED[2][:160], "x" + "ab" * 60 + "c" * 40, edited(rng, "0 " * 60, 5), items[-1][1] + "a" * 90, "", "0 0 1 " * 30)]
    got = {(n, j, s): e for n, j, s, e in d.find(index, texts)}
    want = {}
    for n, t in enumerate(texts):
        for j, (_, text) in enumerate(items):
            item = d.normal(text)
            for s, m in d.windows(len(item)):
                e = plain_edits(item[s : s + m], t)
                if e <= d.budget(m):
                    want[n, j, s] = e
    assert got == want and want


@pytest.mark.parametrize("kind", range(3))
def test_a_megabyte_of_repetition(kind):
    """A long text against a long item of the same kind: bounded time and memory, and every window is found."""
    unit = REPEATED[kind]
    index = d.build([(0, unit * 40), (1, "an ordinary item with zeros " + "0 " * 150 + "and a tail")])
    text = d.normal(unit * (1_000_000 // len(unit)))
    began = time.perf_counter()
    got = d.find_units(index, [text, d.normal("an ordinary text")])
    assert time.perf_counter() - began < 60
    # Tracing costs many times the time, so memory is traced on a shorter text; what a search holds doesn't depend on the length.
    tracemalloc.start()
    d.find_units(index, [text[:5_000]])
    assert tracemalloc.get_traced_memory()[1] < 500 << 20
    tracemalloc.stop()
    whole = d.normal(unit * 40)
    held = {at + start for (n, u, start), e in got.items() for item, at in index.owners[u] if item == 0 and n == 0}
    assert held == set(range(len(whole) - d.WINDOW + 1)) and not any(n for n, _, _ in got)

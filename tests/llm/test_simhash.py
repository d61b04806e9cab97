from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from menuspark.llm import simhash
from menuspark.llm.components import connected_components


def brute_components(fps: dict, distance: int) -> dict:
    """By plain union-find over all pairs."""
    ids = sorted(fps, key=lambda i: (i is None, i))
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= distance:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def plain_fingerprint(text: str) -> int:
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_is_the_plain_one():
    for text in ["", " \t\n", "one", "A b C", "a b c d", "a b c d e a b c d", "Übung MACHT\x0bden Meister heute noch\x1cmehr", "x " * 500]:
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    import xxhash

    assert spark.sql("SELECT xxhash64('größer')").first()[0] & (2**64 - 1) == xxhash.xxh64("größer".encode(), seed=42).intdigest()


def test_anchors_cover_two_flips():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 31, 50)
    own = simhash.anchors(words)
    for w, a in zip(words, own):
        assert all(bin(int(w) ^ int(x)).count("1") <= 2 for x in a)
        for i in range(31):
            for j in range(i, 31):
                other = int(w) ^ (1 << i) ^ (1 << j if i != j else 0)
                assert set(a) & set(simhash.anchors(np.array([other]))[0])


@pytest.mark.parametrize("cell_rows", [4096, 3])
def test_links_equal_brute_force(spark, cell_rows):
    rng = random.Random(5)
    fps = {}
    for g in range(30):
        base = rng.getrandbits(64)
        for k in range(rng.choice([1, 2, 3, 40])):
            fps[len(fps)] = base
            base ^= sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 3, 4, 5])))
    signed = [(i, f - 2**64 if f >> 63 else f) for i, f in fps.items()]
    df = spark.createDataFrame(signed, "id long, fp long")
    roots = connected_components(simhash.linked_fingerprints(df.select("fp").distinct(), max_distance=4, cell_rows=cell_rows))
    found = {r["id"]: r["least"] for r in df.join(df.join(roots.withColumnRenamed("node", "fp"), "fp").groupBy("root").agg(F.min("id").alias("least")).join(roots, "root").withColumnRenamed("node", "fp").select("fp", "least"), "fp", "left").select("id", "least").collect()}
    want = brute_components(fps, 4)
    assert {i: (i if c is None else c) for i, c in found.items() if c is not None} == {i: want[i] for i, c in found.items() if c is not None}
    alone = [i for i, c in found.items() if c is None]
    assert all(fps[i] == fps[want[i]] and all(fps[j] == fps[i] for j in want if want[j] == want[i]) for i in alone)


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["id"]: r for r in simhash.near_duplicates(docs).collect()}
    fps = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs.select("doc_id", "text").collect()}
    want = brute_components(fps, 4)
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r["component_id"] for i, r in got.items()} == want


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (None, "", "z"), (4, "a b c d e f", "fp"), (4, "a b c d e f", "fp"), (3, "a b c d e f", "id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r["id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    f = f"{plain_fingerprint('a b c d e f'):016x}"
    assert got == sorted([(1, "0" * 16, 1), (2, "0" * 16, 1), (None, "0" * 16, 1), (4, f, 3), (4, f, 3), (3, f, 3)], key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_components_of_hubs(spark):
    """Stars whose centre is the largest, a middle or the smallest node, on few partitions and many edges a node."""
    edges = [(i, 10_000) for i in range(3000)] + [(5_000, i) for i in range(20_000, 22_500)] + [(30_000 + i, 31_000) for i in range(2_000) if i != 1000]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 0 for i in [*range(3000), 10_000]} | {i: 5_000 for i in [5_000, *range(20_000, 22_500)]} | {30_000 + i: 30_000 for i in range(2_000)}
    assert got == want

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from menuspark.llm import line_dedup as ld

SPACE = " \t\n\v\f\r"


def key(line: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line).strip(SPACE)


def plain(rows, min_docs, least=1, keep="none"):
    """rows: (id, text). (lines, dropped, kept text) of each."""
    split = [(text or "").split("\n") for _, text in rows]
    count, first = {}, {}
    for (i, _), own in zip(rows, split):
        for k in {key(x) for x in own}:
            count[k] = count.get(k, 0) + 1
        for n, x in enumerate(own):
            at = (i is None, i if i is not None else 0, n)
            if key(x) not in first or at < first[key(x)]:
                first[key(x)] = at
    out = []
    for (i, _), own in zip(rows, split):
        gone = [n for n, x in enumerate(own) if len(key(x)) >= least and count[key(x)] >= min_docs and not (keep == "first" and first[key(x)] == (i is None, i if i is not None else 0, n))]
        out.append((len(own), len(gone), "\n".join(x for n, x in enumerate(own) if n not in gone)))
    return out


ODD = [(1, None), (2, ""), (3, "a\n\nA \n\x0bb"), (3, "a\n\nA \n\x0bb"), (None, "a\nc"), (5, "\n\n"), (6, "É\né\n  é"), (7, "z" * 150_000 + "\na"), (8, "a\r\nq"), (None, "\xa0a\nb")]


def run(spark, rows, **more):
    df = spark.createDataFrame([(n, i, t, n, "x") for n, (i, t) in enumerate(rows)], "n int, doc_id long, text string, key int, n_lines string")
    out = ld.dedup_lines(df, **more)
    assert out.columns == ["n", "doc_id", "text", "key", "n_lines", "line_stats"]
    return [tuple(r["line_stats"]) for r in sorted(out.collect(), key=lambda r: r["n"])]


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize(("filter_bytes", "set_bytes"), [(1 << 26, 1 << 26), (0, 1 << 26), (1 << 26, 0), (0, 0)])
def test_equals_brute_force(spark, keep, filter_bytes, set_bytes):
    rng = random.Random(7)
    lines = ["Shared", " shared\t", "SHARED line", "x", "", "  ", "Übung", "übung", "tail\r"] + [f"own {i}" for i in range(40)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 9)))) for i in range(60)] + [(i and i + 100, t) for i, t in ODD]
    if keep == "first":  # ids without a value all count as one: leave the odd ones of them out
        rows = [r for r in rows if r[0] is not None]
    for min_docs, least in ((2, 1), (10, 1), (3, 5)):
        assert run(spark, rows, min_docs=min_docs, min_code_points=least, keep=keep, filter_bytes=filter_bytes, set_bytes=set_bytes) == plain(rows, min_docs, least, keep)


def test_odd_rows(spark):
    assert run(spark, ODD, min_docs=2) == plain(ODD, 2)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ld.dedup_lines(empty).count() == 0


def test_column_key_is_the_key(spark):
    texts = ["A b ", "\t\v\fX\r", "É", "", "\xa0A", "a\x1c", "  "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(ld.line_key(F.col("t"))).collect()] == [key(t) for t in texts] == [ld.line_keys(t.encode())[0].decode() for t in texts]


def test_bloom_has_no_false_negatives():
    rng = np.random.default_rng(0)
    own, other = (rng.integers(0, 2**63, 20_000).astype(np.uint64) for _ in range(2))
    bloom = ld.Bloom(ld.ONCE_BITS * len(own))
    bloom.add(own)
    assert bloom.has(own).all() and bloom.has(other).mean() < 0.02


def test_repeats_and_first_places(spark):
    rows = [(5, "b\nA"), (2, "x\na"), (9, "a\na\nb")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {bytes(r["key"]).decode(): (r["n_docs"], r["first_doc"], r["first_line"]) for r in ld.repeated_lines(df, min_docs=2, first=True).collect()}
    assert got == {"a": (3, 2, 1), "b": (2, 5, 0)}


@pytest.mark.parametrize("filter_bytes", [1 << 26, 6_000, 0])
def test_filters_at_every_size(spark, monkeypatch, filter_bytes):
    """More shards than asked for, and filters folded until they fit: all repeats are suspects, and few others while there is room."""
    monkeypatch.setattr(ld, "SHARD_HASHES", 300)
    rng = random.Random(4)
    own = [f"line {i}" for i in range(3000)]
    rows = [(i, "\n".join(rng.sample(own[:200], 4) + own[200 + 7 * i : 207 + 7 * i])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    filters = ld.line_filters(df, filter_bytes=filter_bytes).value
    assert filters.shards > 4
    seen = filters.has(ld._hashes([x.encode() for x in own]))
    assert seen[:200].all() and (filter_bytes == 0 or seen[200:].mean() < 0.1)
    assert len(filters.data) <= max(filter_bytes, filters.shards) + 1
    got = {bytes(r["key"]).decode(): r["n_docs"] for r in ld.repeated_lines(df, filter_bytes=filter_bytes).collect()}
    want = {k: n for k in own if (n := sum(k in t.split("\n") for _, t in rows)) > 1}
    assert got == want


def test_a_line_of_all_rows_and_rows_without_ids(spark):
    """The join way with a hot key, repeated ids, null ids and a text of very many lines."""
    rows = [(i % 50 if i % 3 else None, f"licence\nown {i}") for i in range(300)] + [(7, "\n".join(f"l{k}" for k in range(20_000)) + "\nlicence"), (8, "\n".join(f"l{k}" for k in range(20_000)))]
    assert run(spark, rows, min_docs=2, set_bytes=0) == plain(rows, 2)


def test_the_sql_counts_rows(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from menuspark.llm.queries import OP1_SQL, op1_line_dedup

    rows = [(1, "a\nb")] * 6 + [(None, "a\nc")] * 4 + [(2, None), (3, "b\n\nB ")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = [tuple(r) for r in op1_line_dedup(spark, str(tmp_path)).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()]
    want = con.execute(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({OP1_SQL})").fetchall()
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == len(rows)

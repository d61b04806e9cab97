from __future__ import annotations

import os
import random
import re
import time

import numpy as np
import pytest

from menuspark.llm import token_count as tc

needs = pytest.mark.skipif(not os.path.exists(tc.RANKS), reason="no vocabulary file")


@pytest.mark.parametrize("block_tokens", [1, 2, 7, 1 << 20])
def test_blocks_are_stitched(spark, tmp_path, block_tokens):
    rng = random.Random(block_tokens)
    want = {}
    for k, docs in enumerate([[0, 0, 5, 1, 0], [40, 3], [9], [0], []]):
        for complete in (True, False):
            path = f"{tmp_path}/{k}{complete}.bin"
            ids = []
            for n in docs:
                ids += [rng.randrange(9) for _ in range(n)] + [9]
            open_tokens = 0 if complete else rng.randrange(1, 20)
            np.array(ids + [1] * open_tokens, "<u2").tofile(path)
            want |= {(f"file://{path}", i): (n, True) for i, n in enumerate(docs)}
            if open_tokens:
                want[f"file://{path}", len(docs)] = (open_tokens, False)
    paths = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in os.listdir(tmp_path)], "path string")
    got = {(r["path"], r["ordinal"]): (r["n_tokens"], r["complete"]) for r in tc.count_tokens(paths, end=9, block_tokens=block_tokens, tasks=2).collect()}
    assert got == want


@needs
def test_counts_equal_direct_encoding(spark, sf_dir):
    made = tc.Tokenizer.load()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (None, "a b"), (-3, "x" * 100_000), (-3, "x" * 100_000), (-4, "<|endoftext|> 50256")], "doc_id long, text string")
    both = docs.unionByName(odd).selectExpr("doc_id", "text", "1 AS path", "2 AS ordinal")
    order = tc.write_token_files(both, made, file_bytes=50_000)
    assert order.select("path").distinct().count() > 3
    counted = tc.count_tokens(order, block_tokens=4096, tasks=3)
    assert counted.filter("not complete").count() == 0
    got = sorted(((r["id"], r["n_tokens"]) for r in order.join(counted, ["path", "ordinal"]).collect()), key=str)
    encoder = made.encoder()
    assert got == sorted(((r["doc_id"], len(encoder.encode_ordinary(r["text"] or ""))) for r in both.collect()), key=str)
    none = tc.write_token_files(both.limit(0), made)
    assert none.count() == 0 and tc.count_tokens(none).count() == 0


@needs
def test_long_runs_are_cut_where_the_pattern_cuts(monkeypatch):
    made, rng = tc.Tokenizer.load(), random.Random(1)
    encoder = made.encoder()
    monkeypatch.setattr(tc, "_RUN", re.compile(tc._RUN.pattern.replace("{1000,}", "{2,}")))
    for _ in range(5000):
        text = "".join(rng.choice(" \n\t\u3000\x1c\x85a1'.s") for _ in range(rng.randrange(30)))
        assert made.encode(encoder, text) == encoder.encode_ordinary(text), repr(text)


@needs
def test_very_long_texts(spark):
    began = time.monotonic()
    rows = [(1, " " * 5_000_000), (2, "a" + "\n" * 2_000_000 + "b"), (3, "\u3000" * 300_000 + "x"), (4, "é" * 500_000), (5, "#" * 1_000_000)]
    made = tc.Tokenizer.load()
    order = tc.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), made)
    got = {r["id"]: r["n_tokens"] for r in order.join(tc.count_tokens(order), ["path", "ordinal"]).collect()}
    encoder = made.encoder()
    assert got == {i: len(made.encode(encoder, t)) for i, t in rows} and got[1] > 10_000
    assert time.monotonic() - began < 60

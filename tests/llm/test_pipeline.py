from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from menuspark.llm import decontaminate, line_dedup, quality, sentencepieces, simhash
from menuspark.llm.common import staged
from tests.llm.test_decontaminate import plain_windows
from tests.llm.test_simhash import brute_components, plain_fingerprint


def test_stages_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir).cache()
        before, after = {r["doc_id"]: r for r in docs.collect()}, {r["doc_id"]: r for r in out.collect()}
        assert after.keys() <= before.keys() and out.count() == len(after)
        if name != "pieces":
            assert out.columns == columns
        if name == "quality":
            net = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            score = dict(zip(before, quality.sigmoid(quality.logits(net, [(r["text"] or "").encode() for r in before.values()]))))
            assert after.keys() == {i for i in before if score[i] >= quality.THRESHOLD}
        if name == "lines":
            count: dict[bytes, int] = {}
            for r in before.values():
                for k in set(line_dedup.line_keys(r["text"].encode())):
                    count[k] = count.get(k, 0) + 1
            want = {i: "\n".join(x for x in r["text"].split("\n") if not (k := line_dedup.line_keys(x.encode())[0]) or count[k] < 10) for i, r in before.items()}
            assert {i: r["text"] for i, r in after.items()} == want and all(r["n_chars"] == len(r["text"]) for r in after.values())
        if name == "near_duplicates":
            root = brute_components({i: plain_fingerprint(r["text"]) for i, r in before.items()}, 4)
            assert after.keys() == {i for i in before if root[i] == i}
        if name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            whole = {i for i, r in before.items() if any(decontaminate.normal(t) in decontaminate.normal(r["text"]) for _, t in items)}
            assert whole and not whole & after.keys()
            for i in before.keys() - after.keys() - whole:  # beside whole items only real windows
                text = decontaminate.normal(before[i]["text"])
                assert any(e <= decontaminate.budget(min(len(t), decontaminate.WINDOW)) for t in (decontaminate.normal(t) for _, t in items) for e in plain_windows(t, text).values())
            short = [i for i in after if len(after[i]["text"]) < 500][:12]
            assert short and not any(e <= decontaminate.budget(min(len(t), decontaminate.WINDOW)) for i in short for t in (decontaminate.normal(t) for _, t in items) for e in plain_windows(t, decontaminate.normal(after[i]["text"])).values())
        if name == "pieces":
            model = sentencepieces.load()
            assert {i: model.decode(r["ids"]).decode() for i, r in after.items()} == {i: r["text"] for i, r in before.items()}
        seen.append(len(after))
        docs = out
    assert corpus_pipeline.run(spark, sf_dir).count() == seen[-1]


def test_pieces_are_decoded_in_the_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.encode_pieces(spark, docs, sf_dir)
    want = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert {r["doc_id"]: r["decoded"] for r in out.collect()} == want and out.count() == docs.count()


def test_odd_rows_and_clashing_columns(spark, sf_dir):
    """Null, empty, repeated and long rows and columns with the stages' own names go through all stages; an empty table gives an empty one."""
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    prose = " ".join(r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").filter("length(text) between 200 and 900").orderBy("doc_id").limit(3).collect())
    odd = spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", "a", 0), (None, prose, "en", "a", 1), (-3, prose, "en", "a", 1), (-3, prose, "en", "a", 1), (-4, prose * 40, None, "a", 1)], kind)
    extra = {"__score": F.lit("own"), "Line_Stats": F.lit(7), "pieces": F.lit(True), "__id": F.lit(1), "score": F.lit("s"), "id": F.lit(None).cast("string")}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").unionByName(odd).withColumns(extra)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out, none = staged(stage(spark, docs, sf_dir), "odd"), stage(spark, empty, sf_dir)
        assert none.columns == out.columns and none.count() == 0
        if name == "pieces":
            break
        assert out.columns == docs.columns
        assert out.select(*extra).distinct().collect() == docs.select(*extra).distinct().collect()
        rows = out.filter("doc_id = -3").count()
        assert rows in (0, 2) and out.filter("doc_id is null").count() <= 1
        docs, empty = out, out.limit(0)
    assert {"doc_id", "ids", "decoded"} <= set(out.columns)

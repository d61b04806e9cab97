"""The corpus pipeline: STAGES over documents, each written as Parquet and read again as the next one's input.

1. quality: documents that the quality classifier rejects go;
2. lines: lines whose key is in ten documents or more go from every document;
3. near_duplicates: of each group of linked fingerprints the document with the smallest doc_id stays;
4. decontamination: documents that hold a benchmark window go;
5. pieces: every text is encoded as SentencePiece ids, and the ids are decoded again to a text beside them.

All but the last return the columns of documents. A stage works on all rows its predecessor kept. Rows with a null doc_id
are never dropped as duplicates or leaks. Null texts count as empty ones. Columns beside those of documents may have any name and
come through the stages as they are, but the last, which has columns of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from menuspark.llm import decontaminate, line_dedup, quality, sentencepieces, simhash
from menuspark.llm.common import new_folder, staged


def _fresh(name: str, docs: DataFrame) -> str:
    """A column name that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = "_" + name
    return name


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = quality.fit(docs, labels, label_col="quality")
    score = _fresh("score", docs)
    return quality.score(docs, net, to=score).filter(F.col(score) >= quality.THRESHOLD).select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = {c: _fresh(c.lower(), docs) for c in docs.columns if c.lower() == "line_stats"}
    out = line_dedup.dedup_lines(docs.withColumnsRenamed(own), min_docs=10, min_code_points=1)
    kept = F.col("line_stats.kept")
    new = {"text": kept, "n_chars": F.length(kept).cast("long")}
    return out.select(*[new[c].alias(c) if c in new else out[own.get(c, c)].alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of a component is its component_id, so the rows to drop are known without a grouping. Rows that
    repeat that doc_id all stay, as do rows without one."""
    found = simhash.near_duplicates(docs)
    gone = staged(found.filter("id is not null and id != component_id").select(F.col("id").alias("__id")).distinct(), "near-duplicates")
    return docs.join(gone, docs["doc_id"] == gone["__id"], "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = sentencepieces.encode(docs, sentencepieces.load(), decoded=True)
    return out.select("doc_id", "lang", "source", "pieces.ids", "pieces.n_pieces", "pieces.n_byte_pieces", "pieces.decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("lines", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("pieces", encode_pieces),
]
#: SQL expresses neither the trained classifier nor the fingerprints; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""Token counts from flat token files without an index.

A token file is nothing but token ids, little-endian and of one width, each document followed by the end-of-document id. The
files are cut into blocks, whatever documents lie there. A task finds all separators of a block at once and notes the lengths
between them, the tokens before the first and after the last. A prefix scan over a file's blocks then carries the open tokens of
earlier blocks to the next separator and numbers the documents, so a document may span any number of blocks. The scan has a few
numbers a block; the lengths inside blocks meet its result by a join.

Texts of any length and kind are encoded: the splitting pattern looks ahead after white space, which its engine can't do over
very long runs, so these are cut out first, where the pattern itself would cut.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import filesystem, new_folder, slices, staged

RANKS, END, WIDTH = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken", 50_256, 2
#: The published splitting pattern of these vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_TOKENS, FILE_BYTES, LONG_RUN = 1 << 20, 64 << 20, 1000
#: Unicode's white space, which the pattern's \s is; Python's own has four control characters more.
_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)


@dataclass
class Tokenizer:
    """A byte-level BPE vocabulary as it is broadcast; each worker builds its encoder once."""

    ranks: dict[bytes, int]
    split: str = SPLIT
    end: int = END
    width: int = WIDTH

    @classmethod
    def load(cls, path: str = RANKS, **more) -> Tokenizer:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, **more)

    def encoder(self):
        import tiktoken

        return tiktoken.Encoding("own", pat_str=self.split, mergeable_ranks=self.ranks, special_tokens={})

    def encode(self, encoder, text: str) -> list[int]:
        """The ids of a whole text. A run of white space is one piece but for its last character, which may belong to what comes
        after it; at the end of the text it is one piece."""
        if self.split != SPLIT:
            return encoder.encode_ordinary(text)
        ids, at = [], 0
        for m in _RUN.finditer(text):
            end = m.end() - (m.end() < len(text))
            ids += encoder.encode_ordinary(text[at : m.start()])
            ids += encoder._encode_single_piece(text[m.start() : end])
            at = end
        return ids + encoder.encode_ordinary(text[at:]) if at else encoder.encode_ordinary(text)


def _write(shared, folder: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = shared.value
        encoder, kind = made.encoder(), np.dtype(f"<u{made.width}")
        stop = np.array([made.end], kind).tobytes()
        system, place = filesystem(folder)
        out, name, size, ordinal = None, "", 0, 0
        try:
            for batch in slices(batches, 2048):
                names, ordinals = [], []
                for text in batch.column(1).to_pylist():
                    if out is None or size >= file_bytes:
                        if out is not None:
                            out.close()
                        system.create_dir(place, recursive=True)
                        name, size, ordinal = f"{folder}/part-{uuid.uuid4().hex}.bin", 0, 0
                        out = system.open_output_stream(f"{place}/{name.rpartition('/')[2]}", compression=None)
                    data = np.array(made.encode(encoder, text or ""), kind).tobytes() + stop
                    out.write(data)
                    size += len(data)
                    names.append(name)
                    ordinals.append(ordinal)
                    ordinal += 1
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(ordinals, pa.int64())], ["id", "path", "ordinal"])
        finally:
            if out is not None:
                out.close()

    return run


def write_token_files(docs: DataFrame, tokenizer: Tokenizer, folder: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Token files of whole texts in a folder (a new one in the shared folder if none is given); returns the staged order
    (id, path, ordinal) of the documents. Null and empty texts are an end-of-document id alone. Each attempt of a task writes
    files of its own; those not in the order are left-overs of attempts that were lost."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return staged(rows.mapInArrow(_write(spark.sparkContext.broadcast(tokenizer), folder, file_bytes), "id long, path string, ordinal long"), "token-order")


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = batch.column(0).to_pylist()
        sizes = []
        for p in paths:
            system, place = filesystem(p)
            sizes.append(system.get_file_info(place).size)
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "bytes"])


def block_counts(data: np.ndarray, end: int) -> tuple[int, int, int, np.ndarray]:
    """(separators, tokens before the first, tokens after the last, tokens of each document that lies wholly between). Without
    a separator all tokens are after the last."""
    at = np.flatnonzero(data == end)
    if not len(at):
        return 0, 0, len(data), at
    return len(at), int(at[0]), len(data) - int(at[-1]) - 1, np.diff(at) - 1


def _scan(end: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, block, start, size in zip(*(batch.column(i).to_pylist() for i in range(4))):
                system, place = filesystem(path)
                with system.open_input_file(place) as f:
                    data = np.frombuffer(f.read_at(size, start), np.uint8)
                data = data[: len(data) // width * width].view(f"<u{width}")
                n, head, tail, inner = block_counts(data, end)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([block], pa.int64()), pa.array([n], pa.int64()), pa.array([head], pa.int64()), pa.array([tail], pa.int64()), pa.array([inner.astype(np.int64)], pa.list_(pa.int64()))], ["path", "block", "ends", "head", "tail", "inner"])

    return run


def count_tokens(paths: DataFrame, *, end: int = END, width: int = WIDTH, block_tokens: int = BLOCK_TOKENS, tasks: int | None = None) -> DataFrame:
    """(path, ordinal, n_tokens, complete) for each document of the token files listed in ``paths`` (path): the tokens before its
    end-of-document id. Tokens after a file's last such id are a document that is not complete. An empty file has none; an odd
    last byte of a file is not read."""
    size = block_tokens * width
    files = paths.select("path").distinct().mapInArrow(_sizes, "path string, bytes long").filter("bytes > 0")
    blocks = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(bytes - 1) div {size}"))).alias("block"))
    blocks = blocks.select("path", "block", (F.col("block") * size).alias("start"), F.lit(size).cast("long").alias("size"))
    scanned = staged((blocks.repartition(tasks) if tasks else blocks).mapInArrow(_scan(end, width), "path string, block long, ends long, head long, tail long, inner array<long>"), "token-blocks")
    order = Window.partitionBy("path").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # Blocks of one run: one with separators and those after it that have none. Their tails are open at the next separator.
    slim = scanned.select("path", "block", "ends", "head", "tail")
    run = slim.withColumn("run", F.sum(F.when(F.col("ends") > 0, 1).otherwise(0)).over(order))
    open_now = F.sum("tail").over(Window.partitionBy("path", "run").orderBy("block"))
    carried = run.withColumn("open", open_now).withColumn("carry", F.coalesce(F.lag("open").over(order), F.lit(0)))
    carried = carried.withColumn("first", F.coalesce(F.sum("ends").over(before), F.lit(0))).withColumn("last", F.lead("block").over(order).isNull())
    whole = F.concat(F.array(F.col("carry") + F.col("head")), F.col("inner"))
    lengths = scanned.select("path", "block", "inner").join(carried.filter("ends > 0").select("path", "block", "first", "carry", "head"), ["path", "block"])
    documents = lengths.select("path", "first", F.posexplode(whole).alias("at", "n_tokens")).select("path", (F.col("first") + F.col("at")).alias("ordinal"), "n_tokens", F.lit(True).alias("complete"))
    rest = carried.filter("last and open > 0").select("path", (F.col("first") + F.col("ends")).alias("ordinal"), F.col("open").alias("n_tokens"), F.lit(False).alias("complete"))
    return documents.unionByName(rest)

"""Chat formatting with loss masks aligned by offsets.

A conversation's turns, in order, are rendered as one string by a template of control strings; the string is encoded once, with
the offsets of its tokens; the sorted spans of the turns' texts meet the sorted token spans by binary search, which gives the
mask of the tokens that count as loss. Control strings are single tokens and no text can hold one: inside a text each gets a
backslash after its first character (and one more where it has some already), which is undone exactly when the output is read.

Rows of a conversation may be any number: they are dealt by (conversation, block of ``BLOCK_TURNS`` turn numbers), sorted by Spark
outside the heap, and go through a task as a stream. An output row is a piece of a conversation: all its turns, unless the turns pass
a block or ``PIECE_CHARS``. As control tokens never merge with their neighbours, pieces have the ids that the whole would have.

Defined results: a null or missing text or role is empty; turns are ordered by number (null first), then role, then text, and repeated
rows are turns of their own; a null id is a conversation as any other; a table without rows gives none. Only the four named
columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import slices, staged

VOCABULARY, END_OF_TEXT = "/opt/tokenizers/byte_bpe_50k.json", "<|endoftext|>"
BLOCK_TURNS, PIECE_CHARS, PART_CHARS, BATCH_CHARS = 4096, 1 << 20, 1 << 15, 1 << 18
ASSISTANT = "assistant"
#: Where a long text may be cut: the vocabulary's splitting pattern always cuts between a character and white space.
_CUT = re.compile(r"(?<=\S)(?= )")


@dataclass(frozen=True)
class Template:
    """The control strings around a turn's text, by role; turns of other roles name theirs between ``role_open`` and ``role_close``.
    Every control string begins with ``<`` or ``[`` and none holds a backslash or begins inside another."""

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), ASSISTANT: ("", "</s>")})
    role_open: str = "[ROLE]"
    role_close: str = "[/ROLE]"
    end: str = "</s>"
    also_escaped: tuple[str, ...] = ("<s>", END_OF_TEXT)

    @cached_property
    def controls(self) -> list[str]:
        own = [x for pair in self.marks.values() for x in pair] + [self.role_open, self.role_close, self.end]
        return list(dict.fromkeys(x for x in own if x))

    @cached_property
    def _patterns(self) -> tuple[re.Pattern, re.Pattern]:
        every = sorted({*self.controls, *self.also_escaped}, key=len, reverse=True)
        by_first = {first: "|".join(re.escape(x[1:]) for x in every if x[0] == first) for first in sorted({x[0] for x in every})}
        put, take = ("|".join(f"{re.escape(first)}{marks}(?:{tails})" for first, tails in by_first.items()) for marks in (r"\\*", r"\\+"))
        return re.compile(put), re.compile(take)

    def escape(self, text: str) -> str:
        return self._patterns[0].sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return self._patterns[1].sub(lambda m: m[0][0] + m[0][2:], text)

    def render(self, role: str, text: str) -> tuple[str, str, str]:
        """What comes before a turn's text, the text escaped, and what comes after it."""
        if role in self.marks:
            before, after = self.marks[role]
        else:
            before, after = f"{self.role_open}{self.escape(role)}{self.role_close}", self.end
        return before, self.escape(text), after

    def turns(self, rendered: str) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn of a rendered string: the inverse of rendering."""
        at = 0
        plain = next(role for role, (before, _) in self.marks.items() if not before)
        while at < len(rendered):
            role, end = plain, self.marks[plain][1]
            if rendered.startswith(self.role_open, at):
                stop = rendered.index(self.role_close, at)
                role, end, at = self.unescape(rendered[at + len(self.role_open) : stop]), self.end, stop + len(self.role_close)
            else:
                for name, (before, after) in self.marks.items():
                    if before and rendered.startswith(before, at):
                        role, end, at = name, after, at + len(before)
                        break
            stop = rendered.index(end, at)
            yield role, self.unescape(rendered[at:stop])
            at = stop + len(end)


@dataclass
class Encoder:
    """A byte-level BPE vocabulary (a file that every executor has, or its content) with the template's control strings as tokens of
    their own behind it."""

    vocabulary: str
    template: Template = field(default_factory=Template)

    @classmethod
    def load(cls, path: str = VOCABULARY, template: Template | None = None) -> Encoder:
        with open(path, encoding="utf-8") as f:
            return cls(f.read(), template or Template())

    @cached_property
    def tokenizer(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer

        made = Tokenizer.from_str(self.vocabulary)
        made.no_truncation()
        made.no_padding()
        made.add_special_tokens([AddedToken(x, normalized=False) for x in self.template.controls])
        return made

    @cached_property
    def token_bytes(self) -> list[bytes]:
        """Each id's bytes. The vocabulary writes a byte as itself where it is printable, the others as U+0100 onwards, in order."""
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        added = set(self.template.controls) | {END_OF_TEXT}
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        names = map(self.tokenizer.id_to_token, range(size))
        return [x.encode() if x in added else bytes(to_byte[c] for c in x) for x in names]

    def __getstate__(self):
        return {"vocabulary": self.vocabulary, "template": self.template}

    def encode(self, parts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and (start, end) offsets of each part."""
        out = []
        for at in range(0, len(parts), 64):
            for e in self.tokenizer.encode_batch(parts[at : at + 64], add_special_tokens=False):
                out.append((np.array(e.ids, np.int32), np.array(e.offsets, np.int64).reshape(-1, 2)))
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist())).decode()


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """True for each token that lies inside one of the sorted, disjoint ``spans``. Token starts and ends never fall, so a span's tokens
    are a range that two binary searches find."""
    first = np.searchsorted(starts, spans[:, 0], "left")
    last = np.searchsorted(ends, spans[:, 1], "right")
    some = first < last
    steps = np.bincount(first[some], minlength=len(starts) + 1) - np.bincount(last[some], minlength=len(starts) + 1)
    return np.cumsum(steps)[:-1] > 0


class _Piece:
    """Turns of one conversation while they come in: the rendered string in parts that can be encoded apart, and the loss spans."""

    def __init__(self, key):
        self.key, self.turns, self.chars, self.parts, self.open, self.open_chars, self.spans = key, 0, 0, [], [], 0, []

    def add(self, text: str) -> None:
        self.open.append(text)
        self.open_chars += len(text)
        self.chars += len(text)

    def close_part(self) -> None:
        if self.open:
            self.parts.append("".join(self.open))
            self.open, self.open_chars = [], 0

    def turn(self, before: str, text: str, after: str, loss: bool) -> None:
        self.turns += 1
        self.add(before)
        start = self.chars
        if len(text) > PART_CHARS:
            self.close_part()
            at = 0
            while len(text) - at > PART_CHARS and (m := _CUT.search(text, at + PART_CHARS)):
                self.add(text[at : m.start()])
                self.close_part()
                at = m.start()
            self.add(text[at:])
        else:
            self.add(text)
        if loss and self.chars > start:
            self.spans.append((start, self.chars))
        self.add(after)
        if self.open_chars > PART_CHARS:
            self.close_part()


def _format(shared, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: Encoder = shared.value
        template = made.template
        now, piece, number, waiting, chars = None, None, 0, [], 0

        def encoded() -> pa.RecordBatch:
            found = made.encode([part for x in waiting for part in x[0].parts])
            rows, at = [], 0
            for x, n in waiting:
                mine, at = found[at : at + len(x.parts)], at + len(x.parts)
                shift = np.cumsum([0, *map(len, x.parts)])[:-1]
                ids = np.concatenate([i for i, _ in mine]) if mine else np.zeros(0, np.int32)
                offsets = np.concatenate([o + s for (_, o), s in zip(mine, shift, strict=True)]) if mine else np.zeros((0, 2), np.int64)
                loss = loss_mask(offsets[:, 0], offsets[:, 1], np.array(x.spans, np.int64).reshape(-1, 2))
                rows.append((*x.key, n, x.turns, "".join(x.parts), ids, loss))
            waiting.clear()
            columns = list(zip(*rows, strict=True))
            kinds = [id_type, pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_())]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["id", "block", "piece", "n_turns", "text", "ids", "loss"])

        def finish() -> None:
            nonlocal chars
            piece.close_part()
            waiting.append((piece, number))
            chars += piece.chars

        for batch in slices(batches):
            for conv, block, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if piece is None or (conv, block) != now:
                    if piece is not None:
                        finish()
                    now, number, piece = (conv, block), 0, _Piece((conv, block))
                elif piece.chars >= PIECE_CHARS:
                    finish()
                    number, piece = number + 1, _Piece(now)
                piece.turn(*template.render(role, text), loss=role == ASSISTANT)
                if chars >= BATCH_CHARS:
                    yield encoded()
                    chars = 0
        if piece is not None:
            finish()
        if waiting:
            yield encoded()

    return run


def format_conversations(rows: DataFrame, encoder: Encoder, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a piece of a conversation: id, block, piece (their order), n_turns, text (rendered), ids and loss (one entry a token)."""
    spark = rows.sparkSession
    id_field = T.StructField("id", rows.schema[id_col].dataType)
    schema = T.StructType([id_field, *T.StructType.fromDDL("block long, piece int, n_turns long, text string, ids array<int>, loss array<boolean>").fields])
    turn = F.col(turn_col).cast("long")
    dealt = (
        rows.select(F.col(id_col).alias("id"), F.floor(turn / BLOCK_TURNS).cast("long").alias("block"), turn.alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .repartition("id", "block").sortWithinPartitions("id", "block", "turn", "role", "text").select("id", "block", "role", "text")
    )
    return dealt.mapInArrow(_format(spark.sparkContext.broadcast(encoder), to_arrow_type(id_field.dataType)), schema)


class _Digest:
    def __init__(self):
        self.turns, self.chars, self.loss_chars, self.whole, self.loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()

    def add(self, made: Encoder, ids: np.ndarray, loss: np.ndarray) -> None:
        rendered = made.decode(ids)
        self.chars += len(rendered)
        for role, text in made.template.turns(rendered):
            self.turns += 1
            self.whole.update(f"{role}\n{text}\n".encode())
        edges = np.flatnonzero(np.diff(np.concatenate([[0], loss.view(np.int8), [0]])))
        for start, stop in edges.reshape(-1, 2):
            text = made.template.unescape(made.decode(ids[start:stop]))
            self.loss_chars += len(text)
            self.loss.update(text.encode())


def _read(shared, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: Encoder = shared.value
        now, digest, done = None, None, []

        def out() -> pa.RecordBatch:
            rows = [(i, d.turns, d.whole.hexdigest(), d.loss_chars, d.loss.hexdigest(), d.chars) for i, d in done]
            done.clear()
            kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in slices(batches, 64):
            for k, conv in enumerate(batch.column(0).to_pylist()):
                if digest is None or conv != now:
                    if digest is not None:
                        done.append((now, digest))
                    now, digest = conv, _Digest()
                digest.add(made, batch.column(1)[k].values.to_numpy(), np.asarray(batch.column(2)[k].values.to_numpy(zero_copy_only=False)))
                if len(done) >= 1024:
                    yield out()
        if digest is not None:
            done.append((now, digest))
        if done:
            yield out()

    return run


def read_back(formatted: DataFrame, encoder: Encoder) -> DataFrame:
    """What the ids and masks of formatted conversations hold, one row a conversation: the turns are parsed from the decoded ids, the
    loss text is what the ids under the mask decode to. Pieces go through a task as a sorted stream."""
    id_field = formatted.schema["id"]
    schema = T.StructType([id_field, *T.StructType.fromDDL("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").fields])
    dealt = formatted.repartition("id").sortWithinPartitions("id", "block", "piece").select("id", "ids", "loss")
    return dealt.mapInArrow(_read(formatted.sparkSession.sparkContext.broadcast(encoder), to_arrow_type(id_field.dataType)), schema)


def formatted_and_read(rows: DataFrame, encoder: Encoder, **columns) -> DataFrame:
    """Format, write ids and masks to a staged table, and read that back."""
    return read_back(staged(format_conversations(rows, encoder, **columns).drop("text"), "chats"), encoder)

from __future__ import annotations

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from menuspark.llm import sentencepieces as sp

pytestmark = pytest.mark.skipif(not os.path.exists(sp.MODEL), reason="no vocabulary file")


@pytest.fixture(scope="module")
def model():
    return sp.load()


def total(model, ids) -> float:
    """The score of a path: byte pieces come in whole characters."""
    number = {int(i): k for k, i in enumerate(model.ids)}
    score, run = 0.0, b""
    for i in [*map(int, ids), None]:
        if i is not None and i not in number:
            run += model.table[i]
            continue
        score += model.unknown * len(run.decode()) if run else 0.0
        run = b""
        score += float(model.scores[number[i]]) if i is not None else 0.0
    return score


def plain(model, text: str) -> float:
    """The best score by Viterbi over the whole text with a dictionary."""
    own = {model.table[int(i)].decode(): float(s) for i, s in zip(model.ids, model.scores)}
    text = ("▁" if text else "") + text.replace(" ", "▁")
    best = [0.0] + [float("-inf")] * len(text)
    for i in range(len(text)):
        if text[i] not in own:
            best[i + 1] = max(best[i + 1], best[i] + model.unknown)
        for j in range(i + 1, min(len(text), i + 16) + 1):
            if text[i:j] in own:
                best[j] = max(best[j], best[i] + own[text[i:j]])
    return best[-1]


TEXTS = ["", " ", "a", "  two  spaces ", "naïve größe\n\n\tEnd.\r\n", "日本語のテキスト 한국어", "emoji 😀😀 x‍", "\x00\x01", "the " * 50, "x" * 300, "ñandú-çà", "a\nb c", "  z", "0123456789" * 9]


def test_trie_holds_its_keys():
    rng = random.Random(1)
    keys = sorted({bytes(rng.choice(b"abc\xff\x00") for _ in range(rng.randrange(1, 6))) for _ in range(400)})
    trie = sp.DoubleArray(keys)

    def number(key):
        node = 0
        for c in key:
            to = int(trie.base[node]) + c
            if trie.check[to] != node:
                return -1
            node = to
        return int(trie.value[node])

    assert [number(k) for k in keys] == list(range(len(keys)))
    for _ in range(500):
        k = bytes(rng.choice(b"abcd\xff\x00") for _ in range(rng.randrange(1, 7)))
        assert (number(k) >= 0) == (k in keys)


def test_best_path_and_round_trip(model, spark, sf_dir):
    texts = TEXTS + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect()]
    for text, ids in zip(texts, model.encode([t.encode() for t in texts])):
        assert model.decode(ids.tolist()).decode() == text
        assert abs(total(model, ids) - plain(model, text)) < 1e-6
        assert [int(i) for i in ids] == [int(i) for i in sum((list(model.one(w.replace(b" ", sp.MARK))) for w in model.words.findall(model.spaced(text.encode()))), [])]


def test_equals_the_public_library(model):
    """The library's unigram model over the same pieces and scores finds paths of the same score."""
    spm = pytest.importorskip("sentencepiece")
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb.ModelProto()
    proto.ParseFromString(open(sp.MODEL, "rb").read())
    proto.trainer_spec.model_type = 1
    for i, s in zip(model.ids, model.scores):
        proto.pieces[int(i)].score = float(s)
    library = spm.SentencePieceProcessor(model_proto=proto.SerializeToString())
    for text in TEXTS:
        ids = model.encode([text.encode()])[0]
        other = library.encode(text)
        assert abs(total(model, ids) - total(model, other)) < 1e-2 * max(1, len(other)) ** 0.5
        assert library.decode([int(i) for i in ids]) == text


def test_frames(model, spark):
    rows = [(1, "Hello world", "a"), (2, None, "b"), (None, "", "c"), (3, "ab " * 40_000, "d"), (3, "ab " * 40_000, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = sp.encode(docs, model)
    assert out.columns == ["doc_id", "text", "ids", "pieces"]
    got = out.select("doc_id", "text", F.col("pieces.ids").alias("ids"), "pieces.n_pieces")
    back = sp.decode(got, model).collect()
    assert [r["decoded"] for r in back] == [r[1] or "" for r in rows]
    assert [r["n_pieces"] for r in back][1:3] == [0, 0]
    digest = sp.digests(docs, model).select("pieces.*", F.sha2(F.coalesce("text", F.lit("")), 256).alias("want")).collect()
    assert all(r["decoded_sha256"] == r["want"] for r in digest)
    assert sp.encode(docs.limit(0), model).count() == 0


def test_scores_of_the_file():
    model = sp.load(scores="file")
    ids = model.encode([b"hello there"])[0]
    assert model.decode(ids.tolist()) == b"hello there"


def test_long_words_are_cut_where_no_piece_reaches_across(model, monkeypatch):
    rng = random.Random(3)
    for _ in range(400):
        word = "".join(rng.choice("etaoinshr é漢字の\U0001F600") for _ in range(rng.randrange(20, 120))).replace(" ", "▁").encode()
        monkeypatch.setattr(sp, "CUT_BYTES", 1 << 20)
        parts = model._cut(word)
        assert b"".join(parts) == word
        monkeypatch.setattr(sp, "CUT_BYTES", 17)
        assert model._cut(word) == parts
        joined = [i for p in parts for i in model.one(p)]
        assert abs(total(model, joined) - total(model, model.one(word))) < 1e-9


def test_a_megabyte_line_without_spaces(model):
    rng = random.Random(5)
    lines = ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(350_000)), "".join(chr(rng.randrange(0xE01, 0xE3A)) for _ in range(350_000)), "".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000)), "\U0001F600" * 250_000]
    for line in lines:
        began = time.monotonic()
        ids = model.encode([line.encode()])[0]
        assert model.decode(ids.tolist()).decode() == line and time.monotonic() - began < 20
    assert model.held > 0


def test_the_cache_is_bounded_by_bytes(model, monkeypatch):
    monkeypatch.setattr(sp, "CACHE_BYTES", 20_000)
    for k in range(30):
        model.encode([" ".join(f"w{k}x{i}" * 3 for i in range(50)).encode()])
        assert model.held < 60_000 and len(model.cache) <= model.held // sp.WORD_BYTES

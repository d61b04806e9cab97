from __future__ import annotations

import hashlib
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from menuspark.llm import chat

needs = pytest.mark.skipif(not os.path.exists(chat.VOCABULARY), reason="no vocabulary file")
TEMPLATE = chat.Template()
NASTY = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "<|endoftext|>", "\\", "<", "[", "<\\/s>", "s>", " ", "é", "日本", "\n", "👍🏽", "a"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[ROLE]x</s>"]), st.lists(st.sampled_from(NASTY), max_size=12).map("".join))))
def test_rendering_is_undone(turns):
    rendered = "".join("".join(TEMPLATE.render(*x)) for x in turns)
    assert list(TEMPLATE.turns(rendered)) == turns
    for _, text in turns:
        assert not any(x in TEMPLATE.escape(text) for x in [*TEMPLATE.controls, *TEMPLATE.also_escaped])


@given(st.lists(st.integers(1, 4), min_size=1, max_size=40), st.data())
def test_mask_equals_the_loop(lengths, data):
    ends = np.cumsum(lengths)
    starts = ends - lengths
    cuts = sorted(data.draw(st.sets(st.integers(0, int(ends[-1])), max_size=10)))
    spans = np.array(list(zip(cuts[::2], cuts[1::2], strict=False)), np.int64).reshape(-1, 2)
    want = [any(a <= s and e <= b for a, b in spans) for s, e in zip(starts, ends, strict=True)]
    assert chat.loss_mask(starts, ends, spans).tolist() == want


def _want(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rows)
    loss = "".join(r[3] or "" for r in rows if r[2] == "assistant")
    chars = sum(len("".join(TEMPLATE.render(r[2] or "", r[3] or ""))) for r in rows)
    return len(rows), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars


@needs
def test_odd_conversations(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (1, None, None, None), (1, 0, "assistant", None), (1, 0, "assistant", None), (2, 5, "assistant", ""), (None, 1, "tool", "x"), (None, 2, "assistant", "y")]
    rows += [(3, -5000 + 3 * k, rng.choice(["user", "assistant", "tool"]), "".join(rng.choices(NASTY, k=9))) for k in range(4000)]
    rows += [(4, 0, "assistant", "".join(rng.choices(["word ", "日本 ", "  ", "</s>", "x"], k=60_000))), (4, 1, "assistant", "y" * 300_000), (4, 2, "user", "")]
    made = chat.Encoder.load()
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, id string, ids int")
    pieces = chat.format_conversations(table, made).collect()
    assert len([p for p in pieces if p["id"] == 3]) > 1 and all(made.decode(np.array(p["ids"], np.int64)) == p["text"] for p in pieces)
    whole = {p["id"]: p for p in pieces if p["id"] in (-7, 4)}
    for p in whole.values():  # encoding in parts gives the ids of the whole
        assert made.encode([p["text"]])[0][0].tolist() == p["ids"]
    got = {r["id"]: tuple(r)[1:] for r in chat.formatted_and_read(table, made).collect()}
    assert got == {k: _want([r for r in rows if r[0] == k]) for k in {r[0] for r in rows}}
    assert chat.formatted_and_read(table.limit(0), made).count() == 0

from __future__ import annotations

import os
import random
import time

import pytest

from menuspark.llm import warc


def archive(pages, packed=True):
    records = [warc.record("response", i, f"http://x/{i}", p) for i, p in pages]
    return [warc.member(r) if packed else r for r in records]


def recovered(data):
    return [(warc._number(x[3]["warc-record-id"]), warc.payload_of(x[4])[0]) for x in warc.salvage(data) if x[0] == "record"]


def covered(data):
    """Records and gaps lie end to end."""
    at = 0
    for start, end in sorted({(x[1], x[2]) for x in warc.salvage(data)}):
        assert data[at:start].strip(b"\r\n") == b"" and start >= at
        at = end
    return data[at:].strip(b"\r\n") == b""


@pytest.mark.parametrize("packed", [True, False])
def test_every_damage_loses_only_its_record(packed):
    rng = random.Random(3)
    pages = [(i, bytes(rng.choice(b"abc <>\r\n") for _ in range(rng.randrange(0, 400)))) for i in range(8)]
    parts = archive(pages, packed)
    assert recovered(b"".join(parts)) == pages and not [x for x in warc.salvage(b"".join(parts)) if x[0] == "gap"]
    for k in range(8):
        for damage in ("cut", "flip", "junk", "head"):
            own = list(parts)
            if damage == "cut":
                own[k] = own[k][: len(own[k]) // 2]
            elif damage == "flip":
                at = len(own[k]) - 12 if packed else own[k].index(b"HTTP/1.1") + 3
                own[k] = own[k][:at] + bytes([own[k][at] ^ 0x55]) + own[k][at + 1 :]
            elif damage == "junk":
                own[k] = b"\x1f\x8b\x08 WARC/1.1\r\nno " + own[k]
            else:
                own[k] = b"xx" + own[k][2:]
            data = b"".join(own)
            want = [p for i, p in enumerate(pages) if i != k or damage == "junk"]
            assert recovered(data) == want
            gaps = [x for x in warc.salvage(data) if x[0] == "gap"]
            assert len(gaps) == 1 and gaps[0][3] and covered(data)


def test_no_records():
    assert list(warc.salvage(b"")) == []
    assert [(x[0], x[1], x[2]) for x in warc.salvage(b"no archive")] == [("gap", 0, 10)]
    assert [(x[0], x[1], x[2]) for x in warc.salvage(b"\x1f\x8b\x08")] == [("gap", 0, 3)]


def test_write_and_read(spark, tmp_path):
    pages = [(1, "http://a", "same"), (5, "http://b\n", "same"), (3, None, "same"), (7, "u", None), (8, "u", ""), (9, "é", "größe " * 50_000), (9, "é", "größe " * 50_000), (None, "n", "same"), (10, "u", "alone")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("n", __import__("pyspark").sql.functions.lit(1))
    manifest = warc.write_archives(warc.plan(df), f"file://{tmp_path}/out", archive_bytes=200)
    got = {}
    for r in warc.read_archives(manifest, payload=True, tasks=2).collect():
        assert r["kind"] == "record" and r["reason"] is None
        got.setdefault(r["page_id"], []).append((r["warc_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], bytes(r["payload"])))
    text = {i: (t or "").encode() for i, _, t in pages}
    want = {1: ("revisit", 5), 3: ("revisit", 5), 5: ("response", None), 7: ("revisit", 8), 8: ("response", None), 9: ("response", None), None: ("response", None), 10: ("response", None)}
    assert got.keys() == want.keys() and len(got[9]) == 2
    for i, rows in got.items():
        for r in rows:
            assert r == (*want[i], len(text[i]), warc.sha1_base32(text[i]), b"" if want[i][0] == "revisit" else text[i])
    assert manifest.count() > 2
    # The same folder through Spark's reader, with one archive damaged.
    name = sorted(os.listdir(tmp_path / "out"))[0]
    data = (tmp_path / "out" / name).read_bytes()
    (tmp_path / "out" / name).write_bytes(b"damage" + data)
    found = warc.read_warc(spark, f"file://{tmp_path}/out").collect()
    assert sum(r["kind"] == "record" for r in found) == len(pages)
    assert [(r["start"], r["end"], r["reason"]) for r in found if r["kind"] == "gap"] == [(0, 6, "no version line")]
    empty = warc.write_archives(warc.plan(df.limit(0)))
    assert empty.count() == 0 and warc.read_archives(empty).count() == 0


@pytest.mark.parametrize("step,kept", [(1 << 20, 64 << 20), (512, 0)])
def test_damage_in_a_member_of_many_records(monkeypatch, step, kept):
    monkeypatch.setattr(warc, "STEP_BYTES", step)
    monkeypatch.setattr(warc, "KEPT_BYTES", kept)
    rng = random.Random(5)
    pages = [(i, rng.randbytes(rng.randrange(0, 3_000))) for i in range(12)]
    records = archive(pages, packed=False)
    whole, after = warc.member(b"".join(records)), warc.member(warc.record("response", 99, "http://x/99", b"after"))
    assert recovered(whole + after) == [*pages, (99, b"after")] and covered(whole + after)
    # A bad record inside a sound member.
    bad = list(records)
    bad[4] = bad[4].replace(b"HTTP/1.1", b"HTTX/1.1")
    bad[7] = bad[7][: len(bad[7]) // 2]
    data = warc.member(b"".join(bad)) + after
    assert recovered(data) == [p for p in pages if p[0] not in (4, 7)] + [(99, b"after")]
    gaps = [x for x in warc.salvage(data) if x[0] == "gap"]
    assert len(gaps) == 2 and all("plain bytes" in x[3] for x in gaps) and covered(data)
    # A wrong CRC, a cut tail and a flipped byte lose nothing before them.
    wrong = whole[:-8] + bytes([whole[-8] ^ 1]) + whole[-7:]
    assert recovered(wrong + after) == [*pages, (99, b"after")] and [x[3] for x in warc.salvage(wrong + after) if x[0] == "gap"] == ["broken gzip member"]
    for data in (whole[: len(whole) * 2 // 3], whole[: len(whole) // 2] + b"\xff" * 40 + whole[len(whole) // 2 + 40 :]):
        for tail in (b"", after):
            got = recovered(data + tail)
            own = got[:-1] if tail else got
            assert len(own) >= 4 and [p for p in pages if p in own] == own and (not tail or got[-1] == (99, b"after"))
            assert any(x[0] == "gap" for x in warc.salvage(data + tail))
    # Stored bytes show the version lines as well: each record comes once.
    packer = __import__("zlib").compressobj(0, 8, 31)
    stored = packer.compress(b"".join(records)) + packer.flush()
    assert recovered(stored[:-8] + b"12345678" + after) == [*pages, (99, b"after")]


def test_time_grows_with_the_archive():
    def seconds(data):
        began = time.process_time()
        n = sum(x[0] == "record" for x in warc.salvage(data))
        return n, time.process_time() - began

    parts = archive([(i, os.urandom(1200)) for i in range(16_000)])
    seconds(b"".join(parts[:200]))
    (n, few), (m, many) = seconds(b"".join(parts[:2000])), seconds(b"".join(parts))
    assert (n, m) == (2000, 16_000) and many < 16 * few + 1
    # What begins like records or members but is none costs little each.
    for junk in (b"WARC/1.0\r\n", b"WARC/1.1\r\nA: b\r\n", b"\x1f\x8b\x08\0\0\0\0\0\0\0"):
        n, took = seconds(junk * 50_000 + parts[0])
        assert n == 1 and took < 20


def test_a_record_that_is_gone_fails_the_job(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in range(20)], "page_id long, url string, html string")
    manifest = warc.write_archives(warc.plan(pages.coalesce(1)), f"file://{tmp_path}/out")
    name = os.listdir(tmp_path / "out")[0]
    data = (tmp_path / "out" / name).read_bytes()
    (tmp_path / "out" / name).write_bytes(data[: len(data) - 30])
    with pytest.raises(Exception, match="of the manifest's"):
        warc.read_archives(manifest).count()
    assert warc.read_archives(manifest, whole=False).filter("kind = 'record'").count() == 19

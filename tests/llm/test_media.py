from __future__ import annotations

import hashlib
import io
import random
import zlib

import numpy as np
import pytest

from menuspark.llm import media


def test_netpbm_forms():
    grey = np.array([[0, 7, 255], [3, 4, 5]], np.uint8)
    assert (media.decode(b"P5\n# note\n3 2\n255\n" + grey.tobytes()) == grey).all()
    assert (media.decode(b"P2 3 2 # x\n255\n0 7 255\n3 4 5") == grey).all()
    colour = np.arange(12, dtype=np.uint8).reshape(2, 2, 3)
    assert (media.decode(b"P6 2 2 255 " + colour.tobytes()) == colour).all()
    assert (media.decode(b"P3 2 2 255 " + b" ".join(b"%d" % x for x in range(12))) == colour).all()
    assert (media.decode(b"P1 3 2 1 0 1 011") == np.array([[0, 255, 0], [255, 0, 0]])).all()
    assert (media.decode(b"P4 3 2\n\xa0\x60") == np.array([[0, 255, 0], [255, 0, 0]])).all()
    wide = np.array([[1, 65535]], np.uint16)
    assert (media.decode(b"P5 2 1 65535 " + wide.astype(">u2").tobytes()) == wide).all()
    pam = b"P7\nWIDTH 2\nHEIGHT 2\nDEPTH 3\nMAXVAL 255\nTUPLTYPE RGB\nENDHDR\n" + colour.tobytes()
    assert (media.decode(pam) == colour).all()


def test_bmp_forms():
    rng = np.random.default_rng(0)
    for shape in ((3, 5), (4, 7, 3), (1, 1)):
        image = rng.integers(0, 256, shape, np.uint8)
        back = media.decode(media.encode_bmp(image))
        assert (back == (image if image.ndim == 3 else image[:, :, None])).all()
    import struct

    pixels = bytes([0, 1, 1, 0, 1, 0, 0, 0])  # two rows of three, padded to four, lowest first
    palette = bytes([10, 10, 10, 0, 200, 200, 200, 0])
    raw = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 70, 0, 0, 62, 40, 3, 2, 1, 8, 0, 8, 0, 0, 2, 0) + palette + pixels
    assert media.decode(raw).tolist() == [[200, 10, 10], [10, 200, 200]]


@pytest.mark.parametrize("raw", [b"", b"P5", b"P5\n3 3\n255\nab", b"BM" + b"\0" * 60, b"GIF89a", b"P5\nx 3\n255\n", b"P7\nENDHDR\n", b"P2 2 1 255 9"])
def test_broken(raw):
    with pytest.raises(media.MediaError):
        media.decode(raw)


def plain_resize(image, width, height):
    out = np.zeros((height, width))
    h, w = image.shape
    for i in range(height):
        for j in range(width):
            y0, y1, x0, x1 = i * h / height, (i + 1) * h / height, j * w / width, (j + 1) * w / width
            for y in range(h):
                for x in range(w):
                    out[i, j] += image[y, x] * max(0, min(y1, y + 1) - max(y0, y)) * max(0, min(x1, x + 1) - max(x0, x)) / ((y1 - y0) * (x1 - x0))
    return out


def test_resize_and_hash():
    rng = np.random.default_rng(3)
    for h, w in ((1, 1), (2, 3), (9, 8), (13, 17)):
        image = rng.integers(0, 256, (h, w), np.uint8)
        for size in ((9, 8), (4, 4), (1, 1)):
            assert np.allclose(media.resize(image, *size), plain_resize(image, *size))
        cells = plain_resize(image, 9, 8).round(9)
        want = sum(1 << (63 - (i * 8 + j)) for i in range(8) for j in range(8) if cells[i, j] > cells[i, j + 1])
        assert media.difference_hash(image) == want
    assert np.load(io.BytesIO(media.tile(image))).shape == (16, 16)


def test_texts_come_back(spark):
    rng = random.Random(1)
    texts = [None, "", "a", "é" * 288, "é" * 289, "x" * 576, "".join(rng.choice("abc \n") for _ in range(50_000))]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate([*texts, texts[-1]])], "doc_id long, text string, media int")
    got = {r["id"]: r for r in media.with_feature(media.read_texts(media.store_texts(docs))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        stored = media.encode_pgm(media.text_image(raw))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert got[0].asDict() | {"id": 1} == got[1].asDict() and got[6].asDict() | {"id": 7} == got[7].asDict()
    assert media.read_texts(media.store_texts(docs.limit(0))).count() == 0


def test_describe(spark):
    image = np.arange(48, dtype=np.uint8).reshape(6, 8)
    rows = [(1, media.encode_pgm(image)), (2, media.encode_bmp(image)), (3, None), (4, b""), (4, b"junk")]
    out = media.describe(spark.createDataFrame(rows, "width int, media binary")).select("width", "image").collect()
    assert [r["image"]["width"] for r in out] == [8, 8, None, None, None] and [r["width"] for r in out] == [1, 2, 3, 4, 4]
    assert [r["image"]["channels"] for r in out[:2]] == [1, 3] and all(r["image"]["error"] for r in out[2:])
    assert np.load(io.BytesIO(out[0]["image"]["tile"])).dtype == np.uint8
    assert out[0]["image"]["dhash"] == "0" * 16 == out[1]["image"]["dhash"]

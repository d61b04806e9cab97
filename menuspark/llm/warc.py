"""WARC archives: a writer with identical-payload revisits, and a salvage reader.

The writer puts a gzip member around each record and starts a new archive every ``ARCHIVE_BYTES``. Which page of equal payloads
is the response is settled before, from digests alone. Attempts write under names of their own and the written files are
known from the manifest that the job returns, so a repeated task leaves at most an unlisted file.

The reader checks each record: the member's CRC, version line, header, length and block digest. Where a check fails it
searches for the next gzip member or version line that passes all of them, recovers the records from there, and logs the bytes
between as a quarantined gap. The same goes for the plain bytes of a gzip member: it is unpacked in steps, and one that breaks
gives the records before its damage. Gaps inside a member name its plain bytes.
"""

from __future__ import annotations

import base64
import hashlib
import io
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import as_bytes, filesystem, join_counted, new_folder, staged

ARCHIVE_BYTES, FIRST_BYTES, STEP_BYTES, KEPT_BYTES, LEVEL, DATE = 16 << 20, 4096, 1 << 20, 64 << 20, 1, "1970-01-01T00:00:00Z"
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, page: int | None, uri: str | None, payload: bytes, refers_to: int | None = None, digest: str | None = None) -> bytes:
    """One record. A revisit's block is the HTTP header alone, whose Content-Length is the full payload's."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'-' if page is None else page}>", f"WARC-Date: {DATE}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
    head += [f"WARC-Payload-Digest: sha1:{digest or sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {_IDENTICAL}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Broken(ValueError):
    """A record or member that fails a check. ``needs``: with so many bytes from its start it could be told."""

    def __init__(self, reason: str, needs: int = 0):
        super().__init__(reason)
        self.needs = needs


def _open_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at a place, all checks passed."""
    if not _VERSION.match(data, at):
        raise Broken("no version line", 10 if len(data) - at < 10 else 0)
    head: dict[str, str] = {}
    # Line by line: what isn't a header is left at its first odd line, so a search over many version lines stays linear.
    end = data.find(b"\r\n", at)
    while True:
        next_ = data.find(b"\r\n", end + 2)
        if next_ < 0:
            raise Broken("header without an end", len(data) - at + 1)
        if next_ == end + 2:
            break
        name, colon, value = data[end + 2 : next_].partition(b":")
        if not colon:
            raise Broken("header line without a colon")
        name = name.strip().lower().decode("utf-8", "replace")
        if name in head and name != "warc-concurrent-to":
            raise Broken("repeated header line")  # a cut header that runs into the next record's
        head[name] = value.strip().decode("utf-8", "replace")
        end = next_
    size = head.get("content-length", "")
    if not size.isdigit() or "warc-type" not in head:
        raise Broken("no length or type")
    block = data[end + 4 : end + 4 + int(size)]
    stop = end + 4 + int(size)
    if len(block) < int(size) or data[stop : stop + 4] != b"\r\n\r\n":
        raise Broken("wrong length", stop + 4 - at if stop + 4 > len(data) else 0)
    digest = head.get("warc-block-digest", "")
    if digest.lower().startswith("sha1:") and digest[5:].upper() != sha1_base32(block):
        raise Broken("wrong block digest")
    return head, block, stop + 4


def _last_bytes(unpacker, piece: bytes) -> tuple[bytes, int]:
    """What a step that fails gives before it fails, and how many bytes it reads for that."""
    out, used = [], 0
    for size in (4096, 1):
        for i in range(0, len(piece), size):
            saved = unpacker.copy()
            try:
                out.append(unpacker.decompress(piece[i : i + size]))
            except zlib.error:
                unpacker, piece, used = saved, piece[i : i + size], used + i
                break
    try:
        while True:
            out.append(unpacker.decompress(piece, 1))
            piece = unpacker.unconsumed_tail
            if not out[-1] and not piece:
                break
    except zlib.error:
        pass
    return b"".join(out), used + 1


def _unpack(data: bytes, at: int) -> Iterator[tuple[bytes, int, str | None]]:
    """(plain bytes, place, None) of the gzip member at a place, in steps; the last has the member's end and what broke it, or ""."""
    view, unpacker, place, size = memoryview(data), zlib.decompressobj(31), at, min(FIRST_BYTES, STEP_BYTES)
    while True:
        piece = view[place : place + size]  # small at first: what a short member leaves unread is copied
        size = min(2 * size, STEP_BYTES)
        saved = unpacker.copy() if place > at else zlib.decompressobj(31)
        try:
            plain = unpacker.decompress(piece, STEP_BYTES)
        except zlib.error:
            plain, used = _last_bytes(saved, bytes(piece))
            yield plain, place + used, "broken gzip member"
            return
        place += len(piece) - len(unpacker.unconsumed_tail) - len(unpacker.unused_data)
        if unpacker.eof or not (plain or piece):
            yield plain, place, "" if unpacker.eof else "gzip member without an end"
            return
        yield plain, place, None


def _inner(steps: Iterator[bytes], total: int) -> Iterator[tuple[dict[str, str] | str, bytes | None]]:
    """(headers, block) of the records in a member's ``total`` plain bytes, and (reason, None) of the gaps between."""
    data, base, at, gap, reason = bytearray(), 0, 0, None, ""

    def more(least: int) -> bool:
        """Reads on until ``least`` bytes from the place are there, if the member has so many."""
        nonlocal data, base, at
        if base + at + least > total or base + len(data) >= total:
            return False
        data, base, at = data[at:], base + at, 0
        wanted = max(least, 2 * len(data))
        while len(data) < wanted and (step := next(steps, None)) is not None:
            data += step
        return True

    while base + at < total:
        try:
            head, block, end = _open_record(data, at)
        except Broken as e:
            if e.needs and more(e.needs):
                continue
            if gap is None:
                if data[at : at + 1] in (b"\r", b"\n"):
                    at += 1
                    continue
                gap, reason = base + at, str(e)
            m = _VERSION.search(data, at + 1)
            at = m.start() if m else max(at + 1, len(data) - 9)
            if at >= len(data):
                more(1)
            continue
        if gap is not None:
            yield f"{reason}: plain bytes {gap} to {base + at}", None
            gap = None
        yield head, bytes(block)
        at = end
    if gap is not None:
        yield f"{reason}: plain bytes {gap} to {total}", None


def _open_member(data: bytes, at: int) -> tuple[Iterator[tuple[dict[str, str] | str, bytes | None]], int, str]:
    """The records and gaps of the gzip member at a place, its end, and what broke it, or "". A member of more than
    ``KEPT_BYTES`` is unpacked again for its records, step by step."""
    kept, total = [], 0
    for plain, end, broken in _unpack(data, at):
        total += len(plain)
        if total <= KEPT_BYTES:
            kept.append(plain)
    found = _inner(iter(kept) if total <= KEPT_BYTES else (plain for plain, *_ in _unpack(data, at)), total)
    first = []  # up to the first record
    for x in found:
        first.append(x)
        if x[1] is not None:
            return itertools.chain(first, found), end, broken
    raise Broken(broken or (first[0][0].split(":")[0] if first else "empty gzip member"))


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict[str, str] | str, bytes]]:
    """("record", start, end, headers, block) and ("gap", start, end, reason of its first failure, b"") in file order. The
    gaps and the records' places cover the file but for blank bytes between records. What a gzip member holds has the
    member's place; the records of a broken one lie in its gap."""
    at, gap, reason, unpacked = 0, None, "", 0
    while at < len(data):
        broken = ""
        try:
            if data[at : at + 3] == b"\x1f\x8b\x08":
                found, end, broken = _open_member(data, at)
            else:
                if at < unpacked:
                    raise Broken("inside a gzip member")  # a stored version line, whose record has been read
                head, block, end = _open_record(data, at)
                found = [(head, block)]
        except Broken as e:
            if gap is None:
                blank = len(data[at : at + 4096]) - len(data[at : at + 4096].lstrip(b"\r\n"))
                if blank:
                    at += blank
                    continue
                gap, reason = at, str(e)
            m = _START.search(data, at + 1)
            at = m.start() if m else len(data)
            continue
        if gap is not None:
            yield "gap", gap, at, reason, b""
            gap = None
        for head, block in found:
            yield ("gap", at, end, head, b"") if block is None else ("record", at, end, head, block)
        if broken:
            # Where the member really ends isn't known, so the search goes on inside it.
            gap, reason, unpacked = at, broken, max(unpacked, end)
            m = _START.search(data, at + 1)
            at = m.start() if m else len(data)
        else:
            at = end
    if gap is not None:
        yield "gap", gap, len(data), reason, b""


def payload_of(block: bytes) -> tuple[bytes, int | None]:
    """The payload of an HTTP block, and the length its header states."""
    if not block.startswith(b"HTTP/"):
        return block, None
    head, _, payload = block.partition(b"\r\n\r\n")
    m = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", head.replace(b"\r\n", b"\n"))
    return payload, int(m[1]) if m else None


def _number(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


FOUND = "kind string, path string, start long, end long, reason string, warc_type string, page_id long, refers_to long, uri string, payload_bytes long, payload_digest string, payload binary"


def _rows(path: str, data: bytes, with_payload: bool) -> Iterator[tuple]:
    for kind, start, end, head, block in salvage(data):
        if kind == "gap":
            yield kind, path, start, end, head, None, None, None, None, None, None, None
            continue
        payload, stated = payload_of(block)
        type_, known = head["warc-type"], head.get("warc-payload-digest", "").rpartition(":")[2]
        revisit = type_ == "revisit"
        size, digest = (stated, known) if revisit else (len(payload), sha1_base32(payload))
        reason = None if revisit or not known or known.upper() == digest else "wrong payload digest"
        yield kind, path, start, end, reason, type_, _number(head.get("warc-record-id")), _number(head.get("warc-refers-to")), head.get("warc-target-uri"), size, digest, payload if with_payload else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    s, i, b = pa.string(), pa.int64(), pa.binary()
    kinds = (s, s, i, i, s, s, i, i, s, i, s, b)
    names = [x.split()[0] for x in FOUND.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def _read(with_payload: bool, content: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, count = batch.column(0)[i].as_py(), 0
                if content:
                    data = batch.column(1)[i].as_py() or b""
                else:
                    system, place = filesystem(path)
                    with system.open_input_file(place) as f:
                        data = f.read()
                rows: list[tuple] = []
                size = 0
                for row in _rows(path, data, with_payload):
                    rows.append(row)
                    count += row[0] == "record"
                    size += len(row[-1] or b"") + 500
                    if size > 8 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                yield _batch(rows)
                stated = None if content else batch.column(1)[i].as_py()
                if stated is not None and stated != count:
                    raise RuntimeError(f"{path}: {count} of the manifest's {stated} records were read")

    return run


def read_archives(manifest: DataFrame, *, payload: bool = False, tasks: int | None = None, whole: bool = True) -> DataFrame:
    """Records and gaps of the archives that a manifest lists (path, records), each read by one task in turn. Rows of kind
    "record" have the type, ids, payload's length and digest (and the payload if asked for); rows of kind "gap" are the
    quarantine log. With ``whole`` the job fails if an archive doesn't give as many records as the manifest states."""
    paths = manifest.select("path", (F.col("records") if whole else F.lit(None)).cast("long").alias("records"))
    return (paths.repartition(tasks) if tasks else paths).mapInArrow(_read(payload, False), FOUND)


def read_warc(spark: SparkSession, path: str, *, payload: bool = True) -> DataFrame:
    """The same for any WARC files under a path that Spark can read; a file is read whole, so up to Spark's 2 GB."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_read(payload, True), FOUND)


def plan(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(id, url, payload, refers_to): refers_to is null for a response. Of rows with equal payloads (null: empty) that with
    the largest id is the response and the others revisit it; rows that repeat that id, and rows without an id, are
    responses as well."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    keys = staged(rows.select("id", "digest"), "payload-digests")
    groups = staged(keys.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1"), "payload-groups")
    total = keys.count()
    revisits = staged(join_counted(keys, groups, "digest", total).filter("id != refers_to").distinct(), "revisits")
    return rows.join(revisits, ["id", "digest"], "left").select("id", "url", "payload", "refers_to")


def _write(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = filesystem(folder)
        out, count, listed = io.BytesIO(), 0, []

        def close():
            nonlocal out, count
            if count:
                name = f"part-{uuid.uuid4().hex}.warc.gz"
                system.create_dir(place, recursive=True)
                with system.open_output_stream(f"{place}/{name}", compression=None) as f:
                    f.write(out.getbuffer())
                listed.append((f"{folder}/{name}", count, out.tell()))
            out, count = io.BytesIO(), 0

        for batch in batches:
            payloads = as_bytes(batch.column(2))
            for page, url, payload, ref in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), payloads, batch.column(3).to_pylist()):
                out.write(member(record("response" if ref is None else "revisit", page, url, payload, ref)))
                count += 1
                if out.tell() >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in listed], pa.string()), pa.array([x[1] for x in listed], pa.int64()), pa.array([x[2] for x in listed], pa.int64())], ["path", "records", "bytes"])

    return run


def write_archives(planned: DataFrame, folder: str | None = None, *, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write what ``plan`` gives as .warc.gz files in a folder (a new one in the shared folder if none is given); returns the
    staged manifest (path, records, bytes)."""
    folder = folder or new_folder(planned.sparkSession, "warc")
    return staged(planned.select("id", "url", "payload", "refers_to").mapInArrow(_write(folder, archive_bytes), "path string, records long, bytes long"), "warc-manifest")

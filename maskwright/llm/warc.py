"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle is a run of frames with a seek table appended as a skippable
frame (the public seekable format: sizes of each frame, then a footer), so any Zstandard reader decompresses a bundle whole
and a seeking reader touches one frame. An index maps each record identifier to (bundle, frame, offset within the frame).

Of records with equal payloads (of at least ``least`` bytes) the one with the largest page_id is a *response*, others are
*revisit* records that refer to it and carry no payload. Equality is by SHA-256 and length. Only (page_id, digest) pairs meet
by digest, with counts combined before the shuffle and the rows of a frequent payload dealt among tasks; payloads are dealt by
page_id, so that thousands of copies of one payload never land in one task.

Bundles are rows of a Parquet table in the shared folder: Spark's own writer puts them there, whatever the store, and a task
that is run again replaces its own files alone.

Null html: an empty payload. Null url: no target header. Null page_id: a record without an identifier. Rows that repeat
page_id and payload are each a response. Equal payloads under the largest page_id more than once: each of these is a response.
Empty table: no bundle, empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.workspace import hot_join, stage

_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_BUNDLES = "bundle string, data binary, page_id array<long>, frame array<int>, offset array<int>"
_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    body = b""
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    else:
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
        head.append("Content-Type: application/http; msgtype=response")
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(frame: bytes, at: int) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of the record that starts at ``at``; raises if the payload differs from its digest."""
    stop = frame.index(b"\r\n\r\n", at)
    lines = frame[at:stop].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    head = dict(x.split(": ", 1) for x in lines[1:])
    n = int(head["Content-Length"])
    body = frame[stop + 4 : stop + 4 + n]
    if len(body) != n or frame[stop + 4 + n : stop + 8 + n] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} is cut off")
    payload = body[body.index(b"\r\n\r\n") + 4 :] if n else b""
    if head["WARC-Type"] == "response":
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if head["WARC-Payload-Digest"] != f"sha1:{digest}" or int(head["X-Payload-Length"]) != len(payload):
            raise ValueError(f"the payload of {head.get('WARC-Record-ID')} differs from its digest")
    return head, payload


def close_bundle(frames: list[tuple[bytes, int]]) -> bytes:
    """Compressed frames with their uncompressed sizes, and the seek table in a skippable frame after them."""
    table = b"".join(struct.pack("<II", len(data), n) for data, n in frames) + struct.pack("<IBI", len(frames), 0, _SEEKABLE)
    return b"".join(data for data, _ in frames) + struct.pack("<II", _SKIPPABLE, len(table)) + table


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, size) of each frame, read from the footer."""
    count, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != _SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    at, out = 0, []
    base = len(bundle) - 9 - count * width
    for k in range(count):
        packed, size = struct.unpack_from("<II", bundle, base + k * width)
        out.append((at, packed, size))
        at += packed
    return out


def _write(batches: Iterator[pa.RecordBatch], frame_bytes: int, bundle_bytes: int, level: int) -> Iterator[pa.RecordBatch]:
    import zstandard

    press = zstandard.ZstdCompressor(level=level, write_checksum=True)
    frames: list[tuple[bytes, int]] = []
    raw, held = bytearray(), 0
    index: list[tuple[int | None, int, int]] = []

    def end_frame() -> None:
        nonlocal held
        if raw:
            data = press.compress(bytes(raw))
            frames.append((data, len(raw)))
            held += len(data)
            raw.clear()

    def end_bundle() -> Iterator[pa.RecordBatch]:
        nonlocal held
        end_frame()
        if frames:
            ids, nos, offsets = zip(*index, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().hex]), pa.array([close_bundle(frames)], pa.binary()), pa.array([ids], pa.list_(pa.int64())), pa.array([nos], pa.list_(pa.int32())), pa.array([offsets], pa.list_(pa.int32()))],
                names=["bundle", "data", "page_id", "frame", "offset"],
            )
            frames.clear()
            index.clear()
            held = 0

    for batch in batches:
        for k in range(batch.num_rows):
            page_id, url, payload, refers_to, revisit = (batch.column(j)[k].as_py() for j in range(5))
            index.append((page_id, len(frames), len(raw)))
            raw += record(page_id, url, payload, refers_to, revisit)
            if len(raw) >= frame_bytes:
                end_frame()
                if held >= bundle_bytes:
                    yield from end_bundle()
    yield from end_bundle()


def write_archives(pages: DataFrame, least: int = 0, frame_bytes: int = 1 << 18, bundle_bytes: int = 8 << 20, level: int = 3) -> DataFrame:
    """Bundles (bundle, data) with their index (page_id, frame, offset: arrays), staged in the shared folder."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    keyed = rows.withColumn("digest", F.concat(F.sha2("payload", 256), F.lit("-"), F.octet_length("payload")))
    narrow = keyed.filter(F.octet_length("payload") >= least).select("page_id", "digest")
    first = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    first = stage(first, "payloads")
    again = hot_join(narrow, first, "digest", "n", ["page_id"]).filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to").distinct()
    marked = keyed.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    shaped = marked.select("page_id", "url", "payload", "refers_to", F.col("d").isNotNull().alias("revisit"))
    return stage(shaped.mapInArrow(functools.partial(_write, frame_bytes=frame_bytes, bundle_bytes=bundle_bytes, level=level), _BUNDLES), "warc")


def _read(batches: Iterator[pa.RecordBatch], wanted: bool = False) -> Iterator[pa.RecordBatch]:
    import zstandard

    unpress = zstandard.ZstdDecompressor()
    number = lambda x: int(x.removeprefix("<urn:page:").removesuffix(">")) if x else None
    for batch in batches:
        for k in range(batch.num_rows):
            bundle = batch.column(1)[k].as_py()
            table, now, frame, out = seek_table(bundle), -1, b"", []
            for no, at in zip(batch.column(3)[k].as_py(), batch.column(4)[k].as_py(), strict=True):
                if no != now:
                    start, packed, size = table[no]
                    frame, now = unpress.decompress(bundle[start : start + packed], max_output_size=size), no
                head, payload = parse(frame, at)
                out.append((number(head.get("WARC-Record-ID")), int(head["X-Payload-Length"]), head["WARC-Payload-Digest"][5:], head["WARC-Type"], number(head.get("WARC-Refers-To")), payload))
            cols = list(zip(*out, strict=True))
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=False)]
            if wanted:
                arrays, names = [*arrays, pa.array(cols[5], pa.binary())], [*names, "payload"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)


def read_archives(bundles: DataFrame, with_payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (and payload) of every record, by seeking."""
    return bundles.select("bundle", "data", "page_id", "frame", "offset").mapInArrow(functools.partial(_read, wanted=with_payload), _READ + ", payload binary" * with_payload)


def index(bundles: DataFrame) -> DataFrame:
    """A row for each record: page_id, bundle, frame, offset."""
    return bundles.select("bundle", F.inline(F.arrays_zip("page_id", "frame", "offset"))).select("page_id", "bundle", "frame", "offset")


def fetch(bundles: DataFrame, ids: DataFrame) -> DataFrame:
    """The records whose page_id is in ``ids`` (a column page_id); of each bundle only the frames that hold them are read."""
    at = index(bundles).join(ids.select("page_id").distinct(), "page_id", "left_semi").groupBy("bundle").agg(F.array_sort(F.collect_list(F.struct("frame", "offset", "page_id"))).alias("hits"))
    chosen = bundles.select("bundle", "data").join(at, "bundle")
    return read_archives(chosen.select("bundle", "data", F.col("hits.page_id").alias("page_id"), F.col("hits.frame").alias("frame"), F.col("hits.offset").alias("offset")), True)

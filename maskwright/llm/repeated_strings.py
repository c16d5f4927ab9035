"""Exact removal of repeated strings by bucket-pointer refinement.

A byte goes if a string of ``length`` bytes that covers it also starts earlier (smaller doc_id, or the same text further left).
That needs no full suffix array, only the order of suffixes up to ``length`` bytes, and of that only who shares a bucket:

* Bucket pointers of all suffixes for q = 32 bytes come from those for 16, these from 8, and so on: the pointer of a suffix is
  a function of its own pointer and that of the suffix q/2 further on, so each level reuses what the one before has set.
* A suffix of ``length`` bytes is sampled by the least q-gram pointer inside it: equal strings have the same. Neighbouring
  suffixes mostly share it, so a run of suffixes with one least pointer is one entry of the initial buckets. An entry in which
  that pointer stands twice may repeat itself, and is marked.
* Refinement sorts the entries of a bucket by the pointers at later offsets (0, 32, 64, length - 32 of the run's first and last
  suffix). Equal entries are repeats of the first of them as a whole. Entries that differ, but share their initial bucket, may
  still have suffixes in common: only these, and marked ones, are taken apart into single suffixes and sorted once more.

A bucket with one entry is done at once; that is nearly all of a text that does not repeat. Each task settles repeats within
what it has read before anything is shuffled, so thousands of copies leave a task as a few entries. A bucket's single suffixes
go to one task, next to each other, which compresses them well; those of a bucket with many entries are dealt among several by
their later pointers. Sorting, spilling and joining are Spark's; no bucket has to fit memory. Texts travel compressed.

Suffixes are told apart by 52 bits of their least q-gram and 64 bits of their later pointers together. The identifier of a bucket
is a hash of what its suffixes begin with and not its rank, so that tasks agree on it without a sort of all suffixes.

Null text: empty. Texts under ``length`` bytes: nothing removed. Null doc_id: before all others. Equal rows are one text given more
than once, and cut alike. Different texts under one doc_id, or none, are texts of their own, in the order of a hash. Empty table:
empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.textblocks import blocks, mix
from maskwright.llm.workspace import ranked, stage

_Q = 32
_SEGMENT = 2 << 20
_NULL_ID = -(2**63)
_SEEDS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS = mix(np.arange(1, 9, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
_ENTRY = "bucket long, later long, doc_id long, lo int, n int"
_LOCAL_ROWS = 1_000_000
_PLACE = np.uint64(0xFFF)
_TWICE = 1024
_BUCKET_ROWS = 64


def pointers(data: np.ndarray) -> np.ndarray:
    """Bucket pointers of every 32-byte string of ``data``, each level from the one of half its length."""
    h = _SEEDS[data]
    n, level = 1, 0
    while n < _Q:
        h = h[:-n] * _FACTORS[level] + h[n:] if len(h) > n else h[:0]
        h ^= h >> np.uint64(32)
        n, level = 2 * n, level + 1
    return h


def _later(h: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The pointers that cover ``length`` bytes from ``at`` on, as one."""
    out = h[at]
    for k in [*range(_Q, length - _Q, _Q), length - _Q]:
        out = mix(out * _FACTORS[6] + h[at + k])
    return out


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    n = 1
    while 2 * n <= width:
        h = np.minimum(h[:-n], h[n:]) if len(h) > n else h[:0]
        n *= 2
    rest = width - n
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def _segments(ids: list[int], texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(ids, offsets, pieces) of at most about a segment; a long text's pieces overlap by all but one byte of a string."""
    held: tuple[list[int], list[int], list[bytes]] = ([], [], [])
    size = 0
    for doc_id, text in zip(ids, texts, strict=True):
        for at in range(0, max(len(text) - length + 1, 0), _SEGMENT):
            piece = text[at : at + _SEGMENT + length - 1]
            if size and size + len(piece) > _SEGMENT:
                yield held
                held, size = ([], [], []), 0
            for column, x in zip(held, (doc_id, at, piece), strict=True):
                column.append(x)
            size += len(piece)
    if size:
        yield held


def entries(ids: list[int], offsets: list[int], pieces: list[bytes], length: int) -> list[np.ndarray]:
    """bucket, later, doc_id, lo, n: runs of neighbouring suffixes with one least pointer, at most as many as can share one.

    ``n`` is raised by ``_TWICE`` where the least pointer may stand twice in the run.
    """
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    starts = np.concatenate(([0], np.cumsum(sizes)))
    h = pointers(data)
    place = np.arange(len(h), dtype=np.uint64) & _PLACE
    width = length - _Q + 1
    left, right = _least((h & ~_PLACE) | place, width), _least((h & ~_PLACE) | (_PLACE - place), width)
    least = left >> np.uint64(12)
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[starts[:-1]] += 1
    inside[starts[1:] - length + 1] -= 1
    ok = np.cumsum(inside[: len(least)]) > 0
    cut = np.ones(len(least), dtype=bool)
    cut[1:] = (least[1:] != least[:-1]) | (ok[1:] != ok[:-1])
    cut[starts[:-1][starts[:-1] < len(least)]] = True
    first = np.flatnonzero(cut)
    place = np.arange(len(least)) - np.repeat(first, np.diff(np.append(first, len(least))))
    first = np.flatnonzero(place % width == 0)
    n = np.diff(np.append(first, len(least)))
    keep = ok[first]
    first, n = first[keep], n[keep]
    later = mix(_later(h, first, length) * _FACTORS[7] + _later(h, first + n - 1, length) + n.astype(np.uint64))
    last = first + n - 1
    twice = ((left[first] & _PLACE) != (_PLACE - (right[last] & _PLACE))) | (first >> 12 != (last + width) >> 12)  # places count up to 4096
    piece = np.searchsorted(starts, first, side="right") - 1
    return [least[first].view(np.int64), later.view(np.int64), np.array(ids, dtype=np.int64)[piece], first - starts[piece] + np.array(offsets, dtype=np.int64)[piece], n + _TWICE * twice]


def _settle(parts: list[list[np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Of equal entries the first stays; later ones go out marked (n < 0), neighbours as one, and need not be looked at again.
    A sixth column marks entries that have nobody to meet elsewhere: what is left of them stays here. A seventh says among how
    many parts the entries of a bucket are dealt by their later pointers; ``salt`` is an entry's part."""
    if not parts:
        return
    bucket, later, doc, lo, n, *more = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((lo, doc, later, bucket))
    bucket, later, doc, lo, n, *more = (c[order] for c in (bucket, later, doc, lo, n, *more))
    fresh = np.ones(len(bucket), dtype=bool)
    fresh[1:] = (bucket[1:] != bucket[:-1]) | (later[1:] != later[:-1])
    head = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    again = (doc > doc[head]) | ((doc == doc[head]) & (lo > lo[head]))
    same = ~fresh & ~again  # a row given more than once
    kept = np.flatnonzero(~again & ~same & ~more[0]) if more else np.flatnonzero(~again & ~same)
    kept = kept[np.lexsort((lo[kept], doc[kept]))]
    gone = np.flatnonzero(again)
    gone = gone[np.lexsort((lo[gone], doc[gone]))]
    size = n[gone] % _TWICE
    joins = np.zeros(len(gone), dtype=bool)
    joins[1:] = (doc[gone][1:] == doc[gone][:-1]) & (lo[gone][1:] == lo[gone][:-1] + size[:-1])
    head = np.flatnonzero(~joins)
    total = np.add.reduceat(size, head) if len(head) else size
    spread = mix(lo[gone][head].astype(np.uint64) ^ (doc[gone][head].view(np.uint64) << np.uint64(24))).view(np.int64)
    columns = [np.concatenate(c) for c in ((bucket[kept], spread), (later[kept], np.zeros(len(head), np.int64)), (doc[kept], doc[gone][head]), (lo[kept], lo[gone][head]), (n[kept], -total))]
    kinds = [np.int64, np.int64, np.int64, np.int32, np.int32]
    if more:
        ways = np.concatenate((more[1][kept], np.ones(len(head), np.int64)))
        columns, kinds = [*columns, columns[1].view(np.uint64) % ways.astype(np.uint64)], [*kinds, np.int32]
    for k in range(0, len(columns[0]), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c[k : k + (1 << 16)].astype(t)) for c, t in zip(columns, kinds, strict=True)], names=names)


def _enter(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    names = ["bucket", "later", "doc_id", "lo", "n"]
    held: list[list[np.ndarray]] = []
    rows = 0
    for part, texts in blocks(batches, "text", _SEGMENT):
        for ids, offsets, pieces in _segments(part.column(0).to_pylist(), texts, length):
            held.append(entries(ids, offsets, pieces, length))
            rows += len(held[-1][0])
        if rows >= _LOCAL_ROWS:
            yield from _settle(held, names)
            held, rows = [], 0
    yield from _settle(held, names)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, so that meeting them by doc_id moves less."""
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    for part, texts in blocks(batches, "text"):
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(press.compress, texts), pa.binary())], names=["doc_id", "text"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    import zstandard

    unpress = zstandard.ZstdDecompressor()
    for part, texts in blocks(batches, "text"):
        yield part, [unpress.decompress(t) for t in texts]


def _take_apart(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The single suffixes of the entries (bucket, lo, n, alone, ways: lists) of each text."""
    names = ["bucket", "later", "doc_id", "lo", "n", "salt"]
    held: list[list[np.ndarray]] = []
    rows = 0
    for part, texts in _unpacked(batches):
        ids = part.column(0).to_pylist()
        buckets, los, ns, own, dealt = (part.column(part.schema.get_field_index(c)) for c in ("bucket", "lo", "n", "alone", "ways"))
        for k, text in enumerate(texts):
            lo, n = (np.asarray(c[k].values.to_numpy(zero_copy_only=False)).astype(np.int64) for c in (los, ns))
            bucket = buckets[k].values.to_numpy(zero_copy_only=False)
            alone = own[k].values.to_numpy(zero_copy_only=False).astype(bool)
            ways = dealt[k].values.to_numpy(zero_copy_only=False).astype(np.int64)
            data = np.frombuffer(text, dtype=np.uint8)
            inside = lo + n + length - 1 <= len(data)
            lo, n, bucket, alone, ways = lo[inside], n[inside], bucket[inside], alone[inside], ways[inside]
            for a in range(0, len(lo), 4096):
                start, count = lo[a : a + 4096], n[a : a + 4096]
                size = count + length - 1
                begin = np.concatenate(([0], np.cumsum(size)))
                spot = np.arange(begin[-1]) - np.repeat(begin[:-1], size)
                h = pointers(data[np.repeat(start, size) + spot])
                first = np.concatenate(([0], np.cumsum(count)))
                inner = np.arange(first[-1]) - np.repeat(first[:-1], count)
                later = _later(h, np.repeat(begin[:-1], count) + inner, length)
                held.append([np.repeat(bucket[a : a + 4096], count), later.view(np.int64), np.full(len(later), ids[k], np.int64), np.repeat(start, count) + inner, np.ones(len(later), np.int64), np.repeat(alone[a : a + 4096], count), np.repeat(ways[a : a + 4096], count)])
                rows += len(later)
                if rows >= _LOCAL_ROWS:
                    yield from _settle(held, names)
                    held, rows = [], 0
    yield from _settle(held, names)


def _refined(rows: DataFrame) -> DataFrame:
    """With ``again``: an equal entry stands earlier; ``shared``: the first of its kind, but others share its bucket."""
    in_bucket = Window.partitionBy("bucket")
    ordered = Window.partitionBy("bucket", "later").orderBy("doc_id", "lo")
    first = F.first(F.struct("doc_id", "lo")).over(ordered)
    marked = rows.withColumn("size", F.count("*").over(in_bucket)).withColumn("low", F.min("later").over(in_bucket)).withColumn("high", F.max("later").over(in_bucket)).withColumn("first", first)
    again = (F.col("n") < 0) | (F.struct("doc_id", "lo") > F.col("first"))
    return marked.select("bucket", "doc_id", "lo", F.when(F.col("n") < 0, -F.col("n")).otherwise(F.pmod("n", F.lit(_TWICE))).alias("n"), again.alias("again"), (~again & ((F.col("low") != F.col("high")) | (F.col("n") > _TWICE))).alias("shared"), (F.col("low") == F.col("high")).alias("alone"), (F.floor(F.col("size") / _BUCKET_ROWS) + 1).cast("int").alias("ways")).filter("again or shared")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in _unpacked(batches):
        starts, stops = (part.column(part.schema.get_field_index(c)) for c in ("starts", "stops"))
        out: list[tuple[int, int, str, bytes]] = []
        for k, text in enumerate(texts):
            kept, spans, removed = text, 0, 0
            if starts[k].is_valid and len(starts[k]):
                a, b = (np.asarray(c[k].values.to_numpy(zero_copy_only=False)).astype(np.int64) for c in (starts, stops))
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.minimum(np.maximum.accumulate(b[order]), len(text))
                fresh = np.concatenate(([True], a[1:] > b[:-1]))
                begin, end = a[fresh], b[np.append(np.flatnonzero(fresh)[1:] - 1, len(b) - 1)]
                spans, removed = len(begin), int((end - begin).sum())
                kept = b"".join(text[x:y] for x, y in zip([0, *end.tolist()], [*begin.tolist(), len(text)], strict=True))
            out.append((removed, spans, hashlib.sha256(kept).hexdigest(), kept))
        cols = list(zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2]), pa.array(cols[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def repeated_ranges(narrow: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, start, stop: byte ranges (they may overlap) that together cover what is to be removed, of texts (doc_id, text: bytes)
    that a doc_id tells apart and orders."""
    if length < 2 * _Q:
        raise ValueError(f"strings of at least {2 * _Q} bytes")
    met = narrow.mapInArrow(functools.partial(_enter, length=length), _ENTRY).repartition("bucket")
    level = stage(_refined(met), "entries")
    whole = level.filter("again").select("doc_id", F.col("lo").alias("start"), (F.col("lo") + F.col("n") + F.lit(length - 1)).alias("stop"))
    lists = level.filter("shared").groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("bucket", "lo", "n", "alone", "ways")).alias("e"))
    texts = narrow.mapInArrow(_pack, "doc_id long, text binary").join(lists, F.col("doc_id") == F.col("id")).select("doc_id", "text", F.col("e.bucket").alias("bucket"), F.col("e.lo").alias("lo"), F.col("e.n").alias("n"), F.col("e.alone").alias("alone"), F.col("e.ways").alias("ways"))
    singles = texts.mapInArrow(functools.partial(_take_apart, length=length), _ENTRY + ", salt int").repartition("bucket", "salt")
    ordered = Window.partitionBy("bucket", "salt", "later").orderBy("doc_id", "lo")
    marked = singles.withColumn("first", F.first(F.struct("doc_id", "lo")).over(ordered)).filter((F.col("n") < 0) | (F.struct("doc_id", "lo") > F.col("first")))
    return whole.unionByName(marked.select("doc_id", F.col("lo").alias("start"), (F.col("lo") + F.abs("n") + F.lit(length - 1)).alias("stop")))


def _narrow(documents: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text: bytes; and, if several texts share a doc_id or have none, the table key, doc_id of the numbers that then stand
    for the pairs of doc_id and text, in the order of doc_id)."""
    doc_id, text = F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    rows = documents.select(doc_id, text)
    digests = rows.select("doc_id", F.xxhash64("text").alias("digest"))
    if digests.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low < high").isEmpty():
        return rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(_NULL_ID))), None
    keys = stage(ranked(digests.distinct(), ["doc_id", "digest"], "key"), "keys")
    named = keys.select("key", F.col("doc_id").alias("named"), "digest")
    met = rows.withColumn("digest", F.xxhash64("text")).join(named, F.col("doc_id").eqNullSafe(F.col("named")) & (F.xxhash64("text") == named["digest"]))
    return stage(met.select(F.col("key").alias("doc_id"), "text"), "keyed"), keys.select("key", F.col("doc_id").alias("named"))


def remove_repeats(documents: DataFrame, length: int = 100, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes that stay) for each row of (doc_id, text)."""
    narrow, keys = _narrow(documents)
    ranges = repeated_ranges(narrow, length).groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("start", "stop")).alias("r"))
    texts = narrow.mapInArrow(_pack, "doc_id long, text binary").join(ranges, F.col("doc_id") == F.col("id"), "left").select("doc_id", "text", F.col("r.start").alias("starts"), F.col("r.stop").alias("stops"))
    out = texts.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    if keys is not None:
        out = out.join(keys, F.col("doc_id") == F.col("key")).withColumn("doc_id", F.coalesce("named", F.lit(_NULL_ID)))
    doc_id = F.when(F.col("doc_id") != _NULL_ID, F.col("doc_id")).alias("doc_id")
    return out.select(doc_id, "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text)

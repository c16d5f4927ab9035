"""Stupid-backoff scores from n-gram counts of the whole corpus.

A document is scored by all others: its own n-grams are taken out of the counts, or each would know itself and back-off would
never happen. A word's score is count(context word) / count(context) at the longest order whose n-gram the others have; each
step to a shorter context multiplies by ``backoff``. Order 1 divides by the others' words, and a word that they lack counts as
if they had it once. A document's score is the sum of the logarithms.

Counts are a table partitioned by n-gram hash and the documents' n-grams are joined to it; rows are packed so that the join
fits the disk. Documents are gathered into blocks of about ``block_bytes`` of text. A block's distinct n-grams of an order are
one sorted run of hashes, cut by hash partition: a row (partition, block, order, hashes, counts). A partition's task adds up
the runs of all blocks and answers each block's run with the corpus counts, in the same order; block and answers meet by
block, and scores are summed per document. So an n-gram that stands in a third of all documents is one entry for each block,
whatever its frequency, and no group is larger than a partition's share of hashes. 56 bits of hash tell n-grams apart.

Null or empty text: no word, score 0 and mean null. Words are lower-cased (A-Z) runs without white space. Repeated rows are
counted and scored as often as they come. Empty table: empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.textblocks import BLOCK_BYTES, NOT_SPACE, Words, blocks, mix
from maskwright.llm.workspace import partitions, stage

_BITS = 56
_BLOCK = "block string, doc_id binary, sizes binary, texts binary, n_words long, runs long"
_RUNS = "part int, block string, ngram int, hashes binary, counts binary"


def _pack(values: np.ndarray) -> bytes:
    """Integers as byte planes, compressed: small numbers cost little, whatever their type."""
    import zstandard

    planes = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel()


def _pack_sorted(values: np.ndarray) -> bytes:
    return _pack(np.diff(values, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data), dtype=np.uint64)


def ngrams(texts: list[bytes], order: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Index of the text of each word, and for each order the hashes of its n-grams with the index of their last word."""
    docs, words = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    start = 0
    while start < len(texts):  # words of about a megabyte at a time: what is kept is a hash and an index for each
        stop, size = start, 0
        while stop < len(texts) and (size == 0 or size + len(texts[stop]) <= BLOCK_BYTES):
            size += len(texts[stop])
            stop += 1
        w = Words([t.lower() for t in texts[start:stop]], NOT_SPACE)
        docs.append(w.doc + start)
        words.append(w.hash)
        start = stop
    doc, word = np.concatenate(docs), np.concatenate(words)
    out, h = [], word
    at = np.arange(len(h))
    cut = np.uint64(64 - _BITS)
    for n in range(1, order + 1):
        if n > 1:
            keep = np.flatnonzero((at >= n - 1) & (doc[at] == doc[np.maximum(at - n + 1, 0)]))
            h, at = mix(h[keep - 1] * np.uint64(0xFF51AFD7ED558CCD) + word[at[keep]]), at[keep]  # of the context that ends one word before
        out.append((h >> cut, at))
    return doc, out


def _gather(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    import zstandard

    press = zstandard.ZstdCompressor(level=9)  # a block is written, and shuffled once
    ids: list[int | None] = []
    held: list[bytes] = []
    size = 0

    def flush() -> pa.RecordBatch:
        table = pa.array([pa.scalar(None, pa.int64()) if x is None else x for x in ids], pa.int64())
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("doc_id", pa.int64())])) as out:
            out.write_batch(pa.RecordBatch.from_arrays([table], names=["doc_id"]))
        n = sum(len(t.split()) for t in held)
        cols = [uuid.uuid4().hex, sink.getvalue().to_pybytes(), _pack(np.array([len(t) for t in held], dtype=np.uint64)), press.compress(b"".join(held)), n, n]
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cols, (pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["block", "doc_id", "sizes", "texts", "n_words", "runs"])

    for part, texts in blocks(batches, "text"):
        ids += part.column(0).to_pylist()
        held += texts
        size += sum(map(len, texts))
        if size >= block_bytes:
            yield flush()
            ids, held, size = [], [], 0
    if held:
        yield flush()


def _texts(sizes: bytes, texts: bytes) -> list[bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(texts) if texts else b""
    ends = np.cumsum(_unpack(sizes).astype(np.int64)).tolist()
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _cuts(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Where a sorted run is cut into the hash partitions."""
    bounds = [(k << _BITS) // parts for k in range(parts)]
    return np.append(np.searchsorted(hashes, np.array(bounds, dtype=np.uint64)), len(hashes))


def _runs(batches: Iterator[pa.RecordBatch], order: int, parts: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            block, sizes, texts = (batch.column(j)[k].as_py() for j in (0, 1, 2))
            _, grams = ngrams(_texts(sizes, texts), order)
            rows: list[tuple] = []
            for n, (h, _) in enumerate(grams, 1):
                distinct, counts = np.unique(h, return_counts=True)
                cut = _cuts(distinct, parts)
                rows += [(p, block, n, _pack_sorted(distinct[a:b]), _pack(counts[a:b])) for p, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if b > a]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["part", "block", "ngram", "hashes", "counts"])


def _answer(table: pa.Table) -> pa.Table:
    """The runs of one hash partition with the counts replaced by those of the corpus."""
    ngram = table.column("ngram").to_pylist()
    hashes = [_unpack_sorted(x) for x in table.column("hashes").to_pylist()]
    counts = table.column("counts").to_pylist()
    out: list[bytes] = [b""] * len(ngram)
    for n in sorted(set(ngram)):
        rows = [k for k, x in enumerate(ngram) if x == n]
        every = np.concatenate([hashes[k] for k in rows])
        own = np.concatenate([_unpack(counts[k]) for k in rows])
        order = np.argsort(every, kind="stable")
        fresh = np.concatenate(([True], every[order][1:] != every[order][:-1]))
        group = np.cumsum(fresh) - 1
        total = np.add.reduceat(own[order], np.flatnonzero(fresh))
        back = np.empty(len(every), dtype=np.uint64)
        back[order] = total[group]
        ends = np.cumsum([len(hashes[k]) for k in rows])
        for k, part in zip(rows, np.split(back, ends[:-1]), strict=True):
            out[k] = _pack(part)
    return pa.table({"part": table.column("part"), "block": table.column("block"), "ngram": table.column("ngram"), "counts": pa.array(out, pa.binary())})


def _own(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each n-gram how often its own document has it."""
    order = np.lexsort((h, doc))
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    group = np.cumsum(fresh) - 1
    out = np.empty(len(h), dtype=np.int64)
    out[order] = np.bincount(group)[group] if len(h) else 0
    return out


def _score(left: pa.Table, right: pa.Table, order: int, total: int, backoff: float) -> pa.Table:
    if not left.num_rows:
        return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "log_score": pa.array([], pa.float64())})
    ids = pa.ipc.open_stream(left.column("doc_id")[0].as_py()).read_all().column("doc_id")
    texts = _texts(left.column("sizes")[0].as_py(), left.column("texts")[0].as_py())
    doc, grams = ngrams(texts, order)
    answers = sorted(zip(right.column("ngram").to_pylist(), right.column("part").to_pylist(), right.column("counts").to_pylist(), strict=True), key=lambda x: x[:2])
    words = np.bincount(doc, minlength=len(texts))
    others = np.maximum(total - words, 1).astype(float)[doc]
    score = np.zeros(len(doc))
    before = np.zeros(len(doc))  # what the others have of the shorter n-gram that ends at each word
    for n, (h, at) in enumerate(grams, 1):
        if not len(h):
            continue
        counts = np.concatenate([_unpack(c) for m, _, c in answers if m == n]).astype(np.int64)
        _, inverse = np.unique(h, return_inverse=True)
        elsewhere = (counts[inverse] - _own(h, doc[at])).astype(float)
        now = np.zeros(len(doc))
        now[at] = elsewhere
        if n == 1:
            score[at] = np.log(np.maximum(elsewhere, 1) / others[at])
        else:
            score[at] += np.log(backoff)
            seen = at[elsewhere > 0]
            score[seen] = np.log(now[seen] / before[seen - 1])
        before = now
    return pa.table({"doc_id": ids, "n_words": pa.array(words.astype(np.int64)), "log_score": pa.array(np.bincount(doc, weights=score, minlength=len(texts)))})


def score(documents: DataFrame, order: int = 3, backoff: float = 0.4, block_bytes: int = 8 << 20, partition_words: int = 3_000_000) -> DataFrame:
    """doc_id, n_words, log_score (natural logarithm, summed), mean_log_score for each row of (doc_id, text)."""
    spark = documents.sparkSession
    narrow = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    gathered = stage(narrow.mapInArrow(functools.partial(_gather, block_bytes=block_bytes), _BLOCK), "lm-blocks")
    total = gathered.agg(F.sum("n_words")).first()[0] or 0
    parts = max(partitions(spark), -(-total * order // partition_words))
    runs = gathered.select("block", "sizes", "texts").mapInArrow(functools.partial(_runs, order=order, parts=parts), _RUNS)
    answers = runs.groupBy("part").applyInArrow(_answer, "part int, block string, ngram int, counts binary")
    fields = "doc_id long, n_words long, log_score double"
    met = gathered.select("block", "doc_id", "sizes", "texts").groupBy("block").cogroup(answers.groupBy("block"))
    scored = met.applyInArrow(functools.partial(_score, order=order, total=total, backoff=backoff), fields)
    return scored.select("doc_id", "n_words", "log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("mean_log_score"))

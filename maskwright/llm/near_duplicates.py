"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its word shingles. All shingles have one global order: by estimated number of documents, rarest
first, then by hash. Of a set of n, any partner at the threshold shares ceil(t * n) shingles, so the first
n - ceil(t * n) + l of both sides share at least l. Each document chooses its own l, from 1 to all it must share: the longer
prefix costs more postings, but then more of them must be shared before a pair is verified; the choice weighs the estimated
postings against the estimated verifications. Two documents are candidates if their prefixes share as many shingles as the smaller of their two l, and as
their sizes demand (``_needed``).

Estimates come from a count sketch over the shingles of all documents: a fixed table, summed in slices by the executors. It only
orders and weighs; wrong estimates cost time, never a link.

Only components are wanted, so not all pairs are formed. Texts with equal sets are one node. In each of a few rounds every
posting list still spanning several components compares its members with two pivots, and what links becomes one component. What
then remains is done exhaustively: every pair of different components that shares as many of its rarest shingles as a link
needs is verified. So a group of thousands of near copies costs a few comparisons for each member.

A frequent shingle's postings are dealt among cells of about ``per_cell`` by the sketch's estimate, and what they are compared
with goes to every cell; so is a large component's where rows meet their component.

Shingles are told apart by 64-bit hashes, sets by 128 bits and their size. Null or empty text, or one without a word: an empty
set, linked with nothing; its component is its own doc_id. Fewer words than a shingle: the whole sequence is one. Rows that
repeat a doc_id are one document: the texts given under it are linked through it. Rows without a doc_id are documents of their
own, which link others, and have the least doc_id of their component, if there is one, as theirs. Empty table: empty result.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.components import components
from maskwright.llm.textblocks import NOT_SPACE, Words, blocks, mix
from maskwright.llm.workspace import drop_staged, hot_join, stage

SKETCH_BITS, _SLICES = 21, 64
_SIGNATURE = "id long, digest long, n long, d1 long, d2 long, slice int, cells binary"
_PREFIX = "id long, digest long, n int, need int, prefix array<long>, ways array<int>"
_TEXT = "id long, digest long, packed binary"
NO_ID = -(2**63)


def _press(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def _unpress(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def shingle_sets(texts: list[bytes], length: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the texts, sorted within each text, and the bounds of each text's."""
    w = Words([t.lower() for t in texts], NOT_SPACE)
    h, at = w.windows(length)
    doc = w.doc[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < length))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        whole += w.counts[short].astype(np.uint64) * np.uint64(0x51ED270B7F4A7C15)
        for k in range(length - 1):
            more = np.flatnonzero(w.counts[short] > k)
            whole[more] = mix(whole[more] * np.uint64(0xFF51AFD7ED558CCD) + w.hash[w.first[short[more]] + k])
        h, doc = np.concatenate((h, whole)), np.concatenate((doc, short))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[fresh], doc[fresh]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1))


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _sign(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    sketch = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    names = ["id", "digest", "n", "d1", "d2", "slice", "cells"]
    for part, texts in blocks(batches, "text", 1 << 19):
        h, bounds = shingle_sets(texts, length)
        sketch += np.bincount(_cells(h), minlength=len(sketch))
        d1, d2 = (_sums(mix(h ^ np.uint64(salt)), bounds).view(np.int64) for salt in (0x0123456789ABCDEF, 0x7A3C19E5D2B48F60))
        k = len(texts)
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(bounds)), pa.array(d1), pa.array(d2), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
    cells = [_press(x.astype("<i8").tobytes()) for x in np.split(sketch, _SLICES)]
    yield pa.RecordBatch.from_arrays([*(pa.nulls(_SLICES, pa.int64()) for _ in range(5)), pa.array(range(_SLICES), pa.int32()), pa.array(cells, pa.binary())], names=names)


def _sum_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slices of a task summed; every slice number is met at most once in the result."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(_unpress(x), dtype="<i8")
            totals[k] = totals[k] + own if k in totals else own
    if totals:
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([_press(x.tobytes()) for x in totals.values()], pa.binary())], names=["slice", "cells"])


def sketch_of(signed: DataFrame) -> np.ndarray:
    """The summed sketch: a fixed 16 MB, whatever the input."""
    rows = signed.filter(F.col("slice").isNotNull()).select("slice", "cells").repartition(_SLICES, "slice").mapInArrow(_sum_cells, "slice int, cells binary").collect()
    out = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    width = len(out) // _SLICES
    for r in rows:
        out[r["slice"] * width : (r["slice"] + 1) * width] += np.frombuffer(_unpress(r["cells"]), dtype="<i8")
    return out


def choose_need(cost: np.ndarray, n: int, least: int) -> int:
    """How many shared prefix shingles to require: the cheapest of 1 to ``least``.

    ``cost``: estimated documents of each shingle in global order; ``least``: shingles that any partner shares. Postings read
    are the sum over the prefix; each further required match is taken to halve the pairs that must be verified. As a further
    shingle costs one posting at least, nothing is gained once all halves together are below that.
    """
    base = n - least
    found = float(np.maximum(cost[: base + 1] - 1, 0).sum()) * n / 16
    most = min(least, int(found).bit_length() + 2)
    total = np.cumsum(cost[: base + most], dtype=np.float64)[base:] + found / 2.0 ** np.arange(most)
    return int(np.argmin(total)) + 1


def _prefixes(batches: Iterator[pa.RecordBatch], length: int, percent: int, per_cell: int, sketch: Broadcast) -> Iterator[pa.RecordBatch]:
    cells = sketch.value
    floor = int(np.median(cells))
    for part, texts in blocks(batches, "text", 1 << 19):
        h, bounds = shingle_sets(texts, length)
        estimate = np.maximum(cells[_cells(h)] - floor, 1)
        doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
        order = np.lexsort((h, estimate, doc))
        h, estimate = h[order].view(np.int64), estimate[order]
        kept, needs, sizes = [np.zeros(0, np.int64)], [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            n = b - a
            least = -(-percent * n // 100)
            need = choose_need(estimate[a:b], n, least) if n else 0
            kept.append(np.arange(a, a + n - least + need))
            needs.append(need)
            sizes.append(n)
        offsets = pa.array(np.cumsum([len(x) for x in kept]), pa.int32())
        at = np.concatenate(kept)
        ways = (-(-estimate[at] // per_cell)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int32()), pa.array(needs, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(h[at])), pa.ListArray.from_arrays(offsets, pa.array(ways))], names=["id", "digest", "n", "need", "prefix", "ways"])


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in blocks(batches, "text", 1 << 19):
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(map(_press, texts), pa.binary())], names=["id", "digest", "packed"])


def _common(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}  # of the few texts just met: those of one node stand together

    def members(node: int, packed: pa.BinaryScalar) -> np.ndarray:
        if node not in held:
            if len(held) >= 32:
                held.pop(next(iter(held)))
            held[node] = shingle_sets([_unpress(packed.as_buffer())], length)[0]
        return held[node]

    for batch in batches:
        left, right = (batch.column(batch.schema.get_field_index(c)) for c in ("left_packed", "right_packed"))
        a, b = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b"))
        rows = []
        for k, (i, j) in enumerate(zip(a.to_pylist(), b.to_pylist(), strict=True)):
            x, y = sorted((members(i, left[k]), members(j, right[k])), key=len)
            spot = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
            rows.append((len(x), len(y), int((y[spot] == x).sum()) if len(x) else 0))
        n, m, common = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([a, b, pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(common, pa.int64())], names=["a", "b", "na", "nb", "common"])


def _verify(pairs: DataFrame, texts: DataFrame, length: int, percent: int) -> DataFrame:
    """a, b, linked for distinct pairs (a, b); packed texts travel, which are smaller than their sets."""
    left = texts.select(F.col("node").alias("a"), F.col("packed").alias("left_packed"))
    right = texts.select(F.col("node").alias("b"), F.col("packed").alias("right_packed"))
    met = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "left_packed", "right_packed").mapInArrow(functools.partial(_common, length=length), "a long, b long, na long, nb long, common long")
    union = F.col("na") + F.col("nb") - F.col("common")
    return met.select("a", "b", (100 * F.col("common") >= percent * union).alias("linked"))


def _whole(x: F.Column) -> F.Column:
    return F.ceil(x - 1e-9)


_PAIR = ("na", "nb", "need_a", "need_b")


def _overlap(percent: int, na: str, nb: str) -> F.Column:
    """The least number of common shingles that links sets of these sizes."""
    return _whole(percent * (F.col(na) + F.col(nb)) / (100 + percent))


def _prefix_rest(percent: int, na: str, nb: str, need_a: str, need_b: str) -> F.Column:
    """The longer of the remainders that the prefixes of a and b leave."""
    return F.greatest(*[_whole(percent * F.col(n) / 100) - F.col(need) for n, need in ((na, need_a), (nb, need_b))])


def _needed(percent: int, names: tuple[str, str, str, str] = _PAIR) -> F.Column:
    """Shared prefix shingles that a linked pair (sizes and needs of a and b) cannot do without.

    Of the two prefixes take the one that ends first in the global order: a common shingle is in both prefixes or among the
    shingles that follow this one, so what a link demands beyond the longer remainder must be in both.
    """
    return F.greatest(F.least(names[2], names[3]), _overlap(percent, *names[:2]) - _prefix_rest(percent, *names))


def _with_root(postings: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return postings.withColumn("comp", F.col("node"))
    return postings.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")


def _shared_only(postings: DataFrame) -> DataFrame:
    """Postings of the shingles that several nodes have in their prefixes; those of a shingle dealt among cells all count."""
    return postings.withColumn("size", F.count("*").over(Window.partitionBy("token", "cell"))).filter("size > 1 or ways > 1").drop("size")


def _open_lists(postings: DataFrame) -> DataFrame:
    """The postings of the lists that span several components. Of lists dealt among cells all stay: that costs time only."""
    whole = Window.partitionBy("token", "cell")
    spans = postings.withColumn("low", F.min("comp").over(whole)).withColumn("high", F.max("comp").over(whole))
    return spans.filter("low < high or ways > 1").drop("low", "high")


def _in_cells(lists: DataFrame) -> DataFrame:
    """Rows (token, ways, ...) once for each cell of their token."""
    return lists.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("ways") - 1))).drop("ways")


def _in_range(n: str, m: str, percent: int) -> F.Column:
    return (100 * F.least(F.col(n), F.col(m))) >= (percent * F.greatest(F.col(n), F.col(m)))


def _counted(met: DataFrame, least: F.Column) -> DataFrame:
    """a, b of the pairs that share at least so many: rows (a, b, na, nb, need_a, need_b), one for each shared shingle."""
    return met.groupBy(*_PAIR, "a", "b").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least).select("a", "b").distinct()


def _sides(swap: F.Column) -> list[F.Column]:
    """The columns of a pair of postings (node, n, need; node2, n2, need2) as a, b, with the sides swapped where said."""
    pick = lambda x, y, name: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(name)
    return [pick("node", "node2", "a"), pick("node2", "node", "b"), pick("n", "n2", "na"), pick("n2", "n", "nb"), pick("need", "need2", "need_a"), pick("need2", "need", "need_b")]


def _pivot_pairs(postings: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs of a list's member with one of two pivots of another component, if the lists they share let them hope.

    Pivots are drawn by hash; but the first of all is the member with the fewest prefix shingles of its own (``alone``), of
    several the largest: what near copies were made from has none, while each copy has those of its changes.

    A pair meets its pivot only in the lists that drew it, so half the shingles it needs are enough here; nothing is lost for
    good, as what stays apart is looked at again by ``_rest_pairs``.
    """
    draw = F.xxhash64(F.lit(turn), "node")
    drawn = lambda *first: F.struct(*[x.alias(f"first{i}") for i, x in enumerate(first)], draw.alias("draw"), F.col("node").alias("node2"), F.col("comp").alias("comp2"), F.col("n").alias("n2"), F.col("need").alias("need2"))
    first = [-F.col("alone"), F.col("n")] if turn == 0 else [F.lit(0), F.lit(0)]
    pivots = postings.groupBy("token", "ways").agg(F.max(drawn(*first)).alias("p"), F.min(drawn(F.lit(0), F.lit(0))).alias("q"))
    columns = ["node2", "comp2", "n2", "need2"]
    pivots = _in_cells(pivots.select("token", "ways", F.inline(F.array(*[F.struct(*[F.col(f"{x}.{c}").alias(c) for c in columns]) for x in ("p", "q")]))))
    met = postings.join(pivots, ["token", "cell"]).filter((F.col("comp") != F.col("comp2")) & _in_range("n", "n2", percent))
    return _counted(met.select(*_sides(F.col("node") > F.col("node2"))), 0.5 * _needed(percent))


def _rest_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components that can be linked at all.

    Of a list's members only those outside its largest component are compared with the others: any pair of two components has
    one. A pair that must overlap in o shingles shares at least l of the first n - o + l of one and the first m - o + l of the
    other, so a posting counts only where it stands that early on both sides, and the frequent end of every prefix takes no
    part. Nor do pairs of which one has fewer than l open postings that early (``firsts``: places of its first ones), or fewer
    open postings in all (``k``) than a link with the other needs of its prefix. This holds for every l up to what both prefixes
    allow; here l is two at most, as a larger one would let more of the frequent shingles take part.
    """
    firsts = F.slice(F.array_sort(F.collect_list("pos")), 1, 2)
    open_ = postings.groupBy(F.col("node").alias("k_node")).agg(F.count("*").alias("k"), firsts.alias("firsts"))
    sizes = postings.groupBy("token", "ways", "comp").agg(F.count("*").alias("c"))
    largest = _in_cells(sizes.groupBy("token", "ways").agg(F.max_by("comp", F.struct("c", "comp")).alias("largest")))
    known = postings.join(open_, F.col("node") == F.col("k_node")).join(largest, ["token", "cell"]).withColumn("inside", F.col("comp") == F.col("largest"))
    columns = ["node", "comp", "n", "need", "pos", "k", "firsts"]
    here = _in_cells(known.filter(~F.col("inside")).select("token", "ways", *columns))
    there = known.select("token", "cell", *[F.col(c).alias(f"{c}2") for c in columns], "inside")
    names = ("n", "n2", "need", "need2")
    both, o = F.least("need", "need2", F.lit(2)), _overlap(percent, "n", "n2")
    early = (F.col("pos") < F.col("n") - o + both) & (F.col("pos2") < F.col("n2") - o + both)
    able = (F.get("firsts", both - 1) < F.col("n") - o + both) & (F.get("firsts2", both - 1) < F.col("n2") - o + both)
    once = F.col("inside") | (F.col("node") < F.col("node2"))
    met = here.join(there, ["token", "cell"]).filter((F.col("comp") != F.col("comp2")) & _in_range("n", "n2", percent) & once & early & able & (F.least("k", "k2") >= _needed(percent, names)))
    return _counted(met.select(*_sides(F.col("node") > F.col("node2"))), F.least("need_a", "need_b", F.lit(2)))


def _same_document(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """u, v: texts given under one doc_id are linked through it."""
    named = rows.filter((F.col("n") > 0) & (F.col("id") != NO_ID))
    several = named.groupBy("id").agg(F.min("d1").alias("low"), F.max("d1").alias("high")).filter("low < high").select("id")
    nodes = stage(named.join(several, "id", "left_semi").join(classes.select("n", "d1", "d2", "node"), ["n", "d1", "d2"]).select("id", "node").distinct(), "same-document")
    return nodes.join(nodes.groupBy("id").agg(F.min("node").alias("v")), "id").filter("node != v").select(F.col("node").alias("u"), "v").distinct()


def assign(documents: DataFrame, length: int = 5, percent: int = 75, rounds: int = 3, per_cell: int = 1_000) -> DataFrame:
    """id (doc_id; the least long if null), digest (xxhash64 of the text), n (size of the set), root (a number for each component,
    null for an empty set) for each row of (doc_id, text)."""
    spark = documents.sparkSession
    text = F.col("text").cast("string")
    narrow = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    signed = stage(narrow.mapInArrow(functools.partial(_sign, length=length), _SIGNATURE), "signatures")
    rows = signed.filter(F.col("slice").isNull()).select("id", "digest", "n", "d1", "d2")
    least = rows.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min(F.struct("id", "digest")).alias("row"))
    classes = stage(least.select("n", "d1", "d2", "row.id", "row.digest").withColumn("node", F.monotonically_increasing_id()), "classes")
    sketch = spark.sparkContext.broadcast(sketch_of(signed))
    prefixes = narrow.mapInArrow(functools.partial(_prefixes, length=length, percent=percent, per_cell=per_cell, sketch=sketch), _PREFIX)
    nodes = classes.select("id", "digest", "node")
    # rows that repeat id and text fall together here
    own = prefixes.filter("n > 0").join(nodes, ["id", "digest"]).groupBy("id", "digest", "node").agg(*[F.first(c).alias(c) for c in ("n", "need", "prefix", "ways")])
    cell = F.pmod(F.xxhash64("node"), F.col("at.ways")).cast("int").alias("cell")
    listed = own.select("node", "n", "need", F.posexplode(F.arrays_zip("prefix", "ways")).alias("pos", "at")).select("node", "n", "need", "pos", F.col("at.prefix").alias("token"), F.col("at.ways").alias("ways"), cell)
    found = stage(_shared_only(listed), "postings")
    shared = found.groupBy(F.col("node").alias("k_node")).agg(F.count("*").alias("shared"))
    alone = F.col("n") - _whole(percent * F.col("n") / 100) + F.col("need") - F.col("shared")
    several = stage(found.join(shared, F.col("node") == F.col("k_node")).withColumn("alone", alone).drop("k_node", "shared"), "postings")
    drop_staged(found)
    wanted = nodes.join(several.select("node").distinct(), "node")
    packed = narrow.mapInArrow(_pack_texts, _TEXT)
    texts = stage(packed.join(wanted, ["id", "digest"]).groupBy("id", "digest", "node").agg(F.first("packed").alias("packed")).select("node", "packed"), "texts")
    bridges = stage(_same_document(rows, classes), "links")
    roots = None if bridges.isEmpty() else components(bridges)
    open_lists = _with_root(several, roots)
    for turn in range(rounds + 1):
        pairs = _pivot_pairs(open_lists, turn, percent) if turn < rounds else _rest_pairs(open_lists, percent)
        new = stage(_verify(pairs, texts, length, percent).filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
        if not new.isEmpty():
            roots = components(new if roots is None else new.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))
            if turn < rounds:
                before = open_lists
                open_lists = stage(_open_lists(_with_root(before.drop("comp"), roots)), "open-lists")
                drop_staged(before)
    rooted = _with_root(classes.select("n", "d1", "d2", "node"), roots).select("n", "d1", "d2", F.col("comp").alias("root"))
    return rows.join(rooted, ["n", "d1", "d2"], "left").select("id", "digest", "n", "root")


def join_components(documents: DataFrame, length: int = 5, percent: int = 75, rounds: int = 3, per_cell: int = 1_000) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of (doc_id, text)."""
    met = stage(assign(documents, length, percent, rounds, per_cell), "assigned")
    named = F.when(F.col("id") != NO_ID, F.col("id"))
    least = met.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min(named).alias("least"), F.count("*").alias("size"))
    out = hot_join(met, least, "root", "size", ["id", "digest"], "left")
    return out.select(named.alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), named).otherwise(F.col("least")).alias("component_id"))

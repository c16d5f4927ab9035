"""Quality rules with weak supervision.

Each rule looks at the statistics of one text and votes *junk* (0), *good* (1) or abstains (2). Nobody says how far a rule
can be trusted: expectation-maximisation over the counts of vote patterns estimates, for junk and for good texts, how often
each rule casts each vote, and the posterior probability of *good* under these estimates decides.

Plan: one pass over the texts (Arrow workers, arrays for a block of texts at a time) gives statistics and votes and is staged;
``groupBy(pattern).count()`` combines on the map side and yields at most 3**rules rows, which is the only thing that reaches
the driver; the posteriors go back as a join on the pattern. Nothing is shuffled but pattern counts.

Null or empty text: no words, all counts 0, base_failed. Repeated rows: each is judged by itself, alike. Empty table: empty
result. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.textblocks import NOT_SPACE, Words, blocks, byte_class
from maskwright.llm.workspace import bounded_broadcast, stage

SYMBOLS = b"#*$%&|<>"
RULES = ("symbols", "odd_endings", "repeats", "variety", "capitals", "shouting", "dup_lines", "word_length", "sentences", "function_words", "length")
_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, pattern string"

_symbol = np.zeros(256, dtype=bool)
_symbol[list(SYMBOLS)] = True
_continuation = byte_class((0x80, 0xBF))
_upper = byte_class((0x41, 0x5A))
_lower = byte_class((0x61, 0x7A))
_stop = np.zeros(256, dtype=bool)
_stop[list(b".!?,;:")] = True


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def text_statistics(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Counts for each text of a block: the five contract statistics and those that only the rules use."""
    w = Words(texts, NOT_SPACE)
    n = w.counts
    inside = NOT_SPACE[w.data]
    out = {"n_words": n, "word_chars": _per_text(inside & ~_continuation[w.data], w.text_start), "n_symbols": _per_text(_symbol[w.data], w.text_start)}
    out["n_dup_lines"] = np.fromiter((_dup_lines(t) for t in texts), dtype=np.int64, count=len(texts))
    h, at = w.windows(3)
    covered = np.zeros(len(w.hash) + 3, dtype=bool)
    if len(h):
        order = np.lexsort((h, w.doc[at]))
        same = (h[order][1:] == h[order][:-1]) & (w.doc[at][order][1:] == w.doc[at][order][:-1])
        repeated = at[order[np.concatenate((same, [False])) | np.concatenate(([False], same))]]
        for k in range(3):
            covered[repeated + k] = True
    out["n_repeat_words"] = _per_text(covered[: len(w.hash)], w.first)
    order = np.lexsort((w.hash, w.doc))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (w.doc[order][1:] != w.doc[order][:-1])
    out["n_distinct"] = np.bincount(w.doc[order][fresh], minlength=len(texts))
    out["n_upper"], out["n_lower"] = _per_text(_upper[w.data], w.text_start), _per_text(_lower[w.data], w.text_start)
    last = w.data[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    out["n_stops"], out["n_odd_ends"] = _per_text(_stop[last], w.first), _per_text(_symbol[last], w.first)
    before = w.data[np.maximum(w.end - 2, 0)] if len(w.end) else last
    out["n_shouts"] = _per_text((last == 0x21) & (before == 0x21), w.first)
    out["n_short"] = _per_text((w.end - w.start) <= 3, w.first)
    return out


def votes(s: dict[str, np.ndarray]) -> np.ndarray:
    """A row for each text, a column for each of ``RULES``: 0 junk, 1 good, 2 abstains."""
    n = np.maximum(s["n_words"], 1).astype(float)
    letters = np.maximum(s["n_upper"] + s["n_lower"], 1).astype(float)
    mean = s["word_chars"] / n
    expected = np.minimum(1.0, 6.0 / np.sqrt(n))  # long texts reuse more of their words

    def rule(junk, good) -> np.ndarray:
        return np.where(junk, 0, np.where(good, 1, 2))

    short = s["n_words"] < 20
    cols = [
        rule(s["n_symbols"] > 0.10 * n, s["n_symbols"] <= 0.005 * n),
        rule(s["n_odd_ends"] > 0.05 * n, False),
        rule(s["n_repeat_words"] > 0.30 * n, (s["n_repeat_words"] <= 0.05 * n) & ~short),
        rule((s["n_distinct"] < 0.25 * expected * n) & ~short, s["n_distinct"] > 0.6 * expected * n),
        rule(s["n_upper"] > 0.4 * letters, s["n_upper"] < 0.1 * letters),
        rule(s["n_shouts"] > 0.05 * n, False),
        rule(s["n_dup_lines"] > 3, False),
        rule((mean < 2.5) | (mean > 12), False),
        rule((s["n_stops"] < 0.01 * n) | (s["n_stops"] > 0.5 * n), (s["n_stops"] > 0.04 * n) & (s["n_stops"] < 0.3 * n)),
        rule(s["n_short"] < 0.03 * n, (s["n_short"] > 0.15 * n) & (s["n_short"] < 0.8 * n)),
        rule(s["n_words"] < 30, s["n_words"] >= 80),
    ]
    return np.stack(cols, axis=1)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in blocks(batches, "text"):
        s = text_statistics(texts)
        pattern = ["".join(map(str, row)) for row in votes(s).tolist()]
        yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *(pa.array(s[k].astype(np.int64)) for k in _STATS), pa.array(pattern, pa.string())], names=["doc_id", *_STATS, "pattern"])


def estimate(patterns: dict[str, int], rounds: int = 100) -> dict[str, object]:
    """Expectation-maximisation over counts of vote patterns.

    Returns the share of good texts, for each rule its accuracy (how often a cast vote is right), and the posterior of each
    pattern. The start says only that a cast vote is more often right than wrong. Two classes that share no evidence (no
    pattern at all) give empty results.
    """
    keys = sorted(patterns)
    if not keys:
        return {"good": 0.5, "accuracy": {}, "posterior": {}}
    count = np.array([patterns[k] for k in keys], dtype=float)
    cast = np.array([[int(c) for c in k] for k in keys])
    hot = np.stack([cast == v for v in range(3)], axis=2).astype(float)
    m = cast.shape[1]
    share = np.stack([np.full((m, 3), 0.0), np.full((m, 3), 0.0)])
    overall = (hot * count[:, None, None]).sum(0) / count.sum() + 1e-3
    for y in range(2):
        share[y] = overall * np.where(np.arange(3) == y, 2.0, np.where(np.arange(3) == 2, 1.0, 0.2))
        share[y] /= share[y].sum(1, keepdims=True)
    good = 0.8
    for _ in range(rounds):
        logs = [np.log(p) + (hot * np.log(share[y])).sum((1, 2)) for y, p in ((0, 1 - good), (1, good))]
        post = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        for y, weight in ((0, count * (1 - post)), (1, count * post)):
            share[y] = ((hot * weight[:, None, None]).sum(0) + 1.0 * overall) / (weight.sum() + overall.sum(1, keepdims=True))
        before, good = good, float(np.clip((count * post).sum() / count.sum(), 1e-3, 1 - 1e-3))
        if abs(before - good) < 1e-9:
            break
    right = good * share[1][:, 1] + (1 - good) * share[0][:, 0]
    wrong = good * share[1][:, 0] + (1 - good) * share[0][:, 1]
    return {"good": good, "accuracy": dict(zip(RULES, (right / np.maximum(right + wrong, 1e-12)).tolist(), strict=False)), "posterior": dict(zip(keys, post.tolist(), strict=True))}


def judge(documents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the five statistics, base_failed, the posterior ``quality`` and ``kept`` for each row of (doc_id, text)."""
    spark = documents.sparkSession
    narrow = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    measured = stage(narrow.mapInArrow(_measure, _SCHEMA), "quality")
    counted = {r["pattern"]: r["n"] for r in measured.groupBy("pattern").agg(F.count("*").alias("n")).collect()}  # at most 3**rules rows
    posterior = estimate(counted)["posterior"]
    scores = spark.createDataFrame([(k, float(v)) for k, v in posterior.items()], "pattern string, quality double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    listed, _ = bounded_broadcast(scores, 3 ** len(RULES))
    return measured.join(listed, "pattern").select("doc_id", *_STATS, failed.alias("base_failed"), (~failed & (F.col("quality") >= threshold)).alias("kept"), "quality")


def _select(batches: Iterator[pa.RecordBatch], posterior: dict[str, float], threshold: float) -> Iterator[pa.RecordBatch]:
    for part, texts in blocks(batches, "text"):
        s = text_statistics(texts)
        score = np.array([posterior.get("".join(map(str, row)), 0.0) for row in votes(s).tolist()])
        failed = (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
        yield part.filter(pa.array(~failed & (score >= threshold)))


def keep_good(documents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``documents`` that ``judge`` keeps, with all their columns; a second pass over the texts, and no shuffle."""
    counted = {r["pattern"]: r["n"] for r in documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_measure, _SCHEMA).groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    return documents.mapInArrow(functools.partial(_select, posterior=estimate(counted)["posterior"], threshold=threshold), documents.schema)

"""Routes: what happens to each document, decided by one chain of checks, with a content-free audit row for each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.structure import code_names, title_names
from maskwright.functions.text import clean_surface, key, sha16
from maskwright.functions.tokens import has_token
from maskwright.operators import bootstrap
from maskwright.operators.gate import GateConfig
from maskwright.plans.staging import settle

ROUTES = ("cloud_raw", "cloud_masked", "needs_confirmation", "local_only", "block")
#: How a command ends for each route, and how much of a document a local model reads.
EXIT_CODES = {"block": 3, "local_only": 2, "needs_confirmation": 4}
LOCAL_CHARS = 12_000


def secret_count(rule_spans: Column) -> Column:
    return F.size(F.filter(rule_spans, lambda x: x["type"] == "SECRET")).cast("long")


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, key, surface (its first spelling): code names and title-case names of each document."""
    found = F.concat(code_names(F.col("text")), title_names(F.col("text")))
    rows = docs.select("doc_id", F.posexplode(found).alias("ord", "raw")).select("doc_id", "ord", clean_surface(F.col("raw")).alias("surface")).filter(F.length("surface") >= 2)
    return rows.withColumn("key", key(F.col("surface"))).filter(F.col("key") != "").groupBy("doc_id", "key").agg(F.min_by("surface", "ord").alias("surface"))


def proposed(docs: DataFrame, make: Callable | None = None) -> DataFrame:
    """doc_id, key, surface, kind, alias: project-like terms of each document. Code and title-case names count unless the
    provider knows them as public; what the provider itself proposes counts, public or not. With a provider the candidates are
    settled: they are judged and kept."""
    found = candidates(docs) if make is None else settle(candidates(docs))
    found = found.select("doc_id", "key", "surface", F.lit("TERM").alias("kind"), F.lit("").alias("alias"), F.lit(1).alias("rank"))
    if make is None:
        return found.drop("rank")
    judged = bootstrap.public_terms(found.select(F.col("surface").alias("title")), make).filter("public").select(F.col("title").alias("surface"))
    model = bootstrap.model_terms(docs, make).filter(F.col("key") != "").select("doc_id", "key", "surface", "kind", F.col("description").alias("alias"), F.lit(0).alias("rank"))
    every = found.join(judged, "surface", "left_anti").unionByName(model)
    return every.groupBy("doc_id", "key").agg(F.min(F.struct("rank", "surface", "kind", "alias")).alias("x")).select("doc_id", "key", "x.surface", "x.kind", "x.alias")


def find_suspects(docs: DataFrame, glossary: DataFrame, allow: DataFrame, restore: DataFrame, make: Callable) -> DataFrame:
    """doc_id, key, surface, kind, alias of the terms in docs (doc_id, text) that neither the glossary (surfaces) nor the allow list
    (surface) knows and that are not masked already (restore: doc_id, surface)."""
    known = glossary.select(F.explode("surfaces").alias("surface")).unionByName(allow.select("surface")).select(key(F.col("surface")).alias("key")).filter(F.col("key") != "")
    return suspects(proposed(docs, make), known, restore.select("doc_id", key(F.col("surface")).alias("key")).distinct())


def suspects(found: DataFrame, known: DataFrame, masked: DataFrame) -> DataFrame:
    """Candidates (doc_id, key, surface) that no known key (key) and no masked surface of their document (doc_id, key) covers.

    A candidate is covered if it is one of them, if it holds or lies within a masked one, or holds a known one of three
    letters at least. Masked ones meet within their document; known ones by the candidate's substrings, an equi-join.
    """
    left = found.join(known.select("key").distinct(), "key", "left_anti")
    near = masked.filter(F.col("key") != "").select("doc_id", F.col("key").alias("m")).groupBy("doc_id").agg(F.collect_set("m").alias("ms"))
    open_ = left.join(near, "doc_id", "left").filter(~F.coalesce(F.exists("ms", lambda m: F.contains("key", m) | F.contains(m, F.col("key"))), F.lit(False))).drop("ms")
    open_ = settle(open_)  # read twice, and the model's answers stand behind it
    n, longest = F.length("key"), known.agg(F.max(F.length("key"))).first()[0] or 0
    starts = F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1)))
    # no part is longer than the longest known key, however long a candidate is
    parts = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(3), F.greatest(F.least(n - i + 1, F.lit(longest)), F.lit(3))), lambda w: F.substr("key", i, w))))
    holds = open_.select("key").distinct().select("key", F.explode(F.array_distinct(parts)).alias("part")).join(known.filter(F.length("key") >= 3).select(F.col("key").alias("part")).distinct(), "part").select("key").distinct()
    return open_.join(holds, "key", "left_anti")


def masked_ratio(masked_chars: Column, chars: Column) -> Column:
    return F.when(chars > 0, masked_chars / chars).otherwise(0.0)


def decide(rows: DataFrame, cfg: GateConfig | None = None) -> DataFrame:
    """``rows`` with route and reasons, from (text, secrets, l3_ids, n_suspects, masked_chars, n_spans): first match wins."""
    cfg = cfg or GateConfig()
    chars = F.length("text")
    ratio = masked_ratio(F.col("masked_chars"), chars)
    secret = (F.col("secrets") > 0) & F.lit(cfg.secret_policy == "block")
    dense = (chars >= cfg.min_ratio_chars) & (ratio >= cfg.max_masked_ratio)
    count = lambda c, what: F.concat(c.cast("string"), F.lit(what))
    steps = [
        (secret, "block", count(F.col("secrets"), " secrets")), (has_token(F.col("text")), "block", F.lit("token-like text")), (F.size("l3_ids") > 0, "local_only", F.lit("level 3 terms")),
        (F.col("n_suspects") > cfg.max_suspects, "block", count(F.col("n_suspects"), " suspects")), (F.col("n_suspects") > 0, "needs_confirmation", count(F.col("n_suspects"), " suspects")),
        (dense, "block", count(F.round(100 * ratio).cast("int"), "% masked")), (F.col("n_spans") == 0, "cloud_raw", F.lit("nothing sensitive")),
    ]
    route, reason = F.lit("cloud_masked"), count(F.col("n_spans"), " masked")
    for test, name, why in reversed(steps):
        route, reason = F.when(test, F.lit(name)).otherwise(route), F.when(test, why).otherwise(reason)
    return rows.withColumn("route", route).withColumn("reasons", F.array(reason))


def outgoing(routed: DataFrame) -> DataFrame:
    """``routed`` with ``out``, the text that may leave: the document, its masked form, or nothing."""
    return routed.withColumn("out", F.when(F.col("route") == "cloud_raw", F.col("text")).when(F.col("route") == "cloud_masked", F.col("masked")).otherwise(F.lit("")))


def audit_rows(routed: DataFrame, project: str | None = None, job_id: str | None = None, via: str | None = None) -> DataFrame:
    """One row for each decision; hashes, counts and reasons only, never text, terms or file names."""
    own = lambda c, otherwise: F.col(c) if c in routed.columns else otherwise
    leaves = F.col("route") == "cloud_masked"
    return routed.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("time"), "route", F.coalesce(own("source_hash", F.lit(None).cast("string")), sha16(F.col("text"))).alias("source"), F.lit(project).cast("string").alias("project"),
        F.length("text").cast("long").alias("chars_in"), F.length("out").cast("long").alias("chars_out"), F.when(leaves, own("counts", F.lit(None).cast("map<string,bigint>"))).alias("counts"), "reasons",
        F.when(F.col("route").isin("cloud_raw", "cloud_masked"), F.lit(job_id)).cast("string").alias("job_id"), own("local_answer", F.lit(False)).alias("local_answer"), F.col("n_suspects").cast("long").alias("suspects"), F.lit(via).cast("string").alias("via"),
    )


def span_counts(spans: Column) -> Column:
    """The number of spans of each type, as a map."""
    kinds = F.array_sort(F.array_distinct(F.transform(spans, lambda x: x["type"])))
    return F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter(spans, lambda x: x["type"] == k)).cast("long")))


def local_answers(routed: DataFrame, question: str, make: Callable) -> DataFrame:
    """doc_id, answer: what the local model says to ``question`` about each document that must not leave; it reads the first
    LOCAL_CHARS characters (the limit is the feature) and says so where that is not all."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "answer": [provider.answer(t, question) + note for t, note in zip(f["text"], f["note"], strict=True)]})

    note = F.when(F.length("text") > LOCAL_CHARS, f"\n\n(only the first {LOCAL_CHARS} characters were read)").otherwise("")
    held = routed.filter("route = 'local_only'").select("doc_id", F.substring("text", 1, LOCAL_CHARS).alias("text"), note.alias("note"))
    return held.mapInPandas(run, "doc_id long, answer string")


def audit_rollup(audit: DataFrame) -> DataFrame:
    return audit.groupBy("route").agg(F.count("*").alias("documents"), F.sum("chars_in").alias("chars_in"), F.sum("chars_out").alias("chars_out"))

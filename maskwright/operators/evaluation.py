"""Evaluation jobs: compositions of the operators over labelled sets, one DataFrame for each job."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.functions.rules import detect
from maskwright.functions.spans import resolve, surface
from maskwright.functions.text import key, norm, rate
from maskwright.functions.tokens import make_token, repair, splice, tokens
from maskwright.operators import gate, linking, metrics, router
from maskwright.operators.glossary import Entry, surface_pattern
from maskwright.plans.staging import numbered

#: Languages of the transforms, and how much of the documents an attacker reads.
LANGS, CONTEXT_CHARS = ("ko", "ja", "en"), 6_000


def predictions(labelled: DataFrame, with_rules: bool = True) -> DataFrame:
    """id, start, end, type of resolved spans for (id, text; optionally llm_spans)."""
    parts = ([detect(F.col("text"))] if with_rules else []) + ([F.col("llm_spans")] if "llm_spans" in labelled.columns else [])
    return labelled.select("id", F.explode(resolve(F.concat(*parts))).alias("x")).select("id", "x.start", "x.end", "x.type")


def detection(labelled: DataFrame, modes: dict[str, DataFrame]) -> DataFrame:
    """mode, type, counts and scores: exact matches of each mode's predictions with the labelled spans."""
    gold = labelled.select("id", F.explode("spans").alias("x")).select("id", "x.start", "x.end", "x.type")
    out = None
    for mode, pred in modes.items():
        rows = metrics.score_table(metrics.exact_matches(gold, pred)).withColumn("mode", F.lit(mode))
        out = rows if out is None else out.unionByName(rows)
    return out


def linked_names(labelled: DataFrame, romans: DataFrame | None = None) -> DataFrame:
    """id (surface), gold, pred for every person surface; without romanised names (surface, family, given) clusters are equal
    normal forms. A surface's entity is that of its first mention; one without is alone."""
    rows = labelled.select("id", "text", F.posexplode("spans").alias("ord", "x")).filter("x.type = 'PERSON'").select("id", "ord", surface(F.col("text"), F.col("x")).alias("s"), F.col("x.entity_id").alias("e"))
    first = rows.groupBy("s").agg(F.min_by(F.coalesce("e", F.concat(F.lit("_single_"), F.col("s"))), F.struct("id", "ord")).alias("gold"))
    if romans is None:
        return first.select(F.col("s").alias("id"), "gold", norm(F.col("s")).alias("pred"))
    roots = linking.link(first.join(romans, F.col("s") == F.col("surface")).select(F.col("s").alias("id"), "family", "given"))
    return first.join(roots, F.col("s") == F.col("id")).select("id", "gold", F.col("root").alias("pred"))


def relinked(labelled: DataFrame, romans: DataFrame) -> DataFrame:
    """Linking scored again from saved romanised names (surface, family, given), without a model: clusters, exact, rate, wrong, split
    and the pairs' tp, fp, fn, p, r, f."""
    members = linked_names(labelled, romans)
    return metrics.cluster_exact(members).crossJoin(metrics.wrong_and_split(members)).crossJoin(metrics.pair_scores(members))  # one row each


def connectivity(provider) -> dict:
    """Whether a provider answers in the form that is asked of it; without one, that there is none."""
    if provider is None:
        return {"ok": False, "error": "no model"}
    try:
        found = provider.detect("Yesterday Ann Field wrote from 4 Mill Lane, Leeds.")
        return {"ok": isinstance(found, list) and all(len(x) == 2 for x in found), "found": len(found)}
    except (OSError, ValueError, KeyError) as e:
        return {"ok": False, "error": str(e)}


def bootstrap_scores(groups: DataFrame, excluded: DataFrame, gold: DataFrame, persons: DataFrame, suggested: DataFrame | None = None) -> DataFrame:
    """One row of metrics of proposals (root, title, surfaces) and excluded ones against gold (id, surface) and persons (surface).

    candidates, excluded, entries, entries_found, spellings, spellings_found, with_suggestions, precision, wrong_merges,
    fragmented, gold_excluded, persons_proposed, suggestions, suggestions_right. Spellings meet by their keys.
    """
    owner = gold.select("id", key(F.col("surface")).alias("key")).distinct()
    spelt = lambda df: df.select("root", F.explode(F.transform("surfaces", lambda x: x["surface"])).alias("s")).select("root", key(F.col("s")).alias("key")).distinct()
    own = spelt(groups).join(owner, "key")
    sugg = (suggested if suggested is not None else groups.sparkSession.createDataFrame([], "root string, surface string")).select("root", key(F.col("surface")).alias("key")).distinct()
    per_group = own.groupBy("root").agg(F.countDistinct("id").alias("n"))
    judged = sugg.join(owner, "key", "left").join(own.select("root", F.col("id").alias("own")).distinct(), "root", "left").groupBy("root", "key").agg(F.max(F.coalesce(F.col("id") == F.col("own"), F.lit(False))).alias("right"))
    person_keys = persons.select(key(F.col("surface")).alias("key")).distinct()
    rows = [
        groups.agg(F.count("*").alias("candidates")), excluded.agg(F.count("*").alias("excluded")), gold.agg(F.countDistinct("id").alias("entries")), own.agg(F.countDistinct("id").alias("entries_found")),
        owner.agg(F.countDistinct("key").alias("spellings")), own.agg(F.countDistinct("key").alias("spellings_found")), own.select("key").unionByName(sugg.join(owner, "key", "left_semi").select("key")).agg(F.countDistinct("key").alias("with_suggestions")),
        per_group.agg(F.count("*").alias("precise"), F.count_if(F.col("n") > 1).alias("wrong_merges")), own.select("root", "id").distinct().groupBy("id").count().agg(F.count_if(F.col("count") > 1).alias("fragmented")),
        spelt(excluded).join(owner, "key").agg(F.countDistinct("root").alias("gold_excluded")), spelt(groups).join(person_keys, "key").agg(F.countDistinct("root").alias("persons_proposed")), judged.agg(F.count("*").alias("suggestions"), F.count_if("right").alias("suggestions_right")),
    ]
    out = functools.reduce(lambda a, b: a.crossJoin(b), rows)  # one row each
    return out.withColumn("precision", rate(F.col("precise"), F.col("candidates"))).drop("precise")


def replies(contexts: DataFrame, ask: Callable, make: Callable) -> DataFrame:
    """``contexts`` (id, context, prompt) with reply: ``ask(provider, context, prompt)`` over the first CONTEXT_CHARS characters (the
    limit is the feature) for questions and for attacks alike."""

    def run(frames):
        provider = make()
        for f in frames:
            yield f.assign(reply=[ask(provider, c, p) for c, p in zip(f["context"], f["prompt"], strict=True)])

    cut = contexts.select("id", F.substring("context", 1, CONTEXT_CHARS).alias("context"), "prompt")
    return cut.mapInPandas(run, T.StructType([*cut.schema.fields, T.StructField("reply", T.StringType())]))


def related(entries: DataFrame, docs: DataFrame) -> DataFrame:
    """id, doc_id: the documents that hold any spelling of an entry (id, surfaces), in any variant."""
    listed = entries.select("id", F.explode("surfaces").alias("surface")).collect()  # a glossary is written by hand
    hits = F.array(*[F.when(F.rlike("text", F.lit(surface_pattern(r["surface"]))), F.lit(r["id"])) for r in listed]) if listed else F.array().cast("array<string>")
    return docs.select("doc_id", F.explode(F.array_distinct(F.array_compact(hits))).alias("id")).select("id", "doc_id")


def semantic_leaks(masked_by_mode: dict[str, DataFrame], targets: DataFrame, make: Callable) -> DataFrame:
    """mode, facts, leaked, rate, names_recovered: what an attacker who sees the masked documents (doc_id, masked) says about each
    target (id, token, surfaces, doc_ids, facts)."""
    out = None
    for mode, docs in masked_by_mode.items():
        met = targets.select("id", "token", "surfaces", "facts", F.explode("doc_ids").alias("doc_id")).join(docs, "doc_id")
        contexts = met.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "masked"))), lambda x: x["masked"]), "\n\n").alias("context"), F.first("token").alias("prompt"))
        said = replies(contexts, lambda p, c, t: p.attack(c, t), make).join(targets.select("id", "surfaces", "facts"), "id")
        named = F.exists("surfaces", lambda s: F.contains(F.lower("reply"), F.lower(s)))
        rows = metrics.leaks(said).crossJoin(said.agg(F.count_if(named).alias("names_recovered"))).withColumn("mode", F.lit(mode))  # one row each
        out = rows if out is None else out.unionByName(rows)
    return out


def rewritten(masked: DataFrame, make: Callable) -> DataFrame:
    """id, kind, target, source, output, repaired: every masked text (id, lang, masked) translated into its targets, and groups of
    them summarised; then tokens repaired. ``metrics.preservation`` scores both columns."""
    targets, groups = transform_inputs(masked)
    asked = targets.select(F.col("id").cast("string").alias("id"), F.lit("translate").alias("kind"), "target", F.col("masked").alias("source"))
    asked = asked.unionByName(groups.select(F.col("group_no").cast("string").alias("id"), F.lit("summarize").alias("kind"), F.explode(F.array(*map(F.lit, LANGS))).alias("target"), F.col("text").alias("source")))

    def run(frames):
        provider = make()
        for f in frames:
            yield f.assign(output=[(provider.translate if k == "translate" else provider.summarize)(s, t) for k, t, s in zip(f["kind"], f["target"], f["source"], strict=True)])

    said = asked.mapInPandas(run, "id string, kind string, target string, source string, output string")
    return said.withColumn("repaired", repair(F.col("output"), tokens(F.col("source"))))


def gold_masked(labelled: DataFrame) -> DataFrame:
    """id, lang, text, masked: labelled spans replaced by tokens numbered within the row."""
    spans = F.transform(F.array_sort("spans"), lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), make_token(x["type"], i + 1).alias("render")))
    return labelled.select("id", "lang", "text", splice(F.col("text"), spans, lambda x: x["render"]).alias("masked"))


def transform_inputs(masked: DataFrame, langs: tuple[str, ...] = LANGS, group: int = 10) -> tuple[DataFrame, DataFrame]:
    """(id, masked, target: the first two languages that are not the row's; group_no, text: ten rows joined, for summaries)."""
    main = F.element_at(F.split("lang", r"\+"), 1)
    targets = masked.select("id", "masked", F.explode(F.slice(F.array_except(F.array(*map(F.lit, langs)), F.array(main)), 1, 2)).alias("target"))
    turned = numbered(masked.withColumn("one", F.lit(0)), "one", ["id"], "turn")
    joined = turned.withColumn("group_no", F.floor((F.col("turn") - 1) / group)).groupBy("group_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "masked"))), lambda x: x["masked"]), "\n").alias("text"))
    return targets, joined


def glossary_gate(docs: DataFrame, glossary: list[Entry]) -> DataFrame:
    """doc_id, level, matches, blocked: what the gate sees of each level in each document."""
    rows = gate.analyse(docs, glossary).select("doc_id", "blocked", F.explode("glossary_spans").alias("x"))
    return rows.groupBy("doc_id", F.col("x.level").alias("level")).agg(F.count("*").alias("matches"), F.first("blocked").alias("blocked"))


def exposure_by_mode(texts_by_mode: dict[str, DataFrame], terms: list[str]) -> DataFrame:
    """mode, exposures of protected terms."""
    out = None
    for mode, texts in texts_by_mode.items():
        rows = metrics.exposure(texts, terms).agg(F.coalesce(F.sum("exposures"), F.lit(0)).alias("exposures")).withColumn("mode", F.lit(mode))
        out = rows if out is None else out.unionByName(rows)
    return out


def chunk_leaks(docs: DataFrame, names: list[str], mask: Callable[[DataFrame, int], DataFrame], sizes: tuple[int, ...] = (1500, 300)) -> DataFrame:
    """size, leaked: names left in the text that ``mask`` makes (doc_id, masked) with each chunk size."""
    out = None
    for size in sizes:
        left = F.lit(0)
        for n in names:
            left = left + metrics.substring_count(F.col("masked"), F.lit(n))
        rows = mask(docs, size).agg(F.sum(left).alias("leaked")).withColumn("size", F.lit(size))
        out = rows if out is None else out.unionByName(rows)
    return out


def leave_one_out(docs: DataFrame, glossary: DataFrame) -> DataFrame:
    """dropped, doc_id, held: for each glossary spelling (id, key) and each document that has it as a candidate, whether the
    rest of the glossary would still hold the document for it. The entry's own spellings are dropped with it."""
    found = router.candidates(docs)
    met = found.join(glossary.select(F.col("id").alias("dropped"), "key"), "key")
    others = glossary.select(F.col("id").alias("other"), F.col("key").alias("k"))
    covered = met.join(others, (F.col("key") == F.col("k")) & (F.col("other") != F.col("dropped")), "left")
    return covered.groupBy("dropped", "doc_id", "key").agg(F.count("other").alias("n")).select("dropped", "doc_id", "key", (F.col("n") == 0).alias("held"))

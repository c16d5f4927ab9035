"""The gate: every document's spans by rules, glossary and detector, the level-3 stop, masking, and its result row."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions.rules import detect
from maskwright.functions.spans import resolve, surface
from maskwright.functions.structure import reduce_context
from maskwright.functions.tokens import canonical, has_token, tokens
from maskwright.operators import glossary as glossaries
from maskwright.operators import linking, pseudonyms

#: Defaults of the gate.
MAX_LINK_SURFACES, DETECT_CHARS, CHUNK_CHARS = 200, 300, 1500


@dataclass(frozen=True)
class GateConfig:
    secret_policy: str = "block"
    max_masked_ratio: float = 0.30
    max_suspects: int = 20
    model: str | None = None
    link: bool = True
    min_ratio_chars: int = 300
    projects: dict[str, list[str]] = field(default_factory=dict)
    allowed_roots: tuple[str, ...] = ()


def analyse(docs: DataFrame, glossary: list[glossaries.Entry] | None = None) -> DataFrame:
    """``docs`` (doc_id, text; optionally llm_spans) with rule_spans, glossary_spans, l3_ids, blocked, refused and spans. A text that
    holds something like a token is refused: it could not be restored without doubt.

    Level 3 is judged on all glossary matches, before overlaps are resolved. Public terms (level 0) take part in that, so they
    shield their place from the detector, and are dropped after it.
    """
    text = F.col("text")
    out = docs.withColumn("rule_spans", detect(text)).withColumn("glossary_spans", glossaries.match(text, glossary or []))
    every = F.concat("rule_spans", "glossary_spans", *(["llm_spans"] if "llm_spans" in docs.columns else []))
    l3 = F.array_sort(F.array_distinct(F.transform(F.filter("glossary_spans", lambda x: x["level"] == 3), lambda x: x["entity_id"])))
    out = out.withColumn("l3_ids", l3).withColumn("blocked", F.size("l3_ids") > 0).withColumn("refused", has_token(text))
    return out.withColumn("spans", resolved(every))


def resolved(spans: Column) -> Column:
    """Disjoint spans without the public ones."""
    return F.filter(resolve(spans), lambda x: F.coalesce(x["level"] != 0, F.lit(True)))


def mask(analysed: DataFrame, entities: DataFrame, surfaces: DataFrame, links: DataFrame | None = None, l2_context: str = "keep", glossary: list[glossaries.Entry] | None = None, rewrite=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Masked documents (blocked and refused ones have empty text and number nothing), restore rows, numbered surfaces."""
    if l2_context not in ("keep", "generalize", "drop"):
        raise ValueError("l2_context is keep, generalize or drop")
    masked, restore, numbered = pseudonyms.mask(analysed.filter(~F.col("blocked") & ~F.col("refused")), entities, surfaces, links)
    if l2_context != "keep":
        hidden = F.array(*[F.lit(e.token) for e in glossary or [] if e.effective_level == 2]).cast("array<string>")
        masked = masked.withColumn("masked", reduce_context(F.col("masked"), hidden, tokens, rewrite if l2_context == "generalize" else None))
    stopped = analysed.filter("blocked or refused").withColumn("masked", F.lit(""))
    return masked.unionByName(stopped), restore, numbered


def link_candidates(analysed: DataFrame, surfaces: DataFrame, limit: int = MAX_LINK_SURFACES) -> DataFrame:
    """doc_id, ord, surface: a document's person names, distinct, in order; then (doc_id null) the known ones in theirs, once for
    all documents. A document's list is its own names and then the known ones that it lacks, up to ``limit`` in all (the limit
    is the feature: it bounds what an external model is asked)."""
    named = F.transform(F.filter("spans", lambda x: x["type"] == "PERSON"), lambda x: surface(F.col("text"), x))
    own = analysed.select("doc_id", F.posexplode(F.slice(F.array_distinct(named), 1, limit)).alias("at", "surface")).select("doc_id", (F.col("at") + 1).cast("int").alias("ord"), "surface")
    known = surfaces.filter("type = 'PERSON'").groupBy("surface").agg(F.min(F.struct("ord", "token")).alias("first")).orderBy("first", "surface").limit(limit)
    turn = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("first", "surface"))  # at most ``limit`` rows
    return own.unionByName(known.select(F.lit(None).cast("long").alias("doc_id"), turn.cast("int").alias("ord"), "surface"))


def person_links(candidates: DataFrame, romans: DataFrame, surfaces: DataFrame) -> DataFrame:
    """surface, alias, ord for pseudonyms.mask: each name leads to the first known spelling of its person (ord 0) and to the first
    of the spellings met with it (ord 1), so a person of many spellings needs two rows for each and no pairs.

    ``candidates`` as of ``link_candidates``; ``romans``: surface, family, given.
    """
    names = candidates.select("surface").distinct().join(romans, "surface")
    roots = linking.link(names.select(F.col("surface").alias("id"), "family", "given")).select(F.col("id").alias("surface"), "root")
    known = surfaces.filter("type = 'PERSON'").groupBy("surface").agg(F.min("ord").alias("known"))
    rooted = roots.join(known, "surface", "left")
    heads = rooted.groupBy("root").agg(F.min_by("surface", F.when(F.col("known").isNotNull(), F.struct("known", "surface"))).alias("old"), F.min("surface").alias("new"), F.count("*").alias("n")).filter("n > 1")
    both = F.array(F.struct(F.col("old").alias("alias"), F.lit(0).alias("ord")), F.struct(F.col("new").alias("alias"), F.lit(1).alias("ord")))
    return rooted.join(heads, "root").select("surface", F.inline(both)).filter(F.col("alias").isNotNull() & (F.col("alias") != F.col("surface")))


def entity_listing(surfaces: DataFrame) -> DataFrame:
    """token, type, n_spellings: never a value."""
    return surfaces.groupBy("token", "type").agg(F.countDistinct("surface").alias("n_spellings"))


def bare(token: F.Column) -> F.Column:
    return canonical(token)

"""Glossary bootstrap: term candidates of a document set, grouped to one proposal for each thing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.functions.spans import surface
from maskwright.functions.structure import chunks, code_names, title_names
from maskwright.functions.text import clean_surface, is_latin, key, similarity, sound
from maskwright.operators.glossary import KINDS, surface_pattern
from maskwright.plans.staging import components, settle
from maskwright.sources import providers

MODEL_CHARS, PUBLIC_BATCH, TRANSLITERATION_BATCH, SOUND_RATIO, CHUNK_CHARS = 1500, 20, 25, 0.85, 300


def deterministic_terms(docs: DataFrame) -> DataFrame:
    """doc_id, surface, key, source ('code' or 'title') of code names and title-case names."""

    def found(fn: Callable, source: str) -> Column:
        return F.transform(fn(F.col("text")), lambda x: F.struct(clean_surface(x).alias("surface"), F.lit(source).alias("source")))

    rows = docs.select("doc_id", F.explode(F.concat(found(code_names, "code"), found(title_names, "title"))).alias("x"))
    return rows.select("doc_id", "x.surface", "x.source").filter(F.length("surface") >= 2).withColumn("key", key(F.col("surface")))


def model_terms(docs: DataFrame, make: Callable) -> DataFrame:
    """doc_id, surface, key, source ('llm'), kind, description; strings that the text does not hold are dropped."""
    schema = "doc_id long, surface string, kind string, description string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for f in frames:
            rows = [(d, t["text"], t.get("kind") if t.get("kind") in KINDS else "TERM", t.get("description", "")) for d, c in zip(f["doc_id"], f["chunk"], strict=True) for t in provider.extract_terms(c) if t.get("text") and t["text"] in c]
            yield pd.DataFrame(rows, columns=["doc_id", "surface", "kind", "description"])

    cut = docs.select("doc_id", F.explode(chunks(F.col("text"), MODEL_CHARS)).alias("c")).select("doc_id", F.col("c.chunk").alias("chunk"))
    found = cut.mapInPandas(run, schema).withColumn("surface", clean_surface(F.col("surface"))).filter(F.length("surface") >= 2)
    return found.withColumn("key", key(F.col("surface"))).withColumn("source", F.lit("llm"))


def without_persons(terms: DataFrame, persons: DataFrame) -> DataFrame:
    """Terms whose key is not a detected person's (surface), whenever that was met."""
    return terms.join(persons.select(key(F.col("surface")).alias("key")).distinct(), "key", "left_anti")


def _word_hits(docs: DataFrame, surfaces: DataFrame) -> DataFrame:
    """doc_id, surface, n of Latin spellings. Runs of words with one separator between are cut into all their short sequences;
    a sequence whose folded letters are a spelling's key meets it by an equi-join, and its pattern has the last word."""
    longest = surfaces.agg(F.max(F.length("key"))).first()[0] or 0
    runs = F.regexp_extract_all("text", F.lit(r"(?U)[A-Za-z0-9]+(?:[\s_\-・·.][A-Za-z0-9]+)*"), F.lit(0))
    words = docs.select("doc_id", F.explode(runs).alias("run")).withColumn("words", F.split("run", r"(?U)[\s_\-・·.]"))
    # a sequence has a letter a word at least, so no more words than the longest key has letters, nor more letters
    ends = lambda i: F.sequence(i, F.least(F.size("words") - 1, i + F.lit(max(longest, 1) - 1)))
    sequences = F.flatten(F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.filter(F.transform(ends(i), lambda j: F.struct(F.lower(F.array_join(F.slice("words", i + 1, j - i + 1), "")).alias("key"), F.array_join(F.slice("words", i + 1, j - i + 1), " ").alias("shown"))), lambda x: F.length(x["key"]) <= longest)))
    met = words.select("doc_id", F.inline(sequences)).groupBy("doc_id", "key", "shown").agg(F.count("*").alias("n")).join(surfaces, "key")
    return met.filter(F.rlike("shown", "pattern")).groupBy("doc_id", "surface").agg(F.sum("n").alias("n"))


def _sign_hits(docs: DataFrame, surfaces: DataFrame) -> DataFrame:
    """doc_id, surface, n of spellings with signs beyond ASCII: documents that have the first two such signs of a spelling next to
    each other meet it by an equi-join, and only their texts are searched."""
    run = F.regexp_extract("surface", r"[^\x00-\x7F]{1,2}", 0)
    wanted = surfaces.withColumn("hint", run)
    signs = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(r"[^\x00-\x7F]+"), F.lit(0)), lambda x: F.flatten(F.transform(F.sequence(F.lit(1), F.length(x)), lambda k: F.array(F.substr(x, k, F.lit(1)), F.substr(x, k, F.lit(2)))))))
    near = docs.select("doc_id", F.explode(F.array_distinct(signs)).alias("hint")).join(wanted, "hint").select("doc_id", "surface", "pattern")
    return near.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "surface", F.regexp_count("text", F.col("pattern")).cast("long").alias("n")).filter("n > 0")


def count_surfaces(docs: DataFrame, surfaces: DataFrame) -> DataFrame:
    """surface, doc_id, n: each spelling (surface, key) counted in each document by its own variant-tolerant pattern, so spellings
    of one term each count all its variants. Only documents that can hold a spelling meet it, and nothing is collected. Latin
    spellings that overlap themselves ("a a" in "a a a") count at each place."""
    patterned = surfaces.select("surface", "key").distinct().withColumn("pattern", pattern_of(F.col("surface")))
    latin = is_latin(F.col("surface"))
    return _word_hits(docs, patterned.filter(latin)).unionByName(_sign_hits(docs, patterned.filter(~latin))).select("surface", "doc_id", "n")


@F.pandas_udf(T.StringType())
def pattern_of(surface: pd.Series) -> pd.Series:
    """``surface_pattern`` for a column of spellings (a vocabulary, not texts)."""
    return surface.map(surface_pattern)


def public_terms(titles: DataFrame, make: Callable) -> DataFrame:
    """title, public: the provider's verdict on each title, matched back by the term itself."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for f in frames:
            names = list(f["title"])
            for k in range(0, len(names), PUBLIC_BATCH):
                part = names[k : k + PUBLIC_BATCH]
                known = provider.public_terms(part)
                yield pd.DataFrame({"title": part, "public": [t in known for t in part]})

    return titles.select("title").distinct().mapInPandas(run, "title string, public boolean")


def title_of(surfaces: Column) -> Column:
    """Of array<struct<surface,n,ord>> the most frequent spelling; then one that is not Latin, then the shorter, then the first."""
    best = F.array_max(F.transform(surfaces, lambda x: F.struct(x["n"], ~is_latin(x["surface"]), -F.length(x["surface"]), -x["ord"], x["surface"])))
    return best["surface"]


def main_kind(kinds: Column) -> Column:
    """Of array<struct<kind,n,ord>> the most frequent, the first on ties; TERM if there is none."""
    best = F.array_max(F.transform(kinds, lambda x: F.struct(x["n"], -x["ord"], x["kind"])))
    return F.coalesce(best["kind"], F.lit("TERM"))


def definition_edges(docs: DataFrame, surfaces: DataFrame) -> DataFrame:
    """a, b (keys): a term and what stands in brackets right after it, where that is a term too.

    Equal brackets after equal characters are one from the start, and only those that hold a term are looked at further. The term
    before such a bracket is a known surface that the line ends with there, found by an equi-join on the line's last characters,
    as many as the longest surface has.
    """
    longest = surfaces.agg(F.max(F.length("surface"))).first()[0] or 0
    pattern = r"(?U)\s?[(（]([^()（）\n]{2,40})[)）]"
    line = docs.select(F.explode(F.split("text", "\n")).alias("line")).filter(F.rlike("line", F.lit(pattern)))
    cut = line.select(F.split("line", pattern, -1).alias("gaps"), F.regexp_extract_all("line", F.lit(pattern), F.lit(0)).alias("all"), F.regexp_extract_all("line", F.lit(pattern), F.lit(1)).alias("inner"))
    # what stands before a bracket goes back through earlier brackets: a term may hold some; with four signs a bracket at least,
    # its last characters take a quarter as many brackets
    back = lambda i: F.least(i, F.lit(longest // 4 + 1))
    before = lambda i: F.right(F.concat(F.array_join(F.transform(F.slice("all", i - back(i) + 1, back(i)), lambda x, j: F.concat(F.get("gaps", i - back(i) + j), x)), ""), F.get("gaps", i)), F.lit(longest))
    pairs = cut.select(F.explode(F.transform("inner", lambda x, i: F.struct(before(i).alias("before"), F.trim(x).alias("inner")))).alias("x")).select("x.before", "x.inner").filter(F.length("before") > 0).distinct()
    held = pairs.withColumn("b", key(F.col("inner"))).join(surfaces.select(F.col("key").alias("b")).distinct(), "b", "left_semi").select("before", "b").distinct()
    tails = F.transform(F.sequence(F.lit(1), F.length("before")), lambda n: F.right("before", n))
    # shuffled whatever Spark expects: it cannot tell how many tails a small file gives, and would collect them for a broadcast
    met = held.select("b", F.explode(tails).alias("surface")).join(surfaces.select("surface", F.col("key").alias("a")).distinct().hint("merge"), "surface")
    return met.filter(F.col("a") != F.col("b")).select("a", "b").distinct()


def spelt_in_english(surfaces: DataFrame, make: Callable) -> DataFrame:
    """key, english: the provider's guess at the English spelling that a term of another script transliterates."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for f in frames:
            for k in range(0, len(f), TRANSLITERATION_BATCH):
                part = f.iloc[k : k + TRANSLITERATION_BATCH]
                said = provider.transliterate(list(part["surface"]))
                yield pd.DataFrame({"key": part["key"], "english": [said.get(t, "") or "" for t in part["surface"]]})

    return surfaces.filter(~is_latin(F.col("surface"))).select("key", "surface").mapInPandas(run, "key string, english string").filter(F.col("english") != "")


def sound_edges(spelt: DataFrame, surfaces: DataFrame) -> DataFrame:
    """a, b (keys): a Latin term and a term in another script whose English spelling (key, english) sounds like it.

    A ratio of 0.85 needs a common pair of letters and lengths that differ by a third at most (twice the shorter length is 0.85
    of both at least), so candidates meet on pair and length; of several Latin terms the first by name."""
    two = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda k: F.substr(c, k, F.lit(2)))
    left = spelt.select("key", sound(F.col("english")).alias("s")).filter(F.length("s") >= 3).distinct()
    least, most = F.ceil(F.length("s") * SOUND_RATIO / (2 - SOUND_RATIO) - 1e-9).cast("int"), F.floor(F.length("s") * (2 - SOUND_RATIO) / SOUND_RATIO + 1e-9).cast("int")
    left = left.withColumn("two", F.explode(F.array_distinct(two(F.col("s"))))).withColumn("size", F.explode(F.sequence(least, most)))
    right = surfaces.filter(is_latin(F.col("surface"))).select(F.col("key").alias("latin"), sound(F.col("surface")).alias("t")).distinct().withColumn("two", F.explode(F.array_distinct(two(F.col("t"))))).withColumn("size", F.length("t"))
    met = left.join(right, ["two", "size"]).select("key", "latin", "s", "t").distinct().filter(similarity(F.col("s"), F.col("t")) >= SOUND_RATIO)
    return met.groupBy("key").agg(F.min("latin").alias("a")).select("a", F.col("key").alias("b"))


def merged(terms: DataFrame, counts: DataFrame, edges: DataFrame) -> DataFrame:
    """root, surfaces (surface, n, ord), kinds, descriptions, sources, documents: terms (key, surface, kind, description, source; one
    row for each mention) put together along ``edges`` (a, b), counts (surface, doc_id, n) added up; documents count once."""
    roots = components(edges).select(F.col("node").alias("key"), "root")
    rows = settle(terms.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")))
    spelt = rows.select("root", "surface").distinct()
    per_doc = settle(spelt.join(counts, "surface"))
    per = per_doc.groupBy("root", "surface").agg(F.sum("n").alias("n"))
    surfaces = per.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("surface", "n"))).alias("s"))
    documents = per_doc.select("root", "doc_id").distinct().groupBy("root").agg(F.count("*").alias("documents"))
    kinds = rows.filter(F.col("kind").isNotNull()).groupBy("root", "kind").agg(F.count("*").alias("n")).groupBy("root").agg(F.array_sort(F.collect_list(F.struct("kind", "n"))).alias("k"))
    texts = rows.groupBy("root").agg(F.array_sort(F.collect_set(F.when(F.col("description") != "", F.col("description")))).alias("descriptions"), F.array_sort(F.collect_set("source")).alias("sources"))
    with_ord = lambda c, name: F.transform(c, lambda x, i: F.struct(x[name].alias(name), x["n"].alias("n"), i.alias("ord")))
    out = surfaces.join(documents, "root").join(texts, "root").join(kinds, "root", "left")
    return out.select("root", with_ord(F.col("s"), "surface").alias("surfaces"), with_ord(F.coalesce("k", F.array().cast("array<struct<kind:string,n:bigint>>")), "kind").alias("kinds"), "descriptions", "sources", "documents")


def total_of(surfaces: Column) -> Column:
    return F.aggregate(F.transform(surfaces, lambda x: x["n"]), F.lit(0).cast("long"), lambda a, x: a + x)


def long_variants(groups: DataFrame) -> DataFrame:
    """root, into: a group met in one document whose key holds that of a more frequent group, which it is suggested to.

    Meets by substrings of the key (an equi-join), of the lengths that other keys can have. Of several the most frequent wins,
    then the greatest name; a group that is itself suggested to another takes no suggestions.
    """
    flat = settle(groups.select("root", "documents", total_of(F.col("surfaces")).alias("total"), F.explode(F.transform("surfaces", lambda x: x["surface"])).alias("surface")).withColumn("k", key(F.col("surface"))).filter(F.col("k") != ""))
    longest = flat.agg(F.max(F.length("k"))).first()[0] or 1
    n = F.length("k")
    inside = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), F.least(n - i + 1, F.lit(longest))), lambda w: F.substr("k", i, w))))
    small = flat.filter("documents <= 1").select("root", "total", "k", F.explode(F.array_distinct(inside)).alias("part")).filter("part != k")
    met = small.join(flat.select(F.col("root").alias("into"), F.col("total").alias("more"), F.col("k").alias("part")), "part").filter((F.col("into") != F.col("root")) & (F.col("more") > F.col("total")))
    best = settle(met.groupBy("root").agg(F.max_by("into", F.struct("more", "into")).alias("into")))
    return best.join(best.select(F.col("root").alias("into")), "into", "left_anti").select("root", "into")


def translations(groups: DataFrame, make: Callable) -> DataFrame:
    """root, surface: spellings of groups in other scripts that the provider takes for translations of a Latin group (root, title,
    surfaces). They are suggestions for a person, no merges; the proposals of one review go to the model in one question."""
    latin = F.exists("surfaces", lambda x: is_latin(x["surface"]))
    listed = groups.agg(F.array_sort(F.collect_list(F.when(latin, F.struct("root", "title")))).alias("latin"), F.array_sort(F.collect_list(F.when(~latin, F.struct("root", "title")))).alias("other"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for f in frames:
            for e, k in zip(f["latin"], f["other"], strict=True):
                pairs = provider.translations([x["title"] for x in e], [x["title"] for x in k]) if len(e) and len(k) else []
                good = [(i, j) for i, j in pairs if 0 <= i < len(k) and 0 <= j < len(e)]
                yield pd.DataFrame([(e[j]["root"], k[i]["root"]) for i, j in good], columns=["root", "other"])

    pairs = listed.mapInPandas(run, "root string, other string")
    return pairs.join(groups.select(F.col("root").alias("other"), F.explode(F.transform("surfaces", lambda x: x["surface"])).alias("surface")), "other").select("root", "surface")


def excluded(public: Column, sources: Column) -> Column:
    """Public terms go, unless a model proposed them; those are only marked."""
    return public & ~F.array_contains(sources, "llm")


def ordered(groups: DataFrame) -> DataFrame:
    """Groups with total, title and kind, most documents first, then most occurrences."""
    return groups.withColumn("total", total_of(F.col("surfaces"))).withColumn("title", title_of(F.col("surfaces"))).withColumn("kind", main_kind(F.col("kinds"))).orderBy(F.desc("documents"), F.desc("total"), "root")


def bootstrap(docs: DataFrame, make: Callable | None = None, persons: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(proposals, excluded) for documents (doc_id, text): candidates without persons (surface; by default what the provider
    detects), counts, public verdicts, merging by definition and sound, suggestions (``suggested``: translations and long
    variants), order."""
    terms = deterministic_terms(docs).select("key", "surface", "source", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("description"))
    if make is not None:
        terms = terms.unionByName(model_terms(docs, make).select("key", "surface", "source", "kind", "description"))
        if persons is None:
            found = providers.detected_spans(docs.select("doc_id", "text"), make, CHUNK_CHARS)
            persons = found.select("text", F.explode(F.filter("llm_spans", lambda x: x["type"] == "PERSON")).alias("x")).select(surface(F.col("text"), F.col("x")).alias("surface"))
    terms = settle((without_persons(terms, persons) if persons is not None else terms).filter(F.col("key") != ""))
    surfaces = settle(terms.select("surface", "key").distinct())
    edges = definition_edges(docs, surfaces)
    if make is not None:
        edges = edges.unionByName(sound_edges(settle(spelt_in_english(surfaces, make)), surfaces))
    titled = settle(ordered(merged(terms, settle(count_surfaces(docs, surfaces)), settle(edges))).withColumn("public", F.lit(False)))
    out = F.lit(False)
    if make is not None:
        judged = public_terms(titled, make).withColumnRenamed("public", "known")
        titled = settle(titled.join(judged, "title", "left").withColumn("public", F.coalesce("known", F.lit(False))).drop("known"))
        out = excluded(F.col("public"), F.col("sources"))
    kept = titled.filter(~out)
    variants = settle(long_variants(kept))
    spelt = kept.select("root", F.explode(F.transform("surfaces", lambda x: x["surface"])).alias("surface"))
    more = variants.join(spelt, "root").select(F.col("into").alias("root"), "surface")
    if make is not None:
        more = more.unionByName(translations(kept, make))
    suggested = more.groupBy("root").agg(F.array_sort(F.collect_set("surface")).alias("suggested"))
    final = kept.join(variants, "root", "left_anti").join(suggested, "root", "left").withColumn("suggested", F.coalesce("suggested", F.array().cast("array<string>")))
    return final.orderBy(F.desc("documents"), F.desc("total"), "root"), titled.filter(out)

"""Benchmark decontamination with a distributed positional inverted index.

The index holds postings (term, doc_id, position) of the training texts for the terms that drive the search: of each test
window its rarest terms by corpus frequency. A search starts from the postings of a window's rarest term, moves them by the
distance to its second rarest and intersects them with that term's postings; what is left is compared word by word with the
posting's neighbourhood, which is stored with it. Exact phrases and, with a slop, proximity matches come from the same lists.

Plan, DataFrame functions only: one pass over the texts counts the benchmark's vocabulary (sums combine on the map side), a
second writes the postings, neither shuffles text. Windows and vocabulary are broadcast if they have been counted to be small,
else shuffled. Postings meet by (doc_id, position, term), so neither a frequent term nor a passage that stands in a third of
all documents gathers in one task. A closing posting (the empty term at the position after the last word) carries each
document's length.

Null or empty text: no words, nothing hit. Rows that repeat a doc_id are read as one document: positions hit in any of them.
Null item text: no window. Empty tables: empty result, or nothing hit. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.workspace import bounded_broadcast, stage

_BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CLOSING = ""


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words: runs of digits, letters a-z and anything beyond ASCII. Null: none."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.octet_length(whole) == F.char_length(whole)  # cheaper to lower-case; beyond ASCII other letters must stay
    lower = F.when(ascii_only, F.lower(whole)).otherwise(F.translate(whole, _UPPER, _LOWER))
    return F.array_remove(F.split(lower, _BETWEEN_WORDS), "")


def benchmark_windows(benchmark: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (wid, words) of ``length`` consecutive words, an item of fewer being one window; and (wid, item_id)."""
    items = benchmark.select(F.col("item_id"), words_of(F.col("text")).alias("all")).filter(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - (length - 1), F.lit(1)))
    raw = stage(items.select("item_id", F.explode(starts).alias("at"), "all").select("item_id", F.slice("all", F.col("at"), length).alias("words")), "test-windows")
    windows = stage(raw.select("words").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    return windows, stage(raw.join(windows, "words").select("wid", "item_id").distinct(), "window-items")


def _terms(windows: DataFrame) -> DataFrame:
    return windows.select("wid", F.posexplode("words").alias("off", "term"))


def corpus_frequency(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """term, frequency over all words of all documents, for the given terms."""
    vocabulary, small = bounded_broadcast(terms.select("term").distinct(), 1_000_000)
    words = documents.select(F.explode(words_of(F.col("text"))).alias("term"))
    if small:
        return words.join(vocabulary, "term").groupBy("term").agg(F.count("*").alias("frequency"))
    # counted before they are shuffled, so the most frequent word is one row for each task
    return words.groupBy("term").agg(F.count("*").alias("frequency")).join(vocabulary, "term")


def search_plan(windows: DataFrame, frequency: DataFrame) -> DataFrame:
    """For each window that can occur at all: its rarest term and the next rarest, with their offsets.

    A window with a word that no document has is left out: it occurs nowhere.
    """
    terms = _terms(windows).join(frequency, "term", "left")
    by = Window.partitionBy("wid").orderBy("frequency", "off")
    rank = terms.withColumn("rank", F.row_number().over(by))
    first = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    chosen = rank.groupBy("wid").agg(first(1, "term").alias("term1"), first(1, "off").alias("off1"), first(2, "term").alias("t2"), first(2, "off").alias("o2"), F.count_if(F.col("frequency").isNull()).alias("absent"))
    chosen = chosen.filter("absent = 0").select("wid", "term1", "off1", F.coalesce("t2", "term1").alias("term2"), F.coalesce("o2", "off1").alias("off2"))
    return stage(chosen.join(windows, "wid").withColumn("delta", F.col("off2") - F.col("off1")), "search-plan")


def postings(documents: DataFrame, plan: DataFrame, length: int) -> DataFrame:
    """The stored index: term, doc_id, pos; for terms that lead a search also ``near``, the words around, and ``lead``, how many
    of them stand before the posting. The closing posting of each row has the empty term and the number of words."""
    roles = plan.select(F.col("term1").alias("term"), F.lit(True).alias("leads")).unionByName(plan.select(F.col("term2").alias("term"), F.lit(False).alias("leads")))
    closing = documents.sparkSession.createDataFrame([(_CLOSING, False)], "term string, leads boolean")
    roles = roles.unionByName(closing).groupBy("term").agg(F.max("leads").alias("leads"))
    listed, small = bounded_broadcast(roles, 1_000_000)
    texts = documents.select(F.col("doc_id"), words_of(F.col("text")).alias("words"))
    exploded = F.posexplode(F.concat("words", F.array(F.lit(_CLOSING)))).alias("pos", "term")
    if small:
        every = texts.select("doc_id", "words", exploded).join(listed, "term")
    else:  # words travel alone; which places count goes back to the text once
        rows = stage(texts.withColumn("row", F.monotonically_increasing_id()), "texts")
        at = rows.select("row", exploded).join(listed, "term").groupBy("row").agg(F.collect_list(F.struct("term", "leads", "pos")).alias("at"))
        every = rows.join(at, "row").select("doc_id", "words", F.inline("at"))
    lead = F.least(F.col("pos"), F.lit(length - 1))
    near = F.when(F.col("leads"), F.slice("words", F.col("pos") - lead + 1, lead + length))
    return stage(every.select("term", "doc_id", "pos", lead.alias("lead"), near.alias("near")), "postings")


def phrase_matches(index: DataFrame, plan: DataFrame) -> DataFrame:
    """doc_id, start, stop (past the last word), wid for every exact occurrence of every window."""
    pairs, _ = bounded_broadcast(plan.select("term1", "term2", "delta").distinct(), 1_000_000)
    led = index.filter(F.col("near").isNotNull()).withColumnRenamed("term", "term1").join(pairs, "term1")
    led = led.select("term1", "doc_id", "pos", "lead", "near", "term2", "delta", (F.col("pos") + F.col("delta")).alias("pos2"))
    second = index.filter(F.col("term") != _CLOSING).select(F.col("doc_id").alias("d"), F.col("term").alias("t"), F.col("pos").alias("p")).distinct()
    both = led.join(second, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("pos2") == F.col("p")) & (F.col("term2") == F.col("t")))
    listed, _ = bounded_broadcast(plan.select("wid", "words", "term1", "off1", "term2", "delta"), 500_000)
    tried = both.join(listed, ["term1", "term2", "delta"])
    size, begin = F.size("words"), F.col("lead") - F.col("off1")
    exact = (begin >= 0) & (F.slice("near", F.greatest(begin, F.lit(0)) + 1, size) == F.col("words"))
    start = F.col("pos") - F.col("off1")
    return tried.filter(exact).select("doc_id", start.alias("start"), (start + size).alias("stop"), "wid")


def proximity_matches(index: DataFrame, plan: DataFrame, slop: int) -> DataFrame:
    """doc_id, wid, pos1, pos2: the window's two rarest terms, at most ``slop`` words further apart or nearer than in the window.

    Positions are dealt into cells of 2 * slop + 1 words, so a frequent pair in one long text meets only its neighbours.
    """
    cell = 2 * slop + 1
    windows, _ = bounded_broadcast(plan.select("wid", "term1", "term2", "delta"), 500_000)
    led = index.filter(F.col("term") != _CLOSING).select("doc_id", F.col("term").alias("term1"), F.col("pos").alias("pos1")).distinct().join(windows, "term1").withColumn("aim", F.col("pos1") + F.col("delta"))
    led = led.withColumn("cell", F.explode(F.array_distinct(F.array(F.floor((F.col("aim") - slop) / cell), F.floor((F.col("aim") + slop) / cell)))))
    other = index.filter(F.col("term") != _CLOSING).select(F.col("doc_id").alias("d"), F.col("term").alias("t"), F.col("pos").alias("pos2")).distinct().withColumn("c", F.floor(F.col("pos2") / cell))
    met = led.join(other, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("term2") == F.col("t")) & (F.col("cell") == F.col("c")))
    apart = (F.abs(F.col("pos2") - F.col("aim")) <= slop) & ((F.col("pos1") != F.col("pos2")) | (F.col("delta") == 0))
    return met.filter(apart).select("doc_id", "wid", "pos1", "pos2").distinct()


def search(documents: DataFrame, benchmark: DataFrame, length: int = 10) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(index, plan, windows' items, phrase matches) of the benchmark's windows in the documents."""
    windows, members = benchmark_windows(benchmark, length)
    plan = search_plan(windows, corpus_frequency(documents, _terms(windows)))
    index = postings(documents, plan, length)
    return index, plan, members, stage(phrase_matches(index, plan), "matches")


def contamination(documents: DataFrame, benchmark: DataFrame, length: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted strings), contaminated: one row for each doc_id."""
    index, _, members, matches = search(documents, benchmark, length)
    sizes = index.filter(F.col("term") == _CLOSING).groupBy("doc_id").agg(F.max("pos").cast("long").alias("n_words"))
    spans = matches.groupBy("doc_id", "start").agg(F.max("stop").alias("stop"))
    before = Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("start"), F.coalesce(F.max("stop").over(before), F.lit(0))))
    hits = spans.select("doc_id", fresh.alias("fresh")).groupBy(F.col("doc_id").alias("hit_doc")).agg(F.sum("fresh").cast("long").alias("n_hit"))
    found, _ = bounded_broadcast(members, 1_000_000)
    items = matches.select("doc_id", "wid").distinct().join(found, "wid").select("doc_id", "item_id").distinct()
    items = items.groupBy(F.col("doc_id").alias("item_doc")).agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    out = sizes.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_doc")), "left").join(items, F.col("doc_id").eqNullSafe(F.col("item_doc")), "left")
    hit = F.coalesce("n_hit", F.lit(0))
    return out.select("doc_id", "n_words", hit.cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (hit > 0).alias("contaminated"))

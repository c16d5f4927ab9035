"""Evaluation: span matching, scores by type, clusters and pairs, leaks, exposure, preservation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions.text import prf, rate
from maskwright.functions.tokens import report
from maskwright.operators.glossary import surface_pattern


def exact_matches(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """type, tp, fp, fn of spans (id, start, end, type): equal spans meet one to one."""
    nth = F.row_number().over(Window.partitionBy("id", "start", "end", "type").orderBy(F.lit(0)))
    keys = ["id", "start", "end", "type", "nth"]
    g, p = gold.withColumn("nth", nth).select(*keys, F.lit(1).alias("g")), pred.withColumn("nth", nth).select(*keys, F.lit(1).alias("p"))
    met = g.join(p, keys, "full")
    both, only_p, only_g = F.col("g").isNotNull() & F.col("p").isNotNull(), F.col("g").isNull(), F.col("p").isNull()
    return met.groupBy("type").agg(F.count_if(both).alias("tp"), F.count_if(only_p).alias("fp"), F.count_if(only_g).alias("fn"))


def overlap_matches(gold: Column, pred: Column) -> Column:
    """Indexes into ``pred`` (or -1) for each span of ``gold``: in order, the first unused one of its type that overlaps."""
    state = F.array().cast("array<int>")

    def step(acc: Column, g: Column) -> Column:
        fits = F.filter(F.sequence(F.lit(0), F.size(pred) - 1), lambda i: (F.get(pred, i)["type"] == g["type"]) & (F.get(pred, i)["start"] < g["end"]) & (g["start"] < F.get(pred, i)["end"]) & ~F.array_contains(acc, i))
        return F.array_append(acc, F.when(F.size(pred) == 0, -1).otherwise(F.coalesce(F.get(fits, F.lit(0)), F.lit(-1))))

    return F.aggregate(gold, state, step)


def overlap_counts(rows: DataFrame) -> DataFrame:
    """type, tp, fp, fn from (id, gold, pred): arrays of spans."""
    met = rows.withColumn("hit", overlap_matches(F.col("gold"), F.col("pred")))
    g = met.select(F.explode(F.arrays_zip(F.transform("gold", lambda x: x["type"]).alias("type"), "hit")).alias("x")).select("x.type", (F.col("x.hit") >= 0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), (F.col("x.hit") < 0).cast("long").alias("fn"))
    unused = F.filter(F.transform("pred", lambda x, i: F.struct(x["type"].alias("type"), i.alias("i"))), lambda x: ~F.array_contains("hit", x["i"]))
    p = met.select(F.explode(unused).alias("x")).select("x.type", F.lit(0).cast("long").alias("tp"), F.lit(1).cast("long").alias("fp"), F.lit(0).cast("long").alias("fn"))
    return g.unionByName(p).groupBy("type").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def score_table(counts: DataFrame) -> DataFrame:
    """type (and ALL), tp, fp, fn, p, r, f."""
    rolled = counts.rollup("type").agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return rolled.select(F.coalesce("type", F.lit("ALL")).alias("type"), "tp", "fp", "fn", p.alias("p"), r.alias("r"), f.alias("f"))


def latency(rows: DataFrame) -> DataFrame:
    """mean, median and maximum of (ord, seconds) without the first row, which warms up."""
    return rows.filter("ord > 0").agg(F.avg("seconds").alias("mean"), F.median("seconds").alias("median"), F.max("seconds").alias("max"))


def pair_scores(members: DataFrame) -> DataFrame:
    """tp, fp, fn, p, r, f over pairs of (id, gold, pred): same cluster in both, in pred alone, in gold alone.

    Counted from cluster sizes: a cluster of n has n(n-1)/2 pairs, so no pair is ever formed.
    """
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2).cast("long")
    count = lambda *k: members.groupBy(*k).agg(F.count("*").alias("n")).agg(F.coalesce(pairs("n"), F.lit(0)).cast("long").alias("x"))
    both, gold, pred = (count(*k).withColumnRenamed("x", n) for k, n in ((("gold", "pred"), "tp"), (("gold",), "g"), (("pred",), "q")))
    one = both.crossJoin(gold).crossJoin(pred).select("tp", (F.col("q") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn"))  # one row each
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return one.select("tp", "fp", "fn", p.alias("p"), r.alias("r"), f.alias("f"))


def cluster_exact(members: DataFrame) -> DataFrame:
    """clusters (gold ones of several members), exact (met by one predicted cluster of the same members), rate."""
    gold = members.groupBy("gold").agg(F.count("*").alias("n"), F.min("pred").alias("a"), F.max("pred").alias("b")).filter("n > 1")
    size = members.groupBy("pred").agg(F.count("*").alias("m"))
    met = gold.join(size, gold["a"] == size["pred"], "left")
    out = met.agg(F.count("*").alias("clusters"), F.count_if((F.col("a") == F.col("b")) & (F.col("m") == F.col("n"))).alias("exact"))
    return out.select("clusters", "exact", rate(F.col("exact"), F.col("clusters")).alias("rate"))


def wrong_and_split(members: DataFrame) -> DataFrame:
    """wrong: predicted clusters that mix gold ones; split: gold clusters dealt to several predicted ones."""
    wrong = members.groupBy("pred").agg(F.countDistinct("gold").alias("k")).agg(F.count_if(F.col("k") > 1).alias("wrong"))
    split = members.groupBy("gold").agg(F.countDistinct("pred").alias("k")).agg(F.count_if(F.col("k") > 1).alias("split"))
    return wrong.crossJoin(split)  # one row each


def exposure(texts: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, exposures: how often the protected terms (any variant) stand in each text. One pass; terms are few."""
    total = F.lit(0)
    for t in terms:
        total = total + F.regexp_count("text", F.lit(surface_pattern(t)))
    return texts.select("doc_id", total.cast("long").alias("exposures"))


def answers_right(rows: DataFrame) -> DataFrame:
    """questions, right, accuracy of (reply, answers): any allowed answer within the reply, whatever the case."""
    right = F.exists("answers", lambda a: F.contains(F.lower("reply"), F.lower(a)))
    out = rows.agg(F.count("*").alias("questions"), F.count_if(right).alias("right"))
    return out.select("questions", "right", rate(F.col("right"), F.col("questions")).alias("accuracy"))


def leaks(rows: DataFrame) -> DataFrame:
    """facts, leaked, rate of (reply, facts: array of arrays of keywords): a fact has leaked if one of its keywords shows."""
    hit = F.size(F.filter("facts", lambda ks: F.exists(ks, lambda k: F.contains(F.lower("reply"), F.lower(k)))))
    out = rows.agg(F.sum(F.size("facts")).cast("long").alias("facts"), F.sum(hit).cast("long").alias("leaked"))
    return out.select("facts", "leaked", rate(F.col("leaked"), F.col("facts"), 2).alias("rate"))


def substring_count(text: Column, part: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, part))) / F.length(part)).cast("long")


def preservation(rows: DataFrame) -> DataFrame:
    """outputs, intact, input_tokens, preserved, missing, invented, malformed, rates, of (source, output)."""
    r = rows.select(report(F.col("source"), F.col("output")).alias("r")).select("r.*")
    n = lambda c: F.sum(F.size(c)).cast("long").alias(c)
    ok = (F.size("missing") == 0) & (F.size("invented") == 0) & (F.size("malformed") == 0)
    out = r.agg(F.count("*").alias("outputs"), F.count_if(ok).alias("intact"), F.sum("input_unique").cast("long").alias("input_tokens"), F.sum("preserved_unique").cast("long").alias("preserved"), n("missing"), n("invented"), n("malformed"))
    return out.withColumn("preserved_rate", rate(F.col("preserved"), F.col("input_tokens"))).withColumn("intact_rate", rate(F.col("intact"), F.col("outputs")))


def left_out(rows: DataFrame) -> DataFrame:
    """cases, held, flagged, masked, leaked of leave-one-out rows (held, flagged, masked: boolean)."""
    return rows.agg(F.count("*").alias("cases"), F.count_if("held").alias("held"), F.count_if("flagged").alias("flagged"), F.count_if(F.col("masked") & ~F.col("held")).alias("masked"), F.count_if(~F.col("masked") & ~F.col("held")).alias("leaked"))


def coverage(gold: DataFrame, masked: DataFrame) -> DataFrame:
    """occurrences, covered (within a masked interval), over_masked (intervals that meet no occurrence), of (doc_id, start, end).

    Intervals of a document are disjoint, so each occurrence is compared with the last interval that starts at or before it.
    """
    events = gold.select("doc_id", "start", "end", F.lit(1).alias("kind")).unionByName(masked.select("doc_id", "start", "end", F.lit(0).alias("kind")))
    before = Window.partitionBy("doc_id").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("doc_id").orderBy(F.col("start"), F.desc("kind")).rowsBetween(1, Window.unboundedFollowing)
    upto = Window.partitionBy("doc_id").orderBy("start", F.desc("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = events.withColumn("reach", F.max(F.when(F.col("kind") == 0, F.col("end"))).over(before)).withColumn("gold_reach", F.max(F.when(F.col("kind") == 1, F.col("end"))).over(upto)).withColumn("next_gold", F.min(F.when(F.col("kind") == 1, F.col("start"))).over(after))
    is_gold, alone = F.col("kind") == 1, (F.coalesce("gold_reach", F.lit(-1)) <= F.col("start")) & (F.coalesce("next_gold", F.col("end")) >= F.col("end"))
    return rows.agg(F.count_if(is_gold).alias("occurrences"), F.count_if(is_gold & (F.col("reach") >= F.col("end"))).alias("covered"), F.count_if(~is_gold & alone).alias("over_masked"))


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` beyond their count in ``right``."""
    return left.exceptAll(right)

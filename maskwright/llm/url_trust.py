"""URL filters: ordered rules first, and for what no rule decides, trust and distrust spread over the host graph.

Rules are (host, path, verdict). A rule fits its host and all subdomains if the path starts with the rule's; the longest rule
wins. Every host suffix of a URL is looked up with an equi-join, so the cost is the number of labels, not of rules.

Host edges come from absolute links of the pages. Seeds: a host most of whose rule-decided pages are allowed is trusted, one
most of whose pages are blocked by rules is distrusted. Personalised PageRank spreads trust from the trusted seeds along the
edges; the same iteration on reversed edges spreads distrust from the blocked seeds to those who link to them. A host is
blocked if its distrust exceeds both ``threshold`` times its seeds' mean mass and its trust; its undecided pages follow.

Each iteration is one join and one aggregation by host (sums combine on the map side; the edges of a hub and the pages of a
frequent host are dealt among tasks), staged every few steps. Nothing but totals reaches the driver.

Null url or none with "://": empty host and path, no rule, verdict allow. Null html: no links. Null page_id: as any other.
Repeated rows: each judged alike, one result row per row. Two rules of equal length fit one url: the later by name. A host that
is trusted and distrusted alike: allowed. Empty table: empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.workspace import bounded_broadcast, hot_join, stage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as rows; ``rule`` is host and path together."""
    return spark.createDataFrame([(h, p, h + p, v) for v, h, p in rules], "rule_host string, rule_path string, rule string, rule_verdict string")


def _suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def apply_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``pages`` (with row, host, path) and the longest rule that fits: rule, rule_verdict or nulls."""
    table, _ = bounded_broadcast(rules, 200_000)
    fits = pages.select("row", "path", F.explode(_suffixes(F.col("host"))).alias("rule_host")).join(table, "rule_host").filter(F.expr("startswith(path, rule_path)"))
    best = fits.groupBy("row").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "rule_verdict")).alias("best"))
    return pages.join(best, "row", "left").select(*pages.columns, F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("rule_verdict"))


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, weight (number of links) between different hosts, from links in ``html`` of (host, html) that name a host,
    with a scheme or (``//host/path``) without."""
    found = F.expr(r"""regexp_extract_all(html, "(?i)href\\s*=\\s*[\"']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\\s>]*)", 1)""")
    links = pages.filter((F.col("host") != "") & F.contains(F.col("html"), F.lit("//"))).select(F.col("host").alias("src"), F.explode(found).alias("to"))
    return links.select("src", F.translate("to", _UPPER, _LOWER).alias("dst")).filter((F.col("dst") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-5, stage_every: int = 4, hub: int = 10_000) -> DataFrame:
    """host, mass: personalised PageRank from ``seeds`` (host, seed; summing to 1). Mass that has no edge to follow ends there.
    Ends when no host's mass changes by more than ``tolerance`` times the largest seed between two staged rounds, however many
    seeds there are; all changes together shrink by ``damping`` a round, so it ends without a limit of ``rounds``.

    The edges of a host with more than ``hub`` of them are dealt into cells, and its mass goes to each of these."""
    total = stage(edges.groupBy("src").agg(F.sum("weight").alias("out"), F.count("*").alias("n")), "out")
    share = (F.col("weight") / F.col("out")).alias("share")
    joined = hot_join(edges, total.withColumn("degree", F.col("n")), "src", "n", ["dst"], least=hub)
    steps = stage(joined.select("src", F.pmod(F.xxhash64("dst"), F.ceil(F.col("degree") / hub)).cast("int").alias("cell"), "dst", share), "links")
    hubs, _ = bounded_broadcast(total.filter(F.col("n") > hub).select(F.col("src").alias("hub"), F.ceil(F.col("n") / hub).cast("int").alias("cells")), 200_000)
    mass = stage(seeds.select("host", F.col("seed").alias("mass")), "mass")
    base = mass.select("host", ((1 - damping) * F.col("mass")).alias("part"))
    least = tolerance * (mass.agg(F.max("mass")).first()[0] or 0.0)
    held = mass  # as it was staged last
    for k in itertools.count() if rounds is None else range(rounds):
        spread = mass.join(hubs, mass.host == hubs.hub, "left").select("host", "mass", F.explode(F.sequence(F.lit(0), F.coalesce("cells", F.lit(1)) - 1)).alias("cell"))
        moved = spread.join(steps, (spread.host == steps.src) & (spread.cell == steps.cell)).select(F.col("dst").alias("host"), (damping * F.col("mass") * F.col("share")).alias("part"))
        parts = moved.unionByName(base).withColumn("was", F.lit(0.0))
        if (k + 1) % stage_every:
            mass = parts.groupBy("host").agg(F.sum("part").alias("mass"))
            continue
        parts = parts.unionByName(held.select("host", F.lit(0.0).alias("part"), F.col("mass").alias("was")))
        after = stage(parts.groupBy("host").agg(F.sum("part").alias("mass"), F.sum("was").alias("was")), "mass")
        mass = held = after.select("host", "mass")
        if (after.agg(F.max(F.abs(F.col("mass") - F.col("was")))).first()[0] or 0.0) <= least:
            return mass
    return stage(mass, "mass")


def judge(pages: DataFrame, rules: DataFrame, threshold: float = 0.01, damping: float = 0.85) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust, for each row of (page_id, url, html)."""
    url = F.col("url").cast("string")
    parts = pages.select(F.col("page_id").cast("long"), host_of(url).alias("host"), path_of(url).alias("path"), F.col("html").cast("string")).withColumn("row", F.monotonically_increasing_id())
    edges = stage(host_edges(parts), "edges")
    ruled = stage(apply_rules(stage(parts.drop("html"), "urls"), rules), "ruled")
    by_host = ruled.filter(F.col("host") != "").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("rule_verdict") == "allow").alias("allowed"), F.count_if(F.col("rule_verdict") == "block").alias("blocked"))
    by_host = stage(by_host, "hosts")

    def seeds(column: str) -> DataFrame:
        chosen = by_host.filter(2 * F.col(column) > F.col("n"))
        n = chosen.count()
        return chosen.select("host", F.lit(1.0 / max(n, 1)).alias("seed"))

    trust = propagate(edges, seeds("allowed"), damping).withColumnRenamed("mass", "trust")
    reverse = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    blocked = seeds("blocked")
    distrust = propagate(reverse, blocked, damping).withColumnRenamed("mass", "distrust")
    level = distrust.join(blocked.select("host"), "host", "left_semi").agg(F.avg("distrust")).first()[0] or 0.0
    scored = by_host.select("host", "n").join(trust, "host", "left").join(distrust, "host", "left").na.fill(0.0, ["trust", "distrust"])
    bad = (F.col("distrust") > F.lit(threshold * level)) & (F.col("distrust") > F.col("trust"))
    hosts = stage(scored.select("host", "n", "trust", "distrust", bad.alias("bad")), "judged")
    verdict = F.coalesce("rule_verdict", F.when(F.col("bad"), "block").otherwise("allow"))
    judged = hot_join(ruled, hosts, "host", "n", ["row"], "left")
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))

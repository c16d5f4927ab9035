"""Queries over decisions, joins, metrics, linking, checklists, bootstrap and streams, with the same results in SQL."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.functions import text
from maskwright.functions.tokens import splice
from maskwright.operators import bootstrap, confirm, evaluation, gate, glossary, linking, metrics, pseudonyms, router
from maskwright.plans.rule_queries import EMAIL, table
from maskwright.plans.staging import components, numbered, settle, shared_folder
from maskwright.plans.text_queries import GLOSSARY, VALUES
from maskwright.sources import files, providers
from maskwright.streaming import ingest

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return wrap


# --- decisions -----------------------------------------------------------------------------------------------------------
_DECISION = """d AS (SELECT o_orderkey, repeat('x', (o_custkey % 700 + 1)::INT) || CASE WHEN o_orderkey % 41 = 0 THEN ' [PERSON_001]' ELSE '' END AS text,
 (CASE WHEN o_orderkey % 37 = 0 THEN 2 ELSE 0 END) AS secrets, o_orderkey % 13 = 0 AS l3, o_orderkey % 29 AS n_suspects_raw, o_custkey % 400 AS masked_chars, o_orderkey % 3 AS n_spans FROM orders),
e AS (SELECT *, CASE WHEN n_suspects_raw < 4 THEN 0 ELSE n_suspects_raw END AS n_suspects FROM d),
r AS (SELECT o_orderkey, length(text)::BIGINT AS chars, CASE WHEN secrets > 0 THEN 'block' WHEN regexp_matches(text, '\\[([A-Z_]+)_(\\d{2,})(?::[^\\[\\]\\n]{0,80})?\\]') THEN 'block' WHEN l3 THEN 'local_only' WHEN n_suspects > 20 THEN 'block'
 WHEN n_suspects > 0 THEN 'needs_confirmation' WHEN length(text) >= 300 AND masked_chars / length(text) >= 0.3 THEN 'block' WHEN n_spans = 0 THEN 'cloud_raw' ELSE 'cloud_masked' END AS route FROM e)"""


def _decided(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    raw = F.col("o_orderkey") % 29
    rows = o.select(
        "o_orderkey", F.concat(F.expr("repeat('x', cast(o_custkey % 700 + 1 as int))"), F.when(F.col("o_orderkey") % 41 == 0, " [PERSON_001]").otherwise("")).alias("text"),
        F.when(F.col("o_orderkey") % 37 == 0, 2).otherwise(0).alias("secrets"), F.when(F.col("o_orderkey") % 13 == 0, F.array(F.lit("TERM_01"))).otherwise(F.array().cast("array<string>")).alias("l3_ids"),
        F.when(raw < 4, 0).otherwise(raw).alias("n_suspects"), (F.col("o_custkey") % 400).alias("masked_chars"), (F.col("o_orderkey") % 3).alias("n_spans"),
    )
    return router.decide(rows)


@query("route_decision", f"WITH {_DECISION} SELECT o_orderkey, route FROM r")
def route_decision(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).select("o_orderkey", "route")


@query("audit_rollup", f"WITH {_DECISION} SELECT route, count(*) AS documents, sum(chars)::BIGINT AS chars_in, sum(CASE WHEN route = 'cloud_raw' THEN chars WHEN route = 'cloud_masked' THEN 6 ELSE 0 END)::BIGINT AS chars_out FROM r GROUP BY route")
def audit_rollup(spark: SparkSession, d: str) -> DataFrame:
    return router.audit_rollup(router.audit_rows(router.outgoing(_decided(spark, d).withColumn("masked", F.lit("masked")))))


@query("masked_ratio", f"SELECT doc_id, round(coalesce(list_sum(list_transform(x, lambda s: length(s))), 0) / length(text), 6) AS ratio FROM (SELECT doc_id, text, regexp_extract_all(text, '{EMAIL}') AS x FROM documents)")
def masked_ratio(spark: SparkSession, d: str) -> DataFrame:
    from maskwright.functions.rules import rule_places

    found = F.aggregate(rule_places(F.col("text"), "email"), F.lit(0), lambda a, x: a + F.length(x["surface"]))
    return table(spark, d, "documents").select("doc_id", F.round(router.masked_ratio(found, F.length("text")), 6).alias("ratio"))


@query("project_of", "SELECT page_id, CASE WHEN starts_with(path, '/h/blog/') THEN 'blogs' WHEN path = '/h/m' OR starts_with(path, '/h/m/') THEN 'mobile' END AS project FROM (SELECT page_id, '/h/' || replace(replace(regexp_extract(url, '://([^/?#]*)', 1), 'blog.', 'blog/'), 'm.', 'm/') AS path FROM pages)")
def project_of(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/h/"), F.replace(F.replace(F.regexp_extract("url", "://([^/?#]*)", 1), F.lit("blog."), F.lit("blog/")), F.lit("m."), F.lit("m/")))
    return files.project_of(table(spark, d, "pages").select("page_id", path.alias("path")), {"blogs": ["/h/blog"], "mobile": ["/h/m"]}).select("page_id", "project")


@query("allowed_path", "SELECT n_nationkey, n_regionkey IN (0, 1, 2) AND NOT (n_regionkey = 1) AS allowed FROM nation")
def allowed_path(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/data/r"), F.col("n_regionkey").cast("string"), F.lit("/"), "n_name")
    return table(spark, d, "nation").select("n_nationkey", files.allowed_path(path, ["/data/r1"], ["/data/r0", "/data/r1/", "/data/r2"]).alias("allowed"))


# --- joins ---------------------------------------------------------------------------------------------------------------
_FOLD = "regexp_replace(lower({}), '[^a-z]', '', 'g')"
_WORDS = f"c AS (SELECT DISTINCT doc_id, {_FOLD.format('x')} AS key FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS x FROM documents)), cc AS (SELECT * FROM c WHERE length(key) >= 2), k AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS key FROM part), m AS (SELECT DISTINCT doc_id, key FROM cc WHERE length(key) > 14)"


@query("suspects", f"WITH {_WORDS} SELECT doc_id, key FROM cc WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.key = cc.key OR (length(k.key) >= 3 AND contains(cc.key, k.key))) AND NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = cc.doc_id AND (contains(m.key, cc.key) OR contains(cc.key, m.key)))")
def suspects(spark: SparkSession, d: str) -> DataFrame:
    """All words of all documents, against the words of part names as known terms and a document's longest words as masked."""
    fold = lambda c: F.regexp_replace(F.lower(c), "[^a-z]", "")
    c = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("x")).select("doc_id", fold("x").alias("key")).filter(F.length("key") >= 2).distinct()
    known = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("key")).distinct()
    return router.suspects(settle(c), known, c.filter("length(key) > 14"))


@query("candidates", "SELECT p_partkey AS doc_id, replace(p_name, ' ', '') AS key, upper(p_name[1:1]) || regexp_extract(p_name, '^.([^ ]*) ', 1) || ' ' || upper(regexp_extract(p_name, ' (.)', 1)) || regexp_extract(p_name, ' .(.*)$', 1) AS surface FROM part UNION ALL SELECT p_partkey, 'runx' || p_size, 'run_x_' || p_size FROM part")
def candidates(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit("call run_x_"), F.col("p_size").cast("string"), F.lit(" of the "), F.initcap("p_name"), F.lit(", not A, b or run."))
    return router.candidates(table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), t.alias("text")))


@query("components", "WITH e AS (SELECT o_custkey AS a, o_orderkey + 10000000 AS b FROM orders), r AS (SELECT b AS node, a AS root FROM e) SELECT node, root FROM r UNION SELECT root, root FROM r")
def connected(spark: SparkSession, d: str) -> DataFrame:
    """Each customer with all its orders, which are linked in a chain and not with the customer alone."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c"), (F.col("o_orderkey") + 10_000_000).alias("o"))
    before = F.lag("o").over(Window.partitionBy("c").orderBy("o"))
    return components(orders.select(F.coalesce(before, F.col("c")).cast("long").alias("a"), F.col("o").cast("long").alias("b")))


@query("numbered", "SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS seq FROM customer")
def numbered_rows(spark: SparkSession, d: str) -> DataFrame:
    return numbered(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ["c_custkey"]).select("c_custkey", "seq")


_PERSONS = """r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN -1 ELSE c_custkey % 18 END AS f, CASE WHEN c_custkey % 13 = 0 THEN -1 WHEN c_custkey % 18 >= 16 AND c_custkey % 11 <> 0 THEN 0 ELSE c_nationkey % 5 END AS g FROM customer),
n AS (SELECT min(id) AS id, f, g FROM r GROUP BY f, g), whole AS (SELECT *, min(id) OVER (PARTITION BY f // 2, g) AS root FROM n WHERE f >= 0 AND g >= 0)"""


@query("link_persons", f"""WITH {_PERSONS} SELECT id, root FROM whole UNION ALL SELECT id, id FROM n WHERE f < 0 AND g < 0
UNION ALL SELECT id, coalesce((SELECT CASE WHEN count(DISTINCT root) = 1 THEN min(root) END FROM whole w WHERE w.f // 2 = n.f // 2), id) FROM n WHERE f >= 0 AND g < 0
UNION ALL SELECT id, coalesce((SELECT CASE WHEN count(DISTINCT root) = 1 THEN min(root) END FROM whole w WHERE w.g = n.g), id) FROM n WHERE f < 0 AND g >= 0""")
def link_persons(spark: SparkSession, d: str) -> DataFrame:
    """Names made from two spellings of nine family names and five given names; lone parts; swapped slots."""
    k = F.col("c_custkey")
    f = F.element_at(F.array(*[F.lit(g[i]) for g in text.FAMILY_GROUPS[:9] for i in (0, 1)]), (k % 18 + 1).cast("int"))
    g = F.element_at(F.array(*map(F.lit, ["seora", "haruto", "minjae", "kazuo", "dowon"])), (F.when((k % 18 >= 16) & (k % 11 != 0), 0).otherwise(F.col("c_nationkey") % 5) + 1).cast("int"))
    names = table(spark, d, "customer").select(k.alias("id"), F.when(k % 11 == 0, "").otherwise(f).alias("family"), F.when(k % 13 == 0, "").otherwise(g).alias("given"))
    ids = names.groupBy("family", "given").agg(F.min("id").alias("id"))
    swap = (F.col("id") % 2 == 0) & (F.col("family") != "") & (F.col("given") != "")
    return linking.link(ids.select("id", F.when(swap, F.col("given")).otherwise(F.col("family")).alias("family"), F.when(swap, F.col("family")).otherwise(F.col("given")).alias("given")))


@query("exposure", r"SELECT doc_id, len(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w IN ('thanedble', 'worthless', 'und', 'the')))::BIGINT AS exposures FROM documents")
def exposure(spark: SparkSession, d: str) -> DataFrame:
    return metrics.exposure(table(spark, d, "documents"), ["thanedble", "Worthless", "und", "the"])


@query("exposure_counts", "SELECT p_partkey AS doc_id, ((CASE WHEN ends_with(p_name, ' ring') THEN 2 ELSE 0 END) + (CASE WHEN starts_with(p_name, 'red ') THEN 2 ELSE 0 END))::BIGINT AS exposures FROM part")
def exposure_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.upper("p_name"), F.lit("; "), "p_name", F.lit(".")).alias("text"))
    return metrics.exposure(docs, ["ring", "Red"])


# --- metrics -------------------------------------------------------------------------------------------------------------
_SPANS = """g AS (SELECT DISTINCT l_orderkey AS id, (l_partkey % 200)::INT AS s, (l_partkey % 200 + 5 + l_suppkey % 9)::INT AS e, l_returnflag AS type FROM lineitem),
p AS (SELECT DISTINCT l_orderkey AS id, (l_partkey % 200)::INT AS s, (l_partkey % 200 + 5 + l_suppkey % 9 + CASE WHEN l_linenumber = 2 THEN 1 ELSE 0 END)::INT AS e, CASE WHEN l_linenumber = 3 THEN 'A' ELSE l_returnflag END AS type FROM lineitem WHERE l_linenumber < 5)"""


def _gold_pred(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    li = table(spark, d, "lineitem")
    a = (F.col("l_partkey") % 200).cast("int")
    e = (a + 5 + F.col("l_suppkey") % 9).cast("int")
    gold = li.select(F.col("l_orderkey").alias("id"), a.alias("start"), e.alias("end"), F.col("l_returnflag").alias("type")).distinct()
    pred = li.filter("l_linenumber < 5").select(F.col("l_orderkey").alias("id"), a.alias("start"), (e + F.when(F.col("l_linenumber") == 2, 1).otherwise(0)).cast("int").alias("end"), F.when(F.col("l_linenumber") == 3, "A").otherwise(F.col("l_returnflag")).alias("type")).distinct()
    return gold, pred


@query("span_scores", f"""WITH {_SPANS}, m AS (SELECT coalesce(g.type, p.type) AS type, g.id IS NOT NULL AND p.id IS NOT NULL AS tp, g.id IS NULL AS fp, p.id IS NULL AS fn FROM g FULL JOIN p ON g.id = p.id AND g.s = p.s AND g.e = p.e AND g.type = p.type),
t AS (SELECT coalesce(type, 'ALL') AS type, sum(tp::INT)::BIGINT AS tp, sum(fp::INT)::BIGINT AS fp, sum(fn::INT)::BIGINT AS fn FROM m GROUP BY ROLLUP(type))
SELECT type, tp, fp, fn, round(tp / (tp + fp), 3) AS p, round(tp / (tp + fn), 3) AS r, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 3) AS f FROM t""")
def span_scores(spark: SparkSession, d: str) -> DataFrame:
    return metrics.score_table(metrics.exact_matches(*_gold_pred(spark, d)))


@query("span_overlap", """WITH m AS (SELECT l_returnflag AS type, l_partkey % 15 < 10 AND l_linenumber <> 3 AS tp, CASE WHEN l_linenumber = 3 THEN 'X' ELSE l_returnflag END AS p FROM lineitem),
c AS (SELECT type, tp::INT AS tp, 0 AS fp, (NOT tp)::INT AS fn FROM m UNION ALL SELECT p, 0, 1, 0 FROM m WHERE NOT tp), t AS (SELECT coalesce(type, 'ALL') AS type, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM c GROUP BY ROLLUP(type))
SELECT type, tp, fp, fn, CASE WHEN tp + fp = 0 THEN 0 ELSE round(tp / (tp + fp), 3) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE round(tp / (tp + fn), 3) END AS r, CASE WHEN tp = 0 THEN 0 ELSE round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 3) END AS f FROM t""")
def span_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Labelled spans of ten characters, each in a cell of its own, and predictions moved by 0 to 14 within it."""
    n = F.col("l_linenumber")
    at, moved = (n * 100).cast("int"), (n * 100 + F.col("l_partkey") % 15).cast("int")
    pack = lambda start, kind: F.array_sort(F.collect_list(F.struct(start.alias("start"), (start + 10).alias("end"), kind.alias("type"))))
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(pack(at, F.col("l_returnflag")).alias("gold"), pack(moved, F.when(n == 3, "X").otherwise(F.col("l_returnflag"))).alias("pred"))
    return metrics.score_table(metrics.overlap_counts(rows))


_MEMBERS = "m AS (SELECT c_custkey AS id, c_nationkey AS gold, CASE WHEN c_custkey % 17 = 0 THEN 99 ELSE c_nationkey // 2 * 2 + CASE WHEN c_nationkey < 10 THEN c_nationkey % 2 ELSE 0 END END AS pred FROM customer)"


def _members(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("c_nationkey")
    pred = F.when(F.col("c_custkey") % 17 == 0, 99).otherwise(F.floor(n / 2) * 2 + F.when(n < 10, n % 2).otherwise(0))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), n.alias("gold"), pred.alias("pred"))


@query("pair_scores", f"""WITH {_MEMBERS}, x AS (SELECT sum((a.gold = b.gold AND a.pred = b.pred)::INT)::BIGINT AS tp, sum((a.gold <> b.gold AND a.pred = b.pred)::INT)::BIGINT AS fp, sum((a.gold = b.gold AND a.pred <> b.pred)::INT)::BIGINT AS fn FROM m a JOIN m b ON a.id < b.id)
SELECT tp, fp, fn, round(tp / (tp + fp), 3) AS p, round(tp / (tp + fn), 3) AS r, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 3) AS f FROM x""")
def pair_scores(spark: SparkSession, d: str) -> DataFrame:
    return metrics.pair_scores(_members(spark, d))


@query("cluster_exact", f"WITH {_MEMBERS}, m2 AS (SELECT id, gold, CASE WHEN gold % 3 = 0 THEN gold + 1000 ELSE pred END AS pred FROM m), g AS (SELECT gold, list(id ORDER BY id) AS l FROM m2 GROUP BY gold HAVING count(*) > 1), p AS (SELECT pred, list(id ORDER BY id) AS l FROM m2 GROUP BY pred) SELECT count(*) AS clusters, count(p.l) AS exact, round(count(p.l) / count(*), 3) AS rate FROM g LEFT JOIN p ON g.l = p.l")
def cluster_exact(spark: SparkSession, d: str) -> DataFrame:
    return metrics.cluster_exact(_members(spark, d).withColumn("pred", F.when(F.col("gold") % 3 == 0, F.col("gold") + 1000).otherwise(F.col("pred"))))


@query("wrong_and_split", f"WITH {_MEMBERS} SELECT (SELECT count(*) FROM (SELECT pred FROM m GROUP BY pred HAVING count(DISTINCT gold) > 1)) AS wrong, (SELECT count(*) FROM (SELECT gold FROM m GROUP BY gold HAVING count(DISTINCT pred) > 1)) AS split")
def wrong_and_split(spark: SparkSession, d: str) -> DataFrame:
    return metrics.wrong_and_split(_members(spark, d))


@query("latency", "SELECT round(avg(s), 6) AS mean, round(median(s), 6) AS median, max(s) AS max FROM (SELECT o_orderkey AS ord, o_totalprice / 1000 AS s FROM orders) WHERE ord > 0")
def latency(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.latency(table(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), (F.col("o_totalprice") / 1000).alias("seconds")))
    return rows.select(F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "max")


_FORMS = {"source": "concat('[PERSON_', lpad(cast(o_custkey % 900 + 100 as string), 3, '0'), '] and [ORG_001]')", "output": "concat('[PERSON_', lpad(cast(o_custkey % 900 + 100 + case when o_orderkey % 5 = 0 then 1 else 0 end as string), 3, '0'), '] ', case when o_orderkey % 2 = 0 then '[ORG_001]' else 'ORG 001' end)"}


@query("preservation", """WITH x AS (SELECT o_orderkey % 5 = 0 AS moved, o_orderkey % 2 <> 0 AS mangled FROM orders), y AS (SELECT count(*) AS outputs, count(*) FILTER (NOT moved AND NOT mangled) AS intact, (2 * count(*))::BIGINT AS input_tokens, sum((NOT moved)::INT + (NOT mangled)::INT)::BIGINT AS preserved, sum(moved::INT + mangled::INT)::BIGINT AS missing, sum(moved::INT)::BIGINT AS invented, sum(mangled::INT)::BIGINT AS malformed FROM x)
SELECT *, round(preserved / input_tokens, 3) AS preserved_rate, round(intact / outputs, 3) AS intact_rate FROM y""")
def preservation(spark: SparkSession, d: str) -> DataFrame:
    return metrics.preservation(table(spark, d, "orders").select(*[F.expr(v).alias(k) for k, v in _FORMS.items()]))


@query("answers_right", "SELECT count(*) AS questions, count(*) FILTER (contains(lower(text), 'the ') OR contains(lower(text), 'und ')) AS right, round(count(*) FILTER (contains(lower(text), 'the ') OR contains(lower(text), 'und ')) / count(*), 3) AS accuracy FROM conversations")
def answers_right(spark: SparkSession, d: str) -> DataFrame:
    return metrics.answers_right(table(spark, d, "conversations").select(F.col("text").alias("reply"), F.array(F.lit("The "), F.lit("UND ")).alias("answers")))


@query("leaks", "WITH x AS (SELECT (contains(lower(text), 'the ') OR contains(lower(text), 'zzzz'))::INT + contains(lower(text), 'ing')::INT AS n FROM conversations) SELECT (2 * count(*))::BIGINT AS facts, sum(n)::BIGINT AS leaked, round(sum(n) / (2 * count(*)), 2) AS rate FROM x")
def leaks(spark: SparkSession, d: str) -> DataFrame:
    facts = F.array(F.array(F.lit("THE "), F.lit("zzzz")), F.array(F.lit("ing")))
    return metrics.leaks(table(spark, d, "conversations").select(F.col("text").alias("reply"), facts.alias("facts")))


@query("substring_count", "SELECT doc_id, ((length(text) - length(replace(text, 'the', ''))) // 3)::BIGINT AS n FROM documents")
def substring_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", metrics.substring_count(F.col("text"), F.lit("the")).alias("n"))


@query("left_out", "SELECT count(*) AS cases, count(*) FILTER (o_orderkey % 2 = 0) AS held, count(*) FILTER (o_orderkey % 3 = 0) AS flagged, count(*) FILTER (o_orderkey % 5 = 0 AND o_orderkey % 2 <> 0) AS masked, count(*) FILTER (o_orderkey % 5 <> 0 AND o_orderkey % 2 <> 0) AS leaked FROM orders")
def left_out(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return metrics.left_out(table(spark, d, "orders").select((k % 2 == 0).alias("held"), (k % 3 == 0).alias("flagged"), (k % 5 == 0).alias("masked")))


@query("coverage", """WITH g AS (SELECT DISTINCT o_custkey % 50 AS doc, (o_orderkey % 500) * 10 AS s, (o_orderkey % 500) * 10 + 6 AS e FROM orders WHERE o_orderkey % 3 = 0),
m AS (SELECT DISTINCT o_custkey % 50 AS doc, (o_orderkey % 500) * 10 AS s, (o_orderkey % 500) * 10 + 5 + o_orderkey % 4 AS e FROM orders WHERE o_orderkey % 4 < 3 AND o_orderkey % 500 < 400), m1 AS (SELECT doc, s, max(e) AS e FROM m GROUP BY doc, s)
SELECT (SELECT count(*) FROM g) AS occurrences, (SELECT count(*) FROM g WHERE EXISTS (SELECT 1 FROM m1 WHERE m1.doc = g.doc AND m1.s <= g.s AND m1.e >= g.e)) AS covered, (SELECT count(*) FROM m1 WHERE NOT EXISTS (SELECT 1 FROM g WHERE m1.doc = g.doc AND m1.s < g.e AND g.s < m1.e)) AS over_masked""")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    doc, s = (F.col("o_custkey") % 50).alias("doc_id"), (F.col("o_orderkey") % 500 * 10).alias("start")
    gold = o.filter("o_orderkey % 3 = 0").select(doc, s, (F.col("o_orderkey") % 500 * 10 + 6).alias("end")).distinct()
    masked = o.filter("o_orderkey % 4 < 3 and o_orderkey % 500 < 400").select(doc, s, (F.col("o_orderkey") % 500 * 10 + 5 + F.col("o_orderkey") % 4).alias("end")).groupBy("doc_id", "start").agg(F.max("end").alias("end"))
    return metrics.coverage(gold, masked)


@query("multiset_difference", "SELECT l_orderkey, l_returnflag FROM lineitem EXCEPT ALL SELECT l_orderkey, l_returnflag FROM lineitem WHERE l_linenumber < 4")
def multiset_difference(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    return metrics.multiset_difference(rows.select("l_orderkey", "l_returnflag"), rows.filter("l_linenumber < 4").select("l_orderkey", "l_returnflag"))


@query("chunk_leaks", "SELECT size::INT AS size, (SELECT sum((length(t) - length(replace(t, 'ing', ''))) // 3)::BIGINT FROM (SELECT replace(text, 'and', '*') AS t FROM documents)) AS leaked FROM (VALUES (1500), (300)) AS v(size)")
def chunk_leaks(spark: SparkSession, d: str) -> DataFrame:
    """A detector that knows one of two strings, asked chunk by chunk: the other one leaks at either size."""

    def mask(docs: DataFrame, size: int) -> DataFrame:
        found = settle(providers.detected_spans(docs, functools.partial(providers.FixtureProvider, entities={"and": "ORG"}), size).withColumn("spans", gate.resolved(F.col("llm_spans"))))
        return found.select("doc_id", splice(F.col("text"), F.col("spans"), lambda x: F.lit("[ORG]")).alias("masked"))

    return evaluation.chunk_leaks(settle(table(spark, d, "documents").select("doc_id", "text")), ["and", "ing"], mask)


@query("detection", "SELECT 'rules' AS mode, type, tp, fp, 0::BIGINT AS fn, round(tp / (tp + fp), 3) AS p, 1.0::DOUBLE AS r, round(2 * (tp / (tp + fp)) / (tp / (tp + fp) + 1), 3) AS f FROM (SELECT unnest(['EMAIL', 'ALL']) AS type, count(*) FILTER (o_orderkey % 3 = 0) AS tp, count(*) FILTER (o_orderkey % 3 <> 0) AS fp FROM orders)")
def detection(spark: SparkSession, d: str) -> DataFrame:
    """Rules against labels, which miss two of three addresses."""
    k = F.col("o_orderkey")
    at = F.array(F.struct(F.lit(5).alias("start"), (F.length(k.cast("string")) + 13).cast("int").alias("end"), F.lit("EMAIL").alias("type"), F.lit(None).cast("string").alias("entity_id")))
    gold = table(spark, d, "orders").select(k.cast("string").alias("id"), F.concat(F.lit("mail u"), k.cast("string"), F.lit("@ex.com now")).alias("text"), F.when(k % 3 == 0, at).otherwise(F.slice(at, 1, 0)).alias("spans"))
    return evaluation.detection(gold, {"rules": evaluation.predictions(gold)})


@query("leave_one_out", "WITH g AS (SELECT DISTINCT 'TERM_' || (p_size % 7) AS id, replace(p_name, ' ', '') AS key FROM part) SELECT g.id AS dropped, p_partkey AS doc_id, g.key, NOT EXISTS (SELECT 1 FROM g o WHERE o.key = g.key AND o.id <> g.id) AS held FROM part JOIN g ON g.key = replace(p_name, ' ', '')")
def leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    terms = parts.select(F.concat(F.lit("TERM_"), (F.col("p_size") % 7).cast("string")).alias("id"), F.replace("p_name", F.lit(" ")).alias("key")).distinct()
    return evaluation.leave_one_out(parts.select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("the "), F.initcap("p_name"), F.lit(".")).alias("text")), terms)


# --- checklists, glossary, bootstrap -------------------------------------------------------------------------------------
def _pending(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("n_nationkey") % 3 == 0, "x").when(F.col("n_nationkey") % 3 == 1, "o").otherwise(" ")
    rows = table(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("file"), state.alias("state"), F.col("n_nationkey").cast("int").alias("n"), F.col("n_name").alias("title"), F.lit("ORG").alias("kind"), (F.col("n_nationkey") % 4).cast("int").alias("level"), F.lit("").alias("alias"), F.array("n_name", F.lower("n_name")).alias("surfaces"))
    return confirm.parse_pending(confirm.numbered_lines(confirm.render(rows)))


@query("pending_items", "SELECT n_regionkey::VARCHAR AS file, n_nationkey AS n, n_name AS title, CASE n_nationkey % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'o' ELSE ' ' END AS state, n_nationkey % 4 AS level, n_name || '|' || lower(n_name) AS surfaces FROM nation")
def pending_items(spark: SparkSession, d: str) -> DataFrame:
    return _pending(spark, d).select("file", "n", "title", "state", "level", F.array_join("surfaces", "|").alias("surfaces"))


@query("allow_list", "SELECT DISTINCT unnest([n_name, lower(n_name)]) AS surface FROM nation WHERE n_nationkey % 3 = 1 UNION SELECT r_name FROM region")
def allow_list(spark: SparkSession, d: str) -> DataFrame:
    _, allow, _ = confirm.split_pending(_pending(spark, d))
    return confirm.allowed(table(spark, d, "region").select(F.col("r_name").alias("surface")), allow)


@query("add_pending", "SELECT n_name AS title, (24 + row_number() OVER (ORDER BY n_nationkey))::INT AS n FROM (SELECT n_nationkey, 'new ' || n_name AS n_name FROM nation)")
def add_pending(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "nation").select(F.explode(F.array("n_name", F.concat(F.lit("new "), "n_name"))).alias("surface"), F.col("n_nationkey").alias("ord"), F.lit("TERM").alias("kind"), F.lit("").alias("alias"))
    return confirm.add_pending(_pending(spark, d), found).filter(F.col("title").startswith("new ")).select("title", "n")


@query("apply_review", f"""WITH g(id, kind, level, status, alias, surfaces) AS (VALUES {VALUES}) SELECT id, kind, array_to_string(surfaces, '|') AS surfaces FROM g WHERE id NOT IN ('COMPONENT_01') UNION ALL SELECT id, kind, array_to_string(surfaces, '|') || '|crimson plate' FROM g WHERE id = 'COMPONENT_01'
UNION ALL SELECT 'ORG_' || lpad((1 + row_number() OVER (ORDER BY r_regionkey))::VARCHAR, 2, '0'), 'ORG', r_name FROM region""")
def apply_review(spark: SparkSession, d: str) -> DataFrame:
    now = glossary.glossary_frame(spark, glossary.entries(GLOSSARY))
    new = table(spark, d, "region").select(F.lit("r").alias("file"), F.col("r_regionkey").cast("long").alias("item"), F.lit("ORG").alias("kind"), F.lit(2).alias("level"), F.lit("").alias("alias"), F.array("r_name").alias("surfaces"))
    hit = spark.createDataFrame([("r", 99, "TERM", 2, "", ["RED PLATE", "crimson plate"])], new.schema)
    return confirm.apply_review(now, new.unionByName(hit)).select("id", "kind", F.array_join("surfaces", "|").alias("surfaces"))


_TITLE = "upper(p_name[1:1]) || regexp_extract(p_name, '^.([^ ]*) ', 1) || upper(regexp_extract(p_name, ' (.)', 1)) || regexp_extract(p_name, ' .(.*)$', 1)"


@query("bootstrap", f"SELECT {_TITLE} AS title, 'TERM' AS kind, count(*) AS documents, (4 * count(*))::BIGINT AS total FROM part GROUP BY p_name UNION ALL SELECT upper(p_type[1:1]) || lower(p_type[2:]) || ' Works', 'TERM', count(*), count(*)::BIGINT FROM part WHERE p_type <> 'ECONOMY' GROUP BY p_type")
def bootstrap_terms(spark: SparkSession, d: str) -> DataFrame:
    """Proposals from the title-case and code names of the part table's texts; one of them is public."""
    t = F.concat(F.lit("Use the "), F.initcap("p_name"), F.lit(" ("), F.replace(F.initcap("p_name"), F.lit(" ")), F.lit(") of "), F.initcap("p_type"), F.lit(" Works.\n"))
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), t.alias("text"))
    kept, _ = bootstrap.bootstrap(docs, functools.partial(providers.FixtureProvider, public=frozenset(["Economy Works"])))
    return kept.select("title", "kind", "documents", "total")


@query("order_groups", "SELECT p_name, n, row_number() OVER (ORDER BY n DESC, p_name) AS rank FROM (SELECT p_name, count(*) AS n FROM part GROUP BY p_name)")
def order_groups(spark: SparkSession, d: str) -> DataFrame:
    groups = table(spark, d, "part").groupBy("p_name").agg(F.count("*").alias("n")).withColumn("one", F.lit(0)).withColumn("minus", -F.col("n"))
    return numbered(groups, "one", ["minus", "p_name"], "rank").select("p_name", "n", "rank")


# --- the gate end to end, and streams -------------------------------------------------------------------------------------
def gate_documents(spark: SparkSession, d: str) -> DataFrame:
    """All documents analysed, masked and routed: one row each."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    routed = ingest.process(docs, *pseudonyms.empty_state(spark), glossary.entries(GLOSSARY)).routed
    return routed.select("doc_id", "route", "n_spans", "masked_chars", F.length("out").cast("long").alias("chars_out"))


QUERIES["gate_documents"] = gate_documents


@query("link_candidates", "SELECT p_partkey AS doc_id, 1 AS ord, CASE WHEN p_partkey % 2 = 0 THEN 'Ann' ELSE 'Bob' END AS surface FROM part UNION ALL SELECT p_partkey, 2, 'Bob' FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT NULL, 1, 'Cleo' UNION ALL SELECT NULL, 2, 'Ann'")
def link_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Names that a detector finds in each document, each once, and the known ones once for all documents."""
    t = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Ann saw the "), "p_name", F.lit("; so did Bob and Ann"))).otherwise(F.concat(F.lit("Bob has the "), "p_name"))
    docs = settle(table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("doc_id"), t.alias("text")))
    found = providers.detected_spans(docs, functools.partial(providers.FixtureProvider, entities={"Ann": "PERSON", "Bob": "PERSON"}))
    surfaces = spark.createDataFrame([("[PERSON_001]", "PERSON", "ann", "Ann", 2), ("[PERSON_002]", "PERSON", "cleo", "Cleo", 1), ("[PERSON_001]", "PERSON", "ann", "Ann", 3), ("[ORG_001]", "ORG", "x", "X", 1)], pseudonyms.SURFACES)
    return gate.link_candidates(settle(gate.analyse(found)), surfaces)


@query("route_stream", "SELECT time_bucket(INTERVAL '10 minutes', ts) AS start_at, event_type AS route, count(*) AS documents FROM events GROUP BY 1, 2")
def route_stream(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling-window counts of a stream of routed events, run to the end of what is there; the result is a table in the shared
    folder, written anew by each trigger."""
    source = table(spark, d, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{d}/events.parquet*").select(F.col("ts").cast("timestamp").alias("time"), F.col("event_type").alias("route"))
    folder = f"{shared_folder(spark)}/maskwright/stream-{uuid.uuid4().hex}"
    write = lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/counts")
    ingest.route_counts(stream).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/counts").select(F.col("window.start").cast("timestamp_ntz").alias("start_at"), "route", "documents")

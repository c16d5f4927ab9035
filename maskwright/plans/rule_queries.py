"""Queries over the rules and spans, with the same results in SQL.

Documents of the test tables hold few of the strings that the rules look for; texts put together from the order table with
functions that both engines share hold all of them, next to strings that must not count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions.rules import RULES, detect, rule_places
from maskwright.functions.spans import SPANS, resolve
from maskwright.plans.staging import dealt

QUERIES, ORACLES = {}, {}
K4, C4 = "lpad(cast(o_orderkey % 10000 as string), 4, '0')", "lpad(cast(o_custkey % 10000 as string), 4, '0')"
K3, C3 = "lpad(cast(o_orderkey % 1000 as string), 3, '0')", "lpad(cast(o_custkey % 1000 as string), 3, '0')"
#: name: (text from the order table, what SQL finds in it: group 1 of a pattern without look-around, one hit a row).
DERIVED = {
    "secret_pem": (f"concat('key -----BEGIN RSA PRIVATE KEY-----', chr(10), {K4}, chr(10), '-----END RSA PRIVATE KEY----- ', case when o_orderkey % 3 = 0 then '-----BEGIN PRIVATE KEY' else 'x' end)", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----)"),
    "secret_prefix": (f"concat('use ', case when o_orderkey % 2 = 0 then 'xAKIA' else 'AKIA' end, {K4}, {C4}, 'ABCD', {K4}, ' now')", r"(?:^|[^A-Za-z0-9])(AKIA[0-9A-Z]{16})(?:[^A-Za-z0-9]|$)"),
    "id_kr": (f"concat('no ', {K3}, {C3}, '-', cast(o_custkey % 10 as string), {K3}, {C3}, case when o_orderkey % 4 = 0 then '9' else ' ' end, 'end')", r"(?:^|[^\d-])(\d{6}-[1-8]\d{6})(?:[^\d-]|$)"),
    "id_jp": (f"concat('id ', {K4}, case o_orderkey % 3 when 0 then ' ' when 1 then '-' else '' end, {C4}, case o_custkey % 2 when 0 then ' ' else '' end, {K4}, case when o_orderkey % 5 = 0 then '7' else '.' end)", r"(?:^|\D)(\d{4}[ -]?\d{4}[ -]?\d{4})(?:\D|$)"),
    "phone_international": (f"concat('call +8', cast(1 + o_orderkey % 3 as string), ' 3-', {C4}, '-', {K4}, case when o_custkey % 4 = 0 then '-1' else ' ok' end)", r"(\+8[12] 3-\d{4}-\d{4})(?:[^\d-]|$)"),
    "phone_kr_mobile": (f"concat('tel 01', cast(o_orderkey % 10 as string), '-', {C4}, '-', {K4}, case when o_custkey % 6 = 0 then '5' else ' ' end)", r"(?:^|[^\d-])(01[016789][ -]?\d{3,4}[ -]?\d{4})(?:[^\d-]|$)"),
    "phone_jp_free": (f"concat('free ', case o_orderkey % 4 when 0 then '0120' when 1 then '0570' when 2 then '0800' else '0990' end, '-', {C3}, '-', {K3}, '.')", r"(?:^|[^\d-])(0(?:120|570|800)-\d{3}-\d{3,4})(?:[^\d-]|$)"),
    "phone_paren": (f"concat('office (0', cast(o_orderkey % 100 as string), ') ', {C4}, '-', {K4}, case when o_custkey % 3 = 0 then '1' else '' end)", r"(\(0\d{1,4}\)\s?\d{1,4}-\d{4})(?:[^\d-]|$)"),
    "passport": (f"concat(case o_orderkey % 3 when 0 then 'Passport No. ' when 1 then 'passport: ' else 'code ' end, 'M', {C4}, {K4}, case when o_custkey % 4 = 0 then 'A' else ';' end)", r"(?:[Pp]assport(?:\s*(?:[Nn]o\.?|number))?)\s*[::]?\s*([A-Z]{1,2}\d{7,8})(?:[^\dA-Za-z]|$)"),
    "phone_3part": (f"concat('home 0', cast(o_orderkey % 100 as string), '-', {C3}, '-', {K4}, case when o_custkey % 5 = 0 then '-2' else ' x' end)", r"(?:^|[^\d-])(0\d{1,4}-\d{1,4}-\d{4})(?:[^\d-]|$)"),
    "postal_jp": (f"concat('zip ', {K3}, '-', {C4}, case when o_custkey % 3 = 0 then '0' else ' ' end)", r"(?:^|[^\d-])(\d{3}-\d{4})(?:[^\d-]|$)"),
    "postal_kr": (f"concat(case o_orderkey % 3 when 0 then '우편번호 ' when 1 then '(우)' else 'no ' end, '1', {C4}, case when o_custkey % 4 = 0 then '7' else '' end)", r"(?:우편번호 |우편번호: |\(우\) |\(우\))(\d{5})(?:\D|$)"),
    "postal_us": (f"concat('at ', case o_orderkey % 3 when 0 then 'CA' when 1 then 'NY' else 'xNY' end, ' 1', {C4}, case o_custkey % 3 when 0 then concat('-', {K4}) when 1 then '9' else '' end, '.')", r"\b[A-Z]{2} (\d{5}(?:-\d{4})?)(?:\D|$)"),
}


def _add(name: str, oracle: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return wrap


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _derived(name: str, text: str, sql: str) -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = table(spark, d, "orders").select("o_orderkey", F.expr(text).alias("text")).withColumn("found", rule_places(F.col("text"), name))
        return rows.select("o_orderkey", F.size("found").cast("long").alias("n"), F.array_join(F.transform("found", lambda x: x["surface"]), "|").alias("surfaces"))

    QUERIES[f"rule_{name}"] = query
    ORACLES[f"rule_{name}"] = f"SELECT o_orderkey, (CASE WHEN s = '' THEN 0 ELSE 1 END)::BIGINT AS n, s AS surfaces FROM (SELECT o_orderkey, coalesce(regexp_extract({text}, '{sql}', 1), '') AS s FROM orders)"


for _name, (_text, _sql) in DERIVED.items():
    _derived(_name, _text, _sql)

EMAIL = next(p for n, _, p, *_ in RULES if n == "email")
URL = next(p for n, _, p, *_ in RULES if n == "url")


@_add("rule_email", f"SELECT doc_id, len(x)::BIGINT AS n, array_to_string(x, '|') AS surfaces FROM (SELECT doc_id, regexp_extract_all(text, '{EMAIL}') AS x FROM documents) WHERE len(x) > 0")
def rule_email(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").withColumn("x", rule_places(F.col("text"), "email")).filter(F.size("x") > 0)
    return rows.select("doc_id", F.size("x").cast("long").alias("n"), F.array_join("x.surface", "|").alias("surfaces"))


@_add("rule_url", "SELECT page_id, len(x)::BIGINT AS n, array_to_string(x, ' ') AS surfaces FROM (SELECT page_id, list_transform(regexp_extract_all(html, '" + URL.replace("'", "''") + "'), lambda u: rtrim(u, '.,;:!?。、)]')) AS x FROM pages) WHERE len(x) > 0")
def rule_url(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").withColumn("x", rule_places(F.col("html"), "url")).filter(F.size("x") > 0)
    return rows.select("page_id", F.size("x").cast("long").alias("n"), F.array_join("x.surface", " ").alias("surfaces"))


@_add(
    "span_offsets",
    f"""WITH p AS (SELECT doc_id, string_split_regex(regexp_replace(text, '({EMAIL})', chr(1) || '\\1' || chr(2), 'g'), '[' || chr(1) || chr(2) || ']') AS x FROM documents),
e AS (SELECT doc_id, unnest(range(2, len(x) + 1, 2)) AS k, x FROM p)
SELECT doc_id, len(array_to_string(x[:k - 1], ''))::BIGINT AS start_at, len(array_to_string(x[:k], ''))::BIGINT AS end_at, x[k] AS surface FROM e""",
)
def span_offsets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.explode(rule_places(F.col("text"), "email")).alias("x"))
    return rows.select("doc_id", F.col("x.start").cast("long").alias("start_at"), F.col("x.end").cast("long").alias("end_at"), F.col("x.surface").alias("surface"))


@_add("rules_detect", "SELECT o_orderkey AS id, type, 1::BIGINT AS n, chars::BIGINT AS chars FROM orders, (VALUES ('EMAIL', 12), ('URL', 21), ('SECRET', 20), ('PHONE', 13), ('POSTAL', 5), ('ID_NUMBER', 14)) AS v(type, chars)")
def rules_detect(spark: SparkSession, d: str) -> DataFrame:
    """All rules at once over texts that hold one string of each of six types, next to others that are none."""
    t = f"concat('to u', {K4}, '@ex.com, see https://site.org/', {K4}, '. AKIA', {K4}, {C4}, 'ABCDEFGH or 0120-', {C4}, '-', {K4}, ' and 010-', {C4}, '-', {K4}, ' in TX 7', {K4}, ' x', {K4})"
    rows = dealt(table(spark, d, "orders").select("o_orderkey", "o_custkey")).select(F.col("o_orderkey").alias("id"), F.explode(resolve(detect(F.expr(t)))).alias("x"))
    return rows.groupBy("id", F.col("x.type").alias("type")).agg(F.count("*").alias("n"), F.sum(F.col("x.end") - F.col("x.start")).cast("long").alias("chars"))


@_add(
    "resolve_spans",
    """WITH RECURSIVE s AS (SELECT l_orderkey AS doc, (l_partkey % 60)::INT AS a, (l_partkey % 60 + 1 + l_suppkey % 15)::INT AS b, l_linenumber AS o,
  CASE l_linenumber % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS r FROM lineitem),
k AS (SELECT doc, list({'a': a, 'b': b} ORDER BY r, a - b, a, o) AS l FROM s GROUP BY doc),
g AS (SELECT doc, l, 1 AS i, CAST([] AS STRUCT(a INT, b INT)[]) AS kept FROM k
  UNION ALL SELECT doc, l, i + 1, CASE WHEN len(list_filter(kept, lambda x: x.a < l[i].b AND l[i].a < x.b)) > 0 THEN kept ELSE list_append(kept, l[i]) END FROM g WHERE i <= len(l))
SELECT doc AS l_orderkey, x.a::BIGINT AS start_at, x.b::BIGINT AS end_at FROM (SELECT doc, unnest(kept) AS x FROM g WHERE i = len(l) + 1)""",
)
def resolve_spans(spark: SparkSession, d: str) -> DataFrame:
    source = F.when(F.col("l_linenumber") % 3 == 0, "rule").when(F.col("l_linenumber") % 3 == 1, "glossary").otherwise("llm")
    a = (F.col("l_partkey") % 60).cast("int")
    one = F.struct(a.alias("start"), (a + 1 + F.col("l_suppkey") % 15).cast("int").alias("end"), F.lit("T").alias("type"), source.alias("source"), F.col("l_linenumber").cast("int").alias("ord"), *[F.lit(None).cast("string").alias(c) for c in ("entity_id", "token", "render")], F.lit(None).cast("int").alias("level"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(one).cast(SPANS).alias("spans"))
    return rows.select("l_orderkey", F.explode(resolve(F.col("spans"))).alias("x")).select("l_orderkey", F.col("x.start").cast("long").alias("start_at"), F.col("x.end").cast("long").alias("end_at"))

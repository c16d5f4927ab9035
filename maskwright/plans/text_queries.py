"""Queries over scalar functions, structure, tokens, glossaries and masking, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import structure, text, tokens
from maskwright.functions.rules import RULES, detect, rule_places
from maskwright.functions.spans import places, resolve
from maskwright.operators import confirm, gate, glossary, pseudonyms, tidy
from maskwright.plans.rule_queries import table
from maskwright.plans.staging import settle
from maskwright.sources import files, providers

QUERIES, ORACLES = {}, {}
EMAIL = next(p for n, _, p, *_ in RULES if n == "email")
#: A glossary in the words of the part table.
GLOSSARY = [
    {"id": "COMPONENT_01", "kind": "COMPONENT", "level": 1, "status": "confirmed", "surfaces": ["red plate", "Hot Gizmo"], "alias": "first piece"},
    {"id": "COMPONENT_02", "kind": "COMPONENT", "level": 2, "status": "confirmed", "surfaces": ["small gear"], "alias": ""},
    {"id": "TERM_01", "kind": "TERM", "level": 3, "status": "confirmed", "surfaces": ["cold anvil"], "alias": ""},
    {"id": "TERM_02", "kind": "TERM", "level": 0, "status": "confirmed", "surfaces": ["ring"], "alias": ""},
    {"id": "ORG_01", "kind": "ORG", "level": 1, "status": "proposed", "surfaces": ["blue ring"], "alias": "supplier"},
    {"id": "bad-1", "kind": "THING", "level": 5, "status": "confirmed", "surfaces": ["SMALL GEAR"], "alias": ""},
]
#: (id, kind, level, status, alias, surfaces) as SQL rows.
VALUES = ", ".join(f"('{g['id']}', '{g['kind']}', {g['level']}, '{g['status']}', '{g['alias']}', [{', '.join(repr(s) for s in g['surfaces'])}])" for g in GLOSSARY)
G = f"g(id, kind, level, status, alias, surfaces) AS (VALUES {VALUES})"
EFFECTIVE = "CASE WHEN status = 'confirmed' THEN level ELSE greatest(level, 2) END"


def query(name: str, oracle: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return wrap


@query("norm_key", r"SELECT p_partkey, regexp_replace(lower(p_name || '-' || p_brand), '[\s.\-_]', '', 'g') AS norm, regexp_replace(lower(p_name || '_' || p_type), '[\s.\-_]', '', 'g') AS term_key FROM part")
def norm_key(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part")
    return rows.select("p_partkey", text.norm(F.concat("p_name", F.lit("-"), "p_brand")).alias("norm"), text.key(F.concat("p_name", F.lit("_"), "p_type")).alias("term_key"))


_LOOSE = "regexp_replace(lower({}), '[^a-z]', '', 'g')"
for _a, _b in text.LOOSE:
    _LOOSE = f"replace({_LOOSE}, '{_a}', '{_b}')"
_SOUND = "regexp_replace(lower({}), '[^a-z]', '', 'g')"
for _c in "abcdefghijklmnopqrstuvwxyz":
    _SOUND = f"regexp_replace({_SOUND}, '{_c}+', '{_c}', 'g')"
_FAMILY = "CASE " + " ".join(f"WHEN regexp_replace(lower({{0}}), '[^a-z]', '', 'g') IN ({', '.join(repr(x) for x in g)}) THEN '{min(g)}'" for g in text.FAMILY_GROUPS) + f" ELSE {_LOOSE.replace('{}', '{0}')} END"


@query("sound_forms", f"SELECT n_nationkey, {_SOUND.format('n_name')} AS sound, {_LOOSE.format('n_name')} AS loose, {_FAMILY.format('n_name')} AS family FROM nation")
def sound_forms(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_name")
    return table(spark, d, "nation").select("n_nationkey", text.sound(n).alias("sound"), text.loose(n).alias("loose"), text.family(n).alias("family"))


@query("is_latin", "SELECT doc_id, len(list_filter(string_split(text, ' '), lambda w: regexp_full_match(w, '[A-Za-z0-9 _\\-.]+')))::BIGINT AS latin FROM documents")
def is_latin(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(F.filter(F.split("text", " "), text.is_latin)).cast("long").alias("latin"))


@query("sha16", "SELECT doc_id, substr(sha256(text), 1, 16) AS sha FROM documents")
def sha16(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.sha16(F.col("text")).alias("sha"))


@query("clean_surface", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN 'the ' || w1 WHEN w1 IN ('new', 'old') THEN w2 || ' ' || p_size ELSE w1 || ' ' || w2 || ' ' || p_size END AS surface FROM (SELECT *, string_split(p_name, ' ')[1] AS w1, string_split(p_name, ' ')[2] AS w2 FROM part)")
def clean_surface(spark: SparkSession, d: str) -> DataFrame:
    w1, w2 = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    lead = F.when(F.col("p_partkey") % 3 == 0, "The our ").otherwise("see ")
    raw = F.when(F.col("p_partkey") % 3 == 2, F.concat(F.lit("'the "), w1, F.lit("'"))).otherwise(F.concat(F.lit("`"), lead, w1, F.lit(" "), w2, F.lit(" "), F.col("p_size").cast("string"), F.lit("` ")))
    return table(spark, d, "part").select("p_partkey", text.clean_surface(raw).alias("surface"))


@query("honorifics", "SELECT n_nationkey, e AS \"end\", CASE WHEN e = '이' AND n_nationkey % 2 = 1 THEN '보람이' WHEN e = '' THEN '보람' ELSE '보람' END AS bare FROM (SELECT n_nationkey, unnest(['ちゃん', 'さん', 'くん', '様', 'さま', '씨', '님', '이', '']) AS e FROM nation)")
def honorifics(spark: SparkSession, d: str) -> DataFrame:
    """A name with each honorific, and the linking vowel before a particle or not."""
    ends = [*text.HONORIFICS, "이", ""]
    rows = table(spark, d, "nation").select("n_nationkey", F.explode(F.array(*map(F.lit, ends))).alias("end"))
    name = F.concat(F.lit("보람"), F.col("end"))
    return rows.select("n_nationkey", "end", text.without_honorific(name, F.when(F.col("n_nationkey") % 2 == 0, "가").otherwise("X")).alias("bare"))


@query("same_person", """WITH x AS (SELECT c_custkey, c_custkey % 18 AS a, (c_custkey * 7 + c_nationkey) % 18 AS b, c_nationkey % 3 <> 0 AS given FROM customer) SELECT c_custkey, a // 2 = b // 2 AND given AS same, a // 2 = b // 2 AS family FROM x""")
def same_person(spark: SparkSession, d: str) -> DataFrame:
    """Two names from nine family names in two spellings each, whole in one slot or swapped, with a given name that sounds alike."""
    k, own = F.col("c_custkey"), F.array(*[F.lit(g[i]) for g in text.FAMILY_GROUPS[:9] for i in (0, 1)])
    a, b = F.element_at(own, (k % 18 + 1).cast("int")), F.element_at(own, ((k * 7 + F.col("c_nationkey")) % 18 + 1).cast("int"))
    given = F.when(F.col("c_nationkey") % 3 == 0, "tsubaki").otherwise("sora")
    whole = F.concat(given, F.lit(" "), b)
    bf, bg = text.split_full_name(F.when(k % 2 == 0, whole).otherwise(""), F.when(k % 2 == 0, "").otherwise(whole))
    rows = table(spark, d, "customer").select("c_custkey", a.alias("a"), b.alias("b"), bf.alias("bf"), bg.alias("bg"))
    return rows.select("c_custkey", text.same_person(F.col("a"), F.lit("seora"), F.col("bf"), F.col("bg")).alias("same"), text.same_family(F.col("a"), F.col("b")).alias("family"))


@query("similarity")
def similarity(spark: SparkSession, d: str) -> DataFrame:
    """The matching-blocks ratio of the names of nations of one region."""
    n = table(spark, d, "nation").select("n_regionkey", "n_name")
    m = n.select(F.col("n_regionkey"), F.col("n_name").alias("other"))
    return n.join(m, "n_regionkey").filter("n_name < other").select("n_name", "other", F.round(text.similarity(F.lower("n_name"), F.lower("other")), 6).alias("ratio"))


_LINE = r"regexp_extract_all(substr(l, length(regexp_extract(l, '^\s*(?:(?:[-*+]|\d+[.)]|#{1,6}|>)\s+)?', 0)) + 1), '[^\n.!?。！？]*(?:[.!?。！？]+|$)[ \t]*')"


@query("sentences", rf"SELECT doc_id, sum(len(s))::BIGINT AS n, sum(len(array_to_string(s, '')))::BIGINT AS chars, max(len(s[1]))::BIGINT AS longest_first FROM (SELECT doc_id, list_filter({_LINE}, lambda x: x <> '') AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)) GROUP BY doc_id")
def sentences(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of every line of every document, without what opens the line."""
    rows = table(spark, d, "documents").select("doc_id", F.explode(F.transform(structure.lines(F.col("text")), lambda x: structure.line_parts(x)["sentences"])).alias("s"))
    return rows.groupBy("doc_id").agg(F.sum(F.size("s")).cast("long").alias("n"), F.sum(F.length(F.array_join("s", ""))).cast("long").alias("chars"), F.max(F.length(F.get("s", F.lit(0)))).cast("long").alias("longest_first"))


@query("lines", "SELECT doc_id, len(string_split(text, chr(10)))::BIGINT - (CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 1 ELSE 0 END) AS n FROM documents")
def lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(structure.lines(F.col("text"))).cast("long").alias("n"))


@query("chunks", "SELECT doc_id, length(text)::BIGINT AS chars, true AS whole, true AS within FROM documents")
def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of 300 characters: together the text, none longer, each where it says it is."""
    rows = table(spark, d, "documents").withColumn("c", structure.chunks(F.col("text"), 300))
    place = F.forall("c", lambda x: F.substr("text", x["offset"] + 1, F.length(x["chunk"])) == x["chunk"])
    return rows.select("doc_id", F.length(F.array_join(F.col("c.chunk"), "")).cast("long").alias("chars"), (F.array_join(F.col("c.chunk"), "") == F.col("text")).alias("whole"), (place & F.forall("c", lambda x: F.length(x["chunk"]) <= 300)).alias("within"))


@query("title_names", r"SELECT doc_id, len(x)::BIGINT AS n, array_to_string(x, '|') AS names FROM (SELECT doc_id, regexp_extract_all(regexp_replace(text, '[^\x00-\x7F\p{P}\p{S}\p{Z}]', '_', 'g'), '" + structure.TITLE_NAME + r"') AS x FROM documents) WHERE len(x) > 0")
def title_names(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").withColumn("x", structure.title_names(F.col("text"))).filter(F.size("x") > 0)
    return rows.select("doc_id", F.size("x").cast("long").alias("n"), F.array_join("x", "|").alias("names"))


CODE_TEXT = "concat('call run_', lower(p_brand), '_', cast(p_size as string), ' of ', replace(initcap(p_type), ' ', ''), ' now')"
CODE_SQL = "'call run_' || lower(p_brand) || '_' || p_size || ' of ' || array_to_string(list_transform(string_split(p_type, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), '') || ' now'"
@query("code_names", r"SELECT p_partkey, array_to_string(regexp_extract_all(" + CODE_SQL + r", '" + structure.CODE_NAME + r"'), '|') AS names FROM part")
def code_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.array_join(structure.code_names(F.expr(CODE_TEXT)), "|").alias("names"))


DEFINED = "concat(p_name, case p_partkey % 3 when 0 then ' (' else '(' end, p_brand, ') and (', p_type, ')')"
@query("definitions", "SELECT p_partkey, p_brand AS inner_text FROM part WHERE ends_with(p_name, 'ring') AND length(p_brand) >= 2")
def definitions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.explode(structure.definitions(F.expr(DEFINED), "ring")).alias("inner_text"))


@query("glossary_match", f"""WITH {G}, s AS (SELECT id, kind, {EFFECTIVE} AS lv, unnest(surfaces) AS s FROM g), t AS (SELECT p_partkey, 'see ' || lower(p_name) || '; x' || p_name || ' ' AS t FROM part),
m AS (SELECT p_partkey, t, id, lv, s FROM t, s WHERE regexp_matches(t, '(?i)(?:^|[^A-Za-z0-9])' || replace(s, ' ', '[\\s_\\-.]?') || '(?:[^A-Za-z0-9]|$)')),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY length(s) DESC, id) AS k FROM m)
SELECT p_partkey, id AS entity_id, lv::BIGINT AS level FROM r WHERE k = 1
UNION ALL SELECT p_partkey, 'TERM_02', 0::BIGINT FROM part WHERE ends_with(p_name, ' ring')""")
def glossary_match(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit("see "), F.lower("p_name"), F.lit("; x"), F.col("p_name"), F.lit(" "))
    own = glossary.entries([g for g in GLOSSARY])
    rows = table(spark, d, "part").select("p_partkey", F.explode(glossary.match(t, own)).alias("x"))
    return rows.select("p_partkey", F.col("x.entity_id").alias("entity_id"), F.col("x.level").cast("long").alias("level"))


@query("glossary_summary", f"WITH {G} SELECT ({EFFECTIVE})::BIGINT AS effective_level, count(*) AS entries, sum(len(surfaces))::BIGINT AS spellings, count(*) FILTER (status <> 'confirmed') AS unconfirmed FROM g GROUP BY 1")
def glossary_summary(spark: SparkSession, d: str) -> DataFrame:
    return glossary.summary(glossary.glossary_frame(spark, glossary.entries(GLOSSARY))).withColumn("effective_level", F.col("effective_level").cast("long"))


@query("glossary_problems", rf"""WITH {G}, u AS (SELECT id, lower(unnest(surfaces)) AS s FROM g),
d AS (SELECT s FROM u GROUP BY s HAVING count(DISTINCT id) > 1)
SELECT id, 'id is not KIND_NN' AS problem FROM g WHERE NOT regexp_full_match(id, '[A-Z_]+_\d{{2,}}')
UNION ALL SELECT id, 'unknown kind' FROM g WHERE kind NOT IN ('PROJECT', 'COMPONENT', 'ALGORITHM', 'TERM', 'ORG', 'PERSON', 'SECRET')
UNION ALL SELECT id, 'level is not 0 to 3' FROM g WHERE level NOT IN (0, 1, 2, 3)
UNION ALL SELECT id, 'level 1 needs an alias' FROM g WHERE {EFFECTIVE} = 1 AND alias = ''
UNION ALL SELECT DISTINCT u.id, 'a spelling belongs to several entries' FROM u JOIN d USING (s)""")
def glossary_problems(spark: SparkSession, d: str) -> DataFrame:
    return glossary.problems(glossary.glossary_frame(spark, glossary.entries(GLOSSARY)))


@query("glossary_render", f"WITH {G} SELECT id, CASE WHEN {EFFECTIVE} = 1 AND alias <> '' THEN '[' || id || ': ' || alias || ']' ELSE '[' || id || ']' END AS shown FROM g")
def glossary_render(spark: SparkSession, d: str) -> DataFrame:
    rows = glossary.glossary_frame(spark, glossary.entries(GLOSSARY))
    return rows.select("id", glossary.render(F.col("id"), F.col("level"), F.col("status"), F.col("alias")).alias("shown"))


@query("l3_documents", "SELECT p_partkey, regexp_matches(lower(p_name), '(^|[^a-z0-9])cold[ _.-]?anvil($|[^a-z0-9])') AS blocked FROM part")
def l3_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.lower("p_name").alias("text"))
    return gate.analyse(docs, glossary.entries(GLOSSARY[:5])).select(F.col("doc_id").alias("p_partkey"), "blocked")


def _emails(spark: SparkSession, d: str) -> DataFrame:
    return settle(table(spark, d, "documents").select("doc_id", "text", resolve(detect(F.col("text"), ["email"])).alias("spans")))


_NUMBERED = rf"""e AS (SELECT doc_id, k, x[k] AS s, len(array_to_string(p[1:k], '')) + coalesce(len(array_to_string(x[1:k - 1], '')), 0) AS place FROM
  (SELECT doc_id, regexp_extract_all(text, '{EMAIL}') AS x, string_split_regex(text, '{EMAIL}') AS p, unnest(range(1, len(regexp_extract_all(text, '{EMAIL}')) + 1)) AS k FROM documents)),
n AS (SELECT *, regexp_replace(lower(s), '[\s.\-_]', '', 'g') AS norm FROM e),
f AS (SELECT norm, min(doc_id * 1000000 + place) AS first FROM n GROUP BY norm),
t AS (SELECT norm, '[EMAIL_' || CASE WHEN r < 1000 THEN lpad(r::VARCHAR, 3, '0') ELSE r::VARCHAR END || ']' AS token FROM (SELECT norm, row_number() OVER (ORDER BY first) AS r FROM f))"""


@query("token_numbering", f"WITH {_NUMBERED} SELECT norm, token FROM t")
def token_numbering(spark: SparkSession, d: str) -> DataFrame:
    found = pseudonyms.occurrences(_emails(spark, d))
    return pseudonyms.number_surfaces(found, *pseudonyms.empty_state(spark)).select("norm", "token")


@query("mask_documents", f"""WITH {_NUMBERED}, p AS (SELECT doc_id, string_split_regex(text, '{EMAIL}') AS p FROM documents),
q AS (SELECT doc_id, unnest(p) AS part, unnest(range(1, len(p) + 1)) AS k FROM p)
SELECT q.doc_id, string_agg(part || coalesce(token, ''), '' ORDER BY q.k) AS masked FROM q LEFT JOIN n ON q.doc_id = n.doc_id AND q.k = n.k LEFT JOIN t USING (norm) GROUP BY q.doc_id""")
def mask_documents(spark: SparkSession, d: str) -> DataFrame:
    masked, _, _ = pseudonyms.mask(_emails(spark, d), *pseudonyms.empty_state(spark))
    return masked.select("doc_id", "masked")


@query("unmask_roundtrip", f"SELECT doc_id, text AS restored, len(regexp_extract_all(text, '{EMAIL}'))::BIGINT AS tokens_in_answer, 0::BIGINT AS unresolved FROM documents")
def unmask_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    masked, restore, _ = pseudonyms.mask(_emails(spark, d), *pseudonyms.empty_state(spark))
    return pseudonyms.unmask(masked.select("doc_id", F.col("masked").alias("answer")), restore, pseudonyms.empty_state(spark)[1])


def _restore(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("ord"), F.concat(F.lit("["), F.col("l_returnflag"), F.lit("_0"), F.col("l_linestatus").isin("O").cast("int").cast("string"), F.lit("]")).alias("token"), F.col("l_partkey").cast("string").alias("surface"))


_RESTORE = "r AS (SELECT l_orderkey AS doc_id, l_linenumber * 10000000 + l_partkey AS ord, '[' || l_returnflag || '_0' || (CASE WHEN l_linestatus = 'O' THEN '1' ELSE '0' END) || ']' AS token, l_partkey::VARCHAR AS surface FROM lineitem)"


@query("occurrence_queue", f"WITH {_RESTORE} SELECT doc_id, ord, token, surface, row_number() OVER (PARTITION BY doc_id, token ORDER BY ord)::INT AS nth FROM r")
def occurrence_queue(spark: SparkSession, d: str) -> DataFrame:
    return pseudonyms.occurrence_queue(_restore(spark, d))


@query("first_surfaces", f"WITH {_RESTORE} SELECT doc_id, token, arg_min(surface, ord) AS first FROM r GROUP BY doc_id, token")
def first_surfaces(spark: SparkSession, d: str) -> DataFrame:
    return pseudonyms.first_surfaces(_restore(spark, d))


@query("type_counts", f"WITH {_RESTORE} SELECT doc_id, regexp_extract(token, '^\\[([A-Z_]+)_', 1) AS type, count(*) AS n FROM r GROUP BY 1, 2")
def type_counts(spark: SparkSession, d: str) -> DataFrame:
    return pseudonyms.type_counts(_restore(spark, d)).select("doc_id", F.explode("counts").alias("type", "n"))


@query("entity_listing", "SELECT '[' || p_brand || ']' AS token, p_type AS type, count(DISTINCT p_name) AS n_spellings FROM part GROUP BY 1, 2")
def entity_listing(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.concat(F.lit("["), "p_brand", F.lit("]")).alias("token"), F.col("p_type").alias("type"), F.col("p_name").alias("surface"))
    return gate.entity_listing(rows)


TOKENS = "concat('from [PERSON_', lpad(cast(o_custkey % 1000 as string), 3, '0'), '] to [ORG_', lpad(cast(o_orderkey % 100 as string), 2, '0'), ': the buyer] end')"


@query("token_scan", "SELECT o_orderkey, '[PERSON_' || lpad((o_custkey % 1000)::VARCHAR, 3, '0') || ']|[ORG_' || lpad((o_orderkey % 100)::VARCHAR, 2, '0') || ']' AS tokens FROM orders")
def token_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.array_join(tokens.tokens(F.expr(TOKENS)), "|").alias("tokens"))


OUT = "concat('[PERSON_', cast(o_custkey % 1000 as string), '] wrote to 【ORG_', lpad(cast(o_orderkey % 100 as string), 2, '0'), '】 and PERSON_999999')"


@query("token_repair", "SELECT o_orderkey, '[PERSON_' || CASE WHEN o_custkey % 1000 BETWEEN 10 AND 99 THEN (o_custkey % 1000)::VARCHAR ELSE lpad((o_custkey % 1000)::VARCHAR, 3, '0') END || '] wrote to [ORG_' || lpad((o_orderkey % 100)::VARCHAR, 2, '0') || '] and PERSON_999999' AS repaired FROM orders")
def token_repair(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", tokens.repair(F.expr(OUT), tokens.tokens(F.expr(TOKENS))).alias("repaired"))


@query("token_report", "SELECT o_orderkey, 2::BIGINT AS input_unique, (CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS preserved_unique, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '[ORG_' || lpad((o_orderkey % 100)::VARCHAR, 2, '0') || '],' END || '[PERSON_' || lpad((o_custkey % 1000)::VARCHAR, 3, '0') || ']' AS missing, '[URL_001]' AS invented, '' AS malformed FROM orders")
def token_report(spark: SparkSession, d: str) -> DataFrame:
    out = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("[ORG_"), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"), F.lit("] [URL_001]"))).otherwise(F.lit("[URL_001]"))
    rows = table(spark, d, "orders").select("o_orderkey", tokens.report(F.expr(TOKENS), out).alias("r"))
    return rows.select("o_orderkey", F.array_join("r.malformed", ",").alias("malformed"), "r.input_unique", "r.preserved_unique", F.array_join("r.missing", ",").alias("missing"), F.array_join("r.invented", ",").alias("invented"))


@query("reduce_context", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '- kept one. ' ELSE '- ' END || chr(10) || 'last.' AS kept FROM orders")
def reduce_context(spark: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("o_orderkey") % 2 == 0, F.lit("- kept one. [TERM_01] is out.\nlast.")).otherwise(F.lit("- [TERM_01] is out.\nlast."))
    return table(spark, d, "orders").select("o_orderkey", structure.reduce_context(t, F.array(F.lit("[TERM_01]")), tokens.tokens).alias("kept"))


@query("tidy_spans", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 3 END::BIGINT AS n, CASE WHEN p_partkey % 2 = 0 THEN length(p_name) ELSE length(p_name) - 1 + 3 END::BIGINT AS chars FROM part")
def tidy_spans(spark: SparkSession, d: str) -> DataFrame:
    """Words as a detector's person spans: two next to each other are one name, three are a list; times are no address."""
    t = F.concat(F.initcap("p_name"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise(" Ann"), F.lit(" at 09:15"))
    named = F.transform(places(F.col("text"), r"\b[A-Z][a-z]+\b"), lambda x: F.struct(x["start"], x["end"], F.lit("PERSON").alias("type")))
    timed = F.transform(places(F.col("text"), r"\d\d:\d\d"), lambda x: F.struct(x["start"], x["end"], F.lit("ADDRESS").alias("type")))
    rows = table(spark, d, "part").select("p_partkey", t.alias("text")).withColumn("s", tidy.tidy(F.col("text"), F.concat(named, timed)))
    return rows.select("p_partkey", F.size("s").cast("long").alias("n"), F.aggregate("s", F.lit(0), lambda a, x: a + x["end"] - x["start"]).cast("long").alias("chars"))


@query("markup_parse", "SELECT n_nationkey AS id, 'see ' || n_name || ' now' AS text, 4::BIGINT AS start_at, (4 + length(n_name))::BIGINT AS end_at, 'ORG' AS type, 'e' || n_nationkey AS entity_id FROM nation")
def markup_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.lit("en").alias("lang"), F.concat(F.lit("see [[ORG:e"), F.col("n_nationkey").cast("string"), F.lit("|"), "n_name", F.lit("]] now")).alias("marked"), F.lit("").alias("note"))
    return files.parse_markup(rows).select("id", "text", F.inline("spans")).select("id", "text", F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"), "type", "entity_id")


@query("model_json", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name || '|x' ELSE '' END AS found, CASE WHEN n_nationkey % 3 = 0 THEN lower(n_name) ELSE '' END AS family, '' AS given FROM nation")
def model_json(spark: SparkSession, d: str) -> DataFrame:
    """Replies of a model: whole, cut off, and without the list that was asked for."""
    k, name = F.col("n_nationkey") % 3, F.col("n_name")
    listed = F.concat(F.when(k == 2, '{"others": [').otherwise('{"entities": ['), F.lit('{"text": "'), name, F.lit('", "type": "ORG"}, {"text": "x"}]'), F.when(k == 1, "").otherwise("}"))
    roman = F.when(k == 0, F.concat(F.lit('{"family": " '), name, F.lit(' ", "nationality": null}'))).when(k == 1, '{"family": "').otherwise("[]")
    rows = table(spark, d, "nation").select("n_nationkey", providers.parsed(listed, "entities", "text:string,type:string").alias("e"), providers.roman_parts(roman).alias("r"))
    return rows.select("n_nationkey", F.array_join(F.transform("e", lambda x: x["text"]), "|").alias("found"), "r.family", "r.given")


@query("turn_items", "WITH h AS (SELECT conv_id, turn, role, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS item FROM conversations) SELECT conv_id::VARCHAR AS file, min(turn) FILTER (role = 'user')::INT AS n, CASE WHEN count(*) FILTER (role <> 'user') > 0 THEN 3 ELSE 2 END AS level FROM h WHERE item > 0 GROUP BY conv_id, item")
def turn_items(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as checklists: user turns are headings, every other line belongs to the last heading above it."""
    line = F.when(F.col("role") == "user", F.concat(F.lit("## [ ] P"), tokens.padded(F.col("turn"), 3), F.lit(" · t"))).otherwise("- level: 3")
    rows = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("file"), F.col("turn").cast("int").alias("n"), line.alias("line"))
    return confirm.items(rows, confirm.PENDING_HEAD).select("file", "n", "level")


__all__ = ["ORACLES", "QUERIES", "rule_places"]

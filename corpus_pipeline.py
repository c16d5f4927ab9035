"""A training corpus from raw documents, in five stages: quality rules, near duplicates, decontamination, PII, packing.

Each stage takes the documents that the one before has kept, as a Parquet table, and returns what it keeps. All but the last
return the columns of ``documents``. No stage collects ids: what one rejects is an anti-join away.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import decontaminate, near_duplicates, packing, quality_rules, surrogates
from maskwright.llm.queries import PII_KEY, tokenizer_path
from maskwright.llm.workspace import bounded_broadcast, stage, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and that the weakly supervised rules take for good; null and empty texts go. Repeated
    rows are judged alike; other columns stay, whatever their names."""
    return quality_rules.keep_good(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row, that with the smallest doc_id (null comes last; of several texts under it, that
    with the smallest hash). Of rows without a word, and of rows that repeat doc_id and text, one each."""
    found = stage(near_duplicates.assign(docs), "assigned")
    order = F.struct((F.col("id") == near_duplicates.NO_ID).alias("absent"), "id", "digest")
    kept = stage(found.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min(order).alias("row")).select("row.id", "row.digest").unionByName(found.filter(F.col("root").isNull()).select("id", "digest")).distinct(), "kept")
    repeats = stage(found.groupBy("id", "digest").agg(F.count("*").alias("n")).filter("n > 1").select("id", "digest").join(kept, ["id", "digest"], "left_semi"), "repeats")
    own = [f"_in_{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, own, strict=True))
    rows = docs.toDF(*own).withColumn("id", F.coalesce(F.col(at["doc_id"]).cast("long"), F.lit(near_duplicates.NO_ID))).withColumn("digest", F.xxhash64(F.col(at["text"]).cast("string")))
    twice, _ = bounded_broadcast(repeats, 1_000_000)
    out = rows.join(kept, ["id", "digest"], "left_semi")
    once = out.join(twice, ["id", "digest"], "left_anti").select(*own)
    if not repeats.isEmpty():
        # equal rows combine before they are shuffled, however many there are
        once = once.unionByName(out.join(twice, ["id", "digest"], "left_semi").groupBy("id", "digest").agg(F.first(F.struct(*own)).alias("row")).select("row.*"))
    return once.toDF(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an occurrence of a benchmark window; rows that repeat a doc_id, null too, go or stay together. Null or
    empty texts have no words and stay."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    hit = stage(found.filter("contaminated").select("doc_id"), "contaminated")
    own = [f"_in_{i}" for i in range(len(docs.columns))]
    listed, _ = bounded_broadcast(hit.select(F.col("doc_id").alias("hit")), 1_000_000)
    kept = docs.toDF(*own).join(listed, F.col(own[docs.columns.index("doc_id")]).eqNullSafe(F.col("hit")), "left_anti")
    return kept.toDF(*docs.columns)


def pseudonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every detected entity replaced by its surrogate; n_chars, if there is one, follows the text. Null and empty
    texts stay as they are; repeated rows are changed alike."""
    changed, _ = surrogates.pseudonymise(docs, PII_KEY)
    size = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return (changed.withColumn("n_chars", size) if size is not None else changed).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 2048 tokens. Null and empty texts: the separator alone.
    Repeated rows are packed as often as they come; other columns are ignored."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("near_duplicates", deduplicate),
    ("decontamination", decontaminated),
    ("pii", pseudonymised),
    ("packing", packed),
]

#: SQL has no expectation-maximisation, surrogates or best-fit packing; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

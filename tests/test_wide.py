"""Steps that must not run in one task, more than once, or on more rows than they need."""

from pyspark.sql import functions as F

from maskwright.functions.rules import detect
from maskwright.functions.spans import resolve
from maskwright.operators import bootstrap, pseudonyms, router
from maskwright.plans import registry
from maskwright.sources.providers import FixtureProvider
from maskwright.streaming import ingest


def test_a_batch_of_one_partition_is_dealt_out(spark, monkeypatch):
    settled, plain = [], ingest.settle
    monkeypatch.setattr(ingest, "settle", lambda df: settled.append(plain(df)) or settled[-1])
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("to u"), "id", F.lit("@ex.com")).alias("text")).coalesce(1)
    got = ingest.process(docs, *pseudonyms.empty_state(spark)).routed
    assert len(settled[0].inputFiles()) == 4  # the analysed texts: a file of each of four tasks
    assert got.filter("route = 'cloud_masked'").count() == 400


def test_masking_numbers_once_for_all_its_results(spark):
    rows = spark.range(6).select(F.col("id").alias("doc_id"), F.concat(F.lit("to u"), F.col("id") % 2, F.lit("@ex.com")).alias("text")).withColumn("spans", resolve(detect(F.col("text"))))
    masked, restore, tokens = pseudonyms.mask(rows, *pseudonyms.empty_state(spark))
    assert "Aggregate" not in tokens._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in restore._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["doc_id"], r["masked"]) for r in masked.collect()} == {(k, f"to [EMAIL_{k % 2 + 1:03d}]") for k in range(6)}


def test_a_model_is_asked_once_for_each_text(spark, tmp_path):
    log = str(tmp_path / "asked")

    class Counted(FixtureProvider):  # here, so that workers get it by value
        def extract_terms(self, text):
            with open(log, "a") as f:
                f.write(text + "\n")
            return []

    docs = spark.range(5).select(F.col("id").alias("doc_id"), F.concat(F.lit("a BrassWheel"), F.col("id").cast("string"), F.lit(" of HotGizmo")).alias("text"))
    none = spark.createDataFrame([], "surface string")
    glossary = spark.createDataFrame([(["Hot Gizmo"],)], "surfaces array<string>")
    got = router.find_suspects(docs, glossary, none, spark.createDataFrame([], "doc_id long, surface string"), Counted)
    assert sorted((r["doc_id"], r["key"]) for r in got.collect()) == [(k, f"brasswheel{k}") for k in range(5)]
    assert len((tmp_path / "asked").read_text().splitlines()) == 5


def test_equal_brackets_are_one_before_their_tails_are_cut(spark, small):
    run = registry.QUERIES["definition_terms"](spark, small)._jdf.queryExecution()
    assert "SortMergeJoin [surface" in run.sparkPlan().toString()  # else the tails are what is broadcast
    plan = run.optimizedPlan().toString()
    tails = next(x for x in plan.splitlines() if "Generate explode(transform(sequence(1" in x)
    below = plan[plan.index(tails) :]
    assert "LeftSemi" in below and "Aggregate" in below and "Repartition" in below


def test_terms_behind_many_brackets_and_with_brackets_in_them(spark):
    """A line of many brackets; a term that itself holds brackets, some right after each other; a line that begins with one."""
    docs = spark.createDataFrame([(1, "x (ab)(cd) big (one) (two) Gear (Wheel) and " * 300 + "end (Wheel)"), (2, "(Wheel) none"), (3, "Gear （Wheel）\nGear\n(Wheel)")], "doc_id long, text string")
    names = spark.createDataFrame([("Gear", "gear"), ("Wheel", "wheel"), ("(ab)(cd) big (one) (two) Gear", "long"), ("(one)", "one"), ("two", "two")], "surface string, key string")
    assert sorted(tuple(r) for r in bootstrap.definition_edges(docs, names).collect()) == [("gear", "wheel"), ("long", "wheel"), ("one", "two")]

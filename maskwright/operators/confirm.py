"""Checklists for people: proposals and pending terms as markdown, read back and merged into the glossary.

A checklist is one small file. Its lines are parsed as rows; each line belongs to the last heading above it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions.text import folded, key
from maskwright.functions.tokens import padded
from maskwright.operators.glossary import KINDS
from maskwright.plans.staging import numbered

#: Headings and fields of the two checklists, as they stand in files written before.
PENDING_HEAD = r"^## \[(x|X|o|O| )\] P(\d+) · (.+)$"
REVIEW_HEAD = r"^## \[(x|X| )\] C(\d+) · (.+)$"
FIELD = r"^- (kind|level|설명|표기):\s*(.*)$"
EXCLUDED_HEAD, EXCLUDED_LINE = "## 제외된 후보", r"^- \[(x|X)\] (.+)$"


def numbered_lines(files: DataFrame) -> DataFrame:
    """file, n, line for (file, text)."""
    return files.select("file", F.posexplode(F.split("text", r"\r\n|\n|\r", -1)).alias("n", "line"))


def items(lines: DataFrame, head: str) -> DataFrame:
    """file, item, state, n, title, kind, level, alias, surfaces of a checklist's lines (file, n, line)."""
    is_head = F.col("line").rlike(head)
    order = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("line").startswith(EXCLUDED_HEAD).cast("int")).over(order)
    rows = lines.withColumn("item", F.sum(is_head.cast("int")).over(order)).withColumn("excluded", stop > 0)
    inside = rows.filter((F.col("item") > 0) & ~F.col("excluded"))
    name, value = F.regexp_extract("line", FIELD, 1), F.trim(F.regexp_extract("line", FIELD, 2))
    last = lambda f: F.max_by(F.when(name == f, value), F.when(name == f, F.col("n")))
    got = inside.groupBy("file", "item").agg(
        F.max(F.when(is_head, F.regexp_extract("line", head, 1))).alias("state"), F.max(F.when(is_head, F.regexp_extract("line", head, 2))).cast("int").alias("n"), F.max(F.when(is_head, F.trim(F.regexp_extract("line", head, 3)))).alias("title"),
        last("kind").alias("kind"), last("level").alias("level"), last("설명").alias("alias"), last("표기").alias("surfaces"),
    )
    state = F.when(F.trim(F.lower("state")) == "", " ").otherwise(F.lower("state"))
    digit = F.regexp_extract("level", r"^(\d)", 1)
    split = F.filter(F.transform(F.split(F.coalesce("surfaces", F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    return got.select("file", "item", state.alias("state"), "n", "title", F.when(F.coalesce("kind", F.lit("")) == "", "TERM").otherwise(F.upper("kind")).alias("kind"), F.when(F.coalesce(digit, F.lit("")) == "", 2).otherwise(digit.cast("int")).alias("level"), F.coalesce("alias", F.lit("")).alias("alias"), split.alias("surfaces"))


def parse_pending(lines: DataFrame) -> DataFrame:
    """Pending items; one without spellings has its title."""
    return items(lines, PENDING_HEAD).withColumn("surfaces", F.when(F.size("surfaces") == 0, F.array("title")).otherwise(F.col("surfaces")))


def parse_review(lines: DataFrame) -> DataFrame:
    """Checked proposals that have spellings, and checked lines of the excluded section."""
    chosen = items(lines, REVIEW_HEAD).filter((F.col("state") == "x") & (F.size("surfaces") > 0))
    order = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    late = lines.withColumn("late", F.sum(F.col("line").startswith(EXCLUDED_HEAD).cast("int")).over(order)).filter((F.col("late") > 0) & F.col("line").rlike(EXCLUDED_LINE))
    title = F.trim(F.regexp_extract("line", EXCLUDED_LINE, 2))
    more = late.select("file", (F.col("n") + 1_000_000).cast("long").alias("item"), F.lit("x").alias("state"), F.lit(None).cast("int").alias("n"), title.alias("title"), F.lit("TERM").alias("kind"), F.lit(2).alias("level"), F.lit("").alias("alias"), F.array(title).alias("surfaces"))
    return chosen.unionByName(more)


def item_text(letter: str) -> F.Column:
    """One checklist item as text, from (state, n, title, kind, level, alias, surfaces)."""
    return F.concat_ws(
        "\n", F.concat(F.lit("## ["), F.col("state"), F.lit(f"] {letter}"), padded(F.col("n"), 3), F.lit(" · "), F.col("title")), F.concat(F.lit("- kind: "), F.col("kind")),
        F.concat(F.lit("- level: "), F.col("level").cast("string")), F.concat(F.lit("- 설명: "), F.col("alias")), F.concat(F.lit("- 표기: "), F.array_join("surfaces", " | ")), F.lit(""),
    )


def render(checklist: DataFrame, letter: str = "P") -> DataFrame:
    """file, text: the items of each file in their order."""
    return checklist.withColumn("part", item_text(letter)).groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda x: x["part"]), "\n").alias("text"))


def render_review(found: DataFrame, excluded: DataFrame) -> DataFrame:
    """text: the proposals of a bootstrap as one checklist, most documents first, and the excluded ones in their own section.
    One file that a person reads, so it is put together in one row."""
    rank = lambda: F.struct((-F.col("documents")).alias("d"), (-F.col("total")).alias("t"), F.col("root").alias("r"))
    surfaces = F.transform(bootstrap_order(F.col("surfaces")), lambda x: x["surface"])
    rows = found.select(F.struct(rank().alias("at"), F.col("title").alias("title"), F.col("kind").alias("kind"), F.get("descriptions", F.lit(0)).alias("alias"), surfaces.alias("surfaces")).alias("x"))
    listed = rows.agg(F.array_sort(F.collect_list("x")).alias("items"))
    item = lambda x, i: F.concat_ws("\n", F.concat(F.lit("## [ ] C"), padded(i + 1, 3), F.lit(" · "), x["title"]), F.concat(F.lit("- kind: "), x["kind"]), F.lit("- level: 2"), F.concat(F.lit("- 설명: "), F.coalesce(x["alias"], F.lit(""))), F.concat(F.lit("- 표기: "), F.array_join(x["surfaces"], " | ")), F.lit(""))
    gone = excluded.agg(F.array_sort(F.collect_list("title")).alias("gone"))
    section = F.when(F.size("gone") > 0, F.concat(F.lit("\n" + EXCLUDED_HEAD + "\n"), F.array_join(F.transform("gone", lambda t: F.concat(F.lit("- [ ] "), t)), "\n"), F.lit("\n"))).otherwise("")
    return listed.crossJoin(gone).select(F.concat(F.array_join(F.transform("items", item), "\n"), section).alias("text"))  # one row each


def bootstrap_order(surfaces: F.Column) -> F.Column:
    """Spellings (surface, n, ord) by falling count, then in their order."""
    sort = lambda a, b: F.when(a["n"] != b["n"], F.when(a["n"] > b["n"], -1).otherwise(1)).otherwise(F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0))
    return F.array_sort(surfaces, sort)


def add_pending(pending: DataFrame, found: DataFrame) -> DataFrame:
    """``pending`` with an item for each suspect (surface, ord, kind, alias) whose key no pending spelling has, numbered on."""
    have = pending.select(F.explode("surfaces").alias("s")).select(key(F.col("s")).alias("key")).distinct()
    new = found.withColumn("key", key(F.col("surface"))).join(have, "key", "left_anti").groupBy("key").agg(F.min(F.struct("ord", "surface", "kind", "alias")).alias("x")).select("x.*")
    top = pending.agg(F.coalesce(F.max("n"), F.lit(0)).alias("top"), F.coalesce(F.max("file"), F.lit("pending")).alias("file"))
    rows = numbered(new.withColumn("one", F.lit(0)), "one", ["ord", "surface"], "turn").crossJoin(F.broadcast(top)).select("file", (F.col("top") + F.col("turn")).cast("long").alias("item"), F.lit(" ").alias("state"), (F.col("top") + F.col("turn")).cast("int").alias("n"), F.col("surface").alias("title"), "kind", F.lit(2).alias("level"), "alias", F.array("surface").alias("surfaces"))
    return pending.withColumn("item", F.col("item").cast("long")).unionByName(rows)


def split_pending(pending: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(to protect, to allow, undecided)."""
    return tuple(pending.filter(F.col("state") == s) for s in ("x", "o", " "))


def allowed(allow: DataFrame, chosen: DataFrame) -> DataFrame:
    """The allow list (surface) with the spellings of ``chosen``, each once."""
    return allow.select("surface").unionByName(chosen.select(F.explode("surfaces").alias("surface"))).distinct()


def apply_review(glossary: DataFrame, chosen: DataFrame) -> DataFrame:
    """The glossary with the chosen items merged in.

    An item that shares a spelling (any case) with an entry adds its other spellings to it, the first such spelling deciding;
    any other becomes the next confirmed entry of its kind. No entry owns a spelling that another has.
    """
    owner = glossary.select("id", F.explode("surfaces").alias("s")).groupBy(folded(F.col("s")).alias("low")).agg(F.max("id").alias("owner"))
    spelt = chosen.select("file", "item", F.posexplode("surfaces").alias("pos", "s")).withColumn("low", folded(F.col("s"))).join(owner, "low", "left")
    hit = spelt.groupBy("file", "item").agg(F.min_by("owner", F.when(F.col("owner").isNotNull(), F.col("pos"))).alias("owner"))
    more = spelt.filter(F.col("owner").isNull()).drop("owner").join(hit.filter("owner is not null"), ["file", "item"]).groupBy(F.col("owner").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("item", "pos", "s"))), lambda x: x["s"]).alias("more"))
    kept = glossary.join(more, "id", "left").select("id", "kind", "level", "status", F.array_distinct(F.concat("surfaces", F.coalesce("more", F.array().cast("array<string>")))).alias("surfaces"), "alias")
    kind = F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise("TERM")
    new = chosen.join(hit.filter("owner is null").select("file", "item"), ["file", "item"]).withColumn("kind", kind)
    top = glossary.groupBy(F.regexp_extract("id", r"^(.*)_\d+$", 1).alias("kind")).agg(F.max(F.regexp_extract("id", r"_(\d+)$", 1).try_cast("int")).alias("top"))
    turn = F.row_number().over(Window.partitionBy("kind").orderBy("file", "item"))
    made = new.withColumn("turn", turn).join(top, "kind", "left").select(F.concat("kind", F.lit("_"), padded(F.coalesce("top", F.lit(0)) + F.col("turn"), 2)).alias("id"), "kind", "level", F.lit("confirmed").alias("status"), "surfaces", "alias")
    return kept.unionByName(made)

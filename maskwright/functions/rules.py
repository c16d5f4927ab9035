"""Format rules: fifteen patterns for strings whose form alone tells what they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions.spans import let, no_spans, places, span

_BEFORE, _AFTER = r"(?<![\d\-])", r"(?![\d\-])"
#: Name, type, pattern, the group whose place counts; and what no match is without, a string or (re:) a pattern.
RULES: tuple[tuple[str, str, str, int, str], ...] = (
    ("secret_pem", "SECRET", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", 0, "-----BEGIN "),
    ("secret_prefix", "SECRET", r"(?<![A-Za-z0-9])(?:sk-(?:ant-|proj-)?[A-Za-z0-9_\-]{20,}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,}|AKIA[0-9A-Z]{16}|xox[baprs]-[A-Za-z0-9\-]{10,}|hf_[A-Za-z0-9]{30,}|AIza[0-9A-Za-z_\-]{35})(?![A-Za-z0-9])", 0, "re:sk-|gh[pousr]_|github_pat_|AKIA|xox[baprs]-|hf_|AIza"),
    ("url", "URL", r"(?:https?://|www\.)[A-Za-z0-9\-._~:/?#@!$&'*+,;=%\[\]()]+", 0, "re:://|www[.]"),
    ("email", "EMAIL", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", 0, "@"),
    ("id_kr", "ID_NUMBER", _BEFORE + r"\d{6}-[1-8]\d{6}" + _AFTER, 0, "-"),
    ("id_jp", "ID_NUMBER", r"(?<![\d])\d{4}[ \-]?\d{4}[ \-]?\d{4}(?![\d])", 0, r"re:\d{3}"),
    ("phone_international", "PHONE", r"\+8[12][ \-]?\d{1,4}[ \-]?\d{2,4}[ \-]?\d{3,4}" + _AFTER, 0, "+8"),
    ("phone_kr_mobile", "PHONE", _BEFORE + r"01[016789][ \-]?\d{3,4}[ \-]?\d{4}" + _AFTER, 0, r"re:\d{3}"),
    ("phone_jp_free", "PHONE", _BEFORE + r"0(?:120|570|800)-\d{3}-\d{3,4}" + _AFTER, 0, "-"),
    ("phone_paren", "PHONE", r"\(0\d{1,4}\)\s?\d{1,4}-\d{4}" + _AFTER, 0, "(0"),
    ("passport", "ID_NUMBER", r"(?:여권\s*번호|여권|旅券番号|パスポート番号|[Pp]assport(?:\s*(?:[Nn]o\.?|number))?)\s*[:：]?\s*([A-Z]{1,2}\d{7,8})(?![\dA-Za-z])", 1, r"re:\d{7}"),
    ("phone_3part", "PHONE", _BEFORE + r"0\d{1,4}-\d{1,4}-\d{4}" + _AFTER, 0, "-"),
    ("postal_jp", "POSTAL", _BEFORE + r"\d{3}-\d{4}" + _AFTER, 0, "-"),
    ("postal_kr", "POSTAL", r"(?:(?<=우편번호 )|(?<=우편번호: )|(?<=\(우\) )|(?<=\(우\)))\d{5}(?!\d)", 0, "우"),
    ("postal_us", "POSTAL", r"(?<=\b[A-Z]{2} )\d{5}(?:-\d{4})?(?!\d)", 0, r"re:\d{3}"),
)
#: Fixed value: signs that end a sentence or bracket, not a URL.
URL_TAIL = ".,;:!?。、)]"


def pattern_of(name: str) -> str:
    return "(?U)" + next(p for n, _, p, _, _ in RULES if n == name)


def rule_places(text: Column, name: str) -> Column:
    """array<struct<start,end,surface>> of one rule; a URL without the punctuation after it."""
    _, kind, _, group, hint = next(r for r in RULES if r[0] == name)
    found = places(text, pattern_of(name), group)
    if kind == "URL":
        bare = lambda x: F.rtrim(x["surface"], F.lit(URL_TAIL))
        found = F.transform(found, lambda x: F.struct(x["start"], (x["start"] + F.length(bare(x))).cast("int").alias("end"), bare(x).alias("surface")))
    if not hint:
        return found
    may = text.rlike("(?U)" + hint[3:]) if hint.startswith("re:") else F.contains(text, F.lit(hint))
    return F.when(may, found).otherwise(F.array().cast("array<struct<start:int,end:int,surface:string>>"))


def detect(text: Column, names: list[str] | None = None) -> Column:
    """All spans of the rules, before overlaps are resolved."""
    chosen = [r for r in RULES if names is None or r[0] in names]

    def spans_of(t: Column, k: int, name: str, kind: str) -> Column:
        return F.transform(rule_places(t, name), lambda x: span(x["start"], x["end"], F.lit(kind), F.lit("rule"), F.lit(k)))

    # the text may be an expression: all rules share one evaluation of it
    parts = lambda t: F.concat(*[spans_of(t, k, name, kind) for k, (name, kind, *_) in enumerate(chosen)])
    return F.coalesce(let(text, parts), no_spans())

"""Tokens that stand for spans: their grammar, splicing them into a text, finding, repairing and reporting on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions.spans import let

#: A token ([TYPE_01], [TYPE_001], [TYPE_01: description]), a token a writer has mangled, and the token types.
TOKEN = r"\[([A-Z_]+)_(\d{2,})(?::[^\[\]\n]{0,80})?\]"
LOOSE_TOKEN = r"(?:[\[【［「〔(]\s*)?([A-Z]+(?:_[A-Z]+)*)[\s_＿]?(\d{1,4})(?:\s*[\]】］」〕)])?"
KINDS = ("PERSON", "EMAIL", "PHONE", "ADDRESS", "ORG", "URL", "POSTAL", "ID_NUMBER", "PROJECT", "COMPONENT", "ALGORITHM", "TERM", "SECRET")

_TOKEN, _LOOSE = "(?U)" + TOKEN, "(?U)" + LOOSE_TOKEN


def has_token(text: Column) -> Column:
    return text.rlike(_TOKEN)


def canonical(token: Column) -> Column:
    """A token without its description; anything else as it is."""
    return F.regexp_replace(token, r"(?U)\A" + TOKEN + r"\z", "[$1_$2]")


def tokens(text: Column) -> Column:
    """All tokens in order, without descriptions."""
    return F.transform(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), canonical)


def token_type(token: Column) -> Column:
    return F.regexp_extract(token, r"^\[([A-Z_]+)_\d{2,}", 1)


def padded(n: Column, width: int) -> Column:
    """A number with leading zeros; longer numbers stay whole."""
    return F.when(F.length(n.cast("string")) < width, F.lpad(n.cast("string"), width, "0")).otherwise(n.cast("string"))


def make_token(kind: Column, n: Column, width: int = 3) -> Column:
    return F.concat(F.lit("["), kind, F.lit("_"), padded(n, width), F.lit("]"))


def splice(text: Column, spans: Column, shown) -> Column:
    """The text with each span (disjoint, by place) replaced by ``shown(span)``."""

    def pieces(own: Column) -> Column:
        after = lambda i: F.coalesce(F.get(own, i - 1)["end"], F.lit(0))
        parts = F.transform(own, lambda x, i: F.concat(F.substr(text, after(i) + 1, x["start"] - after(i)), shown(x)))
        return F.concat(F.array_join(parts, ""), F.substr(text, after(F.size(own)) + 1, F.length(text)))

    return F.when(F.size(spans) > 0, let(spans, pieces)).otherwise(text)


def _each(text: Column, pattern: str, fix) -> Column:
    """The text with every match of ``pattern`` replaced by ``fix(match)``."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    joined = F.array_join(F.transform(F.sequence(F.lit(1), F.size(found)), lambda k: F.concat(fix(F.element_at(found, k)), F.element_at(gaps, k + 1))), "")
    return F.when(F.size(found) > 0, F.concat(F.element_at(gaps, 1), joined)).otherwise(text)


def repair(output: Column, allowed: Column) -> Column:
    """Mangled tokens restored, where the right one is in ``allowed``; good tokens and unknown ones stay as they are."""

    def fix(found: Column) -> Column:
        kind, n = F.regexp_extract(found, _LOOSE, 1), F.regexp_extract(found, _LOOSE, 2).cast("int")
        out = found
        for width in (2, 3):
            candidate = make_token(kind, n, width)
            out = F.when(F.array_contains(allowed, candidate), candidate).otherwise(out)
        return out

    gaps, good = F.split(output, _TOKEN, -1), F.regexp_extract_all(output, F.lit(_TOKEN), F.lit(0))
    mended = F.transform(gaps, lambda g: _each(g, _LOOSE, fix))
    rest = F.array_join(F.transform(F.sequence(F.lit(1), F.size(good)), lambda k: F.concat(F.element_at(good, k), F.element_at(mended, k + 1))), "")
    return F.when(F.size(good) > 0, F.concat(F.element_at(mended, 1), rest)).otherwise(F.element_at(mended, 1))


def report(source: Column, output: Column) -> Column:
    """What became of the source's tokens: counts of distinct and preserved ones, the missing, the invented, the malformed."""
    given, got = F.array_distinct(tokens(source)), F.array_distinct(tokens(output))
    outside = F.regexp_replace(output, _TOKEN, " ")
    malformed = F.filter(F.regexp_extract_all(outside, F.lit(_LOOSE), F.lit(0)), lambda x: x.rlike("|".join(KINDS)))
    return F.struct(
        F.size(given).cast("long").alias("input_unique"), F.size(F.array_intersect(given, got)).cast("long").alias("preserved_unique"),
        F.array_sort(F.array_except(given, got)).alias("missing"), F.array_sort(F.array_except(got, given)).alias("invented"), malformed.alias("malformed"),
    )

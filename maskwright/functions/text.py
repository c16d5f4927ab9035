"""Scalar functions on surfaces and names: normal forms, keys, sound forms and person comparison.

Built-in expressions wherever Spark has one. Three things it lacks run as Arrow UDFs: Unicode NFKC with case folding, the
matching-blocks similarity ratio, and what is built on these two.
"""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: characters that may stand between the parts of a name or term.
JOINTS = r"[\s・·.\-_]"
#: Romanised family names that are the same name.
FAMILY_GROUPS = (
    ("park", "bak", "pak", "bahk"), ("lee", "yi", "i", "rhee", "rhie"), ("choi", "choe", "chwe", "che"), ("jung", "jeong", "chung", "cheong", "chong"), ("kang", "gang"),
    ("kim", "gim"), ("yoon", "yun"), ("baek", "paek", "paik", "baik"), ("shin", "sin"), ("cho", "jo"),
)
#: Spellings replaced for comparison by sound, in this order.
LOOSE = (("eo", "o"), ("eu", "u"), ("ou", "o"), ("oo", "o"), ("uu", "u"), ("ei", "e"), ("ae", "e"), ("ph", "f"), ("ck", "k"), ("c", "k"))
#: Words that open a term without belonging to it; honorifics after a name; particles after a Korean name.
LEADING_WORDS = ("the", "a", "an", "our", "see", "new", "old", "this", "that")
HONORIFICS = ("ちゃん", "さん", "くん", "様", "さま", "씨", "님")
PARTICLES = ("가", "는", "를", "도", "랑", "한")
UNIT = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+|[^A-Za-z\d]+"


@F.pandas_udf(T.StringType())
def _norm_unicode(surface: pd.Series) -> pd.Series:
    joints = re.compile(JOINTS)
    return surface.map(lambda s: None if s is None else joints.sub("", unicodedata.normalize("NFKC", s).casefold()))


@F.pandas_udf(T.StringType())
def _casefold(surface: pd.Series) -> pd.Series:
    return surface.map(lambda s: None if s is None else s.casefold())


@F.pandas_udf(T.DoubleType())
def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """The matching-blocks ratio of two strings (order-sensitive, not an edit distance)."""
    return pd.Series([None if a is None or b is None else SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right, strict=True)], dtype="float64")


def _plain(surface: Column) -> Column:
    return surface.rlike(r"^[\x00-\x7F]*$")


def norm_ascii(surface: Column) -> Column:
    return F.regexp_replace(F.lower(surface), r"[\s.\-_\x1c-\x1f]", "")


def norm(surface: Column) -> Column:
    """NFKC, case folding and no joints: the form in which spellings are compared. Plain ASCII never leaves the JVM."""
    return F.when(_plain(surface), norm_ascii(surface)).otherwise(_norm_unicode(F.when(~_plain(surface), surface)))


def folded(surface: Column) -> Column:
    """Case folded; plain ASCII never leaves the JVM."""
    return F.when(_plain(surface), F.lower(surface)).otherwise(_casefold(F.when(~_plain(surface), surface)))


def units(surface: Column) -> Column:
    """Parts of a term: cut at joints and where the letter case tells a new word."""
    parts = F.split(F.regexp_replace(surface, r"(?U)^\s+|\s+$", ""), r"(?U)[\s_\-・·.]+")
    return F.filter(F.flatten(F.transform(parts, lambda p: F.regexp_extract_all(p, F.lit("(?U)" + UNIT), F.lit(0)))), lambda u: u != "")


def key(surface: Column) -> Column:
    """One key for all variants of a term: its parts, folded and joined."""
    joined = F.array_join(units(surface), "")
    return F.when(_plain(surface), F.lower(joined)).otherwise(_casefold(F.when(~_plain(surface), joined)))


def is_latin(surface: Column) -> Column:
    return surface.rlike(r"\A[A-Za-z0-9 _\-.]+\z")


def _letters(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z]", "")


def sound(name: Column) -> Column:
    """Lower-case letters with runs of one letter squeezed."""
    return F.regexp_replace(_letters(name), r"(.)\1+", "$1")


def loose(name: Column) -> Column:
    out = _letters(name)
    for old, new in LOOSE:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def family(name: Column) -> Column:
    """The family name's group if it is in the table, else its loose form."""
    aliases = F.create_map(*[F.lit(x) for group in FAMILY_GROUPS for name_ in group for x in (name_, min(group))])
    return F.coalesce(F.element_at(aliases, _letters(name)), loose(name))


def similar(a: Column, b: Column) -> Column:
    return (loose(a) == loose(b)) | (similarity(loose(a), loose(b)) >= 0.8)


def same_family(a: Column, b: Column) -> Column:
    return (family(a) == family(b)) | ((F.least(F.length(loose(a)), F.length(loose(b))) >= 5) & similar(a, b))


def same_person(a_family: Column, a_given: Column, b_family: Column, b_given: Column) -> Column:
    """Two full romanised names of one person, allowing for swapped slots."""
    one = lambda x1, x2: (same_family(x1, b_family) & similar(x2, b_given)) | (same_family(x2, b_given) & similar(x1, b_family))
    return one(a_family, a_given) | one(a_given, a_family)


def split_full_name(family_: Column, given: Column) -> tuple[Column, Column]:
    """A whole two-word name that stands in one slot, dealt to both."""
    words = F.filter(F.split(F.when(family_ != "", family_).otherwise(given), r"(?U)\s+"), lambda w: w != "")
    both = ((family_ == "") | (given == "")) & (F.size(words) == 2)
    return F.when(both, F.element_at(words, 2)).otherwise(family_), F.when(both, F.element_at(words, 1)).otherwise(given)


def clean_surface(surface: Column) -> Column:
    """Without quotes around it and, while more than two words are left, without leading articles."""
    bare = F.regexp_replace(F.regexp_replace(surface, r"(?U)^\s+|\s+$", ""), "^[`*「」『』\"']+|[`*「」『』\"']+$", "")
    lead = "(?i)^(?:" + "|".join(LEADING_WORDS) + ") (?=[^ ]* [^ ]*)"
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(F.split(bare, " ")) - 2, F.lit(1))), bare, lambda acc, _: F.regexp_replace(acc, lead, ""))


def sha16(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def without_honorific(surface: Column, following: Column) -> Column:
    """A name without its honorific, or without the Korean vowel that links it to a particle."""
    out = F.when(surface.endswith("이") & (F.length(surface) >= 3) & following.isin(*PARTICLES), F.substr(surface, F.lit(1), F.length(surface) - 1)).otherwise(surface)
    for h in reversed(HONORIFICS):
        out = F.when(surface.endswith(h) & (F.length(surface) > len(h)), F.substr(surface, F.lit(1), F.length(surface) - len(h))).otherwise(out)
    return out


def rate(part: Column, whole: Column, digits: int = 3) -> Column:
    return F.round(F.when(whole != 0, part / whole).otherwise(0.0), digits)


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 to three digits; 0 where there is nothing to divide by."""
    p, r = F.when(tp + fp != 0, tp / (tp + fp)).otherwise(0.0), F.when(tp + fn != 0, tp / (tp + fn)).otherwise(0.0)
    return F.round(p, 3), F.round(r, 3), F.round(F.when(p + r != 0, 2 * p * r / (p + r)).otherwise(0.0), 3)

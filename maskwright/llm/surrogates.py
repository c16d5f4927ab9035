"""PII surrogates: every detected entity gets a keyed replacement of its own type, gender, script and format.

Detection is one alternation of patterns, each anchored where a token begins and with possessive quantifiers, so a scan is
linear even in a text without a space. Entities (type, value) are reduced to distinct ones before anything else happens: the
sums combine on the map side, and a card number that stands in a third of all documents is one row. A surrogate is a function
of (key, type, value, attempt): digits become digits, letters letters of the same case, separators and country codes stay; a
card that passes the Luhn test gets a surrogate that passes it; IPv4 octets stay octets; a personal name gets names made of
syllables of its script, given names ending by the gender its title tells, each word by itself, so that a surname met with and
without a given name stays one person's.

Collision checks: a candidate that equals another entity's candidate (the smaller value keeps it) or a value that occurs in
the corpus is drawn again with the next attempt, until none is left; so distinct entities keep distinct surrogates, no
surrogate is a real value, and equal entities stay equal across all documents. A format may have fewer strings than the corpus
has entities of it (two syllables of a Han name): after some attempts each further one makes the surrogate longer by a
character, a name's words by two, so there are soon more strings than entities, however many they are.

Coreference: a word of a name that was found by its title or honorific is replaced wherever else it stands by itself in the same
document ("Dr Anna Smith called. Smith said"), by the word that it has become there; where several names of a document share a
word, by that of the first. What remains undetected: names that nowhere in their document have a title or honorific.

Plan, DataFrame functions only: each text is searched once, and entities and gaps are staged. Entities (not texts) meet the
mapping by value, frequent values being dealt among tasks, and go back by row number; a document without an entity meets nobody.

Null text stays null. Empty text: unchanged. Repeated rows are each changed alike. Null doc_id: as any other. Other columns of the
input are kept, whatever their names, by ``pseudonymise``. Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.workspace import hot_join, stage

#: Titles that open a personal name, by the gender they tell.
MALE_TITLES = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña")
NEUTRAL_TITLES = ("Dr", "Prof", "Mx")

_TITLES = "|".join((*MALE_TITLES, *FEMALE_TITLES, *NEUTRAL_TITLES))
#: type and pattern, in order of precedence where two could start at one place.
PATTERNS = (
    ("SECRET", r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}+|xox[baprs]-[A-Za-z0-9-]{10,}+|sk-[A-Za-z0-9_-]{20,}+)(?![A-Za-z0-9])"),
    ("PASSWORD", r"(?<![A-Za-z0-9])(?i:password|passwd|pwd)(?-i)\s?[=:]\s?[^\s\"'&#%$*|,;!]{6,}+"),
    ("TOKEN", r"(?<![A-Za-z0-9])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![A-Za-z0-9])"),
    ("EMAIL", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*(?<=\.[A-Za-z]{2,24})"),
    ("IPV4", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])"),
    ("IBAN", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("CARD", r"(?<![0-9A-Za-z.-])[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9A-Za-z]|[.-][0-9])"),
    ("PHONE", r"(?<![0-9A-Za-z.+-])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9A-Za-z])"),
    ("PHONE", r"(?<![0-9A-Za-z.+-])\([0-9]{2,4}\) ?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])"),
    ("PHONE", r"(?<![0-9A-Za-z.+-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"),
    ("ID", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    ("PERSON", rf"(?<!\p{{L}})(?:{_TITLES})\.?[  ]\p{{Lu}}\p{{Ll}}[\p{{L}}'’-]*+(?![0-9])(?: \p{{Lu}}\p{{Ll}}[\p{{L}}'’-]*+(?![0-9])){{0,2}}"),
    (
        "PERSON",
        r"(?<!\p{IsHan})\p{IsHan}{2,4}(?=さん|氏)|(?<![\p{IsKatakana}ー])\p{IsKatakana}[\p{IsKatakana}ー]{1,7}(?=さん|様|氏)"
        r"|(?<!\p{L})[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]{2,4}(?=さん|様|氏)"
        r"|(?<!\p{L})\p{IsHangul}{2,4}(?=씨| 씨(?:[^\p{IsHangul}]|$|는|가|를|의|와|도|에게))",
    ),
)
#: No text without one of these has an entity. Words are tried where they begin, so a text without any is read once, quickly.
_HINT = r"[0-9@=_さ様氏씨]|(?<![A-Za-z0-9])(?:(?:" + _TITLES + r")\.?[  ]\p{Lu}|(?i:password|passwd|pwd)\s?:|sk-|xox[baprs]-|AKIA)"


def _outer(k: int, pattern: str) -> str:
    return pattern.replace(r"\1", rf"\k<s{k}>").replace("([ -]?)", rf"(?<s{k}>[ -]?)")


#: All patterns begin where a word does; said once in front, most places are passed with one look at the character before.
ANY = "(?<![A-Za-z0-9])(?:" + "|".join(f"(?:{_outer(k, p)})" for k, (_, p) in enumerate(PATTERNS)) + ")"
_VOWELS, _CONSONANTS = "aeiou", "bdfgklmnprstvz"
#: Letters from which names of a script are made: openings, vowels, ending of a male, female and other given name.
_SCRIPTS = {
    "cyrillic": (r"\p{IsCyrillic}", "бвгдзклмнпрст", "аеиоу", "ан", "ия", "ей"),
    "greek": (r"\p{IsGreek}", "βγδζκλμνπρστ", "αειου", "ος", "ια", "ις"),
    "hangul": (r"\p{IsHangul}", "강김나도라마바서", "가나다라마바사아", "호", "희", "수"),
    "kana": (r"[\p{IsHiragana}\p{IsKatakana}]", "アカサタナハマヤ", "イキシチニヒミリ", "オ", "コ", "ミ"),
    "han": (r"\p{IsHan}", "山川田中村松林森", "一本上下野原島井", "男", "子", "美"),
}

_EAST_ASIAN = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"
#: Names are drawn so many times before they become longer.
_NAME_ATTEMPTS = 8


def type_of(found: Column) -> Column:
    """The type of a detected string: that of the first pattern it matches whole, without the look at its neighbours."""
    out = F.lit("PERSON")
    bare = lambda p: "(?s)^(?:" + p + ")$"
    for kind, pattern in reversed(PATTERNS[:-2]):
        out = F.when(found.rlike(bare(pattern)), F.lit(kind)).otherwise(out)
    return out


def _stream(seed: Column, chars: Column) -> Column:
    """Hex digits enough for ``chars`` characters, two for each."""
    blocks = F.sequence(F.lit(0), F.floor(chars / 32).cast("int"))
    return F.array_join(F.transform(blocks, lambda k: F.sha2(F.concat_ws("|", seed, k.cast("string")), 256)), "")


def _byte(stream: Column, k: Column) -> Column:
    return F.conv(F.substring(stream, 2 * k + 1, 2) if isinstance(k, int) else F.substr(stream, 2 * k + 1, F.lit(2)), 16, 10).cast("int")


def _pick(letters: str | Column, n: Column) -> Column:
    if isinstance(letters, str):
        return F.substr(F.lit(letters), F.pmod(n, F.lit(len(letters))) + 1, F.lit(1))
    return F.transform(F.array(letters), lambda x: F.substr(x, F.pmod(n, F.length(x)) + 1, F.lit(1)))[0]


def _like(value: Column, stream: Column, kept: Column, hexadecimal: Column, bare: Column) -> Column:
    """Each character after the first ``kept`` replaced by another of its class, a letter of another script by one of its
    script, if that is known; others stay. In a ``bare`` value, without letter and digit, signs but "@" become letters.
    All arguments are plain columns: what is computed would be computed again for each character."""

    def one(c: Column, i: Column) -> Column:
        n = _byte(stream, i)
        letters = F.when(c.between("0", "9"), F.when(hexadecimal, F.lit("0123456789abcdef")).when((i == kept) & (c != "0"), F.lit("123456789")).otherwise(F.lit("0123456789")))
        letters = letters.when(hexadecimal, F.when(c.between("a", "f"), F.lit("0123456789abcdef"))).when(c.between("a", "z") | (bare & (c != "@")), F.lit("abcdefghijklmnopqrstuvwxyz")).when(c.between("A", "Z"), F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(c <= "\x7f", F.lit(None))
        for pattern, opens, vowels, *_ in _SCRIPTS.values():
            letters = letters.when(c.rlike(pattern), F.lit(opens + vowels))
        letters = letters.when(c.rlike(r"\p{N}"), F.lit("0123456789")).when(c.rlike(r"[\p{L}\p{M}]"), F.lit("abcdefghijklmnopqrstuvwxyz"))
        return F.when(i < kept, c).otherwise(F.coalesce(_pick(letters, n), c))

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits."""
    part = lambda c, i: F.when(F.pmod(i, F.lit(2)) == 0, c).otherwise(F.when(2 * c > 9, 2 * c - 9).otherwise(2 * c))
    terms = F.transform(F.split(F.reverse(digits), ""), lambda c, i: part(c.cast("int"), i))
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x)


def _card(value: Column, drawn: Column) -> Column:
    valid = F.pmod(_luhn(F.regexp_replace(value, "[^0-9]", "")), F.lit(10)) == 0
    head = F.substr(drawn, F.lit(1), F.length(drawn) - 1)
    rest = F.pmod(_luhn(F.concat(F.regexp_replace(head, "[^0-9]", ""), F.lit("0"))), F.lit(10))
    return F.when(valid, F.concat(head, F.pmod(10 - rest, F.lit(10)).cast("string"))).otherwise(drawn)


def _ipv4(stream: Column) -> Column:
    return F.concat_ws(".", *[(1 + F.pmod(_byte(stream, F.lit(k)), F.lit(254))).cast("string") for k in range(4)])


def _character(c: Column, n: Column) -> Column:
    """The n-th letter (n below 65536) of the script of an East Asian character; others stay."""
    code = F.when(c.rlike(r"\p{IsHangul}"), 0xAC00 + 28 * F.pmod(n, F.lit(399))).when(c.rlike(r"\p{IsHan}"), 0x4E00 + F.pmod(n, F.lit(20_902)))
    code = code.when(c.rlike(r"\p{IsKatakana}"), 0x30AB + F.pmod(n, F.lit(72))).when(c.rlike(r"\p{IsHiragana}"), 0x304B + F.pmod(n, F.lit(72)))
    return F.coalesce(F.decode(F.unhex(F.hex(code.cast("long"))), "UTF-16BE"), c)


def _east_asian(word: Column, stream: Column, extra: Column) -> Column:
    """A name of as many characters of the same scripts, and ``extra`` more of the script of the last."""
    letters = F.concat(F.split(word, ""), F.array_repeat(F.substr(word, F.length(word), F.lit(1)), extra))
    return F.array_join(F.transform(letters, lambda c, i: _character(c, F.conv(F.substr(stream, 4 * i + 1, F.lit(4)), 16, 10).cast("int"))), "")


def _name_word(word: Column, gender: Column, given: Column, key: Column, extra: Column) -> Column:
    stream = F.sha2(F.concat_ws("|", key, F.lit("name"), F.lower(word)), 256)
    at = lambda k: _byte(stream, F.lit(k))
    more = _stream(F.concat_ws("|", key, F.lit("more"), F.lower(word)), 2 * extra)
    body = F.concat(*[x for k in (0, 2, 4) for x in (_pick(_CONSONANTS, at(k)), _pick(_VOWELS, at(k + 1)))])
    tail = F.when(~given, _pick("nrst", at(6))).when(gender == "female", F.lit("la")).when(gender == "male", F.lit("lo")).otherwise(F.lit("li"))
    first, second = F.lit(_CONSONANTS), F.lit(_VOWELS)
    for script in ("cyrillic", "greek"):
        pattern, opens, vowels, male, female, other = _SCRIPTS[script]
        here = word.rlike("^" + pattern)
        body = F.when(here, F.concat(*[x for k in (0, 2, 4) for x in (_pick(opens, at(k)), _pick(vowels, at(k + 1)))])).otherwise(body)
        tail = F.when(here, F.when(~given, F.lit("")).when(gender == "male", F.lit(male)).when(gender == "female", F.lit(female)).otherwise(F.lit(other))).otherwise(tail)
        first, second = F.when(here, F.lit(opens)).otherwise(first), F.when(here, F.lit(vowels)).otherwise(second)
    syllables = F.transform(F.array(F.struct(more.alias("more"), first.alias("first"), second.alias("second"))), lambda x: F.array_join(F.transform(F.sequence(F.lit(1), extra), lambda k: F.concat(_pick(x["first"], _byte(x["more"], 2 * k - 2)), _pick(x["second"], _byte(x["more"], 2 * k - 1)))), ""))[0]
    alphabetic = F.initcap(F.concat(body, F.when(extra > 0, syllables).otherwise(""), tail))
    return F.when(word.rlike("^" + _EAST_ASIAN), _east_asian(word, _stream(F.concat_ws("|", key, F.lit("name"), word), 2 * (F.length(word) + extra)), extra)).otherwise(alphabetic)


def title_of(value: Column) -> Column:
    return F.regexp_extract(value, rf"^(?:{_TITLES})\.?[  ]", 0)


def _name_words(value: Column) -> Column:
    """The words of a name without its title."""
    return F.split(F.substr(value, F.length(title_of(value)) + 1, F.length(value)), " ")


def _person(value: Column, key: Column, attempt: Column, extra: Column) -> Column:
    title = title_of(value)
    bare = F.regexp_replace(title, r"[.  ]", "")
    gender = F.when(bare.isin(*MALE_TITLES), "male").when(bare.isin(*FEMALE_TITLES), "female").otherwise("other")
    words = _name_words(value)
    salted = F.when(attempt == 0, key).otherwise(F.concat_ws("|", key, attempt.cast("string")))
    return F.concat(title, F.array_join(F.transform(words, lambda w, i: _name_word(w, gender, i < F.size(words) - 1, salted, extra)), " "))


def candidates(entities: DataFrame, key: str, most_attempts: int) -> DataFrame:
    """value, kind, attempt of entities and the candidate (surrogate): a function of these and the key alone. From
    ``most_attempts`` on (names, whose formats are small: at most _NAME_ATTEMPTS) it is longer with each attempt."""
    keyed, kind, value = F.lit(key), F.col("kind"), F.col("value")
    own_length = F.when(kind == "PERSON", min(_NAME_ATTEMPTS, most_attempts)).otherwise(most_attempts)
    extra = F.col("extra")
    more = lambda c: F.repeat(F.lit(c), extra)
    prefix = F.length(F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[^0-9])|^(?i:password|passwd|pwd)(?-i)\s?[=:]\s?|^AKIA|^gh[pousr]_|^xox[baprs]-|^sk-", 0))
    domain = F.when(kind == "EMAIL", F.regexp_extract(value, r"\.[A-Za-z]+$", 0)).otherwise("")
    shape = F.when(kind == "EMAIL", F.concat(more("a"), F.substr(value, F.lit(1), F.length(value) - F.length("domain")))).when(kind == "IPV4", more("0")).when(kind.isin("PASSWORD", "SECRET"), F.concat(value, more("a"))).otherwise(F.concat(value, more("0")))
    kept = F.when(kind.isin("EMAIL", "CARD", "TOKEN", "IPV4"), 0).when(kind == "IBAN", 2).otherwise(prefix)
    # each step in columns of its own: inlined, the tree would double at every use
    rows = entities.select("value", "kind", "attempt", F.greatest(F.lit(0), F.col("attempt") - own_length + 1).alias("extra"), domain.alias("domain"))
    rows = rows.select("*", shape.alias("shape"), kept.alias("kept"), _stream(F.concat_ws("|", keyed, kind, value, F.col("attempt").cast("string")), F.length(value) + extra).alias("stream"))
    rows = rows.select("*", (~F.substr("shape", F.col("kept") + 1, F.length("shape")).rlike(r"[\p{L}\p{M}\p{N}]")).alias("bare"), (kind == "TOKEN").alias("hexadecimal"), F.when(kind == "IPV4", F.substring("stream", 9, 2**30)).otherwise(F.col("stream")).alias("signs"))
    rows = rows.select("*", F.when(kind != "PERSON", _like(F.col("shape"), F.col("signs"), F.col("kept"), F.col("hexadecimal"), F.col("bare"))).alias("like"))
    ipv4 = F.concat(_ipv4(F.col("stream")), F.when(extra > 0, F.concat(F.lit("."), F.col("like"))).otherwise(""))
    drawn = F.when(kind == "PERSON", _person(value, keyed, F.col("attempt"), extra)).when(kind == "IPV4", ipv4).when(kind == "CARD", _card(value, F.col("like"))).otherwise(F.concat("like", "domain"))
    return rows.select("value", "kind", "attempt", drawn.alias("surrogate"))


def _detected(text: Column) -> Column:
    return F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def entity_table(places: DataFrame) -> DataFrame:
    """value, kind, n_occurrences of every distinct entity of places (value)."""
    return places.groupBy("value").agg(F.count("*").alias("n_occurrences")).select("value", type_of(F.col("value")).alias("kind"), "n_occurrences")


def surrogate_table(entities: DataFrame, key: str, most_attempts: int = 64) -> DataFrame:
    """value, kind, surrogate for distinct entities (value, kind): surrogates differ from each other and from every value.
    Each round settles those without a clash; as candidates become longer, there are free ones for all (see ``candidates``)."""
    open_rows = entities.select("value", "kind").withColumn("attempt", F.lit(0))
    real = entities.select(F.col("value").alias("surrogate"))
    settled: DataFrame | None = None
    while True:
        drawn = stage(candidates(open_rows, key, most_attempts), "candidates")
        if settled is not None:
            real_or_taken = real.unionByName(settled.select("surrogate"))
        else:
            real_or_taken = real
        keeper = drawn.groupBy("surrogate").agg(F.min("value").alias("keeper"))
        taken = real_or_taken.select("surrogate", F.lit(True).alias("taken")).distinct()
        judged = stage(drawn.join(keeper, "surrogate").join(taken, "surrogate", "left").withColumn("ok", (F.col("value") == F.col("keeper")) & F.col("taken").isNull()).drop("keeper", "taken"), "surrogates")
        good = judged.filter("ok").select("value", "kind", "surrogate")
        settled = good if settled is None else settled.unionByName(good)
        open_rows = judged.filter(~F.col("ok")).select("value", "kind", (F.col("attempt") + 1).alias("attempt"))
        if open_rows.isEmpty():
            return settled


def _mention(word: Column) -> Column:
    """A pattern for a word of a name where it stands by itself; a Korean word may have a particle behind it."""
    alone = lambda sign: F.concat(F.lit(f"(?<!{sign})"), word, F.lit(f"(?!{sign})"))
    out = F.when(word.rlike(r"^\p{IsHangul}"), F.concat(F.lit(r"(?<!\p{IsHangul})"), word)).when(word.rlike(r"^\p{IsHan}"), alone(r"\p{IsHan}"))
    return out.when(word.rlike(r"^[\p{IsHiragana}\p{IsKatakana}]"), alone(r"[\p{IsHiragana}\p{IsKatakana}ー]")).otherwise(alone(r"[\p{L}\p{M}\p{N}]"))


def _replaced(text: Column, pattern: Column, words: Column, new: Column) -> Column:
    """``text`` with every match of ``pattern``, one of ``words``, replaced by its partner in ``new``."""
    parts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    both = F.concat(F.element_at(parts, 1), F.array_join(F.transform(found, lambda w, i: F.concat(F.element_at(new, F.array_position(words, w).cast("int")), F.get(parts, i + 1))), ""))
    return F.when(F.rlike(text, pattern), both).otherwise(text)


def pseudonymise(documents: DataFrame, key: str, count_column: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents with text replaced and all columns kept; the table value, kind, surrogate). With ``count_column`` there is one
    more column of that name, the number of entities, unless the input has a column of that name, which then stays as it is."""
    names = documents.columns
    renamed = documents.toDF(*[f"_in_{i}" for i in range(len(names))])
    at = {c: f"_in_{i}" for i, c in enumerate(names)}
    rest = [c for c in renamed.columns if c != at["text"]]
    text = F.col("text")
    looked = renamed.withColumn("text", F.col(at["text"]).cast("string")).withColumn("found", _detected(text)).withColumn("any", F.size("found") > 0)
    # each text is searched once: what is staged holds the entities, and the text or what stands between them
    base = looked.select(*rest, F.when(~F.col("any"), text).alias("text"), F.when(F.col("any"), F.split(text, ANY, -1)).alias("gaps"), "found")
    base = stage(base.withColumn("row", F.monotonically_increasing_id()), "entities")
    with_entities = base.filter(F.col("gaps").isNotNull())
    places = with_entities.select("row", F.posexplode("found").alias("pos", "value"))
    entities = stage(entity_table(places), "entity-values")
    mapping = stage(surrogate_table(entities, key), "mapping")
    known = mapping.join(entities.select("value", "n_occurrences"), "value")
    pairs = hot_join(places, known, "value", "n_occurrences", ["row", "pos"])
    lists = pairs.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "value", "surrogate", "kind"))).alias("new"))
    people = F.filter("new", lambda x: x["kind"] == "PERSON")
    words = lambda field: F.flatten(F.transform("people", lambda x: _name_words(x[field])))
    met = with_entities.join(lists, "row").withColumn("people", people).withColumn("words", words("value")).withColumn("others", words("surrogate"))
    longest_first = F.array_sort(F.transform(F.filter(F.array_distinct("words"), lambda w: F.length(w) > 1), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    met = met.withColumn("mention", F.array_join(F.transform(longest_first, lambda x: _mention(x["w"])), "|"))
    met = met.withColumn("gaps", F.when(F.col("mention") != "", F.transform("gaps", lambda g: _replaced(g, F.col("mention"), F.col("words"), F.col("others")))).otherwise(F.col("gaps")))
    joined = F.concat(F.element_at("gaps", 1), F.array_join(F.transform("new", lambda x, i: F.concat(x["surrogate"], F.get("gaps", i + 1))), ""))
    changed = met.select(*rest, joined.alias(at["text"]), F.size("new").cast("long").alias("count"))
    same = base.filter(F.col("gaps").isNull()).select(*rest, F.col("text").alias(at["text"]), F.lit(0).cast("long").alias("count"))
    more = [F.col("count").alias(count_column)] if count_column and count_column not in names else []
    return changed.unionByName(same).select(*[F.col(at[c]).alias(c) for c in names], *more), mapping

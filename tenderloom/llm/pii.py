"""Personal data replaced by keyed surrogates (operator 5); DataFrame functions only.

Entities are found by one regular expression per kind. A surrogate is the entity under a
keyed permutation that keeps its format: digits stay digits, vowels stay vowels and
consonants stay consonants of the same case and script, separators, titles and the ending of a name (which
carries its gender) stay. Each part of a name has its own surrogate, with or without a title, so the
same surname is the same everywhere; parts found behind a title are replaced wherever the same text
holds them as whole words in the same spelling. The key comes from the caller. Card numbers keep a valid check digit and addresses stay in range.

A permutation never maps two entities of a format to one surrogate, and the same entity has
the same surrogate in all documents. What it can do is hit another entity of the corpus.
That is the collision check: surrogates are looked up among all entities found, and an entity
whose surrogate is one gets a surrogate under another key that is nobody else's either. An entity
of a format that is used up, or whose characters belong to no class, gets an invented value of its
kind that is longer; invented values grow until one is free, so every entity gets a surrogate.
"""

from __future__ import annotations

import secrets
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tenderloom.llm.common import stored

ROUNDS = 4
ATTEMPTS = 32

# The formats that are detected, in order of precedence, and titles.
# No pattern repeats a group without a bound (a matcher recurses per repetition), and a run of characters
# that a pattern starts with is entered at its first one only, so time is linear in the text.
FEMALE = (
    "Mrs", "Ms", "Miss", "Frau", "Fräulein", "Madame", "Mme", "Mademoiselle", "Mlle", "Señora", "Sra", "Señorita", "Srta", "Госпожа", "г-жа",
)
MALE = ("Mr", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Господин", "г-н")
NEUTRAL = ("Dr", "Dra", "Prof", "Professor", "Professorin", "Doctor", "Doktor", "Доктор", "Профессор")
TITLES = (*FEMALE, *MALE, *NEUTRAL)
_TITLE = "(?:" + "|".join(TITLES) + r")(?![\p{L}])\.?"
_WORD = rf"(?!{_TITLE})\p{{Lu}}\p{{Ll}}+(?:-\p{{Lu}}\p{{Ll}}+)?"
_LABEL = r"(?i:token|secret|password|api[_-]?key)\s*+[=:]\s*+[\"']?"
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}+\.){1,9}[A-Za-z]{2,}",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|" + _LABEL + r"(?=[+/_-]*+[A-Za-z0-9])[A-Za-z0-9+/_-]{16,})",
    "phone": r"(?<![\w.])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])"
    # national: 3-3-4 digits, five pairs, or an area code that starts with 0
    r"|(?<![\w.+-])(?:1[ .-])?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![\w-])"
    r"|(?<![\w.+-])0[1-9](?:[ .-][0-9]{2}){4}(?![\w-])"
    r"|(?<![\w.+-])(?:\(0[1-9][0-9]{1,3}\) ?|0[1-9][0-9]{1,3}[ /-])[0-9]{3,4}(?:[ -]?[0-9]{2,4}){1,2}(?![\w-])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "card": r"(?<![\w.-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![\w-])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![\w]|\.[0-9])",
    "name": r"(?<![\p{L}])(?:" + _TITLE + " ){1,4}+" + _WORD + "(?: " + _WORD + "){0,2}",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
PART = r"\A\p{Lu}\p{Ll}+\z"
# Characters of a class replace each other.
CLASSES = (
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ",
    "àáâäèéêëìíîïòóôöùúûü", "çñß", "ÀÁÂÄÈÉÊËÌÍÎÏÒÓÔÖÙÚÛÜ", "ÇÑ",
    "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ",
)
HEX = ("0123456789", "abcdef")


KEY_SETTING = "spark.tenderloom.pii.key"


@lru_cache(maxsize=None)
def _drawn_key(application: str) -> str:
    return secrets.token_hex(32)


def session_key(spark: SparkSession) -> str:
    """The key the cluster sets in ``spark.tenderloom.pii.key``; without one, a random key of this application."""
    return spark.conf.get(KEY_SETTING, None) or _drawn_key(spark.sparkContext.applicationId)


def kind_of(entity: Column) -> Column:
    """The first kind whose pattern the whole entity matches, ``part`` for a word of a name."""
    kind = F.when(entity.rlike(PART), F.lit("part"))
    for name, pattern in reversed(KINDS.items()):
        kind = F.when(entity.rlike(rf"\A(?:{pattern})\z"), F.lit(name)).otherwise(kind)
    return kind


def _tables(classes: tuple[str, ...]) -> tuple[str, str, str]:
    """The classes end to end, and per character where its class starts and how long it is (three digits each)."""
    alphabet = "".join(classes)
    firsts = "".join(f"{alphabet.index(c) + 1:03d}" for c in classes for _ in c)
    sizes = "".join(f"{len(c):03d}" for c in classes for _ in c)
    return alphabet, firsts, sizes


def _shifted(char: Column, by: Column, tables: Column) -> Column:
    """``char`` moved ``by`` places around its class; characters of no class stay."""
    place = F.instr(tables["alphabet"], char)
    first = F.substring(tables["firsts"], place * 3 - 2, F.lit(3)).cast("int")
    size = F.substring(tables["sizes"], place * 3 - 2, F.lit(3)).cast("int")
    moved = F.substring(tables["alphabet"], (first + F.pmod(place - first + by, size)).cast("int"), F.lit(1))
    return F.when((char != "") & (place > 0), moved).otherwise(char)


def _number(key: str, *parts: Column) -> Column:
    """A keyed number below 2^32."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), lambda x: use(x))[0]


def permuted(text: Column, key: str, kind: Column, tables: Column) -> Column:
    """A keyed permutation of all strings of one format.

    Odd and even places take turns: each half is shifted by amounts that depend on the other, which
    can be undone knowing the other half, so no two inputs meet.
    """

    def turned(turn: int, chars: Column) -> Column:
        def seeded(cs: Column) -> Column:
            other = F.array_join(F.filter(cs, lambda c, i: i % 2 == 1 - turn % 2), "")
            return F.struct(cs.alias("chars"), _number(key, kind, F.lit(str(turn)), other).alias("seed"))

        def moved(s: Column) -> Column:
            # the last letter of each part of a name carries its gender
            ending = lambda i: kind.isin("name", "part") & F.coalesce(F.try_element_at(s["chars"], i + 2), F.lit(" ")).isin(" ", "-")
            return F.transform(
                s["chars"],
                lambda c, i: F.when(
                    (i % 2 == turn % 2) & ~ending(i), _shifted(c, F.pmod(F.xxhash64(s["seed"], i), F.lit(1 << 30)), tables)
                ).otherwise(c),
            )

        return _bound(_bound(chars, seeded), moved)

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    for turn in range(ROUNDS):
        chars = turned(turn, chars)
    return F.array_join(chars, "")


def _luhn_sum(digits: Column) -> Column:
    """Sum of the check-digit rule over digits that precede the check digit."""
    places = F.transform(
        F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
        lambda c, i: c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1),
    )
    return F.aggregate(places, F.lit(0), lambda total, d: total + F.when(d > 9, d - 9).otherwise(d))


def _check_digit(old: Column, new: Column, digit: Column) -> Column:
    """The digit at the same distance from the valid one after ``new`` as ``digit`` is after ``old``."""
    old_sum, new_sum = (_luhn_sum(F.regexp_replace(x, "[^0-9]", "")) for x in (old, new))
    return F.pmod(digit.cast("int") + old_sum - new_sum, F.lit(10)).cast("string")


def _ip(entity: Column, key: str) -> Column:
    """Four numbers below 256, by the same alternation as characters."""

    def turned(turn: int):
        def use(parts: Column) -> Column:
            other = F.array_join(F.filter(parts, lambda q, j: j % 2 == 1 - turn % 2).cast("array<string>"), ".")
            return F.transform(
                parts,
                lambda p, i: F.when(
                    i % 2 == turn % 2,
                    F.pmod(p + _number(key, F.lit("ip"), F.lit(str(turn)), i.cast("string"), other), F.lit(256)).cast("int"),
                ).otherwise(p),
            )

        return use

    parts = F.transform(F.split(entity, r"\."), lambda p: p.cast("int"))
    for turn in range(ROUNDS):
        parts = _bound(parts, turned(turn))
    return F.array_join(parts.cast("array<string>"), ".")


# What stays in front of and behind the permuted part, by kind.
HEADS = {"secret": "AKIA|" + _LABEL, "phone": r"\+[0-9]{1,3}|\(?0|1[ .-]", "name": f"(?:{_TITLE} )+"}
TAILS = {"email": r"\.[A-Za-z]{2,}", "card": r"[0-9]"}


def _end(entity: Column, kind: Column, patterns: dict[str, str], form: str) -> Column:
    end = F.lit("")
    for name, pattern in patterns.items():
        end = F.when(kind == name, F.regexp_extract(entity, form.format(pattern), 1)).otherwise(end)
    return end


def surrogate(entity: Column, kind: Column, key: str) -> Column:
    """The keyed replacement of an entity of the given kind."""

    def cut(e: Column) -> Column:
        length = F.length(e["entity"]) - F.length(e["head"]) - F.length(e["tail"])
        middle = F.substring(e["entity"], F.length(e["head"]) + 1, length)
        hexadecimal = (e["kind"] == "secret") & middle.rlike(r"\A[0-9a-f]+\z")
        tables = [F.when(hexadecimal, h).otherwise(w) for h, w in zip(_tables(HEX), _tables(CLASSES))]
        named = F.struct(*[t.alias(n) for t, n in zip(tables, ("alphabet", "firsts", "sizes"))])
        return F.struct(e["kind"].alias("kind"), e["head"].alias("head"), e["tail"].alias("tail"), middle.alias("middle"), named.alias("tables"))

    def joined(e: Column) -> Column:
        new = permuted(e["middle"], key, e["kind"], e["tables"])
        return _bound(new, lambda n: F.concat(e["head"], n, F.when(e["kind"] == "card", _check_digit(e["middle"], n, e["tail"])).otherwise(e["tail"])))

    ends = F.struct(
        entity.alias("entity"),
        kind.alias("kind"),
        _end(entity, kind, HEADS, r"\A({})").alias("head"),
        _end(entity, kind, TAILS, r"({})\z").alias("tail"),
    )
    return F.when(kind == "ip", _ip(entity, key)).otherwise(_bound(_bound(ends, cut), joined))


# Letters for the sixteen digits of a hash, so that syllables of an invented name can be said.
FIRST, SECOND = "bdfghjklmnprstvz", "aeiouaeiouaeioua"


def _syllables(digest: Column, n: int) -> Column:
    pairs = F.transform(
        F.sequence(F.lit(1), F.lit(2 * n - 1), F.lit(2)),
        lambda i: F.concat(
            F.translate(F.substring(digest, i, F.lit(1)), "0123456789abcdef", FIRST),
            F.translate(F.substring(digest, i + 1, F.lit(1)), "0123456789abcdef", SECOND),
        ),
    )
    return F.array_join(pairs, "")


def invented(entity: Column, kind: Column, key: str, attempt: int) -> Column:
    """A keyed value of the entity's kind that does not keep its length; it grows with ``attempt``."""

    def made(e: Column) -> Column:
        digest, head, tail = e["digest"], e["head"], e["tail"]
        digits = F.translate(digest, "abcdef", "012345")
        cut = lambda s, *sizes: [F.substring(s, 1 + sum(sizes[:i]), n) for i, n in enumerate(sizes)]
        word = _syllables(digest, min(32, 3 + attempt))
        ending = F.regexp_extract(e["entity"], r"(\p{Ll})\z", 1)
        number = F.substring(digits, 1, 18)
        long = F.substring(digest, 1, min(64, 32 + attempt))
        return (
            F.when(e["kind"] == "email", F.concat(word, F.lit("@"), F.substring(digest, 1, min(64, 8 + attempt)), tail))
            .when(e["kind"] == "secret", F.concat(head, F.when(head == "AKIA", F.upper(long)).otherwise(long)))
            .when(e["kind"] == "phone", F.concat_ws(" ", head, *cut(digits, 4, 4, 4, 4, 4)))
            .when(e["kind"] == "ssn", F.concat_ws("-", *cut(digits, 3, 2, 4, 12)))
            .when(e["kind"] == "card", F.concat(number, F.pmod(-_luhn_sum(number), F.lit(10)).cast("string")))
            .when(e["kind"] == "ip", F.concat_ws(":", F.lit("2001:db8"), *cut(digest, 4, 4, 4, 4, 4, 4)))
            .otherwise(F.concat(head, F.initcap(word), ending))
        )

    parts = F.struct(
        entity.alias("entity"),
        kind.alias("kind"),
        _end(entity, kind, HEADS, r"\A({})").alias("head"),
        _end(entity, kind, TAILS, r"({})\z").alias("tail"),
        F.sha2(F.concat_ws("\x1f", F.lit(key), kind, entity), 256).alias("digest"),
    )
    return _bound(parts, made)


def _found(text: Column) -> Column:
    """All entities of a text in order. Every format holds a digit, one of ``@ = :``, AKIA, or a title,
    so a text without any of them is not searched further."""
    hint = text.rlike("[0-9@=:]") | F.contains(text, F.lit("AKIA"))
    for title in TITLES:
        hint = hint | F.contains(text, F.lit(title))
    return F.when(hint, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.expr("array()").cast("array<string>"))


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(entity, n): every distinct entity in the table with its number of occurrences."""
    return docs.select(F.explode(_found(F.col(text_col))).alias("entity")).groupBy("entity").agg(F.count("*").alias("n"))


def _name(entity: Column) -> Column:
    return entity.rlike(rf"\A(?:{KINDS['name']})\z")


def _words(entity: Column) -> Column:
    """The parts of a name, without titles."""
    return F.split(F.regexp_replace(entity, rf"\A(?:{_TITLE} )+", ""), "[ -]")


def _units(entities: Column) -> Column:
    """What has a surrogate of its own: the parts of names, other entities whole."""
    return F.array_distinct(F.flatten(F.transform(entities, lambda e: F.when(_name(e), _words(e)).otherwise(F.array(e)))))


def collisions(found: DataFrame, key: str) -> DataFrame:
    """(entity, surrogate) for the entities whose first surrogate is an entity itself.

    They are permuted under further keys, one after the other, until the surrogate is no entity and
    nobody else's surrogate. Under one key no two of them meet, so only earlier ones have to be looked up.
    What is left after ``ATTEMPTS`` keys, or stays itself under three, gets an invented value; of
    entities that meet there one has it and the others go on.
    """
    units = found.select(F.explode(_units(F.array("entity"))).alias("entity")).distinct()
    names = stored(units.select("entity", _of(F.col("entity"), key).alias("surrogate")), "entities")
    entity = names.select(F.col("entity").alias("surrogate"))
    taken = entity.unionByName(names.select("surrogate"))
    hit = names.join(entity, "surrogate", "left_semi").select("entity", "surrogate")
    rigid = F.col("surrogate") == F.col("entity")
    for attempt in (1, 2):
        rigid = rigid & (_of(F.col("entity"), f"{key}#{attempt}") == F.col("entity"))
    clashes = stored(hit.withColumn("_rigid", rigid), "clashes")
    left, last = (clashes.filter(c).select("entity", "surrogate") for c in ("not _rigid", "_rigid"))
    done = left.limit(0)
    for attempt in range(1, ATTEMPTS + 1):
        if left.isEmpty():
            break
        new = left.select("entity", _of(F.col("entity"), f"{key}#{attempt}").alias("surrogate"))
        used = taken.unionByName(done.select("surrogate")).select("surrogate", F.lit(True).alias("_hit"))
        marked = stored(new.join(used.distinct(), "surrogate", "left").select("entity", "surrogate", "_hit"), "clashes")
        done = done.unionByName(marked.filter("_hit is null").select("entity", "surrogate"))
        left = marked.filter("_hit").select("entity", "surrogate")
    left, attempt = left.unionByName(last).select("entity"), 0
    while not left.isEmpty():
        entity = F.col("entity")
        new = left.select("entity", invented(entity, kind_of(entity), f"{key}#invented{attempt}", attempt).alias("surrogate"))
        one = new.groupBy("surrogate").agg(F.min("entity").alias("entity"))
        used = taken.unionByName(done.select("surrogate"))
        free = stored(one.join(used, "surrogate", "left_anti").select("entity", "surrogate"), "clashes")
        done = done.unionByName(free)
        left = stored(left.join(free, "entity", "left_anti"), "clashes")
        attempt += 1
    return done


def _of(entity: Column, key: str) -> Column:
    known = F.struct(entity.alias("entity"), kind_of(entity).alias("kind"))
    return _bound(known, lambda s: surrogate(s["entity"], s["kind"], key))


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in the text and ``n_entities``, the number replaced; all other columns stay.

    Texts are cut at the entities and put together again with surrogates in one projection. Only the
    few surrogates that are entities themselves come from a table: Spark joins it to the rows that
    hold such an entity. Between entities, words that are parts of the text's own names are replaced
    and counted too. A null text stays null with 0 entities. A row is carried as one value, so its columns may have any
    names; a column ``n_entities`` of an earlier run is replaced.
    """
    clash = stored(collisions(entities(docs, text_col), key), "collisions")
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    cut = rows.withColumn("found", _found(F.col("text"))).withColumn("parts", F.when(F.size("found") > 0, F.split("text", PATTERN, -1)))
    if clash.isEmpty():
        return _assembled(cut.withColumn("clash", F.lit(None).cast("map<string,string>")), docs, key, text_col)
    hit = (
        rows.select("text", F.explode(_units(_found(F.col("text")))).alias("entity"))
        .join(clash, "entity")
        .groupBy(F.sha2("text", 256).alias("digest"))
        .agg(F.map_from_entries(F.collect_set(F.struct("entity", "surrogate"))).alias("clash"))  # a text's own entities
    )
    held = stored(hit, "clashes")
    joined = cut.withColumn("digest", F.sha2("text", 256)).join(held, "digest", "left")
    return _assembled(joined, docs, key, text_col)


def _assembled(rows: DataFrame, docs: DataFrame, key: str, text_col: str) -> DataFrame:
    of = lambda e: F.coalesce(F.col("clash")[e], _of(e, key))
    words = F.array_distinct(F.flatten(F.transform(F.filter("found", _name), _words)))
    known = rows.withColumn("units", F.when(F.size("found") > 0, words)).withColumn(
        "renamed", F.map_from_arrays("units", F.transform("units", of))
    )
    # runs of letters and what stands between them, for the texts that hold a name
    cut = lambda s: F.split(s, r"(?<=\p{L})(?!\p{L})|(?<!\p{L})(?=\p{L})")
    own_word = lambda w: w.rlike(PART) & F.array_contains(F.col("units"), w)
    renamed = lambda s: F.array_join(F.transform(cut(s), lambda w: F.when(own_word(w), F.col("renamed")[w]).otherwise(w)), "")
    head = lambda e: F.regexp_extract(e, rf"\A((?:{_TITLE} )+)", 1)
    rest = lambda e: F.regexp_replace(e, rf"\A(?:{_TITLE} )+", "")
    own = F.transform("found", lambda e: F.when(_name(e), F.concat(head(e), renamed(rest(e)))).otherwise(of(e)))
    named = F.size("units") > 0
    between = F.when(named, F.transform("parts", renamed)).otherwise(F.col("parts"))
    bare = F.when(named, F.aggregate("parts", F.lit(0), lambda n, s: n + F.size(F.filter(cut(s), own_word)))).otherwise(0)
    done = known.withColumn("bare", bare)
    pieces = F.zip_with(between, F.concat(own, F.array(F.lit(""))), lambda part, new: F.concat(part, new))
    text = F.when(F.size("found") > 0, F.array_join(pieces, "")).otherwise(F.col("text")).alias(text_col)
    columns = [text if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c != "n_entities"]
    count = F.coalesce(F.greatest(F.size("found"), F.lit(0)), F.lit(0)) + F.col("bare")
    return done.select(*columns, count.alias("n_entities"))

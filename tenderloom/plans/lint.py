"""Rule lint: rules that can never fire or always meet another list (Q5), with the rows they match.

Prefixes are walked as a trie: a prefix is covered by a shorter or equal one on its path. Keyword patterns are compared where they are
plain: words, each with an optional open end, divided by white space; such a pattern is covered by another
one whose words cover a run of its own.

* ``dead``: covered in the same list, or a near-miss rule covered by an inclusion rule. A record that matches it is decided by the other
  rule in every case, though the rule can still add a reason of its own.
* ``conflict``: an exclusion rule and an inclusion rule of which one covers the other, so what the narrower one matches is always both.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from tenderloom.functions.text import combined_text
from tenderloom.operators.staging import computed_once
from tenderloom.rules import RuleSet, code_regex, keyword_regex
from tenderloom.schema import CODE

PREFIX_LISTS = {"include": "include_cpv_prefixes", "exclude": "exclude_cpv_prefixes", "near_miss": "near_miss_cpv_prefixes"}
KEYWORD_LISTS = {"include": "include_keyword_patterns", "exclude": "exclude_keyword_patterns", "near_miss": "near_miss_keyword_patterns"}
COLUMNS = "kind string, subject string, list string, rule string, by_list string, by_rule string"


class Finding(NamedTuple):
    kind: str
    subject: str
    list: str
    rule: str
    by_list: str
    by_rule: str


class PrefixTrie:
    """Prefixes with the lists they stand in."""

    def __init__(self) -> None:
        self.children: dict[str, PrefixTrie] = {}
        self.lists: set[str] = set()

    def put(self, prefix: str, name: str) -> None:
        node = self
        for digit in prefix:
            node = node.children.setdefault(digit, PrefixTrie())
        node.lists.add(name)

    def walk(self, above: tuple[tuple[str, str], ...] = (), prefix: str = "") -> Iterator[tuple[str, str, str, str]]:
        """(list, prefix, list of a prefix on its path, that prefix), equal prefixes of other lists included."""
        own = tuple((name, prefix) for name in sorted(self.lists))
        for name, _ in own:
            for by_name, by in (*above, *own):
                if (by_name, by) != (name, prefix):
                    yield name, prefix, by_name, by
        for digit, child in sorted(self.children.items()):
            yield from child.walk(above + own, prefix + digit)


def _words(pattern: str) -> list[tuple[str, bool]] | None:
    """(word, open end) of a plain pattern, else None."""
    if not (pattern.startswith(r"\b") and pattern.endswith(r"\b")):
        return None
    parts = pattern[2:-2].split(r"\s+")
    if not all(re.fullmatch(r"[0-9a-z]+(?:\\w\*)?", p) for p in parts):
        return None
    return [(p.removesuffix(r"\w*"), p.endswith(r"\w*")) for p in parts]


def covers(wide: str, narrow: str) -> bool:
    """Every text that ``narrow`` matches is one that ``wide`` matches, told from plain patterns."""
    a, b = _words(wide), _words(narrow)
    if a is None or b is None:
        return wide == narrow

    def word(x: tuple[str, bool], y: tuple[str, bool]) -> bool:
        return y[0].startswith(x[0]) if x[1] else x == y

    return any(all(word(x, y) for x, y in zip(a, b[i:])) for i in range(len(b) - len(a) + 1))


def _judged(subject: str, name: str, rule: str, by_name: str, by: str) -> Finding | None:
    pair = {name, by_name}
    if name == by_name or (name == "near_miss" and by_name == "include"):
        return Finding("dead", subject, name, rule, by_name, by)
    return Finding("conflict", subject, name, rule, by_name, by) if pair == {"include", "exclude"} else None


def findings(rules: RuleSet) -> list[Finding]:
    trie, found = PrefixTrie(), []
    for name, attribute in PREFIX_LISTS.items():
        for prefix in getattr(rules, attribute):
            trie.put(prefix, name)
    for name, prefix, by_name, by in trie.walk():
        # equal prefixes of two lists are one conflict, told from the exclusion side
        if not (prefix == by and (name, by_name) == ("include", "exclude")):
            found.append(_judged("code", name, prefix, by_name, by))
    keywords = [(name, p) for name, attribute in KEYWORD_LISTS.items() for p in dict.fromkeys(getattr(rules, attribute))]
    for name, pattern in keywords:
        for by_name, by in keywords:
            same = covers(by, pattern) and covers(pattern, by)
            if (name, pattern) != (by_name, by) and covers(by, pattern) and not (same and (name, by_name) == ("include", "exclude")):
                found.append(_judged("keyword", name, pattern, by_name, by))
    return [f for f in found if f]


def lint(spark: SparkSession, tenders: DataFrame, rules: RuleSet) -> DataFrame:
    """The findings with ``rows``, how many records the rule itself matches: one pass over the records for all of them."""
    found = findings(rules)
    table = spark.createDataFrame(found, COLUMNS)
    asked = sorted({(f.subject, f.rule) for f in found})
    if not asked:
        return table.withColumn("rows", F.lit(0).cast("long"))
    seen = computed_once(tenders.select("id", CODE, *[c for c in tenders.columns if c not in ("id", CODE)]), {"_text": combined_text()}, keep=[CODE])
    counts = []
    for subject, rule in asked:
        hit = F.rlike(F.col(CODE), F.lit(code_regex((rule,)) or r"(?!)")) if subject == "code" else F.rlike(F.col("_text"), F.lit(keyword_regex((rule,))))
        counts.append(F.struct(F.lit(subject).alias("subject"), F.lit(rule).alias("rule"), F.count_if(F.coalesce(hit, F.lit(False))).alias("rows")))
    matched = seen.agg(F.array(*counts).alias("m")).select(F.inline("m"))
    return table.join(F.broadcast(matched), ["subject", "rule"]).select(*[f.split()[0] for f in COLUMNS.split(", ")], "rows")  # a row per rule found

"""Rule lint: what is covered by what, and the rows it matches."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tenderloom.operators.classify import classify
from tenderloom.plans import lint
from tenderloom.rules import DEFAULT_RULES, code_regex
from tenderloom.schema import CODE, TITLE


def test_the_overlaps_of_the_standard_rules_are_found():
    codes = {f[:1] + f[2:] for f in lint.findings(DEFAULT_RULES) if f.subject == "code"}
    assert codes == {
        ("conflict", "exclude", "5031", "include", "5031"), ("conflict", "exclude", "5032", "include", "5032"),
        ("conflict", "include", "50312", "exclude", "5031"), ("dead", "include", "50312", "include", "5031"),
        ("dead", "near_miss", "480", "include", "48"), ("dead", "near_miss", "722", "include", "72"),
    }
    words = {(f.kind, f.rule, f.by_rule) for f in lint.findings(DEFAULT_RULES) if f.subject == "keyword"}
    assert words >= {
        ("dead", r"\bfaqe\s+web\b", r"\bweb\b"), ("dead", r"\bmirembajtje\s+dhe\s+riparim\b", r"\briparim\w*\b"),
        ("dead", r"\bpajisje\w*\s+kompjuter\w*\b", r"\bkompjuter\w*\b"),
    }
    assert not any(rule == by for kind, rule, by in words if kind == "dead")


@pytest.mark.parametrize(
    "wide,narrow,yes",
    [
        (r"\bweb\b", r"\bfaqe\s+web\b", True), (r"\bweb\b", r"\bwebsite\b", False), (r"\bweb\w*\b", r"\bwebsite\b", True),
        (r"\bwebsite\b", r"\bweb\w*\b", False), (r"\bweb\w*\b", r"\bwebs\w*\b", True), (r"\ba\s+b\b", r"\bx\s+a\s+b\s+y\b", True),
        (r"\ba\s+b\b", r"\ba\s+x\s+b\b", False), (r"(?:x)y", r"(?:x)y", True), (r"(?:x)y", r"\bx\b", False), (r"\ba\b", r"\ba\b", True),
    ],
)
def test_covering_of_plain_patterns(wide, narrow, yes):
    assert lint.covers(wide, narrow) is yes


def test_rows_and_dead_near_misses(spark, make_tenders):
    codes = ["48000000-1", "48100000-1", "50312000-1", "30200000-1", "72200000-2; 48000000-3", ""]
    tenders = make_tenders(*[{TITLE: "faqe web" if i % 2 else "asgje", CODE: c} for i, c in enumerate(codes * 3)])
    found = {(r["kind"], r["list"], r["rule"], r["by_list"], r["by_rule"]): r["rows"] for r in lint.lint(spark, tenders, DEFAULT_RULES).collect()}
    assert found[("dead", "near_miss", "480", "include", "48")] == 6 and found[("dead", "near_miss", "722", "include", "72")] == 3
    assert found[("dead", "include", "50312", "include", "5031")] == 3 and found[("dead", "include", r"\bfaqe\s+web\b", "include", r"\bweb\b")] == 9
    # a record that a dead near-miss rule matches is accepted by the rule that covers it
    judged = classify(tenders, DEFAULT_RULES).filter(F.rlike(CODE, F.lit(code_regex(("480", "722")))))
    assert judged.filter("not broad_ok").count() == 0
    clean = replace(DEFAULT_RULES, **{n: () for n in (*lint.PREFIX_LISTS.values(), *lint.KEYWORD_LISTS.values())})
    assert lint.lint(spark, tenders, clean).count() == 0 and "rows" in lint.lint(spark, tenders, clean).columns
    assert {r["rows"] for r in lint.lint(spark, tenders.limit(0), DEFAULT_RULES).collect()} == {0}

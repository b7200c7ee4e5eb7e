from __future__ import annotations

import hashlib
import random
import re
import sys
import unicodedata
from decimal import Decimal

from pyspark.sql import functions as F

from tenderloom.functions import dates, numbers, reasons, text
from tenderloom.rules import DEFAULT_RULES, code_regex, keyword_regex


def plain_norm(value: str) -> str:
    for wrong, right in text.MOJIBAKE_REPAIRS:
        value = value.replace(wrong, right)
    kept = [c for c in unicodedata.normalize("NFKD", value) if unicodedata.combining(c) == 0]
    return re.sub(r"\s+", " ", "".join(kept).lower()).strip()


def test_norm_agrees_on_every_character(values):
    """All assigned characters that Python and the JVM know, in short texts."""
    known = [
        chr(c)
        for c in range(1, sys.maxunicode + 1)
        if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) not in ("Cn", "Co", "Cs") and c != 0xFFFD
    ]
    texts = ["a " + "b".join(known[i : i + 40]) + " C" for i in range(0, len(known), 40)]
    got = values(text.norm, texts)
    different = [(t, g) for t, g in zip(texts, got) if g != plain_norm(t)]
    assert not different, (len(different), [ascii(x) for x in different[0]])


def test_norm_texts(values):
    texts = [
        "MirÃ«mbajtje e softuerit pÃ«r portalin",
        "â€œQuotedâ€\u009d â€“ donâ€™t � stop",
        "Përgatitje  ÇELËS\t\n  ﬁnal ½ ㎏ 한글 ＡＢＣ",
        "",
        "Straße ÅNGSTRÖM naïve Ω İstanbul ΑΣ",
    ]
    assert values(text.norm, texts) == [plain_norm(t) for t in texts]


def test_squeeze_covers_unicode_blanks(values):
    texts = ["  a  b\x1c\x1d c\x85　 ", "\n\t", "x"]
    assert values(text.squeeze, texts) == ["a b c", "", "x"]


def test_source_hash(make_tenders):
    row = {"objekti_procedurave": " A  b ", "autoriteti_kontraktues": "K", "data_publikimit": "1-2-2030", "kodi_cpv_raw": "x"}
    expected = hashlib.sha256("\x1e".join(["A b", "K", "1-2-2030", "", "", "x"]).encode()).hexdigest()
    assert make_tenders(row).select(text.source_hash()).first()[0] == expected


def test_amounts(values):
    cases = {
        "600,000.00 Lekë": "600000.00",
        "1.000.000,00 Lekë": "1000000.00",
        "600,000.00 Lek": "600000.00",
        "1.000.000,00 Lek": "1000000.00",
        "350,000.00 Lekë": "350000.00",
        "600,00 Lekë": "600.00",
        "1.000.000 Lekë": "1000000.00",
        "600.50 Lekë": "600.50",
        "600.000 LEK": "600000.00",
        ".000 Lek": "0.00",
        "600,5 lek": "600.50",
        "600,000 Lek": "600000.00",
        "600. Lek": "600.00",
        ".5 Lek": "0.50",
        "0.125 Lek": "125.00",
        "1.2345 Lek": "1.23",
        "2.0050 Lek": "2.01",
        "1,2,3 Lek": "123.00",
        "1.000,00,00 Lek": "",
        ". Lek": "",
        ", Lek": "",
        "12345678901234567890123456 Lek": "12345678901234567890123456.00",
        "123456789012345678901234567 Lek": "",
        "": "",
        "pa fond": "",
        "rreth 600 Lek": "",
        "600 Euro": "",
    }
    got = values(lambda c: numbers.amount_text(numbers.parse_amount(c)), list(cases))
    assert dict(zip(cases, got)) == cases
    assert values(numbers.parse_amount, ["600.5 Lek"]) == [Decimal("600.50")]


def test_dates(values):
    cases = {"1-2-2031": "2031-02-01", " 01-01-2031 ": "2031-01-01", "31-02-2024": "", "29-2-2024": "2024-02-29", "2024-01-01": "", "1/2/2031": "", "": ""}
    got = values(lambda c: dates.iso_text(dates.parse_local_date(c)), list(cases))
    assert dict(zip(cases, got)) == cases


def test_times(values):
    cases = {"09:45": 585, "Ora 7:05": 425, "14.30": 870, "": None, "no-time": None, "25:01": None, "12:60": None, "8 : 15 dhe 10:00": 495}
    assert dict(zip(cases, values(dates.publication_time, list(cases)))) == cases


def test_publication_timestamp(make_tenders):
    rows = make_tenders(
        {"data_iso": "2031-01-02", "ora_publikimit": "10:15"},
        {"data_publikimit": "3-1-2031"},
        {"data_iso": "broken", "data_publikimit": "4-1-2031", "ora_publikimit": "25:01"},
        {"ora_publikimit": "10:15"},
    )
    got = [r[0] and r[0].isoformat(" ") for r in rows.orderBy("id").select(dates.publication_ts()).collect()]
    assert got == ["2031-01-02 10:15:00", "2031-01-03 00:00:00", "2031-01-04 00:00:00", None]


def test_factored_regexes_find_the_same_words(values):
    words = "software softuer softuerit web website faqe platforma programi it bit mirembajtje te informacionit teknologjise internet digital x ÿ".split()
    rng = random.Random(7)
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", "-", "s", "_"]) for _ in range(30)) for _ in range(200)]
    for patterns in (DEFAULT_RULES.include_keyword_patterns, (r"\bit?\b", r"\bweb\b"), (r"web|\bit\b", r"\bx\b"), (r"\bsoft\w*\b",)):
        found = values(lambda c, p=patterns: F.regexp_extract_all(c, F.lit(keyword_regex(p)), F.lit(0)), texts)
        plain = re.compile("|".join(patterns), re.IGNORECASE)
        assert found == [[m.group(0) for m in plain.finditer(t)] for t in texts]


def test_code_regex(values):
    texts = ["72000000-5; 50312000-5 48219300-9", "172000000-5 7200000-5 72000000-55", "72000000-5x 72000000-5|50320000-4", ""]
    prefixes = ("72", "5031", "50312", "48219300", "999999999")
    got = values(lambda c: F.regexp_extract_all(c, F.lit(code_regex(prefixes)), F.lit(0)), texts)
    every = re.compile(r"\b\d{8}-\d\b")
    assert got == [[m for m in every.findall(t) if any(m[:8].startswith(p) for p in prefixes)] for t in texts]
    assert code_regex(()) is None


def test_ascii_case_folding_only(values):
    got = values(lambda c: text.contains_ignoring_ascii_case(c, "mirË"), ["MIRË x", "mirë", "zmirËz", None])
    assert got == [True, False, True, False]
    literal = values(lambda c: text.contains_ignoring_ascii_case(c, r"a%_\E.b"), [r"xA%_\E.Bx", "a%x.b"])
    assert literal == [True, False]


def test_small_texts(values):
    assert values(lambda c: text.optional_text(c, 3), ["  ", " abcd ", None]) == [None, "abc", None]
    assert values(lambda c: text.ellipsis(c, 5), ["abcdef", "a  b", "abcde"]) == ["abcd…", "a b", "abcde"]
    assert values(lambda c: numbers.score_bucket(c.cast("int")), ["0", "9", "45", "99", "100"]) == [
        "00-09", "00-09", "40-49", "90-99", "100-100",
    ]
    assert values(lambda c: reasons.signal_label(F.lit("n"), c.cast("int")), ["14", "-16"]) == ["n(+14)", "n(-16)"]
    assert values(reasons.list_from_json, [None, "", '["a"]']) == [[], [], ["a"]]
    assert values(reasons.reasons_from_json, [None, '{"broad":["a"]}']) == [{}, {"broad": ["a"]}]
    assert values(reasons.label_is_valid, ["relevant", "x", None]) == [True, False, False]
    assert values(lambda c: reasons.normalized_reasons(F.split(c, ",")), [" b,a,,b"]) == [["a", "b"]]

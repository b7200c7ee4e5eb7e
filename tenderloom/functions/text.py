"""Text functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tenderloom.functions.unicode_tables import (
    HANGUL,
    expanding_class,
    fold_table,
    latin_only_regex,
)
from tenderloom.schema import CODE, FINGERPRINT_COLUMNS, KIND, TITLE

# Unit separator between fingerprint fields.
FIELD_SEPARATOR = "\x1e"

# Wrongly decoded sequences and their repairs, applied in this order.
MOJIBAKE_REPAIRS = (
    ("Ã«", "e"),
    ("Ã§", "c"),
    ("Ã‰", "e"),
    ("â€™", "'"),
    ("â€œ", '"'),
    ("â€\u009d", '"'),
    ("â€“", "-"),
    ("â€”", "-"),
    ("�", ""),
)

# A classification code, eight digits, a dash and a check digit.
CODE_PATTERN = r"(?U)\b\d{8}-\d\b"

# Unicode white space plus the four separators that (?U)\s leaves out.
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def squeeze(col: Column) -> Column:
    """white-space runs become one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), WHITESPACE, " "))


def strip_space(col: Column) -> Column:
    """Trim Unicode white space at both ends, inner runs kept."""
    return F.regexp_replace(F.coalesce(col, F.lit("")), r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def source_hash(columns: tuple[str, ...] = FINGERPRINT_COLUMNS) -> Column:
    """SHA-256 fingerprint of a record."""
    return F.sha2(F.concat_ws(FIELD_SEPARATOR, *[squeeze(F.col(c)) for c in columns]), 256)


def _repair_mojibake(col: Column) -> Column:
    repaired = col
    for wrong, right in MOJIBAKE_REPAIRS:
        repaired = F.replace(repaired, F.lit(wrong), F.lit(right))
    leads = sorted({wrong[0] for wrong, _ in MOJIBAKE_REPAIRS})
    suspicious = F.contains(col, F.lit(leads[0]))
    for lead in leads[1:]:
        suspicious = suspicious | F.contains(col, F.lit(lead))
    return F.when(suspicious, repaired).otherwise(col)


def _expand_hangul(ch: Column) -> Column:
    offset = F.ascii(ch) - F.lit(HANGUL.start)
    lead = F.lit("".join(chr(0x1100 + i) for i in range(19)))
    vowel = F.lit("".join(chr(0x1161 + i) for i in range(21)))
    tail = F.lit("".join(chr(0x11A8 + i) for i in range(27)))

    def pick(table: Column, position: Column) -> Column:
        return F.when(position > 0, F.substring(table, position, 1)).otherwise(F.lit(""))

    return F.concat(
        pick(lead, F.floor(offset / 588).cast("int") + 1),
        pick(vowel, F.floor((offset % 588) / 28).cast("int") + 1),
        pick(tail, (offset % 28).cast("int")),
    )


def _expand_wide(col: Column) -> Column:
    """Replace each character that decomposes into several; only rare texts get here."""
    pairs = "\x02".join(f"{k}\x01{v}" for k, v in fold_table(False).expansions.items())
    table = F.str_to_map(F.lit(pairs), F.lit("\x02"), F.lit("\x01"))
    found = F.array_distinct(F.regexp_extract_all(col, F.lit(expanding_class()), F.lit(0)))

    def apply(acc: Column, ch: Column) -> Column:
        hangul = ch.between(chr(HANGUL.start), chr(HANGUL.stop - 1))
        return F.replace(
            acc,
            ch,
            F.when(hangul, _expand_hangul(ch)).otherwise(F.try_element_at(table, ch)),
        )

    return F.aggregate(found, col, apply)


def _is_ascii(col: Column) -> Column:
    return F.octet_length(col) == F.char_length(col)


def _unfold_wide(col: Column) -> Column:
    """Fold texts with characters outside the Latin table completely; leave the others alone."""
    every = fold_table(False)
    wide = F.translate(_expand_wide(col), every.source, every.target)
    return F.when(_is_ascii(col), col).when(F.rlike(col, F.lit(latin_only_regex())), col).otherwise(wide)


def _fold_latin(col: Column) -> Column:
    """Drop Latin diacritics and case, squeeze white space; plain ASCII skips the table."""
    latin = fold_table(True)
    unaccented = F.when(_is_ascii(col), col).otherwise(F.translate(col, latin.source, latin.target))
    return squeeze(F.lower(unaccented))


# F10 in steps that each look at their input several times: evaluate one step per
# projection (see ``operators.classify``) where texts are long.
NORM_STEPS = (_repair_mojibake, _unfold_wide, _fold_latin)


def norm(col: Column) -> Column:
    """repaired, unaccented, lower-case, white space squeezed."""
    out = F.coalesce(col, F.lit(""))
    for step in NORM_STEPS:
        out = step(out)
    return out


def joined_record_text(title: str = TITLE, code: str = CODE, kind: str = KIND) -> Column:
    """The raw text the keyword rules look at."""
    return F.concat_ws(" ", text_of(title), text_of(code), text_of(kind))


def combined_text(title: str = TITLE, code: str = CODE, kind: str = KIND) -> Column:
    """the normalised text the keyword rules look at."""
    return norm(joined_record_text(title, code, kind))


def parse_cpv_codes(col: Column) -> Column:
    """every classification code in order, duplicates kept."""
    return F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(CODE_PATTERN), F.lit(0))


def contains_ignoring_ascii_case(col: Column, needle: str) -> Column:
    """substring test that folds A-Z only; the needle is literal."""
    quoted = "\\Q" + needle.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.coalesce(F.rlike(col, F.lit("(?i)" + quoted)), F.lit(False))


def optional_text(col: Column, limit: int) -> Column:
    """blank becomes null, otherwise trimmed and cut to ``limit``."""
    return F.substring(F.nullif(strip_space(col), F.lit("")), 1, limit)


def ellipsis(col: Column, limit: int = 96) -> Column:
    """display text of at most ``limit`` characters, the last one an ellipsis when cut."""
    text = squeeze(col)
    cut = F.concat(F.substring(text, 1, limit - 1), F.lit("…"))
    return F.when(F.char_length(text) > limit, cut).otherwise(text)

"""Records from pages of the registry's result layout (X1-X7), with native string functions."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, functions as F

from tenderloom.functions.dates import LOCAL_DATE_PATTERN, iso_text, parse_local_date
from tenderloom.functions.numbers import amount_text, parse_amount
from tenderloom.functions.reasons import LIST_SEPARATOR
from tenderloom.functions.text import FIELD_SEPARATOR, squeeze
from tenderloom.operators.staging import computed_once
from tenderloom.schema import TENDER_COLUMNS

# Labels and markers of the page layout.
TITLE_LABELS = ("Objekti i procedurës së prokurimit:", "Objekti i procedurës së prokurimit :")
HIGHLIGHT = "607D8B"
CONTAINER_ID = "simple-search"
CONTAINER_CLASS = "search-result-container"
BLOCK_CLASSES = ("list-group-item", "list-group-item-result")

_GAP = r"(?:\s|<[^>]*+>|&nbsp;)*+"
PAGE_COUNTER = rf"(?isU)Faqe{_GAP}(\d+){_GAP}nga{_GAP}(\d+)"


def _with_class(*names: str) -> str:
    """Look-aheads inside an opening tag for classes given as whole words."""
    return "".join(rf"(?=[^>]*\bclass\s*=\s*[\"'](?:[^\"']*\s)?{n}[\s\"'])" for n in names)


CONTAINER = rf"(?i)<\w+\b(?=[^>]*\bid\s*=\s*[\"']{CONTAINER_ID}[\"']){_with_class(CONTAINER_CLASS)}[^>]*>"
BLOCK = rf"(?i)<div\b{_with_class(*BLOCK_CLASSES)}[^>]*>"
# one literal in front of all branches, which the matcher looks for before it tries any
UNSHOWN = r"(?is)<(?:(script|style)\b.*?</\1>|!--.*?-->)"
TAGS = r"(?s)<(?:!--.*?-->|[^>]*>)"
REFERENCE = r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z0-9]+);"
INLINE_LIST = rf"(?i)<ul\b{_with_class('list-inline')}[^>]*>"
HEADER = rf"(?i)<div\b{_with_class('list-group-item-header')}[^>]*>"
SPAN = r"(?is)<span\b[^>]*>(.*?)</span>"
HIGHLIGHTED = rf"(?s)<(?i:span)\b(?=[^>]*\b(?i:style)\s*=\s*[\"'][^\"'>]*{HIGHLIGHT})[^>]*>"


def _element(name: str) -> str:
    return rf"(?is)<{name}\b[^>]*>(.*?)</{name}>"


def _after(col: Column, opening: str) -> Column:
    """Text after the first match of ``opening``; null when there is none."""
    return F.try_element_at(F.split(col, opening, 2), F.lit(2))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often ``use`` looks at it."""
    return F.transform(F.array(value), use)[0]


def _tag_steps(text: Column, name: Column) -> Column:
    """Opening and closing tags of one element name in order: whether closing, and lengths of tag and of what precedes it."""
    tag = F.concat(F.lit("(?i)<(?:"), name, F.lit(r"\b[^>]*>|/"), name, F.lit(r"\s*>)"))

    def steps(tags: Column) -> Column:
        return F.zip_with(
            tags,
            F.slice(F.split(text, tag, -1), F.lit(1), F.size(tags)),
            lambda t, p: F.struct(F.startswith(t, F.lit("</")).alias("closing"), F.length(t).alias("tag"), F.length(p).alias("part")),
        )

    return _once(F.regexp_extract_all(text, tag, F.lit(0)), steps)


def _inside(after: Column, name: Column | str) -> Column:
    """Text up to the tag that closes an element whose opening tag stands before ``after``; all of it if none does."""
    name = F.lit(name) if isinstance(name, str) else name

    def walked(text: Column) -> Column:
        def step(at: Column, s: Column) -> Column:
            depth = at["depth"] + F.when(s["closing"], -1).otherwise(1)
            moved = at["end"] + s["part"] + F.when(depth == 0, 0).otherwise(s["tag"])
            return F.when(at["depth"] == 0, at).otherwise(F.struct(depth.alias("depth"), moved.alias("end")))

        start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("end"))
        return F.struct(text.alias("text"), F.aggregate(_tag_steps(text, name), start, step).alias("at"))

    found = F.transform(F.array(after), walked)
    cut = lambda x: F.when(x["at"]["depth"] == 0, F.substring(x["text"], F.lit(1), x["at"]["end"])).otherwise(x["text"])
    return F.transform(found, cut)[0]


def _children(text: Column, name: str) -> Column:
    """Contents of the outermost elements of one name."""

    def step(at: Column, s: Column) -> Column:
        here = at["here"] + s["part"]
        opens = ~s["closing"] & (at["depth"] == 0)
        closes = s["closing"] & (at["depth"] == 1)
        span = F.array(F.struct(at["start"].alias("start"), here.alias("end")))
        return F.struct(
            F.greatest(at["depth"] + F.when(s["closing"], -1).otherwise(1), F.lit(0)).alias("depth"),
            (here + s["tag"]).alias("here"),
            F.when(opens, here + s["tag"]).otherwise(at["start"]).alias("start"),
            F.when(closes, F.concat(at["found"], span)).otherwise(at["found"]).alias("found"),
        )

    start = F.struct(
        F.lit(0).alias("depth"),
        F.lit(0).alias("here"),
        F.lit(0).alias("start"),
        F.expr("cast(array() AS array<struct<start:int,end:int>>)").alias("found"),
    )
    spans = F.aggregate(_tag_steps(text, F.lit(name)), start, step)["found"]
    return F.transform(spans, lambda x: F.substring(text, x["start"] + 1, x["end"] - x["start"]))


def _each_after(text: Column, opening: str, standin: str) -> Column:
    """The text after every match of ``opening``; later matches stand in it as ``standin``."""

    def rests(parts: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: i > 1)
        return F.transform(places, lambda i: F.array_join(F.slice(parts, i, F.size(parts)), standin))

    return _once(F.split(text, opening, -1), rests)


def _decoded(ref: Column) -> Column:
    """The character of a reference such as &euml; or &#235;, the reference itself when unknown."""
    names = "\x02".join(f"{n}\x01{chr(c)}" for n, c in name2codepoint.items())
    table = F.str_to_map(F.lit(names), F.lit("\x02"), F.lit("\x01"))
    body = F.substring(ref, F.lit(2), F.length(ref) - 2)
    digits = F.when(F.rlike(body, F.lit("^#[xX]")), F.conv(F.substr(body, F.lit(3)), 16, 10)).otherwise(
        F.substr(body, F.lit(2))
    )
    code = digits.try_cast("int")
    printable = code.between(0x20, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    by_number = F.when(printable, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    named = F.try_element_at(table, body)
    return F.coalesce(F.when(F.startswith(body, F.lit("#")), by_number).otherwise(named), ref)


def _references(col: Column) -> Column:
    """Distinct character references of a text with what they stand for."""
    every = F.when(F.contains(col, F.lit("&")), F.regexp_extract_all(col, F.lit(REFERENCE), F.lit(0)))
    found = F.array_distinct(F.coalesce(every, F.array().cast("array<string>")))
    return F.transform(found, lambda ref: F.struct(ref.alias("ref"), _decoded(ref).alias("char")))


def _replaced(col: Column, references: Column) -> Column:
    """Replace references; those that give an ampersand come last, so none is read twice."""
    ordered = F.concat(
        F.filter(references, lambda r: r["char"] != "&"),
        F.filter(references, lambda r: r["char"] == "&"),
    )
    return F.aggregate(ordered, col, lambda text, r: F.replace(text, r["ref"], r["char"]))


def unescaped(col: Column) -> Column:
    return F.when(F.contains(col, F.lit("&")), _replaced(col, _references(col))).otherwise(col)


def _stripped(col: Column) -> Column:
    """Fragment without tags and comments, squeezed; references other than blanks stay."""
    return squeeze(F.replace(F.regexp_replace(col, TAGS, ""), F.lit("&nbsp;"), F.lit(" ")))


def html_text(col: Column, gap: str = "") -> Column:
    """Text of a fragment: tags and comments replaced by ``gap``, references decoded, squeezed."""
    return squeeze(unescaped(F.regexp_replace(col, TAGS, gap)))


def _counter_text(html: Column) -> Column:
    """The shown counter of a page, empty when there is none."""
    return F.regexp_extract(F.regexp_replace(html, UNSHOWN, " "), PAGE_COUNTER, 0)


def _counter_numbers(counter: Column) -> tuple[Column, Column]:
    return tuple(F.nullif(F.regexp_extract(counter, PAGE_COUNTER, i), F.lit("")).try_cast("long") for i in (1, 2))


def page_counter(html: Column) -> tuple[Column, Column]:
    """(page number, page total), nulls when the page shows no counter."""
    return _counter_numbers(_counter_text(html))


def blocks(pages: DataFrame, ordinal: str = "page_id", empty_pages: bool = False) -> DataFrame:
    """One row per record block, with its page number and place on the page.

    ``ordinal`` stands in for the page number where a page shows no counter. With
    ``empty_pages`` a page without blocks keeps one row, with neither place nor block.
    """
    number, total = _counter_numbers(F.col("counter"))
    opened = computed_once(
        pages,
        {"counter": _counter_text(F.col("html")), "after": _after(F.col("html"), CONTAINER)},
        keep=list(dict.fromkeys([ordinal, "html"])),
    )
    inside = computed_once(
        opened,
        {
            "page_number": F.coalesce(number, F.col(ordinal).cast("long")),
            "page_total": total,
            "inside": _inside(
                F.col("after"), F.regexp_extract("html", CONTAINER.replace(r"<\w+\b", r"<(\w+)\b", 1), 1)
            ),
        },
        keep=[],
    )
    parts = computed_once(inside, {"parts": F.split("inside", BLOCK)}, keep=["page_number", "page_total"])
    found = F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0)))
    explode = F.posexplode_outer if empty_pages else F.posexplode
    return parts.select("page_number", "page_total", explode(found).alias("row_index", "block"))


# Fields read from labelled list items, besides the date and the codes.
PLAIN_FIELDS = (
    "autoriteti_kontraktues",
    "burimi_financimit",
    "fondi_limit_raw",
    "viti",
    "koha_zhvillimit",
    "tipi_procedures",
    "anulluar",
)
TEXT_FIELDS = ("objekti_procedurave", *PLAIN_FIELDS, "data_publikimit", "ora_publikimit", "kodi_cpv_raw")


def _header_cell(header: Column) -> Column:
    wide, medium = (_after(header, rf"(?i)<\w+\b{_with_class(css)}[^>]*>") for css in ("col-lg-12", "col-md-12"))
    return _inside(F.coalesce(wide, medium, F.lit("")), "div")


def _title(whole: Column) -> Column:
    """The text after the label, else all of it."""
    labelled = F.lit(None).cast("string")
    for label in reversed(TITLE_LABELS):
        at = F.locate(label, whole)
        labelled = F.when(at > 0, F.trim(F.substr(whole, at + len(label)))).otherwise(labelled)
    return F.coalesce(F.nullif(labelled, F.lit("")), whole)


def _label(item: Column) -> Column:
    return F.regexp_replace(F.lower(_stripped(F.regexp_extract(item, _element("b"), 1))), r"[ :]+$", "")


def _field_of(label: Column) -> Column:
    """The field a label names; tests run in this order."""

    def has(*words: str) -> Column:
        out = F.lit(True)
        for word in words:
            out = out & F.contains(label, F.lit(word))
        return out

    return (
        F.when(has("data e publikimit"), "data_publikimit")
        .when(has("kodi cpv"), "kodi_cpv_raw")
        .when(has("autoriteti", "kontraktues"), "autoriteti_kontraktues")
        .when(has("burimi", "financimit"), "burimi_financimit")
        .when(has("fondi limit") | F.startswith(label, F.lit("fondi")), "fondi_limit_raw")
        .when(F.startswith(label, F.lit("viti")), "viti")
        .when(has("koha", "zhvillimit"), "koha_zhvillimit")
        .when(has("tipi", "procedur"), "tipi_procedures")
        .when(has("anulluar"), "anulluar")
    )


def _first_text(items: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(items, lambda t: t != ""), F.lit(1)), F.lit(""))


def _highlighted_value(item: Column) -> Column:
    """First non-empty highlighted span, else the italic text."""
    spans = F.transform(_each_after(item, HIGHLIGHTED, "<span>"), lambda t: _stripped(_inside(t, "span")))
    italic = _stripped(F.regexp_extract(item, _element("i"), 1))
    return F.coalesce(F.nullif(_first_text(spans), F.lit("")), italic)


def _span_texts(fragment: Column) -> Column:
    return F.transform(F.regexp_extract_all(fragment, F.lit(SPAN), F.lit(1)), lambda t: _stripped(t))


def _code_list(item: Column) -> Column:
    """Texts of the spans that are children of the highlighted one, else its own text."""
    inside = _inside(F.coalesce(_after(item, HIGHLIGHTED), F.lit("")), "span")
    texts = F.transform(_children(inside, "span"), lambda t: _stripped(t))
    listed = F.array_join(F.filter(texts, lambda t: t != ""), LIST_SEPARATOR)
    return F.coalesce(F.nullif(listed, F.lit("")), _stripped(inside))


def _date_span(item: Column) -> Column:
    """The first span holding a d-m-yyyy date."""
    dates = F.filter(_span_texts(item), lambda t: F.rlike(t, F.lit(LOCAL_DATE_PATTERN)))
    return F.coalesce(F.try_element_at(dates, F.lit(1)), F.lit(""))


def records(pages: DataFrame, ordinal: str = "page_id", empty_pages: bool = False) -> DataFrame:
    """Tender records of a page corpus. No shuffle: a page is parsed where it is read.

    Each step works on the finished columns of the one before; the references of
    all fields of a record are decoded together. With ``empty_pages`` a page without
    records keeps one row without a row index, so that one pass also tells which
    pages were read.
    """
    place = ["page_number", "row_index"]
    found = blocks(pages, ordinal, empty_pages).select(*place, "block")
    lists = F.array_join(F.transform(_each_after(F.col("block"), INLINE_LIST, "<ul>"), lambda t: _inside(t, "ul")), " ")
    parts = computed_once(
        found,
        {
            "header": F.coalesce(_inside(_after(F.col("block"), HEADER), "div"), F.lit("")),
            "items": F.filter(F.split(lists, r"(?i)<li\b[^>]*>"), lambda i: F.rlike(i, F.lit(r"(?i)<b\b"))),
        },
        keep=place,
    )
    labelled = computed_once(
        parts,
        {
            "title": F.replace(
                F.regexp_replace(_header_cell(F.col("header")), TAGS, " "), F.lit(FIELD_SEPARATOR), F.lit(" ")
            ),
            "labelled": F.transform("items", lambda i: F.struct(_label(i).alias("label"), i.alias("item"))),
        },
        keep=place,
    )
    named = computed_once(
        labelled,
        {"named": F.transform("labelled", lambda i: F.struct(_field_of(i["label"]).alias("field"), i["item"].alias("item")))},
        keep=[*place, "title"],
    )

    def item_of(field: str) -> Column:
        last = F.try_element_at(F.filter("named", lambda i: i["field"] == field), F.lit(-1))
        return F.coalesce(last["item"], F.lit(""))

    items = computed_once(
        named,
        {f: item_of(f) for f in (*PLAIN_FIELDS, "data_publikimit", "kodi_cpv_raw")},
        keep=[*place, "title"],
    )
    values = {
        **{f: _highlighted_value(F.col(f)) for f in PLAIN_FIELDS},
        "objekti_procedurave": F.col("title"),
        "data_publikimit": _date_span(F.col("data_publikimit")),
        "ora_publikimit": _stripped(F.regexp_extract("data_publikimit", _element("small"), 1)),
        "kodi_cpv_raw": _code_list(F.col("kodi_cpv_raw")),
    }
    joined = computed_once(
        items, {"joined": F.concat_ws(FIELD_SEPARATOR, *[values[f] for f in TEXT_FIELDS])}, keep=place
    )
    decoded = computed_once(
        computed_once(joined, {"references": _references(F.col("joined"))}),
        {"fields": F.split(_replaced(F.col("joined"), F.col("references")), FIELD_SEPARATOR)},
        keep=place,
    )
    texts = computed_once(
        decoded, {f: squeeze(F.get("fields", F.lit(i))) for i, f in enumerate(TEXT_FIELDS)}, keep=place
    )
    return texts.withColumns(
        {
            "page_fetched": F.col("page_number").cast("string"),
            "row_index_on_page": F.col("row_index").cast("string"),
            "objekti_procedurave": _title(F.col("objekti_procedurave")),
            "fondi_limit_lek": amount_text(parse_amount(F.col("fondi_limit_raw"))),
            "data_iso": iso_text(parse_local_date(F.col("data_publikimit"))),
            "cpv_spans": F.col("kodi_cpv_raw"),
        }
    ).select(*TENDER_COLUMNS)

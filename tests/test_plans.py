"""Labels, search, reports, exports, sources and page extraction."""

from __future__ import annotations

import csv
import json
from dataclasses import replace
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tenderloom.operators import extract, labels as lab, quality
from tenderloom.operators.classify import classify, classify_many
from tenderloom.operators.statistics import RegistryCounts, changed_rules
from tenderloom.plans import export, reports, search
from tenderloom.rules import DEFAULT_RULES
from tenderloom.schema import CODE, KIND, TENDER_COLUMNS, TITLE
from tenderloom.shared import written
from tenderloom.sources import sinks, tables

SOFT, BUNDLE, NEAR, OTHER = (
    {TITLE: "Zhvillim software për portalin", CODE: "72000000-5"},
    {TITLE: "Zhvillim software dhe riparim printeresh", CODE: "72000000-5; 50312000-5"},
    {TITLE: "Implementim sistemi elektronik"},
    {TITLE: "Blerje materiale pastrimi"},
)


def at(day, hour=0):
    return datetime(2031, 1, day, hour)


@pytest.fixture
def tenders(make_tenders):
    dated = [
        {**SOFT, "data_iso": "2031-01-02", "autoriteti_kontraktues": "Bashkia Tiranë", "row_index_on_page": "2"},
        {**BUNDLE, "data_iso": "2031-01-02", "autoriteti_kontraktues": "Bashkia Durrës", "row_index_on_page": "10"},
        {**NEAR, "data_iso": "2031-01-03", "autoriteti_kontraktues": "Ministria", "koha_zhvillimit": "Prill"},
        {**OTHER, "data_iso": "", "autoriteti_kontraktues": "100%_ministria"},
        {**BUNDLE, "data_iso": "2031-01-02", "autoriteti_kontraktues": 'Me "thonjëza", presje', "row_index_on_page": "1"},
    ]
    return make_tenders(*dated)


@pytest.fixture
def given(spark, tenders):
    """Labels as stored, with snapshots; ids 2 and 3 tie."""
    rows = [(1, 1, "relevant", "Arta", at(1)), (2, 2, "not_relevant", "Beni", at(2)), (3, 2, "maybe", "Arta", at(2)),
            (4, 1, "not_relevant", "Beni", at(3)), (5, 3, "relevant", None, at(1)), (6, 4, "maybe", "Arta", at(5))]
    plain = spark.createDataFrame(rows, "id long, tender_id long, label string, reviewer string, created_at timestamp_ntz")
    frozen = classify(tenders, replace(DEFAULT_RULES, include_cpv_prefixes=()))
    from tenderloom.operators.classify import snapshot

    snaps = frozen.select(F.col("id").alias("tender_id"), snapshot().alias("snapshot"))
    return plain.withColumn("note", F.lit(None).cast("string")).join(snaps, "tender_id")


def ids(df, column="id"):
    return [r[column] for r in df.select(column).collect()]


# --- labels -----------------------------------------------------------------------


def test_latest_labels(given):
    assert sorted(ids(lab.latest_labels(given, "one"))) == [3, 4, 5, 6]
    assert sorted(ids(lab.latest_labels(given, "keep"))) == [2, 3, 4, 5, 6]
    with pytest.raises(ValueError):
        lab.latest_labels(given, "all")


def test_label_listing(given):
    assert ids(lab.label_listing(given, limit=3)) == [6, 4, 3]
    assert ids(lab.label_listing(given, tender_id=1, limit=0)) == [4]


def test_new_labels(spark, tenders):
    requests = spark.createDataFrame(
        [(1, 2, " relevant ", "  Arta ", " "), (2, 99, "maybe", None, None), (3, 1, "yes", "", "x"), (4, 1, "maybe", "", "n" * 2000)],
        "request_id long, tender_id long, label string, reviewer string, note string",
    )
    out = lab.new_labels(requests, tenders, F.lit("2031-01-01").cast("timestamp_ntz"), start=10)
    got = {r["id"]: r for r in out.accepted.collect()}
    assert [(i, r["tender_id"], r["label"], r["reviewer"], r["note"] and len(r["note"])) for i, r in sorted(got.items())] == [
        (11, 2, "relevant", "Arta", None),
        (12, 1, "maybe", None, 1000),
    ]
    assert got[11]["snapshot"]["near_miss_ok"] and got[12]["snapshot"]["strict_ok"]
    assert sorted(tuple(r) for r in out.rejected.collect()) == [(2, 99, "tender_not_found"), (3, 1, "invalid_label")]


def test_snapshot_columns_round_trip(given):
    flat = lab.snapshot_to_columns(given)
    row = flat.filter("id = 2").first()
    assert row["snapshot_strict_ok"] == 0 and isinstance(json.loads(row["snapshot_reasons_json"])["mixed"], list)
    back = {r["id"]: r["snapshot"] for r in lab.snapshot_from_columns(flat).collect()}
    assert back == {r["id"]: r["snapshot"] for r in given.collect()}


# --- search -----------------------------------------------------------------------


def page(result):
    return ids(result.items), tuple(result.totals.first())


def test_search_orders_and_pages(tenders, given):
    assert page(search.search_page(tenders, page_size=2)) == ([3, 5], (5, 3))
    assert page(search.search_page(tenders, page=3, page_size=2)) == ([4], (5, 3))
    assert page(search.search_page(tenders, sort="oldest", page_size=100))[0] == [4, 1, 2, 5, 3]
    assert page(search.search_page(tenders, q="nothing here")) == ([], (0, 1))
    shown = search.search_page(tenders, given).items.orderBy("id").select("id", "latest_label", "latest_reviewer").collect()
    assert [tuple(r) for r in shown] == [
        (1, "not_relevant", "Beni"), (2, "maybe", "Arta"), (3, "relevant", None), (4, "maybe", "Arta"), (5, None, None),
    ]


def test_search_filters(tenders, given):
    def found(**filters):
        return sorted(ids(search.matching(tenders, given, **filters)))

    assert found(q="BASHKIA") == [1, 2] and found(q="72000") == [1, 2, 5] and found(q=" software ") == [1, 2, 5]
    assert found(authority="100%_M") == [4] and found(authority="0_m") == []
    assert found(authority="TIRANË") == [] and found(authority="tiranë") == [1]
    assert found(cpv="5031") == [2, 5] and found(koha_zhvillimit="pril") == [3]
    assert found(reviewer="arta") == [2, 4] and found(reviewer="beni") == [1] and found(reviewer="  ") == [1, 2, 3, 4, 5]
    assert found(q="software", authority="durr") == [2]
    assert found(confidence="high") == [1, 2, 3, 4, 5]
    assert found(software="strict", confidence="low") == [] and found(software="strict", confidence="any") == [1]
    assert search.matching(tenders, None, reviewer="arta").count() == 0


def test_search_by_mode_ranks_by_tier_score_and_date(tenders):
    result = search.search_page(tenders, software="near_miss")
    rows = [(r["id"], r["score"], r["confidence"]) for r in result.items.collect()]
    scores = {r["id"]: r["score"] for r in classify(tenders).collect()}
    assert [r[0] for r in rows] == [5, 2, 3] and all(scores[i] == s for i, s, _ in rows)
    assert page(search.search_page(tenders, software="near_miss", sort="oldest"))[0] == [2, 5, 3]
    assert page(search.search_page(tenders, software="broad"))[1] == (3, 1)


@pytest.mark.parametrize("wrong", [{"page": 0}, {"page_size": 0}, {"page_size": 101}, {"sort": "up"}, {"software": "x"}, {"confidence": "x"}])
def test_search_rejects(tenders, wrong):
    with pytest.raises(ValueError):
        search.search_page(tenders, **wrong)


def test_detail_and_stats(tenders, given):
    detail = search.tender_detail(tenders, given, 2).first()
    assert [e["label_id"] for e in detail["analyst_labels"]] == [3, 2] and detail["broad_ok"] and not detail["strict_ok"]
    assert search.tender_detail(tenders, given, 5).first()["analyst_labels"] is None
    assert search.tender_detail(tenders, given, 77).count() == 0
    assert tuple(search.registry_stats(tenders).first()) == (5, 3, 1, 3)


# --- reports ----------------------------------------------------------------------


def test_quality_report(tenders, given):
    parts = reports.quality_report(given, tenders)
    assert tuple(parts["label_counts"].first()) == (5, 3, 2)
    assert tuple(parts["mode_counts"].first()) == (1, 2, 2)
    metrics = {r["mode"]: tuple(r)[1:] for r in parts["metrics_by_mode"].collect()}
    assert metrics["strict"] == (0, 1, 1, 1, 0.0, 0.0, 0.0)
    assert metrics["near_miss"] == (1, 1, 0, 1, 0.5, 1.0, 0.6667)
    tiers = {r["confidence"]: tuple(r)[1:] for r in parts["confidence_tier_confusions_strict"].collect()}
    assert set(tiers) == {"high", "medium", "low"} and sum(map(sum, tiers.values())) == 3
    assert sum(r["labels"] for r in parts["score_distribution_buckets"].collect()) == 3


def test_quality_of_nothing(tenders, given):
    parts = reports.quality_report(given.filter("false"), tenders)
    assert tuple(parts["label_counts"].first()) == (0, 0, 0)
    assert all(tuple(r)[1:] == (0, 0, 0, 0, 0.0, 0.0, 0.0) for r in parts["metrics_by_mode"].collect())
    assert parts["confidence_tier_confusions_strict"].count() == 3


def test_calibration(tenders, given):
    blind = replace(DEFAULT_RULES, near_miss_keyword_patterns=(r"\bnever\b",))
    out = reports.calibration_report(given, tenders, blind)
    lines = [r["message"] for r in out["regressions"].collect()]
    assert lines == ["near_miss: recall dropped -1.0"]
    assert ids(out["changed_tenders"], "tender_id") == [3]
    same = reports.calibration_report(given, tenders, replace(DEFAULT_RULES, high_threshold=95), reference_thresholds=True)
    assert same["changed_tenders"].count() == 0 and same["regressions"].count() == 0


def test_drift(tenders, given, tmp_path):
    drift = reports.drift_table(given, tenders)
    assert drift.count() == 5
    moved = reports.drift_report(drift, limit=4)
    assert ids(moved, "label_id") == [4, 3, 2]
    assert ids(reports.drift_report(drift, limit=1), "label_id") == []
    assert reports.write_drift_csv(drift, str(tmp_path / "drift")) == 5
    assert read_parts(tmp_path / "drift")[0] == list(reports.DRIFT_COLUMNS)


def test_validation_and_samples(tenders):
    report = reports.validation_report(tenders)
    assert tuple(report["counts"].first()) == (5, 3, 1, 2, 3, 2, 0)
    assert ids(report["sample_excluded_titles"]) == [2, 5]


def test_maintained_counts_equal_a_recount(spark, make_tenders, tmp_path):
    titles = ["software i ri", "riparim kompjuter", "sistem elektronik", "rrjet", "software dhe riparim", "ndertim rruge", ""]
    rows = make_tenders(*[{TITLE: titles[i % 7], CODE: ["48000000-1", "50310000-1", "30200000-1", "45000000-1"][i % 4]} for i in range(90)])
    counts = RegistryCounts(spark, str(tmp_path / "counts"))
    assert tuple(counts.current().first()) == (0, 0, 0, 0)
    for number in range(3):
        counts.add(rows.filter(F.col("id") % 3 == number), DEFAULT_RULES, f"batch-{number}")
    counts.add(rows.filter("id % 3 = 1"), DEFAULT_RULES, "batch-1")  # a repeated batch
    assert counts.current().first() == search.registry_stats(rows, DEFAULT_RULES).first()
    steps = [
        replace(DEFAULT_RULES, include_keyword_patterns=(r"\bsoftware\b", r"\brruge\b"), near_miss_cpv_prefixes=("45",)),
        replace(DEFAULT_RULES, exclude_keyword_patterns=(r"\briparim\b",), exclude_cpv_prefixes=("48",)),
        replace(DEFAULT_RULES, near_miss_keyword_patterns=()),
        DEFAULT_RULES,
    ]
    before = DEFAULT_RULES
    for number, rules in enumerate(steps):
        counts.change_rules(rows, before, rules, f"rules-{number}")
        assert counts.current().first() == search.registry_stats(rows, rules).first()
        before = rules
    assert changed_rules(DEFAULT_RULES, steps[2]) is None
    untouched = changed_rules(DEFAULT_RULES, DEFAULT_RULES)
    assert classify(rows, untouched).filter("broad_ok").count() == 0


def test_diff_by_blocks_equals_the_whole_join(spark, make_tenders):
    titles = ["sistem informatik", "software", "mirembajtje", "kompjuter", "laborator"]
    rows = make_tenders(*[{TITLE: f"{titles[i % 5]} {i}", "kodi_cpv_raw": f"48{i:06d}-1"} for i in range(300)])
    left = written(classify(rows).filter("id <> 77"), "left")
    other = replace(DEFAULT_RULES, include_keyword_patterns=(r"\bkompjuter\b",))
    changed = classify_many(rows.filter("id % 50 = 0"), {"": other})
    right = written(classify(rows).filter("id % 50 <> 0 and id <> 3").select("id", *quality.DIFF_KEYS).unionByName(changed.select("id", *quality.DIFF_KEYS)), "right")
    want = {tuple(r) for r in quality.row_diff(left, right, "id").collect()}
    assert {(r[0], r[1]) for r in want} >= {(77, "present"), (3, "present")}
    for leaves in (1, 7, 1 << 16):
        sums = tuple(quality.block_checksums(t, "id", leaves) for t in (left, right))
        for given in (None, sums):
            assert {tuple(r) for r in quality.result_diff(left, right, "id", leaves, given).collect()} == want
    found = quality.differing_leaves(*(quality.block_checksums(t, "id") for t in (left, right))).count()
    assert found == len({r[0] for r in want})
    twice = left.unionByName(left.filter("id = 5"))
    assert quality.differing_leaves(*(quality.block_checksums(t, "id") for t in (left, twice))).count() == 1
    assert quality.result_diff(left, left.orderBy("id"), "id").count() == 0
    assert quality.result_diff(left.limit(0), right.limit(0), "id").count() == 0


def test_result_diff(tenders):
    left = classify(tenders)
    right = classify(tenders.filter("id <> 4"), replace(DEFAULT_RULES, near_miss_keyword_patterns=(r"\bnever\b",)))
    assert quality.result_diff(left, left, "id").count() == 0
    fields = {(r["id"], r["field"]) for r in quality.result_diff(left, right, "id").collect()}
    assert (4, "present") in fields and (3, "near_miss_ok") in fields and not any(i in (1, 2, 5) for i, _ in fields)


def test_crawl_and_run_rows(tenders, given):
    qc = reports.crawl_qc(tenders.withColumn("page_fetched", F.lit("3")), "2031").first()
    assert (qc["row_count_raw"], qc["last_page_number"], qc["target_year"]) == (5, 3, "2031")


# --- exports and sources ----------------------------------------------------------


def read_parts(path: Path):
    header, rows = None, []
    for part in sorted(path.glob("part-*.csv")):
        with part.open(encoding="utf-8-sig", newline="") as handle:
            found = list(csv.reader(handle))
        header = found[0] if found else header
        rows += found[1:]
    return header, rows


def test_export_all(tenders, tmp_path):
    counts = export.export_all(tenders, str(tmp_path), "2031")
    assert counts == {
        "canonical": 5, "software_broad": 3, "software_strict": 1, "software_qc": 5,
        "software_strict_qc": 2, "software_near_miss": 2, "software_review_queue": 2,
    }
    header, rows = read_parts(tmp_path / "registry_2031.csv")
    assert header == list(TENDER_COLUMNS)
    assert [r[0] for r in rows] == [OTHER[TITLE], SOFT[TITLE], BUNDLE[TITLE], BUNDLE[TITLE], NEAR[TITLE]]
    header, rows = read_parts(tmp_path / "registry_2031_software_review_queue.csv")
    assert header == [*TENDER_COLUMNS, *export.MATCH_COLUMNS]
    assert [r[header.index("row_index_on_page")] for r in rows] == ["1", "10"]
    header, rows = read_parts(tmp_path / "registry_2031_software_qc.csv")
    assert header == list(export.QC_COLUMNS) and [r[2] == "excluded" for r in rows] == [False, False, True, False, True]
    assert rows[2][3].startswith("mixed_it_bundle | kw:")
    first = next((tmp_path / "registry_2031.csv").glob("part-*.csv")).read_bytes()
    assert first.startswith(b"\xef\xbb\xbf")


def test_export_counts_and_near_scope(tenders):
    classified = classify(tenders)
    assert tuple(export.export_counts(classified).first()) == (5, 3, 1, 2, 2, 5)
    assert sorted(ids(export.near_miss_rows(classified, "all"))) == [2, 3, 5]


def test_csv_round_trip(spark, make_tenders, tmp_path):
    texts = ['a "quoted", text', "two\nlines", "  blanks kept  ", "", "back\\slash"]
    df = make_tenders(*[{TITLE: t, "data_iso": f"2031-01-0{i + 1}"} for i, t in enumerate(texts)])
    assert sinks.write_tenders_csv(df, str(tmp_path / "t")) == 5
    back = tables.read_tenders_csv(spark, str(tmp_path / "t"))
    assert back.columns == list(TENDER_COLUMNS)
    assert [r[TITLE] for r in back.orderBy("data_iso").collect()] == texts


def test_csv_source_shape(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("\ufeffobjekti_procedurave,extra,viti\nA,x,2031\nB,,\n", encoding="utf-8")
    rows = tables.read_tenders_csv(spark, str(path)).orderBy(TITLE).collect()
    assert [(r[TITLE], r["viti"], r["anulluar"]) for r in rows] == [("A", "2031", ""), ("B", "", "")]


def test_legacy_export(tenders, tmp_path):
    assert export.export_legacy(tenders.select(*TENDER_COLUMNS), str(tmp_path), "2031") == {
        "broad": 3, "strict": 1, "qc": 5, "strict_qc": 2,
    }
    header, rows = read_parts(tmp_path / "registry_2031_software_strict_qc.csv")
    assert rows[0][3] == "exclude_kw:riparim | exclude_kw:printeresh | exclude_cpv:50312000-5"
    header, rows = read_parts(tmp_path / "registry_2031_software.csv")
    assert rows[0][header.index("software_match_score")] == "4"


def test_vectors_and_json_report(spark, tmp_path):
    path = tmp_path / "v.json"
    path.write_text(json.dumps([{"name": "a", "record": {TITLE: "web", CODE: ""}}, {"name": "b", "record": {KIND: "x"}}]))
    rows = classify(tables.read_vectors(spark, str(path))).orderBy("name").collect()
    assert [(r["name"], r["broad_ok"]) for r in rows] == [("a", True), ("b", False)]
    sinks.write_report(spark.createDataFrame([(1, [2])], "a int, b array<int>"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


# --- page extraction --------------------------------------------------------------

PAGE = """<html><head><script>var x = "Faqe 8 nga 8";</script></head><body>
<div class="paging">FAQE&nbsp;<b>3</b> nga <i> 12 </i></div>
<div class="list-group-item list-group-item-result"><div class="list-group-item-header"><div class="col-lg-12">outside</div></div></div>
<div id='simple-search' class='row search-result-container'>
<div class="list-group-item list-group-item-result other">
  <div class="list-group-item-header"><div class="row"><div class="col-md-12">medium</div><div class="col-lg-12"><b>Objekti i procedur&euml;s s&#235; prokurimit :</b>
   Zhvillim <i>software</i> &amp;lt;&lt;web&gt; &amp; &#x1F600;</div></div></div>
  <ul class="list-inline"><li><b>Autoriteti Kontraktues :</b> <span style="color:#607D8B"> </span><span style="color:#607D8B">Bashkia &quot;Tiran&euml;&quot;</span></li>
  <li><b>Burimi i Financimit:</b> <i>Buxheti</i></li><li>no label</li>
  <li><b>Fondi limit</b> <span style="font-weight:bold;color:#607D8B">1.000.000,50 Lek&euml;</span></li></ul>
  <ul class="x list-inline"><li><b>Data e Publikimit:</b> <span>x</span><span>1-2-2031</span> <small> Ora 7:05 </small></li>
  <li><b>Kodi CPV</b> <span style="color:#607D8B"><span>72000000-5</span><span> </span><span>50312000-5 - Repair</span></span></li>
  <li><b>Viti:</b> <span style="color:#607D8B">2031</span></li><li><b>Koha e zhvillimit:</b> <span style="color:#607D8B">Prill</span></li>
  <li><b>Tipi i Procedur&euml;s</b> <span style="color:#607D8B">E hapur</span></li><li><b>Anulluar</b> <span style="color:#607D8B">Po</span></li></ul>
</div>
<div class="list-group-item list-group-item-result"><div class="list-group-item-header"><div class="col-md-12"> Vet&euml;m titull </div></div>
  <ul class="list-inline"><li><b>Kodi CPV</b> <span style="color:#607D8B">48000000-8</span></li><li><b>Data e publikimit</b><span>31-2-2031</span></li></ul></div>
</div></body></html>"""


def test_page_records(spark):
    pages = spark.createDataFrame([(7, "", PAGE), (8, "", "<html>nothing</html>"), (9, "", PAGE.replace("nga", "-"))], "page_id long, url string, html string")
    rows = {(r["page_fetched"], r["row_index_on_page"]): r for r in extract.records(pages).collect()}
    assert set(rows) == {("3", "0"), ("3", "1"), ("9", "0"), ("9", "1")}
    first, second = rows["3", "0"], rows["3", "1"]
    assert {c: first[c] for c in TENDER_COLUMNS if c not in ("page_fetched", "row_index_on_page")} == {
        TITLE: "Zhvillim software &lt;<web> & \U0001f600",
        "autoriteti_kontraktues": 'Bashkia "Tiranë"',
        "burimi_financimit": "Buxheti",
        "fondi_limit_raw": "1.000.000,50 Lekë",
        "fondi_limit_lek": "1000000.50",
        "data_publikimit": "1-2-2031",
        "ora_publikimit": "Ora 7:05",
        "data_iso": "2031-02-01",
        "viti": "2031",
        "koha_zhvillimit": "Prill",
        CODE: "72000000-5 | 50312000-5 - Repair",
        "cpv_spans": "72000000-5 | 50312000-5 - Repair",
        KIND: "E hapur",
        "anulluar": "Po",
    }
    assert (second[TITLE], second[CODE], second["data_publikimit"], second["data_iso"]) == ("Vetëm titull", "48000000-8", "31-2-2031", "")


def test_page_counter(values):
    counters = values(lambda c: F.array(*extract.page_counter(c)), ["<p>faqe <b>2</b>nga&nbsp;30</p>", "Faqe x nga 3", ""])
    assert counters == [[2, 30], [None, None], [None, None]]


NESTED = """<div id="simple-search" class="x search-result-container"><div>
<div class="list-group-item list-group-item-result"><div class="list-group-item-header"><div class="col-lg-12">
<b>Objekti i procedurës së prokurimit:</b> <div>Part one</div> part two</div></div>
<ul class="list-inline"><li><b>Autoriteti Kontraktues</b> <span style="color:#607D8B">Bashkia <span>e <span>re</span></span> Tiranes</span></li>
<li><b>Viti</b> <span style="color:#607D8B"><ul><li>no label</li></ul>2031</span></li>
<li><b>Kodi CPV</b> <span style="color:#607D8B"><span>72<span>000000</span></span><span>48</span></span> <span>aside</span></li></ul></div>
</div></div><div class="list-group-item list-group-item-result"><div class="list-group-item-header">outside</div></div>"""


def test_nested_elements_stay_whole(spark):
    pages = spark.createDataFrame([(3_000_000_000, "", NESTED)], "page_id long, url string, html string")
    (row,) = extract.records(pages).collect()
    assert row["objekti_procedurave"] == "Part one part two"
    assert row["autoriteti_kontraktues"] == "Bashkia e re Tiranes"
    assert row["kodi_cpv_raw"] == "72000000 | 48"
    assert row["page_fetched"] == "3000000000"


def test_sinks_replace_an_earlier_run(spark, tenders, tmp_path):
    for limit in (5, 2):
        sinks.write_tenders_csv(tenders.limit(limit), str(tmp_path / "csv"))
        sinks.write_report(tenders.limit(limit), str(tmp_path / "json"))
    assert tables.read_tenders_csv(spark, str(tmp_path / "csv")).count() == 2
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_page_texts_are_searched_once(spark):
    """Each expression over a page's text stands in the plan once, because generators evaluate every mention of it."""

    def plan(column):
        rows = spark.createDataFrame([("x",)], "html string").select(column.alias("out"))
        return rows._jdf.queryExecution().analyzed().toString()

    steps = plan(extract._tag_steps(F.col("html"), F.lit("div")))
    assert (steps.count("regexp_extract_all("), steps.count("split(")) == (1, 1)
    assert plan(extract._each_after(F.col("html"), "<ul>", "<ul>")).count("split(") == 1
    pages = spark.createDataFrame([(7, PAGE)], "page_id long, html string")
    assert extract.blocks(pages)._jdf.queryExecution().analyzed().toString().count("regexp_replace(") == 1

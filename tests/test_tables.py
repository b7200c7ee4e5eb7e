"""Ordering, de-duplication, merging, the store, ingest and streaming."""

from __future__ import annotations

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tenderloom.operators import dedupe, ordering, store as store_module, windows
from tenderloom.operators.store import ConcurrentBatchError, TenderStore
from tenderloom.plans.ingest import run_ingest
from tenderloom.schema import PAGE_SCHEMA, TENDER_COLUMNS, TITLE
from tenderloom.streaming.daily import daily_stream, load_stream, stored_mark
from tenderloom.streaming.ingest import upsert_stream, without_repeats
from tenderloom.streaming.labels import label_stream, stored_labels, stored_rejects

T1, T2, T3 = datetime(2031, 1, 1), datetime(2031, 1, 2), datetime(2031, 1, 3)


def stamp(t):
    return F.lit(t.isoformat(" ")).cast("timestamp_ntz")


def test_numbering_with_one_hot_key(spark):
    rng = random.Random(3)
    rows = [(7 if i % 3 == 0 else rng.randint(0, 50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, i int").repartition(5)
    got = ordering.number_rows(df, [F.desc("k"), F.asc("i")], "nr", start=10).collect()
    want = {pair: 11 + n for n, pair in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])))}
    assert {(r["k"], r["i"]): r["nr"] for r in got} == want


def test_running_totals_across_blocks(spark):
    rng = random.Random(4)
    spread = [rng.randrange(2**rng.randrange(20, 63)) for _ in range(300)]
    keys = sorted({*rng.sample(range(0, 3 * ordering.BLOCK), 500), 20_000_000, 2**31 - 1, 2**62, 2**62 - 1, *spread})
    for some in (keys, keys[:400], [0], []):
        df = spark.createDataFrame([(k, k % 5) for k in some], "k long, v int").repartition(4)
        got = {r["k"]: (r["n"], r["s"]) for r in ordering.running_totals(df, "k", {"n": F.lit(1), "s": F.col("v")}).collect()}
        total = 0
        assert len(got) == len(some)
        for n, k in enumerate(some, 1):
            total += k % 5
            assert got[k] == (n, total)


def test_numbering_evaluates_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(1000).mapInArrow(count, "id long")
    assert ordering.number_rows(df, [F.desc("id")], "nr").filter("nr = 1").first()["id"] == 999
    assert seen.value == 1000


def test_pages_of_any_depth_equal_a_sorted_list(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 7).repartition(5)
    order = [F.desc("k"), F.asc("id")]
    want = [r["id"] for r in sorted(df.collect(), key=lambda r: (-r["k"], r["id"]))]
    pages = ordering.SortedPages(df, order)
    assert pages.total() == 1000
    for page in (1, 2, 9, 17, 33, 34, 35):
        rows = sorted(pages.page(page, 30).collect(), key=lambda r: r["_row"])
        assert [r["id"] for r in rows] == want[(page - 1) * 30 : page * 30]
        assert [r["_row"] for r in rows] == list(range((page - 1) * 30 + 1, min(page * 30, 1000) + 1))[: len(rows)]
        assert page > 9 or [r["id"] for r in ordering.page_slice(df, order, page, 30).collect()] == want[(page - 1) * 30 : page * 30]
    assert ordering.SortedPages(df.limit(0), order).page(1, 30).count() == 0


def test_a_deep_page_reads_one_or_two_files_and_few_rows(spark):
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pages = ordering.SortedPages(spark.range(200_000).withColumn("r", F.xxhash64("id")), [F.asc("r")])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert pages.index.count() == 16
    page = pages.page(7777, 25)
    assert len(page.inputFiles()) in (1, 2)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "TakeOrdered" not in plan and "GreaterThanOrEqual(_pos" in plan
    first = page.agg(F.min("_row"), F.max("_row"), F.count("*")).first()
    assert tuple(first) == (7776 * 25 + 1, 7777 * 25, 25)


def sample(title, page=1, row=0, **more):
    return {TITLE: title, "page_fetched": str(page), "row_index_on_page": str(row), **more}


def test_first_row_wins_whatever_the_order(make_tenders):
    rows = [sample("a", 2, 0, anulluar="late"), sample("a", 1, 10, anulluar="tenth"), sample("a", 1, 9, anulluar="first"), sample("b", 3, 0)]
    for shuffled in (rows, rows[::-1]):
        kept = dedupe.first_wins(make_tenders(*shuffled, ids=False))
        assert sorted((r[TITLE], r["anulluar"]) for r in kept.collect()) == [("a", "first"), ("b", "")]


def test_duplicate_counts(make_tenders):
    df = make_tenders(sample("a"), sample("a", 2), sample("  ", 3), sample("b", 4))
    assert tuple(dedupe.duplicate_counts(df).first()) == (3, 4, 1, 1)


def table_of(df):
    return {r[TITLE]: (r["id"], r["first_seen_at"], r["last_seen_at"], r["anulluar"]) for r in df.collect()}


def test_merge_is_first_wins_and_replayable(make_tenders):
    base = dedupe.first_load(make_tenders(sample("a", 1), sample("b", 2), ids=False), stamp(T1))
    batch = make_tenders(sample("b", 1, 0, anulluar="changed"), sample("d", 2, 1), sample("c", 2, 0), sample("c", 9), ids=False)
    once = table_of(dedupe.merge(base, batch, stamp(T2)))
    assert once == {"a": (1, T1, T1, ""), "b": (2, T1, T2, ""), "c": (3, T2, T2, ""), "d": (4, T2, T2, "")}
    again = table_of(dedupe.merge(dedupe.merge(base, batch, stamp(T2)), batch, stamp(T3)))
    assert again == {k: (i, f, T1 if k == "a" else T3, a) for k, (i, f, _, a) in once.items()}
    assert tuple(dedupe.merge_counts(base, batch).first()) == (2, 2)


def test_second_of_two_writers_fails_and_can_append_again(spark, make_tenders, tmp_path):
    one, two = (TenderStore(spark, str(tmp_path / "store")) for _ in range(2))
    first, second = make_tenders(sample("a"), sample("b"), ids=False), make_tenders(sample("b"), sample("c"), ids=False)
    publish = two._publish

    def overtaken(batch_id, attempt):
        two._publish = publish
        one.append(first, T1)
        publish(batch_id, attempt)

    two._publish = overtaken
    with pytest.raises(ConcurrentBatchError):
        two.append(second, T2)
    assert set(table_of(one.tenders())) == {"a", "b"}
    run = two.append(second, T2)
    assert (run["batch_id"], run["rows_inserted"], run["duplicates_skipped"]) == (1, 1, 1)
    assert set(table_of(one.tenders())) == {"a", "b", "c"}
    assert sorted(r.id for r in one.tenders().select("id").collect()) == [1, 2, 3]


class FailingStore(TenderStore):
    """Fails once, right before or after a step of its first batch."""

    def __init__(self, spark, path, step):
        super().__init__(spark, path)
        self.step = step

    def _fail_at(self, step):
        if self.step == step:
            self.step = None
            raise RuntimeError("injected")

    def _write(self, df, part, batch_id, attempt, *by):
        super()._write(df, part, batch_id, attempt, *by)
        self._fail_at(part)

    def _publish(self, folder, name, attempt):
        self._fail_at("publish")
        super()._publish(folder, name, attempt)
        self._fail_at("after")


def test_store_equals_merge_and_hides_unfinished_batches(spark, make_tenders, tmp_path):
    store = TenderStore(spark, str(tmp_path / "store"))
    assert store.tenders().count() == 0
    first, second = make_tenders(sample("a", 1), sample("b", 2), ids=False), make_tenders(sample("b"), sample("c", 2), ids=False)
    run = store.append(first, T1, target_year="2031")
    assert (run["rows_inserted"], run["duplicates_skipped"]) == (2, 0)

    class Lost(RuntimeError):
        pass

    broken = TenderStore(spark, store.path)
    write = broken._write

    def fail_on_runs(df, part, batch_id, attempt, *by):
        if part == "runs":
            raise Lost
        write(df, part, batch_id, attempt, *by)

    broken._write = fail_on_runs
    try:
        broken.append(second, T2)
    except Lost:
        pass
    assert set(table_of(store.tenders())) == {"a", "b"}

    run = store.append(second, T2)
    assert (run["batch_id"], run["rows_inserted"], run["duplicates_skipped"]) == (1, 1, 1)
    merged = dedupe.merge(dedupe.first_load(first, stamp(T1)), second, stamp(T2))
    assert table_of(store.tenders()) == table_of(merged)
    keyed = store.append(make_tenders(sample("d"), ids=False), T2, replay_key="stream#0")
    assert store.append(make_tenders(sample("d"), ids=False), T3, replay_key="stream#0") == keyed
    assert table_of(store.tenders())["d"] == (4, T2, T2, "")
    assert store.runs().count() == 3


def test_store_reads_without_the_seen_table_when_it_can(spark, make_tenders, tmp_path):
    store = TenderStore(spark, str(tmp_path / "store"))
    store.append(make_tenders(sample("a"), ids=False), T1)
    store.append(make_tenders(sample("a"), ids=False), T2)
    narrow = store.tenders().select("id", TITLE)
    assert "seen_at" not in narrow._jdf.queryExecution().executedPlan().toString()
    assert "seen_at" in store.tenders()._jdf.queryExecution().executedPlan().toString()


def test_window_predicates(make_tenders):
    rows = make_tenders(
        {"viti": " 2031 ", "data_iso": "2031-01-02", "ora_publikimit": "08:30"},
        {"viti": "2031", "data_iso": "2031-01-02", "ora_publikimit": "10:15"},
        {"viti": "2031", "data_iso": "2031-01-01"},
        {"viti": "2030", "data_iso": "2031-01-02", "ora_publikimit": "23:00"},
        {"viti": "2031"},
    )

    def ids(condition):
        return [r["id"] for r in rows.filter(condition).orderBy("id").collect()]

    assert ids(windows.of_year("2031")) == [1, 2, 3, 5]
    assert ids(windows.of_two_days("2031", date(2031, 1, 2))) == [1, 2, 3]
    at = datetime(2031, 1, 2, 10, 15)
    assert ids(windows.of_window("2031", stamp(datetime(2031, 1, 2, 8, 30)), stamp(at))) == [1, 2]
    assert ids(windows.daily_scope("2031", at, at)) == [2]
    assert ids(windows.daily_scope("2031", None, at)) == [1, 2, 3]
    assert windows.high_water_mark(rows, "2031").first()[0] == at
    assert windows.high_water_mark(rows, "1999").first()[0] is None


def test_stale_cut_against_a_walk(spark):
    rng = random.Random(5)
    for trial in range(6):
        pages = sorted(rng.sample(range(1, 9000), 60))
        flags = [(p, rng.random() < 0.5) for p in pages]
        patience = 1 + trial % 4
        walked, empty = [], 0
        for page, matched in flags:
            walked.append(page)
            empty = 0 if matched else empty + 1
            if empty >= patience:
                break
        got = windows.visited_pages(spark.createDataFrame(flags, "page int, matched boolean"), patience)
        assert sorted(r["page"] for r in got.collect()) == walked
        capped = windows.visited_pages(spark.createDataFrame(flags, "page int, matched boolean"), patience, max_pages=2)
        assert sorted(r["page"] for r in capped.collect()) == walked[:2]


def page(number, *rows):
    def field(label, value):
        return f'<li><b>{label}:</b><span style="color: #607D8B">{value}</span></li>'

    blocks = "".join(
        '<div class="list-group-item list-group-item-result"><div class="list-group-item-header"><div class="col-lg-12">'
        f'Objekti i procedurës së prokurimit: {title}</div></div><ul class="list-inline">{field("Viti", day[:4])}'
        f'<li><b>Data e publikimit</b><span>{int(day[8:])}-{int(day[5:7])}-{day[:4]}</span><small>{time}</small></li></ul></div>'
        for title, day, time in rows
    )
    return (number, "", f'<p>Faqe {number} nga 9</p><div id="simple-search" class="x search-result-container">{blocks}</div>')


def test_bootstrap_then_daily(spark, tmp_path):
    store = TenderStore(spark, str(tmp_path / "store"))
    old = spark.createDataFrame([page(1, ("a", "2031-01-02", "09:00"), ("x", "2030-01-02", "09:00")), page(2, ("b", "2031-01-01", ""))], PAGE_SCHEMA)
    run = run_ingest(store, old, "bootstrap", "2031", T2, seen_at=T2)
    assert (run["pages_visited"], run["rows_parsed"], run["rows_inserted"]) == (2, 3, 2)

    new = spark.createDataFrame(
        [
            page(1, ("d", "2031-01-03", "08:00"), ("future", "2031-01-05", "08:00")),
            page(2, ("c", "2031-01-02", "09:00"), ("a", "2031-01-02", "09:00")),
            page(3, ("late", "2031-01-01", "08:00")),
            page(4, ("later", "2031-01-01", "08:00")),
            page(5, ("never read", "2031-01-02", "12:00")),
        ],
        PAGE_SCHEMA,
    )
    now = datetime(2031, 1, 3, 12, 0)
    run = run_ingest(store, new, "daily", "2031", now, seen_at=now, stale_pages=2)
    assert (run["pages_visited"], run["rows_parsed"], run["rows_inserted"], run["duplicates_skipped"]) == (4, 6, 2, 1)
    assert set(table_of(store.tenders())) == {"a", "b", "c", "d"}
    assert table_of(store.tenders())["a"][2] == now
    assert "dynamic_last_record_to_now" in run["summary_json"]


def test_first_daily_run_takes_two_days(spark, tmp_path):
    store = TenderStore(spark, str(tmp_path / "store"))
    pages = spark.createDataFrame([page(1, ("a", "2031-01-02", "09:00"), ("b", "2031-01-01", ""), ("c", "2030-12-31", ""))], PAGE_SCHEMA)
    run = run_ingest(store, pages, "daily", "2031", datetime(2031, 1, 2, 6, 0))
    assert run["rows_inserted"] == 2 and "fallback_today_yesterday" in run["summary_json"]


def test_stream_equals_batch_and_resumes(spark, make_tenders, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    store = TenderStore(spark, str(tmp_path / "store"))
    schema = make_tenders(ids=False).schema

    def drain():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        upsert_stream(stream, store, checkpoint, clock=lambda: T1).awaitTermination()

    loaded = make_tenders(sample("z"), ids=False)
    store.append(loaded, T1)
    parts = [make_tenders(sample("a"), sample("b", 2), ids=False), make_tenders(sample("b"), sample("c", 3), ids=False)]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(source)
        drain()
    drain()
    batch = dedupe.first_load(loaded, stamp(T1))
    for part in parts:
        batch = dedupe.merge(batch, part, stamp(T1))
    assert table_of(store.tenders()) == table_of(batch)
    assert store.runs().count() == 3


def test_a_batch_reads_only_files_that_may_hold_its_keys(spark, make_tenders, tmp_path):
    store = TenderStore(spark, str(tmp_path / "store"))
    batches = [make_tenders(*[sample(f"{b} {i}", b, i) for i in range(60)], ids=False) for b in range(3)]
    for rows in batches:
        store.append(rows, T1)
    every = len(store.rows().inputFiles())
    fresh = dedupe.fingerprinted(make_tenders(*[sample(f"new {i}", 9, i) for i in range(5)], ids=False))
    old = dedupe.fingerprinted(make_tenders(sample("1 7", 1, 7), sample("new", 9), ids=False))
    assert every >= 40 and len(store.holding(fresh)) <= 2  # false hits are rare
    held = store.holding(old)
    digit = old.filter(F.col(TITLE) == "1 7").first()["source_hash"][0]
    assert any("batch_id=1/" in f and f.endswith(f"bucket={digit}") for f in held) and len(held) <= 3
    assert [r["source_hash"] for r in store.known(old).collect()] == [old.filter(F.col(TITLE) == "1 7").first()["source_hash"]]
    assert store.known(fresh).count() == 0
    for rows in batches:  # no stored key is ever missed
        assert store.known(dedupe.first_wins(rows)).count() == 60


def test_compaction_keeps_the_table_and_its_readers(spark, make_tenders, tmp_path):
    store = TenderStore(spark, str(tmp_path / "store"))
    store.compact()
    for b, now in enumerate((T1, T2, T3)):
        store.append(make_tenders(*[sample(f"{i}", 1, i) for i in range(b, b + 20)], ids=False), now)
    before, files = table_of(store.tenders()), len(store.rows().inputFiles())
    reader = store.tenders()
    store.compact()
    assert table_of(store.tenders()) == before == table_of(reader)
    merged = store._published("rows", store_module.ROWS_SCHEMA).select("batch_id", "attempt", "bucket").distinct().collect()
    assert len(merged) <= 16 < files
    store.compact()  # nothing new: stays as it is
    assert store._named("compacted").count() == 1
    run = store.append(make_tenders(sample("3"), sample("99"), ids=False), T3)
    assert (run["batch_id"], run["rows_inserted"], run["duplicates_skipped"]) == (3, 1, 1)
    assert set(table_of(store.tenders())) == {*before, "99"} and store.runs().count() == 4
    store.compact()
    assert table_of(store.tenders())["99"][0] == 23 and len(table_of(store.tenders())) == 23


def test_an_empty_published_file_heals_itself(spark, make_tenders, tmp_path):
    store = TenderStore(spark, str(tmp_path / "store"))
    store.append(make_tenders(sample("a"), ids=False), T1)
    (tmp_path / "store" / "published" / "1").touch()
    assert set(table_of(store.tenders())) == {"a"}
    assert store.append(make_tenders(sample("b"), ids=False), T2)["batch_id"] == 1
    assert set(table_of(store.tenders())) == {"a", "b"}
    other = TenderStore(spark, store.path)
    with pytest.raises(store_module.ConcurrentBatchError):
        other._publish("published", "1", "late")
    assert not [f for f in (tmp_path / "store" / "published").iterdir() if f.name.startswith("_")]


@pytest.mark.parametrize("step", ["rows", "blooms", "seen", "runs", "publish", "after"])
def test_a_stream_resumes_after_a_failure_at_any_step(spark, make_tenders, tmp_path, step):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    parts = [make_tenders(sample("a"), sample("b", 2), ids=False), make_tenders(sample("b"), sample("c", 3), ids=False)]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(source)
    schema = parts[0].schema
    broken = FailingStore(spark, str(tmp_path / "store"), step)

    def drain(store):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        upsert_stream(stream, store, checkpoint, clock=lambda: T1).awaitTermination()

    with pytest.raises(Exception, match="injected"):
        drain(broken)
    store = TenderStore(spark, broken.path)
    drain(store)
    drain(store)
    batch = dedupe.merge(dedupe.first_load(parts[0], stamp(T1)), parts[1], stamp(T1))
    assert table_of(store.tenders()) == table_of(batch)
    assert store.runs().count() == 2


def test_daily_stream_starts_from_the_mark_of_the_run_before(spark, make_tenders, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "stream")
    store = TenderStore(spark, str(tmp_path / "store"))

    def dated(title, day, time=""):
        return sample(title, data_iso=day, ora_publikimit=time, viti=day[:4])

    def records():
        return spark.readStream.schema(schema).parquet(source)

    first = make_tenders(dated("a", "2031-01-02", "09:00"), dated("b", "2031-01-01"), dated("x", "2030-05-05"), ids=False)
    schema = first.schema
    first.write.parquet(source)
    load_stream(records(), store, path, clock=lambda: T1)
    make_tenders(dated("late", "2031-01-01", "08:00"), dated("edge", "2031-01-02", "09:00"), dated("d", "2031-01-03", "08:00"), dated("y", "2030-06-06"), ids=False).write.mode("append").parquet(source)
    assert daily_stream(records(), store, path, "2031", datetime(2031, 1, 3, 12), clock=lambda: T2) == datetime(2031, 1, 2, 9)
    make_tenders(dated("older", "2031-01-02", "10:00"), dated("e", "2031-01-03", "09:00"), dated("future", "2031-01-09"), ids=False).write.mode("append").parquet(source)
    assert daily_stream(records(), store, path, "2031", datetime(2031, 1, 4), clock=lambda: T3) == datetime(2031, 1, 3, 8)
    assert set(table_of(store.tenders())) == {"a", "b", "x", "edge", "d", "e"}
    assert stored_mark(spark, f"{path}/marks", "2031") == datetime(2031, 1, 3, 9) == windows.high_water_mark(store.rows(), "2031").first()[0]
    fresh = TenderStore(spark, str(tmp_path / "fresh"))
    assert daily_stream(records(), fresh, str(tmp_path / "other"), "2031", datetime(2031, 1, 3, 12), clock=lambda: T1) is None
    assert set(table_of(fresh.tenders())) == {"a", "edge", "older", "d", "e"}


def test_label_stream_appends_every_request_once(spark, make_tenders, tmp_path):
    tenders = make_tenders(sample("software"), sample("ndertim", 2), sample("sistem", 3))
    path, source = str(tmp_path / "labels"), str(tmp_path / "in")
    schema = "request_id long, tender_id long, label string, reviewer string, note string"
    fails = {"left": 1}

    def clock():
        if fails["left"]:
            fails["left"] -= 1
            raise RuntimeError("injected")
        return T1

    def drain(tick, table=tenders):
        label_stream(spark.readStream.schema(schema).parquet(source), table, path, clock=tick).awaitTermination()

    assert stored_labels(spark, path) is None and stored_rejects(spark, path) is None
    spark.createDataFrame([(1, 1, "relevant", "a", ""), (2, 9, "relevant", "a", ""), (3, 2, "odd", "a", "")], schema).write.parquet(source)
    with pytest.raises(Exception, match="injected"):
        drain(clock)
    drain(clock)
    spark.createDataFrame([(4, 3, " maybe ", "b", "n"), (5, 1, "not_relevant", "b", "")], schema).write.mode("append").parquet(source)
    drain(clock, tenders.withColumn(TITLE, F.lit("software")))  # the classification of the time of the label
    drain(clock)
    rows = {r["id"]: r for r in stored_labels(spark, path).collect()}
    assert {i: (r["tender_id"], r["label"]) for i, r in rows.items()} == {1: (1, "relevant"), 2: (3, "maybe"), 3: (1, "not_relevant")}
    assert rows[1]["snapshot"]["broad_ok"] and rows[2]["snapshot"]["broad_ok"] and rows[1]["created_at"] == T1
    assert {(r["request_id"], r["reason"]) for r in stored_rejects(spark, path).collect()} == {(2, "tender_not_found"), (3, "invalid_label")}


def test_stream_prefilter_drops_repeats(spark, make_tenders, tmp_path):
    source = str(tmp_path / "in")
    rows = make_tenders(sample("a"), sample("a", 2), sample("b", 3), ids=False).withColumn("at", F.lit(T1.isoformat(" ")).cast("timestamp"))
    rows.coalesce(1).write.parquet(source)
    kept = without_repeats(spark.readStream.schema(rows.schema).parquet(source), "at", "1 day")
    query = kept.writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r[TITLE] for r in spark.table("kept").collect()) == ["a", "b"]


def test_stored_columns(make_tenders):
    loaded = dedupe.first_load(make_tenders(sample("a"), ids=False), stamp(T1))
    assert loaded.columns == ["id", "source_hash", *TENDER_COLUMNS, "first_seen_at", "last_seen_at"]


def test_numbering_sorts_and_writes_no_texts(spark, make_tenders, monkeypatch):
    columns = []

    def noted(df, name):
        columns.append(set(df.columns))
        return whole(df, name)

    whole = ordering.written
    monkeypatch.setattr(ordering, "written", noted)
    base = dedupe.first_load(make_tenders(sample("a", 1), sample("b", 2), ids=False), stamp(T1))
    merged = dedupe.merge(base, make_tenders(sample("b", 1), sample("c", 2), ids=False), stamp(T2))
    assert {r[TITLE]: r["id"] for r in merged.collect()} == {"a": 1, "b": 2, "c": 3}
    assert columns and not any(TITLE in c for c in columns)

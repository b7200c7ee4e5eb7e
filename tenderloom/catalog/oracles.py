"""The registered queries once more, as SQL for DuckDB over the same tables.

Texts are normalised with ``strip_accents``; RE2 word boundaries are ASCII, so
the keyword rules look at a copy of the text in which other letters become x.
"""

from __future__ import annotations

from tenderloom.catalog.adapters import CANDIDATE_RULES, CURRENT_RULES, FORMER_RULES
from tenderloom.rules import DEFAULT_RULES, RuleSet

WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def squeeze(sql: str) -> str:
    return f"trim(regexp_replace({sql}, '{WS}', ' ', 'g'))"


def fingerprint(alias: str = "") -> str:
    fields = ("objekti_procedurave", "autoriteti_kontraktues", "data_publikimit", "ora_publikimit", "fondi_limit_raw", "kodi_cpv_raw")
    return "sha256(concat_ws(chr(30), " + ", ".join(squeeze(alias + f) for f in fields) + "))"


TENDERS = """
tenders AS (
  SELECT doc_id + 1 AS id, text AS objekti_procedurave, 'Autoriteti ' || lang AS autoriteti_kontraktues,
    CASE WHEN n_chars % 2 = 0 THEN 'Buxheti' ELSE 'Te ardhurat' END AS burimi_financimit,
    CASE n_chars % 4 WHEN 0 THEN n_chars || ',50 Lekë' WHEN 1 THEN n_chars || '.00 Lek'
      WHEN 2 THEN n_chars || ' lek' ELSE 'pa fond' END AS fondi_limit_raw,
    CASE n_chars % 4 WHEN 0 THEN n_chars || '.50' WHEN 3 THEN '' ELSE n_chars || '.00' END AS fondi_limit_lek,
    day(d) || '-' || month(d) || '-' || year(d) AS data_publikimit,
    CASE n_chars % 3 WHEN 0 THEN 'Ora ' || (n_chars % 24) || ':' || lpad(CAST(n_chars % 60 AS VARCHAR), 2, '0')
      WHEN 1 THEN (n_chars % 24) || '.' || lpad(CAST(n_chars % 60 AS VARCHAR), 2, '0') ELSE '' END AS ora_publikimit,
    CAST(d AS VARCHAR) AS data_iso, CAST(2024 + doc_id % 3 AS VARCHAR) AS viti,
    'Muaji ' || (n_chars % 12 + 1) AS koha_zhvillimit, code AS kodi_cpv_raw, code AS cpv_spans,
    source AS tipi_procedures, '' AS anulluar,
    CAST(doc_id // 20 + 1 AS VARCHAR) AS page_fetched, CAST(doc_id % 20 AS VARCHAR) AS row_index_on_page,
    CAST(d AS TIMESTAMP) + CASE WHEN n_chars % 3 = 2 THEN INTERVAL 0 MINUTE
      ELSE to_minutes(CAST((n_chars % 24) * 60 + n_chars % 60 AS BIGINT)) END AS published
  FROM (
    SELECT *, DATE '2024-01-01' + CAST(n_chars % 365 AS INTEGER) AS d,
      lpad(CAST((n_chars * 7368787 + 31415926) % 100000000 AS VARCHAR), 8, '0') || '-' || (n_chars % 10) AS code
    FROM documents
  )
)"""

LABELS = """
given AS (
  SELECT doc_id * 3 + v + 1 AS id, doc_id + 1 AS tender_id,
    CASE WHEN v = 1 AND toxic = 1 THEN 'maybe' WHEN quality = 1 THEN 'relevant'
      WHEN toxic = 1 THEN 'maybe' ELSE 'not_relevant' END AS label,
    CASE WHEN doc_id % 11 <> 0 THEN 'Analyst ' || (doc_id % 7) END AS reviewer,
    CASE WHEN v = 2 THEN 'note ' || doc_id END AS note,
    TIMESTAMP '2024-06-01' + to_days(CASE WHEN v = 0 THEN 0 ELSE 1 END) + to_hours(doc_id % 50) AS created_at
  FROM (SELECT *, unnest(range(0, doc_id % 3 + 1)) AS v FROM labels)
)"""

LAST_ONE = """
last_one AS (
  SELECT * FROM given QUALIFY row_number() OVER (PARTITION BY tender_id ORDER BY created_at DESC, id DESC) = 1
)"""

LAST_TIES = """
last_ties AS (
  SELECT * FROM given QUALIFY rank() OVER (PARTITION BY tender_id ORDER BY created_at DESC) = 1
)"""

NORMAL = """
normal AS (
  SELECT id, kodi_cpv_raw AS code, {full} AS t0 FROM tenders
), folded AS (
  SELECT id, code, t0, regexp_replace(regexp_replace(t0, '[^\\x00-\\x7F\\p{{L}}\\p{{N}}]', ' ', 'g'), '[^\\x00-\\x7F]', 'x', 'g') AS t
  FROM normal
)""".format(full=squeeze("lower(strip_accents(objekti_procedurave || ' ' || kodi_cpv_raw || ' ' || tipi_procedures))"))


def classified(rules: RuleSet, name: str) -> str:
    """CTEs ending in ``name``: sorted hit lists, flags, reasons, score, tier and signals per id."""
    w = rules.weights

    def words(patterns):
        joined = "|".join(patterns)
        return f"list_sort(list_distinct(regexp_extract_all(t, '(?i){joined}')))"

    def codes(prefixes):
        starts = "|".join(prefixes)
        every = r"regexp_extract_all(code, '\b\d{8}-\d\b')"
        return f"list_sort(list_distinct(list_filter({every}, lambda x: regexp_matches(x, '^({starts})'))))"

    def marked(items, prefix):
        return f"list_transform({items}, lambda x: '{prefix}' || x)"

    none = "CAST([] AS VARCHAR[])"
    entries = (
        ("status:broad", "broad_ok", str(w["broad_bonus"])),
        ("status:strict", "strict_ok", str(w["strict_bonus"])),
        ("status:mixed_it_bundle", "mixed_ok", str(w["mixed_bundle_bonus"])),
        ("include_kw_hits", "len(kw) > 0", f"len(kw) * {w['include_keyword_hit']}"),
        ("include_cpv_hits", "len(cpv) > 0", f"len(cpv) * {w['include_cpv_hit']}"),
        ("exclude_kw_hits", "len(xkw) > 0", f"len(xkw) * ({w['exclude_keyword_hit']})"),
        ("exclude_cpv_hits", "len(xcpv) > 0", f"len(xcpv) * ({w['exclude_cpv_hit']})"),
        ("near_kw_hits", "NOT broad_ok AND len(nkw) > 0", f"len(nkw) * {w['near_keyword_hit']}"),
        ("near_cpv_hits", "NOT broad_ok AND len(ncpv) > 0", f"len(ncpv) * {w['near_cpv_hit']}"),
        ("mixed_near_hits", "mixed_ok", f"(len(kw) + len(cpv) + len(xkw) + len(xcpv)) * {w['mixed_bundle_bonus']}"),
    )
    signals = ", ".join(
        f"CASE WHEN {cond} THEN {{'a': abs(CAST({val} AS BIGINT)), 'w': CAST({val} AS BIGINT), 'n': '{label}'}} END"
        for label, cond, val in entries
    )
    ranked = f"list_reverse_sort(list_filter([{signals}], lambda s: s IS NOT NULL))"
    total = " + ".join(f"CASE WHEN {cond} THEN {val} ELSE 0 END" for _, cond, val in entries)
    return f"""
{name}_hits AS (
  SELECT id, {words(rules.include_keyword_patterns)} AS kw, {codes(rules.include_cpv_prefixes)} AS cpv,
    {words(rules.exclude_keyword_patterns)} AS xkw, {codes(rules.exclude_cpv_prefixes)} AS xcpv,
    {words(rules.near_miss_keyword_patterns)} AS nkw, {codes(rules.near_miss_cpv_prefixes)} AS ncpv
  FROM folded
), {name}_flags AS (
  SELECT *, len(kw) + len(cpv) > 0 AS broad_ok, len(xkw) + len(xcpv) > 0 AS exclusion_ok,
    len(kw) + len(cpv) > 0 AND len(xkw) + len(xcpv) = 0 AS strict_ok,
    len(kw) + len(cpv) > 0 AND len(xkw) + len(xcpv) > 0 AS mixed_ok
  FROM {name}_hits
), {name}_reasons AS (
  SELECT *, mixed_ok OR (NOT broad_ok AND len(nkw) + len(ncpv) > 0) AS near_miss_ok,
    list_sort({marked('kw', 'kw:')} || {marked('cpv', 'cpv:')}) AS broad_reasons,
    list_sort({marked('xkw', 'exclude_kw:')} || {marked('xcpv', 'exclude_cpv:')}) AS exclusion_reasons,
    {total} AS raw_score, {ranked} AS ranked
  FROM {name}_flags
), {name} AS (
  SELECT *, CASE WHEN mixed_ok THEN exclusion_reasons ELSE {none} END AS strict_excluded_reasons,
    CASE WHEN mixed_ok THEN list_sort(broad_reasons || exclusion_reasons) ELSE {none} END AS mixed_reasons,
    CASE WHEN mixed_ok THEN list_sort({marked('broad_reasons || exclusion_reasons', 'mixed_it_bundle:')})
      WHEN broad_ok THEN {none}
      ELSE list_sort({marked('nkw', 'near_kw:')} || {marked('ncpv', 'near_cpv:')}) END AS near_miss_reasons,
    CAST(greatest({rules.score_min}, least({rules.score_max}, raw_score)) AS INTEGER) AS score,
    CASE WHEN greatest({rules.score_min}, least({rules.score_max}, raw_score)) >= {rules.high_threshold} THEN 'high'
      WHEN greatest({rules.score_min}, least({rules.score_max}, raw_score)) >= {rules.medium_threshold} THEN 'medium'
      ELSE 'low' END AS confidence,
    array_to_string(list_transform(ranked[1:{rules.top_signal_count}], lambda s: s.n || printf('(%+d)', s.w)), ' | ') AS top_signals
  FROM {name}_reasons
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


CLASSIFIED = (TENDERS, NORMAL, classified(CURRENT_RULES, "c"))


def listed(column: str) -> str:
    return f"array_to_string({column}, ' | ')"


def confusion(predicted: str, rows: str = "") -> str:
    return ", ".join(
        f"CAST(count(*) FILTER (WHERE {p}{predicted} AND label = '{lab}'{rows}) AS BIGINT) AS {n}"
        for n, p, lab in (
            ("tp", "", "relevant"),
            ("fp", "", "not_relevant"),
            ("fn", "NOT ", "relevant"),
            ("tn", "NOT ", "not_relevant"),
        )
    )


PRECISION = "CASE WHEN {0}tp + {0}fp > 0 THEN {0}tp / ({0}tp + {0}fp) ELSE 0.0 END"
RECALL = "CASE WHEN {0}tp + {0}fn > 0 THEN {0}tp / ({0}tp + {0}fn) ELSE 0.0 END"


def rates(prefix: str = "") -> str:
    p, r = PRECISION.format(prefix), RECALL.format(prefix)
    f1 = f"CASE WHEN {p} + {r} > 0 THEN 2 * ({p}) * ({r}) / (({p}) + ({r})) ELSE 0.0 END"
    return f"round({p}, 4) AS {prefix}precision, round({r}, 4) AS {prefix}recall, round({f1}, 4) AS {prefix}f1"


def per_mode(source: str, columns: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{m}' AS mode, {columns.replace('$', m + '_ok')} FROM {source}" for m in ("strict", "broad", "near_miss")
    )


JUDGED = (TENDERS, NORMAL, classified(CURRENT_RULES, "c"), LABELS, LAST_TIES, "judged AS (SELECT c.*, l.label FROM last_ties l JOIN c ON c.id = l.tender_id)")

COMPARED = (
    TENDERS,
    NORMAL,
    classified(CURRENT_RULES, "b"),
    classified(CANDIDATE_RULES, "k"),
    LABELS,
    LAST_TIES,
    """compared AS (
  SELECT l.id AS label_id, l.tender_id, l.label, """
    + ", ".join(f"b.{c} AS before_{c}, k.{c} AS after_{c}" for c in ("score", "confidence", "strict_ok", "broad_ok", "near_miss_ok"))
    + """ FROM last_ties l JOIN b ON b.id = l.tender_id JOIN k ON k.id = l.tender_id)""",
)


def _deltas() -> str:
    cells = ", ".join(
        f"CAST(count(*) FILTER (WHERE {p}{side}_$ AND label = '{lab}') AS BIGINT) AS {side}_{n}"
        for side in ("before", "after")
        for n, p, lab in (("tp", "", "relevant"), ("fp", "", "not_relevant"), ("fn", "NOT ", "relevant"), ("tn", "NOT ", "not_relevant"))
    )
    counts = "counts AS (" + per_mode("compared", cells) + ")"
    rated = f"rated AS (SELECT *, {rates('before_')}, {rates('after_')} FROM counts)"
    return with_(*COMPARED, counts, rated, """deltas AS (SELECT *, round(after_recall - before_recall, 4) AS recall_delta,
      round(after_precision - before_precision, 4) AS precision_delta FROM rated)""")


DRIFT = (
    TENDERS,
    NORMAL,
    classified(FORMER_RULES, "f"),
    classified(CURRENT_RULES, "c"),
    LABELS,
    LAST_TIES,
    """drift AS (
  SELECT l.id AS label_id, l.tender_id, l.label, strftime(l.created_at, '%Y-%m-%d %H:%M:%S') AS timestamp,
    f.score AS snapshot_score, c.score AS current_score, f.confidence AS snapshot_confidence, c.confidence AS current_confidence,
    CAST(f.strict_ok AS INTEGER) AS snapshot_strict_ok, CAST(c.strict_ok AS INTEGER) AS current_strict_ok,
    CAST(f.near_miss_ok AS INTEGER) AS snapshot_near_miss_ok, CAST(c.near_miss_ok AS INTEGER) AS current_near_miss_ok,
    f.top_signals AS snapshot_top_signals, c.top_signals AS current_top_signals
  FROM last_ties l JOIN f ON f.id = l.tender_id JOIN c ON c.id = l.tender_id)""",
)

HASHED = f"hashed AS (SELECT *, {fingerprint()} AS source_hash FROM tenders)"
ARRIVAL = "CAST(page_fetched AS BIGINT), CAST(row_index_on_page AS BIGINT)"


def first_of(source: str, where: str = "TRUE") -> str:
    return f"SELECT * FROM {source} WHERE {where} QUALIFY row_number() OVER (PARTITION BY source_hash ORDER BY {ARRIVAL}) = 1"


def loaded(name: str, where: str) -> str:
    """First rows per fingerprint, numbered in arrival order."""
    return f"{name} AS (SELECT row_number() OVER (ORDER BY {ARRIVAL}, source_hash) AS nr, * FROM ({first_of('hashed', where)}))"


STORED = "source_hash, viti, page_fetched, row_index_on_page, fondi_limit_lek"


def merged(last_time: str, first_time: str = "2024-06-02 00:00:00") -> str:
    return with_(
        TENDERS,
        HASHED,
        loaded("base", "viti = '2024'"),
        f"batch AS ({first_of('hashed')})",
        f"fresh AS (SELECT (SELECT max(nr) FROM base) + row_number() OVER (ORDER BY {ARRIVAL}, source_hash) AS nr, * "
        "FROM batch WHERE source_hash NOT IN (SELECT source_hash FROM base))",
    ) + f"""SELECT nr AS id, {STORED}, '2024-06-01 00:00:00' AS first_seen_at, '{last_time}' AS last_seen_at FROM base
UNION ALL SELECT nr, {STORED}, '{first_time}', '{last_time}' FROM fresh"""


def _like(column: str, needle: str) -> str:
    return f"contains(translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{needle}')"


PAGE = "data_iso, autoriteti_kontraktues, kodi_cpv_raw"
TIER = "CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"


def _listed_reasons(sql: str) -> str:
    return f"array_to_string(list_sort({sql}), ' | ')"


def _exported(where: str, reasons: str) -> str:
    return with_(*CLASSIFIED) + f"""SELECT c.id, autoriteti_kontraktues, {_listed_reasons(reasons)} AS software_match_reason,
  CAST(score AS VARCHAR) AS software_match_score, confidence AS software_confidence, top_signals AS software_top_signals
FROM c JOIN tenders t ON t.id = c.id WHERE {where}"""


def _qc(score: str, excluded: str) -> tuple[str, str]:
    first = f"SELECT id, 0 AS step, {score} AS software_match_score, {_listed_reasons('broad_reasons')} AS software_match_reason FROM c WHERE broad_ok"
    second = f"SELECT id, 1 AS step, 'excluded' AS software_match_score, {_listed_reasons(excluded)} AS software_match_reason FROM c WHERE mixed_ok"
    return first, second


_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"

DIFF_FIELDS = (
    "broad_ok", "broad_reasons", "strict_ok", "strict_excluded_reasons", "mixed_ok", "mixed_reasons",
    "near_miss_ok", "near_miss_reasons", "score", "confidence", "top_signals",
)


def _diff() -> str:
    def shown(side: str, name: str) -> str:
        if name.endswith("reasons"):
            return f"array_to_string({side}.{name}, ' | ')"
        if name == "top_signals":
            return f"array_to_string(list_sort(string_split({side}.top_signals, ' | ')), ' | ')"
        return f"CAST({side}.{name} AS VARCHAR)"

    fields = " UNION ALL ".join(
        f"SELECT b.id, '{n}' AS field, {shown('b', n)} AS \"left\", {shown('k', n)} AS \"right\" FROM b JOIN k ON k.id = b.id"
        for n in DIFF_FIELDS
    )
    return with_(TENDERS, NORMAL, classified(CURRENT_RULES, "b"), classified(CANDIDATE_RULES, "k")) + f"""
SELECT * FROM (
  {fields}
) WHERE "left" IS DISTINCT FROM "right" """


def _unescape(sql: str) -> str:
    for reference, raw in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        sql = f"replace({sql}, '{reference}', '{raw}')"
    return sql


def _html_text(sql: str, gap: str) -> str:
    return squeeze(_unescape(f"regexp_replace({sql}, '<[^>]*>', '{gap}', 'g')"))


def all_oracles() -> dict[str, str]:
    c = with_(*CLASSIFIED)
    t = with_(TENDERS)
    stats = """SELECT count(*) AS total, count(*) FILTER (WHERE broad_ok) AS software_broad,
  count(*) FILTER (WHERE strict_ok) AS software_strict, count(*) FILTER (WHERE near_miss_ok) AS near_miss FROM """
    labels = with_(LABELS, LAST_ONE, LAST_TIES)
    label_row = "id, tender_id, label, reviewer, note, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at"
    judged = with_(*JUDGED)
    used = "label IN ('relevant', 'not_relevant')"
    drift = with_(*DRIFT)
    stored = f"SELECT nr AS id, {STORED}, '2024-06-01 00:00:00' AS first_seen_at, '2024-06-01 00:00:00' AS last_seen_at FROM base"
    qc, strict_qc = _qc("CAST(score AS VARCHAR)", "['mixed_it_bundle'] || mixed_reasons")
    old_qc, old_strict_qc = _qc("CAST(len(broad_reasons) AS VARCHAR)", "exclusion_reasons")
    flags = f"""flags AS (SELECT CAST(page_fetched AS BIGINT) AS page, bool_or(coalesce(viti = '2025' AND
      published BETWEEN TIMESTAMP '2024-02-01' AND TIMESTAMP '2024-03-15', FALSE)) AS matched FROM tenders GROUP BY 1)"""
    deltas = _deltas()
    queue = f"{TIER.replace('confidence', 'software_confidence')} DESC, CAST(software_match_score AS INTEGER) DESC, data_iso, row_index_on_page, id"
    requests = """requests AS (SELECT doc_id + 1 AS request_id,
      CASE WHEN doc_id % 10 = 3 THEN doc_id + 1000000000 ELSE doc_id + 1 END AS tender_id,
      CASE WHEN doc_id % 10 = 4 THEN 'unsure' WHEN quality = 1 THEN 'relevant' ELSE 'maybe' END AS label,
      'Analyst ' || (doc_id % 7) AS reviewer, CASE WHEN doc_id % 2 <> 0 THEN CAST(1000 AS BIGINT) ELSE 0 END AS note_length FROM labels)"""
    half_year = "viti = '2025' AND published BETWEEN (SELECT max(published) FROM tenders WHERE viti = '2025' AND data_iso <= '2024-06-01') AND TIMESTAMP '2024-06-30 12:00:00'"
    return {
        "stats_by_mode": c + stats + "c",
        "stats_default_rules": with_(TENDERS, NORMAL, classified(DEFAULT_RULES, "d")) + stats + "d",
        "rule_lint": with_(TENDERS, NORMAL)
        + """, found(kind, subject, list, rule, by_list, by_rule, hit) AS (VALUES
  ('dead', 'code', 'include', '72', 'include', '7', '\\b72\\d{6}-\\d\\b'),
  ('conflict', 'code', 'exclude', '503', 'include', '503', '\\b503\\d{5}-\\d\\b'),
  ('dead', 'code', 'exclude', '5031', 'exclude', '503', '\\b5031\\d{4}-\\d\\b'),
  ('conflict', 'code', 'exclude', '5031', 'include', '503', '\\b5031\\d{4}-\\d\\b'),
  ('dead', 'code', 'near_miss', '480', 'include', '48', '\\b480\\d{5}-\\d\\b'),
  ('dead', 'keyword', 'include', '\\bque\\s+de\\b', 'include', '\\bque\\w*\\b', '\\bque\\s+de\\b'),
  ('conflict', 'keyword', 'include', '\\bthe\\s+and\\b', 'exclude', '\\band\\b', '\\bthe\\s+and\\b'),
  ('conflict', 'keyword', 'exclude', '\\bder\\b', 'include', '\\bder\\b', '\\bder\\b'),
  ('dead', 'keyword', 'near_miss', '\\bquel\\w*\\b', 'include', '\\bque\\w*\\b', '\\bquel\\w*\\b'))
SELECT kind, subject, list, rule, by_list, by_rule, (SELECT count(*) FROM folded n
  WHERE CASE subject WHEN 'code' THEN regexp_matches(n.code, hit) ELSE regexp_matches(n.t, hit) END) AS rows FROM found""",
        "stats_maintained": with_(TENDERS, NORMAL, classified(CANDIDATE_RULES, "k")) + stats + "k",
        "classify_flags": c + "SELECT id, broad_ok, exclusion_ok, strict_ok, mixed_ok, near_miss_ok FROM c",
        "reason_lists": c
        + "SELECT id, "
        + ", ".join(
            f"{listed(n)} AS {n}"
            for n in ("broad_reasons", "exclusion_reasons", "strict_excluded_reasons", "mixed_reasons", "near_miss_reasons")
        )
        + " FROM c",
        "scores_and_tiers": c + "SELECT id, score, confidence FROM c",
        "top_signals": c + "SELECT id, top_signals FROM c",
        "validation_report": c
        + """SELECT count(*) AS total_full_rows, count(*) FILTER (WHERE broad_ok) AS broad_rows,
  count(*) FILTER (WHERE strict_ok) AS strict_rows,
  count(*) FILTER (WHERE broad_ok) - count(*) FILTER (WHERE strict_ok) AS excluded_from_strict_count,
  count(*) FILTER (WHERE near_miss_ok) AS near_miss_rows, count(*) FILTER (WHERE mixed_ok) AS mixed_it_bundle_rows,
  CAST(0 AS BIGINT) AS classification_invariant_violations FROM c""",
        "sample_excluded_titles": c
        + f"""SELECT id, substr(title, 1, 120) AS title FROM (
  SELECT c.id, data_iso, regexp_replace(objekti_procedurave, '^{WS}|{WS}$', '', 'g') AS title, broad_ok, strict_ok
  FROM c JOIN tenders t ON t.id = c.id)
WHERE broad_ok AND NOT strict_ok AND title <> '' ORDER BY data_iso, id LIMIT 5""",
        "result_diff": _diff(),
        "normalized_text": with_(TENDERS, NORMAL) + "SELECT id, md5(t0) AS digest, length(t0) AS length FROM normal",
        "cpv_codes": t
        + r"""SELECT id, array_to_string(regexp_extract_all(kodi_cpv_raw || ' ' || objekti_procedurave || ' ' || kodi_cpv_raw,
  '\b\d{8}-\d\b'), ' | ') AS codes FROM tenders""",
        "source_hash": with_(TENDERS, HASHED) + "SELECT id, source_hash FROM hashed",
        "display_text": t
        + f"""SELECT id, CASE WHEN length(s) > 96 THEN substr(s, 1, 95) || '…' ELSE s END AS shown
FROM (SELECT id, {squeeze('objekti_procedurave')} AS s FROM tenders)""",
        "amount_parse": f"""SELECT o_orderkey, CASE o_orderkey % 8
    WHEN 4 THEN whole || '.00' WHEN 5 THEN whole || '.00' WHEN 6 THEN '' WHEN 7 THEN whole || rest || '5.00'
    ELSE whole || '.' || rest END AS amount
  FROM (SELECT o_orderkey, {_CENTS} // 100 AS whole, lpad(CAST({_CENTS} % 100 AS VARCHAR), 2, '0') AS rest FROM orders)""",
        "date_parse": """SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS data_iso FROM orders""",
        "time_parse": """SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN hour(ts) * 60 + minute(ts) WHEN 1 THEN hour(ts) * 60 + minute(ts)
    WHEN 2 THEN CASE WHEN hour(ts) < 4 THEN (hour(ts) + 20) * 60 + minute(ts) ELSE -1 END ELSE -1 END AS INTEGER) AS minutes FROM events""",
        "publication_times": t + "SELECT id, strftime(published, '%Y-%m-%d %H:%M:%S') AS published FROM tenders",
        "dedupe_first_wins": with_(TENDERS, HASHED)
        + f"SELECT source_hash, id, page_fetched, row_index_on_page FROM ({first_of('hashed')})",
        "crawl_qc": with_(TENDERS, HASHED)
        + f"""SELECT (SELECT count(DISTINCT source_hash) FROM hashed) AS row_count_deduped, count(*) AS row_count_raw,
  count(*) - count(DISTINCT source_hash) AS duplicate_fingerprints,
  (SELECT count(*) FROM ({first_of('hashed')}) WHERE {squeeze('objekti_procedurave')} = '') AS rows_missing_object,
  max(CAST(page_fetched AS BIGINT)) AS last_page_number, count(DISTINCT page_fetched) AS pages_with_rows,
  '2024' AS target_year FROM hashed""",
        "upsert_merge": merged("2024-06-02 00:00:00"),
        "upsert_replay": merged("2024-06-03 00:00:00"),
        "upsert_stats": with_(TENDERS, HASHED)
        + """SELECT count(DISTINCT source_hash) FILTER (WHERE NOT known) AS rows_inserted,
  count(*) - count(DISTINCT source_hash) FILTER (WHERE NOT known) AS duplicates_skipped
FROM (SELECT source_hash, source_hash IN (SELECT source_hash FROM hashed WHERE viti = '2024') AS known FROM hashed)""",
        "surrogate_ids": t
        + "SELECT id AS tender, data_iso, 100 + row_number() OVER (ORDER BY data_iso DESC, id) AS position FROM tenders",
        "year_filter": t + "SELECT id, viti FROM tenders WHERE viti = '2025'",
        "two_day_fallback": t
        + "SELECT id, data_iso FROM tenders WHERE viti = '2025' AND data_iso IN ('2024-03-02', '2024-03-01')",
        "window_filter": t
        + """SELECT id, strftime(published, '%Y-%m-%d %H:%M:%S') AS published FROM tenders WHERE viti = '2026'
  AND published BETWEEN TIMESTAMP '2024-03-01 06:30:00' AND TIMESTAMP '2024-09-15 12:00:00'""",
        "high_water_mark": t
        + "SELECT strftime(max(published), '%Y-%m-%d %H:%M:%S') AS latest FROM tenders WHERE viti = '2025'",
        "stale_page_cut": with_(TENDERS, flags)
        + """SELECT page, matched, visit FROM (
  SELECT *, min(CASE WHEN run = 3 THEN visit END) OVER () AS cut FROM (
    SELECT *, row_number() OVER (ORDER BY page) AS visit,
      sum(CASE WHEN matched THEN 0 ELSE 1 END) OVER (ORDER BY page ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS run FROM flags))
WHERE visit <= coalesce(cut, visit)""",
        "page_cap": t
        + """SELECT count(*) AS pages_visited, max(page) AS last_page FROM (
  SELECT DISTINCT CAST(page_fetched AS BIGINT) AS page FROM tenders ORDER BY page LIMIT 7)""",
        "latest_label_one": labels + f"SELECT {label_row} FROM last_one",
        "latest_label_ties": labels + f"SELECT {label_row} FROM last_ties",
        "label_listing": labels
        + f"SELECT {label_row} FROM (SELECT * FROM given ORDER BY created_at DESC, id DESC LIMIT 100)",
        "label_append": with_(*CLASSIFIED, requests)
        + f"""SELECT 500 + row_number() OVER (ORDER BY request_id) AS id, tender_id, label, reviewer, note_length, score, confidence,
  strict_ok, {listed('near_miss_reasons')} AS near_miss FROM requests r JOIN c ON c.id = r.tender_id WHERE label <> 'unsure'""",
        "streaming_labels": with_(*CLASSIFIED, requests)
        + """SELECT 500 + row_number() OVER (ORDER BY request_id) AS id, tender_id, label, score, strict_ok, '' AS reason
FROM requests r JOIN c ON c.id = r.tender_id WHERE label <> 'unsure'
UNION ALL SELECT -1, tender_id, '', -1, FALSE, CASE WHEN label = 'unsure' THEN 'invalid_label' ELSE 'tender_not_found' END
FROM requests WHERE label = 'unsure' OR tender_id NOT IN (SELECT id FROM c)""",
        "label_rejects": with_(TENDERS, requests)
        + """SELECT request_id, tender_id, CASE WHEN label = 'unsure' THEN 'invalid_label' ELSE 'tender_not_found' END AS reason
FROM requests WHERE label = 'unsure' OR tender_id NOT IN (SELECT id FROM tenders)""",
        "snapshot_json_roundtrip": with_(TENDERS, NORMAL, classified(FORMER_RULES, "f"), LABELS)
        + f"""SELECT l.id, score, confidence, broad_ok, top_signals, {listed('broad_reasons')} AS broad, {listed('mixed_reasons')} AS mixed
FROM given l JOIN f ON f.id = l.tender_id""",
        "search_text_page": with_(TENDERS, LABELS, LAST_ONE)
        + f"""SELECT p.id, {PAGE}, l.label AS latest_label, l.reviewer AS latest_reviewer FROM (
  SELECT * FROM tenders WHERE {_like('objekti_procedurave', 'que')} OR {_like('autoriteti_kontraktues', 'que')} OR {_like('kodi_cpv_raw', 'que')}
  ORDER BY data_iso DESC NULLS LAST, id DESC LIMIT 30 OFFSET 30) p LEFT JOIN last_one l ON l.tender_id = p.id""",
        "search_mode_page": with_(*CLASSIFIED, LABELS, LAST_ONE)
        + f"""SELECT p.id, {PAGE}, score, confidence, l.label AS latest_label FROM (
  SELECT t.*, score, confidence FROM c JOIN tenders t ON t.id = c.id WHERE near_miss_ok
  ORDER BY {TIER} DESC, score DESC, data_iso, t.id LIMIT 25) p LEFT JOIN last_one l ON l.tender_id = p.id""",
        "search_confidence_page": c
        + f"""SELECT t.id, {PAGE}, score, confidence FROM c JOIN tenders t ON t.id = c.id WHERE strict_ok AND confidence = 'low'
  ORDER BY {TIER} DESC, score DESC, data_iso DESC, t.id DESC LIMIT 10 OFFSET 10""",
        "search_fields_page": t
        + f"""SELECT id, {PAGE}, koha_zhvillimit FROM tenders WHERE {_like('autoriteti_kontraktues', 'autoriteti e')}
  AND {_like('kodi_cpv_raw', '7')} AND {_like('koha_zhvillimit', 'muaji 1')} ORDER BY data_iso, id LIMIT 100""",
        "search_indexed": t
        + f"""SELECT id, {PAGE} FROM tenders WHERE ({_like('objekti_procedurave', 'que')} OR {_like('autoriteti_kontraktues', 'que')}
  OR {_like('kodi_cpv_raw', 'que')}) AND {_like('autoriteti_kontraktues', 'iteti es')} AND {_like('kodi_cpv_raw', '12')}""",
        "search_indexed_page": with_(*CLASSIFIED, LABELS, LAST_ONE)
        + f"""SELECT p.id, {PAGE}, score, confidence, l.label AS latest_label FROM (
  SELECT t.*, score, confidence FROM c JOIN tenders t ON t.id = c.id WHERE broad_ok AND ({_like('objekti_procedurave', 'tion')}
    OR {_like('autoriteti_kontraktues', 'tion')} OR {_like('kodi_cpv_raw', 'tion')})
  ORDER BY {TIER} DESC, score DESC, data_iso, t.id LIMIT 25 OFFSET 25) p LEFT JOIN last_one l ON l.tender_id = p.id""",
        "search_deep_page": t
        + """SELECT position, id, data_iso, kodi_cpv_raw FROM (
  SELECT *, row_number() OVER (ORDER BY data_iso DESC NULLS LAST, id DESC) AS position, count(*) OVER () // 2 // 25 * 25 AS skipped FROM tenders)
WHERE position > skipped AND position <= skipped + 25""",
        "search_reviewer": with_(TENDERS, LABELS, LAST_ONE)
        + f"""SELECT id, autoriteti_kontraktues FROM tenders
WHERE id IN (SELECT tender_id FROM last_one WHERE {_like('reviewer', 'analyst 3')})""",
        "search_totals": c
        + f"""SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 25)) AS BIGINT) AS page_count FROM c JOIN tenders t ON t.id = c.id
WHERE broad_ok AND ({_like('objekti_procedurave', 'der')} OR {_like('autoriteti_kontraktues', 'der')} OR {_like('kodi_cpv_raw', 'der')})""",
        "tender_detail": with_(*CLASSIFIED, LABELS)
        + """SELECT t.id, objekti_procedurave, broad_ok, strict_ok, (
    SELECT string_agg(concat_ws(':', id, label, reviewer), ',' ORDER BY created_at DESC, id DESC)
    FROM (SELECT * FROM given WHERE tender_id = 9 ORDER BY created_at DESC, id DESC LIMIT 10)) AS analyst_labels
FROM tenders t JOIN c ON c.id = t.id WHERE t.id = 9""",
        "quality_metrics_by_mode": judged
        + f"SELECT *, {rates()} FROM (" + per_mode("judged", confusion("$")) + ")",
        "quality_tiers": judged
        + " UNION ALL ".join(
            f"SELECT '{tier}' AS confidence, {confusion('strict_ok', rows=chr(32) + f'AND confidence = {chr(39)}{tier}{chr(39)}')} FROM judged"
            for tier in ("high", "medium", "low")
        ),
        "score_histogram": judged
        + f"""SELECT printf('%02d-%02d', score // 10 * 10, least(score // 10 * 10 + 9, 100)) AS bucket, count(*) AS labels
FROM judged WHERE {used} GROUP BY 1""",
        "label_counts": judged
        + f"""SELECT count(*) AS labels_total, count(*) FILTER (WHERE {used}) AS labels_used_for_metrics,
  count(*) FILTER (WHERE label = 'maybe') AS labels_maybe_excluded FROM judged""",
        "mode_counts": judged
        + f"""SELECT count(*) FILTER (WHERE strict_ok AND {used}) AS strict, count(*) FILTER (WHERE broad_ok AND {used}) AS broad,
  count(*) FILTER (WHERE near_miss_ok AND {used}) AS near_miss FROM judged""",
        "calibration_compare": deltas + "SELECT * FROM deltas",
        "calibration_regressions": deltas + "SELECT mode, recall_delta FROM deltas WHERE recall_delta < 0",
        "calibration_changed": with_(*COMPARED)
        + f"""SELECT label_id, tender_id, label, before_score, before_confidence, before_strict_ok, before_near_miss_ok,
  after_score, after_confidence, after_strict_ok, after_near_miss_ok FROM compared WHERE {used} AND (before_score <> after_score
  OR before_confidence <> after_confidence OR before_strict_ok <> after_strict_ok OR before_near_miss_ok <> after_near_miss_ok)""",
        "drift_rows": drift + "SELECT * FROM drift",
        "drift_report": drift
        + """SELECT label_id, tender_id, snapshot_score, current_score, snapshot_strict_ok, current_strict_ok FROM (
  SELECT * FROM drift ORDER BY timestamp DESC, label_id DESC LIMIT 50)
WHERE snapshot_score <> current_score OR snapshot_confidence <> current_confidence OR snapshot_strict_ok <> current_strict_ok""",
        "export_broad": _exported("broad_ok", "broad_reasons"),
        "export_strict": _exported("strict_ok", "broad_reasons"),
        "export_near_miss": _exported("near_miss_ok AND broad_ok", "near_miss_reasons"),
        "near_miss_all": _exported("near_miss_ok", "near_miss_reasons"),
        "export_qc": c + f"{qc} UNION ALL {strict_qc}",
        "export_strict_qc": c + strict_qc,
        "export_counts": c
        + """SELECT count(*) AS "full", count(*) FILTER (WHERE broad_ok) AS software_broad, count(*) FILTER (WHERE strict_ok) AS software_strict,
  count(*) FILTER (WHERE broad_ok AND NOT strict_ok) AS excluded_from_strict, count(*) FILTER (WHERE near_miss_ok AND broad_ok) AS near_miss_rows,
  count(*) FILTER (WHERE broad_ok) + count(*) FILTER (WHERE mixed_ok) AS qc_rows FROM c""",
        "review_queue": c
        + f"""SELECT *, row_number() OVER (ORDER BY {queue}) AS position FROM (
  SELECT c.id, confidence AS software_confidence, CAST(score AS VARCHAR) AS software_match_score, data_iso, row_index_on_page
  FROM c JOIN tenders t ON t.id = c.id WHERE near_miss_ok AND broad_ok)""",
        "canonical_order": t
        + "SELECT id, data_iso, autoriteti_kontraktues, row_number() OVER (ORDER BY data_iso, id) AS position FROM tenders",
        "legacy_counts": c + f"{old_qc} UNION ALL {old_strict_qc}",
        "page_blocks": f"""SELECT page_id, CAST(position AS INTEGER) AS position, {_html_text('block', '')} AS content FROM (
  SELECT page_id, unnest(items) AS block, unnest(range(len(items))) AS position
  FROM (SELECT page_id, regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1) AS items FROM pages))""",
        "page_fields": "SELECT page_id, "
        + ", ".join(
            _html_text(rf"regexp_extract(html, '(?s)<{tag}\b[^>]*>(.*?)</{tag}>', 1)", " ") + f" AS {tag}" for tag in ("title", "h1")
        )
        + " FROM pages",
        "page_counters": t
        + """SELECT DISTINCT CAST(page_fetched AS BIGINT) AS page_id, CAST(page_fetched AS BIGINT) AS page_number,
  CAST(900 AS BIGINT) AS page_total FROM tenders""",
        "page_records": t
        + "SELECT "
        + ", ".join(
            f"{squeeze(f)} AS {f}"
            for f in (
                "objekti_procedurave", "autoriteti_kontraktues", "burimi_financimit", "fondi_limit_raw", "fondi_limit_lek",
                "data_publikimit", "ora_publikimit", "data_iso", "viti", "koha_zhvillimit", "kodi_cpv_raw", "cpv_spans",
                "tipi_procedures", "anulluar", "page_fetched", "row_index_on_page",
            )
        )
        + " FROM tenders",
        "bootstrap_ingest": with_(TENDERS, HASHED, loaded("base", "viti = '2025'")) + stored,
        "daily_ingest": with_(
            TENDERS,
            HASHED,
            loaded("base", "data_iso <= '2024-06-01'"),
            f"batch AS ({first_of('hashed', half_year)})",
            f"fresh AS (SELECT (SELECT max(nr) FROM base) + row_number() OVER (ORDER BY {ARRIVAL}, source_hash) AS nr, * "
            "FROM batch WHERE source_hash NOT IN (SELECT source_hash FROM base))",
        )
        + f"""SELECT nr AS id, {STORED}, '2024-06-01 00:00:00' AS first_seen_at,
  CASE WHEN source_hash IN (SELECT source_hash FROM batch) THEN '2024-06-30 12:00:00' ELSE '2024-06-01 00:00:00' END AS last_seen_at FROM base
UNION ALL SELECT nr, {STORED}, '2024-06-30 12:00:00', '2024-06-30 12:00:00' FROM fresh""",
        "run_metrics": with_(TENDERS, HASHED, loaded("base", "viti = '2025'"), NORMAL, classified(CURRENT_RULES, "c"), LABELS, LAST_TIES)
        + f"""SELECT (SELECT count(DISTINCT page_fetched) FROM tenders) AS pages_visited, (SELECT count(*) FROM tenders) AS rows_parsed,
  (SELECT count(*) FROM base) AS rows_inserted,
  (SELECT count(*) FROM tenders WHERE viti = '2025') - (SELECT count(*) FROM base) AS duplicates_skipped,
  CAST(0 AS BIGINT) AS failures_retries, count(*) AS export_full, count(*) FILTER (WHERE broad_ok) AS export_software_broad,
  count(*) FILTER (WHERE strict_ok) AS export_software_strict, count(*) AS validate_total_full,
  count(*) FILTER (WHERE broad_ok) AS validate_broad, count(*) FILTER (WHERE strict_ok) AS validate_strict,
  CAST(0 AS BIGINT) AS validate_invariant_violations, (SELECT count(*) FROM last_ties) AS feedback_labels_total,
  (SELECT count(*) FROM last_ties WHERE {used}) AS feedback_labels_used
FROM c JOIN base b ON b.id = c.id""",
        "streaming_upsert": with_(TENDERS, HASHED, loaded("base", "TRUE")) + stored,
        "streaming_resume": with_(TENDERS, HASHED, loaded("base", "TRUE")) + stored,
        "store_merge": merged("2024-06-02 00:00:00"),
        "streaming_daily": with_(
            TENDERS,
            HASHED,
            loaded("base", "data_iso <= '2024-06-01'"),
            f"batch AS ({first_of('hashed', half_year)})",
            f"fresh AS (SELECT (SELECT max(nr) FROM base) + row_number() OVER (ORDER BY {ARRIVAL}, source_hash) AS nr, * "
            "FROM batch WHERE source_hash NOT IN (SELECT source_hash FROM base))",
        )
        + f"""SELECT nr AS id, {STORED}, '2024-06-01 00:00:00' AS first_seen_at,
  CASE WHEN source_hash IN (SELECT source_hash FROM batch) THEN '2024-06-30 12:00:00' ELSE '2024-06-01 00:00:00' END AS last_seen_at FROM base
UNION ALL SELECT nr, {STORED}, '2024-06-30 12:00:00', '2024-06-30 12:00:00' FROM fresh""",
        "streaming_dedupe": with_(TENDERS, HASHED).rstrip()
        + """, seen AS (
  SELECT source_hash, bool_or(id % 4 = 0) AS h0, bool_or(id % 4 = 1) AS h1, bool_or(id % 4 = 2) AS h2, bool_or(id % 4 = 3) AS h3
  FROM hashed WHERE NOT (id % 4 = 3 AND id % 50 = 7) GROUP BY 1),
first_two AS (SELECT *, h1 AND NOT h0 AS k1 FROM seen),
three AS (SELECT *, h2 AND NOT k1 AS k2 FROM first_two)
SELECT source_hash, 0 AS part FROM three WHERE h0 UNION ALL SELECT source_hash, 1 FROM three WHERE k1
UNION ALL SELECT source_hash, 2 FROM three WHERE k2 UNION ALL SELECT source_hash, 3 FROM three WHERE h3 AND NOT k2""",
    }

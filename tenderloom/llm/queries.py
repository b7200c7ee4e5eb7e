"""The registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tenderloom.llm import bpe, chaining, gridjoin, hyperminhash, langid, lexical, packing, pii, raking, suffixes, topk, urls, variants
from tenderloom.llm.common import table


def byte_bpe_path() -> str:
    """Where the public byte-level vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def word_bpe_path() -> str:
    """Where the public vocabulary with word ends lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), byte_bpe_path())


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_of(table(spark, sf_dir, "documents"))


def op3_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, threshold=0.85)


def op4_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridjoin.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymised(docs, pii.session_key(spark))


def op6_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raking.mix(table(spark, sf_dir, "documents"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


def op9_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.classed_passages(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op11_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), word_bpe_path(), end_id=2)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def op13_k2_treap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_bpe, op2_language_id, op3_hyperminhash, op4_grid_join, op5_surrogates,
        op6_raking, op7_top_k, op8_suffix_array, op9_chaining, op10_url_filter,
        op11_vector_packing, op12_spelling_variants, op13_k2_treap,
    )
    return {f.__name__: f for f in own}


# The exact self-joins on small tables; they grow with the square of the input.
OP3_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * c >= 85 * (p.n + q.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, e.y FROM reach r JOIN edges e ON e.x = r.b),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN comp c USING (doc_id)
"""

OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (
  SELECT vec_id, label, e FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.y FROM reach r JOIN links l ON l.x = r.b),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1),
deg AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e LEFT JOIN deg d USING (vec_id) JOIN comp c USING (vec_id)
"""

OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r, vec_id, score FROM scored)
SELECT query_id, r::INTEGER AS rank, vec_id, score FROM ranked WHERE r <= 5
"""


# DuckDB has no crc32: the table comes from the polynomial, and a fold over the bytes of id, colon and word gives the sum.
# Letters below U+0100 are one or two bytes of UTF-8. Near words share a text with one place left out.
OP12_SQL = """
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{00C0}-\\x{00FF}]{7,}')) AS r
  FROM documents),
found AS (SELECT d, r, count(*) AS c FROM runs GROUP BY 1, 2),
bytes AS (
  SELECT d, r, c, list_concat([4294967295::BIGINT], flatten(list_transform(regexp_extract_all(d || ':' || r, '(?s).'), lambda x:
    CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, (unicode(x) - 64)::BIGINT] END))) AS b
  FROM found),
summed AS (
  SELECT r, c, xor(list_reduce(b, lambda s, x: xor(s >> 8, t[(xor(s, x) & 255) + 1])), 4294967295) AS h
  FROM bytes, crc),
slipped AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(r, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS word, c FROM summed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM slipped WHERE length(word) >= 7 GROUP BY 1 HAVING sum(c) >= 2),
places AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
gaps AS (SELECT word, n, i, left(word, i::INT) || substr(word, i::INT + 2) AS g FROM places),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b ON a.g = b.g AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gaps a JOIN words b ON a.g = b.word
  UNION SELECT b.word, a.word, a.n FROM gaps a JOIN words b ON a.g = b.word),
ranked AS (
  SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS k, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS p
  FROM near),
judged AS (
  SELECT w.word, w.n, coalesce(r.k, 0) AS n_near, CASE WHEN r.other_n >= 10 * w.n THEN r.other END AS form,
    CASE WHEN r.other_n >= 10 * w.n THEN r.other_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.p = 1),
ways AS (
  SELECT word, word AS at FROM judged UNION ALL SELECT w.word, j.form FROM ways w JOIN judged j ON j.word = w.at WHERE j.form IS NOT NULL)
SELECT j.word, j.form, w.at AS root, j.n, j.n_near, j.form_n
FROM judged j JOIN ways w ON w.word = j.word JOIN judged e ON e.word = w.at WHERE e.form IS NULL
"""


OP13_SQL = """
WITH found AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents),
sizes AS (SELECT r, doc_id, len(terms)::BIGINT AS n, terms FROM found WHERE len(terms) > 0),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM sizes),
counted AS (SELECT r, doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS t FROM sizes) GROUP BY ALL),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t
  FROM benchmark),
weights AS (
  SELECT t, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT t, count(*)::BIGINT AS df FROM counted GROUP BY 1), whole),
scored AS (
  SELECT a.item_id, c.r, c.doc_id, sum(w.w * ((1000000000 * c.tf) // (1000 * c.tf + 20 * (100 - 50 + (50 * c.n * docs) // total))))::BIGINT AS score
  FROM asked a JOIN weights w USING (t) JOIN counted c USING (t), whole GROUP BY 1, 2, 3),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, k::INTEGER AS rank, doc_id, score FROM ranked WHERE k <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_hyperminhash": OP3_SQL, "op4_grid_join": OP4_SQL, "op7_top_k": OP7_SQL, "op12_spelling_variants": OP12_SQL, "op13_k2_treap": OP13_SQL}

"""The operators' queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, html_text, jaccard_join, licenses, mixing, multi_index, packing, quality_model, quality_rules, spelling, substring_dedup, suffix_tree_lm, vector_codes
from .common import documents


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.linked(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(documents(spark, sf_dir))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scanned(documents(spark, sf_dir))
    best = F.array_max(F.transform("found", lambda x: x["dice"]))
    return found.select(
        "doc_id", F.get(F.filter("found", lambda x: x["dice"] == best), F.lit(0))["license"].alias("license"),
        best.alias("dice"), F.size("found").alias("n_found"),
        F.array_sort(F.array_distinct(F.transform("found", lambda x: x["license"]))).alias("licenses"),
    )


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op8_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.scored(documents(spark, sf_dir))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_report(documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir))


def op11_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.grouped(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_embedding_dedup, op2_html_text, op3_jaccard_join, op4_quality_rules, op5_license_scan, op6_quality_model,
        op7_mixing, op8_suffix_tree_lm, op9_substring_dedup, op10_packing, op11_multi_index,
        op12_vector_codes, op13_spelling,
    )
}

_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOW = _WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

#: The smallest node reachable by links (a, b), both ways listed, for each node of nodes (id).
_COMPONENTS = """
  reach(id, c) AS (
    SELECT id, id FROM nodes
    UNION
    SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.id WHERE r.c < l.b
  ),
  component AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id)
"""


def _lloyd() -> str:
    """Codebooks b0, b1, b2, each the entries moved to the whole means of the parts nearest to them."""
    near = """
  near{k} AS MATERIALIZED (
    SELECT pos, part, min(d * 64 + i) % 64 AS i, min(d * 64 + i) // 64 AS d FROM (
      SELECT u.pos, u.part, b.i, CAST(list_sum(list_transform(range(1, len(u.part) + 1), lambda j: (u.part[j] - b.part[j]) * (u.part[j] - b.part[j]))) AS BIGINT) AS d
      FROM (SELECT DISTINCT pos, part FROM parts) u JOIN b{k} b ON b.pos = u.pos
    ) GROUP BY pos, part
  )"""
    moved = """
  sums{k} AS (
    SELECT pos, i, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
      SELECT p.pos, a.i, unnest(range(1, len(p.part) + 1)) AS j, unnest(p.part) AS x FROM parts p JOIN near{k} a ON a.pos = p.pos AND a.part = p.part
    ) GROUP BY pos, i, j
  ),
  means{k} AS (SELECT pos, i, list((s - ((s % n) + n) % n) // n ORDER BY j) AS part FROM sums{k} GROUP BY pos, i),
  b{m} AS MATERIALIZED (SELECT b.pos, b.i, coalesce(m.part, b.part) AS part FROM b{k} b LEFT JOIN means{k} m ON m.pos = b.pos AND m.i = b.i)"""
    return ",".join([near.format(k=0), moved.format(k=0, m=1), near.format(k=1), moved.format(k=1, m=2), near.format(k=2)])


#: Unsigned crc32 of the bytes of s, by the table of its 256 steps.
_CRC = """(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], list_transform(range(1, len(hex(encode(s))) // 2 + 1),
  lambda i: CAST('0x' || substr(hex(encode(s)), 2 * i - 1, 2) AS UBIGINT))), lambda c, x: xor(c >> 8, steps[CAST((xor(c, x) & 255) + 1 AS BIGINT)])))"""
_STEP = "list_reduce(list_concat([CAST(i AS UBIGINT)], list_transform(range(8), lambda k: CAST(k AS UBIGINT))), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"

SQL: dict[str, str] = {
    "op1_embedding_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  nodes AS (SELECT vec_id AS id FROM v),
  links AS MATERIALIZED (
    SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id
    WHERE list_dot_product(x.e, y.e) >= 0.9e0 * sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))
  ),
{_COMPONENTS}
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id) AS n_links, component_id, id = component_id AS kept FROM component
""",
    "op3_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_LOW} AS w FROM documents),
  grams AS MATERIALIZED (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w
  ),
  sizes AS MATERIALIZED (SELECT doc_id, len(s) AS n FROM grams),
  tokens AS MATERIALIZED (SELECT doc_id, unnest(s) AS t FROM grams),
  common AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM tokens x JOIN tokens y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY ALL
  ),
  links AS MATERIALIZED (
    SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)
  ),
  nodes AS (SELECT doc_id AS id FROM documents),
{_COMPONENTS}
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, component_id FROM sizes s JOIN component ON id = s.doc_id
""",
    "op9_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
  starts AS (
    SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ' '))) AS g FROM w
  ),
  later AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM starts) WHERE r > 1
  ),
  gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
  lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
  kept AS (
    SELECT w.doc_id, w.w, CASE WHEN ps IS NULL THEN w.w
      ELSE list_transform(list_filter(range(1, len(w.w) + 1), lambda p: NOT list_contains(ps, p)), lambda p: w.w[p]) END AS k
    FROM w LEFT JOIN lists ON lists.doc_id = w.doc_id
  )
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(k) AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
""",
    "op12_vector_codes": f"""
WITH kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  ),
  cuts AS (SELECT vec_id, label, v, unnest(range(16)) AS pos FROM kept),
  parts AS MATERIALIZED (SELECT vec_id, label, pos, v[pos * (len(v) // 16) + 1:(pos + 1) * (len(v) // 16)] AS part FROM cuts),
  first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM kept ORDER BY vec_id LIMIT 64),
  b0 AS MATERIALIZED (SELECT pos, i, part FROM parts JOIN first USING (vec_id)),
  {_lloyd()},
  coded AS (
    SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', a.i), '' ORDER BY p.pos) AS code, CAST(sum(a.d) AS BIGINT) AS error
    FROM parts p JOIN near2 a ON a.pos = p.pos AND a.part = p.part GROUP BY vec_id
  )
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY pos, i)) FROM b2) AS codebooks_sha256
FROM coded
""",
    "op13_spelling": f"""
WITH RECURSIVE steps AS (SELECT list(s ORDER BY i) AS steps FROM (SELECT i, {_STEP} AS s FROM range(256) t(i))),
  found AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run
    FROM documents WHERE text IS NOT NULL
  ),
  runs AS (SELECT doc_id, run, doc_id || ':' || run AS s, count(*) AS n FROM found WHERE length(run) >= 7 GROUP BY ALL),
  hashed AS MATERIALIZED (SELECT run, n, xor({_CRC}, 4294967295) AS h FROM runs, steps),
  spoilt AS (
    SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed
  ),
  words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spoilt WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
  cut AS MATERIALIZED (
    SELECT DISTINCT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
  ),
  near AS MATERIALIZED (
    SELECT DISTINCT x.word AS a, y.word AS b FROM cut x JOIN cut y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
    UNION SELECT word, rest FROM cut WHERE rest IN (SELECT word FROM words)
    UNION SELECT rest, word FROM cut WHERE rest IN (SELECT word FROM words)
  ),
  ranked AS (
    SELECT a, b, n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r
    FROM near JOIN words ON word = b
  ),
  forms AS MATERIALIZED (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN k.n >= 10 * w.n THEN b END AS form, CASE WHEN k.n >= 10 * w.n THEN k.n END AS form_n
    FROM words w LEFT JOIN ranked k ON k.a = w.word AND r = 1
  ),
  chain AS (
    SELECT word, coalesce(form, word) AS at FROM forms
    UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.at WHERE f.form IS NOT NULL AND c.at <> c.word
  )
SELECT f.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n
FROM forms f JOIN (SELECT c.word, c.at AS root FROM chain c JOIN forms g ON g.word = c.at WHERE g.form IS NULL) c ON c.word = f.word
""",
}

"""The registered queries of this subpackage: one per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.llm import decontaminate, language, lm_score, mixing, near_dup, quality, repeats, resample, secret_scan, token_count, token_file, url_filter, vector_codes
from bidloom.llm.common import table
from bidloom.session import scratch_dir

# Folder of the public vocabulary files; the same on every machine.
TOKENIZERS = "/opt/tokenizers"
Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    try:
        import public_tokenizers
    except ImportError:
        return f"{TOKENIZERS}/{name}"
    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf, "pages"), table(spark, sf, "labels"))


def op2_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf, "documents"))


def op3_repeated_passages(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.find_repeats(table(spark, sf, "documents"))


def op4_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return near_dup.near_groups(table(spark, sf, "documents"), shingle=2)


def op5_lm_scores(spark: SparkSession, sf: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf, "documents"))


def op6_benchmark_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op7_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    counts = [c for c in quality.COUNTS if c not in ("n_lines", "n_distinct_words", "n_ended_lines", "n_upper")]
    judged = quality.judge(table(spark, sf, "documents").select("doc_id", "text").withColumn("n_chars", F.length("text")))
    return judged.select("doc.doc_id", *counts, "base_failed", F.col("quality").alias("posterior"), "kept")


def op8_token_file(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark, "tokens")
    token_file.write_tokens(table(spark, sf, "documents"), vocabulary("byte_bpe_50k.json"), path)
    return token_file.read_tokens(spark, path)


def op9_mixing(spark: SparkSession, sf: str) -> DataFrame:
    taken = (F.col("size") * F.col("copies")).cast("long").alias("taken")
    return mixing.mix_rates(table(spark, sf, "documents")).select("doc.doc_id", "size", "source_size", "target", taken)


def op10_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf, "documents"), vocabulary("piece_bpe_32k.model"))


def op11_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    return vector_codes.encode_with_errors(table(spark, sf, "embeddings"))


def op12_language(spark: SparkSession, sf: str) -> DataFrame:
    return language.predict(table(spark, sf, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op13_target_resampling(spark: SparkSession, sf: str) -> DataFrame:
    drawn = resample.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_url_filter,
        op2_secret_scan,
        op3_repeated_passages,
        op4_near_duplicates,
        op5_lm_scores,
        op6_benchmark_leaks,
        op7_quality_rules,
        op8_token_file,
        op9_mixing,
        op10_token_counts,
        op11_vector_codes,
        op12_language,
        op13_target_resampling,
    )
}

def _vector_codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """All rounds as common tables: v (vec_id, p, x), c0..c4 (p, e, c), a0..a4 (vec_id, p, e, d)."""
    head = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
v AS MATERIALIZED (SELECT vec_id, p, x[p * len(x) // {parts} + 1:(p + 1) * len(x) // {parts}] AS x FROM kept, range({parts}) r(p)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {entries}),
c0 AS MATERIALIZED (SELECT p, e, x AS c FROM first JOIN v USING (vec_id))"""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, p, min_by({{'e': e, 'd': d}}, d * {entries} + e) AS n
  FROM (SELECT vec_id, v.p, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v JOIN c{r} USING (p))
  GROUP BY vec_id, p)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (
  SELECT p, e, list(floor(s::DOUBLE / n)::BIGINT ORDER BY i) AS c
  FROM (
    SELECT p, e, i, sum(x[i]) AS s, count(*) AS n
    FROM (SELECT v.p, a{r}.n.e AS e, x, unnest(range(1, len(x) + 1)) AS i FROM v JOIN a{r} USING (vec_id, p)) GROUP BY ALL)
  GROUP BY p, e),
c{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (p, e))""")
    tail = f"""
coded AS (
  SELECT vec_id, string_agg(format('{{:02x}}', n.e), '' ORDER BY p) AS code, sum(n.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM c{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""
    return ",".join([head, *steps, tail])


_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

SQL: dict[str, str] = {
    "op4_near_duplicates": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
component AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN component c USING (doc_id)""",
    "op9_mixing": rf"""
WITH d AS (SELECT doc_id, source, {_WORDS}::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
l AS (
  SELECT *, sum(source_size) OVER () AS all_size,
    coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS size_before,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_left
  FROM w),
f AS (
  SELECT size_before, weight_left FROM l
  WHERE (1.5::DOUBLE * all_size - 2 * size_before)::DOUBLE / weight_left::DOUBLE * weight <= 2 * source_size
  ORDER BY size_before, weight_left DESC LIMIT 1),
t AS (
  SELECT source, source_size,
    coalesce(least((1.5::DOUBLE * all_size - 2 * f.size_before)::DOUBLE / f.weight_left::DOUBLE * weight, (2 * source_size)::DOUBLE), (2 * source_size)::DOUBLE) AS target
  FROM l LEFT JOIN f ON true),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(t.target / nullif(t.source_size, 0), 0) AS rate,
    ('0x' || substr(md5('mix:' || d.doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r""",
    "op11_vector_codes": _vector_codes_sql(),
    "op13_target_resampling": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f
  FROM benchmark),
o AS (SELECT doc_id, f, count(*) AS n FROM (SELECT doc_id, unnest(w) AS f FROM w) GROUP BY ALL),
k AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS k
  FROM range(256) t(i)),
v AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM o UNION SELECT f FROM b)),
crc AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i::INT + 1, 2))::BIGINT)),
    lambda c, x: xor(c >> 8, k[1 + (xor(c, x) & 255)])), 4294967295) % 10000 AS bucket
  FROM v, k),
s AS (SELECT bucket, sum(n) AS s FROM o JOIN crc USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN crc USING (f) GROUP BY bucket),
g AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * (coalesce((SELECT sum(s) FROM s), 0) + 10000))::DOUBLE
    / ((coalesce(s, 0) + 1) * (coalesce((SELECT sum(t) FROM t), 0) + 10000))::DOUBLE))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket)),
weights AS (SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM o JOIN crc USING (f) JOIN g USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))))::BIGINT AS score
  FROM w LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.*, CASE WHEN r.rank <= r.n * 10 // 100 THEN r.rank END AS rank
FROM scored s LEFT JOIN ranked r USING (doc_id)""",
}

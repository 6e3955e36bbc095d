"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: query: module that holds it.
WHERE = {
    "op1_language_id": "language",
    "op2_simhash_near_dedup": "simhash",
    "op3_suffix_array_dedup": "suffix",
    "op4_pii": "pii",
    "op5_best_fit_packing": "packing",
    "op6_token_counts": "tokens",
    "op7_media_tiff": "tiff",
    "op8_html_extraction": "html",
    "op9_bpe_round_trip": "tokens",
    "op10_embedding_near_dedup": "embedding",
    "op11_cross_tokenizer_alignment": "align",
    "op12_periodic_runs": "periodic",
    "op13_sharding": "sharding",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def of(name: str) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: getattr(importlib.import_module(f"{__package__}.{WHERE[name]}"), name)(spark, sf_dir)

    return {name: of(name) for name in WHERE} | {"pipeline": pipeline}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


#: The other operators have no equal in SQL: hashes, models, codecs and packings. op3 tells windows by their MD5 here; op12 joins equal words of
#: a text, and CRC-32 is a sum over bits.
ORACLE = {
    "op12_periodic_runs": """WITH d AS (SELECT row_number() OVER () AS k, doc_id, CAST(doc_id AS VARCHAR) AS s, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
h AS (SELECT *, len(w) AS n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), range(0, 8 * len(s))), lambda c, j: xor(xor(c, CASE WHEN j % 8 = 0 THEN ascii(s[j // 8 + 1]) ELSE 0 END) >> 1,
  3988292384 * (xor(c, CASE WHEN j % 8 = 0 THEN ascii(s[j // 8 + 1]) ELSE 0 END) & 1))), CAST(4294967295 AS BIGINT)) AS h FROM d),
a AS (SELECT *, h % 10 = 0 AND n > 0 AS planted, h // 10 % greatest(n, 1) AS a, 3 + h // 10 % 8 AS c FROM h),
v AS (SELECT k, doc_id, n, CASE WHEN planted THEN list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // c) + 1] END) ELSE w END AS w FROM a),
words AS (SELECT k, n, unnest(range(0, n)) AS i, unnest(w) AS w FROM v),
same AS (SELECT x.k, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.k = y.k AND x.w = y.w AND y.i > x.i AND y.i - x.i <= x.n // 3),
lags AS (SELECT k, q FROM same GROUP BY k, q HAVING count(*) >= greatest(24 - q, 2 * q)),
isles AS (SELECT k, q, i, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS g FROM same SEMI JOIN lags USING (k, q)),
found AS (SELECT k, q, min(i) AS start, count(*) + q AS length FROM isles GROUP BY k, q, g HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS (SELECT k, start, length, min(q) AS period FROM found GROUP BY k, start, length),
best AS (SELECT k, start, length, period FROM runs QUALIFY row_number() OVER (PARTITION BY k ORDER BY length / period DESC, start, period) = 1),
told AS (SELECT k, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS said FROM runs GROUP BY k),
gone AS (SELECT DISTINCT r.k, i FROM (SELECT k, unnest(range(start + period, start + length)) AS i FROM runs) r),
kept AS (SELECT k, string_agg(w, ' ' ORDER BY i) AS said FROM words ANTI JOIN gone USING (k, i) GROUP BY k)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(told.said, '')) AS runs_sha256, sha256(coalesce(kept.said, '')) AS collapsed_sha256
FROM v LEFT JOIN best USING (k) LEFT JOIN told USING (k) LEFT JOIN kept USING (k)""",
    "op3_suffix_array_dedup": """WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT k, i, md5_number(substr(h, 2 * i + 1, 400)) AS s FROM d, unnest(range(0, len(h) // 2 - 199)) AS u(i)),
again AS (SELECT s FROM w GROUP BY s HAVING count(*) > 1),
hits AS (SELECT k, i FROM w WHERE s IN (SELECT s FROM again)),
runs AS (SELECT k, i, sum(new) OVER (PARTITION BY k ORDER BY i) AS r FROM (SELECT k, i, CASE WHEN i - lag(i) OVER (PARTITION BY k ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM hits)),
spans AS (SELECT k, min(i) AS a, max(i) + 200 AS b FROM runs GROUP BY k, r),
gaps AS (SELECT k, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) AS a, a AS b FROM spans UNION ALL SELECT k, max(b), NULL FROM spans GROUP BY k),
kept AS (SELECT k, string_agg(CASE WHEN g.b IS NULL THEN substr(h, 2 * g.a + 1) ELSE substr(h, 2 * g.a + 1, 2 * (g.b - g.a)) END, '' ORDER BY g.a, g.b NULLS LAST) AS h FROM gaps g JOIN d USING (k) GROUP BY k),
n AS (SELECT k, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY k)
SELECT doc_id, len(d.h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256 FROM d LEFT JOIN kept USING (k) LEFT JOIN n USING (k)""",
    "op10_embedding_near_dedup": """WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 95e-2),
r(vec_id, low) AS (SELECT vec_id, vec_id FROM v UNION SELECT p.b, r.low FROM r JOIN p ON p.a = r.vec_id)
SELECT r.vec_id, coalesce(any_value(l.n), 0) AS n_links, min(low) AS component_id, min(low) = r.vec_id AS kept
FROM r LEFT JOIN (SELECT a, count(*) AS n FROM p GROUP BY a) l ON l.a = r.vec_id GROUP BY r.vec_id""",
}


def oracle_sql() -> dict[str, str]:
    return ORACLE

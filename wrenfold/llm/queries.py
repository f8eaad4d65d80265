"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wrenfold.llm import crossparse, decontaminate, kdclusters, licenses, merkle, ngramjoin, ogg, packing, prefixtrie, sharding, suffixdedup, toxicity, windowdedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return merkle.audit(pages, merkle.aged_replica(pages))


def op3_best_fit_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), shards=24)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.dedup_substrings(_table(spark, sf_dir, "documents"))


def op6_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_columns(_table(spark, sf_dir, "documents"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=85)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.recognise(_table(spark, sf_dir, "documents"))


def op10_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowdedup.dedup_windows(_table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(_table(spark, sf_dir, "conversations"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdclusters.cluster(_table(spark, sf_dir, "embeddings"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossparse.predict_languages(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination, op2_warc_fixity, op3_best_fit_sharding, op4_best_fit_packing, op5_suffix_array_dedup,
        op6_ogg_media, op7_ngram_jaccard_join, op8_toxicity, op9_license_rules, op10_window_dedup, op11_conversation_trie, op12_centroid_clusters, op13_language_id,
    )
}

_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_WORD = r"'[^\x20\x09-\x0D]+'"

ORACLE_SQL: dict[str, str] = {
    "op2_warc_fixity": merkle.oracle_sql(),
    "op9_license_rules": licenses.oracle_sql(),
    "op11_conversation_trie": prefixtrie.oracle_sql(),
    "op12_centroid_clusters": kdclusters.oracle_sql(),
    "op1_benchmark_decontamination": f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_ASCII_LOWER}, {_ALNUM}) AS ws FROM benchmark),
win AS (SELECT DISTINCT item, least(len(ws), 13) AS n, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') AS w
        FROM (SELECT item, ws, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS i FROM item WHERE len(ws) > 0)),
doc AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER}, {_ALNUM}) AS ws FROM documents),
lens AS (SELECT DISTINCT n FROM win),
cand AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS w
         FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM doc, lens WHERE len(ws) >= n)),
hit AS (SELECT doc_id, cand.n, i, item FROM cand JOIN win ON cand.w = win.w AND cand.n = win.n),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op5_suffix_array_dedup": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents),
win AS (SELECT doc_id, i, md5(b[i + 1:i + 200]) AS h FROM (SELECT doc_id, b, unnest(range(0, n_bytes - 199)) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM win) WHERE n > 1),
mark AS (SELECT doc_id, i, CASE WHEN i > 200 + lag(i) OVER (PARTITION BY doc_id ORDER BY i) THEN 1 ELSE 0 END AS head FROM again),
run AS (SELECT doc_id, min(i) AS lo, max(i) + 200 AS hi FROM (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM mark) GROUP BY doc_id, k),
gone AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM run GROUP BY 1),
stay AS (SELECT doc_id, hi AS lo, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) AS hi FROM run UNION ALL SELECT doc_id, 0, min(lo) FROM run GROUP BY 1),
kept AS (SELECT doc_id, sha256(unhex(string_agg(hex(b[stay.lo + 1:coalesce(stay.hi, n_bytes)]), '' ORDER BY stay.lo))) AS sha FROM stay JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, coalesce(sha, sha256(b)) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op7_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER}, {_WORD}) AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
m AS (SELECT x, min(y) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents LEFT JOIN n USING (doc_id) JOIN m ON x = doc_id""",
    "op10_window_dedup": f"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS ws FROM documents),
win AS (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS nth
        FROM (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM doc WHERE len(ws) >= 20))),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM win WHERE nth > 1),
word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS j, unnest(ws) AS word FROM doc),
runs AS (SELECT g.doc_id, count(*) AS n FROM gone g LEFT JOIN gone p ON g.doc_id = p.doc_id AND p.j = g.j - 1 WHERE p.j IS NULL GROUP BY g.doc_id),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256,
       CAST(coalesce(runs.n, 0) AS BIGINT) AS n_intervals
FROM doc LEFT JOIN kept USING (doc_id) LEFT JOIN runs USING (doc_id)""",
}

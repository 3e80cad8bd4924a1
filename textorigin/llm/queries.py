"""The registered queries of this subpackage, by name, and the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, compression, decontamination, language_model, lines, minhash, mixing, sharding, simhash, subvectors, tokens, toxicity, weak_supervision

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    """The vocabulary file; every executor has the package that holds it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def splits(spark: SparkSession) -> int:
    """Number of output files: that of the session's shuffle partitions, which is set to fit the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def op1_benchmark_decontamination(spark, sf_dir):
    return decontamination.op1(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality_classifier(spark, sf_dir):
    return compression.op2(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_minhash_near_dedup(spark, sf_dir):
    return minhash.op3(table(spark, sf_dir, "documents"))


def op4_sharding(spark, sf_dir):
    return sharding.op4(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark, sf_dir):
    return weak_supervision.op5(table(spark, sf_dir, "documents"))


def op6_toxicity(spark, sf_dir):
    return toxicity.op6(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_output(spark, sf_dir):
    return tokens.tokens(table(spark, sf_dir, "documents"), tokenizer_path(), splits(spark))


def op8_source_mixing(spark, sf_dir):
    return mixing.op8(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark, sf_dir):
    return lines.op9(table(spark, sf_dir, "documents"))


def op10_language_model(spark, sf_dir):
    return language_model.op10(table(spark, sf_dir, "documents"))


def op11_tokenizer_alignment(spark, sf_dir):
    return alignment.op11(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path(PIECES))


def op12_simhash_near_dedup(spark, sf_dir):
    return simhash.op12(table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark, sf_dir):
    return subvectors.op13(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination, op2_quality_classifier, op3_minhash_near_dedup, op4_sharding, op5_quality_rules, op6_toxicity, op7_token_output,
        op8_source_mixing, op9_substring_dedup, op10_language_model, op11_tokenizer_alignment, op12_simhash_near_dedup, op13_centroid_clustering,
    )
}

#: words of a text as an array, lower-cased for A-Z only
WORDS = "regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{1}')"
ITEM_WORD, ANY_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+"



def _clusters(rounds: int = 3, clusters: int = 16) -> str:
    """SQL of the centroid clustering: one step per round, each a cross product of vectors with the few centroids."""
    near = """d{0} AS MATERIALIZED (SELECT r, vec_id, e, k, list_sum(list_transform(list_zip(e, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{0}),
a{0} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(e) AS e, min(struct_pack(d := d, k := k)) AS best FROM d{0} GROUP BY r),
"""
    move = """s{0} AS (SELECT k, i, sum(x) AS s, count(*) AS n FROM (SELECT best.k AS k, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a{0}) GROUP BY k, i),
m{0} AS (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM s{0} GROUP BY k),
c{1} AS MATERIALIZED (SELECT k, coalesce(m.c, o.c) AS c FROM c{0} AS o LEFT JOIN m{0} AS m USING (k)),
"""
    steps = "".join(near.format(j) + (move.format(j, j + 1) if j < rounds else "") for j in range(rounds + 1))
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, e) - 1 AS k, e AS c FROM v QUALIFY k < {clusters}),
{steps}t AS (SELECT best.k AS k, sum(best.d)::BIGINT AS cluster_inertia FROM a{rounds} GROUP BY 1)
SELECT vec_id, CAST(best.k AS INTEGER) AS cluster, best.d AS distance, cluster_inertia, (SELECT sum(cluster_inertia) FROM t)::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN t ON t.k = best.k JOIN c{rounds} AS c ON c.k = best.k
"""


ORACLES: dict[str, str] = {
    "op1_benchmark_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format("text", ITEM_WORD)} AS w FROM documents),
i AS (SELECT item_id, {WORDS.format("text", ITEM_WORD)} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS win
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS win
       FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT r, k, dw.n, item_id FROM dw JOIN win ON dw.n = win.n AND dw.win = win.win),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(k, k + n - 1)) AS p FROM hit) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN named USING (r)
""",
    "op3_minhash_near_dedup": f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format("text", ANY_WORD)} AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[k:k + 2], ' ') AS g FROM (SELECT r, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM s AS a JOIN s AS b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n AS x ON x.r = a JOIN n AS y ON y.r = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT r AS a, doc_id AS c FROM d UNION SELECT u.b, reach.c FROM reach JOIN u ON u.a = reach.a),
m AS (SELECT a, min(c) AS c FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, doc_id IS NOT DISTINCT FROM c AS kept FROM d JOIN m ON m.a = d.r LEFT JOIN n USING (r)
""",
    "op9_substring_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
c AS (SELECT r, doc_id, regexp_extract_all(text, '[{lines.WHITE}]*{lines.UNITS["sentence"]}') AS p FROM d WHERE text IS NOT NULL),
u AS (SELECT r, doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS k FROM c),
n AS (SELECT *, {WORDS.format("piece", ANY_WORD)} AS w, length(piece) - length(regexp_replace(piece, '^[{lines.WHITE}]+', '')) AS lead,
             CAST(sum(length(piece)) OVER (PARTITION BY r ORDER BY k) AS BIGINT) AS stop FROM u),
m AS (SELECT *, row_number() OVER (PARTITION BY array_to_string(w, ' ') ORDER BY doc_id NULLS LAST, r, k) > 1 AS again FROM n),
i AS (SELECT *, k - row_number() OVER (PARTITION BY r, again ORDER BY k) AS island FROM m),
g AS (SELECT *, again AND sum(len(w)) OVER (PARTITION BY r, again, island) >= {lines.RUN_WORDS} AS gone FROM i),
t AS (SELECT r, coalesce(string_agg(piece, '' ORDER BY k) FILTER (NOT gone), '') AS kept, max(stop) AS tail, count(*) FILTER (gone) AS n_removed,
             CAST(coalesce(sum(length(piece) - lead) FILTER (gone), 0) AS BIGINT) AS removed_chars,
             coalesce(string_agg((stop - length(piece) + lead) || '-' || stop, ',' ORDER BY k) FILTER (gone), '') AS removed
      FROM g GROUP BY r)
SELECT doc_id, CASE WHEN tail IS NULL THEN text ELSE kept || substr(text, tail + 1) END AS text, coalesce(n_removed, 0) AS n_removed,
       coalesce(removed_chars, 0) AS removed_chars, coalesce(removed, '') AS removed
FROM d LEFT JOIN t USING (r)
""",
    "op13_centroid_clustering": _clusters(),
}

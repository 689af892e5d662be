"""Queries of the corpus operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, delta_lloyd, divergence, license_scan, line_dedup, mixing, mixture_sql, ngram_join, order_minhash, packing, pii, token_counts, toxicity, url_filter
from .session import load

Query = Callable[[SparkSession, str], DataFrame]


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components over three-word shingles at similarity 0.9."""
    return ngram_join.near_duplicates(load(spark, sf_dir, "documents"), k=3, permille=900)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat in windows of three."""
    cleaned = line_dedup.without_repeated_lines(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
w AS (SELECT doc_id, i, l[i + 1] || chr(10) || l[i + 2] || chr(10) || l[i + 3] AS g FROM (SELECT doc_id, l, unnest(generate_series(0, len(l) - 3)) AS i FROM d WHERE len(l) >= 3)),
v AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM w WHERE regexp_matches(g, '[^\s]')),
r AS (SELECT DISTINCT doc_id, i + o AS p FROM v, (VALUES (0), (1), (2)) AS t(o) WHERE n > 1),
x AS (SELECT doc_id, list(p) AS ps FROM r GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE CAST(len(l) AS BIGINT) END AS n_lines, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN ps IS NULL THEN coalesce(text, '') ELSE coalesce(array_to_string([l[i + 1] FOR i IN range(len(l)) IF NOT list_contains(ps, i)], chr(10)), '') END) AS text_sha256
FROM d LEFT JOIN x USING (doc_id)
"""

#: Rules of the URL query: fixed values.
URL_RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages; hosts of which the rules block more pages than they allow are listed."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES, url_filter.hosts_blocked_by_rules(pages, URL_RULES))


OP5_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
p AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(rhost, rpath, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT p.*, rhost || rpath AS rule, v FROM p LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
b AS (SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v FROM m GROUP BY page_id, host, path),
h AS (SELECT host FROM b GROUP BY host HAVING sum(CASE v WHEN 'block' THEN 1 WHEN 'allow' THEN -1 ELSE 0 END) > 0)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN host IN (SELECT host FROM h) THEN 'block' ELSE 'allow' END) AS verdict FROM b
"""


def tokenizer_path(name: str) -> str:
    """Path of an installed public tokenizer file, the same on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of whole texts, with the longest prefix of at most 512 tokens."""
    found = token_counts.token_prefix_counts(load(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 512, keep_table=False)
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"), "fit_chars")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of at most 4096 tokens."""
    return packing.pack_documents(load(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of texts and of edited texts, and their likeness."""
    return order_minhash.edits_and_neighbours(load(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of whole texts."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, load(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and texts in documents."""
    return license_scan.scan(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in documents."""
    found = pii.find_personal_data(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *(pii.count_of(k).alias(f"n_{k}") for k in pii.KINDS),
        F.sha2(pii.digest(F.col("base")), 256).alias("base_sha256"),
        pii.digest(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages of ten words in documents."""
    found = decontaminate.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, least(10, len(w)) AS k, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM bs),
ks AS (SELECT DISTINCT k FROM bw),
di AS (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k),
hits AS (SELECT di.doc_id, di.i, di.k, bw.item_id FROM di JOIN bw ON di.k = bw.k AND array_to_string(di.w[di.i:di.i + di.k - 1], ' ') = bw.g),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of kept words of each source beside those of its language's other sources, and the words it uses more."""
    return divergence.audit(load(spark, sf_dir, "documents"), least_docs=30, smoothing=5, scale=10**9, top=50)


def op12_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the embeddings around 40 integer centroids."""
    return delta_lloyd.clusters_of(load(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64, scale=256, seed=2)


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of each document so that sources have weights 5, 2, 1 of one and a half times all words."""
    return mixing.mix(load(spark, sf_dir, "documents"), weights=(5, 2, 1), share=Fraction(3, 2), repeats=2)


QUERIES = (
    op1_ngram_jaccard, op2_line_dedup, op3_token_counts, op4_best_fit_packing, op5_url_filter, op6_order_minhash, op7_toxicity,
    op8_license_scan, op9_decontaminate, op10_pii, op11_source_divergence, op12_delta_lloyd, op13_source_mixing,
)


def queries() -> dict[str, Query]:
    """Every corpus query by name."""
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the corpus queries that SQL can express on whole tables."""
    return {"op2_line_dedup": OP2_SQL, "op5_url_filter": OP5_SQL, "op9_decontaminate": OP9_SQL, "op11_source_divergence": mixture_sql.DIVERGENCE, "op12_delta_lloyd": mixture_sql.clusters(), "op13_source_mixing": mixture_sql.MIXING}

"""The registered queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, gif, mixing, packing, ppm, quality, secret_scan, sharding, simhash, urls
from .common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_pivots": lambda spark, d: simhash.near_duplicates(documents(spark, d)),
    "op2_mixing": lambda spark, d: mixing.taken_words(documents(spark, d)),
    "op3_quality_neighbours": lambda spark, d: quality.quality_scores(documents(spark, d), documents(spark, d, "labels")),
    "op4_lm_ppm": lambda spark, d: ppm.model_scores(documents(spark, d)),
    "op5_secret_ownership": lambda spark, d: secret_scan.secrets(documents(spark, d)),
    "op6_url_rules": lambda spark, d: urls.judge(documents(spark, d, "pages")),
    "op7_packing_differencing": lambda spark, d: packing.pack_documents(documents(spark, d)),
    "op8_gif_media": lambda spark, d: gif.text_media(documents(spark, d)),
    "op9_exact_dedup_state": lambda spark, d: exact_dedup.exact_duplicates(documents(spark, d)),
    "op10_sharding_prefix_sums": lambda spark, d: sharding.near_equal_bytes(documents(spark, d)),
}

#: The others are not SQL's: XXH64 and CRC-32, tokenizers, models and seeded draws.
ORACLES: dict[str, str] = {
    "op6_url_rules": """
        WITH rules(verdict, host, path) AS (VALUES
            ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'),
            ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
        rests AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (SELECT page_id,
            translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
        fits AS (SELECT p.host, p.path, r.host || r.path AS rule, r.verdict,
            row_number() OVER (PARTITION BY p.host, p.path ORDER BY length(r.host || r.path) DESC, r.host || r.path DESC) AS place
            FROM (SELECT DISTINCT host, path FROM parts) p
            JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
        SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
        FROM parts p LEFT JOIN fits f ON f.host = p.host AND f.path = p.path AND f.place = 1
    """,
    "op9_exact_dedup_state": """
        WITH norm AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        groups AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM norm GROUP BY t)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
        FROM norm n JOIN groups g ON n.t = g.t
    """,
}

"""The registered queries of this folder: one per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (best_fit_packing, box_negatives, line_spread, near_dedup, phrase_index, quality_ranking, secret_scan, token_alignment, token_transducer, topk_search,
               toxic_channel, url_trees, warc_revisits)
from .common import fold, table

Query = Callable[[SparkSession, str], DataFrame]


def op8_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_ranking.fit(docs, table(spark, sf_dir, "labels"))
    return quality_ranking.score_documents(docs, model).select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op7_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_spread.remove_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.md5(F.encode("text", "utf-8")).alias("kept_md5"))


def op1_toxic_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxic_channel.fit(docs, table(spark, sf_dir, "labels"))
    return toxic_channel.score_documents(docs, model).select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secret_scan.joined("base"), 256).alias("base_sha256"),
                      secret_scan.joined("spans").alias("spans"), "n_random")


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_revisits.archive_round_trip(table(spark, sf_dir, "pages"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"), size=4)


def op6_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = phrase_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                      F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), phrase_index.contaminated().alias("contaminated"))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op10_token_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_transducer.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op11_box_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return box_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op12_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_trees.judge(pages, url_trees.fit(pages)).select("page_id", "host", "path", "rule", "verdict")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_alignment.align_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


LINE_SQL = """
WITH l AS (SELECT doc_id, coalesce(source, chr(1)) AS site, unnest(string_split(text, chr(10))) AS raw,
    unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
n AS (SELECT doc_id, site, raw, trim(raw, ' ') AS line, pos FROM l),
b AS (SELECT line, min(doc_id) AS d, arg_min(pos, (doc_id, pos)) AS p FROM n WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {sites}),
k AS (SELECT n.*, b.line IS NOT NULL AND NOT (n.doc_id = d AND n.pos = p) AS gone FROM n LEFT JOIN b USING (line)),
c AS (SELECT doc_id, count(*) FILTER (line <> '') AS n_lines, count(*) FILTER (gone) AS n_removed,
    coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM k GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, CAST(length(kept) AS BIGINT) AS kept_chars, md5(kept) AS kept_md5 FROM c
"""

TOPK_SQL = """
WITH v AS (SELECT vec_id, min(list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE)))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""
NEGATIVES_SQL = """
WITH r AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT row_number() OVER (ORDER BY vec_id, label, q) AS n, * FROM r),
s AS (SELECT a.n, a.vec_id AS anchor_id, b.n AS m, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.n <> b.n),
p AS (SELECT n, anchor_id, m, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) <= 5),
g AS (SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.n, p.m ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score,
  s.score AS negative_score FROM p JOIN s ON p.n = s.n AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT * FROM g WHERE rank <= 5
"""
WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
o AS (SELECT d, max(page_id) AS o FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN o.o <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN o.o <> page_id THEN o.o END AS refers_to FROM p LEFT JOIN o ON p.d = o.d AND p.n >= 1000
"""
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _FOLD + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
PHRASE_SQL = f"""
WITH it AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
wi AS (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM it WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, list_slice(w, i, i + k - 1) AS g FROM wi),
d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
dw AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k),
m AS (SELECT doc_id, i, k, item_id FROM (SELECT doc_id, i, k, list_slice(w, i, i + k - 1) AS g FROM dw) JOIN win USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

QUERIES: dict[str, Query] = {
    "op1_toxic_channel": op1_toxic_channel,
    "op2_topk_search": op2_topk_search,
    "op3_secret_scan": op3_secret_scan,
    "op4_near_dedup": op4_near_dedup,
    "op5_warc_revisits": op5_warc_revisits,
    "op6_phrase_index": op6_phrase_index,
    "op7_line_spread": op7_line_spread,
    "op8_quality_ranking": op8_quality_ranking,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_token_transducer": op10_token_transducer,
    "op11_box_negatives": op11_box_negatives,
    "op12_url_trees": op12_url_trees,
    "op13_token_alignment": op13_token_alignment,
}
SQL: dict[str, str] = {"op2_topk_search": TOPK_SQL, "op5_warc_revisits": WARC_SQL, "op6_phrase_index": PHRASE_SQL, "op7_line_spread": LINE_SQL.format(sites=line_spread.MIN_SITES),
                      "op11_box_negatives": NEGATIVES_SQL}

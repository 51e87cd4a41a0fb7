"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hard_negatives, licenses, line_quality, mixing, ngram_join, packing, quality, ranked_search, sharding, token_counts, toxicity, url_filter, vector_dedup
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.judge(documents, quality.fit(documents, table(spark, sf_dir, "labels")))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def packed(documents: DataFrame) -> DataFrame:
    pieces = packing.tokenized(documents, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    digest = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digest, order=("doc_id", "piece", "start", "ids_crc32"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(table(spark, sf_dir, "documents"))


#: Components by what each row reaches; the table's ids are unique.
_REACHED = """
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reached r JOIN edges e ON r.b = e.a),
classes AS (SELECT a AS id, min(b) AS least FROM reached GROUP BY a),
degrees AS (SELECT a AS id, count(*) AS n FROM edges GROUP BY a)
"""

OP4_SQL = f"""
WITH RECURSIVE split AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
  ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles FROM split),
held AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM held x JOIN held y ON x.shingle = y.shingle AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
{_REACHED}
SELECT doc_id, len(shingles)::BIGINT AS n_shingles, least(doc_id, coalesce(c.least, doc_id)) AS component_id, coalesce(d.n, 0)::BIGINT AS n_links
FROM sets LEFT JOIN classes c ON c.id = doc_id LEFT JOIN degrees d ON d.id = doc_id
"""


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.shuffled(mixing.mix(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "text", "source", "lang", "n_chars", "copy", "copies")


OP6_SQL = f"""
WITH RECURSIVE target(source, weight) AS (VALUES {", ".join(f"('{s}', {w!r}::DOUBLE)" for s, w in mixing.TARGET.items())}),
docs AS (SELECT d.*, t.source AS bucket, coalesce(t.weight, {mixing.OTHER!r}::DOUBLE) AS weight FROM documents d LEFT JOIN target t USING (source)),
sizes AS (SELECT bucket, any_value(weight) AS weight, count(*) AS n FROM docs GROUP BY bucket),
rates AS (SELECT bucket, weight / (SELECT sum(weight) FROM sizes) * (SELECT sum(n) FROM sizes) / n AS rate FROM sizes),
terms(bucket, rate, k, term, cdf) AS (
  SELECT bucket, rate, 0, exp(-rate), exp(-rate) FROM rates
  UNION ALL
  SELECT bucket, rate, k + 1, term * rate / (k + 1), cdf + term * rate / (k + 1) FROM terms WHERE k + 2 < rate + 12 * sqrt(rate) + 30
),
lists AS (SELECT bucket, list(cdf) AS cdfs FROM terms GROUP BY bucket),
drawn AS (
  SELECT doc_id, text, source, lang, n_chars, bucket,
    ('0x' || substr(md5('mix-1/0/' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / {float(2**52)!r} AS u
  FROM docs
),
counted AS (
  SELECT d.*, len(list_filter(l.cdfs, lambda c: c <= d.u))::INTEGER AS copies
  FROM drawn d JOIN lists l ON d.bucket IS NOT DISTINCT FROM l.bucket
)
SELECT doc_id, text, source, lang, n_chars, unnest(range(copies))::INTEGER AS copy, copies FROM counted WHERE copies > 0
"""


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("detections")


def op8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.dedup(table(spark, sf_dir, "embeddings"))


OP8_SQL = f"""
WITH RECURSIVE sound AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM sound x JOIN sound y ON x.vec_id < y.vec_id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.9),
{_REACHED}
SELECT vec_id, coalesce(d.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c.least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c.least, vec_id)) AS kept
FROM embeddings LEFT JOIN classes c ON c.id = vec_id LEFT JOIN degrees d ON d.id = vec_id
"""


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def _rule_case(what: str) -> str:
    longest = sorted(url_filter.RULES, key=lambda r: -len(r.text))
    return "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, what)}'" for r in longest) + " END"


def _address(url: str) -> tuple[str, str, str]:
    upper, lower = url_filter.UPPER, url_filter.LOWER
    host = f"coalesce(translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{lower}'), '')"
    path = f"coalesce(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
    return host, path, f"{host} || {path} || coalesce(regexp_extract({url}, '(?s)^.*?://[^?#]*(\\?[^#]*)', 1), '')"


def op9_sql() -> str:
    host, path, node = _address("url")
    t_host, t_path, t_node = _address("target")
    tag = lambda s: s.replace("'", "''")
    return f"""
WITH RECURSIVE judged AS (SELECT page_id, url, html, host, path, node, {_rule_case("text")} AS rule, {_rule_case("verdict")} AS ruled
  FROM (SELECT page_id, url, html, {host} AS host, {path} AS path, {node} AS node FROM pages)),
tags AS (
  SELECT url, node, host, path, unnest(list_concat(
    list_transform(list_filter(regexp_extract_all(html, '{tag(url_filter.LINK_TAG)}'), lambda t: regexp_matches(t, '{tag(url_filter.CANONICAL)}')), lambda t: regexp_extract(t, '{tag(url_filter.HREF)}', 1)),
    list_transform(list_filter(regexp_extract_all(html, '{tag(url_filter.META_TAG)}'), lambda t: regexp_matches(t, '{tag(url_filter.REFRESH)}')), lambda t: regexp_extract(t, '{tag(url_filter.REFRESH_URL)}', 1)))) AS raw
  FROM judged WHERE host <> '' AND regexp_matches(html, '{url_filter.DECLARES}')
),
links AS (
  SELECT url, node, CASE WHEN regexp_matches(raw, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN raw
    WHEN starts_with(raw, '//') THEN regexp_extract(url, '(?s)^(.*?)://', 1) || ':' || raw
    WHEN starts_with(raw, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || raw
    ELSE regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || coalesce(nullif(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*/)', 1), ''), '/') || raw END AS target
  FROM (SELECT url, node, replace(raw, '&amp;', '&') AS raw FROM tags WHERE raw <> '')
),
ends AS (SELECT node, {t_node} AS other, {t_host} AS host, {t_path} AS path FROM links),
edges AS (SELECT node AS a, other AS b FROM ends UNION SELECT other, node FROM ends),
known AS (SELECT other AS node, {_rule_case("verdict")} AS ruled FROM ends UNION SELECT node, ruled FROM judged WHERE node IN (SELECT a FROM edges)),
reached(a, b) AS (SELECT a, a FROM edges UNION SELECT r.a, e.b FROM reached r JOIN edges e ON r.b = e.a),
classes AS (SELECT r.a AS node, CASE WHEN bool_or(k.ruled = 'allow') THEN 'allow' WHEN bool_or(k.ruled = 'block') THEN 'block' END AS of_class FROM reached r JOIN known k ON k.node = r.b GROUP BY r.a)
SELECT page_id, host, path, rule, coalesce(ruled, of_class, 'allow') AS verdict FROM judged LEFT JOIN classes USING (node)
"""


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return line_quality.score(documents, line_quality.fit(documents, table(spark, sf_dir, "labels")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives.mine(rows, F.col("id") % 100 == 0)


OP12_SQL = """
WITH sound AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS other, b.label AS label, list_dot_product(a.v, b.v)::BIGINT AS score FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS k FROM scores WHERE label = own) WHERE k <= 5),
met AS (SELECT p.anchor_id, p.positive_id, p.positive_score, s.other AS negative_id, s.score AS negative_score FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND s.label <> s.own
  WHERE 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score),
ranked AS (SELECT *, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) AS rank FROM met)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = f"regexp_extract_all(translate(text, '{licenses.UPPER}', '{licenses.LOWER}'), '{ranked_search.TERM}')"

OP13_SQL = f"""
WITH sized AS (SELECT row_number() OVER () AS place, doc_id, words, len(words)::BIGINT AS n FROM (SELECT doc_id, {_TERMS} AS words FROM documents WHERE text IS NOT NULL) WHERE len(words) > 0),
stats AS (SELECT count(*)::BIGINT AS total, sum(n)::BIGINT AS length FROM sized),
wanted AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
tokens AS (SELECT place, doc_id, n, unnest(words) AS term FROM sized),
postings AS (SELECT place, doc_id, n, term, count(*)::BIGINT AS tf FROM tokens WHERE term IN (SELECT term FROM wanted) GROUP BY place, doc_id, n, term),
weights AS (SELECT term, floor(1000 * ln((2.0 * total + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM postings GROUP BY term), stats),
scores AS (SELECT item_id, place, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * total) // length))))::BIGINT AS score
  FROM postings JOIN weights USING (term) JOIN wanted USING (term), stats GROUP BY item_id, place, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_quality_rules": op2_quality_rules,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_ngram_join": op4_ngram_join,
    "op5_toxicity": op5_toxicity,
    "op6_mix_sources": op6_mix_sources,
    "op7_license_scan": op7_license_scan,
    "op8_vector_dedup": op8_vector_dedup,
    "op9_url_filters": op9_url_filters,
    "op10_shards": op10_shards,
    "op11_line_quality": op11_line_quality,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_ranked_search": op13_ranked_search,
}

ORACLE_SQL = {"op4_ngram_join": OP4_SQL, "op6_mix_sources": OP6_SQL, "op8_vector_dedup": OP8_SQL, "op9_url_filters": op9_sql(), "op12_hard_negatives": OP12_SQL, "op13_ranked_search": OP13_SQL}

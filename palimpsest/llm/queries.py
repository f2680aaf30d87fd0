"""Queries of the corpus operators over the whole tables."""

from __future__ import annotations

import public_tokenizers as tokenizers_of
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import balltree, bpe, chosenpath, jaccard, packing, phrases, quality, rlz, secrets, suffix, urlrank, voronoi, wordpiece
from palimpsest.llm.common import table


#: Fixed values of the contract.
URL_RULES = (
    urlrank.Rule("block", "com", "/en/"),
    urlrank.Rule("allow", "example.com", "/en/7"),
    urlrank.Rule("allow", "net", "/de/"),
    urlrank.Rule("block", "example.net", "/de/8"),
    urlrank.Rule("block", "org", "/es/"),
)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = tokenizers_of.path("byte_bpe_50k.tiktoken")
    found = secrets.scan(table(spark, sf_dir, "documents"), secrets.default_forest(vocabulary), vocabulary, path_col="source")
    return found.select("doc_id", "n_candidates", "n_findings", "findings", F.sha2("clean_text", 256).alias("clean_sha256"))


FERTILITY_VOCABULARIES = (tokenizers_of.path("piece_bpe_32k.model"), tokenizers_of.path("byte_bpe_multi_50k.tiktoken"))


def op2_tokenizer_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), FERTILITY_VOCABULARIES, tokenizers_of.PATTERN)


def _removed(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + (s["hi"] - s["lo"]).cast("long"))


def op3_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = rlz.dedup(table(spark, sf_dir, "documents"))
    return parsed.select("doc_id", "n_words", _removed(F.col("spans")).alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_wordpiece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"), tokenizers_of.path("piece_bpe_32k.model"))


def op5_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = packing.token_pieces(docs, tokenizers_of.path("word_bpe_49k.json"))
    digests = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(digests, docs.count())


def op6_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi.top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, k=5, scale=256)


def op7_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrank.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = tokenizers_of.path("byte_bpe_50k.tiktoken"), tokenizers_of.PATTERN
    coded = bpe.encode(table(spark, sf_dir, "documents"), path, pattern, check=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = suffix.dedup(table(spark, sf_dir, "documents"))
    return parsed.select("doc_id", "n_bytes", _removed(F.col("spans")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return balltree.hard_negatives(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0, moved, scale=256, positives=5, negatives=5, window=(80, 100, 100))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), longest=5, least=100, top=2000)


def op13_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosenpath.near_duplicates(table(spark, sf_dir, "documents"), k=5, num=85, den=100)


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_tokenizer_fertility": op2_tokenizer_fertility,
    "op3_relative_lz": op3_relative_lz,
    "op4_wordpiece_counts": op4_wordpiece_counts,
    "op5_sequence_packing": op5_sequence_packing,
    "op6_voronoi_top_k": op6_voronoi_top_k,
    "op7_link_graph": op7_link_graph,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_parity_sketch_join": op9_parity_sketch_join,
    "op10_suffix_array": op10_suffix_array,
    "op11_ball_tree": op11_ball_tree,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_chosen_path": op13_chosen_path,
}
TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
HARD_NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS anchor_id, c.vec_id AS vec_id, q.label = c.label AS same,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
PHRASES_SQL = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS x
  FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS w FROM t),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, unnest([1, 2, 3, 4, 5]) AS k, w FROM w),
o AS (SELECT lang, k, unnest(list_transform(range(1, len(w)::BIGINT - k + 2), lambda i: w[i : i + k - 1])) AS p FROM g WHERE len(w) >= k),
f AS (SELECT lang, k, p, count(*)::BIGINT AS f FROM o GROUP BY lang, k, p HAVING count(*) >= 100),
inside AS (
  SELECT lang, p, max(f) AS f FROM (
    SELECT lang, f, p[1 : k - 1] AS p FROM f WHERE k > 2 UNION ALL SELECT lang, f, p[2 : k] AS p FROM f WHERE k > 2) GROUP BY lang, p),
c AS (SELECT f.* FROM f LEFT JOIN inside i ON f.lang = i.lang AND f.p = i.p WHERE k >= 2 AND (i.f IS NULL OR 100 * i.f < 100 * f.f)),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
s AS (
  SELECT c.lang, c.p, c.cut, c.f AS a, x.f AS l, y.f AS r, n, ((1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.p = c.p[1 : c.cut] JOIN f y ON y.lang = c.lang AND y.p = c.p[c.cut + 1 : c.k] JOIN total t ON t.lang = c.lang),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
r AS (SELECT *, array_to_string(p, ' ') AS phrase FROM m)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM r QUALIFY rank <= 2000
"""
ORACLES: dict[str, str] = {"op6_voronoi_top_k": TOP_K_SQL, "op11_ball_tree": HARD_NEGATIVES_SQL, "op12_phrase_collocations": PHRASES_SQL}

"""Queries over conversations: messages, tokens, injection, compaction, stitching."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import messages as M
from palimpsest.functions.text import token_count
from palimpsest.operators import constraints as C
from palimpsest.operators import neighbours as N
from palimpsest.operators import stitching as K
from palimpsest.operators.common import shared_folder
from palimpsest.operators.compactors import FirstSentences, RecentMessages, compaction, token_budget
from palimpsest.operators.evaluation import contexts, judged_contexts, lengths, turns_of
from palimpsest.plans.registry import CONV_SQL, catalogue_sql, draw_sql, query, tok


def _m() -> Column:
    return F.col("messages")

TARGET, LONG_TARGET = 300, 1000


@query(f"WITH {CONV_SQL} SELECT conv_id, n::INTEGER AS n_messages, m[1].role AS first_role, m[-1].role AS last_role, len(u)::INTEGER AS n_users FROM ctx")
def assemble_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts(spark, sf_dir).select("conv_id", F.size(_m()).alias("n_messages"), F.get(_m(), F.lit(0))["role"].alias("first_role"), F.element_at(_m(), -1)["role"].alias("last_role"), F.size(M.user_turns(_m())).alias("n_users"))


@query("SELECT conv_id, turn, CASE WHEN lower(trim(role)) IN ('user', 'human') THEN 'user' WHEN lower(trim(role)) IN ('system', 'developer') THEN 'system' ELSE 'assistant' END AS mapped FROM conversations")
def role_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", M.mapped_role(F.col("role")).alias("mapped"))


@query("SELECT conv_id, count(*)::INTEGER AS n_messages, sum(length(trim(text)))::BIGINT AS n_chars FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def trim_drop_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = contexts(spark, sf_dir).select("conv_id", M.cleaned(_m()).alias("messages"))
    return clean.select("conv_id", F.size(_m()).alias("n_messages"), F.aggregate(_m(), F.lit(0).cast("long"), lambda a, x: a + F.length(x["content"])).alias("n_chars")).filter("n_messages > 0")


@query(f"WITH {CONV_SQL} SELECT conv_id, list_sum(t)::INTEGER AS token_length FROM ctx")
def token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths(turns_of(spark, sf_dir)).select("conv_id", "token_length")


@query(f"SELECT doc_id, {tok('text')}::INTEGER AS n_tokens FROM documents")
def document_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", token_count(F.col("text")).alias("n_tokens"))


@query(f"WITH {CONV_SQL} SELECT count(*) AS n_rows, min(list_sum(t))::INTEGER AS min_tokens, max(list_sum(t))::INTEGER AS max_tokens, round(avg(list_sum(t)), 6) AS avg_tokens, round(avg(n), 6) AS avg_turns, round(avg(len(u)), 6) AS avg_users FROM ctx")
def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lengths(turns_of(spark, sf_dir)).select(F.col("token_length").alias("t"), F.col("turns").alias("n"), F.col("users").alias("u"))
    return rows.agg(F.count("*").alias("n_rows"), F.min("t").alias("min_tokens"), F.max("t").alias("max_tokens"), *[F.round(F.avg(c), 6).alias(a) for c, a in (("t", "avg_tokens"), ("n", "avg_turns"), ("u", "avg_users"))])


@query(f"WITH {CONV_SQL} SELECT conv_id, u[1]::INTEGER AS top, u[(len(u) // 2 + 1)::INTEGER]::INTEGER AS middle, u[-1]::INTEGER AS bottom FROM ctx WHERE len(u) > 0")
def position_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = contexts(spark, sf_dir).select("conv_id", M.user_turns(_m()).alias("u")).filter(F.size("u") > 0)
    return users.select("conv_id", *[M.at_position(F.col("u"), F.lit(p)).alias(p) for p in ("top", "middle", "bottom")])


@query(f"""WITH {CONV_SQL}, w AS (SELECT conv_id, m, u, (len(u) // 2 + 1)::INTEGER AS mid FROM ctx WHERE len(u) >= 3)
SELECT conv_id, u[mid]::INTEGER AS middle_user_index, (u[mid] + 1)::INTEGER AS injection_position,
  (u[mid + 1] - u[mid - 1] + 1 + CASE WHEN m[u[mid + 1] + 2].role = 'assistant' THEN 1 ELSE 0 END)::INTEGER AS n_local, m[u[mid - 1] + 1].content AS first_text FROM w""")
def local_context_r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contexts(spark, sf_dir).select("conv_id", M.user_turns(_m()).alias("u"), M.local_context(_m(), 1).alias("local")).filter("local is not null")
    middle = M.at_position(F.col("u"), F.lit("middle"))
    return rows.select("conv_id", middle.alias("middle_user_index"), (middle + 1).alias("injection_position"), F.size("local").alias("n_local"), F.get("local", F.lit(0))["content"].alias("first_text"))


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM conversations""")
def prev_assistant_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    said = F.last(F.when(F.col("role") == "assistant", F.col("text")), ignorenulls=True).over(before)
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", said.alias("previous"))


@query("SELECT conv_id, md5(string_agg(role || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def render_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts(spark, sf_dir).select("conv_id", F.md5(M.rendered(_m())).alias("digest"))


@query("SELECT conv_id, md5(string_agg('[' || role || ']: ' || text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def render_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts(spark, sf_dir).select("conv_id", F.md5(M.transcript(_m())).alias("digest"))


@query("SELECT conv_id, md5(string_agg(turn_no || '. ' || text, chr(10) ORDER BY turn)) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no FROM conversations) GROUP BY conv_id")
def render_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts(spark, sf_dir).select("conv_id", F.md5(M.numbered(F.transform(_m(), lambda x: x["content"]))).alias("digest"))


@query("SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts(spark, sf_dir).select("conv_id", F.md5(M.embedding_text(_m())).alias("digest"))


@query(f"WITH {CONV_SQL} SELECT conv_id, CASE WHEN m[1].role = 'system' THEN n - 1 ELSE n END::INTEGER AS n_without_leading, len(list_filter(m, lambda x: x.role <> 'system'))::INTEGER AS n_without_any, (CASE WHEN m[1].role = 'system' THEN list_sum(t[2:]) ELSE list_sum(t) END)::INTEGER AS token_length FROM ctx")
def system_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = contexts(spark, sf_dir).select("conv_id", M.system_only_first(_m()).alias("messages"))
    return checked.select("conv_id", F.size(M.without_leading_system(_m())).alias("n_without_leading"), F.size(M.without_system(_m())).alias("n_without_any"), M.total_tokens(M.without_leading_system(_m())).alias("token_length"))


def _injected(spark: SparkSession, sf_dir: str, position: str, repeat: int) -> DataFrame:
    pairs = contexts(spark, sf_dir).filter(F.size(M.user_turns(_m())) > 0).crossJoin(C.catalogue(spark))
    wrapped = C.framed(F.col("sssc"), F.lit(True), F.lit(True))
    full = C.injected(_m(), C.targets(_m(), F.lit(position), F.lit(repeat), F.col("conv_id"), F.col("id")), wrapped)
    return pairs.select("conv_id", F.col("id").alias("sssc_id"), F.md5(M.rendered(full)).alias("digest"))


def _injected_sql(places: str) -> str:
    return f"""WITH {CONV_SQL}, {catalogue_sql()}, p AS (SELECT ctx.*, cat.id, '{C.EXPLICIT_HARD}' || lower(substr(sssc, 1, 1)) || substr(sssc, 2) AS w, {places} AS places FROM ctx, cat WHERE len(u) > 0)
SELECT conv_id, id AS sssc_id, md5(array_to_string(list_transform(range(1, n + 1), lambda i: m[i].role || ':' || chr(10) || CASE WHEN list_contains(places, i - 1) THEN w || chr(10) ELSE '' END || m[i].content), chr(10) || chr(10))) AS digest FROM p"""


@query(_injected_sql("[u[1]]"))
def inject_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _injected(spark, sf_dir, "top", 1)


@query(_injected_sql("[u[(len(u) // 2 + 1)::INTEGER]]"))
def inject_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _injected(spark, sf_dir, "middle", 1)


@query(_injected_sql("[u[-1]]"))
def inject_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _injected(spark, sf_dir, "bottom", 1)


@query(_injected_sql(f"""list_transform(list_sort(list_transform(u, lambda i: struct_pack(d := {draw_sql("'rep'", "conv_id", "cat.id", "i")}, i := i)))[1:3], lambda x: x.i)"""))
def inject_repeat3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _injected(spark, sf_dir, "top", 3)


@query(f"""WITH {catalogue_sql()}, c AS (SELECT DISTINCT conv_id FROM conversations), s AS (SELECT c.conv_id, cat.*, {draw_sql("'swap'", "c.conv_id", "cat.id")} < 0.5 AS swap FROM c, cat)
SELECT conv_id, id AS sssc_id, CASE WHEN swap THEN 'B' ELSE 'A' END AS letter,
  probe || chr(10) || 'A) ' || CASE WHEN swap THEN incorrect_answer ELSE correct_answer END || chr(10) || 'B) ' || CASE WHEN swap THEN correct_answer ELSE incorrect_answer END || chr(10) || 'Answer with A or B.' AS prompt FROM s""")
def probe_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.functions.text import draw

    convs = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct()
    made = convs.crossJoin(C.catalogue(spark)).withColumn("p", C.choice_probe(F.col("probe"), F.col("correct_answer"), F.col("incorrect_answer"), draw("swap", F.col("conv_id"), F.col("id")) < 0.5))
    return made.select("conv_id", F.col("id").alias("sssc_id"), "p.letter", "p.prompt")


@query(f"WITH {CONV_SQL} SELECT conv_id, least(n, 5)::INTEGER AS n_kept, list_sum(t)::INTEGER AS tokens_before, list_sum(t[greatest(n - 5, 0) + 1:])::INTEGER AS tokens_after, round(list_sum(t[greatest(n - 5, 0) + 1:]) / list_sum(t), 10) AS compression_ratio FROM ctx")
def recent_n_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = contexts(spark, sf_dir).withColumn("kept", RecentMessages(5).compact(_m())).withColumn("c", compaction(_m(), F.col("kept")))
    return kept.select("conv_id", F.size("kept").alias("n_kept"), "c.tokens_before", "c.tokens_after", F.round("c.compression_ratio", 10).alias("compression_ratio"))


@query(f"""WITH {CONV_SQL} SELECT conv_id, md5(array_to_string(list_transform(u[1:3], lambda i: regexp_extract(m[i + 1].content, '^[^.!?\\n]*[.!?]?', 0)), ' ')) AS digest FROM ctx""")
def extractive_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts(spark, sf_dir).select("conv_id", F.md5(F.get(FirstSentences(3).compact(_m()), F.lit(0))["content"]).alias("digest"))


@query(r"""WITH x AS (SELECT conv_id, turn, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]') AS l FROM conversations),
tk AS (SELECT conv_id, turn, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS pos FROM x),
df AS (SELECT lower(token) AS word, count(DISTINCT conv_id) AS df FROM tk GROUP BY 1),
r AS (SELECT tk.*, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN token <> '?' THEN 1 ELSE 0 END, df, turn, pos) AS rank FROM tk JOIN df ON lower(token) = word)
SELECT conv_id, string_agg(token, ' ' ORDER BY turn, pos) FILTER (rank <= 64) AS kept, count(*) AS n_tokens, count(*) FILTER (rank <= 64) AS n_kept FROM r GROUP BY conv_id""")
def token_budget_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_budget(spark.read.parquet(f"{sf_dir}/conversations.parquet"), 64)


@query(f"""WITH {CONV_SQL}, s AS (SELECT conv_id, n, list_transform(range(1, n + 1), lambda i: list_sum(t[1:i])) AS sums FROM ctx WHERE list_sum(t) >= {TARGET})
SELECT conv_id, (len(list_filter(sums, lambda x: x < {TARGET})) + 1)::INTEGER AS n_messages, sums[len(list_filter(sums, lambda x: x < {TARGET})) + 1]::INTEGER AS token_length FROM s""")
def trim_to_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = K.trimmed_rows(contexts(spark, sf_dir), TARGET)
    return rows.select("conv_id", F.size(_m()).alias("n_messages"), "token_length")


_PAIR_SQL = f"""WITH {CONV_SQL}, s AS (SELECT conv_id, m, t, list_transform(range(1, n + 1), lambda i: list_sum(t[1:i])) AS sums FROM ctx WHERE list_sum(t) >= {TARGET}),
k AS (SELECT *, len(list_filter(sums, lambda x: x < {TARGET})) + 1 AS k, row_number() OVER (ORDER BY conv_id) - 1 AS rn FROM s),
h AS (SELECT rn // 2 AS pair, rn % 2 AS side, list_filter(range(1, k + 1), lambda i: rn % 2 = 0 OR m[i].role <> 'system') AS keep, t FROM k)
SELECT pair AS source_row_index, sum(len(keep))::INTEGER AS n_messages, sum(list_sum(list_transform(keep, lambda i: t[i])))::INTEGER AS token_length, count(*)::INTEGER AS source_conversation_count
FROM h GROUP BY pair HAVING count(*) = 2"""


@query(_PAIR_SQL)
def pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = K.paired_rows(contexts(spark, sf_dir), TARGET)
    return rows.select("source_row_index", F.size(_m()).alias("n_messages"), "token_length", "source_conversation_count")


@query(f"""WITH RECURSIVE {CONV_SQL}, r AS (SELECT row_number() OVER (ORDER BY conv_id) AS rn, conv_id, list_sum(t) AS t FROM ctx),
f AS (SELECT 0::BIGINT AS rn, 0::HUGEINT AS run, 0::BIGINT AS grp
  UNION ALL SELECT r.rn, CASE WHEN f.run >= {LONG_TARGET} THEN r.t ELSE f.run + r.t END, CASE WHEN f.run >= {LONG_TARGET} THEN f.grp + 1 ELSE f.grp END FROM f JOIN r ON r.rn = f.rn + 1),
g AS (SELECT f.grp, r.rn, r.t, sum(r.t) OVER (PARTITION BY f.grp ORDER BY r.rn) AS run, sum(r.t) OVER (PARTITION BY f.grp) AS total FROM f JOIN r USING (rn)),
k AS (SELECT grp, t, total, total <= {LONG_TARGET} / 0.8 OR run <= {LONG_TARGET} / 0.8 AS kept FROM g)
SELECT grp AS source_row_index, count(*) FILTER (kept)::INTEGER AS source_conversation_count, coalesce(sum(t) FILTER (kept), 0)::BIGINT AS token_length FROM k GROUP BY grp HAVING max(total) >= {LONG_TARGET}""")
def concat_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.concatenated(lengths(turns_of(spark, sf_dir)), LONG_TARGET).select("source_row_index", F.size("sources").alias("source_conversation_count"), "token_length")


_DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"


@query(f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, round({_DOT}, 9) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, neighbour_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, neighbour_id, round(similarity, 6) AS similarity FROM r WHERE rank <= 5""")
def knn_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 5)


@query(f"""WITH s AS (SELECT a.label, a.vec_id AS seed_id, b.vec_id, round({_DOT}, 9) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) a JOIN embeddings b ON a.label = b.label AND b.vec_id <> a.vec_id WHERE a.rn = 1)
SELECT label, seed_id, arg_min(vec_id, struct_pack(d := -sim, i := vec_id)) AS nearest_id FROM s GROUP BY ALL""")
def masked_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest unused row to each label's first."""
    return K.nearest_to_seed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query(f"""WITH s AS (SELECT a.vec_id AS seed_id, b.vec_id, round({_DOT}, 9) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id <> a.vec_id WHERE NOT (b.label < 7 AND b.vec_id % 11 <> 0))
SELECT seed_id, arg_min(vec_id, struct_pack(d := -sim, i := vec_id)) AS nearest_id FROM s GROUP BY ALL""")
def masked_neighbour_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's nearest among those not used, from a kept table of neighbours that was extended once."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    table, rows = N.NeighbourTable(spark, f"{shared_folder(spark)}/neighbours-{uuid.uuid4().hex}", 16), N.usable(vectors)
    table.extend(rows.filter("id % 10 <> 3"))
    table.extend(rows)
    used = vectors.filter("label < 7 and vec_id % 11 <> 0").select(F.col("vec_id").alias("used_id"))
    return table.nearest_unused(rows.select(F.col("id").alias("seed_id")), used).select("seed_id", "nearest_id")


#: A step of the greedy stitching adds the nearest free context, gives the latest one back, or ends a row.
_TOPIC_SQL = f"""WITH RECURSIVE {CONV_SQL},
src AS MATERIALIZED (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v, list_sum(t)::BIGINT AS n
  FROM embeddings JOIN ctx ON vec_id = conv_id),
step AS (
  SELECT 0 AS made, []::BIGINT[] AS used, []::BIGINT[] AS taken, list_resize([]::DOUBLE[], 64, 0.0) AS total_v, 0::BIGINT AS total, false AS filled, []::BIGINT[] AS done, 0::BIGINT AS done_total
  UNION ALL
  (WITH s AS (SELECT *, filled AND NOT (len(taken) > 1 AND total > floor({LONG_TARGET} / 0.8)) AS ends FROM step),
  c AS (SELECT src.id, src.v, src.n, -round(list_sum(list_transform(list_zip(src.v, s.total_v), lambda z: z[1] * z[2])) / greatest(sqrt(list_sum(list_transform(s.total_v, lambda y: y * y))), 1e-12), 9) AS d
    FROM s JOIN src ON NOT list_contains(s.used, src.id) AND NOT list_contains(s.taken, src.id) WHERE NOT s.filled),
  nxt AS (SELECT * FROM c ORDER BY d, id LIMIT 1), gone AS (SELECT src.* FROM s JOIN src ON src.id = s.taken[-1] WHERE s.filled AND NOT s.ends)
  SELECT made + 1, list_concat(used, taken), []::BIGINT[], list_resize([]::DOUBLE[], 64, 0.0), 0::BIGINT, false, taken, total FROM s WHERE ends
  UNION ALL SELECT made, used, taken[:-2], list_transform(list_zip(total_v, v), lambda z: z[1] - z[2]), total - n, true, []::BIGINT[], 0::BIGINT FROM s, gone
  UNION ALL SELECT made, used, list_append(taken, id), list_transform(list_zip(total_v, v), lambda z: z[1] + z[2]), total + n, total + n >= {LONG_TARGET}, []::BIGINT[], 0::BIGINT FROM s, nxt))
SELECT (made - 1)::INTEGER AS "row", array_to_string(done, ',') AS sources, done_total AS token_length FROM step WHERE len(done) > 0"""


@query(_TOPIC_SQL)
def topic_cohesive_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows over the whole dataset, as many as it fills."""
    sizes = lengths(turns_of(spark, sf_dir)).select("conv_id", "token_length")
    rows = K.topic_cohesive(sizes, spark.read.parquet(f"{sf_dir}/embeddings.parquet"), LONG_TARGET)
    return rows.select("row", F.array_join(F.col("sources").cast("array<string>"), ",").alias("sources"), F.col("token_length"))


@query(f"""WITH {CONV_SQL}, {catalogue_sql()}, r AS (SELECT cat.type, cat.id, list_contains(range(greatest(n - 5, 0), n), u[1]) AS kept FROM ctx, cat WHERE len(u) > 0)
SELECT type AS sssc_type, round(avg(kept::INTEGER), 10) AS retention_rate, count(*) FILTER (kept) AS n_retained, count(*) AS n_rows FROM r GROUP BY type""")
def retention_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole path on texts: inject at the top, keep the last five messages, judge, count by type."""
    judged = judged_contexts(spark, sf_dir, "recent_5", "top")
    return judged.groupBy("sssc_type").agg(F.round(F.avg(F.col("retention").cast("double")), 10).alias("retention_rate"), F.count_if("retention").alias("n_retained"), F.count("*").alias("n_rows"))


@query("""WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id) AS rn, doc_id, n_chars AS size FROM documents),
f AS (SELECT 0::BIGINT AS rn, 0::BIGINT AS cnt, 0::BIGINT AS total, 0::BIGINT AS bin, NULL::BIGINT AS doc_id
  UNION ALL SELECT d.rn, CASE WHEN f.cnt = 50 OR f.total + d.size > 200000 THEN 1 ELSE f.cnt + 1 END, CASE WHEN f.cnt > 0 AND (f.cnt = 50 OR f.total + d.size > 200000) THEN d.size ELSE f.total + d.size END,
    CASE WHEN f.cnt > 0 AND (f.cnt = 50 OR f.total + d.size > 200000) THEN f.bin + 1 ELSE f.bin END, d.doc_id FROM f JOIN d ON d.rn = f.rn + 1)
SELECT bin, count(*) AS n_rows, sum(size)::BIGINT AS n_bytes FROM f JOIN d USING (rn) GROUP BY bin""")
def byte_bin_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("n_chars").alias("size"))
    bins = K.byte_bins(docs, 50, 200_000, "doc_id", "size")
    return bins.join(docs, bins["id"] == docs["doc_id"]).groupBy("bin").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"))

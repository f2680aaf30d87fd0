"""Queries over sources and model outputs: adapters, parsers, extraction, labels, streams' batch forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import grading as G
from palimpsest.functions import messages as M
from palimpsest.functions import text as X
from palimpsest.operators import constraints as C
from palimpsest.operators import extraction as E
from palimpsest.operators.evaluation import contexts
from palimpsest.operators.stitching import normalised as unit
from palimpsest.plans.registry import CONV_SQL, catalogue_sql, draw_sql, query
from palimpsest.sources.adapters import DEFAULT_QUESTION, normalised
from palimpsest.streaming.extraction import windowed_counts


def _m() -> Column:
    return F.col("messages")

_COUNTS = "SELECT conv_id, count(*)::INTEGER AS n_messages, sum(length(trim(text)))::BIGINT AS n_chars FROM conversations WHERE trim(text) <> '' GROUP BY conv_id"


def _counted(df: DataFrame) -> DataFrame:
    return df.select("conv_id", F.size(_m()).alias("n_messages"), F.aggregate(_m(), F.lit(0).cast("long"), lambda a, x: a + F.length(x["content"])).alias("n_chars"))


@query(_COUNTS)
def adapter_turn_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.transform(_m(), lambda x: F.struct(F.when(x["role"] == "user", "human").otherwise("gpt").alias("from"), x["content"].alias("value")))
    return _counted(normalised(contexts(spark, sf_dir).select("conv_id", turns.alias("conversations")), "sharegpt", ("conv_id",)))


@query(_COUNTS)
def adapter_turn_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.struct(F.transform(_m(), lambda x: x["role"]).alias("from"), F.transform(_m(), lambda x: x["content"]).alias("value"))
    return _counted(normalised(contexts(spark, sf_dir).select("conv_id", both.alias("conversations")), "sharegpt", ("conv_id",)))


@query(_COUNTS)
def adapter_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(normalised(contexts(spark, sf_dir).withColumnRenamed("messages", "conversation").withColumn("language", F.lit("English")), "wildchat", ("conv_id",)))


@query(_COUNTS)
def adapter_json_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(normalised(contexts(spark, sf_dir).select("conv_id", F.to_json("messages").alias("prompt")), "mrcr", ("conv_id",)))


@query(_COUNTS)
def adapter_content_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.transform(_m(), lambda x: F.struct(x["role"].alias("role"), F.array(F.struct(x["content"].alias("text")), F.struct(F.lit(" ").alias("text"))).alias("content")))
    return _counted(normalised(contexts(spark, sf_dir).select("conv_id", parts.alias("messages")), "openresearcher", ("conv_id",)))


@query(f"SELECT doc_id AS conv_id, 3::INTEGER AS n_messages, ({len(DEFAULT_QUESTION)} + length(trim(text, ' ')) + length(lang))::BIGINT AS n_chars FROM documents")
def adapter_question_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("conv_id"), F.lit(" ").alias("input"), F.col("text").alias("context"), F.array("lang").alias("answers"))
    return _counted(normalised(docs, "longbench", ("conv_id",)))


@query("SELECT lang, count(*) AS n_rows FROM documents WHERE lang = 'en' GROUP BY lang")
def language_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    named = docs.withColumn("language", F.when(F.col("lang") == "en", "English").otherwise(F.col("lang")))
    return named.filter(F.col("language") == "English").groupBy("lang").agg(F.count("*").alias("n_rows"))


_ANSWER = f"CASE WHEN {draw_sql(repr('a'), 'conv_id', 'turn')} < 0.45 THEN 'A' WHEN {draw_sql(repr('a'), 'conv_id', 'turn')} < 0.9 THEN ' b ' ELSE 'maybe' END"


def _outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    d = X.draw("a", F.col("conv_id"), F.col("turn"))
    answer = F.when(d < 0.45, "A").when(d < 0.9, " b ").otherwise("maybe")
    return turns.select("conv_id", "turn", "text", answer.alias("answer"), F.concat(F.lit("[analysis]\n"), "text", F.lit("\n[final]\n"), answer).alias("output"))


@query(f"SELECT conv_id, turn, length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS n_analysis, trim({_ANSWER}) AS final, CASE WHEN upper(trim({_ANSWER})) IN ('A', 'B') THEN upper(trim({_ANSWER})) = 'A' END AS compliant FROM conversations")
def parse_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _outputs(spark, sf_dir)
    return rows.select("conv_id", "turn", F.length(F.regexp_replace(G.channel(F.col("output"), "analysis"), r"^\s+|\s+$", "")).cast("long").alias("n_analysis"), G.channel(F.col("output"), "final").alias("final"), G.letter_grade(G.graded_text(F.col("output")), F.lit("A")).alias("compliant"))


@query(f"SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN {draw_sql(repr('y'), 'conv_id', 'turn')} < 0.5 THEN true WHEN {draw_sql(repr('y'), 'conv_id', 'turn')} < 0.9 THEN false END AS verdict FROM conversations) GROUP BY 1")
def parse_yes_no(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.draw("y", F.col("conv_id"), F.col("turn"))
    said = F.when(d < 0.5, " yes, it does").when(d < 0.9, "No.").otherwise("unclear")
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select(G.yes_no(said).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, 1::INTEGER AS n_items, md5(trim(text, ' ')) AS digest FROM conversations WHERE role = 'user'")
def parse_extractor_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("role = 'user'")
    body = F.to_json(F.struct(F.array(F.struct(F.col("text").alias("text"), F.lit("e").alias("evidence")), F.struct(F.lit(" ").alias("text"), F.lit("").alias("evidence"))).alias("scs")))
    shape = F.when(F.col("turn") % 3 == 0, body).when(F.col("turn") % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("Here they are: "), body))
    items = G.extracted_constraints(shape)
    return users.select("conv_id", "turn", F.size(items).alias("n_items"), F.md5(F.get(items, F.lit(0))["text"]).alias("digest"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN NULL ELSE length(trim(text, ' ' || chr(10))) END::BIGINT AS n_thinking, CASE WHEN turn % 3 = 2 THEN length(trim(text, ' ')) ELSE 4 END::BIGINT AS n_answer FROM conversations")
def thinking_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<think>"), "text", F.lit("</think> done"))).when(F.col("turn") % 3 == 1, F.concat("text", F.lit("</think>done"))).otherwise(F.col("text"))
    split = G.thinking_split(text)
    return turns.select("conv_id", "turn", F.length(F.regexp_replace(split["thinking"], r"^[ \n]+|[ \n]+$", "")).cast("long").alias("n_thinking"), F.length(split["answer"]).cast("long").alias("n_answer"))


@query("SELECT verdict, count(*) AS n FROM (SELECT CASE conv_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'not_enough_information' END AS verdict FROM conversations) GROUP BY 1")
def parse_json_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = F.element_at(F.array(*[F.lit(x) for x in ('{"verdict": true}', '{"verdict": false}', '{"verdict": "not_enough_information"}', "no idea")]), (F.col("conv_id") % 4 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select(G.json_verdict(shapes).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


@query("SELECT event_type AS tool, count(*) AS n FROM events GROUP BY 1")
def recovered_tool_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("<|channel|>commentary to=functions."), "event_type", F.lit('<|message|>{"v": 1}<|call|>'))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.explode(G.recovered_calls(raw)).alias("tool")).groupBy("tool").agg(F.count("*").alias("n"))


@query("SELECT role, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY 1")
def decoded_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.to_json(F.array(F.struct(F.lit("reasoning").alias("type"), F.lit("hm").alias("text")), F.struct(F.lit("message").alias("type"), F.col("text").alias("text"))))
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("role", G.decoded_response(items)["text"].alias("t")).groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("t")).alias("n_chars"))


@query(f"""WITH {CONV_SQL}, {catalogue_sql()}, p AS (SELECT conv_id, cat.id AS sssc_id, '{C.EXPLICIT_HARD}' || lower(substr(sssc, 1, 1)) || substr(sssc, 2) AS text,
list_sort(list_transform(list_sort(list_transform(u, lambda i: struct_pack(d := {draw_sql("'rep'", "conv_id", "cat.id", "i")}, i := i)))[1:3], lambda x: x.i)) AS places FROM ctx, cat WHERE len(u) > 0)
SELECT conv_id, sssc_id, 1::INTEGER AS n_items, text, places[1]::INTEGER AS source_turn_index FROM p""")
def online_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each constraint is injected into three turns; the fold keeps it once, from the first."""
    pairs = contexts(spark, sf_dir).filter(F.size(M.user_turns(_m())) > 0).crossJoin(C.catalogue(spark))
    places = C.targets(_m(), F.lit("top"), F.lit(3), F.col("conv_id"), F.col("id"))
    found = E.registry(C.injected(_m(), places, C.framed(F.col("sssc"), F.lit(True), F.lit(True))))
    rows = pairs.select("conv_id", F.col("id").alias("sssc_id"), found.alias("r"))
    return rows.select("conv_id", "sssc_id", F.size("r").alias("n_items"), F.get("r", F.lit(0))["text"].alias("text"), F.get("r", F.lit(0))["source_turn_index"].alias("source_turn_index"))


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first_component FROM embeddings""")
def vector_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.round(norm, 6).alias("norm"), F.round(F.get(unit(F.col("embedding")), F.lit(0)), 6).alias("first_component"))


@query("""SELECT source, upper(substr(source, 1, 1)) || lower(substr(source, 2)) AS label, regexp_replace(source, '[^A-Za-z0-9]+', '_', 'g') AS slug, count(*) AS n FROM documents GROUP BY 1""")
def display_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.groupBy("source").agg(F.count("*").alias("n")).select("source", X.display_label(F.col("source"), {}, {}).alias("label"), X.slug(F.col("source")).alias("slug"), "n")


@query("""SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(avg(value), 9) AS mean_value FROM events GROUP BY 1, 2""")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: the batch form of the streaming windows."""
    return windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""WITH d AS (SELECT doc_id, lower(regexp_replace(text, '[^\\p{L}\\p{N}]+', ' ', 'g')) AS t FROM documents), b AS (SELECT item_id, trim(lower(regexp_replace(text, '[^\\p{L}\\p{N}]+', ' ', 'g'))) AS t FROM benchmark)
SELECT b.item_id, count(*) AS n_documents FROM b JOIN d ON contains(d.t, b.t) GROUP BY 1""")
def lexical_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical judge on documents: which hold a benchmark text.

    Items and documents meet on words: an item is looked for only where its rarest
    word occurs, so no text is compared with every other.  Words travel with ids alone;
    a document's text joins what it met.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", plain(F.col("text")).alias("t"))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", plain(F.col("text")).alias("i")).filter("i <> ''")
    words = items.select("item_id", "i", F.explode(F.array_distinct(F.split("i", " "))).alias("w"))
    spread = docs.select(F.explode(F.array_distinct(F.split("t", " "))).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    rarest = words.join(spread, "w", "left").groupBy("item_id", "i").agg(F.min_by("w", F.struct(F.coalesce("df", F.lit(0)), "w")).alias("w"))
    places = docs.select(F.col("doc_id").alias("doc"), F.explode(F.array_distinct(F.split("t", " "))).alias("w"))
    near = places.join(rarest, "w").select("doc", "item_id", "i").distinct()
    met = near.join(docs, F.col("doc").eqNullSafe(F.col("doc_id"))).filter(F.contains("t", "i"))
    return met.groupBy("item_id").agg(F.count("*").alias("n_documents"))


@query(r"""WITH w AS (SELECT conv_id, ('0x' || substr(md5(lower(x)), 1, 8))::BIGINT % 16 AS b FROM (SELECT conv_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]')) AS x FROM conversations)),
c AS (SELECT conv_id, b, count(*) AS n FROM w GROUP BY 1, 2) SELECT conv_id, count(*)::INTEGER AS n_buckets, round(sqrt(sum(n * n)), 6) AS norm FROM c GROUP BY 1""")
def hashed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors without a model, from the contexts' joined contents."""
    v = X.hashed_vector(M.embedding_text(_m()), 16)
    rows = contexts(spark, sf_dir).select("conv_id", v.alias("v"))
    return rows.select("conv_id", F.size(F.filter("v", lambda x: x > 0)).alias("n_buckets"), F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"))

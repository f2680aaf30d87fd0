"""Queries over the phases of an evaluation, scalar labels and report tables, with their twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import grading as G
from palimpsest.functions import messages as M
from palimpsest.functions import text as X
from palimpsest.operators import constraints as C
from palimpsest.operators import extraction as E
from palimpsest.operators import metrics as A
from palimpsest.operators import phases, reports, runs
from palimpsest.operators import stitching as K
from palimpsest.operators.compactors import compactor, model_compaction
from palimpsest.operators.evaluation import contexts, facts, manifest
from palimpsest.plans.registry import CONV_SQL, catalogue_sql, draw_sql, facts_sql, query
from palimpsest.sources.adapters import normalised

FACTS = facts_sql()
MSG = "list_transform({0}, lambda x: x.role || ':' || x.content)"


def plain(messages: Column) -> Column:
    return F.md5(F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|"))


def plain_sql(messages: str) -> str:
    return f"md5(array_to_string({MSG.format(messages)}, '|'))"


def with_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts(spark, sf_dir).filter(F.size(M.user_turns(F.col("messages"))) > 0)


@query(f"WITH {CONV_SQL} SELECT conv_id, {plain_sql('m')} AS digest FROM ctx")
def message_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only role and content of richer messages."""
    rich = F.transform("messages", lambda m: F.struct(F.lit(1).alias("id"), m["content"].alias("content"), m["role"].alias("role")))
    return contexts(spark, sf_dir).select("conv_id", plain(M.projected(rich)).alias("digest"))


@query("SELECT role, turn, CASE WHEN role = 'user' THEN 'user' WHEN role = 'assistant' AND turn % 2 = 0 THEN 'assistant' ELSE role END AS mapped, count(*) AS n FROM conversations GROUP BY ALL")
def runtime_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """human and ai as runtimes name them; other roles in lower case."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    spoken = F.when(F.col("role") == "user", " Human").when((F.col("role") == "assistant") & (F.col("turn") % 2 == 0), "AI").otherwise(F.upper("role"))
    return turns.groupBy("role", "turn", M.runtime_role(spoken).alias("mapped")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, count(*)::INTEGER + 1 AS n_messages, 'user' AS first_role, (sum(length(trim(text, ' '))) + 3)::BIGINT AS n_chars FROM (SELECT c.conv_id, c.text FROM conversations c WHERE trim(text, ' ') <> '' AND (turn // 2) IN (SELECT a.turn // 2 FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn % 2 = 0 AND b.turn = a.turn + 1 WHERE a.conv_id = c.conv_id)) GROUP BY 1")
def adapter_memory_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A context, then question and answer turns; pairs are a conversation's neighbouring turns."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    asked = turns.filter("turn % 2 = 0").select("conv_id", F.expr("turn div 2").alias("p"), F.col("text").alias("q"))
    said = turns.filter("turn % 2 = 1").select("conv_id", F.expr("turn div 2").alias("p"), F.col("text").alias("a"))
    listed = asked.join(said, ["conv_id", "p"]).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("p", "q", "a"))).alias("l"))
    records = listed.select("conv_id", F.lit("ctx").alias("context"), F.transform("l", lambda x: x["q"]).alias("questions"), F.transform("l", lambda x: F.array(x["a"], F.lit("other"))).alias("answers"))
    made = normalised(records, "memory", ("conv_id",))
    return made.select("conv_id", F.size("messages").alias("n_messages"), F.get("messages", F.lit(0))["role"].alias("first_role"), F.aggregate("messages", F.lit(0).cast("long"), lambda a, m: a + F.length(m["content"])).alias("n_chars"))


@query(f"WITH {CONV_SQL} SELECT conv_id, {plain_sql('m')} AS digest FROM (SELECT conv_id, list_filter(list_transform(m, lambda x: struct_pack(role := x.role, content := trim(x.content, ' '))), lambda x: x.content <> '') AS m FROM ctx)")
def adapter_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unknown source with turns in some records and messages in others."""
    turns = F.transform("messages", lambda m: F.struct(m["role"].alias("from"), m["content"].alias("value")))
    odd = F.col("conv_id") % 2 == 1
    none, empty = F.array().cast("array<struct<from: string, value: string>>"), F.array().cast(M.MESSAGES)
    mixed = contexts(spark, sf_dir).select("conv_id", F.when(odd, turns).otherwise(none).alias("conversations"), F.when(odd, empty).otherwise(F.col("messages")).alias("messages"))
    return normalised(mixed, "someone", ("conv_id",)).select("conv_id", plain(F.col("messages")).alias("digest"))


@query(FACTS + ", c AS (SELECT sssc_id, (sssc_id - 1) // 3 AS g FROM facts) SELECT sssc_id, min(f.sssc_type) AS category, count(*) AS n FROM facts f WHERE sssc_id IN (2, 5, 14) GROUP BY 1")
def constraint_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen constraints by id, with the category their id stands for."""
    rows = phases.of_constraints(facts(spark, sf_dir), (2, 5, 14))
    return rows.groupBy("sssc_id", C.category_of(F.col("sssc_id")).alias("category")).agg(F.count("*").alias("n"))


@query("""SELECT * EXCLUDE (top0), top0::DOUBLE AS top FROM (VALUES ('recent_4__top', 'recent_4', 'top', true, true, 'A10 recent_4', 'recent_4_top', 1.0),
('recent_4__middle', 'recent_4', 'middle', true, true, 'A10 recent_4', 'recent_4_middle', 0.0),
('recent_4__explicit_soft', 'recent_4', 'top', true, false, 'A10 recent_4', 'recent_4_explicit_soft', 1.0),
('recent_4__implicit_soft', 'recent_4', 'top', false, false, 'A10 recent_4', 'recent_4_implicit_soft', 1.0)) v(run_id, name, declared, explicit, hard, short, slug, top0)""")
def run_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read from a run's label and configuration: name, position, framing, short row label, file name."""
    flags = (("explicit_soft", True, False), ("implicit_soft", False, False), ("top", True, True), ("middle", True, True))
    rows = manifest(spark).filter(F.col("run_id").isin("recent_4__top", "recent_4__middle", "recent_4__explicit_soft", "recent_4__implicit_soft"))
    config = F.concat(F.lit("{'name': '"), F.col("compactor"), F.lit("', 'config': {}}"))
    framing = X.flag_suffix(F.col("run_id"), flags)
    return rows.select(
        "run_id", X.compactor_name(config).alias("name"), F.col("position").alias("declared"), framing["explicit"].alias("explicit"), framing["hard"].alias("hard"),
        X.abbreviated(F.lit("agent_10k"), F.col("compactor")).alias("short"), X.slug(F.col("run_id")).alias("slug"), X.verdict_number((F.col("position") == "top").cast("string")).alias("top"),
    )


@query(FACTS + """ SELECT run_id, dataset, compactor AS name, upper(substr(dataset, 1, 1)) || regexp_extract(dataset, '[0-9]+') || ' ' || compactor AS short,
  regexp_replace(run_id, '[^A-Za-z0-9]+', '_', 'g') AS slug, count(*) AS n, sum(retention::INTEGER)::BIGINT AS n_true FROM facts GROUP BY ALL""")
def fact_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All facts by the labels read from their runs: name out of a configuration, short row label, file name, verdicts as numbers."""
    rows = facts(spark, sf_dir).select("run_id", "dataset", "compactor", F.col("retention").cast("string").alias("verdict"))
    config = F.to_json(F.struct(F.col("compactor").alias("name"), F.struct(F.lit(1).alias("n")).alias("config")))
    labels = [X.compactor_name(config).alias("name"), X.abbreviated(F.col("dataset"), F.col("compactor")).alias("short"), X.slug(F.col("run_id")).alias("slug")]
    return rows.groupBy("run_id", "dataset", *labels).agg(F.count("*").alias("n"), F.sum(X.verdict_number(F.col("verdict"))).cast("long").alias("n_true"))


@query("SELECT * FROM (VALUES ('compactor.config.n', '4'), ('compactor.name', 'recent_4'), ('seed', '42')) v(name, value)")
def flattened_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = runs.config_cell({"seed": 42, "compactor": {"name": "recent_4", "config": {"n": 4}}})
    return spark.createDataFrame(sorted(cell.items()), "name string, value string")


@query("WITH f AS (SELECT doc_id, quality, CASE WHEN doc_id % 4 = 3 THEN 'C' WHEN quality = 1 THEN ' a' ELSE 'B ' END AS output FROM labels) SELECT output, quality, CASE WHEN output <> 'C' THEN upper(trim(output)) = 'A' END AS graded, count(*) AS n FROM f GROUP BY ALL")
def letter_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    said = F.when(F.col("doc_id") % 4 == 3, "C").when(F.col("quality") == 1, " a").otherwise("B ")
    return labels.select(said.alias("output"), "quality", G.letter_grade(said, F.lit("A")).alias("graded")).groupBy("output", "quality", "graded").agg(F.count("*").alias("n"))


@query("SELECT doc_id, 'think ' || doc_id || chr(10) || lang AS log FROM documents")
def graded_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    output = F.concat(F.lit("[analysis]\nthink "), F.col("doc_id"), F.lit("\n[final]\n"), F.col("lang"))
    return docs.select("doc_id", G.log_text(output).alias("log"))


def system_talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts(spark, sf_dir).withColumn("messages", F.concat(F.array(M.message("system", F.lit("be brief, please"))), F.col("messages")))


@query(f"WITH {CONV_SQL} SELECT conv_id, (list_sum(t) + 6)::INTEGER AS token_length, list_sum(t)::INTEGER AS later_length FROM ctx")
def dedup_aware_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a context adds to a stitched row as its first part, and as a later one without its system message."""
    return K.stitching_lengths(system_talks(spark, sf_dir), True)


@query(f"WITH {CONV_SQL}, g AS (SELECT conv_id // 3 AS source_row_index, count(*) AS k, sum(len(m))::INTEGER AS n, list(m ORDER BY conv_id) AS ms FROM ctx GROUP BY 1) SELECT source_row_index, n + 1 AS n_messages, md5('system:be brief, please|' || array_to_string(list_transform(flatten(ms), lambda x: x.role || ':' || x.content), '|')) AS digest FROM g")
def joined_with_one_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three contexts in a row; only the first keeps its system message."""
    talks = system_talks(spark, sf_dir)
    rows = talks.groupBy(F.expr("conv_id div 3").alias("source_row_index")).agg(F.array_sort(F.collect_list("conv_id")).alias("sources"))
    made = K.stitched_messages(rows, talks, one_system=True)
    return made.select("source_row_index", F.size("messages").alias("n_messages"), plain(F.col("messages")).alias("digest"))


@query(f"WITH {CONV_SQL} SELECT conv_id, len(m)::INTEGER + 3 AS n_messages, m[len(m)].content AS before_last, 'probe ' || conv_id AS last FROM ctx")
def probing_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """System prompt, tools, context and probe, as a probed model gets them."""
    talk = M.probing_conversation(C.system_prompt(F.lit("agent_10k")), F.lit(C.tools_message()), F.col("messages"), F.concat(F.lit("probe "), F.col("conv_id")))
    made = contexts(spark, sf_dir).select("conv_id", talk.alias("t"))
    return made.select("conv_id", F.size("t").alias("n_messages"), F.element_at("t", -2)["content"].alias("before_last"), F.element_at("t", -1)["content"].alias("last"))


def _pairs_sql() -> str:
    swap = draw_sql("'swap'", "conv_id", "cat.id")
    return f"""WITH {CONV_SQL}, {catalogue_sql()}, pr AS (SELECT conv_id AS source_row_index, cat.id AS sssc_id, cat.type AS sssc_type, m, u, {swap} < 0.5 AS swapped,
  cat.probe || chr(10) || 'A) ' || CASE WHEN {swap} < 0.5 THEN incorrect_answer ELSE correct_answer END || chr(10) || 'B) ' || CASE WHEN {swap} < 0.5 THEN correct_answer ELSE incorrect_answer END || chr(10) || 'Answer with A or B.' AS prompt FROM ctx, cat WHERE len(u) > 0)"""


@query(f"{_pairs_sql()} SELECT source_row_index, sssc_id, sssc_type, CASE WHEN swapped THEN 'B' ELSE 'A' END AS compliant_letter, md5(prompt) AS probe FROM pr")
def evaluation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every context with every constraint: type, probe and compliant letter."""
    rows = phases.pairs(spark, with_user(spark, sf_dir).withColumnRenamed("conv_id", "source_row_index"))
    return rows.select("source_row_index", "sssc_id", "sssc_type", "compliant_letter", F.md5("probe_prompt").alias("probe"))


def pairs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phases.pairs(spark, with_user(spark, sf_dir).withColumnRenamed("conv_id", "source_row_index"))


#: The letter stub answers A to prompts of odd length.
_ANSWER = "CASE WHEN length(prompt) % 2 = 1 THEN 'A' ELSE 'B' END"


@query(f"{_pairs_sql()} SELECT source_row_index, sssc_id, {_ANSWER} = CASE WHEN swapped THEN 'B' ELSE 'A' END AS full_with_sssc_compliant, {_ANSWER} = CASE WHEN swapped THEN 'B' ELSE 'A' END AS full_without_sssc_compliant, 'success' AS compaction_status FROM pr")
def evaluation_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compaction, four probes and the judge with stand-in models, resumed from a half that is done."""
    rows = pairs_of(spark, sf_dir)
    first = phases.evaluated(rows.filter("sssc_id % 2 = 0"), compactor("recent_4"), "stub_letter", "stub_judge")
    done = phases.evaluated(rows, compactor("recent_4"), "stub_letter", "stub_judge", first)
    return done.select("source_row_index", "sssc_id", "full_with_sssc_compliant", "full_without_sssc_compliant", "compaction_status")


@query(f"{_pairs_sql()} SELECT source_row_index, sssc_id, {_ANSWER} AS output, {_ANSWER} = CASE WHEN swapped THEN 'B' ELSE 'A' END AS reprobed_compliant FROM pr")
def reprobed_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed contexts probed again in one case."""
    rows = phases.reprobed(phases.compacted(pairs_of(spark, sf_dir), compactor("recent_4")), "stub_letter", ("full_without_sssc",))
    return rows.select("source_row_index", "sssc_id", "output", "reprobed_compliant")


@query(FACTS + " SELECT run_id || '__rejudged' AS run_id, source_row_index, sssc_id, NOT retention AS retention FROM facts WHERE manifest_pos = 0")
def rejudged_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run under a new id with another judge's verdicts."""
    rows = facts(spark, sf_dir).filter("manifest_pos = 0")
    verdicts = rows.select("source_row_index", "sssc_id", (~F.col("retention")).alias("retention"), F.lit("x").alias("retention_raw"))
    made = phases.rejudged(rows.withColumn("retention_raw", F.lit("y")), verdicts, "recent_2__top__rejudged")
    return made.select("run_id", "source_row_index", "sssc_id", "retention")


@query(FACTS + " SELECT source_row_index, sssc_id, a.retention AS baseline_retention, b.retention AS targeted_retention FROM (SELECT * FROM facts WHERE run_id = 'recent_4__top') a JOIN (SELECT * FROM facts WHERE run_id = 'extract_3__top') b USING (source_row_index, sssc_id)")
def prompt_pair_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda run: facts(spark, sf_dir).filter(F.col("run_id") == run)
    return phases.prompt_pairs(side("recent_4__top"), side("extract_3__top"), ["retention"])


@query(FACTS + " SELECT run_id, source_row_index, sssc_id, retention, compactor, position FROM facts WHERE status = 'success' AND manifest_pos < 4")
def run_config_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows without their configuration, joined with it by run."""
    rows = A.success(facts(spark, sf_dir)).filter("manifest_pos < 4").select("run_id", "source_row_index", "sssc_id", "retention")
    return rows.join(manifest(spark).select("run_id", "compactor", "position"), "run_id")


@query(FACTS + """, f AS MATERIALIZED (SELECT run_id, source_row_index, sssc_id, retention, manifest_pos FROM facts),
k AS (SELECT run_id, source_row_index, sssc_id FROM f WHERE sssc_id % 5 = 0 AND manifest_pos < 6) SELECT run_id, source_row_index, sssc_id, retention FROM f JOIN k USING (run_id, source_row_index, sssc_id)""")
def key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows named by a key list, looked up by the columns that make their key."""
    rows = facts(spark, sf_dir).select("run_id", "source_row_index", "sssc_id", "retention")
    keys = rows.filter(F.col("sssc_id") % 5 == 0).filter(F.col("run_id").startswith("recent_2") | F.col("run_id").isin("recent_4__top", "recent_4__middle", "recent_4__bottom")).select("run_id", "source_row_index", "sssc_id")
    return rows.join(keys, ["run_id", "source_row_index", "sssc_id"], "left_semi")


@query(f"WITH {CONV_SQL}, {catalogue_sql()}, s AS (SELECT 1::BIGINT AS one, lower(cat.sssc[1]) AS l, * FROM ctx, cat WHERE len(u) > 0) SELECT count(*) AS n, 1.0::DOUBLE AS avg_items, 1::INTEGER AS min_items, 1::INTEGER AS max_items, count(*) AS n_judged FROM s")
def extractor_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registries of contexts with one framed constraint each: items, and how many were judged."""
    found = pairs_of(spark, sf_dir).withColumn("registry", E.registry(F.col("injected"))).withColumn("retention", F.lit(True))
    stats = E.extraction_stats(found.select("registry", "retention"))
    return found.agg(F.count("*").alias("n")).crossJoin(stats.select("avg_items", "min_items", "max_items", "n_judged"))


@query(f"WITH {CONV_SQL} SELECT conv_id, least(len(m), 4)::INTEGER + 1 AS n_messages, '(none)' AS last FROM ctx")
def augmented_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compacted contexts with the running list of constraints as a last user message."""
    kept = compactor("recent_4").compact(F.col("messages"))
    made = contexts(spark, sf_dir).select("conv_id", E.augmented(kept, E.registry(F.col("messages"))).alias("m"))
    return made.select("conv_id", F.size("m").alias("n_messages"), F.element_at("m", -1)["content"].alias("last"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'error' ELSE 'success' END AS status, CASE WHEN doc_id % 7 <> 0 THEN 'short ' || doc_id END AS summary FROM documents")
def summaries_with_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that fails on some rows: its batches fall back to single rows, and those alone are errors."""

    def model(prompts: list[str]) -> list[str]:
        if any(int(p) % 7 == 0 for p in prompts):
            raise ValueError("cannot read this")
        return [f"short {p}" for p in prompts]

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("doc_id").cast("string").alias("prompt"))
    return model_compaction(docs, model, retries=1, id_cols=("doc_id",)).select("doc_id", "status", "summary")


_MEANS = FACTS + ", c AS (SELECT compactor, dataset, avg(retention::INTEGER) AS r FROM facts WHERE status = 'success' GROUP BY 1, 2)"


@query(_MEANS + """, w AS (SELECT compactor, max(r) FILTER (dataset = 'agent_10k') AS agent_10k, max(r) FILTER (dataset = 'agent_20k') AS agent_20k, max(r) FILTER (dataset = 'chat_10k') AS chat_10k FROM c GROUP BY 1)
SELECT compactor, round(agent_10k, 9) AS agent_10k, round(agent_20k, 9) AS agent_20k, round(chat_10k, 9) AS chat_10k FROM w UNION ALL SELECT 'Average', round(avg(agent_10k), 9), round(avg(agent_20k), 9), round(avg(chat_10k), 9) FROM w""")
def strict_pivot_with_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = A.cells(facts(spark, sf_dir)).select("compactor", "dataset", "x")
    sets = ["agent_10k", "agent_20k", "chat_10k"]
    wide = reports.with_average(reports.strict_pivot(means, "compactor", "dataset", "x", sets), "compactor")
    return wide.select("compactor", *[F.round(c, 9).alias(c) for c in sets])


@query(_MEANS + """ SELECT row_number() OVER (ORDER BY CASE dataset WHEN 'chat_10k' THEN 1 ELSE 2 END, dataset, CASE compactor WHEN 'extract_3' THEN 1 WHEN 'recent_6' THEN 2 ELSE 3 END, compactor) AS place, dataset, compactor, printf('%.1f%%', 100 * r) AS shown FROM c""")
def ordered_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by preferred orders, values not listed last by name, as percent; a dozen rows."""
    sorted_ = reports.ordered(A.cells(facts(spark, sf_dir)), {"dataset": ["chat_10k"], "compactor": ["extract_3", "recent_6"]}).coalesce(1)
    return sorted_.select((F.monotonically_increasing_id() + 1).alias("place"), "dataset", "compactor", reports.percent("x").alias("shown"))


@query(FACTS + """ SELECT dataset, compactor, avg(r) FILTER (explicit AND hard) AS "explicit hard", avg(r) FILTER (explicit AND NOT hard) AS "explicit soft", avg(r) FILTER (NOT explicit AND hard) AS "implicit hard", avg(r) FILTER (NOT explicit AND NOT hard) AS "implicit soft"
FROM (SELECT dataset, compactor, explicit, hard, round(avg(retention::INTEGER), 10) AS r FROM facts WHERE status = 'success' AND position = 'top' AND repeat = 1 GROUP BY ALL) GROUP BY 1, 2""")
def framing_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir).filter("position = 'top' and repeat = 1")
    return reports.framing_table(A.group_local(rows, "dataset", "compactor", "explicit", "hard"), "retention")


@query(FACTS + " SELECT compactor AS x, round(avg(retention::INTEGER), 9) AS y, dataset AS series FROM facts WHERE status = 'success' GROUP BY ALL")
def plot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.plot_table(A.cells(facts(spark, sf_dir)).withColumn("x", F.round("x", 9)).withColumnRenamed("x", "v"), "compactor", "v", "dataset")


@query(f"WITH {CONV_SQL}, k AS (SELECT role, count(*) AS n FROM conversations GROUP BY 1) SELECT role, n AS count FROM k ORDER BY n DESC, role LIMIT 1")
def most_common_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.most_common(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "role")


@query("WITH p AS (SELECT * FROM (VALUES (0, 1), (0, 2), (1, 1), (1, 2)) v(source_row_index, sssc_id)) SELECT source_row_index, sssc_id FROM p")
def swap_seed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs in the nested order of a sequential generator's draws; the draws themselves have a unit test."""
    return spark.createDataFrame([(r, c) for r, c, _, _ in C.pair_seeds(2, 2)], "source_row_index int, sssc_id int")

"""Queries over sources and sinks: each writes into the shared folder, reads back, and has a twin over the input."""

from __future__ import annotations

import io
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import messages as M
from palimpsest.operators.common import shared_folder
from palimpsest.operators.evaluation import MANIFEST, contexts, facts, lengths, turns_of
from palimpsest.plans.registry import CONV_SQL, facts_sql, query, tok
from palimpsest.sources import readers, writers
from palimpsest.sources.snapshots import SnapshotTable

FACTS = facts_sql()
#: Messages as a source gives them: trimmed, roles mapped, empty ones gone.
CLEAN_SQL = f"""WITH conv AS (SELECT conv_id, list(struct_pack(role := CASE WHEN lower(trim(role)) IN ('user', 'human') THEN 'user' WHEN lower(trim(role)) IN ('system', 'developer') THEN 'system' ELSE 'assistant' END, content := trim(text, ' ')) ORDER BY turn) FILTER (trim(text, ' ') <> '') AS m FROM conversations GROUP BY conv_id),
clean AS (SELECT conv_id, m, list_sum(list_transform(m, lambda x: {tok('x.role')} + {tok('x.content')} + 1))::INTEGER AS token_length FROM conv)"""


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/sources-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digest(df: DataFrame) -> DataFrame:
    return df.select(F.md5(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")).alias("digest"), F.size("messages").alias("n_messages"), F.col("token_length").cast("int").alias("token_length"))


DIGEST_SQL = "SELECT md5(array_to_string(list_transform(m, lambda x: x.role || ':' || x.content), '|')) AS digest, len(m)::INTEGER AS n_messages, token_length FROM clean"


@query(f"{CLEAN_SQL} {DIGEST_SQL}")
def source_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered source from its folder: adapter, cleaning, token lengths, and the check that it is not empty."""
    root = folder(spark)
    contexts(spark, sf_dir).write.parquet(f"{root}/ultrachat")
    return digest(readers.read_source(spark, root, "ultrachat"))


@query(f"{CLEAN_SQL} {DIGEST_SQL}")
def source_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharded Parquet below a configuration and a split; other columns are not read."""
    root = folder(spark)
    parts = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.array(F.struct(m["content"].alias("text"))).alias("content")))
    contexts(spark, sf_dir).select("conv_id", parts.alias("messages"), F.lit("x" * 50).alias("unused")).repartition(3, "conv_id").write.parquet(f"{root}/openresearcher/seed_42/train")
    return digest(readers.read_source(spark, root, "openresearcher"))


@query("SELECT CASE doc_id % 3 WHEN 0 THEN 'gov_report' WHEN 1 THEN 'qmsum' ELSE 'multi_news' END AS member, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM benchmark_rows GROUP BY 1".replace("benchmark_rows", "(SELECT item_id AS doc_id, text FROM benchmark)"))
def source_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of a ZIP of JSON lines; the benchmark's few items make one."""
    names, content = ("gov_report", "qmsum", "multi_news"), io.BytesIO()
    items = table(spark, sf_dir, "benchmark").select("item_id", F.to_json(F.struct(F.lit("").alias("input"), F.col("text").alias("context"))).alias("json")).orderBy("item_id").collect()
    with zipfile.ZipFile(content, "w") as archive:
        for i, name in enumerate(names):
            archive.writestr(f"data/{name}.jsonl", "\n".join(r.json for r in items if r.item_id % 3 == i))
    path = f"{folder(spark)}/items.zip"
    writers.write_bytes(spark, content.getvalue(), path)
    rows = readers.zipped_json_lines(spark, path, names, "input string, context string")
    return rows.groupBy("member").agg(F.count("*").alias("n"), F.sum(F.length("context")).alias("n_chars"))


@query(f"""WITH {CONV_SQL} SELECT row_number() OVER (ORDER BY conv_id) - 1 AS source_row_index, list_sum(t)::INTEGER AS token_length FROM ctx QUALIFY source_row_index < 10""")
def saved_dataset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset is written once, kept columns only, and read with a row cap."""
    path, rows = f"{folder(spark)}/dataset", contexts(spark, sf_dir)
    made = rows.withColumn("token_length", M.total_tokens(F.col("messages"))).select(F.col("conv_id").alias("source_row_index"), "messages", "token_length", F.lit(1).alias("dropped"))
    first = writers.write_dataset(made, path)
    writers.write_dataset(made.limit(1), path)  # what is there stays
    return readers.read_dataset(spark, path, 10).select("source_row_index", "token_length").join(first.select("source_row_index"), "source_row_index")


def _run_folders(spark: SparkSession, sf_dir: str) -> tuple[str, list[dict]]:
    """The first three runs of the manifest, each in its folder; the second is a test run."""
    root, runs = folder(spark), [{"run_id": r[0] + ("__test__" if i == 1 else ""), "label": f"{r[1]} {r[2]}"} for i, r in enumerate(MANIFEST[:3])]
    rows = facts(spark, sf_dir)
    for run, made in zip(runs, MANIFEST[:3], strict=True):
        rows.filter(F.col("run_id") == made[0]).drop("run_id", "manifest_pos").write.parquet(readers.run_root(root, run["run_id"], "main"))
    return root, runs


@query(FACTS + " SELECT manifest_pos, run_id || CASE WHEN manifest_pos = 1 THEN '__test__' ELSE '' END AS run_id, compactor || ' ' || position AS run_label, 'main' AS experiment, count(*) AS n, count(*) FILTER (retention) AS n_retained FROM facts WHERE manifest_pos < 3 GROUP BY ALL")
def manifest_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of a listed set of runs in its order; a run listed twice counts once, a missing one is skipped."""
    root, runs = _run_folders(spark, sf_dir)
    listed = [runs[0], runs[1], runs[0], runs[2], {"run_id": "missing"}]
    rows = readers.union_runs(spark, root, [*listed[:2], *listed[3:]], "main", missing="skip")
    again = readers.union_runs(spark, root, listed, "main", missing="skip")
    counts = rows.groupBy("manifest_pos", "run_id", "run_label", "experiment").agg(F.count("*").alias("n"), F.count_if("retention").alias("n_retained"))
    return counts.join(again.groupBy("run_id").agg(F.count("*").alias("n")), ["run_id", "n"])


@query("SELECT * FROM (VALUES (0, 'recent_2__top', 'recent_2 top', 'test'), (1, 'recent_2__middle', 'recent_2 middle', 'test')) v(manifest_pos, run_id, run_label, experiment)")
def manifest_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.manifest_table(spark, [{"run_id": r[0], "label": f"{r[1]} {r[2]}"} for r in MANIFEST[:2]], "test")


@query("SELECT 'strict' AS mode, 'recent_4__explicit_soft' AS run_id UNION ALL SELECT 'first', 'recent_4__repeat2'")
def run_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run by its attributes: exactly one, or the first by id."""
    from palimpsest.operators.evaluation import manifest

    runs = manifest(spark)
    strict = readers.find_runs(runs, compactor="recent_4", position="top", repeat=1, explicit=True, hard=False)
    first = readers.find_runs(runs.filter("repeat > 1"), strict=False, compactor="recent_4")
    return strict.select(F.lit("strict").alias("mode"), "run_id").unionByName(first.select(F.lit("first").alias("mode"), "run_id"))


@query("SELECT * FROM (VALUES ('agent_cat_10k', 'a'), ('chat_cat_10k', 'b')) v(dataset, root)")
def dataset_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole datasets below two roots; of one name the first root's counts, and a broken one is left out."""
    root, one = folder(spark), spark.range(1)
    for where in ("a/agent_cat_10k", "b/chat_cat_10k", "b/agent_cat_10k", "a/other"):
        one.write.parquet(f"{root}/{where}")
    writers.write_bytes(spark, b"", f"{root}/a/broken_cat_5k/part-0.parquet")
    found = readers.discover_datasets(spark, [f"{root}/a", f"{root}/b"])
    return found.select("dataset", F.element_at(F.split("path", "/"), -2).alias("root"))


@query(f"WITH {CONV_SQL} SELECT conv_id AS source_row_index, len(m)::INTEGER AS n FROM ctx ORDER BY conv_id LIMIT 7")
def fallback_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second of two roots where the first cannot be read."""
    root = folder(spark)
    contexts(spark, sf_dir).withColumnRenamed("conv_id", "source_row_index").write.parquet(f"{root}/second")
    return readers.first_readable(spark, [f"{root}/first", f"{root}/second"], 7).select("source_row_index", F.size("messages").alias("n"))


@query("SELECT doc_id, quality, toxic FROM labels")
def json_lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{folder(spark)}/labels"
    writers.write_json_lines(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), path, "doc_id")
    return readers.json_lines(spark, path, "doc_id long, quality int, toxic int")


@query("SELECT doc_id AS id, quality, lang, '' AS label FROM labels JOIN documents USING (doc_id)")
def blind_and_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reviewer's file without verdicts and the key that is held aside, joined again by id."""
    path = folder(spark)
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").withColumnRenamed("doc_id", "id")
    for name, part in zip(("blind", "key"), writers.blind_and_key(rows, ["lang"], ["quality"]), strict=True):
        writers.write_json_lines(part, f"{path}/{name}")
    blind = readers.json_lines(spark, f"{path}/blind", "id long, label string, lang string")
    return blind.join(readers.json_lines(spark, f"{path}/key", "id long, quality int"), "id").select("id", "quality", "lang", "label")


@query(FACTS + " SELECT run_id, count(*) AS n FROM facts WHERE manifest_pos < 2 GROUP BY 1 UNION ALL SELECT run_id, count(*) FILTER (retention) FROM facts WHERE manifest_pos = 2 GROUP BY 1")
def results_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run written again replaces its own rows and no others."""
    path, rows = folder(spark), facts(spark, sf_dir)
    writers.write_results(rows.filter("manifest_pos < 3"), path)
    writers.write_results(rows.filter("manifest_pos = 2 and retention"), path)
    return spark.read.parquet(path).groupBy("run_id").agg(F.count("*").alias("n"))


@query(FACTS + " SELECT run_id, count(*) AS n, count(*) FILTER (status = 'error') AS n_errors FROM facts WHERE manifest_pos % 3 <> 0 OR status = 'success' GROUP BY 1")
def committed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of all runs committed once; every third run is then committed anew without its errors."""
    results, rows = SnapshotTable(spark, folder(spark), "run_id"), facts(spark, sf_dir).select("run_id", "manifest_pos", "source_row_index", "sssc_id", "status")
    first = results.replace(rows)
    results.replace_values(results.read(first).filter("manifest_pos % 3 = 0 and status = 'success'"), based_on=first)
    return results.read().groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "error").alias("n_errors"))


@query(FACTS + " SELECT compactor, count(*) FILTER (retention) AS n_retained, count(*) AS n FROM facts GROUP BY 1")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    writers.write_csv(facts(spark, sf_dir).groupBy("compactor").agg(F.count_if("retention").alias("n_retained"), F.count("*").alias("n")), path)
    return spark.read.option("header", True).schema("compactor string, n_retained long, n long").csv(path)


@query("SELECT dataset, test, num_convo, target_size, stitching_method FROM (VALUES ('chat', false, 3, 1000, 'topic')) v(dataset, test, num_convo, target_size, stitching_method)")
def json_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{folder(spark)}/manifest.json"
    writers.write_json(spark, writers.generation_manifest("chat", False, 3, 1000, "topic"), path)
    return spark.createDataFrame([writers.read_json(spark, path)], "dataset string, test boolean, num_convo int, target_size int, stitching_method string")


@query(f"WITH {CONV_SQL} SELECT conv_id, list_sum(t)::INTEGER AS token_length FROM ctx")
def cached_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made once under its identity; the second time it is read, and another identity is another table."""
    path, sizes = folder(spark), lengths(turns_of(spark, sf_dir)).select("conv_id", "token_length")
    identity = {"name": "lengths", "rows": 1}
    writers.cached(spark, path, identity, lambda: sizes)
    writers.cached(spark, path, identity | {"rows": 2}, lambda: sizes.limit(0))
    return writers.cached(spark, path, identity, lambda: sizes.limit(0))


@query("SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY 1")
def replaced_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table rewritten from itself: read, extended, replaced, and whole."""
    path, docs = f"{folder(spark)}/t", table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    writers.replace_table(docs.filter("doc_id % 2 = 0"), path)
    half = spark.read.parquet(path)
    writers.replace_table(half.unionByName(docs.filter("doc_id % 2 = 1")), path)
    return spark.read.parquet(path).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))

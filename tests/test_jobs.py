import pytest
from pyspark.sql import functions as F

from palimpsest.functions import messages as M
from palimpsest.operators.evaluation import contexts, facts
from palimpsest.operators import phases
from palimpsest.operators.common import released, stored, stored_in_buckets
from palimpsest.operators.compactors import compactor
from palimpsest.plans import jobs
from palimpsest.plans.analyses import ANALYSES
from palimpsest.sources import readers
from palimpsest.sources.snapshots import SnapshotTable
from palimpsest.sources.writers import exists

SF = "/root/testdata/sf0.001"


def test_dataset_jobs(spark, tmp_path):
    root = str(tmp_path)
    talks = contexts(spark, SF)
    talks.select(F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages")).write.parquet(f"{root}/ultrachat")
    base = {"root": root, "dataset": "ultrachat", "target_size": 400}
    trimmed = jobs.generate_dataset(spark, base | {"method": "trim", "out": f"{root}/trim"})
    assert trimmed.count() > 5 and trimmed.filter(M.total_tokens(F.col("messages")) < 400).isEmpty()
    stitched = jobs.generate_dataset(spark, base | {"method": "vanilla", "out": f"{root}/vanilla", "test": True})
    assert stitched.count() == 5 and stitched.filter(M.total_tokens(F.col("messages")) != F.col("token_length")).isEmpty()
    topic = jobs.generate_dataset(spark, base | {"method": "topic", "out": f"{root}/topic"})
    assert topic.count() >= 1 and topic.filter(M.total_tokens(F.col("messages")) != F.col("token_length")).isEmpty()
    spark.read.parquet(f"{SF}/embeddings.parquet").withColumnRenamed("vec_id", "conv_id").write.parquet(f"{root}/vectors")
    given = jobs.generate_dataset(spark, base | {"method": "topic", "vectors": f"{root}/vectors", "out": f"{root}/given", "num_convo": 2})
    assert given.count() == 2
    with pytest.raises(Exception, match="rows were made"):
        jobs.generate_dataset(spark, base | {"method": "topic", "out": f"{root}/many", "num_convo": 500})
    summary = jobs.dataset_summary(spark, {"trim": f"{root}/trim", "vanilla": f"{root}/vanilla"}).collect()
    assert [(r.dataset, r.n_rows) for r in summary] == [("trim", trimmed.count()), ("vanilla", 5)]

    config = {"root": root, "datasets": {"name": "d_1k", "path": f"{root}/trim", "rows": 3}, "probes": {"name": "p", "runtime": "stub_letter"}, "compactors": "recent_3", "evaluator": {"name": "j", "runtime": "stub_judge"}}
    (run,) = jobs.evaluate(spark, config)
    assert jobs.evaluate(spark, config | {"snapshots": f"{root}/committed"}) == [run]
    assert SnapshotTable(spark, f"{root}/committed", "run_id").read().filter(F.col("run_id") == run).count() == 45
    table = readers.union_runs(spark, root, [{"run_id": run}], "main")
    assert table.count() == 45 and table.filter("run_id is null or retention is null").isEmpty()


def test_source_rows_keep_the_order_of_their_files(spark, tmp_path):
    spark.range(50, 100).coalesce(1).write.parquet(f"{tmp_path}/b")
    spark.range(50).coalesce(1).write.parquet(f"{tmp_path}/a")
    rows = readers.in_file_order(spark.read.parquet(f"{tmp_path}/b", f"{tmp_path}/a"), "n").collect()
    assert [(r.n, r.id) for r in sorted(rows, key=lambda r: r.n)] == [(i, i) for i in range(100)]


def test_analysis_job(spark, tmp_path):
    facts(spark, SF).write.parquet(f"{tmp_path}/facts")
    settings = {"focal": "extract_3", "home": "chat_10k", "runs": ["recent_4__top", "recent_4__middle"], "left": "recent_4__top", "right": "recent_4__bottom", "second": "compacted", "markers": [["recent", "window"]]}
    done = jobs.JOBS["analyse"](spark, {"facts": f"{tmp_path}/facts", "out": f"{tmp_path}/out", "settings": settings})
    assert set(done) == set(ANALYSES)
    count = lambda name: spark.read.option("header", True).csv(f"{tmp_path}/out/{name}").count()
    assert (count("main_experiment/headline"), count("main_experiment/per_run"), count("constraint_types/by_type"), count("prompt_targeting/delta_ci")) == (12, 17, 5, 1)
    report = (tmp_path / "out" / "report.md").read_text()
    assert report.startswith("## Headline") and report.count("\n|") == 14
    few = jobs.analyse(spark, {"facts": f"{tmp_path}/facts", "out": f"{tmp_path}/few", "analyses": ["repeats"]})
    assert few == {"repeats": ["repeat"]}
    committed = SnapshotTable(spark, f"{tmp_path}/committed", "run_id")
    committed.replace(spark.read.parquet(f"{tmp_path}/facts"))
    committed.replace_values(committed.read().filter("run_id = 'recent_4__top' and status = 'success'"))
    for version in (1, 2):
        jobs.analyse(spark, {"snapshots": f"{tmp_path}/committed", "version": version, "out": f"{tmp_path}/v{version}", "analyses": ["main_experiment"]})
    runs = [spark.read.option("header", True).csv(f"{tmp_path}/v{v}/main_experiment/per_run").count() for v in (1, 2)]
    assert runs == [17, 17] and committed.read().count() < committed.read(1).count()
    with pytest.raises(ValueError, match="needs focal, home"):
        jobs.analyse(spark, {"facts": f"{tmp_path}/facts", "out": f"{tmp_path}/few", "analyses": ["style_match"]})


def test_extractor_reprobe_and_summary_jobs(spark, tmp_path):
    root = str(tmp_path)
    talks = contexts(spark, SF).filter(F.size(M.user_turns(F.col("messages"))) > 0).limit(4).withColumnRenamed("conv_id", "source_row_index")
    sized = talks.withColumn("token_length", M.total_tokens(F.col("messages"))).withColumn("source_conversation_count", F.lit(1))
    sized.write.parquet(f"{root}/chat_cat_1k")
    found = jobs.extract(spark, {"dataset": f"{root}/chat_cat_1k", "name": "d", "out": root})
    assert found.count() == 60 and found.filter("not retention or size(registry) = 0").isEmpty() and found.first().run_id == "d__rules__lexical"
    phases.compacted(phases.pairs(spark, talks), compactor("recent_2")).write.parquet(f"{root}/contexts")
    answers = jobs.reprobe(spark, {"contexts": f"{root}/contexts", "runtime": "stub_letter", "cases": ["compacted"], "out": f"{root}/answers"})
    assert answers.count() == 60 and answers.filter("reprobed_compliant is null").isEmpty()
    judged = jobs.reprobe(spark, {"contexts": f"{root}/contexts", "runtime": "stub_letter", "judge": "stub_judge", "cases": ["compacted"], "out": f"{root}/judged"})
    assert judged.count() == 60 and "verdict" in judged.columns
    summary = jobs.summarise_datasets(spark, {"roots": [root], "out": f"{root}/summary"}).collect()
    assert [(r.dataset, r.n_rows, r.avg_sources) for r in summary] == [("chat_cat_1k", 4, 1.0)]


def test_what_a_job_stores_on_the_way_is_removed(spark, tmp_path):
    before = facts(spark, SF).count()
    path, table = stored(spark.range(5))
    bucketed, name = stored_in_buckets(spark.range(5).withColumn("p", F.lit(1)), ["id"], 2, "p")
    assert table.count() == spark.table(name).count() == 5
    assert released(spark) >= 2 and released(spark) == 0
    assert not exists(spark, path) and not exists(spark, bucketed) and not spark.catalog.tableExists(name)
    assert facts(spark, SF).count() == before  # made again

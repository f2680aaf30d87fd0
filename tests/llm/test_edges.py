"""Pipeline stages and queries on hard rows: nulls anywhere, repeats, clashing extra columns."""

import random

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import queries, secrets

rng = random.Random(9)
PROSE = "The old bridge across the river was closed in spring because two of its seven arches had begun to sink, and the council could not agree whether stone or steel should carry the road. "
VOCABULARY = sorted(secrets.dictionary(P.path("byte_bpe_50k.tiktoken")))
LONG = " ".join(rng.choice(VOCABULARY) for _ in range(12_000))
OTHER = " ".join(f"Chapter {rng.randrange(10**6)} tells of {rng.choice(['ships', 'storms', 'songs', 'stones'])} and the {rng.randrange(10**6)} people who kept them." for _ in range(30))
ROWS = [
    (1, PROSE + OTHER, "en", "src1"),
    (1, PROSE + OTHER, "en", "src1"),
    (None, PROSE + OTHER, None, None),
    (None, OTHER[::-1], "xx", "src2"),
    (2, None, "en", None),
    (3, "", None, "src3"),
    (4, LONG, "en", "src4"),
    (5, "short", "de", "src5"),
    (6, OTHER[500:] + " The password=b7db7aa4a5fcc78305 was changed. " + OTHER[:300], "en", "tests/fixture"),
]


@pytest.fixture(scope="module")
def hard(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit(None).cast("string") for c in ("key", "rest", "spans", "node", "kept", "ids", "start", "marks", "at")}).repartition(3)


def test_stages_on_hard_rows(spark, hard):
    docs = hard
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), hard.schema)
        assert docs.columns == hard.columns, name
    left = docs.collect()
    assert any(r.doc_id == 4 for r in left) and not any(r.doc_id in (2, 3, 5) for r in left)
    assert sum(r.text is not None and r.text.startswith(PROSE[:60]) for r in left) <= 1
    assert not any("b7db7aa4a5fcc78305" in r.text for r in left)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert sum(r.length for r in packed if r.start == 0) > 0 and {r.doc_id for r in packed} == {r.doc_id for r in left}


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES if s[0] != "sequence_packing"], ids=lambda s: s[0])
def test_each_stage_alone(spark, hard, stage):
    out = stage[1](spark, hard, "")
    assert out.columns == hard.columns and out.count() <= len(ROWS)


def test_packing_stage_alone(spark, hard):
    packed = dict(corpus_pipeline.STAGES)["sequence_packing"](spark, hard, "").collect()
    assert sum(r.start == 0 for r in packed) == len(ROWS) and {r.doc_id for r in packed} == {i for i, *_ in ROWS}
    assert [r.length for r in packed if r.doc_id in (2, 3)] == [1, 1] and max(r.offset + r.length for r in packed) <= 2048
    assert sum(r.length for r in packed if r.doc_id == 4) == next(r.doc_tokens for r in packed if r.doc_id == 4) > 2048


def test_stages_without_language_or_source(spark, hard):
    bare = hard.drop("lang", "source")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, bare, "")
        assert out.columns == bare.columns, name
        assert out.count() > 0


@pytest.mark.parametrize("name", [q for q in queries.QUERIES if q not in ("op6_voronoi_top_k", "op7_link_graph", "op11_ball_tree", "op12_phrase_collocations")])
def test_queries_give_every_row(spark, hard, tmp_path, name):
    hard.write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.QUERIES[name](spark, str(tmp_path))
    rows = out.collect()
    assert (sum(r.start == 0 for r in rows) if "start" in out.columns else len(rows)) == len(ROWS)
    hard.limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert queries.QUERIES[name](spark, f"{tmp_path}/empty").count() == 0


@pytest.mark.parametrize(("name", "schema"), [("op6_voronoi_top_k", "vec_id long, embedding array<float>, label int"), ("op7_link_graph", "page_id long, url string, html string")])
def test_queries_on_null_rows(spark, tmp_path, name, schema):
    table = "embeddings" if "vec" in schema else "pages"
    spark.createDataFrame([(None, None, None), (0, None, None)], schema).write.parquet(f"{tmp_path}/{table}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == (0 if table == "embeddings" else 2)

"""The evaluation table: every conversation, constraint and run with its verdicts.

Verdicts of models come from deterministic stand-ins: draws keyed by what is judged.
Facts are narrow: keys, verdicts and token counts.  Injected and compacted texts are
made only where a query asks for them, as they are fifteen copies of every context.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.messages import assemble, contains_text, user_turns
from palimpsest.functions.text import draw, first_sentence, token_count
from palimpsest.operators import constraints as C
from palimpsest.operators.common import PAIR, stored_in_buckets
from palimpsest.operators.compactors import compactor
from palimpsest.sources.writers import complete, file_system

COMPACTORS = ("recent_2", "recent_4", "recent_6", "extract_3")
POSITIONS = ("top", "middle", "bottom")
#: run_id, compactor, position, repeat, explicit, hard; the order is the manifest's.
MANIFEST = (
    *((f"{c}__{p}", c, p, 1, True, True) for c in COMPACTORS for p in POSITIONS),
    ("recent_4__explicit_soft", "recent_4", "top", 1, True, False),
    ("recent_4__implicit_hard", "recent_4", "top", 1, False, True),
    ("recent_4__implicit_soft", "recent_4", "top", 1, False, False),
    ("recent_4__repeat2", "recent_4", "top", 2, True, True),
    ("recent_4__repeat3", "recent_4", "top", 3, True, True),
)
DATASETS = ("agent_10k", "agent_20k", "chat_10k")
VERDICTS = ("uninjected", "injected", "compacted", "post")


def manifest(spark: SparkSession) -> DataFrame:
    """One row a run with its place; seventeen rows, always."""
    rows = [(i, *r) for i, r in enumerate(MANIFEST)]
    return F.broadcast(spark.createDataFrame(rows, "manifest_pos int, run_id string, compactor string, position string, repeat int, explicit boolean, hard boolean"))


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, messages`` of the conversations."""
    return assemble(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def turns_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def lengths(turns: DataFrame) -> DataFrame:
    """``conv_id, token_length, turns, users``: sums, so no text is shuffled."""
    tokens = token_count(F.col("role")) + token_count(F.col("text")) + 1
    return turns.groupBy("conv_id").agg(F.sum(tokens).cast("int").alias("token_length"), F.count("*").cast("int").alias("turns"), F.count_if(F.col("role") == "user").cast("int").alias("users"))


def features(turns: DataFrame, partitions: int | None = None) -> DataFrame:
    """What the facts need of a context: places and token counts of its turns.

    Tokens are counted before turns are gathered, so texts stay where they are read.
    ``partitions``: over how many the contexts are dealt; they are small, and what is made of them is not.
    """
    user = F.col("role") == "user"
    narrow = turns.select("conv_id", F.struct(F.col("turn").alias("at"), user.alias("user"), (token_count(F.col("role")) + token_count(F.col("text")) + 1).alias("t"), F.when(user, token_count(first_sentence(F.col("text")))).alias("f")).alias("m"))
    dealt = narrow.repartition(partitions, "conv_id") if partitions else narrow
    listed = dealt.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    places = F.filter(F.transform("m", lambda x, i: F.when(x["user"], i)), lambda i: i.isNotNull())
    said = F.slice(F.transform(F.filter("m", lambda x: x["user"]), lambda x: x["f"]), 1, 3)
    return listed.select(
        "conv_id", F.size("m").alias("turns"), places.alias("users"), F.transform("m", lambda x: x["t"]).alias("tokens"),
        F.aggregate(said, F.lit(2), lambda a, x: a + x).alias("extract_tokens"),
    ).filter(F.size("users") > 0)


#: Bytes of conversations to a bucket of facts; the number of buckets follows from the input.
BUCKET_BYTES = 2 << 20
#: Bytes of conversations to a task that makes facts; a bucket's facts are hundreds of times their contexts' places.
MADE_BYTES = 1 << 20
_STORED: dict[tuple, tuple[str, str, list[str]]] = {}


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``made_facts`` as a table in the shared folder, by run and in buckets of the pair, written once for a session and an input.

    Runs, judges and prompts are compared on the pair, so their joins need no shuffle.
    The input counts as the same while its files' names, sizes and times are.
    """
    files, where = file_system(spark, f"{sf_dir}/conversations.parquet")
    listed = files.listStatus(where)
    state = tuple(sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in listed))
    key = (spark.sparkContext.applicationId, sf_dir, state)
    if key not in _STORED or not complete(spark, _STORED[key][0]):
        size = sum(n for _, n, _ in state)
        made = made_facts(spark, sf_dir, max(4, -(-size // MADE_BYTES)))
        _STORED[key] = (*stored_in_buckets(made, PAIR, max(4, -(-size // BUCKET_BYTES)), "run_id"), made.columns)
    return spark.table(_STORED[key][1]).select(*_STORED[key][2])


def made_facts(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    """One row for each conversation, constraint and run.

    A constraint is retained where one of its target turns is kept; that equals the
    text judge's answer on the injected and compacted context.
    """
    base = features(turns_of(spark, sf_dir), partitions).crossJoin(manifest(spark)).crossJoin(C.catalogue(spark).select(F.col("id").alias("sssc_id"), F.col("type").alias("sssc_type")))
    conv, cid, run, users = F.col("conv_id"), F.col("sssc_id"), F.col("run_id"), F.col("users")
    drawn = F.slice(F.array_sort(F.transform(users, lambda i: F.struct(draw("rep", conv, cid, i).alias("d"), i.alias("i")))), F.lit(1), F.least(F.col("repeat"), F.size(users)))
    n = F.size(users)
    at = F.when(F.col("position") == "top", 0).when(F.col("position") == "middle", F.floor(n / 2).cast("int")).otherwise(n - 1)
    places = F.when(F.col("repeat") > 1, F.transform(drawn, lambda x: x["i"])).otherwise(F.array(F.get(users, at)))
    recent = F.regexp_extract("compactor", r"^recent_(\d+)$", 1)
    is_recent = recent != ""
    window = F.when(is_recent, recent).otherwise("0").cast("int")
    cut = F.slice(users, 1, 3)
    kept = F.when(is_recent, F.exists("places", lambda i: i >= F.col("turns") - window)).otherwise(F.arrays_overlap("places", cut))
    sums = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    after = F.when(is_recent, sums(F.slice("tokens", F.greatest(F.col("turns") - window, F.lit(0)) + 1, F.greatest(window, F.lit(1))))).otherwise(F.col("extract_tokens"))
    ok = draw("err", run, conv, cid) >= 0.02
    known = lambda name, *key: draw("null", name, *key) >= 0.03
    framing = (F.col("position"), F.col("repeat"), F.col("explicit").cast("int"), F.col("hard").cast("int"))
    lift = F.when(F.col("explicit"), 0.05).otherwise(0.0) + F.when(F.col("hard"), 0.05).otherwise(0.0)
    return (
        base.withColumn("places", places)
        .withColumn("kept", kept)
        .withColumn("ok", ok)
        .select(
            "manifest_pos", "run_id",
            F.element_at(F.array(*[F.lit(d) for d in DATASETS]), (F.pmod(conv, F.lit(3)) + 1).cast("int")).alias("dataset"),
            "compactor", "position", "repeat", "explicit", "hard",
            conv.alias("source_row_index"), "sssc_id", "sssc_type",
            F.when(F.col("ok"), "success").otherwise("error").alias("status"),
            F.when(known("uninjected", conv, cid), draw("uninjected", conv, cid) < 0.3 + 0.01 * cid).alias("uninjected"),
            F.when(known("injected", conv, cid, *framing), draw("injected", conv, cid, *framing) < 0.75 + lift).alias("injected"),
            F.when(F.col("ok") & known("compacted", run, conv, cid), draw("compacted", run, conv, cid) < F.when(F.col("kept"), 0.8 + lift).otherwise(0.35)).alias("compacted"),
            F.when(F.col("ok") & known("post", run, conv, cid), draw("post", run, conv, cid) < 0.9).alias("post"),
            F.when(F.col("ok"), F.col("kept")).alias("retention"),
            "turns",
            sums(F.col("tokens")).alias("tokens_before"),
            F.when(F.col("ok"), after).alias("tokens_after"),
        )
    )


def judged_contexts(spark: SparkSession, sf_dir: str, compactor_name: str, position: str, explicit: bool = True, hard: bool = True) -> DataFrame:
    """The same pipeline on texts: inject, compact, and judge what is left."""
    pairs = contexts(spark, sf_dir).filter(F.size(user_turns(F.col("messages"))) > 0).crossJoin(C.catalogue(spark))
    wrapped = C.framed(F.col("sssc"), F.lit(explicit), F.lit(hard))
    made = pairs.withColumn("wrapped", wrapped).withColumn("full", C.injected(F.col("messages"), C.targets(F.col("messages"), F.lit(position), F.lit(1)), F.col("wrapped")))
    left = made.withColumn("context", compactor(compactor_name).compact(F.col("full")))
    return left.select("conv_id", F.col("id").alias("sssc_id"), F.col("type").alias("sssc_type"), "context", contains_text(F.col("context"), F.col("wrapped")).alias("retention"))

"""Aggregations over the evaluation facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.stats import agreement, bounds, cluster_interval, effect_retention, few_valued_interval, invalid_rate, kappa_of, mcnemar_exact, rate, ratio, resampled_means, resampled_sums, value_counts
from palimpsest.operators.common import PAIR, checkpointed, numbered_within

CASES = ("uninjected", "injected", "compacted", "post")


def r10(c: Column) -> Column:
    return F.round(c, 10)


def success(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("status") == "success")


def retention_by(facts: DataFrame, *keys: str) -> DataFrame:
    """Rate over judged rows; ``n_judged`` counts those, ``n_rows`` all of the group."""
    kept = F.col("retention")
    return facts.groupBy(*keys).agg(r10(rate(kept)).alias("retention_rate"), F.count_if(kept).alias("n_retained"), F.count(kept).alias("n_judged"), F.count("*").alias("n_rows"))


def compression(facts: DataFrame) -> DataFrame:
    """Token counts and the mean of the rows' ratios, one decimal in percent, half to even."""
    return success(facts).groupBy("compactor").agg(F.round(F.avg("tokens_before"), 6).alias("avg_before"), F.round(F.avg("tokens_after"), 6).alias("avg_after"), F.round(F.avg(F.col("tokens_after") / F.col("tokens_before")), 9).alias("avg_ratio"), F.count("*").alias("n_rows"))


def first_runs(facts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns of each pair's first run in the manifest, by partial aggregation."""
    return facts.groupBy(*PAIR).agg(F.min_by(F.struct(*columns), "manifest_pos").alias("first")).select(*PAIR, "first.*")


def baselines(facts: DataFrame) -> DataFrame:
    """Rates of the conditions that no compactor touches: all rows, each pair once, the first run's."""
    once = first_runs(facts, ("uninjected", "injected"))
    return once.groupBy("dataset").agg(rate(F.col("uninjected")).alias("base"), rate(F.col("injected")).alias("injected_base"))


def headline(facts: DataFrame) -> DataFrame:
    """By dataset and compactor: rates, calibrated compliance and effect retention."""
    done = success(facts).groupBy("dataset", "compactor").agg(F.count("*").alias("n"), rate(F.col("retention")).alias("retention"), rate(F.col("compacted")).alias("compacted"), rate(F.col("post")).alias("upper"))
    joined = done.join(baselines(facts), "dataset")
    return joined.select("dataset", "compactor", "n", *[r10(F.col(c)).alias(c) for c in ("retention", "compacted", "base", "injected_base", "upper")], r10(F.col("compacted") - F.col("base")).alias("calibrated"), r10(effect_retention(F.col("compacted"), F.col("base"), F.col("upper"))).alias("effect_retention"))


def group_local(facts: DataFrame, *keys: str) -> DataFrame:
    """As the headline, with each group's own success rows as its baseline."""
    done = success(facts).groupBy(*keys).agg(F.count("*").alias("n"), rate(F.col("retention")).alias("retention"), rate(F.col("uninjected")).alias("base"), rate(F.col("compacted")).alias("compacted"), rate(F.col("post")).alias("upper"))
    return done.select(*keys, "n", *[r10(F.col(c)).alias(c) for c in ("retention", "base", "compacted", "upper")], r10(F.col("compacted") - F.col("base")).alias("calibrated"), r10(effect_retention(F.col("compacted"), F.col("base"), F.col("upper"))).alias("effect_retention"))


def per_run(facts: DataFrame) -> DataFrame:
    """One row a run: ``retained/judged`` as text and rates to four decimals."""
    done = facts.groupBy("manifest_pos", "run_id").agg(F.count_if("retention").alias("k"), F.count("retention").alias("j"), *[F.round(rate(F.col(c)), 4).alias(c) for c in CASES], F.count_if(F.col("status") == "success").alias("n_success"), F.count("*").alias("n_rows"), r10(invalid_rate(F.col("compacted"))).alias("invalid_rate"))
    return done.select("manifest_pos", "run_id", F.format_string("%d/%d", "k", "j").alias("retained"), *CASES, "n_success", "n_rows", "invalid_rate")


def long_verdicts(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each verdict column: keys, ``case``, ``verdict``."""
    return facts.unpivot(list(keys), list(CASES), "case", "verdict")


def four_groups(facts: DataFrame) -> DataFrame:
    """Rate and count of each condition by dataset and compactor; the two shared ones once a dataset."""
    keys = ["dataset", "compactor"]
    done = success(facts)
    own = long_verdicts(done, keys).filter(F.col("case").isin("compacted", "post")).groupBy(*keys, "case").agg(r10(rate(F.col("verdict"))).alias("rate"), F.count("verdict").alias("n"))
    once = first_runs(done, CASES)
    shared = long_verdicts(once, ["dataset"]).filter(F.col("case").isin("uninjected", "injected")).groupBy("dataset", "case").agg(r10(rate(F.col("verdict"))).alias("rate"), F.count("verdict").alias("n"))
    return own.unionByName(own.select(*keys).distinct().join(shared, "dataset", "left"))


def decomposition(groups: DataFrame) -> DataFrame:
    """The gap from injected to compacted compliance as three parts that add up to it."""
    wide = groups.groupBy("dataset", "compactor").pivot("case", list(CASES)).agg(F.first("rate"))
    position, loss = F.col("post") - F.col("injected"), F.col("injected") - F.col("compacted")
    gap = F.col("post") - F.col("compacted")
    return wide.select("dataset", "compactor", r10(position).alias("position_advantage"), r10(loss).alias("compaction_loss"), r10(gap - position - loss).alias("residual"), r10(gap).alias("total_gap"), (F.abs(gap - position - loss) < 1e-9).alias("identity_check"))


def paired_loss(facts: DataFrame, replicates: int = 2000) -> DataFrame:
    """Mean of injected minus compacted over rows where both are known, with its interval."""
    both = success(facts).withColumn("d", F.col("injected").cast("int") - F.col("compacted").cast("int"))
    out = few_valued_interval(both, ["compactor"], "d", (-1, 0, 1), replicates, seed="loss")
    return out.select("compactor", "n", F.col("mean").alias("loss"), "low", "high")


def confusion(facts: DataFrame) -> DataFrame:
    """Compliance (with unknown) against retention, as counts and percent; unknown retention is dropped."""
    known = success(facts).filter("retention is not null").withColumn("compliance", F.coalesce(F.col("compacted").cast("string"), F.lit("unknown")))
    cells = known.groupBy("compliance").pivot("retention", [True, False]).count().na.fill(0)
    total = F.sum(F.col("true") + F.col("false")).over(W.partitionBy())
    return cells.select("compliance", F.col("true").alias("retained"), F.col("false").alias("lost"), r10(100 * F.col("true") / total).alias("retained_percent"), r10(100 * F.col("false") / total).alias("lost_percent"))


def complied_without(facts: DataFrame) -> DataFrame:
    """Not retained, yet complied: shares by what the model did without the constraint."""
    rows = success(facts).filter(~F.col("retention") & F.col("compacted"))
    kind = F.when(F.col("uninjected"), "complies_anyway").when(~F.col("uninjected"), "complies_only_after").otherwise("unknown")
    counts = rows.groupBy("compactor", kind.alias("kind")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", r10(F.col("n") / F.sum("n").over(W.partitionBy("compactor"))))


def null_cases(facts: DataFrame) -> DataFrame:
    return success(facts).filter("compacted is null").select("run_id", "dataset", F.col("source_row_index").alias("row"), F.col("sssc_id").alias("constraint_id"), F.col("sssc_type").alias("constraint_type"), "retention", "uninjected")


def grouping_sets(facts: DataFrame) -> DataFrame:
    """Micro averages for all, each dataset, and each dataset and type, in one pass."""
    sets = [[], ["dataset"], ["dataset", "sssc_type"]]
    done = success(facts).groupingSets([[F.col(c) for c in s] for s in sets], F.col("dataset"), F.col("sssc_type"))
    out = done.agg(F.count_if("retention").alias("retained"), F.count("retention").alias("judged"))
    return out.select(F.coalesce("dataset", F.lit("all")).alias("dataset"), F.coalesce("sssc_type", F.lit("all")).alias("sssc_type"), "retained", "judged", r10(F.col("retained") / F.greatest("judged", F.lit(1))).alias("micro_rate"))


def cells(facts: DataFrame) -> DataFrame:
    return success(facts).groupBy("compactor", "dataset").agg(rate(F.col("retention")).alias("x"), F.count("*").alias("n"))


def additive_residuals(facts: DataFrame) -> DataFrame:
    """Cell minus row mean minus column mean plus grand mean, each over cells."""
    by = lambda *k: F.avg("x").over(W.partitionBy(*k))
    return cells(facts).select("compactor", "dataset", r10(F.col("x")).alias("cell"), r10(F.col("x") - by("compactor") - by("dataset") + by()).alias("residual"))


def home_field(facts: DataFrame, focal: str, home: str) -> DataFrame:
    """(focal - peers) at home minus the mean of (focal - peers) elsewhere, over pooled rows."""
    of = lambda c: rate(F.when(c, F.col("retention")))
    gaps = success(facts).groupBy("dataset").agg((of(F.col("compactor") == focal) - of(F.col("compactor") != focal)).alias("gap"))
    at_home = F.col("dataset") == home
    return gaps.agg(r10(F.avg(F.when(at_home, F.col("gap")))).alias("home_gap"), r10(F.avg(F.when(~at_home, F.col("gap")))).alias("away_gap")).withColumn("did", r10(F.col("home_gap") - F.col("away_gap")))


def paired_metrics(facts: DataFrame, left_run: str, right_run: str, sets: Sequence[Sequence[str]] = ((), ("dataset",), ("dataset", "sssc_type"))) -> DataFrame:
    """Two runs pair by pair: rates, gains, losses and the exact test, by metric and grouping set."""
    metrics = ["retention", "compacted", "post"]
    keys = ["dataset", "sssc_type", "source_row_index", "sssc_id"]
    long = facts.filter(F.col("run_id").isin(left_run, right_run)).unpivot([*keys, "run_id"], metrics, "metric", "verdict")
    pick = lambda run: F.max(F.when(F.col("run_id") == run, F.col("verdict").cast("int")))
    pairs = long.groupBy(*keys, "metric").agg(pick(left_run).alias("a"), pick(right_run).alias("b"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    on = [[F.col("metric"), *[F.col(c) for c in s]] for s in sets]
    out = pairs.groupingSets(on, F.col("metric"), F.col("dataset"), F.col("sssc_type")).agg(
        F.count_if(both).alias("n"), F.count_if(~both).alias("excluded"), r10(F.avg(F.when(both, F.col("a")))).alias("left_rate"), r10(F.avg(F.when(both, F.col("b")))).alias("right_rate"),
        F.count_if(F.col("b") > F.col("a")).alias("gains"), F.count_if(F.col("b") < F.col("a")).alias("losses"),
    )
    return out.select("metric", *[F.coalesce(c, F.lit("all")).alias(c) for c in ("dataset", "sssc_type")], "n", "excluded", "left_rate", "right_rate", r10(F.col("right_rate") - F.col("left_rate")).alias("delta"), "gains", "losses", (F.col("n") - F.col("gains") - F.col("losses")).alias("unchanged"), F.round(mcnemar_exact(F.col("gains"), F.col("losses")), 8).alias("p_value"))


def pairwise_runs(facts: DataFrame, runs: Sequence[str]) -> DataFrame:
    """Every pair of runs, in manifest order, for each case: agreement over pairs known to both."""
    rows = facts.filter(F.col("run_id").isin(*runs))
    side = lambda s: rows.select(*PAIR, F.col("manifest_pos").alias(f"{s}_pos"), F.col("run_id").alias(f"{s}_run"), *[F.col(c).alias(f"{s}_{c}") for c in CASES])
    cases = F.explode(F.array(*[F.struct(F.lit(c).alias("case"), F.col(f"l_{c}").alias("l"), F.col(f"r_{c}").alias("r")) for c in CASES]))
    pairs = side("l").join(side("r"), list(PAIR)).filter("l_pos < r_pos")  # on the pair alone, by which facts are stored
    met = pairs.select("l_run", "r_run", cases.alias("x")).select("l_run", "r_run", "x.*").filter("l is not null and r is not null")
    x, y, same = F.avg(F.col("l").cast("double")), F.avg(F.col("r").cast("double")), F.avg((F.col("l") == F.col("r")).cast("double"))
    return met.groupBy("case", "l_run", "r_run").agg(F.count("*").alias("n_paired"), r10(x).alias("left_rate"), r10(y).alias("right_rate"), r10(y - x).alias("rate_delta"), r10(same).alias("agree_rate"), r10(kappa_of(same, x, y)).alias("cohen_kappa"))


def contrasts(facts: DataFrame, replicates: int = 5000) -> DataFrame:
    """Three contrasts between conditions on rows where both are known, with their intervals; one scan."""
    pairs = (("injected", "uninjected"), ("compacted", "uninjected"), ("post", "compacted"))
    sides = F.explode(F.array(*[F.struct(F.lit(f"{a}-{b}").alias("contrast"), F.col(a).cast("int").alias("a"), F.col(b).cast("int").alias("b")) for a, b in pairs]))
    both = success(facts).select("compactor", sides.alias("x")).select("compactor", "x.*").filter("a is not null and b is not null")
    keys, values = ["compactor", "contrast"], (-1, 0, 1)
    sums = both.groupBy(*keys).agg(*value_counts(F.col("a") - F.col("b"), values), r10(F.avg("a")).alias("left_rate"), r10(F.avg("b")).alias("right_rate"), r10(F.avg(F.col("a") - F.col("b"))).alias("difference"))
    sums = checkpointed(sums)  # a few rows, read twice
    intervals = resampled_means(sums, keys, values, replicates, "contrast").groupBy(*keys).agg(*bounds("m", 0.95))
    return sums.join(intervals, keys).select("compactor", "n", "left_rate", "right_rate", "difference", "contrast", "low", "high")


def stability_pairs(facts: DataFrame) -> DataFrame:
    """Each case at the top position against each other position: known to both, equal, deviation."""
    rows = facts.filter("repeat = 1 and explicit and hard").withColumn("retained", F.col("retention"))
    metrics, places = (*CASES, "retained"), ("top", "middle", "bottom")
    at = lambda m, p: F.max(F.when(F.col("position") == p, F.col(m).cast("int")))
    # one row a compactor and pair, in the buckets where facts lie; metrics and comparisons are spread after that
    wide = rows.groupBy("compactor", *PAIR).agg(*[F.struct(*[at(m, p).alias(p) for p in places]).alias(m) for m in metrics])
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m)["top"].alias("top"), F.lit(p).alias("comparison"), F.col(m)[p].alias("value")) for m in metrics for p in places[1:]]))
    other = wide.select("compactor", *PAIR, cells.alias("c")).select("compactor", "c.metric", *PAIR, "c.top", "c.comparison", "c.value")
    return other.withColumn("comparable", F.col("top").isNotNull() & F.col("value").isNotNull()).withColumn("abs_deviation", F.abs(F.col("top") - F.col("value")))


def stability_summary(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("compactor", "metric", "comparison").agg(
        F.count("*").alias("n_pairs"), F.count_if("comparable").alias("n_comparable"), F.count_if(F.col("abs_deviation") > 0).alias("n_disagree"),
        r10(1 - F.avg("abs_deviation")).alias("agreement"), r10(F.avg(F.when(F.col("comparable"), F.col("top")))).alias("top_rate"), r10(F.avg(F.when(F.col("comparable"), F.col("value")))).alias("other_rate"),
        (F.count_if(F.col("abs_deviation") > 0) == 0).alias("consistent"),
    )


def tool_calls(calls: DataFrame, case: str, pair: str, tool: str) -> DataFrame:
    """By case: pairs, mean calls, and names by descending count as ``a:3; b:1``."""
    counts = calls.groupBy(case, tool).agg(F.count("*").alias("n"))
    named = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col(tool).alias("t")))), lambda x: F.concat(x["t"], F.lit(":"), (-x["o"]).cast("string")))
    totals = calls.groupBy(case).agg(F.countDistinct(pair).alias("n_pairs"), F.count("*").alias("n_calls"))
    return counts.groupBy(case).agg(F.array_join(named, "; ").alias("tools")).join(totals, case).select(case, "n_pairs", "n_calls", r10(F.col("n_calls") / F.col("n_pairs")).alias("mean_calls"), "tools")


def agreement_by(rows: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """Two raters' agreement, kappa and confusion, and the exact test of their disagreements."""
    cells_ = agreement(F.col(a), F.col(b))
    out = rows.groupBy(*keys).agg(*[c.alias(n) for n, c in cells_.items()])
    return out.withColumn("p_value", F.round(mcnemar_exact(F.col("no_yes"), F.col("yes_no")), 8))


def joint_cells(rows: DataFrame, *raters: str) -> DataFrame:
    """Counts of every combination of verdicts, and whether all agree."""
    known = rows.filter(" and ".join(f"{r} is not null" for r in raters))
    same = F.lit(True)
    for r in raters[1:]:
        same = same & (F.col(r) == F.col(raters[0]))
    return known.groupBy(*raters).agg(F.count("*").alias("n")).withColumn("unanimous", same)


def generative_agreement(rows: DataFrame, *keys: str) -> DataFrame:
    """Free-generation verdicts against letter verdicts: counts, bounds and the paired comparison.

    ``verdict`` is true, false or not_enough_information, which counts as a failure in
    the lower bound and as a pass in the upper; the pairing uses decisive verdicts only.
    """
    v = F.col("verdict")
    yes, no = v == "true", v == "false"
    n = F.count(v)
    first = rows.groupBy(*keys).agg(
        n.alias("n_judged"), F.count_if(yes).alias("n_true"), F.count_if(no).alias("n_false"), (n - F.count_if(yes) - F.count_if(no)).alias("n_undecided"),
        r10(F.count_if(yes) / F.nullif(F.count_if(yes) + F.count_if(no), F.lit(0))).alias("decisive_rate"),
        r10(F.count_if(yes) / F.nullif(n, F.lit(0))).alias("lower_bound"), r10((n - F.count_if(no)) / F.nullif(n, F.lit(0))).alias("upper_bound"),
    )
    paired = agreement_by(rows.withColumn("a", F.when(yes, True).when(no, False)), "a", "compliant", *keys)
    return first.join(paired, list(keys))


def retention_relationship(rows: DataFrame) -> DataFrame:
    """Decisive free-generation and letter rates of the compacted case, by whether it was retained."""
    decided = F.when(F.col("verdict") == "true", 1.0).when(F.col("verdict") == "false", 0.0)
    return rows.groupBy("retention").agg(F.count("*").alias("n"), F.count(decided).alias("n_decisive"), r10(F.avg(decided)).alias("generative_rate"), r10(rate(F.col("compliant"))).alias("letter_rate"))


def prober_table(facts: DataFrame, runs: Sequence[str], reference: str) -> DataFrame:
    """Each run's case rates and invalid share, and its agreement with a reference run on the compacted case."""
    rows = facts.filter(F.col("run_id").isin(*runs))
    table = success(rows).groupBy("run_id").agg(F.count("*").alias("n_success"), *[r10(rate(F.col(c))).alias(c) for c in (*CASES, "retention")], r10(invalid_rate(F.col("compacted"))).alias("invalid_rate"))
    to = rows.filter(F.col("run_id") == reference).select(*PAIR, F.col("compacted").alias("r"))
    met = rows.join(to, list(PAIR)).filter("compacted is not null and r is not null")
    x, y, same = F.avg(F.col("r").cast("double")), F.avg(F.col("compacted").cast("double")), F.avg((F.col("compacted") == F.col("r")).cast("double"))
    against = met.groupBy("run_id").agg(F.count("*").alias("n_paired"), r10(same).alias("agree_rate"), r10(kappa_of(same, x, y)).alias("kappa"))
    return table.join(against, "run_id", "left")


def prompt_pair_rates(facts: DataFrame, left_run: str, right_run: str) -> DataFrame:
    """Two runs' rates side by side; nulls are dropped on each side by itself."""
    side = lambda run: facts.filter(F.col("run_id") == run)
    keys = ["dataset", "source_row_index", "sssc_id"]
    joined = side(left_run).select(*keys, *[F.col(c).alias(f"l_{c}") for c in ("compacted", "retention", "tokens_after")]).join(side(right_run).select(*keys, *[F.col(c).alias(f"r_{c}") for c in ("compacted", "retention", "tokens_after")]), keys)
    mean = lambda c: F.avg(F.col(c).cast("double"))
    return joined.groupBy("dataset").agg(F.count("*").alias("n"), *[r10(mean(f"{s}_{c}")).alias(f"{s}_{c}") for c in ("compacted", "retention", "tokens_after") for s in ("l", "r")], *[r10(mean(f"r_{c}") - mean(f"l_{c}")).alias(f"delta_{c}") for c in ("compacted", "retention")])


def run_inventory(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows, successes and known verdicts of each run, with where the run came from."""
    counts = facts.groupBy("run_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("status") == "success").alias("n_success"), *[F.count(c).alias(f"n_{c}") for c in (*CASES, "retention")])
    return counts.join(sources, "run_id", "left")


def summary_length(facts: DataFrame) -> DataFrame:
    """Mean tokens left for every run, overall and by dataset."""
    rows = success(facts).rollup("run_id", "dataset").agg(F.round(F.avg("tokens_after"), 6).alias("mean_tokens"), F.count("*").alias("n"))
    return rows.filter("run_id is not null").select("run_id", F.coalesce("dataset", F.lit("all")).alias("dataset"), "mean_tokens", "n")


def rejudge_report(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two judges over all rows and by run."""
    cells_ = agreement(F.col(a), F.col(b))
    return rows.rollup("run_id").agg(*[c.alias(n) for n, c in cells_.items()]).withColumn("run_id", F.coalesce("run_id", F.lit("all")))


def label_gate(rows: DataFrame, label: str) -> DataFrame:
    """How many labels are read, missing or not recognised; a report waits until none is."""
    from palimpsest.functions.text import human_label

    read = human_label(F.col(label)).isNotNull()
    blank = F.coalesce(F.trim(label), F.lit("")) == ""
    return rows.agg(F.count_if(read).alias("n_read"), F.count_if(blank).alias("n_missing"), F.count_if(~read & ~blank).alias("n_unknown"), (F.count_if(~read) == 0).alias("complete"))


def home_field_interval(facts: DataFrame, focal: str, home: str, replicates: int = 2000, level: float = 0.95, seed: str = "did") -> DataFrame:
    """Percentile interval of the home-field contrast.

    Conversations are resampled whole within each dataset, jointly for the focal
    compactor and its peers, from their sums and counts; undefined replicates are dropped.
    """
    mine = F.col("compactor") == focal
    part = lambda who, f: f(F.when(who, F.col("retention").cast("double")))
    clusters = success(facts).groupBy("dataset", "source_row_index").agg(part(mine, F.sum).alias("fs"), part(mine, F.count).alias("fn"), part(~mine, F.sum).alias("ps"), part(~mine, F.count).alias("pn"))
    slots = numbered_within(clusters, ["dataset"], ["source_row_index"])
    gap = ratio(F.col("fs"), F.col("fn")) - ratio(F.col("ps"), F.col("pn"))
    gaps = resampled_sums(slots, ["dataset"], ("fs", "fn", "ps", "pn"), replicates, seed).select("replicate", "dataset", gap.alias("gap"))
    at_home = F.col("dataset") == home
    did = gaps.groupBy("replicate").agg((F.avg(F.when(at_home, F.col("gap"))) - F.avg(F.when(~at_home, F.col("gap")))).alias("did")).filter("did is not null")
    return did.agg(F.count("*").alias("n_replicates"), *bounds("did", level))


def clustered_delta(facts: DataFrame, left_run: str, right_run: str, replicates: int = 5000) -> DataFrame:
    """The pooled difference of two runs' compliance and its interval: conversations are resampled within datasets."""
    side = lambda run: F.max(F.when((F.col("run_id") == run), F.col("compacted").cast("int")))
    pairs = facts.filter(F.col("run_id").isin(left_run, right_run)).groupBy(*PAIR).agg(side(left_run).alias("a"), side(right_run).alias("b")).filter("a is not null and b is not null")
    clusters = pairs.groupBy("dataset", "source_row_index").agg(F.sum(F.col("b") - F.col("a")).alias("v"), F.count("*").alias("w"))
    return cluster_interval(numbered_within(clusters, ["dataset"], ["source_row_index"]), ["dataset"], "v", "w", replicates)

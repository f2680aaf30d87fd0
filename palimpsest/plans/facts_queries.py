"""Queries over the evaluation facts: rates, effects, decompositions, agreement, intervals, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.stats import few_valued_interval
from palimpsest.functions.text import draw
from palimpsest.operators import metrics as A
from palimpsest.operators import sampling as S
from palimpsest.operators.evaluation import facts
from palimpsest.plans.registry import draw_sql, facts_sql, query

FACTS = facts_sql()
RUN_A, RUN_B, RUN_C = "recent_4__top", "recent_4__middle", "recent_4__bottom"


def rate(c: str, where: str | None = None) -> str:
    return f"avg({c}::INTEGER)" + (f" FILTER ({where})" if where else "")


def few_sql(keys: tuple[str, ...], values: tuple[int, ...], replicates: int, seed: str) -> str:
    """``few``: the twin of ``few_valued_interval`` over ``src`` (keys, v), by exact binomial terms."""
    k = ", ".join(keys)
    parts = [f"""sz AS (SELECT {k}, count(v) AS n, avg(v) AS mean, {", ".join(f"count(*) FILTER (v = {v}) AS k{i}" for i, v in enumerate(values))} FROM src WHERE v IS NOT NULL GROUP BY {k}),
s0 AS (SELECT sz.*, rep, n AS rest, 0.0 AS total FROM sz, range(0, {replicates}) r(rep))"""]
    rest = "n"
    for i, v in enumerate(values[:-1]):
        u1, u2 = (draw_sql(repr(seed), *keys, "rep", str(i), str(part)) for part in (1, 2))
        same = lambda f: " AND ".join(f"l.{c} = {f}.{c}" for c in keys)
        parts.append(f"""
l{i} AS (SELECT *, coalesce(k{i} / nullif({rest}, 0), 0.0) AS p, min(rest) OVER (PARTITION BY {k}) AS s1, rest - min(rest) OVER (PARTITION BY {k}) AS s2, {u1} AS u1, {u2} AS u2 FROM s{i}),
c{i} AS (SELECT {k}, s1 AS size, p FROM l{i} WHERE p > 0 AND p < 1 AND s1 > 0 UNION SELECT {k}, s2, p FROM l{i} WHERE p > 0 AND p < 1 AND s2 > 0),
w{i} AS (SELECT {k}, size, x, exp(lgamma(size + 1) - lgamma(x + 1) - lgamma(size - x + 1) + x * ln(p) + (size - x) * ln(1 - p)) AS w
  FROM c{i}, unnest(range(greatest(0, floor(size * p - 7 * sqrt(size * p * (1 - p)) - 9))::BIGINT, least(size, ceil(size * p + 7 * sqrt(size * p * (1 - p)) + 9))::BIGINT + 1)) t(x)),
f{i} AS (SELECT {k}, size, x, sum(w) OVER (PARTITION BY {k}, size ORDER BY x) / sum(w) OVER (PARTITION BY {k}, size) AS c FROM w{i}),
g{i} AS (SELECT l.*, CASE WHEN p <= 0 THEN 0 WHEN p >= 1 THEN l.rest ELSE coalesce(f.x, 0) + coalesce(h.x, 0) END AS got FROM l{i} l ASOF LEFT JOIN f{i} f ON {same("f")} AND l.s1 = f.size AND l.u1 <= f.c ASOF LEFT JOIN f{i} h ON {same("h")} AND l.s2 = h.size AND l.u2 <= h.c),
s{i + 1} AS (SELECT * EXCLUDE (p, s1, s2, u1, u2, got, rest, total), rest - got AS rest, total + got * {v} AS total FROM g{i})""")
        rest += f" - k{i}"
    last = len(values) - 1
    parts.append(f"""
few AS (SELECT {k}, n, round(mean, 9) AS mean, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM (SELECT {k}, n, mean, (total + rest * {values[-1]}) / n AS m FROM s{last}) GROUP BY {k}, n, mean)""")
    return ",".join(parts)


def slots_sql(keys: tuple[str, ...], replicates: int, seed: str) -> str:
    """``dr``: the twin of the draws of ``resampled_sums``, over ``z`` (keys, n)."""
    text = " || '|' || ".join([repr(seed), *[f"z.{k}::VARCHAR" for k in keys], "rep::VARCHAR", "(i // 4)::VARCHAR"])
    return f"""dr AS (SELECT {", ".join(f"z.{k}" for k in keys)}, rep, floor(('0x' || substr(md5({text}), (1 + 8 * (i % 4))::INTEGER, 8))::BIGINT / 4294967296.0 * z.n)::BIGINT AS slot
  FROM z, range(0, {replicates}) a(rep), range(0, (SELECT max(n) FROM z)) b(i) WHERE i < z.n)"""


def _retention_sql(*keys: str) -> str:
    k = ", ".join(keys)
    return f"{FACTS} SELECT {k}, round({rate('retention')}, 10) AS retention_rate, count(*) FILTER (retention) AS n_retained, count(retention) AS n_judged, count(*) AS n_rows FROM facts GROUP BY {k}"


@query(_retention_sql("sssc_type"))
def facts_retention_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.retention_by(facts(spark, sf_dir), "sssc_type")


@query(_retention_sql("dataset", "position"))
def retention_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.retention_by(facts(spark, sf_dir), "dataset", "position")


@query(_retention_sql("compactor"))
def retention_by_compactor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.retention_by(facts(spark, sf_dir), "compactor")


@query(f"{FACTS} SELECT regexp_extract(dataset, '([0-9]+)k$', 1)::BIGINT * 1000 AS context_tokens, round({rate('retention')}, 10) AS retention_rate, count(*) FILTER (retention) AS n_retained, count(retention) AS n_judged, count(*) AS n_rows FROM facts GROUP BY 1")
def retention_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.functions.text import context_tokens

    return A.retention_by(facts(spark, sf_dir).withColumn("context_tokens", context_tokens(F.col("dataset"))), "context_tokens")


@query(f"{FACTS} SELECT sssc_type, round(avg(r), 10) AS mean_of_means FROM (SELECT sssc_type, dataset, {rate('retention')} AS r FROM facts GROUP BY ALL) GROUP BY 1")
def mean_retention_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_set = facts(spark, sf_dir).groupBy("sssc_type", "dataset").agg(F.avg(F.col("retention").cast("double")).alias("r"))
    return by_set.groupBy("sssc_type").agg(F.round(F.avg("r"), 10).alias("mean_of_means")).orderBy(F.desc("mean_of_means"), "sssc_type")


@query(f"{FACTS} SELECT compactor, round(avg(tokens_before), 6) AS avg_before, round(avg(tokens_after), 6) AS avg_after, round(avg(tokens_after / tokens_before), 9) AS avg_ratio, count(*) AS n_rows FROM facts WHERE status = 'success' GROUP BY 1")
def compression_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.compression(facts(spark, sf_dir))


_BASE = f""", once AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY dataset, source_row_index, sssc_id ORDER BY manifest_pos) = 1),
b AS (SELECT dataset, {rate('uninjected')} AS base, {rate('injected')} AS injected_base FROM once GROUP BY 1)"""


@query(f"""{FACTS} {_BASE}, g AS (SELECT dataset, compactor, count(*) AS n, {rate('retention')} AS r, {rate('compacted')} AS c, {rate('post')} AS u FROM facts WHERE status = 'success' GROUP BY 1, 2)
SELECT g.dataset, compactor, n, round(r, 10) AS retention, round(c, 10) AS compacted, round(base, 10) AS base, round(injected_base, 10) AS injected_base, round(u, 10) AS upper, round(c - base, 10) AS calibrated, round((c - base) / nullif(round(u - base, 12), 0), 10) AS effect_retention FROM g JOIN b USING (dataset)""")
def headline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.headline(facts(spark, sf_dir))


def _local_sql(where: str, *keys: str) -> str:
    k = ", ".join(keys)
    return f"""{FACTS}, g AS (SELECT {k}, count(*) AS n, {rate('retention')} AS r, {rate('uninjected')} AS b, {rate('compacted')} AS c, {rate('post')} AS u FROM facts WHERE status = 'success' AND {where} GROUP BY {k})
SELECT {k}, n, round(r, 10) AS retention, round(b, 10) AS base, round(c, 10) AS compacted, round(u, 10) AS upper, round(c - b, 10) AS calibrated, round((c - b) / nullif(round(u - b, 12), 0), 10) AS effect_retention FROM g"""


@query(_local_sql("position = 'top' AND repeat = 1", "dataset", "compactor", "explicit", "hard"))
def framing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.group_local(facts(spark, sf_dir).filter("position = 'top' and repeat = 1"), "dataset", "compactor", "explicit", "hard")


@query(_local_sql("explicit AND hard", "dataset", "compactor", "repeat"))
def repeat_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.group_local(facts(spark, sf_dir).filter("explicit and hard"), "dataset", "compactor", "repeat")


@query(f"""{FACTS} SELECT manifest_pos, run_id, count(*) FILTER (retention) || '/' || count(retention) AS retained, round({rate('uninjected')}, 4) AS uninjected, round({rate('injected')}, 4) AS injected, round({rate('compacted')}, 4) AS compacted, round({rate('post')}, 4) AS post,
count(*) FILTER (status = 'success') AS n_success, count(*) AS n_rows, round(avg((compacted IS NULL)::INTEGER), 10) AS invalid_rate FROM facts GROUP BY 1, 2""")
def per_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.per_run(facts(spark, sf_dir))


_GROUPS = f""", once AS (SELECT * FROM facts WHERE status = 'success' QUALIFY row_number() OVER (PARTITION BY dataset, source_row_index, sssc_id ORDER BY manifest_pos) = 1),
own AS (SELECT dataset, compactor, 'compacted' AS "case", round({rate('compacted')}, 10) AS rate, count(compacted) AS n FROM facts WHERE status = 'success' GROUP BY 1, 2
  UNION ALL SELECT dataset, compactor, 'post', round({rate('post')}, 10), count(post) FROM facts WHERE status = 'success' GROUP BY 1, 2),
shared AS (SELECT dataset, 'uninjected' AS "case", round({rate('uninjected')}, 10) AS rate, count(uninjected) AS n FROM once GROUP BY 1 UNION ALL SELECT dataset, 'injected', round({rate('injected')}, 10), count(injected) FROM once GROUP BY 1),
four AS (SELECT * FROM own UNION ALL SELECT d.dataset, d.compactor, s."case", s.rate, s.n FROM (SELECT DISTINCT dataset, compactor FROM own) d JOIN shared s USING (dataset))"""


@query(f'{FACTS} {_GROUPS} SELECT dataset, compactor, "case", rate, n FROM four')
def four_group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.four_groups(facts(spark, sf_dir)).select("dataset", "compactor", "case", "rate", "n")


@query(f"""{FACTS} {_GROUPS}, w AS (SELECT dataset, compactor, max(rate) FILTER ("case" = 'injected') AS i, max(rate) FILTER ("case" = 'compacted') AS c, max(rate) FILTER ("case" = 'post') AS p FROM four GROUP BY 1, 2)
SELECT dataset, compactor, round(p - i, 10) AS position_advantage, round(i - c, 10) AS compaction_loss, round((p - c) - (p - i) - (i - c), 10) AS residual, round(p - c, 10) AS total_gap, true AS identity_check FROM w""")
def compliance_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = A.decomposition(A.four_groups(facts(spark, sf_dir)))
    return parts.withColumn("residual", F.abs("residual"))


@query(f"{FACTS}, src AS (SELECT compactor, injected::INTEGER - compacted::INTEGER AS v FROM facts WHERE status = 'success' AND injected IS NOT NULL AND compacted IS NOT NULL), " + few_sql(("compactor",), (-1, 0, 1), 2000, "loss") + " SELECT compactor, n, mean AS loss, low, high FROM few")
def paired_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.paired_loss(facts(spark, sf_dir))


@query(f"""{FACTS}, c AS (SELECT CASE WHEN compacted IS NULL THEN 'unknown' WHEN compacted THEN 'true' ELSE 'false' END AS compliance, count(*) FILTER (retention) AS retained, count(*) FILTER (NOT retention) AS lost FROM facts WHERE status = 'success' AND retention IS NOT NULL GROUP BY 1)
SELECT *, round(100.0 * retained / sum(retained + lost) OVER (), 10) AS retained_percent, round(100.0 * lost / sum(retained + lost) OVER (), 10) AS lost_percent FROM c""")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.confusion(facts(spark, sf_dir))


@query(f"""{FACTS}, k AS (SELECT compactor, CASE WHEN uninjected IS NULL THEN 'unknown' WHEN uninjected THEN 'complies_anyway' ELSE 'complies_only_after' END AS kind, count(*) AS n FROM facts WHERE status = 'success' AND NOT retention AND compacted GROUP BY 1, 2)
SELECT *, round(n / sum(n) OVER (PARTITION BY compactor), 10) AS share FROM k""")
def complied_without_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.complied_without(facts(spark, sf_dir))


@query(f'{FACTS} SELECT run_id, dataset, source_row_index AS "row", sssc_id AS constraint_id, sssc_type AS constraint_type, retention, uninjected FROM facts WHERE status = \'success\' AND compacted IS NULL')
def null_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.null_cases(facts(spark, sf_dir))


@query(f"""{FACTS} SELECT coalesce(dataset, 'all') AS dataset, coalesce(sssc_type, 'all') AS sssc_type, count(*) FILTER (retention) AS retained, count(retention) AS judged, round(count(*) FILTER (retention) / greatest(count(retention), 1), 10) AS micro_rate
FROM facts WHERE status = 'success' GROUP BY GROUPING SETS ((), (dataset), (dataset, sssc_type))""")
def summary_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.grouping_sets(facts(spark, sf_dir))


@query(f"""{FACTS} SELECT sssc_type, round(sum(k) / sum(n), 10) AS micro_rate, round(avg(k / n), 10) AS macro_rate FROM (SELECT sssc_type, dataset, count(*) FILTER (retention) AS k, count(*) AS n FROM facts GROUP BY ALL) GROUP BY 1""")
def collapse_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_set = A.retention_by(facts(spark, sf_dir), "sssc_type", "dataset")
    return by_set.groupBy("sssc_type").agg(F.round(F.sum("n_retained") / F.sum("n_rows"), 10).alias("micro_rate"), F.round(F.avg(F.col("n_retained") / F.col("n_rows")), 10).alias("macro_rate"))


@query(f"{FACTS} SELECT compactor, " + ", ".join(f"round({rate('retention', chr(39).join(['dataset = ', d, '']))}, 10) AS {d}" for d in ("agent_10k", "agent_20k", "chat_10k")) + f", round({rate('retention')}, 10) AS all_rows FROM facts WHERE status = 'success' GROUP BY 1")
def cell_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = A.success(facts(spark, sf_dir)).withColumn("v", F.col("retention").cast("double"))
    wide = done.groupBy("compactor").pivot("dataset", ["agent_10k", "agent_20k", "chat_10k"]).agg(F.round(F.avg("v"), 10))
    return wide.join(done.groupBy("compactor").agg(F.round(F.avg("v"), 10).alias("all_rows")), "compactor")


@query(f"""{FACTS}, c AS (SELECT compactor, dataset, {rate('retention')} AS x FROM facts WHERE status = 'success' GROUP BY 1, 2)
SELECT compactor, dataset, round(x, 10) AS cell, round(x - avg(x) OVER (PARTITION BY compactor) - avg(x) OVER (PARTITION BY dataset) + avg(x) OVER (), 10) AS residual FROM c""")
def additive_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.additive_residuals(facts(spark, sf_dir))


@query(f"""{FACTS}, c AS (SELECT compactor, dataset, {rate('retention')} AS x FROM facts WHERE status = 'success' GROUP BY 1, 2),
r AS (SELECT compactor, dataset, x - avg(x) OVER (PARTITION BY compactor) - avg(x) OVER (PARTITION BY dataset) + avg(x) OVER () AS residual FROM c)
SELECT (compactor LIKE 'recent%') = (dataset LIKE 'agent%') AS matched, round(avg(round(residual, 10)), 9) AS mean_residual, count(*) AS n_cells FROM r GROUP BY 1""")
def matched_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.additive_residuals(facts(spark, sf_dir))
    matched = F.col("compactor").startswith("recent") == F.col("dataset").startswith("agent")
    return rows.groupBy(matched.alias("matched")).agg(F.round(F.avg("residual"), 9).alias("mean_residual"), F.count("*").alias("n_cells"))


@query(f"""{FACTS}, g AS (SELECT dataset, {rate('retention', "compactor = 'extract_3'")} - {rate('retention', "compactor <> 'extract_3'")} AS gap FROM facts WHERE status = 'success' GROUP BY 1),
h AS (SELECT round(avg(gap) FILTER (dataset = 'chat_10k'), 10) AS home_gap, round(avg(gap) FILTER (dataset <> 'chat_10k'), 10) AS away_gap FROM g)
SELECT *, round(home_gap - away_gap, 10) AS did FROM h""")
def home_field_did(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.home_field(facts(spark, sf_dir), "extract_3", "chat_10k")


_P = """CASE WHEN {g} + {l} = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least({g}, {l}) + 1), lambda i: exp(lgamma({g} + {l} + 1) - lgamma(i + 1) - lgamma({g} + {l} - i + 1) + ({g} + {l}) * ln(0.5))))) END"""


def p_sql(g: str, losses: str) -> str:
    return "round(" + _P.format(g=g, l=losses) + ", 8)"


def _paired_sql() -> str:
    parts = " UNION ALL ".join(f"SELECT dataset, sssc_type, source_row_index, sssc_id, run_id, '{m}' AS metric, {m}::INTEGER AS v FROM facts" for m in ("retention", "compacted", "post"))
    return f"""{FACTS}, l AS ({parts}), p AS (SELECT dataset, sssc_type, metric, max(v) FILTER (run_id = '{RUN_A}') AS a, max(v) FILTER (run_id = '{RUN_B}') AS b FROM l WHERE run_id IN ('{RUN_A}', '{RUN_B}') GROUP BY dataset, sssc_type, metric, source_row_index, sssc_id),
s AS (SELECT metric, coalesce(dataset, 'all') AS dataset, coalesce(sssc_type, 'all') AS sssc_type, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n, count(*) FILTER (a IS NULL OR b IS NULL) AS excluded,
  round(avg(a) FILTER (b IS NOT NULL), 10) AS left_rate, round(avg(b) FILTER (a IS NOT NULL), 10) AS right_rate, count(*) FILTER (b > a) AS gains, count(*) FILTER (b < a) AS losses FROM p GROUP BY GROUPING SETS ((metric), (metric, dataset), (metric, dataset, sssc_type)))
SELECT metric, dataset, sssc_type, n, excluded, left_rate, right_rate, round(right_rate - left_rate, 10) AS delta, gains, losses, n - gains - losses AS unchanged, {p_sql('gains', 'losses')} AS p_value FROM s"""


@query(_paired_sql())
def paired_metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.paired_metrics(facts(spark, sf_dir), RUN_A, RUN_B)


_AGREE = """{k} count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n, count(*) FILTER (a = b) AS n_agree, count(*) FILTER (a AND b) AS yes_yes, count(*) FILTER (a AND NOT b) AS yes_no, count(*) FILTER (NOT a AND b) AS no_yes, count(*) FILTER (NOT a AND NOT b) AS no_no,
avg(a::INTEGER) FILTER (b IS NOT NULL) AS x, avg(b::INTEGER) FILTER (a IS NOT NULL) AS y, avg((a = b)::INTEGER) AS po"""
_KAPPA = "round(CASE WHEN round(x * y + (1 - x) * (1 - y), 12) = 1 THEN 1.0 ELSE (po - (x * y + (1 - x) * (1 - y))) / (1 - (x * y + (1 - x) * (1 - y))) END, 10)"


def agree_sql(source: str, key: str = "") -> str:
    group = f"GROUP BY {key}" if key else ""
    k = f"{key}," if key else ""
    return f"g AS (SELECT {_AGREE.format(k=k)} FROM ({source}) {group}) SELECT {k} n, n_agree, yes_yes, yes_no, no_yes, no_no, round(x, 10) AS left_rate, round(y, 10) AS right_rate, round(po, 10) AS agree_rate, {_KAPPA} AS kappa, {p_sql('no_yes', 'yes_no')} AS p_value FROM g"


@query(f"{FACTS}, " + agree_sql("SELECT compactor, retention AS a, compacted AS b FROM facts", "compactor"))
def agreement_retention_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.agreement_by(facts(spark, sf_dir), "retention", "compacted", "compactor")


@query("WITH " + agree_sql("SELECT quality = 1 AS a, toxic = 1 AS b FROM labels"))
def agreement_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b"))
    return A.agreement_by(labels, "a", "b")


def judged_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The retention verdicts with a second judge and a reviewer, who differ by keyed draws."""
    rows = A.success(facts(spark, sf_dir))
    flip = lambda who, p: F.when(draw(who, F.col("run_id"), F.col("source_row_index"), F.col("sssc_id")) < p, ~F.col("retention")).otherwise(F.col("retention"))
    return rows.withColumns({"second": flip("second", 0.08), "human": flip("human", 0.04)})


_TWICE = f""", judged AS (SELECT *, CASE WHEN {draw_sql("'second'", "run_id", "source_row_index", "sssc_id")} < 0.08 THEN NOT retention ELSE retention END AS second,
CASE WHEN {draw_sql("'human'", "run_id", "source_row_index", "sssc_id")} < 0.04 THEN NOT retention ELSE retention END AS human FROM facts WHERE status = 'success')"""
TWICE = FACTS.replace("judged AS (", "placed_judged AS (", 1).replace("FROM judged)", "FROM placed_judged)") + _TWICE


@query(f"{TWICE}, " + agree_sql("SELECT compactor, human AS a, retention AS b FROM judged", "compactor"))
def blind_test_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.agreement_by(judged_twice(spark, sf_dir), "human", "retention", "compactor")


@query(f"{TWICE}, " + agree_sql("SELECT CASE WHEN contains(lower(run_id), 'recent') THEN 'window' WHEN contains(lower(run_id), 'extract') THEN 'extractive' ELSE 'other' END AS family, retention AS a, second AS b FROM judged", "family"))
def family_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.functions.text import family

    tagged = judged_twice(spark, sf_dir).withColumn("family", family(F.col("run_id"), (("recent", "window"), ("extract", "extractive"))))
    return A.agreement_by(tagged, "retention", "second", "family")


@query(f"{TWICE} SELECT human, retention, second, count(*) AS n, human = retention AND human = second AS unanimous FROM judged WHERE human IS NOT NULL AND retention IS NOT NULL AND second IS NOT NULL GROUP BY 1, 2, 3")
def joint_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.joint_cells(judged_twice(spark, sf_dir), "human", "retention", "second")


def _pairwise_sql() -> str:
    runs = f"('{RUN_A}', '{RUN_B}', '{RUN_C}')"
    parts = " UNION ALL ".join(f"SELECT manifest_pos, run_id, dataset, source_row_index, sssc_id, '{c}' AS \"case\", {c} AS v FROM facts WHERE run_id IN {runs}" for c in A.CASES)
    return f"""{FACTS}, l AS ({parts}), j AS (SELECT a."case", a.run_id AS l_run, b.run_id AS r_run, a.v::INTEGER AS l, b.v::INTEGER AS r FROM l a JOIN l b USING (dataset, source_row_index, sssc_id, "case") WHERE a.manifest_pos < b.manifest_pos AND a.v IS NOT NULL AND b.v IS NOT NULL),
g AS (SELECT "case", l_run, r_run, count(*) AS n_paired, avg(l) AS x, avg(r) AS y, avg((l = r)::INTEGER) AS po FROM j GROUP BY 1, 2, 3)
SELECT "case", l_run, r_run, n_paired, round(x, 10) AS left_rate, round(y, 10) AS right_rate, round(y - x, 10) AS rate_delta, round(po, 10) AS agree_rate, {_KAPPA} AS cohen_kappa FROM g"""


@query(_pairwise_sql())
def pairwise_probers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.pairwise_runs(facts(spark, sf_dir), (RUN_A, RUN_B, RUN_C))


_CONTRASTS = " UNION ALL ".join(f"SELECT compactor, '{a}-{b}' AS contrast, {a}::INTEGER AS a, {b}::INTEGER AS b FROM facts WHERE status = 'success' AND {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in (("injected", "uninjected"), ("compacted", "uninjected"), ("post", "compacted")))


@query(f"{FACTS}, known AS ({_CONTRASTS}), src AS (SELECT compactor, contrast, a - b AS v FROM known), " + few_sql(("compactor", "contrast"), (-1, 0, 1), 5000, "contrast") + """,
t AS (SELECT compactor, contrast, round(avg(a), 10) AS left_rate, round(avg(b), 10) AS right_rate, round(avg(a - b), 10) AS difference FROM known GROUP BY 1, 2)
SELECT compactor, n, left_rate, right_rate, difference, contrast, low, high FROM t JOIN few USING (compactor, contrast)""")
def condition_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.contrasts(facts(spark, sf_dir))


def _stability_sql() -> str:
    parts = " UNION ALL ".join(f"SELECT compactor, position, dataset, source_row_index, sssc_id, '{m}' AS metric, {c}::INTEGER AS v FROM facts WHERE repeat = 1 AND explicit AND hard" for m, c in (*((c, c) for c in A.CASES), ("retained", "retention")))
    return f"""{FACTS}, l AS ({parts}), w AS (SELECT compactor, metric, dataset, source_row_index, sssc_id, max(v) FILTER (position = 'top') AS top, max(v) FILTER (position = 'middle') AS middle, max(v) FILTER (position = 'bottom') AS bottom FROM l GROUP BY ALL),
s AS (SELECT compactor, metric, dataset, source_row_index, sssc_id, top, 'middle' AS comparison, middle AS value FROM w UNION ALL SELECT compactor, metric, dataset, source_row_index, sssc_id, top, 'bottom', bottom FROM w),
pairs AS (SELECT *, top IS NOT NULL AND value IS NOT NULL AS comparable, abs(top - value) AS abs_deviation FROM s)"""


@query(f"{_stability_sql()} SELECT compactor, metric, dataset, source_row_index, sssc_id, top, comparison, value, comparable, abs_deviation FROM pairs")
def stability_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.stability_pairs(facts(spark, sf_dir))


@query(f"""{_stability_sql()} SELECT compactor, metric, comparison, count(*) AS n_pairs, count(*) FILTER (comparable) AS n_comparable, count(*) FILTER (abs_deviation > 0) AS n_disagree, round(1 - avg(abs_deviation), 10) AS agreement,
round(avg(top) FILTER (comparable), 10) AS top_rate, round(avg(value) FILTER (comparable), 10) AS other_rate, count(*) FILTER (abs_deviation > 0) = 0 AS consistent FROM pairs GROUP BY 1, 2, 3""")
def stability_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.stability_summary(A.stability_pairs(facts(spark, sf_dir)))


@query("""WITH c AS (SELECT user_id % 3 AS bucket, user_id, event_type FROM events), n AS (SELECT bucket, event_type, count(*) AS n FROM c GROUP BY 1, 2),
t AS (SELECT bucket, string_agg(event_type || ':' || n, '; ' ORDER BY n DESC, event_type) AS tools FROM n GROUP BY 1)
SELECT bucket AS "case", count(DISTINCT user_id) AS n_pairs, count(*) AS n_calls, round(count(*) / count(DISTINCT user_id), 10) AS mean_calls, any_value(tools) AS tools FROM c JOIN t USING (bucket) GROUP BY 1""")
def tool_call_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 3).alias("case"), "user_id", "event_type")
    return A.tool_calls(calls, "case", "user_id", "event_type")


@query(f"{FACTS}, src AS (SELECT compactor, compacted::INTEGER AS v FROM facts WHERE status = 'success'), " + few_sql(("compactor",), (0, 1), 2000, "mean") + " SELECT * FROM few")
def bootstrap_mean_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.success(facts(spark, sf_dir)).withColumn("v", F.col("compacted").cast("int"))
    return few_valued_interval(rows, ["compactor"], "v", (0, 1), 2000, seed="mean")


@query(f"{FACTS}, src AS (SELECT compactor, post::INTEGER - compacted::INTEGER AS v FROM facts WHERE status = 'success'), " + few_sql(("compactor",), (-1, 0, 1), 5000, "diff") + " SELECT * FROM few")
def paired_diff_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.success(facts(spark, sf_dir)).withColumn("v", F.col("post").cast("int") - F.col("compacted").cast("int"))
    return few_valued_interval(rows, ["compactor"], "v", (-1, 0, 1), 5000, seed="diff")


@query(f"""{FACTS}, pr AS (SELECT dataset, source_row_index, b.compacted::INTEGER - a.compacted::INTEGER AS d FROM facts a JOIN facts b USING (dataset, source_row_index, sssc_id) WHERE a.run_id = '{RUN_A}' AND b.run_id = '{RUN_B}' AND a.compacted IS NOT NULL AND b.compacted IS NOT NULL),
cl AS (SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY source_row_index) - 1 AS slot, sum(d) AS v, count(*) AS w FROM pr GROUP BY dataset, source_row_index),
z AS (SELECT dataset, count(*) AS n FROM cl GROUP BY 1), """ + slots_sql(("dataset",), 5000, "cluster") + """,
ms AS (SELECT rep, sum(v) / sum(w) AS m FROM dr JOIN cl USING (dataset, slot) GROUP BY rep)
SELECT (SELECT count(*) FROM cl) AS n, (SELECT round(sum(v) / sum(w), 9) FROM cl) AS mean, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM ms""")
def clustered_delta_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations are resampled whole, within each dataset; a replicate pools all datasets."""
    return A.clustered_delta(facts(spark, sf_dir), RUN_A, RUN_B)


_KEYED = f"{FACTS}, keyed AS (SELECT substr(sha1(concat_ws('|', dataset, source_row_index, sssc_id, run_id)), 1, 16) AS key, run_id, source_row_index, sssc_id, retention FROM facts WHERE retention IS NOT NULL)"


def keyed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir).filter("retention is not null")
    return rows.select(S.stable_key(F.col("dataset"), F.col("source_row_index"), F.col("sssc_id"), F.col("run_id")).alias("key"), "run_id", "source_row_index", "sssc_id", "retention")


@query(f"{_KEYED} SELECT * FROM keyed ORDER BY md5('0|' || key), key LIMIT 200")
def stable_key_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.key_sample(keyed_rows(spark, sf_dir), 200, seed=0)


@query(f"""{_KEYED}, r AS (SELECT *, row_number() OVER (PARTITION BY retention ORDER BY md5('0|' || key), key) AS rk FROM keyed) SELECT key, run_id, source_row_index, sssc_id, retention FROM r WHERE rk <= 25""")
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.balanced_sample(keyed_rows(spark, sf_dir), 50, "retention", seed=0)


@query(f"""{_KEYED}, r AS (SELECT *, row_number() OVER (PARTITION BY retention ORDER BY md5('0|' || key), key) AS rk FROM keyed), f AS (SELECT * FROM r WHERE rk <= 25),
o AS (SELECT * FROM keyed WHERE key NOT IN (SELECT key FROM f) ORDER BY md5('1|' || key), key LIMIT 450)
SELECT key, run_id, source_row_index, sssc_id, retention, true AS forced FROM f UNION ALL SELECT key, run_id, source_row_index, sssc_id, retention, false FROM o""")
def nested_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyed_rows(spark, sf_dir)
    return S.nested_sample(rows, S.balanced_sample(rows, 50, "retention", seed=0), 500, seed=1)


@query(f"{FACTS} SELECT run_id, source_row_index, sssc_id, compacted IS NULL AS need_compacted, post IS NULL AS need_post FROM facts WHERE compacted IS NULL OR post IS NULL")
def pending_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["run_id", "source_row_index", "sssc_id"]
    rows = facts(spark, sf_dir)
    return S.pending_conditions(rows.select(*keys), A.success(rows).select(*keys, "compacted", "post"), keys, ["compacted", "post"])


@query(f"{FACTS} SELECT run_id, source_row_index, sssc_id, CASE WHEN status = 'error' THEN 'retried' ELSE status END AS status FROM facts")
def upsert_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["run_id", "source_row_index", "sssc_id"]
    rows = facts(spark, sf_dir).select(*keys, "status")
    return S.upsert(rows, rows.filter("status = 'error'").withColumn("status", F.lit("retried")), keys)


_GEN = f""", gen AS (SELECT *, CASE WHEN {draw_sql("'gen'", "run_id", "source_row_index", "sssc_id")} < 0.5 THEN 'true' WHEN {draw_sql("'gen'", "run_id", "source_row_index", "sssc_id")} < 0.85 THEN 'false' ELSE 'not_enough_information' END AS verdict, compacted AS compliant FROM facts WHERE status = 'success')"""


def generated_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = draw("gen", F.col("run_id"), F.col("source_row_index"), F.col("sssc_id"))
    verdict = F.when(d < 0.5, "true").when(d < 0.85, "false").otherwise("not_enough_information")
    return A.success(facts(spark, sf_dir)).withColumns({"verdict": verdict, "compliant": F.col("compacted")})


@query(f"""{FACTS} {_GEN}, c AS (SELECT compactor, count(verdict) AS n_judged, count(*) FILTER (verdict = 'true') AS n_true, count(*) FILTER (verdict = 'false') AS n_false FROM gen GROUP BY 1), x AS (SELECT * FROM (WITH """ + agree_sql("SELECT compactor, CASE verdict WHEN 'true' THEN true WHEN 'false' THEN false END AS a, compliant AS b FROM gen", "compactor") + """))
SELECT compactor, n_judged, n_true, n_false, n_judged - n_true - n_false AS n_undecided, round(n_true / (n_true + n_false), 10) AS decisive_rate, round(n_true / n_judged, 10) AS lower_bound, round((n_judged - n_false) / n_judged, 10) AS upper_bound, x.* EXCLUDE (compactor) FROM c JOIN x USING (compactor)""")
def generative_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.generative_agreement(generated_verdicts(spark, sf_dir), "compactor")


@query(f"""{FACTS} {_GEN}, d AS (SELECT *, CASE verdict WHEN 'true' THEN 1.0 WHEN 'false' THEN 0.0 END::DOUBLE AS v FROM gen) SELECT retention, count(*) AS n, count(v) AS n_decisive, round(avg(v), 10) AS generative_rate, round({rate('compliant')}, 10) AS letter_rate FROM d GROUP BY 1""")
def retention_relationship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.retention_relationship(generated_verdicts(spark, sf_dir))


_RUNS = f"('{RUN_A}', '{RUN_B}', '{RUN_C}')"


@query(f"""{FACTS}, t AS (SELECT run_id, count(*) AS n_success, round({rate('uninjected')}, 10) AS uninjected, round({rate('injected')}, 10) AS injected, round({rate('compacted')}, 10) AS compacted, round({rate('post')}, 10) AS post, round({rate('retention')}, 10) AS retention, round(avg((compacted IS NULL)::INTEGER), 10) AS invalid_rate FROM facts WHERE status = 'success' AND run_id IN {_RUNS} GROUP BY 1),
m AS (SELECT a.run_id, r.compacted::INTEGER AS l, a.compacted::INTEGER AS q FROM facts a JOIN facts r USING (dataset, source_row_index, sssc_id) WHERE r.run_id = '{RUN_A}' AND a.run_id IN {_RUNS} AND a.compacted IS NOT NULL AND r.compacted IS NOT NULL),
g AS (SELECT run_id, count(*) AS n_paired, avg(l) AS x, avg(q) AS y, avg((l = q)::INTEGER) AS po FROM m GROUP BY 1)
SELECT t.*, n_paired, round(po, 10) AS agree_rate, {_KAPPA} AS kappa FROM t LEFT JOIN g USING (run_id)""")
def prober_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.prober_table(facts(spark, sf_dir), (RUN_A, RUN_B, RUN_C), RUN_A)


@query(f"""{FACTS} SELECT dataset, count(*) AS n, round(avg(a.compacted::INTEGER), 10) AS l_compacted, round(avg(b.compacted::INTEGER), 10) AS r_compacted, round(avg(a.retention::INTEGER), 10) AS l_retention, round(avg(b.retention::INTEGER), 10) AS r_retention, round(avg(a.tokens_after), 10) AS l_tokens_after, round(avg(b.tokens_after), 10) AS r_tokens_after,
round(avg(b.compacted::INTEGER) - avg(a.compacted::INTEGER), 10) AS delta_compacted, round(avg(b.retention::INTEGER) - avg(a.retention::INTEGER), 10) AS delta_retention FROM (SELECT * FROM facts WHERE run_id = 'recent_4__top') a JOIN (SELECT * FROM facts WHERE run_id = 'extract_3__top') b USING (dataset, source_row_index, sssc_id) GROUP BY 1""")
def prompt_pair_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.prompt_pair_rates(facts(spark, sf_dir), "recent_4__top", "extract_3__top")


@query(f"""{FACTS} SELECT run_id, count(*) AS n_rows, count(*) FILTER (status = 'success') AS n_success, count(uninjected) AS n_uninjected, count(injected) AS n_injected, count(compacted) AS n_compacted, count(post) AS n_post, count(retention) AS n_retention, any_value(compactor) AS source FROM facts GROUP BY 1""")
def run_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.operators.evaluation import manifest

    return A.run_inventory(facts(spark, sf_dir), manifest(spark).select("run_id", F.col("compactor").alias("source")))


@query(f"{FACTS} SELECT run_id, coalesce(dataset, 'all') AS dataset, round(avg(tokens_after), 6) AS mean_tokens, count(*) AS n FROM facts WHERE status = 'success' GROUP BY GROUPING SETS ((run_id), (run_id, dataset))")
def summary_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.summary_length(facts(spark, sf_dir))


@query(f"""{TWICE}, r AS (SELECT run_id, retention AS a, second AS b FROM judged UNION ALL SELECT 'all', retention, second FROM judged), t AS (SELECT * FROM (WITH """ + agree_sql("SELECT * FROM r", "run_id") + ")) SELECT * EXCLUDE (p_value) FROM t")
def rejudge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rejudge_report(judged_twice(spark, sf_dir), "retention", "second")


@query("SELECT count(*) FILTER (quality IS NOT NULL) AS n_read, count(*) FILTER (quality IS NULL AND doc_id % 2 = 0) AS n_missing, count(*) FILTER (quality IS NULL AND doc_id % 2 = 1) AS n_unknown, count(*) FILTER (quality IS NULL) = 0 AS complete FROM documents LEFT JOIN labels USING (doc_id)")
def label_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    said = F.when(F.col("quality") == 1, "yes").when(F.col("quality") == 0, "no").when(F.col("doc_id") % 2 == 0, " ").otherwise("hm")
    return A.label_gate(docs.select("doc_id").join(labels, "doc_id", "left").withColumn("label", said), "label")


@query(f"""{FACTS}, c AS (SELECT dataset, source_row_index, sum(retention::INTEGER) FILTER (compactor = 'extract_3') AS fs, count(retention) FILTER (compactor = 'extract_3') AS fn, sum(retention::INTEGER) FILTER (compactor <> 'extract_3') AS ps, count(retention) FILTER (compactor <> 'extract_3') AS pn FROM facts WHERE status = 'success' GROUP BY 1, 2),
s AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY source_row_index) - 1 AS slot FROM c), z AS (SELECT dataset, count(*) AS n FROM s GROUP BY 1),
""" + slots_sql(("dataset",), 2000, "did") + """,
g AS (SELECT dataset, rep, sum(coalesce(fs, 0)) / nullif(sum(fn), 0) - sum(coalesce(ps, 0)) / nullif(sum(pn), 0) AS gap FROM dr JOIN s USING (dataset, slot) GROUP BY 1, 2),
d AS (SELECT rep, avg(gap) FILTER (dataset = 'chat_10k') - avg(gap) FILTER (dataset <> 'chat_10k') AS did FROM g GROUP BY 1)
SELECT count(did) AS n_replicates, round(quantile_cont(did, 0.025), 9) AS low, round(quantile_cont(did, 0.975), 9) AS high FROM d""")
def home_field_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.home_field_interval(facts(spark, sf_dir), "extract_3", "chat_10k")

"""A query and its DuckDB twin, registered under one name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Fixed values shared by the twins: the token pattern as a DuckDB expression over x.
TOKENS = r"len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+|[^\s\p{{L}}\p{{N}}_]'))"


def tok(expression: str) -> str:
    return TOKENS.format(expression)


def draw_sql(*parts: str) -> str:
    """The twin of a keyed draw; parts are SQL expressions."""
    text = " || '|' || ".join(f"({p})::VARCHAR" for p in parts)
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0)"


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"two queries named {key}")
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return register


#: Messages as lists, and their users' zero-based places.
CONV_SQL = f"""
conv AS (
  SELECT conv_id, list(struct_pack(role := role, content := text) ORDER BY turn) AS m FROM conversations GROUP BY conv_id),
ctx AS (
  SELECT conv_id, m, len(m) AS n, list_filter(range(0, len(m)), lambda i: m[i + 1].role = 'user') AS u,
         list_transform(m, lambda x: {tok('x.role')} + {tok('x.content')} + 1) AS t
  FROM conv)
"""


def catalogue_sql() -> str:
    from palimpsest.operators.constraints import CATALOGUE

    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({c.id}, {quoted(c.type)}, {quoted(c.sssc)}, {quoted(c.probe)}, {quoted(c.correct_answer)}, {quoted(c.incorrect_answer)})" for c in CATALOGUE)
    return f"cat AS (SELECT * FROM (VALUES {rows}) AS v(id, type, sssc, probe, correct_answer, incorrect_answer))"


def facts_sql() -> str:
    """Common tables up to ``facts``; to be followed by a select."""
    from palimpsest.operators.evaluation import MANIFEST

    runs = ", ".join(f"({i}, '{r}', '{c}', '{p}', {n}, {str(e).lower()}, {str(h).lower()})" for i, (r, c, p, n, e, h) in enumerate(MANIFEST))
    d = draw_sql
    frame = "position", "repeat", "CASE WHEN explicit THEN 1 ELSE 0 END", "CASE WHEN hard THEN 1 ELSE 0 END"
    known = lambda cond, *key: f"{d(repr('null'), repr(cond), *key)} >= 0.03"
    lift = "(CASE WHEN explicit THEN 0.05 ELSE 0.0 END + CASE WHEN hard THEN 0.05 ELSE 0.0 END)"
    return f"""WITH {CONV_SQL}, {catalogue_sql()},
man AS (SELECT * FROM (VALUES {runs}) AS v(manifest_pos, run_id, compactor, position, repeat, explicit, hard)),
base AS (
  SELECT ctx.*, man.*, cat.id AS sssc_id, cat.type AS sssc_type,
    list_transform(list_sort(list_transform(u, lambda i: struct_pack(d := {d("'rep'", "conv_id", "cat.id", "i")}, i := i)))[1:man.repeat], lambda x: x.i) AS drawn,
    {d("'err'", "run_id", "conv_id", "cat.id")} >= 0.02 AS ok,
    try_cast(regexp_extract(compactor, '^recent_([0-9]+)$', 1) AS INTEGER) AS win
  FROM ctx, man, cat WHERE len(u) > 0),
placed AS (
  SELECT *, CASE WHEN repeat > 1 THEN drawn WHEN position = 'top' THEN [u[1]] WHEN position = 'middle' THEN [u[(len(u) // 2 + 1)::INTEGER]] ELSE [u[-1]] END AS places FROM base),
judged AS (
  SELECT *, CASE WHEN win IS NOT NULL THEN list_max(places) >= n - win ELSE list_has_any(places, u[1:3]) END AS kept,
    CASE WHEN win IS NOT NULL THEN list_sum(t[greatest(n - win, 0) + 1:])
         ELSE 2 + list_sum(list_transform(u[1:3], lambda i: {tok("regexp_extract(m[i + 1].content, '^[^.!?\\n]*[.!?]?', 0)")})) END AS after
  FROM placed),
facts AS (
  SELECT manifest_pos, run_id, CASE conv_id % 3 WHEN 0 THEN 'agent_10k' WHEN 1 THEN 'agent_20k' ELSE 'chat_10k' END AS dataset,
    compactor, position, repeat, explicit, hard, conv_id AS source_row_index, sssc_id, sssc_type,
    CASE WHEN ok THEN 'success' ELSE 'error' END AS status,
    CASE WHEN {known('uninjected', 'conv_id', 'sssc_id')} THEN {d("'uninjected'", "conv_id", "sssc_id")} < 0.3 + 0.01 * sssc_id END AS uninjected,
    CASE WHEN {known('injected', 'conv_id', 'sssc_id', *frame)} THEN {d("'injected'", "conv_id", "sssc_id", *frame)} < 0.75 + {lift} END AS injected,
    CASE WHEN ok AND {known('compacted', 'run_id', 'conv_id', 'sssc_id')} THEN {d("'compacted'", "run_id", "conv_id", "sssc_id")} < CASE WHEN kept THEN 0.8 + {lift} ELSE 0.35 END END AS compacted,
    CASE WHEN ok AND {known('post', 'run_id', 'conv_id', 'sssc_id')} THEN {d("'post'", "run_id", "conv_id", "sssc_id")} < 0.9 END AS post,
    CASE WHEN ok THEN kept END AS retention,
    n AS turns, list_sum(t) AS tokens_before, CASE WHEN ok THEN after END AS tokens_after
  FROM judged)
"""

"""URL filters: path rules first, then link-graph propagation between hosts.

Hosts whose pages the rules allow seed trust, hosts whose pages they block seed
distrust.  Personalised PageRank carries trust along links and distrust against
them; mass of hosts without links returns to the seeds.  A page that no rule
judges is blocked when its host's distrust per page is ``threshold`` times the
average page's or more, and exceeds the host's trust per page.

A link without a host of its own stays on the page's host and is an edge from the
host to itself: it keeps rank where it is.  Host edges are counted before they are
shuffled, so a host with a third of all pages is one node like any other.  Ranks
are checkpointed every few rounds; a graph without edges settles like any other.

Defined results: a url that is null or has no ``://`` has an empty host and path,
fits no rule and is allowed; null html has no links; hosts that tie are judged
alike, each by its own scores; repeated rows each give their own row, and each counts as a page; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import checkpointed

#: Changes shrink by DAMPING a round, so about 100 rounds always settle; MAX_ROUNDS is never reached.
DAMPING, MAX_ROUNDS, TOLERANCE = 0.85, 400, 1e-7
THRESHOLD = 2.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)(?:href|src)\s*=\s*["']?([^"'>\s]+)"""
_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:"
_HOST = "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]+)"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url column."""
    host = F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_column(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest fitting rule as a struct (text, verdict), or null."""
    chosen = F.lit(None).cast("struct<text: string, verdict: string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is tested first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        chosen = F.when(fits, F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, links``: how many pages of a host link to a host, their own included.

    Relative links lead to the page's own host; links with a scheme and no host
    (mail, scripts), and those to a place on the same page, lead nowhere.
    """

    def target(link: Column) -> Column:
        host = F.translate(F.regexp_extract(link, _HOST, 1), _UPPER, _LOWER)
        return F.when(host != "", host).when(~link.rlike(_SCHEME) & ~link.startswith("#") & ~link.startswith("//"), F.col("host"))

    found = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(_LINK), 1), target))
    links = pages.filter("host <> ''").select(F.col("host").alias("src"), F.explode(found).alias("dst"))
    return links.filter("dst is not null").groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(seeds: DataFrame, edges: DataFrame, rounds: int | None = None, damping: float = DAMPING) -> DataFrame:
    """Personalised PageRank for several kinds at once, until it settles or for ``rounds``.

    ``seeds``: kind, host, seed (sums to 1 in a kind).  ``edges``: kind, src, dst,
    share (sums to 1 for each kind and src that has edges).  Returns kind, host, score.
    """
    ranks = seeds.select("kind", "host", F.col("seed").alias("score"))
    links = edges.select("kind", F.col("src").alias("host"), "dst", "share")
    sources = links.select("kind", "host").distinct()
    for _ in range(MAX_ROUNDS if rounds is None else rounds):
        sent = ranks.join(links, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.lit(damping) * F.col("score") * F.col("share")).alias("part"))
        resting = ranks.join(sources, ["kind", "host"], "left_anti").groupBy("kind").agg(F.sum("score").alias("rest"))
        back = seeds.join(resting, "kind", "left").select("kind", "host", (F.col("seed") * (1 - damping + damping * F.coalesce("rest", F.lit(0.0)))).alias("part"))
        parts = sent.unionByName(back).withColumn("was", F.lit(0.0)).unionByName(ranks.select("kind", "host", F.lit(0.0).alias("part"), F.col("score").alias("was")))
        # a row a host; each round's plan starts at the last round's rows, which also tell how far the ranks moved
        moved = checkpointed(parts.groupBy("kind", "host").agg(F.sum("part").alias("score"), F.sum("was").alias("was")))
        ranks = moved.select("kind", "host", "score")
        if rounds is None and (moved.agg(F.sum(F.abs(F.col("score") - F.col("was")))).first()[0] or 0.0) < TOLERANCE:
            break
    else:
        if rounds is None:
            raise RuntimeError("the ranks did not settle")
    return ranks


def judge(pages: DataFrame, rules: tuple[Rule, ...], threshold: float = THRESHOLD, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust``; the last two are the host's, per page."""
    host, path = url_parts(F.col(url_col).cast("string"))
    base = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.col(html_col).cast("string").alias("html"))
    ruled = base.withColumn("hit", rule_column(F.col("host"), F.col("path"), rules))

    per_host = checkpointed(
        ruled.filter("host <> ''").groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("hit.verdict") == "allow").alias("trust"), F.count_if(F.col("hit.verdict") == "block").alias("distrust"))
    )
    totals = per_host.agg(F.sum("pages").alias("all_pages"), F.sum("trust").alias("all_trust"), F.sum("distrust").alias("all_distrust"))
    kinds = per_host.crossJoin(F.broadcast(totals)).select("host", F.expr("stack(2, 'trust', trust / nullif(all_trust, 0), 'distrust', distrust / nullif(all_distrust, 0)) as (kind, seed)")).filter("seed > 0")
    edges = checkpointed(host_edges(base))
    out, into = edges.groupBy("src").agg(F.sum("links").alias("n")), edges.groupBy("dst").agg(F.sum("links").alias("n"))
    along = edges.join(out, "src").select(F.lit("trust").alias("kind"), "src", "dst", (F.col("links") / F.col("n")).alias("share"))
    against = edges.join(into, "dst").select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("links") / F.col("n")).alias("share"))
    scores = propagate(checkpointed(kinds), checkpointed(along.unionByName(against)))
    mean = F.col("pages") / F.col("all_pages")
    of_kind = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")))
    by_host = scores.groupBy("host").agg(of_kind("trust").alias("t"), of_kind("distrust").alias("d"))
    lifts = per_host.join(by_host, "host").crossJoin(F.broadcast(totals)).select("host", F.coalesce(F.col("t") / mean, F.lit(0.0)).alias("trust"), F.coalesce(F.col("d") / mean, F.lit(0.0)).alias("distrust"))
    lifts = checkpointed(lifts)  # a row a host; both sides of the join are then plain shuffles, so a hot host's pages can be split
    method = F.when((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    return ruled.drop("html").join(lifts, "host", "left").select(
        "page_id", "host", "path", F.col("hit.text").alias("rule"), F.coalesce("hit.verdict", method).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )

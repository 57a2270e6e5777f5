"""URL filter: rules first, then trust and distrust that spread over the host graph (operator 10), in DataFrame functions only.

Trust is personalised PageRank from hosts whose pages rules allow, along links; distrust is the same from hosts whose pages
rules block, against the links' direction. Links are those in the pages' html to named hosts; a host and its parent domain
(down to two labels) are linked both ways. A host is blocked where its distrust is at least `threshold` of both scores.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many rules are one expression over a page's row; more are joined by host.
INLINE_RULES = 200
LINK = r"(?i)(?:href|src|action)\s*=\s*[\x22']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\x22'\s<>]+)"
DAMPING, THRESHOLD = 0.85, 0.5
#: What later rounds could still move is at most this share of all scores, whatever the graph: after k rounds it is DAMPING ** k.
TOLERANCE = 1e-3
ROUNDS = math.ceil(math.log(TOLERANCE) / math.log(DAMPING))
#: Rounds that are one job; its scores are written.
STEP = 4
#: Longest host name that has parents (the limit of the domain name system).
LONGEST_HOST = 253


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The query's rules.
RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))


def split_url(pages: DataFrame) -> DataFrame:
    """pages with host and path; empty for a null url or one without "://"."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return pages.withColumn("_rest", rest).withColumn("host", F.translate(F.regexp_extract("_rest", r"^[^/?#]*+", 0), UPPER, LOWER)).withColumn("path", F.regexp_extract("_rest", r"^[^/?#]*+([^?#]*+)", 1)).drop("_rest")


def _fits(rule: Rule) -> Column:
    return ((F.col("host") == rule.host) | F.endswith("host", F.lit("." + rule.host))) & F.startswith("path", F.lit(rule.path))


def with_rule(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """pages (host, path, ...) with rule and ruled, the longest fitting rule's text and verdict, null where none fits.

    Of rules of the same text the first counts. Beyond INLINE_RULES, hosts are joined to rules on their domain suffixes and
    each host's rules, of which there are as many as the list has at most, go to its pages as one array.
    """
    ordered = sorted(dict.fromkeys(Rule(*r) for r in rules), key=lambda r: -len(r.text))
    if len(ordered) <= INLINE_RULES:
        found = F.lit(None).cast("struct<rule: string, ruled: string>")
        for r in reversed(ordered):
            found = F.when(_fits(r), F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("ruled"))).otherwise(found)
        return pages.withColumn("_found", found).withColumn("rule", F.col("_found.rule")).withColumn("ruled", F.col("_found.ruled")).drop("_found")
    spark = pages.sparkSession
    listed = spark.createDataFrame([(r.host, -len(r.text), i, r.path, r.text, r.verdict) for i, r in enumerate(ordered)], "suffix string, size int, place int, start string, rule string, ruled string")
    most = max(r.host.count(".") + 1 for r in ordered)
    labels = F.split("host", r"\.")
    hosts = pages.select("host").distinct().withColumn("_l", labels)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size("_l"))), lambda k: F.array_join(F.slice("_l", -k, k), "."))
    per_host = hosts.select("host", F.explode(suffixes).alias("suffix")).join(listed, "suffix").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("size", "place", "start", "rule", "ruled"))).alias("_rules"))
    best = F.get(F.filter("_rules", lambda r: F.startswith("path", r.start)), 0)
    return pages.join(per_host, "host", "left").withColumn("_best", best).withColumn("rule", F.col("_best.rule")).withColumn("ruled", F.col("_best.ruled")).select(*pages.columns, "rule", "ruled")


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links between hosts, 1 + ln(count), and both ways between a host and its parent."""
    linked = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
    linked = linked.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> '' AND src <> dst").groupBy("src", "dst").count()
    names = pages.select("host").distinct().union(linked.select("dst")).distinct().where(F.length("host") <= LONGEST_HOST)
    labels = F.split("host", r"\.")
    n = F.size(labels)
    tail = lambda k: F.array_join(F.slice("_l", k, F.size("_l")), ".")
    steps = F.transform(F.sequence(F.lit(1), F.size("_l") - 2), lambda k: F.struct(tail(k).alias("a"), tail(k + 1).alias("b")))
    kin = names.withColumn("_l", labels).where(n > 2).select(F.inline(steps)).distinct()
    both = kin.selectExpr("a AS src", "b AS dst", "1.0D AS weight").union(kin.selectExpr("b AS src", "a AS dst", "1.0D AS weight"))
    return linked.selectExpr("src", "dst", "1.0D + ln(count) AS weight").union(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(work: Workspace, edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) after so many rounds; seeds: (host, allowed, blocked), shares of the host's pages.

    A node's score is its seed's part and what its neighbours pass on by edge weight; what a host without links out would pass on
    is lost. Each round is a join on the sending host, pre-aggregated by the receiving one; every STEP rounds are written to the
    shared folder.
    """
    total = seeds.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).first()
    give = lambda c, t: (F.col(c) / t if t else F.lit(0.0)).alias("seed")
    seed = seeds.select(F.explode(F.array(F.struct("host", F.lit(0).alias("kind"), give("allowed", total.a)), F.struct("host", F.lit(1).alias("kind"), give("blocked", total.b)))).alias("s")).select("s.*").where("seed > 0")
    seed = work.keep(seed, "seed")
    ways = edges.selectExpr("src AS giver", "dst AS taker", "0 AS kind", "weight").union(edges.selectExpr("dst AS giver", "src AS taker", "1 AS kind", "weight"))
    out = ways.groupBy("giver", "kind").agg(F.sum("weight").alias("out"))
    ways = work.keep(ways.join(out, ["giver", "kind"]).selectExpr("giver", "taker", "kind", "weight / out AS share"), "ways")
    score = seed.selectExpr("host", "kind", "seed AS score")
    for k in range(rounds):
        passed = ways.join(score.selectExpr("host AS giver", "kind", "score"), ["giver", "kind"]).selectExpr("taker AS host", "kind", f"{damping}D * share * score AS score")
        kept = seed.selectExpr("host", "kind", f"{1 - damping}D * seed AS score")
        score = passed.union(kept).groupBy("host", "kind").agg(F.sum("score").alias("score"))
        if (k + 1) % STEP == 0 or k + 1 == rounds:
            score = work.keep(score, f"score-{k}")
            if k >= 2 * STEP:
                work.drop(f"score-{k // STEP * STEP - 1}")
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0))
    return score.groupBy("host").agg(of(0).alias("trust"), of(1).alias("distrust"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust (0 where nothing reaches it).

    Null or malformed urls have empty host and path and are allowed unless a rule says otherwise; null html has no links;
    repeated rows give a row each; an empty table gives none. Other columns are not read.
    """
    work = Workspace(pages.sparkSession, "urls")
    cut = split_url(pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")))
    ruled = with_rule(cut.drop("html"), rules)
    share = lambda v: F.avg(F.when(F.col("ruled") == v, 1.0).otherwise(0.0))
    seeds = work.keep(ruled.where("host <> ''").groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked")), "seeds")
    scores = propagate(work, work.keep(host_edges(cut), "edges"), seeds)
    bad = F.coalesce((F.col("distrust") > 0) & (F.col("distrust") >= threshold * (F.col("trust") + F.col("distrust"))), F.lit(False))
    out = ruled.join(scores, "host", "left").withColumn("verdict", F.coalesce("ruled", F.when(bad, "block").otherwise("allow")))
    return out.select("page_id", "host", "path", "rule", "verdict", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op10_url_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")

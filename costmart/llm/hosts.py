"""URL filter by propagation over the link graph of hosts.

Rules (allow or block a host with its subdomains and a path prefix) judge a
page first, the longest rule that fits.  Hosts get seed weights from the share
of their pages that rules allow or block.  Trust spreads from allowed hosts
along links (personalised PageRank: a host divides what it has among the hosts
it links to).  Distrust spreads from blocked hosts against the links: a host
takes damping times the mean of the hosts it links to.  So distrust is the
discounted blame a surfer meets who starts there; the number of other hosts that
link to a blocked one does not shrink it, and one link of thousands weighs one
part in thousands.  Scores are iterated until the rest is below ``tolerance``.
A page without a rule is blocked if its host's distrust is at least
``min_distrust`` and more than ``block_share`` of its trust and distrust
together.

Built from DataFrame functions only.  Links are counted per host pair before
anything is joined, so a host that holds a third of all pages is one row in
the graph; AQE splits it where pages meet their host's verdict.

Defined cases: a null URL or one without ``://`` has an empty host and path,
which no rule fits; the empty host neither seeds nor spreads; a null page has
no links; an unreached host is allowed; repeated rows are judged alike and
count as pages; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costmart.llm.common import keep_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hosts of absolute and protocol-relative links.
LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    """``allow`` or ``block`` for a host, its subdomains and a path prefix."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith(f".{self.host}")) & path.startswith(self.path)


def parse_rule(verdict: str, text: str) -> Rule:
    """A rule from text like ``example.org/es/``."""
    host, slash, path = text.partition("/")
    return Rule(verdict, host, slash + path)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    known = F.coalesce(url, F.lit(""))
    return (F.translate(F.regexp_extract(known, pattern, 1), UPPER, LOWER),
            F.regexp_extract(known, pattern, 2))


def ruled(pages: DataFrame, rules: list[Rule], id_col: str, url_col: str) -> DataFrame:
    """page_id, host, path, rule, verdict by rules alone."""
    host, path = url_parts(F.col(f"`{url_col}`").cast("string"))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"),
                        host.alias("host"), path.alias("path"))
    rule = verdict = None
    for r in sorted(rules, key=lambda r: len(r.text), reverse=True):
        fits = r.fits(F.col("host"), F.col("path"))
        rule = F.when(fits, r.text) if rule is None else rule.when(fits, r.text)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    none = F.lit(None).cast("string")
    return rows.withColumns({"rule": none if rule is None else rule,
                             "verdict": none if verdict is None else verdict})


def host_links(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """src, dst: the distinct links between different hosts."""
    host, _ = url_parts(F.col(f"`{url_col}`").cast("string"))
    found = F.regexp_extract_all(F.col(f"`{html_col}`").cast("string"), F.lit(LINK), F.lit(1))
    return (pages.select(host.alias("src"), F.array_distinct(found).alias("found"))
            .where("src != '' AND size(found) > 0")
            .select("src", F.explode("found").alias("dst"))
            .select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
            .where("src != dst").distinct())


def spread(seeds: DataFrame, links: DataFrame, damping: float = 0.85,
           tolerance: float = 1e-4) -> DataFrame:
    """kind, host, score from kind, host, seed: the fixed point of seed plus what links bring.

    A link weighs damping over the links of the host it stands on.  ``trust``
    takes it along, ``distrust`` against its direction; both take each step in
    one join and one aggregation.  Each step shrinks the change by damping at
    least, in sum (trust) or at most (distrust), so the iteration ends; it does
    when what can still come is below ``tolerance`` of each score (of 1 for
    smaller scores).  Every fourth step is written, and the change of the step
    after it looked at.
    """
    weights = links.groupBy("src").agg((damping / F.count(F.lit(1))).alias("share"))
    weighed = links.join(weights, "src")
    walks = keep_table(
        weighed.select(F.lit("trust").alias("kind"), F.col("src").alias("host"),
                       F.col("dst").alias("to"), "share")
        .unionByName(weighed.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"),
                                    F.col("src").alias("to"), "share")), "host-walks")
    seeds = keep_table(seeds.select("kind", "host", F.col("seed").cast("double").alias("score")),
                       "host-seeds")
    if walks.isEmpty():
        return seeds
    step = lambda score: (
        seeds.unionByName(score.join(walks, ["kind", "host"]).select(
            "kind", F.col("to").alias("host"), (F.col("score") * F.col("share")).alias("score")))
        .groupBy("kind", "host").agg(F.sum("score").alias("score")))
    score, change = seeds, None
    while change is None or change * damping / (1 - damping) > tolerance:
        before = step(step(step(score)))
        both = step(before).withColumnRenamed("score", "now").join(before, ["kind", "host"], "left")
        # A host once reached stays reached, so the left side has every host.
        table = keep_table(both.withColumn("score", F.coalesce("score", F.lit(0.0))), "host-scores")
        change = table.agg(F.max(F.abs(F.col("now") - F.col("score"))
                                 / F.greatest("now", F.lit(1.0)))).first()[0] or 0.0
        score = table.select("kind", "host", F.col("now").alias("score"))
    return score


def judge(pages: DataFrame, rules: list[Rule], block_share: float = 0.75,
          min_distrust: float = 0.5, damping: float = 0.85, tolerance: float = 1e-4,
          id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page."""
    rows = ruled(pages, rules, id_col, url_col)
    by_host = rows.where("host != ''").groupBy("host").agg(
        F.avg((F.coalesce("verdict", F.lit("")) == "allow").cast("double")).alias("trust"),
        F.avg((F.coalesce("verdict", F.lit("")) == "block").cast("double")).alias("distrust"))
    seeds = by_host.select("host", F.explode(F.create_map(
        F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "seed")) \
        .where("seed > 0")
    scores = spread(seeds, host_links(pages, url_col, html_col), damping, tolerance)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))),
                                 F.lit(0.0)).alias(kind)
    hosts = scores.groupBy("host").agg(of("trust"), of("distrust"))
    both = F.col("trust") + F.col("distrust")
    bad = (F.col("distrust") >= min_distrust) & (F.col("distrust") > block_share * both)
    return (rows.join(hosts, "host", "left")
            .withColumns({k: F.coalesce(k, F.lit(0.0)) for k in ("trust", "distrust")})
            .select("page_id", "host", "path", "rule",
                    F.coalesce("verdict", F.when(bad, "block").otherwise("allow"))
                    .alias("verdict"), "trust", "distrust"))

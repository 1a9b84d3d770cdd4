"""URL filters: host and path rules, then trust and distrust propagated over links between hosts.

Pages that no rule fits are judged by their host. Personalised PageRank carries trust along links
from hosts with allowed pages; over the reversed links it carries distrust from hosts with blocked
pages to those that link to them. A host is blocked if its distrust passes a threshold and its trust.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Durable, table

#: (verdict, rule): a rule is a host and a path, put together.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DAMPING = 0.85
#: Rounds go on until no host's trust or distrust moves by more than this share of a whole seed's, up to a number that the damping makes enough.
TOLERANCE = 1e-3
ROUNDS = 60
#: After so many rounds, scores are written to the shared folder and looked at.
TURN = 4
#: Distrust that blocks, as a share of what a host has whose pages are all blocked and that links to none.
THRESHOLD = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""

    def fits(rule: str) -> Column:
        at = rule.index("/")
        return ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])

    ordered = sorted(rules, key=lambda r: -len(r[1]))
    none = F.lit(None).cast("string")
    return tuple(reduce(lambda rest, r: F.when(fits(r[1]), F.lit(r[of])).otherwise(rest), reversed(ordered), none) for of in (1, 0))  # type: ignore[return-value]


def host_links(pages: DataFrame) -> DataFrame:
    """``src``, ``dst``: which host links to which other, and each host with its parent, where both have pages.

    ``pages`` has ``host`` and ``html``. Links are the absolute ones of href attributes.
    """
    found = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""), F.lit(1))).alias("dst"))
    links = found.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).distinct()
    hosts = pages.select(F.col("host").alias("src")).distinct()
    parents = hosts.select("src", F.regexp_extract("src", r"^[^.]+\.(.+\..+)$", 1).alias("dst")).where("dst <> ''").join(hosts.select(F.col("src").alias("dst")), "dst", "left_semi")
    both = parents.unionByName(parents.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return links.unionByName(both).where("src <> dst and src <> '' and dst <> ''").distinct()


def propagate(links: DataFrame, seeds: DataFrame, durable: Durable, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``host``, ``trust``, ``distrust`` and ``residual``: by how much any of them moved in the last round.

    ``seeds`` has ``host``, ``allowed`` and ``blocked`` (0 to 1). Each round, a host keeps
    ``1 - damping`` of its seed and gets ``damping`` of what neighbours have, who share it equally:
    trust from those that link to it, distrust from those that it links to. What a host without
    such links has stays with it and goes no further, so scores do not depend on hosts that are not
    connected. Rounds end when the residual is within ``tolerance`` of a whole seed's, or after
    ``rounds``. Every TURN rounds are written to the shared folder.
    """
    out = links.groupBy("src").agg(F.count(F.lit(1)).alias("n_out"))
    into = links.groupBy("dst").agg(F.count(F.lit(1)).alias("n_in"))
    weighed = durable.keep(links, "links")
    out, into = durable.keep(out, "out"), durable.keep(into, "into")
    weighed = weighed.join(out, "src").join(into, "dst")
    # Trust goes from src to dst, shared by src's links; distrust from dst to src, shared by the links to dst.
    moves = durable.keep(weighed.select(F.col("src").alias("a"), F.col("dst").alias("b"), (damping / F.col("n_out")).alias("t"), F.lit(0.0).alias("d")).unionByName(weighed.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(0.0).alias("t"), (damping / F.col("n_in")).alias("d"))), "moves")
    hosts = links.select(F.explode(F.array("src", "dst")).alias("host")).unionByName(seeds.select("host")).distinct()
    start = hosts.join(seeds, "host", "left").select("host", ((1 - damping) * F.coalesce("allowed", F.lit(0.0))).alias("trust0"), ((1 - damping) * F.coalesce("blocked", F.lit(0.0))).alias("distrust0"))
    start = durable.keep(start, "start")
    now = start.select("host", F.col("trust0").alias("trust"), F.col("distrust0").alias("distrust"), F.lit(0.0).alias("moved"))
    residual = 0.0
    for k in range(1, rounds + 1) if not moves.isEmpty() else ():
        sent = moves.join(now, F.col("a") == F.col("host")).groupBy("b").agg(F.sum(F.col("t") * F.col("trust")).alias("t"), F.sum(F.col("d") * F.col("distrust")).alias("d"))
        before = now.select("host", F.col("trust").alias("old_t"), F.col("distrust").alias("old_d"))
        new = start.join(sent, F.col("host") == F.col("b"), "left").select("host", (F.col("trust0") + F.coalesce("t", F.lit(0.0))).alias("trust"), (F.col("distrust0") + F.coalesce("d", F.lit(0.0))).alias("distrust"))
        if k % TURN == 0 or k == rounds:
            moved = F.greatest(F.abs(F.col("trust") - F.col("old_t")), F.abs(F.col("distrust") - F.col("old_d")))
            now = durable.keep(new.join(before, "host").select("host", "trust", "distrust", moved.alias("moved")), "now")
            residual = float(now.agg(F.max("moved")).first()[0] or 0.0)
            if residual <= tolerance * (1 - damping):
                break
        else:
            now = new
    return now.select("host", "trust", "distrust", F.lit(residual).alias("residual"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, threshold: float = THRESHOLD, damping: float = DAMPING) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, and the host's ``trust`` and ``distrust``.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest
    decides. Other pages are blocked if their host is: its distrust is above ``threshold`` times
    that of a host whose pages are all blocked, and above its trust. A very long page costs a scan of its
    text for links and no more. Null urls and those without
    ``://`` have empty host and path, fit no rule and are allowed. A null html has no links. Null
    ids and repeated rows stay as rows; other columns are not looked at; no rows, no result.
    """
    durable = Durable(pages.sparkSession)
    found = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    ruled = found.withColumns({"rule": rule, "ruled": verdict})
    seeds = ruled.where("host <> ''").groupBy("host").agg(F.avg(F.coalesce(F.col("ruled") == "allow", F.lit(False)).cast("double")).alias("allowed"), F.avg(F.coalesce(F.col("ruled") == "block", F.lit(False)).cast("double")).alias("blocked"))
    seeds = durable.keep(seeds, "seeds")
    links = durable.keep(host_links(found), "host_links")
    ranks = propagate(links, seeds, durable, damping)
    ranks = durable.keep(ranks.select("host", (F.col("trust") / (1 - damping)).alias("trust"), (F.col("distrust") / (1 - damping)).alias("distrust")), "ranks")
    blocked = (F.col("distrust") > threshold) & (F.col("distrust") > F.col("trust"))
    by_host = F.when(F.coalesce(blocked, F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return ruled.drop("html").join(ranks, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", by_host).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")

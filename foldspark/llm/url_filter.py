"""URL filters: host and path rules first, then a path-template tree per host. DataFrame functions only.

Level by level, a node of a host's tree has a variable segment, which becomes `*`, if no child holds as much as a fixed
share of its rows; Hoeffding's bound says what its rows can tell. Where a host has too few, the rows of all hosts that
have come to the same template decide. From the last level to the first, a branch is merged into its largest sibling if
the templates below both and their labelled shares differ by no more than the bounds of two samples allow.

A template is rejected when its smoothed share of blocked pages among the labelled ones, which are those that a rule
decides, is high. Its prior is that of its path templates on all hosts, whose own prior is the share of all pages. So what
the rules say of a template on some hosts also judges it on hosts without a rule.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.llm.common import materialise

TOP_SHARE = 0.25  # a segment with such a child is fixed
DOUBT = 0.1  # of a variable segment
ALIKE = 0.974  # siblings may differ by this over the root of each one's rows: sqrt(ln(2 / 0.3) / 2)
PRIOR_WEIGHT = 4.0
REJECT_SHARE = 0.7
SPREAD = math.log(1 / DOUBT) / 2


@dataclass(frozen=True)
class Rule:
    """Allow or block the pages of a host and its subdomains whose path starts with `path`."""

    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules that the registered query applies.
RULES = (Rule("org", "/", True), Rule("example.org", "/es/", False), Rule("example.org", "/en/1", False), Rule("com", "/fr/", True), Rule("com", "/de/", False))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without `://`."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(whole, parts, 1), upper, lower), F.regexp_extract(whole, parts, 2)


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Struct (size, rule, allow) of the longest rule that fits, or null. Equal lengths: the rule that sorts last."""
    fits = [
        F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.struct(F.lit(len(r.text)).alias("size"), F.lit(r.text).alias("rule"), F.lit(r.allow).alias("allow")))
        for r in rules
    ]
    return F.array_max(F.array_compact(F.array(*fits))) if fits else F.lit(None).cast("struct<size:int,rule:string,allow:boolean>")


def _bound(n: Column) -> Column:
    """How far a share of n rows may be from the true one."""
    return F.sqrt(F.lit(SPREAD) / n)


def _shared(a: Column, b: Column) -> Column:
    """How many elements two arrays have in common from the start."""
    first = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")


def _jumped(live: DataFrame) -> DataFrame:
    """Rows moved over the segments that all paths of their template, on whatever host, have in common.

    There one child holds all rows, on each host and on all, so those segments are fixed whatever the bounds say.
    """
    rest = F.slice("parts", F.col("at") + 1, F.greatest(F.size("parts"), F.lit(1)))
    jump = live.groupBy("template").agg(F.min(rest).alias("low"), F.max(rest).alias("high")).select("template", _shared(F.col("low"), F.col("high")).alias("jump"))
    common = F.concat_ws("", F.transform(F.slice("parts", F.col("at") + 1, F.col("jump")), lambda s: F.concat(F.lit("/"), s)))
    moved = live.join(jump, "template").withColumn("template", F.concat("template", common))
    return moved.withColumn("at", F.col("at") + F.col("jump")).drop("jump").withColumn("part", F.get("parts", "at"))


def _templates(paths: DataFrame) -> DataFrame:
    """Add `template` and `forks` to counted (host, path, parts) rows: variable segments become `*`, level by level.

    forks are the levels where a row's template has siblings on its host. A round takes each row to the next level where
    paths of its template part, and rows whose path has ended leave; so the rounds are as many as such levels on one path,
    and not as its segments.
    """
    live = paths.withColumns({"template": F.lit(""), "at": F.lit(0), "forks": F.array().cast("array<int>")})
    columns = [*paths.columns, "template", "forks"]
    done = []
    while True:
        cur = materialise(_jumped(live), "template-rows")
        done.append(cur.where("part is null").select(*columns))
        child = cur.where("part is not null").groupBy("host", "template", "part").agg(F.sum("n").alias("n"))
        own = child.groupBy("host", "template").agg(F.sum("n").alias("n"), (F.max("n") / F.sum("n")).alias("top"), (F.count("*") > 1).alias("many"))
        pooled = child.groupBy("template", "part").agg(F.sum("n").alias("n")).groupBy("template").agg((F.max("n") / F.sum("n") + _bound(F.sum("n")) < TOP_SHARE).alias("pooled"))
        varies = F.when(F.col("top") + _bound(F.col("n")) < TOP_SHARE, True).when(F.col("top") - _bound(F.col("n")) >= TOP_SHARE, False).otherwise(F.col("pooled"))
        node = own.join(pooled, "template").select("host", "template", varies.alias("varies"), "many")
        step = F.when(F.col("varies"), "/*").otherwise(F.concat(F.lit("/"), "part"))
        forks = F.when(F.col("many") & ~F.col("varies"), F.array_append("forks", F.col("at") + 1)).otherwise(F.col("forks"))
        live = cur.where("part is not null").join(node, ["host", "template"])
        live = live.select(*paths.columns, F.concat("template", step).alias("template"), (F.col("at") + 1).alias("at"), forks.alias("forks"))
        live = materialise(live, "templates")
        if live.isEmpty():
            return reduce(DataFrame.union, done)


def _differ_little(a: Column, b: Column, distance: Column) -> Column:
    """May two samples of a and b rows with shares this far apart be of one kind?"""
    return distance <= ALIKE * (1 / F.sqrt(a) + 1 / F.sqrt(b))


def _merged(tree: DataFrame, levels: list[int]) -> DataFrame:
    """Add `merged` to counted (host, template) rows: branches that are like their largest sibling take its name.

    The templates below two branches are as far apart as the share of rows that they don't have in common. A branch without
    labelled pages has the labels of its name on all hosts; without any, it is like others without. At other than the given
    levels no branch has a sibling; merging deeper ones changes no name above them.
    """
    cur = tree.withColumn("merged", F.col("template"))
    node = ["host", "parent"]
    for level in sorted(levels, reverse=True):
        deep = F.length("merged") - F.length(F.replace("merged", F.lit("/"))) >= level
        head = F.when(deep, F.substring_index("merged", "/", level + 1))
        cur = cur.withColumn("head", head).withColumn("tail", F.expr("substring(merged, length(head) + 1)")).withColumn("parent", F.when(deep, F.substring_index("merged", "/", level)))
        twig = cur.where("head is not null").groupBy(*node, "head", "tail").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "blocked")))
        branch = twig.groupBy(*node, "head").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "blocked")))
        everywhere = branch.groupBy("head").agg(F.sum("labelled").alias("all_l"), F.sum("blocked").alias("all_b"))
        own = F.col("labelled") > 0
        known = branch.join(everywhere, "head").select(*node, "head", "n", F.when(own, F.col("labelled")).otherwise(F.col("all_l")).alias("l"), F.when(own, F.col("blocked")).otherwise(F.col("all_b")).alias("b"))
        known = materialise(known, "branches")
        place = F.struct(-F.col("n"), "head")
        hub = known.groupBy(*node).agg(F.count("*").alias("k"), *(F.min_by(c, place).alias(f"hub_{c}") for c in ("head", "n", "l", "b"))).where("k > 1").drop("k")
        pair = known.join(hub, node).where("head <> hub_head")
        below = twig.select(*node, "head", "tail", F.col("n").alias("m"))
        hubs = below.join(hub.select(*node, F.col("hub_head").alias("head")), [*node, "head"]).select(*node, "tail", F.col("m").alias("hub_m"))
        common = below.join(pair.select(*node, "head", "n", "hub_n"), [*node, "head"]).join(hubs, [*node, "tail"])
        common = common.groupBy(*node, "head").agg(F.sum(F.least(F.col("m") / F.col("n"), F.col("hub_m") / F.col("hub_n"))).alias("common"))
        pair = pair.join(common, [*node, "head"], "left")
        apart = F.round(1 - F.coalesce("common", F.lit(0.0)), 9)
        labels = F.when(F.greatest("l", "hub_l") == 0, True).when(F.least("l", "hub_l") == 0, False)
        labels = labels.otherwise(_differ_little(F.col("l"), F.col("hub_l"), F.abs(F.col("b") / F.col("l") - F.col("hub_b") / F.col("hub_l"))))
        alike = pair.where(_differ_little(F.col("n"), F.col("hub_n"), apart) & labels)
        into = F.concat("hub_head", F.lit("|..")).alias("into")
        name = materialise(alike.select("host", "head", into).union(alike.select("host", F.col("hub_head"), into).distinct()), "merged-branches")
        cur = cur.join(name, ["host", "head"], "left").withColumn("merged", F.when(F.col("head").isNull(), F.col("merged")).otherwise(F.concat(F.coalesce("into", "head"), "tail")))
        cur = materialise(cur.drop("head", "tail", "parent", "into"), "merged")
    return cur


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, reject_share: float = REJECT_SHARE) -> DataFrame:
    """One row for each page: (page_id, host, path, rule, verdict, template, blocked_share).

    verdict is the longest fitting rule's, else `block` if the page's template is rejected and `allow` if not. Where
    nothing is labelled, every share is a half. A null url, or one without `://`, has an empty host and path and the
    template of these. Paths of any length are read whole; each level where paths of one template part is a round of joins. Repeated rows
    count each and get equal verdicts; of equally large siblings the one that sorts first gives the name; an empty table
    gives no rows. Only page_id and url are read; the rules must be few enough for one expression.
    """
    host, path = host_and_path(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    judged = judged.withColumn("found", matching_rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.allow").alias("allow"))
    blocked = F.when(~F.col("allow"), 1).otherwise(0)
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    paths = judged.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("allow").alias("labelled"), F.sum(blocked).alias("blocked")).withColumn("parts", parts)
    paths = materialise(paths, "paths")
    leaf = _templates(paths).select("host", "path", "template", "n", "labelled", "blocked", "forks")
    levels = [r[0] for r in leaf.select(F.explode("forks")).distinct().collect()]  # a number for each level at most
    named = _merged(leaf.groupBy("host", "template").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "blocked"))), levels)
    base = named.agg(((F.coalesce(F.sum("blocked"), F.lit(0)) + 1) / (F.coalesce(F.sum("labelled"), F.lit(0)) + 2)).alias("base"))
    smoothed = (F.sum("blocked") + PRIOR_WEIGHT * base.scalar()) / (F.sum("labelled") + PRIOR_WEIGHT)
    prior = named.groupBy("template").agg(smoothed.alias("prior"))
    of = named.join(prior, "template").groupBy("host", "merged").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), (F.sum(F.col("n") * F.col("prior")) / F.sum("n")).alias("prior"))
    share = of.select("host", "merged", F.round((F.col("b") + PRIOR_WEIGHT * F.col("prior")) / (F.col("l") + PRIOR_WEIGHT), 6).alias("blocked_share"))
    verdict = leaf.select("host", "path", "template").join(named.select("host", "template", "merged"), ["host", "template"]).join(share, ["host", "merged"])
    out = judged.join(verdict.select("host", "path", "merged", "blocked_share"), ["host", "path"])
    decided = F.when(F.col("allow").isNotNull(), F.when(F.col("allow"), "allow").otherwise("block")).when(F.col("blocked_share") >= reject_share, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", decided.alias("verdict"), F.col("merged").alias("template"), "blocked_share")

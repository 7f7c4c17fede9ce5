"""URL filter by a path-template tree: wildcards for variable segments, merged branches, smoothed labelled purity.

DataFrame functions only. Pages are reduced to distinct (host, template) rows with counts first; the tree is then grown
level by level over those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintline.llm.common import drop, save

#: The rules of the production query, as (verdict, host and path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

#: A branch with more children than this, none of them with half of its pages, has one wildcard child.
CHILDREN = 12
#: Pages that a parent's rate weighs in a child's smoothed rate.
STRENGTH = 4.0
#: A branch leaves the merged one if its rate differs from the parent's by so many standard deviations.
SIGMA = 2.0
THRESHOLD = 0.5


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty where there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule (ties: the smaller text) whose host is the page's or above it and whose path begins the page's."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        at, _, start = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + start)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def template_of(path: Column) -> Column:
    """Segments of a path with their variable parts generalised: digits, dates, long hex runs and mixed codes."""

    def kind(s: Column) -> Column:
        return (
            F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit("{date}"))
            .when(s.rlike(r"^\d+$"), F.lit("{n}"))
            .when(s.rlike(r"^\d+\.[A-Za-z]{1,5}$"), F.concat(F.lit("{n}."), F.regexp_extract(s, r"\.([A-Za-z]+)$", 1)))
            .when(s.rlike(r"^[0-9a-fA-F-]{8,}$") & s.rlike(r"\d"), F.lit("{hex}"))
            .when(s.rlike(r"\d{3,}"), F.regexp_replace(s, r"\d{3,}", "{n}"))
            .otherwise(s)
        )

    return F.transform(F.split(path, "/"), kind)


def shared_start(low: Column, high: Column) -> Column:
    """Segments that the smallest and the largest of some templates begin with, and so all of them."""
    same = F.transform(low, lambda x, i: x.eqNullSafe(F.get(high, i)))
    return F.when(F.array_position(same, F.lit(False)) > 0, F.array_position(same, F.lit(False)) - 1).otherwise(F.size(low)).cast("int")


def grow(leaves: DataFrame, children: int = CHILDREN, strength: float = STRENGTH, sigma: float = SIGMA) -> DataFrame:
    """leaves (host, template, pages, labelled, blocked) -> (host, template, branch, rate), level by level.

    On each level of a host's branch: more than `children` children without a dominant one become one wildcard;
    children whose blocked share does not differ from the branch's (a z-test) are merged; a child's rate is
    (blocked + strength * branch rate) / (labelled + strength). The root's rate is that of all labelled pages,
    half where there are none. Templates may be of any length: the levels on which a branch has one child are taken in
    one step, so that rounds follow the forks on a path, not its segments.
    """
    top = leaves.agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("b")).first()
    root = (top.b / top.n) if top.n else 0.5
    hosts = leaves.groupBy("host").agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("b"))
    hosts = hosts.select("host", ((F.col("b") + strength * root) / (F.col("n") + strength)).alias("rate"), F.lit("").alias("branch"), F.lit(0).alias("at"))
    now = save(leaves.join(hosts, "host"), "level")
    open_ = F.size("template") > F.col("at")
    while not now.where(open_).isEmpty():
        tail = F.slice("template", F.col("at") + 1, F.size("template"))
        ends = now.where(open_).groupBy("host", "branch").agg(F.min(tail).alias("low"), F.max(tail).alias("high"), *[F.sum(c).alias(f"all_{c}") for c in ("labelled", "blocked")])
        ends = save(ends.select("host", "branch", shared_start(F.col("low"), F.col("high")).alias("alone"), "all_labelled", "all_blocked"), "alone")
        # a child that is alone has its branch's share: so many smoothings of one rate by one share
        share = F.col("all_blocked") / F.when(F.col("all_labelled") > 0, F.col("all_labelled"))
        left = F.pow(F.lit(float(strength)) / (F.col("all_labelled") + strength), F.col("alone"))
        run = now.where(open_).join(ends, ["host", "branch"])
        run = run.withColumn("rate", F.coalesce(share + (F.col("rate") - share) * left, "rate")).withColumn("at", F.col("at") + F.col("alone"))
        run = save(run.withColumn("branch", F.concat("branch", F.repeat(F.lit("/~"), F.col("alone")))).select(*now.columns), "run")

        going = run.where(open_).withColumn("seg", F.get("template", F.col("at")))
        kids = save(going.groupBy("host", "branch", "seg").agg(F.max("rate").alias("above"), *[F.sum(c).alias(c) for c in ("pages", "labelled", "blocked")]), "kids")
        whole = kids.groupBy("host", "branch").agg(
            F.count("*").alias("n_kids"), F.max("pages").alias("most"), *[F.sum(c).alias(f"all_{c}") for c in ("pages", "labelled", "blocked")]
        )
        whole = save(whole, "whole")
        judged = kids.join(whole, ["host", "branch"])
        wild = (F.col("n_kids") > children) & (2 * F.col("most") < F.col("all_pages"))
        share = F.col("all_blocked") / F.col("all_labelled")
        spread = F.sqrt(share * (1 - share) / F.col("labelled"))
        odd = (F.col("labelled") > 0) & (F.abs(F.col("blocked") / F.when(F.col("labelled") > 0, F.col("labelled")) - share) > sigma * spread)
        named = judged.withColumn("name", F.when(wild, F.lit("*")).when(F.coalesce(odd, F.lit(False)), F.col("seg")).otherwise(F.lit("~")))
        merged = named.groupBy("host", "branch", "name").agg(F.max("above").alias("above"), F.sum("labelled").alias("n"), F.sum("blocked").alias("b"))
        merged = save(merged.withColumn("rate", (F.col("b") + strength * F.col("above")) / (F.col("n") + strength)).select("host", "branch", "name", "rate"), "merged")
        step = named.select("host", "branch", "seg", "name").join(merged, ["host", "branch", "name"])
        step = save(step.select("host", "branch", "seg", F.col("rate").alias("new_rate"), F.concat_ws("/", "branch", "name").alias("new_branch")), "step")
        moved = going.join(step, ["host", "branch", "seg"])
        moved = moved.select("host", "template", "pages", "labelled", "blocked", F.col("new_rate").alias("rate"), F.col("new_branch").alias("branch"), (F.col("at") + 1).alias("at"))
        before = now
        now = save(moved.unionByName(run.where(~open_)).unionByName(now.where(~open_)), "level")
        for x in (before, ends, run, kids, whole, merged, step):
            drop(x)
    return now.select("host", "template", "branch", "rate")


def judge(pages: DataFrame, rules=RULES, url_col: str = "url", label: Column | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """`pages` with host, path, rule, branch, rate and verdict (allow or block).

    A fitting rule decides; `rules` is a short fixed list of (verdict, host/path). For all other pages the rate of
    their place in the tree does: at `threshold` or more they are blocked. The tree learns from labelled pages:
    those of `label` (a column: true for blocked, null for unknown), by default those that a rule decides. Null urls and
    those without `://` have an empty host and path and are judged as such. Repeated rows each count and give a row.
    Columns of these names in the input are replaced. An empty table gives an empty result.
    """
    plain = pages.drop("host", "path", "rule", "branch", "rate", "verdict")
    url = F.col(url_col)
    seen = plain.withColumn("host", host_of(url)).withColumn("path", path_of(url)).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    blocks = F.col("rule").isin([r for v, r in rules if v == "block"])
    known = blocks if label is None else label
    t = "__template"
    while t in (c.lower() for c in seen.columns):
        t += "_"
    seen = seen.withColumn(t, template_of(F.col("path")))
    leaves = seen.groupBy("host", F.col(t).alias("template")).agg(F.count("*").alias("pages"), F.count(known).alias("labelled"), F.count_if(known).alias("blocked"))
    tree = grow(save(leaves, "leaves")).withColumnRenamed("template", t)
    out = seen.join(tree, ["host", t], "left").drop(t)
    return out.withColumn("verdict", F.when(F.col("rule").isNotNull(), F.when(blocks, F.lit("block")).otherwise(F.lit("allow"))).when(F.col("rate") >= threshold, F.lit("block")).otherwise(F.lit("allow")))

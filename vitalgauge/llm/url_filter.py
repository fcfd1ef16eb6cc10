"""URL filters: a path-template tree for each host, built and applied with DataFrame functions alone.

Level by level down the path, each node of a host's tree looks at the segments below it:

- where they are many (``most_kinds``) and each is rare, the segment is variable and becomes a wildcard that keeps its
  file ending;
- of the others, branches whose labelled share of bad pages doesn't differ from the node's by more than ``merge_z``
  standard errors are merged into one branch; a branch that differs keeps its name.

This goes on until no path has a further segment; a path that is alone below its node keeps its further segments as they
are, so there are as many rounds as the longest way that distinct paths of a host share.

What is left is a template a url. A template is rejected when the smoothed share of bad pages among its labelled urls
(smoothed towards the host's, that one towards the whole) reaches ``reject_at``. Explicit rules go first: a rule
``host/path`` fits the host and its subdomains where the url's path starts with the rule's; the longest that fits wins.

Hosts of any size are only counted and joined by (host, node); nothing is gathered. Null urls and urls without ``://``
have empty host and path and are judged like a host of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgauge.llm.common import named, saved

MOST_KINDS = 20
RARE_SHARE = 0.1
MERGE_Z = 2.58
STRENGTH = 20.0
REJECT_AT = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str]


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def first_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits as struct (rule, verdict), else null; of equally long ones the first."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule in reversed(sorted(rules, key=lambda r: -len(r[1]))):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def judge_urls(
    pages: DataFrame,
    labelled: DataFrame,
    rules: list[Rule],
    key: str = "page_id",
    url: str = "url",
    bad: str = "bad",
    most_kinds: int = MOST_KINDS,
    rare_share: float = RARE_SHARE,
    merge_z: float = MERGE_Z,
    strength: float = STRENGTH,
    reject_at: float = REJECT_AT,
) -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict, template, bad_share.

    ``labelled`` has ``url`` and boolean ``bad``: counts of urls that are labelled, and of bad ones. It should hold each
    url at most once; null labels don't count.
    """
    address = F.col("url")
    parts = named(pages, page_id=key, url=url).select("page_id", host_of(address).alias("host"), path_of(address).alias("path"))
    known = (
        named(labelled, url=url, bad=bad)
        .where(F.col("bad").isNotNull())
        .groupBy(host_of(address).alias("host"), path_of(address).alias("path"))
        .agg(F.count("*").alias("judged"), F.sum(F.col("bad").cast("int")).alias("bad"))
    )
    # the tree is built on distinct paths, each with its counts
    paths = (
        parts.groupBy("host", "path")
        .agg(F.count("*").alias("n"))
        .join(known, ["host", "path"], "left")
        .fillna(0, ["judged", "bad"])
        .withColumn("segments", F.split(F.expr("substring(path, 2)"), "/"))
        .withColumn("node", F.lit(""))
    )
    rows, finished = saved(paths, "url-level"), []
    while True:
        # each level reads the last one twice: as a table its plan isn't repeated
        table = saved(_descend(rows, len(finished), most_kinds, rare_share, merge_z), "url-level")
        finished.append(table.where("not more"))
        rows = table.where("more").drop("more")
        if rows.isEmpty():
            break
    done = finished[0]
    for table in finished[1:]:
        done = done.union(table)
    paths = saved(done.select("host", "path", F.col("node").alias("template"), "n", "judged", "bad"), "url-templates")

    whole = paths.agg(F.sum("judged").alias("judged"), F.sum("bad").alias("bad")).first()
    share = (whole["bad"] or 0) / whole["judged"] if whole["judged"] else 0.0
    hosts = paths.groupBy("host").agg(((F.sum("bad") + strength * share) / (F.sum("judged") + strength)).alias("host_share"))
    templates = (
        paths.groupBy("host", "template")
        .agg(F.sum("judged").alias("judged"), F.sum("bad").alias("bad"))
        .join(hosts, "host")
        .select("host", "template", ((F.col("bad") + strength * F.col("host_share")) / (F.col("judged") + strength)).alias("bad_share"))
    )
    shares = paths.select("host", "path", "template").join(templates, ["host", "template"])
    judged = parts.join(shares, ["host", "path"], "left").withColumn("fit", first_rule(F.col("host"), F.col("path"), rules))
    by_method = F.when(F.col("bad_share") >= reject_at, "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", by_method).alias("verdict"), "template", "bad_share"
    )


def _descend(paths: DataFrame, level: int, most_kinds: int, rare_share: float, merge_z: float) -> DataFrame:
    """Extend each path's node by its segment, by a wildcard, or by the merged branch of its parent, and add ``more``:
    whether the path goes on. All paths have a segment at this level."""
    paths = paths.withColumn("segment", F.element_at("segments", level + 1))
    branches = paths.groupBy("host", "node", "segment").agg(
        F.count("*").alias("paths"), F.sum("n").alias("n"), F.sum("judged").alias("judged"), F.sum("bad").alias("bad")
    )
    nodes = branches.groupBy("host", "node").agg(
        F.count("*").alias("kinds"),
        F.sum("paths").alias("all_paths"),
        F.sum("n").alias("pages"),
        F.sum("judged").alias("all_judged"),
        F.sum("bad").alias("all_bad"),
    )
    share = F.col("all_bad") / F.greatest("all_judged", F.lit(1))
    error = F.sqrt(F.greatest(share * (1 - share), F.lit(0.01)) / F.greatest("judged", F.lit(1)))
    variable = (F.col("kinds") > most_kinds) & (F.col("n") <= rare_share * F.col("pages"))
    alike = (F.col("kinds") > 1) & (F.abs(F.col("bad") / F.greatest("judged", F.lit(1)) - share) <= merge_z * error)
    ending = F.regexp_extract("segment", r"(\.[A-Za-z]{1,5})$", 1)
    step = (
        F.when(variable, F.concat(F.lit("*"), ending))
        .when((F.col("judged") > 0) & alike, F.lit("+"))
        .otherwise(F.col("segment"))
    )
    alone = (F.col("all_paths") == 1).alias("alone")
    steps = branches.join(nodes, ["host", "node"]).select("host", "node", "segment", step.alias("step"), alone)
    rest = F.array_join(F.slice("segments", level + 1, F.size("segments")), "/")
    return (
        paths.join(steps, ["host", "node", "segment"])
        .withColumn("node", F.concat("node", F.lit("/"), F.when(F.col("alone"), rest).otherwise(F.col("step"))))
        .withColumn("more", ~F.col("alone") & (F.size("segments") > level + 1))
        .drop("segment", "step", "alone")
    )

"""URL filtering by a path-template tree (DataFrame functions only).

Pages under a host-and-path rule take the rule's verdict and are the labels. For the rest, each host's paths form
a tree of templates: a segment of digits (or long hexadecimal) becomes a wildcard at once, and so does every child of
a branch with many distinct children of few pages each. Sibling templates whose smoothed block rates don't differ by
more than their standard errors are merged. A merged template is rejected when its block rate, smoothed towards its
host's and through it the whole table's, is above one half.

All statistics are counts over distinct (host, template); pages are only read, generalised and joined back.

Defined results: a null url, or one without "://", has empty host and path and is judged like any page of that empty host;
repeated rows count as often as they occur; with no labelled page at all the rate is one half and everything is allowed;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: (host, path prefix, verdict). A rule fits its host and all subdomains; the longest that fits wins.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Levels of the tree after which it is written, to keep plans short.
WRITTEN = 6
#: A branch with over MANY children and under FEW pages a child has variable children.
MANY, FEW = 20, 3
#: Strength, in pages, of a parent's rate; standard errors within which siblings are merged.
STRENGTH, ERRORS = 10, 2


def parse(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule, as host + path, and its verdict; nulls if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def lexical(path: Column) -> Column:
    """Segments without a leading empty one; digits and long hexadecimal become *."""
    text = F.regexp_replace(path, r"(?<=/)(?:[0-9]+|[0-9a-f]{16,})(?=[/.]|$)", "*")
    return F.split(F.regexp_replace(text, "^/", ""), "/", -1)


def templates(paths: DataFrame) -> DataFrame:
    """paths(host, parts, n, n_block, n_allow), distinct -> the same with template, after generalising variable children.

    The tree is as deep as the longest path; paths that end above a level pass it by, and long trees are written every few levels.
    """
    out = paths.withColumn("tree", F.col("parts"))
    for level in range(1, (paths.agg(F.max(F.size("parts"))).first()[0] or 0) + 1):
        if level % WRITTEN == 0:
            out = materialize(out, "url-tree")
        above = F.slice("tree", 1, level - 1)
        branch = out.where(F.size("tree") >= level).groupBy("host", above.alias("above"), F.element_at("tree", level).alias("child")).agg(F.sum("n").alias("pages"))
        variable = branch.groupBy("host", "above").agg(F.count("*").alias("children"), F.sum("pages").alias("pages")).where((F.col("children") > MANY) & (F.col("pages") < FEW * F.col("children"))).select("host", "above", F.lit(True).alias("variable"))
        out = out.withColumn("above", above).join(variable, ["host", "above"], "left")
        wild = F.expr(f"transform(tree, (x, i) -> if(i = {level - 1}, '*', x))")
        out = out.withColumn("tree", F.when(F.col("variable") & (F.size("tree") >= level), wild).otherwise(F.col("tree"))).drop("above", "variable")
    return out.withColumn("template", F.concat(F.lit("/"), F.array_join("tree", "/"))).withColumn("parent", F.concat(F.lit("/"), F.array_join(F.slice("tree", 1, F.size("tree") - 1), "/"))).drop("tree")


def judged(leaves: DataFrame) -> DataFrame:
    """templates' leaves -> (host, template, branch, block_rate): siblings of similar rates share a branch."""
    sums = [F.sum(c).alias(c) for c in ("n_block", "n_allow")]
    tree = leaves.groupBy("host", "parent", "template").agg(*sums)
    hosts = leaves.groupBy("host").agg(F.sum("n_block").alias("h_block"), F.sum("n_allow").alias("h_allow"))
    every = hosts.agg(F.coalesce(F.sum("h_block"), F.lit(0).cast("long")).alias("a_block"), F.coalesce(F.sum("h_allow"), F.lit(0).cast("long")).alias("a_allow"))
    base = (F.col("a_block") + STRENGTH / 2) / (F.col("a_block") + F.col("a_allow") + STRENGTH)
    hosts = hosts.join(F.broadcast(every), F.lit(True)).withColumn("host_rate", (F.col("h_block") + base * STRENGTH) / (F.col("h_block") + F.col("h_allow") + STRENGTH)).select("host", "host_rate")
    weight = F.col("n_block") + F.col("n_allow") + STRENGTH
    tree = tree.join(hosts, "host").withColumn("rate", (F.col("n_block") + F.col("host_rate") * STRENGTH) / weight).withColumn("weight", weight)
    sibling = Window.partitionBy("host", "parent").orderBy("rate", "template")
    gap = F.col("rate") - F.lag("rate").over(sibling)
    error = F.sqrt(F.lit(0.25) / F.col("weight") + F.lit(0.25) / F.lag("weight").over(sibling))
    tree = tree.withColumn("apart", F.coalesce((gap > ERRORS * error).cast("int"), F.lit(0))).withColumn("branch", F.sum("apart").over(sibling.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = tree.groupBy("host", "parent", "branch").agg(*sums, F.first("host_rate").alias("host_rate"))
    merged = merged.withColumn("block_rate", (F.col("n_block") + F.col("host_rate") * STRENGTH) / (F.col("n_block") + F.col("n_allow") + STRENGTH)).select("host", "parent", "branch", "block_rate")
    return tree.join(merged, ["host", "parent", "branch"]).select("host", "template", "branch", "block_rate")


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, block_rate."""
    host, path = parse(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, said = matched_rule(F.col("host"), F.col("path"), rules)
    rows = materialize(rows.select("page_id", "host", "path", rule.alias("rule"), said.alias("said"), lexical(F.col("path")).alias("parts")), "url-rows")
    leaves = rows.groupBy("host", "parts").agg(F.count("*").alias("n"), F.count_if(F.col("said") == "block").alias("n_block"), F.count_if(F.col("said") == "allow").alias("n_allow"))
    leaves = materialize(templates(materialize(leaves, "url-paths")), "url-leaves")
    verdicts = leaves.select("host", "parts", "template").join(judged(leaves), ["host", "template"])
    out = rows.join(verdicts, ["host", "parts"])
    own = F.when(F.col("block_rate") > 0.5, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", own).alias("verdict"), "template", "block_rate")

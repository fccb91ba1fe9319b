"""URL filters: explicit rules first, and for the rest a tree of path templates per host.

Segments that are plainly variable (numbers, hexadecimal, long tails) become placeholders; so does every child of a node
that has very many children of which none is common. Nodes count pages and labels. From the root down, a branch whose
labels do not differ from its parent's by a two-sided test merges with it; one that differs keeps its own purity,
smoothed towards its parent's. Templates whose smoothed share of blocked pages is high are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, saved, table

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
CHILDREN, COMMON = 32, 0.2
#: Weight of the parent's purity, the test's bound, and the purity from which a template is rejected.
PRIOR, BOUND, REJECT = 5.0, 1.96, 0.8


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; null or without ``://``: both empty."""
    whole = F.coalesce(url.cast("string"), F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(whole, pattern, 1), UPPER, LOWER), F.regexp_extract(whole, pattern, 2)


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out


def segments(path: Column) -> Column:
    """The path's segments, variable ones replaced by their kind."""
    all_of = F.filter(F.split(path, "/"), lambda s: s != "")

    def kind(s: Column) -> Column:
        return F.when(s.rlike(r"^[0-9]+(\.[A-Za-z0-9]{1,5})?$"), F.regexp_replace(s, "^[0-9]+", "{n}")).when(s.rlike(r"^[0-9a-fA-F-]{8,}$"), F.lit("{h}")).otherwise(s)

    return F.transform(all_of, kind)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, labels: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of every row.

    ``labels`` (page_id, blocked) trains the tree; without it, pages that a rule decides are its labels. Null urls have
    an empty host; repeated rows each count; an empty table gives no rows. Hosts without labels keep the overall share.
    """
    host, path = parts(F.col("url"))
    # Urls are a small part of a page; the levels below read them from a written table of their own.
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url")).select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.select("*", ruled(F.col("host"), F.col("path"), rules).alias("r")).select("page_id", "host", "path", "r.rule", F.col("r.verdict").alias("ruled"), segments(F.col("path")).alias("seg"))
    if labels is None:
        rows = rows.withColumn("blocked", (F.col("ruled") == "block").cast("int"))
    else:
        rows = rows.join(labels.where("page_id is not null").groupBy(F.col("page_id").alias("l_id")).agg(F.max("blocked").cast("int").alias("blocked")), F.col("page_id") == F.col("l_id"), "left").drop("l_id")
    # One row a host and template from here on, whatever the number of pages; counts are combined before the shuffle.
    tree = saved(rows.groupBy("host", "seg").agg(F.count("*").alias("n"), F.count("blocked").alias("lab"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("blk")))
    share = tree.agg(F.sum("blk").alias("b"), F.sum("lab").alias("l")).first()
    overall = (share["b"] or 0) / share["l"] if share["l"] else 0.0
    tree = tree.withColumn("prefix", F.lit("")).withColumn("purity", F.lit(None).cast("double")).withColumn("template", F.lit(""))
    tree = saved(_settle(tree, 0, overall))
    k = 0
    # Below the deepest label no branch can differ from its parent.
    while tree.where((F.size("seg") > k) & (F.col("lab") > 0)).limit(1).count():
        tree = tree.withColumn("s", F.get("seg", F.lit(k)))
        here = tree.where("s is not null").groupBy("host", "prefix", "s").agg(F.sum("n").alias("c"))
        wide = here.groupBy("host", "prefix").agg(F.count("*").alias("kids"), F.max("c").alias("top"), F.sum("c").alias("all")).where((F.col("kids") > CHILDREN) & (F.col("top") < COMMON * F.col("all"))).select("host", "prefix", F.lit(True).alias("wild"))
        tree = tree.join(wide, ["host", "prefix"], "left")
        step = F.when(F.col("wild"), F.lit("{*}")).otherwise(F.col("s"))
        tree = tree.withColumn("prefix", F.when(F.col("s").isNull(), F.col("prefix")).otherwise(F.concat("prefix", F.lit("/"), step))).drop("wild")
        k += 1
        tree = saved(_settle(tree, k, overall))
    tree = tree.withColumn("template", F.concat("template", F.repeat(F.lit("/{*}"), F.greatest(F.size("seg") - k, F.lit(0)))))
    found = tree.select(F.col("host").alias("t_host"), F.col("seg").alias("t_seg"), "template", "purity")
    out = rows.join(found, (F.col("host") == F.col("t_host")) & (F.col("seg") == F.col("t_seg")))
    verdict = F.coalesce("ruled", F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def _settle(tree: DataFrame, level: int, overall: float) -> DataFrame:
    """Purity and template of each row's node at this level, from its labels and its parent's purity."""
    nodes = tree.groupBy("host", "prefix").agg(F.sum("lab").alias("node_lab"), F.sum("blk").alias("node_blk"))
    both = tree.join(nodes, ["host", "prefix"])
    parent = F.lit(overall) if level == 0 else F.col("purity")
    own = (F.col("node_blk") + PRIOR * parent) / (F.col("node_lab") + PRIOR)
    spread = F.sqrt(F.greatest(parent * (1 - parent), F.lit(1e-4)) / F.greatest(F.col("node_lab"), F.lit(1)))
    differs = (F.col("node_lab") > 0) & (F.abs(F.col("node_blk") / F.greatest(F.col("node_lab"), F.lit(1)) - parent) > BOUND * spread)
    if level == 0:
        return both.withColumn("purity", own).drop("node_lab", "node_blk")
    deeper = F.col("s").isNotNull()
    both = both.withColumn("template", F.when(~deeper, F.col("template")).when(differs, F.col("prefix")).otherwise(F.concat("template", F.lit("/{*}"))))
    return both.withColumn("purity", F.when(deeper & differs, own).otherwise(F.col("purity"))).drop("node_lab", "node_blk", "s")


def op7_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))

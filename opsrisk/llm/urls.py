"""URL filter by a path-template tree.

A path's segments are generalised host by host: a segment value that stands at its place in at least ``SHARE`` of the
host's paths, and ``SUPPORT`` times, stays; any other becomes a wildcard that keeps only a file ending
(``/en/4711.html`` becomes ``/en/*.html``). The generalised paths of a host form a tree. Each node counts the labelled
pages below it and the bad ones among them. A branch whose share of bad pages does not differ from its siblings' (test of
two proportions) is merged with them into its parent; a branch that differs stays for itself. So a template belongs to the
lowest node on its path that differs, or to the root of its host, and its purity is the share of good pages of this
merged branch, smoothed towards its host's, which is smoothed towards that of all pages. Templates of low purity are blocked.

Rules of hosts and paths come first: the longest that fits decides.

All steps are joins and aggregates of DataFrames; their number does not depend on the depth of the tree, as a branch is
compared with its siblings by the counts of their pages alone. Pages are joined by host and by template; both sides but the pages' are
aggregates, and AQE splits a host that fills a partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import saved

# Rules of the contract: verdict and host/path.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

SUPPORT = 5  # pages of a host that hold a segment value that stays
SHARE = 0.02  # and their share of the host's pages that reach this place
Z2 = 6.63  # square of the normal quantile beyond which two shares differ (1 %)
PRIOR = 10.0  # pages that a branch's host weighs in its purity, and all pages in the host's
MIN_PURITY = 0.5

_ENDING = r"(\.[A-Za-z]{1,5})$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty if it is null or has no ``://``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    cut = lambda group: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))
    return F.translate(cut(1), upper, upper.lower()), cut(2)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule (struct of n, rule, verdict) that fits; null if none does. Equal lengths: the rule last in code-point order."""
    fits = []
    for verdict, rule in rules:
        cut = rule.index("/")
        name, start = rule[:cut], rule[cut:]
        here = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        fits.append(F.when(here, F.struct(F.lit(len(rule)).alias("n"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    if not fits:
        return F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    return F.array_max(F.array_compact(F.array(*fits)))


def _segments(path: Column) -> Column:
    return F.split(path, "/", -1)


def _place(i: Column, segment: Column) -> Column:
    return F.concat(i.cast("string"), F.lit("/"), segment)


def constant_segments(paths: DataFrame, support: int = SUPPORT, share: float = SHARE) -> DataFrame:
    """One row for each host with segments that stay: host, constants (array of place/segment).

    ``paths`` has host and path. At most 1 / ``share`` segments stay at a place, so the array is bounded by the depth of the
    host's paths.
    """
    at = paths.select("host", F.posexplode(_segments(F.col("path"))).alias("i", "segment"))
    values = at.groupBy("host", "i", "segment").agg(F.count(F.lit(1)).alias("n"))
    reach = at.groupBy("host", "i").agg(F.count(F.lit(1)).alias("total"))
    stay = values.where((F.col("n") >= support) & (F.col("segment") != "")).join(reach, ["host", "i"]).where(F.col("n") >= F.col("total") * F.lit(share))
    return stay.groupBy("host").agg(F.collect_list(_place(F.col("i"), F.col("segment"))).alias("constants"))


def template_of(path: Column, constants: Column) -> Column:
    """The path with wildcards for its variable segments."""

    def general(segment: Column, i: Column) -> Column:
        stays = (segment == "") | F.coalesce(F.array_contains(constants, _place(i, segment)), F.lit(False))
        return F.when(stays, segment).otherwise(F.concat(F.lit("*"), F.regexp_extract(segment, _ENDING, 1)))

    return F.array_join(F.transform(_segments(path), general), "/")


def labelled_templates(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host, template, n (labelled pages), bad: counts of each template of a host.

    ``pages`` has page_id, host, template; ``labels`` has page_id and bad (boolean). A page with several labels is bad if one is.
    """
    one = labels.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    joined = pages.join(one, "page_id", "left")
    return joined.groupBy("host", "template").agg(F.count("bad").alias("n"), F.count_if(F.col("bad")).alias("bad"))


def merged_branches(templates: DataFrame, z2: float = Z2) -> DataFrame:
    """host, template, branch, n, bad: the merged branch that every template belongs to, with the branch's labelled counts.

    The branch is the prefix of the template at its lowest node that differs from its siblings; empty: the root of the host.
    """
    segments = F.split("template", "/", -1)
    depth = F.posexplode(F.sequence(F.lit(0), F.size(segments)))
    node = lambda k: F.array_join(F.slice(segments, 1, k), "/")
    below = templates.select("host", "template", "n", "bad", segments.alias("s"), depth.alias("_", "k")).drop("_")
    # a node is its depth and prefix: the prefix '' is the root (depth 0) and the first, empty segment (depth 1)
    segments = F.col("s")
    below = below.select("host", "template", "n", "bad", "k", node(F.col("k")).alias("node"), F.when(F.col("k") > 0, node(F.col("k") - 1)).alias("above"))
    nodes = below.groupBy("host", "k", "node").agg(F.min("above").alias("above"), F.sum("n").alias("n1"), F.sum("bad").alias("b1"))
    parents = nodes.select("host", (F.col("k") + 1).alias("k"), F.col("node").alias("above"), F.col("n1").alias("all_n"), F.col("b1").alias("all_b"))
    n1, b1 = F.col("n1").cast("double"), F.col("b1").cast("double")
    n, b = F.col("all_n").cast("double"), F.col("all_b").cast("double")
    n2, b2 = n - n1, b - b1
    gap = b1 * n2 - b2 * n1
    differs = (n1 > 0) & (n2 > 0) & (gap * gap * n > F.lit(z2) * b * (n - b) * n1 * n2)
    edges = nodes.join(parents, ["host", "k", "above"]).where(differs).select("host", "k", "node")
    lowest = below.join(edges, ["host", "k", "node"]).groupBy("host", "template").agg(F.max(F.struct("k", "node")).alias("m"))
    placed = templates.join(lowest, ["host", "template"], "left").select("host", "template", "n", "bad", F.coalesce("m.k", F.lit(0)).alias("k"), F.coalesce("m.node", F.lit("")).alias("branch"))
    pooled = placed.groupBy("host", "k", "branch").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    return placed.drop("n", "bad").join(pooled, ["host", "k", "branch"]).select("host", "template", "branch", "n", "bad")


def purity(branches: DataFrame, all_n: int, all_bad: int, prior: float = PRIOR) -> DataFrame:
    """Adds purity: the smoothed share of good pages of each template's merged branch. ``all_n``, ``all_bad``: counts of all pages."""
    host = branches.select("host", "branch", "n", "bad").distinct().groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("bad").alias("host_bad"))
    good = lambda n, b: (F.col(n) - F.col(b)).cast("double")
    overall = (all_n - all_bad) / all_n if all_n else 1.0
    host = host.select("host", ((good("host_n", "host_bad") + F.lit(prior * overall)) / (F.col("host_n") + F.lit(prior))).alias("host_purity"))
    smoothed = (good("n", "bad") + F.lit(prior) * F.col("host_purity")) / (F.col("n") + F.lit(prior))
    return branches.join(host, "host").select(*branches.columns, smoothed.alias("purity"))


def url_filter(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    support: int = SUPPORT,
    share: float = SHARE,
    z2: float = Z2,
    prior: float = PRIOR,
    min_purity: float = MIN_PURITY,
) -> DataFrame:
    """Judge every URL.

    ``pages`` has page_id and url, ``labels`` page_id and bad (boolean); ``rules`` are (verdict, host/path), a short list of
    the caller's. Returns one row for each row of ``pages``: page_id, host, path, rule (null if none fits), verdict (allow or
    block), template, branch, n_labelled, n_bad (of the branch), purity.

    A null or empty url, or one without ``://``, has an empty host, path and template, and is judged with all others of this
    kind. A null page_id has no label. Repeated rows count as often as they stand and get equal verdicts. Without
    labels nothing but the rules blocks. A purity equal to ``min_purity`` is allowed. An empty table gives no rows. Other
    columns, whatever their names, are not read.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    base = saved(pages.select(F.col("page_id").alias("page_id"), host.alias("host"), path.alias("path")), "url-paths")
    # hosts and templates are never null, so plain joins lose no row
    constants = constant_segments(base, support, share)
    found = base.join(constants, "host", "left").select("page_id", "host", "path", template_of(F.col("path"), F.col("constants")).alias("template"))
    found = saved(found, "url-templates")
    counts = saved(labelled_templates(found, labels), "url-counts")
    total = counts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    judged = purity(merged_branches(counts, z2), total["n"] or 0, total["bad"] or 0, prior)
    rule = rule_for(F.col("host"), F.col("path"), rules)
    out = found.join(judged, ["host", "template"]).withColumn("_rule", rule)
    own = F.when(F.col("purity") < F.lit(min_purity), "block").otherwise("allow")
    return out.select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", own).alias("verdict"),
        "template", "branch", F.col("n").alias("n_labelled"), F.col("bad").alias("n_bad"), "purity",
    )


def page_labels(labels: DataFrame) -> DataFrame:
    """page_id and bad of the table labels: a page of low quality or toxic content is bad; rows without both labels say nothing."""
    return labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))

"""URL filters: rules first, then a tree of path templates for each host.

A rule (host, path, verdict) fits its host and all subdomains if the path starts
with the rule's; of several the longest wins. What rules decide labels the pages
from which templates are judged:

1. Paths become shapes: numbers, long hexadecimal strings and dates in a segment
   are written as their kind. Pages are counted by host and shape; everything
   below works on these counts.
2. Level by level a segment's branches are generalised. By a two-sided test at
   ``SIGMAS`` standard errors a branch's share of blocked labels is like that of
   all its siblings (or has too few labels to tell), above it, or below it;
   branches on the same side are merged into one wildcard (``*``, ``*+``, ``*-``)
   unless they differ from that side's share in turn. A branch with less than
   ``SHARE`` of its parent's pages is variable and always merged. Segments below
   ``DEPTH`` become one ``**``.
3. A template's purity is its share of blocked labels, smoothed towards that of
   the template above it, that towards the one above, up to the host and to all
   hosts, with ``PRIOR`` imagined labels each time. Above ``LIMIT`` it is blocked.

Defined results: a null url or one without ``://`` has an empty host and path (and
is judged like any host); equal urls get equal verdicts, of equally long rules the
one that sorts first wins; repeated rows repeat; without labels the purity is one
half and nothing is blocked; an empty table gives no rows. Counts are summed before
they are shuffled and lookups have one row for each key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdlens.session import materialize

DEPTH = 4
SHARE = 0.05
SIGMAS = 2.0
LABELS = 5
PRIOR = 4.0
LIMIT = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, in lower case, and path of a url; both empty if there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruling(host: Column, path: Column, rules: list) -> Column:
    """The longest rule that fits as (rule, verdict), or null."""
    fitting = []
    for rule_host, rule_path, verdict in rules:
        name = rule_host + rule_path
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        order = F.struct(F.lit(-len(name)).alias("length"), F.lit(name).alias("rule"), F.lit(verdict).alias("verdict"))
        fitting.append(F.when(fits, order))
    return F.array_min(F.array_compact(F.array(*fitting))) if fitting else F.lit(None)


def shape(path: Column) -> Column:
    """The segments of a path, numbers and the like as their kind."""

    def kind(s):
        kinds = F.regexp_replace(s, r"^[0-9]{4}-[0-9]{2}-[0-9]{2}", "<date>")
        kinds = F.regexp_replace(kinds, r"^(?=[0-9a-fA-F-]*[0-9])[0-9a-fA-F][0-9a-fA-F-]{7,}(?=$|\.)", "<hex>")
        return F.regexp_replace(F.replace(kinds, F.lit("*"), F.lit("%2A")), r"(?<![A-Za-z0-9])[0-9]+", "<n>")

    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), kind)


def _beside(branches: DataFrame, keys: list) -> DataFrame:
    """Branches with the sums of all that agree in ``keys``."""
    sums = [F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "blocked")]
    return branches.join(materialize(branches.groupBy(*keys).agg(*sums), "url-sums"), keys)


def _apart() -> Column:
    """1 or -1 if a branch's share of blocked labels is above or below that of all, beyond chance; else 0."""
    share = F.col("all_blocked") / F.greatest(F.col("all_labelled"), F.lit(1))
    error = F.sqrt(share * (1 - share) / F.greatest(F.col("labelled"), F.lit(1)))
    gap = F.col("blocked") / F.greatest(F.col("labelled"), F.lit(1)) - share
    return F.when(gap > SIGMAS * error, 1).when(gap < -SIGMAS * error, -1).otherwise(0)


def templates(shapes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``shapes`` (host, shape, n, labelled, blocked) with the ``template`` of each."""
    rows = shapes.withColumn("template", F.lit(""))
    for level in range(depth):
        rows = rows.withColumn("branch", F.get("shape", F.lit(level)))
        sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
        branches = rows.where("branch IS NOT NULL").groupBy("host", "template", "branch").agg(*sums)
        branches = materialize(branches, "url-branches")
        side = F.when(F.col("labelled") < LABELS, "").when(_apart() > 0, "+").when(_apart() < 0, "-").otherwise("")
        sided = _beside(branches, ["host", "template"]).select(
            *branches.columns, side.alias("side"), (F.col("n") < SHARE * F.col("all_n")).alias("rare")
        )
        sided = materialize(sided, "url-sides")
        other = (F.col("labelled") >= LABELS) & (_apart() != 0)
        named = F.col("branch").contains("<") | (other & ~F.col("rare"))
        node = F.when(named, F.col("branch")).otherwise(F.concat(F.lit("*"), "side"))
        decided = _beside(sided, ["host", "template", "side"]).select("host", "template", "branch", node.alias("node"))
        rows = rows.join(materialize(decided, "url-nodes"), ["host", "template", "branch"], "left").withColumn(
            "template", F.concat("template", F.coalesce(F.concat(F.lit("/"), "node"), F.lit("")))
        ).drop("node", "branch")
        rows = materialize(rows, "url-shapes")
    deeper = F.when(F.size("shape") > depth, "/**").otherwise("")
    return rows.withColumn("template", F.concat("template", deeper))


def with_purity(rows: DataFrame, depth: int = DEPTH, prior: float = PRIOR) -> DataFrame:
    """Templates with ``purity``, the smoothed share of blocked labels."""
    blocked, labelled = rows.agg(F.sum("blocked"), F.sum("labelled")).first()
    start = ((blocked or 0) + 0.5 * prior) / ((labelled or 0) + prior)
    rows = rows.withColumn("purity", F.lit(start)).withColumn("nodes", F.split("template", "/"))
    for level in range(depth + 2):
        # The host itself, then ever longer beginnings of the template.
        rows = rows.withColumn("above", F.array_join(F.slice("nodes", 1, level + 1), "/"))
        sums = rows.groupBy("host", "above").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l"))
        rows = rows.join(materialize(sums, "url-purity"), ["host", "above"])
        longer = F.size("nodes") > level
        smoothed = (F.col("b") + prior * F.col("purity")) / (F.col("l") + prior)
        rows = rows.withColumn("purity", F.when(longer, smoothed).otherwise(F.col("purity"))).drop("b", "l", "above")
    return rows.drop("nodes")


def judged(pages: DataFrame, rules: list, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict, template, purity)`` of every page."""
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    found = rows.withColumn("found", ruling(F.col("host"), F.col("path"), rules)).select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("ruled"), shape(F.col("path")).alias("shape")
    )
    blocked = F.coalesce((F.col("ruled") == "block").cast("int"), F.lit(0))
    shapes = found.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.count("ruled").alias("labelled"), F.sum(blocked).alias("blocked")
    )
    tree = materialize(with_purity(templates(materialize(shapes, "url-shapes"))), "url-templates")
    shown = found.join(tree.select("host", "shape", "template", "purity").hint("merge"), ["host", "shape"])
    method = F.when(F.col("purity") > LIMIT, "block").otherwise("allow")
    return shown.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "template", "purity"
    )

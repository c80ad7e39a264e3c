"""URL verdicts by rules and, where no rule fits, by a tree of path templates per host; DataFrame operations only.

Paths are first reduced to shapes (numbers, hexadecimal keys and UUIDs become placeholders) and counted per host, so
that a host with a third of all pages is a few rows from there on. Going down the tree, siblings whose share of bad labels
can't be told from their parent's share (two-sided z test) are merged: literal ones, and any rare ones of a node with many
children. Its other rare ones are merged where their share can't be told from that of their median label; what differs from
both keeps its name. Below ``DEEP`` levels only branches with both kinds of labels are followed. A template is rejected when its purity, the share of good labels smoothed
towards its host's and that towards the share of all, is under ``PURITY``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationlens.llm.common import Scratch

#: From this level on a branch whose labels are all alike, or that is a single path, ends in one wildcard.
DEEP = 6
#: A node with more children may merge placeholders with less than this share of its pages, and such children among themselves.
MANY_CHILDREN, RARE_SHARE = 12, 0.05
#: Below this z, siblings are alike.
SIMILAR_Z = 1.96
#: Labels that the smoothing counts for.
PRIOR_LABELS = 4.0
PURITY = 0.5
#: A shape with more than 1 in so many of all pages, and more than ``LARGE_ROWS``, is met by broadcast.
LARGE_SHAPES, LARGE_ROWS = 10_000, 200

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; path: then up to ``? #`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest of the rules (verdict, ``host/path``) that fits as struct(rule, verdict), or null.

    A rule fits its host and all subdomains where the path starts with the rule's; of equally long ones the first by text.
    """
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule in sorted(rules, key=lambda x: (len(x[1]), [-ord(c) for c in x[1]])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def shaped_segments(path: Column) -> Column:
    """The path's segments with variable parts as placeholders."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(
        segments,
        lambda s: F.when(s.rlike("^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"), "{uuid}")
        .when(s.rlike("^(?=.*[0-9])[0-9a-fA-F]{12,}$"), "{hex}")
        .when(s.rlike("[0-9]"), F.regexp_replace(s, "[0-9]+", "{num}"))
        .otherwise(s),
    )


def _ended(tree: DataFrame, d: int) -> DataFrame:
    """Branches that go on below level ``d`` though their labels are all alike, or as a single path, end in one segment."""
    below = tree.filter(F.size("segments") > d)
    nodes = below.groupBy("host", "template").agg(F.count("*").alias("_paths"), F.sum("labelled").alias("_labelled"), F.sum("bad").alias("_bad"))
    mixed = (F.col("_paths") > 1) & (F.col("_bad") > 0) & (F.col("_bad") < F.col("_labelled"))
    ends = (F.size("segments") > d) & ~F.coalesce("_mixed", F.lit(False))
    marked = tree.join(nodes.filter(mixed).select("host", "template", F.lit(True).alias("_mixed")), ["host", "template"], "left").withColumn("_ends", ends)
    return marked.withColumn("template", F.when(F.col("_ends"), F.concat("template", F.lit("/{rest}"))).otherwise(F.col("template"))).withColumn("segments", F.when(F.col("_ends"), F.slice("segments", 1, d)).otherwise(F.col("segments"))).drop("_mixed", "_ends")


def path_templates(shapes: DataFrame) -> DataFrame:
    """(host, shape, segments, n, labelled, bad) -> the same with ``template``: the shape's place in its host's tree."""
    scratch = Scratch(shapes.sparkSession)
    deepest = shapes.agg(F.max(F.size("segments"))).first()[0] or 0
    tree = shapes.withColumn("template", F.lit(""))
    for d in range(deepest):
        tree = scratch.keep(_ended(tree, d) if d >= DEEP else tree, f"level-{d}")  # each level reads it several times
        scratch.drop(f"level-{d - 1}")
        if d >= DEEP and not tree.filter(F.size("segments") > d).limit(1).count():
            break
        tree = tree.withColumn("seg", F.get("segments", F.lit(d)))
        children = tree.filter("seg IS NOT NULL").groupBy("host", "template", "seg").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "bad")))
        parents = children.groupBy("host", "template").agg(F.count("*").alias("kids"), F.sum("n").alias("all_n"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
        both = children.join(parents, ["host", "template"])
        many = F.greatest("labelled", F.lit(1))
        near = lambda p: (F.col("labelled") == 0) | (F.abs(F.col("bad") / many - p) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-4)) / many) < SIMILAR_Z)
        rare = (F.col("kids") > MANY_CHILDREN) & (F.col("n") < RARE_SHARE * F.col("all_n"))
        alike = (F.col("kids") > 1) & near(F.col("all_bad") / F.greatest("all_labelled", F.lit(1))) & (rare | ~F.col("seg").contains("{"))
        both = both.withColumn("rare", rare & ~alike).withColumn("alike", alike)
        # the share that half of the labels of the rare ones lie under, in thousandths, so that a node's state is of fixed size
        middle = both.filter("rare").groupBy("host", "template").agg(F.expr("percentile(round(bad / labelled, 3), 0.5, labelled)").alias("middle"))
        both = both.join(middle, ["host", "template"], "left")
        step = both.select("host", "template", "seg", F.when(F.col("alike"), "*").when(F.col("rare") & near(F.col("middle")), "{rare}").otherwise(F.col("seg")).alias("to"))
        tree = tree.join(step, ["host", "template", "seg"], "left")
        tree = tree.withColumn("template", F.when(F.col("to").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "to"))).drop("to", "seg")
    return tree


def judge_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule, verdict, template, purity.

    ``labels``: (page_id, bad 0/1); a page with several counts as bad if one says so, null or missing ones don't count. A null
    url, or one without ``://``, has an empty host and path. Repeated rows and null ids give a row each. Other columns are
    ignored, an empty table gives no rows. Without labels every template's purity is 1. The verdicts of shapes that very many pages
    have are broadcast (there are few), so that no task gets all pages of one.
    """
    scratch = Scratch(pages.sparkSession)
    labels = labels.groupBy("page_id").agg(F.max(F.col("bad").cast("long")).alias("bad"))
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("segments", shaped_segments(F.col("path"))).withColumn("shape", F.array_join("segments", "/"))
    marked = rows.join(labels, "page_id", "left")
    shapes = scratch.keep(marked.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad")).withColumn("segments", F.filter(F.split("shape", "/"), lambda s: s != "")), "shapes")
    tree = scratch.keep(path_templates(shapes).select("host", "shape", "template", "n", "labelled", "bad"), "tree")

    m = F.lit(PRIOR_LABELS)
    totals = tree.agg((F.sum("bad") / F.greatest(F.sum("labelled"), F.lit(1))).alias("p"))
    overall = F.coalesce(totals.scalar(), F.lit(0.0))
    hosts = tree.groupBy("host").agg(((F.sum("bad") + m * overall) / (F.sum("labelled") + m)).alias("host_p"))
    found = tree.groupBy("host", "template").agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled")).join(hosts, "host")
    found = found.select("host", "template", (1 - (F.col("bad") + m * F.col("host_p")) / (F.col("labelled") + m)).alias("purity"))
    judged = scratch.keep(tree.select("host", "shape", "template", "n").join(found, ["host", "template"]), "judged")
    large = F.col("n") > max(LARGE_ROWS, (judged.agg(F.sum("n")).first()[0] or 0) // LARGE_SHAPES)
    hot, cold = F.broadcast(judged.filter(large).drop("n")), judged.filter(~large).drop("n")
    bare, key = rows.drop("segments"), ["host", "shape"]
    met = bare.join(hot, key).unionByName(bare.join(hot, key, "left_anti").join(cold, key))

    rule = matching_rule(F.col("host"), F.col("path"), rules)
    return (
        met.withColumn("_rule", rule)
        .select(
            "page_id", "host", "path", F.col("_rule.rule").alias("rule"),
            F.coalesce("_rule.verdict", F.when(F.col("purity") < PURITY, "block").otherwise("allow")).alias("verdict"),
            "template", F.round("purity", 6).alias("purity"),
        )
    )

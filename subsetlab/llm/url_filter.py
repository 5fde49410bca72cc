"""URL filters: host and path rules, and for the rest a tree of path templates per host.

Each host's paths form a tree of segments. Segments that are numbers, hexadecimal ids or dates by their look are
wildcards from the start. From the root down, a level at a time, until no path has a segment left:

1. A child is kept apart if the labels of its pages tell it from the rest of its node: m KL(b / m, p) > ln(2 c / LEVEL), with
   b of its m labelled pages bad, a share p (smoothed) of the rest, and c children. By Chernoff's bound, a child like the
   rest is kept with a chance of LEVEL in all of a node.
2. Children that are kept and show the same share of bad pages (a two-proportion test doesn't tell them apart) are merged.
3. All others can't be told from each other, and are one branch. It is a wildcard if the segment varies: if the chance
   that a page brings a new segment (by Good and Turing, the share of pages whose segment no other page has) is
   ``VARIES`` or more, by Wilson's lower bound.
4. What the paths of a branch that is one child have in common is taken in the same step, so that steps only count
   places where paths part.

What is left are templates. One is rejected if its smoothed share of bad pages, which pulls few labels towards the
share of all pages, is at least ``PURITY``.

Pages are counted by distinct path before anything else, so a busy host costs no more than its distinct paths. Children
are merged by their counts (labelled, bad), of which L labels give no more than about L to the power of 2 / 3.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subsetlab.llm.shared import cut, cut_table, spread_join

#: Chance that some child of a node is kept apart although it is like the rest.
LEVEL = 0.05
#: Least chance of a new segment at which segments vary.
VARIES = 0.1
#: Two-proportion z below which branches count as alike; also that of Wilson's bound.
ALIKE = 1.96
PURITY, PRIOR_PAGES = 0.8, 10.0
#: Segments that vary by their look, and what stands for them.
LOOKS = (
    (r"^[0-9]+$", "{number}"),
    (r"^[0-9]+\.[a-z]{1,5}$", "{number}.{ext}"),
    (r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$", "{date}"),
    (r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", "{uuid}"),
    (r"^(?=.*[0-9])[0-9a-f]{8,}$", "{hex}"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Split at the first ``://``: host (A-Z lower-cased) up to ``/``, ``?``, ``#`` or the end, path up to ``?`` or ``#``.

    Without ``://``, or for null, both are empty.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """Return the longest rule that fits, and its verdict (null if none does).

    A rule is ``host/path``: it fits its host and all subdomains if the path starts with the rule's.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules.items(), key=lambda x: (len(x[0]), x[0])):
        own, slash, tail = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def look(segment: Column) -> Column:
    out = segment
    for pattern, name in reversed(LOOKS):
        out = F.when(segment.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def path_segments(path: Column) -> Column:
    """Return all segments, generalised by their look; a final slash counts for nothing."""
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), look)


def _kept(c: Column, labelled: Column, bad: Column, all_labelled: Column, all_bad: Column) -> Column:
    """Tell whether a child's labels differ from those of the rest of its node."""
    share = bad / F.greatest(labelled, F.lit(1))
    rest = (all_bad - bad + 0.5) / (all_labelled - labelled + 1)
    part = lambda x, p: F.when(x > 0, x * F.log(F.when(x > 0, x / p).otherwise(F.lit(1.0)))).otherwise(F.lit(0.0))
    far = labelled * (part(share, rest) + part(1 - share, 1 - rest))
    return (labelled > 0) & (all_labelled > labelled) & (far > F.log(2 * c / LEVEL))


def _varies(single: Column, pages: Column) -> Column:
    share, z = single / pages, ALIKE * ALIKE
    low = (share + z / (2 * pages) - ALIKE * F.sqrt(share * (1 - share) / pages + z / (4 * pages * pages))) / (1 + z / pages)
    return low >= VARIES


def _name(first: Column, members: Column) -> Column:
    """Name a branch by its least segment and how many more it has."""
    return F.when(members == 1, first).otherwise(F.concat(F.lit("{"), first, F.lit("|+"), (members - 1).cast("string"), F.lit("}")))


def _merge(bins: pd.DataFrame) -> pd.DataFrame:
    """Merge alike children of one node, given as (host, prefix, labelled, bad, n, first): n children with these counts.

    Add to each bin its branch's least segment and number of children (top, members).
    """
    rows = bins.assign(rate=(bins["bad"] + 0.5) / (bins["labelled"] + 1)).sort_values(["rate", "labelled", "first"]).reset_index(drop=True)
    number, labelled, bad = [], 0, 0
    for r in rows.itertuples():
        n, m = labelled, r.labelled * r.n
        p = (bad + r.bad * r.n) / (n + m)
        z = abs(bad / n - r.bad / r.labelled) / max((p * (1 - p) * (1 / n + 1 / m)) ** 0.5, 1e-12) if n and 0 < p < 1 else 0.0
        alike = bool(number) and z < ALIKE
        number.append(number[-1] + (not alike) if number else 0)
        labelled, bad = (labelled if alike else 0) + m, (bad if alike else 0) + r.bad * r.n
    own = rows.groupby(pd.Series(number, dtype="int64"))
    rows["top"], rows["members"] = own["first"].transform("min"), own["n"].transform("sum")
    return rows[["host", "prefix", "labelled", "bad", "top", "members"]]


def _step(live: DataFrame) -> DataFrame:
    """Take ``live`` (host, segments, pages, labelled, bad, prefix, at: how many segments the prefix stands for) a level down."""
    node, counts = ["host", "prefix"], ["labelled", "bad"]
    rest = F.slice("segments", F.col("at") + 2, F.size("segments"))
    live = live.withColumn("segment", F.get("segments", F.col("at")))
    sums = [F.sum(c).alias(c) for c in ("pages", *counts)]
    children = cut(live.groupBy(*node, "segment").agg(*sums, F.count(F.lit(1)).alias("n"), F.min(rest).alias("low"), F.max(rest).alias("high")))
    nodes = children.groupBy(*node).agg(
        F.count(F.lit(1)).alias("c"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"),
        _varies(F.count_if(F.col("pages") == 1), F.sum("pages")).alias("varies"),
    )
    nodes = cut(nodes)
    kept = _kept(*[F.col(c) for c in ("c", "labelled", "bad", "all_labelled", "all_bad")])
    children = cut(spread_join(children, nodes, node, nodes.withColumnRenamed("c", "n")).withColumn("kept", kept))
    marks = {c: F.when(F.col("kept"), F.col(c)).otherwise(F.lit(-1).cast("long")).alias(c) for c in counts}
    bins = cut(children.groupBy(*node, *[marks[c] for c in counts]).agg(F.count(F.lit(1)).alias("n"), F.min("segment").alias("first"), F.bool_or("varies").alias("varies")))
    merged = bins.where("labelled >= 0").groupBy(*node).applyInPandas(_merge, "host string, prefix string, labelled long, bad long, top string, members long")
    merged = merged.select(*node, *counts, _name(F.col("top"), F.col("members")).alias("name"), "members")
    others = bins.where("labelled < 0")
    name = F.when(F.col("varies"), F.lit("*")).otherwise(_name(F.col("first"), F.col("n")))
    named = merged.unionByName(others.select(*node, *counts, name.alias("name"), F.col("n").alias("members")))
    steps = children.select(*node, "segment", *[marks[c] for c in counts], "low", "high")
    steps = spread_join(steps, named, [*node, *counts], bins, F.xxhash64("segment"))
    # Arrays that lie between the least and the greatest one begin with what these two have in common.
    parts = F.zip_with("low", "high", lambda x, y: F.coalesce(x == y, F.lit(False)))
    common = F.array_position(F.concat(parts, F.array(F.lit(False))), F.lit(False)).cast("int") - 1
    steps = steps.withColumn("common", F.when(F.col("members") == 1, common).otherwise(0))
    step = F.concat_ws("/", "prefix", "name", F.slice("low", F.lit(1), F.col("common")))
    steps = steps.select(*node, "segment", step.alias("next"), "common")
    live = spread_join(live, steps, [*node, "segment"], children.select(*node, "segment", "n"), F.xxhash64("segments"))
    return live.select("host", "segments", "pages", *counts, F.col("next").alias("prefix"), (F.col("at") + 1 + F.col("common")).alias("at"))


def templates(paths: DataFrame) -> DataFrame:
    """Return ``paths`` (host, segments, pages, labelled, bad; host and segments each pair once) with their template."""
    live = paths.select("host", "segments", "pages", "labelled", "bad", F.lit("").alias("prefix"), F.lit(0).alias("at"))
    done = live.where(F.size("segments") == 0)
    live = live.where(F.size("segments") > 0)
    while not live.isEmpty():
        # A checkpoint would keep what the plan knows of its columns, which grows from level to level.
        now = cut_table(_step(live), "paths")
        done = done.unionByName(now.where(F.size("segments") == F.col("at")))
        live = now.where(F.size("segments") > F.col("at"))
    return done.withColumnRenamed("prefix", "template").drop("at")


def judge(pages: DataFrame, labels: DataFrame, rules: dict[str, str], purity: float = PURITY) -> DataFrame:
    """Return page_id, host, path, rule, verdict, template and share (the smoothed share of bad pages) of every page.

    ``pages`` has page_id and url, ``labels`` has page_id and bad (boolean; a page with several labels counts each, null
    ones not at all). Null urls have an empty host and path, and are one template. Null page_ids have no labels;
    repeated rows stay. Without labels nothing is rejected but by rules. Further columns are left out. Paths of any depth
    are taken whole. An empty table of pages gives no rows.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    parsed = parsed.withColumn("segments", path_segments(F.col("path")))
    one = labels.where(F.col("bad").isNotNull()).groupBy(F.col("page_id").cast("long").alias("page_id"))
    one = one.agg(F.count(F.lit(1)).alias("labelled"), F.sum(F.col("bad").cast("long")).alias("bad"))
    zero = F.lit(0).cast("long")
    paths = parsed.join(one, "page_id", "left").groupBy("host", "segments").agg(
        F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum("labelled"), zero).alias("labelled"), F.coalesce(F.sum("bad"), zero).alias("bad")
    )
    paths = cut(paths)
    total = paths.agg(F.sum("labelled").alias("n"), F.sum("bad").alias("bad")).first()
    prior = (total["bad"] or 0) / total["n"] if total["n"] else 0.0
    made = cut(templates(paths))
    counts = made.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    share = (F.col("bad") + F.lit(prior * PRIOR_PAGES)) / (F.col("labelled") + F.lit(PRIOR_PAGES))
    known = made.select("host", "segments", "template").join(counts.select("host", "template", share.alias("share")), ["host", "template"])
    rule, by_rule = rule_of(F.col("host"), F.col("path"), rules)
    out = spread_join(parsed, known, ["host", "segments"], paths.select("host", "segments", F.col("pages").alias("n")), F.xxhash64("page_id", "path"))
    own = F.when(F.col("share") >= purity, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(by_rule, own).alias("verdict"), "template", "share")

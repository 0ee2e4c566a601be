"""URL filters: rules first, then a path-template tree judged by smoothed purity.

The tree of a host has a level for each path segment. A segment becomes a
wildcard if it looks like a value (digits, dates, hex) or is one of many rare
children of its parent. Sibling branches, which differ in their last literal
segment alone, are merged where their shares of blocked pages are statistically
the same. A template is rejected when its share of labelled pages that are
blocked, smoothed towards the share of its host, reaches a threshold; the host's
share is smoothed in turn, by some pages of which half are blocked. So a host's
own evidence decides, whatever else the table holds. A template without labelled pages is judged by its
nearest ancestor that has some, in which every labelled template counts as one
observation, blocked or allowed by its majority: pages of one branch resemble
each other, so a branch says little about its siblings and many of them say
much. Rules label the pages they fit; the caller may give more labels.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import lower_ascii, small, spare, written

#: A parent with more children than this makes those with less than RARE of its pages a wildcard.
CHILDREN = 16
RARE = 0.05
#: What smoothing adds to a branch: so many pages, blocked by the share of its host; and to a host: as many, of which this share is blocked.
PRIOR, BASE = 4.0, 0.5
REJECT = 0.8
#: Standard errors within which two shares are the same.
SAME = 1.96
#: A template's last literal segment, and the wildcards after it.
SIBLINGS = r"/[^/*][^/]*((?:/\*)*)$"
VALUE = r"^(?:\d[\d_.,-]*|[0-9a-fA-F]{8,}|[0-9a-fA-F-]{32,})(?:\.[A-Za-z0-9]{1,5})?$"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """Lower-cased host after the first ``://``; empty without one."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits; null if none does."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | F.endswith(host, F.lit(f".{rule.host}"))) & F.startswith(path, F.lit(rule.path))
        name, verdict = F.when(fits, rule.text).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def prefixes(parts: Column) -> Column:
    """Hashes of the first 0, 1, ... segments of an array, as many as it has: the nodes that a path passes."""
    start = F.struct(F.xxhash64(F.lit("/")).alias("h"), F.array().cast("array<bigint>").alias("all"))
    step = lambda acc, x: F.struct(F.xxhash64(acc["h"], x).alias("h"), F.concat(acc["all"], F.array(acc["h"])).alias("all"))
    return F.aggregate(parts, start, step, lambda acc: acc["all"])


def templates(paths: DataFrame) -> DataFrame:
    """(host, path, pages, known, blocked) with the path's template.

    Segments that look like values are wildcards from the start. The nodes of
    all levels are then counted at once, and rare children of parents with many
    become wildcards, in each host at its topmost level that has some: what they
    merge below is counted in the next round. So there are as many rounds as
    levels with rare children, one more, and not as many as the deepest path
    has segments.
    """
    segs = F.filter(F.split("path", "/"), lambda s: s != "")
    found = paths.withColumn("segs", segs).withColumn("parts", F.transform("segs", lambda s: F.when(s.rlike(VALUE), "*").otherwise(s)))
    found = written(found, "segments")
    while True:
        steps = F.transform(prefixes(F.col("parts")), lambda h, i: F.struct(h.alias("node"), i.alias("level"), F.get("segs", i).alias("seg"), F.get("parts", i).alias("part")))
        child = found.select("host", "pages", F.inline(steps)).groupBy("host", "level", "node", "seg", "part").agg(F.sum("pages").alias("own"))
        child = written(child, "children")
        parent = child.groupBy("host", "node").agg(F.count(F.lit(1)).alias("children"), F.sum("own").alias("all")).where(F.col("children") > CHILDREN)
        rare = child.where("part <> '*'").join(parent, ["host", "node"]).where(F.col("own") < RARE * F.col("all")).select("host", "level", "node", "seg")
        top = rare.groupBy("host").agg(F.min("level").alias("level"))
        rare = written(rare.join(top, ["host", "level"]), "rare")
        if rare.isEmpty():
            break
        # A path passes one node of that level: it is hit or not.
        at = found.join(small(top), "host", "left").withColumn("node", F.get(prefixes(F.col("parts")), F.col("level"))).withColumn("seg", F.get("segs", F.col("level")))
        hit = at.join(small(rare.withColumn("hit", F.lit(True))), ["host", "level", "node", "seg"], "left")
        parts = F.when(F.col("hit"), F.transform("parts", lambda p, i: F.when(i == F.col("level"), "*").otherwise(p))).otherwise(F.col("parts"))
        found = written(hit.withColumn("parts", parts).select(found.columns), "segments")
    return found.withColumn("template", F.when(F.size("parts") > 0, F.concat(F.lit("/"), F.array_join("parts", "/"))).otherwise("")).drop("segs", "parts")


def judged(found: DataFrame) -> DataFrame:
    """(host, template) with the smoothed purity of its branch, after merging, and whether it is rejected."""
    leaf = found.groupBy("host", "template").agg(F.sum("known").alias("known"), F.sum("blocked").alias("blocked"))
    leaf = written(leaf.withColumn("kin", F.regexp_replace("template", SIBLINGS, "/+$1")), "leaves")
    pool = leaf.groupBy("host", "kin").agg(F.sum("known").alias("k"), F.sum("blocked").alias("b"))
    both = leaf.join(pool, ["host", "kin"])
    rest = F.col("k") - F.col("known")
    share = F.col("b") / F.col("k")
    error = F.sqrt(share * (1 - share) * (1 / F.col("known") + 1 / rest))
    gap = F.abs(F.col("blocked") / F.col("known") - (F.col("b") - F.col("blocked")) / rest)
    like = F.when((F.col("known") > 0) & (rest > 0), gap <= SAME * error).otherwise(F.lit(False))
    both = both.withColumn("like", like)
    merged = both.where("like").groupBy("host", "kin").agg(F.sum("known").alias("mk"), F.sum("blocked").alias("mb"))
    both = both.join(merged, ["host", "kin"], "left")
    n = F.when(F.col("like"), F.col("mk")).otherwise(F.col("known"))
    bad = F.when(F.col("like"), F.col("mb")).otherwise(F.col("blocked"))
    both = written(both.select("host", "template", "known", "blocked", n.alias("n"), bad.alias("bad")), "branches")
    # Ancestors: every labelled template is one observation, blocked or allowed by its majority.
    segments = F.split("template", "/")  # the first is empty; the host's root counts as its own ancestor
    above = F.posexplode(prefixes(F.when(F.size(segments) > 1, F.slice(segments, 2, F.size(segments))).otherwise(segments))).alias("level", "above")
    seen = both.where("n > 0").select("host", above, (F.col("blocked") * 2 >= F.col("known")).cast("long").alias("bad"))
    seen = seen.groupBy("host", "above").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    asks = both.where("n = 0").select("host", "template", above)
    near = asks.join(seen, ["host", "above"]).groupBy("host", "template").agg(F.max(F.struct("level", "n", "bad")).alias("near"))
    both = both.join(near, ["host", "template"], "left")
    hosts = leaf.groupBy("host").agg(((F.sum("blocked") + PRIOR * BASE) / (F.sum("known") + PRIOR)).alias("base"))
    both = both.join(small(written(hosts, "hosts")), "host")
    n, bad = F.coalesce("near.n", "n"), F.coalesce("near.bad", "bad")
    purity = (bad + PRIOR * F.col("base")) / (n + PRIOR)
    return both.select("host", "template", purity.alias("purity"), ((n > 0) & (purity >= REJECT)).alias("rejected"))


def filter_urls(pages: DataFrame, rules: Sequence[Rule], labels: DataFrame | None = None) -> DataFrame:
    """``pages`` with host, path, rule, verdict, template and purity for each ``url``.

    The longest rule that fits decides; other pages are blocked where their
    template is rejected, and allowed else (see ``judged``). ``labels`` (url, blocked boolean)
    adds labelled urls to those that rules label. Added columns get underscores
    in front if ``pages`` has their names.

    A null url, or one without ``://``, has an empty host and path; such pages
    share one template. Repeated rows count once each. An empty table gives an empty one.
    """
    host, path = spare(pages, "host"), spare(pages, "path")
    rows = pages.withColumn(host, host_of(F.col("url"))).withColumn(path, path_of(F.col("url")))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    paths = rows.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(F.count(F.lit(1)).alias("pages"))
    paths = paths.withColumn("rule", rule).withColumn("by_rule", verdict)
    paths = paths.withColumn("known", F.when(F.col("rule").isNotNull(), F.col("pages")).otherwise(0)).withColumn("blocked", F.when(F.col("by_rule") == "block", F.col("pages")).otherwise(0))
    if labels is not None:
        told = labels.where("blocked is not null").select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("blocked").cast("int").alias("bad"))
        told = told.groupBy("host", "path").agg(F.count(F.lit(1)).alias("told"), F.sum("bad").alias("bad"))
        paths = paths.join(told, ["host", "path"], "left").withColumn("known", F.col("known") + F.coalesce("told", F.lit(0))).withColumn("blocked", F.col("blocked") + F.coalesce("bad", F.lit(0))).drop("told", "bad")
    found = templates(written(paths, "paths"))
    table = found.join(small(written(judged(found), "judged")), ["host", "template"]).select(
        F.col("host").alias("_h"), F.col("path").alias("_p"), "rule", F.coalesce("by_rule", F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"), "template", "purity"
    )
    table = written(table, "verdicts")
    joined = rows.join(table.select("_h", "_p", *(F.col(c).alias(f"_found_{c}") for c in ("rule", "verdict", "template", "purity"))), (F.col(host) == F.col("_h")) & (F.col(path) == F.col("_p")))
    added = [F.col(f"_found_{c}").alias(spare(pages, c)) for c in ("rule", "verdict", "template", "purity")]
    return joined.select(*pages.columns, host, path, *added)

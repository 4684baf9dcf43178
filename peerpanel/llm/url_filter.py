"""URL filter: a path-template tree per host, judged by labelled purity.

Every distinct path of a host becomes a list of segments; numbers, hexadecimal ids
and dates are typed wildcards at once, so counts are taken over distinct lists, not
over pages. The tree grows one level at a time for all hosts together: the children
of a node are counted, and

* a literal child of fewer than ``MIN_PAGES`` pages or less than ``MIN_SHARE`` of its
  node's pages becomes part of the wildcard ``*``, so a node keeps at most
  1 / ``MIN_SHARE`` literals beside the wildcards;
* labelled siblings whose blocked shares do not differ significantly (two-proportion
  z below ``Z``, neighbours in order of the share) are merged into one branch
  ``{a|b}``; a branch without labels is like any other and stays alone.

A node's rate is the blocked share of *all* its pages, smoothed by the rate of its
parent: ``(blocked + s * parent) / (pages + s)``; pages without a label count as not
blocked, so a host is not condemned by one branch. A template's purity is the blocked
share of its *labelled* pages, smoothed by its parent's rate: ``(blocked + s * parent)
/ (labelled + s)``. Templates of purity ``REJECT`` or more are rejected. Segments after
the ``DEPTH``-th form one tail.

Rules decide first: a rule ``host/path`` fits its host and all subdomains where the
url's path starts with its path; the longest rule wins. The pages that a rule decides
are the labelled ones unless other labels are given.

All work is DataFrame work: hot hosts are pre-aggregated, and the small
table of a level meets the distinct paths through a salted join.

Defined results: a null url, or one without ``://``, has empty host and path and is
judged as a page of the host ''; repeated rows are separate pages with one verdict; a
null page id gets a verdict like any other; an empty table gives no rows; very long
urls are used whole; columns other than those returned are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

DEPTH = 8
MIN_PAGES, MIN_SHARE = 2, 0.02
Z = 1.96
SMOOTH = 4.0
REJECT = 0.5
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = "://([^/?#]*)([^?#]*)"
# kinds of variable segments: wildcard and pattern; the ending of a file stays
KINDS = (("{date}", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), ("{n}", r"^[0-9]+\z"), ("{n}.html", r"^[0-9]+[.]html?\z"),
         ("{hex}", r"^[0-9a-f]{8,}(-[0-9a-f]{4,})*\z"))
TAIL = "{**}"


def split_url(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url column; empty without ``://``."""
    part = lambda i: F.coalesce(F.regexp_extract(F.col(url), URL, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def longest_rule(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """``(rule, verdict)`` of the longest fitting rule, null where none fits. Rules are
    a short configured list; of two equal ones the first wins."""
    rule = verdict = None
    for text, decides in sorted(rules, key=lambda r: -len(r[0])):
        at = text.index("/")
        own, start = text[:at], text[at:]
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(start))
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(decides)) if verdict is None else verdict.when(fits, F.lit(decides))
    null = F.lit(None).cast("string")
    return (null, null) if rule is None else (rule, verdict)


def segments(path: Column, depth: int = DEPTH) -> Column:
    """Segments of a path, variable ones by kind; an ending ``/`` leaves an empty last
    segment, and what follows the ``depth``-th is one tail."""
    def kind(s: Column) -> Column:
        c = None
        for name, pattern in KINDS:
            c = F.when(s.rlike(pattern), F.lit(name)) if c is None else c.when(s.rlike(pattern), F.lit(name))
        return c.otherwise(s)

    found = F.split(F.regexp_replace(path, "^/", ""), "/")
    head = F.transform(F.slice(found, 1, depth), kind)
    cut = F.when(F.size(found) > depth, F.concat(head, F.array(F.lit(TAIL)))).otherwise(head)
    return F.when(F.length(path) > 0, cut).otherwise(F.array().cast("array<string>"))


def _merged(children: DataFrame, node: list[str]) -> DataFrame:
    """Branch of every child: neighbours in order of the blocked share join while
    their shares do not differ significantly. A node has few children."""
    share = F.col("blocked") / F.col("labelled")
    known = children.where("labelled > 0").withColumn("share", share)
    order = Window.partitionBy(*node).orderBy("share", "child")
    b0, l0 = F.lag("blocked").over(order), F.lag("labelled").over(order)
    pooled = (F.col("blocked") + b0) / (F.col("labelled") + l0)
    spread = F.sqrt(pooled * (1.0 - pooled) * (1.0 / F.col("labelled") + 1.0 / l0))
    apart = F.coalesce(F.col("share") - b0 / l0 >= Z * spread, F.lit(False)) & (F.col("share") > b0 / l0)
    known = known.withColumn("cut", F.when(apart, 1).otherwise(0))
    known = known.withColumn("branch", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    names = F.array_sort(F.collect_set("child").over(Window.partitionBy(*node, "branch")))
    name = F.when(F.size(names) > 1, F.concat(F.lit("{"), F.array_join(names, "|"), F.lit("}"))).otherwise(F.col("child"))
    alone = children.where("labelled = 0").select(*children.columns, F.col("child").alias("name"))
    return known.select(*children.columns, name.alias("name")).union(alone)


def _level(paths: DataFrame, d: int) -> DataFrame:
    """One level deeper: paths of at least ``d`` segments get their branch, the
    template so far, the rate of their node and the purity of the template."""
    node = ["host", "template"]
    here = paths.where(F.size("segments") >= d).drop("purity").withColumn("segment", F.element_at("segments", d))
    seen = here.groupBy(*node, "parent", "segment").agg(*[F.sum(c).alias(c) for c in ("pages", "labelled", "blocked")])
    total = seen.groupBy(*node).agg(F.sum("pages").alias("all_pages"))
    fixed = F.col("segment").isin(*[k for k, _ in KINDS], TAIL, "")
    rare = ~fixed & ((F.col("pages") < MIN_PAGES) | (F.col("pages") < MIN_SHARE * F.col("all_pages")))
    salted = F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt")
    seen = seen.withColumn("salt", F.pmod(F.xxhash64("segment"), F.lit(SALTS)).cast("int")) \
        .join(total.select("*", salted), [*node, "salt"]).drop("salt")
    seen = stored(seen.withColumn("child", F.when(rare, F.lit("*")).otherwise(F.col("segment"))), "url-children")
    children = seen.groupBy(*node, "parent", "child").agg(*[F.sum(c).alias(c) for c in ("pages", "labelled", "blocked")])
    branches = _merged(children, node)
    whole = Window.partitionBy(*node, "name")
    blocked, labelled, pages = (F.sum(c).over(whole) for c in ("blocked", "labelled", "pages"))
    prior = SMOOTH * F.col("parent")
    judged = branches.select(*node, "child", F.concat("template", F.lit("/"), "name").alias("deeper"),
                             ((blocked + prior) / (pages + SMOOTH)).alias("rate"),
                             ((blocked + prior) / (labelled + SMOOTH)).alias("purity"))
    # kept literals, kinds and the wildcard: what is not a kept literal of its node is rare
    literal = judged.where("child <> '*'").select(*node, F.col("child").alias("segment"), "deeper", "rate", "purity")
    wild = judged.where("child = '*'").select(*node, F.col("deeper").alias("w"), F.col("rate").alias("wr"),
                                              F.col("purity").alias("wp"))
    salt = F.pmod(F.xxhash64("segments"), F.lit(SALTS)).cast("int")
    out = here.withColumn("salt", salt).join(literal.select("*", salted), [*node, "segment", "salt"], "left") \
        .join(wild.select("*", salted), [*node, "salt"], "left")
    return out.select("host", "segments", "pages", "labelled", "blocked", F.coalesce("deeper", "w").alias("template"),
                      F.coalesce("rate", "wr").alias("parent"), F.coalesce("purity", "wp").alias("purity"))


def path_templates(pages: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``(host, segments, template, purity)`` of every distinct list of segments of
    ``(host, segments, blocked)``; ``blocked`` is true, false or null (no label)."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    counts = stored(pages.groupBy("host", "segments").agg(
        F.count("*").alias("pages"), one(F.col("blocked").isNotNull()).alias("labelled"),
        one(F.coalesce("blocked", F.lit(False))).alias("blocked")), "url-paths")
    everything = counts.agg(F.sum("pages").alias("n"), F.sum("blocked").alias("b"), F.max(F.size("segments")).alias("d")).first()
    start = everything["b"] / everything["n"] if everything["n"] else 0.0
    hosts = counts.groupBy("host").agg(*[F.sum(c).alias(f"h_{c}") for c in ("pages", "labelled", "blocked")])
    rate = (F.col("h_blocked") + SMOOTH * start) / (F.col("h_pages") + SMOOTH)
    purity = (F.col("h_blocked") + SMOOTH * start) / (F.col("h_labelled") + SMOOTH)
    salted = F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt")
    hosts = hosts.select("host", rate.alias("parent"), purity.alias("purity"), salted)
    level = stored(counts.withColumn("salt", F.pmod(F.xxhash64("segments"), F.lit(SALTS)).cast("int"))
                   .join(hosts, ["host", "salt"]).select(*counts.columns, F.lit("").alias("template"), "parent", "purity"),
                   "url-level")
    done = level.where(F.size("segments") == 0).select("host", "segments", "template", "purity")
    for d in range(1, min(everything["d"] or 0, depth + 1) + 1):
        level = stored(_level(level, d), "url-level")
        done = done.union(level.where(F.size("segments") == d).select("host", "segments", "template", "purity"))
    return done


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url",
               label: Column | None = None, depth: int = DEPTH) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` per row of ``pages``.

    ``rules`` are pairs like ``("net/", "block")``. ``label`` is a boolean column of
    ``pages`` (true: blocked; null: unknown); by default pages that a rule decides are
    labelled by it."""
    host, path = split_url("url")
    known = label.cast("boolean") if label is not None else F.lit(None).cast("boolean")
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), known.alias("given"))
    rule, verdict = longest_rule(rules, F.col("host"), F.col("path"))
    urls = base.select("page_id", "given", host.alias("host"), path.alias("path")) \
        .select("*", rule.alias("rule"), verdict.alias("decided"), segments(F.col("path"), depth).alias("segments"))
    labelled = F.col("given") if label is not None else F.col("decided") == "block"
    trees = stored(path_templates(urls.select("host", "segments", labelled.alias("blocked")), depth), "url-templates")
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt")
    mixed = F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int").alias("salt")
    out = urls.select("*", mixed).join(trees.select("*", salts), ["host", "segments", "salt"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce(
        F.col("decided"), F.when(F.col("purity") >= REJECT, "block").otherwise("allow")).alias("verdict"),
        "template", F.round("purity", 6).alias("purity"))

"""URL verdicts: host and path rules, and for the rest a tree of path templates.

A path's segments get a shape first (runs of digits become ``#``, long hexadecimal runs ``%``). Then,
host by host and level by level, a node with many children that hardly repeat has its rare children
replaced by ``*``; levels end where no host has enough paths for that. Every node of the tree counts the
rule-labelled URLs below it. Siblings of like purity are a band, and a branch that doesn't differ
significantly from its band is merged with it: it has the band's counts. From the root down, a branch whose
counts don't differ significantly from its parent's is merged with the parent; any other has its own share of
blocked URLs, smoothed towards the parent's. Above a host's tree stand the trees of the hosts that share its last
two labels, of those that share its last one, and of all hosts; above them the blocked share of all URLs,
those without a label counted as not blocked. A template is blocked at ``THRESHOLD`` or more.

Null url, or one without ``://``: host and path are empty, no rule, the share of everything decides.
No labelled URL at all: allowed. Null page_id and repeated rows: each row is judged. Ties: of equally long
rules the first; a purity of just THRESHOLD blocks. Very long urls: time grows with the square of a path's
segments, memory doesn't. Empty table: no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import ascii_lower, written


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
CHILDREN, REPEATS, SHARE = 12, 5.0, 0.1
SMOOTHING, SIGNIFICANT, THRESHOLD = 4.0, 3.84, 0.5
#: Bands of purity in which siblings are merged.
BANDS = 5
#: Parts into which hosts are dealt where they meet a node over all hosts.
SALTS = 8


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path as the contract has them."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)), F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null; of equally long ones the first."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def shapes(path: Column) -> Column:
    """The path's segments by shape."""
    plain = F.regexp_replace(F.regexp_replace(path, r"(?<=^|[^0-9a-zA-Z])[0-9a-f]{16,}(?=$|[^0-9a-zA-Z])", "%"), r"[0-9]+", "#")
    return F.split(F.regexp_replace(plain, "^/", ""), "/")


def _prefix(segments: Column, depth: Column | int) -> Column:
    """A node: the hash of the segments down to a depth."""
    return F.xxhash64(F.slice(segments, 1, depth))


def templates(paths: DataFrame) -> DataFrame:
    """``paths`` (host, shape, n, ...) with ``template``: the shape with variable segments as wildcards."""
    t, d = paths.withColumn("template", F.col("shape")), 0
    while not t.where(F.size("template") > d).groupBy("host").count().where(F.col("count") >= CHILDREN).isEmpty():
        above, own = _prefix(F.col("template"), d).alias("above"), F.get("template", F.lit(d)).alias("own")
        children = t.where(F.size("template") > d).groupBy("host", above, own).agg(F.sum("n").alias("n"))
        parents = children.groupBy("host", "above").agg(F.count("*").alias("k"), F.sum("n").alias("total"))
        variable = parents.where((F.col("k") >= CHILDREN) & (F.col("total") < REPEATS * F.col("k")))
        rare = children.join(variable, ["host", "above"]).where(F.col("n") < SHARE * F.col("total")).select("host", "above", "own", F.lit(True).alias("rare"))
        t = t.withColumns({"above": _prefix(F.col("template"), d), "own": F.get("template", F.lit(d))})
        t = t.join(rare, ["host", "above", "own"], "left")
        wild = F.concat(F.slice("template", 1, d), F.array(F.lit("*")), F.slice("template", F.lit(d + 2), F.greatest(F.size("template") - d - 1, F.lit(0))))
        t = t.withColumn("template", F.when(F.col("rare"), wild).otherwise(F.col("template"))).drop("above", "own", "rare")
        t, d = written(t, "templates"), d + 1
    return t


def _gain(b: Column, n: Column, p: Column) -> Column:
    """The likelihood-ratio statistic of b of n against the share p."""
    safe = F.greatest(F.least(p, F.lit(0.999)), F.lit(0.001))
    log_of = lambda k, q: F.when(k > 0, k * F.log(k / n / q)).otherwise(0.0)
    return 2 * (log_of(b, safe) + log_of(n - b, 1 - safe))


def merged(nodes: DataFrame) -> DataFrame:
    """``nodes`` (host, depth, above, node, b, n) with the counts of its band for every branch that resembles it."""
    family, band = ["host", "depth", "above"], ["host", "depth", "above", "band"]
    whole = nodes.groupBy(*family).agg(F.sum("b").alias("all_b"), F.sum("n").alias("all_n"))
    rows = nodes.join(whole, family)
    share = F.when(F.col("all_n") > 0, F.col("all_b") / F.col("all_n")).otherwise(0.0)
    rows = rows.withColumn("band", F.least(F.floor((F.col("b") + SMOOTHING * share) / (F.col("n") + SMOOTHING) * BANDS), F.lit(BANDS - 1)).cast("int")).drop("all_b", "all_n")
    rows = written(rows, "nodes")
    pools = rows.groupBy(*band).agg(F.sum("b").alias("band_b"), F.sum("n").alias("band_n"))
    rows = rows.join(pools, band)
    alike = (F.col("n") == 0) | (_gain(F.col("b"), F.col("n"), F.try_divide("band_b", "band_n")) < SIGNIFICANT)
    pick = lambda c: F.when(alike & (F.col("band_n") > 0), F.col(f"band_{c}")).otherwise(F.col(c)).alias(c)
    return rows.select("host", "depth", "node", pick("b"), pick("n"))


def purities(paths: DataFrame) -> DataFrame:
    """host, shape, template, purity (smoothed share of blocked URLs) for each of ``paths`` (host, shape, n, blocked, labelled)."""
    t = templates(paths)
    prior = paths.agg(F.sum("blocked"), F.sum("n")).first()
    prior = (prior[0] or 0) / prior[1] if prior[1] else 0.0
    leaves = t.groupBy("host", "template").agg(F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled"))
    leaves = leaves.withColumn("leaf", F.xxhash64("template"))
    depths = F.explode(F.transform(F.sequence(F.lit(1), F.size("template")), lambda d: F.struct(d.alias("depth"), _prefix(F.col("template"), d - 1).alias("above"), _prefix(F.col("template"), d).alias("node")))).alias("at")
    below = written(leaves.select("host", "leaf", "blocked", "labelled", depths).select("host", "leaf", "blocked", "labelled", "at.*"), "below")
    counts = (F.sum("blocked").cast("double").alias("b"), F.sum("labelled").cast("double").alias("n"))
    own = written(merged(below.groupBy("host", "depth", "above", "node").agg(*counts)), "own")
    scopes = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.when(F.lit(k) > 0, F.substring_index("host", ".", -k)).otherwise("").alias("scope")) for k in range(3)))).alias("of")
    wide = lambda df: df.select("*", scopes).select("*", "of.level", "of.scope").drop("of")
    pooled = wide(below).groupBy("level", "scope", "depth", "node").agg(*counts).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    step = lambda level: F.struct(level.alias("level"), "depth", "b", "n").alias("step")
    wanted = below.select("host", "leaf", "depth", "node", F.pmod(F.xxhash64("host"), F.lit(SALTS)).cast("int").alias("salt"))
    chain = wanted.join(own, ["host", "depth", "node"]).select("host", "leaf", step(F.lit(3)))
    chain = chain.unionByName(wide(wanted).join(pooled, ["level", "scope", "depth", "node", "salt"]).select("host", "leaf", step(F.col("level"))))
    chain = chain.groupBy("host", "leaf").agg(F.array_sort(F.collect_list("step")).alias("steps"))

    def refine(p: Column, x: Column) -> Column:
        alike = (x["n"] == 0) | (_gain(x["b"], x["n"], p) < SIGNIFICANT)
        return F.when(alike, p).otherwise((x["b"] + SMOOTHING * p) / (x["n"] + SMOOTHING))

    purity = F.aggregate("steps", F.lit(float(prior)), refine)
    return t.withColumn("leaf", F.xxhash64("template")).join(chain.select("host", "leaf", purity.alias("purity")), ["host", "leaf"]).select("host", "shape", "template", "purity")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, held_out: Column | None = None) -> DataFrame:
    """page_id, host, path, rule, template, purity, predicted, verdict of every page.

    ``predicted`` is the tree's verdict, whatever the rules say; it learns nothing from pages that are ``held_out``.
    """
    host, path = split_url(F.coalesce("url", F.lit("")))
    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), held.alias("held"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rows = written(rows.select("page_id", "host", "path", "held", shapes(F.col("path")).alias("shape"), rule.alias("rule"), verdict.alias("ruled")), "urls")
    one = lambda c: F.sum(F.when(c & ~F.col("held"), 1).otherwise(0)).alias
    paths = written(rows.groupBy("host", "shape").agg(F.count("*").alias("n"), one(F.col("ruled") == "block")("blocked"), one(F.col("ruled").isNotNull())("labelled")), "paths")
    judged = rows.join(purities(paths), ["host", "shape"], "left")
    block = F.when(F.col("purity") >= THRESHOLD, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.concat_ws("/", "host", F.array_join("template", "/")).alias("template"), "purity", block.alias("predicted"), F.coalesce("ruled", block).alias("verdict"))

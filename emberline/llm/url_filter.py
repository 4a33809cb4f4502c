"""URL verdicts from rules and, where no rule fits, from a tree of path templates.

Rows that a rule decides are the labelled ones. Every url becomes a chain of
templates: its host, then the host with one more path segment at each level, as
deep as paths go.
Segments that hold a digit, or that a parent has seen fewer than `support` times,
become the wildcard `*`. A branch whose labelled block rate does not differ from
that of its labelled siblings (two-proportion z) is merged into the wildcard
branch. The tree grows level by level; a node of fewer than `support` rows grows no
further, as all below it would be wildcards, which are written at once. Levels on
which all rows of a node go on alike are taken in one round, so there are no more
rounds than levels on which `support` rows part or end.

A node's purity is its labelled block rate, smoothed by `weight` pseudo-rows of its
parent's purity; a host's parent is its domain without the first label, and so on up
to the root, whose purity is the block rate of all labelled rows. So a branch without labels
of its own is judged by the nearest node that has some. A template is rejected when
its purity reaches `reject` and the branches that lead to it, host and domains
included, hold `support` labelled rows at one of them below the root.

Everything is DataFrame operations. Urls are reduced to counted templates before
the first shuffle, so a host with a third of all rows adds up on the map side.

Defined cases: a null url, or one without ://, has an empty host and path, and is
judged by the template of the empty host; repeated rows are each judged; an empty
table gives an empty result; no labelled row at all gives the prior 0.5, so allow;
other columns pass, but for clashing ones (in any case), which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, without, written


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = ""

    @property
    def text(self) -> str:
        return f"{self.host}/{self.path}"


RULES = (Rule("block", "net"), Rule("allow", "example.net", "en/"), Rule("block", "example.com", "de/"), Rule("allow", "org", "fr/"))


@dataclass(frozen=True)
class TreeConfig:
    support: int = 5  # rows that a segment needs to stay literal, and labelled rows that a rejection needs
    z: float = 1.96  # siblings whose rates differ by less are merged
    weight: float = 4.0  # pseudo-rows of the parent's purity
    domains: int = 4  # levels of parent domains that lend their purity to a host; a host of more labels hangs below its last four
    reject: float = 0.8  # least purity of a rejected template


def with_parts(urls: DataFrame, url: str = "url") -> DataFrame:
    """Add host and path."""
    rest = F.when(F.instr(F.col(url), "://") > 0, F.expr(f"substr({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return urls.withColumns({"host": ascii_lower(host), "path": path})


def rule_columns(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits host and path; null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the last one to fit wins
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith("/" + r.path)
        text = F.when(fits, F.lit(r.text)).otherwise(text)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def _counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("n", "lab", "blk")))


def _purity(lab: Column, blk: Column, parent: Column, config: TreeConfig) -> Column:
    return (blk + config.weight * parent) / (lab + config.weight)


def domain(host: Column, labels: int) -> Column:
    """The last so many labels of a host."""
    return F.substring_index(host, ".", -labels)


def host_purities(hosts: DataFrame, prior: float, config: TreeConfig) -> DataFrame:
    """hosts (host; n, lab, blk) with purity and held: the labelled rows of the best evidenced node from the host up to its domain of one label.

    Domains of 1, 2, ... labels are nodes where they are shorter than the host.
    """
    out = hosts.withColumns({"purity": F.lit(prior), "held": F.lit(0).cast("long")})
    for k in range(1, config.domains + 1):
        sums = _counts(hosts.select(domain(F.col("host"), k).alias("d"), "n", "lab", "blk"), "d").select("d", F.col("lab").alias("dl"), F.col("blk").alias("db"))
        inner = F.size(F.split("host", "[.]")) > k  # else this node is the host itself
        out = out.withColumn("at", domain(F.col("host"), k)).join(sums, F.col("at") == F.col("d"))
        out = out.withColumns({"purity": F.when(inner, _purity(F.col("dl"), F.col("db"), F.col("purity"), config)).otherwise(F.col("purity")), "held": F.when(inner, F.greatest("held", "dl")).otherwise(F.col("held"))}).drop("at", "d", "dl", "db")
    return out.withColumns({"purity": _purity(F.col("lab"), F.col("blk"), F.col("purity"), config), "held": F.greatest("held", "lab")})


def segments(path: Column) -> Column:
    """Segments of a path; those that hold a digit are the wildcard."""
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.when(s.rlike("[0-9]"), F.lit("*")).otherwise(s))


def onward(rest: Column) -> list[Column]:
    """Aggregates over the rows of a node: those that go on below it, and their least and greatest remaining segments."""
    on = F.size(rest) > 0
    return [F.sum(F.when(on, F.col("n")).otherwise(0)).alias("open"), F.min(F.when(on, rest)).alias("lo"), F.max(F.when(on, rest)).alias("hi")]


def levels_alike(config: TreeConfig) -> Column:
    """Levels below a node of open, lo and hi that are one round: those on which its rows have one branch, or one level. What the least and the greatest begin with, all between begin with."""
    parted = F.array_position(F.zip_with("lo", "hi", lambda a, b: a.eqNullSafe(b)), False)
    alike = F.when(parted == 0, F.size("lo")).otherwise(parted - 1).cast("int")
    return F.when(F.col("open") >= config.support, F.greatest(alike, F.lit(1))).otherwise(1)


def template_verdicts(judged: DataFrame, config: TreeConfig) -> DataFrame:
    """For every (host, raw: segments) of the urls: template, purity and verdict of the tree.

    judged: rows with host, path and rule_verdict.
    """
    labelled = F.col("rule_verdict").isNotNull().cast("long")
    blocked = F.coalesce((F.col("rule_verdict") == "block").cast("long"), F.lit(0).cast("long"))
    counted = _counts(judged.select("host", segments(F.col("path")).alias("raw"), F.lit(1).cast("long").alias("n"), labelled.alias("lab"), blocked.alias("blk")), "host", "raw")
    counted = written(counted, "templates")
    total = counted.agg(F.sum("lab").alias("lab"), F.sum("blk").alias("blk")).first()  # two numbers
    prior = total["blk"] / total["lab"] if total["lab"] else 0.5
    at_hosts = counted.groupBy("host").agg(*onward(F.col("raw")), *(F.sum(c).alias(c) for c in ("n", "lab", "blk"))).select("host", "n", "lab", "blk", levels_alike(config).alias("jump"))
    hosts = written(host_purities(at_hosts, prior, config), "hosts")
    # node: the template so far, of depth segments; open rows are those whose node may still branch
    rows = counted.join(hosts.select("host", "purity", "held", F.col("n").alias("nn"), "jump"), "host").withColumns({"node": F.col("host"), "depth": F.lit(0)})
    rows = written(rows, "templates")
    done = []
    while True:
        left = F.size("raw") - F.col("depth")
        ends = (left < 1) | (F.col("nn") < config.support)
        below = F.when(left > 0, F.concat(F.lit("/"), F.array_join(F.array_repeat(F.lit("*"), left), "/"))).otherwise("")
        done.append(rows.where(ends).select("host", "raw", F.concat("node", below).alias("template"), "purity", "held"))
        rows = rows.where(~ends)
        if rows.isEmpty():
            break
        rows = rows.withColumn("step", F.array_join(F.slice("raw", F.col("depth") + 1, F.col("jump")), "/"))
        after = F.slice("raw", F.col("depth") + F.col("jump") + 1, F.size("raw"))
        branches = rows.groupBy("node", "step").agg(F.sum("n").alias("bn"), F.sum("lab").alias("bl"), F.sum("blk").alias("bb"), *onward(after))
        parents = branches.groupBy("node").agg(F.sum("bl").alias("pl"), F.sum("bb").alias("pb"))
        rest_l, rest_b = F.col("pl") - F.col("bl"), F.col("pb") - F.col("bb")
        gap = F.col("bb") / F.col("bl") - rest_b / rest_l
        pooled = F.col("pb") / F.col("pl")
        spread = pooled * (1 - pooled) * (1 / F.col("bl") + 1 / rest_l)
        similar = F.when((F.col("bl") > 0) & (rest_l > 0), gap * gap <= config.z * config.z * spread).otherwise(F.lit(False))
        name = F.when((F.col("bn") >= config.support) & ~similar, F.col("step")).otherwise("*")
        named = written(branches.join(parents, "node").withColumn("name", name), "branches")
        sums = named.groupBy("node", "name").agg(F.sum("bn").alias("cn"), F.sum("bl").alias("cl"), F.sum("bb").alias("cb"), F.sum("open").alias("open"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        children = named.select("node", "step", "name").join(sums.select("node", "name", "cn", "cl", "cb", levels_alike(config).alias("next")), ["node", "name"])
        purity = F.aggregate(F.sequence(F.lit(1), F.col("jump")), F.col("purity"), lambda p, _: _purity(F.col("cl"), F.col("cb"), p, config))  # once a level
        rows = rows.join(children, ["node", "step"]).select(
            "host", "raw", "n", "lab", "blk", purity.alias("purity"), F.greatest("held", "cl").alias("held"),
            F.col("cn").alias("nn"), F.col("next").alias("jump"), F.concat_ws("/", "node", "name").alias("node"), (F.col("depth") + F.col("jump")).alias("depth"),
        )
        rows = written(rows, "templates")
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    verdict = F.when((F.col("purity") >= config.reject) & (F.col("held") >= config.support), "block").otherwise("allow")
    return written(out.select("host", "raw", "template", "purity", verdict.alias("tree_verdict")), "templates")


def judge_urls(urls: DataFrame, rules: tuple[Rule, ...] = RULES, config: TreeConfig = TreeConfig(), url: str = "url") -> DataFrame:
    """urls with host, path, rule, verdict, template and purity added (columns of these names are replaced)."""
    kept = urls.select(*without(urls, "host", "path", "rule", "rule_verdict", "verdict", "template", "purity", "tree_verdict", "raw"))
    text, verdict = rule_columns(rules)
    judged = with_parts(kept, url).withColumns({"rule": text, "rule_verdict": verdict})
    templates = template_verdicts(judged, config)
    out = judged.withColumn("raw", segments(F.col("path"))).join(templates, ["host", "raw"], "left")
    return out.select(*kept.columns, "host", "path", "rule", F.coalesce("rule_verdict", "tree_verdict").alias("verdict"), "template", "purity")

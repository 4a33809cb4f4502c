"""Secret scans over an incremental ledger of content-addressed blobs.

A blob is a distinct text, named by its SHA-256. The ledger is a Parquet table of
(blob, rule_versions, findings): which versions of which rules have been run over a
blob, and what they found (places only: the ledger holds no secrets). A scan names
every path's blob, asks the ledger, and looks only at blobs for which it lacks a
version of some rule, and there at those rules only. It appends what it has
done, and joins the findings back to every path (row) that holds the blob, in any
historical version.

Everything is DataFrame operations: a rule's matches come from regexp_extract_all,
their offsets from the lengths of the pieces that split() leaves between them.
Unseen texts are gated: only those that hold a rule's literal and its gate pattern
travel, once for each different text. Patterns try a bounded number of characters
at each place, so a long run of letters costs no more than as many words.

Defined cases: a null text is an empty one and has no findings; copies of a text
are scanned once, whatever their number; equal rows stay equal rows; an empty
table gives an empty result and adds nothing to the ledger; clean blobs are in the
ledger too; other columns pass, but for `blob` and `findings` in any case. Two scans
that write one ledger at once may both write a pair; it is read as one.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, aside, checked, sha256_hex, shared_dir, without, written


@dataclass(frozen=True)
class SecretRule:
    """pattern's matches count whose group (0: whole match) has at least `least` characters.

    gate: a cheaper pattern, and needs: a literal, that every text with a counting match holds.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    gate: str | None = None  # None: the pattern
    needs: str = ""


# The three base rules. Letter classes are spelt out, so only ASCII letters fold.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    SecretRule("assign", ASSIGN, 2, 8),
    SecretRule("access", "AKIA[A-Z0-9]+", 0, 16, "AKIA[A-Z0-9]{12}", "AKIA"),
    SecretRule("hex", "[0-9a-f]+", 0, 32, "[0-9a-f]{32}"),
)
#: Spans that the method adds. A token's header has 1000 characters at most, a scheme 16.
ADDED = (
    SecretRule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", needs="-----BEGIN "),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{1,1000}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 32, needs="eyJ"),
    SecretRule("url_login", r"[a-z][a-z0-9+.-]{0,15}://[^\x00-\x20/:@]+:[^\x00-\x20/@]+@", needs="://"),
)
RULES = BASE + ADDED


def rule_version(rule: SecretRule) -> str:
    return hashlib.sha256(repr(rule).encode()).hexdigest()[:16]


#: Most bytes of findings that are broadcast; beyond, they meet their paths by a shuffle.
BROADCAST_BYTES = 64_000_000


def _wanted(missing: Column, rule: SecretRule) -> Column:
    return F.array_contains(missing, rule_version(rule))


def gated(text: Column, rules: tuple[SecretRule, ...], missing: Column) -> Column:
    """Whether a text can hold a counting match of a rule whose version is missing."""
    out = F.lit(False)
    for r in rules:
        one = text.rlike(r.gate or r.pattern)
        out = out | (_wanted(missing, r) & text.contains(r.needs) & one if r.needs else _wanted(missing, r) & one)
    return out


def _matches(text: Column, rule: SecretRule, ordinal: int) -> Column:
    """Array of (ordinal, pos, gap, len, counts), one for each match of a rule; gap: characters between it and the match before."""
    whole, gaps = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.split(text, rule.pattern, -1)
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    sides = F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("whole"), value.alias("value"))
    return F.transform(
        sides,
        lambda x, i: F.struct(
            F.lit(ordinal).alias("ordinal"), i.alias("pos"), F.char_length(x["gap"]).alias("gap"), F.char_length(x["whole"]).alias("len"),
            (F.char_length(x["value"]) >= rule.least).alias("counts"),
        ),
    )


SPANS = "array<struct<start:bigint,end:bigint,rule:string>>"
LEDGER = f"blob string, rule_versions array<string>, findings {SPANS}"


def blob_findings(blobs: DataFrame, rules: tuple[SecretRule, ...]) -> DataFrame:
    """blob and findings (SPANS) of blobs (blob, text, missing; one row each), by the rules whose versions are missing. Blobs without any are left out.

    The i-th match of a rule ends where i + 1 gaps and i + 1 matches end: a running sum, in a window over one rule's matches in one blob.
    """
    found = [F.when(_wanted(F.col("missing"), r), _matches(F.col("text"), r, k)).otherwise(F.array()) for k, r in enumerate(rules)]
    raw = blobs.select("blob", F.explode(F.flatten(F.array(*found))).alias("x"))
    before = Window.partitionBy("blob", "x.ordinal").orderBy("x.pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("x.gap") + F.col("x.len")).over(before)
    versions = F.array(*(F.lit(rule_version(r)) for r in rules))
    spans = raw.select("blob", "x", end.alias("end")).where("x.counts")
    span = F.struct((F.col("end") - F.col("x.len")).alias("start"), F.col("end").cast("long").alias("end"), F.get(versions, F.col("x.ordinal")).alias("rule"))
    return spans.groupBy("blob").agg(F.collect_list(span).alias("findings"))


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame | None:
    """The ledger's rows; None where there is no ledger yet."""
    try:
        return spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def unseen(paths: DataFrame, rules: tuple[SecretRule, ...], ledger: DataFrame | None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A row a blob of paths (blob, text) for which the ledger lacks something: blob, missing (the versions that it lacks), and text, null where the gate knows it clean.

    Blobs are compared by name before any text is looked at, and only gated texts are
    shuffled. Names of unseen blobs are broadcast where they are few, as after a first
    scan. Where they are many, but the fewer, their texts meet them by a shuffle; where they
    are the most of all, as after a new rule, it is cheaper to gate all texts at once.
    """
    versions = [rule_version(r) for r in rules]

    def gate(rows: DataFrame, missing: Column) -> DataFrame:
        may = gated(F.col("text"), rules, missing)
        return rows.withColumn("text", F.when(may, F.col("text"))).groupBy("blob").agg(F.first("text").alias("text"), *(F.first(c).alias(c) for c in rows.columns if c == "missing"))

    if ledger is None:
        return gate(paths, F.array(*map(F.lit, versions))).withColumn("missing", F.array(*map(F.lit, versions)))
    known = ledger.groupBy(F.col("blob").alias("known")).agg(F.flatten(F.collect_set("rule_versions")).alias("run"))
    names = paths.select("blob").distinct().join(known, F.col("blob") == F.col("known"), "left")
    lacks = F.array_except(F.array(*map(F.lit, versions)), F.coalesce("run", F.array().cast("array<string>")))
    named = written(names.select("blob", lacks.alias("missing")), "named")
    lacking = named.where(F.size("missing") > 0)
    n, every = lacking.count(), named.count()
    if n <= broadcast_rows:
        return gate(paths.join(F.broadcast(lacking), "blob"), F.col("missing"))
    if 2 * n < every:
        return gate(paths.join(lacking, "blob"), F.col("missing"))
    anywhere = F.array(*(F.lit(r["v"]) for r in lacking.select(F.explode("missing").alias("v")).distinct().collect()))  # rules at most
    return gate(paths, anywhere).join(lacking, "blob")


def scan(documents: DataFrame, rules: tuple[SecretRule, ...] = RULES, ledger: str | None = None, text: str = "text", broadcast_bytes: int = BROADCAST_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """documents with `blob` and `findings` (never null) added, columns of these names being replaced. A finding is (start, ordinal of the rule, end, kind), by start, then rule.

    ledger: folder of the ledger, shared by all executors; scans with the same
    one skip what it has. None: a new ledger, in the application's shared folder.
    """
    spark = documents.sparkSession
    ledger = ledger or f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    kept = documents.select(*without(documents, "blob", "findings"))
    whole = F.coalesce(F.col(text), F.lit(""))
    todo = written(unseen(kept.select(sha256_hex(whole).alias("blob"), whole.alias("text")), rules, read_ledger(spark, ledger), broadcast_rows), "unseen")
    found = blob_findings(todo.where("text is not null"), rules).withColumnRenamed("blob", "of")
    todo.join(found, F.col("blob") == F.col("of"), "left").select("blob", F.col("missing").alias("rule_versions"), F.coalesce("findings", F.array().cast(SPANS)).alias("findings")).write.mode("append").parquet(ledger)
    # of all scans: a pair that two of them wrote counts once
    place = F.create_map(*(F.lit(x) for k, r in enumerate(rules) for x in (rule_version(r), k)))
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    spans = read_ledger(spark, ledger).where(F.size("findings") > 0).select("blob", F.explode("findings").alias("s")).where(F.col("s.rule").isin([rule_version(r) for r in rules])).distinct()
    span = F.struct(F.col("s.start").alias("start"), F.try_element_at(place, "s.rule").alias("ordinal"), F.col("s.end").alias("end"), F.get(kinds, F.try_element_at(place, "s.rule")).alias("kind"))
    findings = written(spans.groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("findings")), "findings")
    none = F.array().cast(findings.schema["findings"].dataType)
    paths = kept.withColumn("blob", sha256_hex(whole))
    if (findings.agg(F.sum(200 + 60 * F.size("findings"))).first()[0] or 0) <= broadcast_bytes:
        return paths.join(F.broadcast(findings), "blob", "left").select(*kept.columns, "blob", F.coalesce("findings", none).alias("findings"))
    # texts of clean paths don't travel while the other names can be broadcast
    names = checked(findings.select("blob"), "names")
    held = paths.join(names, "blob", "left_semi").join(findings, "blob").select(*kept.columns, "blob", "findings")
    return held.unionAll(paths.join(names, "blob", "left_anti").select(*kept.columns, "blob", none.alias("findings")))


def joined_spans(findings: Column) -> Column:
    """kind:start:end of the findings, comma-joined."""
    return F.array_join(F.transform(findings, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(documents: DataFrame, rules: tuple[SecretRule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """documents without their secrets: each run of overlapping findings in `text` becomes the mark, and n_chars, where there is one, is counted again.

    Documents without findings stay as they are, null texts included.
    """
    clear, back = aside(documents, ("blob", "findings"))
    found = scan(clear, rules)
    # overlapping spans are merged; findings are sorted by start
    def join_span(acc, s):
        overlaps = (F.size(acc) > 0) & (s["start"] < F.try_element_at(acc, F.lit(-1))["end"])
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], s["end"]).alias("end"))))
        return F.when(overlaps, grown).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))))

    merged = F.aggregate("findings", F.array().cast("array<struct<start:bigint,end:bigint>>"), join_span)
    acc = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    cut = F.aggregate(
        merged, acc,
        lambda a, s: F.struct(F.concat(a["out"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mark)).alias("out"), s["end"].alias("at")),
        lambda a: F.concat(a["out"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.char_length("text"))),
    )
    text = F.when(F.size("findings") > 0, cut).otherwise(F.col("text"))
    out = found.withColumn("text", text)
    for f in clear.schema.fields:
        if f.name.lower() == "n_chars":  # in the type that it has
            out = out.withColumn(f.name, F.when(F.size("findings") > 0, F.char_length("text").cast(f.dataType)).otherwise(F.col(f.name)))
    return out.select(*back)

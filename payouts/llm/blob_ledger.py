"""Secret scans with an incremental ledger of blobs.

Every version of every document is addressed by the SHA-256 of its content. The ledger holds one row for each pair of
blob and rule version that has been scanned, with what was found. A run scans only the pairs that the ledger lacks,
each blob once however many rows hold it, adds them to the ledger, and joins the findings back to all rows. All of it
is DataFrame functions.

Positions: the pieces between the matches and the matches themselves alternate, so running sums of their lengths give
each match's start and end in code points. A rule may look at a cheap literal first.

Defined results: a missing text is an empty blob; rows with equal content share its findings, and equal rows are all
returned; an empty table gives an empty result and leaves the ledger as it was.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from payouts.llm.common import text_of

SPAN = "struct<start:int,end:int>"


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern`, leftmost and non-overlapping; those whose `group` has fewer than `least` characters go.

    A changed pattern needs a new version: blobs that were scanned under the old one are then scanned again.
    """

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    literal: str | None = None


#: In the order in which kinds are listed at equal starts.
BASE_RULES = (
    Rule("assign", 1, r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)
RULES = (*BASE_RULES, Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27, "-----BEGIN "))


def rule_spans(text: Column, rule: Rule) -> Column:
    """The spans that the rule finds, an array in order."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    picked = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    between = F.split(text, rule.pattern, -1)
    lengths = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda gap, match: F.struct(F.char_length(gap).alias("gap"), F.char_length(match).alias("match")))
    spans = F.aggregate(
        lengths,
        F.struct(F.lit(0).alias("end"), F.array().cast(f"array<{SPAN}>").alias("all")),
        lambda done, x: F.struct(
            (done["end"] + x["gap"] + x["match"]).alias("end"),
            F.concat(done["all"], F.array(F.struct((done["end"] + x["gap"]).alias("start"), (done["end"] + x["gap"] + x["match"]).alias("end")))).alias("all")),
        lambda done: done["all"],
    )
    kept = F.filter(F.zip_with(spans, picked, lambda span, value: F.struct(span.alias("span"), F.char_length(value).alias("n"))), lambda x: x["n"] >= rule.least)
    some = F.contains(text, F.lit(rule.literal)) if rule.literal else F.lit(True)
    none = F.array().cast(f"array<{SPAN}>")
    return F.when(some & F.regexp_like(text, F.lit(rule.pattern)), F.transform(kept, lambda x: x["span"])).otherwise(none)


def _ledger(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def scan_unseen(blobs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings for the pairs that the ledger lacks: `blob`, `kind`, `version`, `spans`.

    blobs: `blob` and `text`, one row for each.
    """
    todo = blobs.withColumn("seen", F.array().cast("array<string>"))
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "kind", "version")).alias("known"))  # as many as there are rule versions
        todo = blobs.join(seen, "blob", "left").withColumn("seen", F.coalesce("known", F.array().cast("array<string>")))
    results = [
        F.when(~F.array_contains("seen", f"{r.kind}:{r.version}"), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), rule_spans(F.col("text"), r).alias("spans")))
        for r in rules
    ]
    # The outer form: for the inner one Spark derives a filter that would scan every text once more.
    return todo.select("blob", F.explode_outer(F.array(*results)).alias("x")).filter(F.col("x").isNotNull()).select("blob", "x.kind", "x.version", "x.spans")


def scan(docs: DataFrame, ledger_path: str, identifier: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each row: its identifier, `blob`, and `findings`, a map from kind to spans.

    Scans what the ledger at this path lacks and appends it there. The append is one atomic write of new files, so a
    run that is broken off adds nothing.
    """
    spark = docs.sparkSession
    addressed = docs.select(F.col(identifier).alias("id"), F.sha2(text_of(text), 256).alias("blob"))
    ledger = _ledger(spark, ledger_path)
    blobs = docs.select(F.sha2(text_of(text), 256).alias("blob"), text_of(text).alias("text"))
    if ledger is not None:  # blobs known under every rule version need no text
        known = ledger.filter(F.concat_ws(":", "kind", "version").isin([f"{r.kind}:{r.version}" for r in rules]))
        full = known.groupBy("blob").agg(F.count_distinct("kind").alias("n")).filter(F.col("n") == len(rules))
        blobs = blobs.join(full, "blob", "left_anti")
    scan_unseen(blobs.dropDuplicates(["blob"]), ledger, rules).write.mode("append").parquet(ledger_path)
    current = [f"{r.kind}:{r.version}" for r in rules]
    found = spark.read.parquet(ledger_path).filter((F.size("spans") > 0) & F.concat_ws(":", "kind", "version").isin(current))
    by_blob = found.groupBy("blob").agg(F.map_from_entries(F.collect_list(F.struct("kind", "spans"))).alias("findings"))  # one entry a rule
    none = F.create_map().cast(f"map<string,array<{SPAN}>>")
    return addressed.join(by_blob, "blob", "left").select(F.col("id").alias(identifier), "blob", F.coalesce("findings", none).alias("findings"))


def _labelled(place: int, kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("place"), F.concat_ws(":", F.lit(kind), s["start"], s["end"]).alias("text"))


def listed(findings: Column, kinds: list[str]) -> Column:
    """kind:start:end of these kinds by start, then kind as listed, comma-joined."""
    each = [
        F.transform(F.coalesce(findings[k], F.array().cast(f"array<{SPAN}>")), _labelled(i, k))
        for i, k in enumerate(kinds)
    ]
    return F.array_join(F.transform(F.array_sort(F.concat(*each)), lambda x: x["text"]), ",")

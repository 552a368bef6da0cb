"""Benchmark decontamination by a broadcast hash set of test n-grams.

Benchmark texts become windows of a fixed number of words (a shorter item is one window). Every token window of the
documents is hashed, probed against the broadcast windows, and a hit is verified on the words themselves. All of it is
DataFrame functions: a document's row is spread into its windows and brought together again by one small aggregation.

Defined results: a missing text has no words; an item without words, or without an identifier, never matches; rows
that are equal throughout get equal results, one each; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payouts.llm.common import ascii_lower, text_of

WINDOW = 10
#: Words are runs of characters other than these, after A-Z have become lower case.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Benchmarks of up to so many distinct windows are broadcast (about 200 bytes each); larger ones are shuffled by hash.
BROADCAST_WINDOWS = 500_000


def words(text: str = "text") -> Column:
    return F.regexp_extract_all(ascii_lower(text_of(text)), F.lit(WORD), F.lit(0))


def _windows(tokens: Column, width: Column | int) -> Column:
    """Hashes of the windows of this width, in order; none if there are fewer words."""
    width = F.lit(width) if isinstance(width, int) else width
    last = F.size(tokens) - width + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(tokens, i, width))))


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each distinct window: `gram` (its words), `width`, `hash` and `items` that hold it."""
    tokens = benchmark.filter(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("item"), words(text).alias("tokens"))
    width = F.least(F.lit(window), F.size("tokens"))
    at = F.sequence(F.lit(1), F.size("tokens") - width + 1)
    grams = tokens.filter(F.size("tokens") > 0).select(
        "item", width.alias("width"), F.explode_outer(F.transform(at, lambda i: F.slice("tokens", i, width))).alias("gram"))
    return grams.groupBy("gram", "width").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumn("hash", F.xxhash64("gram"))


def hits(docs: DataFrame, benchmark: DataFrame, identifier: str = "doc_id", text: str = "text", window: int = WINDOW,
         broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row for each row: `id`, `text_hash`, `n_words`, the array
    `covered` of the hit words' positions (from 1) and the array `items` of identifiers that occur."""
    grams = benchmark_windows(benchmark, text=text, window=window)
    widths = {r["width"]: r["n"] for r in grams.groupBy("width").agg(F.count("*").alias("n")).collect()}  # at most `window` rows
    fits = sum(widths.values()) <= broadcast_windows
    tokens = docs.select(F.col(identifier).alias("id"), F.xxhash64(text_of(text)).alias("text_hash"), words(text).alias("tokens"))
    # The first probe of a row is empty, so that a row without hits stays. The outer form of explode matters: for the
    # inner one Spark derives a filter that would evaluate the windows once more, below the projections.
    probes = [F.coalesce(_windows(F.col("tokens"), w), F.array().cast("array<bigint>")) for w in sorted(widths)]
    probed = tokens.withColumns({"n_words": F.size("tokens"), "probes": F.concat(F.array(F.lit(None).cast("bigint")), *probes)})
    spread = probed.select("id", "text_hash", "tokens", "n_words", F.posexplode_outer("probes").alias("pos", "h"))
    width, at, cases = F.lit(0), F.lit(0), []
    for w in sorted(widths, reverse=True):
        start = _before(sorted(widths), w)
        cases.append((F.col("pos") >= start, w, F.col("pos") - start + 1))
    for reached, w, place in reversed(cases):
        width, at = F.when(reached, w).otherwise(width), F.when(reached, place).otherwise(at)
    located = spread.withColumns({"w": width, "at": at})
    mine = F.slice("tokens", F.greatest("at", F.lit(1)), F.col("w"))
    if fits:
        found = located.join(F.broadcast(grams), F.col("h") == F.col("hash"), "left")
    else:
        located = located.withColumn("mine", mine).drop("tokens")
        found, mine = located.join(grams, F.col("h") == F.col("hash"), "left"), F.col("mine")
    found = found.filter((F.col("pos") == 0) | ((F.col("w") == F.col("width")) & (mine == F.col("gram"))))
    grouped = found.groupBy("id", "text_hash").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count_if(F.col("pos") == 0).alias("rows"),
        F.array_distinct(F.flatten(F.collect_set(F.when(F.col("pos") > 0, F.sequence("at", F.col("at") + F.col("w") - 1))))).alias("covered"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    return grouped.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).drop("row", "rows")


def _before(widths: list[int], width: int) -> Column:
    """Position of a row's first probe of this width."""
    out = F.lit(1)
    for w in widths:
        if w < width:
            out = out + F.greatest(F.col("n_words") - w + 1, F.lit(0))
    return out


#: The same words in a text as it is.
_RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def clean_documents(docs: DataFrame, benchmark: DataFrame, identifier: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows without hits, with all their columns."""
    bad = hits(docs, benchmark, identifier, text, **options).filter(F.size("covered") > 0).select("id", "text_hash").distinct()
    same = docs[identifier].eqNullSafe(bad["id"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == bad["text_hash"])
    return docs.join(bad, same, "left_anti")


def clean_spans(docs: DataFrame, benchmark: DataFrame, identifier: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """All rows with all their columns; hit words, and what lies between two of them, are cut out of the texts."""
    bad = hits(docs, benchmark, identifier, text, **options).filter(F.size("covered") > 0).select("id", "text_hash", "covered").dropDuplicates(["id", "text_hash"])
    same = docs[identifier].eqNullSafe(bad["id"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == bad["text_hash"])
    own, covered = docs[text], bad["covered"]
    between, found = F.split(own, _RAW_WORD, -1), F.regexp_extract_all(own, F.lit(_RAW_WORD), F.lit(0))

    def kept(word: Column, i: Column) -> Column:
        hit, before = F.array_contains(covered, i + 1), F.array_contains(covered, i)
        return F.concat(F.when(hit & before, F.lit("")).otherwise(F.get(between, i)), F.when(hit, F.lit("")).otherwise(word))

    cleaned = F.concat(F.array_join(F.transform(found, kept), ""), F.element_at(between, -1))
    columns = [F.when(covered.isNotNull(), cleaned).otherwise(own).alias(text) if c == text else docs[f"`{c}`"] for c in docs.columns]
    return docs.join(bad, same, "left").select(*columns)


def contamination(docs: DataFrame, benchmark: DataFrame, identifier: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row for each row: the identifier, `n_words`, `n_hit`, `n_items`,
    `items_sha256`, `contaminated`."""
    found = hits(docs, benchmark, identifier, text, **options)
    return found.select(
        F.col("id").alias(identifier), "n_words", F.size("covered").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("covered") > 0).alias("contaminated"))

"""Ranked lexical search over a length-stratified index.

Scoring. Terms are the maximal runs of TERM in a text with A-Z lower-cased. Over the documents with at least one term,
N counts them and L sums their terms; a document's normaliser is m = 25 + (75 * n * N) div L with n its terms. A term
held by df documents weighs w = floor(1000 * ln((2N + 2) / (2df + 1))); a posting of tf occurrences in a document of
normaliser m has the impact w * ((10^9 * tf) div (1000 * tf + 8 * m)), all in 64-bit integers. A query's score of a
document sums the impacts of its terms, a term as often as the query holds it.

Method. The index is partitioned by document, as search engines shard it: each Spark task holds whole documents.
A first pass counts, per task, the documents with terms, their terms and the df of every query term; Spark sums those
counts (one row per query term). The second pass builds, inside each task and batch, the length-stratified index of
its documents: postings grouped by term, normaliser m (the stratum) and tf, with the impact computed once per group and
spread to the group's documents; each task keeps a running TOP per query, equal scores by ascending doc_id, and a last
window merges at most TOP rows per task and query. No text or posting is shuffled; the result is that of all documents.
Queries go in blocks of at most BLOCK (query, term) pairs, the bound of what each task is sent. `index` gives the same
postings and strata as a DataFrame for other uses.

A first version visited the strata of the whole corpus by falling impact with lower bounds on the TOP-th score; as
impacts hardly grow with tf, the bounds opened about 29 % of all (query, document) pairs on the check's small input.

Edges. A null text has no terms and counts in neither N nor L; it is never ranked. A null doc_id takes part in every
count and is ranked like others, after all identifiers of its score. Repeated documents are separate documents with
their own rows. Repeated benchmark rows (same item_id and text) are one query; a null item_id is a query ranked under
null. An item without terms, or whose terms no document holds, gives no rows. Very long texts are read whole. Empty
tables give no rows. Only doc_id, text and item_id, text are read, so other columns of any name are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from payouts.llm.common import ascii_lower, cut, text_of

# Fixed values of the scoring contract.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 10
#: (query, term) pairs sent to the tasks at once; more queries go in further blocks.
BLOCK = 200_000


def terms(text: str = "text"):
    """The terms of a text column, A-Z lower-cased; none for null."""
    return F.regexp_extract_all(ascii_lower(text_of(text)), F.lit(TERM), 0)


def index(docs: DataFrame, vocabulary: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(postings, groups) of the documents.

    postings: (key, doc_id, term, tf, n, m) with `key` a unique number of the document row; groups: (term, m, tf,
    n_docs, w, impact), the length strata of each term with their tf groups. With a `vocabulary` (a frame with a `term`
    column), only postings of its terms are kept; N, L, m and the df of those terms are still those of all documents
    and all terms. One pass reads the texts: each document also posts its length under a null term, from which N and L
    are summed (two numbers to the driver).
    """
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), terms().alias("terms"))
    rows = rows.withColumn("n", F.size("terms").cast("long")).filter(F.col("n") > 0)
    words = rows.select("key", "doc_id", "n", F.explode(F.concat("terms", F.array(F.lit(None).cast("string")))).alias("term"))
    if vocabulary is not None:  # Spark broadcasts a small vocabulary after measuring it, else joins by shuffle
        known = vocabulary.select("term").distinct().withColumn("_known", F.lit(True))
        words = words.join(known, "term", "left").where(F.col("_known") | F.col("term").isNull()).drop("_known")
    counted = cut(words.groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("doc_id").alias("doc_id"), F.first("n").alias("n")))
    totals = counted.where(F.col("term").isNull()).agg(F.count(F.lit(1)).alias("N"), F.sum("n").alias("L")).first()
    big_n, big_l = int(totals["N"] or 0), int(totals["L"] or 0)
    m = F.lit(25) + F.expr(f"(75 * n * {big_n}L) div {max(big_l, 1)}L")
    postings = counted.where(F.col("term").isNotNull()).withColumn("m", m)
    weights = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select(
        "term", F.floor(F.lit(1000.0) * F.log((F.lit(2.0 * big_n + 2)) / (F.col("df") * 2 + 1))).cast("long").alias("w"))
    groups = postings.groupBy("term", "m", "tf").agg(F.count(F.lit(1)).alias("n_docs")).join(weights, "term")
    groups = groups.withColumn("impact", F.col("w") * F.expr("(1000000000 * tf) div (1000 * tf + 8 * m)"))
    return postings, groups


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """For each query (item_id, text), its `top` best documents with a positive score: (item_id, rank, doc_id, score).

    The queries go in blocks of at most `block` (query, term) pairs, so what each task is sent has a bound.
    """
    spark = docs.sparkSession
    items = queries.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("qtext")).dropDuplicates()
    items = cut(items).withColumn("ikey", F.monotonically_increasing_id())  # numbered on stored rows, so stable
    asked = cut(items.select("ikey", "item_id", F.explode(terms("qtext")).alias("term"))
                .groupBy("ikey", "item_id", "term").agg(F.count(F.lit(1)).alias("k")))
    sizes = asked.groupBy("ikey").count().orderBy("ikey").collect()  # one row a query
    texts = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for lo, hi in _blocks([(r["ikey"], r["count"]) for r in sizes], block):
        part = asked.where((F.col("ikey") >= lo) & (F.col("ikey") <= hi)).collect()  # at most `block` rows
        ranked = _ranked_block(spark, texts, part, top)
        found = ranked if found is None else found.unionByName(ranked)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("ikey").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "key")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.select("item_id", F.col("rank").cast("int"), "doc_id", F.col("score").cast("long"))


def _blocks(sizes: list[tuple[int, int]], block: int) -> list[tuple[int, int]]:
    """Ranges of query keys whose pairs add up to `block` at most (a query larger than that is a block alone)."""
    out, lo, held = [], None, 0
    for key, n in sizes:
        if lo is not None and held + n > block:
            out.append((lo, last))
            lo, held = None, 0
        lo = key if lo is None else lo
        held, last = held + n, key
    if lo is not None:
        out.append((lo, last))
    return out


#: A-Z to a-z on UTF-8 bytes: bytes of several-byte characters are all above 0x7F, so only ASCII letters change.
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_TERM = re.compile(TERM)


def _terms(text: str | None) -> list[str]:
    return _TERM.findall(text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")) if text else []


def _ranked_block(spark, texts: DataFrame, part: list, top: int) -> DataFrame:
    """Local top `top` per query of each task's documents, for one block of queries."""
    vocabulary = sorted({r["term"] for r in part})
    ids = {t: i for i, t in enumerate(vocabulary)}
    keys = sorted({r["ikey"] for r in part})
    where = {k: i for i, k in enumerate(keys)}
    names = {r["ikey"]: r["item_id"] for r in part}
    shared = spark.sparkContext.broadcast(ids)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        df, docs, total = Counter(), 0, 0
        for batch in batches:
            for text in batch["text"]:
                found = _terms(text)
                if found:
                    docs, total = docs + 1, total + len(found)
                    df.update(known.keys() & set(found))
        yield pd.DataFrame({"term": [None, *df], "df": [0, *df.values()], "n": [docs, *[0] * len(df)], "l": [total, *[0] * len(df)]})

    stats = texts.select("text").mapInPandas(counted, "term string, df long, n long, l long").groupBy("term").agg(
        F.sum("df").alias("df"), F.sum("n").alias("n"), F.sum("l").alias("l")).collect()  # one row a term of the block
    big_n = sum(r["n"] for r in stats if r["term"] is None)
    big_l = sum(r["l"] for r in stats if r["term"] is None)
    df = {r["term"]: r["df"] for r in stats if r["term"] is not None}
    weight = np.zeros(len(vocabulary), dtype=np.int64)
    for term, i in ids.items():
        weight[i] = math.floor(1000.0 * math.log((2.0 * big_n + 2) / (2.0 * df.get(term, 0) + 1))) if big_n else 0
    # queries of each term, as ranges of one array
    pairs = sorted((ids[r["term"]], where[r["ikey"]], r["k"]) for r in part)
    starts = np.searchsorted(np.array([p[0] for p in pairs]), np.arange(len(vocabulary) + 1))
    query_of, times = np.array([p[1] for p in pairs], dtype=np.int64), np.array([p[2] for p in pairs], dtype=np.int64)
    table = spark.sparkContext.broadcast((weight, starts, query_of, times))
    n_queries = len(keys)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, (w, starts, query_of, times) = shared.value, table.value
        best: dict[int, list[tuple]] = {}
        for batch in batches:
            doc_of, term_of, tf_of, m_of = [], [], [], []
            for j, text in enumerate(batch["text"]):
                found = _terms(text)
                if not found:
                    continue
                m = 25 + (75 * len(found) * big_n) // big_l
                for term, tf in Counter(found).items():
                    i = known.get(term)
                    if i is not None:
                        doc_of.append(j), term_of.append(i), tf_of.append(tf), m_of.append(m)
            if not doc_of:
                continue
            doc_of, term_of, tf_of, m_of = (np.array(x, dtype=np.int64) for x in (doc_of, term_of, tf_of, m_of))
            # the index of the batch: postings by (term, stratum m, tf); an impact once for each such group
            groups, group_of = np.unique(np.stack([term_of, m_of, tf_of]), axis=1, return_inverse=True)
            impact = w[groups[0]] * ((1_000_000_000 * groups[2]) // (1000 * groups[2] + 8 * groups[1]))
            spread = starts[term_of + 1] - starts[term_of]
            rows = np.repeat(np.arange(len(term_of)), spread)
            at = np.repeat(starts[term_of] - np.concatenate([[0], np.cumsum(spread)[:-1]]), spread) + np.arange(rows.size)
            flat = doc_of[rows] * n_queries + query_of[at]
            sums = np.bincount(flat, weights=(times[at] * impact[group_of.ravel()[rows]]).astype(np.float64), minlength=len(batch) * n_queries)
            score = np.rint(sums).astype(np.int64).reshape(len(batch), n_queries)
            key, doc_id = batch["key"].to_numpy(), batch["doc_id"]
            for q in np.flatnonzero((score > 0).any(axis=0)):
                hit = np.flatnonzero(score[:, q] > 0)
                held = best.get(q, []) + [(-int(score[h, q]), pd.isna(doc_id.iat[h]), 0 if pd.isna(doc_id.iat[h]) else int(doc_id.iat[h]), int(key[h])) for h in hit]
                best[q] = heapq.nsmallest(top, held)
        out = [(keys[q], names[keys[q]], k, None if null else d, -s) for q, held in best.items() for s, null, d, k in held]
        yield pd.DataFrame(out, columns=["ikey", "item_id", "key", "doc_id", "score"]).astype({"item_id": "Int64", "doc_id": "Int64"})

    return texts.mapInPandas(scored, "ikey long, item_id long, key long, doc_id long, score long")

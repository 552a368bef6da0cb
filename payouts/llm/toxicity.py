"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the words, the pairs of neighbours, and the pairs with one word between, hashed into a fixed table; a
feature counts once a document. FTRL-proximal learns with a rate for each coordinate, and its L1 term leaves few weights
that are not zero, so the model that goes to the tasks is small whatever the corpus. Scoring is one pass over the
texts without a shuffle.

The fit uses a bounded sample of labelled rows, chosen by a hash of the identifier; the bound is the parameter
`sample`. Its features (numbers, no texts) go to one task.

Defined results: a missing text has no words and gets the score of the bias alone; labelled rows whose label or
document is missing are not learned from; a document with several labels is learned once with each; without any label
every score is 0; an empty table gives an empty result; further columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payouts.llm.common import fresh, text_of
from payouts.llm.text_arrays import LOWER_BYTES, gram_hashes, mixed, parts, range_hashes, text_bytes, word_ranges

BITS = 22
SAMPLE = 16_000
EPOCHS = 5
ALPHA, BETA, L2 = 0.3, 1.0, 1.0
#: The L1 term is this times the root of the number of sampled rows, as the sums of gradients of chance features grow.
L1_RATE = 0.23
#: Features that fewer sampled documents hold are not learned.
LEAST = 10
THRESHOLD = 0.3
#: Everything in ASCII but letters and digits parts words.
_OUTSIDE = np.zeros(256, bool)
_OUTSIDE[:128] = True
_OUTSIDE[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The feature numbers of all texts, repeats included, and the number of the text of each."""
    data, offsets = text_bytes(texts)
    data = LOWER_BYTES[data]
    starts, ends, before = word_ranges(data, offsets, _OUTSIDE)
    words = range_hashes(data, starts, ends)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    hashes, rows = [words], [row]
    if len(words) > 1:
        near = row[1:] == row[:-1]
        hashes.append(gram_hashes(words, 2)[near])
        rows.append(row[1:][near])
    if len(words) > 2:
        near = row[2:] == row[:-2]
        hashes.append(mixed(words[:-2] * np.uint64(3) + mixed(words[2:]))[near])
        rows.append(row[2:][near])
    return (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int32), np.concatenate(rows)


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, end in parts(batch.column("text")):
            part = batch.slice(begin, end - begin)
            number, row = features(part.column("text"))
            pair = np.unique(row.astype(np.int64) << 32 | number)
            bounds = np.searchsorted(pair >> 32, np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                part.column("label"), part.column("place"), pa.ListArray.from_arrays(pa.array(bounds), pa.array((pair & 0xFFFFFFFF).astype(np.int32)))],
                names=["label", "place", "found"])


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and weights of the features that FTRL-proximal leaves; the bias is number -1."""
    if not len(rows):
        return np.zeros(0, np.int32), np.zeros(0)
    held = np.zeros(1 << BITS, np.int32)
    for row in rows:
        held[row] += 1  # a row has each feature once
    numbers = np.flatnonzero(held >= LEAST).astype(np.int32)
    bias = len(numbers)
    dense = np.full(1 << BITS, -1, np.int32)
    dense[numbers] = np.arange(bias)
    known = [np.append((at := dense[row])[at >= 0], bias) for row in rows]
    z, n = np.zeros(bias + 1), np.zeros(bias + 1)
    l1 = np.full(bias + 1, L1_RATE * len(rows) ** 0.5)
    l1[bias] = 0

    def weights(at: np.ndarray | slice) -> np.ndarray:
        return np.where(np.abs(z[at]) <= l1[at], 0, (np.sign(z[at]) * l1[at] - z[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for at, label in zip(known, labels.tolist(), strict=True):
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(slice(None))
    left = np.flatnonzero(w[:bias])
    return np.append(numbers[left], -1).astype(np.int32), np.append(w[left], w[bias])


def _fit_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, labels, places = [], [], []
    for batch in batches:
        found = batch.column("found")
        offsets, flat = np.asarray(found.offsets), np.asarray(found.values)
        rows += [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        labels.append(np.asarray(batch.column("label")))
        places.append(np.asarray(batch.column("place")))
    if rows:
        labels, places = np.concatenate(labels), np.concatenate(places)
        order = np.lexsort((labels, [len(r) for r in rows], places))  # the same order however the rows came
        number, weight = fit([rows[i] for i in order], labels[order])
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(weight)], names=["number", "weight"])


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, identifier: str = "doc_id", text: str = "text", label: str = "toxic",
          sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """The model: feature numbers and weights. Learns from labels whose row meets `learn`, a condition on the
    identifier, and from `sample` of them at most."""
    marked = labels.select(F.col(identifier).alias("label_id"), F.col(label).cast("double").alias("label")).filter("label IS NOT NULL AND label_id IS NOT NULL")
    if learn is not None:
        marked = marked.filter(learn)
    place = F.xxhash64(F.col("label_id").cast("string"), F.lit(6))
    chosen = marked.withColumn("place", place).orderBy("place", "label_id", "label").limit(sample)
    texts = docs.select(F.col(identifier).alias("id"), text_of(text).alias("text"))
    joined = texts.join(F.broadcast(chosen), F.col("id") == F.col("label_id")).select("text", "label", "place")  # `sample` rows at most
    found = joined.mapInArrow(_sample_features, "label double, place long, found array<int>")
    rows = found.repartition(1).mapInArrow(_fit_sample, "number int, weight double").toPandas()
    return rows["number"].to_numpy(np.int32), rows["weight"].to_numpy(float)


def _scores(number: np.ndarray, weight: np.ndarray, name: str, score_name: str):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << BITS, np.float32)
        table[number[:-1]] = weight[:-1]
        for batch in batches:
            for begin, end in parts(batch.column(name)):
                part = batch.slice(begin, end - begin)
                score = np.zeros(part.num_rows)
                if len(number):
                    found, row = features(part.column(name))
                    some = table[found] != 0
                    pair = np.unique(row[some].astype(np.int64) << 32 | found[some])
                    total = np.bincount(pair >> 32, table[pair & 0xFFFFFFFF], part.num_rows) + weight[-1]
                    score = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*part.schema.names, score_name])

    return walk


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text") -> DataFrame:
    """The rows with a score from 0 to 1 as the last column: `score`, or with underscores before where that is taken."""
    name = fresh(docs, "score")[0]
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"`{name}` double"])
    return docs.mapInArrow(_scores(*model, text, name), kinds)


def held_out(identifier: str, of: int, remainder: int) -> Column:
    """Whether the row is kept from learning: the CRC-32 of the identifier as text leaves this remainder."""
    return F.coalesce(F.crc32(F.col(identifier).cast("string")) % of == remainder, F.lit(False))

"""Language identification by error-correcting output codes.

Every language gets a codeword of bits. For each bit a binary classifier over character trigrams separates the
languages whose bit is 1 from those whose bit is 0; its weights are log-odds of trigram rates, each language counting
alike. The margins of all bits decode by loss: the codeword with the least summed logistic loss wins, and a narrow
lead over the second flags ambiguity.

The trigram counts come from all rows to learn from: each task adds up its own, so what is shuffled and gathered is
bounded by the languages and the 2^18 trigrams, not by the rows.

Defined results: a text that is missing or has no letter is `und` with score 0; rows without a language are not
learned from; with a single language every text with a letter gets it; with none every text is `und`; an empty table
gives an empty result; further columns may have any names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payouts.llm.common import text_of
from payouts.llm.text_arrays import parts, text_bytes

UNDETERMINED = "und"
#: Leads of a smaller share of the loss than this are ambiguous.
NARROW = 0.05
_BOUND = 0
#: Bytes in 64 classes: 0 parts words, 1 to 26 letters in either case, 27 to 63 bytes of other characters.
_CLASS = np.zeros(256, np.uint32)
_CLASS[65:91] = _CLASS[97:123] = np.arange(1, 27)
_CLASS[128:] = 27 + np.arange(128) % 37
_SLICE = 1 << 20


def _trigrams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """In slices: trigram numbers, and the text of each. Trigrams whose middle parts words are left out."""
    data, offsets = text_bytes(texts)
    for begin in range(0, len(data), _SLICE):
        low, high = max(0, begin - 1), min(len(data), begin + _SLICE + 1)
        kind = _CLASS[data[low:high]]
        # One trigram for each byte of the slice; beyond the data lies a bound.
        kind = np.concatenate([np.zeros(int(begin == low), np.uint32), kind, np.zeros(int(begin + _SLICE + 1 > len(data)), np.uint32)])
        # A text's neighbours are bounds too.
        edges = offsets[(offsets >= begin) & (offsets <= begin + len(kind) - 2)] - begin
        before, after = kind[:-2].copy(), kind[2:].copy()
        before[edges[edges < len(before)]] = after[edges[edges > 0] - 1] = _BOUND
        number = before << 12 | kind[1:-1] << 6 | after
        at = np.flatnonzero(kind[1:-1] != _BOUND)
        yield number[at], np.searchsorted(offsets, begin + at, "right") - 1


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for begin, end in parts(batch.column("text")):
            part = batch.slice(begin, end - begin)
            langs, place = np.unique(np.array(part.column("lang").to_pylist(), object).astype(str), return_inverse=True)
            for number, row in _trigrams(part.column("text")):
                both = np.bincount(place[row].astype(np.int64) << 18 | number, minlength=len(langs) << 18)
                for i, lang in enumerate(langs.tolist()):
                    total[lang] = total.get(lang, 0) + both[i << 18: (i + 1) << 18]
    for lang, count in total.items():
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(count[some].astype(np.int64))], names=["lang", "gram", "n"])


def codewords(languages: int) -> np.ndarray:
    """A row of bits for each language: every split in two for up to five, else the best of some dense random codes."""
    if languages < 2:
        return np.zeros((languages, 0), np.int8)
    if languages <= 5:
        splits = [s for s in itertools.product((0, 1), repeat=languages) if s[0] == 1 and 0 in s]
        return np.array(splits, np.int8).T
    width, random = 10 * int(np.ceil(np.log2(languages))), np.random.default_rng(languages)
    best, most = None, -1
    for _ in range(200):
        code = random.integers(0, 2, (languages, width), np.int8)
        least = min((a != b).sum() for a, b in itertools.combinations(code, 2))
        split = code.sum(axis=0)
        if least > most and ((split > 0) & (split < languages)).all():
            best, most = code, least
    return best


def train(docs: DataFrame, learn: Column | None = None, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """The model: languages in order, their codewords, and for each trigram the weights of the bits."""
    marked = docs.filter(F.col(lang).isNotNull() & (learn if learn is not None else F.lit(True)))
    counted = marked.select(text_of(text).alias("text"), F.col(lang).cast("string").alias("lang")).mapInArrow(_counts, "lang string, gram int, n long")
    rows = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()  # languages times 2^18 at most
    names = sorted(rows["lang"].unique())
    rate = np.full((len(names), 1 << 18), 0.5)
    rate[rows["lang"].map({n: i for i, n in enumerate(names)}).to_numpy(int), rows["gram"].to_numpy(int)] += rows["n"].to_numpy(float)
    rate /= rate.sum(axis=1, keepdims=True)
    code = codewords(len(names))
    weights = np.zeros((1 << 18, code.shape[1]), np.float32)
    for bit in range(code.shape[1]):
        weights[:, bit] = np.log(rate[code[:, bit] == 1].mean(axis=0) / rate[code[:, bit] == 0].mean(axis=0))
    return names, code, weights


def _decoded(names: list[str], code: np.ndarray, weights: np.ndarray, extra: list[str]):
    signs = 2.0 * code - 1

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in parts(batch.column("text")):
                part = batch.slice(begin, end - begin)
                margin, grams = np.zeros((part.num_rows, code.shape[1])), np.zeros(part.num_rows)
                for number, row in _trigrams(part.column("text")):
                    if len(row):
                        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                        margin[row[first]] += np.add.reduceat(weights[number], first, axis=0)
                        grams[row[first]] += np.diff(np.append(first, len(row)))
                lettered = np.asarray(part.column("lettered").to_numpy(zero_copy_only=False), bool)
                # Mean weight of a trigram, on a scale on which a plain text of one language reaches about 4.
                margin = 4 * margin / np.maximum(grams, 1)[:, None]
                loss = np.log1p(np.exp(-margin[:, None, :] * signs[None])).sum(axis=2) if names else np.zeros((part.num_rows, 1))
                likely = np.exp(loss.min(axis=1, keepdims=True) - loss)
                best = loss.argmin(axis=1)
                ordered = np.sort(loss, axis=1)
                narrow = (ordered[:, 1] - ordered[:, 0] < NARROW * ordered[:, 1]) if loss.shape[1] > 1 else np.zeros(part.num_rows, bool)
                sure = lettered & bool(names)
                lang = np.where(sure, np.array(names or [UNDETERMINED], object)[best], UNDETERMINED)
                columns = [pa.array(lang, pa.string()), pa.array(np.where(sure, 1 / likely.sum(axis=1), 0.0)), pa.array(~sure | narrow)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in extra), *columns], names=[*extra, "lang_pred", "score", "ambiguous"])

    return walk


def identified(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], identifier: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row: its identifier, `lang_pred`, `score` from 0 to 1, and `ambiguous`."""
    names, code, weights = model
    source = docs.select(F.col(identifier).alias("id"), text_of(text).alias("text"), text_of(text).rlike(r"\p{L}").alias("lettered"))
    kind = docs.schema[identifier].dataType.simpleString()
    found = source.mapInArrow(_decoded(names, code, weights, ["id"]), f"id {kind}, lang_pred string, score double, ambiguous boolean")
    return found.withColumnRenamed("id", identifier)

"""A Katz backoff language model with Good-Turing discounts, and the log-probabilities of texts under it.

Tokens are the words of a text, A-Z in lower case, then one end; the first token follows a start. The tables hold
single tokens, and pairs of neighbours that occur in training `least` times or more: with 1 all of them, each with its
discount; with 2, the default, a pair that occurs once is treated as unseen and its probability goes to backing off.
Discounts come from the counts of counts of all training tokens and
pairs. With p1 for single tokens, an unknown word having what their discounts leave,

    p(w | h) = d c(h, w) / c(h)   where the pair is in the table,   else   a(h) p1(w),

and a(h) is what the discounts of h leave, over the p1 of all words that do not follow h in the table: for every h the
probabilities of all words and the unknown one sum to 1.

Everything is partitioned by the earlier token of a pair. A task packs its pairs, summed where they repeat, into one
row for each bucket, so that few rows are shuffled; a bucket's rows meet in one task, which adds up in numpy and holds
the bucket's own table only. Since every word is the earlier token of exactly one pair, what a text owes to a word's
own count is found in the same place, and scoring is one more pass of the same form against the stored tables. Stored
are counts: of a bucket's earlier tokens and its distinct later ones a row each, of its pairs one row that refers to them
by number. The later tokens meet their own counts in a join, a row for each token and bucket in place of one for each
pair; probabilities are worked out where the pairs are looked up and are never written. The
number of buckets is `spark.sql.shuffle.partitions`, which is to be set to the size of the data as for any shuffle.

Defined results: a missing text is an empty one, which is one end; each row has its own result, repeated rows and rows
without identifiers included; without training rows every score is 0; an empty table gives an empty result; further
columns may have any names. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payouts.llm.common import _BATCH, BATCH_BYTES, new_folder, release, text_of
from payouts.llm.text_arrays import BLOCK, LOWER_BYTES, mixed, parts, range_hashes, text_bytes, word_ranges

START, END = np.uint64(1), np.uint64(2)
#: Counts up to this are discounted.
DISCOUNTED = 5
#: Pairs that occur less often are not in the table, if no other number is given.
LEAST = 2
#: Bytes of text whose pairs are packed together.
PACK = 12 * BLOCK
_ZSTD = pa.Codec("zstd", compression_level=1)


def _pairs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Earlier and later tokens of all pairs, the text of each pair, and the number of tokens of each text."""
    hashes, counts = [], []
    for begin, end in parts(texts, 2 * BLOCK):  # what is worked out for each byte is not kept
        data, offsets = text_bytes(texts.slice(begin, end - begin))
        data = LOWER_BYTES[data]
        starts, ends, before = word_ranges(data, offsets)
        hashes.append(range_hashes(data, starts, ends))
        counts.append(np.diff(before))
    words, n = np.concatenate(hashes), np.concatenate(counts)
    del hashes
    row = np.repeat(np.arange(len(n), dtype=np.int32), n + 1)
    first = np.cumsum(n + 1) - (n + 1)
    inner = np.ones(len(row), bool)
    inner[first] = False
    earlier, later = np.full(len(row), START), np.full(len(row), END)
    earlier[inner] = words
    inner = np.ones(len(row), bool)
    inner[first + n] = False
    later[inner] = words
    return earlier, later, row, n + 1


def _bucket(earlier: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(earlier + np.uint64(77)) % np.uint64(buckets)).astype(np.int32)


def _squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0 up: the lowest bytes of all numbers, then the next, as one zstd frame."""
    head, planes = [], []
    for values in arrays:
        width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
        head += [len(values), width]
        planes.append(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    raw = b"".join(planes)
    return np.array([len(arrays), len(raw), *head], "<u4").tobytes() + _ZSTD.compress(raw, asbytes=True)


def _loosened(blob: bytes) -> list[np.ndarray]:
    n, size = np.frombuffer(blob, "<u4", 2).tolist()
    head = np.frombuffer(blob, "<u4", 2 * n, 8).reshape(n, 2).tolist()
    raw = np.frombuffer(_ZSTD.decompress(blob[8 + 8 * n:], decompressed_size=size, asbytes=True) if size else b"", np.uint8)
    out, at = [], 0
    for length, width in head:
        values = np.zeros((length, 8), np.uint8)
        values[:, :width] = raw[at: at + length * width].reshape(width, length).T
        out.append(values.view("<u8").reshape(-1))
        at += length * width
    return out


def _ranked(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens, the most frequent first as small numbers take little room, and the place of each token among them."""
    token, place, times = np.unique(tokens, return_inverse=True, return_counts=True)
    order = np.argsort(-times, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return token[order], rank[place]


def _packed(earlier: np.ndarray, later: np.ndarray, number: np.ndarray | None) -> bytes:
    """Pairs with a number each (a text; in order), or, without, in order of pairs with the times that they occur. What is in
    order is kept as steps."""
    h, hi = _ranked(earlier)
    w, wi = _ranked(later)
    if number is not None:
        return _squeezed(h, w, hi, wi, np.diff(number, prepend=number.dtype.type(0)))
    key, times = np.unique(hi * len(w) + wi, return_counts=True)
    return _squeezed(h, w, np.diff(key // len(w), prepend=0), key % len(w), times)


def _unpacked(blob: bytes, texts: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct earlier and later tokens, and for each pair its places among them and its number."""
    h, w, *rest = _loosened(blob)
    hi, wi, number = (x.astype(np.int64) for x in rest)
    return (h, w, hi, wi, np.cumsum(number)) if texts else (h, w, np.cumsum(hi), wi, number)


def _by_bucket(earlier: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    where = _bucket(earlier, buckets)
    order = np.argsort(where, kind="stable")
    bounds = np.searchsorted(where[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        yield b, order[bounds[b]: bounds[b + 1]]


def _count_packs(buckets: int):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in parts(batch.column("text"), PACK):
                earlier, later, _, _ = _pairs(batch.column("text").slice(begin, end - begin))
                found = [(b, _packed(earlier[at], later[at], None)) for b, at in _by_bucket(earlier, buckets)]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.binary())], names=["bucket", "pack"])

    return walk


def _summed(h: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    _, first, place = np.unique(mixed(h) + w, return_index=True, return_inverse=True)
    return h[first], w[first], np.bincount(place, c, len(first)).astype(np.int64)


def _counted(least: int):
    """Of packs in order of bucket: earlier tokens with their counts (kind 0), distinct later tokens of the pairs that occur
    the least number of times or more (kind 1), those pairs in one row (kind 2), counts of low counts of pairs (kind 5).
    Holds the distinct pairs of one bucket and the packs since they were last summed.

    The row of pairs has for each earlier token, in order, the number of its pairs, then for each pair the place of the
    later token, in order of these, and the count.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, fresh, waiting = None, [], 0

        def total() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return _summed(*(np.concatenate(x) for x in zip(*fresh, strict=True)))

        def flush() -> Iterator[pa.RecordBatch]:
            h, w, c = total()
            token, place = np.unique(h, return_inverse=True)
            often = np.flatnonzero(c >= least)
            later, after = np.unique(w[often], return_inverse=True)
            order = np.lexsort((after, place[often]))
            pairs = _squeezed(np.bincount(place[often], minlength=len(token)), after[order], c[often][order])
            low = np.bincount(np.minimum(c, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1: DISCOUNTED + 2]
            for kind, a, n, pack in (
                (0, token, np.bincount(place, c, len(token)).astype(np.int64), None), (1, later, np.zeros(len(later), np.int64), None),
                (2, np.zeros(1, np.uint64), np.zeros(1, np.int64), pairs), (5, np.arange(1, len(low) + 1), low, None),
            ):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(a), kind, np.int8)), pa.array(np.full(len(a), bucket, np.int32)), pa.array(a.astype(np.uint64).view(np.int64)), pa.array(n.astype(np.int64)),
                    pa.array([pack] * len(a), pa.binary())], names=["kind", "bucket", "h", "c", "pack"])

        for batch in batches:
            for b, pack in zip(batch.column("bucket").to_pylist(), batch.column("pack"), strict=True):
                if b != bucket:
                    if fresh:
                        yield from flush()
                    bucket, fresh, waiting = b, [], 0
                h, w, hi, wi, number = _unpacked(pack.as_py(), texts=False)
                fresh.append((h[hi], w[wi], number))
                waiting += len(number)
                if waiting > 1_000_000 + len(fresh[0][0]):
                    fresh, waiting = [total()], 0
        if fresh:
            yield from flush()

    return walk


def discounts(low: dict[int, int]) -> list[float]:
    """Factors for counts 1 to DISCOUNTED by Good and Turing, in the form of Katz; where the counts of counts do not give
    factors between 0 and 1, those of an absolute discount."""
    n = [low.get(r, 0) for r in range(1, DISCOUNTED + 2)]
    if all(n):
        rest = (DISCOUNTED + 1) * n[DISCOUNTED] / n[0]
        if rest < 1:
            out = [((r + 1) * n[r] / (n[r - 1] * r) - rest) / (1 - rest) for r in range(1, DISCOUNTED + 1)]
            if all(0 < d < 1 for d in out):
                return out
    less = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    return [(r - min(max(less, 0.1), 0.9)) / r for r in range(1, DISCOUNTED + 1)]


def _factors(counts: np.ndarray, factors: list[float]) -> np.ndarray:
    return np.array([1.0, *factors, 1.0])[np.minimum(counts, DISCOUNTED + 1)]


def _long(token: np.uint64) -> int:
    return int(np.array([token]).view(np.int64)[0])


_COUNTS = "kind byte, bucket int, h long, c long, pack binary"


class Model:
    """The counts in the shared folder, by bucket, and the few numbers that belong to them."""

    def __init__(self, docs: DataFrame, train: Column, text: str = "text", least: int = LEAST):
        spark = docs.sparkSession
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        source = docs.filter(train).select(text_of(text).alias("text"))
        packs = source.mapInArrow(_count_packs(self.buckets), "bucket int, pack binary")
        ordered = packs.repartitionById(self.buckets, F.col("bucket")).sortWithinPartitions("bucket")
        folder = new_folder(spark, "katz-counts")
        before = spark.conf.get(_BATCH)
        spark.conf.set(_BATCH, BATCH_BYTES)
        try:
            ordered.mapInArrow(_counted(least), _COUNTS).write.parquet(folder)
        finally:
            spark.conf.set(_BATCH, before)
        del packs, ordered
        release(spark)
        self.counts = spark.read.schema(_COUNTS).parquet(folder)
        # A few rows: of tokens one for the starts (0), each low count and all high ones; of pairs one for each low count.
        start = (F.col("kind") == 0) & (F.col("h") == _long(START))
        level = F.when(F.col("kind") == 5, F.col("h")).when(start, F.lit(0)).otherwise(F.least("c", F.lit(DISCOUNTED + 2)))
        found = self.counts.filter("kind IN (0, 5)").groupBy("kind", level.alias("level")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()
        words = {r["level"]: r for r in found if r["kind"] == 0}
        starts = words.pop(0)["c"] if 0 in words else 0  # the texts
        self.tokens, self.types, self.ends = sum(r["c"] for r in words.values()) + starts, sum(r["n"] for r in words.values()) + (starts > 0), starts
        self.single = discounts({level: r["n"] for level, r in words.items() if level <= DISCOUNTED + 1})
        self.pair = discounts({r["level"]: r["c"] for r in found if r["kind"] == 5})
        self.pair[: least - 1] = [0.0] * (least - 1)
        discounted = sum(r["c"] * ([*self.single, 1.0][min(level, DISCOUNTED + 1) - 1]) for level, r in sorted(words.items()))
        # The end is a type of its own and is left as it is. Discounts always leave something unless all counts are high.
        spare = 0.5 if self.tokens and self.tokens - discounted - starts < 1e-9 else 0.0
        self.mass = float(self.tokens + spare) or 1.0
        self.unknown = 1 - (discounted + starts) / self.mass if self.tokens else 1.0
        self.end = starts / self.mass if starts else 1.0

    def rows(self) -> DataFrame:
        """The tables in the form in which they meet the packs: earlier tokens and later ones, both with their own counts
        (the end's is not among them), and pairs."""
        words = self.counts.filter("kind = 0").select("bucket", "kind", "h", F.col("c").alias("w"))
        later = self.counts.filter("kind = 1").select("bucket", "kind", "h")
        later = later.join(words.select("h", "w"), "h", "left").select("bucket", "kind", "h", F.coalesce("w", F.lit(0)).alias("w"))
        return words.unionByName(later).unionByName(self.counts.filter("kind = 2").select("bucket", "kind", "pack"), allowMissingColumns=True)


def _score_packs(buckets: int):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in parts(batch.column("text"), PACK):
                part = batch.slice(begin, end - begin)
                earlier, later, row, n = _pairs(part.column("text"))
                keys = np.asarray(part.column("row"))
                found = [(b, _packed(earlier[at], later[at], row[at])) for b, at in _by_bucket(earlier, buckets)]
                size, whole, kind = len(found), len(keys), part.schema.field("id").type
                # The number of its first row names the part; its texts are counted from there.
                yield pa.RecordBatch.from_arrays([
                    pa.array([x[0] for x in found], pa.int32()), pa.array(np.full(size, 3, np.int8)), pa.array(np.full(size, keys[0], np.int64)), pa.nulls(size, pa.int64()),
                    pa.nulls(size, pa.int32()), pa.array([x[1] for x in found], pa.binary()), pa.nulls(size, kind), pa.nulls(size, pa.bool_())], names=_NAMES)
                # One row a text that carries its identifier, dealt over all buckets.
                yield pa.RecordBatch.from_arrays([
                    pa.array((keys % buckets).astype(np.int32)), pa.array(np.full(whole, 4, np.int8)), pa.array(np.full(whole, keys[0], np.int64)), pa.array(n.astype(np.int64)),
                    pa.array(np.arange(whole, dtype=np.int32)), pa.nulls(whole, pa.binary()), part.column("id"), part.column("held_out")], names=_NAMES)

    return walk


_NAMES = ["bucket", "kind", "h", "w", "place", "pack", "id", "held_out"]
_PARTIAL = ["part", "place", "n", "sums", "id", "held_out"]


def _bucket_scores(model: Model):
    """Of a bucket's rows in order of kind (0 earlier tokens, 1 later tokens, 2 pairs, 3 packs, 4 texts): partial sums for
    the texts of each pack, in one row, and the rows of kind 4.

    Holds the bucket's tables and one pack.
    """
    base_of = math.log10(model.tokens + 0.5 * (model.types + 1))
    unknown, end, mass, single, pair = model.unknown, model.end, model.mass, model.single, model.pair
    lost = math.log10(unknown)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, raw, ready, kind_of_id = None, {0: [], 1: [], 2: []}, None, None

        def listed(kind: int) -> tuple[np.ndarray, np.ndarray]:
            """Tokens in order, and their counts."""
            if not raw[kind]:
                return np.zeros(0, np.uint64), np.zeros(0, np.int64)
            token, count = (np.concatenate(x) for x in zip(*raw[kind], strict=True))
            order = np.argsort(token.view(np.uint64))
            return token.view(np.uint64)[order], count[order]

        def tables():
            """Of earlier tokens the counts, logarithms of what a pair's count is divided by, of a(h) and of p1; of pairs
            the keys, in order, and what a pair in the table gains over backing off."""
            (h, c), (w, own) = listed(0), listed(1)
            follow, after, times = (x.astype(np.int64) for x in (_loosened(raw[2][0]) if raw[2] else [np.zeros(0, np.int64)] * 3))
            place = np.repeat(np.arange(len(h)), follow)
            below = np.where(w == END, end, own * _factors(own, single) / mass)[after]
            kept = times * _factors(times, pair)
            left = np.bincount(place, kept, len(h))
            whole = np.where(c - left > 1e-9, c, c + 1.0)
            back = np.log10((1 - left / whole) / np.maximum(1 - np.bincount(place, below, len(h)), unknown))
            key = mixed(h)[place] + w[after]
            order = np.argsort(key)
            return h, c, np.log10(whole), back, np.log10(c * _factors(c, single) / mass), key[order], (np.log10(kept) - np.log10(below))[order]

        def found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if not len(keys):
                return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            return at, keys[at] == wanted

        def sums(pack: bytes, first: int) -> pa.RecordBatch:
            token, count, whole, back, p, pair, gain = ready
            h, w, hi, wi, text = _unpacked(pack, texts=True)
            at, known = found(token, h)
            is_start = h == START
            some = lambda x, other: np.where(known, x[at] if len(x) else 0.0, other)
            c = some(count, 0)
            base = np.where(is_start, 0, np.log10(c + 0.5) - base_of)
            own = some(back, 0.0) + np.where(is_start, 0, some(p, lost))
            seen_at, seen = found(pair, mixed(h)[hi] + w[wi])
            bonus = np.where(seen, (gain[seen_at] if len(gain) else 0.0) - (some(whole, 0.0) + some(back, 0.0))[hi], 0.0)
            n = int(text.max()) + 1
            held = np.flatnonzero(np.bincount(text, minlength=n))
            known, base, score = (np.bincount(text, x, n)[held] for x in ((known & ~is_start)[hi], base[hi], own[hi] + bonus))
            out = _squeezed(np.diff(held, prepend=0), known, base.view(np.uint64), score.view(np.uint64))
            return pa.RecordBatch.from_arrays([
                pa.array([first], pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.array([out], pa.binary()), pa.nulls(1, kind_of_id), pa.nulls(1, pa.bool_())], names=_PARTIAL)

        for batch in batches:
            kind_of_id = batch.schema.field("id").type
            buckets, kinds = (np.asarray(batch.column(c)) for c in ("bucket", "kind"))
            cuts = np.flatnonzero(np.append(True, (buckets[1:] != buckets[:-1]) | (kinds[1:] != kinds[:-1])))
            for low, high in zip(cuts.tolist(), [*cuts[1:].tolist(), len(kinds)], strict=True):
                part = batch.slice(low, high - low)
                if buckets[low] != bucket:
                    bucket, raw, ready = buckets[low], {0: [], 1: [], 2: []}, None
                kind = int(kinds[low])
                if kind < 2:
                    raw[kind].append([part.column(c).to_numpy(zero_copy_only=False) for c in ("h", "w")])
                elif kind == 2:
                    raw[2] += part.column("pack").to_pylist()
                elif kind == 3:
                    if ready is None:
                        ready = tables()
                    for first, pack in zip(part.column("h").to_pylist(), part.column("pack"), strict=True):
                        yield sums(pack.as_py(), first)
                else:
                    yield pa.RecordBatch.from_arrays([part.column("h"), part.column("place"), part.column("w"), pa.nulls(part.num_rows, pa.binary()), part.column("id"), part.column("held_out")], names=_PARTIAL)

    return walk


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of part: the sums of each of its texts. Holds one part, whose size PACK bounds."""
    part, texts, sums = None, [], []

    def flush() -> pa.RecordBatch:
        table = pa.Table.from_batches(texts).combine_chunks()
        place = table.column("place").to_numpy()
        n = int(place.max()) + 1
        total = {"known": np.zeros(n, np.int64), "base": np.zeros(n), "score": np.zeros(n)}
        for x in sums:
            step, known, base, score = _loosened(x)
            at = np.cumsum(step.astype(np.int64))
            for name, some in (("known", known.astype(np.int64)), ("base", base.view("<f8")), ("score", score.view("<f8"))):
                total[name][at] += some
        columns = [table.column(c).chunk(0) for c in ("id", "held_out", "n")]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(total[c][place]) for c in ("base", "score", "known"))], names=["id", "held_out", "n", "base", "score", "known"])

    for batch in batches:
        parts_here = np.asarray(batch.column("part"))
        cuts = np.flatnonzero(np.append(True, parts_here[1:] != parts_here[:-1])) if len(parts_here) else parts_here
        for low, high in zip(cuts.tolist(), [*cuts[1:].tolist(), len(parts_here)], strict=True):
            if parts_here[low] != part:
                if texts:
                    yield flush()
                part, texts, sums = parts_here[low], [], []
            rows = batch.slice(low, high - low)
            is_text = rows.column("sums").is_null()
            texts.append(rows.filter(is_text))
            sums += [x.as_py() for x in rows.column("sums").drop_null()]
    if texts:
        yield flush()


def scored(docs: DataFrame, held_out: Column, identifier: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """One row for each row: its identifier, `held_out`, `n_tokens`, `n_known`, `train_tokens`, `base_score` and `score`.
    The model learns from the rows that are not held out."""
    model = Model(docs, ~held_out, text, least)
    release(docs.sparkSession)  # the counting's packs, now that the counts are stored and read
    kind = docs.schema[identifier].dataType.simpleString()
    # The row numbers hold within this one job, which is where packs and identifiers part and meet again.
    source = docs.select(F.col(identifier).alias("id"), text_of(text).alias("text"), held_out.alias("held_out")).withColumn("row", F.monotonically_increasing_id())
    packs = source.mapInArrow(_score_packs(model.buckets), f"bucket int, kind byte, h long, w long, place int, pack binary, id {kind}, held_out boolean")
    met = model.rows().unionByName(packs, allowMissingColumns=True).repartitionById(model.buckets, F.col("bucket")).sortWithinPartitions("bucket", "kind")
    partial = met.mapInArrow(_bucket_scores(model), f"part long, place int, n long, sums binary, id {kind}, held_out boolean")
    by_part = partial.repartition("part").sortWithinPartitions("part")
    total = by_part.mapInArrow(_totals, f"id {kind}, held_out boolean, n long, base double, score double, known long")
    base_of_end = math.log10((model.ends + 0.5) / (model.tokens + 0.5 * (model.types + 1)))
    return total.select(
        F.col("id").alias(identifier), "held_out", F.col("n").alias("n_tokens"), (F.col("known") + F.lit(int(model.ends > 0)).cast("long")).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") + base_of_end).alias("base_score"), (F.col("score") + math.log10(model.end)).alias("score"))

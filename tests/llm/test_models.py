"""Language identification, toxicity and the language model: held-out accuracy, exact values and edges."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from payouts.llm import katz, language_codes, queries, toxicity

from .conftest import ROWS

SMALL = "/root/testdata/sf0.01"


def test_languages_of_held_out_documents(spark):
    found = queries.op1_language_id(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = found.groupBy("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("share"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in right) == 1000 and {r["held_out"] for r in right} == {True, False}
    assert all(r["share"] >= 0.98 for r in right)


def test_languages_at_the_edges(spark, edge_docs, no_docs, sample):
    model = language_codes.train(sample)
    found = language_codes.identified(edge_docs, model)
    assert found.columns == ["doc_id", "lang_pred", "score", "ambiguous"] and found.count() == len(ROWS)
    by_id = {r["doc_id"]: r for r in found.collect()}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (1, 2, 3))
    assert by_id[11]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in by_id.values())
    assert language_codes.identified(no_docs, model).count() == 0
    none = language_codes.train(sample.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in language_codes.identified(edge_docs, none).collect()} == {"und"}
    one = language_codes.train(sample.withColumn("lang", F.lit("xx")))
    assert {r["lang_pred"] for r in language_codes.identified(edge_docs, one).collect()} == {"xx", "und"}


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 12, 40])
def test_codewords_are_apart(n):
    code = language_codes.codewords(n)
    apart = min((a != b).sum() for i, a in enumerate(code) for b in code[:i])
    assert code.shape[0] == n and apart >= (1 if n == 2 else code.shape[1] // 4)
    assert all(0 < s < n for s in code.sum(axis=0))


def test_slices_do_not_change_trigrams(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["Ünï one two", "", None, "x", "three four five"])
    whole = [np.concatenate(x) for x in zip(*language_codes._trigrams(texts), strict=True)]
    for size in (1, 3, 7):
        monkeypatch.setattr(language_codes, "_SLICE", size)
        pieces = [np.concatenate(x) for x in zip(*language_codes._trigrams(texts), strict=True)]
        assert all((a == b).all() for a, b in zip(whole, pieces, strict=True))


def test_toxicity_of_held_out_documents(spark):
    """Words that mark toxic documents are found; labels that no word explains are noise."""
    folder = "/root/testdata/sf0.1"
    found = queries.op6_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    caught, clean = found[found.toxic == 1].predicted, found[found.toxic == 0].predicted
    assert caught.mean() > 0.65 and clean.mean() < 0.02


def test_toxicity_at_the_edges(spark, edge_docs, no_docs):
    docs = spark.createDataFrame([(i, "plain words are here" if i % 3 else "plain idiot words are here") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(None, 1), (1, None), (9999, 1), (0, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, model).collect()}
    assert all((scores[i] >= toxicity.THRESHOLD) == (i % 3 == 0) for i in range(300))
    assert len(model[0]) < 30
    again = toxicity.train(docs.repartition(7), labels.repartition(3))
    assert (again[0] == model[0]).all() and np.allclose(again[1], model[1])
    found = toxicity.scored(edge_docs, model)
    assert found.columns == [*edge_docs.columns, "_score"] and found.count() == len(ROWS)
    assert found.filter("_score < 0 OR _score > 1 OR _score IS NULL").count() == 0
    assert toxicity.scored(no_docs, model).count() == 0
    for nothing in (toxicity.train(docs, labels.limit(0)), toxicity.train(docs.limit(0), labels)):
        assert {r["score"] for r in toxicity.scored(docs, nothing).collect()} == {0.0}


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + [None]


class Brute:
    def __init__(self, texts):
        single, pair, self.earlier = Counter(), Counter(), Counter()
        for text in texts:
            before = "<start>"
            for t in tokens(text):
                single[t] += 1
                pair[before, t] += 1
                self.earlier[before] += 1
                before = t
        self.single, self.n, self.v = single, sum(single.values()), len(single)
        one = katz.discounts(Counter(c for t, c in single.items() if t is not None))
        two = [0.0, *katz.discounts(Counter(pair.values()))[1:]]
        kept = {t: c * (one[c - 1] if c <= katz.DISCOUNTED and t is not None else 1) for t, c in single.items()}
        mass = self.n if not self.n or self.n - sum(kept.values()) > 1e-9 else self.n + 0.5
        self.p = {t: k / mass for t, k in kept.items()}
        self.unknown = 1 - sum(self.p.values())
        self.table = {k: c * (two[c - 1] if c <= katz.DISCOUNTED else 1) for k, c in pair.items() if c >= katz.LEAST}
        self.left, self.used = defaultdict(float), defaultdict(float)
        for (h, w), d in self.table.items():
            self.left[h] += d
            self.used[h] += self.p[w]

    def chance(self, h, w):
        below = self.p.get(w, self.unknown)
        if h not in self.earlier:
            return below
        whole = self.earlier[h] if self.earlier[h] - self.left[h] > 1e-9 else self.earlier[h] + 1
        if (h, w) in self.table:
            return self.table[h, w] / whole
        return (1 - self.left[h] / whole) / max(1 - self.used[h], self.unknown) * below

    def row(self, text):
        base = score = known = 0
        before = "<start>"
        for t in tokens(text):
            base += math.log10((self.single.get(t, 0) + 0.5) / (self.n + 0.5 * (self.v + 1)))
            score += math.log10(self.chance(before, t))
            known += t in self.single
            before = t
        return len(tokens(text)), known, self.n, base, score


def check_scores(docs, rows, held):
    found = katz.scored(docs, toxicity.held_out("doc_id", 5, 1)).collect()
    model = Brute([t for i, t in rows if not held(i)])
    wanted = sorted(((i, held(i), *model.row(t)) for i, t in rows), key=lambda r: (str(r[0]), r[2], r[5]))
    assert len(found) == len(wanted)
    for a, b in zip(sorted(map(tuple, found), key=lambda r: (str(r[0]), r[2], r[5])), wanted, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-6)
    return model


def of_fifth(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def test_katz_scores_equal_brute_force(sample):
    model = check_scores(sample, [(r["doc_id"], r["text"]) for r in sample.collect()], of_fifth)
    for h in ("<start>", "the", "of", "de"):  # the probabilities of all words and the unknown one sum to 1
        assert sum(model.chance(h, w) for w in model.p) + model.chance(h, "never seen") == pytest.approx(1)


def test_katz_at_the_edges(spark, edge_docs, no_docs, monkeypatch):
    monkeypatch.setattr(katz, "PACK", 100)
    check_scores(edge_docs, ROWS, of_fifth)
    assert katz.scored(no_docs, F.lit(False)).count() == 0
    untrained = katz.scored(edge_docs, F.lit(True)).collect()
    assert len(untrained) == len(ROWS) and {(r["n_known"], r["train_tokens"], r["score"]) for r in untrained} == {(0, 0, 0.0)}


def test_discounts_lie_between_zero_and_one():
    for low in ({}, {1: 5}, {1: 10, 2: 20, 3: 1}, {r: 1000 // r**2 for r in range(1, 8)}, {r: 5 for r in range(1, 8)}):
        assert all(0 < d < 1 for d in katz.discounts(low))


def test_katz_query_keeps_pairs_seen_once(spark, sample):
    """The query's scores are those of a table of all pairs, each with its discount."""
    texts = [(r["doc_id"], r["text"]) for r in sample.collect()]
    model = Brute([t for i, t in texts if not of_fifth(i)])
    pair = Counter((h, w) for i, t in texts if not of_fifth(i) for h, w in zip(["<start>", *tokens(t)], tokens(t), strict=False))
    factors = katz.discounts(Counter(pair.values()))
    model.table = {k: c * (factors[c - 1] if c <= katz.DISCOUNTED else 1) for k, c in pair.items()}
    model.left, model.used = defaultdict(float), defaultdict(float)
    for (h, w), d in model.table.items():
        model.left[h] += d
        model.used[h] += model.p[w]
    found = {r["doc_id"]: r["score"] for r in queries.op10_katz_backoff(spark, "/root/testdata/sf0.001").collect()}
    assert found == pytest.approx({i: model.row(t)[4] for i, t in texts}, abs=1e-6)


def test_katz_stores_few_bytes_for_a_pair(spark, tmp_path, monkeypatch):
    """Files hold counts and small numbers, no probability or hash for each pair."""
    monkeypatch.setattr(katz, "new_folder", lambda _, name: f"{tmp_path}/{name}")
    texts = [" ".join(f"w{i}" for i in np.random.default_rng(n).zipf(1.3, 400) % 20_000) for n in range(600)]
    model = katz.Model(spark.createDataFrame([(t,) for t in texts], "text string"), F.lit(True), least=1)
    pairs = {pair for t in texts for pair in zip(["<start>", *tokens(t)], tokens(t), strict=False)}
    stored = sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    assert (model.tokens, model.ends) == (600 * 401, 600) and stored < 10 * len(pairs)


def test_packs_hold_what_was_packed():
    wide = [np.array(x, np.uint64) for x in ([], [0, 0], [255, 256, 65_536], [2**64 - 1, 1], range(1000))]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(wide, katz._loosened(katz._squeezed(*wide)), strict=True))
    assert len(katz._loosened(katz._squeezed(wide[0]))[0]) == 0
    rng = np.random.default_rng(1)
    earlier, later = (rng.integers(2**63, 2**63 + 40, 5000, np.uint64) for _ in range(2))
    text = np.sort(rng.integers(0, 300, 5000)).astype(np.int32)
    h, w, hi, wi, number = katz._unpacked(katz._packed(earlier, later, text), texts=True)
    assert (h[hi] == earlier).all() and (w[wi] == later).all() and (number == text).all()
    h, w, hi, wi, number = katz._unpacked(katz._packed(earlier, later, None), texts=False)
    assert dict(zip(zip(h[hi].tolist(), w[wi].tolist(), strict=True), number.tolist(), strict=True)) == Counter(zip(earlier.tolist(), later.tolist(), strict=True))


def test_trigrams_of_a_text_do_not_depend_on_its_neighbours(monkeypatch):
    import pyarrow as pa

    texts = ["ab", "", "cde", None, "ab"]
    alone = [n for t in texts for some, _ in language_codes._trigrams(pa.array([t], pa.string())) for n in some.tolist()]
    for size in (1, 2, 1 << 20):
        monkeypatch.setattr(language_codes, "_SLICE", size)
        assert [n for some, _ in language_codes._trigrams(pa.array(texts)) for n in some.tolist()] == alone

"""Exact and near duplicates against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from payouts.llm import common, content_sort, jaccard_join

from .conftest import ROWS


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def last(i):
    return (i is None, i or 0)


def expected_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append(i)
    return groups


def check_groups(rows, found):
    groups = expected_groups(rows)
    assert len(found) == len(rows)
    stays = defaultdict(int)
    for r in found:
        text = next(t for t, ids in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        assert r["group_size"] == len(groups[text]) and r["keep_id"] == min(groups[text], key=last) and r["doc_id"] in groups[text]
        stays[text] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert all(stays[t] == 1 for t in groups)


def test_exact_groups_at_the_edges(edge_docs, no_docs):
    check_groups(ROWS, content_sort.exact_groups(edge_docs).collect())
    assert content_sort.exact_groups(no_docs).count() == 0


def test_exact_groups_cross_many_ranges(spark):
    """Half of the rows are copies of one text, so that its rows fill several ranges."""
    random.seed(5)
    rows = [(i, "one common text  of some length" if i % 2 else f"text {random.randrange(200)}") for i in range(3000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        check_groups(rows, content_sort.exact_groups(docs).collect())
        kept = content_sort.exact_dedup(docs.selectExpr("*", "doc_id AS edge", "1 AS part"))
        assert kept.columns == ["doc_id", "text", "edge", "part"]
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(min(ids) for ids in expected_groups(rows).values())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows):
    """(set size, smallest linked identifier) of each row."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    smallest = {}
    for k, (i, _) in enumerate(rows):
        smallest[find(k)] = min(smallest.get(find(k), i), i, key=last)
    return [(i, len(sets[k]), smallest[find(k)]) for k, (i, _) in enumerate(rows)]


def compare(found, rows):
    assert sorted((tuple(r) for r in found), key=str) == sorted(brute_components(rows), key=str)


def test_similar_components_at_the_edges(edge_docs, no_docs):
    compare(jaccard_join.similar_components(edge_docs).collect(), ROWS)
    assert jaccard_join.similar_components(no_docs).count() == 0


def near_copies(seed):
    """Groups of edited copies, chains that only link step by step, and a passage that many unrelated texts share."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(100_000)}"
    passage, rows = [word() for _ in range(30)], []
    for _ in range(6):
        text = [word() for _ in range(rng.randrange(20, 120))]
        for _ in range(rng.randrange(1, 40)):
            for _ in range(rng.randrange(4)):
                text[rng.randrange(len(text))] = word()
            rows.append(list(text) if rng.random() < 0.6 else text + [word() for _ in range(len(text) // 4)])
    for _ in range(60):
        own = [word() for _ in range(rng.randrange(1, 60))]
        rows.append(own + passage[: rng.randrange(31)] if rng.random() < 0.7 else passage + own[:3])
    rng.shuffle(rows)
    return [(i, " ".join(r)) for i, r in enumerate(rows)]


@pytest.mark.parametrize(("seed", "few", "block"), [(1, 8, 2048), (2, 0, 16), (3, 1_000_000, 2048)])
def test_similar_components_equal_brute_force(spark, monkeypatch, seed, few, block):
    """Open tokens pair by pair, block by block, and in both ways."""
    monkeypatch.setattr(jaccard_join, "FEW", few)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = near_copies(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    compare(jaccard_join.similar_components(docs).collect(), rows)
    if few == 8:
        kept = jaccard_join.one_of_each(docs.selectExpr("*", "1 AS kept_id"))
        assert kept.columns == ["doc_id", "text", "kept_id"]
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in brute_components(rows)})


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(7, 7), (3, 9)], "a long, b long")
    assert {r["node"]: r["comp"] for r in jaccard_join.components(edges).collect()} == {**{i: 100 for i in range(100, 161)}, 3: 3, 9: 3}
    assert jaccard_join.components(edges.limit(0)).count() == 0


def test_one_of_each_drops_near_copies_that_share_or_lack_an_identifier(spark):
    """{1: A, 5: A+1 word, 5: B, null: A+1 word, null: C}: A's near copies go whatever their identifier."""
    a = " ".join(f"word{i}" for i in range(40))
    b = " ".join(f"other{i}" for i in range(40))
    c = " ".join(f"third{i}" for i in range(40))
    rows = [(1, a), (5, a + " extra"), (5, b), (None, a + " extra"), (None, c), (7, b + " more"), (7, b + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "1 AS _kept_id", "2 AS _text_key")
    kept = sorted(((r.doc_id, r.text) for r in jaccard_join.one_of_each(docs).collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    assert kept == [(1, a), (5, b), (None, c)]
    assert set(jaccard_join.one_of_each(docs).columns) == set(docs.columns)


@pytest.mark.parametrize("bits", [None, 128])
def test_a_sieve_loses_no_key(spark, monkeypatch, bits):
    if bits:
        monkeypatch.setattr(common, "SIEVE", bits)  # more keys than it holds
    frame = spark.range(20000).selectExpr("id AS _word", "nullif(id % 4000, 0) AS k")
    keys = spark.range(1000).selectExpr("nullif(id, 0) AS k")
    found = common.sieved(frame, F.xxhash64("k"), keys, F.xxhash64("k"), "maybe")
    assert found.columns == ["_word", "k", "maybe"]
    rows = found.collect()
    assert len(rows) == 20000 and all(r["maybe"] for r in rows if r["k"] is None or r["k"] < 1000)
    if not bits:
        assert sum(r["maybe"] for r in rows) < 5000 + 15000 / 8
    assert not common.sieved(frame, F.xxhash64("k"), keys.limit(0), F.xxhash64("k"), "maybe").filter("maybe").count()


def test_texts_are_sieved_and_each_comparison_has_its_own_files(spark, sample, monkeypatch):
    plans = []
    cut = jaccard_join.cut

    def noted(frame):
        plans.append(frame._jdf.queryExecution().optimizedPlan().toString())
        return cut(frame)

    monkeypatch.setattr(jaccard_join, "cut", noted)
    jaccard_join.one_of_each(sample.limit(100))
    assert [p for p in plans if "tokens" in p and "getbit" in p and "MapInArrow" in p]  # the texts of the wanted rows
    assert max(p.count("MapInArrow walk") for p in plans) == 1

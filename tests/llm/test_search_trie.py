"""Lexical search, phrase fingerprints and the conversation trie against brute force and at their edges."""

import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from payouts.llm import lexical_search, phrase_prints, prefix_trie, ranking

from .conftest import ROWS

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_search(docs, items, top=10):
    bags = [(d, TERM.findall(lower(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    big_n, big_l = len(bags), sum(len(b) for _, b in bags)
    df = {}
    for _, b in bags:
        for t in set(b):
            df[t] = df.get(t, 0) + 1
    out = set()
    for item, text in set(items):
        scores = []
        for key, (d, b) in enumerate(bags):
            m = 25 + (75 * len(b) * big_n) // big_l
            s = 0
            for q in TERM.findall(lower(text)):
                tf = b.count(q)
                if tf:
                    s += math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[q] + 1))) * ((10**9 * tf) // (1000 * tf + 8 * m))
            if s > 0:
                scores.append((-s, d is None, d if d is not None else 0, key, d, s))
        for rank, row in enumerate(sorted(scores)[:top], 1):
            out.add((item, rank, row[4], row[5]))
    return out


ITEMS = [(1, "the quick brown fox"), (2, "LOREM ipsum lorem"), (3, None), (4, ""), (5, "nothing matches zzzq"), (None, "same text of five words"), (1, "the quick brown fox")]


def test_search_equals_brute_force_at_the_edges(spark, edge_docs, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 AS ikey", "2 AS term", "3 AS k")
    got = {tuple(r) for r in lexical_search.search(edge_docs, items).collect()}
    assert got == brute_search(ROWS, ITEMS)
    assert lexical_search.search(no_docs, items).count() == 0
    assert lexical_search.search(edge_docs, items.limit(0)).count() == 0


def test_search_pruning_loses_nothing_on_a_corpus(spark, sample):
    """The bounds open few groups, yet the ranking equals brute force over all documents."""
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    docs = [(r.doc_id, r.text) for r in sample.select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in bench.collect()]
    got = {tuple(r) for r in lexical_search.search(sample, bench).collect()}
    assert got == brute_search(docs, items)
    assert len(got) == 10 * len({i for i, _ in items})


def test_positions_and_list_ranking(spark):
    frame = spark.createDataFrame([(i % 7, i) for i in range(200)], "a long, b long").repartition(5)
    ranked = {(r.a, r.b): r.position for r in ranking.positions(frame, [F.col("a"), F.col("b")]).collect()}
    assert [ranked[k] for k in sorted(ranked)] == list(range(200))
    assert ranking.positions(frame.limit(0), [F.col("a")]).count() == 0
    # two lists: 0 -> 1 -> ... -> 99 and 100 -> ... -> 149, weights equal to the node
    arcs = spark.createDataFrame([(i, i + 1 if i not in (99, 149) else None, i) for i in range(150)], "node long, succ long, w long")
    got = {r.node: (r.w, r.steps) for r in ranking.list_ranked(arcs, "node", "succ", ["w"]).collect()}
    for i in range(150):
        end = 100 if i < 100 else 150
        assert got[i] == (sum(range(i, end)), end - i)


# ---------------------------------------------------------------- fingerprints


def brute_prints(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    out = {}
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 4
        edited = t[: len(t) - k] + nxt[:k]
        own, changed, after = phrase_prints.fingerprint(t), phrase_prints.fingerprint(edited), phrase_prints.fingerprint(nxt)
        out.setdefault(d, set()).add((len(t), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own, changed,
                                      phrase_prints.likeness(own, changed), phrase_prints.likeness(own, after)))
    return out


def test_fingerprints_equal_brute_force(spark):
    rows = [(3, "alpha beta gamma delta epsilon zeta eta theta"), (1, None), (2, ""), (4, "x" * 5003), (5, "alpha beta gamma delta epsilon zeta eta theta"),
            (None, "no id here at all"), (6, "Ünïcödé \U0001f642 text with some words and more words and more"), (7, "abc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "1 AS rid", "2 AS head", "3 AS rank")
    got = {}
    for r in phrase_prints.fingerprints(docs).collect():
        got.setdefault(r.doc_id, set()).add((r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next))
    assert got == brute_prints(rows)
    assert phrase_prints.fingerprints(docs.limit(0)).count() == 0
    one = phrase_prints.fingerprints(docs.filter("doc_id = 3")).first()
    alone = rows[0][1][: 45 - 45 // 4] + rows[0][1][: 45 // 4]  # followed by itself
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(alone.encode()).hexdigest()


def test_fingerprint_properties():
    text = " ".join(f"w{i % 37} v{i % 11}" for i in range(3000))
    assert phrase_prints.fingerprint(text) == phrase_prints.fingerprint(text)
    assert phrase_prints.fingerprint("") == phrase_prints.EMPTY == phrase_prints.fingerprint(None)
    edited, own, changed = phrase_prints.edited_pair(text, "completely different words " * 40)
    own, changed = own.hex(), changed.hex()
    assert own == phrase_prints.fingerprint(text) and changed == phrase_prints.fingerprint(edited)
    assert phrase_prints.likeness(own, changed) > phrase_prints.likeness(own, phrase_prints.fingerprint("unrelated tokens only " * 50))
    assert len(phrase_prints.fingerprint("日本語のテキスト" * 5000)) == 8 * phrase_prints.K  # no spaces: pieces of 8


# ---------------------------------------------------------------- trie


def brute_trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn, role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(ts, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))] for c, ts in convs.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = own.get(c - int(math.fmod(c, 5)), [])
        built[c] = base[:h] + ts[h:]
    nodes = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    out = set()
    for key, members in nodes.items():
        d = len(key)
        children = [k for k in nodes if len(k) == d + 1 and k[:d] == key]
        sub = [k for k in nodes if len(k) >= d and k[:d] == key]
        leaves = sum(1 for k in sub if not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in nodes))
        saved = sum((len(nodes[k]) - 1) * (len(k[-1][1].encode()) if k else 0) for k in sub)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(built[c]) == d))
        parent = min(nodes[key[:-1]]) if d else None
        out.add((min(members), d, parent, len(members), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


CONV = [
    (0, 0, "user", "hello"), (0, 1, "assistant", "hi there"), (0, 2, "user", "long " * 3000), (0, None, "system", "first"),
    (1, 0, "user", "hello"), (1, 1, "assistant", "different"), (2, 5, None, None), (3, 0, "user", "hello"), (3, 0, "user", "hello"),
    (7, 0, "user", "x"), (11, 1, "user", "y"), (11, 1, "assistant", "y"), (None, 0, "user", "orphan"), (12, 0, "user", "Ünï \U0001f642"),
    (10, 0, "user", "hello"), (10, 1, "assistant", "hi there"), (15, 3, "user", "z"),
]


def test_trie_equals_brute_force(spark):
    frame = spark.createDataFrame(CONV, "conv_id long, turn long, role string, text string").repartition(3).selectExpr("*", "1 AS depth", "2 AS s1", "3 AS id", "4 AS pos")
    got = {tuple(r) for r in prefix_trie.trie(frame).drop("tour_enter", "tour_exit").collect()}
    assert got == brute_trie(CONV)
    assert prefix_trie.trie(frame.limit(0)).count() == 0


def test_trie_tour_positions_nest(spark):
    frame = spark.createDataFrame(CONV, "conv_id long, turn long, role string, text string")
    rows = prefix_trie.trie(frame).collect()
    spans = sorted((r.tour_enter, r.tour_exit) for r in rows)
    assert sorted(p for s in spans for p in s) == list(range(2 * len(rows)))
    for a, b in spans:  # subtrees nest or are apart
        for c, d in spans:
            assert b < c or d < a or (a <= c and d <= b) or (c <= a and b <= d)


@pytest.mark.parametrize("name", ["op11_lexical_search", "op13_prefix_trie"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from payouts.llm.queries import ORACLE, QUERIES
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = {tuple(None if v != v else v for v in r) for r in con.execute(ORACLE[name]).fetchall()}
    got = QUERIES[name](spark, folder)
    cols = [d[0] for d in con.execute(ORACLE[name]).description]
    assert {tuple(r) for r in got.select(*cols).collect()} == want

"""Benchmark, secret and license scans against brute force."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from payouts.llm import blob_ledger, decontaminate, license_windows

from .conftest import ROWS

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(text, items):
    tokens, covered, found = words(text), set(), set()
    for item, t in items:
        own = words(t)
        width = min(10, len(own))
        grams = {tuple(own[i:i + width]) for i in range(len(own) - width + 1)} if own else set()
        for i in range(len(tokens) - width + 1):
            if tuple(tokens[i:i + width]) in grams:
                covered |= set(range(i, i + width))
                found.add(str(item))
    return len(tokens), len(covered), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(covered)


ITEMS = [(1, "Quick brown FOX"), (2, None), (3, ""), (20, "nobody looks"), (4, "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam lorem ipsum"), (5, "nobody looks"), (None, "word")]


@pytest.mark.parametrize("most", [500_000, 0])
def test_contamination_at_the_edges(spark, edge_docs, no_docs, most):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 AS id", "2 AS tokens")
    found = decontaminate.contamination(edge_docs, benchmark, broadcast_windows=most).collect()
    wanted = [(i, *brute_hits(t, [x for x in ITEMS if x[0] is not None])) for i, t in ROWS]
    assert sorted(map(tuple, found), key=str) == sorted(wanted, key=str)
    assert decontaminate.contamination(no_docs, benchmark, broadcast_windows=most).count() == 0
    assert decontaminate.contamination(edge_docs, benchmark.limit(0), broadcast_windows=most).filter("contaminated").count() == 0


def test_clean_documents_and_spans(spark, edge_docs):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontaminate.clean_documents(edge_docs, benchmark)
    assert kept.columns == edge_docs.columns
    clean = [i for i, t in ROWS if not brute_hits(t, [x for x in ITEMS if x[0] is not None])[4]]
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(clean, key=str)
    cut = decontaminate.clean_spans(edge_docs, benchmark)
    assert cut.columns == edge_docs.columns and cut.count() == len(ROWS)
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert texts[11] == "the  jumps over the lazy dog while  at all" and texts[12].startswith("THE ") and texts[4] == "word" and texts[1] is None
    assert decontaminate.contamination(cut, benchmark).filter("contaminated").count() == 0


RULES = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
SECRETS = [
    (1, "secret: token: abcdefg PASSWORD = 'hunter2hunter2' api_key=\"x\" apikey=abcdef"), (2, "\U0001f642 AKIA" + "A" * 16 + " AKIA" + "B" * 15 + " " + "a1" * 12 + "\n" + "b" * 23),
    (3, None), (4, "x"), (5, "-----BEGIN RSA PRIVATE KEY-----"), (6, "\U0001f642 AKIA" + "A" * 16 + " AKIA" + "B" * 15 + " " + "a1" * 12 + "\n" + "b" * 23), (7, "token=AKIA" + "C" * 20),
    (1, "secret: token: abcdefg PASSWORD = 'hunter2hunter2' api_key=\"x\" apikey=abcdef"), (8, "toKen=abcdefghi ſecret=abcdefgh"),
]


def brute_spans(text, kinds):
    found = []
    for place, kind in enumerate(kinds):
        pattern, group, least = RULES[kind]
        found += [(m.start(), place, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return ",".join(x[2] for x in sorted(found))


def test_secret_scan_and_ledger(spark, edge_docs, tmp_path):
    docs = spark.createDataFrame(SECRETS, "doc_id long, text string").selectExpr("*", "'x' AS blob", "1 AS findings")
    ledger = str(tmp_path / "ledger")
    found = blob_ledger.scan(docs, ledger).withColumn("base", blob_ledger.listed(F.col("findings"), list(RULES))).collect()
    assert sorted((r["doc_id"], r["base"]) for r in found) == sorted((i, brute_spans(t, RULES)) for i, t in SECRETS)
    assert {r["doc_id"]: [list(s) for s in r["findings"].get("pem", [])] for r in found}[5] == [[0, 31]]
    rows = spark.read.parquet(ledger)
    blobs = len({t or "" for _, t in SECRETS})
    assert rows.count() == rows.dropDuplicates(["blob", "kind", "version"]).count() == blobs * len(blob_ledger.RULES)
    # Only what is new is scanned: one more blob, then one more rule version.
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(9, "passwd: zzzzzzzz")], "doc_id long, text string"))
    again = blob_ledger.scan(more, ledger)
    assert again.count() == len(SECRETS) + 1 and spark.read.parquet(ledger).count() == (blobs + 1) * len(blob_ledger.RULES)
    assert again.filter("doc_id = 9").first()["findings"]["assign"][0]["end"] == 16
    changed = (*blob_ledger.RULES[1:], blob_ledger.Rule("assign", 2, "(z+)", 1, 8))
    newest = blob_ledger.scan(more, ledger, rules=changed)
    assert [tuple(s) for s in newest.filter("doc_id = 9").first()["findings"]["assign"]] == [(8, 16)]
    assert spark.read.parquet(ledger).count() == (blobs + 1) * (len(blob_ledger.RULES) + 1)
    assert blob_ledger.scan(edge_docs, str(tmp_path / "other")).count() == len(ROWS)
    assert blob_ledger.scan(edge_docs.limit(0), ledger).count() == 0


LICENSED = [
    (1, "Text before.\nLicensed under the Apache License, Version 2.0.\nText after."), (2, "licensed UNDER cc by-nc 4.0!"), (3, None), (4, "Released under the MIT"),
    (5, "a " * 500 + "Released under the MIT License. " + "b " * 500 + "Released under the MIT License."), (6, "Licensed under"), (7, "the Apache License, Version 2.0"),
    (8, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files (the \"Software\"), to deal in the Software without restriction"),
]


def test_license_windows(spark, edge_docs, no_docs):
    found = {r["doc_id"]: r for r in license_windows.scanned(spark.createDataFrame(LICENSED, "doc_id long, text string").selectExpr("*", "1 AS id")).collect()}
    assert {i: r["licenses"] for i, r in found.items()} == {1: "Apache-2.0", 2: "CC-BY-NC-4.0", 3: "", 4: "", 5: "MIT", 6: "", 7: "", 8: "MIT"}
    assert found[1]["spans"] == "Apache-2.0:2:9" and found[5]["spans"] == "MIT:500:504,MIT:1005:1009" and found[5]["n_matches"] == 2
    assert license_windows.scanned(edge_docs).count() == len(ROWS)
    assert license_windows.scanned(no_docs).count() == 0


def test_license_lines_of_the_sample(sample):
    lines = {"Apache-2.0": "licensed under the apache license, version 2.0", "MIT": "released under the mit license", "CC-BY-NC-4.0": "licensed under cc by-nc 4.0",
             "GPL-3.0-only": "licensed under the gnu general public license, version 3"}
    wanted = {r["doc_id"]: ",".join(sorted(k for k, v in lines.items() if v in r["text"].lower())) for r in sample.collect()}
    assert {r["doc_id"]: r["licenses"] for r in license_windows.scanned(sample).collect()} == wanted


NOTICES = [
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "GPL-3.0-or-later"),
    ("This is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "GPL-2.0-or-later"),
    ("GNU GENERAL PUBLIC LICENSE\n Version 2, June 1991\n Copyright (C) 1989", "GPL-2.0-only"), ("licensed under the GNU Affero General Public License, version 3", "AGPL-3.0-only"),
    ("Licensed under CC BY-SA 4.0", "CC-BY-SA-4.0"), ("Licensed under CC BY 4.0", "CC-BY-4.0"), ("Released under MIT License", "MIT"), ("This is free and unencumbered software, released into the public domain. Anyone is free to copy, change, publish, use, compile, sell, or distribute this software", "Unlicense"),
    (license_windows._CLAUSES + " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS", "BSD-2-Clause"),
    (license_windows._CLAUSES + " Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "BSD-3-Clause"),
]


def test_altered_notices(spark):
    docs = spark.createDataFrame([(i, f"some words first {x} and some after") for i, (x, _) in enumerate(NOTICES)], "doc_id long, text string")
    found = {r["doc_id"]: r["licenses"] for r in license_windows.scanned(docs).collect()}
    assert found == {i: name for i, (_, name) in enumerate(NOTICES)}

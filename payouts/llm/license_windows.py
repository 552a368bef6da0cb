"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

A text's words (letters and digits, A-Z in lower case) pass in windows of twice the length of a template or a little
more, each starting half a window after the last, so every occurrence of a template lies in a whole window. A window
and a template that it holds share three tenths of their shingles or more, and with 40 bands of one row each they miss
each other with a probability under one in a million. What is retrieved is verified exactly: the share of the
template's distinct shingles that the window has, within one text. Short templates have shingles of two words. What
tells a license from its kin (a version, a clause) must stand in the match, or must not follow it.

Defined results: a missing text, or one without words, has no license; matches of one template that overlap are one;
different templates are reported independently; each row has its own result, repeated rows included; an empty table
gives an empty result; further columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from payouts.llm.common import text_of
from payouts.llm.text_arrays import BLOCK, LOWER_BYTES, gram_hashes, mixed, parts, range_hashes, text_bytes, word_ranges
from payouts.llm.toxicity import _OUTSIDE

SHINGLE = 3
#: Templates of fewer words have shingles of one word less.
SHORT = 16
BANDS = 40
CONTAINED = 0.8
#: Words after a match in which a phrase of another license is looked for.
AFTER = 120
_FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation, "
_LIBRARY = "This library is free software; you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation; "
_LATER = "either version {} of the License, or (at your option) any later version"
_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_CLAUSES = _CONDITIONS + """: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
    Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_NAMES = "may be used to endorse or promote products derived from"
_GNU = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}
#: By SPDX identifier, texts of license notices and of the licenses, those of long licenses by their heading and opening
#: (fixed values): the text, phrases that a match must hold, and phrases that must not be in it or follow it.
TEMPLATES: dict[str, list[str | tuple[str, list[str], list[str]]]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0", "Licensed under the Apache 2.0 License", "Released under the Apache License 2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ],
    "MIT": [
        "Released under the MIT License", "Licensed under the MIT License", "Released under MIT License", "Licensed under MIT License", "This project is licensed under the terms of the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ],
    "CC0-1.0": [("Licensed under CC0 1.0 Universal", ["CC0 1.0"], []), ("Creative Commons CC0 1.0 Universal Public Domain Dedication", ["CC0 1.0"], []), ("Creative Commons Legal Code CC0 1.0 Universal", ["CC0 1.0"], [])],
    "BSD-2-Clause": [("Licensed under the BSD 2-Clause License", ["2 Clause"], []), (_CLAUSES, [], [_NAMES]), (_CONDITIONS, [], [_NAMES])],
    "BSD-3-Clause": [
        ("Licensed under the BSD 3-Clause License", ["3 Clause"], []),
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "ISC": ["Licensed under the ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "MPL-2.0": [
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["2.0"], []), ("Licensed under the Mozilla Public License 2.0", ["2.0"], []), ("Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor", ["2.0"], []),
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", "Released under the Unlicense License"],
    "Zlib": ["This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"],
}
for _kind, _code in (("Attribution", "BY"), ("Attribution-ShareAlike", "BY-SA"), ("Attribution-NonCommercial", "BY-NC"), ("Attribution-NoDerivatives", "BY-ND"),
                               ("Attribution-NonCommercial-ShareAlike", "BY-NC-SA"), ("Attribution-NonCommercial-NoDerivatives", "BY-NC-ND")):
    TEMPLATES[f"CC-{_code}-4.0"] = [
        (f"Licensed under CC {_code} 4.0", [f"CC {_code} 4.0"], []), (f"Licensed under CC-{_code}", [f"CC {_code}"], [f"CC {_code} {x}" for x in ("SA", "NC", "ND", "1", "2", "3")]),
        (f"Licensed under a Creative Commons {_kind} 4.0 International License", [f"Commons {_kind} 4.0"], []), (f"Creative Commons {_kind} 4.0 International Public License", [f"Commons {_kind} 4.0"], []),
    ]
for _name, _number in (("GPL", "2"), ("GPL", "3"), ("LGPL", "2.1"), ("LGPL", "3"), ("AGPL", "3")):
    _full, _spdx = _GNU[_name], f"{_name}-{_number}{'' if '.' in _number else '.0'}"
    _version = f"version {_number}"
    TEMPLATES[f"{_spdx}-only"] = [
        (f"This work is licensed under the {_full}, {_version}", [f"{_full} {_version}"], ["any later version"]), (f"Licensed under the {_full}, {_version}", [f"{_full} {_version}"], ["any later version"]),
        (f"Licensed under the {_full} v{_number}", [f"{_full} v{_number}"], ["any later version"]),
        (f"Licensed under the {_full} v{_number}.0", [f"{_full} v{_number}.0"], ["any later version"]), (_FREE.format(_full) + _version, [_full, _version], ["any later version"]),
        ({"GPL-2.0": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "GPL-3.0": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "LGPL-2.1": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
          "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"}[_spdx], [f"{_full} {_version}"], []),
    ]
    TEMPLATES[f"{_spdx}-or-later"] = [(x.format(_full) + _LATER.format(_number), [_full, _version], []) for x in (_FREE, _LIBRARY)]
_SEEDS = mixed(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(texts)
    data = LOWER_BYTES[data]
    starts, ends, before = word_ranges(data, offsets, _OUTSIDE)
    return range_hashes(data, starts, ends), before


def _stride(words: int) -> int:
    """Half a window: the template's length, or a little more so that few lengths occur."""
    step = max(1, 1 << max(0, words.bit_length() - 3))
    return -(-words // step) * step


def prepared(templates) -> dict[int, dict[int, list[tuple]]]:
    """By width of shingles and stride: name, distinct shingles, MinHash values, and words of the phrases of each template."""
    out: dict[int, dict[int, list[tuple]]] = {}
    for name, texts in templates.items():
        for entry in texts:
            text, *phrases = (entry, [], []) if isinstance(entry, str) else entry
            words = _words(pa.array([text]))[0]
            if len(words) < SHINGLE:
                raise ValueError(f"the template of {name} has fewer than {SHINGLE} words")
            width = SHINGLE - (len(words) < SHORT)
            shingles = np.unique(gram_hashes(words, width))
            lows = np.array([mixed(shingles ^ seed).min() for seed in _SEEDS])
            some = [[_words(pa.array([p]))[0] for p in x] for x in phrases]
            out.setdefault(width, {}).setdefault(_stride(len(words)), []).append((name, shingles, lows, *some))
    return out


def _holds(words: np.ndarray, phrase: np.ndarray) -> bool:
    n = len(words) - len(phrase) + 1
    return n > 0 and bool(np.all([words[k: k + n] == w for k, w in enumerate(phrase)], axis=0).any())


def matches(words: np.ndarray, before: np.ndarray, templates: dict[int, dict[int, list[tuple]]]) -> list[tuple[int, str, int, int]]:
    """Number of the text, name, and first and last word (from 0) of each match."""
    found = []
    for width, some in templates.items():
        found += _of_width(words, before, width, some)
    merged: list[tuple[int, str, int, int]] = []
    for t, name, low, high in sorted(found):
        if merged and merged[-1][:2] == (t, name) and low <= merged[-1][3]:
            merged[-1] = (t, name, merged[-1][2], max(high, merged[-1][3]))
        else:
            merged.append((t, name, low, high))
    return merged


def _of_width(words: np.ndarray, before: np.ndarray, width: int, templates: dict[int, list[tuple]]) -> list[tuple[int, str, int, int]]:
    shingles = gram_hashes(words, width)
    if not len(shingles):
        return []
    blocks = {s: -(-len(shingles) // s) for s in templates}
    hit = {s: np.zeros((blocks[s], len(templates[s])), bool) for s in templates}
    for band, seed in enumerate(_SEEDS):
        value = mixed(shingles ^ seed)
        for s, some in templates.items():
            full = len(value) // s * s
            low = value[:full].reshape(-1, s).min(axis=1)
            if full < len(value):
                low = np.append(low, value[full:].min())
            low[:-1] = np.minimum(low[:-1], low[1:])
            for i, (_, _, lows, *_) in enumerate(some):
                hit[s][:, i] |= low == lows[band]
    found = []
    for s, some in templates.items():
        for block, i in zip(*(x.tolist() for x in np.nonzero(hit[s])), strict=True):
            name, wanted, _, held, barred = some[i]
            begin, end = block * s, min((block + 2) * s, len(shingles))
            # A window may touch several short texts; a shingle counts where it lies in one text whole.
            text = np.searchsorted(before, np.arange(begin, end), "right") - 1
            inside = before[text + 1] - np.arange(begin, end) >= width
            at = np.flatnonzero(inside & np.isin(shingles[begin:end], wanted))
            for t in np.unique(text[at]).tolist():
                own = at[text[at] == t]
                if len(np.unique(shingles[begin + own])) >= CONTAINED * len(wanted):
                    low, high = int(begin + own[0]), int(begin + own[-1] + width)
                    near, later = words[low: min(high + 2, before[t + 1])], words[low: min(high + AFTER, before[t + 1])]
                    if all(_holds(near, p) for p in held) and not any(_holds(later, p) for p in barred):
                        found.append((t, name, int(low - before[t]), int(high - 1 - before[t])))
    return found


def _scanned(templates: dict[str, list[str]]):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = prepared(templates)
        for batch in batches:
            for begin, end in parts(batch.column("text"), 2 * BLOCK):
                part = batch.slice(begin, end - begin)
                spans: list[list[tuple[str, int, int]]] = [[] for _ in range(part.num_rows)]
                for t, name, low, high in matches(*_words(part.column("text")), known):
                    spans[t].append((name, low, high))
                names = [",".join(sorted({x[0] for x in s})) for s in spans]
                where = [",".join(f"{n}:{a}:{b}" for a, b, n in sorted((a, b, n) for n, a, b in s)) for s in spans]
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), pa.array(names, pa.string()), pa.array([len(s) for s in spans], pa.int64()), pa.array(where, pa.string())],
                    names=["id", "licenses", "n_matches", "spans"])

    return walk


def scanned(docs: DataFrame, templates: dict[str, list[str]] | None = None, identifier: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row: its identifier, `licenses` (names, comma-joined), `n_matches`, and `spans` as
    name:first word:last word."""
    kind = docs.schema[identifier].dataType.simpleString()
    source = docs.select(docs[identifier].alias("id"), text_of(text).alias("text"))
    found = source.mapInArrow(_scanned(TEMPLATES if templates is None else templates), f"id {kind}, licenses string, n_matches long, spans string")
    return found.withColumnRenamed("id", identifier)

"""Document fingerprints from a Lempel-Ziv phrase parse, compared by minimum hashes.

Method. A text is cut into tokens (runs of at most PIECE non-space characters, so texts without spaces parse too) and
parsed the LZ78 way: each phrase is the shortest run of tokens from the current place that is not yet a phrase. A
phrase is hashed from its parent phrase's hash and its last token, so equal phrases hash alike in any document. The
fingerprint is, for each of K hash functions, the least value over the phrase set (K 32-bit values in hex); the share
of equal places estimates the Jaccard likeness of two phrase sets, as a compressor that knows one text would find the
other. Equal texts have equal phrase sets, hence equal fingerprints; an empty text has the empty set (all places
ffffffff).

Edited texts. For the query, each document's last floor(n/4) code points are replaced by the first as many of the next
document in ascending doc_id (all of it if shorter; the last document is followed by the first). Documents are ordered
by `ranking.positions` (range partitioning, no single task); each document sends only the head its predecessor needs,
so beyond one exchange of the texts (as zstd frames) only a quarter of them moves. The parse of the common beginning is done once and
continued twice, for the text and for the edited text. Minimum hashes travel as 256-byte digests: one pass gives each
document's own row and a row that takes its digest to its predecessor, and one grouping by row joins them.

Edges. A null text is empty; a null doc_id sorts after all others, and repeated doc_ids are ordered by a hash of their
text, then by row. A single document is followed by itself. Very long texts are parsed whole, one row at a time in
batches bounded in bytes. Empty tables give no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payouts.llm import ranking
from payouts.llm.common import cut, text_of

PIECE = 8
K = 64
TOKEN = re.compile(r"\S{1,%d}" % PIECE)
_LAST_SPACE = re.compile(r"\s\S*\Z")
_RNG = np.random.default_rng(20240531)
_A = _RNG.integers(1, 2**63, size=K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, size=K, dtype=np.uint64)
EMPTY = "ffffffff" * K


class Parse:
    """An LZ78 parse over tokens that can be continued, or copied and continued otherwise."""

    __slots__ = ("trie", "hashes", "node", "node_hash")

    def __init__(self) -> None:
        self.trie: dict[tuple[int, str], tuple[int, int]] = {}
        self.hashes: list[int] = []
        self.node, self.node_hash = 0, 0

    def feed(self, tokens: list[str]) -> Parse:
        trie, hashes, node, node_hash = self.trie, self.hashes, self.node, self.node_hash
        for token in tokens:
            got = trie.get((node, token))
            if got is None:
                phrase = xxhash.xxh64_intdigest(token, seed=node_hash)
                trie[(node, token)] = (len(trie) + 1, phrase)
                hashes.append(phrase)
                node, node_hash = 0, 0
            else:
                node, node_hash = got
        self.node, self.node_hash = node, node_hash
        return self

    def copy(self) -> Parse:
        other = Parse()
        other.trie, other.hashes, other.node, other.node_hash = dict(self.trie), list(self.hashes), self.node, self.node_hash
        return other

    def digest(self) -> bytes:
        """The K least values, 4 bytes each, most significant first."""
        if not self.hashes:
            return b"\xff" * (4 * K)
        values = np.fromiter(self.hashes, dtype=np.uint64, count=len(self.hashes))
        with np.errstate(over="ignore"):
            mixed = (values[:, None] * _A[None, :] + _B[None, :]) >> np.uint64(32)
        return mixed.min(axis=0).astype(">u4").tobytes()

    def fingerprint(self) -> str:
        return self.digest().hex()


def fingerprint(text: str | None) -> str:
    """The fingerprint of one text (None: empty)."""
    return Parse().feed(TOKEN.findall(text or "")).fingerprint()


def likeness(a: str, b: str) -> float:
    """Share of equal places of two fingerprints."""
    return sum(a[i:i + 8] == b[i:i + 8] for i in range(0, 8 * K, 8)) / K


def edited_pair(text: str, head: str) -> tuple[str, bytes, bytes]:
    """(edited text, digest of text, digest of edited text): the last floor(n/4) code points give way to head."""
    n = len(text)
    keep = n - n // 4
    edited = text[:keep] + head
    last = _LAST_SPACE.search(text, 0, keep)
    space = last.start() if last else 0
    common = Parse().feed(TOKEN.findall(text[:space]))
    other = common.copy()
    return edited, common.feed(TOKEN.findall(text[space:])).digest(), other.feed(TOKEN.findall(edited[space:])).digest()


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts as zstd frames: the one exchange of the texts moves about half of what Spark's own codec would."""
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        yield pd.DataFrame({"rid": batch["rid"], "doc_id": batch["doc_id"],
                            "packed": [pack.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch["text"]]})


def _unpack(packed: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(packed).decode("utf-8", "surrogatepass")


def _heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first k code points of each text, addressed to its predecessor."""
    for batch in batches:
        yield pd.DataFrame({"rid": batch["pred_rid"], "head": [_unpack(p)[:k] for p, k in zip(batch["packed"], batch["k"], strict=True)],
                            "next_doc_id": batch["doc_id"]}).astype({"next_doc_id": "Int64"})


def _printed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per document, its own row (kind 0) and a row that takes its digest to its predecessor (kind 1)."""
    for batch in batches:
        out: list[tuple] = []
        for rid, doc_id, packed, head, after, pred in zip(batch["rid"], batch["doc_id"], batch["packed"], batch["head"], batch["next_doc_id"], batch["pred_rid"], strict=True):
            text, head = _unpack(packed), head or ""
            edited, own, changed = edited_pair(text, head)
            out.append((rid, 0, None if pd.isna(doc_id) else int(doc_id), len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                        own, changed, None if pd.isna(after) else int(after)))
            out.append((pred, 1, None, None, None, own, None, None))
        frame = pd.DataFrame(out, columns=["rid", "kind", "doc_id", "n_chars", "edited_sha256", "digest", "edited_digest", "next_doc_id"])
        yield frame.astype({"doc_id": "Int64", "n_chars": "Int64", "next_doc_id": "Int64", "kind": "int8"})


def same_share(a: Column, b: Column) -> Column:
    """likeness() of two digests (binary, 4 bytes a place) as a column expression."""
    places = F.sequence(F.lit(0), F.lit(K - 1))
    return F.size(F.filter(places, lambda i: F.substring(a, i * 4 + 1, 4) == F.substring(b, i * 4 + 1, 4))) / F.lit(float(K))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_doc_id) per
    document row; next_doc_id is the document that followed it."""
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    order = base.select("rid", "doc_id", F.char_length("text").cast("long").alias("n"), F.xxhash64("text").alias("h"))
    ranked = cut(ranking.positions(order, [F.col("doc_id").asc_nulls_last(), F.col("h"), F.col("n"), F.col("rid")], "rank"))
    total = ranked.count()
    follower = ranked.select(((F.col("rank") - 1 + F.lit(total)) % F.lit(max(total, 1))).alias("rank"), F.col("rid").alias("next_rid"))
    pairs = cut(ranked.select("rid", "rank", "n").join(follower, "rank"))
    wants = pairs.select(F.col("next_rid").alias("rid"), F.col("rid").alias("pred_rid"), F.floor(F.col("n") / 4).cast("int").alias("k"))
    # Both branches read the same columns of the joined texts, so Spark exchanges the texts once and reuses it.
    packed = base.mapInPandas(_packed, "rid long, doc_id long, packed binary")
    joined = packed.join(wants, "rid").select("rid", "doc_id", "packed", "pred_rid", "k")
    heads = joined.mapInPandas(_heads, "rid long, head string, next_doc_id long")
    rows = joined.select("rid", "doc_id", "packed", "pred_rid").join(heads, "rid")
    schema = "rid long, kind byte, doc_id long, n_chars long, edited_sha256 string, digest binary, edited_digest binary, next_doc_id long"
    printed = rows.mapInPandas(_printed, schema)
    own = F.col("kind") == 0
    pick = lambda c: F.first(F.when(own, F.col(c)), ignorenulls=True).alias(c)
    met = printed.groupBy("rid").agg(*[pick(c) for c in ("doc_id", "n_chars", "edited_sha256", "digest", "edited_digest", "next_doc_id")],
                                     F.first(F.when(~own, F.col("digest")), ignorenulls=True).alias("next_digest"))
    return met.select("doc_id", "n_chars", "edited_sha256", F.lower(F.hex("digest")).alias("fingerprint"), F.lower(F.hex("edited_digest")).alias("edited_fingerprint"),
                      same_share(F.col("digest"), F.col("edited_digest")).alias("near_edited"), same_share(F.col("digest"), F.col("next_digest")).alias("near_next"),
                      "next_doc_id")

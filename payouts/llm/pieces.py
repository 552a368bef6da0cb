"""SentencePiece encoding and decoding with a batched Viterbi search in numpy.

Texts become pieces as the library makes them: a space is written as U+2581, one is put in front, and characters
without a piece become bytes. No piece has U+2581 after another character, so texts part into words before every such
mark, and each distinct word of a batch is searched once. Words of equal length (longer ones padded to a few lengths)
advance together: a rolling hash gives the hash of every substring, the hashes probe the sorted keys of the pieces, and
for each end position the best last piece is stored as a backpointer.

For a model of type unigram the best is the largest sum of scores. A model of type BPE has no such sum: its result is
the one path on which every two neighbours are what merging would leave of the two alone, so there the search keeps,
for each end, the one piece that fits behind the best path before it. Both agree with the library.

Defined results: a missing text has no identifiers (an empty list), as an empty one; U+2581 itself in a text is taken
for a space, as in the library, and every other text comes back exactly; an empty table gives an empty result; further
columns may have any names.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from payouts.llm.common import fresh
from payouts.llm.text_arrays import BLOCK, mixed, parts, text_bytes

SPACE = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Entries of the lattice (words times positions times piece lengths) that are held at a time.
_LATTICE = 2_000_000
#: Words whose pieces a Python worker remembers, about 200 bytes each.
REMEMBERED = 300_000
_ASKED_BITS = 20
_PAD = 0x110000  # no character


def default_model() -> str:
    """The public SentencePiece vocabulary of this environment."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Vocabulary:
    texts: list[str]
    scores: np.ndarray
    is_byte: np.ndarray
    first_byte: int
    keys: np.ndarray  # sorted
    ids: np.ndarray  # in the order of the keys
    longest: int
    unigram: bool
    unknown: int
    unknown_score: float
    # For merging: the priority of a piece (lower comes first), its last two parts, and the pieces that pairs give.
    priority: np.ndarray
    left: np.ndarray
    right: np.ndarray
    pair_keys: np.ndarray
    pair_priority: np.ndarray
    # Direct tables in front of the sorted keys.
    slots: np.ndarray
    pair_slots: np.ndarray
    # Bytes of all pieces and where each begins.
    spelling: np.ndarray
    spelled: np.ndarray
    # Pairs that were asked for lately, in a table of fixed size, and whether they fit.
    asked: np.ndarray
    fitted: np.ndarray


def _slots(keys: np.ndarray) -> np.ndarray:
    """For the leading bits of a key the place of the first sorted key that has them or more."""
    bits = max(10, len(keys).bit_length() + 3)
    return np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).astype(np.int32)


def _places(keys: np.ndarray, slots: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places among the sorted keys, and whether the key is there. The slots lead to the place; where several keys share
    one, the next few are tried."""
    at = np.minimum(slots[wanted >> np.uint64(64 - len(slots).bit_length() + 1)], len(keys) - 1)
    found = keys[at]
    less = np.flatnonzero(found < wanted)
    while less.size:
        at.flat[less] = np.minimum(at.flat[less] + 1, len(keys) - 1)
        more = keys[at.flat[less]]
        found.flat[less] = more
        less = less[(more < wanted.flat[less]) & (at.flat[less] < len(keys) - 1)]
    return at, found == wanted


def _hash(codes: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes of the rows, the empty one first."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for i in range(codes.shape[1]):
        out[:, i + 1] = out[:, i] * _BASE + codes[:, i].astype(np.uint64) + np.uint64(1)
    return out


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def _salt(length: int) -> np.uint64:
    return np.uint64(length * 0xD1342543DE82EF95 % (1 << 64))


def _codes(words: list[str], length: int) -> np.ndarray:
    """Code points, one row a word, padded."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    out = np.full((len(words), length), _PAD, np.uint32)
    out[np.arange(length) < sizes[:, None]] = flat
    return out


@functools.cache
def load(path: str) -> Vocabulary:
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(sentencepiece.SentencePieceProcessor(model_file=path).serialized_model_proto())
    spec, rule = model.trainer_spec, model.normalizer_spec
    if spec.model_type not in (1, 2) or not spec.byte_fallback or rule.precompiled_charsmap or rule.remove_extra_whitespaces or not rule.add_dummy_prefix:
        raise ValueError("only unigram and BPE models with byte fallback and plain white space are supported")
    return vocabulary([(p.piece, p.score, p.type) for p in model.pieces], spec.model_type == 1)


def vocabulary(pieces: list[tuple[str, float, int]], unigram: bool) -> Vocabulary:
    """From texts, scores and types (1 ordinary, 2 unknown, 6 byte) in the order of the identifiers."""
    texts = [p[0] for p in pieces]
    scores = np.array([p[1] for p in pieces], float)
    ordinary = [i for i, p in enumerate(pieces) if p[2] == 1]
    by_text = {texts[i]: i for i in ordinary}
    if any(SPACE in t.lstrip(SPACE) for t in by_text) or any(c not in by_text for t in by_text for c in t):
        raise ValueError("a piece holds a mark after other characters, or a character that is no piece")
    keys = np.concatenate([_keys([texts[i]])[0] for i in ordinary])
    order = np.argsort(keys)
    if (np.diff(keys[order]) == 0).any():
        raise ValueError("two pieces have one hash")
    n = len(texts)
    # Merging takes the best score, and of equal scores the leftmost pair; equal scores share a priority.
    priority = np.full(n, np.iinfo(np.int64).max, np.int64)
    priority[ordinary] = np.unique(-scores[ordinary], return_inverse=True)[1]
    left, right = np.arange(n), np.arange(n)
    pairs = {}
    for t, i in by_text.items():
        for k in range(1, len(t)):
            if (a := by_text.get(t[:k])) is not None and (b := by_text.get(t[k:])) is not None:
                pairs[a << 32 | b] = priority[i]
    if not unigram:
        for t, i in by_text.items():
            path = _merged(t, by_text, priority)
            if len(path) == 2:
                left[i], right[i] = path
            elif len(t) > 1:
                left[i] = -1  # merging never makes this piece
    pair_list = np.array(list(pairs), np.int64)
    pair_hash = mixed(pair_list.view(np.uint64))
    pair_order = np.argsort(pair_hash)
    pair_keys = pair_hash[pair_order]
    first_byte = next((i for i, p in enumerate(pieces) if p[2] == 6), -1)
    spelled = [bytes([i - first_byte]) if p[2] == 6 else p[0].replace(SPACE, " ").encode("utf-8", "surrogatepass") for i, p in enumerate(pieces)]
    return Vocabulary(
        texts, scores, np.array([p[2] == 6 for p in pieces]), first_byte, keys[order], np.array(ordinary)[order],
        max(map(len, by_text)), unigram, next(i for i, p in enumerate(pieces) if p[2] == 2), scores[ordinary].min() - 10, priority, left, right, pair_keys, np.array(list(pairs.values()), np.int64)[pair_order],
        _slots(keys[order]), _slots(pair_keys), np.frombuffer(b"".join(spelled), np.uint8), np.append(0, np.cumsum([len(x) for x in spelled])), np.full(1 << _ASKED_BITS, -1, np.int64), np.zeros(1 << _ASKED_BITS, bool))


def _merged(text: str, by_text: dict[str, int], priority: np.ndarray) -> list[int]:
    """What merging makes of the text before its last merge into one piece, if that is where it ends."""
    symbols = list(text)
    while len(symbols) > 1:
        found = [(priority[i], k) for k in range(len(symbols) - 1) if (i := by_text.get(symbols[k] + symbols[k + 1])) is not None]
        if not found:
            break
        _, k = min(found)
        if len(symbols) == 2:
            return [by_text[s] for s in symbols]
        symbols[k: k + 2] = [symbols[k] + symbols[k + 1]]
    return []


def _keys(words: list[str]) -> list[np.ndarray]:
    return [mixed(_hash(_codes([w], len(w)))[:, -1] + _salt(len(w))) for w in words]


def _fits(v: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As _fit, for pairs of which many were asked for before."""
    key = a << 32 | b
    slot = mixed(key.view(np.uint64)) >> np.uint64(64 - _ASKED_BITS)
    out = v.fitted[slot]
    new = np.flatnonzero(v.asked[slot] != key)
    if new.size:
        out[new] = _fit(v, a[new], b[new])
        v.asked[slot[new]], v.fitted[slot[new]] = key[new], out[new]
    return out


def _fit(v: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether merging leaves the pieces a and b side by side when it starts from the characters of both.

    It does unless some merge across the border comes before the merge that hides one of its sides. So the parts along
    the border are taken apart again, the one made last first, and each pair on the way must not merge earlier.
    """
    n = len(a)
    out, at = np.zeros(n, bool), np.arange(n)
    a, b = a.copy(), b.copy()
    # A merge across the border counts if it comes before this moment; of one priority, the left comes first.
    limit = np.full(n, np.iinfo(np.int64).max, np.int64)
    while at.size:
        merges = np.zeros(len(a), bool)
        if len(v.pair_keys):
            place, there = _places(v.pair_keys, v.pair_slots, mixed((a << 32 | b).view(np.uint64)))
            # Moments: twice the priority, and one more for what lies right of the border.
            merges = there & (2 * v.pair_priority[place] < limit)
        whole_a, whole_b = v.left[a] == a, v.left[b] == b
        done = ~merges & whole_a & whole_b
        out[at[done]] = True
        go = ~(merges | done)
        at, a, b, limit, whole_a, whole_b = at[go], a[go], b[go], limit[go], whole_a[go], whole_b[go]
        # The side that was made later is taken apart; on a tie the right one, which merging reaches later.
        made_a = np.where(whole_a, -1, 2 * v.priority[a])
        made_b = np.where(whole_b, -1, 2 * v.priority[b] + 1)
        apart_a = made_a > made_b
        limit = np.where(apart_a, made_a, made_b)
        a, b = np.where(apart_a, v.right[a], a), np.where(apart_a, b, v.left[b])
    return out


def _search(words: list[str], length: int, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Piece identifiers of all words and where each word's begin; an unknown character is -1 - its code point."""
    codes = _codes(words, length)
    n, widest = len(words), min(v.longest, length)
    sums = _hash(codes)
    ids = np.full((widest + 1, n, length + 1), -1, np.int32)
    for k in range(1, widest + 1):
        key = mixed(sums[:, k:] - sums[:, :-k] * _power(k) + _salt(k))
        place, there = _places(v.keys, v.slots, key)
        ids[k, :, k:] = np.where(there, v.ids[place], -1)
    back = np.zeros((n, length + 1), np.int16)
    if v.unigram:
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        for e in range(1, length + 1):
            most = min(widest, e)
            here = ids[1: most + 1, :, e]
            gain = np.where(here >= 0, v.scores[here], -np.inf)
            gain[0] = np.where(here[0] >= 0, gain[0], v.unknown_score)
            total = best[:, e - most: e][:, ::-1].T + gain
            back[:, e] = total.argmax(axis=0) + 1
            best[:, e] = total.max(axis=0)
    else:
        last = np.full((n, length + 1), -1, np.int32)  # -1: the start or an unknown character, with which nothing merges
        ids[1:][(ids[1:] >= 0) & (v.left[ids[1:]] < 0)] = -1
        sizes = np.fromiter(map(len, words), np.int64, n)
        for e in range(1, length + 1):
            open_ = np.flatnonzero(sizes >= e)
            for k in range(min(widest, e), 0, -1):
                piece = ids[k, open_, e]
                at = np.flatnonzero((piece >= 0) & (back[open_, e - k] > 0) if e > k else piece >= 0)
                if at.size:
                    before = last[open_[at], e - k]
                    good = before < 0
                    ask = np.flatnonzero(~good)
                    good[ask] = _fits(v, before[ask].astype(np.int64), piece[at[ask]].astype(np.int64))
                    won = open_[at[good]]
                    back[won, e], last[won, e] = k, piece[at[good]]
                    open_ = np.delete(open_, at[good])
                if not open_.size:
                    break
            unknown = open_[ids[1, open_, e] < 0]
            back[unknown, e] = 1
    # All words walk back together, one piece at a time.
    sizes = np.fromiter(map(len, words), np.int64, n)
    steps, owners = [], []
    alive, e = np.arange(n), sizes.copy()
    alive, e = alive[e > 0], e[e > 0]
    while alive.size:
        k = back[alive, e].astype(np.int64)
        piece = ids[k, alive, e]
        steps.append(np.where(piece >= 0, piece, -1 - codes[alive, e - 1].astype(np.int32)))
        owners.append(alive)
        e = e - k
        alive, e = alive[e > 0], e[e > 0]
    if not steps:
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    owner, found = np.concatenate(owners[::-1]), np.concatenate(steps[::-1])
    return found[np.argsort(owner, kind="stable")], np.append(0, np.cumsum(np.bincount(owner, minlength=n)))


def _padded(length: int) -> int:
    """Up to 24 characters as it is, then a few lengths."""
    step = 1 << max(0, length.bit_length() - 4)
    return length if length <= 24 else -(-length // step) * step


def encode_words(words: list[str], v: Vocabulary) -> list[bytes]:
    """Identifiers of each word as 32-bit numbers."""
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(_padded(len(w)), []).append(i)
    out: list[bytes] = [b""] * len(words)
    for length, places in by_length.items():
        step = max(1, _LATTICE // (length * min(length, v.longest)))
        for begin in range(0, len(places), step):
            some = places[begin: begin + step]
            found, bounds = _search([words[j] for j in some], length, v)
            raw = found.tobytes()
            for i, low, high in zip(some, (4 * bounds[:-1]).tolist(), (4 * bounds[1:]).tolist(), strict=True):
                out[i] = raw[low:high]
            if len(found) and found.min() < 0:
                for j in np.unique(np.searchsorted(bounds, np.flatnonzero(found < 0), "right") - 1).tolist():
                    spelled = (x for f in found[bounds[j]: bounds[j + 1]].tolist() for x in ([f] if f >= 0 else [v.first_byte + b for b in chr(-1 - f).encode("utf-8", "surrogatepass")]))
                    out[some[j]] = np.fromiter(spelled, np.int32).tobytes()
    return out


class Encoder:
    """Encodes texts; remembers the pieces of REMEMBERED words at most, those used last."""

    def __init__(self, v: Vocabulary):
        self.v, self.known, self.older = v, {}, {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [_WORDS.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        wanted = set()
        for words in split:
            wanted.update(words)
        if len(self.known) + len(wanted) > REMEMBERED // 2:
            self.older, self.known = self.known, {}
        wanted.difference_update(self.known)
        again = wanted & self.older.keys()
        self.known.update(zip(again, map(self.older.__getitem__, again), strict=True))
        new = list(wanted - again)
        self.known.update(zip(new, encode_words(new, self.v), strict=True))
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each Python worker, so that tasks share what it remembers."""
    return Encoder(load(path))


def decode_all(ids: np.ndarray, bounds: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another and where each begins; each still has the space put in front."""
    sizes = np.diff(v.spelled)[ids]
    ends = np.cumsum(sizes)
    at = np.repeat(v.spelled[ids] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
    return v.spelling[at], np.append(0, ends)[bounds]


def decode(ids: np.ndarray, v: Vocabulary) -> str:
    """The text of the identifiers; bytes that are no UTF-8 become U+FFFD."""
    raw, _ = decode_all(ids, np.array([0, len(ids)]), v)
    return raw.tobytes().decode("utf-8", "replace")[1:]


def _encoded(path: str, text: str, keep: list[str], name: str):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for begin, end in parts(batch.column(text), 2 * BLOCK):
                part = batch.slice(begin, end - begin)
                found = own.encode(part.column(text).to_pylist())
                offsets = np.zeros(len(found) + 1, np.int32)
                np.cumsum([len(f) // 4 for f in found], out=offsets[1:])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), ids], names=[*keep, name])

    return walk


def encoded(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """The rows with the identifiers of their texts as the last column: `ids`, or with underscores before where that
    is taken."""
    name = fresh(docs, "ids")[0]
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"`{name}` array<int>"])
    return docs.mapInArrow(_encoded(path or default_model(), text, docs.columns, name), kinds)


def _decoded(path: str, ids: str, name: str):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(path)
        for batch in batches:
            column = batch.column(ids)
            offsets, flat = np.asarray(column.offsets), np.asarray(column.values)
            missing = column.is_null().to_numpy(zero_copy_only=False)
            texts = [None if m else decode(flat[a:b], v) for m, a, b in zip(missing.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name])

    return walk


def decoded(rows: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """The rows with the texts of their identifiers as the last column: `decoded`, or with underscores before where that
    is taken. Missing identifiers give a missing text."""
    name = fresh(rows, "decoded")[0]
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), f"`{name}` string"])
    return rows.mapInArrow(_decoded(path or default_model(), ids, name), kinds)


def _digested(path: str):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, v = encoder(path), load(path)
        for batch in batches:
            for begin, end in parts(batch.column("text"), 2 * BLOCK):
                part = batch.slice(begin, end - begin)
                found = own.encode(part.column("text").to_pylist())
                bounds = np.append(0, np.cumsum([len(f) // 4 for f in found]))
                decoded, at = decode_all(np.frombuffer(b"".join(found), np.int32), bounds, v)
                given, offsets = text_bytes(part.column("text"))
                same = []
                for a, b, low, high in zip(at[:-1].tolist(), at[1:].tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    text, back = given[low:high].tobytes(), decoded[a + 1: b].tobytes()
                    same.append(text == back or text.replace(SPACE.encode(), b" ") == back)
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), pa.array(np.diff(bounds).astype(np.int64)), pa.array([hashlib.sha256(f).hexdigest() for f in found], pa.string()), pa.array(same, pa.bool_())],
                    names=["id", "n_ids", "ids_sha256", "round_trip"])

    return walk


def digests(docs: DataFrame, path: str | None = None, identifier: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row: its identifier, the number of piece identifiers, the SHA-256 of them as 32-bit numbers, and
    whether decoding them gives the text again. Encodes and decodes in one pass."""
    kind = docs.schema[identifier].dataType.simpleString()
    source = docs.select(docs[identifier].alias("id"), docs[text].alias("text"))
    found = source.mapInArrow(_digested(path or default_model()), f"id {kind}, n_ids long, ids_sha256 string, round_trip boolean")
    return found.withColumnRenamed("id", identifier)

"""SentencePiece coding against the library, and exact round trips."""

import numpy as np
import pytest
import sentencepiece
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2

from payouts.llm import pieces

from .conftest import ROWS

PATH = pieces.default_model()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def encoder():
    return pieces.encoder(PATH)


def ids(encoder, text):
    return np.frombuffer(encoder.encode([text])[0], np.int32)


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet=st.one_of(st.sampled_from("the ning er=-*\n\t01é中\U0001f642"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_any_text_is_coded_as_by_the_library(library, encoder, text):
    found = ids(encoder, text)
    assert found.tolist() == library.encode(text)
    assert pieces.decode(found, encoder.v) == text.replace("▁", " ")


def test_long_words_and_repeats(library, encoder):
    for text in ("x" * 3000, "the" * 700, "=" * 500, " " * 300 + "end", "0123456789" * 300, "日本語" * 400):
        assert ids(encoder, text).tolist() == library.encode(text)


def test_what_is_remembered_does_not_matter(encoder, monkeypatch, sample):
    texts = [r["text"] for r in sample.limit(60).collect()]
    whole = encoder.encode(texts)
    monkeypatch.setattr(pieces, "REMEMBERED", 10)
    monkeypatch.setattr(pieces, "_LATTICE", 500)
    small = pieces.Encoder(encoder.v)
    assert [small.encode([t])[0] for t in texts] == whole


def test_unigram_models_take_the_best_sum(sample):
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(sentencepiece.SentencePieceProcessor(model_file=PATH).serialized_model_proto())
    model.trainer_spec.model_type = 1
    rng = np.random.default_rng(3)
    for p in model.pieces:
        if p.type == 1:
            p.score = float(-8 - 4 * rng.random())
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    own = pieces.Encoder(pieces.vocabulary([(p.piece, p.score, p.type) for p in model.pieces], True))
    texts = [r["text"] for r in sample.limit(100).collect()] + ["", "\U0001f642 naïve", "x" * 200]
    score = own.v.scores
    score[own.v.is_byte] = 0  # an unknown character costs the same either way
    for text, mine, theirs in zip(texts, own.encode(texts), library.encode(texts), strict=True):
        mine = np.frombuffer(mine, np.int32)
        # Equal sums may have several paths, and the library adds in single precision.
        assert score[mine].sum() == pytest.approx(score[theirs].sum(), rel=1e-5) and pieces.decode(mine, own.v) == text


def test_frames_at_the_edges(edge_docs, no_docs):
    coded = pieces.encoded(edge_docs)
    assert coded.columns == [*edge_docs.columns, "_ids"]
    back = pieces.decoded(coded.drop("decoded"), ids="_ids")
    assert back.columns[-1] == "decoded" and sorted((r["decoded"] for r in back.collect())) == sorted((t or "").replace("▁", " ") for _, t in ROWS)
    assert pieces.encoded(no_docs).count() == 0
    found = pieces.digests(edge_docs)
    assert found.count() == len(ROWS) and found.filter("NOT round_trip").count() == 0
    assert found.filter("doc_id = 1").first()["n_ids"] == 0

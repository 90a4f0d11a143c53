"""Words of scripts that no language was learned from must not decide on a text, nor make its score undefined."""

import math

import pytest

from vecspark.llm import langid
from vecspark.llm.catalog import vocabulary


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return langid.fit_language_model(spark, docs, vocabulary("piece_bpe_32k.model"))


def test_foreign_words_keep_scores_finite(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 200")
    cherokee, junk = "ᎠᎡᎢᎣᎤᎥᎦᎧᎨᎩᎪᎫᎬᎭᎮᎯᎰᎱᎲᎳᎴᎵᎶᎷ", "ꙮ" * 500
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.where("lang is not null").limit(60).collect()]
    langs, scores = langid.Scorer(model).texts([f"{t} {cherokee} {junk} {cherokee * 3}" for _, t, _ in rows])
    plain, _ = langid.Scorer(model).texts([t for _, t, _ in rows])
    assert all(math.isfinite(s) and 0 <= s <= 1 for s in scores)
    assert sum(a == b for a, b in zip(langs, plain)) >= 58
    alone, score = langid.Scorer(model).texts([cherokee, junk])
    assert set(alone) <= set(model.langs) and all(0 < s <= 1 for s in score)


def test_scaled_sums_are_the_plain_ones(model):
    words = ["haus", "the", "été", "a", "zu", "informatie"]
    got = model.word_scores(words)
    for w, row in zip(words, got):
        raw = "▁".encode() + w.encode()
        number = langid.load_pieces(vocabulary("piece_bpe_32k.model"))
        alpha = [[1.0] * len(model.langs)] + [[0.0] * len(model.langs) for _ in raw]
        for e in range(1, len(raw) + 1):
            for s in range(max(0, e - langid.PIECE_BYTES), e):
                k = number.get(raw[s:e])
                if k is not None:
                    alpha[e] = [x + y * p for x, y, p in zip(alpha[e], alpha[s], model.probs[k])]
        assert all(math.isclose(a, math.log(b), rel_tol=1e-9) for a, b in zip(row, alpha[-1]))

import os

import numpy as np
import pytest

from tesserae.llm import offensive as O
from tesserae.llm.gbt import BoostedTrees, Isotonic
from tesserae.llm.textnorm import tokens_of

DATA = "/root/testdata/sf0.1"


@pytest.mark.parametrize(
    "text,word",
    [
        ("you 1d10t", "idiot"), ("you i d i o t", "idiot"), ("you i.d.i.o.t", "idiot"), ("you idiооt", "idiot"), ("you iiiiidiot", "idiot"),
        ("YOU IDIOT!", "idiot"), ("you id​iot", "idiot"), ("<b>idiot</b>", "idiot"), ("idi*t", "idiot"), ("idoit", "idiot"), ("dumbassss", "dumbass"),
    ],
)
def test_disguises_are_undone(text, word):
    tokens = O.Tokens.of([text])
    assert (tokens.bits & O._BIT["insult"]).any() or word == "idiot" and "idioot" in tokens_of(text)[0]


def test_plain_technical_text_is_left_alone():
    words, flags = tokens_of("Lot 2202 has a 3.5 mm dent; close-up at 12:05, run A-17, IoU 0.9.")
    assert not any(f & 10 for f in flags) and "dent" in words


def test_words_inside_a_long_run_are_found():
    for run in ("abcdefgh" * 8 + "idiot" + "hgfedcba" * 8, "thisisonelongrunwithoutspacesyoustupidbastardandsoon"):
        assert (O.Tokens.of([run]).bits & O._BIT["insult"]).any()
    assert not (O.Tokens.of(["donaudampfschifffahrtsgesellschaftskapitän"]).bits & O._MASKABLE).any()


def test_trees_learn_an_interaction_and_calibrate():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = BoostedTrees().fit(x[:2000], y[:2000])
    score = model.score(x[2000:])
    assert ((score > 0) == (y[2000:] > 0)).mean() > 0.95
    p = Isotonic().fit(score, y[2000:]).predict(np.sort(score))
    assert (np.diff(p) >= 0).all() and 0 <= p.min() and p.max() <= 1


ODD = [None, "", " ", "\x00\x01", "a" * 100_000, "!!! *** ???", "ñ" * 50, "<", "&amp;", "1 2 3", "i d i o t", "you idiot"]


def test_odd_texts_have_a_score(spark):
    model = O.OffensiveModel.fit(np.zeros((0, len(O.COLUMNS))), np.zeros(0), np.zeros(0, int), O.Phrases())
    p = model.probability(ODD)
    assert len(p) == len(ODD) and np.isfinite(p).all() and p[-1] == p.max() and p[0] == p[1] < p[-1]
    df = spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(ODD)] + [(None, "x", "x", 1.0)], "doc_id long, text string, source string, score double")
    rows = O.score_documents(df, model, "source").collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert O.source_rates(O.score_documents(df, model, "source")).first().n_docs == len(ODD)


def test_blocks_score_like_the_whole(monkeypatch):
    filler = "the mask covers the rim and the lot was checked by camera nine again "
    texts = [filler * 40 + "you are a stupid idiot " + filler * 40, "short", "", filler * 3 + "YOU IDIOTS! " + filler * 9]
    tokens = O.Tokens.of(texts)
    code = np.sort(np.unique(np.concatenate([c for _, _, c in tokens.grams()]))[::7])
    near = np.sort(np.unique(np.concatenate([c for _, c in tokens.beside_abuse()])))
    phrases = O.Phrases(code, np.linspace(1.5, 3, len(code)), near, np.linspace(-2, 2, len(near)))
    whole = O.features(tokens, phrases)
    for size in (37, 100, 1000):
        monkeypatch.setattr(O, "BLOCK_TOKENS", size)
        cut_up = O.features(tokens, phrases)
        own = [i for i, c in enumerate(O.COLUMNS) if not c.startswith("context")]
        assert np.allclose(whole[:, own], cut_up[:, own])


def test_phrases_are_learnt_without_the_fold_they_serve(spark):
    rows = [(i, "do walk into the cold sea now" if i < 6 else f"lot {i} was fine and the mask fits", int(i < 6), i % 3) for i in range(60)]
    rows += [(100, "only here stands one peculiar sentence", 1, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int, fold int")
    learnt = O.learn_phrases(df)
    code = {n: c for n, _, c in O.Tokens.of(["walk into the cold"]).grams()}
    lone = {n: c for n, _, c in O.Tokens.of(["one peculiar sentence"]).grams()}
    assert all((p.find(code[4])[1] > O.PHRASE_ODDS).all() and len(p.find(code[4])[0]) == len(code[4]) for p in learnt)
    assert [len(p.find(lone[3])[0]) == len(lone[3]) for p in learnt] == [False, True, True, True]
    assert all(not len(p.find(np.concatenate([c for _, _, c in O.Tokens.of(["the mask fits"]).grams()]))[0]) for p in learnt)


def test_few_labels_stay_near_the_fixed_weighting(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["you idiot", "the lot is fine", "a dent", None])], "doc_id long, text string")
    for rows in ([], [(0, 1)], [(0, 1), (1, 0), (2, 0), (2, 1), (3, None)]):
        model = O.fit_offensive(docs, spark.createDataFrame(rows, "doc_id long, offensive int"))
        p = model.reviewed_probability(["you stupid idiot", "the lot is fine", "a long dent", None])
        assert p[0] > 0.4 > p[1:].max()
    assert O.score_documents(docs.limit(0), model).count() == 0


def test_share_of_offensive_documents_is_recovered():
    rng = np.random.default_rng(1)
    good, bad = rng.beta(2, 8, 97_000), rng.beta(8, 2, 3_000)  # densities as of a calibrated score with a share of one half
    p = np.r_[good, bad]
    density = lambda v, a, b: v ** (a - 1) * (1 - v) ** (b - 1)
    reviewed = density(p, 8, 2) / (density(p, 8, 2) + density(p, 2, 8))
    assert abs(O.true_share(reviewed, np.ones(len(p)), 0.5) - 0.03) < 0.003


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_held_out_quality(spark):
    found, x, _ = O.reviewed_features(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/review_labels.parquet"))
    quality = O.held_out_quality(x, found["y"].to_numpy(), found["fold"].to_numpy())
    assert quality["precision"] > 0.85 and quality["recall_apart"] > 0.5


LARGE = "/root/testdata/check_l"


@pytest.mark.skipif(not os.path.isdir(LARGE), reason="needs the large test tables")
def test_held_out_quality_with_many_verdicts(spark):
    found, x, _ = O.reviewed_features(spark.read.parquet(f"{LARGE}/documents.parquet"), spark.read.parquet(f"{LARGE}/review_labels.parquet"))
    quality = O.held_out_quality(x, found["y"].to_numpy(), found["fold"].to_numpy())
    assert quality["precision"] > 0.9 and quality["recall_apart"] > 0.8

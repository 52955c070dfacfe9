import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm import mixing, packing
from tesserae.llm.tokens import PIECE_CHARS, count_tokens, encoding, VOCABULARY, pieces


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=60))
def test_best_fit_never_overflows(sizes):
    bins = packing.best_fit(np.array(sizes, np.int64), 64)
    fill = np.bincount(bins, sizes) if sizes else np.zeros(0)
    assert (fill <= 64).all()
    assert sum(f <= 32 for f in fill) <= 1  # two half-empty ones would have been one


def _pack(spark, sizes, capacity=2048):
    df = spark.createDataFrame([(i, n, "x", 1) for i, n in sizes], "id long, n_tokens long, container_id string, item int")
    return packing.pack_items(packing.split_large(df, capacity), capacity).collect()


def test_every_token_once_and_containers_full(spark, monkeypatch):
    monkeypatch.setattr(packing, "PARTITION_ITEMS", 300)
    rnd = random.Random(4)
    sizes = [(i, int(min(9000, rnd.expovariate(1 / 300)))) for i in range(3000)] + [(5000, 0), (5001, 2048), (5002, 4096), (5003, 5000), (5003, 5000), (5004, 2049)]
    got = _pack(spark, sizes)
    fill = {}
    for r in got:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
    total = sum(n for _, n in sizes)
    assert sum(fill.values()) == total and max(fill.values()) <= 2048
    assert len(fill) <= math.ceil(total / 2048 * 1.02) + 1
    for i, n in sizes:
        mine = [r for r in got if r.id == i]
        assert len(mine) >= max(1, math.ceil(n / 2048)) and sum(r.n_tokens for r in mine) % max(n, 1) == 0
        assert n > 2048 or all(r.n_tokens == n and r.token_start == 0 for r in mine)


def test_large_items_do_not_stop_the_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "PARTITION_ITEMS", 50)
    assert len({r.container_id for r in _pack(spark, [(i, 1500) for i in range(400)])}) == 400


def test_rounds_go_on_until_nothing_fits(spark, monkeypatch):
    monkeypatch.setattr(packing, "PARTITION_ITEMS", 40)
    rnd = random.Random(9)
    got = _pack(spark, [(i, rnd.choice([900, 1100, 1300, 700])) for i in range(600)])
    fill = {}
    for r in got:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
    assert len(got) == 600 and max(fill.values()) <= 2048
    assert sum(f <= 1024 for f in fill.values()) <= 1


def test_pack_nothing(spark):
    assert _pack(spark, []) == [] and _pack(spark, [(None, 5)]) == []
    report = packing.packing_report(packing.pack_items(packing.split_large(spark.createDataFrame([], "id long, n_tokens long")))).first()
    assert report.containers == 0


def brute_seats(shares, seats, caps):
    won = [0] * len(shares)
    for _ in range(seats):
        free = [(-s / (2 * w + 1), i) for i, (s, w, c) in enumerate(zip(shares, won, caps)) if s > 0 and w < c]
        if free:
            won[min(free)[1]] += 1
    return won


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 30)), min_size=1, max_size=6), st.integers(0, 60))
def test_highest_quotients(parts, seats):
    shares, caps = [float(s) for s, _ in parts], [c for _, c in parts]
    free = [10**9] * len(shares)
    assert mixing.sainte_lague(shares, seats) == brute_seats(shares, seats, free)
    assert mixing.sainte_lague(shares, seats, caps) == brute_seats(shares, seats, caps)


def test_shares_are_met_within_the_repeats(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_DOCS", 200)
    rnd = random.Random(6)
    docs = [(i, rnd.choice(["big"] * 8 + ["small", "none", None]), rnd.choice([0, 50, 200, 900]), "x", 2) for i in range(4000)]
    sizes = spark.createDataFrame(docs + docs[:50] + [(None, "big", 5, "x", 2)], "id long, source string, n_tokens long, shard string, blocks int")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("absent", 0.1, 2), ("off", 0.0, 2), (None, 0.2, 1), ("bad", None, 1)], "source string, target_share double, max_repeat int")
    mixed = mixing.mix_sources(sizes, targets)
    rows = {r.source: r for r in mixing.mix_report(mixed, sizes.dropDuplicates(["id"]), targets).collect()}
    assert abs(rows["big"].actual_share - 2 / 3) < 0.01 and abs(rows["small"].actual_share - 1 / 3) < 0.01
    assert rows["small"].most_repeats <= 3 and rows["big"].most_repeats <= 1 and rows["none"].tokens_chosen == 0 and rows["absent"].tokens_chosen == 0
    assert mixed.count() == mixed.select("id").distinct().count()
    smaller = mixing.mix_sources(sizes, targets, total_tokens=50_000).selectExpr("sum(n_tokens * repeats) t").first().t
    assert 40_000 < smaller <= 56_000


def test_tiny_and_lumpy_sources_are_served(spark):
    docs = [(i, "big", 500) for i in range(2000)] + [(9000, "tiny", 2000), (9001, "tiny", 0), (9100, "lumpy", 40_000), (9101, "lumpy", 300), (9102, "lumpy", 9_000)]
    sizes = spark.createDataFrame(docs, "id long, source string, n_tokens long")
    targets = spark.createDataFrame([("big", 0.68, 1), ("tiny", 0.02, 3), ("lumpy", 0.3, 2)], "source string, target_share double, max_repeat int")
    mixed = mixing.mix_sources(sizes, targets)
    rows = {r.source: r for r in mixing.mix_report(mixed, sizes, targets).collect()}
    assert abs(rows["tiny"].actual_share - 0.02) < 0.001 and abs(rows["lumpy"].actual_share - 0.3) < 0.03 and abs(rows["big"].actual_share - 0.68) < 0.03
    assert rows["tiny"].most_repeats <= 3 and rows["lumpy"].most_repeats <= 2 and rows["big"].most_repeats <= 1
    alone = mixing.mix_sources(sizes.filter("source <> 'lumpy'"), spark.createDataFrame([("big", 0.98, 1), ("tiny", 0.02, 1)], targets.schema))
    assert alone.filter("source = 'tiny'").first().repeats == 1


def test_too_many_targets_are_refused(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_TARGETS", 2)
    sizes = spark.createDataFrame([(i, "abc"[i % 3], 5) for i in range(9)], "id long, source string, n_tokens long")
    targets = spark.createDataFrame([(s, 0.3, 1) for s in "abc"], "source string, target_share double, max_repeat int")
    with pytest.raises(ValueError):
        mixing.mix_sources(sizes, targets)


def test_mix_nothing(spark):
    sizes = spark.createDataFrame([], "id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeat int")
    assert mixing.mix_sources(sizes, targets).count() == 0
    assert mixing.mix_report(mixing.mix_sources(sizes, targets), sizes, targets).count() == 1


def test_pieces_count_like_the_whole():
    rnd = random.Random(8)
    text = " ".join("".join(rnd.choice("abcdefgäñ1") for _ in range(rnd.randint(1, 9))) for _ in range(40_000))
    assert len(text) > 3 * PIECE_CHARS and "".join(pieces(text)) == text
    assert count_tokens(text) == len(encoding(VOCABULARY).encode_ordinary(text))
    assert count_tokens(None) == count_tokens("") == 0
    run = "abcdefgh-" * 30_000  # no place to cut
    assert count_tokens(run) == len(encoding(VOCABULARY).encode_ordinary(run)) and list(pieces(run)) == [run]


@pytest.mark.parametrize("text", ["\x00�", "<|endoftext|>", "🙂" * 1000])
def test_odd_texts_have_tokens(text):
    assert count_tokens(text) > 0

import datetime as dt
import random

import pytest

from tesserae.operators import existence
from tesserae.operators.existence import alive_counts, live_events
from tesserae.operators.orphans import RecordTable, cascade_orphans, orphan_report

T0 = dt.datetime(2024, 1, 1)
LIVES = "rel_path string, registered_at timestamp, deleted_at timestamp, extra int"


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def test_running_count_equals_brute_force(spark):
    rnd = random.Random(3)
    lives = [(rnd.choice("ab") if i % 3 else "hot", at(s := rnd.randint(0, 200)), at(s + rnd.randint(-2, 60)) if rnd.random() < 0.7 else None, 1) for i in range(300)]
    asked = [(rnd.choice(["a", "b", "hot", "never"]), at(rnd.randint(-5, 300)), i) for i in range(400)]
    events = live_events(spark.createDataFrame(lives, LIVES), "rel_path", "registered_at", "deleted_at")
    got = {r.n: r.alive for r in alive_counts(spark.createDataFrame(asked, "key string, at timestamp, n int"), events, ["n"]).collect()}
    for key, when, n in asked:
        want = sum(1 for p, s, e, _ in lives if p == key and s <= when and (e is None or e > when))
        assert got[n] == want


def test_hot_days_are_cut_into_parts(spark, monkeypatch):
    lives = [("hot", at(1), at(30), 1), ("hot", at(26), at(28), 1), ("cold", at(2), None, 1)]
    asked = [("hot", at(27 if i % 3 else 29), i) for i in range(300)] + [("hot", at(i % 40), 300 + i) for i in range(80)] + [("cold", at(1), 900), ("hot", None, 901)]
    events = live_events(spark.createDataFrame(lives, LIVES), "rel_path", "registered_at", "deleted_at")
    questions = spark.createDataFrame(asked, "key string, at timestamp, n int")
    monkeypatch.setattr(existence, "HOT_QUESTIONS", 10)
    cut_up = sorted((r.n, r.alive) for r in alive_counts(questions, events, ["n"]).collect())
    monkeypatch.setattr(existence, "HOT_QUESTIONS", 1000)
    assert cut_up == sorted((r.n, r.alive) for r in alive_counts(questions, events, ["n"]).collect())
    known = dict(cut_up)
    assert len(cut_up) == 382 and known[1] == 2 and known[0] == 1 and known[900] == 0 and known[901] == 2


GRAPH = (
    RecordTable("masks", "mask_id", ("mask_path",), ("refined",), ()),
    RecordTable("images", "image_id", ("source",), ("output",), ("base",)),
)


def _tables(spark, masks, images):
    return {
        "masks": spark.createDataFrame(masks, "mask_id long, mask_path string, refined string, created_at timestamp, key string, alive int"),
        "images": spark.createDataFrame(images, "image_id long, source string, output string, base string, created_at timestamp, at string, depth int"),
    }


def test_direct_and_inherited(spark):
    inventory = spark.createDataFrame(
        [("data/m1.png", at(0), None, 0), ("data/m2.png", at(5), at(9), 0), ("data/s.png", at(0), None, 0), ("data/none.png", None, None, 0)], LIVES
    )
    masks = [
        (1, "./data/m1.png", "outputs/r1.png", at(1), "x", 1), (2, "data/m2.png", "outputs/r2.png", at(4), "x", 1), (3, "data/m2.png", None, at(5), None, None),
        (4, "data/m2.png", None, at(9), None, None), (5, None, None, at(9), None, None), (6, "n/a", None, at(9), None, None), (2, "data/m2.png", "outputs/r2.png", at(4), "x", 1),
        (7, "data/m2.png", None, None, None, None), (8, "data/none.png", None, None, None, None),
    ]
    images = [
        (10, "/mnt/x/data/s.png", "outputs/i10.png", "outputs/r2.png", at(10), "z", 1), (11, "data/s.png", "outputs/i11.png", "outputs/i10.png", at(10), "z", 1),
        (12, "data/s.png", "outputs/i12.png", "outputs/i12.png", at(10), "z", 1), (13, "data/s.png", None, "outputs/r1.png", at(10), "z", 1),
        (14, "data/s.png", "outputs/r2.png", "outputs/i11.png", at(10), "z", 1),
    ]
    found = cascade_orphans(_tables(spark, masks, images), inventory, GRAPH)
    got = sorted((r.table_name, r.field_name, r.record_id, r.kind, r.depth) for r in found.collect())
    assert got == [
        ("images", "base", 10, "inherited", 1), ("images", "base", 11, "inherited", 2), ("images", "base", 14, "inherited", 3),
        ("masks", "mask_path", 2, "direct", 0), ("masks", "mask_path", 4, "direct", 0), ("masks", "mask_path", 8, "direct", 0),
    ]
    assert sum(r.n_refs for r in orphan_report(found).collect()) == 6


def test_empty_tables(spark):
    found = cascade_orphans(_tables(spark, [], []), spark.createDataFrame([], LIVES), GRAPH)
    assert found.count() == 0


def _chain(spark, length):
    images = [(i, "data/s.png" if i else "data/none.png", f"outputs/c{i}.png", f"outputs/c{i - 1}.png" if i else None, at(10), "z", 1) for i in range(length)]
    return _tables(spark, [], images), spark.createDataFrame([("data/s.png", at(0), None, 0)], LIVES)


def test_a_chain_is_followed_to_its_end_or_refused(spark):
    tables, inventory = _chain(spark, 8)
    assert sorted((r.record_id, r.depth) for r in cascade_orphans(tables, inventory, GRAPH).collect()) == [(i, i) for i in range(8)]
    assert cascade_orphans(tables, inventory, GRAPH, max_rounds=8).count() == 8
    with pytest.raises(RuntimeError):
        cascade_orphans(tables, inventory, GRAPH, max_rounds=3)


def test_records_without_id_stay_apart(spark):
    images = [(None, "data/none.png", "outputs/a.png", None, at(1), "z", 1), (None, "data/none.png", "outputs/b.png", None, at(2), "z", 1),
              (None, "data/none.png", "outputs/b.png", None, at(2), "z", 1), (None, "data/s.png", None, "outputs/b.png", at(3), "z", 1)]
    found = cascade_orphans(_tables(spark, [], images), spark.createDataFrame([("data/s.png", at(0), None, 0)], LIVES), GRAPH)
    assert sorted((r.field_name, r.kind) for r in found.collect()) == [("base", "inherited"), ("source", "direct"), ("source", "direct")]

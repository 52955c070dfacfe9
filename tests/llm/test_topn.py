import random

from tesserae.llm import topn

SCHEMA = "pid long, category string, kind string, score double, rank_no int, g0 int, bin int, id string"


def brute(rows, n):
    best = {}
    for pid, c, k, s, *_ in set(rows):
        if None not in (pid, c, k, s) and s == s and 0 <= s <= 1:
            best.setdefault((c, k), set()).add((-s, pid))
    return sorted((c, k, i + 1, pid) for (c, k), v in best.items() for i, (_, pid) in enumerate(sorted(v)[:n]))


def _rows():
    rnd = random.Random(1)
    odd = [None, float("nan"), float("inf"), -0.1, 1.01, 0.0, -0.0, 1.0]
    rows = [(i, rnd.choice(["hot", "hot", "a", "b", "", None]), rnd.choice(["x", "x", "y", None]), rnd.choice([rnd.random(), 0.75, rnd.choice(odd)]), 0, 0, 0, "z") for i in range(3000)]
    rows += [(None, "a", "x", 0.99, 0, 0, 0, "z"), (9001, "single", "x", 0.1, 0, 0, 0, "z")] + [(i, "tied", "x", 1.0, 0, 0, 0, "z") for i in range(5000, 6000)]
    return rows + [r for r in rows if rnd.random() < 0.3] * 3


def _got(spark, rows, n):
    out = topn.top_n(spark.createDataFrame(rows, SCHEMA), ["category", "kind"], "score", "pid", n)
    return sorted((r.category, r.kind, r.rank_no, r.pid) for r in out.collect())


def test_equals_brute_force(spark):
    rows = _rows()
    for n in (1, 5):
        assert _got(spark, rows, n) == brute(rows, n)


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(topn, "BROADCAST_GROUPS", 0)
    assert _got(spark, _rows(), 5) == brute(_rows(), 5)


def test_empty(spark):
    assert _got(spark, [], 5) == []

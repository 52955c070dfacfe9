import json

import pytest
from pyspark.sql import functions as F

from tesserae.operators import lineage as N
from tesserae.operators import relational as R
from tesserae.sources import readers, sinks
from tesserae.streaming.upsert import latest, stream_upsert, windowed_counts


def test_ties_in_deduplication(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, None), ("j", 5, "z")], "k string, o int, v string")
    assert {r.k: r.v for r in R.last_wins(df, ["k"], "o").collect()} == {"k": None, "j": "z"}
    assert {r.k: r.v for r in R.first_wins(df, ["k"], "o").collect()} == {"k": "a", "j": "z"}
    twice = spark.createDataFrame([(1, "a", None), (1, "b", 3), (1, "c", 2), (None, "d", 1)], "i int, v string, ingested_at int")
    assert [(r.i, r.v) for r in R.once(twice, "i", "v").collect()] == [(1, "c")]


def test_lookup_without_reference_fails(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string")
    assert R.strict_lookup(left.filter("k = 1"), right, ["k"]).first().v == "a"
    with pytest.raises(Exception, match="no reference"):
        R.strict_lookup(left, right, ["k"]).collect()


def test_mixing_and_subsamples(spark):
    real, syn = spark.range(6).withColumnRenamed("id", "n"), spark.range(100, 104).withColumnRenamed("id", "n")
    count = lambda r: R.ratio_mix(real, syn, "n", r).filter("kind = 'synthetic'").count()
    assert [count(r) for r in (0, 0.5, 0.7, 1)] == [0, 6, 14, 4]
    picked = sorted(r.n for r in R.even_subsample(spark.range(101).withColumnRenamed("id", "n"), "n", 5).collect())
    assert picked == [0, 25, 50, 75, 100] and R.even_subsample(real, "n", 50).count() == 6
    keyed = spark.createDataFrame([("a", 1), ("a", 2), ("b", 9)], "k string, n int")
    turns = [(r.turn, r.k, r.n) for r in R.balanced_round_robin(keyed, ["k"], "n", 5).orderBy("turn").collect()]
    assert turns == [(0, "a", 1), (1, "b", 9), (2, "a", 1), (3, "b", 9), (4, "a", 1)]
    split = R.hash_split(spark.range(50).withColumn("g", F.col("id") % 2), ["g"], "id", "s", 5)
    assert split.filter("split = 'adaptation'").count() == 10


def test_numbering_is_the_order(spark):
    rows = R.ordinal(spark.range(1000).select((F.col("id") * 7 % 1000).alias("v")), "v", "nth").collect()
    assert all(r.v == r.nth for r in rows) and len(rows) == 1000


def test_paths_and_guards(spark):
    inside = spark.range(1).select(*[R.path_within(F.lit(a), F.lit(b)) for a, b in (("a/b", "a"), ("a", "a/"), ("ab", "a"), ("a/b", "a/b/c"))]).first()
    assert tuple(inside) == (True, True, False, False)
    df = spark.createDataFrame([(1,), (2,)], "v int")
    assert N.guard(df, F.col("v") > 5, "stale").count() == 2
    with pytest.raises(Exception, match="stale"):
        N.guard(df, F.col("v") > 1, "stale").collect()
    a, b = df, spark.createDataFrame([(2,), (3,)], "v int")
    assert N.shared_keys(a, b, ["v"]).first().v == 2 and N.unassigned(a, b, ["v"]).first().v == 1


def test_only_held_out_samples_are_capped(spark):
    rows = spark.range(70).selectExpr("id", "if(id % 10 < 6, 'adaptation', 'held_out') as split", "'c' as category", "'d' as defect_type", "concat('p', id) as image_path")
    nested = N.manifest(rows, ["category", "defect_type"], "split", ["image_path"], "id")
    got = [(r.split, r.place, r.id) for r in N.manifest_samples(nested, 20).collect()]
    listed = {s: [i for i in range(70) if (i % 10 < 6) == (s == "adaptation")] for s in ("adaptation", "held_out")}
    assert sorted(got) == [("adaptation", n, i) for n, i in enumerate(listed["adaptation"])] + [("held_out", n, i) for n, i in enumerate(listed["held_out"][:20])]


def test_scores_are_fused_place_by_place(spark):
    of = lambda *rows: spark.createDataFrame(list(rows), "n int, score array<double>")
    student, prior = of((0, [0.0, 1.0, 0.4, 0.2, 0.8]), (1, [1.0])), of((1, [3.0]), (0, [1.0, 0.0, 0.4, 0.6, 0.8]))
    got = {r.n: r for r in N.fuse_score_rows(student, prior, ["n"], "score", 0.25).collect()}
    assert [round(v, 9) for v in got[0].score] == [0.25, 0.75, 0.4, 0.3, 0.8] and got[1].score == [1.0]
    assert got[1].student_score == [1.0] and got[1].prior_score == [3.0]
    assert N.fuse_score_rows(student, prior, ["n"], "score", 7.0).filter("n = 0").first().score == [1.0, 0.0, 0.4, 0.6, 0.8]
    for a, b in ((student, prior.filter("n = 0")), (student.filter("n = 0"), prior)):
        with pytest.raises(Exception, match="different lengths"):
            N.fuse_score_rows(a, b, ["n"], "score", 0.25).collect()
    for short in ([0.5] * 4, None):
        with pytest.raises(Exception, match="different shapes"):
            N.fuse_score_rows(student, of((0, short), (1, [1.0])), ["n"], "score", 0.25).collect()


def test_fingerprint_depends_on_content_only(spark):
    rows = [("k", 1, "x", 10), ("k", 2, None, 20)]
    of = lambda r: R.content_fingerprint(spark.createDataFrame(r, "k string, i int, h string, mtime int"), ["k"], "i", "h").first().fingerprint
    assert of(rows) == of([(k, i, h, m + 1) for k, i, h, m in reversed(rows)]) != of([("k", 1, "y", 10), rows[1]])
    assert len(of(rows)) == 64


def test_readers(spark, tmp_path):
    schema = "a int, b string"
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": "u"}\n\n{"a": 2\n[1]\n{"a": 3, "z": 0}\n')
    (tmp_path / "ok.jsonl").write_text('{"a": 1, "b": "u"}\n')
    assert sorted(r.a for r in readers.lenient_json(spark, str(tmp_path / "x.jsonl"), schema).collect()) == [1, 3]
    assert readers.strict_json(spark, str(tmp_path / "ok.jsonl"), schema).count() == 1
    with pytest.raises(Exception):
        readers.strict_json(spark, str(tmp_path / "x.jsonl"), schema).collect()
    (tmp_path / "rows.json").write_text(json.dumps({"rows": [{"a": 5, "b": "r"}, {"a": 6}]}, indent=1))
    (tmp_path / "list.json").write_text(json.dumps([{"a": 7}]))
    for name, want in (("rows.json", [5, 6]), ("list.json", [7]), ("ok.jsonl", [1])):
        assert sorted(r.a for r in readers.manifest_rows(spark, str(tmp_path / name), "struct<a: int, b: string>").collect()) == want
    (tmp_path / "m.csv").write_text("key,v,w\nk,1.5,x\nk,2.5,3\nj,,1\n")
    assert {r.key: (r.v, r.w) for r in readers.metric_csv(spark, str(tmp_path / "m.csv"), "key", ["v", "w"]).collect()} == {"k": (2.5, 3.0), "j": (None, 1.0)}
    (tmp_path / "img").mkdir()
    for n in ("a.PNG", "b.txt", "c.jpg"):
        (tmp_path / "img" / n).write_bytes(b"1")
    files = readers.file_inventory(spark, str(tmp_path / "img"), hashes=True).collect()
    assert len(files) == 2 and len(files[0].sha256) == 64
    assert readers.newest_union(spark, str(tmp_path / "none.jsonl"), [str(tmp_path / "ok.jsonl")], schema).count() == 1


def test_publish_keeps_the_current_run_on_failure(spark, tmp_path):
    root = str(tmp_path / "pub")
    first = sinks.publish(spark, root, {"t": spark.range(3)}, {"t": "id >= 0"})
    with pytest.raises(ValueError):
        sinks.publish(spark, root, {"t": spark.range(9)}, {"t": "id < 5"})
    assert sinks.current(spark, root, "t").count() == 3
    second = sinks.publish(spark, root, {"t": spark.range(4)})
    assert first != second and sinks.current(spark, root, "t").count() == 4
    sinks.seal(spark.range(1), str(tmp_path / "sealed"))
    with pytest.raises(Exception):
        sinks.seal(spark.range(1), str(tmp_path / "sealed"))


def test_stream_upsert(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "table")
    schema = "k long, o long, v string"
    run = lambda: stream_upsert(spark, source, schema, target, ["k"], "o", str(tmp_path / "ck")).awaitTermination(120)
    spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (1, 2, "c")], schema).write.parquet(source)
    run()
    spark.createDataFrame([(2, 5, "new"), (1, 1, "old"), (3, 1, "d")], schema).write.mode("append").parquet(source)
    run()
    assert {r.k: r.v for r in latest(spark, target, schema).collect()} == {1: "c", 2: "new", 3: "d"}
    run()  # nothing new
    assert latest(spark, target, schema).count() == 3 and latest(spark, str(tmp_path / "none"), schema).count() == 0


def test_windowed_counts_on_a_stream(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01 00:01:00' as ts, 'a' as t, 1.0d as v union all select timestamp'2024-01-01 00:04:00', 'a', 2.0d")
    rows.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "ev"))
    q = windowed_counts(stream, "ts", "t", "v").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.n_rows, r.total) for r in spark.sql("select * from w").collect()] == [(2, 3.0)]

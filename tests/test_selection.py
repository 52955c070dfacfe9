from pyspark.sql import functions as F

from tesserae.functions import scalars as S
from tesserae.operators import selection as sel


def test_quota_of_special_rows(spark):
    rows = [("g", f"rep_{x}", s, True) for x, s in zip("abc", (10, 9, 8))] + [("g", f"nat_{x}", s, False) for x, s in zip("ab", (7, 6))]
    df = spark.createDataFrame(rows, "g string, id string, score int, rep boolean")
    got = {r.id for r in sel.capped_top_k(df, ["g"], "score", "id", F.col("rep"), 4, 0.5).collect()}
    assert got == {"rep_a", "rep_b", "nat_a", "nat_b"}
    back_filled = [r.id for r in sel.capped_top_k(df, ["g"], "score", "id", F.col("rep"), 5, 0.2).orderBy("place").collect()]
    assert back_filled == ["rep_a", "nat_a", "nat_b", "rep_b", "rep_c"]
    assert sel.capped_top_k(df, ["g"], "score", "id", F.col("rep"), 0, 0.5).count() == 0
    thrice = df.unionAll(df).unionAll(df)
    again = [r.id for r in sel.capped_top_k(thrice, ["g"], "score", "id", F.col("rep"), 5, 0.2, repeated=True).orderBy("place").collect()]
    assert again == back_filled
    assert sel.top_k(df, ["g"], "score", "id", 2).count() == 2 and sel.top_k(df, ["g"], "score", "id", 0).count() == 0


def test_first_best_keeps_the_first_of_equals(spark):
    df = spark.createDataFrame([("k", 1, 0.5), ("k", 2, 0.5), ("k", 3, None)], "k string, n int, s double")
    assert sel.first_best(df, ["k"], "s", "n").first().n == 1


def test_disposition(spark):
    d = spark.range(1).select(sel.disposition(F.lit(0.6), F.lit(0.5), F.lit(0.1)), sel.disposition(F.lit(0.6), F.lit(0.5), F.lit(0.3)), sel.disposition(F.lit(0.1), F.lit(0.0), F.lit(0.0)))
    assert tuple(d.first()) == ("hard_mask_ok", "soft_mask_only", "needs_review")


def _verdicts(spark, rows):
    df = spark.createDataFrame(rows, "au double, ap double, di double, ra double, tr double, ratio double")
    base = {"auroc": F.lit(0.80), "aupro": F.lit(0.45), "dice": F.lit(0.24)}
    return [r[0] for r in df.select(sel.arbitration(*[F.col(c) for c in ("au", "ap", "di", "ra", "tr", "ratio")], base)["verdict"]).collect()]


def test_arbitration(spark):
    assert _verdicts(spark, [(0.83, 0.50, 0.25, 0.065, 0.05, 0.25), (0.78, 0.40, 0.20, 0.12, 0.05, 0.50)]) == ["recommended", "demote_ratio"]


def test_scalars(spark):
    df = spark.createDataFrame([("", 0, "x", "1.5"), (None, 3, "y", "nan"), ("a", None, "z", "abc"), ("", 0, None, None)], "a string, b int, c string, n string")
    rows = df.select(S.first_truthy(F.col("a"), F.col("b").cast("string"), F.col("c")), S.safe_number(F.col("n"), -1.0)).collect()
    assert [tuple(r) for r in rows] == [("x", 1.5), ("3", -1.0), ("a", -1.0), (None, -1.0)]
    one = spark.range(1).select(
        S.angle_difference(F.lit(170.0), F.lit(10.0)), S.answered_json(F.lit('Sure: {"a": {"b": 1}} ok')), S.answered_json(F.lit("none")),
        S.clipped_box(S.box(F.lit(9), F.lit(-2), F.lit(1), F.lit(30)), F.lit(8), F.lit(20)),
    ).first()
    assert one[0] == 20.0 and one[1] == '{"a": {"b": 1}}' and one[2] is None and tuple(one[3]) == (1, 0, 8, 20)

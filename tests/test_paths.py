import pytest
from pyspark.sql import functions as F

from tesserae.functions.paths import file_key, file_name, file_stem, file_suffix, parent_dir

CASES = {
    "data/a/b.png": "data/a/b.png",
    "  data/a/b.png\t": "data/a/b.png",
    "data/a/c.png\n": "data/a/c.png", "\ndata/a/c.png": "data/a/c.png",
    "./data/a/b.png": "data/a/b.png",
    "../../data/a/b.png": "data/a/b.png",
    "/mnt/lab/data/a/b.png": "data/a/b.png",
    "file:///mnt/lab/data/a%20c/b.png": "data/a c/b.png",
    "D:\\lab\\outputs\\a\\b.png": "outputs/a/b.png",
    "outputs\\a\\b.png": "outputs/a/b.png",
    "outputs//a/./b.png": "outputs/a/b.png",
    "outputs/tmp/../a/b.png": "outputs/a/b.png",
    "outputs/a/x/y/../../b.png": "outputs/a/b.png",
    "/srv/lab/x/data_old/a.png": "data_old/a.png",
    "data/50%.png": "data/50%.png",
    "data/a+b.png": "data/a+b.png",
    "data/A/B.PNG": "data/A/B.PNG", "data/lot 7/b.png": "data/lot 7/b.png", "data/a/../b.png": "data/b.png", "data/a/.": "data/a/", "data": "data",
    "data/.hidden.png": "data/.hidden.png",
    "outputs/data/b.png": "outputs/data/b.png",
    "/elsewhere/b.png": "elsewhere/b.png",
    "": None, "   ": None, "-": None, "N/A": None, "unknown": None, "None": None, None: None,
}


def test_notations_of_one_file(spark):
    df = spark.createDataFrame([(k, v) for k, v in CASES.items()], "p string, want string")
    wrong = [(r.p, r.want, r.got) for r in df.withColumn("got", file_key("p")).collect() if r.want != r.got]
    assert not wrong


@pytest.mark.parametrize(
    "path,want", [("a/b/c.tar.gz", ("c.tar.gz", "c.tar", ".gz", "a/b")), ("x", ("x", "x", "", "")), (".env", (".env", ".env", "", "")), ("a\\b.PNG", ("b.PNG", "b", ".png", "a"))]
)
def test_parts_of_a_path(spark, path, want):
    p = F.lit(path)
    assert tuple(spark.range(1).select(file_name(p), file_stem(p), file_suffix(p), parent_dir(p)).first()) == want

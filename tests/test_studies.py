"""The named studies on small tables."""

import pytest
from pyspark.sql import functions as F

from corpusloom.plans import studies as S


@pytest.mark.parametrize("n", [0, 1, 7, 450, 999, 1000, 2000])
def test_largest_is_exact_with_ties_and_unreadable_scores(spark, n):
    rows = [(i, str(i * 7919 % 10) if i % 3 else str(i)) for i in range(1000)] + [(2000, None), (2001, "x"), (2002, "NaN")]
    df = spark.createDataFrame(rows, "k int, s string")
    want = sorted(rows[:1000], key=lambda r: (-float(r[1]), r[0]))[:n]
    assert sorted(r.k for r in S.largest(df, F.col("s"), n, ["k"], 0.01).collect()) == sorted(k for k, _ in want)


def test_arms(spark):
    df = spark.createDataFrame([(i, f"s{i}", None if i == 3 else f"t{i}", str(i / 100), "0.95" if i % 2 else "0.5") for i in range(40)], "ordinal int, src string, tgt string, score string, lid string")
    arms = S.domain_arms(df, df, "score", {"lid": 0.9}, 5)
    assert arms["narrow"].count() == 39 and {r.ordinal for r in arms["broad"].collect()} == {31, 33, 35, 37, 39}
    assert S.matched_arms(df.limit(4), df, "score")["other"].count() == 4
    assert {k: v.count() for k, v in S.equal_sized({"a": df, "b": df.limit(9)}, "src").items()} == {"a": 9, "b": 9}
    built = S.build_arm(df.na.drop(), None, 20)
    assert built.count() == 20 and {r.split for r in built.select("split").distinct().collect()} == {"train", "validation", "test"}
    assert sorted(x.count() for x in S.floors_by_source({"p": df, "q": df}, "score", {"p": 0.3}, 0.35, {"lid": 0.9})) == [2, 5]
    assert S.reversed_pairs(df).filter("ordinal = 1").first().asDict()["src"] == "t1"


def test_stratification_study(spark):
    curated = {"health": spark.createDataFrame([(i, f"ሰላም {i}", f"peace {i % 5}" + "(" * (i == 0)) for i in range(12)] + [(50, "ሰላም 1", "peace 1")], "ordinal int, src string, tgt string")}
    mined = spark.createDataFrame([(i, f"m{i}", f"n{i}", f"http://x.site{i % 3}.org/", None, "0.9" if i < 20 else "0.1") for i in range(24)] + [(99, "m", "n", None, None, "0.9")], "ordinal int, src string, tgt string, source_url string, target_url string, africomet_score string")
    pool = S.stratification_pool(curated, mined, {"africomet_score": 0.8}, top=2)
    assert {r.domain: r["count"] for r in pool.groupBy("domain").count().collect()} == {"health": 11, "site0.org": 7, "site1.org": 7}
    for df in S.three_splits(pool.withColumn("cluster", F.length("src") % 2)).values():
        assert df.count() == 25 and df.filter("split is null").count() == 0


def test_encoding_and_preparation(spark):
    df = spark.createDataFrame([(1, "ab cd", "Hello, you"), (2, "x " * 200, "y")], "k int, src string, tgt string")
    encode = lambda c: F.transform(F.split(c, " "), lambda w: F.length(w) + 10)
    row = S.encoded_arm(df, encode, source=F.lower).collect()
    assert [(r.k, list(r.src), list(r.tgt)) for r in row] == [(1, [2, 12, 12, 3], [2, 15, 11, 13, 3])]
    words = spark.createDataFrame([([2, 12, 1, 3, 0],)], "ids array<int>")
    assert words.select(S.redecoded(F.col("ids"), lambda c: F.array_join(c.cast("array<string>"), " ")).alias("t")).first().t == "12 1"
    assert (S.recipe_of(0.5), S.recipe_of(0.2)) == ("translit", "normalize")
    text = spark.createDataFrame([("ሰላም",), ("",)], "t string")
    assert [r.t for r in text.select(S.prepared(F.col("t"), "translit").alias("t")).collect()][0] == "səlam"
    assert text.select(S.prepared(F.col("t"), "normalize").alias("t")).count() == 2
    with pytest.raises(ValueError):
        S.prepared(F.col("t"), "other")


def test_published_splits(spark, tmp_path):
    (tmp_path / "dev.am").write_text("a\nb\n")
    (tmp_path / "dev.en").write_text("c\nd\n")
    (tmp_path / "test.csv").write_text('src,tgt\n"x\ny",z\nonly,\n')
    got = S.read_split(spark, str(tmp_path), "validation", {"validation": "dev"}, (".am", ".en"))
    assert sorted(map(tuple, got.collect())) == [(0, "a", "c"), (1, "b", "d")]
    assert [tuple(r) for r in S.read_split(spark, str(tmp_path), "test").collect()] == [(0, "x\ny", "z")]


def test_scores_over_seeds(spark):
    runs = spark.createDataFrame([("a", 1, 0), ("a", 2, None), ("b", 1, 1), ("b", 2, 0), ("b", 3, 0)], "arm string, seed int, returncode int")
    scored = spark.createDataFrame([("b", 2)], "arm string, seed int")
    todo = S.pending_scores(runs, scored, ["a", "b"], ["flores"])
    assert sorted(map(tuple, todo.collect())) == [("a", 1, "cross", "b"), ("a", 1, "flores", "flores"), ("a", 1, "own", "a"), ("b", 3, "cross", "a"), ("b", 3, "flores", "flores"), ("b", 3, "own", "b")]
    report = S.seed_report(spark.createDataFrame([("a", "own", 1.0), ("a", "own", 3.0), ("b", "own", 2.0)], "arm string, metric string, bleu double"))
    assert sorted(map(tuple, report.collect())) == [("a", "own", 2, 2.0, 1.41421), ("b", "own", 1, 2.0, None)]
    means = S.mean_tensors(spark.createDataFrame([("w", [1.0, 2.0]), ("w", [3.0, 2.0])], "t string, v array<float>"), "t", "v")
    assert sorted(map(tuple, means.collect())) == [("w", 0, 2.0), ("w", 1, 2.0)]

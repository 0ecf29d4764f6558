"""What a task holds does not grow with the batch that it is given, nor its time faster than the text."""

import difflib
import re
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import analysis as A
from corpusloom.operators import relational as R
from corpusloom.plans.queries import QUERIES


def peak_mb(f) -> tuple[object, float]:
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_nearest_neighbours_hold_a_slice_of_products():
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (20_000, 8)).astype(np.float64)  # whole numbers: many ties
    ids = rng.permutation(20_000)
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(x))], names=["id", "v"])
    q_ids, q = ids[:300], x[:300]
    out, mb = peak_mb(lambda: A.best_products(iter([batch.slice(0, 15_000), batch.slice(15_000)]), q_ids, q, 256))
    assert mb < 15  # all products at once are 48 MB
    s = q @ x.T
    s[np.arange(300), np.arange(300)] = -np.inf
    wanted = [(int(i), int(ids[row == row.max()].min()), float(row.max())) for i, row in zip(q_ids, s, strict=True)]
    assert list(zip(*(c.to_pylist() for c in out.columns), strict=True)) == wanted


def test_nearest_neighbours_pass_over_nulls(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.0]), (None, [9.0, 0.0]), (3, None)], "id long, v array<double>")
    out = A.nearest_neighbours(rows, rows.filter("id = 1"), "id", "v").collect()
    assert [tuple(r) for r in out] == [(1, 2, 0.5)]


def test_distinct_trigrams_deal_out_no_text(spark, tmp_path):
    texts = [("a", "x y z x y z x"), ("a", "X y  z"), ("a", " y z"), ("a", "x y"), ("b", "yz x y z"), ("b", None), ("b", ""), (None, "x y z"), ("c", "y")]
    spark.createDataFrame(texts, "lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["distinct_trigram_ratio"](spark, str(tmp_path))
    assert sorted(map(tuple, out.collect()), key=str) == [("a", 7, round(4 / 7, 6)), ("b", 2, 1.0), (None, 1, 1.0)]
    assert "array_join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_transliteration_looks_letters_up_by_place(spark):
    """A map is searched from its first key to the last, for every letter."""
    df = spark.createDataFrame([("ሰላም\t፴፪ abc ፴፪ሰ ፡  😀 ፻",), ("",), (None,)], "t string").select(X.transliterate(F.col("t")).alias("latin"))
    assert [r.latin for r in df.collect()] == ["səlam 32 abc 302sə   😀 100", "", None]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not any("ለ" in keys or "ላ" in keys for keys in re.findall(r"keys: \[([^\]]*)\]", plan))


def test_bleu_holds_a_slice_of_segments():
    words = [[f"w{i * 7 % 97}" for i in range(k, k + 40)] for k in range(5_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5_000)), pa.array(words), pa.array(words[1:] + [None])], names=["seg", "h", "r"])
    parts, mb = peak_mb(lambda: list(A.count_segments(iter([batch, batch.slice(0, 0)]), "seg")))
    assert mb < 10  # all tokens at once are over 20 MB
    out = pa.Table.from_batches(parts).to_pylist()
    assert [r["seg"] for r in out] == list(range(5_000))
    assert (out[0]["sys_len"], out[0]["ref_len"], out[0]["correct_1"], out[0]["correct_4"], out[0]["total_4"]) == (40, 40, 39, 36, 37)
    assert (out[-1]["ref_len"], out[-1]["correct_1"], out[-1]["total_1"]) == (0, 0, 40)


def test_ratios_hold_a_slice_of_counts():
    letters = "abcdefghijklmnopqrstuvwxyzéèü"
    x = pa.array([f"{letters}{k}" for k in range(5_000)])
    y = pa.array([f"{letters[:15]}{letters[:k % 20]}{k}" for k in range(5_000)])
    out, mb = peak_mb(lambda: R.ratios(x, y, 0.0))
    assert mb < 5  # the counts of all texts are over 15 MB
    assert out.to_pylist() == [difflib.SequenceMatcher(None, s, t, autojunk=False).ratio() for s, t in zip(x.to_pylist(), y.to_pylist(), strict=True)]
    assert R.ratios(pa.array(["abcd", "abcd"]), pa.array(["abcx", "wxyz"]), 0.7).to_pylist() == [0.75, None]


def test_composition_holds_a_slice_of_texts(spark):
    texts = pa.array([None, "e\u0301" * 500, "abc"] * 2_000)
    out, mb = peak_mb(lambda: X.compose(texts))
    assert mb < 5  # all texts are over 8 MB
    assert out.to_pylist() == [None, "é" * 500, "abc"] * 2_000
    df = spark.createDataFrame([("e\u0301",), ("abc",), ("",), (None,)], "t string")
    assert [r.t for r in df.select(X.nfc(F.col("t")).alias("t")).collect()] == ["é", "abc", "", None]

"""The pipeline stage by stage, each against a plain re-statement of its decision on its own input."""

from collections import Counter

import corpus_pipeline
from corpusloom.llm import decontamination
from corpusloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, after = docs.collect(), stage(spark, docs, SF)
        rows = after.collect()
        if k < 4:
            assert after.columns == columns
            assert not Counter(r.doc_id for r in rows) - Counter(r.doc_id for r in before)
        if name == "quality_rules":
            judged = QUERIES["op4_quality_rules"](spark, SF)
            assert {r.doc_id for r in rows} == {r.doc_id for r in judged.filter("kept").collect()}
        if name == "simhash_near_dedup":
            texts = Counter(r.text for r in rows)
            assert max(texts.values()) == 1 and {r.text for r in rows} <= {r.text for r in before}
        if name == "benchmark_decontamination":
            items = [decontamination.normalise(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert not any(i in decontamination.normalise(r.text) for r in rows for i in items)
        if name == "pii_sanitisation":
            assert len(rows) == len(before) and all(r.n_chars == len(r.text) and "@mail" not in r.text for r in rows)
        if name == "source_mixing":
            assert 0 < len(rows) <= len(before) and all(r.taken == r.copies * r.size for r in rows)
        docs = spark.createDataFrame(rows, after.schema)


def test_registry():
    assert len(QUERIES) == 10 and set(ORACLE_SQL) <= set(QUERIES)


def test_chat_oracle(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    found = con.sql(ORACLE_SQL["op2_format_chat"])
    got = QUERIES["op2_format_chat"](spark, SF)
    assert sorted(map(tuple, got.select(*found.columns).collect())) == sorted(found.fetchall())


NAMES = "doc_id long, text string, lang string, source string, n_chars long, `row` string, _text string, own_th int, `a.b` string, sanitised string"


def test_stages_take_nulls_repeats_clashing_names_and_empty_tables(spark):
    a, b = (" ".join(f"{w}{i % 50}" for i in range(60)) for w in ("word", "other"))
    rows = [(1, a), (None, a), (None, b), (5, b), (5, a + " tail"), (7, None), (None, None), (8, ""), (9, f"{b} mail me@x.example.org {a}"), (5, b)]
    docs = spark.createDataFrame([(i, t, None, None, None, "r", "t", k, None, "s") for k, (i, t) in enumerate(rows)], NAMES)
    kept = corpus_pipeline.simhash_near_dedup(spark, docs, SF).collect()
    # The groups: a with its tail and its null-id copy; b; the texts without a word; the mix of both.
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, a), (5, b), (7, None), (9, rows[8][1])], key=lambda r: r[0])
    alone = corpus_pipeline.simhash_near_dedup(spark, docs.filter("doc_id = 1 or doc_id is null and text = '" + a + "'"), SF)
    assert [r.doc_id for r in alone.collect()] == [1]
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, SF)
            n = out.count()
            if name != "source_mixing":
                assert out.columns == docs.columns and n <= table.count()
            if name == "benchmark_decontamination":
                assert n == table.count()
            if name == "pii_sanitisation" and n:
                texts = {r.own_th: r.text for r in out.collect()}
                assert len(texts) == len(rows) and "[EMAIL]" in texts[8] and texts[5] is None and texts[0] == a

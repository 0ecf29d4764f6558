"""Golden rows and invariants of the corpus operators."""

import difflib
import io
import math
import tarfile
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import analysis as A
from corpusloom.operators import relational as R
from corpusloom.cli import main
from corpusloom.plans.pipelines import PROFILES, Profile, build, clean, contamination, contamination_report, single_source
from corpusloom.plans.queries import QUERIES
from corpusloom.sources import readers


def one(spark, f, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r[0] for r in df.select("i", f(F.col("text")).alias("x")).orderBy("i").select("x").collect()]


@pytest.mark.parametrize(
    "function,text,expected",
    [
        (X.sentence_period, 'he said "no."', 'he said "no።"'),
        (X.sentence_period, "አ.ክ.ም", "አ.ክ.ም"),
        (X.sentence_period, "3.14", "3.14"),
        (X.sentence_period, "ሰላም...", "ሰላም..."),
        (X.sentence_period, "ሰላም..", "ሰላም.."),
        (lambda c: X.merge_homophones(X.labialise(c)), "ኹዋአ", "ኋ"),
        (X.labialise, "ሉዋአ", "ሏ"),
        (X.labialise, "ልዋ", "ልዋ"),
        (X.merge_homophones, "ሐሠዐፀኸ", "ሀሰአጸኸ"),
        (X.plain_quotes, "“a” ‘b’ «c» ‹d› e′", "\"a\" 'b' \"c\" \"d\" e'"),
        (X.doubled_wordspace, "ሰላም፡ ፡ልጅ", "ሰላም። ልጅ"),
        (X.ethiopic_punctuation, "ሰላም፡ልጅ, ; : ?", "ሰላም ልጅ፣ ፤ ፥ ፧"),
        (X.nfc, "é", "é"),
        (X.nfc, None, None),
        (X.comparison_key, "A, b.", "ab"),
        (X.transliterate, "ሰላም", "səlam"),
        (X.transliterate, "፴፪", "32"),
        (X.spell_ethiopic, "səlam", "ሠላም"),
        (X.unescape_html, "&lt;a&gt; &amp;amp; &quot;", '<a> &amp; "'),
        (X.moses_tokens, "He said, (don't) pay 3,500.", "He said , ( don 't ) pay 3,500 ."),
        (X.moses_detokens, "He said , ( don 't ) pay 3,500 .", "He said, (don't) pay 3,500."),
    ],
)
def test_text(spark, function, text, expected):
    assert one(spark, function, text) == [expected]


def test_ngrams(spark):
    sizes = one(spark, lambda c: F.size(X.word_ngrams(X.word_tokens(c))), "a b c d", "a b c d e", "a b c d e f g", "")
    assert sizes == [1, 1, 3, 0]


def test_filters(spark):
    assert one(spark, lambda c: R.length_between(c, 5, 500), "x" * 5, "x" * 6, "x" * 499, "x" * 500, None) == [False, True, True, False, False]
    assert one(spark, R.balanced_parens, "ሀ) text", "a) text", "text) more", "(a)") == [True, True, False, True]
    assert one(spark, lambda c: R.pure_script(c, R.ETHIOPIC_FOREIGN), "ቫይታሚን B9(folate)", "ከ6-59 ወር", "ሰላም 3.") == [False, False, True]


def test_hosts(spark):
    assert one(spark, lambda c: X.registered_domain(X.host(c)), "https://am.econologie.com/x", None, "ftp://a.b", "http://u@www.bbc.co.uk:80/", "http://10.0.0.1/") == ["econologie.com", "unknown", "unknown", "bbc.co.uk", "unknown"]


def test_small_cut(spark):
    train, valid = R.small_cut(F.col("id"))
    got = {r[0]: (r[1], r[2], r[0] - r[1] - r[2]) for r in spark.range(1, 13).select("id", train, valid).collect()}
    assert got == {1: (1, 0, 0), 2: (0, 1, 1), 3: (1, 1, 1), 4: (2, 1, 1), 5: (3, 1, 1), 6: (3, 1, 2), 7: (4, 1, 2), 8: (5, 1, 2), 9: (6, 1, 2), 10: (8, 1, 1), 11: (8, 1, 2), 12: (9, 1, 2)}


def test_floors(spark):
    df = spark.createDataFrame([(1, "0.8", None), (2, "0.7", None), (3, None, 1.2), (4, None, None), (5, "x", None)], "i int, labse_score string, laser_score double")
    keep = R.above_floors(df.columns, {"labse_score": 0.7, "absent": 0.9, "laser_score": 0.0}, {"labse_score": "laser_score"})
    assert [r.i for r in df.filter(keep).orderBy("i").collect()] == [1, 3]


def test_float_literal(spark):
    df = spark.createDataFrame([(1.08,), (1.09,)], "s float")
    assert readers.mined_pairs(df, {"s": 1.08}, {"s": "score"}).count() == 1


def test_cache_computes_each_key_once(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "text string")
    cache = df.filter("text = 'b'").select(X.content_key(F.col("text")).alias("key"), F.lit(9.0).alias("score"))
    asked = []

    def compute(missing):
        asked.append(missing.count())
        return missing.withColumn("score", F.lit(1.0))

    rows = {(r.text, r.score) for r in R.cached_scores(df, cache, ["text"], "score", compute, F.col("text") == "c").collect()}
    assert asked == [1] and rows == {("a", 1.0), ("b", 9.0), ("c", None)}


def test_split_never_leaks(spark):
    df = spark.createDataFrame([(i, f"t{i % 60}", "d1" if i % 2 else None) for i in range(200)], "ordinal long, text string, domain string")
    s = R.split_groups(df, "text", ["domain"], cut=R.small_cut)
    assert s.count() == 200
    assert s.groupBy("text").agg(F.countDistinct("split").alias("k")).filter("k > 1").count() == 0


def test_sequence_ratio(spark):
    pairs = [("abcd", "bcde"), ("", "a"), ("same", "same")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(R.sequence_ratio(F.col("a"), F.col("b"))).collect()] == [difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() for a, b in pairs]


def test_bleu_perfect_and_empty(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat.", "the cat sat on the mat."), (2, "", "a b c d")], "k int, h string, r string")
    stats = A.segment_stats(df, "k", A.tokens_13a(F.col("h")), [A.tokens_13a(F.col("r"))])
    got = {r.k: r.bleu for r in A.bleu(stats, ["k"]).collect()}
    assert got == {1: 100.0, 2: 0.0}
    assert A.chrf(df.filter("k = 1"), "k", F.col("h"), F.col("r")).first()[0] == 100.0


def test_chunked_reader_and_aligned(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('x "q\ty\t1.5\nx\ty\tbad\n')
    assert readers.read_tsv(spark, str(tmp_path / "a.tsv"), ["a", "b"], ["s"]).collect()[0].a == 'x "q'
    (tmp_path / "l.txt").write_text("1\n2\n3\n")
    (tmp_path / "r.txt").write_text("a\nb\nc\n")
    got = readers.read_aligned(spark, str(tmp_path / "l.txt"), str(tmp_path / "r.txt"))
    assert [(r.src, r.tgt) for r in got.orderBy("ordinal").collect()] == [("1", "a"), ("2", "b"), ("3", "c")]
    (tmp_path / "m.jsonl").write_text('{"translation": {"am": "ሰ", "en": "s"}}\n\n')
    assert readers.read_translation_jsonl(spark, str(tmp_path / "m.jsonl"), "am", "en").first().tgt == "s"
    (tmp_path / "v.xml").write_text('<t><seg id="v1"> a\n b </seg><seg id="v2"> </seg></t>')
    assert [(r.verse, r.text) for r in readers.read_verses(spark, str(tmp_path / "v.xml")).collect()] == [("v1", "a b")]


def test_archive_members(spark, tmp_path):
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as archive:
        for name, text in (("top/dev/am.dev", "ሀ\nለ\n"), ("top/dev/en.dev", "h\nl\n"), ("top/dev/fr.dev", "x\n")):
            entry = tarfile.TarInfo(name)
            entry.size = len(text.encode())
            archive.addfile(entry, io.BytesIO(text.encode()))
    got = readers.read_archive(spark, str(tmp_path / "b.tar.gz"), ["dev/am.dev", "dev/en.dev"])
    assert sorted(map(tuple, got.collect())) == [("dev/am.dev", 0, "ሀ"), ("dev/am.dev", 1, "ለ"), ("dev/en.dev", 0, "h"), ("dev/en.dev", 1, "l")]
    with pytest.raises(ValueError):
        readers.read_archive(spark, str(tmp_path / "b.tar.gz"), ["test/am.test"])


def test_strict_lookup(spark):
    df = spark.createDataFrame([("a",), ("b",)], "text string")
    table = df.select(X.content_key(F.col("text")).alias("key"), F.lit(1.0).alias("v"))
    assert R.strict_lookup(df, table, ["text"], "v").count() == 2
    with pytest.raises(KeyError):
        R.strict_lookup(df, table.limit(1), ["text"], "v")


def test_nearest_texts(spark):
    df = spark.createDataFrame([(1, "The cat sat"), (2, "a cat sat down"), (3, "zzz"), (4, "the cat sat"), (5, None)], "k long, t string")
    got = {r.query_id: (r.neighbour_id, r.similarity) for r in A.nearest_texts(df, F.col("k") > 0, "k", "t").collect()}
    assert got[1] == (4, 1.0) and got[4] == (1, 1.0) and got[2][0] == 1 and set(got) == {1, 2, 4}
    assert A.nearest_texts(df.limit(0), F.col("k") > 0, "k", "t").count() == 0
    assert one(spark, lambda c: F.array_join(A.char_grams(c), "|"), "Ab c", "") == [" ab|ab | ab | c ", ""]


def test_fixed_size_profile(spark):
    rows = [(i, f"ሰላም {i}", f"sentence {i}") for i in range(30)]
    df = spark.createDataFrame(rows, "ordinal long, src string, tgt string")
    assert build({"a": df}, None, Profile(sample_to=12)).count() == 12


def test_build_drops_benchmark_rows(spark):
    rows = [(i, f"ሰላም ልጅ ቁጥር {i} ነው", f"this is sentence number {i} of many sentences", 0.9, 0.9) for i in range(40)]
    df = spark.createDataFrame(rows, "ordinal long, src string, tgt string, labse_score double, africomet_score double")
    bench = spark.createDataFrame([(1, "x", "This is sentence number 7 of many sentences!")], "item_id long, src string, tgt string")
    out = build({"a": df, "b": df}, bench, Profile())
    tgts = {r.tgt for r in out.collect()}
    assert "this is sentence number 7 of many sentences" not in tgts
    assert out.groupBy("src").agg(F.countDistinct("split").alias("k")).filter("k > 1").count() == 0
    assert clean(df, PROFILES["production"], ["ordinal"]).count() == 40


SF = "/root/testdata/sf0.001"
PAIR = "ordinal long, src string, tgt string"


def test_benchmark_is_normalised_like_the_corpus(spark):
    pooled = spark.createDataFrame([(0, "ሰላም ሀገር፣ ደህና ነህ።", "peace to you my country and to all"), (1, "ሌላ ነገር", "something else entirely here now")], PAIR).withColumn("row", F.col("ordinal"))
    bench = spark.createDataFrame([(5, "ሠላም ሐገር, ደህና ነህ.", "nothing like it"), (6, "x", "Something else, entirely here now!"), (7, "", "peace to you my country and to all of them")], "item_id long, src string, tgt string")
    got = {r.row: (r.side, r.kind, r.item_id) for r in contamination(pooled, bench).collect()}
    assert got == {0: ("src", "exact", 5), 1: ("tgt", "exact", 6)}
    assert {r.row: r.side for r in contamination(pooled, bench, normalise=False).collect()} == {0: "tgt", 1: "tgt"}
    report = {(r["by"], r.value): (r.matches, r.share) for r in contamination_report(contamination(pooled, bench), 4).collect()}
    assert report[("all", "all")] == (2, 0.5) and report[("side", "src")] == (1, 0.25) and report[("kind", "exact")][0] == 2


def test_fuzzy_matches_against_brute_force(spark):
    lines = [f"{a} the quick brown fox jumps over {b} lazy dogs" for a in ("", "once", "so then") for b in ("the", "ten", "a hundred very")] + ["", "unlike anything"]
    items = ["the quick brown fox jumps over the lazy dogs", "once the quick brown fox jumps over ten lazy cats"]
    df = spark.createDataFrame([(i, t, "z" * 9) for i, t in enumerate(lines)], PAIR).withColumn("row", F.col("ordinal"))
    bench = spark.createDataFrame([(i, t, "q") for i, t in enumerate(items)], "item_id long, src string, tgt string")
    got = {r.row: (r.item_id, r.ratio) for r in contamination(df, bench, ("src",), normalise=False).collect()}
    want = {}
    key = lambda t: "".join(t.lower().split())
    grams = lambda t: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))}
    for i, t in enumerate(lines):
        scored = [(difflib.SequenceMatcher(None, key(t), key(b), autojunk=False).ratio(), len(grams(t) & grams(b)), -j) for j, b in enumerate(items) if t and grams(t) & grams(b)]
        if scored and max(scored)[0] >= 0.7:
            want[i] = (-max(scored)[2], round(max(scored)[0], 3))
    assert got == want and len(want) > 4


def test_build_stages_and_profiles(spark):
    rows = [(i, f"ሰላም ልጅ ቁጥር {i} ነው", f"this is sentence number {i} of many") for i in range(40)] + [(40, "ab", "too short a source"), (41, "ሰላም ልጅ ቁጥር 3 ነው", "another translation of the third")]
    df = spark.createDataFrame(rows, PAIR)
    both = {"human": df, "nllb": df}
    assert build({"human": df}, None, Profile()).count() == 41 and build({"nllb": df}, None, Profile()).count() == 40
    assert build(both, None, Profile(), stages=("floors", "split")).count() == 42
    assert "split" not in build(both, None, Profile(), stages=("clean",)).columns
    assert single_source(both, "human", None, PROFILES["single_source"]).count() == 41
    with pytest.raises(ValueError):
        build(both, None, Profile(excluded=("quran",)))
    with pytest.raises(ValueError):
        build(both, None, Profile(), stages=("clear",))


def test_keep_first_and_clashing_names(spark):
    df = spark.createDataFrame([(3, "a", 1), (1, "a", 2), (2, None, 3), (0, None, 4)], "n long, t string, _rank long")
    assert sorted(map(tuple, R.keep_first(df, ["t"], ["n"]).collect())) == [(0, None, 4), (1, "a", 2)]
    assert R.keep_first(df.limit(0), ["t"], ["n"]).count() == 0


def test_split_ranks_are_those_of_one_window(spark):
    df = spark.createDataFrame([(i, f"t{i % 700}") for i in range(900)], "ordinal long, text string").withColumn("d", F.lit("x"))
    import hashlib

    order = sorted({f"t{i % 700}" for i in range(900)}, key=lambda t: hashlib.sha1(b"42\0" + t.encode()).hexdigest())
    want = {t: "train" if k < 560 else "validation" if k < 630 else "test" for k, t in enumerate(order)}
    assert {r.text: r.split for r in R.split_groups(df, "text", ["d"]).collect()} == want


def test_checks_and_collections(spark):
    assert R.check_trim(100, 95, 90) is None and "20.0%" in R.check_trim(100, 80, 80)
    with pytest.raises(ValueError):
        R.check_trim(100, 10, 50)
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 1, None)], "k string, o int, split string")
    assert {r.k: r.split for r in R.collect_by(df, ["k"], "split", "o").collect()} == {"a": ["x", "y"], "b": [None]}
    assert R.only_split(df, "x").count() == 1 and R.only_split(df, None).count() == 3
    with pytest.raises(ValueError):
        R.only_split(df, "z")
    verses = spark.createDataFrame([("GEN 1:1", "ሀ"), ("GEN 1:2", "ለ")], "verse string, text string")
    english = spark.createDataFrame([("GEN 1:1", "in", "t1"), ("GEN 1:2", " <range> ", "t1"), ("GEN 1:1", "the", "t2"), ("GEN 1:2", "and", "t2")], "verse string, text string, translation string")
    assert sorted(r.tgt for r in R.verse_pairs(verses, english, 2).collect()) == ["and", "the"]


def test_public_suffixes(spark):
    rules = X.public_suffix_rules(spark.createDataFrame([(x,) for x in ("// a comment", "", "com", "uk", "co.uk", "*.ck", "!www.ck")], "value string"))
    hosts = {"www.bbc.co.uk": "bbc.co.uk", "a.b.com": "b.com", "co.uk": "unknown", "x.y.z.ck": "y.z.ck", "www.ck": "www.ck", "q.www.ck": "www.ck", "a.b.unlisted": "b.unlisted", "10.0.0.1": "unknown", "unknown": "unknown", "U@A.Com:80": "a.com"}
    got = X.registered_domains(spark.createDataFrame([(h,) for h in hosts], "host string"), rules)
    assert {r.host: r.domain for r in got.collect()} == hosts


def test_small_functions(spark):
    assert one(spark, lambda c: X.confidence(c, F.lit(1.0000001)), "a", " \n", None) == [1.0, 0.0, 0.0]
    assert one(spark, X.casefold, "Straße ΣΑΣ", None) == ["strasse σασ", None]
    assert one(spark, X.collapse_space, " a \u00a0\t b\u2003c\n") == ["a b c"]
    assert one(spark, lambda c: X.content_key(c, F.lit("b")), None, "") == one(spark, lambda c: X.content_key(F.lit(""), F.lit("b")), "", "")
    assert [round(x, 9) for x in one(spark, lambda c: X.length_penalty(F.length(c), 0.6), "abcdefg", "")] == [round(2**0.6, 9), round((5 / 6) ** 0.6, 9)]
    assert one(spark, lambda c: X.unknown_rate(F.transform(F.split(c, ""), lambda d: d.cast("int"))), "1123") == [0.5]
    assert one(spark, lambda c: X.pad_mask(F.array(F.lit(5), F.lit(0))), "") == [[1, 0]]


def test_statistics_against_plain_ones(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    p = np.linalg.eigvalsh(x @ x.T / 60)
    p = p[p > 1e-12]
    assert math.isclose(A.vendi_score(df, "v", 4), math.exp(-(p * np.log(p)).sum()), rel_tol=1e-6)
    same, far = F.col("k") % 2 == 0, F.col("v")[0] > 0
    (m0, p0), (m1, p1) = (A.mean_discrepancy(df, "v", y, "k", 1.0, features=2000) for y in (same, far))
    for y, m in ((np.arange(60) % 2 == 0, m0), (x[:, 0] > 0, m1)):
        k = np.exp(-((x[:, None] - x[None]) ** 2).sum(2))
        assert abs(k[y][:, y].mean() + k[~y][:, ~y].mean() - 2 * k[y][:, ~y].mean() - m) < 0.03
    assert p1 < 0.05 < p0
    aucs = {A.domain_shift_auc(d, "v", far, "k") for d in (df.coalesce(1), df.repartition(7))}
    assert max(aucs) - min(aucs) < 1e-9 and min(aucs) > 0.8


def test_clusters_and_semantic_split(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.05, (30, 3)) for c in ((0, 0, 5), (0, 5, 0), (5, 0, 0))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    found = {r.k: r.cluster for r in A.kmeans(df, "v", 3).collect()}
    assert all(len({found[i] for i in range(a, a + 30)}) == 1 for a in (0, 30, 60)) and len(set(found.values())) == 3
    split = QUERIES["split_semantic"](spark, SF)
    counts = Counter(r.split for r in split.collect())
    assert set(counts) == {"train", "validation", "test"} and counts["train"] > counts["validation"] + counts["test"] and sum(counts.values()) == split.select("vec_id").distinct().count()


def test_bleu_with_two_references(spark):
    df = spark.createDataFrame([(1, "the the cat sat", "the cat", "the the dog sat down now")], "k int, h string, a string, b string")
    r = A.segment_stats(df, "k", A.tokens_13a(F.col("h")), [A.tokens_13a(F.col("a")), A.tokens_13a(F.col("b"))]).first()
    assert (r.sys_len, r.ref_len, r.correct_1, r.correct_2, r.correct_3, r.total_4) == (4, 2, 4, 2, 0, 1)


def test_sinks_and_registry(spark, tmp_path):
    df = spark.createDataFrame([("k1", 1.0), ("k1", 1.0), ("k2", 2.0)], "key string, score double")
    for new in (df, df.withColumn("score", F.lit(9.0)).unionByName(spark.createDataFrame([("k3", 3.0)], df.schema))):
        readers.append_scores(spark, str(tmp_path / "cache"), new)
    assert {r.key: r.score for r in spark.read.parquet(str(tmp_path / "cache")).collect()} == {"k1": 1.0, "k2": 2.0, "k3": 3.0}
    assert readers.count_rows(spark, str(tmp_path / "cache")) == 3
    for row, schema in ((("a", 1), "model string, bleu int"), (("b", 2, 3), "model string, bleu int, chrf int")):
        readers.append_results_file(spark, str(tmp_path / "results"), spark.createDataFrame([row], schema))
    got = spark.read.csv(str(tmp_path / "results"), header=True)
    assert got.columns == ["model", "bleu", "chrf"] and sorted(map(tuple, got.collect()), key=str) == [("a", "1", None), ("b", "2", "3")]
    text = [(0, 'a "q", x\ny', "b")]
    readers.write_csv(spark.createDataFrame(text, PAIR), str(tmp_path / "c"))
    assert readers.read_csv(spark, str(tmp_path / "c"), ["ordinal", "src", "tgt"]).first().src == text[0][1]
    registry, calls = readers.Registry(), []

    @registry.add("one")
    def collect_one(spark):
        calls.append(1)
        return spark.range(3)

    folder = str(tmp_path / "raw")
    assert [registry.collect(spark, folder)["one"], registry.collect(spark, folder)["one"], registry.collect(spark, folder, ["one"])["one"], registry.collect(spark, folder, force=True)["one"]] == ["written", "kept", "written", "written"] and len(calls) == 3
    with pytest.raises(ValueError):
        registry.collect(spark, folder, ["two"])


def test_numbered_and_zipped_verses(spark, tmp_path):
    (tmp_path / "t.txt").write_text("".join(f"{i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 3000)
    try:
        lines = spark.read.text(str(tmp_path / "t.txt"))
        assert lines.rdd.getNumPartitions() > 1 and all(int(r.value) == r.ordinal for r in readers.numbered(lines).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with zipfile.ZipFile(tmp_path / "v.zip", "w") as z:
        z.writestr("a/v.xml", '<t><seg id="b.GEN.1.01"><s>a  b</s><s>c</s></seg><seg id="x"><s>n</s></seg><seg id="b.GEN.1.2"><s> </s></seg></t>')
    assert [tuple(r) for r in readers.read_zipped_verses(spark, str(tmp_path / "v.zip")).collect()] == [("GEN 1:1", "a b c")]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "s").mkdir()
    for name in ("human", "nllb"):
        (tmp_path / "s" / f"{name}.csv").write_text("src,tgt\n" + "".join(f"ሰላም ልጅ ቁጥር {i} ነው,this is sentence number {i} of many\n" for i in range(30)))
    (tmp_path / "b.csv").write_text("src,tgt\nx,This is sentence number 7 of many\n")
    run = lambda *a: main([*a[:1], *(str(x) for x in a[1:])])
    run("build", "--sources", tmp_path / "s", "--benchmark", tmp_path / "b.csv", "--out", tmp_path / "out")
    out = spark.read.parquet(str(tmp_path / "out"))
    assert 0 < out.count() < 30 and not out.filter("tgt like '%number 7 of%'").count()
    run("build", "--sources", tmp_path / "s", "--out", tmp_path / "all", "--skip", "split", "--only", "human")
    assert spark.read.parquet(str(tmp_path / "all")).count() == 30
    run("report", "--corpus", tmp_path / "all", "--benchmark", tmp_path / "b.csv")
    run("char-freq", "--corpus", tmp_path / "all", "--glyphs", "ሰላ")
    (tmp_path / "h.txt").write_text("the cat sat on the mat\n")
    run("evaluate", "--hypotheses", tmp_path / "h.txt", "--references", tmp_path / "h.txt")
    shown = capsys.readouterr().out
    assert "exact" in shown and "100.0" in shown
    spark.createDataFrame([("http://a.example.com/x", None), (None, "https://b.org/")], "source_url string, target_url string").write.parquet(str(tmp_path / "u"))
    run("remove-domain", "--corpus", tmp_path / "u", "--out", tmp_path / "v", "--domain", "example.com")
    assert spark.read.parquet(str(tmp_path / "v")).count() == 1

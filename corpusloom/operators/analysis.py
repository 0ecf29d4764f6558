"""Statistics, vectors and translation metrics as aggregations."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from itertools import batched, chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of some rows, so that no more than those are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


# ---------------------------------------------------------------- statistics


def effective_vocabulary(words: DataFrame, by: str, word: str = "word") -> DataFrame:
    """exp of the entropy of each group's word distribution."""
    counts = words.groupBy(by, word).agg(F.count(F.lit(1)).cast("double").alias("c"))
    sums = counts.groupBy(by).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("s"), F.count(F.lit(1)).alias("types"))
    return sums.select(by, "types", F.col("n").cast("long").alias("tokens"), F.round(F.exp(F.log("n") - F.col("s") / F.col("n")), 4).alias("effective"))


def distinct_trigrams(df: DataFrame, by: str, words: str) -> DataFrame:
    """(by, n, ratio): how many trigrams each group's lists of words have, and the share of distinct ones.

    A trigram is counted by two 64-bit hashes of its words, in different orders, so that rows of
    fixed width are dealt out and not its text; of 10 billion trigrams two share both with probability 1.5e-19.
    """
    n = F.size(words) - 2
    threes = F.arrays_zip(F.slice(words, 1, n).alias("a"), F.slice(words, 2, n).alias("b"), F.slice(words, 3, n).alias("c"))
    grams = df.select(by, F.explode(F.when(n > 0, threes)).alias("g"))
    counts = grams.groupBy(by, F.xxhash64("g.a", "g.b", "g.c").alias("h"), F.xxhash64("g.c", "g.a", "g.b").alias("k")).agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy(by).agg(F.sum("c").alias("n"), F.round(F.count(F.lit(1)) / F.sum("c"), 6).alias("ratio"))


def mann_whitney(df: DataFrame, value: str, first: Column) -> DataFrame:
    """U of the rows where ``first`` holds against the others, ties averaged, and its z.

    Ranks come from the counts of distinct values, added up within ranges and over the ranges;
    the bounds of the ranges only divide the work.
    """
    counts = df.groupBy(value).agg(F.sum(first.cast("long")).alias("a"), F.count(F.lit(1)).alias("t"))
    # Running totals in two steps: within ranges of values, then over the few ranges.
    bounds = counts.approxQuantile(value, [i / 64 for i in range(1, 64)], 0.005)
    parts = counts.withColumn("_p", F.size(F.filter(F.array(*(F.lit(float(b)) for b in sorted(set(bounds)))), lambda b: b < F.col(value))))
    return _mann_whitney_sums(parts, value)


def _mann_whitney_sums(parts: DataFrame, value: str) -> DataFrame:
    inner = Window.partitionBy("_p").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = parts.withColumn("_before", F.coalesce(F.sum("t").over(inner), F.lit(0)))
    totals = local.groupBy("_p").agg(F.sum("t").alias("_t"))
    earlier = totals.alias("x").join(totals.alias("y"), F.col("y._p") < F.col("x._p"), "left").groupBy(F.col("x._p").alias("_p")).agg(F.coalesce(F.sum("y._t"), F.lit(0)).alias("_base"))
    ranked = local.join(F.broadcast(earlier), "_p").withColumn("rank", F.col("_base") + F.col("_before") + (F.col("t") + 1) / 2.0)
    s = ranked.agg(F.sum(F.col("rank") * F.col("a")).alias("r"), F.sum("a").cast("double").alias("n1"), F.sum(F.col("t") - F.col("a")).cast("double").alias("n2"), F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("ties"))
    n = F.col("n1") + F.col("n2")
    s = s.withColumn("u", F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2)
    s = s.withColumn("z", (F.col("u") - F.col("n1") * F.col("n2") / 2) / F.sqrt(F.col("n1") * F.col("n2") / 12 * ((n + 1) - F.col("ties") / (n * (n - 1)))))
    return s.select(F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"), F.round("u", 2).alias("u"), F.round("z", 6).alias("z"))


# ---------------------------------------------------------------- vectors


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def mean_unit(df: DataFrame, by: str, vector: str) -> DataFrame:
    """The mean of each group's vectors, scaled to length one; a zero mean stays."""
    means = df.select(by, F.posexplode(vector).alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    rows = means.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))
    norm = F.sqrt(dot(F.col("mean"), F.col("mean")))
    return rows.withColumn("norm", norm).select(by, F.transform("mean", lambda x: F.when(F.col("norm") > 0, x / F.col("norm")).otherwise(x)).alias("unit"), "norm")


def mean_pairwise_distance(df: DataFrame, by: str, vector: str) -> DataFrame:
    """Mean cosine distance over all pairs of unit vectors, from the length of their sum: one pass, no pairs."""
    sums = df.select(by, F.posexplode(vector).alias("pos", "x")).groupBy(by, "pos").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count(F.lit(1)).alias("n"))
    return sums.groupBy(by).agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("q")).select(by, "n", F.round(1 - (F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 5).alias("distance"))


def best_products(batches: Iterable[pa.RecordBatch], q_ids: np.ndarray, q: np.ndarray, rows_at_once: int) -> pa.RecordBatch:
    """Of the (id, vector) rows the best other one for each query: query_id, neighbour_id, similarity; ties go to the smaller id."""
    every, lowest = np.arange(len(q)), -np.finfo(np.float64).max  # a product that is no number comes after all that are
    top, who = np.full(len(q), -np.inf), np.zeros(len(q), np.int64)
    for batch in slices(batches, rows_at_once):
        own = batch.column(0).to_numpy()
        order = np.argsort(own, kind="stable")  # the first of several best is then the smallest id
        own, x = own[order], np.stack(batch.column(1).to_numpy(zero_copy_only=False))[order].astype(np.float64)
        s = q @ x.T
        s[np.isnan(s)] = lowest
        s[q_ids[:, None] == own[None, :]] = -np.inf
        first = s.argmax(axis=1)
        found, its = s[every, first], own[first]
        better = (found > top) | ((found == top) & (its < who))
        top[better], who[better] = found[better], its[better]
    seen = top > -np.inf
    top[top == lowest] = np.nan
    return pa.RecordBatch.from_arrays([pa.array(q_ids[seen], pa.int64()), pa.array(who[seen]), pa.array(top[seen])], names=["query_id", "neighbour_id", "similarity"])


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, id_col: str, vector: str, block: int = 1024, rows_at_once: int = 512) -> DataFrame:
    """For each query the other row with the largest dot product: exact, the queries against all rows in blocks.

    A block of queries goes to the executors, each task keeps its best per query, and the
    best of those is one aggregate over blocks x tasks rows.  A task holds ``block`` x
    ``rows_at_once`` products, however many rows come in a batch.
    """
    out = None
    held: list = []

    def scan(part: list) -> DataFrame:
        ids = np.array([r[0] for r in part])
        matrix = np.array([r[1] for r in part], np.float64)
        shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix))

        def best(batches):
            yield best_products(batches, *shared.value, rows_at_once)

        found = vectors.select(id_col, vector).dropna().mapInArrow(best, "query_id long, neighbour_id long, similarity double")
        return found.groupBy("query_id").agg(F.min_by(F.struct("neighbour_id", "similarity"), F.struct(-F.col("similarity"), "neighbour_id")).alias("b"))

    for row in queries.select(id_col, vector).toLocalIterator():
        held.append(row)
        if len(held) == block:
            out = scan(held) if out is None else out.unionByName(scan(held))
            held = []
    if held or out is None:
        last = scan(held) if held else vectors.select(F.col(id_col).cast("long").alias("query_id"), F.struct(F.col(id_col).cast("long").alias("neighbour_id"), F.lit(0.0).alias("similarity")).alias("b")).limit(0)
        out = last if out is None else out.unionByName(last)
    return out.select("query_id", "b.neighbour_id", F.round("b.similarity", 5).alias("similarity"))


def char_grams(column: Column, orders: Sequence[int] = (3, 4, 5)) -> Column:
    """Character n-grams of the lower-cased words, each with a space on either side; none reaches over two words."""

    def cut(padded: Column, n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(padded) - (n - 1), F.lit(1)))
        return F.when(F.length(padded) >= n, F.transform(places, lambda i: F.substring(padded, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    words = F.filter(F.split(F.lower(column), r"\s+"), lambda w: w != "")
    return F.flatten(F.transform(words, lambda w: F.flatten(F.array(*(cut(F.concat(F.lit(" "), w, F.lit(" ")), n) for n in orders)))))


def nearest_texts(df: DataFrame, wanted: Column, key: str, text: str, orders: Sequence[int] = (3, 4, 5), min_df: int = 2, block: int = 256, rows_at_once: int = 64) -> DataFrame:
    """For each row whose ``key`` is ``wanted`` the other row most alike: cosine of TF-IDF over character n-grams.

    A gram in fewer than ``min_df`` rows doesn't count; ties go to the smaller key; a row that
    shares no gram with another has no neighbour.  ``key`` is a unique integer.  The weighted
    grams of all rows stay where they are: the wanted rows pass over them in blocks, each batch
    keeps its best, and the best of those is one aggregate.
    """
    grams = df.select(key, F.explode(char_grams(F.col(text), orders)).alias("gram")).groupBy(key, "gram").agg(F.count(F.lit(1)).alias("tf"))
    spread = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= min_df)
    weight = F.col("tf") * (F.log(F.lit(1.0 + df.count()) / (F.col("df") + 1)) + 1)
    rows = grams.join(spread, "gram").select(key, F.struct(F.xxhash64("gram").alias("g"), weight.alias("w")).alias("gw")).groupBy(key).agg(F.collect_list("gw").alias("gw"))
    rows = rows.select(key, F.transform("gw", lambda x: x["g"]).alias("g"), F.transform("gw", lambda x: x["w"]).alias("w"))

    def scan(part: Sequence) -> DataFrame:
        ids = np.array([r[0] for r in part])
        grams_of, weights = [np.array(r.g, np.int64) for r in part], [np.array(r.w) for r in part]
        order = np.argsort(np.concatenate(grams_of), kind="stable")
        columns = np.concatenate(grams_of), np.repeat(np.arange(len(part)), [len(g) for g in grams_of]), np.concatenate([w / np.linalg.norm(w) for w in weights])
        shared = df.sparkSession.sparkContext.broadcast((ids, *(c[order] for c in columns)))

        def best(batches):
            q_ids, q_gram, q_row, q_weight = shared.value
            for whole in batches:
                for at in range(0, len(whole), rows_at_once):
                    pdf = whole.iloc[at : at + rows_at_once]
                    own, n = pdf[key].to_numpy(), len(pdf)
                    row = np.repeat(np.arange(n), pdf["g"].map(len))
                    gram, w = np.concatenate(pdf["g"].to_list()), np.concatenate([x / np.linalg.norm(x) for x in pdf["w"]])
                    first = np.searchsorted(q_gram, gram, "left")
                    times = np.searchsorted(q_gram, gram, "right") - first
                    hit = np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())
                    s = np.bincount(q_row[hit] * n + np.repeat(row, times), weights=q_weight[hit] * np.repeat(w, times), minlength=len(q_ids) * n).reshape(len(q_ids), n)
                    s = np.where(q_ids[:, None] == own[None, :], 0.0, np.round(s, 9))
                    top = np.lexsort((own[None, :].repeat(len(q_ids), 0), -s), axis=1)[:, 0]
                    found = pd.DataFrame({"query_id": q_ids, "neighbour_id": own[top], "similarity": s[np.arange(len(q_ids)), top]})
                    yield found[found["similarity"] > 0]

        found = rows.mapInPandas(best, "query_id long, neighbour_id long, similarity double")
        return found.groupBy("query_id").agg(F.min_by(F.struct("neighbour_id", "similarity"), F.struct(-F.col("similarity"), "neighbour_id")).alias("b"))

    out = None
    for part in batched(rows.filter(wanted).toLocalIterator(), block):
        out = scan(part) if out is None else out.unionByName(scan(part))
    if out is None:
        return df.sparkSession.createDataFrame([], "query_id long, neighbour_id long, similarity double")
    return out.select("query_id", "b.neighbour_id", F.round("b.similarity", 5).alias("similarity"))


def kmeans(df: DataFrame, vector: str, k: int, seed: int = 42) -> DataFrame:
    """Adds ``cluster``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = df.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(ready)
    return model.transform(ready).drop("_v")


def vendi_score(df: DataFrame, vector: str, dims: int) -> float:
    """exp of the entropy of the eigenvalues of K/n; the d x d matrix has the same ones and is all that is gathered."""
    rows = df.select(F.posexplode(vector).alias("i", "x"), F.col(vector).alias("v")).groupBy("i").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col("x").cast("double") * F.get("v", F.lit(j)).cast("double")).alias(f"c{j}") for j in range(dims))).collect()
    gram, n = np.zeros((dims, dims)), max((r.n for r in rows), default=1)
    for r in rows:
        gram[r.i] = [r[f"c{j}"] or 0.0 for j in range(dims)]
    p = np.linalg.eigvalsh(gram / n)
    p = p[p > 1e-12]
    return float(np.exp(-(p * np.log(p)).sum()))


def domain_shift_auc(df: DataFrame, vector: str, label: Column, key: str, seed: int = 42) -> float:
    """Held-out area under the ROC curve of a logistic regression that tells two sets of vectors apart; 0.5 is no shift.

    Three tenths are held out, by hash of ``key``, whatever the layout of the rows.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.functions import array_to_vector

    ready = df.select(array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"), label.cast("double").alias("label"), (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(10)) < 3).alias("held"))
    return BinaryClassificationEvaluator().evaluate(LogisticRegression(regParam=0.01).fit(ready.filter("not held")).transform(ready.filter("held")))


def mean_discrepancy(df: DataFrame, vector: str, label: Column, key: str, gamma: float, features: int = 256, permutations: int = 100, seed: int = 42) -> tuple[float, float]:
    """(squared mean discrepancy of two sets under a Gaussian kernel, its permutation p-value).

    The kernel is taken by random Fourier features, so one pass over the vectors gives the
    means of both sets, and those of every permutation of the labels, drawn by hash of ``key``.
    """
    shaped = df.select(vector, label.cast("int").alias("_y"), F.xxhash64(F.lit(seed), key).alias("_s"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float64)
            rng = np.random.default_rng(seed)
            w, b = rng.normal(0, np.sqrt(2 * gamma), (x.shape[1], features)), rng.uniform(0, 2 * np.pi, features)
            phi = np.sqrt(2 / features) * np.cos(x @ w + b)
            y, s = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy().view(np.uint64)
            for k in range(permutations + 1):
                drawn = (((s ^ np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)) ^ (s >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(11)
                for side in (0, 1):
                    own = (y == side) if k == 0 else ((drawn / float(1 << 53) < 0.5) == bool(side))
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([side], pa.int32()), pa.array([int(own.sum())], pa.int64()), pa.array([phi[own].sum(0).tolist()], pa.list_(pa.float64()))], names=["k", "side", "n", "total"])

    sums = shaped.mapInArrow(run, "k int, side int, n long, total array<double>")
    rows = sums.select("k", "side", "n", F.posexplode("total").alias("i", "x")).groupBy("k", "side", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()
    means = np.zeros((permutations + 1, 2, features))
    for r in rows:
        means[r.k, r.side, r.i] = r.x / max(r.n, 1)
    found = ((means[:, 0] - means[:, 1]) ** 2).sum(1)
    return float(found[0]), float((1 + (found[1:] >= found[0]).sum()) / (permutations + 1))


# ---------------------------------------------------------------- translation metrics

_PUNCT = r"([\x21-\x2B\x2F\x3A-\x40\x5B-\x60\x7B-\x7E])"


def tokens_13a(column: Column) -> Column:
    """The 13a tokens of the mteval script: punctuation apart, but for dots and commas inside numbers."""
    t = F.regexp_replace(column, r"\s+", " ")
    for pattern, to in ((_PUNCT, " $1 "), (r"([^0-9])([.,])", "$1 $2 "), (r"([.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 ")):
        t = F.regexp_replace(t, pattern, to)
    return F.filter(F.split(t, " +"), lambda w: w != "")


def ngram_counts(tokens: Sequence[str], orders: Sequence[int]) -> list[Counter]:
    return [Counter(zip(*(tokens[i:] for i in range(n)), strict=False)) for n in orders]


def overlaps(hyp: Sequence[str], refs: Sequence[Sequence[str]], orders: Sequence[int]) -> list[tuple[int, int, int]]:
    """(matching, in the hypothesis, in the first reference) per order; with several references a gram counts up to its most in one."""
    own, others = ngram_counts(hyp, orders), [ngram_counts(r, orders) for r in refs]
    out = []
    for i, h in enumerate(own):
        most = others[0][i]
        for o in others[1:]:
            most = most | o[i]
        out.append(((h & most).total(), h.total(), others[0][i].total()))
    return out


STATS = ["sys_len", "ref_len", *(f"{k}_{n}" for k in ("correct", "total") for n in (1, 2, 3, 4))]


def count_segments(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """The statistics of rows of key, hypothesis tokens and each reference's."""
    for batch in slices(batches):
        rows = []
        for h, *r in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
            h, r = h or [], [x or [] for x in r]
            found = overlaps(h, r, (1, 2, 3, 4))
            closest = min((abs(len(x) - len(h)), len(x)) for x in r)[1]
            rows.append((len(h), closest, *(f[0] for f in found), *(f[1] for f in found)))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True))], names=[key, *STATS])


def segment_stats(df: DataFrame, key: str, hyp: Column, refs: Sequence[Column]) -> DataFrame:
    """BLEU's sufficient statistics of each segment: key, sys_len, ref_len, correct_n, total_n.

    Segments are counted where they are, in Arrow batches; only the statistics move later.  A
    null side is empty; the reference length is the closest, the shorter of two as close.
    """
    base = df.select(F.col(key), hyp.alias("_h"), *(r.alias(f"_r{i}") for i, r in enumerate(refs)))
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *(T.StructField(n, T.LongType()) for n in STATS)])
    return base.mapInArrow(lambda batches: count_segments(batches, key), schema)


def bleu(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """BLEU of each group of segments, zero counts smoothed by halving (exp)."""
    sums = [F.sum(c).alias(c) for c in ("sys_len", "ref_len", *(f"{k}_{n}" for k in ("correct", "total") for n in (1, 2, 3, 4)))]
    s = stats.groupBy(*by).agg(F.count(F.lit(1)).alias("n_segments"), *sums)
    logs, halvings = F.lit(0.0), F.lit(0.0)
    for n in (1, 2, 3, 4):
        c, t = F.col(f"correct_{n}").cast("double"), F.col(f"total_{n}").cast("double")
        halvings = halvings + (c == 0).cast("double")
        logs = logs + F.when(c > 0, F.log(c / t)).otherwise(F.log(1.0 / (F.pow(F.lit(2.0), halvings) * t)))
    brevity = F.when(F.col("sys_len") >= F.col("ref_len"), 0.0).otherwise(1 - F.col("ref_len") / F.col("sys_len"))
    scored = (F.col("correct_1") > 0) & (F.col("total_4") > 0)
    return s.withColumn("bleu", F.round(F.when(scored, 100 * F.exp(brevity + logs / 4)).otherwise(0.0), 4))


def chrf(df: DataFrame, key: str, hyp: Column, ref: Column, chars: int = 6, words: int = 2, beta: float = 2.0) -> DataFrame:
    """chrF++ of the whole table: F-beta of mean precision and recall over character and word n-grams."""
    base = df.select(F.coalesce(hyp, F.lit("")).alias("h"), F.coalesce(ref, F.lit("")).alias("r"), tokens_13a(F.coalesce(hyp, F.lit(""))).alias("hw"), tokens_13a(F.coalesce(ref, F.lit(""))).alias("rw"))

    def run(batches):
        """One row per batch, kind and order."""
        for batch in batches:
            total = Counter()
            for h, r, hw, rw in chain.from_iterable(zip(*(c.to_pylist() for c in part.columns), strict=True) for part in slices([batch])):
                for kind, x, y, orders in (("c", "".join(h.split()), "".join(r.split()), range(1, chars + 1)), ("w", hw, rw, range(1, words + 1))):
                    for n, found in zip(orders, overlaps(x, [y], orders), strict=True):
                        for k, v in zip("mhr", found, strict=True):
                            total[kind, n, k] += v
            cells = sorted({c[:2] for c in total})
            yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cells], pa.string()), pa.array([c[1] for c in cells], pa.int64()), *(pa.array([total[(*c, k)] for c in cells], pa.int64()) for k in "mhr")], names=["kind", "n", "m", "h", "r"])

    sums = base.mapInArrow(run, "kind string, n long, m long, h long, r long").groupBy("kind", "n").agg(*(F.sum(k).alias(k) for k in "mhr")).filter("h > 0 and r > 0")
    mean = sums.agg(F.avg(F.col("m") / F.col("h")).alias("p"), F.avg(F.col("m") / F.col("r")).alias("q"))
    b = beta * beta
    return mean.select(F.round(F.when(F.col("p") + F.col("q") > 0, 100 * (1 + b) * F.col("p") * F.col("q") / (b * F.col("p") + F.col("q"))).otherwise(0.0), 4).alias("chrfpp"))

"""The named studies beside the corpus build: which rows each arm of a comparison gets, how they are encoded, and the report over seeds."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import relational as R
from corpusloom.plans import pipelines as P
from corpusloom.sources import readers

# ---------------------------------------------------------------- selections


def largest(df: DataFrame, score: Column, n: int, ties: Sequence[str | Column], error: float = 0.001) -> DataFrame:
    """The ``n`` rows with the highest score, fewer if there are fewer; a null or unreadable score is none, ``ties`` order equal ones.

    Estimated quantiles bracket the n-th score and two counts prove the bracket, so that only
    rows inside it are sorted: no task gets all n rows, unless most of them tie.
    """
    scored = df.withColumn("_score", score.try_cast("double")).filter("not isnan(_score) and _score is not null")
    total = scored.count()
    if total <= n:
        return scored.drop("_score")
    at = 1 - n / total
    low, high = scored.approxQuantile("_score", [max(at - 2 * error, 0.0), min(at + 2 * error, 1.0)], error)
    above, within = scored.agg(F.count_if(F.col("_score") > high), F.count_if(F.col("_score") >= low)).first()
    if not above <= n <= within:
        low, high, above = float("-inf"), float("inf"), scored.filter(F.col("_score") > float("inf")).count()
    edge = scored.filter((F.col("_score") >= low) & (F.col("_score") <= high)).orderBy(F.desc("_score"), *ties).limit(n - above)
    return scored.filter(F.col("_score") > high).unionByName(edge).drop("_score")


def best_scored(df: DataFrame, score: str, n: int, floors: dict[str, float] | None = None, ties: Sequence[str] = ("src", "tgt")) -> DataFrame:
    """The ``n`` best by ``score`` of the rows strictly above every floor, whose columns must be there."""
    for column, floor in (floors or {}).items():
        df = df.filter(F.col(column).try_cast("double") > F.lit(float(floor)))
    return largest(df, F.col(score), n, ties)


def seeded_head(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in the order of a seeded hash of ``key``."""
    digest = F.sha1(F.concat_ws("\0", F.lit(str(seed)), F.col(key).cast("string")))
    return largest(df, -F.conv(F.substring(digest, 1, 12), 16, 10).cast("double"), n, [digest, key])


def equal_sized(arms: dict[str, DataFrame], key: str, seed: int = 42) -> dict[str, DataFrame]:
    """Every arm cut to the size of the smallest one."""
    least = min(df.count() for df in arms.values())
    return {name: seeded_head(df, key, least, seed) for name, df in arms.items()}


def matched_arms(first: DataFrame, other: DataFrame, score: str, floors: dict[str, float] | None = None, ties: Sequence[str] = ("src", "tgt")) -> dict[str, DataFrame]:
    """A whole first arm, and as many of the other's best rows."""
    return {"first": first, "other": best_scored(other, score, first.count(), floors, ties)}


def domain_arms(narrow: DataFrame, broad: DataFrame, score: str, floors: dict[str, float], n: int = 10_000, needed: Sequence[str] = ("src", "tgt"), ties: Sequence[str] = ("src", "tgt")) -> dict[str, DataFrame]:
    """One domain whole, only rows without a needed text left out, against the ``n`` best of a broad source."""
    return {"narrow": narrow.na.drop(subset=list(needed)), "broad": best_scored(broad.na.drop(subset=list(needed)), score, n, floors, ties)}


def build_arm(df: DataFrame, bench: DataFrame | None, n: int | None = None, order: str = "ordinal", seed: int = 42, ratios: tuple[float, float] = (0.8, 0.1)) -> DataFrame:
    """Pools, decontaminates, cuts to ``n`` and splits one arm, without cleaning or floors."""
    return P.build({"arm": df}, bench, P.Profile(sample_to=n, ratios=ratios, seed=seed), order, stages=("decontaminate", "size", "split"))


def floors_by_source(sources: dict[str, DataFrame], score: str, floors: dict[str, float], default: float, shared: dict[str, float]) -> list[DataFrame]:
    """Each source above a floor of its own for ``score`` and above the ``shared`` floors of all."""
    return [sources[s].filter(R.above_floors(sources[s].columns, {score: floors.get(s, default), **shared})).withColumn("source", F.lit(s)) for s in sorted(sources)]


# ---------------------------------------------------------------- the stratification study


def top_domains(df: DataFrame, urls: Sequence[str], top: int) -> DataFrame:
    """Adds ``domain`` and keeps the rows of the ``top`` domains with most rows; an unknown one is none of them."""
    named = df.withColumn("domain", X.registered_domain(X.host(*(F.col(u) for u in urls))))
    most = named.filter("domain != 'unknown'").groupBy("domain").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "domain").limit(top)
    return named.join(F.broadcast(most.select("domain")), "domain", "left_semi")


def stratification_pool(curated: dict[str, DataFrame], mined: DataFrame, floors: dict[str, float], urls: Sequence[str] = ("source_url", "target_url"), top: int = 20, order: str = "ordinal") -> DataFrame:
    """(src, tgt, domain, ordinal, row, bucket): curated sources lightly cleaned, each a domain, and the mined rows of the largest domains after their floors."""
    frames = []
    for name in sorted(curated):
        df = X.normalised(curated[name].select("src", "tgt", order), {"src": True, "tgt": False})
        whole = df.filter(R.balanced_parens(F.col("src")) & R.balanced_parens(F.col("tgt")))
        frames.append(R.keep_first(whole, ["src", "tgt"], [order]).withColumn("domain", F.lit(name)))
    frames.append(top_domains(mined.filter(R.above_floors(mined.columns, floors)), urls, top).select("src", "tgt", order, "domain"))
    pooled = R.pool(frames, ["src", "tgt"], [order])
    return pooled.withColumn("row", X.content_key(F.col("src"), F.col("tgt"))).withColumn("bucket", X.length_bucket(F.col("src")))


def three_splits(pooled: DataFrame, strata: dict[str, Sequence[str]] | None = None, group: str = "src", seed: int = 42, order: str = "row") -> dict[str, DataFrame]:
    """One pool under three splitters: by length, by length and cluster, by length and domain; only the last two cut small strata."""
    strata = strata or {"length": ["bucket"], "semantic": ["bucket", "cluster"], "domain": ["bucket", "domain"]}
    return {name: R.split_groups(pooled, group, by, seed, R.plain_cut if len(by) == 1 else R.small_cut, order) for name, by in strata.items()}


# ---------------------------------------------------------------- encoding and evaluation


def reversed_pairs(df: DataFrame) -> DataFrame:
    """Source and target sides exchanged, all other columns as they were."""
    return df.withColumnsRenamed({"src": "_side"}).withColumnsRenamed({"tgt": "src"}).withColumnsRenamed({"_side": "tgt"})


def recipe_of(unknown_rate: float, most: float = 0.2) -> str:
    """How texts are prepared for a vocabulary that does not know this share of raw text's ids."""
    return "translit" if unknown_rate > most else "normalize"


def prepared(column: Column, recipe: str) -> Column:
    """A source text as the model's vocabulary saw it in training; a row stays a row."""
    if recipe not in ("translit", "normalize"):
        raise ValueError(f"unknown recipe: {recipe}")
    return X.transliterate(column) if recipe == "translit" else X.normalise(column, True)


def encoded_arm(df: DataFrame, encode: Callable[[Column], Column], source: Callable[[Column], Column] = X.transliterate, target: Callable[[Column], Column] = X.moses_tokens, most: int = 150) -> DataFrame:
    """Replaces both sides by framed ids; pairs with a longer side than ``most`` go.  ``encode`` is the vocabulary's."""
    sides = {"src": X.frame_ids(encode(source(F.col("src")))), "tgt": X.frame_ids(encode(target(F.col("tgt"))))}
    return df.withColumns(sides).filter((F.size("src") <= most) & (F.size("tgt") <= most))


def redecoded(ids: Column, decode: Callable[[Column], Column], special: Sequence[int] = (0, 2, 3)) -> Column:
    """The reference of in-distribution scoring: what the vocabulary makes of a text's ids, so what it doesn't know is lost."""
    return decode(F.filter(ids, lambda i: ~i.isin(*special)))


def read_split(spark: SparkSession, folder: str, split: str, stems: dict[str, str] | None = None, sides: tuple[str, str] | None = None) -> DataFrame:
    """(ordinal, src, tgt) of a published split: two aligned files named by ``sides``' endings, else a CSV whose incomplete rows go."""
    stem = (stems or {}).get(split, split)
    if sides:
        return readers.read_aligned(spark, f"{folder}/{stem}{sides[0]}", f"{folder}/{stem}{sides[1]}")
    return readers.numbered(spark.read.csv(f"{folder}/{stem}.csv", header=True, inferSchema=False, multiLine=True, escape='"').select("src", "tgt").na.drop()).select("ordinal", "src", "tgt")


def pending_scores(runs: DataFrame, scored: DataFrame, arms: Sequence[str], benchmarks: Sequence[str]) -> DataFrame:
    """(arm, seed, metric, target) still to score: every finished run on its own test split, on the other arms' and on the benchmarks.

    A run is finished with a ``returncode`` of 0 (null while it trains); scored ones are left out by arm and seed.
    """
    todo = R.resume(runs.filter("returncode = 0").select("arm", "seed"), scored, ["arm", "seed"], F.lit(True))
    targets = [F.struct(F.when(F.col("arm") == a, "own").otherwise("cross").alias("metric"), F.lit(a).alias("target")) for a in arms]
    targets += [F.struct(F.lit(b).alias("metric"), F.lit(b).alias("target")) for b in benchmarks]
    return todo.select("arm", "seed", F.explode(F.array(*targets)).alias("t")).select("arm", "seed", "t.*")


def seed_report(scores: DataFrame, by: Sequence[str] = ("arm", "metric"), score: str = "bleu") -> DataFrame:
    """Mean and sample deviation over seeds; one seed has no deviation."""
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 5).alias("mean"), F.round(F.stddev_samp(score), 5).alias("std"))


def mean_tensors(df: DataFrame, name: str, values: str) -> DataFrame:
    """(name, pos, mean): the double mean of each place of the equally named arrays of several checkpoints."""
    return df.select(name, F.posexplode(values).alias("pos", "x")).groupBy(name, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))

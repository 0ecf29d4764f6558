"""The corpus build as one parameterised plan, and its named profiles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import relational as R


@dataclass(frozen=True)
class Floors:
    labse_score: float = 0.0
    africomet_score: float = 0.0
    source_lid: float = 0.0
    target_lid: float = 0.0


@dataclass(frozen=True)
class Profile:
    """What distinguishes one corpus build from another."""

    mined: Floors = field(default_factory=lambda: Floors(0.7, 0.80, 0.90, 0.90))
    curated: Floors = field(default_factory=lambda: Floors(0.15, 0.15, 0.0, 0.0))
    mined_sources: Sequence[str] = ("nllb",)
    excluded: Sequence[str] = ()
    laser_floor: float | None = None
    trim_to: int | None = None
    sample_to: int | None = None
    ratios: tuple[float, float] = (0.8, 0.1)
    seed: int = 42
    src_length: tuple[int, int] = (5, 500)
    tgt_length: tuple[int, int] = (10, 500)


PROFILES = {
    "production": Profile(),
    "clean_recipe": Profile(mined=Floors(0.0, 0.80, 0.90, 0.90), excluded=("quran", "ccaligned", "religious"), laser_floor=1.08),
    "breadth": Profile(mined=Floors(), curated=Floors(), excluded=("gezmu", "religious", "quran", "ccaligned"), laser_floor=1.108, trim_to=145_363),
    "fixed_size": Profile(sample_to=117_049),
    "single_source": Profile(curated=Floors(0.0, 0.15, 0.90, 0.90)),
}


def select_sources(sources: dict[str, DataFrame], profile: Profile, strict: bool = False) -> list[DataFrame]:
    """Each source above the floors of its tier; a column that a source lacks is no floor for it.

    ``strict`` refuses a profile that excludes a source which is not there.
    """
    unknown = set(profile.excluded) - set(sources)
    if strict and unknown:
        raise ValueError(f"unknown sources: {sorted(unknown)}")
    chosen = []
    for name in sorted(set(sources) - set(profile.excluded)):
        df, mined = sources[name], name in profile.mined_sources
        if mined and profile.laser_floor is not None:
            if "laser_score" not in df.columns:
                raise ValueError(f"{name} has no laser_score")
            df = df.filter(F.col("laser_score").try_cast("double") > profile.laser_floor)
        tier = profile.mined if mined else profile.curated
        chosen.append(df.filter(R.above_floors(df.columns, vars(tier), {"labse_score": "laser_score"})).withColumn("source", F.lit(name)))
    return chosen


def clean(df: DataFrame, profile: Profile, order: Sequence[str], exempt: bool = False, keys: Sequence[str] = ("src",)) -> DataFrame:
    """Normalisation, filters and keep-first by ``keys``; ``exempt`` sources may mix scripts."""
    df = X.normalised(df, {"src": True, "tgt": False})
    steps = [("length", R.length_between(F.col("src"), *profile.src_length) & R.length_between(F.col("tgt"), *profile.tgt_length))]
    if not exempt:
        steps.append(("script", R.pure_script(F.col("src"), R.ETHIOPIC_FOREIGN) & R.pure_script(F.col("tgt"), R.LATIN_FOREIGN)))
    steps.append(("parentheses", R.balanced_parens(F.col("src")) & R.balanced_parens(F.col("tgt"))))
    return R.keep_first(R.apply_filters(df, steps), keys, order)


def clean_sources(sources: dict[str, DataFrame], profile: Profile, order: Sequence[str], exempt: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Each source cleaned; a mined one keeps one row per source text, a curated one, which may have several translations, one per pair."""
    return {name: clean(df, profile, order, name in exempt, ("src",) if name in profile.mined_sources else ("src", "tgt")) for name, df in sources.items()}


def contamination(pooled: DataFrame, bench: DataFrame, sides: Sequence[str] = ("src", "tgt"), normalise: bool = True) -> DataFrame:
    """(row, side, kind, ratio, item_id): at most one match a row, of the first side that has one, exact before fuzzy.

    ``pooled`` has a unique ``row``.  The benchmark goes through the normalisation that the
    corpus went through, or raw benchmark text would miss its normalised copies.
    """
    found = None
    if normalise:
        bench = X.normalised(bench, {side: side == "src" for side in sides})
    for rank, side in enumerate(sides):
        keyed = pooled.select("row", X.comparison_key(F.col(side)).alias("key"), X.word_tokens(F.col(side)).alias("tokens"))
        items = bench.select("item_id", X.comparison_key(F.col(side)).alias("bkey"), X.word_tokens(F.col(side)).alias("tokens"))
        exact = R.exact_matches(keyed, items.withColumnRenamed("bkey", "key")).select("row", F.lit("exact").alias("kind"), F.lit(1.0).alias("ratio"), "item_id")
        close = R.ngram_candidates(keyed, items, ["row"]).join(keyed.select("row", "key"), "row").join(R.bounded_broadcast(items.select("item_id", "bkey")), "item_id")
        fuzzy = R.fuzzy_matches(close, ["row"], "key", "bkey").select("row", F.lit("fuzzy").alias("kind"), "ratio", "item_id")
        own = exact.unionByName(fuzzy).select("row", F.lit(side).alias("side"), "kind", "ratio", "item_id", F.lit(rank).alias("rank"))
        found = own if found is None else found.unionByName(own)
    best = F.min_by(F.struct("side", "kind", "ratio", "item_id"), F.struct("rank", "kind"))  # "exact" sorts before "fuzzy"
    return found.groupBy("row").agg(best.alias("m")).select("row", "m.side", "m.kind", F.round("m.ratio", 3).alias("ratio"), "m.item_id")


def contamination_report(matches: DataFrame, total: int) -> DataFrame:
    """(by, value, matches, share of all rows) over kinds, sides and items, and in all."""
    each = matches.select(F.explode(F.array(*(F.struct(F.lit(b).alias("by"), F.col(c).cast("string").alias("value")) for b, c in (("kind", "kind"), ("side", "side"), ("item", "item_id"))), F.struct(F.lit("all").alias("by"), F.lit("all").alias("value")))).alias("x")).select("x.*")
    return each.groupBy("by", "value").agg(F.count(F.lit(1)).alias("matches")).withColumn("share", F.round(F.col("matches") / F.lit(float(max(total, 1))), 6))


def decontaminate(pooled: DataFrame, bench: DataFrame, sides: Sequence[str] = ("src", "tgt")) -> DataFrame:
    """Rows that match a benchmark side exactly, or in 5-grams and a ratio of 0.7, go; ``pooled`` has a unique ``row``."""
    return pooled.join(contamination(pooled, bench, sides).select("row"), "row", "left_anti")


def trim(pooled: DataFrame, score: str, n: int) -> DataFrame:
    """The n best by score; rows without a score come first, ties in seeded order."""
    return pooled.orderBy(F.coalesce(F.col(score).try_cast("double"), F.lit(float("inf"))).desc(), F.sha1("src"), "tgt").limit(n)


STAGES = ("clean", "floors", "decontaminate", "size", "split")


def build(sources: dict[str, DataFrame], bench: DataFrame | None, profile: Profile, order: str = "ordinal", *, stages: Sequence[str] = STAGES, exempt: Sequence[str] = (), strict: bool = True, clusters: str | None = None) -> DataFrame:
    """clean, select, pool, decontaminate, size, split: (src, tgt, source, split, ...).

    ``stages`` switches stages off; without ``floors`` every source is pooled whole.  ``exempt``
    sources may mix scripts.  ``strict`` refuses a profile that excludes an unknown source.
    ``clusters`` names a column to stratify by beside the length, and small strata are then cut
    so that validation and test get their rows.
    """
    unknown = set(stages) - set(STAGES)
    if unknown:
        raise ValueError(f"unknown stages: {sorted(unknown)}")
    if "clean" in stages:
        sources = clean_sources(sources, profile, [order], exempt)
    chosen = select_sources(sources, profile, strict) if "floors" in stages else [sources[n].withColumn("source", F.lit(n)) for n in sorted(sources)]
    pooled = R.pool(chosen, ["src", "tgt"], [order])
    pooled = pooled.withColumn("row", X.content_key(F.col("src"), F.col("tgt"))).withColumn("bucket", X.length_bucket(F.col("src")))
    if bench is not None and "decontaminate" in stages:
        pooled = decontaminate(pooled, bench)
    if "size" in stages and profile.trim_to is not None and "laser_score" in pooled.columns:
        pooled = trim(pooled, "laser_score", profile.trim_to)
    if "size" in stages and profile.sample_to is not None:
        pooled = pooled.orderBy(F.sha1(F.concat_ws("\0", F.lit(str(profile.seed)), "src")), "src", "tgt").limit(profile.sample_to)
    if "split" not in stages:
        return pooled
    return R.split_groups(pooled, "src", ["bucket", *([clusters] if clusters else [])], profile.seed, lambda n: (R.small_cut if clusters else R.plain_cut)(n, profile.ratios), "row")


def single_source(sources: dict[str, DataFrame], name: str, bench: DataFrame | None, profile: Profile, **options) -> DataFrame:
    """The build of one source alone."""
    if name not in sources:
        raise ValueError(f"no source {name}")
    return build({name: sources[name]}, bench, replace(profile, excluded=()), **options)

"""Operators over pair and text tables: filters with a funnel, deduplication, score caches, floors, splits, decontamination, shares."""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X

# ---------------------------------------------------------------- filters

# What each side's script may hold.
ETHIOPIC_FOREIGN = r"""(?U)[^ሀ-፿"'.()0-9\s]"""
LATIN_FOREIGN = r"(?U)[^A-Za-z!-/:-@\[-`{-~0-9\s]"


def length_between(column: Column, low: int, high: int) -> Column:
    """Both bounds are exclusive; a null fails."""
    return F.coalesce((F.length(column) > low) & (F.length(column) < high), F.lit(False))


def pure_script(column: Column, foreign: str) -> Column:
    return F.coalesce(~column.rlike(foreign), F.lit(False))


def balanced_parens(column: Column) -> Column:
    """As many opening as closing parentheses, not counting a list marker's at the start."""
    rest = F.regexp_replace(column, r"(?U)^\s*\S\)", "")
    return F.coalesce(X.occurrences(rest, "(") == X.occurrences(rest, ")"), F.lit(False))


def funnel(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """(step, name, rows) left after each filter in turn, from one pass and one aggregate."""
    alive, sums = F.lit(True), [F.count(F.lit(1)).alias("s0")]
    for i, (_, keep) in enumerate(steps, 1):
        alive = alive & keep
        sums.append(F.sum(alive.cast("long")).alias(f"s{i}"))
    names = ["input", *(n for n, _ in steps)]
    one = df.agg(*sums)
    return one.select(F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("step"), F.lit(n).alias("name"), F.coalesce(F.col(f"s{i}"), F.lit(0)).alias("n_rows")) for i, n in enumerate(names)))).alias("f")).select("f.*")


def apply_filters(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    for _, keep in steps:
        df = df.filter(keep)
    return df


# ---------------------------------------------------------------- order-aware deduplication


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key; ``order`` must make the first one definite.

    An aggregate, so that the rows of a very common key meet in their own tasks first.  Keys of
    null are one key.  Columns may have any name.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    first = df.groupBy(*(F.col(f"`{k}`").alias(f"key{i}") for i, k in enumerate(keys))).agg(F.min_by(row, F.struct(*order)).alias("row"))
    return first.select("row.*")


def pool(frames: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Union by name in the order of the sources, then the first row of each key."""
    ranked = [f.withColumn("_source", F.lit(i)) for i, f in enumerate(frames)]
    union = ranked[0]
    for f in ranked[1:]:
        union = union.unionByName(f, allowMissingColumns=True)
    return keep_first(union, keys, ["_source", *order]).drop("_source")


# ---------------------------------------------------------------- score caches


def cached_scores(df: DataFrame, cache: DataFrame, keys: Sequence[str], score: str, compute: Callable[[DataFrame], DataFrame], skip: Column | None = None) -> DataFrame:
    """Scores by content key: cached ones by a join, the others computed once for each distinct key.

    Rows where ``skip`` holds are neither looked up nor computed and get a null.
    """
    keyed = df.withColumn("_key", X.content_key(*(F.col(k) for k in keys)))
    asked = keyed if skip is None else keyed.filter(~F.coalesce(skip, F.lit(False)))
    known = cache.select(F.col("key").alias("_key"), F.col(score))
    missing = asked.join(known.select("_key"), "_key", "left_anti").dropDuplicates(["_key"])
    new = compute(missing).select("_key", score)
    scored = known.unionByName(new).withColumnRenamed(score, "_score")
    found = keyed.join(scored, "_key", "left")
    value = F.col("_score") if skip is None else F.when(~F.coalesce(skip, F.lit(False)), F.col("_score"))
    return found.withColumn(score, value).drop("_key", "_score")


def strict_lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Adds ``value`` by content key; raises if any row has no entry."""
    keyed = df.withColumn("_key", X.content_key(*(F.col(k) for k in keys)))
    known = table.select(F.col("key").alias("_key"), F.col(value))
    missing = keyed.join(known, "_key", "left_anti").select("_key").distinct().count()
    if missing:
        raise KeyError(f"{missing} keys have no {value}")
    return keyed.join(known, "_key").drop("_key")


def resume(todo: DataFrame, done: DataFrame, keys: Sequence[str], recorded: Column) -> DataFrame:
    """What is still to do: keys without a finished row."""
    return todo.join(done.filter(recorded).select(*keys).distinct(), list(keys), "left_anti")


# ---------------------------------------------------------------- quality floors


def above_floors(columns: Sequence[str], floors: dict[str, float], rescued_by: dict[str, str] | None = None) -> Column:
    """One condition for all floors: strictly above, where the column exists and the floor is above zero.

    A null or unreadable score fails, unless the column that rescues it is there and not null.
    """
    keep = F.lit(True)
    for name, floor in floors.items():
        if name not in columns or floor <= 0:
            continue
        passes = F.coalesce(F.col(name).try_cast("double") > F.lit(float(floor)), F.lit(False))
        rescue = (rescued_by or {}).get(name)
        keep = keep & (passes | F.col(rescue).isNotNull() if rescue in columns else passes)
    return keep


def sweep(df: DataFrame, score: str, thresholds: Sequence[float], by: str) -> DataFrame:
    """Rows strictly above each threshold by group: one pass, a conditional count per threshold."""
    counts = df.groupBy(by).agg(*(F.sum((F.col(score) > F.lit(float(t))).cast("long")).alias(f"_t{i}") for i, t in enumerate(thresholds)))
    return counts.select(by, F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.coalesce(F.col(f"_t{i}"), F.lit(0)).alias("survivors")) for i, t in enumerate(thresholds)))).alias("s")).select(by, "s.*")


# ---------------------------------------------------------------- leak-free splits


def plain_cut(n: Column, ratios=(0.8, 0.1)) -> tuple[Column, Column]:
    return F.floor(n * F.lit(float(ratios[0]))), F.floor(n * F.lit(float(ratios[1])))


def small_cut(n: Column, ratios=(0.8, 0.1)) -> tuple[Column, Column]:
    """As :func:`plain_cut`, but a stratum of one trains, and one of two or more gives a row of training to an empty validation."""
    train, valid = plain_cut(n, ratios)
    lent = ((n > 1) & (valid == 0)).cast("long")
    return F.when(n == 1, F.lit(1)).otherwise(train - lent), valid + lent


def split_groups(df: DataFrame, group: str, strata: Sequence[str], seed: int = 42, cut=plain_cut, order: str = "ordinal") -> DataFrame:
    """Adds ``split``: within each stratum the groups go to train, validation or test in seeded hash order, each as a whole.

    A group that occurs in several strata belongs to that of its first row, so it never
    stands in two splits.
    """
    per_group = df.groupBy(F.col(group).alias("_g")).agg(*(F.min_by(F.coalesce(F.col(s).cast("string"), F.lit("unknown")), order).alias(f"_s{i}") for i, s in enumerate(strata)))
    own = [f"_s{i}" for i in range(len(strata))]
    ranked = per_group.withColumn("_h", F.sha1(F.concat_ws("\0", F.lit(str(seed)), F.col("_g").cast("string"))))
    # Ranks within ranges of the hash, and how many come in the ranges before: no task has a whole stratum.
    ranked = ranked.withColumn("_c", F.substring("_h", 1, 2))
    sizes = ranked.groupBy(*own, "_c").agg(F.count(F.lit(1)).alias("_k"))
    before = Window.partitionBy(*own).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*own, "_c", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_before"), F.sum("_k").over(Window.partitionBy(*own)).alias("_n"))
    ranked = ranked.withColumn("_r", F.row_number().over(Window.partitionBy(*own, "_c").orderBy("_h", "_g"))).join(sizes, [*own, "_c"])
    train, valid = cut(F.col("_n"))
    rank = F.col("_r") + F.col("_before")
    named = ranked.select("_g", F.when(rank <= train, "train").when(rank <= train + valid, "validation").otherwise("test").alias("split"))
    return df.join(named, df[group].eqNullSafe(named["_g"])).drop("_g")


def check_trim(had: int, left: int, wanted: int, most: float = 0.1) -> str | None:
    """Raises if a trim leaves fewer rows than are wanted; a warning if it takes more than ``most`` of them."""
    if left < wanted:
        raise ValueError(f"only {left} rows are left of the {wanted} wanted")
    return f"the trim takes {1 - left / had:.1%} of {had} rows" if had and 1 - left / had > most else None


def only_split(df: DataFrame, split: str | None, column: str = "split") -> DataFrame:
    """The rows of one split, all without one; raises if there are none."""
    out = df if split is None else df.filter(F.col(column) == split)
    if not out.limit(1).count():
        raise ValueError(f"no rows of split {split!r}")
    return out


def collect_by(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """The values of each key as a list, in order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda p: p["v"]).alias(value))


def verse_pairs(verses: DataFrame, translations: DataFrame, least: int = 10_000) -> DataFrame:
    """(verse, src, tgt, translation): each translation joined by verse; blank and ``<range>`` lines and translations with fewer than ``least`` shared verses are left out."""
    there = translations.withColumn("text", X.strip(F.col("text"))).filter(~F.col("text").isin("", "<range>"))
    pairs = verses.select("verse", F.col("text").alias("src")).join(there.select("verse", F.col("text").alias("tgt"), "translation"), "verse")
    enough = pairs.groupBy("translation").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return pairs.join(enough.select("translation"), "translation", "left_semi").select("verse", "src", "tgt", "translation")


# ---------------------------------------------------------------- decontamination


def bounded_broadcast(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """A broadcast hint if the table is known to be small, the table itself otherwise."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def exact_matches(lines: DataFrame, bench: DataFrame, key: str = "key", item: str = "item_id") -> DataFrame:
    first = bench.filter(F.col(key) != "").groupBy(key).agg(F.min(item).alias(item))
    return lines.join(bounded_broadcast(first), key)


def ngram_candidates(lines: DataFrame, bench: DataFrame, row: Sequence[str], item: str = "item_id", limit: int = 8) -> DataFrame:
    """The ``limit`` items that share most 5-grams with each row; ties go to the smaller item."""
    grams = bounded_broadcast(bench.select(item, F.explode(X.word_ngrams(F.col("tokens"))).alias("gram")))
    shared = lines.select(*row, F.explode(X.word_ngrams(F.col("tokens"))).alias("gram")).join(grams, "gram").groupBy(*row, item).agg(F.count(F.lit(1)).alias("shared"))
    rank = F.row_number().over(Window.partitionBy(*row).orderBy(F.desc("shared"), item))
    return shared.withColumn("_r", rank).filter(F.col("_r") <= limit).drop("_r")


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratcliff and Obershelp's 2M/T, in Arrow batches; there is no built-in for it."""
    return _ratio_udf(0.0)(a, b)


def _ratio_udf(least: float):
    @F.arrow_udf("double")
    def ratio(x: pa.Array, y: pa.Array) -> pa.Array:
        return ratios(x, y, least)

    return ratio


def ratios(x: pa.Array, y: pa.Array, least: float, rows_at_once: int = 256) -> pa.Array:
    """Ratios; null where the characters that two texts share show that it is below ``least``, before anything is matched.

    The texts and counts of so many rows are held at a time.
    """
    out = []
    for at in range(0, len(x), rows_at_once):
        counts = {}
        for s, t in zip(x.slice(at, rows_at_once).to_pylist(), y.slice(at, rows_at_once).to_pylist(), strict=True):
            for text in (s, t):
                if text not in counts:
                    counts[text] = Counter(text)
            if 2 * (counts[s] & counts[t]).total() < least * (len(s) + len(t)) - 1e-9:
                out.append(None)
            else:
                out.append(difflib.SequenceMatcher(None, s, t, autojunk=False).ratio())
    return pa.array(out, pa.float64())


def fuzzy_matches(candidates: DataFrame, row: Sequence[str], left: str, right: str, item: str = "item_id", least: float = 0.7) -> DataFrame:
    """The best item of each row with a ratio of at least ``least``; pairs whose lengths rule it out are not compared."""
    la, lb = F.length(left), F.length(right)
    possible = candidates.filter((la + lb > 0) & (2.0 * F.least(la, lb) / (la + lb) >= least))
    scored = possible.withColumn("ratio", _ratio_udf(least)(F.col(left), F.col(right))).filter(F.col("ratio") >= least)
    rank = F.row_number().over(Window.partitionBy(*row).orderBy(F.desc("ratio"), F.desc("shared"), item))
    return scored.withColumn("_r", rank).filter("_r = 1").drop("_r")


# ---------------------------------------------------------------- shares and samples


def shares(df: DataFrame, by: str) -> DataFrame:
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return counts.join(F.broadcast(total)).select(by, "n", F.round(F.col("n") / F.col("_total"), 9).alias("share"))


def sample_per_group(df: DataFrame, by: str, n: int, seed: int, key: str) -> DataFrame:
    order = F.sha1(F.concat_ws("\0", F.lit(str(seed)), F.col(key).cast("string")))
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(order, key))).filter(F.col("_r") <= n).drop("_r")

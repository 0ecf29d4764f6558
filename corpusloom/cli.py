"""The command line: corpus build, contamination report, domain removal, glyph counts, evaluation."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import analysis as A
from corpusloom.operators import relational as R
from corpusloom.plans import pipelines as P
from corpusloom.sources import readers


def _benchmark(spark: SparkSession, path: str | None) -> DataFrame | None:
    if path is None:
        return None
    return readers.numbered(spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"').na.fill(""), "item_id")


def _sources(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: readers.numbered(df) for name, df in readers.read_sources(spark, path).items()}


def build(spark: SparkSession, args) -> DataFrame:
    stages = [s for s in P.STAGES if s not in args.skip]
    options = {"stages": stages, "exempt": args.exempt}
    sources, bench, profile = _sources(spark, args.sources), _benchmark(spark, args.benchmark), P.PROFILES[args.profile]
    out = P.single_source(sources, args.only, bench, profile, **options) if args.only else P.build(sources, bench, profile, strict=False, **options)
    if args.format == "csv":
        readers.write_csv(out, args.out)
    elif "split" in out.columns:
        readers.write_splits(out, args.out)
    else:
        out.write.mode("overwrite").parquet(args.out)
    return spark.read.parquet(args.out).groupBy("split").count() if args.format != "csv" and "split" in stages else spark.createDataFrame([(args.out,)], "written string")


def report(spark: SparkSession, args) -> DataFrame:
    pooled = spark.read.parquet(args.corpus)
    pooled = pooled.withColumn("row", X.content_key(F.col("src"), F.col("tgt"))).dropDuplicates(["row"])
    return P.contamination_report(P.contamination(pooled, _benchmark(spark, args.benchmark)), pooled.count()).orderBy("by", "value")


def remove_domain(spark: SparkSession, args) -> DataFrame:
    df = spark.read.parquet(args.corpus)
    domain = X.registered_domain(X.host(*(F.col(c) for c in args.urls)))
    readers_out = df.filter(~domain.isin(args.domain))
    readers_out.write.mode("overwrite").parquet(args.out)
    return df.groupBy(domain.isin(args.domain).alias("removed")).count()


def char_freq(spark: SparkSession, args) -> DataFrame:
    df = spark.read.parquet(args.corpus)
    return df.agg(*(F.sum(X.occurrences(F.col(args.column), c)).alias(c) for c in dict.fromkeys(args.glyphs)))


def evaluate(spark: SparkSession, args) -> DataFrame:
    """BLEU, cased or not, and chrF++ of aligned lines."""
    lines = readers.read_aligned(spark, args.hypotheses, args.references, ("hyp", "ref"))
    case = F.lower if args.lower else F.col
    stats = A.segment_stats(lines, "ordinal", A.tokens_13a(case("hyp")), [A.tokens_13a(case("ref"))])
    return A.bleu(stats).select("n_segments", "bleu").join(A.chrf(lines, "ordinal", case("hyp"), case("ref")))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corpusloom", description=__doc__)
    commands = top.add_subparsers(required=True)

    def command(f, **options):
        sub = commands.add_parser(f.__name__.replace("_", "-"), help=(f.__doc__ or "").strip() or None)
        for name, kwargs in options.items():
            sub.add_argument(f"--{name}", **kwargs)
        sub.set_defaults(run=f)

    needed, many = {"required": True}, {"nargs": "*", "default": []}
    command(build, sources=needed, out=needed, benchmark={}, profile={"choices": sorted(P.PROFILES), "default": "production"}, only={}, skip=many | {"choices": P.STAGES}, exempt=many, format={"choices": ["parquet", "csv"], "default": "parquet"})
    command(report, corpus=needed, benchmark=needed)
    command(remove_domain, corpus=needed, out=needed, domain=needed | {"nargs": "+"}, urls={"nargs": "+", "default": ["source_url", "target_url"]})
    command(char_freq, corpus=needed, column={"default": "src"}, glyphs=needed)
    command(evaluate, hypotheses=needed, references=needed, lower={"action": "store_true"})
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(SparkSession.builder.appName("corpusloom").getOrCreate(), args).show(1000, truncate=False)

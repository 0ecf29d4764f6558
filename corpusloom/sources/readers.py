"""Readers and writers of corpus files, always with explicit schemas and a stable row order."""

from __future__ import annotations

import io
import json
import re
import tarfile
import zipfile
from collections.abc import Callable, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """All-string CSV with quoted line breaks; nothing is inferred."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', schema=", ".join(f"`{c}` string" for c in columns), enforceSchema=False)


def read_tsv(spark: SparkSession, path: str, strings: Sequence[str], floats: Sequence[str]) -> DataFrame:
    """Unquoted TSV, plain or gzip; unreadable numbers become null and such rows go."""
    names = [*strings, *floats]
    raw = spark.read.csv(path, sep="\t", quote="", schema=", ".join(f"`{c}` string" for c in names))
    return raw.select(*strings, *(F.col(c).try_cast("float").alias(c) for c in floats)).na.drop(subset=list(floats))


def mined_pairs(df: DataFrame, floors: dict[str, float], rename: dict[str, str], kind: str = "float") -> DataFrame:
    """Rows strictly above every floor; the literals are of the columns' own kind, so that the scan takes them."""
    for column, floor in floors.items():
        df = df.filter(F.col(column) > F.lit(floor).cast(kind))
    return df.withColumnsRenamed(rename)


def count_rows(spark: SparkSession, path: str) -> int:
    """Rows of a Parquet table, from its footers."""
    return spark.read.parquet(path).count()


def numbered(df: DataFrame, name: str = "ordinal") -> DataFrame:
    """Adds the row number in file order, without a shuffle of the rows.

    ``df`` is a plan over files without a shuffle, whose partitions are the same each time it
    runs.  Spark's own ids count up inside a partition from a base of its own; the number of rows
    before each partition takes the base's place.
    """
    marked = df.withColumn(name, F.monotonically_increasing_id())
    part = F.shiftright(F.col(name), 33)
    sizes = sorted((r[0], r[1]) for r in marked.groupBy(part.alias("p")).count().collect())
    before, base = 0, []
    for p, n in sizes:
        base += [F.lit(p), F.lit(before)]
        before += n
    if not base:
        return marked
    return marked.withColumn(name, F.create_map(*base)[part].cast("long") + F.col(name).bitwiseAND(F.lit((1 << 33) - 1)))


def read_aligned(spark: SparkSession, left: str, right: str, names: tuple[str, str] = ("src", "tgt")) -> DataFrame:
    """Two files, line by line; raises if they have not as many lines."""
    a, b = (numbered(spark.read.text(p).withColumnRenamed("value", n)) for p, n in zip((left, right), names, strict=True))
    if a.count() != b.count():
        raise ValueError(f"{left} and {right} have not as many lines")
    return a.join(b, "ordinal").select("ordinal", *names)


def read_translation_jsonl(spark: SparkSession, path: str, left: str, right: str) -> DataFrame:
    rows = spark.read.text(path).filter(F.trim("value") != "")
    parsed = rows.select(F.from_json("value", f"translation struct<`{left}`:string,`{right}`:string>").alias("j"))
    return parsed.select(F.col(f"j.translation.{left}").alias("src"), F.col(f"j.translation.{right}").alias("tgt"))


def read_archive(spark: SparkSession, path: str, members: Sequence[str]) -> DataFrame:
    """(member, ordinal, text): the lines of those files in tar archives whose path ends as one of ``members``; raises if one is missing.

    An archive is read whole by one task, so it has to fit there, and below 2 GB.
    """

    def lines(batches):
        for pdf in batches:
            for content in pdf["content"]:
                with tarfile.open(fileobj=io.BytesIO(content)) as archive:
                    for entry in archive:
                        name = next((m for m in members if f"/{entry.name}".endswith(f"/{m}")), None)
                        if name and entry.isfile():
                            text = archive.extractfile(entry).read().decode().removesuffix("\n").split("\n")
                            yield pd.DataFrame({"member": name, "ordinal": range(len(text)), "text": text})

    out = spark.read.format("binaryFile").load(path).select("content").mapInPandas(lines, "member string, ordinal long, text string")
    missing = set(members) - {r.member for r in out.select("member").distinct().collect()}
    if missing:
        raise ValueError(f"{path} has no {sorted(missing)}")
    return out


def read_verses(spark: SparkSession, path: str, row_tag: str = "seg") -> DataFrame:
    """Keyed verses of an XML file: id attribute and text, white space as one space."""
    rows = spark.read.format("xml").option("rowTag", row_tag).schema("_id string, _VALUE string").load(path)
    return rows.select(F.col("_id").alias("verse"), F.trim(F.regexp_replace("_VALUE", r"\s+", " ")).alias("text")).filter(F.col("text") != "")


def read_zipped_verses(spark: SparkSession, path: str, pattern: str = r"^b\.([A-Z0-9]{3})\.(\d+)\.(\d+)$") -> DataFrame:
    """(verse, text) of the first XML member of a zip archive: segments whose id fits ``pattern``, their sentences joined.

    An archive is opened in one task and parsed as a stream of elements.
    """

    def verses(batches):
        wanted = re.compile(pattern)
        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    member = next((n for n in archive.namelist() if n.endswith(".xml")), None)
                    if member is None:
                        raise ValueError("the archive has no XML member")
                    found = []
                    with archive.open(member) as stream:
                        for _, seg in ElementTree.iterparse(stream):
                            if seg.tag != "seg":
                                continue
                            m, text = wanted.match(seg.get("id") or ""), " ".join(w for s in seg.iter("s") for w in "".join(s.itertext()).split())
                            if m and text:
                                found.append((f"{m[1]} {int(m[2])}:{int(m[3])}", text))
                            seg.clear()
                    yield pd.DataFrame(found, columns=["verse", "text"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(verses, "verse string, text string").groupBy("verse").agg(F.last("text").alias("text"))


def read_sources(spark: SparkSession, paths: dict[str, str] | str, needed: Sequence[str] = ("src", "tgt")) -> dict[str, DataFrame]:
    """CSV sources by name, in order of the names; files without the needed columns are left out.

    ``paths`` names each file, or is a folder whose CSV files are named by their stems.
    """
    if isinstance(paths, str):
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(paths).select("path").collect()
        paths = {r.path.rpartition("/")[2].removesuffix(".csv"): r.path for r in files}
    found = {}
    for name in sorted(paths):
        df = spark.read.csv(paths[name], header=True, inferSchema=False, multiLine=True, escape='"')
        if set(needed) <= set(df.columns):
            found[name] = df.withColumn("source", F.lit(name))
    return found


class Registry:
    """Named sources, each with a function that collects it; what is there already is skipped."""

    def __init__(self):
        self.sources: dict[str, Callable[[SparkSession], DataFrame]] = {}

    def add(self, name: str):
        def register(f):
            self.sources[name] = f
            return f

        return register

    def collect(self, spark: SparkSession, folder: str, names: Sequence[str] = (), force: bool = False) -> dict[str, str]:
        """What became of each source: ``kept`` or ``written``.  Sources that are named, or all with ``force``, are rebuilt."""
        unknown = set(names) - set(self.sources)
        if unknown:
            raise ValueError(f"unknown sources: {sorted(unknown)}")
        done = {}
        for name in sorted(names or self.sources):
            path = f"{folder}/{name}"
            if exists(spark, path) and not (force or names):
                done[name] = "kept"
            else:
                self.sources[name](spark).write.mode("overwrite").parquet(path)
                done[name] = "written"
        return done


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def write_splits(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV as the readers take it: a header, quotes doubled, a null as an empty field."""
    df.write.mode("overwrite").csv(path, header=True, escape='"', nullValue="", emptyValue="")


def append_scores(spark: SparkSession, path: str, new: DataFrame) -> None:
    """Adds the keys that a score cache does not have yet; the first score of a key stays."""
    fresh = new.dropDuplicates(["key"])
    if exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select("key"), "key", "left_anti")
    fresh.write.mode("append").parquet(path)


def append_results(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new rows under the wider header, gaps blank."""
    joined = old.unionByName(new, allowMissingColumns=True)
    return joined.na.fill("")


def append_results_file(spark: SparkSession, path: str, new: DataFrame) -> None:
    """Adds rows to a results folder of CSV files; a new column widens the header of the old rows.  The old files go only once the new ones stand."""
    new = new.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in new.columns))
    if exists(spark, path):
        new = append_results(spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"'), new)
    write_csv(new.coalesce(1), f"{path}.new")
    system = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)
    system.rename(spark._jvm.org.apache.hadoop.fs.Path(f"{path}.new"), spark._jvm.org.apache.hadoop.fs.Path(path))


def merge_manifest(old: str | None, new: dict) -> str:
    """A JSON manifest with the new keys replaced and all others as they were."""
    return json.dumps((json.loads(old) if old else {}) | new, indent=2, sort_keys=True, ensure_ascii=False)


def turn_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, src, tgt): each user turn with the assistant turn that follows it."""
    after = Window.partitionBy("conv_id").orderBy("turn")
    paired = turns.withColumn("tgt", F.lead("text").over(after)).withColumn("_next", F.lead("role").over(after))
    return paired.filter((F.col("role") == "user") & (F.col("_next") == "assistant")).select("conv_id", "turn", F.col("text").alias("src"), "tgt")

"""An addition: arriving pairs cleaned and deduplicated by content key as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import relational as R


def clean_stream(pairs: DataFrame, event_time: str, delay: str = "1 hour") -> DataFrame:
    """Filters and keep-one by content key within the watermark; state is bounded by ``delay``."""
    kept = pairs.filter(R.length_between(F.col("src"), 5, 500) & R.length_between(F.col("tgt"), 10, 500))
    keyed = kept.withColumn("key", X.content_key(F.col("src"), F.col("tgt")))
    return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["key"])

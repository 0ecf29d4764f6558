"""Mixing sources to target weights by fitting each source's word budget exactly.

Words are counted per document, then per (source, exact length) only counts are
kept.  Whole repeats of a source use up as much of its target as they can; what
remains is a subset-sum problem over lengths with bounded multiplicities, solved
from the counts alone: a proportional share of every length, then dynamic
programming for the rest.  Documents are drawn per length by seeded hash order.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_text import blocks, word_spans
from .shared import arrow_batch, checkpointed, join_largest


def water_fill(sizes: dict[str | None, int], weights: Sequence[float], cap: float, share: float = 1.0) -> dict[str | None, float]:
    """Targets by weight of ``share`` of all words; none above ``cap`` times its source, the excess shared again by weight.

    Sources are in code point order with null last; ``weights`` repeat over them.
    """
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    left, open_ = share * sum(sizes.values()), list(order)
    target: dict[str | None, float] = {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > cap * sizes[s]]
        if not full:
            return target | {s: left * weight[s] / total for s in open_}
        for s in full:
            target[s] = cap * float(sizes[s])
        left -= sum(target[s] for s in full)
        open_ = [s for s in open_ if s not in target]
    return target


def bounded_subset_sum(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = 1 << 16) -> np.ndarray:
    """How many of each length to take so that their words come as close below ``budget`` as can be.

    Every length first gives the same share of its documents, so that the choice keeps
    the source's profile.  Of what that leaves, all but ``window`` words, and all but the
    longest spare length, is filled greedily, longest first.  The rest is solved exactly as a
    bounded knapsack over reachable sums: a bit per sum, in units of the lengths' common
    divisor, multiplicities split into powers of two, bits kept per piece for the way back.
    There is no size at which the programme is left out.  If it leaves a gap, it runs again
    with twice the window, down to no greedy step at all.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    taken = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return taken
    if budget >= total:
        return counts.copy()
    share = np.minimum(np.floor(counts * (budget / total)).astype(np.int64), counts)
    left = budget - int((share * lengths).sum())
    order = np.argsort(-lengths, kind="stable")
    best, gap = share, left
    unit = max(1, int(np.gcd.reduce(lengths[counts > share]))) if (counts > share).any() else 1
    while True:
        taken, rest = share.copy(), left
        spare = counts - taken
        longest = int(lengths[spare > 0].max(initial=0))
        for i in order:
            more = min(int(spare[i]), max(0, rest - window - longest) // int(lengths[i])) if lengths[i] else 0
            taken[i] += more
            rest -= more * int(lengths[i])
        greedy = int((taken - share).sum())
        taken += _exact(lengths, counts - taken, rest, order)
        over = budget - int((taken * lengths).sum())
        if over < gap:
            best, gap = taken, over
        if gap == left % unit or not greedy:
            return best
        window *= 2


def _exact(lengths: np.ndarray, spare: np.ndarray, budget: int, order: np.ndarray) -> np.ndarray:
    """The bounded knapsack itself: how many of each spare length come closest below ``budget``."""
    taken = np.zeros(len(lengths), np.int64)
    unit = int(np.gcd.reduce(lengths[spare > 0])) if (spare > 0).any() else 0
    if budget <= 0 or not unit:
        return taken
    size = budget // unit
    mask, reach, steps = (1 << (size + 1)) - 1, 1, []
    for i in order[::-1]:
        length, more, piece = int(lengths[i]) // unit, int(spare[i]), 1
        while length and more > 0 and length * piece <= size:
            k = min(piece, more)
            steps.append((i, k, length, reach))
            reach |= (reach << (length * k)) & mask
            more, piece = more - k, piece * 2
        if reach >> size & 1:
            break
    at = reach.bit_length() - 1
    for i, k, length, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += k
            at -= k * length
    return taken


def document_sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("source", T.StringType()), T.StructField("size", T.LongType()), T.StructField("h", T.LongType())])

    def count(batches):
        for block in blocks(batches, "text"):
            rows = word_spans(block)[2]
            yield arrow_batch(schema, [block.rows.column(0), block.rows.column(1), np.bincount(rows, minlength=block.n), block.rows.column(3)])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), text.alias("text"), F.xxhash64(F.lit(seed), id_col, text).alias("h")).mapInArrow(count, schema)


def mix_sources(
    docs: DataFrame,
    *,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.0,
    max_repeat: int = 3,
    seed: int = 20240601,
    cell_rows: int = 2048,
    window: int = 1 << 16,
    broadcast_rows: int = 200_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken, copies.

    ``taken`` is size times ``copies`` and copies is at most ``max_repeat``.  A null or
    blank text has size 0 and takes 0; a null source is a source of its own, weighed
    last; repeated rows count as often as they stand there; an empty table gives an
    empty result.  Other columns of ``docs`` are not read.

    Among documents of one source and length the seeded hash of id and text decides, then
    the id; copies with one id are alike and any of them serves.  A very long text is counted
    whole.

    The driver holds one number per source.  A group of equal (source, length) is cut
    by hash into cells of about ``cell_rows`` documents before it is ranked, so a group with
    a third of all rows is ranked by as many tasks as it has cells.  The plan has a row per
    source and length; its ``broadcast_rows`` largest groups are broadcast.
    """
    sized = checkpointed(document_sizes(docs, id_col, text_col, source_col, seed).withColumn("skey", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))))
    hist = sized.groupBy("skey", "size").agg(F.count(F.lit(1)).alias("n"))
    totals = {(r.skey[1:] if r.skey else None): int(r.words) for r in hist.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect()}
    targets = water_fill(totals, weights, max_repeat, share)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size").reset_index(drop=True)
        key = pdf["skey"].iloc[0]
        source = key[1:] if key else None
        words, target = totals[source], targets[source]
        whole = min(int(round(target)) // words, max_repeat) if words else 0
        rest = int(round(target)) - whole * words if whole < max_repeat else 0
        extra = bounded_subset_sum(pdf["size"].to_numpy(np.int64), np.where(pdf["size"] > 0, pdf["n"], 0).astype(np.int64), rest, window)
        return pdf.assign(whole=np.where(pdf["size"] > 0, whole, 0), extra=extra, source_size=words, target=float(target))[["skey", "size", "n", "whole", "extra", "source_size", "target"]]

    plan = hist.groupBy("skey").applyInPandas(fit, "skey string, size long, n long, whole long, extra long, source_size long, target double")
    plan = checkpointed(plan)
    fraction = F.shiftrightunsigned("h", 11).cast("double") / F.lit(float(1 << 53))
    drawn = join_largest(sized, plan, ["skey", "size"], "n", broadcast_rows)
    drawn = drawn.withColumn("cell", F.floor(fraction * F.ceil(F.col("n") / F.lit(cell_rows))))
    # By hand: a join by (source, length) would else serve the ranking too, with a hot group in one task.
    drawn = drawn.repartition("skey", "size", "cell")
    in_group = Window.partitionBy("skey", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = drawn.filter(F.col("n") > cell_rows).groupBy("skey", "size", "cell").agg(F.count(F.lit(1)).alias("members"))
    cells = cells.select("skey", "size", "cell", F.coalesce(F.sum("members").over(in_group), F.lit(0)).alias("before"))
    drawn = drawn.join(cells, ["skey", "size", "cell"], "left")
    rank = F.row_number().over(Window.partitionBy("skey", "size", "cell").orderBy("h", "doc_id")) + F.coalesce("before", F.lit(0))
    copies = (F.col("whole") + (rank <= F.col("extra")).cast("long")).alias("copies")
    return drawn.select("doc_id", "source", "size", "source_size", "target", copies).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")

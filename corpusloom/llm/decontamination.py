"""Benchmark decontamination by pigeonhole edit matching.

An item with an error budget of k edits is cut into k + 1 pieces; a passage within
the budget holds one of them unchanged.  The pieces are laid out as a tree whose
nodes split their budget so that a node within its budget has a child within its
own.  Exact piece hits (one Aho-Corasick pass over a text) are verified upwards
through the tree with Myers' bit-parallel distance, so a chance hit costs a few
short columns, and the root decides with the whole item.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_batch, whole_row

ERROR_RATE, MIN_PIECE, BLOCK_PIECES = 0.1, 8, 20_000
_GAP = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    """Case folded, every run of anything but letters and digits one space, none at the ends."""
    return _GAP.sub(" ", (text or "").casefold()).strip()


def budget(length: int, rate: float = ERROR_RATE, min_piece: int = MIN_PIECE) -> int:
    """Edits allowed for an item of so many characters; pieces keep ``min_piece`` characters."""
    return max(0, min(int(length * rate), length // min_piece - 1))


@dataclass
class Node:
    """A stretch of an item with its budget; ``peq`` has the places of each character, as bits."""

    start: int
    stop: int
    budget: int
    parent: Node | None
    peq: dict[str, int] = field(default_factory=dict)


def piece_tree(item: str, errors: int) -> list[Node]:
    """The leaves; each knows its parents up to the whole item."""
    leaves: list[Node] = []

    def grow(start: int, stop: int, k: int, parent: Node | None) -> None:
        node = Node(start, stop, k, parent)
        for i, c in enumerate(item[start:stop]):
            node.peq[c] = node.peq.get(c, 0) | 1 << i
        if k == 0:
            leaves.append(node)
            return
        left = (k - 1) // 2
        middle = start + (stop - start) * (left + 1) // (k + 1)
        grow(start, middle, left, node)
        grow(middle, stop, k - 1 - left, node)

    grow(0, len(item), errors, None)
    return leaves


def best_distance(peq: dict[str, int], m: int, text: str) -> int:
    """Least edit distance of a pattern of length m to any substring of ``text`` (Myers 1999)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        if score < best:
            best = score
    return best


class Matcher:
    """All items of one block of the benchmark, as one automaton over their pieces."""

    def __init__(self, items: list[tuple[object, str]], rate: float = ERROR_RATE, min_piece: int = MIN_PIECE):
        import ahocorasick

        self.automaton, pieces = ahocorasick.Automaton(), {}
        for item_id, text in items:
            k = budget(len(text), rate, min_piece)
            for leaf in piece_tree(text, k) if text else []:
                pieces.setdefault(text[leaf.start : leaf.stop], []).append((item_id, len(text), leaf))
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, owners)
        self.some = bool(pieces)
        if self.some:
            self.automaton.make_automaton()

    def search(self, text: str) -> dict[object, tuple[int, int]]:
        """item -> (least distance found, item length) for the items that a passage of ``text`` comes within budget of."""
        found: dict[object, tuple[int, int]] = {}
        failed: set[tuple[int, int]] = set()
        if not self.some:
            return found
        for end, owners in self.automaton.iter(text):
            for item_id, length, leaf in owners:
                if item_id in found and found[item_id][0] == 0:
                    continue
                origin = end + 1 - (leaf.stop - leaf.start) - leaf.start  # where the item would start
                node, distance = leaf, 0
                while node.parent is not None:
                    node = node.parent
                    if (id(node), origin) in failed:
                        break
                    k = node.budget
                    distance = best_distance(node.peq, node.stop - node.start, text[max(0, origin + node.start - k) : max(0, origin + node.stop + k)])
                    if distance > k:
                        failed.add((id(node), origin))
                        break
                else:
                    if item_id not in found or distance < found[item_id][0]:
                        found[item_id] = (distance, length)
        return found


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, rate: float, min_piece: int, limit: int):
    """Normalised items in blocks of at most ``limit`` pieces (one item at least)."""
    block, pieces = [], 0
    for row in benchmark.select(item_col, F.col(text_col).cast("string")).dropDuplicates().toLocalIterator():
        text = normalise(row[1])
        size = budget(len(text), rate, min_piece) + 1
        if block and pieces + size > limit:
            yield block
            block, pieces = [], 0
        if text:
            block.append((row[0], text))
            pieces += size
    if block:
        yield block


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    rate: float = ERROR_RATE,
    min_piece: int = MIN_PIECE,
    block_pieces: int = BLOCK_PIECES,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, distance, item_chars) for every document and item whose text stands in it within the budget.

    ``distance`` is the least edit distance that the hits lead to.  Both sides are
    normalised.  An item that is null or has no letter or digit matches nothing, and
    neither does a null or empty document.  Repeated documents are reported each;
    repeated items once per id.  Extra columns are not read.  Empty tables on either side
    give an empty result.  A very long text is searched whole.

    The benchmark goes to the executors in blocks of at most ``block_pieces`` pieces;
    a larger benchmark means more passes over the documents, not a larger broadcast.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("item_id", benchmark.schema[item_col].dataType), T.StructField("distance", T.LongType()), T.StructField("item_chars", T.LongType())])
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for block in benchmark_blocks(benchmark, item_col, item_text_col, rate, min_piece, block_pieces):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            matcher = Matcher(shared.value, rate, min_piece)
            for batch in batches:
                rows: list[tuple] = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    rows.extend((doc_id, item, d, m) for item, (d, m) in matcher.search(normalise(text.as_py())).items())
                yield arrow_batch(schema, [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], [], []])

        part = texts.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, rate: float = ERROR_RATE, min_piece: int = MIN_PIECE, block_pieces: int = BLOCK_PIECES, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents, all columns, that :func:`find_contamination` would not report.

    Rows are filtered where they are, null and repeated ones too, each by its own text; columns
    may have any name; of an empty table nothing is left.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("text"), whole_row(docs))  # columns of any name
    schema = rows.schema
    for block in benchmark_blocks(benchmark, item_col, item_text_col, rate, min_piece, block_pieces):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            matcher = Matcher(shared.value, rate, min_piece)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.search(normalise(t.as_py())) for t in batch.column(0)], pa.bool_()))

        rows = rows.mapInArrow(run, schema)
    return rows.select("_row.*")

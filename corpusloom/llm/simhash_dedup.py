"""SimHash near-duplicates: Golay-code fuzzy hashing of fingerprint segments.

A 64-bit fingerprint is cut into four 16-bit segments.  At most three differing bits
leave one segment equal; the others differ by (3), (2, 1) or (1, 1, 1) bits.  In the
first two cases two segments are equal, which six exact pairs catch.  In the last,
each other segment differs by one bit: padded to 23 bits, two such words share a
codeword of the perfect binary Golay code within distance 4 of both (the nearest
codeword of one is at most 3 + 1 from the other), so the equal segment together with
a codeword index of the next segment is a common key.  Every key has 28 bits or more;
with ``codes=2`` a second segment's codewords make it 40 bits for very large corpora.
Fingerprints that share a key are verified by their Hamming distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_text import Block, blocks, is_space, word_spans
from .components import components
from .shared import arrow_batch, checkpointed, join_largest

SEED, SHINGLE, DISTANCE = 42, 3, 3

# ---------------------------------------------------------------- fingerprints


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data - np.uint8(65)) < 26, data + np.uint8(32), data)


def shingle_hashes(block: Block, size: int = SHINGLE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every word shingle, and its row; fewer words than ``size`` make one shingle."""
    import xxhash

    starts, ends, rows = word_spans(block)
    if not len(starts):
        return np.zeros(0, np.uint64), rows
    data = lower_ascii(block.data)
    # Write every word followed by one space; a shingle is then one slice.
    keep = ~is_space(data)
    widths = ends - starts
    new_starts = np.concatenate(([0], np.cumsum(widths + 1)[:-1]))
    joined = np.full(int(new_starts[-1] + widths[-1] + 1), 32, np.uint8)
    at = np.flatnonzero(keep)
    joined[at - np.repeat(starts - new_starts, widths)] = data[at]
    new_ends = new_starts + widths
    n = len(rows)
    counts = np.bincount(rows, minlength=block.n)
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    last_of_row = (first + counts - 1)[rows]
    index = np.arange(n)
    chosen = (index + size - 1 <= last_of_row) | ((counts[rows] < size) & (index == first[rows]))
    begin = index[chosen]
    stop = np.minimum(begin + size - 1, last_of_row[chosen])
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = [digest(raw[a:b], seed) for a, b in zip(new_starts[begin].tolist(), new_ends[stop].tolist(), strict=True)]
    return np.array(hashes, np.uint64), rows[chosen]


def fingerprints(block: Block, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Bit i is set if over half of a text's shingle hashes have it; zero without words."""
    hashes, rows = shingle_hashes(block, size, seed)
    counts = np.bincount(rows, minlength=block.n)
    ones = np.zeros((block.n, 64), np.int64)
    full = np.flatnonzero(counts)
    if len(full):
        first = np.searchsorted(rows, full)
        step = 1 << 17
        edges = [0]
        while edges[-1] < len(rows):
            edges.append(min(edges[-1] + step, len(rows)))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            bits = np.unpackbits(hashes[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            own = np.unique(rows[a:b])
            at = np.maximum(np.searchsorted(rows[a:b], own), 0)
            ones[own] += np.add.reduceat(bits, at, axis=0, dtype=np.int64)
    majority = ones * 2 > counts[:, None]
    return np.packbits(majority, axis=1, bitorder="little").view(np.uint64).ravel()


# ---------------------------------------------------------------- Golay keys


def _golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Per 11-bit syndrome the error patterns of weight at most 4 that lead to a codeword: one, or the nearest and five at distance 4."""
    generator = 0b101011100011  # the Golay code's generator polynomial, of degree 11

    words = np.arange(1 << 23, dtype=np.int64)
    remainder = words.copy()
    for bit in range(22, 10, -1):
        remainder ^= np.where(remainder >> bit & 1, generator << (bit - 11), 0)
    weight = np.zeros(1 << 23, np.int8)
    for bit in range(23):
        weight += (words >> bit & 1).astype(np.int8)
    light = np.flatnonzero(weight <= 4)
    order = light[np.lexsort((light, weight[light], remainder[light]))]
    syndrome = remainder[order]
    first = np.searchsorted(syndrome, np.arange(2048))
    size = np.bincount(syndrome, minlength=2048)
    patterns = np.full((2048, 6), -1, np.int64)
    for i in range(6):
        have = size > i
        patterns[have, i] = order[first[have] + i]
    return remainder[: 1 << 16], patterns


_KEYS: list[np.ndarray] = []


def segment_codewords() -> np.ndarray:
    """For each 16-bit segment up to six 12-bit codeword indices, -1 where there are fewer."""
    if not _KEYS:
        syndrome, patterns = _golay_tables()
        errors = patterns[syndrome]
        code = (np.arange(1 << 16)[:, None] ^ errors) >> 11  # the systematic bits name the codeword
        _KEYS.append(np.where(errors < 0, -1, code).astype(np.int64))
    return _KEYS[0]


def bucket_keys(fp: np.ndarray, codes: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(index into fp, key) for every key of every fingerprint."""
    parts = [(fp >> np.uint64(16 * i)).astype(np.int64) & 0xFFFF for i in range(4)]
    table, index = segment_codewords(), np.arange(len(fp))
    out_index, out_key = [], []
    kind = 0
    for i in range(4):
        for j in range(i + 1, 4):
            out_index.append(index)
            out_key.append(kind << 48 | parts[i] << 16 | parts[j])
            kind += 1
    for i in range(4):
        words = table[parts[(i + 1) % 4]]
        own = [parts[i] << 12 | np.maximum(words[:, k], 0) for k in range(6)]
        held = [words[:, k] >= 0 for k in range(6)]
        if codes == 2:
            more = table[parts[(i + 2) % 4]]
            own, held = zip(*((o << 12 | np.maximum(more[:, k], 0), h & (more[:, k] >= 0)) for o, h in zip(own, held, strict=True) for k in range(6)), strict=True)
        for o, h in zip(own, held, strict=True):
            out_index.append(index[h])
            out_key.append(kind << 48 | o[h])
        kind += 1
    return np.concatenate(out_index), np.concatenate(out_key)


def spanning_links(fp: np.ndarray, distance: int = DISTANCE, step: int = 1 << 20) -> list[tuple[int, int]]:
    """Links that connect what is connected within one bucket by steps of at most ``distance`` bits.

    Breadth first: a fingerprint meets only those not reached yet, so a dense bucket
    costs little more than its size; the links are fewer than its fingerprints.
    """
    links, open_ = [], np.unique(fp)
    while len(open_) > 1:
        front, open_ = [open_[0]], open_[1:]
        while front and len(open_):
            x = front.pop()
            near = np.bitwise_count(open_ ^ x) <= distance
            if near.any():
                found = open_[near]
                links.extend((int(x), int(y)) for y in found)
                front.extend(found)
                open_ = open_[~near]
    return links


def fingerprint_links(distinct: DataFrame, codes: int, distance: int = DISTANCE) -> DataFrame:
    """(u, v) links between distinct fingerprints (signed 64-bit), connected as all links within ``distance`` are."""

    def keys(batches):
        schema = pa.schema([("key", pa.int64()), ("fp", pa.int64())])
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 1 << 15):
                part = fp[at : at + (1 << 15)]
                index, key = bucket_keys(part.view(np.uint64), codes)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[index])], schema=schema)

    def verify(batches):
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
        held_key, held = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def links(key, fp):
            cut = np.flatnonzero(np.diff(key)) + 1
            first, stop = np.concatenate(([0], cut)), np.concatenate((cut, [len(key)]))
            found = []
            for i in np.flatnonzero(stop - first > 1):
                found.extend(spanning_links(fp[first[i] : stop[i]].view(np.uint64), distance))
            uv = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(uv[:, 0].copy()), pa.array(uv[:, 1].copy())], schema=schema)

        for batch in batches:
            key = np.concatenate((held_key, batch.column(0).to_numpy(zero_copy_only=False)))
            fp = np.concatenate((held, batch.column(1).to_numpy(zero_copy_only=False)))
            whole = np.searchsorted(key, key[-1])  # the last key may go on in the next batch
            held_key, held = key[whole:], fp[whole:]
            if whole:
                yield links(key[:whole], fp[:whole])
        if len(held):
            yield links(held_key, held)

    return distinct.select("fp").mapInArrow(keys, "key long, fp long").repartition("key").sortWithinPartitions("key").mapInArrow(verify, "u long, v long").distinct()


def document_fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, seed: int) -> DataFrame:
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def run(batches):
        for block in blocks(batches, "text"):
            yield arrow_batch(schema, [block.rows.column(0), fingerprints(block, shingle, seed).view(np.int64)])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, distance: int = DISTANCE, codes: int = 1) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    ``component_id`` is the smallest doc_id that links lead to, itself included; a link
    joins fingerprints with at most ``distance`` (3 or less) differing bits.  Null, empty
    and blank texts have fingerprint zero and link like any other.  Rows with a null id
    get a fingerprint, and the least non-null id of their component (null if there is
    none).  Repeated rows stay.  A very long text is read whole, in a block of its own.  An
    empty table gives an empty result.

    Copies collapse to one fingerprint before any key is made.  ``codes`` (1 or 2 codewords
    in a key) picks the key length; either is exact, and 2 suits more than some 2**27
    distinct fingerprints.
    """
    if not 0 <= distance <= 3:
        raise ValueError("the keys are complete up to 3 bits")
    marked = checkpointed(document_fingerprints(docs, id_col, text_col, shingle, seed))
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    linked = components(fingerprint_links(distinct, codes, distance))
    classes = distinct.join(linked.withColumnRenamed("vertex", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = checkpointed(classes.select("fp", "component", "n").join(least, "component").select("fp", "component_id", "n"))
    return join_largest(marked, named, ["fp"], "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

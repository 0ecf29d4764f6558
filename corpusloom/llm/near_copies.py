"""Near copies by the Jaccard similarity of word shingle sets, found by SimHash fingerprints and Golay codewords.

The method is that of ``simhash_dedup``, with a wider budget of bits.  A pair at similarity
0.8 differs in some 15% of its fingerprint bits (the angle of sets that share 8/9 of their
members is 27 degrees), about 10 of 64, so one fingerprint of three segments more or less
equal is not enough: a set gets 18 fingerprints, and their 72 segments of 16 bits make 24
tables of three.  Two segments share one of their Golay codewords with probability 0.79 at
15% (always up to 2 bits, as before), unrelated ones with 0.07.  Sets that share a codeword
in each segment of a table and that are near in 256 check bits and in size are linked; a pair
at 0.8 is in no table with probability 1.1e-7 (1e-4 for a set of four shingles against one of
five, whose bits differ in 19%), a closer one with less.  What these links connect is one
class of candidates, in which every pair that has to be is verified on the whole sets of
hashes; only exact similarities decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_text import Block, blocks, mix64
from .components import components
from .shared import arrow_batch, checkpointed, join_largest, whole_row
from .simhash_dedup import SEED, segment_codewords, shingle_hashes

SHINGLE, SIMILARITY = 5, 0.8
TABLES, SEGMENTS = 24, 3
PRINTS = TABLES * SEGMENTS // 4
#: The first fingerprints are a table's check bits.  Pairs at 0.8 differ in 39 of 256 bits (five shingles: 48), standard deviation 6; unrelated ones in 128, deviation 8.
CHECKS, CHECK_BITS, FIRST_BITS = 4, 72, 28
#: Share of all fingerprint bits in which a pair at 0.8 may differ: 0.15 on average (five shingles: 0.19), standard deviation 0.011.
FAR = 0.25
#: Bytes of a shingle's hash that a set keeps: two of a text's shingles fall together with probability 2**-40.
ITEM_BYTES = 5
#: Sets in one part of a table, about; and keys made at a time.
PART_SETS, KEYS = 500_000, 1 << 21
_RECORD = np.dtype([("sid", "<i8"), ("check", "<u8", (CHECKS,)), ("segment", "<u2", (SEGMENTS,)), ("size", "<u4")])
_ROW_BITS = 27
_STEPS = np.arange(PRINTS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
#: Eight bits as eight counters of a byte each.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def shingle_sets(block: Block, size: int = SHINGLE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row, sorted, one row after the other; and the rows' offsets."""
    hashes, rows = shingle_hashes(block, size, seed)
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    hashes, rows = hashes[new], rows[new]
    return hashes, np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=block.n))))


def sketches(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sets with a shingle, and their SimHash fingerprints: bit i of the k-th is set if over half of the set's k-th hashes have it."""
    full = np.flatnonzero(np.diff(offsets))
    first, size = offsets[full], np.diff(offsets)[full]
    out = np.zeros((len(full), PRINTS), np.uint64)
    if not len(full):
        return full, out
    # A counter of a byte holds 255 shingles.
    pieces = -(-size // 255)
    whole = np.cumsum(pieces) - pieces
    begin = np.repeat(first, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(whole, pieces))
    ones = np.empty((len(begin), 8), np.uint64)
    for k, step in enumerate(_STEPS):
        own = mix64(hashes + step).view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            ones[:, byte] = np.add.reduceat(_SPREAD[own[:, byte]], begin)
        counts = np.add.reduceat(ones.view(np.uint8).reshape(-1, 64), whole, axis=0, dtype=np.int64)
        out[:, k] = np.packbits(2 * counts > size[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return full, out


def packed_sets(hashes: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The upper ``ITEM_BYTES`` bytes of each hash of a set, in order: the part of the set that is stored and compared."""
    raw = np.ascontiguousarray(hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :ITEM_BYTES]).tobytes()
    cut = (ITEM_BYTES * offsets).tolist()
    return [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def unpacked_set(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // ITEM_BYTES, 8), np.uint8)
    out[:, :ITEM_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, ITEM_BYTES)
    return out.view(">u8").ravel().astype(np.uint64)


def _class_of(code: np.ndarray) -> np.ndarray:
    return (mix64(code.astype(np.int64).view(np.uint64)) >> np.uint64(33)).astype(np.int64)


def table_records(sid: np.ndarray, prints: np.ndarray, size: np.ndarray, table: int) -> np.ndarray:
    """What a table needs of each set: three segments of different fingerprints, and the check bits."""
    out = np.empty(len(sid), _RECORD)
    out["sid"], out["check"], out["size"] = sid, prints[:, :CHECKS], size
    out["segment"] = np.ascontiguousarray(prints).view("<u2").reshape(len(sid), -1)[:, table::TABLES]
    return out


def least_connected(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` vertices the least one that links (u, v) lead to."""
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    return label


def candidate_links(records: np.ndarray, part: int = 0, parts: int = 1, keys: int = KEYS, long: int = 64) -> np.ndarray:
    """(u, v) sids of one part of a table that connect all that share a codeword in each segment and are near; fewer than its sets.

    A link leads to the least sid of its component, so that other tables mostly find the same
    links.  A part takes the codewords of the first segment that fall to it, some of them at a time.
    Keys with more than ``long`` sets are scanned breadth first, so that many copies cost rows, not pairs.
    """
    records = records[np.argsort(records["sid"])]
    codes = segment_codewords().astype(np.int16)
    first, second, third = (codes[records["segment"][:, j]] for j in range(SEGMENTS))
    check = [np.ascontiguousarray(records["check"][:, j]) for j in range(CHECKS)]
    size = records["size"].astype(np.int64)
    of = _class_of(first)
    passes = 1 + len(records) * 150 // (keys * parts)
    turn = np.where((first >= 0) & (of % parts == part), of // parts % passes, -1)

    def near(x, y):
        kept = np.flatnonzero(np.bitwise_count(check[0][x] ^ check[0][y]) <= FIRST_BITS)
        x, y = (np.broadcast_to(i, np.broadcast_shapes(np.shape(x), np.shape(y)))[kept] for i in (x, y))
        bits = sum(np.bitwise_count(c[x] ^ c[y]).astype(np.int64) for c in check)
        return kept[(bits <= CHECK_BITS) & (np.minimum(size[x], size[y]) >= SIMILARITY * np.maximum(size[x], size[y]) - 1e-9)]

    least = np.arange(len(records))
    for k in range(passes):
        row, which = np.nonzero(turn == k)
        a, b, c = first[row, which].astype(np.int64), second[row].astype(np.int64), third[row].astype(np.int64)
        packed = (a << 24 + _ROW_BITS | row)[:, None, None] | b[:, :, None] << 12 + _ROW_BITS | c[:, None, :] << _ROW_BITS
        packed = packed[(b >= 0)[:, :, None] & (c >= 0)[:, None, :]]
        packed.sort()
        key, row = packed >> _ROW_BITS, packed & ((1 << _ROW_BITS) - 1)
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(new, len(key)))
        links = []
        small = np.repeat(np.where(count <= long, np.cumsum(count), 0), count)  # where the key ends, if it is no long one
        at, step = np.flatnonzero(np.arange(len(key)) + 1 < small), 1
        while len(at):
            x, y = row[at], row[at + step]
            hit = near(x, y)
            links.append(x[hit] << 32 | y[hit])
            step += 1
            at = at[at + step < small[at]]
        for i in np.flatnonzero(count > long):
            open_ = row[new[i] : new[i] + count[i]]
            while len(open_) > 1:
                front, open_ = [open_[0]], open_[1:]
                while front and len(open_):
                    x = front.pop()
                    hit = near(x, open_)
                    if len(hit):
                        links.append(np.minimum(x, open_[hit]) << 32 | np.maximum(x, open_[hit]))
                        front.extend(open_[hit])
                        open_ = np.delete(open_, hit)
        tree = np.flatnonzero(least != np.arange(len(least)))
        found = np.unique(np.concatenate((tree << 32 | least[tree], *links)))
        least = least_connected(found >> 32, found & 0xFFFFFFFF, len(records))
    tree = np.flatnonzero(least != np.arange(len(least)))
    return records["sid"][np.stack((tree, least[tree]), axis=1)]


def spanning_copies(marks: np.ndarray, sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links that connect what is connected in a bucket by pairs of at least ``similarity``; breadth first, each pair at most once; ``marks`` are the fingerprints."""
    sizes = np.array([len(s) for s in sets])
    links, open_ = [], np.arange(len(sets))
    while len(open_) > 1:
        front, open_ = [open_[0]], open_[1:]
        while front and len(open_):
            x = front.pop()
            near = np.bitwise_count(marks[open_] ^ marks[x]).sum(1, dtype=np.int64) <= FAR * 64 * marks.shape[1]
            near &= np.minimum(sizes[open_], sizes[x]) >= similarity * np.maximum(sizes[open_], sizes[x]) - 1e-9
            near = np.flatnonzero(near)
            if len(near):
                other = open_[near]
                every = np.concatenate([sets[i] for i in other])
                at = np.minimum(np.searchsorted(sets[x], every), sizes[x] - 1)
                first = np.concatenate(([0], np.cumsum(sizes[other])[:-1]))
                both = np.add.reduceat(sets[x][at] == every, first, dtype=np.int64)
                found = both * (1 + similarity) >= similarity * (sizes[other] + sizes[x]) - 1e-9
                links.extend((int(x), int(y)) for y in other[found])
                front.extend(other[found])
                open_ = np.delete(open_, near[found])
    return links


def _marked(docs: DataFrame, id_col: str, text_col: str, shingle: int, seed: int) -> DataFrame:
    """doc_id, th (hash of the text), sid (names the shingle set), marks (its fingerprints; empty without words), items (the set)."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("th", T.LongType()), T.StructField("sid", T.LongType()), T.StructField("marks", T.BinaryType()), T.StructField("items", T.BinaryType())])

    def run(batches):
        for block in blocks(batches, "text", 1 << 20):
            hashes, offsets = shingle_sets(block, shingle, seed)
            full, prints = sketches(hashes, offsets)
            raw, cut = hashes.tobytes(), (8 * offsets).tolist()
            sid = np.array([xxhash.xxh64_intdigest(raw[a:b], seed) for a, b in zip(cut[:-1], cut[1:], strict=True)], np.uint64).view(np.int64)
            items = packed_sets(hashes, offsets)
            marks = [b""] * block.n
            for i, m in zip(full.tolist(), prints, strict=True):
                marks[i] = m.tobytes()
            yield arrow_batch(schema, [block.rows.column(0), block.rows.column(2), sid, marks, items])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("th")).mapInArrow(run, schema)


def _deal(parts: int):
    """(part, records): the records of a batch of sets for each part of each table that they have a codeword in."""
    schema = pa.schema([("part", pa.int64()), ("records", pa.binary())])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sid, size = (batch.column(i).to_numpy() for i in (0, 2))
            prints = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(len(sid), -1)
            for table in range(TABLES):
                records, part, raw = table_records(sid, prints, size, table), [], []
                if parts > 1:
                    code = segment_codewords()[records["segment"][:, 0]]
                    of = np.where(code >= 0, _class_of(code) % parts, -1)
                for k in range(parts):
                    own = records if parts == 1 else records[(of == k).any(1)]
                    if len(own):
                        part.append(table * parts + k)
                        raw.append(own.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(raw, pa.binary())], schema=schema)

    return run


def _linked(parts: int):
    """(u, v) candidates, from the records of whole parts, sorted by part."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def links(part, raw):
        uv = candidate_links(np.frombuffer(b"".join(raw), _RECORD), part % parts, parts)
        return pa.RecordBatch.from_arrays([pa.array(uv[:, 0].copy()), pa.array(uv[:, 1].copy())], schema=schema)

    def run(batches):
        now, held = None, []
        for batch in batches:
            for part, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now and held:
                    yield links(now, held)
                    held = []
                now = part
                held.append(raw)
        if held:
            yield links(now, held)

    return run


def candidates(marked: DataFrame) -> DataFrame:
    """(sid, class) of the sets that a candidate link has: sets of similarity 0.8 or more are in one class."""
    sets = marked.filter(F.length("marks") > 0).groupBy("sid").agg(F.first("marks").alias("marks"), F.first(F.length("items") / ITEM_BYTES).cast("long").alias("size"))
    parts = 1 + marked.count() // PART_SETS
    dealt = sets.select("sid", "marks", "size").mapInArrow(_deal(parts), "part long, records binary").repartition("part").sortWithinPartitions("part")
    linked = components(dealt.mapInArrow(_linked(parts), "u long, v long").distinct())
    return linked.select(F.col("vertex").alias("sid"), F.col("component").alias("class"))


def _verified(similarity: float):
    """(sid, component) of the sets with a link, from whole classes: a component has its least sid as its name."""
    schema = pa.schema([("sid", pa.int64()), ("component", pa.int64())])

    def named(sids, marks, sets):
        marks = np.frombuffer(b"".join(marks), np.uint64).reshape(len(sids), -1)
        name = {}
        for a, b in spanning_copies(marks, [unpacked_set(s) for s in sets], similarity):
            name[b] = name.setdefault(a, a)  # breadth first: a is the start or has been reached before
        least = {}
        for i, head in name.items():
            least[head] = min(least.get(head, sids[i]), sids[i])
        return pa.RecordBatch.from_arrays([pa.array([sids[i] for i in name], pa.int64()), pa.array([least[h] for h in name.values()], pa.int64())], schema=schema)

    def run(batches):
        now, held = None, ([], [], [])
        for batch in batches:
            for of, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if of != now and held[0]:
                    yield named(*held)
                    held = ([], [], [])
                now = of
                for column, value in zip(held, row, strict=True):
                    column.append(value)
        if held[0]:
            yield named(*held)

    return run


def copy_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, seed: int = SEED) -> DataFrame:
    """(doc_id, th, component, component_id) per row: th is XXH64 of the text, component names the group, whatever its ids."""
    if not SIMILARITY <= similarity <= 1:
        raise ValueError("the keys find similarities from 0.8 on")
    marked = checkpointed(_marked(docs, id_col, text_col, shingle, seed))
    distinct = marked.groupBy("sid").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    sets = marked.filter(F.length("marks") > 0).groupBy("sid").agg(F.first("marks").alias("marks"), F.first("items").alias("items"))
    met = candidates(marked).join(sets, "sid").select("class", "sid", "marks", "items")
    linked = met.repartition("class").sortWithinPartitions("class").mapInArrow(_verified(similarity), "sid long, component long")
    classes = distinct.join(linked, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = checkpointed(classes.select("sid", "component", "n").join(least, "component").select("sid", "component", "component_id", "n"))
    return join_largest(marked.select("doc_id", "th", "sid"), named, ["sid"], "n").select("doc_id", "th", "component", "component_id")


def near_copies(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, component_id (the smallest doc_id that links lead to, itself included).

    A link joins texts whose sets of lower-cased ``shingle``-word shingles have a Jaccard
    similarity of ``similarity`` (0.8 or more) or higher; fewer words make one shingle.
    Null, empty and blank texts are copies of each other.  Rows with a null id get the
    least non-null id of their component (null if there is none).  Repeated rows stay.

    Texts with the same set collapse before any key is made, and a class of candidates is
    searched breadth first, so that copies cost rows, not pairs.
    """
    return copy_classes(docs, **options).select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The columns of ``docs``; of each group of near copies one row stays.

    It is the one with the smallest id (a null id is larger than any), of equal ids the one
    with the smallest hash of the text, of rows equal in both the one with the smallest hash
    of the whole row.  Every row is judged by its own text: rows with one id and different
    texts, or with null ids, are as good as any others.  Other columns may have any name.
    """
    classes = checkpointed(copy_classes(docs, id_col=id_col, text_col=text_col, **options))
    best = classes.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "th")).alias("best"))
    best = best.select(F.col("best.doc_id").alias("best_id"), F.col("best.th").alias("best_th"))
    rows = docs.select(F.col(id_col).alias("own_id"), F.xxhash64(F.col(text_col).cast("string")).alias("own_th"), whole_row(docs, "row"))
    kept = rows.join(best, (F.col("own_th") == F.col("best_th")) & F.col("own_id").eqNullSafe(F.col("best_id")), "left_semi")
    if classes.groupBy("doc_id", "th").count().filter("count > 1").limit(1).count():
        kept = kept.groupBy("own_id", "own_th").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return kept.select("row.*")

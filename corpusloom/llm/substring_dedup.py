"""Exact substring deduplication over a logarithmic family of suffix indexes.

Every byte covered by a ``length``-byte string that also starts anywhere else goes.
Indexing all suffixes would move the corpus many times over, so only sampled suffixes
travel: a window of ``length`` bytes is anchored at its minimizer, the least hashed
``seed``-byte string inside it (the first of equals), which depends on the window's
bytes alone.  Equal windows therefore have equal anchors at equal offsets.  The starts
that share an anchor form one run, described by the anchor's hash and by the hash of
the whole stretch that the run's windows cover.

Stage 1 finds which stretches can matter at all: a family sorted by name (the anchor, then
a 128-bit BLAKE2b digest of the stretch) collapses equal stretches to one and drops those
whose anchor stands nowhere else.  Stage 2 takes what shares an anchor but not the
stretch (the edges of repeats), fetches those few bytes, and holds every suffix that
starts in them against each other in their true byte order: only a common prefix of
``length`` bytes is a match.  Both families take batches as they come: a new batch gets its
suffix array, is merge-scanned against the existing levels, and levels of like size are
merged, so there are only logarithmically many.  Suffixes are many and 200 bytes long, so
stage 2 reads its shard sorted by anchor and begins a new family after some whole anchors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_text import SpanHash, blocks, mix64
from .shared import arrow_batch, checkpointed

LENGTH, SEED = 200, 64
POSITION_BITS = 20
SEGMENT = 1 << POSITION_BITS
BATCH_ROWS = 1 << 17
#: Stretches that stage 2 takes at a time, and the most suffixes it writes out at a time.
STRETCHES, SUFFIXES = 1 << 10, 1 << 16


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of each pair of two arrays of byte strings of one width."""
    width = a.dtype.itemsize
    if not len(a):
        return np.zeros(0, np.int64)
    differ = np.ascontiguousarray(a).view(np.uint8).reshape(-1, width) != np.ascontiguousarray(b).view(np.uint8).reshape(-1, width)
    first = differ.argmax(1)
    return np.where(differ[np.arange(len(a)), first], first, width)


class SuffixFamily:
    """A logarithmic family of suffix arrays, over suffixes cut at the length of a match.

    Each level is a suffix array: its entries stand in the order of their bytes, and one entry
    is held for all suffixes that agree in the whole width (``S`` dtype, compared bytewise).
    A new batch gets its suffix array, its neighbours' common prefixes tell which suffixes
    match inside the batch, and a merge-scan against every level tells which match an earlier
    one: only the neighbour at its place in the level can have a common prefix of the whole
    width.  Levels of like size are merged, in one pass over both, so there are only
    logarithmically many.  An entry carries its ``payload`` row along, so nothing outside the
    levels has to be moved when they merge.
    """

    def __init__(self):
        self.levels: list[dict[str, np.ndarray]] = []

    def add(self, suffix: np.ndarray, payload: np.ndarray, settled: np.ndarray | None = None) -> np.ndarray:
        """Takes a batch; returns for each suffix whether it matches one of this or an earlier batch.

        ``settled`` marks suffixes known to match elsewhere, which others may still match.
        """
        width = suffix.dtype.itemsize
        order = np.argsort(suffix, kind="stable")
        ranked = suffix[order]
        fresh = np.ones(len(ranked), bool)
        fresh[1:] = common_prefix(ranked[1:], ranked[:-1]) < width
        group = np.cumsum(fresh) - 1
        twice = np.bincount(group) > 1
        if settled is not None:
            twice |= np.bincount(group, weights=settled[order]) > 0
        first = np.flatnonzero(fresh)
        new = {"suffix": ranked[first], "payload": payload[order[first]], "matched": twice.copy()}
        known = np.zeros(len(first), bool)
        for level in self.levels:
            at = np.minimum(np.searchsorted(level["suffix"], new["suffix"]), len(level["suffix"]) - 1)
            hit = common_prefix(level["suffix"][at], new["suffix"]) >= width
            level["matched"][at[hit]] = True
            known |= hit
        result = np.empty(len(suffix), bool)
        result[order] = (twice | known)[group]
        new["reported"] = twice
        self._push({n: v[~known] for n, v in new.items()})
        return result

    @staticmethod
    def _merged(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Two levels as one: each entry goes to its own place plus the number of the other level's before it."""
        place = np.searchsorted(a["suffix"], b["suffix"]) + np.arange(len(b["suffix"]))
        own = np.ones(len(a["suffix"]) + len(b["suffix"]), bool)
        own[place] = False
        out = {}
        for n in a:
            out[n] = np.empty((len(own), *a[n].shape[1:]), a[n].dtype)
            out[n][own], out[n][place] = a[n], b[n]
        return out

    def _push(self, level: dict[str, np.ndarray]) -> None:
        if not len(level["suffix"]):
            return
        self.levels.append(level)
        while len(self.levels) > 1 and len(self.levels[-2]["suffix"]) <= 2 * len(self.levels[-1]["suffix"]):
            b = self.levels.pop()
            self.levels.append(self._merged(self.levels.pop(), b))

    def entries(self) -> dict[str, np.ndarray] | None:
        """All held entries as one suffix array; None if there are none."""
        while len(self.levels) > 1:
            b = self.levels.pop()
            self.levels.append(self._merged(self.levels.pop(), b))
        return self.levels[0] if self.levels else None


def anchored_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, seed: int = SEED):
    """Runs of window starts with one anchor: (first start, last start, anchor place, name).

    The name has 24 bytes: the anchor's hash, then a 128-bit BLAKE2b digest of the whole stretch
    and of the anchor's place in it.

    Long data is taken in segments of windows; a run that a segment's end cuts in two has
    other stretches than elsewhere and is then left to stage 2.
    """
    n, span = len(data), length - seed + 1
    found = []
    for base in range(0, max(n - length + 1, 0), SEGMENT - length + 1):
        stop = min(n, base + SEGMENT)
        part = data[base:stop]
        m = len(part)
        if m < length:
            break
        hashes = SpanHash(part)
        place = np.arange(m - seed + 1)
        seeds = hashes(place, place + seed)
        low = np.uint64((1 << POSITION_BITS) - 1)
        least, size = (seeds & ~low) | place.astype(np.uint64), 1
        while size * 2 <= span:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < span:
            least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
        anchor = (least & low).astype(np.int64)
        starts = np.arange(len(anchor))
        ends_of = np.repeat(offsets[1:], np.diff(offsets))[base : base + len(starts)]
        at = np.flatnonzero(base + starts + length <= ends_of)
        if not len(at):
            continue
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(anchor[at]) != 0) | (np.diff(at) != 1)
        first, last = at[new], at[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(at) - 1]))]
        place_of = anchor[first]
        raw, digest = part.tobytes(), hashlib.blake2b
        stretch = [digest(raw[x:y], digest_size=16, salt=z.to_bytes(2)).digest() for x, y, z in zip(first.tolist(), (last + length).tolist(), (place_of - first).tolist(), strict=True)]
        name = np.empty((len(first), 24), np.uint8)
        name[:, :8] = seeds[place_of].astype(">u8").view(np.uint8).reshape(-1, 8)
        name[:, 8:] = np.frombuffer(b"".join(stretch), np.uint8).reshape(-1, 16)
        found.append((first + base, last + base, place_of + base, name.view("S24").ravel()))
    if not found:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, "S24"),)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _pack(first: np.ndarray, span: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """A run in one number: first start (46 bits), number of starts (9 bits), anchor's distance from the first start (9 bits)."""
    return (first.astype(np.int64) << 18) | (span.astype(np.int64) << 9) | offset.astype(np.int64)


def _unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return packed >> 18, (packed >> 9) & 511, packed & 511


_RUN = "doc long, th long, kind int, anchor long, packed long"
_DUPLICATE, _EDGE, _WITNESS, _SPAN = 0, 1, 2, 3
_OPEN, _SETTLED = 4, 5


def settle_in_block(name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which runs have an equal within the block, and which of the runs the index still needs: one of each.

    A text of one short period has an anchor in every period, all alike; without this
    they would all meet in one shard.
    """
    order = np.argsort(name, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = name[order[1:]] != name[order[:-1]]
    group = np.cumsum(new) - 1
    repeated, needed = np.empty(len(order), bool), np.zeros(len(order), bool)
    repeated[order] = (np.bincount(group) > 1)[group]
    needed[order[new]] = True
    return repeated, needed


def _names(column: pa.Array) -> np.ndarray:
    column = column.cast(pa.binary(24)) if column.type != pa.binary(24) else column
    return np.frombuffer(column.buffers()[1], "S24")[column.offset : column.offset + len(column)]


def _binary(name: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(24), len(name), [None, pa.py_buffer(np.ascontiguousarray(name))])


def anchor_of(name: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(name).view(np.uint8).reshape(-1, 24)[:, :8].copy().view(">u8").ravel().astype(np.uint64).view(np.int64)


def gathered(batches, rows: int):
    """Arrow batches joined to ones of ``rows`` rows or a little more: fewer levels, fewer scans."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield pa.concat_batches(held)
            held, size = [], 0
    if size:
        yield pa.concat_batches(held)


def _index_runs(batches):
    """Stage 1 in one shard: duplicates of whole runs, and per shared anchor one of each distinct stretch for stage 2."""
    family = SuffixFamily()
    schema = pa.schema([("doc", pa.int64()), ("th", pa.int64()), ("kind", pa.int32()), ("anchor", pa.int64()), ("packed", pa.int64())])

    def out(rows: np.ndarray, anchor: np.ndarray, kind: np.ndarray):
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 0].copy()), pa.array(rows[:, 1].copy()), pa.array(kind.astype(np.int32)), pa.array(anchor), pa.array(rows[:, 2].copy())], schema=schema)

    for batch in gathered(batches, BATCH_ROWS):
        doc, th, packed, kind = (c.to_numpy(zero_copy_only=False) for c in batch.columns[2:])
        stop, name = batch.column(0).to_numpy(zero_copy_only=False), _names(batch.column(1))
        rows = np.stack((doc, th, packed), axis=1)
        span = kind == _SPAN  # its start is in packed, its stop in the place of the anchor
        if span.any():
            yield out(rows[span], stop[span], kind[span])
            name, rows, kind = name[~span], rows[~span], kind[~span]
        matched = family.add(name, rows, kind == _SETTLED) & (kind != _SETTLED)  # the spans of the settled have come already
        yield out(rows[matched], anchor_of(name[matched]), np.full(int(matched.sum()), _DUPLICATE))
    e = family.entries()
    if e is None:
        return
    late, anchor = e["matched"] & ~e["reported"], anchor_of(e["suffix"])
    yield out(e["payload"][late], anchor[late], np.full(int(late.sum()), _DUPLICATE))
    start = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    size = np.diff(np.concatenate((start, [len(anchor)])))
    open_ = np.add.reduceat((~e["matched"]).astype(np.int64), start)
    wanted = np.repeat((size > 1) & (open_ > 0), size)
    yield out(e["payload"][wanted], anchor[wanted], np.where(e["matched"][wanted], _WITNESS, _EDGE))


def whole_anchors(batches, rows: int):
    """Arrow batches, sorted by their first column, joined to ones of at least ``rows`` rows (the last of fewer) that cut no anchor in two."""
    held, size, now = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor = batch.column(0).to_numpy()
        new = np.flatnonzero(np.concatenate(([now is not None and anchor[0] != now], anchor[1:] != anchor[:-1])))
        at, now = 0, anchor[-1]
        while size + batch.num_rows - at >= rows:
            k = np.searchsorted(new, max(at + rows - size, 0))
            if k == len(new):
                break
            stop = int(new[k])
            held.append(batch.slice(at, stop - at))
            yield pa.Table.from_batches(held)
            held, size, at = [], 0, stop
        held.append(batch.slice(at))
        size += batch.num_rows - at
    if size:
        yield pa.Table.from_batches(held)


def matched_windows(data: np.ndarray, offsets: np.ndarray, place: np.ndarray, length: int, at_once: int) -> np.ndarray:
    """Which windows of the stretches of some whole anchors have an equal among them: a row per stretch, a column per window.

    ``place`` is the anchor's in its stretch.  Equal windows have their anchors at equal
    distances, so some distances at a time have a family of their own, and no more than
    ``at_once`` suffixes are written out at a time unless one distance has more; those come
    in batches, and the family holds that one distance.
    """
    counts = np.diff(offsets) - length + 1
    matched = np.zeros((len(counts), int(counts.max()) + 1), bool)
    flat, width = matched.ravel(), matched.shape[1]
    windows = np.lib.stride_tricks.sliding_window_view(data, length)
    lowest, span = int((place - counts).min()) + 1, int(place.max()) + 1
    change = np.bincount(place - counts + 1 - lowest, minlength=span - lowest + 1) - np.bincount(place + 1 - lowest, minlength=span - lowest + 1)
    total = np.concatenate(([0], np.cumsum(np.cumsum(change)[:-1])))  # of the suffixes at smaller distances
    at = 0
    while at < span - lowest:
        to = max(int(np.searchsorted(total, total[at] + at_once, side="right")) - 1, at + 1)
        to = min(to, at + max(4 * at_once // len(counts), 1))
        inner = place[None, :] - np.arange(lowest + at, lowest + to)[:, None]
        own = np.flatnonzero((inner >= 0) & (inner < counts))
        inner, row = inner.ravel()[own], own % len(counts)
        family = SuffixFamily()
        for x in range(0, len(row), at_once):
            r, i = row[x : x + at_once], inner[x : x + at_once]
            name = r * width + i
            hit = family.add(windows[offsets[r] + i].view(f"S{length}").ravel(), name)
            flat[name[hit]] = True
        e = family.entries()
        if e is not None:
            flat[e["payload"][e["matched"]]] = True
        at = to
    return matched


def _index_suffixes(length: int, rows_at_once: int = STRETCHES, at_once: int = SUFFIXES):
    """Stage 2 in one shard, sorted by anchor: the suffixes of edge stretches whose first ``length`` bytes another stretch has too.

    Only stretches of one anchor can share them, so the index holds a few whole anchors at a
    time, and never grows with the shard.
    """
    schema = pa.schema([("doc", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])

    def run(batches):
        for part in whole_anchors(batches, rows_at_once):
            doc, th, kind, first, place = (part.column(i).to_numpy() for i in range(1, 6))
            column = pa.concat_arrays([c.cast(pa.large_binary()) for c in part.column(6).chunks])
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            matched = matched_windows(data, offsets - offsets[0], place, length, at_once)
            matched[kind != _EDGE] = False  # a witness is not reported
            # Maximal runs per stretch; the last column is empty.
            change = np.flatnonzero(np.diff(matched.ravel(), prepend=False))
            row, start = np.divmod(change[::2], matched.shape[1])
            stop = change[1::2] - row * matched.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(th[row]), pa.array(first[row] + start), pa.array(first[row] + stop - 1 + length)], schema=schema)

    return run


def covered_spans(starts: np.ndarray, stops: np.ndarray, borders: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the bytes that the given spans cover; touching spans are one run, except at ``borders``."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    if borders is not None:
        new[1:] |= (starts[1:] == reach[:-1]) & np.isin(starts[1:], borders)
    head = np.flatnonzero(new)
    return starts[head], reach[np.concatenate((head, [len(starts)]))[1:] - 1]


def repeated_spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(doc, th, spans) of ``docs`` (doc, th, text): the stretches made of windows that start elsewhere too."""
    runs_schema = T.StructType([T.StructField(c, T.BinaryType() if c == "name" else T.LongType()) for c in ("anchor", "name", "doc", "th", "packed", "kind")])

    def runs(batches):
        for block in blocks(batches, "text", SEGMENT):
            first, last, place, name = anchored_runs(block.data, block.offsets, length, seed)
            if not len(first):
                continue
            row = block.row_of(first)
            ids, th = (block.rows.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            packed = _pack(first - block.offsets[row], last - first + 1, place - first)
            repeated, needed = settle_in_block(name)
            own = row[needed]
            yield arrow_batch(runs_schema, [anchor_of(name[needed]), _binary(name[needed]), ids[own], th[own], packed[needed], np.where(repeated[needed], _SETTLED, _OPEN)])
            if repeated.any():
                # No span reaches over a text's end, so all texts of the block can be covered at once.
                start, stop = covered_spans(first[repeated], last[repeated] + length, block.offsets)
                own = block.row_of(start)
                start, stop = start - block.offsets[own], stop - block.offsets[own]
                yield arrow_batch(runs_schema, [stop, _binary(np.zeros(len(own), "S24")), ids[own], th[own], start, np.full(len(own), _SPAN)])

    indexed = docs.select("doc", "th", "text").mapInArrow(runs, runs_schema).repartition(F.when(F.col("kind") == _SPAN, F.xxhash64("doc", "packed")).otherwise(F.col("anchor"))).mapInArrow(_index_runs, _RUN)
    indexed = checkpointed(indexed)
    # Stage 2: the bytes of the edges, cut from their documents.
    edges = indexed.filter(F.col("kind").isin(_EDGE, _WITNESS)).groupBy("doc", "th").agg(F.collect_list(F.struct("kind", "anchor", "packed")).alias("edges"))
    stretch_schema = T.StructType([T.StructField("doc", T.LongType()), T.StructField("th", T.LongType()), T.StructField("kind", T.LongType()), T.StructField("first", T.LongType()), T.StructField("place", T.LongType()), T.StructField("data", T.BinaryType()), T.StructField("anchor", T.LongType())])

    def cut(batches):
        for block in blocks(batches, "text"):
            out = [[] for _ in range(7)]
            for i in range(block.n):
                text = block.text_bytes(i)
                for e in block.rows.column(3)[i].as_py():
                    first, n, place = (int(x) for x in _unpack(np.int64(e["packed"])))
                    for column, value in zip(out, (block.rows.column(0)[i].as_py(), block.rows.column(1)[i].as_py(), e["kind"], first, place, text[first : first + n - 1 + length], e["anchor"]), strict=True):
                        column.append(value)
            yield arrow_batch(stretch_schema, out)

    pieces = docs.join(edges, ["doc", "th"]).select("doc", "th", "text", "edges").mapInArrow(cut, stretch_schema)
    windows = pieces.repartition("anchor").sortWithinPartitions("anchor").select("anchor", "doc", "th", "kind", "first", "place", "data").mapInArrow(_index_suffixes(length), "doc long, th long, start long, stop long")
    whole = indexed.filter(F.col("kind") == _DUPLICATE).select("doc", "th", F.shiftright("packed", 18).alias("start"), (F.shiftright("packed", 18) + F.shiftright("packed", 9).bitwiseAND(F.lit(511)) - 1 + length).alias("stop"))
    settled = indexed.filter(F.col("kind") == _SPAN).select("doc", "th", F.col("packed").alias("start"), F.col("anchor").alias("stop"))
    return whole.unionByName(settled).unionByName(windows).groupBy("doc", "th").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED, with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, binary, on request).

    Bytes covered by a ``length``-byte string that also starts anywhere else are removed,
    all copies alike and judged on the input; matches never cross documents.  A null text
    is empty, and a text shorter than ``length`` stays whole.  Repeated rows hold the same
    strings elsewhere and so lose them.  Null ids are one id among others.  The id must be
    an integer; other columns are not read.  A very long text is indexed whole, in segments of
    1 MB.  An empty table gives an empty result.

    What is kept may cut a UTF-8 sequence and is therefore bytes.
    """
    if not 16 <= seed < length <= 511:
        raise ValueError("seed and length are out of range")
    id_type = docs.schema[id_col].dataType
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # ``th`` names a row together with its id; its last bit says that the id is null.
    th = F.xxhash64(text).bitwiseAND(F.lit(-2)).bitwiseOR(F.col(id_col).isNull().cast("long"))
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("doc"), th.alias("th"), text.alias("text")).repartition("doc", "th")
    spans = repeated_spans(keyed, length, seed)
    schema = T.StructType([T.StructField("doc", T.LongType()), T.StructField("th", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())] + [T.StructField("kept", T.BinaryType())] * with_text)

    def finish(batches):
        for block in blocks(batches, "text"):
            lists = block.rows.column(3)
            removed, runs, digest, kept = [], [], [], []
            for i in range(block.n):
                raw, own = block.text_bytes(i), lists[i]
                start = stop = np.zeros(0, np.int64)
                if own.is_valid:
                    values = own.values
                    start, stop = covered_spans(values.field("start").to_numpy(zero_copy_only=False), values.field("stop").to_numpy(zero_copy_only=False))
                at, rest = 0, []
                for a, b in zip(start.tolist(), stop.tolist(), strict=True):
                    rest.append(raw[at:a])
                    at = b
                rest.append(raw[at:])
                left = b"".join(rest)
                removed.append(len(raw) - len(left))
                runs.append(len(start))
                digest.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            yield arrow_batch(schema, [block.rows.column(0), block.rows.column(1), block.lengths, removed, runs, digest] + [kept] * with_text)

    out = keyed.join(spans, ["doc", "th"], "left").select("doc", "th", "text", "spans").mapInArrow(finish, schema)
    return out.select(F.when(F.col("th").bitwiseAND(F.lit(1)) == 0, F.col("doc")).cast(id_type).alias("doc_id"), *out.columns[2:])

"""Scoring with a hashed maximum-entropy language model and a class-factored softmax.

P(word | history) = P(class | history) * P(word | class, history).  Words fall into classes:
the end of a text and the most frequent words have one each, all others, known or not, fall
by their letters into clusters of hashed character n-grams learnt from the frequent words.

The class factor is a softmax over features of the history: the word before (frequent words
by themselves, others by class), the class before that (a skip feature) and both together,
hashed.  Its gradient needs the corpus only through the counts of (history, class), so
executors hold that table, and each round sends them weights and sums their gradients.

The word factor is a softmax over the words of a class.  Its features are the n-gram (word
before, word), whatever the word before, and the skip feature (class before that, word
before, word), hashed; there is one for each that training shows often enough, so their
table grows with the corpus and stays distributed.  A feature only touches words after one
word before, and in one class: such a group is trained in one place, by gradient updates over
all groups of a shard at once, and is normalised exactly (a word without a feature keeps its
share of the class).

Texts are scored in blocks of numpy arrays.  What a block needs from the distributed tables
travels as packed arrays to the shards that hold them, and sums per text come back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_text import Block, blocks, encode_spans, mix64, word_spans, xxh64
from .shared import arrow_batch, checkpointed
from .simhash_dedup import lower_ascii

CLASSES, SINGLE, OWN_WORDS, HEAD_WORDS, CLUSTER_WORDS = 64, 24, 255, 1 << 19, 16_000
HASHED, DIM, ROUNDS, PARTS = 1 << 12, 64, 12, 12
END = np.uint64(0x00E7D)  # the end of a text, as a token
BOS = CLASSES
#: Times a word n-gram and a skip n-gram must occur in training to be a feature; the prior's precision; its rounds.
NGRAM_FROM, SKIP_FROM, PRIOR, WORD_ROUNDS = 2, 3, 1.0, 12
SHARD_TOKENS, CHUNK_TOKENS, CACHED_WORDS = 2_000_000, 700_000, 700_000
GROUP_BITS = 48
BLOCK = 1 << 21
NO_WORD = (1 << 20) - 1  # in place of the index of a word that is not among the frequent ones


@dataclass
class Tokens:
    """The tokens of a block: each one's row and the index of its word; index 0 is the end of a text."""

    hashes: np.ndarray
    words: pa.Array
    which: np.ndarray
    rows: np.ndarray


def tokens(block: Block) -> Tokens:
    """A text's words with A-Z as a-z, then its end.  Words are told apart by their bytes and named by XXH64."""
    starts, ends, rows = word_spans(block)
    codes, words = encode_spans(lower_ascii(block.data), starts, ends)
    at = np.searchsorted(rows, np.arange(block.n), side="right")
    return Tokens(np.concatenate(([END], xxh64(words, 1))), words, np.insert(codes + 1, at, 0), np.insert(rows, at, np.arange(block.n)))


def letter_vectors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unit vectors of hashed, signed byte 1- to 3-grams of words, their edges marked."""
    size = ends - starts + 2
    row = np.repeat(np.arange(len(starts)), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    edge = (place == 0) | (place == size[row] - 1)
    byte = np.where(edge, 0, data[np.clip(starts[row] + place - 1, 0, max(len(data) - 1, 0))]).astype(np.uint64) if len(row) else np.zeros(0, np.uint64)
    out, gram = np.zeros(len(starts) * DIM), np.zeros(len(row), np.uint64)
    for order in (1, 2, 3):
        m = len(row) - order + 1
        if m <= 0:
            break
        gram = (gram[:m] << np.uint64(8)) | byte[order - 1 :]
        inside = row[:m] == row[order - 1 :]
        h = mix64(gram[inside] + np.uint64(order << 40))
        out += np.bincount(row[:m][inside] * DIM + (h % np.uint64(DIM)).astype(np.int64), weights=1.0 - 2.0 * (h >> np.uint64(63)).astype(np.float64), minlength=len(out))
    out = out.reshape(-1, DIM).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)


def cluster(x: np.ndarray, weight: np.ndarray, k: int, rounds: int = 10, seed: int = 9) -> np.ndarray:
    """Weighted spherical k-means; centres are unit vectors."""
    rng = np.random.default_rng(seed)
    if not len(x):
        return rng.normal(size=(k, DIM)).astype(np.float32)
    centres = x[rng.choice(len(x), k, replace=len(x) < k, p=weight / weight.sum())]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        sums = np.stack([np.bincount(own, weights=weight * x[:, d], minlength=k) for d in range(x.shape[1])], axis=1)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), centres).astype(np.float32)
    return centres


@dataclass
class Vocabulary:
    """What every task needs to know about words; its size is bounded by the parameters."""

    head: np.ndarray  # sorted hashes of the frequent words
    head_counts: np.ndarray
    single: np.ndarray  # sorted hashes of the words with a class of their own
    single_class: np.ndarray
    own: np.ndarray  # sorted hashes of the words that are features by themselves
    own_bucket: np.ndarray
    centres: np.ndarray
    rank: np.ndarray  # of each frequent word by its count
    seen: list = field(default_factory=lambda: [np.zeros(0, np.uint64), np.zeros(0, np.int64)], repr=False)

    def classes(self, found: Tokens) -> np.ndarray:
        """The class of each distinct word; those of words met before are kept, up to a bound."""
        out = np.zeros(len(found.hashes), np.int64)
        at, known = lookup(self.seen[0], found.hashes)
        out[known] = self.seen[1][at[known]]
        new = np.flatnonzero(~known[1:])
        if len(new):
            offsets = np.frombuffer(found.words.buffers()[1], np.int64)[found.words.offset :]
            data = np.frombuffer(found.words.buffers()[2], np.uint8)
            for a in range(0, len(new), 16384):
                own = new[a : a + 16384]
                out[own + 1] = SINGLE + (letter_vectors(data, offsets[own], offsets[own + 1]) @ self.centres.T).argmax(1)
            if len(self.seen[0]) + len(new) > CACHED_WORDS:
                self.seen = [np.zeros(0, np.uint64), np.zeros(0, np.int64)]
            h, k = np.concatenate((self.seen[0], found.hashes[new + 1])), np.concatenate((self.seen[1], out[new + 1]))
            order = np.argsort(h)
            self.seen = [h[order], k[order]]
        at, known = lookup(self.single, found.hashes)
        out[known] = self.single_class[at[known]]
        return out

    def history(self, hashes: np.ndarray, word_class: np.ndarray) -> np.ndarray:
        at, known = lookup(self.own, hashes)
        return np.where(known, self.own_bucket[at], word_class) if len(self.own) else word_class


def lookup(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, wanted), max(len(table) - 1, 0))
    return at, (table[at] == wanted) if len(table) else np.zeros(len(wanted), bool)


BUCKETS = CLASSES + 1 + OWN_WORDS  # of the word before: its class, the beginning, or a frequent word itself
CONTEXTS = BUCKETS * (CLASSES + 1)


@dataclass
class Events:
    """What the model sees of each token of a block."""

    found: Tokens
    context: np.ndarray  # of the class factor
    target: np.ndarray
    kinds: np.ndarray  # class of each distinct word
    head: np.ndarray  # index of each distinct word among the frequent ones, NO_WORD if it is none
    group: np.ndarray  # of the word factor: (word before, class), hashed
    code: np.ndarray  # of the word factor: the word's rank and the class before the word before


def events(block: Block, vocabulary: Vocabulary) -> Events:
    found = tokens(block)
    which, rows = found.which, found.rows
    kinds = vocabulary.classes(found)
    bucket = vocabulary.history(found.hashes, kinds)
    at, known = lookup(vocabulary.head, found.hashes)
    head = np.where(known, at, NO_WORD)
    target = kinds[which]
    one, two, before = np.full(len(rows), BOS), np.full(len(rows), BOS), np.zeros(len(rows), np.uint64)
    same1 = rows[1:] == rows[:-1]
    one[1:] = np.where(same1, bucket[which[:-1]], BOS)
    before[1:] = np.where(same1, found.hashes[which[:-1]], np.uint64(0))
    same2 = rows[2:] == rows[:-2]
    two[2:] = np.where(same2, target[:-2], BOS)
    group = mix64(before ^ mix64(target.astype(np.uint64) + np.uint64(1))) >> np.uint64(64 - GROUP_BITS)
    rank = np.full(len(head), NO_WORD)
    rank[known] = vocabulary.rank[at[known]]
    return Events(found, one * (CLASSES + 1) + two, target, kinds, head, group, (rank[which] << 7 | two).astype(np.uint32))


def features_of(context: np.ndarray) -> np.ndarray:
    """The rows of the weight table that a context switches on: bias, word before, skip, both (hashed)."""
    one, two = context // (CLASSES + 1), context % (CLASSES + 1)
    both = (mix64(context.astype(np.uint64) + np.uint64(1)) % np.uint64(HASHED)).astype(np.int64)
    base = 1 + BUCKETS + CLASSES + 1
    return np.stack((np.zeros_like(context), 1 + one, 1 + BUCKETS + two, base + both), axis=1)


ROWS = 1 + BUCKETS + CLASSES + 1 + HASHED


def log_softmax(weights: np.ndarray, context: np.ndarray) -> np.ndarray:
    f = features_of(context)
    z = weights[f[:, 0]] + weights[f[:, 1]] + weights[f[:, 2]] + weights[f[:, 3]]
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


# ---------------------------------------------------------------- packed arrays


def planes(a: np.ndarray) -> np.ndarray:
    """The bytes of an array: all first ones, then all second ones, which compresses well."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.ravel()


def from_planes(raw: np.ndarray, dtype) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes."""
    return np.array([len(a) for a in arrays], np.int64).tobytes() + zstandard.ZstdCompressor(level=1).compress(b"".join(planes(a).tobytes() for a in arrays))


def unpack(blob: bytes, *dtypes) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(blob, np.int64, len(dtypes)), 0, []
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8 * len(dtypes) :]), np.uint8)
    for n, d in zip(sizes.tolist(), dtypes, strict=True):
        width = n * np.dtype(d).itemsize
        out.append(from_planes(raw[at : at + width], d) if n else np.zeros(0, d))
        at += width
    return out


def pack_sorted(a: np.ndarray) -> np.ndarray:
    """Sorted numbers below 2**63 as bytes: their differences, in as many bytes each as the largest takes."""
    steps = np.diff(a, prepend=np.uint64(0))
    width = max(1, -(-int(steps[1:].max(initial=0)).bit_length() // 8))
    return np.concatenate((steps[:1].view(np.uint8), np.uint8([width]), steps[1:].view(np.uint8).reshape(-1, 8)[:, :width].ravel())) if len(a) else np.zeros(0, np.uint8)


def unpack_sorted(b: np.ndarray) -> np.ndarray:
    if not len(b):
        return np.zeros(0, np.uint64)
    width = int(b[8])
    steps = np.zeros(((len(b) - 9) // width + 1, 8), np.uint8)
    steps[0], steps[1:, :width] = b[:8], b[9:].reshape(-1, width)
    return np.cumsum(steps.view(np.uint64).ravel())


_FIRST, _MANY = np.uint32(1 << 31), np.uint32(1 << 30)  # marks in a code: the first of its group, more than one token


def pack_ngrams(group: np.ndarray, kind: np.ndarray, code: np.ndarray, n: np.ndarray) -> bytes:
    first = runs(group)
    marked = np.where(n > 1, code | _MANY, code)
    marked[first] |= _FIRST
    return pack(pack_sorted(group[first]), kind[first], marked, n[n > 1].astype(np.uint32))


def unpack_ngrams(blob: bytes) -> tuple[np.ndarray, ...]:
    group, kind, code, more = unpack(blob, np.uint8, np.uint8, np.uint32, np.uint32)
    own = np.cumsum(code >= _FIRST) - 1
    n = np.ones(len(code), np.int64)
    n[(code & _MANY) > 0] = more
    return unpack_sorted(group)[own], kind[own], code & (_MANY - np.uint32(1)), n


def shard_cuts(sorted_hashes: np.ndarray, shards: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Shards of some sorted hashes, and where each begins; with the end as the last cut.  Shards are ranges of hashes."""
    own = ((sorted_hashes >> np.uint64(bits - 32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
    return own[first], np.append(first, len(own))


def runs(a: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, np.int64)


# ---------------------------------------------------------------- counting


def count_words(docs: DataFrame) -> DataFrame:
    """(hash, n) over all ``docs``."""
    schema = T.StructType([T.StructField("hash", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged():
            h, which = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
            return arrow_batch(schema, [h.view(np.int64), np.bincount(which, weights=np.concatenate([x[1] for x in held])).astype(np.int64)])

        for block in blocks(batches, "text", BLOCK):
            found = tokens(block)
            held.append((found.hashes, np.bincount(found.which, minlength=len(found.hashes))))
            size += len(found.hashes)
            if size > CHUNK_TOKENS:
                yield merged()
                held, size = [], 0
        if held:
            yield merged()

    return docs.select("text").mapInArrow(run, schema).groupBy("hash").agg(F.sum("n").alias("n")).filter("n > 0")


def spell(docs: DataFrame, wanted: np.ndarray) -> dict[int, bytes]:
    """The words that a bounded, sorted set of hashes stands for, found in a pass over all ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    schema = T.StructType([T.StructField("hash", T.LongType()), T.StructField("word", T.BinaryType())])

    def run(batches):
        missing = np.ones(len(shared.value), bool)
        for block in blocks(batches, "text", BLOCK):
            if not missing.any():
                continue
            found = tokens(block)
            at, known = lookup(shared.value, found.hashes)
            new = np.flatnonzero(known & missing[at])
            new = new[new > 0]
            missing[at[new]] = False
            yield arrow_batch(schema, [found.hashes[new].view(np.int64), found.words.take(pa.array(new - 1))])

    told = docs.select("text").mapInArrow(run, schema).groupBy("hash").agg(F.min("word").alias("word"))
    return {int(np.int64(r[0]).view(np.uint64)): bytes(r[1]) for r in told.collect()}


def build_vocabulary(counts: DataFrame, docs: DataFrame, head_words: int = HEAD_WORDS, cluster_words: int = CLUSTER_WORDS) -> tuple[Vocabulary, int]:
    """The vocabulary and the least count of its head; cut on a scale of counts, so that at most ``head_words`` words are gathered.

    Which words are frequent is settled by their exact counts over the corpus, and only then
    are they spelt; the layout of the input has no part in it.
    """
    scale = F.floor(F.log2("n") * 64)
    bins = counts.groupBy(scale.alias("bin")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).orderBy(F.desc("bin")).collect()

    def least_count(limit: int) -> int:
        total, least = 0, 1 << 62
        for b in bins:
            total += b.words
            if total > limit:
                break
            least = b.least
        return least

    floor = least_count(min(head_words, NO_WORD))
    head = counts.filter(F.col("n") >= floor).select("hash", "n").toArrow()
    hashes, n = head.column(0).to_numpy().view(np.uint64), head.column(1).to_numpy()
    order = np.argsort(hashes)
    hashes, n = hashes[order], n[order]
    often = np.flatnonzero((n >= least_count(cluster_words)) & (hashes != END))
    spelt = spell(docs, hashes[often]) if len(often) else {}
    words = sorted(((int(n[i]), int(hashes[i])) for i in often), key=lambda w: (-w[0], w[1]))
    top = np.array([w[1] for w in words[: max(SINGLE - 1, OWN_WORDS)]], np.uint64)
    single = np.concatenate(([END], top[: SINGLE - 1]))
    s_order = np.argsort(single)
    own = top[:OWN_WORDS]
    o_order = np.argsort(own)
    rest = words[SINGLE - 1 :]
    data = np.frombuffer(b"".join(spelt[w[1]] for w in rest), np.uint8)
    size = np.array([len(spelt[w[1]]) for w in rest], np.int64)
    stop = np.cumsum(size)
    centres = cluster(letter_vectors(data, stop - size, stop), np.sqrt(np.array([w[0] for w in rest], np.float64)), CLASSES - SINGLE)
    return Vocabulary(hashes, n, single[s_order], np.arange(len(single))[s_order], own[o_order], (CLASSES + 1 + np.arange(len(own)))[o_order], centres, np.argsort(np.lexsort((hashes, -n)))), floor


_PACKED = T.StructType([T.StructField("key", T.LongType()), T.StructField("blob", T.BinaryType())])


def count_events(docs: DataFrame, vocabulary, shards: int) -> DataFrame:
    """(key, blob) of the training counts, once per key: shards of the word factor (key >= 0) and parts of the class factor (key < 0)."""

    def run(batches):
        cells = np.zeros(CONTEXTS * CLASSES, np.int32)
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def ngrams():
            group, code, kind = (np.concatenate([x[i] for x in held]) for i in range(3))
            order = np.lexsort((code, group))
            group, code, kind = group[order], code[order], kind[order]
            new = np.ones(len(group), bool)
            new[1:] = (group[1:] != group[:-1]) | (code[1:] != code[:-1])
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(group)))
            group, code, kind = group[first], code[first], kind[first]
            own, cuts = shard_cuts(group, shards, GROUP_BITS)
            return arrow_batch(_PACKED, [own, [pack_ngrams(group[a:b], kind[a:b], code[a:b], n[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]])

        for block in blocks(batches, "text", BLOCK):
            e = events(block, vocabulary.value)
            cells += np.bincount(e.context * CLASSES + e.target, minlength=len(cells)).astype(np.int32)
            inside = e.target >= SINGLE
            held.append((e.group[inside], e.code[inside], e.target[inside].astype(np.uint8)))
            size += int(inside.sum())
            if size > CHUNK_TOKENS:
                yield ngrams()
                held, size = [], 0
        if size:
            yield ngrams()
        at = np.flatnonzero(cells)
        part = at // CLASSES % PARTS
        yield arrow_batch(_PACKED, [-1 - np.arange(PARTS), [pack(at[part == k].astype(np.uint32), cells[at[part == k]].astype(np.uint32)) for k in range(PARTS)]])

    return docs.select("text").mapInArrow(run, _PACKED).repartition("key").sortWithinPartitions("key").mapInArrow(_combined, _PACKED)


def _by_key(batches) -> Iterator[tuple[int, list[bytes]]]:
    """The blobs of each key, from rows sorted by key."""
    now, held = None, []
    for batch in batches:
        for key, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != now and held:
                yield now, held
                held = []
            now = key
            held.append(blob)
    if held:
        yield now, held


_GROUPS = (np.uint64, np.uint8, np.uint32, np.uint8, np.int64, np.uint32, np.uint32, np.int64, np.uint32, np.uint32, np.int64)


def _combined(batches):
    for key, blobs in _by_key(batches):
        if key < 0:
            at, n = (np.concatenate(x) for x in zip(*(unpack(b, np.uint32, np.uint32) for b in blobs), strict=True))
            cell, which = np.unique(at, return_inverse=True)
            yield arrow_batch(_PACKED, [[key], [pack(cell.astype(np.int64), np.bincount(which, weights=n).astype(np.int64))]])
        else:
            yield arrow_batch(_PACKED, [[key], [pack(*group_counts([unpack_ngrams(b) for b in blobs]))]])


def group_counts(parts: list) -> list[np.ndarray]:
    """The groups of a shard that have a feature: their contexts with all their tokens, and the features with theirs.

    (group hash, its class; context's group, class before, tokens; n-gram's group, word, tokens;
    skip feature's n-gram, context, tokens).  Rarer n-grams only count as tokens of their context.
    """
    group, kind, code, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((code, group))
    group, kind, code, n = group[order], kind[order], code[order], n[order]
    new = np.ones(len(group), bool)
    new[1:] = (group[1:] != group[:-1]) | (code[1:] != code[:-1])
    first = np.flatnonzero(new)
    group, kind, code, n = group[first], kind[first], code[first], np.add.reduceat(n, first)
    word, before = code >> 7, code & 127
    pair = np.ones(len(group), bool)
    pair[1:] = (group[1:] != group[:-1]) | (word[1:] != word[:-1])
    gram = np.cumsum(pair) - 1
    total = np.bincount(gram, weights=n).astype(np.int64)
    at = np.flatnonzero(pair)
    use = (total >= NGRAM_FROM) & (word[at] != NO_WORD)
    g_new = runs(group)
    g_of = np.repeat(np.arange(len(g_new)), np.diff(np.append(g_new, len(group))))
    has = np.bincount(g_of[at], weights=use, minlength=len(g_new)) > 0
    g_index = np.cumsum(has) - 1
    keep = has[g_of]
    context, which = np.unique(g_index[g_of[keep]] * 128 + before[keep], return_inverse=True)
    tokens_of = np.bincount(which, weights=n[keep], minlength=len(context)).astype(np.int64)
    gram_index = np.cumsum(use) - 1
    skip = keep & use[gram] & (n >= SKIP_FROM)
    of_context = np.zeros(len(group), np.int64)
    of_context[keep] = which
    u32 = lambda x: x.astype(np.uint32)
    return [group[g_new][has], kind[g_new][has], u32(context >> 7), (context & 127).astype(np.uint8), tokens_of, u32(g_index[g_of[at[use]]]), u32(word[at[use]]), total[use], u32(gram_index[gram[skip]]), u32(of_context[skip]), n[skip]]


# ---------------------------------------------------------------- the class factor


def fit_classes(cells: DataFrame, class_counts: np.ndarray, rounds: int = ROUNDS, decay: float = 0.5) -> np.ndarray:
    """Weights by rounds of distributed gradient steps over the parts of the table of (context, class, n).

    In a round each part returns, for the rows of the weight table that its histories use,
    the gradient and a bound of its curvature; the driver adds them up in a fixed order and
    takes one damped step.  What it receives is bounded by the table and the number of
    parts, not by the corpus.
    """
    spark = cells.sparkSession
    weights = np.zeros((ROWS, CLASSES), np.float32)
    weights[0] = np.log((class_counts + 0.5) / (class_counts.sum() + 0.5 * CLASSES))
    schema = T.StructType([T.StructField("order", T.LongType()), T.StructField("rows", T.BinaryType()), T.StructField("gradient", T.BinaryType()), T.StructField("expected", T.BinaryType())])
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(weights)

        def part(batches, shared=shared):
            for key, blobs in _by_key(batches):
                cell, n = unpack(blobs[0], np.int64, np.int64)
                distinct, which = np.unique(cell // CLASSES, return_inverse=True)
                seen = np.zeros((len(distinct), CLASSES))
                np.add.at(seen, (which, cell % CLASSES), n)
                expected = np.exp(log_softmax(shared.value, distinct)) * seen.sum(1, keepdims=True)
                f = features_of(distinct)
                gradient, bound = np.zeros((ROWS, CLASSES)), np.zeros((ROWS, CLASSES))
                for j in range(f.shape[1]):
                    np.add.at(gradient, f[:, j], seen - expected)
                    np.add.at(bound, f[:, j], expected)
                used = np.unique(f)
                yield arrow_batch(schema, [[key], [used.tobytes()], [gradient[used].astype(np.float32).tobytes()], [bound[used].astype(np.float32).tobytes()]])

        total = [np.zeros((ROWS, CLASSES)), np.zeros((ROWS, CLASSES))]
        for r in sorted(cells.mapInArrow(part, schema).collect(), key=lambda r: r.order):
            used = np.frombuffer(r.rows, np.int64)
            for t, x in zip(total, (r.gradient, r.expected), strict=True):
                t[used] += np.frombuffer(x, np.float32).reshape(-1, CLASSES)
        gradient, bound = total[0] - decay * weights, total[1]
        weights = weights + np.clip(gradient / (2.0 * bound + np.abs(total[0]) * 0.5 + decay + 1e-9), -1.0, 1.0).astype(np.float32)
        shared.destroy()
    return weights


# ---------------------------------------------------------------- the word factor


def fit_words(counts: list[np.ndarray], share, rounds: int = WORD_ROUNDS, prior: float = PRIOR) -> list[np.ndarray]:
    """The table of a shard: (group, log of its normaliser; context key, log of its; n-gram key, weight; skip key, weight).

    ``share(word, class)`` is a word's share of its class.  Gradient ascent with a normal prior:
    the curvature of a softmax is at most its expected counts, and two features can be on at
    once, so half a Newton step by that bound never overshoots.
    """
    group, kind, c_group, c_before, c_n, b_group, b_word, b_n, t_gram, t_context, t_n = (x.astype(np.int64) if x.dtype != np.uint64 else x for x in counts)
    p0 = share(b_word, kind[b_group])
    wb, wt = np.zeros(len(b_word)), np.zeros(len(t_gram))
    for step in range(rounds + 1):
        base, more = p0 * np.exp(wb), np.expm1(wt)
        plain = 1.0 + np.bincount(b_group, weights=base - p0, minlength=len(group))
        z = plain[c_group] + np.bincount(t_context, weights=base[t_gram] * more, minlength=len(c_group))
        if step == rounds:
            break
        rate = c_n / z
        skipped = rate[t_context] * base[t_gram]
        expect_b = base * np.bincount(c_group, weights=rate, minlength=len(group))[b_group] + np.bincount(t_gram, weights=skipped * more, minlength=len(b_word))
        expect_t = skipped * (more + 1.0)
        wb = wb + np.clip(0.5 * (b_n - expect_b - prior * wb) / (expect_b + prior), -1.0, 1.0)
        wt = wt + np.clip(0.5 * (t_n - expect_t - prior * wt) / (expect_t + prior), -1.0, 1.0)
    b_key, t_key = b_group << 20 | b_word, (b_group << 27 | b_word << 7)[t_gram] | c_before[t_context]
    order = np.argsort(t_key)
    return [group, np.log10(plain), c_group << 7 | c_before, np.log10(z), b_key, wb / np.log(10), t_key[order], wt[order] / np.log(10)]


_TABLE = (np.uint64, np.float64, np.int64, np.float64, np.int64, np.float64, np.int64, np.float64)


def word_factor(table: list[np.ndarray], group: np.ndarray, code: np.ndarray) -> np.ndarray:
    """log10 of what the history multiplies a word's share of its class by."""
    groups, plain, c_key, z, b_key, wb, t_key, wt = table
    out = np.zeros(len(group))
    g, known = lookup(groups, group)
    at = np.flatnonzero(known)
    g, word, before = g[at], (code[at] >> 7).astype(np.int64), (code[at] & 127).astype(np.int64)
    value = -plain[g]
    for key, weight, wanted, minus in ((c_key, z, g << 7 | before, plain[g]), (b_key, wb, g << 20 | word, None), (t_key, wt, g << 27 | word << 7 | before, None)):
        i, hit = lookup(key, wanted)
        if minus is not None:
            value[hit] = -weight[i[hit]]
        else:
            value[hit] += weight[i[hit]]
    out[at] = value
    return out


# ---------------------------------------------------------------- scoring

_NGRAM_TABLE, _WORD_TABLE, _NGRAM_ASK, _WORD_ASK, _OWN, _PART = range(6)


def score_texts(docs: DataFrame, *, training, id_col: str = "doc_id", text_col: str = "text", head_words: int = HEAD_WORDS, rounds: int = ROUNDS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    ``training`` is the condition for a row to be learnt from (null: it is not).  A null or
    blank text has one token, its end.  Repeated rows are scored alike and stay; a null id
    stays null.  A text longer than a block of 2 MB is a block of its own.  Words of one count
    are ordered by their hash.  Without training rows every token is unknown; an empty table
    gives an empty result.  Other columns of ``docs``, whatever their names, are not read but
    by ``training``.

    ``score`` is a log10 probability over the words seen in training and, per cluster, one
    unknown word, whose share is that of the words seen once (Good and Turing); both factors
    sum to one.  ``base_score`` is the smoothed unigram model.  What is learnt does not depend
    on how the rows are laid out in files and tasks.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(training, F.lit(False)).alias("train"))
    learn = source.filter("train").select("text")
    counts = checkpointed(count_words(learn))
    size = counts.agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n"), F.sum((F.col("n") == 1).cast("long")).alias("once")).first()
    n_types, n_tokens, once = int(size.v), int(size.n or 0), int(size.once or 0)
    vocabulary, floor = build_vocabulary(counts, learn, head_words)
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(vocabulary)
    shards = max(16, -(-n_tokens // shard_tokens))
    learnt = checkpointed(count_events(learn, shared, shards))
    cells = learnt.filter("key < 0").repartition(PARTS, "key").sortWithinPartitions("key")
    class_counts = np.zeros(CLASSES)

    def by_class(batches):
        for key, blobs in _by_key(batches):
            cell, n = unpack(blobs[0], np.int64, np.int64)
            yield arrow_batch(_PACKED, [[key], [np.bincount(cell % CLASSES, weights=n, minlength=CLASSES).tobytes()]])

    for r in cells.mapInArrow(by_class, _PACKED).collect():
        class_counts += np.frombuffer(r.blob)
    weights = fit_classes(cells, class_counts, rounds)
    table = np.concatenate([log_softmax(weights, np.arange(a, min(a + 8192, CONTEXTS))) for a in range(0, CONTEXTS, 8192)]).astype(np.float32) / np.float32(np.log(10))
    unknown = min((once + 0.5) / (class_counts[SINGLE:].sum() + 1.0), 0.999)
    clustered = np.arange(CLASSES) >= SINGLE
    log_class = np.log10(np.maximum(class_counts, 0.5))
    log_known, log_unknown = np.where(clustered, np.log10(1 - unknown), 0.0), np.where(clustered, np.log10(unknown), 0.0)
    norm = float(np.log10(n_tokens + 0.5 * (n_types + 1)))
    model = sc.broadcast((table, log_class, log_known, log_unknown))
    id_type = source.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("blob", T.BinaryType())])

    def rows_of(found):
        """Rows of (key, kind, block, blob) without ids."""
        key, kind, block, blob = zip(*found, strict=True) if found else ((),) * 4
        return arrow_batch(schema, [list(key), list(kind), list(block), pa.nulls(len(key), pa.list_(pa.null())), list(blob)])

    def ngram_tables(batches):
        v, (_, of_class, share, _) = shared.value, model.value
        by_rank = -np.sort(-v.head_counts)
        p0 = lambda word, kind: by_rank[word] * 10.0 ** (share[kind] - of_class[kind])
        for key, blobs in _by_key(batches):
            yield rows_of([(key, _NGRAM_TABLE, 0, pack(*fit_words(unpack(blobs[0], *_GROUPS), p0)))])

    def word_tables(batches):
        for batch in batches:
            h, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            order = np.argsort(h)
            h, n = h[order], n[order]
            own, cuts = shard_cuts(h, shards)
            yield rows_of([(int(k), _WORD_TABLE, 0, pack(h[a:b], n[a:b])) for k, a, b in zip(own, cuts[:-1], cuts[1:], strict=True)])

    def ask(batches):
        v, (log_p, of_class, share, _) = shared.value, model.value
        head_log, head_base = np.log10(np.maximum(v.head_counts, 1)), np.log10(v.head_counts + 0.5) - norm
        for block in blocks(batches, "text", BLOCK):
            e = events(block, v)
            which, rows = e.found.which, e.found.rows
            ids = block.rows.column(0)
            name = int(np.uint64(xxhash.xxh64_intdigest(block.data.tobytes() + block.offsets.tobytes() + repr(ids.to_pylist()).encode())).view(np.int64))
            known = e.head != NO_WORD
            at = np.where(known, e.head, 0)
            word_score = np.where(known, (head_log[at] if len(v.head) else 0.0) - of_class[e.kinds] + share[e.kinds], 0.0)
            in_head = known[which]
            score = np.bincount(rows, weights=log_p[e.context, e.target].astype(np.float64) + word_score[which], minlength=block.n)
            base = np.bincount(rows[in_head], weights=head_base[at[which[in_head]]], minlength=block.n)
            own = pack(np.bincount(rows, minlength=block.n), np.bincount(rows[in_head], minlength=block.n), base, score)
            yield arrow_batch(schema, [[name], [_OWN], [name], pa.ListArray.from_arrays(pa.array([0, block.n], pa.int32()), ids), [own]])
            found = []
            inside = np.flatnonzero(e.target >= SINGLE)
            inside = inside[np.argsort(e.group[inside], kind="stable")]
            small = np.uint16 if block.n <= 1 << 16 else np.uint32
            group, code, row = e.group[inside], e.code[inside].copy(), rows[inside].astype(small)
            keys, cuts = shard_cuts(group, shards, GROUP_BITS)
            first = runs(group)
            code[first] |= _FIRST  # a group lies in one shard
            at = np.searchsorted(first, cuts)
            for k, a, b, g in zip(keys.tolist(), cuts[:-1], cuts[1:], zip(at[:-1], at[1:], strict=True), strict=True):
                found.append((k, _NGRAM_ASK, name, pack(pack_sorted(group[first[slice(*g)]]), code[a:b], planes(row[a:b]))))
            tail = np.flatnonzero(~in_head)
            pair, times = np.unique(which[tail] * block.n + rows[tail], return_counts=True)
            word, row = pair // block.n, (pair % block.n).astype(small)
            order = np.argsort(e.found.hashes[word], kind="stable")
            word, row, times = word[order], row[order], times[order].astype(np.uint32)
            h, kind = e.found.hashes[word], e.kinds[word].astype(np.uint8)
            keys, cuts = shard_cuts(h, shards)
            found += [(k, _WORD_ASK, name, pack(h[a:b], kind[a:b], planes(row[a:b]), times[a:b])) for k, a, b in zip(keys.tolist(), cuts[:-1], cuts[1:], strict=True)]
            yield rows_of(found)

    def answer(batches):
        """In one shard after the other: the tables first, then what blocks ask; rows of their own are handed on."""
        now, ngrams, words = None, None, []
        _, of_class, share, missing = model.value
        for batch in batches:
            own = batch.filter(pa.array(batch.column(1).to_numpy() == _OWN))
            if own.num_rows:
                yield own
            out = []
            for key, kind, block, blob in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if kind == _OWN:
                    continue
                if key != now:
                    now, ngrams, words = key, None, []
                if kind == _NGRAM_TABLE:
                    ngrams = unpack(blob, *_TABLE)
                elif kind == _WORD_TABLE:
                    words.append(unpack(blob, np.uint64, np.int64))
                elif kind == _NGRAM_ASK and ngrams is not None:
                    group, code, row = unpack(blob, np.uint8, np.uint32, np.uint8)
                    row = from_planes(row, np.uint16 if len(row) == 2 * len(code) else np.uint32)
                    value = word_factor(ngrams, unpack_sorted(group)[np.cumsum(code >= _FIRST) - 1], code & (_MANY - np.uint32(1)))
                    at, which = np.unique(row[value != 0], return_inverse=True)
                    out.append((block, _PART, block, pack(at.astype(np.uint32), np.zeros(len(at), np.int64), np.zeros(len(at)), np.bincount(which, weights=value[value != 0], minlength=len(at)))))
                elif kind == _WORD_ASK:
                    if len(words) > 1:
                        h, n = (np.concatenate(x) for x in zip(*words, strict=True))
                        order = np.argsort(h)
                        words = [(h[order], n[order])]
                    h, k, row, times = unpack(blob, np.uint64, np.uint8, np.uint8, np.uint32)
                    row = from_planes(row, np.uint16 if len(row) == 2 * len(h) else np.uint32)
                    c = np.zeros(len(h), np.int64)
                    if words:
                        i, hit = lookup(words[0][0], h)
                        c[hit] = words[0][1][i[hit]]
                    at, which = np.unique(row, return_inverse=True)
                    sums = lambda x: np.bincount(which, weights=x, minlength=len(at))  # noqa: B023, E731
                    score = np.where(c > 0, np.log10(np.maximum(c, 1)) - of_class[k] + share[k], missing[k])
                    out.append((block, _PART, block, pack(at.astype(np.uint32), sums(times * (c > 0)).astype(np.int64), sums(times * (np.log10(c + 0.5) - norm)), sums(times * score))))
            if out:
                yield rows_of(out)

    final = T.StructType([T.StructField("doc_id", id_type)] + [T.StructField(k, T.LongType()) for k in ("n_tokens", "n_known", "train_tokens")] + [T.StructField(k, T.DoubleType()) for k in ("base_score", "score")])

    def finish(batches):
        """Blocks of one content, should there be some, have one name: their parts are added up and shared out alike."""
        now, ids, sums, same = None, None, [], 0

        def done():
            n, known, base, score = sums
            result = arrow_batch(final, [ids, n, np.rint(known / same).astype(np.int64), np.full(len(n), n_tokens), np.round(base / same, 9), np.round(score / same, 9)])
            return [result] * same

        for batch in batches:
            lists = batch.column(3)
            for i, (name, kind, blob) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 1, 4)), strict=True)):
                if name != now and same:
                    yield from done()
                    same = 0
                now = name
                if kind == _OWN:
                    n, *more = unpack(blob, np.int64, np.int64, np.float64, np.float64)
                    sums = [n, *(a + b for a, b in zip(more, sums[1:], strict=True))] if same else [n, *(a.astype(np.float64) for a in more)]
                    ids, same = lists[i].values, same + 1
                else:
                    at, *more = unpack(blob, np.uint32, np.int64, np.float64, np.float64)
                    for total, x in zip(sums[1:], more, strict=True):
                        total[at] += x
        if same:
            yield from done()

    asked = source.select("doc_id", "text").mapInArrow(ask, schema)
    asked = asked.unionByName(learnt.filter("key >= 0").mapInArrow(ngram_tables, schema)).unionByName(counts.filter(F.col("n") < floor).select("hash", "n").mapInArrow(word_tables, schema))
    answered = asked.repartition("key").sortWithinPartitions("key", "kind").mapInArrow(answer, schema)
    return answered.repartition("key").sortWithinPartitions("key", "kind").mapInArrow(finish, final)

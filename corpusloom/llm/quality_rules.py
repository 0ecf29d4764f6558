"""Quality rules: fixed text statistics, then a hashed n-gram log-likelihood ratio.

Two multinomials over hashed byte n-grams are estimated: the raw corpus from every
document, the trusted target from a bounded sample of labelled good documents.  A
document's verdict is its mean log ratio against a fixed threshold.

A few bad words vanish in a mean.  With ``reject_toxic`` a document also goes for its
single worst word: how much likelier the word is in documents labelled toxic than in
trusted ones, at the lower end of its confidence interval, against a cut taken from
the trusted documents' own worst words under a model of the other half of the labels.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_text import Block, blocks, encode_spans, mix64, word_spans, xxh64
from .shared import arrow_batch, checkpointed, whole_row
from .simhash_dedup import lower_ascii

ORDER, BUCKETS = 3, 1 << 16
SYMBOLS = b"#*$%&|<>"
THRESHOLD, PRIOR, TRUSTED_ROWS = -0.3, 8.0, 50_000
#: Bytes of text a block, for memory.
SMALL = 1 << 20
#: Toxic documents a word must be in, the share of held-out trusted documents under the cut, and the least cut.
TOXIC_SUPPORT, TRUSTED_SHARE, LEAST_CUT = 3, 0.999, 1.0
BASE = {k: T.LongType() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}


def ngram_ids(block: Block, order: int = ORDER, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every byte n-gram that lies within one text; a text shorter than ``order`` has none."""
    n = len(block.data) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram = np.zeros(n, np.uint64)
    for j in range(order):
        gram = (gram << np.uint64(8)) | block.data[j : j + n]
    rows = np.repeat(np.arange(block.n), block.lengths)[:n]
    inside = np.arange(n) + order <= block.offsets[rows + 1]
    return (mix64(gram[inside]) % np.uint64(buckets)).astype(np.int64), rows[inside]


def _covered(first: np.ndarray, length: int, n: int) -> np.ndarray:
    """Marks the ``length`` places from each of ``first`` on."""
    change = np.zeros(n + length + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + length, -1)
    return np.cumsum(change)[:n] > 0


def repeated_words(words: np.ndarray, rows: np.ndarray, window: int, n_rows: int) -> np.ndarray:
    """Per row the words inside ``window``-word windows that the row has twice or more, all of them counted; ``words`` are codes."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(n_rows, np.int64)
    same = rows[:n] == rows[window - 1 :]
    key, coded = mix64(rows[:n].astype(np.uint64) + np.uint64(1)), words.astype(np.uint64)
    for j in range(window):
        key = mix64(key ^ coded[j : j + n]) + np.uint64(j)
    at = np.flatnonzero(same)
    order = at[np.argsort(key[at], kind="stable")]
    equal = (key[order[1:]] == key[order[:-1]]) & (rows[order[1:]] == rows[order[:-1]])
    close = np.flatnonzero(equal)
    for j in range(window):  # equal hashes only propose; the words decide
        equal[close] &= words[order[close + 1] + j] == words[order[close] + j]
    twice = np.zeros(len(order), bool)
    twice[1:] |= equal
    twice[:-1] |= equal
    return np.bincount(rows[_covered(order[twice], window, len(words))], minlength=n_rows)


def base_statistics(block: Block) -> dict[str, np.ndarray]:
    """The base columns of every row of a block, from whole texts."""
    data, n = block.data, block.n
    starts, ends, rows = word_spans(block)
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    symbols = np.concatenate(([0], np.cumsum(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)))))
    n_words = np.bincount(rows, minlength=n)
    word_chars = np.bincount(rows, weights=chars[ends] - chars[starts], minlength=n).astype(np.int64)
    # Lines: cut at \n and at the ends of texts; only lines with a word count.
    cut = np.flatnonzero(data == 10)
    line_starts = np.concatenate((block.offsets[:-1], cut + 1))
    line_rows = np.concatenate((np.arange(n), block.row_of(cut)))
    order = np.lexsort((line_starts, line_rows))
    line_starts, line_rows = line_starts[order], line_rows[order]
    line_ends = np.concatenate((line_starts[1:] - 1, [len(data)]))
    last = np.concatenate((line_rows[1:] != line_rows[:-1], [True]))
    line_ends[last] = block.offsets[line_rows[last] + 1]
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, line_rows = line_starts[worded], line_ends[worded], line_rows[worded]
    lines = encode_spans(data, line_starts, line_ends)[0]
    distinct = np.bincount(np.unique(lines * n + line_rows) % n, minlength=n)
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": symbols[block.offsets[1:]] - symbols[block.offsets[:-1]],
        "n_dup_lines": np.bincount(line_rows, minlength=n) - distinct,
        "n_repeat_words": repeated_words(encode_spans(data, starts, ends)[0], rows, 8, n),
    }


def trusted_ids(labels: DataFrame, limit: int = TRUSTED_ROWS, id_col: str = "doc_id") -> list:
    """Ids of at most ``limit`` documents labelled good and not toxic, the first by hash of the id."""
    good = labels.filter((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col(id_col).isNotNull())
    return [r[0] for r in good.select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(limit).collect()]


def fit_ratio(docs: DataFrame, trusted: list, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, buckets: int = BUCKETS, prior: float = PRIOR) -> np.ndarray:
    """Log ratio of trusted to raw probability per bucket, both with ``prior`` pseudo-counts of the raw distribution.

    The raw counts come from every document; each task sums its own before the shuffle,
    and the driver receives one row per bucket.
    """
    own = docs.sparkSession.sparkContext.broadcast(np.asarray(trusted))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("bucket", "raw", "good")])

    def count(batches):
        raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        sample = own.value
        for block in blocks(batches, "text", SMALL):
            ids, rows = ngram_ids(block, order, buckets)
            raw += np.bincount(ids, minlength=buckets)
            if len(sample):
                key = block.rows.column(0).to_pandas()
                chosen = key.isin(sample).to_numpy()
                good += np.bincount(ids[chosen[rows]], minlength=buckets)
        at = np.flatnonzero(raw)
        yield arrow_batch(schema, [at, raw[at], good[at]])

    counts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(count, schema)
    raw, good = np.zeros(buckets), np.zeros(buckets)
    for r in counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect():
        raw[r.bucket], good[r.bucket] = r.raw, r.good
    if not good.sum():
        return np.zeros(buckets)
    scale = raw.sum() / good.sum()
    return np.log((good * scale + prior) / (raw + prior))


def word_hashes(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 and row of every word: a run of letters, digits and characters beyond ASCII, in lower case."""
    data = lower_ascii(block.data)
    inside = (data >= 128) | ((data - np.uint8(97)) < 26) | ((data - np.uint8(48)) < 10)
    words = Block(block.rows, np.where(inside, data, np.uint8(32)), block.offsets)
    starts, ends, rows = word_spans(words)
    if not len(starts):
        return np.zeros(0, np.int64), rows
    codes, distinct = encode_spans(words.data, starts, ends)
    return xxh64(distinct).view(np.int64)[codes], rows


def worst_words(words: np.ndarray, rows: np.ndarray, n: int, known: np.ndarray, evidence: np.ndarray) -> np.ndarray:
    """Per row the largest evidence of its words, 0 without a known one; ``known`` is sorted."""
    out = np.zeros(n)
    if len(known):
        at = np.minimum(np.searchsorted(known, words), len(known) - 1)
        hit = known[at] == words
        np.maximum.at(out, rows[hit], evidence[at[hit]])
    return out


def fit_toxic(docs: DataFrame, labels: DataFrame, limit: int = TRUSTED_ROWS, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray, float]:
    """(word hashes, their evidence, cut), from at most ``limit`` trusted and ``limit`` toxic documents, the first by hash of the id.

    Evidence is the log ratio of a word's document shares, toxic to trusted, less 1.64
    standard errors.  The cut is the ``TRUSTED_SHARE`` quantile of the trusted documents'
    worst words, each by the evidence of the half of the labels it is not in.
    """
    told = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.max(F.coalesce("toxic", F.lit(0))) == 1).alias("toxic"), F.min("quality").alias("_quality"))
    first = lambda kind: told.filter(kind).orderBy(F.xxhash64("_id"), "_id").limit(limit).select("_id", "toxic", (F.xxhash64("_id", F.lit(1)) % 2 == 0).alias("even"))
    sample = first(F.col("toxic")).unionByName(first(~F.col("toxic") & (F.col("_quality") == 1)))
    schema = T.StructType([T.StructField("toxic", T.BooleanType()), T.StructField("even", T.BooleanType()), T.StructField("words", T.ArrayType(T.LongType()))])

    def read(batches):
        for block in blocks(batches, "text", SMALL):
            words, rows = word_hashes(block)
            cut = np.searchsorted(rows, np.arange(block.n + 1))
            yield arrow_batch(schema, [block.rows.column(0), block.rows.column(1), [np.unique(words[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]])

    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "_id")
    own = checkpointed(chosen.select("toxic", "even", "text").mapInArrow(read, schema))
    size = {(r.toxic, r.even): r["count"] for r in own.groupBy("toxic", "even").count().collect()}
    of = lambda toxic, *halves: sum(size.get((toxic, h), 0) for h in halves)
    if not of(True, True, False) or not of(False, True, False):
        return np.zeros(0, np.int64), np.zeros(0), np.inf
    has = lambda toxic, even: F.sum(((F.col("toxic") == toxic) & (F.col("even") == even)).cast("long"))
    counts = own.select("toxic", "even", F.explode("words").alias("word")).groupBy("word").agg(has(True, True).alias("te"), has(True, False).alias("to"), has(False, True).alias("ge"), has(False, False).alias("go"))

    def evidence(t, g, n_toxic, n_good):
        t, g = t + F.lit(0.5), g + F.lit(0.5)
        return F.log(t / (n_toxic + 1.0)) - F.log(g / (n_good + 1.0)) - 1.64 * F.sqrt(1 / t + 1 / g)

    c = F.col
    known = counts.filter(c("te") + c("to") >= TOXIC_SUPPORT).select(
        "word",
        evidence(c("te") + c("to"), c("ge") + c("go"), of(True, True, False), of(False, True, False)).alias("all"),
        evidence(c("te"), c("ge"), of(True, True), of(False, True)).alias("even"),
        evidence(c("to"), c("go"), of(True, False), of(False, False)).alias("odd"),
    )
    table = known.filter(F.greatest("all", "even", "odd") > 0).orderBy("word").toPandas()
    held = docs.sparkSession.sparkContext.broadcast(tuple(table[k].to_numpy() for k in ("word", "even", "odd")))
    stat = T.StructType([T.StructField("worst", T.DoubleType())])

    def judge(batches):
        word, even, odd = held.value
        for batch in batches:
            lists = batch.column(1)
            rows = np.repeat(np.arange(batch.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            words = lists.flatten().to_numpy(zero_copy_only=False)
            is_even = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            by = [worst_words(words, rows, batch.num_rows, word, e) for e in (odd, even)]
            yield arrow_batch(stat, [np.where(is_even, by[0], by[1])])

    worst = own.filter("not toxic").select("even", "words").mapInArrow(judge, stat).toPandas()["worst"].to_numpy()
    cut = max(LEAST_CUT, float(np.quantile(worst, TRUSTED_SHARE, method="higher")))
    use = table["all"].to_numpy() > 0
    return table["word"].to_numpy()[use], table["all"].to_numpy()[use], cut


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: bool = False,
    reject_toxic: bool = False,
    threshold: float = THRESHOLD,
    trusted_rows: int = TRUSTED_ROWS,
    min_words: int = 20,
    max_repeat_percent: int = 30,
) -> DataFrame:
    """One row per input row: doc_id, the base columns, base_failed, ratio, kept.

    With ``carry`` the whole input row follows as the struct ``row``, whatever its names.

    ``ratio`` is the mean log ratio of a text's n-grams, 0 for a text without any.
    A null text is empty: no words, base_failed, not kept.  Without any trusted label
    all ratios are 0 and only the base rules decide.  Repeated rows are judged alike,
    each on its own; a ratio at the threshold is kept.  Null ids stay and are never
    trusted; labels with null values count as not good and not toxic.  A text longer than a
    block of 1 MB is a block of its own, read whole.  An empty table gives an empty result.
    Rows are never moved: all passes are maps over the input.

    With ``reject_toxic`` (the query and the pipeline) a document whose worst word is over
    the cut of :func:`fit_toxic` is not kept; without toxic or trusted labels none goes.
    """
    ratio = docs.sparkSession.sparkContext.broadcast(fit_ratio(docs, trusted_ids(labels, trusted_rows), id_col=id_col, text_col=text_col))
    toxic = docs.sparkSession.sparkContext.broadcast(fit_toxic(docs, labels, trusted_rows, id_col=id_col, text_col=text_col) if reject_toxic else None)
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[id_col].dataType)]
        + [T.StructField(k, v) for k, v in BASE.items()]
        + [T.StructField("base_failed", T.BooleanType()), T.StructField("ratio", T.DoubleType()), T.StructField("kept", T.BooleanType())]
        + [T.StructField("row", docs.schema)] * carry
    )
    taken = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), *[whole_row(docs)] * carry)

    def run(batches):
        table = ratio.value
        for block in blocks(batches, "_text", SMALL):
            base = base_statistics(block)
            ids, rows = ngram_ids(block)
            mean = np.bincount(rows, weights=table[ids], minlength=block.n) / np.maximum(1, np.bincount(rows, minlength=block.n))
            mean = np.round(mean, 9)
            failed = (base["n_words"] < min_words) | (100 * base["n_repeat_words"] > max_repeat_percent * base["n_words"])
            kept = ~failed & (mean >= threshold)
            if toxic.value is not None:
                known, evidence, cut = toxic.value
                kept &= worst_words(*word_hashes(block), block.n, known, evidence) <= cut
            yield arrow_batch(schema, [block.rows.column(0), *(base[k] for k in BASE), failed, mean, kept, *block.rows.columns[2:]])

    return taken.mapInArrow(run, schema)

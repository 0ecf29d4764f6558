"""Language identification with error-correcting output codes.

Every language has a codeword; one binary classifier per bit, over hashed byte
n-grams, predicts whether a text's language has that bit.  Decoding adds up each
classifier's loss against every codeword, weighted by how well the classifier did
in training, and takes the codeword with the least loss; a small margin to the
second flags the text as ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_text import Block, blocks, mix64
from .shared import arrow_batch

ORDERS, BUCKETS, PER_LANGUAGE = (1, 2, 3), 4096, 600
UNDETERMINED = "und"


def code_matrix(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of signs: every split of the languages for few of them, else random splits far from each other."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        columns = np.arange(1, 1 << (n - 1))
        return np.where((columns[None, :] >> np.arange(n)[:, None]) & 1, -1.0, 1.0)
    width, rng = 4 * int(np.ceil(np.log2(n))) + 15, np.random.default_rng(seed)
    best, apart = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, width))
        code = code[:, np.abs(code.sum(1 - 1)) < n]
        gap = int((code.shape[1] - (code @ code.T - 2 * code.shape[1] * np.eye(n)).max()) // 2)
        if gap > apart:
            best, apart = code, gap
    return best


def features(block: Block, orders=ORDERS, buckets: int = BUCKETS) -> np.ndarray:
    """Unit vectors of square-rooted shares of hashed byte n-grams; A-Z as a-z, any non-letter ASCII byte as a space."""
    data = block.data
    lower = np.where((data - np.uint8(65)) < 26, data + np.uint8(32), data)
    lower = np.where((lower < 128) & ~((lower - np.uint8(97)) < 26), np.uint8(32), lower)
    n, out = len(lower), np.zeros((block.n, buckets), np.float32)
    if not n:
        return out
    rows_all = np.repeat(np.arange(block.n), block.lengths)
    for order in orders:
        m = n - order + 1
        if m <= 0:
            continue
        gram = np.full(m, order, np.uint64)
        for j in range(order):
            gram = (gram << np.uint64(8)) | lower[j : j + m]
        rows = rows_all[:m]
        inside = rows == rows_all[order - 1 :]
        ids = (mix64(gram[inside]) % np.uint64(buckets)).astype(np.int64)
        out += np.bincount(rows[inside] * buckets + ids, minlength=block.n * buckets).reshape(block.n, buckets)
    np.sqrt(out, out=out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def has_letter(block: Block) -> np.ndarray:
    lower = block.data | np.uint8(32)
    plain = np.concatenate(([0], np.cumsum((lower - np.uint8(97)) < 26)))
    high = np.concatenate(([0], np.cumsum(block.data >= 128)))
    out = plain[block.offsets[1:]] > plain[block.offsets[:-1]]
    for i in np.flatnonzero(~out & (high[block.offsets[1:]] > high[block.offsets[:-1]])):
        out[i] = any(c.isalpha() for c in block.text_bytes(i).decode())
    return out


def slices(block: Block, rows: int = 512):
    """A block in pieces of at most ``rows`` texts, so that many short texts don't make a tall feature matrix."""
    for at in range(0, block.n, rows):
        to = min(at + rows, block.n)
        yield Block(block.rows.slice(at, to - at), block.data[block.offsets[at] : block.offsets[to]], block.offsets[at : to + 1] - block.offsets[at])


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its share of the softmax over losses, and the margin to the second."""
        margin = x @ self.weights + self.bias
        loss = np.stack([(np.logaddexp(0, -margin * row) * self.trust).sum(1) for row in self.code], axis=1)
        share = np.exp(loss.min(1, keepdims=True) - loss)
        share /= share.sum(1, keepdims=True)
        order = np.sort(share, axis=1)
        second = order[:, -2] if share.shape[1] > 1 else np.zeros(len(share))
        return loss.argmin(1), order[:, -1], order[:, -1] - second


def train(x: np.ndarray, y: np.ndarray, languages: list[str], steps: int = 150, rate: float = 8.0, decay: float = 1e-5) -> Model:
    """Logistic regressions for all bits at once, by full gradient steps; each language weighs the same."""
    code = code_matrix(len(languages))
    signs = code[y]
    share = 1.0 / np.bincount(y, minlength=len(languages))[y]
    share /= share.sum()
    weights, bias = np.zeros((x.shape[1], code.shape[1])), np.zeros(code.shape[1])
    speed = np.zeros_like(weights)
    for _ in range(steps):
        pull = signs * share[:, None] / (1 + np.exp(np.clip(signs * (x @ weights + bias), -50, 50)))
        speed = 0.9 * speed + x.T @ pull - decay * weights
        weights += rate * speed
        bias += rate * pull.sum(0)
    right = ((np.sign(x @ weights + bias) == signs) * share[:, None]).sum(0)
    trust = np.log(np.clip(right, 0.51, 0.999) / (1 - np.clip(right, 0.51, 0.999)))
    return Model(languages, code, weights.astype(np.float32), bias, trust / trust.sum() * len(trust))


def fit(docs: DataFrame, *, training, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """Fits on about ``per_language`` labelled documents of each language, drawn by hash of the id; their texts are read whole.

    ``training`` is the condition for a row to be learnt from.  The driver receives one
    vector of fixed length per drawn document, never a text.
    """
    usable = docs.filter(training & F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in usable.groupBy(F.col(lang_col).cast("string")).count().collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    draw = F.lit(0.0)
    for lang, n in sizes.items():
        draw = F.when(F.col(lang_col) == lang, F.lit(min(1.0, per_language / n))).otherwise(draw)
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit(11), id_col), 11).cast("double") / F.lit(float(1 << 53))
    sample = usable.filter(hashed < draw).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("vector", T.BinaryType())])

    def vectors(batches):
        for block in blocks(batches, "text", 1 << 20):
            for own in slices(block):
                yield arrow_batch(schema, [own.rows.column(0), [v.astype(np.float16).tobytes() for v in features(own)]])

    rows = sorted((r.lang, bytes(r.vector)) for r in sample.mapInArrow(vectors, schema).collect())
    if not rows:
        return None
    x = np.stack([np.frombuffer(v, np.float16) for _, v in rows]).astype(np.float32)
    drawn = [lang for lang in languages if any(r[0] == lang for r in rows)]
    y = np.array([drawn.index(lang) for lang, _ in rows])
    return train(x, y, drawn)


def identify(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text", ambiguous_below: float = 0.2) -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, margin, ambiguous; only the text is looked at.

    A null, empty or letterless text is ``und`` with score 0, as is every text without a
    model (no labelled rows).  Repeated rows are predicted alike; ties go to the language
    that is first by code point.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for block in blocks(batches, "text", 1 << 21):
            for own in slices(block):
                known = has_letter(own) if model else np.zeros(own.n, bool)
                best, score, margin = model.predict(features(own)) if model else (np.zeros(own.n, int), np.zeros(own.n), np.zeros(own.n))
                names = [model.languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]
                yield arrow_batch(schema, [own.rows.column(0), names, np.where(known, np.round(score, 9), 0.0), np.where(known, np.round(margin, 9), 0.0), ~known | (margin < ambiguous_below)])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)

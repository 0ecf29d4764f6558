"""Main-text extraction by a recurrent block labeller.

A page is cut into its leaf blocks.  Each block becomes a vector: its tag path with
classes and ids, hashed, its words, hashed, and a few lengths and ratios.  A
bidirectional LSTM in numpy reads the whole sequence of a page's blocks and labels
every block as main text or not, so that a block is judged by what stands around it.

There are no labelled pages, so it is trained here on weak labels: a bounded sample of
the table's own pages and pages from a small template grammar, labelled by semantic
elements and telling class names.  The labeller is not to repeat that rule: it sees every
training page three times, as it is, without its class names, and with its semantic
elements read as plain ones too, and must find the same labels from the kind, length, links
and order of the blocks alone.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_text import SpanHash, blocks, word_spans
from .shared import arrow_batch

# HTML's element kinds.
BLOCK_TAGS = frozenset("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCK_TAGS - {"br", "body", "html", "head", "button", "option", "legend", "caption"}
BOILER_TAGS = frozenset("nav header footer aside form head title button select textarea menu dialog".split())
MAIN_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILER_WORDS = frozenset("ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar widget".split())

# Comments; script and style, whose content is no text; other tags with their attributes; what else looks like markup.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style)(?=[\s/>])(?:.*?</\1(?=[\s/>])[^>]*(?:>|\Z)|.*\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)(?:>|\Z)"
    r"|</?[a-z!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAME = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(r"[a-z]+")

PATH, WORDS, OTHER, HIDDEN = 48, 24, 8, 16
INPUT = PATH + WORDS + OTHER
SAMPLE_PAGES, SAMPLE_BLOCKS = 192, 160


class Level:
    """An open element, linked to the one around it; what its path says is worked out once per element."""

    __slots__ = ("boiler", "depth", "main", "names", "parent", "seen", "tag")

    def __init__(self, parent: Level | None, tag: str, classes: tuple[str, ...]):
        self.parent, self.tag = parent, tag
        self.names = (tag, *classes) if tag in BLOCK_TAGS or classes else ()
        self.depth = (parent.depth if parent else 0) + len(self.names)
        self.boiler = bool(parent and parent.boiler) or any(n in BOILER_TAGS or n[0] == "." and n[1:] in BOILER_WORDS for n in self.names)
        self.main = bool(parent and parent.main) or tag in MAIN_TAGS
        self.seen: list[np.ndarray | None] = [None] * 3

    def vector(self, hide: int) -> np.ndarray:
        """The hashed names of the path: all of them, or without classes (1), or with semantic elements as div too (2)."""
        todo, at = [], self
        while at is not None and at.seen[hide] is None:
            todo.append(at)
            at = at.parent
        total = at.seen[hide] if at is not None else np.zeros(PATH, np.float32)
        for level in reversed(todo):
            if level.names:
                total = total.copy()
                for name in level.names:
                    if hide and name[0] == ".":
                        continue
                    if hide == 2 and (name in BOILER_TAGS or name in MAIN_TAGS):
                        name = "div"
                    h = zlib.crc32(name.encode())
                    total[h % PATH] += 1.0 if h >> 16 & 1 else -1.0
            level.seen[hide] = total
        return np.clip(total, -2, 2)


class Leaf(NamedTuple):
    """A block of text: the element it stands in, the text, and how many of its characters are inside links."""

    level: Level
    text: str
    linked: int


_ROOT = Level(None, "", ())


def leaf_blocks(html: str) -> list[Leaf]:
    """The blocks with text, in page order.  Character references are decoded, white space is one space.

    The time is linear in the page, however deep its elements nest.
    """
    out: list[Leaf] = []
    stack: list[Level] = []
    outer: list[int] = []  # places of the block elements in the stack
    n_open: Counter[str] = Counter()
    pieces: list[str] = []
    linked = 0
    level: Level | None = None

    def flush() -> None:
        nonlocal linked, level
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                out.append(Leaf(level or _ROOT, text, min(linked, len(text))))
            pieces.clear()
        linked, level = 0, None

    def add(text: str) -> None:
        nonlocal linked, level
        if text:
            if level is None and not text.isspace():
                level = stack[-1] if stack else _ROOT
            pieces.append(text)
            if n_open["a"]:
                linked += len(text)

    def close(at: int) -> None:
        for element in stack[at:]:
            n_open[element.tag] -= 1
        del stack[at:]
        while outer and outer[-1] >= at:
            outer.pop()

    at = 0
    for m in _MARKUP.finditer(html):
        add(html[at : m.start()])
        at = m.end()
        tag = (m.group(3) or "").lower()
        if not tag:
            continue
        if tag in BLOCK_TAGS:
            flush()
        if m.group(2):
            if n_open[tag]:
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                close(i)
            continue
        if tag in CLOSES_P and outer and (stack[outer[-1]].tag == "p" or tag == "li" and stack[outer[-1]].tag == "li"):
            close(outer[-1])
        if tag not in VOID_TAGS and not (m.group(4).endswith("/") and tag not in BLOCK_TAGS):
            attributes = m.group(4)
            own = tuple("." + w for a in _NAME.findall(attributes) for w in _TOKEN.findall("".join(a).lower())) if "=" in attributes else ()
            if tag in BLOCK_TAGS:
                outer.append(len(stack))
            stack.append(Level(stack[-1] if stack else _ROOT, tag, own))
            n_open[tag] += 1
    add(html[at:])
    flush()
    return out


def weak_labels(page: list[Leaf]) -> list[bool]:
    """Main text by semantics alone: inside article or main if the page has one, and not inside anything telling."""
    has_main = any(b.level.main for b in page)
    return [not b.level.boiler and (b.level.main or not has_main) for b in page]


def vectors(pages: list[list[Leaf]], hide: int = 0) -> np.ndarray:
    """The vectors of all blocks of some pages, one row each; ``hide`` as in :meth:`Level.vector`."""
    flat = [b for page in pages for b in page]
    out = np.zeros((len(flat), INPUT), np.float32)
    if not flat:
        return out
    out[:, :PATH] = np.stack([b.level.vector(hide) for b in flat])
    column = pa.RecordBatch.from_arrays([pa.array([t.lower() for _, t, _ in flat], pa.large_string())], names=["t"])
    at = 0
    n_words = np.zeros(len(flat))
    for block in blocks([column], "t"):
        starts, ends, rows = word_spans(block)
        ids = (SpanHash(block.data, 3)(starts, ends) % np.uint64(WORDS)).astype(np.int64)
        counts = np.bincount(rows * WORDS + ids, minlength=block.n * WORDS).reshape(block.n, WORDS)
        total = np.bincount(rows, minlength=block.n)
        out[at : at + block.n, PATH : PATH + WORDS] = np.sqrt(counts / np.maximum(total, 1)[:, None])
        n_words[at : at + block.n] = total
        at += block.n
    length = np.array([len(t) for _, t, _ in flat], np.float64)
    place = np.concatenate([np.arange(len(p)) / max(1, len(p) - 1) for p in pages if p])
    other = np.stack(
        (np.log1p(length) / 6, np.log1p(n_words) / 5, [link / n for (_, _, link), n in zip(flat, length, strict=True)], [t[-1] in ".!?…:;。" for _, t, _ in flat], place, [min(b.level.depth, 12) / 12 for b in flat], [b.level.tag in HEADINGS for b in flat], np.ones(len(flat))),
        axis=1,
    )
    out[:, PATH + WORDS :] = other
    return out


class Labeller:
    """A bidirectional LSTM with a logistic output over both states."""

    def __init__(self, hidden: int = HIDDEN, seed: int = 5):
        rng, h = np.random.default_rng(seed), hidden
        self.h = h
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 1 / np.sqrt(INPUT), (INPUT, 4 * h))
            self.p[f"h{d}"] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h))
            self.p[f"b{d}"] = np.repeat([0.0, 1.0, 0.0, 0.0], h)  # input, forget, output, candidate
        self.p["o"], self.p["c"] = rng.normal(0, 1 / np.sqrt(2 * h), 2 * h), np.zeros(1)

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """x (T, B, D), mask (T, B); the states of every step, and in training what the way back needs."""
        steps, batch, _ = x.shape
        h = self.h
        inner = x.reshape(-1, x.shape[2]) @ self.p[f"x{d}"] + self.p[f"b{d}"]
        inner = inner.reshape(steps, batch, 4 * h)
        state, cell = np.zeros((batch, h), inner.dtype), np.zeros((batch, h), inner.dtype)
        out, kept = np.zeros((steps, batch, h), inner.dtype), []
        weights = self.p[f"h{d}"].astype(inner.dtype)
        for t in range(steps):
            z = inner[t] + state @ weights
            gate = 1 / (1 + np.exp(-z[:, : 3 * h]))
            cand = np.tanh(z[:, 3 * h :])
            m = mask[t][:, None]
            new = gate[:, h : 2 * h] * cell + gate[:, :h] * cand
            squashed = np.tanh(new)
            if keep:
                kept.append((state, cell, gate, cand, squashed))
            state = np.where(m, gate[:, 2 * h :] * squashed, state)
            cell = np.where(m, new, cell)
            out[t] = state
        return out, kept

    def _back(self, x, mask, d, kept, d_out, grads):
        h = self.h
        d_state, d_cell = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
        d_inner = np.zeros((*d_out.shape[:2], 4 * h))
        for t in range(len(x) - 1, -1, -1):
            state, cell, gate, cand, squashed = kept[t]
            m = mask[t][:, None]
            total = d_state + d_out[t]
            i, f, o = gate[:, :h], gate[:, h : 2 * h], gate[:, 2 * h :]
            d_new = np.where(m, total * o * (1 - squashed**2) + d_cell, 0)
            z = np.concatenate((d_new * cand * i * (1 - i), d_new * cell * f * (1 - f), np.where(m, total * squashed, 0) * o * (1 - o), d_new * i * (1 - cand**2)), axis=1)
            d_inner[t] = z
            grads[f"h{d}"] += state.T @ z
            d_state = z @ self.p[f"h{d}"].T + np.where(m, 0, total)
            d_cell = np.where(m, d_new * f, d_cell)
        flat = d_inner.reshape(-1, 4 * h)
        grads[f"x{d}"] += x.reshape(-1, x.shape[2]).T @ flat
        grads[f"b{d}"] += flat.sum(0)

    @staticmethod
    def _reverse(a: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Turns each sequence around inside its own length."""
        t = np.arange(len(a))[:, None]
        at = np.where(t < lengths, lengths - 1 - t, t)
        return a[at, np.arange(a.shape[1])[None, :]]

    def scores(self, x: np.ndarray, lengths: np.ndarray, keep: bool = False):
        mask = np.arange(len(x))[:, None] < lengths
        forward, kf = self._pass(x, mask, "f", keep)
        backward, kb = self._pass(self._reverse(x, lengths), mask, "b", keep)
        both = np.concatenate((forward, self._reverse(backward, lengths)), axis=2)
        logit = both @ self.p["o"] + self.p["c"][0]
        return (logit, mask, both, kf, kb) if keep else logit

    def fit(self, sequences: list[tuple[np.ndarray, np.ndarray]], epochs: int = 8, batch: int = 48, rate: float = 0.02, seed: int = 5) -> Labeller:
        """Adam on the mean logistic loss."""
        rng = np.random.default_rng(seed)
        m1, m2, step = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(sequences))
            for at in range(0, len(order), batch):
                own = [sequences[i] for i in order[at : at + batch]]
                lengths = np.array([len(y) for _, y in own])
                x, y = np.zeros((lengths.max(), len(own), INPUT)), np.zeros((lengths.max(), len(own)))
                for j, (xs, ys) in enumerate(own):
                    x[: len(ys), j], y[: len(ys), j] = xs, ys
                logit, mask, both, kf, kb = self.scores(x, lengths, True)
                d_logit = np.where(mask, 1 / (1 + np.exp(-logit)) - y, 0) / mask.sum()
                grads = {k: np.zeros_like(v) for k, v in self.p.items()}
                grads["o"] = np.einsum("tbh,tb->h", both, d_logit)
                grads["c"] = np.array([d_logit.sum()])
                d_both = d_logit[:, :, None] * self.p["o"]
                self._back(x, mask, "f", kf, d_both[:, :, : self.h], grads)
                self._back(self._reverse(x, lengths), mask, "b", kb, self._reverse(d_both[:, :, self.h :], lengths), grads)
                step += 1
                pace = rate * min(1.0, 2 * (1 - epoch / epochs))
                for k, g in grads.items():
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.99 * m2[k] + 0.01 * g * g
                    self.p[k] = self.p[k] - pace * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def label(self, pages: list[list[Leaf]], cells: int = 1 << 14, hide: int = 0) -> list[np.ndarray]:
        """For each page a flag per block.  Pages of like length go together, at most ``cells`` padded blocks at a time (one page at least)."""
        x = vectors(pages, hide)
        ends = np.cumsum([len(p) for p in pages])
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: -len(pages[i]))
        at = 0
        while at < len(order):
            own = order[at : at + max(1, cells // len(pages[order[at]]))]
            at += len(own)
            lengths = np.array([len(pages[i]) for i in own])
            seq = np.zeros((lengths.max(), len(own), INPUT), np.float32)
            for j, i in enumerate(own):
                seq[: lengths[j], j] = x[ends[i] - lengths[j] : ends[i]]
            logit = self.scores(seq, lengths)
            for j, i in enumerate(own):
                out[i] = logit[: lengths[j], j] > 0
        return out


# ---------------------------------------------------------------- training pages


def template_pages(n: int, seed: int = 3) -> Iterator[str]:
    """Pages from a small grammar of common layouts, with invented words."""
    rng = random.Random(seed)
    syllables = "an be co de er fi ga he in jo ka lo mi no or pa qu re sa ti un va we ya zo".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randrange(a, b)))
    sentence = lambda a=4, b=30: words(a, b).capitalize() + "."
    prose = lambda: " ".join(sentence() for _ in range(rng.randrange(1, 5)))
    link = lambda: f'<a href="/{word()}">{words(1, 4)}</a>'

    def links() -> str:
        outer, inner = rng.choice((("ul", "li"), ("ul", "li"), ("div", "div"), ("div", "p"), ("div", "span")))
        return f"<{outer}>" + "".join(f"<{inner}>{link()}</{inner}> " for _ in range(rng.randrange(2, 9))) + f"</{outer}>"

    may = lambda p, s: s if rng.random() < p else ""
    pick = lambda *a: rng.choice(a)

    def article() -> str:
        parts = [may(0.8, f"<h1>{words(3, 10)}</h1>"), may(0.2, f'<p class="byline">{words(2, 5)}</p>')]
        for _ in range(rng.randrange(1, 12)):
            parts.append(pick(f"<p>{prose()}</p>", f"<p>{prose()}</p>", f"<p>{prose()}", f"<p><b>{prose()}<br><p>{prose()}</p>", f"<h2>{words(2, 7)}</h2><p>{prose()}</p>", f"<blockquote><p>{prose()}</p></blockquote>", f"<ul><li>{sentence()}</li><li>{sentence()}</li></ul>", f"<p>{prose()} <a href='/x'>{words(1, 4)}</a> {prose()}</p>", f"<p>{words(1, 3)}.</p>", f"<pre>{prose()}</pre>", f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>"))
            parts.append(may(0.08, f'<div class="{pick("ad", "advert", "promo", "sponsored")}">{prose()}</div>'))
        return "".join(parts)

    for _ in range(n):
        body = article()
        main = pick(f"<article>{body}</article>", f"<article>{body}</article>", f"<main>{body}</main>", f"<main><article>{body}</article></main>", f'<div class="content">{body}</div>', f'<div id="post">{body}</div>', f'<section class="story">{body}</section>')
        head = may(0.9, f"<head><title>{words(2, 8)}</title></head>")
        top = may(0.5, f"<header><h2>{words(1, 4)}</h2><p>{may(0.5, sentence())}</p></header>") + may(0.8, pick(f"<nav>{links()}</nav>", f'<div class="{pick("menu", "navbar", "nav")}">{links()}</div>')) + may(0.3, f'<div class="{pick("cookie notice", "notice", "banner", "consent")}">{prose()}</div>') + may(0.4, f'<div class="{pick("ad", "ads banner", "advert")}">{prose()}</div>')
        side = may(0.4, f'<aside class="{pick("sidebar", "related", "")}"><h3>{words(1, 4)}</h3>{pick(links(), "<p>" + prose() + "</p>")}</aside>') + may(0.2, f'<div class="sidebar">{links()}<p>{sentence()}</p></div>')
        after = may(0.35, f'<{pick("div", "section")} class="comments"><h3>{words(1, 3)}</h3>' + "".join(f'<div class="comment"><p>{prose()}</p></div>' for _ in range(rng.randrange(1, 5))) + "</div>") + may(0.2, f"<form><label>{words(1, 3)}</label><button>{word()}</button><p>{sentence()}</p></form>") + may(0.2, f'<div class="share">{links()}</div>')
        foot = may(0.85, f"<footer>{pick('&copy; ' + words(1, 4), '<p>' + prose() + '</p>', links())}</footer>")
        page = f"<html>{head}<body>{top}{side if rng.random() < 0.5 else ''}{main}{side if rng.random() < 0.5 else ''}{after}{foot}</body></html>"
        yield page[: rng.randrange(len(page) // 2, len(page))] if rng.random() < 0.1 else page


def training_sequences(page: list[Leaf], most: int = SAMPLE_BLOCKS) -> list[tuple[np.ndarray, np.ndarray]]:
    """A page three times, with more and more of its path hidden; of a long page half of ``most`` blocks from either end."""
    labels = np.array(weak_labels(page), np.float64)
    if len(page) > most:
        page, labels = page[: most // 2] + page[-(most // 2) :], np.concatenate((labels[: most // 2], labels[-(most // 2) :]))
    return [(vectors([page], hide), labels) for hide in range(3)] if page else []


def train(pages: DataFrame, *, html_col: str = "html", id_col: str = "page_id", sample_pages: int = SAMPLE_PAGES, sample_blocks: int = SAMPLE_BLOCKS, templates: int = 160) -> Labeller:
    """Fits on about ``sample_pages`` pages of the table, drawn by hash of id and html, and ``templates`` invented ones.

    Executors send vectors of at most ``sample_blocks`` blocks a page, never the pages.
    """
    schema = T.StructType([T.StructField("x", T.BinaryType()), T.StructField("y", T.BinaryType())])
    total = pages.count()
    share = min(1.0, sample_pages / max(total, 1))
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit(29), id_col, F.col(html_col).cast("string")), 11).cast("double") / F.lit(float(1 << 53))

    def run(batches):
        for batch in batches:
            rows = [(x.astype(np.float16).tobytes(), y.astype(np.uint8).tobytes()) for h in batch.column(0) for x, y in training_sequences(leaf_blocks(h.as_py() or ""), sample_blocks)]
            yield arrow_batch(schema, [[x for x, _ in rows], [y for _, y in rows]])

    drawn = sorted({(bytes(r.x), bytes(r.y)) for r in pages.filter(hashed < share).select(F.col(html_col).cast("string")).mapInArrow(run, schema).toLocalIterator()})[: 3 * 2 * sample_pages]
    sequences = [(np.frombuffer(x, np.float16).reshape(-1, INPUT).astype(np.float64), np.frombuffer(y, np.uint8).astype(np.float64)) for x, y in drawn]
    sequences += [s for p in template_pages(templates) for s in training_sequences(leaf_blocks(p))]
    return Labeller().fit(sequences)


def extract_main_text(pages: DataFrame, model: Labeller | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", join: str = "\n") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars, n_blocks (blocks of main text).

    The blocks that the labeller calls main text, in page order.  A null or empty page, or
    one without main text, has an empty text.  Repeated rows are alike, each on its own;
    null ids and urls stay null; other columns are not read.  Broken markup is read as far
    as it goes: an unfinished tag at the end is dropped, its text before is kept.  Only script
    and style lose their content before it is judged.  A very long page is read whole, in
    memory in proportion to its blocks.  An empty table gives an empty result.
    """
    model = model or train(pages, html_col=html_col, id_col=id_col)
    shared = pages.sparkSession.sparkContext.broadcast({k: v.astype(np.float32) for k, v in model.p.items()})
    schema = T.StructType([T.StructField("page_id", pages.schema[id_col].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_blocks", T.LongType())])
    hidden = model.h

    def run(batches):
        own = Labeller(hidden)
        own.p = shared.value
        for block in blocks(batches, "html", 2 << 20):
            parsed = [leaf_blocks(block.text_bytes(i).decode("utf-8", "replace")) for i in range(block.n)]
            chosen = [[b.text for b, k in zip(page, keep, strict=True) if k] for page, keep in zip(parsed, own.label(parsed), strict=True)]
            texts = [join.join(c) for c in chosen]
            yield arrow_batch(schema, [block.rows.column(0), block.rows.column(1), texts, [len(t) for t in texts], [len(c) for c in chosen]])

    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, schema)

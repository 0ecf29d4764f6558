"""The ten operators against brute force, round trips and held-out accuracy, and the edge cases of each."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import chat_format, decontamination, html_extract, language_id, lm_scoring, mixing, pii, quality_rules, simhash_dedup, substring_dedup
from corpusloom.llm.arrow_text import blocks
from corpusloom.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, size int, row string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def invented(rng, n):
    return " ".join("".join(rng.choice(("an", "be", "co", "dé", "er", "Fi", "ga")) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    base = [invented(rng, rng.randint(1, 120)) for _ in range(60)]
    out = base + base[:10] + [b + " tail words" for b in base[:10]] + [base[3] + "\n" + base[3], None, "", "   ", "x", "Ω" * 300, "ab " * 400, base[5] * 30]
    out += [f"call +1 ({rng.randint(100, 999)}) 555-0{rng.randint(100, 999)} or a.b@c-d.example.org, 10.0.0.{i} 999.1.1.1 4111 1111-1111 1111, 1.2.3.4.5" for i in range(5)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, 1, "r") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0], rows[61], (None, "null id text of some words", None, None, None, None)], DOCS).cache()


def rows_of(docs):
    return [(r.doc_id, r.text or "", r.source) for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---------------------------------------------------------------- 1


def test_bounded_subset_sum_is_exact_where_it_can_be():
    rng = np.random.default_rng(2)
    for _ in range(60):
        lengths = np.unique(rng.integers(1, 40, rng.integers(1, 6)))
        counts = rng.integers(1, 4, len(lengths))
        total = int((lengths * counts).sum())
        budget = int(rng.integers(0, total + 1))
        taken = mixing.bounded_subset_sum(lengths, counts, budget)
        assert (taken <= counts).all() and (taken * lengths).sum() <= budget
        floor = np.floor(counts * budget / total).astype(int) if budget < total else counts
        sums = {int((np.array(c) * lengths).sum()) for c in itertools.product(*(range(f, n + 1) for f, n in zip(floor, counts, strict=True)))}
        assert (taken * lengths).sum() == max(s for s in sums if s <= budget)


def test_bounded_subset_sum_of_long_lengths():
    assert mixing.bounded_subset_sum(np.array([80_000, 90_000]), np.array([1, 1]), 100_000).tolist() == [0, 1]
    rng = np.random.default_rng(7)
    for _ in range(20):
        lengths, budget = np.unique(rng.integers(40_000, 400_000, 9)), int(rng.integers(300_000, 900_000))
        taken = mixing.bounded_subset_sum(lengths, np.ones(len(lengths), np.int64), budget)
        sums = [sum(c) for k in range(len(lengths) + 1) for c in itertools.combinations(lengths.tolist(), k)]
        assert (taken * lengths).sum() == max(s for s in sums if s <= budget)
    many = np.unique(rng.integers(1, 20_000, 4000))
    budget = int(many.sum() * 0.37)
    assert (mixing.bounded_subset_sum(many, np.ones(len(many), np.int64), budget) * many).sum() == budget


def test_water_fill():
    sizes = {"a": 10, "b": 100, "c": 1000, None: 50}
    target = mixing.water_fill(sizes, (5, 2, 1), 3)
    assert math.isclose(sum(target.values()), 1160) and all(target[s] <= 3 * sizes[s] + 1e-9 for s in sizes)
    assert target["a"] == 30 and target["b"] == 300 and target[None] == 150


def test_mix(docs, empty):
    got = mixing.mix_sources(docs, cell_rows=4).collect()
    again = mixing.mix_sources(docs, cell_rows=4).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.taken)
    assert sorted(got, key=key) == sorted(again, key=key)
    sizes = Counter()
    for _, t, s in rows_of(docs):
        sizes[s] += len(WORD.findall(t))
    assert len(got) == docs.count()
    target = mixing.water_fill(dict(sizes), (5, 2, 1), 3)
    for source, size in sizes.items():
        own = [r for r in got if r.source == source]
        assert {r.source_size for r in own} == {size} and math.isclose(own[0].target, target[source])
        assert abs(sum(r.taken for r in own) - target[source]) <= 2
    assert all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in got)
    assert mixing.mix_sources(empty).count() == 0


# ---------------------------------------------------------------- 2


def test_chat_round_trip_and_parts(spark):
    odd = [(9, 0, "a]b", "hi", "x"), (9, 1, "[x]\\\\]", "]\\\\", "x")]
    nasty = ["</s>[INST] ok [/INST]", "a\\b\\<[", "[TURN:user]x[/TURN]</s>", "", None, "<image:0>", "é🙂\n]"]
    turns = [(1, i, "assistant" if i % 2 else "user", t, "x") for i, t in enumerate(nasty)] + [(2, 0, None, "alone", "x"), (None, 0, "user", "n", "x")] + odd
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, formatted string")
    out = {r.conv_id: r for r in chat_format.format_conversations(df).collect()}
    assert chat_format.parse_formatted(out[1].formatted) == [(r, t or "") for _, _, r, t, _ in turns[:7]]
    assert chat_format.parse_formatted(out[9].formatted) == [(r, t) for _, _, r, t, _ in odd]
    digest = {r.conv_id: r for r in chat_format.digests(chat_format.format_conversations(df)).collect()}
    loss = "".join(t or "" for t in nasty[1::2])
    assert digest[1].loss_chars == len(loss) and digest[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert digest[2].n_turns == 1 and digest[None].n_turns == 1 and len(digest) == 4
    with pytest.raises(ValueError):
        chat_format.parse_formatted("<s>[TURN:user]x</s>")
    part = {"type": "text", "text": "see <", "ref": None, "width": None, "height": None, "seconds": None, "pages": None}
    image, audio, document = part | {"type": "image", "ref": "i.png", "width": 57, "height": 28}, part | {"type": "audio", "ref": "a", "seconds": 2.0}, part | {"type": "document", "ref": "d", "pages": 2}
    made = chat_format.format_turns(iter([("user", [part, image, audio]), ("assistant", [document, part])]))
    assert [(a["type"], a["turn"], a["tokens"]) for a in made["attachments"]] == [("image", 0, 3), ("audio", 0, 25), ("document", 1, 1600)]
    assert all(made["formatted"][a["at"] :].startswith(f"<{a['type']}:{a['ordinal']}>") for a in made["attachments"]) and made["expanded_tokens"] == 1628
    assert chat_format.format_conversations(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 3


def edit_within(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        before, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (c != d))
    return min(row)


def test_contamination_against_brute_force(spark):
    rng = random.Random(4)
    items = [(i, invented(rng, rng.randint(3, 9))) for i in range(12)] + [(90, None), (91, "?!"), (92, "tiny")]
    docs = []
    for i in range(80):
        t = list(rng.choice(items[:12])[1])
        for _ in range(rng.randint(0, 8)):
            t[rng.randrange(len(t))] = rng.choice("abcxyz")
        docs.append((i, invented(rng, 6) + " " + "".join(t) + " " + invented(rng, 6)))
    docs += [(200, None), (201, ""), (0, docs[0][1])]
    got = decontamination.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_pieces=6).collect()
    want = Counter()
    for d, t in docs:
        for i, s in items:
            p, q = decontamination.normalise(s), decontamination.normalise(t)
            if p and edit_within(p, q) <= decontamination.budget(len(p)):
                want[d, i] += 1
    assert Counter((r.doc_id, r.item_id) for r in got) == want and want
    kept = decontamination.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_myers_distance():
    rng = random.Random(5)
    for _ in range(200):
        p, t = "".join(rng.choices("abc", k=rng.randint(1, 70))), "".join(rng.choices("abc", k=rng.randint(0, 90)))
        peq = {c: sum(1 << i for i, x in enumerate(p) if x == c) for c in set(p)}
        assert decontamination.best_distance(peq, len(p), t) == edit_within(p, t)


# ---------------------------------------------------------------- 4


def test_quality_base_and_verdict(spark, docs, empty):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = quality_rules.score_quality(docs, labels, carry=True).collect()
    want = Counter()
    for i, t, _ in rows_of(docs):
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        inside = {k + j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(8)}
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside)] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.kept and r.base_failed) and r.row.size in (1, None) for r in got)
    assert quality_rules.score_quality(empty, labels).count() == 0
    assert quality_rules.score_quality(docs, labels.limit(0)).filter("kept = base_failed").count() == 0


def test_quality_base_of_colliding_texts(spark):
    t = "a"
    while len(t) < 2048:
        t += t.translate(str.maketrans("ab", "ba"))
    u = t.translate(str.maketrans("ab", "ba"))
    words = [t, *"1234567"] + [u, *"1234567"]
    rows = [(1, f"{t}\n{u}\n{t}"), (2, " ".join(words)), (3, " ".join([*words, *words[:8]]))]
    got = {r.doc_id: (r.n_dup_lines, r.n_repeat_words) for r in quality_rules.score_quality(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    assert got == {1: (1, 0), 2: (0, 0), 3: (0, 16)}


def test_quality_finds_junk_and_keeps_clean(spark):
    d = "/root/testdata/sf0.01"
    judged = quality_rules.score_quality(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("not base_failed")
    assert judged.filter("quality = 1 and not kept").count() == 0
    assert judged.filter("quality = 0 and kept").count() <= 2


# ---------------------------------------------------------------- 5


def test_html_blocks_and_labels(spark):
    page = '<html><head><title>t</title><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href="/">home</a></li></ul></nav><article><h1>A &amp; B</h1><p>One\n two <b>three</b><p>Four &lt;5</article><footer>&copy; us</footer></body></html><p cla'
    assert [b.text for b in html_extract.leaf_blocks(page)] == ["t", "home", "A & B", "One two three", "Four <5", "© us"]
    rows = [(1, "u", page, "x"), (2, None, None, "x"), (3, "v", "", "x"), (1, "u", page, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.extract_main_text(df).collect()
    assert [(r.page_id, r.text) for r in sorted(got, key=lambda r: r.page_id)] == [(1, "A & B\nOne two three\nFour <5")] * 2 + [(2, ""), (3, "")]
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract_main_text(df.limit(0)).count() == 0


def block_f1(truth, found):
    right = sum(a and b for a, b in zip(truth, found, strict=True))
    return 2 * right / max(1, sum(truth) + sum(found))


@pytest.fixture(scope="module")
def labeller():
    return html_extract.Labeller().fit([s for p in html_extract.template_pages(200) for s in html_extract.training_sequences(html_extract.leaf_blocks(p))])


def test_html_held_out_templates(labeller):
    """As they are, without class names, and without semantic elements, where the rule can tell nothing."""
    pages = [html_extract.leaf_blocks(p) for p in html_extract.template_pages(150, seed=99)]
    truth = [t for page in pages for t in html_extract.weak_labels(page)]
    scores = [block_f1(truth, np.concatenate(labeller.label(pages, hide=hide)).tolist()) for hide in range(3)]
    print(scores, block_f1(truth, [True] * len(truth)))
    assert scores[0] > 0.985 and scores[1] > 0.96 and scores[2] > 0.9 and scores[2] > block_f1(truth, [True] * len(truth)) + 0.08


_PROSE = ["The river rose for three days before the bridge gave way, and nobody in the lower town had slept since.", "By the time the council met, the water had reached the second step of the library.", "Engineers from the province arrived on Friday with pumps, two boats and very little hope.", "They measured the piers twice, argued about the numbers, and sent for a larger crane.", "What remains is a row of stones, and a sign that still announces the speed limit."]
_LINKS = "".join(f'<div><a href="/{w}">{w}</a></div>' for w in ("Home", "World", "Business", "Sport", "Weather"))
# Pages without a telling name, with the main text as a person would mark it: * before a block that belongs to it.
GOLD = [
    ("<div><div>" + _LINKS + "</div><div><h1>*A bridge is lost</h1>" + "".join(f"<p>*{p}</p>" for p in _PROSE) + "</div><div>" + _LINKS + "<div>Copyright 2024 The Daily</div></div></div>"),
    ("<div class=x1>" + _LINKS + "</div><div class=q9><h1>*The flood</h1><h2>*Morning</h2>" + "".join(f"<p>*{p}" for p in _PROSE) + "<ul><li>*Two boats were lost in the first night.<li>*Nobody was hurt.</ul></div><div class=z7><div><a href=/a>About</a></div><div><a href=/b>Contact</a></div></div>"),
    ("<body><p><a href=/>Start</a></p><p><a href=/n>News</a></p><p><a href=/s>Shop</a></p>" + "".join(f"<p>*{p}</p><p>*{q}</p>" for p, q in zip(_PROSE, _PROSE[::-1], strict=True)) + "<p><a href=/i>Imprint</a></p><p><a href=/p>Privacy</a></p></body>"),
]


def test_html_gold_pages_without_telling_names(labeller):
    pages = [html_extract.leaf_blocks(g) for g in GOLD]
    truth = [b.text.startswith("*") for page in pages for b in page]
    network = block_f1(truth, np.concatenate(labeller.label(pages)).tolist())
    rule = block_f1(truth, [x for page in pages for x in html_extract.weak_labels(page)])
    print(network, rule)
    assert network > rule + 0.15


def test_html_keeps_what_is_no_script(labeller):
    texts = lambda h: [b.text for b in html_extract.leaf_blocks(h)]
    assert texts("<p>Energy is <math><mi>E</mi></math> here.</p>") == ["Energy is E here."]
    assert texts('<nav><svg class="i"/></nav><article><svg-icon></svg-icon><p>a</p><object data=x>b</object><noscript><p>c</p></noscript></article>') == ["a", "b", "c"]
    assert texts("<p>x<script>if (a < b) '</p>';</script >y<style>p</style>z</p><scripture>w</scripture><script>open") == ["xyz", "w"]


def test_html_long_and_deep_pages(labeller):
    began = time.process_time()
    deep = html_extract.leaf_blocks("<div>x" * 8000)
    html_extract.vectors([deep])
    assert len(deep) == 8000 and time.process_time() - began < 1
    import tracemalloc

    pages = [html_extract.leaf_blocks("<p>word</p>" * n) for n in (4000, *[5] * 127)]
    tracemalloc.start()
    labels = labeller.label(pages)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [len(x) for x in labels] == [len(p) for p in pages] and peak < 60 << 20


# ---------------------------------------------------------------- 6


def brute_repeats(texts, length):
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        out.append((len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("length,seed", [(200, 64), (40, 16)])
def test_repeats_against_brute_force(docs, length, seed):
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.remove_repeats(docs, length=length, seed=seed).collect())
    rows = rows_of(docs)
    want = Counter((i, *x) for (i, _, _), x in zip(rows, brute_repeats([t.encode() for _, t, _ in rows], length), strict=True))
    assert got == want


def test_repeats_long_text_crosses_segments(monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    data[3000:3900] = data[100:1000]
    monkeypatch.setattr(substring_dedup, "SEGMENT", 700)
    first, last, place, _ = substring_dedup.anchored_runs(data, np.array([0, 5000]))
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)])
    assert sorted(covered) == list(range(4801))
    assert ((place >= last) & (place <= first + 136)).all()


def test_suffix_family_levels():
    rng, family, seen = np.random.default_rng(1), substring_dedup.SuffixFamily(), Counter()
    for k in range(40):
        batch = [bytes(rng.integers(0, 3, 5).astype(np.uint8)) for _ in range(50)]
        matched = family.add(np.array(batch, "S5"), np.full((50, 3), k))
        counts = Counter(batch)
        assert matched.tolist() == [bool(seen[p] or counts[p] > 1) for p in batch]
        seen += counts
        sizes = [len(level["suffix"]) for level in family.levels]
        assert all(a > 2 * b for a, b in zip(sizes[:-1], sizes[1:], strict=True))
        assert all((level["suffix"][1:] > level["suffix"][:-1]).all() for level in family.levels)
    e = family.entries()
    assert {x.ljust(5, b"\0"): bool(m) for x, m in zip(e["suffix"].tolist(), e["matched"], strict=True)} == {p: c > 1 for p, c in seen.items()}


def test_common_prefix():
    a, b = np.array([b"abcd", b"ab\0d", b"xbcd", b"abcd"], "S4"), np.array([b"abcd", b"ab\0e", b"abcd", b"abce"], "S4")
    assert substring_dedup.common_prefix(a, b).tolist() == [4, 3, 0, 3]


def test_index_of_runs_is_far_from_quadratic():
    def seconds(n):
        rng = np.random.default_rng(n)
        names = rng.integers(1, 255, (n, 24)).astype(np.uint8)
        columns = [substring_dedup.anchor_of(names.view("S24").ravel()), substring_dedup._binary(names.view("S24").ravel())] + [np.arange(n)] * 3 + [np.full(n, 4)]
        batch = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=list("abcdef"))
        began = time.process_time()
        for _ in substring_dedup._index_runs(batch.slice(at, 10_000) for at in range(0, n, 10_000)):
            pass
        return time.process_time() - began

    seconds(20_000)
    assert seconds(1_600_000) < 32 * seconds(200_000)  # eight times the rows: a quadratic cost would be 64 times as high


def test_index_of_suffixes_is_bounded():
    import tracemalloc

    def stretches(n, anchors, rng):
        """Rows as stage 2 gets them, and the windows that they have: each stretch has its anchor in the middle, and half of them a neighbour's left side."""
        for k in range(0, n, 1000):
            anchor = np.sort(np.arange(k, min(n, k + 1000)) * anchors // n)
            raw = rng.integers(97, 123, (len(anchor), 330)).astype(np.uint8)
            raw[1::2, :230] = raw[0::2, :230]
            raw[:, 230] = 65 + np.arange(len(anchor)) % 2
            data = [r.tobytes() for r in raw]
            yield pa.RecordBatch.from_arrays([pa.array(anchor), *(pa.array(np.full(len(anchor), x) + np.arange(k, k + len(anchor)) * y) for x, y in ((0, 1), (7, 0), (1, 0), (5, 0), (133, 0))), pa.array(data, pa.binary())], names=list("abcdefg"))

    def peak(n, anchors):
        found = Counter()
        tracemalloc.start()
        for out in substring_dedup._index_suffixes(200)(stretches(n, anchors, np.random.default_rng(n))):
            found.update(zip(out.column(2).to_pylist(), out.column(3).to_pylist(), strict=True))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found == {(5, 235): n}  # the 31 windows of the common side
        return most

    # 131 suffixes of 200 bytes a stretch were 26 KB each, and they stayed.
    assert peak(16_000, 4_000) < 1.1 * peak(4_000, 1_000) < 150 << 20
    assert peak(8_000, 1) < 150 << 20


@pytest.mark.parametrize("at_once", [1, 50, 1 << 16])
def test_suffixes_by_distance_against_brute_force(at_once):
    rng = np.random.default_rng(5)
    size = rng.integers(8, 20, 40)
    offsets = np.concatenate(([0], np.cumsum(size)))
    place = np.array([rng.integers(n - 8, 13) for n in size])
    # A byte tells how far the anchor is, and a bit: equal windows have their anchors at equal distances.
    texts = [bytes((2 * (20 + p - np.arange(n)) + (rng.random(n) < 0.2)).astype(np.uint8)) for n, p in zip(size, place, strict=True)]
    got = substring_dedup.matched_windows(np.frombuffer(b"".join(texts), np.uint8), offsets, place, 8, at_once)
    seen = Counter((p - i, t[i : i + 8]) for t, p in zip(texts, place, strict=True) for i in range(len(t) - 7))
    assert 0 < got.sum() < sum(seen.values())
    for row, t, p in zip(got, texts, place, strict=True):
        assert row.tolist() == [i < len(t) - 7 and seen[p - i, t[i : i + 8]] > 1 for i in range(got.shape[1])]


def test_whole_anchors_are_not_cut():
    rng = np.random.default_rng(6)
    for rows in (1, 7, 60):
        anchor = np.sort(rng.integers(0, 40, 300))
        cut = np.sort(rng.integers(0, 300, 12))
        parts = [p.column(0).to_numpy() for p in substring_dedup.whole_anchors((pa.RecordBatch.from_arrays([pa.array(a)], ["anchor"]) for a in np.split(anchor, cut)), rows)]
        assert np.concatenate(parts).tolist() == anchor.tolist()
        assert all(a[-1] != b[0] and len(a) >= rows for a, b in zip(parts[:-1], parts[1:], strict=True))


def test_repeats_of_thue_morse_strings_and_odd_ids(spark):
    t = "a"
    while len(t) < 2048:
        t += t.translate(str.maketrans("ab", "ba"))
    rows = [(1, t), (2, t.translate(str.maketrans("ab", "ba"))), (-(1 << 62), "x" * 500), (None, "y" * 500), (0, None), (None, "y" * 500), (None, "z")]
    got = Counter(tuple(r) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter((i, *x) for (i, _), x in zip(rows, brute_repeats([(x or "").encode() for _, x in rows], 200), strict=True))


def test_repeats_empty(empty):
    assert substring_dedup.remove_repeats(empty).count() == 0


# ---------------------------------------------------------------- 7


def brute_fingerprint(t):
    w = WORD.findall(t.translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_classes(fps):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(parent, 2):
        if (a ^ b).bit_count() <= 3:
            parent[find(a)] = find(b)
    return {f: find(f) for f in parent}


def test_near_duplicates_against_brute_force(docs, empty):
    rows = rows_of(docs)
    prints = [brute_fingerprint(t) for _, t, _ in rows]
    classes = brute_classes(prints)
    least = {}
    for (i, _, _), f in zip(rows, prints, strict=True):
        least[classes[f]] = min((x for x in (least.get(classes[f]), i) if x is not None), default=None)
    want = Counter((i, f"{f:016x}", least[classes[f]]) for (i, _, _), f in zip(rows, prints, strict=True))
    for codes in (1, 2):
        assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash_dedup.near_duplicates(docs, codes=codes).collect()) == want
    assert simhash_dedup.near_duplicates(empty).count() == 0


def test_golay_keys_never_miss():
    rng = random.Random(6)
    table = simhash_dedup.segment_codewords()
    for bit in range(16):
        x = np.arange(1 << 16)
        own, other = table[x], table[x ^ (1 << bit)]
        assert ((own[:, :, None] == other[:, None, :]) & (own[:, :, None] >= 0)).any((1, 2)).all()
    fps = [rng.getrandbits(64) for _ in range(40)]
    pairs = [(f, f ^ sum(1 << b for b in rng.sample(range(64), k))) for f in fps for k in (1, 2, 3)]
    for codes in (1, 2):
        for a, b in pairs:
            index, key = simhash_dedup.bucket_keys(np.array([a, b], np.uint64), codes)
            assert set(key[index == 0]) & set(key[index == 1])


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    got = {r.vertex: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


# ---------------------------------------------------------------- 8

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, value):
    d = re.sub("[^0-9]", "", value)
    luhn = sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in value.split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]


def test_base_spans_against_re(spark, docs, empty):
    rng = random.Random(8)
    pieces = ["a@b.co", "x_@y.z.w", "@", ".", "1.2.3.4", "256.1.1.1", "001.002.003.004.5", "4111 1111 1111 1111", "4111-1111-1111-1111", "+44 20 7946 0958", "+1", "é🙂", " ", " ", "-", "12345", "(0)", "\n", "q.r_s@t.u", "7" * 60]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))), None, None, None, None) for i in range(400)]
    both = docs.unionByName(spark.createDataFrame(rows, DOCS))
    want = Counter()
    for i, t, _ in rows_of(both):
        spans = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, t) if valid(k, m.group())]
        want[(i, *(sum(s[0] == k for s in spans) for k in PATTERNS), hashlib.sha256(",".join("%s:%d:%d" % s for s in spans).encode()).hexdigest())] += 1
    got = pii.span_digests(pii.sanitise(both)).collect()
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    assert pii.sanitise(empty).count() == 0


def brute_disclosure(rows, chance=0.01):
    """(text, word) -> disclosure, from plain counts over all documents."""
    texts, copies = sorted(set(rows)), Counter(rows)
    words, entities, sketches = [], [], []
    for t in texts:
        w = [x.lower() for x in re.findall(r"[^\W_]+", re.sub(PATTERNS["email"], " ", t))]
        w = [x for x in w if len(x) >= 3 and not re.search("[0-9]", x)]
        words.append(set(w))
        sketches.append(frozenset([tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))]))
        entities.append({m.group().lower() for k, p in PATTERNS.items() for m in re.finditer(p, t) if valid(k, m.group())})
    of = lambda e=None, w=None: [i for i in range(len(texts)) if (e is None or e in entities[i]) and (w is None or w in words[i])]
    size = lambda where: sum(copies[texts[i]] for i in where)
    sets = {}
    for e in sorted({e for s in entities for e in s}):
        if len(of(e)) >= 3:
            sets.setdefault(tuple(of(e)), e)
    tested = [(e, w) for e in sets.values() for w in sorted({w for i in of(e) for w in words[i]}) if len(of(e, w)) >= 3]
    out = {}
    for e, w in tested:
        ic, own = math.log(len(rows) / size(of(e))), of(e, w)
        d = math.log(len(rows) * size(own) / (size(of(e)) * size(of(None, w)))) / ic if ic > 0 else 0
        # The texts of this test are copies or quite different, so the sketches tell as the shingles do.
        if d >= 0.75 and len(own) * ic >= math.log(len(tested) / chance) and len({sketches[i] for i in own}) == len(own):
            for i in own:
                out[texts[i], w] = max(d, out.get((texts[i], w), 0))
    return out


def test_disclosing_words_against_brute_force(spark):
    rng = random.Random(5)
    texts = [invented(rng, rng.randint(20, 60)) for _ in range(300)]
    for k in range(6):  # a signature that repeats word for word in otherwise different texts
        texts[k] += " best regards Zorbaq Quill jane@corp.example.com"
    for k in range(6, 12):
        texts[k] = f"Wexel {texts[k]} +44 20 7946 0958 and more"
    texts[12] += " Wexel"
    for k in range(13, 17):  # copies prove nothing
        texts[k] = f"{texts[13]} Klomp tom@corp.example.com tail{k - 13}"
    many = " ".join(f"u{i}@list.example.org" for i in range(40))
    for k in range(20, 25):
        texts[k] += f" Directory {many}"
    texts += [texts[0]] * 5
    got = {}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.sanitise(df).collect():
        for s in r.spans:
            if s.kind == "term":
                got[texts[r.doc_id], texts[r.doc_id][s.start : s.stop].lower()] = s.label
    want = {k: v for k, v in brute_disclosure(texts).items() if k[0] not in texts[13:17]}
    assert {w for _, w in got} >= {"zorbaq", "quill", "wexel", "directory"} and "klomp" not in {w for _, w in got}
    assert got.keys() == want.keys()
    assert all((got[k] == "") == (want[k] >= 0.9) for k in got)


def test_disclosing_words_go(spark):
    rows = [(i, f"intro{i} text alpha{i} beta{i} met Zorbaq about jane@corp.example.com on gamma{i} day{i} so") for i in range(5)]
    rows = [(i, t + " " + " ".join(chr(97 + (i * 7 + k) % 26) * 4 for k in range(12))) for i, t in rows]
    rows += [(100 + i, f"the plain common words number {i} about met nothing of note") for i in range(300)] + [(500, None)]
    got = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(5):
        assert "Zorbaq" not in got[i].sanitised and "[EMAIL]" in got[i].sanitised and f"alpha{i}" in got[i].sanitised and "about" in got[i].sanitised
    assert got[100].sanitised == rows[5][1] and got[500].sanitised is None


def test_many_matches_in_one_text(spark):
    text = " ".join(f"u{i}@h.example" for i in range(1500))
    row = pii.sanitise(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(s.start, s.stop) for s in row.spans] == [m.span() for m in re.finditer(r"\S+", text)] and row.sanitised == " ".join(["[EMAIL]"] * 1500)


# ---------------------------------------------------------------- 9


def test_code_matrix_is_apart():
    for n in (2, 3, 4, 6, 9, 30):
        code = language_id.code_matrix(n)
        gap = min((code[i] != code[j]).sum() for i, j in itertools.combinations(range(n), 2))
        assert gap >= (1 if n == 2 else 2 if n <= 3 else 4)


def test_features_by_slices_are_those_of_the_block():
    texts = pa.array([None, "", "x", "Ünï cödé", "ab " * 50] * 7)
    (block,) = blocks([pa.RecordBatch.from_arrays([texts], ["text"])], "text")
    pieces = list(language_id.slices(block, 4))
    assert [p.n for p in pieces] == [4] * 8 + [3] and pa.concat_arrays([p.rows.column(0) for p in pieces]).equals(texts)
    assert np.array_equal(np.concatenate([language_id.features(p) for p in pieces]), language_id.features(block))


def test_language_held_out(spark, docs, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = language_id.fit(d, training=~held)
    found = language_id.identify(d, model).join(d.filter(held).select("doc_id", "lang"), "doc_id")
    assert found.filter("lang_pred = lang").count() >= 0.98 * found.count() and found.filter("score < 0 or score > 1").count() == 0
    edge = {r.doc_id: r.lang_pred for r in language_id.identify(docs.filter("text is null or trim(text) = '' or doc_id = 75"), model).collect()}
    assert set(edge.values()) - {"en", "de", "fr", "es"} == {"und"}
    assert language_id.identify(empty, model).count() == 0
    assert language_id.fit(empty, training=F.lit(True)) is None
    assert {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}


# ---------------------------------------------------------------- 10


def test_lm_base_against_brute_force(docs, empty):
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    for head in (1 << 19, 20):
        got = lm_scoring.score_texts(docs, training=~held, head_words=head, rounds=3).collect()
        tokens = [(i, [*WORD.findall(t.translate(LOWER)), None]) for i, t, _ in rows_of(docs)]
        counts = Counter(w for i, ws in tokens if i is not None and zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
        n, v = sum(counts.values()), len(counts)
        want = Counter((i, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, ws in tokens)
        assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm_scoring.score_texts(empty, training=F.lit(True), rounds=1).count() == 0


def test_lm_beats_unigrams_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    sums = lm_scoring.score_texts(d, training=~held).join(d.filter(held).select("doc_id"), "doc_id").agg(F.sum("base_score").alias("b"), F.sum("score").alias("s")).first()
    assert sums.s > sums.b


def test_lm_class_factor_is_normalised():
    weights = np.random.default_rng(0).normal(size=(lm_scoring.ROWS, lm_scoring.CLASSES)).astype(np.float32)
    assert np.allclose(np.exp(lm_scoring.log_softmax(weights, np.arange(500))).sum(1), 1, atol=1e-4)


def test_lm_word_factor_is_normalised_and_learns():
    rng = np.random.default_rng(3)
    word, group, kind = rng.integers(0, 30, 3000), rng.integers(0, 4, 3000), np.full(3000, 30)
    before = rng.integers(0, 3, 3000)
    word[group == 1] = np.where(before[group == 1] == 2, 5, word[group == 1])
    names = np.array([11, 22, 33, 44], np.uint64)
    code, n = np.unique(group << 40 | word << 7 | before, return_counts=True)
    g, c = code >> 40, (code & ((1 << 40) - 1)).astype(np.uint32)
    part = lm_scoring.unpack_ngrams(lm_scoring.pack_ngrams(names[g], np.full(len(g), 30, np.uint8), c, n))
    unigrams = np.bincount(word, minlength=30) / len(word) * 0.9  # a tenth is for unknown words
    counts = lm_scoring.group_counts([part, (np.array([99], np.uint64), np.array([30], np.uint8), np.array([7 << 7], np.uint32), np.array([1]))])
    assert counts[0].tolist() == [11, 22, 33, 44] and counts[4].sum() == 3000
    table = lm_scoring.fit_words(counts, lambda w, k: unigrams[w])
    every = np.append(np.arange(30), lm_scoring.NO_WORD)
    p0 = np.append(unigrams, 0.1)
    for name in (11, 22, 33, 44, 99):
        for b in range(4):
            p = p0 * 10 ** lm_scoring.word_factor(table, np.full(31, name, np.uint64), (every << 7 | b).astype(np.uint32))
            assert math.isclose(p.sum(), 1, abs_tol=1e-9)
            if name == 22 and b == 2:
                assert p[5] > 0.8
            if name == 99:
                assert np.allclose(p, p0)
    better = lm_scoring.word_factor(table, names[group], (word << 7 | before).astype(np.uint32))
    assert better.mean() > 0.1 * (1 / 4)


def test_packed_numbers_come_back():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 500):
        a = np.sort(rng.integers(0, 1 << 62, n)).astype(np.uint64)
        assert lm_scoring.unpack_sorted(lm_scoring.pack_sorted(a)).tolist() == a.tolist()


def test_lm_scores_do_not_depend_on_the_layout(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    got = []
    for k, n in enumerate((1, 64)):
        docs.repartition(n, "doc_id").write.parquet(str(tmp_path / str(k)))
        got.append({r.doc_id: r for r in lm_scoring.score_texts(spark.read.parquet(str(tmp_path / str(k))), training=~held, rounds=4, shard_tokens=20_000).collect()})
    assert got[0].keys() == got[1].keys()
    assert all(math.isclose(a.score, got[1][i].score, rel_tol=1e-6) and a.n_known == got[1][i].n_known for i, a in got[0].items())


def test_lm_table_grows_and_repeated_blocks_stay(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat the cat sat"), (None, None)] * 3, "doc_id long, text string")
    got = lm_scoring.score_texts(docs, training=F.lit(True), rounds=2)
    rows = Counter(tuple(r) for r in got.collect())
    assert len(rows) == 2 and set(rows.values()) == {3} and {r[1] for r in rows} == {10, 1}
    sizes = []
    for n in (200, 2000):
        rng = random.Random(n)
        text = spark.createDataFrame([(i, invented(rng, 40)) for i in range(n)], "doc_id long, text string").select("text")
        counts = lm_scoring.count_words(text)
        vocabulary, _ = lm_scoring.build_vocabulary(counts, text)
        learnt = lm_scoring.count_events(text, spark.sparkContext.broadcast(vocabulary), 4).filter("key >= 0")
        sizes.append(sum(len(lm_scoring.unpack(bytes(r.blob), *lm_scoring._GROUPS)[6]) for r in learnt.collect()))
    assert sizes[1] > 3 * sizes[0] > 0

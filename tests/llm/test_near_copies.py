"""Near copies against brute force over all pairs, and the pipeline's stage."""

import itertools
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from corpusloom.llm import near_copies, simhash_dedup
from corpusloom.llm.arrow_text import blocks

DOCS = "doc_id long, text string"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.random()}"
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    out = [None, "", "  ", "Just two", "just TWO"]
    for n in (30, 80, 200, 200, 400):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(n)]
        out += [" ".join(base)] * 2 + [edited(rng, base, max(1, n * k // 100)) for k in (1, 1, 2, 2, 2, 3, 3, 4, 6)]
    return out


def brute(texts):
    sets = [shingles(t) for t in texts]
    group = list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = [new if g == old else g for g in group]
    return group


def test_near_copies_against_brute_force(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert got == dict(enumerate(brute(texts)))
    assert near_copies.near_copies(docs.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d e f"), (7, "A b c d e f"), (7, "A b c d e f"), (None, "x y")], DOCS)
    assert sorted(near_copies.near_copies(nulls).collect(), key=str) == sorted([(None, 7), (7, 7), (7, 7), (None, None)], key=str)


def test_stage_drops_copies_beyond_three_bits(spark, texts):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    (block,) = blocks([batch], "text")
    prints = simhash_dedup.fingerprints(block).tolist()
    group = brute(texts)
    assert any((prints[i] ^ prints[g]).bit_count() > 3 for i, g in enumerate(group))
    kept = corpus_pipeline.simhash_near_dedup(spark, spark.createDataFrame(list(enumerate(texts)), DOCS), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(group))


def hash_sets(rng, sizes):
    hashes = [np.sort(rng.integers(0, 1 << 64, n, dtype=np.uint64)) for n in sizes]
    return hashes, np.concatenate(([0], np.cumsum(sizes)))


def test_fingerprints_of_a_set_are_majorities():
    hashes, offsets = hash_sets(np.random.default_rng(1), [3, 0, 1, 254, 255, 256, 1000])
    full, prints = near_copies.sketches(np.concatenate(hashes), offsets)
    assert full.tolist() == [0, 2, 3, 4, 5, 6] and prints.shape == (6, near_copies.PRINTS)
    for i, own in zip(full, prints, strict=True):
        for step, got in zip(near_copies._STEPS, own.tolist(), strict=True):
            h = near_copies.mix64(hashes[i] + step).tolist()
            assert got == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("parts,keys,long", [(1, 1 << 21, 64), (3, 1 << 14, 1)])
def test_golay_tables_link_pairs_at_the_similarity_and_no_others(parts, keys, long):
    """Pairs that share 80 of 100 hashes, in one fingerprint some 10 bits apart: simhash_dedup's keys, for 3 bits, miss most."""
    rng, n = np.random.default_rng(2), 300
    hashes, _ = hash_sets(rng, [100] * n)
    pairs = [np.sort(x) for h in hashes for x in (h[:90], np.concatenate((h[:80], h[90:])))]
    _, prints = near_copies.sketches(np.concatenate(pairs), np.arange(0, 180 * n + 1, 90))
    assert (np.bitwise_count(prints[::2, 0] ^ prints[1::2, 0]) > 3).mean() > 0.9
    sid, size = np.arange(2 * n), np.full(2 * n, 90)
    found = set()
    for table in range(near_copies.TABLES):
        records = near_copies.table_records(sid, prints, size, table)
        for part in range(parts):
            found |= {tuple(sorted(x)) for x in near_copies.candidate_links(records, part, parts, keys, long).tolist()}
    assert found == {(2 * i, 2 * i + 1) for i in range(n)}


def test_many_near_copies_make_few_links():
    rng, n = np.random.default_rng(3), 1500
    base = rng.integers(0, 1 << 64, 100, dtype=np.uint64)
    sets = [np.sort(np.concatenate((base[rng.permutation(100)[:93]], rng.integers(0, 1 << 64, 7, dtype=np.uint64)))) for _ in range(n)]
    _, prints = near_copies.sketches(np.concatenate(sets), np.arange(0, 100 * n + 1, 100))
    links = np.concatenate([near_copies.candidate_links(near_copies.table_records(np.arange(n), prints, np.full(n, 100), t)) for t in range(near_copies.TABLES)])
    distinct = np.unique(links, axis=0)
    assert len(links) < near_copies.TABLES * n and len(distinct) < 3 * n
    assert not near_copies.least_connected(distinct[:, 0], distinct[:, 1], n).any()


def test_least_connected():
    rng = np.random.default_rng(4)
    for n, m in ((1, 0), (50, 20), (300, 250), (300, 3000)):
        u, v = rng.integers(0, n, (2, m))
        want = list(range(n))
        for _ in range(60):
            for a, b in zip(u, v, strict=True):
                want[a] = want[b] = min(want[a], want[b])
        assert near_copies.least_connected(u, v, n).tolist() == want
    path = np.arange(99_999)
    assert not near_copies.least_connected(path + 1, path, 100_000).any()


def test_parts_and_long_keys_connect_alike(spark, texts, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    monkeypatch.setattr(near_copies, "PART_SETS", len(texts) // 3)
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()} == dict(enumerate(brute(texts)))

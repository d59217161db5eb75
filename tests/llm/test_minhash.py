import re

import numpy as np
import pytest

from sparkwhy.llm import minhash
from sparkwhy.llm.components import connected_components, linked
from sparkwhy.llm.shingles import MinHasher, WordHashes, overlap, shingle_set, words_of


def plain_sets(texts, width):
    out = []
    for t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append(frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    return out


def plain_components(ids, sets, percent):
    up = {k: k for k in range(len(ids))}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    lowest = {}
    for k, i in enumerate(ids):
        lowest[root(k)] = min(lowest.get(root(k), i), i)
    return {i: lowest[root(k)] for k, i in enumerate(ids)}


def near_copies(n, seed=4):
    """A few originals, each with copies that differ in more and more words."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(6):
        base = [f"w{x}" for x in rng.integers(0, 500, 120)]
        for k in range(n):
            words = list(base)
            for at in rng.integers(0, len(words), k % 9):
                words[at] = f"w{rng.integers(500, 10**6)}"
            out.append(" ".join(words))
    return out


def test_words_split_at_ascii_white_space_only():
    text = "A\u00a0B c\x0bD\x1ce\u2003f\tÀ"
    assert [w.decode() for w in words_of(text)] == ["a\u00a0b", "c", "d\x1ce\u2003f", "À"]


def test_short_texts_are_one_shingle():
    cache = WordHashes()
    assert len(shingle_set("a b", 3, cache)) == 1 and len(shingle_set("", 3, cache)) == 0
    assert shingle_set("a b", 3, cache)[0] not in (shingle_set("a b a", 3, cache)[0], shingle_set("b a", 3, cache)[0])


def test_word_cache_forgets_but_hashes_stay_equal():
    small, large = WordHashes(5), WordHashes()
    text = " ".join(f"w{k % 50}" for k in range(500))
    assert (shingle_set(text, 3, small) == shingle_set(text, 3, large)).all()


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:300], rng.integers(0, 2**63, 100, dtype=np.uint64)]))
    s = MinHasher(2000)([a, b, np.empty(0, np.uint64)])
    true = overlap(a, b) / (len(a) + len(b) - overlap(a, b))
    assert abs((s[0] == s[1]).mean() - true) < 0.05 and (s[2] == 0xFFFFFFFF).all()


def test_least_matches_grow_and_prune_only_what_is_unlikely():
    needed = minhash.least_matches(96, 0.85, 1e-7)
    assert len(needed) == 6 and needed == sorted(needed) and needed[-1] < 0.85 * 96
    rng = np.random.default_rng(1)
    matches = rng.random((200_000, 96)) < 0.85
    missed = np.zeros(len(matches), bool)
    for k, least in enumerate(needed):
        missed |= matches[:, : 16 * (k + 1)].sum(1) < least
    assert missed.mean() < 1e-4


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_equals_brute_force(spark, sf, width, percent):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    texts = [r["text"] for r in rows] + near_copies(20)
    ids = list(range(len(texts)))
    table = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    sets = plain_sets(texts, width)
    expected = plain_components(ids, sets, percent)
    # blocks of a few members each, so that large groups take both rounds
    for options in ({}, {"block_members": 5, "block_shingles": 500}):
        found = {r["doc_id"]: r for r in minhash.near_duplicates(table, width=width, percent=percent, **options).collect()}
        assert {k: found[k]["component_id"] for k in ids} == expected
        assert all(found[k]["n_shingles"] == len(sets[k]) and found[k]["kept"] == (expected[k] == k) for k in ids)


def test_components_equal_a_plain_search(spark):
    rng = np.random.default_rng(7)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2000 + k) for k in range(1, 80)]
    links = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    found, steps = ({r["id"]: r["component"] for r in connected_components(links, most).collect()} for most in (200_000, 10))
    assert found == steps
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        low, high = sorted((root(a), root(b)))
        up[high] = low
    expected = {x: root(x) for x in up}
    assert {k: v for k, v in expected.items() if any(k in p and p[0] != p[1] for p in pairs)} == found
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_inside_large_groups_are_found_block_by_block(spark):
    """Numbers in one group are linked if they differ by one: a chain that any block sees only parts of."""

    def compare(left, right):
        rows = left + (right or [])
        for i, a in enumerate(left):
            for b in right or rows[i + 1 :]:
                if abs(a[0] - b[0]) == 1:
                    yield a[0], b[0]

    members = spark.createDataFrame([(g, 100 * g + k, 1) for g in range(3) for k in range(40)], "group long, id long, weight int")
    payload = members.select("id").withColumn("payload", members["id"].cast("string").cast("binary"))
    links = linked(members, payload, compare, 6)
    found = {r["id"]: r["component"] for r in connected_components(links).collect()}
    assert found == {100 * g + k: 100 * g for g in range(3) for k in range(40)}


@pytest.mark.parametrize("ratio", [0.8, 1.0])
def test_size_classes_lose_no_link(spark, ratio):
    """Ids are linked if their sizes differ by no more than the ratio, sizes just at it included."""
    rng = np.random.default_rng(12)
    sizes = {k: int(s) for k, s in enumerate(np.concatenate([rng.integers(1, 4000, 150), [80, 100, 125, 97, 3200, 4000, 2560], np.full(20, 777)]))}

    def compare(left, right):
        rows = left + (right or [])
        for i, a in enumerate(left):
            for b in right or rows[i + 1 :]:
                x, y = int(a[2]), int(b[2])
                if min(x, y) >= ratio * max(x, y):
                    yield a[0], b[0]

    members = spark.createDataFrame([(1, k, 1, s) for k, s in sizes.items()], "group long, id long, weight int, size long")
    payload = members.select("id", members["size"].cast("string").cast("binary").alias("payload"))
    found = {r["id"]: r["component"] for r in connected_components(linked(members, payload, compare, 1000, 8, ratio)).collect()}
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, x in sizes.items():
        for b, y in sizes.items():
            if a < b and min(x, y) >= ratio * max(x, y):
                low, high = sorted((root(a), root(b)))
                up[high] = low
    assert found == {k: root(k) for k in up}

import collections
import random
import re

import pytest
from texts import ODD, awkward, rows

from tidemark.llm import minhash
from tidemark.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}


def expected(docs, k, percent):
    sets = [(i, shingles(t, k)) for i, t in docs]
    parent = {i: i for i, _ in docs if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[a + 1 :]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return collections.Counter((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets)


def got(df):
    return collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows(df))


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_awkward(spark, k, percent):
    assert got(minhash.near_dedup(awkward(spark), shingle=k, percent=percent)) == expected(ODD, k, percent)


def test_empty(spark):
    assert got(minhash.near_dedup(awkward(spark, []))) == {}


def test_documents(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(minhash.op9_minhash_near_dedup(spark, sf)) == expected(docs, 3, 85)


def copies(seed, n, spread):
    """Copies of a few texts with edits, so that many pairs of a group aren't linked directly."""
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(5000)}" for _ in range(120)] for _ in range(4)]
    docs = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(spread)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        docs.append((1000 - i, " ".join(words)))
    return docs


@pytest.mark.parametrize("block", [3, 1000])
def test_groups_that_hang_together_by_chains(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "SALT_ROWS", 20)
    docs = copies(3, 150, 7)
    want = expected(docs, 3, 85)
    assert 5 < len({c for _, _, c, _ in want}) < 140
    assert got(minhash.near_dedup(awkward(spark, docs), shingle=3, percent=85)) == want


def test_ids_with_several_texts(spark):
    """Such rows hang together, and so does what any of them is linked with."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    docs = [(3, a), (5, a), (5, b), (6, b + " tail"), (8, c), (8, a), (9, "alone")]
    assert {r["doc_id"]: r["component_id"] for r in rows(minhash.near_dedup(awkward(spark, docs)))} == {3: 3, 5: 3, 6: 3, 8: 3, 9: 9}


def mirrored(n):
    """Two different words that polynomial hashes modulo a power of two take for one."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [512, 1024])
def test_mirrored_words(spark, n):
    x, y = mirrored(n)
    docs = [(1, " ".join([x] * 13)), (2, " ".join([y] * 13))]
    assert got(minhash.near_dedup(awkward(spark, docs), shingle=3, percent=85)) == expected(docs, 3, 85)


def test_no_components(spark):
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


@pytest.mark.parametrize("local", [7, 50, None])
def test_components(spark, local):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500 + i, 501 + i) for i in range(40)] + [(7, 7), (600, None)]
    parent = list(range(1000))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    nodes = {x for a, b in edges for x in (a, b) if b is not None and a != b}
    found = {(r["node"], r["component"]) for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b", local).collect()}
    assert found == {(x, find(x)) for x in nodes}

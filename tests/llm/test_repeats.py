import collections
import hashlib
import random
import re

import numpy as np
import pytest
from texts import ODD, awkward, rows

from tidemark.llm import common, recompression, repeats, suffix_dedup
from tidemark.llm.suffixes import suffix_array


def by_bytes(docs, width=100):
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0, i))
    seen, out = set(), collections.Counter()
    for i in order:
        text = (docs[i][1] or "").encode()
        gone = np.zeros(len(text), bool)
        for p in range(len(text) - width + 1):
            s = text[p : p + width]
            if s in seen:
                gone[p : p + width] = True
            seen.add(s)
        spans = sum(1 for p in range(len(text)) if gone[p] and (p == 0 or not gone[p - 1]))
        out[docs[i][0], len(text), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    return out


def by_words(docs, width=13):
    place = lambda i: repeats.NO_ID if i is None else i
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in docs]
    least = {}
    for (i, _), w in zip(docs, words, strict=True):
        for p in range(len(w) - width + 1):
            key = tuple(w[p : p + width])
            least[key] = min(place(i), least.get(key, repeats.NO_ID))
    out = collections.Counter()
    for (i, _), w in zip(docs, words, strict=True):
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if least[tuple(w[p : p + width])] < place(i):
                gone[p : p + width] = [True] * width
        out[i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()] += 1
    return out


def got(df, *names):
    return collections.Counter(tuple(r[n] for n in names) for r in rows(df))


def bytes_of(df):
    return got(df, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def words_of(df):
    return got(df, "doc_id", "n_words", "n_removed", "kept_sha256")


def passages(seed, n):
    """Texts from shared passages, runs and noise."""
    rng = random.Random(seed)
    shared = [" ".join(f"s{rng.randrange(300)}" for _ in range(rng.randrange(5, 60))) for _ in range(8)]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            kind = rng.randrange(5)
            if kind == 0:
                parts.append("ha " * rng.randrange(1, 60))
            elif kind == 1:
                parts.append(" ".join(f"n{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 40))))
            else:
                words = rng.choice(shared).split()
                a = rng.randrange(len(words))
                parts.append(" ".join(words[a : a + rng.randrange(1, 60)]))
        docs.append((n - i, rng.choice([" ", "\n", "  "]).join(parts)))
    return docs


@pytest.mark.parametrize("many", [3, 2000])
@pytest.mark.parametrize("slice_", [1500, 1 << 20])
def test_suffixes_of_passages(spark, monkeypatch, many, slice_):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    monkeypatch.setattr(common, "SLICE", slice_)
    docs = passages(1, 60)
    assert bytes_of(suffix_dedup.suffix_dedup(awkward(spark, docs).repartition(4))) == by_bytes(docs)


def test_words_of_passages(spark):
    docs = passages(2, 120)
    assert words_of(recompression.passage_dedup(awkward(spark, docs).repartition(4))) == by_words(docs)


def test_awkward(spark):
    docs = [*ODD, *((100 + i, t) for i, t in enumerate(["é" * 99, "é" * 99, "x" * 400, "ab" * 120, "ab" * 49]))]
    assert bytes_of(suffix_dedup.suffix_dedup(awkward(spark, docs).coalesce(1))) == by_bytes(docs)
    assert words_of(recompression.passage_dedup(awkward(spark, docs))) == by_words(docs)


def test_empty(spark):
    assert rows(suffix_dedup.suffix_dedup(awkward(spark, []))) == rows(recompression.passage_dedup(awkward(spark, []))) == []


def test_documents(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert bytes_of(suffix_dedup.op3_suffix_dedup(spark, sf)) == by_bytes(docs)
    assert words_of(recompression.op6_substring_dedup(spark, sf)) == by_words(docs)


def test_suffix_array():
    rng = np.random.default_rng(0)
    for _ in range(1500):
        x = rng.integers(0, int(rng.integers(1, 6)), int(rng.integers(0, 70))).tolist()
        assert suffix_array(np.array(x)).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


def test_long_texts_are_cut_with_an_overlap():
    raw = np.frombuffer(b"abcdefghij" * 100, np.uint8)
    parts = list(suffix_dedup._pieces(raw, np.array([0, 1000]), 150))
    assert [p[1] for p in parts] == list(range(0, 901, 150))
    assert all(len(p[2]) <= 249 for p in parts) and parts[-1][1] + len(parts[-1][2]) == 1000


def test_interior_symbols_are_the_same_everywhere():
    rng = np.random.default_rng(4)
    shared = rng.integers(0, 6, 40).astype(np.uint64)
    texts = [np.concatenate([rng.integers(0, 6, 9).astype(np.uint64), shared, rng.integers(0, 6, 9).astype(np.uint64)]) for _ in range(20)]
    seen = set()
    for t in texts:
        for r, (names, start, left, right) in enumerate(recompression.rounds(t, np.zeros(len(t), int))):
            inside = (left >= 9) & (right <= 49)
            seen.add((r, tuple(names[inside].tolist()), tuple(start[inside].tolist())))
    assert len(seen) == recompression.ROUNDS

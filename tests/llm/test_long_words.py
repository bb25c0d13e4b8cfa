"""Different words of hundreds of letters that polynomial hashes modulo a power of two take for one."""

import pytest
from test_lm_scoring import expected, got
from test_minhash import mirrored
from texts import awkward, rows

from tidemark.llm import common, fingerprint, lm_scoring, recompression, suffix_dedup


@pytest.mark.parametrize("n", [512, 1024])
def test_nothing_is_shared(spark, n):
    x, y = mirrored(n)
    docs = awkward(spark, [(1, " ".join([x] * 13)), (2, " ".join([y] * 13)), (3, " ".join([x] * 13))])
    assert {r["doc_id"]: r["n_removed"] for r in rows(recompression.passage_dedup(docs))} == {1: 0, 2: 0, 3: 13}
    prints = {r["doc_id"]: r for r in rows(fingerprint.fingerprints(docs))}
    assert prints[1]["fingerprint"] == prints[3]["fingerprint"] != prints[2]["fingerprint"] and prints[3]["near_next"] < 0.5


def test_losses(spark):
    x, y = mirrored(512)
    docs = [(1, f"{x} {x} a"), (2, f"{y} {x} a"), (3, f"{y} b")]
    targets = spark.createDataFrame([(1,)], "doc_id long")
    assert got(lm_scoring.cross_entropy_difference(awkward(spark, docs), targets)) == expected(docs, {1})


def test_bytes_around_mirrored_words(spark):
    x, y = mirrored(64)
    text = [(1, f"{x}{y}" * 3), (2, f"{y}{x}" * 3), (3, "z" * 150)]
    seen, want = set(), {}
    for i, t in text:
        gone = [False] * len(t)
        for k in range(len(t) - 99):
            s = t[k : k + 100]
            if s in seen:
                gone[k : k + 100] = [True] * 100
            seen.add(s)
        want[i] = sum(gone)
    assert {r["doc_id"]: r["n_removed"] for r in rows(suffix_dedup.suffix_dedup(awkward(spark, text)))} == want
    assert common.LONG_WORD < 512

import collections
import hashlib

import numpy as np
from texts import ODD, awkward, rows

from tidemark.llm import fingerprint


def expected(docs):
    docs = sorted(docs, key=lambda x: -x[0])
    out = {}
    for k, (doc_id, text) in enumerate(docs):
        other = docs[(k + 1) % len(docs)][1] or ""
        text = text or ""
        half = len(text) // 2
        out[doc_id] = (len(text), hashlib.sha256((text[: len(text) - half] + other[:half]).encode()).hexdigest())
    return out


def unique(docs):
    return list({i: (i, t) for i, t in docs if i is not None}.values())


def test_awkward(spark):
    docs = unique(ODD)
    got = rows(fingerprint.fingerprints(awkward(spark, docs).repartition(3)))
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in got} == expected(docs)
    same = {r["doc_id"]: r for r in got}
    assert same[5]["fingerprint"] == same[7]["fingerprint"] != same[9]["fingerprint"] == same[11]["fingerprint"]
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    assert same[7]["near_next"] == 1
    repeated = rows(fingerprint.fingerprints(awkward(spark, ODD)))
    assert collections.Counter(r["doc_id"] for r in repeated) == collections.Counter(i for i, _ in ODD)


def test_documents(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = rows(fingerprint.op10_fingerprint(spark, sf))
    assert len(got) == len(docs)
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in got} == expected(docs)
    texts = dict(docs)
    by = collections.defaultdict(set)
    for r in got:
        by[texts[r["doc_id"]]].add(r["fingerprint"])
    assert all(len(x) == 1 for x in by.values())
    long = [r for r in got if r["n_chars"] > 500]
    assert sum(r["near_edited"] > r["near_next"] for r in long) > 0.97 * len(long)


def test_empty_and_single(spark):
    assert rows(fingerprint.fingerprints(awkward(spark, []))) == []
    (r,) = rows(fingerprint.fingerprints(awkward(spark, [(3, "one two three four\nfive")])))
    assert r["near_next"] == 1


def encoded(text):
    (e,), (c,) = fingerprint.vectors([text])
    return fingerprint.encode(e, c)


def test_multiset():
    a, b, c = "first paragraph here now", "second one with words", "third"
    whole = encoded("\n".join([a, b, c, a]))
    assert whole == encoded("\n".join([a, a, c, b]))
    assert whole != encoded("\n".join([a, b, c]))
    assert fingerprint.delete(whole, a) == encoded("\n".join([c, b, a]))
    assert fingerprint.insert(encoded("\n".join([a, b])), c) == encoded("\n".join([c, a, b]))


def test_likeness_estimates_the_shared_part():
    words = [f"w{i}" for i in range(4000)]
    a = " ".join(words[:2000])
    for share in (0.0, 0.3, 0.6, 0.9):
        b = " ".join(words[2000 - int(2000 * share) : 4000 - int(2000 * share)])
        (ea, eb), (ca, cb) = fingerprint.vectors([a, b])
        assert abs(fingerprint.likeness((ea, ca), (eb, cb)) - share) < 0.2


def plain(text):
    """A text's lanes by their definition: the sum of its lines' lanes, each line by itself."""
    exact, counts = np.zeros(fingerprint.EXACT, np.uint64), np.zeros(fingerprint.LANES, np.uint16)
    for line in text.split("\n"):
        e, c = fingerprint.vectors([line])
        exact, counts = exact + e[0], counts + c[0]
    return exact, counts


def alike(a, b):
    """1 for equal lanes, else what the squared lengths of the counts and of their difference leave."""
    if a[0].tolist() == b[0].tolist():
        return 1.0
    signed = lambda x: [v - 65536 if v > 32767 else v for v in x.tolist()]
    p, q = signed(a[1]), signed(b[1])
    total = sum(v * v for v in p) + sum(v * v for v in q)
    return min(1.0, max(0.0, 1 - sum((u - v) ** 2 for u, v in zip(p, q, strict=True)) / total)) if total else 0.0


def test_every_column_by_brute_force(spark, sf):
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()), reverse=True)
    got = {r["doc_id"]: r for r in rows(fingerprint.op10_fingerprint(spark, sf))}
    lanes = [plain(t) for _, t in docs]
    assert len(got) == len(docs)
    for k, (i, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, changed = lanes[k], plain(edited)
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == fingerprint.encode(*own) and r["edited_fingerprint"] == fingerprint.encode(*changed)
        assert abs(r["near_edited"] - alike(own, changed)) < 1e-9 and abs(r["near_next"] - alike(own, lanes[(k + 1) % len(docs)])) < 1e-9

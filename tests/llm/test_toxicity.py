import math
import random
import zlib

import numpy as np
from texts import awkward, rows

from tidemark.llm import common, toxicity


def brute(scores):
    """Maximal segments by their definition: positive, no better part, and in no better segment of the kind; found by splitting at the best."""
    out = []

    def split(a, b):
        best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
        if best is None or best[0] <= 0:
            return
        *_, i, j = best
        out.append((i, j - 1, best[0]))
        split(a, i)
        split(j, b)

    split(0, len(scores))
    return sorted(out)


def test_segments():
    rng = random.Random(1)
    for _ in range(400):
        n = rng.randrange(0, 14)
        rest = -0.25
        some = {i: rng.choice([-1.5, -0.75, 0.5, 1.0, 2.5]) for i in range(n) if rng.random() < 0.6}
        scores = [some.get(i, rest) for i in range(n)]
        got = sorted(toxicity.segments(list(some), list(some.values()), rest))
        assert math.isclose(sum(s for *_, s in got), sum(s for *_, s in brute(scores)))
        assert [x[2] for x in got] == [x[2] for x in brute(scores)] or sorted(x[2] for x in got) == sorted(x[2] for x in brute(scores))


def test_root():
    lam = toxicity.root([(1.0, 0.2), (-1.0, 0.8)])
    assert math.isclose(lam, math.log(4), rel_tol=1e-6)


def test_isotonic():
    curve = toxicity.isotonic([(0, 100, 1), (1, 50, 5), (2, 50, 3), (3, 20, 19)])
    ps = [p for _, p in curve]
    assert ps == sorted(ps) and ps[0] < 0.05 and ps[-1] > 0.8


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in rows(toxicity.op2_toxicity(spark, sf))}
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    held = [(got[i]["score"], t) for i, t in labels if got[i]["held_out"]]
    ones, zeros = [s for s, t in held if t], [s for s, t in held if not t]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros])
    assert auc > 0.75


def test_awkward(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(5, 1), (7, 0), (None, 1), (13, None), (13, 7)], "doc_id long, toxic int")
    for some in (labels, labels.limit(0)):
        got = rows(toxicity.toxicity(docs, some))
        assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert rows(toxicity.toxicity(awkward(spark, []), labels)) == []


def test_labels_held_out_have_no_part(spark):
    docs = [(i, ("vile words here " if i % 3 == 0 else "kind words there ") * 5) for i in range(60)]
    labels = [(i, int(i % 3 == 0)) for i in range(60)]
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels]
    a, b = (sorted((r["doc_id"], r["score"]) for r in rows(toxicity.toxicity(awkward(spark, docs), spark.createDataFrame(x, "doc_id long, toxic int")))) for x in (labels, flipped))
    assert a == b


def test_least_ratio():
    """One word in 1,000 reaches 10.83 by chance, one in 100 6.63."""
    assert abs(toxicity.least_ratio(1000) - 10.828) < 0.01 and abs(toxicity.least_ratio(100) - 6.635) < 0.01


def plain_score(text, model):
    """Score by its definition: each token's score, the segments by splitting at the best one, the evidence's place on the curve."""
    tokens = toxicity.TOKEN.findall((text or "").lower())
    scores = [model.scores.get(t, model.rest) for t in tokens]
    e = toxicity.evidence([s for *_, s in brute(scores)], len(tokens), model.lam, model.k)
    xs, ps = zip(*model.curve, strict=True)
    return float(np.interp(e, xs, ps)) * (1 - 1e-6) + 1e-6 * (1 - math.exp(-e))


def test_scores_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(common.id_text(docs), labels)
    got = {r["doc_id"]: r["score"] for r in rows(toxicity.op2_toxicity(spark, sf))}
    short = [(r.doc_id, r.text) for r in docs.where("length(text) < 350").collect()]
    assert len(short) > 50 and all(abs(got[i] - plain_score(t, model)) < 1e-9 for i, t in short)


def test_repeated_rows_score_equally(spark):
    docs = [(i, ("vile words here " if i % 3 == 0 else "kind words there ") * 5 + f"number{i}") for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    got = rows(toxicity.toxicity(awkward(spark, [*docs, *docs, (None, docs[0][1])]), labels))
    scores = {i: {r["score"] for r in got if r["doc_id"] == i} for i, _ in docs}
    assert len(got) == 121 and all(len(x) == 1 for x in scores.values()) and len(set.union(*scores.values())) > 1
    assert {r["score"] for r in got if r["doc_id"] is None} == scores[0]


def test_kept_is_not_predicted(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(common.id_text(docs), labels)
    low = {r["doc_id"] for r in rows(toxicity.score(common.id_text(docs), model)) if not r["predicted"]}
    assert {r["doc_id"] for r in rows(toxicity.keep(docs, model))} == low

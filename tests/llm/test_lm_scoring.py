import collections
import math
import re

import pytest
from texts import ODD, awkward, rows

from tidemark.llm import lm_scoring as lm


def expected(docs, targets):
    texts = [[w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in re.findall("[^\x20\x09-\x0d]+", t or "")] + [None] for _, t in docs]
    vocabulary = len({w for t in texts for w in t})
    out = collections.Counter()
    counts = {}
    for kind in ("all", "target"):
        one, two = collections.Counter(), collections.Counter()
        for (i, _), t in zip(docs, texts, strict=True):
            if kind == "all" or i in targets:
                one.update(t)
                two.update(zip([None, *t], t, strict=False))
        counts[kind] = one, two, sum(one.values())
    for (i, _), t in zip(docs, texts, strict=True):
        own1, own2 = collections.Counter(t), collections.Counter(zip([None, *t], t, strict=False))
        losses = {}
        for kind, (one, two, total) in counts.items():
            x = kind == "all" or i in targets
            loss = 0.0
            for h, w in zip([None, *t], t, strict=False):
                p1 = (one[w] - own1[w] * x + lm.DELTA) / (total - len(t) * x + lm.DELTA * vocabulary)
                loss -= math.log((two[h, w] - own2[h, w] * x + lm.MU * p1) / (one[h] - own1[h] * x + lm.MU))
            losses[kind] = loss / len(t)
        out[i, len(t) - 1, round(losses["target"], 8), round(losses["all"], 8), round(losses["target"] - losses["all"], 6)] += 1
    return out


def got(df):
    return collections.Counter((r["doc_id"], r["n_tokens"], round(r["target_loss"], 8), round(r["background_loss"], 8), round(r["difference"], 6)) for r in rows(df))


@pytest.mark.parametrize("wanted", [[5, 13, 16, None, 16], []])
def test_awkward(spark, wanted):
    targets = spark.createDataFrame([(i,) for i in wanted], "doc_id long")
    assert got(lm.cross_entropy_difference(awkward(spark).repartition(3), targets)) == expected(ODD, set(wanted) - {None})


def test_documents(spark, sf, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_ROWS", 30)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    targets = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    a, b = got(lm.op4_lm_scoring(spark, sf)), expected(docs, targets)
    assert len(a) == len(b)
    for x, y in zip(sorted(a), sorted(b), strict=True):
        assert x[:2] == y[:2] and all(math.isclose(p, q, abs_tol=1e-6) for p, q in zip(x[2:], y[2:], strict=True))


def test_empty(spark):
    assert rows(lm.cross_entropy_difference(awkward(spark, []), spark.createDataFrame([], "doc_id long"))) == []

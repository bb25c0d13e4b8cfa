
import pytest
from pyspark.sql import functions as F
from texts import ODD, awkward, rows

import corpus_pipeline
from tidemark.llm import minhash, toxicity


@pytest.fixture
def folder(spark, tmp_path):
    path = str(tmp_path / "sf")
    spark.createDataFrame([(i, int(i % 2)) for i in range(200, 260)] + [(5, 0)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    toxic = [(i, f"some words here n{i} " + ("you horrid creature " * 2 if i % 2 else "nothing to see ") + f"and then m{i}") for i in range(200, 260)]
    docs = awkward(spark, [*ODD, *toxic]).withColumn("n_chars", F.char_length("text").cast("long"))
    docs.write.parquet(f"{path}/documents.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clean = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert clean.columns == docs.columns
    ids = [r["doc_id"] for r in rows(clean)]
    assert not [i for i in ids if i and 200 <= i and i % 2] and len([i for i in ids if i and i >= 200]) == 30 and len(ids) == 30 + len(ODD)

    one = corpus_pipeline.drop_copies(spark, docs, folder)
    assert one.columns == docs.columns
    best = {}
    for r in rows(docs):
        t = r["text"] or ""
        best[t] = max(best.get(t, -(2**63)), -(2**63) if r["doc_id"] is None else r["doc_id"])
    assert sorted((-(2**63) if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in rows(one)) == sorted((i, t) for t, i in best.items())

    near = corpus_pipeline.drop_near_copies(spark, docs, folder)
    gone = {r["doc_id"] for r in rows(minhash.near_dedup(docs)) if not r["kept"]}
    assert near.columns == docs.columns and 7 in gone
    assert sorted(r["doc_id"] or 0 for r in rows(near)) == sorted(r["doc_id"] or 0 for r in rows(docs) if r["doc_id"] not in gone)

    masked = corpus_pipeline.mask_secrets(spark, docs, folder)
    assert masked.columns == docs.columns and masked.count() == docs.count()


def test_run(spark, folder):
    packed = rows(corpus_pipeline.run(spark, folder))
    assert packed and {"doc_id", "piece", "sequence_id", "offset"} <= set(packed[0])
    ids = {r["doc_id"] for r in packed}
    assert 7 in ids and 5 not in ids and 201 not in ids and 202 in ids


def test_a_group_without_ids_keeps_one(spark, folder):
    docs = awkward(spark, [(None, "same"), (None, "same"), (None, "other"), (3, "other"), (3, "other")])
    kept = [(r["doc_id"], r["text"]) for r in rows(corpus_pipeline.drop_copies(spark, docs, folder))]
    assert sorted(kept, key=str) == [(3, "other"), (None, "same")]


def test_toxicity_keeps_texts_without_evidence(spark):
    model = toxicity.Model({"bad": 5.0}, -0.01, 1.0, 0.01, [(0.0, 0.01), (3.0, 0.9)])
    docs = awkward(spark, [(1, None), (2, ""), (3, "bad bad bad"), (4, "fine")])
    assert sorted(r["doc_id"] for r in rows(toxicity.keep(docs, model))) == [1, 2, 4]


def test_toxicity_by_brute_force(spark, folder):
    """What stays is what a plain score of each whole text leaves below the threshold."""
    from test_toxicity import plain_score

    from tidemark.llm import common

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.fit(common.id_text(docs), spark.read.parquet(f"{folder}/labels.parquet"))
    want = sorted(str((r["doc_id"], r["text"])) for r in rows(docs) if len(r["text"] or "") > 10_000 or plain_score(r["text"], model) < 0.3)
    assert sorted(str((r["doc_id"], r["text"])) for r in rows(corpus_pipeline.drop_toxic(spark, docs, folder))) == want


def test_near_dedup_by_brute_force(spark, sf):
    from test_minhash import expected

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = expected([(r["doc_id"], r["text"]) for r in rows(docs)], 5, 80)
    kept = sorted(i for i, _, _, stays in found if stays)
    got = corpus_pipeline.drop_near_copies(spark, docs, sf)
    assert sorted(r["doc_id"] for r in rows(got)) == kept and len(kept) < docs.count()


def test_masks_by_brute_force(spark):
    """Every base value is hidden unless three owners carry it, or two in four repositories, and every live token."""
    sf = "/root/testdata/sf0.01"
    from collections import defaultdict

    from test_secrets import base, random_looking

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    owners, repos = defaultdict(set), defaultdict(set)
    for r in rows(docs):
        for *_, v in base(r["text"]):
            owners[v].add(r["source"] or "")
            repos[v].add((r["source"] or "", r["lang"] or ""))
    want = {}
    for r in rows(docs):
        text, done, out = r["text"] or "", 0, ""
        cuts = []
        for _, n, _, end, v in base(text):
            example = len(owners[v]) >= 3 or (len(owners[v]) > 1 and len(repos[v]) >= 4)
            live = random_looking(v) and len(owners[v]) == 1 and len(repos[v]) < 4
            if (n < 3 and not example) or (n == 3 and live):
                cuts.append((end - len(v), end))
        for a, b in sorted(set(cuts)):
            if a >= done:
                out += text[done:a] + "[SECRET]"
            done = max(done, b)
        want[r["doc_id"]] = out + text[done:]
    got = {r["doc_id"]: r["text"] for r in rows(corpus_pipeline.mask_secrets(spark, docs, sf))}
    assert got == want and any("[SECRET]" in t for t in got.values())


def test_packing_by_brute_force(spark, sf):
    """The pieces of the named tokenizer's ids, each once, and gapless sequences of at most 1024."""
    import zlib
    from collections import defaultdict

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from tidemark.llm import packing

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = set()
    for r in rows(docs):
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want |= {(r["doc_id"], k, a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())) for k, (a, n) in enumerate(packing.cut(len(ids), 1024))}
    got = rows(corpus_pipeline.pack(spark, docs, sf))
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_stages_on_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert rows(stage(spark, docs, folder)) == [], name

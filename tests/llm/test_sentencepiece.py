import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from texts import LONG, ODD, awkward, rows

from tidemark.llm import sentencepiece as sp

TEXTS = [t or "" for _, t in ODD] + [LONG, "a  b\nc\n d <s> x\t", "aaaaaaaaaaaaaaaaaaaaaaaa", "日本語 text 𝔘 ▁under", "   ", "\n", "don't stop", "x" * 300]


def library(path):
    return sentencepiece.SentencePieceProcessor(model_file=path)


def test_same_ids_as_the_library(spark):
    own, theirs = sp.codec(sp.VOCABULARY), library(public_tokenizers.path(sp.VOCABULARY))
    texts = TEXTS + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == theirs.encode(text), text[:80]
        assert own.decode(ids) == text.replace("▁", " ")


def test_random_texts_have_the_ids_of_the_library():
    rng = random.Random(4)
    own, theirs = sp.codec(sp.VOCABULARY), library(public_tokenizers.path(sp.VOCABULARY))
    texts = ["".join(rng.choice("aaabbcdeeeeiio tnrs hlu1234 .,-éß日本") for _ in range(rng.randrange(300))) for _ in range(500)]
    texts.append("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000)))  # one unbroken word
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == theirs.encode(text), text[:80]


def test_paths_are_what_merging_finds():
    """A hand-made model of the BPE kind with ties of overlapping pairs; the path against merges done one by one."""
    rng = random.Random(8)
    for _ in range(20):
        names = list("abc")
        while len(names) < 25:
            p = rng.choice(names) + rng.choice(names)
            if p not in names and len(p) < 7:
                names.append(p)
        model = sp.Model(["<unk>", *names], np.array([0.0, *(-float(i) for i in range(len(names)))]), [sp.UNKNOWN, *[sp.NORMAL] * len(names)], kind=sp.BPE).indexed()
        for n in range(1, 12):
            words = ["".join(rng.choice("abc") for _ in range(n)) for _ in range(40)]
            start, end, _, sizes = sp.paths(model, sp._codes(words))
            at = 0
            for word, size in zip(words, sizes.tolist(), strict=True):
                cuts, at = list(zip(start[at : at + size].tolist(), end[at : at + size].tolist(), strict=True)), at + size
                parts = list(word)
                while len(parts) > 1:
                    rank, k = min((names.index(parts[i] + parts[i + 1]) if parts[i] + parts[i + 1] in names else 99, i) for i in range(len(parts) - 1))
                    if rank == 99:
                        break
                    parts[k : k + 2] = [parts[k] + parts[k + 1]]
                assert [word[a:b] for a, b in cuts] == parts, (word, names)


def test_no_step_no_path(monkeypatch):
    """The ids come from the steps that neighbours allow: without these they are others."""
    own = sp.codec(sp.VOCABULARY)
    right = own.encode(["electroencephalographically"])[0].tolist()
    own.known.clear()
    monkeypatch.setattr(sp.Neighbours, "may", lambda self, a, b: np.zeros(len(a), bool))
    assert own.encode(["electroencephalographically"])[0].tolist() != right
    own.known.clear()


def field(number, value):
    out = bytearray()

    def varint(n):
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        out.append(n)

    if isinstance(value, int):
        varint(number << 3)
        varint(value)
    elif isinstance(value, float):
        varint(number << 3 | 5)
        out.extend(np.float32(value).tobytes())
    else:
        varint(number << 3 | 2)
        varint(len(value))
        out.extend(value)
    return bytes(out)


def unigram(seed, squeeze):
    """A unigram model made by hand, in the format of the library."""
    rng = random.Random(seed)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁", -3.5, 1)]
    names = {"▁"}
    while len(names) < 60:
        p = rng.choice(["", "▁"]) + "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 5)))
        if p not in names:
            names.add(p)
            pieces.append((p, -rng.random() * 9 - 1, 1))
    data = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in pieces)
    return data + field(2, field(3, 1)) + field(3, field(1, b"identity") + field(3, 1) + field(4, squeeze))


@pytest.mark.parametrize("squeeze", [0, 1])
def test_viterbi(tmp_path, squeeze):
    rng = random.Random(9)
    for seed in range(4):
        data = unigram(seed, squeeze)
        path = tmp_path / f"{seed}.model"
        path.write_bytes(data)
        own, theirs = sp.codec(str(path)), library(str(path))
        texts = ["".join(rng.choice("abcd  ez") for _ in range(rng.randrange(0, 40))) for _ in range(200)]
        for text, ids in zip(texts, own.encode(texts), strict=True):
            want = theirs.encode(text)
            score = lambda x: sum(own.model.scores[i] if i else own.model.least for i in x)
            assert ids.tolist() == want or abs(score(ids.tolist()) - score(want)) < 1e-4, (text, ids, want)


def test_frames(spark):
    ids = sp.encode(awkward(spark))
    back = rows(sp.decode(ids))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in back) == sorted((i is None, i or 0, t or "") for i, t in ODD)
    assert rows(sp.encode(awkward(spark, []))) == []


def test_empty_tables(spark):
    empty = awkward(spark, [])
    assert rows(sp.digests(empty)) == [] and rows(sp.decode(sp.encode(empty))) == []


def test_query_on_awkward_texts(spark):
    """Repeated rows are reported each, null texts as empty ones; the mark for a space is the only character that doesn't come back."""
    got = rows(sp.digests(awkward(spark, [*ODD, (77, "\u2581x"), (77, None)])))
    assert len(got) == len(ODD) + 2 and [r["n_ids"] for r in got if r["doc_id"] in (9, 11)] == [0, 0]
    assert [r["round_trip"] for r in got if r["doc_id"] == 77] in ([False, True], [True, False])


def test_query(spark, sf):
    got = rows(sp.op8_sentencepiece(spark, sf))
    assert got and all(r["round_trip"] for r in got)

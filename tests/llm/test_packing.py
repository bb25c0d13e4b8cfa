import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from texts import LONG, ODD, awkward, rows
from tokenizers import Tokenizer

from tidemark.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def expected(tokenizer, docs, capacity):
    out = collections.Counter()
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % capacity + 1
        at = 0
        for k, n in enumerate([first] + [capacity] * ((len(ids) - first) // capacity)):
            out[doc_id, k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())] += 1
            at += n
    return out


def check(got, capacity):
    taken = collections.defaultdict(list)
    for r in got:
        taken[r["sequence_id"]].append((r["offset"], r["length"]))
    for slots in taken.values():
        end = 0
        for offset, length in sorted(slots):
            assert offset == end
            end += length
        assert end <= capacity
    return len(taken)


@pytest.mark.parametrize("capacity", [16, 1024])
def test_awkward(spark, tokenizer, capacity):
    got = rows(packing.pack(awkward(spark), capacity=capacity))
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected(tokenizer, ODD, capacity)
    check(got, capacity)


def test_documents(spark, sf, tokenizer):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = rows(packing.op1_packing(spark, sf))
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected(tokenizer, docs, 1024)
    assert check(got, 1024) <= -(-sum(r["length"] for r in got) // 1024) + 2


def test_empty(spark):
    assert rows(packing.pack(awkward(spark, []))) == []


def brute(counts, capacity):
    left = []
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            fits = [i for i, r in enumerate(left) if r >= n]
            i = min(fits, key=lambda i: left[i], default=None)
            if i is None:
                left.append(capacity - n)
            else:
                left[i] -= n
    return sorted(left)


def test_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(1)
    for _ in range(60):
        counts = {int(n): int(rng.integers(1, 30)) for n in rng.integers(1, 41, 12)}
        used = collections.Counter()
        placed = collections.Counter()
        for length, rank, n, first, at, per in packing.plan(counts, 40):
            assert rank == placed[length]
            placed[length] += n
            for j in range(n):
                assert at + (j % per) * length == used[first + j // per]
                used[first + j // per] += length
        assert placed == counts
        assert sorted(40 - x for x in used.values()) == brute(counts, 40)


def test_long_text_of_words_is_cached_alike(tokenizer):
    encode = packing.Encoder("byte_bpe_50k")
    for text in (LONG, "a  b   c", " lead", "trail ", "x\n y", "don't 's", "1 2 3", "é  é", "a 　b", "a\x1c b\x85 c"):
        for _ in range(2):
            assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_same_ids_as_the_named_tokenizer(tokenizer):
    """Over all texts of sf0.1, and over random Unicode."""
    import pyarrow.dataset as ds

    rng = random.Random(3)
    chars = [*" \t\n\r'", *"abcdefgXYZ0189.,-_", "\u00a0", "\u3000", "\u2028", "é", "ß", "ſ", "日", "本", "😀", "\u0301", "\u200d", "\x1c", "\x85", "\x00", "\ud7ff", "\ue000", "\U0010ffff"]
    texts = ["".join(rng.choices(chars, k=rng.randrange(60))) for _ in range(5000)]
    texts += ["".join(chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(40)) for _ in range(1000)]
    texts += [t or "" for t in ds.dataset("/root/testdata/sf0.1/documents.parquet").to_table(columns=["text"])["text"].to_pylist()]
    encode = packing.Encoder("byte_bpe_50k")
    for low in range(0, len(texts), 2000):
        part = texts[low : low + 2000]
        for text, want in zip(part, tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
            assert encode(text) == np.array(want.ids, "<u4").tobytes(), text[:80]

import collections
import hashlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from texts import ODD, awkward, rows

from tidemark.llm import exact_dedup


def expected(docs):
    groups = collections.defaultdict(list)
    for doc_id, text in docs:
        groups[text or ""].append(doc_id)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return collections.Counter((i, keep[t or ""], len(groups[t or ""]), i is not None and i == keep[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in docs)


def got(df):
    return collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows(df))


def test_awkward(spark):
    assert got(exact_dedup.dedup(awkward(spark))) == expected(ODD)


def test_empty(spark):
    assert got(exact_dedup.dedup(awkward(spark, []))) == {}


def test_splits(spark):
    docs = [(i, f"text {i % 40} " * (i % 7)) for i in range(300)]
    assert got(exact_dedup.dedup(awkward(spark, docs).repartition(5), bucket_bytes=200, depth=6)) == expected(docs)


def test_oracle(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as from '{sf}/documents.parquet'")
    want = collections.Counter(con.execute(f"select doc_id, keep_id, group_size, kept, text_sha256 from ({exact_dedup.ORACLE_SQL})").fetchall())
    assert got(exact_dedup.op5_exact_dedup(spark, sf)) == want


def stored(keys):
    """What a pass over keys (unsigned: bytes) finds."""

    def sizes(bits, prefixes):
        cells = {}
        for key, size in keys.items():
            prefix = key >> (64 - bits)
            if prefixes is None or prefix >> exact_dedup.STEP_BITS in prefixes:
                total, low, high = cells.get(prefix, (0, key, key))
                cells[prefix] = total + size, min(low, key), max(high, key)
        return cells

    return sizes


def test_directory_doubles():
    found = exact_dedup.directory(stored({(p << 58) + x: 50 for p in range(64) for x in (1, 5)}), 900, 6)
    assert found.depth == 3 and found.starts == [p << 61 for p in range(8)]
    keys = {1: 5000, 9 << 40: 5000, 63 << 58: 10}
    found = exact_dedup.directory(stored(keys), 900, 6)
    assert found.depth > 12 and len(set(found.of(np.array(list(keys), np.uint64)).tolist())) == 3  # as deep as it takes
    found = exact_dedup.directory(stored({5 << 58: 10_000}), 900, 6)
    assert found.depth <= 3  # one key can't be split


def test_signed_keys_find_their_bucket():
    index = exact_dedup.Directory(1, [0, 1 << 63])
    assert index.of(np.array([0, 5, -1, -(2**63), 2**63 - 1], np.int64)).tolist() == [0, 0, 1, 1, 0]


def test_one_text_in_most_rows(spark):
    docs = [(i, "the same" if i % 10 else f"other {i}") for i in range(1000)]
    assert got(exact_dedup.dedup(awkward(spark, docs).repartition(7), bucket_bytes=100, depth=4)) == expected(docs)


def test_colliding_keys_are_told_apart(tmp_path):
    table = pa.table({"key": [1, 1, 1, 2], "rep": [1, 2, 3, 4], "best": [5, 6, 7, 8], "n": [1, 1, 2, 1], "text": [b"a", b"b", b"a", b"a"]})
    pq.write_table(table, tmp_path / "x.parquet")
    chains = [(k, [(bytes(t), e) for t, e in c]) for k, c in exact_dedup.read_chains(fs.LocalFileSystem(), [str(tmp_path / "x.parquet")])]
    assert chains == [(1, [(b"a", [(1, 5, 1), (3, 7, 2)]), (b"b", [(2, 6, 1)])]), (2, [(b"a", [(4, 8, 1)])])]

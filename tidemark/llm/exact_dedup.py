"""Exact dedup with an extendible-hash index on shared files.

A first pass over the keys (a 64-bit hash of the text) sizes the directory: a bucket that is too large is split by one
more bit, and the directory doubles whenever a bucket gets as deep as it is. Where cells of DEPTH bits are still too large, a
further pass refines them by STEP_BITS bits, as deep as the data need. The next pass combines equal texts
within a batch and writes the rest into the buckets' files in the shared folder. Owner tasks then go through ranges of
keys: rows with one key form a chain, and within a chain the bytes are compared, so colliding texts stay apart. Owners
stream their files, and answers leave in lots; of a text an owner holds one copy of the bytes and a few numbers for each batch that had it.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common

#: A bucket with more bytes of text is split. Bits of the first pass over the keys, of each further one, and of a key at most.
BUCKET_BYTES, DEPTH, STEP_BITS, KEY_BITS = 4 << 20, 14, 6, 62
ENTRIES = "bucket int, key long, rep long, best long, n long, members array<long>, sha string, text binary"
OWNED = "rep long, keep_id long, group_size long"


@dataclass
class Directory:
    """Buckets as ranges of keys: starts are the least keys (as unsigned numbers) of the buckets, in order; depth is the global depth.

    An entry of the directory of 2 ** depth is the bucket whose range it lies in, so doubling needs no table of that size.
    """

    depth: int
    starts: list[int]

    def of(self, keys: np.ndarray) -> np.ndarray:
        return (np.searchsorted(np.array(self.starts, np.uint64), keys.astype(np.int64).view(np.uint64), "right") - 1).astype(np.int32)


def directory(sizes: Callable[[int, list[int] | None], dict[int, tuple[int, int, int]]], bucket_bytes: int, depth: int = DEPTH, step: int = STEP_BITS) -> Directory:
    """Splits buckets until each has at most bucket_bytes or a single key.

    sizes(bits, prefixes): by key prefix of so many bits, (bytes, least key, greatest key); prefixes: of bits - step bits, None for all.
    """
    done: list[tuple[int, int]] = []  # (prefix, local depth)
    cells, bits, todo = sizes(depth, None), depth, [(0, 0)]
    while True:
        keys = sorted(cells)
        totals = np.concatenate([[0], np.cumsum([cells[k][0] for k in keys], dtype=np.int64)])
        deeper = []
        while todo:
            prefix, local = todo.pop()
            low, high = (bisect.bisect_left(keys, p << (bits - local)) for p in (prefix, prefix + 1))
            held = keys[low:high]
            single = len(held) <= 1 and all(cells[k][1] == cells[k][2] for k in held)
            if totals[high] - totals[low] <= bucket_bytes or single:
                done.append((prefix, local))
            elif local < bits:
                todo += [(2 * prefix + 1, local + 1), (2 * prefix, local + 1)]
            else:
                deeper.append((prefix, local))
        if not deeper or bits + step > KEY_BITS:
            done += deeper
            break
        cells, bits, todo = sizes(bits + step, [p for p, _ in deeper]), bits + step, deeper
    return Directory(max((local for _, local in done), default=0), sorted(p << (64 - local) for p, local in done))


def combine(keyed: DataFrame, index: Directory) -> DataFrame:
    """One entry for each different text of a batch, with the members that it stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            raw, offsets = common.arrays(batch, "text")
            raw = raw.tobytes()
            ids, keys = batch.column("doc_id").to_pylist(), batch.column("key").to_pylist()
            groups: dict[bytes, list[int]] = {}
            for i in range(len(ids)):
                groups.setdefault(raw[offsets[i] : offsets[i + 1]], []).append(i)
            key = [keys[x[0]] for x in groups.values()]
            known = [[ids[i] for i in x if ids[i] is not None] for x in groups.values()]
            if key:
                yield pa.record_batch(
                    [
                        pa.array(index.of(np.array(key, np.int64)), pa.int32()), pa.array(key, pa.int64()), pa.array(range(base + made, base + made + len(key)), pa.int64()),
                        pa.array([max(x, default=None) for x in known], pa.int64()), pa.array([len(x) for x in groups.values()], pa.int64()),
                        pa.array([[ids[i] for i in x] for x in groups.values()], pa.list_(pa.int64())), pa.array([hashlib.sha256(x).hexdigest() for x in groups]), pa.array(list(groups), pa.binary()),
                    ],
                    ["bucket", "key", "rep", "best", "n", "members", "sha", "text"],
                )
                made += len(key)

    return keyed.mapInArrow(run, ENTRIES)


def read_chains(filesystem, files: list[str]) -> Iterator[tuple[int, list[tuple[bytes, list[tuple[int, int | None, int]]]]]]:
    """(key, its different texts with their entries), from files that are sorted by key, text by text."""
    import pyarrow.parquet as pq

    key, chain = None, []
    for name in files:
        with filesystem.open_input_file(name) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=64, columns=["key", "rep", "best", "n", "text"]):
                for k, rep, best, n, text in zip(*(batch.column(c) for c in ("key", "rep", "best", "n", "text")), strict=True):
                    if k.as_py() != key:
                        if chain:
                            yield key, chain
                        key, chain = k.as_py(), []
                    text = text.as_buffer()
                    for held, entries in chain:
                        if held.equals(text):  # byte by byte
                            entries.append((rep.as_py(), best.as_py(), n.as_py()))
                            break
                    else:
                        chain.append((pa.py_buffer(text.to_pybytes()), [(rep.as_py(), best.as_py(), n.as_py())]))
    if chain:
        yield key, chain


def own(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """Owner tasks: each goes through the files of a range of buckets, that is of keys."""

    def answered(out: list[tuple[int, int | None, int]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["rep", "keep_id", "group_size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        filesystem, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        for batch in batches:
            for bucket in batch.column("id").to_pylist():
                listed = filesystem.get_file_info(fs.FileSelector(f"{root}/bucket={bucket}", allow_not_found=True))
                files = sorted(x.path for x in listed if x.path.endswith(".parquet"))
                out: list[tuple[int, int | None, int]] = []
                for _, chain in read_chains(filesystem, files):
                    for _, entries in chain:
                        keep, size = max((b for _, b, _ in entries if b is not None), default=None), sum(n for *_, n in entries)
                        for rep, _, _ in entries:
                            out.append((rep, keep, size))
                            if len(out) >= 50_000:
                                yield answered(out)
                                out = []
                if out:
                    yield answered(out)

    return spark.range(0, buckets, 1, min(buckets, max(common.partitions(spark), buckets // 64))).mapInArrow(run, OWNED)


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, depth: int = DEPTH) -> DataFrame:
    """One row for each row of df: doc_id, keep_id (the greatest id among rows with the same text), group_size, kept, text_sha256.

    Null texts count as empty. Rows without an id count as members, but never stay unless all rows of the group lack
    one (keep_id is null then, and none is kept). Where one id has several rows with one text, all those rows are
    marked kept: the operator decides on ids. An empty table gives no rows. Other columns of df are left out.
    """
    spark = common.prepare(df.sparkSession)
    keyed = common.id_text(df, id_col, text_col).withColumn("key", F.xxhash64("text"))

    def sizes(bits: int, prefixes: list[int] | None) -> dict[int, tuple[int, int, int]]:
        """At most 2 ** DEPTH rows at first; then 2 ** STEP_BITS for each cell that is still larger than a bucket."""
        some = keyed if prefixes is None else keyed.join(F.broadcast(spark.createDataFrame([(p,) for p in prefixes], "cell long")), F.shiftrightunsigned("key", 64 - bits + STEP_BITS) == F.col("cell"), "left_semi")
        found = some.groupBy(F.shiftrightunsigned("key", 64 - bits).alias("prefix")).agg(F.sum(F.octet_length("text") + 64).alias("size"), F.min("key").alias("low"), F.max("key").alias("high"))
        return {r["prefix"]: (r["size"], r["low"], r["high"]) for r in found.collect()}

    index = directory(sizes, bucket_bytes, depth)
    buckets = len(index.starts)
    path = common.shared_path(spark, "index")
    rows = combine(keyed, index)
    n = max(1, min(buckets, 4 * common.partitions(spark)))
    rows.repartition(n, "bucket").sortWithinPartitions("bucket", "key").write.option("compression", "zstd").partitionBy("bucket").parquet(path)
    written = spark.read.schema(rows.schema).parquet(path)
    owned = own(spark, path, buckets)
    return (
        written.select("rep", "members", "sha").join(owned.hint("merge"), "rep").select(F.explode("members").alias("doc_id"), "keep_id", "group_size", F.col("sha").alias("text_sha256"))
        .select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.documents(spark, sf_dir))


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

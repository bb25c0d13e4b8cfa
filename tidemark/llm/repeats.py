"""What the two substring dedups share: a store of texts, the sifting of windows by key, and work that goes to the texts.

Texts are written once, in files of the shared folder; a row's number names its file and its place there. Windows of
neighbouring starts travel as (key, win, doc, row, at): key is what all occurrences of any window of the row share, win a
hash of the whole stretch. Where (key, win) recurs, all starts of the later stretches are repeats. Stretches
of one key that differ are left to a finer look at their texts. Results travel to the texts, not texts to results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common

WINDOWS = "key long, win long, doc long, row long, at long"
SIFTED = "key long, doc long, row long, at long"
#: Row numbers: the file above these bits, the place in the file below.
FILE_BITS = 33
#: The document that a row without an id belongs to: one behind all others.
NO_ID = 2**63 - 1


def store(df: DataFrame) -> tuple[str, int]:
    """Writes (doc, row, text) and returns the path and the number of files. df: doc_id, text."""
    spark = df.sparkSession
    path = common.shared_path(spark, "texts")
    df.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("binary").alias("text"), F.col("doc_id").isNull().alias("no_id")).write.option("compression", "zstd").parquet(path)
    last = spark.read.schema("row long").parquet(path).agg(F.max("row")).first()[0]
    return path, 0 if last is None else (last >> FILE_BITS) + 1


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc long, row long, text binary, no_id boolean").parquet(path)


def pack(lo: np.ndarray, n: np.ndarray, off: np.ndarray) -> np.ndarray:
    return (lo.astype(np.int64) << 16) | (n.astype(np.int64) << 8) | off.astype(np.int64)


def unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 16, (at >> 8) & 255, at & 255


def columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) for c in names]


def table(names: str, *values: np.ndarray | pa.Array) -> pa.RecordBatch:
    return pa.record_batch([v if isinstance(v, pa.Array) else pa.array(v.view(np.int64) if v.dtype == np.uint64 else v, pa.int64()) for v in values], names.split())


def combine(key: np.ndarray, win: np.ndarray, doc: np.ndarray, row: np.ndarray, at: np.ndarray, within: bool) -> pa.RecordBatch:
    """Windows of a batch; those that repeat earlier ones of the batch are marked so by a null doc, and spread by their place.

    within: repeats inside one document count.
    """
    order = np.lexsort((at, row, doc, win, key))
    key, win, doc, row, at = (x[order] for x in (key, win, doc, row, at))
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (win[1:] != win[:-1])
    first = fresh if within else doc == doc[np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))] if len(key) else fresh
    spread = common.mix(row.astype(np.uint64) * np.uint64(31) + at.astype(np.uint64))
    return table("key win doc row at", np.where(first, key, spread.view(np.int64)), win, pa.array(doc, pa.int64(), mask=~first), row, at)


def sift(windows: DataFrame, within: bool) -> DataFrame:
    """Repeats (doc is null) and, of keys with several stretches, the first occurrence of each stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, wins = None, 0  # key, win and doc of the last row; stretches of its key so far, as far as 2
        held: list[tuple[np.ndarray, ...]] = []  # first occurrences of a key with one stretch so far
        for batch in batches:
            known = batch.column("doc").is_valid().to_numpy(zero_copy_only=False)
            if not known.all():
                row, at = columns(batch, "row", "at")
                row, at = row[~known], at[~known]
                yield table("key doc row at", np.zeros(len(row), np.int64), pa.nulls(len(row), pa.int64()), row, at)
                batch = batch.filter(pa.array(known))
            m = batch.num_rows
            if not m:
                continue
            key, win, doc, row, at = columns(batch, "key", "win", "doc", "row", "at")
            new_key, new_win = np.ones(m, bool), np.ones(m, bool)
            new_key[1:] = key[1:] != key[:-1]
            new_win[1:] = new_key[1:] | (win[1:] != win[:-1])
            if last is not None:
                new_key[0] = key[0] != last[0]
                new_win[0] = new_key[0] or win[0] != last[1]
            if within:
                first = new_win
            else:
                at_win = np.maximum.accumulate(np.where(new_win, np.arange(m), -1))
                first = doc == np.where(at_win >= 0, doc[np.maximum(at_win, 0)], last[2] if last is not None else 0)
                last_doc = doc[at_win[-1]] if at_win[-1] >= 0 else last[2]
            group = np.cumsum(new_key)  # 0: the key of the last batch goes on
            n_wins = np.bincount(group, new_win, group[-1] + 1)
            n_wins[0] += wins
            if held and n_wins[0] > 1:
                yield from (table("key doc row at", *x) for x in held)
                held = []
            elif group[-1] > 0:
                held = []
            several = n_wins[group] > 1
            out = first & several
            yield table("key doc row at", key[out], doc[out], row[out], at[out])
            again = ~first
            yield table("key doc row at", key[again], pa.nulls(int(again.sum()), pa.int64()), row[again], at[again])
            wins = min(2, int(n_wins[-1]))
            if wins == 1:
                open_ = first & (group == group[-1])
                held.append((key[open_], doc[open_], row[open_], at[open_]))
            last = (key[-1], win[-1], doc[-1] if within else last_doc)

    dealt = windows.repartition(common.partitions(windows.sparkSession), "key").sortWithinPartitions("key", "win", "doc", "row", "at")
    return dealt.mapInArrow(run, SIFTED)


class Feed:
    """Rows that arrive sorted by file and row, handed out up to a given row."""

    def __init__(self, batches: Iterator[pa.RecordBatch], names: list[str]):
        self.chunks, self.names, self.held = self._split(batches), names, None

    def _split(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
        for batch in batches:
            file, *rows = columns(batch, "file", *self.names)
            for f in np.unique(file):
                yield int(f), [x[file == f] for x in rows]

    def file(self) -> int | None:
        """The next file."""
        if self.held is None:
            self.held = next(self.chunks, None)
        return None if self.held is None else self.held[0]

    def take(self, file: int, last: int) -> list[np.ndarray]:
        out = []
        while self.file() == file:
            rows = self.held[1]
            to = int(np.searchsorted(rows[0], last, "right"))
            out.append([x[:to] for x in rows])
            if to < len(rows[0]):
                self.held = (file, [x[to:] for x in rows])
                break
            self.held = None
        return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64) for _ in self.names]


def at_texts(found: DataFrame, path: str, n_files: int, work: Callable, schema: str, batch_rows: int = 400) -> DataFrame:
    """Deals rows (row and others) to the files of the store; work(batch of texts, its found rows as arrays, their text's place in the batch) gives record batches.

    Each file is one task; it streams the file beside the rows found for it. Every file is visited, also without rows.
    """
    spark = found.sparkSession
    names = ["row", *(c for c in found.columns if c != "row")]
    empty = {c: F.lit(0 if kind == "bigint" else "").cast(kind) for c, kind in found.dtypes}
    blank = spark.range(n_files).select(F.lit(-1).cast("long").alias("row"), *(empty[c].alias(c) for c in names[1:]), F.col("id").cast("int").alias("file"))
    numbered = found.select(*names, F.shiftright("row", FILE_BITS).cast("int").alias("file")).unionByName(blank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        filesystem, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        feed = Feed(batches, names)
        while (file := feed.file()) is not None:
            feed.take(file, -1)
            name = f"{root}/part-{file:05d}{ending}"
            if filesystem.get_file_info(name).type == fs.FileType.File:  # a part without rows has no file
                with filesystem.open_input_file(name) as f:
                    for texts in pq.ParquetFile(f).iter_batches(batch_size=batch_rows):
                        numbers = texts.column("row").to_numpy()
                        part = feed.take(file, int(numbers[-1]))
                        yield from work(texts, part, part[0] - numbers[0])
            feed.take(file, 2**63 - 1)

    if not n_files:
        return spark.createDataFrame([], schema)
    # All files of one writing job end alike, so that a task knows its file's name and needs no listing of the folder.
    ending = spark.read.schema("row long").parquet(path).select(F.regexp_extract(F.col("_metadata.file_name"), r"^part-\d+(.*)$", 1)).first()[0]
    return numbered.repartitionById(n_files, "file").sortWithinPartitions("file", "row").select("file", *names).mapInArrow(run, schema)


def covered(n: int, starts: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """Which of n places lie in a window of width that starts in one of the runs."""
    marks = np.zeros(n + 1, np.int32)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + lengths - 1 + width, -1)
    return np.cumsum(marks[:-1]) > 0

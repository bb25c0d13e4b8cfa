"""What the training-data operators share: the shared folder, batch sizes and vectorised text hashing."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.shipping import ship

#: Separators of words, as bytes: the space and 9 to 13.
WORD = re.compile("[^\x20\x09-\x0d]+")
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Text bytes that are hashed at once; bounds a worker's memory.
SLICE = 1 << 20
#: Bytes from which a word is hashed by itself.
LONG_WORD = 256
ARROW_ROWS, ARROW_BYTES = 2000, 8 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, so that a batch of long texts fits beside the JVM."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; it goes when the application ends. On one machine a temporary folder serves."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(top)
    path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def save(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df as a written table in the shared folder: lost executors can't take it, and its lineage ends."""
    spark = df.sparkSession
    path = path or shared_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.saved_at = path
    return table


def discard(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Deletes tables of save (or paths) that nothing reads any more, so that the shared folder holds what is in use."""
    for x in tables:
        drop_path(spark, x if isinstance(x, str) else x.saved_at)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id, as doc_id long, and the text, a null one as empty; whatever else df has can't clash."""
    return df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrays(batch: pa.RecordBatch | pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column without nulls as its bytes and its offsets."""
    col = batch.column(column)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32, len(col) + 1, col.offset * (8 if wide else 4)).astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(n: int, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random words for the bytes, and the powers of an odd base and of its inverse."""
    if salt not in _tables or len(_tables[salt][1]) < n:
        base = int(mix(np.array([_BASE + 2 * salt], _U))[0]) | 1
        size = max(n, SLICE + 4096)
        up, down = np.full(size, base, _U), np.full(size, pow(base, -1, 1 << 64), _U)
        up[0] = down[0] = 1
        _tables[salt] = (mix(np.arange(256, dtype=_U) + _U(1 + (salt << 8))), np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U))
    return _tables[salt]


def range_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each raw[start:end]; equal bytes give equal hashes wherever they stand. For slices of bounded size."""
    table, up, down = _powers(len(raw) + 1, salt)
    sums = np.zeros(len(raw) + 1, _U)
    np.cumsum(table[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def _lanes(raw: np.ndarray) -> np.ndarray:
    """At each byte, it and the seven behind it as one number."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray((len(raw) + 1,), "<u8", padded, 0, (1,))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, salts: tuple[int, ...] = (0,)) -> list[np.ndarray]:
    """For each salt, a 64-bit hash of each raw[start:end].

    A word is cut into lanes of eight bytes. Each is mixed with its place and the length before they are added up, so no
    algebra of the bytes carries over to the sum; a word of up to eight bytes is mixed one to one, given its length.
    """
    sizes, lanes, step = ends - starts, _lanes(raw), _U(0xD6E8FEB86659FD93)
    out = [np.zeros(len(starts), _U) for _ in salts]
    seeds = [mix(np.array([_BASE + 2 * salt], _U))[0] for salt in salts]
    masks = (_U(1) << (np.arange(8, dtype=_U) * _U(8))) - _U(1)
    masks = np.append(masks, ~_U(0))
    long = np.flatnonzero(sizes > LONG_WORD)
    some = np.flatnonzero(sizes <= LONG_WORD) if len(long) else None
    for j in range(0, int(min(sizes.max(), LONG_WORD)) if len(sizes) else 0, 8):
        if j or some is not None:
            some = np.flatnonzero((sizes > j) & (sizes <= LONG_WORD)) if some is None else some[sizes[some] > j]
        begin, size = (starts, sizes) if some is None else (starts[some], sizes[some])
        lane = lanes[begin + j] & masks[np.minimum(size - j, 8)]
        place = (size.astype(_U) + _U(j << 32)) * step
        for seed, h in zip(seeds, out, strict=True):
            if some is None:
                h += mix(mix(lane + seed) + place)
            else:
                h[some] += mix(mix(lane + seed) + place)
    for i in long.tolist():  # by itself: as many lanes as it takes
        n = int(sizes[i])
        at = np.arange(0, n, 8)
        lane = lanes[starts[i] + at] & masks[np.minimum(n - at, 8)]
        place = (_U(n) + (at.astype(_U) << _U(32))) * step
        for seed, h in zip(seeds, out, strict=True):
            h[i] = mix(mix(lane + seed) + place).sum(dtype=_U)
    return [mix(h) for h in out]


def words(raw: np.ndarray, offsets: np.ndarray, salts: tuple[int, ...] = (0,)) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """The words of a batch of texts: starts, ends, the index of the first word of each text (and the total), hashes for each salt."""
    inside = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets[(offsets > 0) & (offsets < len(raw))]] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
    first = np.searchsorted(starts, offsets)
    return starts, ends, first, word_hashes(raw, starts, ends, salts)


def slices(raw: np.ndarray, offsets: np.ndarray, size: int = SLICE):
    """Runs of whole texts of about size bytes: (first text, last text + 1)."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, to
        at = to

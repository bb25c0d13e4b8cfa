"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A paragraph (a line) becomes a wide vector: EXACT lanes of 64 bits from a cryptographic hash, and LANES lanes of 16 bits, the
sum of one signed unit for each of its word shingles. A fingerprint is the sum of the paragraphs' vectors, lane by lane
modulo 2**64 and 2**16. So the order of paragraphs has no influence, and a paragraph is inserted or deleted by adding
or subtracting its vector. The exact lanes tell equality; the others estimate how much two texts share, as
the squared length of a difference of sums is an unbiased estimate of the squared difference of the counts.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common

EXACT, LANES, SHINGLE = 4, 256, 3
#: Ranges of ids for each shuffle partition, so that partitions come out even.
RANGES = 8
_U = np.uint64
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The exact lanes and the counting lanes of each text."""
    exact = np.zeros((len(texts), EXACT), _U)
    counts = np.zeros((len(texts), LANES), np.uint16)
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    for i, t in enumerate(coded):
        digests = b"".join([hashlib.blake2b(p, digest_size=8 * EXACT).digest() for p in t.split(b"\n")])
        exact[i] = np.frombuffer(digests, _U).reshape(-1, EXACT).sum(0, dtype=_U)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in coded])]).astype(np.int64)
    raw = np.frombuffer(b"".join(coded), np.uint8)
    for low, high in common.slices(raw, offsets):
        counts[low:high] = _counts(raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
    return exact, counts


def _counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    starts, _, first, (hashes,) = common.words(raw, offsets)
    n = len(starts)
    line = np.searchsorted(np.union1d(np.flatnonzero(raw == 10), offsets[1:] - 1), starts)
    text = np.searchsorted(offsets, starts, "right") - 1
    grams = np.zeros(n, _U)
    opens = np.ones(n, bool)
    opens[1:] = line[1:] != line[:-1]
    size = np.zeros(n, np.int64)
    for j in range(SHINGLE):
        same = np.zeros(n, bool)
        same[: n - j] = line[j:] == line[: n - j] if n > j else False
        at = np.flatnonzero(same)
        grams[at] = common.mix(grams[at] * _U(0x9E3779B97F4A7C15) + hashes[at + j])
        size[at] += 1
    used = (size == SHINGLE) | (opens & (size > 0))
    grams, text = grams[used], text[used]
    places = text * LANES + (grams & _U(LANES - 1)).astype(np.int64)
    signs = ((grams >> _U(40)) & _U(1)).astype(np.float64) * 2 - 1
    return np.bincount(places, signs, (len(offsets) - 1) * LANES).astype(np.int64).astype(np.uint16).reshape(-1, LANES)


def encode(exact: np.ndarray, counts: np.ndarray) -> str:
    return base64.b64encode(exact.astype("<u8").tobytes() + counts.astype("<u2").tobytes()).decode()


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(fingerprint)
    return np.frombuffer(raw[: 8 * EXACT], "<u8"), np.frombuffer(raw[8 * EXACT :], "<u2")


def insert(fingerprint: str, paragraph: str) -> str:
    """The fingerprint with one more paragraph."""
    (e, c), (exact, counts) = decode(fingerprint), vectors([paragraph])
    return encode(e + exact[0], c + counts[0])


def delete(fingerprint: str, paragraph: str) -> str:
    """The fingerprint with one paragraph less."""
    (e, c), (exact, counts) = decode(fingerprint), vectors([paragraph])
    return encode(e - exact[0], c - counts[0])


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """1 for equal fingerprints; else the shared part of the shingle counts, as estimated from the counting lanes."""
    if (a[0] == b[0]).all():
        return 1.0
    square = lambda x: float((x.astype(np.int16).astype(np.float64) ** 2).sum())
    both = square(a[1]) + square(b[1])
    return min(1.0, max(0.0, 1 - square(a[1] - b[1]) / both)) if both else 0.0


def _dealt(texts: DataFrame, n_ranges: int) -> DataFrame:
    """The rows by ranges of ids, and after each range the row that follows its last one: carry is 1 there."""
    keyed = texts.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(2**63))).alias("pos"), F.xxhash64("text").alias("tie"))
    cuts = keyed.agg(F.percentile_approx("pos", [i / n_ranges for i in range(1, n_ranges)], 20 * n_ranges).alias("x")).first()["x"] if n_ranges > 1 else []
    bounds = sorted(set(cuts or []))

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.array(bounds, np.int64)
        for batch in batches:
            part = np.searchsorted(at, batch.column("pos").to_numpy(), "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int64())], [*batch.schema.names, "part"])

    ranked = keyed.mapInArrow(ranged, "doc_id long, text string, pos long, tie long, part long")
    heads = keyed.select("pos", "tie").mapInArrow(ranged, "pos long, tie long, part long").groupBy("part").agg(F.max(F.struct("pos", "tie")).alias("head")).orderBy("part").collect()  # a row for each range
    follows = {}  # by part: the position and tie of its first row, and the part whose last row it follows
    for i, r in enumerate(heads):
        follows[r["part"]] = (r["head"]["pos"], r["head"]["tie"], heads[(i + 1) % len(heads)]["part"])

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            pos, tie, part = (batch.column(c).to_numpy() for c in ("pos", "tie", "part"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.zeros(n, np.int32))], [*batch.schema.names, "carry"])
            for i in range(n):
                head = follows[int(part[i])]
                if head[0] == pos[i] and head[1] == tie[i]:
                    row = batch.slice(i, 1)
                    yield pa.RecordBatch.from_arrays([*row.columns[:-1], pa.array([head[2]], pa.int64()), pa.array([1], pa.int32())], [*batch.schema.names, "carry"])

    return ranked.mapInArrow(carried, "doc_id long, text string, pos long, tie long, part long, carry int")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next row is the one with the next smaller id, after the least one the first; rows with one id follow each other by a hash of the text,
    and rows without an id come last. A null text counts as empty, and a single row is its own next. An empty table gives no rows.
    Other columns of df are left out.
    """
    spark = common.prepare(df.sparkSession)
    n = common.partitions(spark)
    dealt = _dealt(common.id_text(df, id_col, text_col), RANGES * n).repartition(n, "part").sortWithinPartitions("part", "carry", F.col("pos").desc(), F.col("tie").desc())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last row, until the next one is there

        def made(rows: list[tuple]) -> pa.RecordBatch | None:
            """rows in order; each but the last is done if the next one belongs to its range and it is no carried row."""
            texts = [r[1] for r in rows]
            todo = [i for i in range(len(rows) - 1) if not rows[i][3] and rows[i][2] == rows[i + 1][2]]
            if not todo:
                return None
            edited = []
            for i in todo:
                half = len(texts[i]) // 2
                edited.append(texts[i][: len(texts[i]) - half] + texts[i + 1][:half])
            own, other = vectors(texts), vectors(edited)
            mine, theirs = list(zip(*own, strict=True)), list(zip(*other, strict=True))
            return pa.record_batch(
                [
                    pa.array([rows[i][0] for i in todo], pa.int64()), pa.array([len(texts[i]) for i in todo], pa.int64()), pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
                    pa.array([encode(*mine[i]) for i in todo]), pa.array([encode(*v) for v in theirs]), pa.array([likeness(mine[i], v) for i, v in zip(todo, theirs, strict=True)]), pa.array([likeness(mine[i], mine[i + 1]) for i in todo]),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                rows = held + list(zip(*(batch.column(c).slice(low, 500).to_pylist() for c in ("doc_id", "text", "part", "carry")), strict=True))
                if (out := made(rows)) is not None:
                    yield out
                held = rows[-1:]

    return dealt.select("doc_id", "text", "part", "carry").mapInArrow(run, OUT)


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(common.documents(spark, sf_dir))

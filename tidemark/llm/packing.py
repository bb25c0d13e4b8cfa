"""Best-fit packing, planned on the histogram of lengths.

The documents are cut into pieces of at most ``capacity`` tokens. Only the number of pieces of each length (at most
``capacity`` rows) reaches the driver, where best-fit decreasing runs over those counts: a decision places a whole run
of equal pieces at once. The plan is a list of slot runs; a piece takes its slot by joining on its rank within its
length. Memory on the driver depends on the capacity, never on the rows.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.llm import common

CAPACITY, EOS, VOCABULARY = 1024, 2, "byte_bpe_50k"
#: Pieces in a rank bucket, on average: ranks within a length are counted bucket by bucket.
BUCKET = 500_000
#: Least number of rank buckets.
BUCKETS = 256
#: Word encodings that a worker keeps.
CACHED = 200_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: A word's beginning: one space between two others, where the vocabulary's pattern always cuts.
CUT = re.compile(r"(?<=\S) (?=\S)")

_encoders: dict[str, object] = {}


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes. Each different word is encoded once while it is cached."""

    def __init__(self, vocabulary: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.special = "<|endoftext|>"
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={self.special: len(ranks)})
        self.known: dict[str, bytes] = {}

    def fresh(self, word: str) -> bytes:
        ids = self.bpe.encode(word, allowed_special="all") if self.special in word else self.bpe.encode_ordinary(word)
        return np.array(ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = CUT.split(text)
        known = self.known
        if len(known) > CACHED:
            known.clear()
        out = [self.fresh(first)]
        for word in rest:
            got = known.get(word)
            if got is None:
                got = self.fresh(" " + word)
                if len(word) < 64:
                    known[word] = got
            out.append(got)
        return b"".join(out)


def encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n tokens; only the first piece may be short."""
    short = (n - 1) % capacity + 1
    return [(0, short), *((at, capacity) for at in range(short, n, capacity))]


def pieces(df: DataFrame, capacity: int = CAPACITY, eos: int = EOS, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each piece of each document: the ids of its text, then the end mark."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary), np.array([eos], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encode(text.as_py()) + end
                rows += [(doc_id, k, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])) for k, (at, n) in enumerate(cut(len(ids) // 4, capacity))]
            if rows:
                doc_id, piece, start, length, crc = zip(*rows, strict=True)
                yield pa.record_batch([pa.array(doc_id, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.mapInArrow(encode, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, pieces, first sequence, used, per sequence) for each run of slots.

    Piece j of a run goes to sequence ``first + j // per``, behind ``used + (j % per) * length`` tokens. The tightest
    sequences that still take a piece are filled first; a piece put into one makes it tighter still, so it goes on
    taking pieces of that length until it can't.
    """
    rooms: list[tuple[int, int, int]] = []  # (room left, first sequence, sequences), sorted
    slots, opened = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        k = bisect.bisect_left(rooms, (length, -1, -1))
        after: list[tuple[int, int, int]] = []
        while left:
            if k < len(rooms):
                room, first, n = rooms.pop(k)
            else:
                room, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            per = room // length
            took = min(left, n * per)
            slots.append((length, rank, took, first, capacity - room, per))
            full, rest = divmod(took, per)
            after += [(room - per * length, first, full)] * (full > 0) + [(room - rest * length, first + full, 1)] * (rest > 0)
            used = full + (rest > 0)
            after += [(room, first + used, n - used)] * (n > used)
            rank, left = rank + took, left - took
        for x in after:
            if x[0]:
                bisect.insort(rooms, x)
    return slots


def place(cut_up: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Gives each row of a written table of pieces a sequence_id and an offset.

    Ranks within a length are a bucket's share plus the rank in the bucket, so that no task sees all pieces of a
    frequent length.
    """
    spark = cut_up.sparkSession
    counts = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count("*").alias("n")).collect()}
    total, n_parts = sum(counts.values()), common.partitions(spark)
    buckets = max(BUCKETS, total // BUCKET)
    slots = spark.createDataFrame(plan(counts, capacity) or [], "length long, first_rank long, n long, first_sequence long, used long, per long")
    keyed = cut_up.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    shares = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    shares = shares.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = keyed.withColumn("place", F.row_number().over(within) - 1).join(shares, ["length", "bucket"]).withColumn("rank", F.col("place") + F.col("before"))
    r, s = ranked.alias("r"), F.broadcast(slots).alias("s")  # slots: bounded by the capacity alone
    j = F.col("r.rank") - F.col("s.first_rank")
    joined = r.join(s, (F.col("r.length") == F.col("s.length")) & (j >= 0) & (j < F.col("s.n")))
    return joined.select(
        "r.doc_id", "r.piece", "r.start", "r.length", "r.ids_crc32",
        (F.col("s.first_sequence") + F.floor(j / F.col("s.per"))).cast("long").alias("sequence_id"),
        (F.col("s.used") + (j % F.col("s.per")) * F.col("s.length")).cast("long").alias("offset"),
    )


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, eos: int = EOS, vocabulary: str = VOCABULARY) -> DataFrame:
    """Packs the documents of df into sequences of at most ``capacity`` tokens.

    Null and empty texts have the end mark alone. Repeated rows and rows without an id are packed as often as they
    stand there; equal lengths are told apart by id, piece and checksum, and which of two equal pieces takes which of
    two equal slots is of no consequence. An empty table gives no rows. Other columns of df are left out.
    """
    common.prepare(df.sparkSession)
    return place(common.save(pieces(common.id_text(df, id_col, text_col), capacity, eos, vocabulary), "pieces"), capacity)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir))

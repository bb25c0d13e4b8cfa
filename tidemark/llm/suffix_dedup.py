"""Substring dedup: bytes in strings of WIDTH bytes that occur earlier go, as sorted suffixes tell.

Every string of WIDTH bytes has an anchor, its GRAM-byte string with the least hash; equal strings have equal anchors at equal
places. Neighbouring starts with one anchor form a stretch. Where the whole stretch occurs again, its later
occurrences go. Where stretches with one anchor differ, they are cut into fragments whose starts share a core, and the
different fragments of a core are sorted as suffixes, with one symbol in the core's place: starts whose suffixes agree on as
many symbols as WIDTH bytes make stand together in the order, and all but the earliest of them are repeats. A core is told by two independent
hashes, and only the bytes around it travel. Cores with very many fragments are taken apart into
their single starts instead, which again go by the sifting of whole stretches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, repeats
from tidemark.llm.suffixes import suffix_array

WIDTH, GRAM = 100, 32
#: Anchor places in a string; offsets of a start from its anchor that share a core.
PLACES, SHARE = WIDTH - GRAM + 1, 18
#: Bytes of a string outside its core.
AROUND = SHARE - 1
#: Symbols of fragments that are sorted at once, and fragments of a core from which it is taken apart.
SORTED, MANY = 1 << 18, 2000
_U = np.uint64
FRAGMENTS = "core long, proof long, doc long, row long, start long, left long, piece binary"
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Of each window of width values, the least."""
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[: len(values) - (width - done)], values[width - done :]) if width > done else values


def stretches(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """(text, first start, starts, anchor's offset from it, key, hash) of each stretch in a slice of texts."""
    if len(raw) < WIDTH:
        return None
    at = np.arange(len(raw) - GRAM + 1)
    grams = common.range_hashes(raw, at, at + GRAM)
    low = _U((1 << 24) - 1)
    if len(raw) > 1 << 24:
        raise ValueError("a slice has to be shorter than 2 ** 24 bytes")
    anchor = (_least((grams & ~low) | at.astype(_U), PLACES) & low).astype(np.int64)
    ends = offsets[1:]
    change = np.zeros(len(raw) + 1, np.int32)  # starts whose string would leave its text
    np.add.at(change, np.maximum(ends - WIDTH + 1, offsets[:-1]), 1)
    np.add.at(change, ends, -1)
    starts = (np.cumsum(change) <= 0)[: len(anchor)]
    p = np.flatnonzero(starts)
    if not len(p):
        return None
    a = anchor[p]
    opens = np.ones(len(p), bool)
    opens[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(opens)
    n = np.diff(np.append(first, len(p)))
    p, a = p[first], a[first]
    text = np.searchsorted(offsets, p, "right") - 1
    return text, p - offsets[text], n, a - p, grams[a], common.range_hashes(raw, p, p + n - 1 + WIDTH)


def _pieces(raw: np.ndarray, offsets: np.ndarray, size: int = common.SLICE) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """Slices of bounded size: (first text, first byte in it, bytes, offsets). A longer text is cut with an overlap, so each start is in one piece."""
    for low, high in common.slices(raw, offsets, size):
        begin, end = offsets[low], offsets[high]
        if end - begin <= 4 * size:
            yield low, 0, raw[begin:end], offsets[low : high + 1] - offsets[low]
            continue
        for at in range(begin, end - WIDTH + 1, size):
            part = raw[at : min(at + size + WIDTH - 1, end)]
            yield low, at - begin, part, np.array([0, len(part)])


def _windows(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = common.arrays(batch, "text")
            doc, row = repeats.columns(batch, "doc", "row")
            parts = []
            for first, byte, part, at in _pieces(raw, offsets):
                if (found := stretches(part, at)) is not None:
                    text, lo, n, off, key, win = found
                    parts.append((key, win, doc[first + text], row[first + text], repeats.pack(lo + byte, n, off)))
            if parts:
                key, win, doc, row, at = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield repeats.combine(key.view(np.int64), win.view(np.int64), doc, row, at, within=True)

    return texts.mapInArrow(run, repeats.WINDOWS)


def _fragments(texts: pa.RecordBatch, found: list[np.ndarray], place: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The starts of differing stretches, by the core that they share."""
    if not len(place):
        return
    raw, offsets = common.arrays(texts, "text")
    (doc,) = repeats.columns(texts, "doc")
    lo, n, off = repeats.unpack(found[1])
    a = lo + off
    for part in range(-(-PLACES // SHARE)):
        near, far = part * SHARE, part * SHARE + SHARE - 1  # offsets of a start before its anchor
        first, last = np.maximum(lo, a - far), np.minimum(lo + n - 1, a - near)
        some = np.flatnonzero(first <= last)
        if not len(some):
            continue
        base = offsets[place[some]]
        begin, end = base + first[some], base + last[some] + WIDTH
        core_from, core_to = base + a[some] - near, base + a[some] - far + WIDTH
        core, proof = np.empty(len(some), _U), np.empty(len(some), _U)
        order = np.argsort(core_from, kind="stable")
        at = 0
        while at < len(order):  # in slices of bounded size
            to = max(at + 1, int(np.searchsorted(core_from[order], core_from[order[at]] + common.SLICE)))
            low, high = core_from[order[at]], core_to[order[at:to]].max()
            core[order[at:to]], proof[order[at:to]] = (common.range_hashes(raw[low:high], core_from[order[at:to]] - low, core_to[order[at:to]] - low, salt) for salt in (1, 2))
            at = to
        core = common.mix(core + _U(part))
        view = memoryview(np.ascontiguousarray(raw))
        pieces = [bytes(view[w:x]) + bytes(view[y:z]) for w, x, y, z in zip(begin.tolist(), core_from.tolist(), core_to.tolist(), end.tolist(), strict=True)]
        yield repeats.table("core proof doc row start left piece", core, proof, doc[place[some]], found[0][some], first[some], core_from - begin, pa.array(pieces, pa.binary()))


def repeated_starts(pieces: list[bytes], lefts: list[int], cores: list[int], docs: list[int], rows: list[int], starts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(fragment, offset) of each start whose string has an earlier occurrence among the fragments. cores: numbers of their cores, behind lefts bytes."""
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes + 2)  # with the core's symbol, and a 0 that ends the fragment
    first = ends - sizes - 2
    symbols = np.zeros(ends[-1], np.int64)
    bytes_ = np.ones(ends[-1], bool)
    bytes_[ends - 1] = bytes_[first + lefts] = False
    symbols[bytes_] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64) + 1
    symbols[first + lefts] = np.array(cores, np.int64) + 257
    n = sizes - AROUND + 1
    valid = np.zeros(len(symbols), bool)
    valid[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())] = True
    order = suffix_array(symbols)
    order = order[valid[order]]
    piece = np.searchsorted(ends, order, "right")
    same = np.zeros(len(order), bool)
    reach = np.arange(AROUND + 1)
    for low in range(1, len(order), 4096):
        high = min(low + 4096, len(order))
        text = symbols[order[low - 1 : high, None] + reach]
        same[low:high] = (text[1:] == text[:-1]).all(1)
    group = np.cumsum(~same)
    offset = order - first[piece]
    docs, rows, starts = (np.array(x, np.int64)[piece] for x in (docs, rows, starts))
    by = np.lexsort((starts + offset, rows, docs, group))
    later = np.zeros(len(by), bool)
    later[1:] = group[by][1:] == group[by][:-1]
    later = by[later]
    return piece[later], offset[later]


def _sorted(fragments: DataFrame) -> DataFrame:
    """(row, at): starts that repeat. Equal fragments of a core are told apart first; only different ones are sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[dict[tuple[int, bytes], list[tuple[int, int, int]]]] = []
        size, core = 0, None

        def done() -> Iterator[pa.RecordBatch]:
            row, at, n = [], [], []
            pieces, lefts, cores, docs, rows, starts = [], [], [], [], [], []
            for number, group in enumerate(groups):
                for (left, piece), places in group.items():
                    first = min(places)
                    for x in places:
                        if x != first:
                            row.append(x[1])
                            at.append(x[2])
                            n.append(len(piece) - AROUND + 1)
                    if len(group) > 1:
                        pieces.append(piece)
                        lefts.append(left)
                        cores.append(number)
                        docs.append(first[0])
                        rows.append(first[1])
                        starts.append(first[2])
            if pieces:
                piece, offset = repeated_starts(pieces, lefts, cores, docs, rows, starts)
                row += np.array(rows, np.int64)[piece].tolist()
                at += (np.array(starts, np.int64)[piece] + offset).tolist()
                n += [1] * len(piece)
            if row:
                lo, n = np.array(at, np.int64), np.array(n, np.int64)
                yield repeats.table("row at", np.array(row, np.int64), repeats.pack(lo, n, np.zeros(len(n), np.int64)))

        for batch in batches:
            for *c, doc, row, start, left, piece in zip(*(batch.column(x).to_pylist() for x in ("core", "proof", "doc", "row", "start", "left", "piece")), strict=True):
                if c != core:
                    if size >= SORTED:
                        yield from done()
                        groups, size = [], 0
                    if groups and len(groups[-1]) == 1 and len(next(iter(groups[-1].values()))) == 1:
                        size -= len(next(iter(groups.pop()))[1]) + 2
                    groups.append({})
                    core = c
                held = groups[-1].setdefault((left, piece), [])
                if not held:
                    size += len(piece) + 2
                held.append((doc, row, start))
        yield from done()

    dealt = fragments.repartition(common.partitions(fragments.sparkSession), "core").sortWithinPartitions("core", "proof")
    return dealt.mapInArrow(run, "row long, at long")


def _single(fragments: DataFrame) -> DataFrame:
    """The single starts of fragments, as stretches of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw, offsets = common.arrays(batch, "piece")
            core, proof, doc, row, start, left = repeats.columns(batch, "core", "proof", "doc", "row", "start", "left")
            n = np.diff(offsets) - AROUND + 1
            piece = np.repeat(np.arange(len(n)), n)
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = offsets[piece] + offset
            # A string is its core, the bytes around it, and how many of these stand before it.
            before = (left[piece] - offset).astype(_U)
            key, win = (common.mix(common.range_hashes(raw, at, at + AROUND, salt) + common.mix(x.view(_U)[piece] + before)) for salt, x in ((0, core), (1, proof)))
            one = np.ones(len(at), np.int64)
            yield repeats.combine(key.view(np.int64), win.view(np.int64), doc[piece], row[piece], repeats.pack(start[piece] + offset, one, 0 * one), within=True)

    return fragments.mapInArrow(run, repeats.WINDOWS)


def _kept(texts: pa.RecordBatch, found: list[np.ndarray], place: np.ndarray) -> Iterator[pa.RecordBatch]:
    raw, offsets = common.arrays(texts, "text")
    lo, n, _ = repeats.unpack(found[1])
    out = []
    cut = np.searchsorted(place, np.arange(texts.num_rows + 1))
    for i in range(texts.num_rows):
        text = raw[offsets[i] : offsets[i + 1]]
        if cut[i] == cut[i + 1]:
            out.append((len(text), 0, 0, hashlib.sha256(text).hexdigest()))
            continue
        gone = repeats.covered(len(text), lo[cut[i] : cut[i + 1]], n[cut[i] : cut[i + 1]], WIDTH)
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((len(text), int(gone.sum()), spans, hashlib.sha256(text[~gone].tobytes()).hexdigest()))
    n_bytes, n_removed, n_spans, sha = zip(*out, strict=True)
    doc, no_id = texts.column("doc").to_numpy(), texts.column("no_id").to_numpy(zero_copy_only=False)
    yield pa.record_batch([pa.array(doc, pa.int64(), mask=no_id), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(sha)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A null text counts as empty. Rows that share an id come one after the other in the order in which they are read; rows without an id come last.
    Texts shorter than a string stay as they are. An empty table gives no rows. Other columns of df are left out.
    """
    spark = common.prepare(df.sparkSession)
    path, n_files = repeats.store(common.id_text(df, id_col, text_col))
    texts = repeats.stored(spark, path)
    sifted = common.save(repeats.sift(_windows(texts), within=True), "sifted")
    found = sifted.where("doc is null").select("row", "at")
    fragments = common.save(repeats.at_texts(sifted.where("doc is not null").select("row", "at"), path, n_files, _fragments, FRAGMENTS), "fragments")
    sizes = common.save(fragments.groupBy("core", "proof").agg(F.count("*").alias("n")).where("n > 1"), "cores")
    grouped = fragments.join(sizes, ["core", "proof"])
    found = found.union(common.save(_sorted(grouped.where(F.col("n") <= MANY).drop("n")), "starts"))
    single = repeats.sift(_single(grouped.where(F.col("n") > MANY).drop("n")), within=True)
    found = found.union(common.save(single.where("doc is null").select("row", "at"), "starts"))
    return repeats.at_texts(found, path, n_files, _kept, OUT)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(common.documents(spark, sf_dir))

"""Substring dedup over words by recompression.

Words become symbols. A round first names maximal runs of one symbol, then pairs: a symbol whose coin shows 0 takes the
next one if that shows 1. Names and coins are hashes of what they stand for, so they are the same in all documents,
with no table of names to pass around, and a repeated passage gets the same symbols inside, wherever it stands.
In each window of WIDTH words, the symbols whose whole parse lies inside it are its interior symbols; the highest
one with the least name is the window's anchor. Windows that share an anchor are neighbours or repeats: equal
stretches around equal symbols show long repeats, and where stretches differ, their single windows are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import common, repeats

WIDTH, ROUNDS = 13, 2
_U = np.uint64
_A, _B = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _runs(change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First members and lengths of runs; change[i]: i opens one."""
    first = np.flatnonzero(change)
    return first, np.diff(np.append(first, len(change)))


def rounds(names: np.ndarray, text: np.ndarray, n: int = ROUNDS) -> list[tuple[np.ndarray, ...]]:
    """Of each round, the symbols (name, first word, first word and end of the words that their parse depends on), in order.

    names: of the words; text: the number of each word's text, over which no symbol reaches. Symbols whose parse depends on
    what would stand before or behind their text aren't listed.
    """
    start = np.arange(len(names))
    left, right, known = start, start + 1, np.ones(len(names), bool)
    out = []
    for r in range(1, n + 1):
        m = len(names)
        if not m:
            break
        change = np.ones(m, bool)
        change[1:] = (names[1:] != names[:-1]) | (text[1:] != text[:-1])
        first, size = _runs(change)
        letter, of = names[first], text[first]
        coin = (common.mix(letter + _U(r * int(_B) % 2**64)) & _U(1)).astype(bool)
        block = np.where(size > 1, common.mix(letter * _A + size.astype(_U)), letter)
        takes = np.zeros(len(first), bool)
        takes[:-1] = ~coin[:-1] & coin[1:] & (of[1:] == of[:-1])
        head = np.ones(len(first), bool)
        head[1:] = ~takes[:-1]
        head = np.flatnonzero(head)
        pair = takes[head]
        tail = head + pair
        low, high = first[head], first[tail] + size[tail] - 1  # the symbol's parts
        before, after = np.maximum(low - 1, 0), np.minimum(high + 1, m - 1)
        inner = (low > 0) & (text[before] == text[low]) & (high < m - 1) & (text[after] == text[high])
        left, right, known = left[before], right[after], inner & known[before] & known[after]
        names = np.where(pair, common.mix(common.mix(block[head]) * _A + block[tail]), common.mix(block[head] + _U(r)))
        start, text = start[low], text[low]
        out.append((names[known], start[known], left[known], right[known]))
    return out


def _least_in(names: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Index of the least name in each [low, high), the first of equal ones; -1 for none. Ranges are as short as a window."""
    out = np.full(len(low), -1)
    some = np.flatnonzero(high > low)
    if not len(some):
        return out
    low, size = low[some], (high - low)[some]
    best = low.copy()
    for j in range(1, int(size.max())):
        more = np.flatnonzero(size > j)
        other = low[more] + j
        better = names[other] < names[best[more]]
        best[more[better]] = other[better]
    out[some] = best
    return out


def hash_windows(names: np.ndarray, starts: np.ndarray, sizes: np.ndarray, salt: int) -> np.ndarray:
    """A hash of the words names[start:start + size]."""
    base = int(common.mix(np.array([977 + salt], _U))[0]) | 1
    powers = np.full(len(names) + 1, base, _U)
    back = np.full(len(names) + 1, pow(base, -1, 1 << 64), _U)
    powers[0] = back[0] = 1
    np.cumprod(powers, out=powers)
    np.cumprod(back, out=back)
    sums = np.zeros(len(names) + 1, _U)
    np.cumsum(common.mix(names + _U(salt)) * powers[:-1], out=sums[1:])
    return common.mix((sums[starts + sizes] - sums[starts]) * back[starts] + sizes.astype(_U) * _B)


def stretches(names: np.ndarray, proof: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """(text, first start, starts, offset of the anchor, key, hash) of windows with one anchor; first: of each text its first word, then the total.

    names and proof are two independent hashes of each word: keys and symbols are made of the names, the hashes that verify a repeat of the proofs.
    """
    sizes = np.diff(first)
    text = np.repeat(np.arange(len(sizes)), sizes)
    p = np.flatnonzero(np.arange(len(names)) + WIDTH <= np.repeat(first[1:], sizes))
    if not len(p):
        return None
    anchor, level, key = p.copy(), np.zeros(len(p), np.int64), np.zeros(len(p), _U)
    for r, (symbols, start, left, right) in reversed(list(enumerate(rounds(names, text), 1))):
        todo = np.flatnonzero(level == 0)
        best = _least_in(symbols, np.searchsorted(left, p[todo]), np.searchsorted(right, p[todo] + WIDTH, "right"))
        at, best = todo[best >= 0], best[best >= 0]
        # All words that the anchor's parse depends on are in every window that it anchors, so they make the key.
        anchor[at], level[at], key[at] = start[best], r, common.mix(symbols[best] + hash_windows(names, left[best], right[best] - left[best], 6 + r))
    alone = level == 0  # nothing but runs: a window is its own anchor
    key[alone] = hash_windows(names, p[alone], np.full(int(alone.sum()), WIDTH), 2)
    opens = np.ones(len(p), bool)
    opens[1:] = (anchor[1:] != anchor[:-1]) | (level[1:] != level[:-1]) | (p[1:] != p[:-1] + 1)
    at, n = _runs(opens)
    p, off, key = p[at], anchor[at] - p[at], key[at]
    return text[p], p - first[text[p]], n, off, key, hash_windows(proof, p, n - 1 + WIDTH, 3)


def _hashed(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    _, _, first, (names, proof) = common.words(raw, offsets, (0, 1))
    return names, proof, first


def _windows(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = common.arrays(batch, "text")
            doc, row = repeats.columns(batch, "doc", "row")
            parts = []
            for low, high in common.slices(raw, offsets):
                if (found := stretches(*_hashed(raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]))) is not None:
                    text, lo, n, off, key, win = found
                    parts.append((key, win, doc[low + text], row[low + text], repeats.pack(lo, n, off)))
            if parts:
                key, win, doc, row, at = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield repeats.combine(key.view(np.int64), win.view(np.int64), doc, row, at, within=False)

    return texts.mapInArrow(run, repeats.WINDOWS)


def _single(texts: pa.RecordBatch, found: list[np.ndarray], place: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The single windows of differing stretches."""
    if not len(place):
        return
    raw, offsets = common.arrays(texts, "text")
    (doc,) = repeats.columns(texts, "doc")
    lo, n, _ = repeats.unpack(found[1])
    for low, high in common.slices(raw, offsets):
        a, b = np.searchsorted(place, [low, high])
        if a == b:
            continue
        names, proof, first = _hashed(raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        size = n[a:b]
        which = np.repeat(np.arange(a, b), size)
        at = lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        p = first[place[which] - low] + at
        widths, one = np.full(len(p), WIDTH), np.ones(len(p), np.int64)
        key, win = hash_windows(names, p, widths, 4), hash_windows(proof, p, widths, 5)
        yield repeats.combine(key.view(np.int64), win.view(np.int64), doc[place[which]], found[0][which], repeats.pack(at, one, 0 * one), within=False)


def _kept(texts: pa.RecordBatch, found: list[np.ndarray], place: np.ndarray) -> Iterator[pa.RecordBatch]:
    lo, n, _ = repeats.unpack(found[1])
    cut = np.searchsorted(place, np.arange(texts.num_rows + 1))
    out = []
    for i, text in enumerate(texts.column("text")):
        words, gone = text.as_py().split(), 0
        if cut[i] < cut[i + 1]:
            marks = repeats.covered(len(words), lo[cut[i] : cut[i + 1]], n[cut[i] : cut[i + 1]], WIDTH)
            gone = int(marks.sum())
            kept = [w for w, g in zip(words, marks.tolist(), strict=True) if not g]
        else:
            kept = words
        out.append((len(words), gone, hashlib.sha256(b" ".join(kept)).hexdigest()))
    n_words, n_removed, sha = zip(*out, strict=True)
    doc, no_id = texts.column("doc").to_numpy(), texts.column("no_id").to_numpy(zero_copy_only=False)
    yield pa.record_batch([pa.array(doc, pa.int64(), mask=no_id), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha)], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def passage_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: doc_id, n_words, n_removed, kept_sha256.

    A null text has no words. Rows that share an id are one document, so they take nothing from each other; nor do rows without an id, which come behind all others.
    Texts with fewer words than a window stay as they are. An empty table gives no rows. Other columns of df are left out.
    """
    spark = common.prepare(df.sparkSession)
    path, n_files = repeats.store(common.id_text(df, id_col, text_col))
    texts = repeats.stored(spark, path)
    sifted = common.save(repeats.sift(_windows(texts), within=False), "sifted")
    found = sifted.where("doc is null").select("row", "at")
    single = repeats.at_texts(sifted.where("doc is not null").select("row", "at"), path, n_files, _single, repeats.WINDOWS)
    again = common.save(repeats.sift(single, within=False).where("doc is null").select("row", "at"), "again")
    return repeats.at_texts(found.union(again), path, n_files, _kept, OUT)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup(common.documents(spark, sf_dir))

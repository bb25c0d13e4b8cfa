"""Encoding and decoding with SentencePiece models, in batches of words.

Texts are cut where no piece of the model can reach over; equal cuts are encoded once, and words of one length advance
together as rows of a matrix. A hash of every substring comes from prefix sums and is looked up among the sorted hashes
of the pieces. A Viterbi pass keeps, column by column, the best last piece and a backpointer for all rows at once.

For unigram models the best path is the one with the greatest sum of scores. Models of the BPE kind have no additive score; there
a step is allowed only between pieces that merging would leave side by side, which is told from the two pieces alone: their
merges are undone from the latest one on, and no pair across their border may have come first. Every prefix then has exactly
one allowed last piece, and the path is the one that merging finds, with the library's ids.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"
#: Fixed values of the model format: kinds of models and of pieces, and what an unknown character costs.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
#: Words that a worker keeps, the longest kept one, and cells of a matrix.
CACHED, LONGEST, CELLS = 200_000, 64, 400_000
#: Characters with a table of their neighbours; the mark for a space stands at 0 there.
TABLE = 1024
#: Bits of a hash that are looked up before the sorted keys are.
FIRST_BITS = 20
#: Pairs of pieces whose decision is remembered (a power of two), and the time of what is never merged.
MEMO, NEVER = 1 << 20, 1 << 60
_U = np.uint64
_BASE = int(common.mix(np.array([20011], _U))[0]) | 1


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer's fields; fixed-size ones as bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        shift = out = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind)
        size = number() if size is None else size
        yield tag >> 3, data[at : at + size]
        at += size


@dataclass
class Model:
    pieces: list[str]
    scores: np.ndarray
    kinds: list[int]
    kind: int = UNIGRAM
    prefix: bool = True
    squeeze: bool = True
    charsmap: bytes = b""
    byte_fallback: bool = False
    unknown: int = 0
    keys: np.ndarray = field(default=None)
    ids: np.ndarray = field(default=None)
    longest: int = 1

    @classmethod
    def load(cls, data: bytes) -> Model:
        model = cls([], np.zeros(0), [])
        scores = []
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                model.pieces.append(piece.get(1, b"").decode())
                scores.append(float(np.frombuffer(piece[2], "<f4")[0]) if 2 in piece else 0.0)
                model.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
                model.kind, model.byte_fallback, model.unknown = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), trainer.get(40, 0)
            elif number == 3:
                normal = dict(_fields(value))
                model.charsmap, model.prefix, model.squeeze = normal.get(2, b""), bool(normal.get(3, 1)), bool(normal.get(4, 1))
        model.scores = np.array(scores)
        return model.indexed()

    def indexed(self) -> Model:
        if self.charsmap or self.kind not in (UNIGRAM, BPE) or USER in self.kinds:
            raise ValueError("models with a character map, with user-defined pieces, or of another kind than unigram and BPE aren't supported")
        usable = [i for i, k in enumerate(self.kinds) if k == NORMAL]
        self.longest = max((len(self.pieces[i]) for i in usable), default=1)
        hashes = np.array([_hash_of(self.pieces[i]) for i in usable], _U)
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], np.array(usable, np.int64)[order]
        self.first_bits = np.zeros(1 << FIRST_BITS, bool)
        self.first_bits[self.keys >> _U(64 - FIRST_BITS)] = True
        self.by_byte = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == BYTE}
        self.single = {self.pieces[i]: i for i in usable if len(self.pieces[i]) == 1}
        # Neighbouring characters that stand so in some piece; no piece reaches over others.
        self.joined = {p[j : j + 2] for i in usable for p in [self.pieces[i]] for j in range(len(p) - 1)}
        self.inner_space = any(SPACE in self.pieces[i].lstrip(SPACE) for i in usable)
        self.decoded = [p.replace(SPACE, " ").encode() if k == NORMAL else bytes([int(p[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else b"" for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.least = min((self.scores[i] for i in usable), default=0.0) - UNKNOWN_PENALTY
        if self.kind == BPE:
            self.neighbours = Neighbours(self, usable)
        return self


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1)


def _sums(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of each row and the powers to shift them back."""
    n = codes.shape[1]
    up = np.array([pow(_BASE, i, 1 << 64) for i in range(n + 1)], _U)
    down = np.array([pow(_BASE, -i, 1 << 64) for i in range(n + 1)], _U)
    sums = np.zeros((len(codes), n + 1), _U)
    np.cumsum(common.mix(codes.astype(_U) + _U(1)) * up[:n], axis=1, out=sums[:, 1:])
    return sums, down


def _hash_of(word: str) -> int:
    sums, _ = _sums(_codes([word]))
    return int(common.mix(sums[:, -1])[0])


def _probe(model: Model, hashes: np.ndarray) -> np.ndarray:
    """The piece of each hash, -1 for none. Hashes whose first bits no key has are left out before the sorted keys are searched."""
    out = np.full(hashes.shape, -1, np.int64)
    some = np.nonzero(model.first_bits[hashes >> _U(64 - FIRST_BITS)])
    found = hashes[some]
    at = np.minimum(np.searchsorted(model.keys, found), len(model.keys) - 1)
    out[some] = np.where(model.keys[at] == found, model.ids[at], -1)
    return out


def viterbi(model: Model, codes: np.ndarray) -> tuple[np.ndarray, ...]:
    """The best segmentation of each row, as of _traced, with piece -1 for an unknown character. Of equal scores the one with the longer last piece wins."""
    rows, n = codes.shape
    sums, down = _sums(codes)
    best = np.full((rows, n + 1), -np.inf)
    best[:, 0] = 0
    back, piece = np.zeros((rows, n + 1), np.int32), np.full((rows, n + 1), -1, np.int64)
    for j in range(1, n + 1):
        for size in range(min(model.longest, j), 0, -1):
            i = j - size
            found = _probe(model, common.mix((sums[:, j] - sums[:, i]) * down[i]))
            score = np.where(found >= 0, model.scores[found], model.least if size == 1 else -np.inf) + best[:, i]
            better = score > best[:, j]
            best[better, j], back[better, j], piece[better, j] = score[better], i, found[better]
    return _traced(back, piece)


def _traced(back: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, ...]:
    """The paths that the backpointers give, all rows' steps in a line: start, end, piece, and how many steps each row has."""
    rows, n = len(back), back.shape[1] - 1
    at, steps = np.full(rows, n), []
    row = np.arange(rows)
    while len(row):
        before = back[row, at]
        steps.append((row, before, at, piece[row, at]))
        row, at = row[before > 0], before[before > 0]
    row, start, end, found = (np.concatenate(x) for x in zip(*steps, strict=True))
    order = np.lexsort((start, row))
    return start[order], end[order], found[order], np.bincount(row, minlength=rows)


class Neighbours:
    """Which pieces of a BPE model may stand side by side."""

    def __init__(self, model: Model, usable: list[int]):
        n = len(model.pieces)
        self.n = n
        order = sorted((i for i in usable if len(model.pieces[i]) > 1), key=lambda i: -model.scores[i])
        #: When a piece is made by merging, -1 for single characters; its two parts; whether merging makes it at all.
        self.made, self.left, self.right, self.whole = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        self.made[order] = np.arange(len(order))
        by: dict[int, list[int]] = {}
        for i in usable:
            by.setdefault(len(model.pieces[i]), []).append(i)
        for size, same in by.items():
            if size == 1:
                self.whole[same] = True
                continue
            for i, cuts in zip(same, merges(model, _codes([model.pieces[i] for i in same]), size - 1), strict=True):
                if len(cuts) == 2 and min(cuts[0][2], cuts[1][2]) >= 0:
                    self.left[i], self.right[i], self.whole[i] = cuts[0][2], cuts[1][2], True
        ids = {model.pieces[i]: i for i in usable}
        pairs = {ids[p[:k]] * n + ids[p[k:]]: self.made[i] for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.joined = np.array([pairs[k] for k in self.pairs.tolist()], np.int64)
        self.known, self.answers = np.full(MEMO, -1, np.int64), np.zeros(MEMO, bool)

    def _joins(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """When a and b would be merged, a large number for never."""
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.pairs, key), max(0, len(self.pairs) - 1))
        return np.where(self.pairs[at] == key, self.joined[at], NEVER) if len(self.pairs) else np.full(len(key), NEVER)

    def _decide(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, at = np.zeros(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), NEVER)
        while len(at):
            open_ = self._joins(a, b) >= limit
            at, a, b = at[open_], a[open_], b[open_]
            made_a, made_b = self.made[a], self.made[b]
            out[at[(made_a < 0) & (made_b < 0)]] = True
            rest = (made_a >= 0) | (made_b >= 0)
            at, a, b, made_a, made_b = at[rest], a[rest], b[rest], made_a[rest], made_b[rest]
            later = made_a > made_b
            # Of equal merges the left one comes first.
            limit = np.where(later, made_a, made_b + 1)
            a, b = np.where(later, self.right[a], a), np.where(later, b, self.left[b])
        return out

    def may(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair whether merging leaves b right behind a; decisions are remembered."""
        key = a * self.n + b
        slot = (common.mix(key.astype(_U)) & _U(MEMO - 1)).astype(np.int64)
        new = np.flatnonzero(self.known[slot] != key)
        out = self.answers[slot]
        if len(new):
            out[new] = self._decide(a[new], b[new])
            self.known[slot[new]] = key[new]
            self.answers[slot[new]] = out[new]
            if len(np.unique(slot[new])) < len(new):  # pairs of this call that share a slot: the last key and its own answer stand there
                self.answers[slot[new]] = out[new]
        return out


def paths(model: Model, codes: np.ndarray) -> tuple[np.ndarray, ...]:
    """The path of allowed steps through each row, as of _traced, with piece -1 for an unknown character."""
    rows, n = codes.shape
    sums, down = _sums(codes)
    near = model.neighbours
    back, piece = np.zeros((rows, n + 1), np.int32), np.full((rows, n + 1), -1, np.int64)
    for j in range(1, n + 1):
        i = np.arange(j - 1, max(0, j - model.longest) - 1, -1)
        found = _probe(model, common.mix((sums[:, j, None] - sums[:, i]) * down[i]))
        back[:, j] = j - 1  # an unknown character, unless a piece is allowed
        row, which = np.nonzero(found >= 0)
        last, before = found[row, which], i[which]
        allowed = near.whole[last]
        inner = np.flatnonzero(allowed & (before > 0) & (piece[row, before] >= 0))
        allowed[inner] = near.may(piece[row[inner], before[inner]], last[inner])
        row, last, before = row[allowed], last[allowed], before[allowed]
        back[row, j], piece[row, j] = before, last
    return _traced(back, piece)


def merges(model: Model, codes: np.ndarray, longest: int = 1 << 62) -> list[list[tuple[int, int, int]]]:
    """The segmentation of each row by merging the best-scored pair of neighbours, the leftmost of equal ones, until none is a piece of at most longest characters.

    It takes the pieces apart when a model is loaded, and the paths are tested against it.
    """
    rows, n = codes.shape
    sums, down = _sums(codes)
    bounds = np.tile(np.arange(n + 1), (rows, 1))
    row = np.arange(rows)
    out: list = [None] * rows

    def scored(r: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = _probe(model, common.mix((sums[r, b] - sums[r, a]) * down[a]))
        return np.where((found >= 0) & (b - a <= longest), model.scores[found], -np.inf)

    pairs = scored(row[:, None], bounds[:, :-2], bounds[:, 2:]) if n > 1 else np.zeros((rows, 0))
    while len(row):
        at = pairs.argmax(1) if pairs.shape[1] else np.zeros(len(row), np.int64)
        live = pairs[np.arange(len(row)), at] > -np.inf if pairs.shape[1] else np.zeros(len(row), bool)
        done = np.flatnonzero(~live)
        if len(done):
            ends = bounds[done]
            found = _probe(model, common.mix((sums[row[done, None], ends[:, 1:]] - sums[row[done, None], ends[:, :-1]]) * down[ends[:, :-1]]))
            for k, r in enumerate(row[done].tolist()):
                out[r] = list(zip(ends[k, :-1].tolist(), ends[k, 1:].tolist(), found[k].tolist(), strict=True))
        row, bounds, pairs, at = row[live], bounds[live], pairs[live], at[live]
        m = bounds.shape[1]
        if not len(row):
            break
        bounds = bounds[np.arange(m) != at[:, None] + 1].reshape(len(row), m - 1)
        pairs = pairs[np.arange(m - 2) != at[:, None]].reshape(len(row), m - 3)
        for k in (at - 1, at):  # the pairs that hold the merged symbol
            some = np.flatnonzero((k >= 0) & (k < m - 3))
            pairs[some, k[some]] = scored(row[some], bounds[some, k[some]], bounds[some, k[some] + 2])
    return out


class Codec:
    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.near = np.zeros((TABLE, TABLE), bool)
        for pair in model.joined:
            x, y = (0 if c == SPACE else ord(c) for c in pair)
            if x < TABLE and y < TABLE:
                self.near[x, y] = True
        other = "".join(sorted(c for c in "\n\t\r" if not any(c in p for p, k in zip(model.pieces, model.kinds, strict=True) if k == NORMAL)))
        self.cut = re.compile(f"[{other}]| +[^ {other}]*|[^ {other}]+" if other else " +[^ ]*|[^ ]+")

    def _parts(self, words: list[str]) -> list[list[str]]:
        """Each word cut between neighbours that no piece has; a table of common neighbours tells for all words at once."""
        whole = "".join(words)
        codes = _codes([whole])[0]
        codes = np.where(codes == ord(SPACE), 0, codes)
        ends = np.cumsum([len(w) for w in words])
        low = codes < TABLE
        rare = ~(low[:-1] & low[1:])
        apart = np.zeros(len(codes), bool)  # the place ends a part
        apart[:-1][~rare] = ~self.near[codes[:-1][~rare], codes[1:][~rare]]
        for j in np.flatnonzero(rare).tolist():
            apart[j] = whole[j : j + 2] not in self.model.joined
        apart[ends - 1] = True
        cuts = (np.flatnonzero(apart) + 1).tolist()
        pieces = [whole[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
        last = np.searchsorted(cuts, ends).tolist()
        return [pieces[a : b + 1] for a, b in zip([0, *(x + 1 for x in last[:-1])], last, strict=True)]

    def fresh(self, words: list[str]) -> None:
        by: dict[int, list[str]] = {}
        parts = self._parts([w.replace(" ", SPACE) for w in words])
        for p in {p for x in parts for p in x}:
            by.setdefault(len(p), []).append(p)
        ids: dict[str, bytes] = {}
        segment = viterbi if self.model.kind == UNIGRAM else paths
        for n, same in by.items():
            step = max(1, CELLS // n)
            for at in range(0, len(same), step):
                chunk = same[at : at + step]
                start, end, found, sizes = segment(self.model, _codes(chunk))
                raw, upto = found.astype("<u4").tobytes(), np.cumsum(sizes)
                for word, a, b in zip(chunk, (upto - sizes).tolist(), upto.tolist(), strict=True):
                    ids[word] = raw[4 * a : 4 * b]
                for r in np.unique(np.searchsorted(upto, np.flatnonzero(found < 0), "right")).tolist():
                    some = range(int(upto[r] - sizes[r]), int(upto[r]))
                    ids[chunk[r]] = array("I", [x for k in some for x in self._ids(chunk[r][start[k] : end[k]], int(found[k]))]).tobytes()
        for w, x in zip(words, parts, strict=True):
            self.known[w] = ids[x[0]] if len(x) == 1 else b"".join([ids[p] for p in x])

    def _ids(self, text: str, piece: int) -> list[int]:
        if piece >= 0:
            return [piece]
        if self.model.byte_fallback:
            return [self.model.by_byte[b] for b in text.encode("utf-8", "surrogatepass")]
        return [self.model.unknown]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        model = self.model
        if len(self.known) > CACHED:
            self.known.clear()
        cut = []
        for text in texts:
            text = text.replace(SPACE, " ")
            if model.squeeze:
                text = re.sub(" +", " ", text).strip(" ")
            text = " " + text if model.prefix and text else text
            cut.append([text] if model.inner_space and text else self.cut.findall(text))
        new = {w for words in cut for w in words if w not in self.known}
        if new:
            self.fresh(list(new))
        known = self.known
        out = [np.frombuffer(b"".join([known[w] for w in words]), "<u4") for words in cut]
        for w in new:
            if len(w) > LONGEST:
                del known[w]
        if not model.byte_fallback:
            out = [_once(ids, model.unknown) for ids in out]
        return out

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.model.decoded.__getitem__, ids.tolist()))
        if self.model.prefix and text[:1] == b" ":
            text = text[1:]
        return text.decode("utf-8", "replace")


def _once(ids: np.ndarray, unknown: int) -> np.ndarray:
    """Neighbouring unknown characters are one id."""
    gone = np.zeros(len(ids), bool)
    gone[1:] = (ids[1:] == unknown) & (ids[:-1] == unknown)
    return ids[~gone]


_codecs: dict[str, Codec] = {}


def codec(vocabulary: str) -> Codec:
    """vocabulary: a file name of the public tokenizers, or a path."""
    if vocabulary not in _codecs:
        import public_tokenizers

        with open(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary), "rb") as f:
            _codecs[vocabulary] = Codec(Model.load(f.read()))
    return _codecs[vocabulary]


def encode(df: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) for each row of df. A null text counts as empty and has no ids. An empty table gives no rows; other columns are left out."""
    common.prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = codec(vocabulary).encode(batch.column("text").to_pylist())
            yield pa.record_batch([batch.column("doc_id"), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return common.id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(df: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) for each row of df; null ids count as none. The literal character U+2581 comes back as a space."""
    common.prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), pa.array([codec(vocabulary).decode(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each whole text and decodes the ids again: doc_id, n_ids, ids_crc32, decoded_sha256, round_trip.

    A null text counts as empty and has no ids; rows without an id and repeated rows are reported as they come. An empty table gives no
    rows. A text with the literal character U+2581 comes back with a space there, so its round_trip is false. Other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            own = codec(VOCABULARY)
            ids = own.encode(texts)
            back = [own.decode(x) for x in ids]
            yield pa.record_batch(
                [
                    batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in back]), pa.array([t == b for t, b in zip(texts, back, strict=True)]),
                ],
                ["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip"],
            )

    common.prepare(df.sparkSession)
    return common.id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.documents(spark, sf_dir))

"""Cross-entropy difference: how much better a target model than a background model predicts each token.

Both are bigram models over one vocabulary, all words of the corpus, with one smoothing: the bigram estimate leans on the
word's own, and that on a uniform one. The target model counts the target documents, the background model all.
Documents are handled in blocks of a stored file. A block sends each of its n-grams once, with its counts, to the owner of
its hash, and nothing to owners that it has no n-gram for, so rows never outnumber n-grams however many owners there are; owners add up and return the corpus counts in the block's own order, so the exchange grows with the
distinct n-grams of the blocks and no table of n-grams is ever in one place. A document's own counts are taken out of
both models before it is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, repeats

#: Weight of the word's own estimate in tokens, and what each word of the vocabulary is taken to have been seen beforehand.
MU, DELTA = 20.0, 0.5
#: Texts of a block; bytes of text for each owner.
BLOCK_ROWS, OWNER_BYTES = 2000, 24 << 20
_U = np.uint64
#: Ends each document, and opens it as a context.
END = _U(0x5851F42D4C957F2D)
COUNTS = "owner int, block long, grams binary, seen binary, target binary, words long, tokens long, target_tokens long"
ANSWERS = "row long, owner long, seen binary, target binary, words long, tokens long, target_tokens long"
OUT = "doc_id long, n_tokens long, target_loss double, background_loss double, difference double"


def _squeezed(values: np.ndarray) -> bytes:
    """Numbers as their bytes by significance, compressed: most high bytes are zero."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T).tobytes())


def _loosened(data: bytes, kind: type) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind) if len(raw) else np.zeros(0, kind)


def _parts(hashes: np.ndarray, n_words: int) -> bytes:
    """Ascending words, then ascending bigrams, as differences."""
    return _squeezed(np.concatenate([np.diff(x, prepend=x[:0] if not len(x) else _U(0)) for x in (hashes[:n_words], hashes[n_words:])]))


def _hashes(data: bytes, n_words: int) -> np.ndarray:
    steps = _loosened(data, _U)
    return np.concatenate([np.cumsum(steps[:n_words], dtype=_U), np.cumsum(steps[n_words:], dtype=_U)])


def _grams(texts: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of the tokens of a batch, in order: text, hash, context's hash, bigram's hash."""
    raw, offsets = common.arrays(texts, "text")
    lowered = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    _, _, first, (hashes,) = common.words(lowered, offsets)
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), n + 1)
    ends = np.cumsum(n + 1) - 1
    word = np.empty(len(text), _U)
    inside = np.ones(len(text), bool)
    inside[ends] = False
    word[inside], word[~inside] = hashes, END
    context = np.empty(len(text), _U)
    context[1:] = word[:-1]
    context[:1] = END
    return text, word, context, common.mix(context * _U(0x9E3779B97F4A7C15) + common.mix(word))


def _index(word: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes of words and bigrams, words first, and each token's place among the words and among all."""
    words, of_word = np.unique(word, return_inverse=True)
    pairs, of_pair = np.unique(pair, return_inverse=True)
    return np.concatenate([words, pairs]), of_word, of_pair + len(words)


def _owned(grams: np.ndarray, owners: int) -> Iterator[tuple[int, np.ndarray]]:
    """The owners that have some of the n-grams, each with their places in order."""
    owner = (grams % _U(owners)).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    names, first = np.unique(owner[order], return_index=True)
    for r, low, high in zip(names.tolist(), first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
        yield r, order[low:high]


def _count(owners: int):
    def work(texts: pa.RecordBatch, found: list[np.ndarray], place: np.ndarray) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(texts.num_rows, bool)
        wanted[place] = True
        text, word, _, pair = _grams(texts)
        grams, of_word, of_pair = _index(word, pair)
        n_words = int(of_pair.min()) if len(of_pair) else 0
        both = np.concatenate([of_word, of_pair])
        seen = np.bincount(both, minlength=len(grams)).astype(np.uint32)
        target = np.bincount(both[np.concatenate([wanted[text]] * 2)], minlength=len(grams)).astype(np.uint32)
        block = texts.column("row")[0].as_py()
        rows = []
        totals = (len(text), int(wanted[text].sum()))
        for r, mine in _owned(grams, owners):
            own_words = int(np.searchsorted(mine, n_words))
            rows.append((r, block, _parts(grams[mine], own_words), _squeezed(seen[mine]), _squeezed(target[mine]), own_words, *(totals if not rows else (0, 0))))
        if not rows:
            return
        values = list(zip(*rows, strict=True))
        yield pa.record_batch([pa.array(values[0], pa.int32()), pa.array(values[1], pa.int64()), *(pa.array(v, pa.binary()) for v in values[2:5]), *(pa.array(v, pa.int64()) for v in values[5:])], ["owner", "block", "grams", "seen", "target", "words", "tokens", "target_tokens"])

    return work


def _answer(counts: DataFrame, owners: int) -> DataFrame:
    """Corpus counts for each block, in the block's order. An owner holds the n-grams of its share of the hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for owner, block, grams, seen, target, words, *totals in zip(*(batch.column(c).to_pylist() for c in ("owner", "block", "grams", "seen", "target", "words", "tokens", "target_tokens")), strict=True):
                held.setdefault(owner, []).append((block, _hashes(grams, words), _loosened(seen, np.uint32), _loosened(target, np.uint32), words, totals))
        for owner, rows in held.items():
            grams, place = np.unique(np.concatenate([r[1] for r in rows]), return_inverse=True)
            seen, target = np.zeros(len(grams), _U), np.zeros(len(grams), _U)
            np.add.at(seen, place, np.concatenate([r[2] for r in rows]).astype(_U))
            np.add.at(target, place, np.concatenate([r[3] for r in rows]).astype(_U))
            word = np.zeros(len(grams), bool)
            at = 0
            for _, g, _, _, words, _ in rows:
                word[place[at : at + words]] = True
                at += len(g)
            at = 0
            for i, (block, g, _, _, _, totals) in enumerate(rows):
                mine = place[at : at + len(g)]
                at += len(g)
                yield pa.record_batch([*(pa.array([x], pa.int64()) for x in (block, owner)), *(pa.array([_squeezed(x[mine])], pa.binary()) for x in (seen, target)), *(pa.array([x], pa.int64()) for x in (int(word.sum()) if i == 0 else 0, *totals))], ["row", "owner", "seen", "target", "words", "tokens", "target_tokens"])

    return counts.repartitionById(owners, "owner").mapInArrow(run, ANSWERS)


def _own(text: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
    """How often each token's n-gram stands in its own text."""
    _, inverse, n = np.unique(text * np.int64(size) + place, return_inverse=True, return_counts=True)
    return n[inverse]


def _score(owners: int, vocabulary: int, tokens: int, target_tokens: int):
    def work(texts: pa.RecordBatch, found: list[np.ndarray], place: np.ndarray) -> Iterator[pa.RecordBatch]:
        text, word, context, pair = _grams(texts)
        grams, of_word, of_pair = _index(word, pair)
        seen, target = np.zeros(len(grams)), np.zeros(len(grams))
        mine = dict(_owned(grams, owners))
        wanted = np.zeros(texts.num_rows, bool)
        for k in range(len(place)):
            if found[1][k] < 0:  # a target document
                wanted[place[k]] = True
            else:
                at = mine[int(found[1][k])]
                seen[at], target[at] = _loosened(found[2][k], _U), _loosened(found[3][k], _U)
        n_words = int(of_pair.min()) if len(of_pair) else 0
        of_context = np.searchsorted(grams[:n_words], context)
        size = np.bincount(text, minlength=texts.num_rows)
        own = [_own(text, x, len(grams)) for x in (of_word, of_pair)]
        # A context stands in its text as often as the word does.
        last = _own_context(text, of_word, of_context, len(grams))
        losses = []
        for counts, total, out in ((target, target_tokens, wanted[text]), (seen, tokens, np.ones(len(text), bool))):
            all_ = np.maximum(total - np.where(out, size[text], 0), 0)
            single = (np.maximum(counts[of_word] - own[0] * out, 0) + DELTA) / (all_ + DELTA * vocabulary)
            p = (np.maximum(counts[of_pair] - own[1] * out, 0) + MU * single) / (np.maximum(counts[of_context] - last * out, 0) + MU)
            losses.append(np.bincount(text, -np.log(p), texts.num_rows) / size)
        doc, no_id = texts.column("doc").to_numpy(), texts.column("no_id").to_numpy(zero_copy_only=False)
        yield pa.record_batch([pa.array(doc, pa.int64(), mask=no_id), pa.array(size - 1, pa.int64()), *(pa.array(x) for x in (losses[0], losses[1], losses[0] - losses[1]))], ["doc_id", "n_tokens", "target_loss", "background_loss", "difference"])

    return work


def _own_context(text: np.ndarray, of_word: np.ndarray, of_context: np.ndarray, size: int) -> np.ndarray:
    keys, n = np.unique(text * np.int64(size) + of_word, return_counts=True)
    return n[np.searchsorted(keys, text * np.int64(size) + of_context)]


def cross_entropy_difference(df: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: doc_id, n_tokens (words), target_loss, background_loss, difference (lower: more like the target).

    targets: ids (doc_id) of the target documents; null and repeated ones don't matter. Losses are natural logs per token,
    the end of a text counting as one. A null text counts as empty. Rows that share an id are all target documents or none. Without target documents the
    target model knows no more than the vocabulary. An empty table gives no rows. Other columns of df are left out.
    """
    spark = common.prepare(df.sparkSession)
    path, n_files = repeats.store(common.id_text(df, id_col, text_col))
    texts = repeats.stored(spark, path)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    owners = max(common.partitions(spark), size // OWNER_BYTES)
    wanted = common.save(texts.where("not no_id").select("doc", "row").join(targets.select(F.col("doc_id").cast("long").alias("doc")).dropDuplicates(), "doc", "left_semi").select("row"), "targets")
    counts = repeats.at_texts(wanted, path, n_files, _count(owners), COUNTS, BLOCK_ROWS)
    answers = common.save(_answer(counts, owners), "answers")
    totals = answers.agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens"), F.sum("target_tokens").alias("target")).first()
    found = answers.select("row", "owner", "seen", "target").union(wanted.select("row", F.lit(-1).cast("long").alias("owner"), F.lit("").cast("binary").alias("seen"), F.lit("").cast("binary").alias("target")))
    return repeats.at_texts(found, path, n_files, _score(owners, totals["words"] or 1, totals["tokens"] or 0, totals["target"] or 0), OUT, BLOCK_ROWS)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target: documents labelled as of good quality."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return cross_entropy_difference(common.documents(spark, sf_dir), labels.where("quality = 1"))

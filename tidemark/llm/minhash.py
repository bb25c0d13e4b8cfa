"""MinHash near-dedup: universal hash minima, banding, signature verification, exact confirmation, components.

1. Each text becomes its set of word shingles. Equal sets fall into one class, which its least document stands for.
2. ``bands * rows`` universal hash minima sign a set; a band of equal minima puts two classes into one bucket.
3. Buckets make clusters: whatever hangs together by buckets. Each class's set is fetched once, and goes once to the task that its
   cluster belongs to. There pairs whose signatures agree on clearly less than the threshold are passed over; the others are
   compared on their full sets, unless both hang together already. Only links that join two parts leave the task.
4. A cluster of more than BLOCK classes, or of more than WEIGHT shingles, is dealt to several tasks. A few classes of each part that a task
   found are dealt anew, until they fit into one task or stay as many. That joins nearly all that belongs together.
5. Then buckets that still hold several parts are gone through exactly: each class outside a bucket's largest part against all its
   classes of other parts, each pair in the first band that it shares. The outer classes stand in blocks, beside which the
   bucket streams through, in salted shares; again only joining links leave a task.

So no link that could join two components is lost, no pair of classes is ever a row, and the rows grow with the classes, but for
the blocks of outer classes that a bucket goes by.

Two sets at the threshold of 0.85 (0.8) share none of 32 bands of 5 minima with a probability of 7e-9 (3e-6); the
signatures of such a pair fall below the margin with a probability of about 1e-9.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, repeats
from tidemark.llm.components import Parts, components

#: Defaults of near-duplicate operators here.
SHINGLE, PERCENT = 5, 80
BANDS, ROWS = 32, 5
#: Standard deviations of an estimate that the signature check leaves below the threshold.
MARGIN = 6
#: Classes and shingles that one task holds against each other.
BLOCK, WEIGHT = 1000, 4_000_000
#: Classes of a bucket that stream past a block in one task.
SALT_ROWS = 20_000
#: Classes of a part that are dealt anew, and how often at most.
DELEGATES, DEALS = 8, 6
_U = np.uint64


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted hashes of the distinct shingles of each text; with fewer than k words, the whole sequence is one."""
    lowered = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    _, _, first, (hashes,) = common.words(lowered, offsets)
    grams = np.zeros(max(0, len(hashes) - k + 1), _U)
    for j in range(k):
        grams = common.mix(grams * _U(0x9E3779B97F4A7C15) + hashes[j : j + len(grams)])
    out = []
    for low, high in zip(first[:-1], first[1:], strict=True):
        if high - low >= k:
            out.append(np.unique(grams[low : high - k + 1]))
        elif high > low:
            whole = np.zeros(1, _U)
            for h in hashes[low:high]:
                whole = common.mix(whole * _U(0x9E3779B97F4A7C15) + h)
            out.append(whole + _U(high - low))
        else:
            out.append(np.zeros(0, _U))
    return out


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """Of each nonempty set, the minima of n universal hash functions (16 bits of each, mixed)."""
    rng = np.random.default_rng(20240229)
    a, b = rng.integers(0, 2**64, n, _U) | _U(1), rng.integers(0, 2**64, n, _U)
    out = np.empty((len(sets), n), np.uint16)
    sizes = np.array([len(s) for s in sets])
    at = 0
    while at < len(sets):
        to, total = at + 1, sizes[at]
        while to < len(sets) and total + sizes[to] <= 30_000:
            total += sizes[to]
            to += 1
        x = np.concatenate(sets[at:to])
        starts = np.concatenate([[0], np.cumsum(sizes[at : to - 1])])
        for i in range(n):
            out[at:to, i] = common.mix(np.minimum.reduceat(x * a[i] + b[i], starts)) & _U(65535)
        at = to
    return out


def _signed(texts: DataFrame, k: int, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = common.arrays(batch, "text")
            doc = pa.array(batch.column("doc").to_numpy(), pa.int64(), mask=batch.column("no_id").to_numpy(zero_copy_only=False))
            for low, high in common.slices(raw, offsets):
                sets = shingle_sets(raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], k)
                full = [i for i, s in enumerate(sets) if len(s)]
                signed = iter(signatures([sets[i] for i in full], n))
                ids = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                marks = [next(signed).tobytes() if len(s) else None for s in sets]
                yield pa.record_batch([doc.slice(low, high - low), batch.column("row").slice(low, high - low), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), pa.array(marks, pa.binary())], ["doc_id", "row", "n_shingles", "set_id", "sig"])

    return texts.mapInArrow(run, "doc_id long, row long, n_shingles long, set_id binary, sig binary")


def _sets(k: int, n: int):
    """Of the wanted texts of a batch, the shingle sets with their signatures, beside what came with the row."""

    def work(texts: pa.RecordBatch, found: list[np.ndarray], place: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(place):
            return
        raw, offsets = common.arrays(texts, "text")
        for low, high in common.slices(raw, offsets):
            wanted = np.flatnonzero((place >= low) & (place < high))
            if len(wanted):
                sets = shingle_sets(raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], k)
                sets = [sets[i - low] for i in place[wanted].tolist()]
                signs = signatures(sets, n)
                beside = [pa.array(x[wanted], pa.int64()) for x in found]
                yield pa.record_batch([*beside, pa.array([x.tobytes() for x in signs], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["row", "cluster", "chunk", "cls", "node", "sig", "items"])

    return work


class Held:
    """Sets that others are compared with."""

    def __init__(self, signs: np.ndarray, sets: list[np.ndarray], percent: int, floor: int):
        self.signs, self.percent, self.floor = signs, percent, floor
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.vocabulary, inverse = np.unique(np.concatenate(sets) if sets else np.zeros(0, _U), return_inverse=True)
        self.items = inverse.astype(np.int32)
        self.mark = np.zeros(len(self.vocabulary), bool)

    def agreeing(self, some: np.ndarray, sign: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Those of some that may be linked by their sizes and signatures, and where the signatures agree."""
        some = some[100 * np.minimum(self.sizes[some], size) >= self.percent * np.maximum(self.sizes[some], size)]
        same = self.signs[some] == sign
        near = same.sum(1) >= self.floor
        return some[near], same[near]

    def place(self, items: np.ndarray) -> np.ndarray:
        """Places of the known ones of sorted items."""
        at = np.searchsorted(self.vocabulary, items)
        at[at == len(self.vocabulary)] = 0
        return at[self.vocabulary[at] == items] if len(self.vocabulary) else at[:0]

    def linked(self, some: np.ndarray, places: np.ndarray, size: int) -> Iterator[int]:
        """Those of some whose sets are linked with a set of that size, of which places are known."""
        self.mark[places] = True
        for i in some.tolist():
            both = int(self.mark[self.items[self.starts[i] : self.starts[i + 1]]].sum())
            if both and 100 * both >= self.percent * (int(self.sizes[i]) + size - both):
                yield i
        self.mark[places] = False


def _resolve(nodes: np.ndarray, signs: np.ndarray, sets: list[np.ndarray], percent: int, floor: int) -> Parts:
    """What hangs together among sets; nodes: what each belongs to already."""
    parts, held = Parts(), Held(signs, sets, percent, floor)
    roots = nodes.copy()
    for i in range(len(nodes) - 1):
        later = np.arange(i + 1, len(nodes))
        some, _ = held.agreeing(later[roots[later] != roots[i]], signs[i], int(held.sizes[i]))
        for j in held.linked(some, held.items[held.starts[i] : held.starts[i + 1]], int(held.sizes[i])) if len(some) else ():
            if parts.join(int(roots[i]), int(roots[j])):
                to = parts.find(int(roots[i]))
                roots[(roots == roots[i]) | (roots == roots[j])] = to
    for n in nodes.tolist():
        parts.find(n)
    return parts


def _within(dealt: DataFrame, percent: int, floor: int, delegates: int) -> DataFrame:
    """(cluster, row, a, b, again): of each class the part that it belongs to in its task, and whether it is dealt anew.

    dealt: cluster, chunk, many (of the cluster), row, cls, node (the part so far), sig, items; many: the cluster has several chunks.
    Clusters of one chunk give only classes that joined another one.
    """

    def done(group: tuple, rows: list[tuple]) -> pa.RecordBatch | None:
        cluster, _, many = group
        row, cls, node, sig, items = zip(*rows, strict=True)
        parts = _resolve(np.array(node, np.int64), np.stack([np.frombuffer(x, np.uint16) for x in sig]), [np.frombuffer(x, _U) for x in items], percent, floor)
        out, dealt_anew = [], {}
        for r, c, n in zip(row, cls, node, strict=True):
            root = parts.find(n)
            if many:
                dealt_anew[root] = dealt_anew.get(root, 0) + 1
            if many or root != n:
                out.append((cluster, r, n, root, c, many and dealt_anew[root] <= delegates))
        return pa.record_batch([*(pa.array(x, pa.int64()) for x in list(zip(*out, strict=True))[:5]), pa.array([x[5] for x in out], pa.bool_())], ["cluster", "row", "a", "b", "cls", "again"]) if out else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for batch in batches:
            for cluster, chunk, many, *row in zip(*(batch.column(c).to_pylist() for c in ("cluster", "chunk", "many", "row", "cls", "node", "sig", "items")), strict=True):
                if (cluster, chunk, many) != group:
                    if rows and (found := done(group, rows)) is not None:
                        yield found
                    group, rows = (cluster, chunk, many), []
                rows.append(tuple(row))
        if rows and (found := done(group, rows)) is not None:
            yield found

    n = common.partitions(dealt.sparkSession)
    return dealt.repartition(n, "cluster", "chunk").sortWithinPartitions("cluster", "chunk", F.xxhash64("row")).select("cluster", "chunk", "many", "row", "cls", "node", "sig", "items").mapInArrow(run, "cluster long, row long, a long, b long, cls long, again boolean")


def _across(split: DataFrame, percent: int, floor: int, rows: int, block: int, weight: int, salt_rows: int) -> DataFrame:
    """Links (a, b) between parts, for buckets of several parts.

    split: key, band, row, comp, sig, items, n (classes of the bucket), main (its largest part), outside (classes not of main), heavy (their shingles).
    """
    chunks, salts = F.ceil(F.greatest(F.col("outside") / block, F.col("heavy") / weight)), F.ceil(F.col("n") / salt_rows)
    numbers = lambda n: F.explode(F.sequence(F.lit(0), n.cast("int") - 1))
    base = ["key", "band", "row", "comp", "sig", "items"]
    held = split.where("comp <> main").withColumn("chunk", F.pmod(F.xxhash64("row"), chunks).cast("int")).withColumn("salt", numbers(salts)).select(*base, "chunk", "salt", F.lit(0).alias("kind"), F.lit(True).alias("out"))
    all_ = split.withColumn("chunk", numbers(chunks)).withColumn("salt", F.pmod(F.xxhash64("row", F.lit(7)), salts).cast("int")).select(*base, "chunk", "salt", F.lit(1).alias("kind"), (F.col("comp") != F.col("main")).alias("out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, block = None, []
        held, parts, number, comps = None, Parts(), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            links = []
            for key, chunk, salt, kind, row, comp, out, band, sig, items in zip(*(batch.column(c).to_pylist() for c in ("key", "chunk", "salt", "kind", "row", "comp", "out", "band", "sig", "items")), strict=True):
                if group != (key, chunk, salt):
                    group, block, held, parts = (key, chunk, salt), [], None, Parts()
                sign, items = np.frombuffer(sig, np.uint16), np.frombuffer(items, _U)
                if not kind:
                    block.append((row, comp, sign, items))
                    continue
                if held is None and not block:  # the hash left this block empty
                    continue
                if held is None:
                    held = Held(np.stack([x[2] for x in block]), [x[3] for x in block], percent, floor)
                    number, comps = np.array([x[0] for x in block], np.int64), np.array([x[1] for x in block], np.int64)
                    block = []
                top = parts.find(comp)
                some = np.flatnonzero((comps != top) & (number < row if out else True))
                some, same = held.agreeing(some, sign, len(items))
                if not len(some):
                    continue
                some = some[same.reshape(len(some), -1, rows).all(2).argmax(1) == band]
                for i in held.linked(some, held.place(items), len(items)) if len(some) else ():
                    before = int(comps[i])
                    if parts.join(before, top):
                        links.append((before, top))
                        old, top = (before, top), parts.find(top)
                        comps[np.isin(comps, old)] = top
            if links:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["a", "b"])

    dealt = held.union(all_).repartition(common.partitions(split.sparkSession), "key", "chunk", "salt").sortWithinPartitions("key", "chunk", "salt", "kind")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _chunked(sized: DataFrame, seed: int, block: int, weight: int) -> DataFrame:
    """Adds to classes (with cluster and weight) many and chunk: how their cluster is dealt. The cluster's size is summed up first."""
    sizes = sized.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("weight") / weight)).cast("int").alias("chunks"))
    dealt = sized.join(sizes, "cluster")
    return dealt.withColumn("many", F.col("chunks") > 1).withColumn("chunk", F.pmod(F.xxhash64("row", F.lit(seed)), "chunks").cast("int"))


def _linked(found: DataFrame, node: str, of: DataFrame) -> DataFrame:
    """of with comp: the component of its node."""
    found = found.select(F.col("node").alias(node), "component")
    return of.join(found, node, "left").withColumn("comp", F.coalesce("component", node)).drop("component")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each row of df: doc_id, n_shingles, component_id (least id reachable over links), kept.

    Texts are linked if 100 * intersection >= percent * union of their shingle sets. A null text counts as empty; texts
    without words have no shingles and no links. Rows that share an id are one node, linked by what any of them links.
    Rows without an id are never linked: their component_id is null and they are kept. An empty table gives no rows.
    Other columns of df are left out.
    """
    spark = common.prepare(df.sparkSession)
    block, weight = BLOCK, WEIGHT
    store, n_files = repeats.store(common.id_text(df, id_col, text_col))
    n = bands * rows
    share = percent / 100
    floor = max(1, math.floor(n * share - MARGIN * math.sqrt(n * share * (1 - share))))
    signed = common.save(_signed(repeats.stored(spark, store), shingle, n), "signed")
    known = signed.where("set_id is not null and doc_id is not null")
    classes = common.save(known.groupBy("set_id").agg(F.min("doc_id").alias("cls"), F.min_by("row", "doc_id").alias("row"), F.first("n_shingles").alias("n_shingles")), "classes")
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring("sig", i * (2 * rows) + 1, F.lit(2 * rows))))
    signs = common.save(signed.select("set_id", "row", "sig").join(classes.select("set_id", "row", "cls").hint("merge"), ["set_id", "row"]).select("row", "cls", "sig"), "signs")
    banded = signs.select("row", "cls", F.posexplode(keys).alias("band", "key"))
    buckets = common.save(banded.groupBy("key").agg(F.min("cls").alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub"), "buckets")
    banded = common.save(banded.join(buckets, "key"), "banded")
    common.discard(spark, signs, buckets)
    # Rows that share an id hang together.
    twice = known.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    twice = known.join(classes.select("set_id", "cls"), "set_id").where("doc_id <> cls").join(twice, "doc_id", "left_semi")
    twice = common.save(twice.select(F.col("doc_id").alias("a"), F.col("cls").alias("b")).distinct(), "twice")
    used = [store, signed, classes, banded, twice]

    def kept(df: DataFrame, name: str) -> DataFrame:
        used.append(common.save(df, name))
        return used[-1]

    used.append(clusters := components(banded.where("cls <> hub"), "cls", "hub"))
    sized = classes.join(clusters, F.col("cls") == F.col("node")).select("row", "cls", F.col("component").alias("cluster"), F.col("n_shingles").alias("weight"))
    placed = kept(_chunked(sized, 0, block, weight).withColumn("node", F.col("cls")), "placed")

    def fetched(some: DataFrame) -> DataFrame:
        """With sig and items, which go straight to the tasks of their clusters."""
        columns = ["row", "cluster", F.col("chunk").cast("long").alias("chunk"), "cls", "node"]
        return repeats.at_texts(some.select(*columns), store, n_files, _sets(shingle, n), "row long, cluster long, chunk long, cls long, node long, sig binary, items binary")

    links = [kept(_within(fetched(placed.where("not many")).withColumn("many", F.lit(False)), percent, floor, DELEGATES), "links")]
    if not placed.where("many").isEmpty():
        large = placed.where("many").select("row", "weight").join(kept(fetched(placed.where("many")), "large").hint("merge"), "row")
        links.append(kept(_within(large.withColumn("many", F.lit(True)), percent, floor, DELEGATES), "links"))
        before = None
        for deal in range(1, DEALS + 1):
            chosen = links[-1].where("again").select("row", F.col("b").alias("node"))
            count = chosen.count()
            if not count or (before is not None and count > 0.7 * before):
                break
            before = count
            again = _chunked(chosen.join(large.select("row", "cls", "cluster", "weight", "sig", "items").hint("merge"), "row"), deal, block, weight)
            # All of these are held on to for the next deal, whether they fit into one task or not.
            links.append(kept(_within(again.withColumn("many", F.lit(True)), percent, floor, DELEGATES), "links"))
        joined = twice
        for more in links:
            joined = joined.union(more.select("a", "b"))
        links = [kept(joined.where("a <> b").distinct(), "links")]
        used.append(found := components(links[0], "a", "b"))
        parts = banded.select("key", "band", "row", "cls").join(large.select("row", "weight"), "row")
        parts = kept(_linked(found, "cls", parts), "parts")
        counts = parts.groupBy("key", "comp").agg(F.count("*").alias("c"), F.sum("weight").alias("w"))
        mixed = counts.groupBy("key").agg(F.sum("c").alias("n"), F.max_by("comp", "c").alias("main"), F.max("c").alias("most"), F.sum("w").alias("w"), F.max_by("w", "c").alias("main_w"), F.count("*").alias("parts"))
        mixed = kept(mixed.where("parts > 1").select("key", "n", "main", (F.col("n") - F.col("most")).alias("outside"), (F.col("w") - F.col("main_w")).alias("heavy")), "mixed")
        if not mixed.isEmpty():
            split = parts.join(mixed, "key").join(large.select("row", "sig", "items").hint("merge"), "row")
            links.append(kept(_across(split, percent, floor, rows, block, weight, SALT_ROWS), "links"))
    joined = twice
    for more in links:
        joined = joined.union(more.select("a", "b"))
    used.append(found := components(joined, "a", "b"))
    out = signed.select("doc_id", "n_shingles", "set_id").join(_linked(found, "cls", classes.select("set_id", "cls")), "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    done = common.save(out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept")), "near")
    common.discard(spark, *used)
    return done


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(common.documents(spark, sf_dir), shingle=3, percent=85)

"""Toxic passages by maximum-scoring segment search.

Each token scores its log-odds between toxic and clean documents, shrunk by a Dirichlet prior in proportion to the corpus.
A linear-time scan lists every maximal segment of a text's token scores. By the extreme-value law of such segments the
expected number of segments as good in clean text of that length is K * length * exp(-lambda * score); a text's
segments are summed up by that law's sum statistic, and an isotonic fit on the labelled rows turns the
evidence into a probability.

The classifier is fitted on at most FIT_ROWS labelled rows (those with the least hashes of their ids). A word has a score of its own if
its log-likelihood ratio is so large that among all words of the fitted texts no more than CHANCE would reach it by chance;
all others score as one. Scoring reads every whole text. Equal texts score equally, wherever and however often they stand.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common

FIT_ROWS = 40_000
#: Weight of the prior in documents, words that may have a score of their own by chance, and what every other token loses.
PRIOR, CHANCE, DRIFT = 10.0, 1.0, 0.01
#: Held out: rows whose crc32 of the id leaves this remainder.
FOLDS, HELD = 4, 2
THRESHOLD = 0.3
#: Steps of the evidence for the isotonic fit.
STEP, STEPS = 0.25, 400
TOKEN = re.compile(r"\w+")


@dataclass
class Model:
    scores: dict[str, float]
    rest: float
    lam: float
    k: float
    curve: list[tuple[float, float]]


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == HELD, F.lit(False))


def segments(places: list[int], scores: list[float], rest: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score); places and scores: of the tokens that don't score rest (which is below 0).

    Each step joins the new segment with earlier ones as long as that raises the score, so each is looked at a bounded number of times.
    """
    found: list[tuple[int, int, float, float]] = []  # first, last, sum before the first, sum up to the last
    total, before = 0.0, 0
    for place, score in zip(places, scores, strict=True):
        total += rest * (place - before)
        before = place + 1
        left, total = total, total + score
        if score <= 0:
            continue
        new = (place, place, left, total)
        while True:
            j = len(found) - 1
            skipped = []
            while j >= 0 and found[j][2] >= new[2]:
                skipped.append(j)
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = (found[j][0], new[1], found[j][2], new[3])
            del found[j:]
    return [(a, b, high - low) for a, b, low, high in found]


def evidence(scores: list[float], n: int, lam: float, k: float) -> float:
    """-log of the p-value of the segments, by the law of the best one or by the sum statistic of the best number of them; 0 or more."""
    if not scores:
        return 0.0
    best, total = 0.0, 0.0
    log_kn = math.log(k * max(n, 1))
    for r, s in enumerate(sorted(scores, reverse=True), 1):
        if r == 1:  # at least one segment as good: 1 - exp(-K n exp(-lambda s))
            expected = math.exp(min(700.0, log_kn - lam * s))
            best = lam * s - log_kn if expected < 1e-9 else -math.log(-math.expm1(-expected)) if expected < 30 else 0.0
        total += lam * s - log_kn
        x = total + math.lgamma(r + 1)
        if r > 1 and x > 0:
            best = max(best, x - (r - 1) * math.log(x + 1e-9) + math.lgamma(r + 1) + math.lgamma(r) - math.log(r * (r + 1)) + math.log(2))
    return best


def least_ratio(words: int, chance: float = CHANCE) -> float:
    """The log-likelihood ratio that no more than chance of so many words reach by chance: its law has one degree of freedom."""
    low, high = 0.0, 1000.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if words * math.erfc(math.sqrt(mid / 2)) > chance else (low, mid)
    return high


def probability(e: float, curve: list[tuple[float, float]]) -> float:
    """The score of an evidence: the fitted curve, with a trace of the evidence itself so that equal steps keep their order."""
    xs, ps = zip(*curve, strict=True)
    return min(1.0, max(0.0, float(np.interp(e, xs, ps)) * (1 - 1e-6) + 1e-6 * (1 - math.exp(-e))))


def scan(text: str, model: Model) -> tuple[int, list[tuple[int, int, float]]]:
    tokens = TOKEN.findall(text.lower())
    places, scores = [], []
    for i, s in enumerate(map(model.scores.get, tokens)):
        if s is not None:
            places.append(i)
            scores.append(s)
    return len(tokens), segments(places, scores, model.rest) if scores else []


def _counts(texts: DataFrame) -> DataFrame:
    """(token, toxic, clean, clean_tokens): documents with the token, and how often it stands in clean ones; the token null counts the documents, an empty one the tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: tuple[Counter, Counter] = (Counter(), Counter())
            often: Counter = Counter()
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                tokens = TOKEN.findall(text.as_py().lower())
                by[toxic].update(set(tokens))
                if not toxic:
                    often.update(tokens)
                by[toxic][None] += 1
                by[toxic][""] += len(tokens)
            names = list({**by[0], **by[1]})
            yield pa.record_batch([pa.array(names, pa.string()), *(pa.array([x[t] for t in names], pa.int64()) for x in (by[1], by[0], often))], ["token", "toxic", "clean", "clean_tokens"])

    sums = (F.sum(x).alias(x) for x in ("toxic", "clean", "clean_tokens"))
    return texts.mapInArrow(run, "token string, toxic long, clean long, clean_tokens long").groupBy("token").agg(*sums)


def root(pairs: list[tuple[float, float]]) -> float:
    """lambda > 0 with sum(p * exp(lambda * s)) = 1; 1 if there is none."""
    if sum(p * s for s, p in pairs) >= 0 or not any(s > 0 and p > 0 for s, p in pairs):
        return 1.0
    low, high = 1e-6, 1e-6
    f = lambda x: sum(p * math.exp(min(600.0, x * s)) for s, p in pairs) - 1
    while f(high) < 0:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def isotonic(bins: list[tuple[float, int, int]]) -> list[tuple[float, float]]:
    """Pool adjacent violators over (x, rows, ones), with half a row of each label added to each pool's ends."""
    pools: list[list[float]] = []
    for x, n, ones in sorted(bins):
        pools.append([x, x, n, ones])
        while len(pools) > 1 and pools[-2][3] / pools[-2][2] >= pools[-1][3] / pools[-1][2]:
            _, last, n, ones = pools.pop()
            pools[-1] = [pools[-1][0], last, pools[-1][2] + n, pools[-1][3] + ones]
    curve = []
    for first, last, n, ones in pools:
        p = (ones + 0.05) / (n + 0.5)
        curve += [(first, p), (last, p)] if last > first else [(first, p)]
    return curve


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic (0 or 1; rows with other or null values are left out, the larger of several holds)."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out())
    chosen = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    texts = docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic")  # at most fit_rows pairs of numbers
    # Copies count once, as toxic if one of them is.
    texts = common.save(texts.groupBy(F.sha2("text", 256).alias("sha")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"), "fit")
    counts = common.save(_counts(texts), "tokens")
    totals = {r["token"]: r for r in counts.where("token is null or token = ''").collect()}
    if None not in totals or not totals[None]["toxic"] or not totals[None]["clean"]:
        return Model({}, -DRIFT, 1.0, 0.1, [(0.0, 0.05), (1.0, 0.05)])
    n_t, n_c, tokens = totals[None]["toxic"], totals[None]["clean"], max(1, totals[""]["clean"])
    both = F.col("toxic") + F.col("clean")
    part = lambda y, n: F.when(y > 0, y * F.log(F.greatest(y, F.lit(1)) * F.lit(float(n_t + n_c)) / (F.greatest(both, F.lit(1)) * F.lit(float(n))))).otherwise(0.0)
    ratio = 2 * (part(F.col("toxic"), n_t) + part(F.col("clean"), n_c))
    words = counts.where("token <> ''")
    rows = words.withColumn("g", ratio).where(F.col("g") >= least_ratio(words.count())).orderBy("token").collect()  # words of at most fit_rows texts
    odds = lambda y, n, a: math.log((y + a) / (n + PRIOR))
    prior = lambda r: PRIOR * (r["toxic"] + r["clean"]) / (n_t + n_c)
    scores = {r["token"]: odds(r["toxic"], n_t, prior(r)) - odds(r["clean"], n_c, prior(r)) for r in rows}
    rest = -DRIFT
    # How often each score comes up in clean text, token by token; a word that clean text hasn't has its prior's share.
    background = [(scores[r["token"]], (r["clean_tokens"] + prior(r)) / (tokens + PRIOR)) for r in rows]
    background.append((rest, 1 - sum(p for _, p in background)))
    model = Model(scores, rest, root(background), 0.1, [])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = 0.0
            rows = 0
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                if not toxic:
                    n, found = scan(text.as_py(), model)
                    part += n * math.exp(-model.lam * max((s for *_, s in found), default=0.0))
                    rows += 1
            yield pa.record_batch([pa.array([rows], pa.int64()), pa.array([part])], ["rows", "part"])

    got = texts.mapInArrow(measure, "rows long, part double").agg(F.sum("rows").alias("rows"), F.sum("part").alias("part")).first()
    model.k = max(got["rows"] / got["part"], 1e-9) if got["part"] else 0.1

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps, ones = Counter(), Counter()
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                n, found = scan(text.as_py(), model)
                step = min(STEPS, math.ceil(evidence([s for *_, s in found], n, model.lam, model.k) / STEP))
                steps[step] += 1
                ones[step] += toxic
            yield pa.record_batch([pa.array(list(steps), pa.int64()), pa.array(list(steps.values()), pa.int64()), pa.array([ones[x] for x in steps], pa.int64())], ["step", "n", "ones"])

    bins = texts.mapInArrow(binned, "step long, n long, ones long").groupBy("step").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).collect()  # at most STEPS + 1 rows
    model.curve = isotonic([(r["step"] * STEP, r["n"], r["ones"]) for r in bins])
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted, n_tokens, passages (first token, last token, segment score) for each row of docs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, sizes, passages = [], [], []
            for text in batch.column("text"):
                n, found = scan(text.as_py(), model)
                e = evidence([s for *_, s in found], n, model.lam, model.k)
                scores.append(probability(e, model.curve))
                sizes.append(n)
                passages.append([{"first": a, "last": b, "score": s} for a, b, s in found if model.k * n * math.exp(-model.lam * s) < 0.05])
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))
            yield pa.record_batch([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(sizes, pa.int64()), pa.array(passages, kind)], ["doc_id", "score", "predicted", "n_tokens", "passages"])

    return docs.mapInArrow(run, "doc_id long, score double, predicted int, n_tokens long, passages array<struct<first: long, last: long, score: double>>")


def keep(df: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df that score below the threshold, with all columns; a null text counts as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays = []
            for text in batch.column(text_col):
                n, found = scan(text.as_py() or "", model)
                stays.append(probability(evidence([s for *_, s in found], n, model.lam, model.k), model.curve) < threshold)
            yield batch.filter(pa.array(stays, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row for each row of df: doc_id, held_out, score, predicted, n_tokens, passages.

    A null text counts as empty and scores as a text without evidence. A row without an id is scored like others and isn't held out.
    Repeated rows are each scored, equal texts equally.
    Without labels of both kinds every text gets the same low score. An empty table gives no rows. Other columns of df are left out.
    """
    common.prepare(df.sparkSession)
    docs = common.id_text(df, id_col, text_col)
    return score(docs, fit(docs, labels, fit_rows)).select("doc_id", held_out().alias("held_out"), "score", "predicted", "n_tokens", "passages")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))

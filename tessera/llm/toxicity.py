"""Toxic passages by maximum-scoring segments over token log-odds.

Tokens are words and the stems of words, their first bytes, as few labels can't teach every
inflected or compound word. Training counts, for every token, the labelled documents of either class that hold it;
log-odds with a Dirichlet prior proportional to the token's overall count, less two
standard errors, are the token's score; tokens that are not sure to either side score
nothing. A text is then a sequence of scores with a small cost per word (a word that
repeats the one before it scores once), and one linear scan finds all maximal segments
of positive score. Segment scores follow an extreme-value law on clean texts;
its rate solves sum p exp(rate * score) = 1 over clean tokens and its constant is read
from clean documents. A passage is significant if fewer than one in twenty such passages
are expected in a clean text of that length. The best passage's normalised score and the
sum of those of all further significant passages go through a logistic curve fitted on the
training documents, which says how much the further ones count. A second curve, fitted on
the first one's, weighs how much better the best passage gets if a word without a score takes that of its
longest stem that has one: much where labels are few, and less the more words they teach.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm._text import ALNUM, Words, as_long, blocks, mix, tidy
from tessera.session import Scratch

PRIOR_COUNTS, PRIOR_SHARE = 5000.0, 0.01  # the prior's pseudo-counts: a constant and a share of all counts
SURE = 2.0  # standard errors taken off a log-odds
MODEL_TOKENS = 1 << 16  # bound of what is broadcast; beyond it, scores of rarer tokens are joined to the texts
WORD_COST = 0.05
PREDICT_AT = 0.7
SIGNIFICANT = 0.05  # expected number of such passages in a clean text of the same length
BROADCAST_ROWS = 500_000
BIN = 0.25
STEMS = (7, 6, 5, 4)  # bytes of the stems, longest first
STEM_SCORE = 1.0  # least score of a stem that counts; most stems are of many neutral words


def token_family(words: Words) -> list[np.ndarray]:
    """Hashes of the words of a block, and of their stems from the longest on; 0 where a word is no longer than the stem.

    Those of stems are odd and those of words even.
    """
    padded = np.concatenate([words.data, np.zeros(8, np.uint8)])
    lane = np.ndarray(len(words.data) + 1, "<u8", padded, strides=(1,))[words.starts]
    size = words.ends - words.starts
    stems = [np.where(size > n, mix((lane & np.uint64((1 << 8 * n) - 1)) ^ np.uint64(n << 59)) | np.uint64(1), np.uint64(0)) for n in STEMS]
    return [as_long(words.hash & ~np.uint64(1)), *map(as_long, stems)]


def _token_counts(labelled: DataFrame) -> DataFrame:
    """(token, toxic, clean): training documents of each class that hold a token."""

    def fold(parts: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(parts).groupby("token", as_index=False, sort=False).sum()

    def count(batches):
        parts, held = [], 0
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, data, offs in blocks(batch.column(0)):
                words = Words(data, offs, ALNUM, True)
                family = np.stack(token_family(words))
                rows = [np.unique(family[:, words.bounds[i] : words.bounds[i + 1]]) for i in range(len(words))]
                rows = [r[r != 0] for r in rows]
                tokens = np.concatenate(rows)
                bad = np.repeat(toxic[lo : lo + len(rows)], [len(r) for r in rows]).astype(np.int64)
                parts.append(fold([pd.DataFrame({"token": tokens, "toxic": bad, "clean": 1 - bad})]))
                held += len(parts[-1])
                if held > 1_000_000:
                    parts = [fold(parts)]
                    held = len(parts[0])
                    if held > 500_000:
                        yield pa.RecordBatch.from_pandas(parts[0], preserve_index=False)
                        parts, held = [], 0
        if parts:
            yield pa.RecordBatch.from_pandas(fold(parts), preserve_index=False)

    counts = labelled.select("text", "toxic").mapInArrow(tidy(count), "token long, toxic long, clean long")
    return counts.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


class TokenScores:
    """The scoring tokens and the clean score distribution's rate.

    ``tokens`` and ``scores`` are held in memory. ``rest`` is a table (token, score) of
    the scoring tokens beyond them, or None; no token is in both.
    """

    def __init__(self, tokens: np.ndarray, scores: np.ndarray, rate: float, rest: DataFrame | None = None):
        order = np.argsort(tokens)
        self.tokens, self.scores, self.rate, self.rest = tokens[order], scores[order], rate, rest

    @classmethod
    def train(cls, labelled: DataFrame, scratch: Scratch) -> TokenScores:
        counts = scratch.table(_token_counts(labelled), "tokens")
        total = counts.where("pmod(token, 2) = 0").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()  # of words
        n1, n0 = float(total["t"] or 0), float(total["c"] or 0)
        if not n1 or not n0:
            return cls(np.zeros(0, np.int64), np.zeros(0), 1.0)
        a0 = PRIOR_COUNTS + PRIOR_SHARE * (n1 + n0)
        scored = counts.withColumn("a", (F.col("toxic") + F.col("clean")) * (a0 / (n1 + n0)))
        y1, y0 = F.col("toxic") + F.col("a"), F.col("clean") + F.col("a")
        odds = F.log(y1 / (n1 + a0 - y1)) - F.log(y0 / (n0 + a0 - y0))
        sure = F.greatest(F.abs(odds) - SURE * F.sqrt(1 / y1 + 1 / y0), F.lit(0.0))
        stem = F.pmod("token", F.lit(2)) == 1
        scored = scored.withColumn("score", F.when(stem & ((odds < 0) | (sure < STEM_SCORE)), 0.0).otherwise(F.signum(odds) * sure))
        rows = scored.where("score <> 0").orderBy(F.desc(F.abs("score")), "token").limit(MODEL_TOKENS + 1).select("token", "score", "clean").collect()
        if len(rows) > MODEL_TOKENS:
            return cls._of_table(scratch.table(scored.select("token", "score", "clean", (F.col("toxic") + F.col("clean")).alias("n")), "scores"), n0, scratch)
        tokens = np.array([r["token"] for r in rows], np.int64)
        scores = np.array([r["score"] for r in rows], float)
        words = tokens % 2 == 0
        share = np.array([r["clean"] + 0.5 for r in rows], float) / (n0 + 0.5 * words.sum() + 1)
        return cls(tokens, scores, _rate(scores[words] - WORD_COST, share[words]))

    @classmethod
    def _of_table(cls, scored: DataFrame, n0: float, scratch: Scratch) -> TokenScores:
        """Most frequent tokens in memory, with or without a score, so that none of many places is shuffled; all others in a table."""
        top = scored.orderBy(F.desc("n"), "token").limit(MODEL_TOKENS).select("token", "score", "n").collect()
        n, token = top[-1]["n"], top[-1]["token"]
        scored = scored.where("score <> 0")
        rest = scratch.table(scored.where((F.col("n") < n) | (F.col("n") == n) & (F.col("token") > token)).select("token", "score"), "rest")
        return cls(np.array([r["token"] for r in top], np.int64), np.array([r["score"] for r in top], float), _rate_of_table(scored.where("pmod(token, 2) = 0"), n0), rest)

    def of(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.zeros(len(tokens))
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return np.where(self.tokens[at] == tokens, self.scores[at], 0.0)

    def of_stems(self, words: np.ndarray, stems: list[np.ndarray], met: TokenScores | None = None) -> np.ndarray:
        """``words``, the words' own scores, with that of the longest stem that has one where there is none; ``met`` has scores that are not held."""
        out = words.copy()
        for tokens in stems:
            open_ = np.flatnonzero(out == 0.0)
            some = tokens[open_]
            out[open_] = self.of(some) + (met.of(some) if met else 0.0)
        return out


def _rate(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum p exp(rate * score) = 1; other tokens score -WORD_COST."""
    rest = max(0.0, 1 - share.sum())
    value = lambda r: float((share * np.exp(np.minimum(r * scores, 600))).sum() + rest * math.exp(-r * WORD_COST)) - 1
    lo, hi = 1e-3, 1e-3
    if not (scores > 0).any() or value(lo) >= 0:
        return 1.0 if not (scores > 0).any() else lo
    while value(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if value(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


def _rate_of_table(scored: DataFrame, n0: float) -> float:
    """``_rate`` over a table of scoring tokens; each aggregate tries 31 rates at once."""
    m, most = scored.agg(F.count("*"), F.max("score")).first()
    share = (F.col("clean") + 0.5) / (n0 + 0.5 * m + 1)
    rest = max(0.0, 1 - scored.agg(F.sum(share)).first()[0])

    def below(rates: np.ndarray) -> int:
        """How many of the rising rates lie below the root."""
        terms = [F.sum(share * F.exp(F.least(F.lit(float(r)) * (F.col("score") - WORD_COST), F.lit(600.0)))).alias(f"r{i}") for i, r in enumerate(rates)]
        values = np.array(scored.agg(*terms).first()) + rest * np.exp(-rates * WORD_COST) - 1
        return int(np.argmax(np.append(values, 0.0) >= 0))

    if most <= WORD_COST:
        return 1.0
    grid = 1e-3 * 2.0 ** np.arange(17)
    k = below(grid)
    if k == 0:
        return float(grid[0])
    lo, hi = grid[0], grid[min(k, len(grid) - 1)]
    for _ in range(10):
        grid = np.linspace(lo, hi, 33)
        k = below(grid[1:-1])
        lo, hi = grid[k], grid[k + 1]
    return float((lo + hi) / 2)


def maximal_segments(places: np.ndarray, scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal segments of positive total, as (first place, end place, score), in one pass.

    ``scores`` are those of scoring words at ``places``; every word costs WORD_COST.
    Segments on the stack keep the totals before them and up to their end, and a link to
    the nearest segment below with a lower total before it. A new word joins that segment
    if the joint one ends higher; links keep the scan linear however totals fall.
    """
    first: list[int] = []
    end: list[int] = []
    before: list[float] = []
    after: list[float] = []
    lower: list[int] = []
    total, last = 0.0, 0
    for place, score in zip(places.tolist(), scores.tolist()):
        total -= WORD_COST * (place - last)
        last = place + 1
        gain = score - WORD_COST
        if gain > 0:
            start, low, high = place, total, total + gain
            j = len(first) - 1
            while j >= 0 and before[j] >= low:
                j = lower[j]
            while j >= 0 and after[j] < high:
                start, low, below = first[j], before[j], lower[j]
                for column in (first, end, before, after, lower):
                    del column[j:]
                j = below
            for column, value in zip((first, end, before, after, lower), (start, last, low, high, j)):
                column.append(value)
        total += gain
    return [(a, b, hi - lo) for a, b, lo, hi in zip(first, end, before, after)]


SEGMENTS = "array<struct<lo:int,hi:int,score:double>>"


ADDED = {"__n_words": "long", "__segments": SEGMENTS, "__best": "double", "__stemmed": "double"}


def _row_segments(words: Words, scores: np.ndarray, again: np.ndarray) -> list[list[tuple[int, int, float]]]:
    """The segments of each row of a block; a word that repeats the one before it scores nothing."""
    at = np.flatnonzero(np.where(again, 0.0, scores))
    bounds = np.searchsorted(at, words.bounds)
    out = []
    for i in range(len(words)):
        own = at[bounds[i] : bounds[i + 1]]
        out.append(maximal_segments(own - words.bounds[i], scores[own]) if len(own) and scores[own].max() > WORD_COST else [])
    return out


def annotate(docs: DataFrame, model: TokenScores) -> DataFrame:
    """``docs`` with the number of words, the toxic passages by word places, and the best passage's score without and with stems.

    A text without a passage has those that its words' stems make.
    """
    held = docs.sparkSession.sparkContext.broadcast(TokenScores(model.tokens, model.scores, model.rate))
    kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("score", pa.float64())]))
    at_text, width = docs.columns.index("text"), len(docs.columns)

    def scan(batches):
        model = held.value
        for batch in batches:
            met = _met(batch.column(width)) if batch.num_columns > width else None
            ns, found, best, stemmed = [], [], [], []
            for _, data, offs in blocks(batch.column(at_text)):
                words = Words(data, offs, ALNUM, True)
                own, *stems = token_family(words)
                scores = model.of(own) + (met.of(own) if met else 0.0)
                again = np.zeros(len(scores), bool)
                again[1:] = words.hash[1:] == words.hash[:-1]
                again[words.bounds[:-1][words.counts > 0]] = False  # a row's first word repeats none
                wide = model.of_stems(scores, stems, met)
                plain, more = _row_segments(words, scores, again), _row_segments(words, wide, again)
                found.extend([{"lo": a, "hi": b, "score": s} for a, b, s in x or y] for x, y in zip(plain, more))
                best.extend(max((s for _, _, s in x), default=0.0) for x in plain)
                stemmed.extend(max((s for _, _, s in x), default=0.0) for x in more)
                ns.extend(words.counts.tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(ns, pa.int64()), pa.array(found, kind), pa.array(best, pa.float64()), pa.array(stemmed, pa.float64())], names=[*batch.schema.names[:width], *ADDED])

    schema = StructType([*docs.schema.fields, *StructType.fromDDL(", ".join(f"{k} {v}" for k, v in ADDED.items())).fields])
    return (docs if model.rest is None else _with_rest(docs, model, held)).mapInArrow(tidy(scan), schema)


def _with_rest(docs: DataFrame, model: TokenScores, held) -> DataFrame:
    """``docs`` with one more column: the scores that lie in the model's table of each text's tokens.

    Texts are named by a hash; two that share it get each other's scores too, which
    changes nothing, as a token's score is the same in every text.
    """

    def tokens(batches):
        known = held.value.tokens
        for batch in batches:
            for lo, data, offs in blocks(batch.column(1)):
                words = Words(data, offs, ALNUM, True)
                of_row = np.repeat(np.arange(len(words)), words.counts)
                for tokens in token_family(words):
                    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                    new = np.flatnonzero((known[at] != tokens) & (tokens != 0))
                    pairs = pd.DataFrame({"__key": batch.column(0).to_numpy()[lo + of_row[new]], "token": tokens[new]}).drop_duplicates()
                    yield pa.RecordBatch.from_pandas(pairs, preserve_index=False)

    named = docs.withColumn("__key", F.xxhash64("text"))
    pairs = named.select("__key", "text").mapInArrow(tidy(tokens), "__key long, token long")
    met = pairs.join(model.rest, "token").groupBy("__key").agg(F.collect_set(F.struct("token", "score")).alias("__met"))
    return named.join(met, "__key", "left").select(*docs.columns, "__met")


def _met(column: pa.ListArray) -> TokenScores | None:
    """The scores that any text of a batch has from the table."""
    rows = column.flatten()
    tokens, first = np.unique(rows.field(0).to_numpy(zero_copy_only=False), return_index=True)
    return TokenScores(tokens, rows.field(1).to_numpy(zero_copy_only=False)[first], 1.0) if len(tokens) else None


def held_out() -> Column:
    """Documents whose labels are never learnt from; never null, a null id reads as empty."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


class ToxicityModel:
    """Token scores with their calibration: the law of clean segment scores and the logistic curve."""

    def __init__(self, tokens: TokenScores, k: float, curve: tuple[float, float, float], stem_curve: tuple[float, float, float]):
        self.tokens, self.k, self.curve, self.stem_curve = tokens, k, curve, stem_curve

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame) -> ToxicityModel:
        """Learn from the labelled documents that are not held out."""
        scratch = Scratch(docs.sparkSession, "toxicity")
        labels = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out())
        labels = scratch.table(labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")), "labels")
        few = labels.count() <= BROADCAST_ROWS
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        labelled = texts.join(F.broadcast(labels) if few else labels.hint("merge"), "doc_id")
        tokens = TokenScores.train(labelled, scratch)
        seen = scratch.table(annotate(labelled, tokens).select("__n_words", "__best", "__stemmed", "__segments.score", "toxic"), "training")
        clean = seen.where("toxic = 0").agg(
            F.sum((F.col("__best") > WORD_COST).cast("double")).alias("hits"), F.sum(F.col("__n_words") * math.exp(-tokens.rate * WORD_COST)).alias("room")
        )
        clean = clean.first()
        k = ((clean["hits"] or 0.0) + 0.5) / ((clean["room"] or 0.0) + 1.0)
        x, more = _bounded(_normalised(F.col("__best"), tokens.rate, k)), _further(F.col("score"), tokens.rate, k)
        bins = seen.groupBy(F.floor(x / BIN).alias("bin"), F.floor(more / BIN).alias("more"), "toxic").agg(F.count("*").alias("n")).collect()  # at most 401 * 101 * 2 rows
        curve = _logistic([((r["bin"] + 0.5) * BIN, (r["more"] + 0.5) * BIN if r["more"] else 0.0, r["toxic"], r["n"]) for r in bins])
        z, rise = _logit(curve, x, more), _rise(tokens.rate)
        bins = seen.groupBy(F.floor(z / BIN).alias("bin"), F.floor(rise / BIN).alias("more"), "toxic").agg(F.count("*").alias("n")).collect()  # at most 321 * 101 * 2 rows
        return cls(tokens, k, curve, _logistic([((r["bin"] + 0.5) * BIN, (r["more"] + 0.5) * BIN if r["more"] else 0.0, r["toxic"], r["n"]) for r in bins]))

    def apply(self, docs: DataFrame) -> DataFrame:
        """``docs`` with the columns of ``annotate``, __score, __predicted and __e_value, the least of a passage.

        Of the segments, those that are significant stay.
        """
        best = _normalised(F.col("__best"), self.tokens.rate, self.k)
        more = _further(F.col("__segments.score"), self.tokens.rate, self.k)
        z = _logit(self.curve, _bounded(best), more)
        score = F.lit(1.0) / (1.0 + F.exp(-_logit(self.stem_curve, z, _rise(self.tokens.rate))))
        found = annotate(docs, self.tokens).withColumn("__score", score).withColumn("__predicted", (F.col("__score") >= PREDICT_AT).cast("int")).withColumn("__e_value", F.exp(-F.greatest(best, _normalised(F.col("__stemmed"), self.tokens.rate, self.k))))
        return found.withColumn("__segments", F.filter("__segments", lambda s: _normalised(s["score"], self.tokens.rate, self.k) >= -math.log(SIGNIFICANT)))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, segments, best_e_value) for each row of ``docs``.

    Labels are learnt from rows that are not held out. Null and empty texts have no
    passage and the lowest evidence there is; labels that are null are not learnt from; a label
    repeated for an id counts as toxic if any is. Without both classes every score is
    the share of toxic labels, or 0. Repeated rows and equal texts get equal scores; a
    score of exactly PREDICT_AT counts as toxic. Other columns are ignored.
    """
    out = ToxicityModel.fit(docs, labels).apply(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return out.select(
        "doc_id", held_out().alias("held_out"), F.col("__score").alias("score"), F.col("__predicted").alias("predicted"), F.col("__segments").alias("segments"), F.col("__e_value").alias("best_e_value")
    )


def _normalised(score: Column, rate: float, k: float) -> Column:
    """Extreme-value normalised score: minus the logarithm of the expected number of such segments by chance."""
    return F.lit(rate) * score - F.log(F.lit(k) * F.greatest(F.col("__n_words"), F.lit(1)))


def _bounded(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(-40.0)), F.lit(60.0))


def _logit(curve: tuple[float, float, float], x: Column, more: Column) -> Column:
    """Log-odds of a fitted curve, within -40 to 40."""
    a, b, c = curve
    return F.least(F.greatest(F.lit(a) + F.lit(b) * x + F.lit(c) * more, F.lit(-40.0)), F.lit(40.0))


def _rise(rate: float) -> Column:
    """How much higher the best passage scores with stems, normalised; at most 25."""
    return F.least(F.greatest(F.lit(rate) * (F.col("__stemmed") - F.col("__best")), F.lit(0.0)), F.lit(25.0))


def _further(scores: Column, rate: float, k: float) -> Column:
    """Logarithm of one plus the summed normalised scores of all significant passages but the best; at most 25."""
    normal = F.array_sort(F.transform(scores, lambda s: -_normalised(s, rate, k)))
    more = F.filter(F.slice(normal, 2, F.size(normal)), lambda x: -x >= -math.log(SIGNIFICANT))
    return F.least(F.log1p(F.aggregate(more, F.lit(0.0), lambda a, x: a - x)), F.lit(25.0))


def _logistic(points: list[tuple[float, float, int, int]], ridge: float = 1e-3) -> tuple[float, float, float]:
    """Intercept and two slopes of a ridge logistic fit of binned points (x, more, label, count); slopes are not negative."""
    if not points:
        return -50.0, 0.0, 0.0
    x, more, y, n = (np.array(c, float) for c in zip(*points))
    toxic = float((y * n).sum())
    if toxic == 0 or toxic == n.sum():
        share = toxic / n.sum()
        return math.log(max(share, 1e-9) / max(1 - share, 1e-9)), 0.0, 0.0
    design = np.stack([np.ones_like(x), x, more])
    weight, hold = n / n.sum(), np.array([1e-9, ridge, ridge])
    loss = lambda v: float((weight * (np.logaddexp(0, v @ design) - y * (v @ design))).sum() + (hold * v**2).sum() / 2)
    for use in ([0, 1, 2], [0, 1], [0]):  # a slope that would be negative is left out
        w = np.zeros(3)
        w[0] = math.log(toxic / (n.sum() - toxic))
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(w @ design, -500, 500)))
            grad = (design @ (weight * (p - y)) + hold * w)[use]
            hess = ((design * (weight * p * (1 - p))) @ design.T + np.diag(hold))[np.ix_(use, use)]
            step, size = np.zeros(3), 1.0
            step[use] = np.linalg.solve(hess, grad)
            while loss(w - size * step) > loss(w) and size > 1e-6:
                size /= 2
            w = w - size * step
            if np.abs(size * step).max() < 1e-9:
                break
        if (w[1:] >= 0).all():
            break
    return float(w[0]), float(w[1]), float(w[2])


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of ``documents``, learnt from ``labels`` that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return out.select("doc_id", "held_out", "score", "predicted")

"""Quality of a text by positive-unlabelled learning.

Trusted positives, unlabelled texts and an estimated share of good ones among these train a logistic model on measures of
the whole text, minimising the non-negative unbiased risk: the risk of the unlabelled as negatives, less what the
positives among them contribute, never below zero; a step that would drive it there is taken back.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import staged

MARKS = b".,;:!?|#*/<>=\"'()[]{}_-%&@"
UPPER, DIGIT, SPACE, HIGH = (np.isin(np.arange(256), np.array(list(x))) for x in (range(65, 91), range(48, 58), (9, 10, 13, 32), range(128, 256)))


def measures(text: str | None) -> np.ndarray:
    """Shares and logarithms that describe a whole text; all zero but for the first where there is none."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return np.zeros(15 + len(MARKS))
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, w, kinds = len(raw), len(words), len(set(words))
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = [x for x in raw.split(b"\n") if x]
    sizes = np.fromiter(map(len, words), np.int64, w)
    return np.concatenate([[
        1.0, np.log1p(w) / 10, kinds / w, kinds / np.sqrt(w) / 20, repeats / w, sizes.mean() / 10, sizes.std() / 10, (sizes <= 3).mean(),
        count[UPPER].sum() / n * 3, count[DIGIT].sum() / n * 5, count[SPACE].sum() / n * 3, count[HIGH].sum() / n * 3,
        len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))) / 10, len(zlib.compress(raw, 1)) / n],
        np.minimum(1, count[list(MARKS)] / w)])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def spread(m: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised measures, their squares and a constant."""
    z = np.clip((m - mean) / scale, -6, 6)
    return np.concatenate([z, z * z - 1, np.ones((len(m), 1))], axis=1)


def descend(p: np.ndarray, u: np.ndarray, pw: np.ndarray, uw: np.ndarray, gradient, steps: int, rate: float = 0.03, decay: float = 1e-4, batch: int = 1024, seed: int = 1) -> np.ndarray:
    """Weights by Adam on batches of both sides, drawn in proportion to ``pw`` and ``uw``."""
    rng = np.random.default_rng(seed)
    w = np.zeros(p.shape[1])
    first, second = np.zeros_like(w), np.zeros_like(w)
    upto_p, upto_u = np.cumsum(pw) / np.sum(pw), np.cumsum(uw) / np.sum(uw)
    draw = lambda x, upto: x[np.minimum(np.searchsorted(upto, rng.random(batch), side="right"), len(x) - 1)]
    for step in range(1, steps + 1):
        g = gradient(draw(p, upto_p), draw(u, upto_u), w) + decay * w
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8) * min(1, 2 - 2 * step / steps)
    return w


def told_apart(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient of the plain risk of positives against unlabelled, half each."""
    return 0.5 * (a.T @ (sigmoid(a @ w) - 1) / len(a) + b.T @ sigmoid(b @ w) / len(b))


def estimated_prior(p: np.ndarray, u: np.ndarray, pw: np.ndarray, uw: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled, by the best bin of a score that tells the two apart.

    The score is fitted on every other row and read on the rest. Above any score the unlabelled hold at least the prior
    times the positives' share there; the threshold with the smallest upper confidence bound of the ratio of the two
    shares gives the estimate. Kept within 0.05 and 0.95.
    """
    w = descend(p[::2], u[::2], pw[::2], uw[::2], told_apart, 800)
    sp, su, pw, uw = p[1::2] @ w, u[1::2] @ w, pw[1::2], uw[1::2]
    at = np.unique(sp)
    above = lambda s, v: (lambda o: 1 - np.concatenate([[0], np.cumsum(v[o])])[np.searchsorted(s[o], at)] / v.sum())(np.argsort(s, kind="stable"))
    qp, qu = above(sp, pw), above(su, uw)
    # Rows in effect, where copies weigh more than one.
    slack = sum(np.sqrt(np.log(4 / delta) / 2 * (v * v).sum() / v.sum() ** 2) for v in (pw, uw))
    ok = qp > 0
    best = np.argmin((qu[ok] + slack * (1 + qu[ok] / qp[ok])) / qp[ok]) if ok.any() else None
    return 0.5 if best is None else float(np.clip(qu[ok][best] / qp[ok][best], 0.05, 0.95))


def fit(positive: np.ndarray, unlabelled: np.ndarray, pw: np.ndarray | None = None, uw: np.ndarray | None = None, prior: float | None = None, steps: int = 3000) -> dict:
    """A model by the non-negative risk; the prior is estimated where none is given. ``pw`` and ``uw`` count copies of a row."""
    pw = np.ones(len(positive)) if pw is None else pw.astype(float)
    uw = np.ones(len(unlabelled)) if uw is None else uw.astype(float)
    both, weights = np.concatenate([positive, unlabelled]), np.concatenate([pw, uw])
    mean = np.average(both, axis=0, weights=weights)
    scale = np.sqrt(np.average((both - mean) ** 2, axis=0, weights=weights)) + 1e-6
    p, u = spread(positive, mean, scale), spread(unlabelled, mean, scale)
    if prior is None:
        prior = estimated_prior(p, u, pw, uw) if min(len(p), len(u)) > 1 else 0.5

    def non_negative(a, b, w):
        sa, sb = sigmoid(a @ w), sigmoid(b @ w)
        as_positive = a.T @ (sa - 1) / len(a)
        as_negative = b.T @ sb / len(b) - prior * (a.T @ sa / len(a))
        risk = -np.log(1 - sb + 1e-12).mean() + prior * np.log(1 - sa + 1e-12).mean()
        return -as_negative if risk < 0 else prior * as_positive + as_negative

    return {"mean": mean, "scale": scale, "prior": prior, "w": descend(p, u, pw, uw, non_negative, steps)}


def score_of(model: dict | None, m: np.ndarray) -> np.ndarray:
    return np.full(len(m), 0.5) if model is None else sigmoid(spread(m, model["mean"], model["scale"]) @ model["w"])


def draw(known: DataFrame, most_positive: int, most_unlabelled: int) -> DataFrame:
    """h, p, u: the different texts that are drawn, with the rows each stands for as a positive and as an unlabelled one.

    ``known`` has h (a hash of the text) and good. Texts with the smallest stirred hashes are taken, so a text comes once
    however often it is copied, and there is a draw wherever there are rows.
    """
    texts = staged(known.groupBy("h").agg(F.count(F.when(F.col("good"), 1)).alias("good"), F.count("*").alias("n")), "different-texts")
    positive = texts.where("good > 0").orderBy(F.xxhash64("h", F.lit(3)), "h").limit(most_positive).select("h", F.col("good").alias("p"), F.lit(0).cast("long").alias("u"))
    unlabelled = texts.orderBy(F.xxhash64("h", F.lit(4)), "h").limit(most_unlabelled).select("h", F.lit(0).cast("long").alias("p"), F.col("n").alias("u"))
    return positive.unionByName(unlabelled).groupBy("h").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))


def learn(docs: DataFrame, judged: DataFrame, most_positive: int = 8000, most_unlabelled: int = 16000) -> dict | None:
    """A model from ``docs`` (doc_id, text) and ``judged`` (doc_id, quality): 1 marks trusted positives.

    Every row of ``docs`` is unlabelled web; positives are drawn besides, and other labels are not used. The share of
    positives in the unlabelled is estimated from the scores of the two samples. The two bounds limit the different texts
    drawn and sent to the driver as measures; copies count as weights. Only hashes of texts meet ``judged``; the texts drawn
    are read again by a broadcast of at most the two bounds' rows. A repeated doc_id takes 1 if any of its labels is 1, a
    null one has none. None where there are no positives.
    """
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    good = judged.where("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumn("good", F.lit(True))
    known = docs.select("doc_id", h.alias("h")).join(good, "doc_id", "left").select("h", F.coalesce("good", F.lit(False)).alias("good"))
    drawn = staged(draw(known, most_positive, most_unlabelled), "drawn-texts")

    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()  # at most the texts drawn
        for f in frames:
            f = f[~f.h.isin(seen) & ~f.h.duplicated()]
            seen.update(f.h)
            yield pd.DataFrame({"h": f.h, "m": [measures(t) for t in f.text]})

    taken = docs.select(h.alias("h"), "text").join(F.broadcast(drawn.select("h")), "h").mapInPandas(measured, "h long, m array<double>")
    rows = taken.groupBy("h").agg(F.min("m").alias("m")).join(drawn, "h").orderBy("h").collect()
    p, u = [r for r in rows if r.p], [r for r in rows if r.u]
    if not p or not u:
        return None
    return fit(np.array([r.m for r in p]), np.array([r.m for r in u]), np.array([r.p for r in p]), np.array([r.u for r in u]))


def scored(docs: DataFrame, model: dict | None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) added or replaced.

    Whole texts are measured; null is the empty text and gets the score of one. Rows are judged one by one, so repeated
    rows and null ids change nothing. Without a model every score is 0.5. No rows give no rows.
    """
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(score_of(model, np.array([measures(t) for t in b])) if len(b) else np.zeros(0))

    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")]
    out = docs.select(*own, F.pandas_udf(f, "double")(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

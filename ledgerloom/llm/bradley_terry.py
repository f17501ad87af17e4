"""Quality classifier: Bradley-Terry scores from preference pairs, cut at a quantile."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import held_out, known_labels, materialize, sampled_labels
from ledgerloom.llm.decision_list import FEATURES, text_statistics

THRESHOLD = 0.3
#: Levels of the score quantiles that the cut is chosen from.
LEVELS = 1_000


def _transformed(feature: str) -> Column:
    """Long-tailed, non-negative ratios on a log scale."""
    return F.log1p(F.coalesce(F.col(feature), F.lit(0.0)) * F.lit(1.0 if feature in ("words", "mean_word") else 20.0))


@dataclass(frozen=True)
class PairwiseModel:
    """Standardised features, each as is and beyond one deviation on either side."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]
    weights: tuple[float, ...]

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - np.array(self.means)) / np.array(self.deviations), -6, 6)
        return np.hstack([z, np.maximum(z - 1, 0), np.maximum(-z - 1, 0)])

    def strength(self) -> Column:
        """The document's latent strength as a Column over its statistics."""
        n = len(self.features)
        total = F.lit(0.0)
        for k, f in enumerate(self.features):
            z = (_transformed(f) - F.lit(self.means[k])) / F.lit(self.deviations[k])
            z = F.least(F.greatest(z, F.lit(-6.0)), F.lit(6.0))
            total = total + F.lit(self.weights[k]) * z
            total = total + F.lit(self.weights[n + k]) * F.greatest(z - 1, F.lit(0.0))
            total = total + F.lit(self.weights[2 * n + k]) * F.greatest(-z - 1, F.lit(0.0))
        return total


def fit_pairs(better: np.ndarray, worse: np.ndarray, ridge: float = 1.0, steps: int = 60) -> np.ndarray:
    """Weights that minimise the logistic loss of the pairs' feature differences."""
    d = better - worse
    w = np.zeros(d.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        gradient = -d.T @ p + ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn_ranking(
    statistics: DataFrame, features: tuple[str, ...] = FEATURES, pairs_each: int = 8, seed: int = 5
) -> PairwiseModel | None:
    """Rank the sample's good documents over its bad ones; null without both kinds.

    Every bad document meets ``pairs_each`` good ones and the other way round.
    """
    got = statistics.select("label", *[_transformed(f).alias(f) for f in features]).toArrow()
    y = got.column("label").to_numpy()
    if not len(y) or y.min() == y.max():
        return None
    x = np.column_stack([got.column(f).to_numpy() for f in features]).astype(float)
    order = np.lexsort([*x.T, y])  # independent of the partitions' order
    x, y = x[order], y[order]
    deviations = x.std(axis=0)
    deviations[deviations < 1e-9] = 1.0
    model = PairwiseModel(features, tuple(x.mean(axis=0).tolist()), tuple(deviations.tolist()), ())
    e = model.expand(x)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    draw = np.random.default_rng(seed)
    a = np.concatenate([draw.choice(good, pairs_each * len(bad)), np.repeat(good, pairs_each)])
    b = np.concatenate([np.repeat(bad, pairs_each), draw.choice(bad, pairs_each * len(good))])
    return PairwiseModel(features, model.means, model.deviations, tuple(fit_pairs(e[a], e[b]).tolist()))


def quantile_cut(strengths: DataFrame, known: DataFrame) -> tuple[float, float]:
    """(level, cut): the cut is the quantile of all documents' strengths at that level.

    ``strengths`` has doc_id and strength of every document.  The quantiles at
    ``LEVELS`` levels are one summary over all of them; the level is the one with the
    fewest wrong verdicts on all labels that are not held out, which are counted by the
    quantiles that they lie between.  Of equal levels the middle one is taken.
    """
    grid = [k / LEVELS for k in range(LEVELS + 1)]
    cuts = strengths.agg(F.percentile_approx("strength", grid, 20 * LEVELS).alias("q")).first()["q"]
    if not cuts:
        return 0.0, 0.0
    steps = F.array(*[F.lit(float(c)) for c in cuts])
    met = strengths.join(known, "doc_id").select("label", F.size(F.filter(steps, lambda c: c <= F.col("strength"))).alias("below"))
    counts = np.zeros((2, len(cuts) + 1))
    for r in met.groupBy("label", "below").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["label"], r["below"]] = r["n"]
    # at level k documents pass that have more than k of the cuts at or below them
    wrong = np.cumsum(counts[1])[:-1] + counts[0].sum() - np.cumsum(counts[0])[:-1]
    best = np.flatnonzero(wrong == wrong.min())
    k = int(best[len(best) // 2])
    return grid[k], float(cuts[k])


def fitted(statistics: DataFrame, labels: DataFrame, sample: int, label: str) -> tuple[PairwiseModel, float, float] | None:
    """Model, level and cut from the statistics of all documents; null without both labels.

    The model is fitted on at most ``sample`` ids of each label; of rows that share an
    id the least statistics are taken.
    """
    known = materialize(known_labels(labels, label), "quality-labels")
    met = statistics.join(F.broadcast(sampled_labels(known, sample)), "doc_id")
    one = met.groupBy("doc_id", "label").agg(F.min(F.struct(*FEATURES)).alias("x")).select("label", "x.*")
    model = learn_ranking(one)
    if model is None:
        return None
    level, cut = quantile_cut(materialize(statistics.select("doc_id", model.strength().alias("strength")), "quality-strengths"), known)
    return model, level, cut


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = 8_000, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Statistics are expressions over the whole text, computed once and written without
    it; the model is one more expression over them.  The cut, a quantile of all
    documents' strengths, lies at score 0.3.  Null and empty texts are texts without
    words; repeated rows get one row each.  Without labels of both kinds all scores are
    0.3.
    """
    table = text_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", *FEATURES)
    statistics = materialize(table, "quality-statistics")
    found = fitted(statistics, labels, sample, label)
    start = math.log(THRESHOLD / (1 - THRESHOLD))
    line = F.lit(start) if found is None else found[0].strength() - F.lit(found[2]) + F.lit(start)
    # at the cut itself the score must not fall below the threshold by rounding
    score = 1 / (1 + F.exp(-F.greatest(F.least(line, F.lit(30.0)), F.lit(-30.0))))
    passes = F.lit(True) if found is None else found[0].strength() >= F.lit(found[2])
    held = F.when(passes, F.greatest(score, F.lit(THRESHOLD))).otherwise(F.least(score, F.lit(THRESHOLD - 1e-12)))
    return statistics.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), held.alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )

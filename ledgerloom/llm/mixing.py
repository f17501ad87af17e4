"""Mixing: rake token weights to source, language and topic marginals, then sample."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import WORD_RUN, broadcast_within, let, materialize, wrapped, words_of

#: Bytes of one row of rates in a hash table, with long category names.
RATE_ROW_BYTES = 256

DIMENSIONS = ("source", "lang", "topic")
DRAW_SEED = 23
#: Most factors of a dimension that are held as a literal.
LITERAL_ROWS = 1_000


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words are counted in so many hashed bins to find a corpus's topic words.
TOPIC_BINS = 1 << 16
#: Words that topics are made of, a bit each.
TOPIC_WORDS = 63


def _bins_of(text: Column) -> Column:
    """Hashed bins of the distinct words of four or more characters, A-Z lower-cased."""
    words = F.filter(words_of(F.translate(text, UPPER, LOWER)), lambda w: F.length(w) >= 4)
    return F.array_distinct(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(TOPIC_BINS)).cast("int")))


@dataclass(frozen=True)
class Topics:
    """Topic words as bins (commonest first), each with its weight and its topic's number."""

    words: list[int]
    weights: list[float]
    topic: list[int]

    def mask(self, bins: Column) -> Column:
        """The words of a document as bits of one number."""
        known = F.array(*[F.lit(b) for b in self.words])
        bit = lambda m, b: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (F.array_position(known, b) - 1).cast("int")))
        return F.aggregate(F.array_intersect(known, bins), F.lit(0).cast("long"), bit)

    def name(self, mask: Column) -> Column:
        """The topic whose words weigh most in the document; the first of equals."""
        names, scores = [], []
        for t in range(max(self.topic) + 1):
            own = [i for i, of in enumerate(self.topic) if of == t]
            names.append(F.lit(f"topic-{self.words[own[0]]}"))
            parts = [F.getbit(mask, F.lit(i)).cast("double") * F.lit(self.weights[i]) for i in own]
            scores.append(F.struct(reduce(Column.__add__, parts).alias("score"), F.lit(-t).alias("turn")))
        best = F.array_max(F.array(*scores))
        return F.when(best["score"] > 0, F.get(F.array(*names), -best["turn"])).otherwise("other")


def together(masks: DataFrame, words: int) -> tuple[list[list[float]], list[list[float]]]:
    """How many documents have both of two words, and how many would if words were
    independent within each language: two tables of ``words`` by ``words`` numbers.

    ``masks`` has lang and mask.  Counts are summed by (language, word) in each task first.
    """
    at = range(words)
    ones = F.filter(F.sequence(F.lit(0), F.lit(words - 1)), lambda i: F.getbit("mask", i) == 1)
    each = masks.select("lang", "mask", F.explode(ones).alias("i"))
    both = materialize(
        each.groupBy("lang", "i").agg(*[F.sum(F.getbit("mask", F.lit(j)).cast("long")).alias(f"c{j}") for j in at]), "mix-together"
    )
    sizes = masks.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    own = both.groupBy("lang").agg(*[F.coalesce(F.max(F.when(F.col("i") == j, F.col(f"c{j}"))), F.lit(0)).alias(f"n{j}") for j in at])
    by_word = own.join(sizes, "lang").select("*", F.posexplode(F.array(*[f"n{j}" for j in at])).alias("i", "n_i"))
    table = lambda rows: [[r[j + 1] for j in at] for r in sorted(rows.collect())]
    found = both.groupBy("i").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in at])
    expected = by_word.groupBy("i").agg(*[F.sum(F.col("n_i") * F.col(f"n{j}") / F.col("n")).alias(f"e{j}") for j in at])
    return table(found), table(expected)


def grouped_words(found: list[list[float]], expected: list[list[float]], topics: int) -> list[int]:
    """The topic of each word: words that meet more often than chance has it are joined,
    those with the highest mean correlation first, until ``topics`` groups are left."""
    words = range(len(found))
    like = lambda i, j: round((found[i][j] - expected[i][j]) / math.sqrt(found[i][i] * found[j][j]), 9)
    groups = {i: [i] for i in words}
    sums = {(i, j): like(i, j) for i in words for j in words if i < j}
    while len(groups) > topics:
        a, b = min(sums, key=lambda p: (-round(sums[p] / (len(groups[p[0]]) * len(groups[p[1]])), 9), p))
        groups[a] += groups.pop(b)
        for c in groups:
            if c != a:
                sums[min(a, c), max(a, c)] += sums.pop((min(b, c), max(b, c)))
        del sums[a, b]
    number = {w: t for t, first in enumerate(sorted(groups)) for w in groups[first]}
    return [number[w] for w in words]


def learn_topics(table: DataFrame, topics: int = 8, widest: float = 0.2) -> Topics | None:
    """Groups of words that meet in documents more often than chance has it.

    ``table`` has the ``bins`` and the lang of every document.  Words are counted in
    ``TOPIC_BINS`` hashed bins, so that what is shuffled and what the driver sees is
    bounded; a bin's count is that of its common word, as rare ones add little.  The
    ``TOPIC_WORDS`` words that most documents hold, but at most ``widest`` of them, are
    grouped by how often they meet beyond what their language explains.  A word weighs the
    logarithm of documents over those that have it.
    """
    total = table.count()
    each = table.select(F.explode("bins").alias("bin"))
    counts = each.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= F.lit(widest * total))
    top = counts.orderBy(F.desc("n"), "bin").limit(TOPIC_WORDS).collect()
    if not top:
        return None
    words = [r["bin"] for r in top]
    weights = [math.log(total / r["n"]) for r in top]
    # written: each of the many counts would make the mask again
    masks = materialize(table.select("lang", Topics(words, weights, []).mask(F.col("bins")).alias("mask")), "mix-masks")
    return Topics(words, weights, grouped_words(*together(masks, len(words)), topics))


def _with_topics(table: DataFrame, topics: int) -> DataFrame:
    """Adds topic: 'topic-<bin>' after the topic's commonest word, 'other' for a text without
    topic words, 'empty' for no text."""
    if "bins" not in table.columns:
        return table
    learned = learn_topics(table, topics)
    named = F.lit("other") if learned is None else let(learned.mask(F.col("bins")), learned.name)
    return table.withColumn("topic", F.when(F.col("blank"), F.lit("empty")).otherwise(named)).drop("bins", "blank")


def tempered_targets(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """Target share of each value: its token share to ``power``, renormalised.

    1 keeps the corpus as it is, 0 makes all values equal.
    """
    mass = cells.groupBy(dimension).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("_m"))
    total = mass.agg(F.sum("_m")).first()[0] or 1.0
    return mass.select(dimension, (F.col("_m") / F.lit(total)).alias("share"))


def rake(
    cells: DataFrame,
    targets: dict[str, DataFrame],
    tolerance: float = 1e-3,
    max_sweeps: int = 15,
    start: dict | None = None,
    found: dict | None = None,
) -> DataFrame:
    """Iterative proportional fitting: ``cells`` with a ``weight`` whose marginals are the targets.

    ``cells`` has one row per combination of dimensions with its tokens.  A cell's
    weight is its token share times one factor per dimension; only the factors, a
    row per value, change.  A sweep sets each dimension's factors in turn to the
    target share over the sum that the other factors give.  Those sums are
    aggregated before they are shuffled, so no value is too large for a task, and
    each set of factors is computed at once, so plans stay short.  Sweeps end when no
    factor moves by more than ``tolerance`` of itself, or after ``max_sweeps``; the
    column ``converged`` tells which it was.  ``start`` has the factors to begin with;
    ``found`` gets the last ones.
    A value without a target keeps no weight; a target without cells is ignored.
    """
    names = list(targets)
    counts = cells.agg(F.sum("tokens").cast("double").alias("t"), *[F.count_distinct(d).alias(d) for d in names]).first()
    shares = cells.withColumn("weight", F.col("tokens") / F.lit(counts["t"] or 1.0))
    wanted = {d: _few(t.select(d, F.col("share").cast("double")), max(counts[d], t.count())) for d, t in targets.items()}
    factors = {d: f for d, f in (start or {}).items() if d in names}

    def weighted(without: str | None = None) -> DataFrame:
        out = shares
        for d, factor in factors.items():
            if d == without:
                continue
            if isinstance(factor, dict):
                known = F.from_json(F.lit(json.dumps(factor)), "map<string,double>")
                value = F.coalesce(F.try_element_at(known, F.col(d).cast("string")), F.lit(0.0))
                out = out.withColumn("weight", F.col("weight") * value)
            else:
                out = out.join(factor.withColumnRenamed("factor", "_factor"), d)
                out = out.withColumn("weight", F.col("weight") * F.col("_factor")).drop("_factor")
        return out

    off = 0.0
    for _ in range(max_sweeps):
        off = 0.0
        for d in names:
            sums = weighted(d).groupBy(F.col(d).cast("string").alias(d)).agg(F.sum("weight").alias("_sum"))
            factors[d], change = _new_factors(sums, wanted[d], factors.get(d), d)
            off = max(off, change)
        if off <= tolerance:
            break
    if found is not None:
        found.update(factors)
    return weighted().withColumn("converged", F.lit(off <= tolerance))


def _few(shares: DataFrame, values: int) -> DataFrame | dict[str, float]:
    """Shares by value: a dict of up to ``LITERAL_ROWS`` values, a written table of more."""
    return materialize(shares, "mix-target") if values > LITERAL_ROWS else {str(v): x for v, x in shares.collect()}


def _new_factors(sums: DataFrame, wanted, was, d: str) -> tuple[DataFrame | dict[str, float], float]:
    """A dimension's factors, share over sum, and the largest relative change among them.

    Few values are a literal in the next sums; many stay a table.
    """
    if isinstance(wanted, dict):
        new = {v: wanted.get(v, 0.0) / total if total > 0 else 0.0 for v, total in sums.collect()}
        return new, max((abs(x - (was or {}).get(v, 0.0)) / max(x, 1e-12) for v, x in new.items()), default=0.0)
    factor = F.when(F.col("_sum") > 0, F.coalesce("share", F.lit(0.0)) / F.col("_sum")).otherwise(F.lit(0.0))
    table = sums.join(wanted.withColumn(d, F.col(d).cast("string")), d, "left").select(d, factor.alias("factor"))
    before = sums.select(d, F.lit(0.0).alias("was")) if was is None else was.withColumnRenamed("factor", "was")
    kept = materialize(table.join(before, d), "mix-factor")
    change = F.abs(F.col("factor") - F.col("was")) / F.greatest("factor", F.lit(1e-12))
    return kept.drop("was"), kept.agg(F.max(change)).first()[0] or 0.0


def _labelled(topic: Column | None) -> dict[str, Column]:
    """Dimensions, tokens and draw as expressions over a row; null values are ''.

    Without a topic the row's word bins stand for it, as topics are still to be learned.
    """
    text = F.col("text")
    if topic is None:
        about = {"bins": _bins_of(text), "blank": F.coalesce(F.length(text), F.lit(0)) == 0}
    else:
        about = {"topic": F.coalesce(topic.cast("string"), F.lit(""))}
    return about | {
        "source": F.coalesce(F.col("source").cast("string"), F.lit("")),
        "lang": F.coalesce(F.col("lang").cast("string"), F.lit("")),
        "n_tokens": F.greatest(F.coalesce(F.regexp_count("text", F.lit(WORD_RUN)), F.lit(0)), F.lit(1)).cast("long"),
        "draw": F.shiftrightunsigned(F.xxhash64(F.lit(DRAW_SEED), "doc_id", "text"), 11) / F.lit(float(1 << 53)),
    }


def _with_rates(table: DataFrame, targets, power: float, keep_share: float | None) -> DataFrame:
    """``table`` (dimensions, n_tokens, ...) with cell_weight, probability, converged."""
    cells = materialize(table.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "mix-cells")
    rates = _rates(cells, targets, power, keep_share)
    return table.join(broadcast_within(rates, rates.count(), RATE_ROW_BYTES), list(DIMENSIONS))


def mix_documents(
    docs: DataFrame,
    power: float = 0.7,
    targets: dict[str, DataFrame] | None = None,
    topic: Column | None = None,
    topics: int = 8,
    keep_share: float | None = None,
) -> DataFrame:
    """One row per document with its calibrated probability and the draw's outcome.

    Token weights (words) are raked to the marginals; a cell's probability is its
    weight over its tokens, scaled so that the largest is 1, or with ``keep_share``
    so that this share of tokens stays (see ``_rates``).  ``topic`` is an expression;
    without one topics are learned from the words of all documents.  The draw compares
    the probability with a hash of (doc_id, text): the same rows are kept on every run,
    and repeated rows share their fate.  Null values of a dimension form the value ''.
    A text without words has one token, so that it takes part.  Returns doc_id, source,
    lang, topic, n_tokens, cell_weight, probability, converged (did raking end within
    its tolerance?), sampled.  An empty table gives no rows.
    """
    written = materialize(docs.select("doc_id", *[v.alias(k) for k, v in _labelled(topic).items()]), "mix-docs")
    table = _with_topics(written, topics)
    return _with_rates(table, targets, power, keep_share).select(
        "doc_id",
        *DIMENSIONS,
        "n_tokens",
        "cell_weight",
        "probability",
        "converged",
        (F.col("draw") < F.col("probability")).alias("sampled"),
    )


def attainable_weights(cells: DataFrame, power: float, keep_share: float, rounds: int = 3) -> tuple[float, DataFrame]:
    """The power nearest to ``power`` whose targets let ``keep_share`` of the tokens stay, and its raked cells.

    A draw that meets the targets keeps at most 1 / (top * tokens), where top is the
    largest weight over tokens of a cell: all tokens at power 1, fewer below.  The
    logarithm is close to linear in the power, so a few secants through (1, 0) find it;
    each search step rakes a few sweeps on from the last one's factors, and the power
    found is then raked to the end.
    """
    least, factors = 0.0, {}
    for _ in range(rounds):
        targets = {d: tempered_targets(cells, d, power) for d in DIMENSIONS}
        most = _most_kept(rake(cells, targets, tolerance=0.02, max_sweeps=2, start=dict(factors), found=factors))
        if power >= 1 or most >= keep_share * 0.995 and (least == 0.0 or most <= keep_share * 1.005):
            break
        if least == 0.0:
            least = power
        slope = -math.log(min(most, 1 - 1e-9)) / (1 - power)
        power = min(1.0, max(least, 1 + math.log(keep_share) / slope))
    targets = {d: tempered_targets(cells, d, power) for d in DIMENSIONS}
    return power, materialize(rake(cells, targets, start=factors), "mix-rates")


def _most_kept(weights: DataFrame) -> float:
    """Largest share of tokens that a draw can keep with all probabilities in proportion to the weights."""
    r = weights.agg(F.max(F.col("weight") / F.col("tokens")).alias("top"), F.sum("weight").alias("w"), F.sum("tokens").alias("t")).first()
    return r["w"] / (r["top"] * r["t"]) if r["top"] else 1.0


def _rates(
    cells: DataFrame, targets: dict[str, DataFrame] | None, power: float, keep_share: float | None = None
) -> DataFrame:
    """Sampling probability of each cell, materialized.

    It is the cell's weight over its tokens, times one scale that needs no
    probability above 1, so that the targets hold in expectation: by default the
    largest such scale, with ``keep_share`` at most the one that keeps that share of
    all tokens.  Targets that are given bind, even if less can be kept then; default
    targets move towards the observed shares until that share can be kept.
    """
    if targets or keep_share is None:
        wanted = targets or {d: tempered_targets(cells, d, power) for d in DIMENSIONS}
        weights = materialize(rake(cells, wanted), "mix-rates")
    else:
        _, weights = attainable_weights(cells, power, keep_share)
    ratio = F.col("weight") / F.col("tokens")
    ends = weights.agg(F.max(ratio).alias("top"), F.sum("weight").alias("w"), F.sum("tokens").alias("t")).first()
    scale = 1 / (ends["top"] or 1.0)
    if keep_share is not None and ends["w"]:
        scale = min(scale, keep_share * ends["t"] / ends["w"])
    probability = F.least(F.lit(1.0), ratio * F.lit(scale))  # 1 is passed by rounding only
    return weights.select(*DIMENSIONS, F.col("weight").alias("cell_weight"), probability.alias("probability"), "converged")


def sample_to_weights(
    docs: DataFrame,
    power: float = 0.7,
    targets: dict[str, DataFrame] | None = None,
    topic: Column | None = None,
    topics: int = 8,
    keep_share: float | None = None,
) -> DataFrame:
    """The documents that ``mix_documents`` samples, with all their columns.

    Rows, their dimensions and draws are written once, so that no text is judged twice;
    columns may have any name, and ids may be null or repeated.  Rows are not shuffled
    while the table of rates is within the broadcast bound; a larger one meets them by
    key.  An empty table stays empty.
    """
    table = _with_topics(materialize(wrapped(docs, **_labelled(topic)), "mix-rows"), topics)
    return _with_rates(table, targets, power, keep_share).where(F.col("draw") < F.col("probability")).select("row.*")

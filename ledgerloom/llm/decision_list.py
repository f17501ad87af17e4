"""Quality rules: a learned decision list of threshold conjunctions, native Spark only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import SPACE_CHARS, let, materialize, words_of

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
#: Ratios that the conjunctions test.
FEATURES = (
    "words",
    "mean_word",
    "symbol_ratio",
    "bang_ratio",
    "capital_ratio",
    "pipe_ratio",
    "dup_line_ratio",
    "repeat_ratio",
    "distinct_ratio",
)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def _repeated_words(words: Column) -> Column:
    """Words covered by windows of eight words that occur at least twice.

    Windows are 64-bit hashes of eight word hashes, compared within one text only.
    Texts whose windows are all different end at that test.  Else the windows are
    sorted with their positions, those with an equal neighbour keep their position,
    and each covers eight words or as many as lie before the next: O(n log n).
    """

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(
            s,
            lambda p, i: F.coalesce(p["h"] == F.get(s, i - 1)["h"], F.lit(False))
            | F.coalesce(p["h"] == F.get(s, i + 1)["h"], F.lit(False)),
        )
        places = let(ordered, lambda s: F.sort_array(F.transform(twice(s), lambda p: p["i"])))
        return let(
            places,
            lambda q: F.aggregate(
                F.transform(q, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(q, k + 1) - p, F.lit(WINDOW)))),
                F.lit(0),
                lambda total, n: total + n,
            ),
        )

    def counted(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(covered(windows))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    # the last words begin no window
    window = lambda h: lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)])
    windows = let(hashes, lambda h: F.slice(F.transform(h, window(h)), F.lit(1), F.size(h) - F.lit(WINDOW - 1)))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(windows, counted)).cast("long")


def _repeated_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.length(F.btrim(line, F.lit(SPACE_CHARS))) > 0)
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id with the base counts and the ratios of every whole text.

    A null text counts as empty: all counts are 0 and all ratios 0.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        "doc_id",
        text.alias("_text"),
        words_of(text).alias("_words"),
    )
    counted = base.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        (F.length("_text") - _count(F.col("_text"), r"[\x20\x09-\x0D]")).alias("word_chars"),
        _count(F.col("_text"), SYMBOLS).alias("n_symbols"),
        _repeated_lines(F.col("_text")).alias("n_dup_lines"),
        _repeated_words(F.col("_words")).alias("n_repeat_words"),
        F.size(F.array_distinct("_words")).alias("_distinct"),
        _count(F.col("_text"), "!").alias("_bangs"),
        _count(F.col("_text"), "[A-Z]").alias("_capitals"),
        _count(F.col("_text"), r"\|").alias("_pipes"),
        (_count(F.col("_text"), "\n") + 1).alias("_lines"),
    )
    per_word = lambda c: F.col(c) / F.greatest("n_words", F.lit(1))
    per_char = lambda c: F.col(c) / F.greatest("word_chars", F.lit(1))
    return counted.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        F.col("n_words").cast("double").alias("words"),
        per_word("word_chars").alias("mean_word"),
        per_word("n_symbols").alias("symbol_ratio"),
        per_word("_bangs").alias("bang_ratio"),
        per_char("_capitals").alias("capital_ratio"),
        per_word("_pipes").alias("pipe_ratio"),
        (F.col("n_dup_lines") / F.col("_lines")).alias("dup_line_ratio"),
        per_word("n_repeat_words").alias("repeat_ratio"),
        per_word("_distinct").alias("distinct_ratio"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.coalesce(F.col(self.feature), F.lit(0.0))
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    rejected: int
    wrongly: int

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules that reject; a text that none covers is kept."""

    rules: tuple[Rule, ...]

    def fired(self) -> Column:
        """Number of the first rule that covers the row, from 1; null if none."""
        out = F.lit(None).cast("int")
        for k in range(len(self.rules), 0, -1):
            out = F.when(self.rules[k - 1].column(), F.lit(k)).otherwise(out)
        return out


def learn_decision_list(
    labelled: DataFrame,
    bad: str = "bad",
    features: tuple[str, ...] = FEATURES,
    max_rules: int = 8,
    max_conditions: int = 3,
    cuts: int = 24,
    min_precision: float = 0.9,
    min_support: int = 3,
) -> DecisionList:
    """Sequential covering over labelled statistics.

    A rule grows by the condition with the best FOIL gain on two thirds of the rows
    (the grow part), then loses trailing conditions while the last third (the prune
    part) gets no worse, and is taken if its Laplace precision on all rows is
    ``min_precision`` or more and it covers ``min_support`` bad rows.  Covered rows
    then leave.  Thresholds are quantiles of each feature; a row becomes its bin
    numbers once, and every step is one sum by (feature, bin) over equal rows
    merged beforehand.  The driver only sees those sums: features x bins of them.
    No labelled rows, or one label only: an empty list.
    """
    grid = [k / cuts for k in range(1, cuts)]
    spots = labelled.agg(
        *[F.percentile_approx(f, grid, 2000).alias(f"a_{f}") for f in features],
        *[F.percentile_approx(F.when(F.col(bad), F.col(f)), grid, 2000).alias(f"b_{f}") for f in features],
    ).first()
    edges = {f: sorted({float(x) for x in [*(spots[f"a_{f}"] or []), *(spots[f"b_{f}"] or [])]}) for f in features}
    features = tuple(f for f in features if edges[f])
    if not features:
        return DecisionList(())

    def bin_of(f: str) -> Column:
        # bin k holds the values in (edge k-1, edge k]
        value = F.coalesce(F.col(f), F.lit(0.0))
        return F.size(F.filter(F.array(*[F.lit(e) for e in edges[f]]), lambda e: e < value))

    binned = labelled.select(
        *[bin_of(f).alias(f) for f in features],
        F.col(bad).alias("_bad"),
        (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("_prune"),
    )
    cells = materialize(binned.groupBy(*features, "_bad", "_prune").agg(F.count(F.lit(1)).alias("_n")), "rules-cells")

    def test(c: tuple[str, bool, int]) -> Column:
        f, above, k = c
        return F.col(f) > k if above else F.col(f) <= k

    def all_of(conditions) -> Column:
        out = F.lit(True)
        for c in conditions:
            out = out & test(c)
        return out

    sums = lambda where: (
        F.coalesce(F.sum(F.when(F.col("_bad") & where, F.col("_n"))), F.lit(0)),
        F.coalesce(F.sum(F.when(~F.col("_bad") & where, F.col("_n"))), F.lit(0)),
    )
    laplace = lambda p, n: (p + 1) / (p + n + 2)
    taken: list[Rule] = []
    left = cells
    for _ in range(max_rules):
        conditions: list[tuple[str, bool, int]] = []
        grown = left.where(~F.col("_prune"))
        for _ in range(max_conditions):
            pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("k")) for f in features]))
            p, n = sums(F.lit(True))
            rows = (
                grown.where(all_of(conditions))
                .select(pairs.alias("_c"), "_bad", "_n")
                .groupBy("_c.f", "_c.k")
                .agg(p.alias("p"), n.alias("n"))
                .collect()
            )
            best = _best_condition(rows, features)
            if best is None:
                break
            conditions.append(best[0])
            if best[1] == 0:
                break
        if not conditions:
            break
        measures = []
        for k in range(1, len(conditions) + 1):
            for part, where in (("all", F.lit(True)), ("prune", F.col("_prune"))):
                p, n = sums(all_of(conditions[:k]) & where)
                measures += [p.alias(f"p_{part}_{k}"), n.alias(f"n_{part}_{k}")]
        got = left.agg(*measures).first()
        worth = [laplace(got[f"p_prune_{k}"], got[f"n_prune_{k}"]) for k in range(1, len(conditions) + 1)]
        size = len(conditions)
        while size > 1 and worth[size - 2] >= worth[size - 1]:
            size -= 1
        p, n = got[f"p_all_{size}"], got[f"n_all_{size}"]
        if laplace(p, n) < min_precision and size < len(conditions):
            size = len(conditions)
            p, n = got[f"p_all_{size}"], got[f"n_all_{size}"]
        if p < min_support or laplace(p, n) < min_precision:
            break
        kept = conditions[:size]
        taken.append(Rule(tuple(Condition(f, above, edges[f][k]) for f, above, k in kept), p, n))
        left = left.where(~all_of(kept))
    return DecisionList(tuple(taken))


def _best_condition(rows, features) -> tuple[tuple[str, bool, int], int] | None:
    """The condition of largest FOIL gain, and the good rows that it still covers."""
    import math

    table: dict[str, dict[int, tuple[int, int]]] = {f: {} for f in features}
    for r in rows:
        table[r["f"]][r["k"]] = (r["p"], r["n"])
    best, most = None, 1e-9
    for f in features:
        bins = sorted(table[f].items())
        all_p, all_n = sum(x[0] for _, x in bins), sum(x[1] for _, x in bins)
        if not all_p or not all_n:
            continue
        before = math.log2((all_p + 1) / (all_p + all_n + 2))
        p = n = 0
        for k, (dp, dn) in bins[:-1]:
            p, n = p + dp, n + dn
            for above, cp, cn in ((False, p, n), (True, all_p - p, all_n - n)):
                if cp:
                    gain = cp * (math.log2((cp + 1) / (cp + cn + 2)) - before)
                    if gain > most:
                        best, most = ((f, above, k), cn), gain
    return best


def label_statistics(statistics: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of the labelled documents, with ``bad`` = quality 0.

    An id that is labelled both ways teaches nothing; repeated labels count once.
    """
    own = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1))
    ends = own.groupBy("doc_id").agg(F.min("quality").alias("_least"), F.max("quality").alias("_most")).where("_least = _most")
    return statistics.join(ends.select("doc_id", (F.col("_least") == 0).alias("bad")), "doc_id")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: base counts, base verdict, first rule fired, verdict.

    Statistics are computed once over every whole text and written to the shared
    folder without the texts; the list is learned from those of labelled documents
    that pass the base rules, so that it adds to them.  Without labels the base
    rules alone decide.  Repeated ids are judged row by row.
    """
    statistics = materialize(text_statistics(docs), "rules-statistics")
    labelled = materialize(label_statistics(statistics.where(~base_failed()), labels), "rules-labelled")
    rules = learn_decision_list(labelled, **options)
    return statistics.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & rules.fired().isNull()).alias("kept"),
        rules.fired().alias("rule"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the base rules and the learned list keep, all columns.

    Rows and their statistics are written to the shared folder once, so that texts
    are neither judged twice nor shuffled: learning reads the statistics columns
    only, and the verdict is an expression over the row itself.  Columns may have any
    name; null and empty texts have no word and go; ids may be null or repeated, as each
    row is judged by its own text.  Without labels the base rules alone decide.
    """
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    judged = materialize(text_statistics(docs.withColumn("doc_id", whole)), "rules-judged")
    statistics = judged.withColumn("doc_id", F.col("doc_id.doc_id"))
    labelled = materialize(label_statistics(statistics.where(~base_failed()), labels), "rules-labelled")
    rules = learn_decision_list(labelled, **options)
    return judged.where(~base_failed() & rules.fired().isNull()).select("doc_id.*")

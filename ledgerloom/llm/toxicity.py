"""Toxicity: a weighted finite-state grammar over clauses, with learned lexemes and weights."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import held_out, known_labels, materialize, sampled_labels, small_parts

#: Letters run together; clauses end at the marks in the second group.
TOKEN = re.compile(r"([^\W\d_]+)|([.!?;:,\n\"“”«»„])")
QUOTES = frozenset('"“”«»„')

# Closed word classes that the grammar names, in the corpus's four languages.
TARGETS = frozenset("you your yours yourself u he she they him her his their du dich dir ihr euch tu te toi vous tú te usted ustedes vosotros".split())
NEGATIONS = frozenset("not no never isn aren wasn weren don doesn didn cannot nobody without nicht kein keine nie ne pas jamais sans nunca sin".split())
REPORTS = frozenset("said says say told called calls claimed quoted wrote reported sagte sagt schrieb dit disait écrit dijo dice escribió".split())
THREATS = frozenset(
    "kill hurt destroy beat punch shoot stab burn crush strangle "
    "töten töte umbringen schlagen verprügeln erschießen erstechen verbrennen erwürgen "
    "tuer tue frapper détruire poignarder brûler écraser étrangler "
    "matar mataré golpear destruir apuñalar quemar aplastar estrangular".split()
)

#: Least weight of a threat's word, and of an arc (its inverse is the most).
LEAST_THREAT, LEAST_FACTOR = 0.1, 0.1

#: Symbols between a hit and its target, and after a negation; words between a quotation and who said it.
REACH, NEGATED_REACH, REPORT_REACH = 4, 3, 3

#: What the machines read: words by class, and the ends of clauses and sentences.
WORD, INSULT, THREAT, TARGET, NEGATION, REPORT, CLAUSE, SENTENCE = SYMBOLS = range(8)
HITS = (INSULT, THREAT)
#: What the transducers write beside a hit; the last two stand after it.
AT_TARGET, NEGATED, REPORTED, REPEATED, TARGET_AFTER, REPORTED_AFTER = MARKS = (1, 2, 4, 8, 16, 32)
#: Matched patterns; each is a feature, and its weight in the score is learned.
PATTERNS = ("insult", "insult at a target", "threat", "threat at a target", "negated", "reported", "repeated")


@dataclass(frozen=True)
class Machine:
    """Deterministic weighted transducer: (state, symbol) to (state, marks of a hit), and
    the weight of that arc; arcs that aren't listed weigh 1."""

    states: int
    arcs: dict[tuple[int, int], tuple[int, int]]
    weights: dict[tuple[int, int], float] = field(default_factory=dict)

    def compose(self, other: Machine) -> Machine:
        """Both machines on the same symbols: a hit gets the marks of both, and the product
        of their arcs' weights."""
        arcs, weights = {}, {}
        for a in range(self.states):
            for b in range(other.states):
                for symbol in SYMBOLS:
                    to_a, marks_a = self.arcs[a, symbol]
                    to_b, marks_b = other.arcs[b, symbol]
                    at = a * other.states + b, symbol
                    arcs[at] = (to_a * other.states + to_b, marks_a | marks_b)
                    weight = self.weights.get((a, symbol), 1.0) * other.weights.get((b, symbol), 1.0)
                    if weight != 1.0:
                        weights[at] = weight
        return Machine(self.states * other.states, arcs, weights)

    def read(self, symbols: Sequence[int]) -> Iterator[tuple[int, float]]:
        """Marks and weight of each symbol's arc, in the order of reading."""
        state = 0
        for symbol in symbols:
            weight = self.weights.get((state, symbol), 1.0)
            state, marks = self.arcs[state, symbol]
            yield marks, weight


def transducer(states: int, step: Callable[[int, int], int], marks: Callable[[int], bool], mark: int, factor: float) -> Machine:
    """``step`` gives the next state; where ``marks`` holds, hits get the mark and factor."""
    arcs, weights = {}, {}
    for state in range(states):
        for symbol in SYMBOLS:
            hit = symbol in HITS and marks(state)
            arcs[state, symbol] = (step(state, symbol), mark if hit else 0)
            if hit and factor != 1.0:
                weights[state, symbol] = factor
    return Machine(states, arcs, weights)


def scope(opener: int, reach: int, mark: int, factor: float = 1.0) -> Machine:
    """For ``reach`` symbols of the clause beyond an opener, hits get ``mark``."""
    step = lambda left, s: reach if s == opener else 0 if s in (CLAUSE, SENTENCE) else max(0, left - 1)
    return transducer(reach + 1, step, bool, mark, factor)


def from_then_on(openers: tuple[int, ...], mark: int, factor: float = 1.0, ends: tuple[int, ...] = (SENTENCE,)) -> Machine:
    """From an opener to the end, hits get ``mark``."""
    return transducer(2, lambda on, s: int(s in openers or (on and s not in ends)), bool, mark, factor)


def beyond_clause(opener: int, reach: int, mark: int, factor: float = 1.0) -> Machine:
    """Beyond the clause of an opener that stands within ``reach`` words of its end, hits of
    the sentence get ``mark``.  States count the words that are left; the last is on."""
    on = reach + 1

    def step(state: int, symbol: int) -> int:
        if symbol == SENTENCE:
            return 0
        if state == on or (symbol == CLAUSE and state):
            return on
        return reach if symbol == opener else max(0, state - 1)

    return transducer(on + 1, step, lambda state: state == on, mark, factor)


def grammar(factors: Mapping[int, float] | None = None) -> tuple[Machine, Machine]:
    """Two compositions: one reads a text forwards and one backwards, so that what stands on
    either side of a hit is in the machines.  ``factors`` are the arcs' weights by mark."""
    w = lambda mark: (factors or {}).get(mark, 1.0)
    forwards = (
        from_then_on((REPORT,), REPORTED, w(REPORTED))
        .compose(scope(TARGET, REACH, AT_TARGET, w(AT_TARGET)))
        .compose(scope(NEGATION, NEGATED_REACH, NEGATED, w(NEGATED)))
        .compose(from_then_on(HITS, REPEATED, w(REPEATED), (CLAUSE, SENTENCE)))
    )
    backwards = scope(TARGET, REACH, TARGET_AFTER, w(TARGET_AFTER)).compose(
        beyond_clause(REPORT, REPORT_REACH, REPORTED_AFTER, w(REPORTED_AFTER))
    )
    return forwards, backwards


@dataclass(frozen=True)
class Hit:
    clause: int
    threat: bool
    marks: int
    weight: float

    def pattern(self) -> int:
        if self.marks & NEGATED:
            return 4
        if self.marks & (REPORTED | REPORTED_AFTER):
            return 5
        return 2 * self.threat + bool(self.marks & (AT_TARGET | TARGET_AFTER))


@dataclass
class ClauseScorer:
    """Matches the clauses of a text against the grammar.

    A clause ends at any mark.  A sentence ends at a full stop, question or exclamation
    mark outside a quotation, at a semicolon and at a line's end; reported speech goes on
    to the end of its sentence, and one that comes up to ``REPORT_REACH`` words after a
    clause reports that clause too.  A target counts on either side of a hit.  A hit weighs
    its word's weight times those of the arcs that read it, one way and the other.
    """

    lexemes: dict[str, float]
    threat_weight: float = 1.0
    threats: dict[str, float] = field(default_factory=dict)
    factors: dict[int, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.forwards, self.backwards = grammar(self.factors)
        self.symbols = {w: (REPORT, 0.0) for w in REPORTS}
        self.symbols |= {w: (NEGATION, 0.0) for w in NEGATIONS}
        self.symbols |= {w: (TARGET, 0.0) for w in TARGETS}
        self.symbols |= {w: (INSULT, x) for w, x in self.lexemes.items()}
        self.symbols |= {w: (THREAT, self.threats.get(w, self.threat_weight)) for w in THREATS}
        self.hits = frozenset(self.lexemes) | THREATS

    def read(self, text: str | None) -> tuple[list[int], list[tuple[int, int, float]], int]:
        """The text's symbols, the hits among them (place, clause, weight) and its words; no
        symbols and words if there is no hit."""
        lowered = (text or "").lower().replace("’", "'").replace("n't", " not")
        tokens = TOKEN.findall(lowered)
        if self.hits.isdisjoint(w for w, _ in tokens):
            return [], [], 0
        symbols: list[int] = []
        hits: list[tuple[int, int, float]] = []
        words = clause = 0
        quoted = False
        for word, mark in tokens:
            if mark:
                clause += 1
                if mark in QUOTES:
                    quoted = not quoted if mark == '"' else mark in "“«„"
                ends = mark in ";\n" or (mark in ".!?" and not quoted)
                quoted = quoted and mark != "\n"
                symbols.append(SENTENCE if ends else CLAUSE)
                continue
            words += 1
            symbol, weight = self.symbols.get(word, (WORD, 0.0))
            if symbol in HITS:
                hits.append((len(symbols), clause, weight))
            symbols.append(symbol)
        return symbols, hits, words

    def matches(self, text: str | None) -> tuple[list[Hit], int]:
        """Hits with their marks and weights, and the words of the text (0 if there is no hit)."""
        symbols, hits, words = self.read(text)
        if not hits:
            return [], 0
        before = list(self.forwards.read(symbols))
        after = list(self.backwards.read(symbols[::-1]))[::-1]
        found = []
        for at, clause, weight in hits:
            (left, x), (right, y) = before[at], after[at]
            found.append(Hit(clause, symbols[at] == THREAT, left | right, weight * x * y))
        return found, words

    def features(self, text: str | None) -> tuple[float, ...]:
        """ln(1 + summed weight) of each pattern, then of the best clause, of the number
        of clauses matched, and of the weight per hundred words; all 0 without a hit.

        Negated and reported hits are in their own patterns only.
        """
        found, words = self.matches(text)
        sums = [0.0] * len(PATTERNS)
        clauses: dict[int, float] = {}
        for hit in found:
            k = hit.pattern()
            sums[k] += hit.weight
            if k < 4:
                clauses[hit.clause] = clauses.get(hit.clause, 0.0) + hit.weight
                if hit.marks & REPEATED:
                    sums[6] += hit.weight
        total = sum(clauses.values())
        more = (max(clauses.values(), default=0.0), float(len(clauses)), 100 * total / max(words, 20))
        return tuple(math.log1p(x) for x in (*sums, *more))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, text, label of at most ``most`` labelled documents of each label.

    Ids are chosen by ``sampled_labels``, never held-out ones.  Of rows that share an id
    the text with the smallest hash is taken, so the bound holds for rows.
    """
    chosen = sampled_labels(known_labels(labels, label), most)
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = met.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return materialize(one.select("doc_id", "text", "label"), "sample-texts")


@dataclass(frozen=True)
class Lexemes:
    """Weights of insults and threats."""

    insults: dict[str, float]
    threats: dict[str, float]
    unseen_threat: float = 1.0


def learn_lexemes(sample: DataFrame, least_z: float = 3.3, most: int = 4_000, least_docs: int = 3) -> Lexemes:
    """Words that toxic documents of the sample have much oftener, with ln odds.

    A word needs ``least_docs`` toxic documents and a log odds ratio of ``least_z``
    standard errors; at most ``most`` words come back, highest z first.  The words of
    ``THREATS`` get their own ln odds, whatever their z, but ``LEAST_THREAT`` at least;
    those that the sample hardly has get the mean of the others.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_parts(batches, 0):
            out, bad = [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                distinct = {w for w, _ in TOKEN.findall((text or "").lower()) if len(w) > 2}
                out.extend(distinct)
                bad.extend([label] * len(distinct))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(bad, pa.int32())], names=["word", "label"])

    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexemes({}, {})
    counts = (
        sample.select("text", F.col("label").cast("int").alias("label"))
        .mapInArrow(words, "word string, label int")
        .groupBy("word")
        .agg(F.count_if(F.col("label") == 1).alias("t"), F.count_if(F.col("label") == 0).alias("c"))
        .where(F.col("t") >= least_docs)
    )
    odds = F.log((F.col("t") + 0.5) / F.lit(n_toxic + 1.0)) - F.log((F.col("c") + 0.5) / F.lit(n_clean + 1.0))
    spread = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    rated = counts.select("word", odds.alias("odds"), (odds / spread).alias("z"))
    rated = materialize(rated, "lexemes")
    known = F.col("word").isin(*sorted(THREATS))
    top = rated.where((F.col("z") >= least_z) & ~known).orderBy(F.desc("z"), "word").limit(most).collect()
    threats = {r["word"]: max(LEAST_THREAT, float(r["odds"])) for r in rated.where(known).collect()}
    unseen = sum(threats.values()) / len(threats) if threats else 1.0
    return Lexemes({r["word"]: float(r["odds"]) for r in top}, threats, unseen)


def learn_factors(sample: DataFrame, scorer: ClauseScorer) -> dict[int, float]:
    """The arcs' weights: how much likelier a hit with a mark is in a toxic document than
    one without, as a ratio of odds between ``LEAST_FACTOR`` and its inverse.

    Hits are counted by label and marks in the tasks; a few rows come back.
    """

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_parts(batches, 0):
            seen: Counter = Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.update((label, hit.marks) for hit in scorer.matches(text)[0])
            rows = [(label, m, n) for (label, m), n in seen.items()]
            kinds = (pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["label", "marks", "n"])

    told = sample.select("text", F.col("label").cast("int").alias("label")).mapInArrow(marks, "label int, marks int, n bigint")
    counts = [tuple(r) for r in told.groupBy("label", "marks").agg(F.sum("n")).collect()]
    factors = {}
    for mark in MARKS:
        number = lambda label, has, m=mark: 0.5 + sum(n for l, marks, n in counts if l == label and bool(marks & m) == has)  # noqa: E731, E741
        ratio = number(1, True) / number(0, True) / (number(1, False) / number(0, False))
        factors[mark] = min(1 / LEAST_FACTOR, max(LEAST_FACTOR, ratio))
    return factors


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Newton steps for logistic regression with an intercept (the last weight)."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty @ w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def clause_features(docs: DataFrame, scorer: ClauseScorer, *more: str) -> DataFrame:
    """Adds ``features`` array<double> to the columns ``more``; one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_parts(batches, 0):
            rows = [scorer.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(rows, pa.list_(pa.float64()))], names=[*more, "features"]
            )

    picked = docs.select("text", *more)
    kinds = ", ".join(f"{n} {t}" for n, t in picked.dtypes[1:])
    return picked.mapInArrow(run, f"{kinds}, features array<double>")


def fit_scorer(docs: DataFrame, labels: DataFrame, sample: int, label: str) -> tuple[ClauseScorer, np.ndarray] | None:
    """Scorer and weights (one a feature, then the intercept); null without both labels."""
    texts = labelled_sample(docs, labels, label, sample)
    words = learn_lexemes(texts)
    plain = ClauseScorer(words.insults, words.unseen_threat, words.threats)
    scorer = ClauseScorer(words.insults, words.unseen_threat, words.threats, learn_factors(texts, plain))
    got = clause_features(texts, scorer, "label").toArrow()
    y = got.column("label").to_numpy().astype(float)
    share = known_labels(labels, label).agg(F.avg("label").alias("p")).first()["p"]
    if not len(y) or y.min() == y.max():
        return None
    w = fit_logistic(np.array(got.column("features").to_pylist()), y)
    # back from the sample's share of toxic documents to that of all labelled ones
    w[-1] += math.log(share / (1 - share)) - math.log(y.mean() / (1 - y.mean()))
    return scorer, w


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = 8_000, label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Lexemes, the arcs' and the patterns' weights are learned from a bounded sample of
    documents that are not held out.  Scores come from matched clauses only.  Repeated rows get one row
    each.  Empty and null texts have no clause and get the score of a text without a
    match.  Without labels of both kinds all scores are 0.
    """
    ids = F.col("doc_id").cast("long").alias("doc_id")
    found = fit_scorer(docs, labels, sample, label)
    if found is None:
        plain = docs.select(ids).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.lit(0.0).alias("score"))
    else:
        scorer, w = found
        line = F.lit(float(w[-1]))
        for k in range(len(w) - 1):
            line = line + F.lit(float(w[k])) * F.get("features", F.lit(k))
        scored = clause_features(docs.select("text", ids), scorer, "doc_id")
        plain = scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), (1 / (1 + F.exp(-line))).alias("score"))
    return plain.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

"""URL filters: rules, and a character language-model ratio for the rest; native Spark only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import common
from ledgerloom.llm.common import head_threshold, let, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Context length of the Markov models; grams are one longer.
CONTEXT = 4
PAD = "\x02"
#: Bytes of one row of the gram table in a hash table.
GRAM_BYTES = 96


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The contract's rules, as (host, path, verdict).
RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty for null or without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null.

    A rule fits its host and all subdomains of it where the path starts with the
    rule's.  Equal lengths go to the alphabetically first.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        on_host = (host == F.lit(rule.host)) | F.endswith(host, F.lit("." + rule.host))
        fits = on_host & F.startswith(path, F.lit(rule.path))
        out = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def model_text(url: Column) -> Column:
    """What the models read: the URL in lower case, every digit as 0."""
    return F.translate(F.lower(F.coalesce(url, F.lit(""))), "123456789", "000000000")


def grams(text: Column, context: int = CONTEXT) -> Column:
    """One gram a character: the character after its ``context`` predecessors.

    Grams are cut from an array of the characters, so the work grows with the length.
    """
    places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
    characters = F.split(F.concat(F.lit(PAD * context), text), "")
    return let(characters, lambda c: F.transform(places, lambda i: F.array_join(F.slice(c, i, F.lit(context + 1)), "")))


def gram_ratios(
    counts: DataFrame, context: int = CONTEXT, strength: float = 4.0, alphabet: int = 128
) -> DataFrame:
    """(gram, ratio): ln of the accepted over the rejected model's probability.

    ``counts`` has every gram of every URL with ``yes`` and ``no``, its counts in
    accepted and rejected ones; grams of undecided URLs only have zeros and so get
    the probability that their longest observed suffix gives.  Order k blends its
    relative frequency with order k - 1 as ``(n + strength * p) / (n_context +
    strength)``; below order 0 lies the uniform law over ``alphabet`` characters.
    Tables hold distinct grams, not positions.
    """
    below: DataFrame | None = None
    for k in range(context + 1):
        gram = F.col("gram") if k == context else F.expr(f"right(gram, {k + 1})")
        level = counts.groupBy(gram.alias("gram")).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
        level = level.withColumn("before", F.substring("gram", 1, k))
        whole = level.groupBy("before").agg(F.sum("yes").alias("all_yes"), F.sum("no").alias("all_no"))
        level = level.join(whole, "before")
        if below is None:
            level = level.withColumn("q_yes", F.lit(1.0 / alphabet)).withColumn("q_no", F.lit(1.0 / alphabet))
        else:
            lower = below.select(F.col("gram").alias("suffix"), F.col("p_yes").alias("q_yes"), F.col("p_no").alias("q_no"))
            level = level.withColumn("suffix", F.expr(f"right(gram, {k})")).join(lower, "suffix")
        blend = lambda n, n_all, q: (F.col(n) + strength * F.col(q)) / (F.col(n_all) + strength)
        below = materialize(
            level.select(
                "gram", blend("yes", "all_yes", "q_yes").alias("p_yes"), blend("no", "all_no", "q_no").alias("p_no")
            ),
            "url-order",
        )
    return below.select("gram", (F.log("p_yes") - F.log("p_no")).alias("ratio"))


def calibrated_threshold(scores: DataFrame, steps: int = 200) -> float:
    """Score at which the share of accepted URLs below equals that of rejected ones above.

    Found among ``steps`` quantiles of each class, a bounded summary.  Without URLs
    of both classes: minus infinity if none is rejected, so that all are allowed,
    and plus infinity if none is accepted.
    """
    grid = [k / steps for k in range(steps + 1)]
    got = scores.agg(
        F.percentile_approx(F.when(F.col("label") == "allow", F.col("score")), grid, 10_000).alias("yes"),
        F.percentile_approx(F.when(F.col("label") == "block", F.col("score")), grid, 10_000).alias("no"),
    ).first()
    yes, no = got["yes"], got["no"]
    if not no:
        return float("-inf")
    if not yes:
        return float("inf")
    best, least = 0.0, float("inf")
    for t in sorted({*yes, *no}):
        missed = sum(x < t for x in yes) / len(yes)
        passed = sum(x >= t for x in no) / len(no)
        if abs(missed - passed) + missed + passed < least:
            best, least = t, abs(missed - passed) + missed + passed
    # in the middle of a gap between the classes, if there is one
    lower = max((x for x in no if x < best), default=best)
    return (best + lower) / 2


def with_ratios(each: DataFrame, ratios: DataFrame, uses: DataFrame) -> DataFrame:
    """(row, ratio) of every position, however many grams there are.

    A gram table within the broadcast bound meets the positions by broadcast.  Of a
    larger one only the head does, grams of at least so many uses (a power of two) that
    they fit; all others meet theirs in a shuffle join, where no key is hot.
    """
    n, most = ratios.count(), common.BROADCAST_BYTES // GRAM_BYTES
    if n <= most:
        return each.join(F.broadcast(ratios), "gram").select("row", "ratio")
    threshold = head_threshold(uses, most)
    known = ratios.join(uses, "gram")
    head = known.where(F.col("n_uses") >= threshold).select("gram", "ratio")
    met = each.join(F.broadcast(head), "gram", "left")
    tail = known.where(F.col("n_uses") < threshold).select("gram", F.col("ratio").alias("_rare"))
    rest = met.where("ratio is null").select("row", "gram").join(tail, "gram").select("row", F.col("_rare").alias("ratio"))
    return met.where("ratio is not null").select("row", "ratio").unionByName(rest)


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, context: int = CONTEXT) -> DataFrame:
    """One row per page: host, path, rule, verdict, and the model's score.

    URLs that a rule decides train the two models (accepted and rejected), but for a
    fifth of them, by hash, on which the threshold is calibrated; where that fifth lacks
    one of the classes, all decided URLs are.  The others get 'allow' if their mean log
    ratio per character reaches the threshold.  An empty or null URL scores 0.  Repeated
    ids are judged row by row, equal URLs alike; without decided URLs all others are
    allowed.  URLs are read whole, in time that grows with their length.  Only page_id and
    url are read, and an empty table gives no rows.  Positions are summed by gram before
    the shuffle.
    """
    host, path = split_url(F.col("url"))
    parts = pages.select("page_id", F.col("url").cast("string").alias("url")).select(
        "page_id", host.alias("host"), path.alias("path"), model_text(F.col("url")).alias("seen")
    )
    parts = parts.withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules))
    table = materialize(
        parts.select(
            F.monotonically_increasing_id().alias("row"),
            "page_id",
            "host",
            "path",
            "seen",
            F.col("_rule.rule").alias("rule"),
            F.col("_rule.verdict").alias("label"),
            (F.pmod(F.xxhash64("seen"), F.lit(5)) == 0).alias("spare"),
        ),
        "url-pages",
    )
    each = table.select("row", F.when(~F.col("spare"), F.col("label")).alias("label"), F.explode(grams(F.col("seen"), context)).alias("gram"))
    counts = materialize(
        each.groupBy("gram").agg(
            F.count_if(F.col("label") == "allow").alias("yes"),
            F.count_if(F.col("label") == "block").alias("no"),
            F.count(F.lit(1)).alias("n_uses"),
        ),
        "url-grams",
    )
    found = with_ratios(each.select("row", "gram"), gram_ratios(counts, context), counts.select("gram", "n_uses"))
    sums = found.groupBy("row").agg(F.avg("ratio").alias("score"))
    scored = materialize(
        table.drop("seen").join(sums, "row", "left").withColumn("score", F.coalesce("score", F.lit(0.0))), "url-scored"
    )
    decided = scored.where("label is not null")
    both = decided.where("spare").agg(F.count_distinct("label").alias("n")).first()["n"] == 2
    threshold = calibrated_threshold(decided.where("spare") if both else decided)
    verdict = F.when(F.col("score") >= F.lit(threshold), F.lit("allow")).otherwise(F.lit("block"))
    return scored.select(
        "page_id", "host", "path", "rule", F.coalesce("label", verdict).alias("verdict"), "score"
    )

"""Corpus operators against brute force on small fixtures, edge cases included."""

import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import (
    bradley_terry,
    decision_list,
    graph,
    group_join,
    mixing,
    packing,
    queries,
    sharding,
    stream_dedup,
    token_counts,
    tokenizing,
    toxicity,
    url_lm,
)
from tests.compare import assert_same
from tests.conftest import SMALL

import xxhash

from ledgerloom.llm import common


def spark_hash(*values):
    """Spark's xxhash64 of strings, int (as a tuple of one) and long values."""
    h = 42
    for v in values:
        if v is None:
            continue
        raw = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
        h = xxhash.xxh64_intdigest(raw, seed=h)
    return h


WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = re.compile(r"[\x20\x09-\x0D]")


def test_oracles(spark, duck):
    for name, sql in queries.ORACLES.items():
        assert_same(queries.QUERIES[name](spark, SMALL), duck, sql)


# -- sharding ---------------------------------------------------------------


def test_shards_are_dense_and_grow_into_the_new_one(messy):
    rows = sharding.shard_documents(messy).collect()
    assert len(rows) == messy.count()
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 8) for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert (by[3]["size"], by[3]["text_crc32"]) == (1, 0)
    text = "ÜBER straße naïve <|endoftext|> 日本語 \x1c \u00a0 end".encode()
    assert (by[8]["size"], by[8]["text_crc32"]) == (len(text) + 1, zlib.crc32(text))


def test_clocks_by_hand(messy):
    def ring(doc_id, shards):
        key = "\x00null" if doc_id is None else str(doc_id)
        clocks = [(-math.log(((spark_hash(key, (17,), (j,)) >> 11) + 0.5) / 2**53), j) for j in range(shards)]
        return min(clocks)[1]

    for r in sharding.shard_documents(messy).collect():
        assert (r["shard"], r["grown_shard"]) == (ring(r["doc_id"], 8), ring(r["doc_id"], 9))


def test_equal_rows_are_numbered_in_many_tasks(spark):
    df = spark.range(100_000).select(F.lit(None).cast("long").alias("k"), F.lit("g").alias("g"), F.col("id").alias("_row"))
    numbered = common.dense_number(df, ["g"], ["k", "_row"], "slot", 100_000)
    got = numbered.agg(F.min("slot"), F.max("slot"), F.count_distinct("slot")).first()
    assert tuple(got) == (0, 99_999, 100_000)
    buckets = df.groupBy(F.pmod(F.xxhash64("k", "_row"), F.lit(20)).alias("b")).count().collect()
    assert len(buckets) == 20 and max(r["count"] for r in buckets) < 6_000


def test_few_rows_move_and_weights_count(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    both = df.select(sharding.rendezvous_shard(F.col("k"), [1, 1, 2]).alias("a"), sharding.rendezvous_shard(F.col("k"), [1, 1, 2, 1]).alias("b"))
    share = {r["a"]: r["count"] / 20_000 for r in both.groupBy("a").count().collect()}
    assert abs(share[2] - 0.5) < 0.02 and abs(share[0] - 0.25) < 0.02
    moved = both.where("a <> b")
    assert moved.where("b <> 3").isEmpty()
    assert abs(moved.count() / 20_000 - 0.2) < 0.02


def test_empty_tables(nothing, no_labels):
    assert sharding.shard_documents(nothing).count() == 0
    assert mixing.mix_documents(nothing).count() == 0
    assert mixing.sample_to_weights(nothing).columns == nothing.columns
    assert decision_list.judge_documents(nothing, no_labels).count() == 0
    assert decision_list.keep_good(nothing, no_labels).count() == 0
    assert stream_dedup.dedup_report(nothing).count() == 0
    assert stream_dedup.drop_copies(nothing).count() == 0
    assert url_lm.judge_urls(nothing.sparkSession.createDataFrame([], "page_id long, url string")).count() == 0
    assert group_join.near_duplicates(nothing).count() == 0
    assert packing.pack_documents(nothing).count() == 0
    assert token_counts.count_tokens(nothing).count() == 0
    assert toxicity.score_documents(nothing, no_labels).count() == 0
    assert bradley_terry.score_quality(nothing, no_labels).count() == 0


# -- mixing -----------------------------------------------------------------


@pytest.mark.parametrize("literal", [1_000, 1])
def test_raking_meets_its_marginals(spark, monkeypatch, literal):
    monkeypatch.setattr("ledgerloom.llm.mixing.LITERAL_ROWS", literal)
    cells = spark.createDataFrame([(s, l, 10 * (i + 1)) for i, (s, l) in enumerate((s, l) for s in "ab" for l in "xyz")], "s string, l string, tokens long")
    targets = {"s": spark.createDataFrame([("a", 0.7), ("b", 0.3)], "s string, share double"),
               "l": spark.createDataFrame([("x", 0.2), ("y", 0.3), ("z", 0.5)], "l string, share double")}
    out = mixing.rake(cells, targets, tolerance=1e-6, max_sweeps=30)
    for d, t in targets.items():
        got = {r[0]: r[1] for r in out.groupBy(d).agg(F.sum("weight")).collect()}
        for r in t.collect():
            assert abs(got[r[0]] - r["share"]) < 1e-4


def test_kept_share_of_tokens(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = mixing.mix_documents(docs, keep_share=0.6).collect()
    tokens = sum(r["n_tokens"] for r in rows)
    assert abs(sum(r["probability"] * r["n_tokens"] for r in rows) / tokens - 0.6) < 0.01
    assert max(r["probability"] for r in rows) <= 1


def kept_shares(rows, d):
    kept = defaultdict(float)
    for r in rows:
        kept[r[d]] += r["probability"] * r["n_tokens"]
    return {v: x / sum(kept.values()) for v, x in kept.items()}


def test_kept_tokens_meet_the_targets(spark):
    """One source has a third of the tokens, 100 share the rest."""
    text = " ".join("w" * 10)
    rows = [(i, text, "en" if i >= 300 else "de", "big" if i % 3 == 0 else f"s{i % 100}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix_documents(docs, keep_share=0.8).collect()
    kept = sum(r["probability"] * r["n_tokens"] for r in got)
    assert abs(kept / 12_000 - 0.8) < 0.005
    cells = docs.select("source", "lang", F.lit("other").alias("topic")).groupBy("source", "lang", "topic").agg((10 * F.count("source")).alias("tokens"))
    power, _ = mixing.attainable_weights(cells, 0.7, 0.8)
    assert 0.7 < power < 1
    for d in ("source", "lang"):
        want = {r[0]: r["share"] for r in mixing.tempered_targets(cells, d, power).collect()}
        found = kept_shares(got, d)
        assert all(abs(found[v] / w - 1) < 0.01 for v, w in want.items())
    given = {
        "source": mixing.tempered_targets(cells, "source", 0.7),
        "lang": spark.createDataFrame([("en", 0.5), ("de", 0.5)], "lang string, share double"),
        "topic": spark.createDataFrame([("other", 1.0)], "topic string, share double"),
    }
    got = mixing.mix_documents(docs, targets=given, keep_share=0.8).collect()
    for d in ("source", "lang"):
        found = kept_shares(got, d)
        assert all(abs(found[r[0]] / r["share"] - 1) < 0.01 for r in given[d].collect())


def test_mixture_rows_and_sample_agree(messy):
    rows = mixing.mix_documents(messy).collect()
    assert len(rows) == messy.count()
    assert all(0 < r["probability"] <= 1 + 1e-12 for r in rows)
    left = mixing.sample_to_weights(messy)
    assert left.columns == messy.columns
    assert Counter(r["doc_id"] for r in left.collect()) == Counter(r["doc_id"] for r in rows if r["sampled"])


def test_mixture_by_hand(spark):
    """Topics, raking and draw over a whole table in plain Python."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    bins = {}
    for r in docs:
        lowered = r["text"].translate(str.maketrans(mixing.UPPER, mixing.LOWER))
        bins[r["doc_id"]] = {(lambda h: (h - 2**64 if h >= 2**63 else h) % mixing.TOPIC_BINS)(spark_hash(w)) for w in WORD.findall(lowered) if len(w) >= 4}
    df = Counter(b for v in bins.values() for b in v)
    top = sorted((b for b in df if df[b] <= 0.2 * len(docs)), key=lambda b: (-df[b], b))[: mixing.TOPIC_WORDS]
    lang = {r["doc_id"]: r["lang"] for r in docs}

    def like(a, b):
        """Documents with both words beyond those that chance gives within each language."""
        both = expected = 0
        for l in sorted(set(lang.values())):
            own = [v for i, v in bins.items() if lang[i] == l]
            both += sum(a in v and b in v for v in own)
            expected += sum(a in v for v in own) * sum(b in v for v in own) / len(own)
        return round((both - expected) / math.sqrt(df[a] * df[b]), 9)

    pairs = {(a, b): like(a, b) for k, a in enumerate(top) for b in top[k + 1 :]}
    groups = [[b] for b in top]
    while len(groups) > 8:
        mean = lambda x, y: round(sum(pairs.get((a, b), pairs.get((b, a))) for a in x for b in y) / (len(x) * len(y)), 9)
        _, i, j = min((-mean(x, y), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j)
        groups[i] = groups[i] + groups.pop(j)
    topic = {}
    for i, v in bins.items():
        scores = [(sum(math.log(len(docs) / df[b]) for b in sorted(g, key=top.index) if b in v), -t) for t, g in enumerate(groups)]
        score, turn = max((round(x, 9), t) for x, t in scores)
        topic[i] = f"topic-{groups[-turn][0]}" if score > 0 else "other"
    assert len(set(topic.values())) > 5
    cells = Counter()
    for r in docs:
        cells[r["source"], r["lang"], topic[r["doc_id"]]] += max(1, len(WORD.findall(r["text"])))
    targets = []
    for d in range(3):
        mass = Counter()
        for c, n in cells.items():
            mass[c[d]] += n
        mass = {v: m**0.7 for v, m in mass.items()}
        targets.append({v: m / sum(mass.values()) for v, m in mass.items()})
    whole = sum(cells.values())
    factors = [dict.fromkeys(t, 1.0) for t in targets]
    weight = lambda c: cells[c] / whole * factors[0][c[0]] * factors[1][c[1]] * factors[2][c[2]]
    for _ in range(15):
        was = [dict(f) for f in factors]
        for d in range(3):
            sums = Counter()
            for c in cells:
                sums[c[d]] += weight(c) / factors[d][c[d]]
            factors[d] = {v: targets[d][v] / sums[v] for v in sums}
        if max(abs(f[v] - x) / f[v] for f, w in zip(factors, was, strict=True) for v, x in w.items()) <= 1e-3:
            break
    top_rate = max(weight(c) / cells[c] for c in cells)
    for r in mixing.mix_documents(spark.read.parquet(f"{SMALL}/documents.parquet")).collect():
        c = (r["source"], r["lang"], topic[r["doc_id"]])
        assert r["topic"] == c[2]
        assert math.isclose(r["probability"], weight(c) / cells[c] / top_rate, rel_tol=1e-6)
        text = next(x["text"] for x in docs if x["doc_id"] == r["doc_id"])
        draw = (spark_hash((23,), r["doc_id"], text) >> 11) / 2**53
        assert r["sampled"] == (draw < r["probability"])


def test_words_that_meet_are_one_topic(spark):
    """Three topics in two languages; words of one language don't meet for that alone."""
    import random

    rnd = random.Random(2)
    subjects = {t: [f"{t}word{k}" for k in range(8)] for t in ("sea", "oven", "code")}
    rows = []
    for i in range(1_500):
        lang, subject = rnd.choice(["en", "de"]), rnd.choice(list(subjects))
        words = [f"{lang}{rnd.randint(0, 400)}x" for _ in range(30)] + [f"{lang}-{w}" for w in rnd.sample(subjects[subject], 3)]
        rows.append((i, " ".join(rnd.sample(words, len(words))), lang, "s", subject))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, subject string")
    told = {r["doc_id"]: r["topic"] for r in mixing.mix_documents(docs, topics=6).collect()}
    seen = defaultdict(Counter)
    for i, _, lang, _, subject in rows:
        seen[told[i]][lang, subject] += 1
    pure = sum(c.most_common(1)[0][1] for c in seen.values())
    assert len(seen) == 6 and pure / len(rows) > 0.9, seen


def test_unfinished_raking_says_so(spark):
    cells = spark.createDataFrame([("a", "x", 9), ("a", "y", 1), ("b", "y", 5)], "s string, l string, tokens long")
    targets = {"s": spark.createDataFrame([("a", 0.5), ("b", 0.5)], "s string, share double"),
               "l": spark.createDataFrame([("x", 0.9), ("y", 0.1)], "l string, share double")}
    assert not mixing.rake(cells, targets, max_sweeps=2).first()["converged"]


# -- quality rules ----------------------------------------------------------


def base_counts(text):
    words = WORD.findall(text or "")
    seen, repeated_lines = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            repeated_lines += line in seen
            seen.add(line)
    places = defaultdict(list)
    for i in range(len(words) - 7):
        places[tuple(words[i : i + 8])].append(i)
    covered = {j for v in places.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, repeated_lines, len(covered)


def test_base_counts_of_whole_texts(spark, messy, no_labels):
    for docs in (messy.select("doc_id", "text"), spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")):
        want = Counter((r["doc_id"], *base_counts(r["text"])) for r in docs.collect())
        got = decision_list.judge_documents(docs, no_labels).collect()
        assert want == Counter(tuple(r)[:6] for r in got)
        for r in got:
            failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
            assert r["base_failed"] == failed and r["kept"] == (not failed)


def test_list_learns_a_conjunction(spark):
    rows = [(i, i % 10 / 10, i % 7 / 7, i % 10 >= 7 and i % 7 >= 4) for i in range(2_000)]
    df = spark.createDataFrame(rows, "doc_id long, a double, b double, bad boolean")
    rules = decision_list.learn_decision_list(df, features=("a", "b"))
    wrong = df.where(rules.fired().isNotNull() != F.col("bad")).count()
    assert rules.rules and wrong == 0


def python_ratios(text):
    words = WORD.findall(text or "")
    n, chars, symbols, dup, covered = base_counts(text)
    text = text or ""
    w, c = max(n, 1), max(chars, 1)
    return {
        "words": float(n), "mean_word": chars / w, "symbol_ratio": symbols / w, "bang_ratio": text.count("!") / w,
        "capital_ratio": sum("A" <= x <= "Z" for x in text) / c, "pipe_ratio": text.count("|") / w,
        "dup_line_ratio": dup / (text.count("\n") + 1), "repeat_ratio": covered / w, "distinct_ratio": len(set(words)) / w,
    }


def test_learned_list_applied_by_hand(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    stats = decision_list.text_statistics(docs)
    rules = decision_list.learn_decision_list(decision_list.label_statistics(stats.where(~decision_list.base_failed()), labels)).rules
    want = {}
    for r in docs.collect():
        x, base = python_ratios(r["text"]), base_counts(r["text"])
        fired = next((k for k, rule in enumerate(rules, 1) if all((x[c.feature] > c.threshold) == c.above for c in rule.conditions)), None)
        want[r["doc_id"]] = (fired, base[0] >= 20 and 100 * base[4] <= 30 * base[0] and fired is None)
    got = {r["doc_id"]: (r["rule"], r["kept"]) for r in decision_list.judge_documents(docs, labels).collect()}
    assert rules and got == want


def test_odd_labels_and_columns(messy, odd_labels):
    left = decision_list.keep_good(messy, odd_labels)
    assert left.columns == messy.columns
    assert decision_list.judge_documents(messy, odd_labels).count() == messy.count()
    known = {tuple(r) for r in common.known_labels(odd_labels, "toxic").collect()}
    assert known <= {(1, 0), (6, 1), (99, 0)} and all(zlib.crc32(str(i).encode()) % 5 for i, _ in known)
    for rows in (toxicity.score_documents(messy, odd_labels), bradley_terry.score_quality(messy, odd_labels)):
        assert Counter(r["doc_id"] for r in rows.collect()) == Counter(r["doc_id"] for r in messy.collect())


def test_list_keeps_all_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    kept = {r[0] for r in decision_list.keep_good(docs, labels).select("doc_id").collect()}
    verdicts = decision_list.judge_documents(docs, labels).where("kept").collect()
    assert kept == {r["doc_id"] for r in verdicts}
    assert decision_list.keep_good(docs, labels).columns == docs.columns


# -- exact dedup ------------------------------------------------------------


def expected_groups(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[SPACE.sub("", r["text"] or "")].append(r)
    out = Counter()
    for members in groups.values():
        order = sorted(members, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))
        for k, r in enumerate(order):
            out[r["doc_id"], order[0]["doc_id"], len(members), k == 0] += 1
    return out


def test_dedup_of_messy_rows(messy):
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in stream_dedup.dedup_report(messy).collect())
    assert got == expected_groups(messy.collect())


def test_bytes_are_checked_on_hits(spark):
    """A digest of one bit collides all the time; whole texts still decide."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60).repartition(4)
    weak = lambda norm: F.pmod(F.crc32(norm.cast("binary")), F.lit(2)).cast("string")
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in stream_dedup.exact_groups(docs, weak).collect())
    assert got == expected_groups(docs.collect())


def test_state_meets_later_waves_and_runs(spark, tmp_path):
    """State of one run goes on in the next; bytes are checked against the first content."""
    folder = "file://" + str(tmp_path / "stream")
    weak = lambda norm: F.substring(norm, 1, 1)

    def rows(*pairs):
        return stream_dedup.content_rows(spark.createDataFrame(list(pairs), "doc_id long, text string").repartition(4), weak)

    stream_dedup.ExactDedupStream(spark, folder).observe(rows((1, "a b"), (2, "c")), waves=2)
    again = stream_dedup.ExactDedupStream(spark, folder)
    again.observe(rows((3, "ab"), (4, "a  b"), (5, "ax")))
    assert {(r["digest"], r["n"]) for r in again.groups().collect()} == {("a", 4), ("c", 1)}
    assert {r["other"] for r in again.differing().collect()} == {"ax"}
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in stream_dedup._placed(again).collect()}
    assert got == {(1, 4, 3, False), (3, 4, 3, False), (4, 4, 3, True), (2, 2, 1, True), (5, 5, 1, True)}
    locator = {r["digest"]: r["content"]["wave"] for r in again.groups().collect()}
    assert locator["a"] in (0, 1)


def test_repeated_rows_leave_the_defined_one(spark):
    docs = spark.createDataFrame([(1, "a b", t) for t in "pqr"] + [(1, "other", "s"), (None, "ab", "z")], "doc_id long, text string, _row string").repartition(3)
    least = docs.where("_row in ('p', 'q', 'r')").orderBy(F.xxhash64(*docs.columns)).first()["_row"]
    for _ in range(2):
        assert {(r["text"], r["_row"]) for r in stream_dedup.drop_copies(docs.repartition(2)).collect()} == {("a b", least), ("other", "s")}


def test_drop_copies_keeps_one_of_each(messy):
    left = stream_dedup.drop_copies(messy)
    assert left.columns == messy.columns
    texts = [SPACE.sub("", r["text"] or "") for r in left.collect()]
    assert len(texts) == len(set(texts)) == len({SPACE.sub("", r["text"] or "") for r in messy.collect()})


# -- URL filters ------------------------------------------------------------


def test_url_rules(spark):
    urls = ["http://a.example.com/x", "https://example.com/en/1", "https://m.example.com/en/", "HTTP://WWW.example.com/en/9?q#f", "http://www.example.com/EN/",
            "http://b.net/es/1", "http://b.net/fr/", "http://b.net/en/", "nothing", None, "x://", "http://com", "http://com/", "http://Example.COM/en/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_lm.judge_urls(df).collect()}
    assert [got[i]["rule"] for i in range(len(urls))] == [
        "com/", "example.com/en/", "example.com/en/", "www.example.com/en/", "com/", "net/es/", "net/fr/", None, None, None, None, None, "com/", "example.com/en/"
    ]
    assert (got[3]["host"], got[3]["path"]) == ("www.example.com", "/en/9")
    assert (got[8]["host"], got[8]["path"]) == ("", "")
    assert got[0]["verdict"] == "allow" and got[1]["verdict"] == "block"
    assert {r["verdict"] for r in got.values()} <= {"allow", "block"}


def test_gram_ratios_against_plain_python(spark):
    import math

    yes, no, context = ["abab", "abac"], ["bbbb", "bbba"], 2
    count = defaultdict(lambda: [0, 0])
    for which, texts in enumerate((yes, no)):
        for t in texts:
            p = url_lm.PAD * context + t
            for i in range(len(t)):
                count[p[i : i + context + 1]][which] += 1
    df = spark.createDataFrame([(g, a, b) for g, (a, b) in count.items()], "gram string, yes long, no long")
    got = {r["gram"]: r["ratio"] for r in url_lm.gram_ratios(df, context, 4.0, 128).collect()}

    def p(gram, which, k):
        if k < 0:
            return 1 / 128
        tail = gram[context - k :]
        n = sum(v[which] for g, v in count.items() if g.endswith(tail))
        whole = sum(v[which] for g, v in count.items() if g[context - k : context] == tail[:-1])
        return (n + 4 * p(gram, which, k - 1)) / (whole + 4)

    for g in count:
        assert abs(got[g] - (math.log(p(g, 0, context)) - math.log(p(g, 1, context)))) < 1e-9


def test_verdicts_by_hand(spark, monkeypatch):
    """Models, scores, threshold and verdicts over all pages; also beyond the broadcast bound."""
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url")
    pages = pages.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "nothing")], "page_id long, url string")).cache()
    got = {r["page_id"]: r for r in url_lm.judge_urls(pages).collect()}
    k = url_lm.CONTEXT
    seen = {i: re.sub("[0-9]", "0", (r["url"] or "").lower()) for i, r in ((r["page_id"], r) for r in pages.collect())}
    grams = {i: [(url_lm.PAD * k + t)[j : j + k + 1] for j in range(len(t))] for i, t in seen.items()}
    label = {i: r["verdict"] for i, r in got.items() if r["rule"] is not None}
    spare = {i for i, t in seen.items() if (lambda h: (h - 2**64 if h >= 2**63 else h) % 5)(spark_hash(t)) == 0}
    tables = {}
    for verdict in ("allow", "block"):
        full, before = defaultdict(int), defaultdict(int)
        for i, gs in grams.items():
            if label.get(i) == verdict and i not in spare:
                for g in gs:
                    for n in range(k + 1):
                        full[g[k - n :]] += 1
                        before[n, g[k - n : k]] += 1
        tables[verdict] = full, before

    def p(verdict, gram, n):
        if n < 0:
            return 1 / 128
        full, before = tables[verdict]
        return (full[gram[k - n :]] + 4 * p(verdict, gram, n - 1)) / (before[n, gram[k - n : k]] + 4)

    score = {i: sum(math.log(p("allow", g, k)) - math.log(p("block", g, k)) for g in gs) / len(gs) if gs else 0.0 for i, gs in grams.items()}
    for i, r in got.items():
        assert math.isclose(r["score"], score[i], rel_tol=1e-6, abs_tol=1e-9)
    own = spark.createDataFrame([(score[i], label[i]) for i in label if i in spare], "score double, label string")
    cut = url_lm.calibrated_threshold(own)
    assert {i: r["verdict"] for i, r in got.items()} == {i: label.get(i, "allow" if score[i] >= cut else "block") for i in got}
    monkeypatch.setattr("ledgerloom.llm.common.BROADCAST_BYTES", 96 * 40)
    again = {r["page_id"]: r for r in url_lm.judge_urls(pages).collect()}
    assert all(math.isclose(again[i]["score"], r["score"], abs_tol=1e-9) and again[i]["verdict"] == r["verdict"] for i, r in got.items())


def test_long_repeated_and_odd_urls(spark, monkeypatch):
    """1 MB of URL in time that grows with its length; repeated rows and clashing names."""
    import time

    data = "data://" + "".join(chr(97 + i * i % 23) for i in range(1_000_000))
    rows = [(1, data), (2, "http://a.com/x"), (2, "http://a.com/x"), (None, None), (3, "http://b.net/es/1"), (4, "x://" + "ü€𝄞" * 3)]
    extra = "gram string, score double, row int, seen string, label string, spare int, ratio int"
    pages = spark.createDataFrame([(*r, "g", 1.0, 1, "s", "l", 1, 1) for r in rows], "page_id long, url string, " + extra)
    took = {}
    for n in (125_000, 1_000_000):
        began = time.time()
        cut = spark.createDataFrame([(data[:n],)], "t string").select(F.explode(url_lm.grams(F.col("t"))).alias("g"))
        assert cut.agg(F.count("g")).first()[0] == n
        took[n] = time.time() - began
    assert took[1_000_000] < 20 + 16 * took[125_000]
    got = url_lm.judge_urls(pages).collect()
    assert len(got) == len(rows)
    twice = [r for r in got if r["page_id"] == 2]
    assert twice[0] == twice[1] and twice[0]["verdict"] == "allow"
    text = "ü€𝄞ab"
    cut = spark.createDataFrame([(text,)], "t string").select(url_lm.grams(F.col("t"), 2)).first()[0]
    assert cut == [(url_lm.PAD * 2 + text)[i : i + 3] for i in range(5)]


# -- n-gram Jaccard join ----------------------------------------------------


def brute_components(rows, k, percent):
    sets = []
    for r in rows:
        w = (r["text"] or "").encode().lower().split()
        sets.append(frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if o and 100 * o >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[root(i)] = min(least.get(root(i), r["doc_id"]), r["doc_id"])
    return Counter((r["doc_id"], len(sets[i]), least.get(root(i))) for i, r in enumerate(rows))


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_components_match_brute_force(spark, messy, k, percent):
    base = " ".join(f"w{i}" for i in range(60)).split()
    edited = []
    for i in range(40):
        w = list(base)
        for j in range(i % 5):
            w[(7 * i + 11 * j) % 60] = f"e{i}-{j}"
        edited.append((100 + i, " ".join(w)))
    docs = messy.select("doc_id", "text").unionByName(spark.createDataFrame(edited, "doc_id long, text string")).cache()
    got = Counter(tuple(r) for r in group_join.near_duplicates(docs, k, percent).collect())
    assert got == brute_components(docs.collect(), k, percent)


def test_shuffled_paths_find_the_same(spark, messy, monkeypatch):
    """Beyond the broadcast bound every small side is shuffled, with equal results."""
    monkeypatch.setattr("ledgerloom.llm.common.BROADCAST_BYTES", 0)
    docs = messy.select("doc_id", "text")
    got = Counter(tuple(r) for r in group_join.near_duplicates(docs, 4, 85).collect())
    assert got == brute_components(docs.collect(), 4, 85)


def test_chains_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(links, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100}


def test_one_near_copy_stays(messy):
    left = group_join.drop_near_duplicates(messy, 2, 50)
    assert left.columns == messy.columns
    ids = {r["doc_id"] for r in left.collect()}
    assert {1, 3, 4, 5, 6, 9} <= ids and not {2, 10, 7} & ids


def test_rows_go_by_row_not_by_id(spark):
    """Null and repeated ids: distinct texts stay, near copies leave one row."""
    near, other = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [
        (1, near, "x"),
        (None, near + " z", "x"),
        (None, other, "x"),
        (None, other + " z", "x"),
        (None, "u v w x y", "x"),
        (2, near + " y", "x"),
        (2, "only one of its kind", "x"),
        (3, "twice the same row here", "q"),
        (3, "twice the same row here", "p"),
        (None, "", "x"),
        (None, None, "x"),
        (None, "", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag string").repartition(3)
    left = Counter((r["doc_id"], r["text"]) for r in group_join.drop_near_duplicates(docs, 2, 75).collect())
    one = [t for i, t in left if i is None and t in (other, other + " z")]
    assert len(one) == 1
    assert left == Counter([(1, near), (None, one[0]), (None, "u v w x y"), (2, "only one of its kind"), (3, "twice the same row here"), (None, ""), (None, ""), (None, None)])


# -- packing and counting ---------------------------------------------------


def library_ids(rows):
    tok = tokenizing.library(tokenizing.default_vocabulary())
    return [tok.encode(r["text"] or "", add_special_tokens=False).ids for r in rows]


def test_units_give_the_library_ids():
    encoder = tokenizing.IdEncoder(tokenizing.default_vocabulary())
    tok = tokenizing.library(tokenizing.default_vocabulary())
    texts = ["", " ", "a", " a", "a ", "a  b", "it's  we'll\n\n x", "x\ty \n z", "\x00 a", "<|endoftext|>", "a<|endoftext|> b", "é\u0301 日本 \u2003 x", "1 234 5\r\n", "\x1c a", "a \x85 b"]
    for t, got in zip(texts, encoder.encode(texts), strict=True):
        ids = tok.encode(t, add_special_tokens=False).ids
        assert got == b"".join(i.to_bytes(4, "little") for i in ids), repr(t)
    assert tokenizing.special_strings(tokenizing.default_vocabulary()) == ("<|endoftext|>",)


def test_ids_and_counts_of_all_texts():
    """Every whole text of sf0.01: ids from units and pre-tokens' sums against the library."""
    import pyarrow.parquet as pq

    vocabulary = tokenizing.default_vocabulary()
    tok, encoder, cutter = tokenizing.library(vocabulary), tokenizing.IdEncoder(vocabulary), token_counts.PreTokenizer(vocabulary)
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()
    pieces = {}
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        for t, got, want in zip(part, encoder.encode(part), tok.encode_batch(part, add_special_tokens=False), strict=True):
            assert got == struct.pack(f"<{len(want.ids)}I", *want.ids)
            counts, specials = cutter.frequencies(t)
            for x in counts:
                if x not in pieces:
                    pieces[x] = len(tok.encode(x, add_special_tokens=False).ids)
            assert specials + sum(pieces[x] * n for x, n in counts.items()) == len(want.ids)


def test_packing_of_messy_rows(messy):
    source = messy.select("doc_id", "text").collect()
    want = Counter()
    for r, ids in zip(source, library_ids(source), strict=True):
        ids = [*ids, 2]
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        at, k = 0, 0
        while at < len(ids):
            size = first if k == 0 else 1024
            piece = b"".join(i.to_bytes(4, "little") for i in ids[at : at + size])
            want[r["doc_id"], k, at, size, zlib.crc32(piece)] += 1
            at, k = at + size, k + 1
    rows = packing.pack_documents(messy).collect()
    assert want == Counter(tuple(r)[:5] for r in rows)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= -(-sum(r["length"] for r in rows) // 1024) + 1


def test_fullest_is_optimal():
    import itertools
    import random

    random.seed(4)
    for _ in range(60):
        pieces = [random.randint(1, 40) for _ in range(9)]
        counts = dict(Counter(pieces))
        got = packing.fullest(counts, 50)
        best = max(
            sum(c) for n in range(1, 10) for c in itertools.combinations(pieces, n) if max(pieces) in c and sum(c) <= 50
        )
        assert sum(a * b for a, b in got) == best
        assert all(b <= counts[a] for a, b in got)
        used = Counter()
        for p in packing.minimum_bin_slack(counts, 50):
            for size, many in p.items:
                used[size] += many * p.times
        assert used == Counter(pieces)


@pytest.mark.parametrize("head", [0, 3, 200_000])
def test_counts_equal_the_library(messy, head):
    source = messy.select("doc_id", "text").collect()
    want = Counter(
        (r["doc_id"], len((r["text"] or "").encode()), len(ids), len(ids) > 512)
        for r, ids in zip(source, library_ids(source), strict=True)
    )
    assert want == Counter(tuple(r) for r in token_counts.count_tokens(messy, head_rows=head).collect())


def test_odd_and_very_long_texts_give_the_library_ids():
    import random

    rnd = random.Random(1)
    parts = [*"abcXYZ  \t\n\r\x0b\x0c\x1c\x00\u00a0\u2003\u200b'\u2019.,!?019é", "日本", "한", "🙂", "\u0301", "ﬀ", "'s", "'LL", " the", "  ", "\r\n", "<|endoftext|>", "٣", "Ⅷ"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 60))) for _ in range(5_000)]
    texts += [" " * 300_000, "a" * 100_000, "\n" * 300_000, "^" * 100_000, " a" * 600_000, "\t \n" * 100_000 + "x", "1" * 100_000]
    encoder = tokenizing.IdEncoder(tokenizing.default_vocabulary())
    assert encoder.encode(texts) == encoder._by_library(texts)


# -- classifiers ------------------------------------------------------------


PATTERN_SENTENCES = [
    ("idiot", "insult"),
    ("you are an idiot", "insult at a target"),
    ("not an idiot", "negated"),
    ("you aren't an idiot", "negated"),
    ("you can't be an idiot", "negated"),
    ("we won’t be idiot", "negated"),
    ("n'est pas un idiot", "negated"),
    ("he wrote an idiot", "reported"),
    ("he said, you idiot", "reported"),
    ("he said: you idiot", "reported"),
    ('he said: "what! you idiot"', "reported"),
    ('"you idiot", he said', "reported"),
    ('"you idiot!" he said', "reported"),
    ("«tu es idiot», dit il", "reported"),
    ("he said. idiot", "insult"),
    ("idiot. he said nothing of it", "insult"),
    ("he said hello\nyou idiot", "insult at a target"),
    ("i will kill you", "threat at a target"),
    ("you i will kill", "threat at a target"),
    ("i will kill. you", "threat"),
    ("i will kill a b c d you", "threat"),
    ("ich werde dich töten", "threat at a target"),
    ("je vais te tuer", "threat at a target"),
    ("te voy a matar", "threat at a target"),
    ("idiot that you are", "insult at a target"),
    ("idiot, that you are", "insult"),
    ("such an idiot, he once said", "reported"),
    ("such an idiot, as he once had said", "insult"),
    ("such an idiot. he said", "insult"),
]


@pytest.mark.parametrize(("text", "pattern"), PATTERN_SENTENCES)
def test_patterns_of_sentences(text, pattern):
    found, _ = toxicity.ClauseScorer({"idiot": 1.0}).matches(text)
    assert [toxicity.PATTERNS[h.pattern()] for h in found] == [pattern]


def test_marks_by_an_independent_matcher():
    """Scopes written out as searches to the left and to the right of each hit."""
    import random

    rnd = random.Random(6)
    names = {toxicity.WORD: "w", toxicity.INSULT: "idiot", toxicity.THREAT: "kill", toxicity.TARGET: "you", toxicity.NEGATION: "not", toxicity.REPORT: "said", toxicity.CLAUSE: ",", toxicity.SENTENCE: ";"}
    factors = {toxicity.AT_TARGET: 2.0, toxicity.NEGATED: 0.25, toxicity.REPORTED: 0.5, toxicity.REPEATED: 1.5, toxicity.TARGET_AFTER: 3.0, toxicity.REPORTED_AFTER: 0.125}
    scorer = toxicity.ClauseScorer({"idiot": 1.0}, threats={"kill": 2.0}, factors=factors)
    for _ in range(3_000):
        said = rnd.choices(list(names), weights=[4, 3, 2, 2, 1, 1, 2, 1], k=rnd.randint(1, 25))
        want = []
        for at, symbol in enumerate(said):
            if symbol not in toxicity.HITS:
                continue
            ends = [i for i, x in enumerate(said) if x == toxicity.SENTENCE]
            start, stop = max([i + 1 for i in ends if i < at], default=0), min([i for i in ends if i > at], default=len(said))
            breaks = [i for i in range(start, stop) if said[i] == toxicity.CLAUSE]
            first, last = max([i + 1 for i in breaks if i < at], default=start), min([i for i in breaks if i > at], default=stop)
            marks = 0
            marks |= toxicity.AT_TARGET * (toxicity.TARGET in said[max(first, at - 4) : at])
            marks |= toxicity.TARGET_AFTER * (toxicity.TARGET in said[at + 1 : min(last, at + 5)])
            marks |= toxicity.NEGATED * (toxicity.NEGATION in said[max(first, at - 3) : at])
            marks |= toxicity.REPORTED * (toxicity.REPORT in said[start:at])
            marks |= toxicity.REPEATED * any(x in toxicity.HITS for x in said[first:at])
            marks |= toxicity.REPORTED_AFTER * any(toxicity.REPORT in said[b + 1 : min([i for i in breaks if i > b], default=stop)][:3] for b in breaks if b >= last)
            weight = 2.0 if symbol == toxicity.THREAT else 1.0
            for mark, factor in factors.items():
                weight *= factor if marks & mark else 1.0
            want.append((marks, weight))
        got, _ = scorer.matches(" ".join(names[x] for x in said))
        assert [(h.marks, round(h.weight, 9)) for h in got] == [(m, round(w, 9)) for m, w in want], said


def test_threats_and_arcs_are_learned(spark):
    toxic = [(i, f"i will kill you now n{i}", 1) for i in range(40)] + [(100 + i, f"you utter moron n{i}", 1) for i in range(40)]
    clean = [(200 + i, f"he said moron and then burn the wood n{i}", 0) for i in range(20)] + [(300 + i, f"we burn wood n{i}", 0) for i in range(60)]
    sample = spark.createDataFrame(toxic + clean, "doc_id long, text string, label int")
    words = toxicity.learn_lexemes(sample, least_z=1.0)
    assert words.threats["kill"] > 2 and "burn" not in words.threats and "kill" not in words.insults
    factors = toxicity.learn_factors(sample, toxicity.ClauseScorer({"moron": 1.0}, words.unseen_threat, words.threats))
    assert factors[toxicity.REPORTED] == 0.1 and factors[toxicity.AT_TARGET] > 2 and factors[toxicity.TARGET_AFTER] > 2


def test_features_are_of_matched_clauses():
    scorer = toxicity.ClauseScorer({"idiot": 1.0, "scum": 2.0})
    assert scorer.features(None) == scorer.features("") == scorer.features("nothing here") == (0.0,) * 10
    got = scorer.features("idiot and scum, you idiot. not an idiot")
    ln = math.log1p
    assert got == pytest.approx((ln(3), ln(1), 0, 0, ln(1), 0, ln(2), ln(3), ln(2), ln(20.0)))


def test_composition_joins_marks():
    a, b = toxicity.scope(toxicity.NEGATION, 2, toxicity.NEGATED), toxicity.from_then_on((toxicity.REPORT,), toxicity.REPORTED)
    both, state, marks = a.compose(b), 0, []
    for symbol in (toxicity.NEGATION, toxicity.REPORT, toxicity.INSULT, toxicity.INSULT):
        state, m = both.arcs[state, symbol]
        marks.append(m)
    assert marks == [0, 0, toxicity.NEGATED | toxicity.REPORTED, toxicity.REPORTED]


def test_scores_by_hand(spark):
    """Both classifiers' scores from their fitted models in plain Python."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    scorer, w = toxicity.fit_scorer(docs, labels, 8_000, "toxic")
    for r in toxicity.score_documents(docs, labels).collect():
        line = sum(a * b for a, b in zip(w, (*scorer.features(texts[r["doc_id"]]), 1.0), strict=True))
        assert math.isclose(r["score"], 1 / (1 + math.exp(-line)), rel_tol=1e-9)
    model, _, cut = bradley_terry.fitted(decision_list.text_statistics(docs), labels, 8_000, "quality")
    n = len(model.features)
    strengths = {}
    for i, t in texts.items():
        x, total = python_ratios(t), 0.0
        for k, f in enumerate(model.features):
            z = (math.log1p(x[f] * (1 if f in ("words", "mean_word") else 20)) - model.means[k]) / model.deviations[k]
            z = max(-6, min(6, z))
            total += model.weights[k] * z + model.weights[n + k] * max(z - 1, 0) + model.weights[2 * n + k] * max(-z - 1, 0)
        strengths[i] = total
    assert any(math.isclose(cut, s, rel_tol=1e-9) for s in strengths.values())
    for r in bradley_terry.score_quality(docs, labels).collect():
        line = strengths[r["doc_id"]] - cut + math.log(0.3 / 0.7)
        assert abs(r["score"] - 1 / (1 + math.exp(-max(-30, min(30, line))))) < 1e-6
        assert r["predicted"] == (r["score"] >= 0.3)


def test_sample_is_bounded_in_rows(spark):
    docs = spark.range(500).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.labelled_sample(docs, labels, "toxic", 10).count() <= 1


def test_workers_without_the_package(tmp_path):
    """op6, op7, op8 and op9 where Python workers don't have this package on their path."""
    import os
    import subprocess
    import sys

    from tests.conftest import ROOT

    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate()
from ledgerloom.llm import group_join, packing, token_counts, toxicity
docs = spark.createDataFrame([(i, f"you idiot number w{{i}} and so on to the end of it") for i in range(30)], "doc_id long, text string")
labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
for f in (group_join.near_duplicates, packing.pack_documents, token_counts.count_tokens, lambda d: toxicity.score_documents(d, labels)):
    assert f(docs).count() > 0
print("all ran")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "all ran" in done.stdout, done.stderr[-2000:]


def test_no_local_folder_on_a_cluster():
    class Conf(dict):
        pass

    class Fake:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})  # noqa: N815

    with pytest.raises(RuntimeError):
        common.shared_dir(Fake())


def test_scores_without_labels(messy, no_labels):
    rows = toxicity.score_documents(messy, no_labels).collect()
    assert {(r["score"], r["predicted"]) for r in rows} == {(0.0, 0)}
    rows = bradley_terry.score_quality(messy, no_labels).collect()
    assert len(rows) == messy.count() and all(abs(r["score"] - 0.3) < 1e-9 for r in rows)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "labels"))
    truth = {r["doc_id"]: r for r in labels.collect()}
    for rows, label, least in ((toxicity.score_documents(docs, labels), "toxic", 0.9), (bradley_terry.score_quality(docs, labels), "quality", 0.9)):
        held = [r for r in rows.collect() if r["held_out"] and r["doc_id"] in truth]
        assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in held)
        right = sum(r["predicted"] == truth[r["doc_id"]][label] for r in held)
        assert right / len(held) >= least


def test_labels_of_held_out_rows_change_nothing(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    from ledgerloom.llm.common import held_out

    flipped = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, flipped).collect()}
    assert a == b

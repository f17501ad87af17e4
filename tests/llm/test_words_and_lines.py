"""Spelling variants, line dedup and periodic runs against plain Python, edge cases included."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import line_dedup, periodic_runs, queries, spelling

SPACES = " \t\n\x0b\x0c\r"
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- spelling variants --------------------------------------------------------


def near(a, b):
    """Do the words differ by one inserted, deleted or replaced letter?"""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n, times=5):
    """word: (form, root, n, n_near, form_n) by comparing all words."""
    forms, counts = {}, {}
    for w in n:
        others = [x for x in n if near(w, x)]
        counts[w] = len(others)
        best = min(others, key=lambda x: (-n[x], x), default=None)
        forms[w] = best if best is not None and n[best] >= times * n[w] else None

    def root(w):
        while forms[w] is not None:
            w = forms[w]
        return w

    return {w: (forms[w], root(w), n[w], counts[w], n[forms[w]] if forms[w] else None) for w in n}


def as_table(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_variants_match_brute_force(spark):
    rnd = random.Random(3)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.randint(1, 6))) for _ in range(150)} | {"aaaaaa", "aaaaa", "aaaa"}
    n = {w: rnd.choice([5, 5, 26, 130, 700, 5000, 26000]) for w in sorted(words)}
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(4)
    assert as_table(spelling.spelling_variants(df)) == brute_variants(n)


def test_long_words_cost_in_proportion(spark):
    """Words beyond the plain length, across its border, and of 100,000 letters."""
    k = spelling.PLAIN_POINTS
    words = {"b" * m: 5 for m in (k - 1, k + 3)}
    words |= {"a" * m: 7 ** (m - k + 3) for m in (k - 1, k, k + 1, k + 2)}
    words |= {"a" * 30 + "c" + "a" * (k - 30): 3, "a" * 30 + "c" + "a" * (k - 29): 9, "ab" * k: 1, "ab" * k + "c": 50, "xb" + "ab" * (k - 1): 50}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert as_table(spelling.spelling_variants(df)) == brute_variants(words)
    long = "".join(chr(97 + i * i % 23) for i in range(100_000))
    three = {long: 5, long[:50_000] + "z" + long[50_001:]: 100, long[:7] + long[8:]: 30}
    got = as_table(spelling.spelling_variants(spark.createDataFrame(list(three.items()), "word string, n long")))
    assert [got[w][0] for w in three] == [list(three)[1], None, None] and got[long][3] == 2


def test_chains_end_at_their_root(spark):
    n = {"a" * k: 5 ** k for k in range(1, 14)}
    got = as_table(spelling.spelling_variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert {r[1] for r in got.values()} == {"a" * 13} and got["a"] == ("aa", "a" * 13, 5, 1, 25)


def test_words_of_messy_texts(spark, messy):
    rows = messy.select("doc_id", "text").collect()
    want = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            want[spelling.planted_typos(r["doc_id"], run.translate(UPPER))] += 1
    want = {w: n for w, n in want.items() if len(w) >= 3 and n >= 2}
    got = spelling.word_counts(messy, 3, 2, spelling.planted_typos)
    assert {r["word"]: r["n"] for r in got.collect()} == want and want
    assert as_table(spelling.variant_groups(messy, 3, 2, 2, spelling.planted_typos)) == brute_variants(want, 2)


def test_case_and_letters():
    assert spelling.planted_typos(1, "letters") == "letters"
    spoiled = [i for i in range(2_000) if spelling.planted_typos(i, "letters") != "letters"]
    for i in spoiled:
        h = zlib.crc32(f"{i}:letters".encode())
        assert h % 199 == 0 and spelling.planted_typos(i, "letters") == "letters"[: h % 7] + "letters"[h % 7 + 1 :]
    assert spoiled


def test_top_letters_are_kept(spark):
    docs = spark.createDataFrame([(i, "ÀB×ÿz ÀB×ÿz àb×ÿz straße1Straße") for i in range(3)], "doc_id long, text string")
    got = {r["word"]: r["n"] for r in spelling.word_counts(docs, 2, 1).collect()}
    assert got == {"Àb×ÿz": 6, "àb×ÿz": 3, "straße": 6}


# -- line dedup ---------------------------------------------------------------


def brute_lines(rows, least_docs=10, least_points=1):
    keys = [[line.strip(SPACES).translate(UPPER) for line in (r["text"] or "").split("\n")] for r in rows]
    uses = Counter(k for own in keys for k in set(own))
    out = []
    for r, own in zip(rows, keys, strict=True):
        goes = [len(k) >= least_points and uses[k] >= least_docs for k in own]
        kept = "\n".join(x for x, go in zip((r["text"] or "").split("\n"), goes, strict=True) if not go)
        out.append((r["doc_id"], len(own), sum(goes), kept))
    return Counter(out)


def line_docs(spark):
    rnd = random.Random(11)
    lines = [f"line {k} über" for k in range(40)] + ["", "  ", "A common Line", " a common line\t", "x", " x ", "É", "é"]
    rows = [(k if k % 7 else None, "\n".join(rnd.choices(lines, k=rnd.randint(0, 30)))) for k in range(60)]
    rows += [(3, None), (3, ""), (4, "\n\n"), (5, "x\r\nA COMMON LINE\r\n"), (6, "y " * 3_000_000 + "\nA common line"), (6, "same"), (6, "same")]
    extra = ("t", "s", 1, 2, [3], 4)
    return spark.createDataFrame([(*r, *extra) for r in rows], "doc_id long, text string, texts string, block string, hash int, shard int, common array<int>, n_lines int")


@pytest.mark.parametrize("least_docs, least_points", [(10, 1), (2, 6), (1, 1), (10_000, 1)])
def test_lines_match_brute_force(spark, least_docs, least_points):
    docs = line_docs(spark).repartition(3)
    got = line_dedup.drop_common_lines(docs, line_dedup.LineRule(least_docs, least_points))
    assert Counter(map(tuple, got.collect())) == brute_lines(docs.collect(), least_docs, least_points)


def test_small_shards_and_salts_find_the_same(spark, monkeypatch):
    docs = line_docs(spark).repartition(5)
    index, common = line_dedup.line_index, line_dedup.common_hashes
    monkeypatch.setattr(line_dedup, "line_index", lambda lines: index(lines, 4))
    monkeypatch.setattr(line_dedup, "common_hashes", lambda *a: common(*a, probes=2))
    monkeypatch.setattr(line_dedup, "small_parts", lambda batches, column: (b.slice(k, 1) for b in batches for k in range(b.num_rows)))
    got = line_dedup.drop_common_lines(docs)
    assert Counter(map(tuple, got.collect())) == brute_lines(docs.collect())


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(2)
    for size in (0, 1, 2, 63, 1_000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        hash_ = line_dedup.PerfectHash.of(keys)
        assert sorted(hash_.numbers(keys).tolist()) == list(range(len(keys)))
        counts = rng.integers(1, 70_000, len(keys))
        shard = line_dedup.Shard.of(keys, counts)
        again = line_dedup.Shard.read(shard.stored(3).to_pylist()[0])
        assert (again.counts_of(keys) == counts).all()
        others = np.setdiff1d(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64), keys)
        assert (again.counts_of(others) > 0).sum() <= 1
    assert len(hash_.bits) * 64 < 4 * len(keys)
    assert line_dedup.Shard.of(keys, np.full(len(keys), 9)).counts.itemsize == 1


# -- periodic runs ------------------------------------------------------------


def brute_runs(w, least=24, times=3):
    """(start, length, period): every maximal stretch, with its smallest period."""
    best = {}
    for p in range(1, len(w) // times + 1):
        i = 0
        while i < len(w) - p:
            s = i
            while i < len(w) - p and w[i] == w[i + p]:
                i += 1
            if i > s and i + p - s >= max(least, times * p):
                best.setdefault((s, i + p - s), p)
            i += 1
    return sorted((s, n, p) for (s, n), p in best.items())


def brute_report(doc_id, text, repeat=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if repeat and h is not None and h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    milli = 1000 * best[1] // best[2] if runs else None
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    left = " ".join(x for i, x in enumerate(w) if i not in gone)
    return doc_id, len(runs), *best, milli, sha(listed), sha(left)


def some_texts():
    rnd = random.Random(8)
    out = []
    for _ in range(300):
        w = []
        for _ in range(rnd.randint(1, 8)):
            part = [rnd.choice("abcÜ") for _ in range(rnd.randint(1, 14))]
            w += part * rnd.choice([1, 1, 2, 5, 12])
        out.append(w)
    return [*out, [], ["a"] * 23, ["a"] * 24, ["a", "b"] * 500 + ["a"], (["x"] * 30 + ["y"]) * 4]


def test_runs_match_brute_force():
    texts = [[x.encode() for x in w] for w in some_texts()]
    got = periodic_runs.runs_of_texts(texts, periodic_runs.RunRule())
    assert [[(s, e - s, p) for s, e, p in own] for own in got] == [brute_runs(w) for w in texts]
    loose = periodic_runs.runs_of_texts(texts, periodic_runs.RunRule(6, 2))
    assert [[(s, e - s, p) for s, e, p in own] for own in loose] == [brute_runs(w, 6, 2) for w in texts]


def test_small_parts_of_the_grid_and_bad_hashes(monkeypatch):
    """Pairs searched a few at a time; hashes that call different words equal."""
    texts = [[x.encode() for x in w] for w in some_texts()]
    want = periodic_runs.runs_of_texts(texts, periodic_runs.RunRule())
    monkeypatch.setattr(periodic_runs, "PAIRS", 50)
    assert periodic_runs.runs_of_texts(texts, periodic_runs.RunRule()) == want
    equal = periodic_runs.PrefixHashes.equal
    monkeypatch.setattr(periodic_runs.PrefixHashes, "equal", lambda self, a, to_a, p: equal(self, a, to_a, p) | (to_a - a < 3))
    assert periodic_runs.runs_of_texts(texts, periodic_runs.RunRule()) == want


def test_reports_of_messy_texts(spark, messy):
    rows = [(r["doc_id"], r["text"]) for r in messy.select("doc_id", "text").collect()]
    rows += [(100 + k, " ".join(w)) for k, w in enumerate(some_texts())]
    rows += [(5_000, "Thue " * 100_000), (5_001, " ".join(str(bin(i).count("1") % 2) for i in range(4_096)))]
    # the very long rows are checked by themselves
    long = [r for r in rows if r[0] in (5_000, 6, 7)]
    docs = spark.createDataFrame([(*r, 1, "t", 2) for r in rows], "doc_id long, text string, runs int, best string, start int").repartition(3)
    got = [tuple(r) for r in periodic_runs.run_digests(periodic_runs.periodic_runs(periodic_runs.repeated_parts(docs))).collect()]
    few = Counter(r for r in got if r[0] not in {x[0] for x in long})
    assert few == Counter(brute_report(*r) for r in rows if r not in long)
    by_id = {r[0]: r for r in got}
    assert by_id[5_000][1:6] == (1, 0, 100_000, 1, 100_000_000)
    assert by_id[6][1] >= 1 and by_id[6][4] == 977


def test_repetition_by_hand(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:12]
    text = " ".join(f"w{k}" for k in range(101))
    docs = spark.createDataFrame([(i, text) for i in ids] + [(ids[0], ""), (ids[1], None), (None, text)], "doc_id long, text string")
    for r in periodic_runs.repeated_parts(docs).collect():
        if r["doc_id"] is None or not r["text"]:
            assert r["text"] in (text, "", None)
            continue
        w, g = text.split(), zlib.crc32(str(r["doc_id"]).encode()) // 10
        a = g % 101
        p = 1 + (101 - a) // (3 + g % 8)
        assert r["text"].split() == [w[i] if i < a else w[a + (i - a) % p] for i in range(101)]


# -- all three ----------------------------------------------------------------


def test_empty_tables_and_one_row(spark, nothing):
    assert spelling.variant_groups(nothing).count() == 0
    assert line_dedup.drop_common_lines(nothing).count() == 0
    assert periodic_runs.periodic_runs(nothing).count() == 0
    one = spark.createDataFrame([(None, None)], "doc_id long, text string")
    assert spelling.variant_groups(one).count() == 0
    assert [tuple(r) for r in line_dedup.drop_common_lines(one).collect()] == [(None, 1, 0, "")]
    assert [tuple(r) for r in periodic_runs.periodic_runs(one).collect()] == [(None, [], "")]


@pytest.mark.parametrize("name, columns", [
    ("op11_wildcard_groups", ["word string", "form string", "root string", "n bigint", "n_near bigint", "form_n bigint"]),
    ("op12_perfect_hash_lines", ["doc_id bigint", "n_lines bigint", "n_dropped bigint", "kept_sha256 string"]),
    ("op13_harmonic_runs", ["doc_id bigint", "n_runs bigint", "start bigint", "length bigint", "period bigint", "exponent_milli bigint", "runs_sha256 string", "collapsed_sha256 string"]),
])
def test_contract_columns(spark, name, columns):
    from tests.conftest import SMALL

    assert [f"{c} {t}" for c, t in queries.QUERIES[name](spark, SMALL).dtypes] == columns

"""Runs, resampling and line rules against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm import line_rules, periodic_runs, resampling, words

SMALL = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- runs


def plain_runs(w, shortest=12):
    """Every period is tried: the stretches of words that equal the word q on, and q words more."""
    found, w = {}, np.unique(np.array(w or [0]), return_inverse=True)[1][: len(w)]
    for q in range(1, len(w) // 2 + 1):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], w[q:] == w[:-q], [0]]).astype(int)))
        for s, e in zip(edge[::2].tolist(), (edge[1::2] + q).tolist()):
            if e - s >= max(shortest, 2 * q):
                found.setdefault((s, e), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70), st.integers(2, 12), st.integers(0, 40), st.integers(1, 15))
def test_runs_equal_all_periods_tried(w, shortest, start, period):
    w = [w[i] if i < start else w[start + (i - start) % period] if start + period <= len(w) else w[i] for i in range(len(w))]
    assert periodic_runs.runs(w, shortest) == plain_runs(w, shortest)


def test_runs_of_special_sequences():
    fibonacci = [0, 1]
    while len(fibonacci) < 400:
        fibonacci = (fibonacci + fibonacci[: 400 - len(fibonacci)]) if len(fibonacci) > 300 else fibonacci + [1 - x for x in fibonacci]
    a, b = [0], [0, 1]
    while len(b) < 500:
        a, b = b, b + a
    for w in ([7] * 100, fibonacci, b, list(range(50)) * 3, list(range(100)), []):
        assert periodic_runs.runs(w) == plain_runs(w)


def test_factors_are_the_longest_that_came_before():
    rng = random.Random(3)
    for _ in range(200):
        w = [rng.randrange(3) for _ in range(rng.randint(0, 40))]
        at = 0
        for start, earlier in periodic_runs.factors(w):
            assert start == at
            size = 0
            while start + size < len(w) and any(w[i : i + size + 1] == w[start : start + size + 1] for i in range(start)):
                size += 1
            assert (earlier < 0) == (size == 0) and (size == 0 or earlier < start and w[earlier : earlier + size] == w[start : start + size])
            at += max(size, 1)
        assert at == len(w)


def plain_run_rows(rows):
    out = []
    for name, text in rows:
        w = words_of(text)
        h = 1 if name is None else zlib.crc32(str(name).encode())
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = plain_runs(w)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        out.append((name, len(found), *best, best[1] and 1000 * best[1] // best[2], sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


RUN_COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_run_query_equals_plain_version(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = [tuple(r) for r in periodic_runs.query(spark, SMALL).select(RUN_COLUMNS).collect()]
    want = plain_run_rows(docs)
    assert sorted(got) == sorted(want) and sum(r[1] > 0 for r in want) > 10


def test_runs_of_odd_rows(spark, odd_docs, odd_rows, no_docs):
    got = {}
    for r in periodic_runs.with_runs(odd_docs).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], [tuple(x) for x in r["runs"]]))
    for name, text in odd_rows:
        if name is not None:
            assert (len(words_of(text)), plain_runs(words_of(text))) in got[name]
    assert sum(map(len, got.values())) == len(odd_rows) and (0, []) in got[None]
    none = periodic_runs.with_runs(no_docs)
    assert none.count() == 0 and none.columns == ["doc_id", "n_words", "runs", "collapsed"]
    with pytest.raises(ValueError):
        periodic_runs.with_runs(no_docs, shortest=1)


@pytest.mark.parametrize("shortest", [2, 12, 30])
def test_cutting_before_the_search_loses_no_run(spark, shortest):
    rng = random.Random(8)
    texts = []
    for k in range(60):
        w = [str(rng.randrange(9)) for _ in range(rng.randint(0, 200))]
        for _ in range(3):
            at, p, n = rng.randint(0, len(w)), rng.randint(1, 20), rng.randint(1, 70)
            piece = [str(rng.randrange(9)) for _ in range(p)]
            w[at:at] = [piece[i % p] for i in range(n)]
        texts.append((k, " ".join(w)))
    rows = periodic_runs.with_runs(spark.createDataFrame(texts, "doc_id long, text string"), shortest=shortest).collect()
    for r in rows:
        w = texts[r["doc_id"]][1].split()
        want = plain_runs(w, shortest)
        assert [tuple(x) for x in r["runs"]] == want
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert r["collapsed"] == " ".join(x for i, x in enumerate(w) if i not in gone)


# --- resampling


def plain_features(text, longest=1, buckets=10_000):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain_resample(docs, target, percent=10, least=20, longest=1, buckets=10_000, seed=2024):
    every = [(i, *plain_features(t, longest, buckets)) for i, t in docs]
    s, t = Counter(b for _, _, f in every for b in f), Counter(b for x in target for b in plain_features(x, longest, buckets)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    rows = []
    for name, n, f in every:
        h = int(hashlib.sha256(f"{seed}:{'null' if name is None else name}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([name, len(f), n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[2] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return [tuple(r) for r in rows]


def as_rows(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "n_words", "weight", "score", "rank").collect()), key=repr)


def test_resampling_query_equals_plain_version(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    want = sorted(((r[0], r[1], *r[3:]) for r in plain_resample(docs, target)), key=repr)
    got = resampling.query(spark, SMALL)
    assert sorted(map(tuple, got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr) == want and sum(r[-1] is not None for r in want) > 10


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_of_odd_rows(spark, odd_docs, odd_rows, no_docs, longest):
    target = spark.createDataFrame([("One two three one TWO",), (None,), ("",)], "text string")
    want = plain_resample(odd_rows, ["One two three one TWO"], 30, 5, longest, 97)
    got = as_rows(resampling.resample(odd_docs, target, 30, 5, longest=longest, buckets=97))
    # rows that share id and text may have each other's ranks, and one of them may be drawn for another
    assert [r[:5] for r in got] == sorted((r[:5] for r in want), key=repr) or Counter(r[:5] for r in got) == Counter(r[:5] for r in want)
    assert Counter(r for r in got) == Counter(want)
    assert as_rows(resampling.resample(no_docs, target)) == []
    assert all(r[5] is None for r in as_rows(resampling.resample(odd_docs, target, 0)))
    assert all(r[3] == 0 for r in as_rows(resampling.resample(odd_docs.filter("text is null"), target.limit(0))))


@pytest.mark.parametrize("k", [0, 3, 301, 985, 1000, 2000])
def test_radix_selection_takes_exactly_k(spark, k):
    rng = random.Random(2)
    rows = [(rng.choice([None, -5, 0, 1 << 62, -(1 << 62), i]), rng.choice([-(1 << 40), -1, 0, 1, 77, 1 << 33]), i) for i in range(700)]
    rows += [(9, 1 << 50, 10_000 + i) for i in range(300)]  # equal scores and ids
    df = resampling.staged(spark.createDataFrame(rows, "id long, score long, place long").repartition(5))
    got = resampling.ranked(df, k).collect()
    order = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0, r[2]))
    drawn = {(r["id"], r["score"], r["place"]): r["rank"] for r in got if r["rank"] is not None}
    assert len(got) == 1000 and drawn == {r: i + 1 for i, r in enumerate(order[:k])}


# --- line rules


def plain_rules(text):
    text = text or ""
    w = words_of(text)
    lines = [x for x in text.split("\n") if words_of(x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    base = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    lost = 0
    for x in lines:
        n = len(words_of(x))
        splits = len(re.findall(line_rules._SEPARATOR, x)) if len(re.findall(r"[|>/~]", x)) >= 3 else 0
        closed = re.search(r"[.!?:;,)\]\"'…»”’。！？][\x20\x09-\x0D]*\Z", x)
        bad = 5 * len(re.findall(r"[#*$%&|<>]", x)) > n or n >= 3 and 2 * len(re.findall("[!?]", x)) > n or n >= 5 and not closed
        bad = bad or splits >= 3 and n <= 4 * splits or n <= 30 and any(p in x.lower() for p in line_rules.NOTICES)
        bad = bad or n >= 10 and 2 * max(Counter(words_of(x)).values()) > n
        lost += n * bad
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(hit), base, not base and 100 * lost <= 50 * len(w)


RULES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def test_rules_query_equals_plain_version_and_sql(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    found = line_rules.query(spark, SMALL)
    got = {r["doc_id"]: tuple(r[1:]) for r in found.select("doc_id", *RULES).collect()}
    assert got == {i: plain_rules(t) for i, t in docs.items()} and 0 < sum(v[-1] for v in got.values()) < len(got)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{SMALL}/documents.parquet'")
    columns = sorted(found.columns)
    assert sorted(con.sql(line_rules.ORACLE_SQL).select(*columns).fetchall()) == sorted(map(tuple, found.select(columns).collect()))


def test_rules_of_odd_rows(spark, odd_docs, odd_rows, no_docs):
    got = Counter(tuple(r) for r in line_rules.cleaned(odd_docs).select("doc_id", *RULES).collect())
    assert got == Counter((i, *plain_rules(t)) for i, t in odd_rows)
    assert line_rules.cleaned(no_docs).count() == 0
    null = line_rules.cleaned(odd_docs.filter("text is null")).first()
    assert (null["n_words"], null["base_failed"], null["kept"], null["cleaned"]) == (0, True, False, "")


GOOD = "the quick brown fox jumps over the lazy dog today."


@pytest.mark.parametrize(
    "bad",
    ["buy### now$$$ at&&& once%%% or*** never.", "WHAT!! A!! SHOUT!! THIS!! IS!!", "home | news | sport | more | help.", "a line that ends without any sign", "Click here to see it.", " ".join(f"same {x} same" for x in "abcdefg") + "."],
)
def test_bad_lines_go_and_good_ones_stay(spark, bad):
    other = "a second line that is fine, with some more words in it."
    rows = [(1, f"{GOOD}\n{bad}\n{other}\n"), (2, f"{bad}\n{bad} x\n{bad} y\n{GOOD}"), (3, f"{GOOD}\n{other}")]
    got = {r["doc_id"]: r for r in line_rules.cleaned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["cleaned"] == f"{GOOD}\n{other}\n" and got[1]["n_bad_lines"] == 1 and got[1]["kept"]
    assert got[3]["cleaned"] == rows[2][1] and got[3]["kept"] and got[3]["n_bad_lines"] == 0


def test_verdicts_agree_with_labels(spark):
    d = "/root/testdata/sf0.01"
    found = line_rules.query(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("not base_failed").groupBy("quality").agg({"*": "count", "kept": "count_if"}).collect()
    share = {r["quality"]: r["count_if(kept)"] / r["count(1)"] for r in found}
    assert share[1] > 0.98 and share[0] < 0.1


# --- what they share


def test_equal_hashes_of_different_stretches_are_told_apart(monkeypatch):
    rng = np.random.default_rng(5)
    code, owner = rng.integers(0, 3, 300), np.repeat([0, 1, 2], 100)
    want = words.exactly_repeated(code, owner, 4).tolist()
    monkeypatch.setattr(words, "_mixed", lambda x: x & np.uint64(1))
    assert sorted(words.exactly_repeated(code, owner, 4).tolist()) == sorted(want)
    grams = Counter((owner[i], *code[i : i + 4]) for i in range(297) if owner[i] == owner[i + 3])
    assert sorted(want) == [i for i in range(297) if owner[i] == owner[i + 3] and grams[(owner[i], *code[i : i + 4])] > 1]


def test_counts_of_bytes_heed_offsets():
    texts = pa.array([b"zz", b"a*b", b"", b"**", b"q"], pa.large_binary()).slice(1, 3)
    assert words.counted(texts, np.arange(256) == ord("*")).tolist() == [1, 0, 2]
    assert words.translated(texts, bytes(range(1, 256)) + b"\x00").to_pylist() == [b"b+c", b"", b"++"]
    assert words.translated(texts.slice(0, 0), bytes(256)).to_pylist() == []

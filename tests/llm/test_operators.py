"""Each operator on odd rows and on none, against brute force."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleaner.llm import shingles as module_of_sets
from gleaner.llm import embedding_join, exact_dedup, jaccard_join, line_dedup, packing, piece_codec, pii, quality, recurrent_lm, token_store

BYTES, WORDS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def ids_of(path, text, end):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + [end]


def kept(rows):
    return sorted(rows, key=repr)


# 1


def test_store(odd_docs, odd_rows, no_docs):
    store = token_store.write_store(odd_docs, BYTES, 0, shard_ids=500)
    got = token_store.digest(store).collect()
    order = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at = [], 0
    for name, text in order:
        ids = ids_of(BYTES, text, 0)
        want.append((name, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert store.count() > 5 and token_store.digest(token_store.write_store(no_docs, BYTES, 0)).count() == 0


@pytest.mark.parametrize("lengths", [[1], [3] * 1000, list(range(700)), [0, 0, 5, 0], [1, 100_000, 1]])
def test_elias_fano_selects(lengths):
    names = [None] * (len(lengths) // 3) + [7 + k * k for k in range(len(lengths) - len(lengths) // 3)]
    for kind in ("u2", "u4"):
        s = token_store.Shard(token_store.encode_shard(names, [np.ones(n + 1, kind) for n in lengths]))
        assert [s.end(k) for k in range(len(lengths))] == np.cumsum(np.array(lengths) + 1).tolist()
        assert [len(s.document(k)) for k in range(len(lengths))] == [n + 1 for n in lengths]
        assert [s.name(k) for k in range(len(lengths))] == names
    x = np.cumsum(lengths)
    n = len(x)
    assert 8 * len(token_store.elias_fano(x)) <= n * (2 + math.log2(x[-1] / n + 1)) + 256 + 24 * 8 + 32 * (n // token_store.SAMPLE)


def test_store_of_one_very_common_id(spark):
    docs = spark.createDataFrame([(None, f"text {i % 7}") for i in range(300)] + [(5, "same")] * 300, "doc_id long, text string")
    store = token_store.write_store(docs.repartition(4), BYTES, 0)
    got = sorted(token_store.digest(store).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None] * 300 + [5] * 300 and len({r["part"] for r in store.collect()}) > 2
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]


# 2


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_dedup(odd_docs, odd_rows, no_docs, keep):
    groups = defaultdict(list)
    for name, text in odd_rows:
        groups[low(text)].append(name)
    want = []
    for name, text in odd_rows:
        known = [n for n in groups[low(text)] if n is not None]
        best = (max if keep == "max" else min)(known) if known else None
        want.append((name, best, len(groups[low(text)]), name == best, hashlib.sha256(low(text).encode()).hexdigest()))
    assert kept(map(tuple, exact_dedup.exact_dedup(odd_docs, keep=keep).collect())) == kept(want)
    assert exact_dedup.exact_dedup(no_docs).count() == 0


def test_runs_of_texts_with_one_key_are_told_apart():
    x = np.zeros(7, exact_dedup._ENTRY)
    x["key"], x["best"], x["n"] = [5, 9, 5, 5, 1, 9, 5], [4, 8, 3, 2, 7, 6, 1], 1
    x["sha"][:, 3] = [1, 0, 2, 1, 0, 0, 2]
    got = exact_dedup.merge(x, -1)
    assert [(int(r["key"]), int(r["sha"][3]), int(r["best"]), int(r["n"])) for r in got] == [(1, 0, 7, 1), (5, 1, 2, 2), (5, 2, 1, 2), (9, 0, 6, 2)]
    assert exact_dedup.merge(got, -1).tobytes() == got.tobytes() and len(exact_dedup.merge(x[:0], 1)) == 0


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_dedup_by_small_runs_and_ranges(monkeypatch, odd_docs, odd_rows, keep):
    want = kept(map(tuple, exact_dedup.exact_dedup(odd_docs, keep=keep).collect()))
    for name, v in (("RUN", 5), ("RANGE", 4), ("FAN_IN", 2)):
        monkeypatch.setattr(exact_dedup, name, v)
    assert kept(map(tuple, exact_dedup.exact_dedup(odd_docs, keep=keep).collect())) == want


# 3


def test_piece_codec(odd_docs, odd_rows, no_docs):
    coded = piece_codec.encode(odd_docs, PIECES).cache()
    back = piece_codec.decode(coded, PIECES)
    assert kept(map(tuple, back.collect())) == kept((n, t or "") for n, t in odd_rows)
    got = piece_codec.digest(odd_docs, PIECES).collect()
    want = [(r["doc_id"], len(r["ids"]) // 4, zlib.crc32(r["ids"])) for r in coded.collect()]
    assert kept((r[0], r[1], r[2]) for r in got) == kept(want)
    assert piece_codec.digest(no_docs, PIECES).count() == 0


# 4


def test_forest_learns_and_walks():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    f = quality.fit(x[:2000], y[:2000])
    assert ((f.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95
    total = np.full(5, f.base)
    for i in range(5):
        for feature, threshold, leaf in zip(f.feature, f.threshold, f.leaf, strict=True):
            node = 0
            for _ in range(quality.DEPTH):
                node = 2 * node + 1 + int(x[i, feature[node]] > threshold[node])
            total[i] += leaf[node - len(feature)]
    assert f.score(x[:5]) == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-12)


def test_forest_equals_naive_trees(monkeypatch):
    for name, v in (("BOOSTS", 3), ("DEPTH", 2), ("BINS", 8)):
        monkeypatch.setattr(quality, name, v)
    rng = np.random.default_rng(4)
    x = np.round(rng.random((120, 3)), 2).astype(np.float32)
    y = (x[:, 0] + 0.3 * rng.random(120) > 0.6).astype(float)
    base = math.log(y.mean() / (1 - y.mean()))
    cuts = np.quantile(x, np.linspace(0, 1, 9)[1:-1], axis=0).astype(np.float32)
    total = np.full(len(y), base)
    for _ in range(3):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        worth = lambda r: g[r].sum() ** 2 / (h[r].sum() + quality.L2)
        nodes = [np.arange(len(y))]
        for _ in range(2):
            split = []
            for r in nodes:
                best, sides = 1e-9, (r, r[:0])
                for f in range(3):
                    for t in cuts[:, f]:
                        left, right = r[x[r, f] <= t], r[x[r, f] > t]
                        if min(len(left), len(right)) >= quality.LEAST and worth(left) + worth(right) - worth(r) > best + 1e-12:
                            best, sides = worth(left) + worth(right) - worth(r), (left, right)
                split += sides
            nodes = split
        for r in nodes:
            total[r] += quality.RATE * g[r].sum() / (h[r].sum() + quality.L2)
    assert quality.fit(x, y).score(x) == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-9)


@pytest.mark.parametrize("size", [512, 513, 1000, 1023, 1024, 1500])
def test_windows_see_the_end_of_a_text(size):
    text = b"a" * (size - 300) + b"#" * 100 + b"A" * 100 + b"|" * 100
    worst = dict(zip(quality.STATS, quality.describe(text), strict=True))
    for name in ("worst_mark_window", "worst_upper_window", "worst_pipe_window"):
        assert worst[name] == 100 / 512


def test_quality(spark, odd_docs, odd_rows, no_docs):
    labels = spark.createDataFrame([(n, int(n % 2), 0) for n, _ in odd_rows if n is not None] + [(None, 1, 0), (3, None, 0), (5, 7, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(odd_docs, labels).collect()
    assert kept(r["doc_id"] for r in got) == kept(n for n, _ in odd_rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    nothing = labels.limit(0)
    assert {r["score"] for r in quality.classify(odd_docs, nothing).collect()} == {0.5}
    assert quality.classify(no_docs, labels).count() == 0


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    got = quality.query(spark, folder).filter("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.95


# 5


def checked_packing(rows, pieces, window):
    texts, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        texts[p["doc_id"], p["doc_tokens"]].append(p)
        sequences[p["sequence_id"]].append(p)
    seen = Counter()
    for ps in sequences.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= window
    for name, text in rows:
        ids = ids_of(WORDS, text, 2)
        seen[name, len(ids)] += 1
    assert {k: sum(p["length"] for p in ps) for k, ps in texts.items()} == {k: k[1] * n for k, n in seen.items()}
    by_id = {(n, len(i)): i for n, t in rows for i in [ids_of(WORDS, t, 2)]}
    for k, ps in texts.items():
        assert all(p["ids_crc32"] == crc(by_id[k][p["start"] : p["start"] + p["length"]]) for p in ps)
    return sum(window - sum(p["length"] for p in ps) for ps in sequences.values())


@pytest.mark.parametrize("window", [4096, 64])
def test_packing(odd_docs, odd_rows, no_docs, window):
    pieces = packing.pack(odd_docs, WORDS, 2, window, digests=True).collect()
    assert checked_packing(odd_rows, pieces, window) < window + len({p["sequence_id"] for p in pieces}) * window * packing.SLACK
    assert packing.packed(no_docs).count() == 0


@pytest.mark.parametrize("h", [{700: 10**9, 13: 5}, {1: 3}, {i: i % 7 for i in range(1, 4096)}, {4095: 10, 1: 10}, {}])
def test_plan_places_every_rank_once(h):
    counts = np.zeros(4096, np.int64)
    for k, v in h.items():
        counts[k] = v
    placed, laid, n = packing.plan(counts)
    ranks = defaultdict(list)
    for t in (placed, laid):
        for row in t.tolist():
            ranks[row[0]].append((row[1], row[2]))
    for length, parts in ranks.items():
        at = 0
        for first, size in sorted(parts):
            assert first == at
            at += size
        assert at == counts[length]
    assert set(ranks) == {k for k, v in h.items() if v}
    tokens = int((counts * np.arange(4096)).sum())
    assert tokens <= n * 4096 <= tokens * (1 + 2 * packing.SLACK) + 4096


# 6


def test_language_model(odd_docs, odd_rows, no_docs):
    words = [re.findall(rb"[^\x20\x09-\x0d]+", low(t).encode()) + [b"\n"] for _, t in odd_rows]
    held = [n is not None and zlib.crc32(str(n).encode()) % 7 == 2 for n, _ in odd_rows]
    c = Counter(w for ws, h in zip(words, held, strict=True) if not h for w in ws)
    tokens, kinds = sum(c.values()), len(c)
    want = [(n, h, len(w), sum(x in c for x in w), tokens, round(sum(math.log10((c[x] + 1) / (tokens + kinds + 1)) for x in w), 6)) for (n, _), h, w in zip(odd_rows, held, words, strict=True)]
    got = recurrent_lm.score(odd_docs).collect()
    assert kept((*r[:5], round(r[5], 6)) for r in got) == kept(want)
    assert all(r["score"] < 0 for r in got)
    assert recurrent_lm.score(no_docs).count() == 0


def test_chances_sum_to_one_and_lanes_change_nothing():
    words = [(f"w{i}".encode(), 50 - i) for i in range(40)]
    lexicon = recurrent_lm.Lexicon([*words, (b"\n", 3)], 1500, 60, {0: (9, 4), 5: (2, 2)})
    model = recurrent_lm.Model(lexicon)
    rng = np.random.default_rng(1)
    texts = [b" ".join(words[i][0] for i in rng.integers(0, 40, n)) for n in (3, 90, 0, 200, 31, 33)]
    codes, shapes, _ = recurrent_lm._texts(lexicon, texts)
    one = recurrent_lm.scored(model, codes, shapes, lanes=1)
    assert one == pytest.approx(recurrent_lm.scored(model, codes, shapes, lanes=4), rel=1e-5)
    state = rng.standard_normal((1, recurrent_lm.STATE)).astype(np.float32)
    p = [np.exp(model.log_probs(state, np.array([c]), np.array([w]))[0]) for w, c in enumerate(lexicon.cls)]
    p += [np.exp(model.log_probs(state, np.array([lexicon.classes + s]), np.array([-1]))[0]) for s in range(recurrent_lm.SHAPES)]
    assert sum(p) == pytest.approx(1, abs=1e-4)
    before = recurrent_lm.scored(model, codes, shapes).sum()
    for _ in range(20):
        recurrent_lm.learnt(model, codes, shapes, lanes=2)
    assert recurrent_lm.scored(model, codes, shapes).sum() > before


def naive_score(model, codes, shapes):
    """The same chances, a token at a time, in double precision."""
    p, lex, h = {n: v.astype(float) for n, v in model.p.items()}, model.l, recurrent_lm.STATE
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    s, before, total = np.zeros(h), lex.size + recurrent_lm.SHAPES, 0.0
    for c, shape in zip(codes.tolist(), shapes.tolist(), strict=True):
        x, g = p["x"][before], s @ p["u"]
        z, r = sigmoid(x[:h] + g[:h]), sigmoid(x[h : 2 * h] + g[h : 2 * h])
        s = (1 - z) * np.tanh(x[2 * h :] + r * g[2 * h :]) + z * s
        inside = 0 <= c < lex.size
        e, q = s @ p["c"] + p["cb"], p["g"] @ s + p["gb"]
        out = lex.cls[c] if inside else lex.classes + shape
        group = np.searchsorted(lex.group_edge, out, "right") - 1  # P(class) = P(group) P(class | group)
        total += q[group] - np.log(np.exp(q).sum()) + e[out] - np.log(np.exp(e[lex.group_edge[group] : lex.group_edge[group + 1]]).sum())
        if inside:
            lo, hi = lex.edge[lex.cls[c]], lex.edge[lex.cls[c] + 1]
            f = p["w"][lo:hi] @ s + p["wb"][lo:hi]
            total += f[c - lo] - np.log(np.exp(f).sum())
        before = c if inside else lex.size + shape
    return total


def small_model():
    lexicon = recurrent_lm.Lexicon([(f"w{i}".encode(), 9 - i) for i in range(8)] + [(b"\n", 1)], 50, 12, {0: (3, 2)})
    rng = np.random.default_rng(2)
    texts = [b" ".join(f"w{i}".encode() for i in rng.integers(0, 11, n)) for n in (1, 200, 5, 0, 63, 64, 7)]
    codes, shapes, _ = recurrent_lm._texts(lexicon, texts)
    return recurrent_lm.Model(lexicon), codes, shapes


def test_scores_equal_a_token_at_a_time():
    model, codes, shapes = small_model()
    recurrent_lm.learnt(model, codes, shapes, lanes=3)
    want = [naive_score(model, c, s) for c, s in zip(codes, shapes, strict=True)]
    for lanes in (1, 3, 50):
        assert recurrent_lm.scored(model, codes, shapes, lanes).tolist() == pytest.approx(want, rel=1e-4)


def test_outputs_of_windows_with_few_lanes_are_scored_together(monkeypatch):
    model, codes, shapes = small_model()
    rng = np.random.default_rng(3)
    codes, shapes = [*codes, rng.integers(0, 8, 5000).astype(np.int32)], [*shapes, np.zeros(5000, np.int16)]
    rows, log_probs = [], recurrent_lm.Model.log_probs
    monkeypatch.setattr(recurrent_lm.Model, "log_probs", lambda self, states, *more: rows.append(len(states)) or log_probs(self, states, *more))
    for together, calls in ((1 << 15, 1), (2000, 3)):
        monkeypatch.setattr(recurrent_lm, "TOGETHER", together)
        rows.clear()
        got = recurrent_lm.scored(model, codes, shapes)
        assert len(rows) == calls and sum(rows) == sum(map(len, codes))
        assert got.tolist() == pytest.approx([naive_score(model, c, s) for c, s in zip(codes, shapes, strict=True)], rel=1e-4)


def test_slices_of_a_batch_are_scored_side_by_side(monkeypatch):
    model, _, _ = small_model()
    texts = ["w1 w2 other", None, "", "w3 " * 70, "unseen W1\tw99", "w4 w4"]
    batch = pa.record_batch([pa.array([5, None, 7, 8, 8, 9], pa.int64()), pa.array(texts, pa.string())], ["id", "text"])
    calls, scored = [], recurrent_lm.scored
    monkeypatch.setattr(recurrent_lm, "scored", lambda *x: calls.append(len(x[1])) or scored(*x))
    whole = pa.Table.from_batches(recurrent_lm._of_batch(model, batch)).to_pydict()
    monkeypatch.setattr(recurrent_lm, "SLICE", 12)
    parts = list(recurrent_lm._of_batch(model, batch))
    assert len(parts) > 2 and calls == [6, 6]
    got = pa.Table.from_batches(parts).to_pydict()
    assert got.pop("chances") == pytest.approx(whole.pop("chances"), rel=1e-5) and got == whole
    assert list(recurrent_lm._of_batch(model, batch.slice(0, 0))) == []


def test_first_step_follows_differences():
    """The optimiser's first step goes against the sign of the loss's slope: here the slope is taken by differences."""
    start, codes, shapes = small_model()
    codes, shapes = [codes[5][:20]], [shapes[5][:20]]  # one window
    moved = recurrent_lm.Model(start.l)
    moved.p = {n: v.copy() for n, v in start.p.items()}
    recurrent_lm.learnt(moved, codes, shapes, lanes=1)
    rng, checked = np.random.default_rng(0), dict.fromkeys(start.p, 0)
    for name, v in start.p.items():
        for at in rng.integers(0, v.size, 25):
            slope = []
            for d in (1e-3, -1e-3):
                p = {n: x.astype(float) for n, x in start.p.items()}
                p[name].ravel()[at] += d
                m = recurrent_lm.Model.__new__(recurrent_lm.Model)
                m.p, m.l = p, start.l
                slope.append(naive_score(m, codes[0], shapes[0]))
            slope = (slope[0] - slope[1]) / 2e-3 / len(codes[0])
            if abs(slope) > 1e-4:
                step = moved.p[name].ravel()[at] - v.ravel()[at]
                assert np.sign(step) == np.sign(slope), (name, at)
                checked[name] += 1
    assert sum(checked.values()) > 40 and min(checked[n] for n in ("c", "cb", "g", "gb", "w", "u")) > 0


def test_a_sequence_that_repeats_is_learnt():
    lexicon = recurrent_lm.Lexicon([(f"w{i}".encode(), 9 - i) for i in range(8)] + [(b"\n", 1)], 50, 9, {})
    codes, shapes, _ = recurrent_lm._texts(lexicon, [b" ".join([b"w1 w2 w3"] * 300)] * 8)
    model = recurrent_lm.Model(lexicon)
    for _ in range(12):
        recurrent_lm.learnt(model, codes, shapes, lanes=8)
    # far above the best that a model without memory can do
    assert recurrent_lm.scored(model, codes[:1], shapes[:1])[0] / len(codes[0]) > -0.6


def test_chances_of_grouped_classes_sum_to_one():
    model, codes, shapes = small_model()
    assert 1 < model.l.groups < model.l.outputs and model.p["g"].shape == (model.l.groups, recurrent_lm.STATE)
    recurrent_lm.learnt(model, codes, shapes, lanes=3)
    lex, state = model.l, np.random.default_rng(1).standard_normal((1, recurrent_lm.STATE)).astype(np.float32)
    p = [np.exp(model.log_probs(state, np.array([c]), np.array([w]))[0]) for w, c in enumerate(lex.cls)]
    p += [np.exp(model.log_probs(state, np.array([lex.classes + s]), np.array([-1]))[0]) for s in range(recurrent_lm.SHAPES)]
    assert sum(p) == pytest.approx(1, abs=1e-4)


def test_a_token_meets_few_outputs():
    """Of a large lexicon, a token's softmaxes have fewer outputs than there are classes."""
    n = 30_000
    lexicon = recurrent_lm.Lexicon([(f"w{i}".encode(), 10**6 // (i + 1) + 1) for i in range(4 * n)], 10**7, int(n ** (4 / 3)), {})
    model = recurrent_lm.Model(lexicon)
    rng, cells, exp = np.random.default_rng(4), [], np.exp
    word = (lexicon.size ** rng.random(4000)).astype(np.int32) - 1
    class Numpy:  # counts what exponentials are taken of
        def __getattr__(self, name):
            return (lambda x, **more: cells.append(np.size(x)) or exp(x, **more)) if name == "exp" else getattr(np, name)
    real, recurrent_lm.np = recurrent_lm.np, Numpy()
    try:
        model.log_probs(np.zeros((len(word), recurrent_lm.STATE), np.float32), lexicon.cls[word], word)
    finally:
        recurrent_lm.np = real
    assert sum(cells) / len(word) < lexicon.outputs


def test_gates_take_no_tanh():
    """A tanh takes twice as long as an exponential: only the candidate, STATE numbers a token, needs one."""
    model, codes, shapes = small_model()
    cells, tanh = [], np.tanh
    class Numpy:  # counts what tanh is taken of
        def __getattr__(self, name):
            return (lambda x, **more: cells.append(np.size(x)) or tanh(x, **more)) if name == "tanh" else getattr(np, name)
    real, recurrent_lm.np = recurrent_lm.np, Numpy()
    try:
        recurrent_lm.scored(model, codes, shapes, lanes=1)
        recurrent_lm.learnt(model, codes, shapes, lanes=1)
    finally:
        recurrent_lm.np = real
    assert sum(cells) == 2 * recurrent_lm.STATE * sum(map(len, codes))


def test_gates_far_from_0_are_open_or_shut():
    model, _, _ = small_model()
    h, s = recurrent_lm.STATE, np.linspace(-1, 1, recurrent_lm.STATE, dtype=np.float32)[None]
    x = np.zeros((1, 3 * h), np.float32)
    with np.errstate(all="raise", under="ignore"):
        for far, want in ((200, s), (-200, np.tanh(x[:, 2 * h :]))):  # z is 1: the state stays; 0: the candidate takes its place
            x[:, :h], x[:, h : 2 * h] = far, -200
            new, z, r, _, _ = model.step(x, s)
            assert new.tolist() == want.tolist() and set(z.ravel()) == {far > 0} and r.max() < 1e-38


def test_words_that_are_known_are_coded_without_a_dictionary(monkeypatch):
    lexicon = recurrent_lm.Lexicon([(f"w{i}".encode(), 9 - i) for i in range(8)] + [(b"\n", 1)], 50, 9, {})
    words = pa.array([b"w1", b"other", b"w7", b"x", b"other", b"w1"] * 50, pa.large_binary())
    sought, index_in = [], recurrent_lm.pc.index_in
    monkeypatch.setattr(recurrent_lm.pc, "index_in", lambda x, **more: sought.append(len(x)) or index_in(x, **more))
    assert lexicon.coded(words).tolist() == [lexicon.code.get(w, -1 - recurrent_lm.shape(w)) for w in words.to_pylist()]
    assert sought == [300]
    assert lexicon.coded(words[:0]).tolist() == [] and lexicon.coded(words[:1]).tolist() == [1]


def test_far_logits_of_any_sign():
    model, codes, shapes = small_model()
    for name, by in (("cb", 200), ("wb", -200), ("w", 300)):
        model.p[name] = model.p[name] * np.float32(300) if name == "w" else model.p[name] + np.float32(by)
    model.p["cb"][0] -= 400  # a class that hardly ever comes
    got = recurrent_lm.scored(model, codes, shapes)
    assert np.isfinite(got).all() and got.tolist() == pytest.approx([naive_score(model, c, s) for c, s in zip(codes, shapes, strict=True)], rel=1e-3)
    recurrent_lm.learnt(model, codes, shapes, lanes=3)
    assert all(np.isfinite(v).all() for v in model.p.values())


def test_words_are_coded_in_arrays_as_one_at_a_time(monkeypatch):
    words = [b"a", b"z9", b"longer-word.", "\u00e9".encode(), b"eightzzz", b"sevenzz", b"\n", b"7", b"x\x00", b"_"]
    frequent = [(w, 20 - i) for i, w in enumerate(words[:4])]
    asked = [*words[:6], *words[7:], b"a", b"eightzzz"]
    assert recurrent_lm._shapes(pa.array([b"cut off", *words], pa.large_binary()).slice(1)).tolist() == [recurrent_lm._shape(w) for w in words]
    for sought in (1 << 18, 2, 0):
        monkeypatch.setattr(recurrent_lm, "SOUGHT", sought)
        lexicon = recurrent_lm.Lexicon(frequent, 100, 9, {})
        assert lexicon.coded(pa.array(asked, pa.large_binary())).tolist() == [lexicon.code.get(w, -1 - recurrent_lm.shape(w)) for w in asked]
        assert lexicon.coded(pa.array([], pa.large_binary())).tolist() == []


def test_sums_of_rows_by_key():
    rng = np.random.default_rng(5)
    for n in (1, 7, 2000):
        key, x = (rng.pareto(0.7, n) * 2).astype(int) % 300, rng.standard_normal((n, 3))
        keys, sums = recurrent_lm._sums(x, key)
        assert keys.tolist() == sorted(set(key.tolist())) and sums == pytest.approx(np.array([x[key == k].sum(axis=0) for k in keys]))


def test_windows_follow_the_tokens():
    rng = np.random.default_rng(1)
    codes = [rng.integers(0, 9, n).astype(np.int32) for n in (5000, *[7] * 400)]
    lanes = recurrent_lm._lanes(np.array([len(c) for c in codes]), 64)
    seen, cells = [[] for _ in codes], 0
    for code, shp, owner, start in recurrent_lm._windows(codes, codes, lanes, 32):
        cells += code.size
        for j in range(code.shape[1]):
            for t in range(len(code)):
                if owner[t, j] >= 0:
                    assert start[t, j] == (not seen[owner[t, j]])
                    seen[owner[t, j]].append(code[t, j])
    assert all(s == c.tolist() for s, c in zip(seen, codes, strict=True)) and cells < 5000 + 64 * 64 + 7 * 400


def test_held_out_texts_are_likelier_than_by_counts(spark):
    got = recurrent_lm.query(spark, "/root/testdata/sf0.001").filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] > got[1]


def test_every_training_document_is_learnt_from(spark):
    lexicon = recurrent_lm.Lexicon([(b"\n", 40)] + [(f"w{i}".encode(), 1) for i in range(40)], 80, 41, {})
    docs = spark.createDataFrame([(i, f"w{i} w{i}") for i in range(40)], "id long, text string")
    start, model = recurrent_lm.Model(lexicon), recurrent_lm.train(docs, lexicon)
    moved = np.abs(model.p["x"] - start.p["x"]).max(axis=1) > 0
    for i in range(40):  # the input of a word moves only where a text with it is learnt from
        assert moved[lexicon.code[f"w{i}".encode()]] == (zlib.crc32(str(i).encode()) % 7 != 2)


def test_each_shard_learns_by_itself_and_models_travel_in_pieces(spark, monkeypatch):
    tables, staged = {}, recurrent_lm.staged

    def seen(df, name="table", **options):
        out = staged(df, name, **options)
        if name == "models":
            tables["pieces"] = out.select("piece", "shard", F.length("numbers").alias("size")).collect()
            tables["numbers"] = {(r["piece"], r["shard"]): (np.frombuffer(r["weights"]), np.frombuffer(r["numbers"], np.float32)) for r in out.collect()}
        return out

    monkeypatch.setattr(recurrent_lm, "staged", seen)
    monkeypatch.setattr(recurrent_lm, "SHARD_TOKENS", 4000)
    words = [(f"w{i}".encode(), 9) for i in range(900)]
    lexicon = recurrent_lm.Lexicon([*words, (b"\n", 3000)], 90_000, 901, {})
    docs = spark.range(6000).select("id", F.concat_ws(" ", *[F.concat(F.lit("w"), (F.col("id") * k % 900).cast("string")) for k in range(1, 41)]).alias("text"))
    model = recurrent_lm.train(docs, lexicon)
    chars = docs.filter(F.crc32(F.col("id").cast("string").cast("binary")) % 7 != 2).agg(F.sum(F.length("text") + 1)).first()[0]
    shards = -(-chars // max(24_000, sum(v.nbytes for v in model.p.values())))
    assert shards > 1 and len({r["shard"] for r in tables["pieces"]}) == shards
    assert max(r["size"] for r in tables["pieces"]) <= 4 * recurrent_lm.PIECE < sum(v.nbytes for v in model.p.values())
    shards = {r["shard"] for r in tables["pieces"]}
    for piece, (_, _, got) in enumerate(recurrent_lm._pieces(model.p)):
        some = [tables["numbers"][piece, n] for n in shards]
        want = sum(w[:, None] * x.reshape(len(w), -1) for w, x in some) / sum(w for w, _ in some)[:, None]
        assert got.reshape(want.shape) == pytest.approx(want, abs=1e-6)


def test_rows_weigh_as_many_tokens_as_moved_them():
    model, codes, shapes = small_model()
    lex = model.l
    met = recurrent_lm._met(lex, codes, shapes)
    inputs, classes = Counter(), Counter()
    for c, s in zip(codes, shapes, strict=True):
        before = lex.size + recurrent_lm.SHAPES
        for code, shape in zip(c.tolist(), s.tolist(), strict=True):
            inputs[before] += 1
            before = code if 0 <= code < lex.size else lex.size + shape
            classes[lex.cls[code] if 0 <= code < lex.size else None] += 1
    assert met["x"].tolist() == [inputs[i] for i in range(lex.size + recurrent_lm.SHAPES + 1)]
    assert met["w"].tolist() == [classes[c] for c in lex.cls]
    start = {n: v.copy() for n, v in model.p.items()}
    recurrent_lm.learnt(model, codes, shapes)
    for name in ("x", "w"):  # what no token moved is where it began
        assert (model.p[name][met[name] == 0] == start[name][met[name] == 0]).all()


def test_a_word_of_one_shard_is_not_thinned_out_by_others(spark, monkeypatch):
    """The input of a word that one of many shards has moves about as far as if that shard were all."""
    words = [(f"w{i}".encode(), 400 - i) for i in range(60)]
    lexicon = recurrent_lm.Lexicon([*words, (b"\n", 300)], 60_000, 61, {})
    rows = [(i, " ".join(f"w{(i * 7 + k * k) % 59}" for k in range(60))) for i in range(4000)]
    rows[3] = (3, "w59 w1 " * 40)
    docs = spark.createDataFrame(rows, "id long, text string")
    start, at = recurrent_lm.Model(lexicon).p["x"], lexicon.code[b"w59"]
    moved = []
    for tokens in (recurrent_lm.SHARD_TOKENS, 1500):
        monkeypatch.setattr(recurrent_lm, "SHARD_TOKENS", tokens)
        moved.append(np.abs(recurrent_lm.train(docs, lexicon).p["x"][at] - start[at]).sum())
    assert zlib.crc32(b"3") % 7 != 2 and 0.4 < moved[1] / moved[0] < 2.5, moved


def test_lexicon_grows_with_the_vocabulary(spark):
    for kinds in (3_000, 60_000, 200_000):
        counts = spark.range(kinds).select(F.encode(F.concat(F.lit("w"), "id"), "utf-8").alias("word"), (kinds - F.col("id")).alias("n"))
        lexicon = recurrent_lm.lexicon_of(counts)
        assert lexicon.size == max(2048, int(kinds**0.75)) and lexicon.classes == round(lexicon.size**0.5)
        assert lexicon.rest.sum() - recurrent_lm.SHAPES == sum(n + 1 for n in range(1, kinds - lexicon.size + 1))
    assert recurrent_lm.Model(lexicon).p["u"].shape == (24, 72)
    large = recurrent_lm.Lexicon([(f"w{i}".encode(), 1) for i in range(40_000)] + [(b"\n", 1)], 80_000, 1_500_000, {})
    codes, shapes, _ = recurrent_lm._texts(large, [b"w39999 w1 other"] * 3)
    model = recurrent_lm.Model(large)
    before = recurrent_lm.scored(model, codes, shapes).sum()
    recurrent_lm.learnt(model, codes, shapes)
    assert recurrent_lm._met(large, codes, shapes)["x"].sum() == sum(map(len, codes))
    assert large.size == 40_001 and before < recurrent_lm.scored(model, codes, shapes).sum() < 0


# 7


def test_line_dedup(spark, odd_docs, odd_rows, no_docs):
    got = line_dedup.without_repeats(odd_docs.select("doc_id", "text", "id", "part")).collect()
    assert len(got) == len(odd_rows) and "id" in got[0].asDict()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[0]["text"] is None and by[1]["text"] == ""
    text = dict(r for r in odd_rows if r[0] is not None)
    first = by[30]["text"].split("\n")
    assert by[30]["text"] == text[30]
    for i in range(31, 38):  # the passage stays in the first document only
        assert by[i]["text"].split("\n") == [x for x in text[i].split("\n") if x != first[1]] and by[i]["removed_chunks"] == 1
    for i in range(40, 80):
        assert by[i]["text"] == text[i]
    assert by[6]["text"] == by[8]["text"] == "" and by[7]["text"] == text[7]  # the row without an id comes first
    assert {r["text"] for r in got if r["doc_id"] is None} == {None, text[6]}
    assert line_dedup.without_repeats(no_docs).count() == 0


def test_line_dedup_moved_block(spark):
    block = [f"line {i} of the block" for i in range(40)]
    docs = [(i, "\n".join([f"own {i} {k}" for k in range(i * 3 + 1)] + block + [f"end {i}"])) for i in range(4)]
    got = line_dedup.without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    left = {r["doc_id"]: r["text"].split("\n") for r in got}
    assert left[0] == docs[0][1].split("\n")
    for i in range(1, 4):
        assert sum(x in block for x in left[i]) < 14 and {f"own {i} {k}" for k in range(i * 3 - 3)} <= set(left[i])


@pytest.mark.parametrize("lines", range(2, 9))
def test_line_dedup_passages_of_few_lines(spark, lines):
    """Passages of over 50 words, each line far below 50, between foreign lines: all copies but the first go, whole."""
    docs, passages = [], {}
    for p in range(20):
        passages[p] = [" ".join(f"w{p}x{k}x{i}" for i in range(55 // lines + 1)) for k in range(lines)]
        passages[p].insert(1, "")
        for copy in range(2):
            own = [f"own {p} {copy} {k} \t words" for k in range(8)]
            docs.append((2 * p + copy, "\n".join([*own[: 3 + p % 3], *passages[p], *own[3 + p % 3 :]])))
    got = {r["doc_id"]: r for r in line_dedup.without_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    for n, text in docs:
        want = text if n % 2 == 0 else "\n".join(x for x in text.split("\n") if x not in passages[n // 2])
        assert (got[n]["text"], got[n]["removed_lines"], got[n]["removed_chunks"]) == (want, n % 2 * (lines + 1), n % 2)


def test_line_dedup_keeps_one_of_a_line_that_repeats_itself(spark):
    line = " ".join(f"w{i}" for i in range(30))
    got = line_dedup.without_repeats(spark.createDataFrame([(1, "\n".join([line] * 7))], "doc_id long, text string")).collect()
    assert (got[0]["text"], got[0]["removed_lines"]) == (f"{line}\n{line}", 5)


def chained(*values):
    """Spark's xxhash64 of a string, or of numbers (None is passed over)."""
    seed = 42
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed=seed)
    return seed - (seed >> 63 << 64)


def brute_line_dedup(rows):
    """(id, text, removed lines, stretches of them) by the rule, in plain loops."""
    docs = {(n, chained(t), t) for n, t in rows if t is not None}
    found = defaultdict(list)
    for n, digest, text in docs:
        lines = text.split("\n")
        words = [len(x.split()) for x in lines]
        hashes = [chained(x) for x in lines]
        spans = set()
        for i in range(len(lines)):
            if words[i]:  # the shortest span of 50 words from this line on, and up to it
                total = np.cumsum(words[i:])
                if total[-1] >= 50:
                    spans.add((i, i + int(np.argmax(total >= 50))))
                total = np.cumsum(words[i::-1])
                if total[-1] >= 50:
                    spans.add((i - int(np.argmax(total >= 50)), i))
        begin = 0
        for i in range(len(lines)):
            rolling = chained(hashes[i], *(hashes[i - k] if i >= k else None for k in (1, 2)))
            if words[i] >= 50 or i + 1 == len(lines) or words[i + 1] >= 50 or rolling % 4 == 0:
                if i > begin:
                    spans.add((begin, i))
                begin = i + 1
        for a, z in spans:
            found["\n".join(lines[a : z + 1])].append((n is not None, n or 0, digest, a, z))
    gone = defaultdict(set)
    for places in found.values():
        one, *more = sorted(places)
        for known, n, digest, a, z in more:
            if (known, n, digest) == one[:3]:
                a = max(a, one[4] + 1)
            gone[n if known else None, digest] |= set(range(a, z + 1))
    out = []
    for n, text in rows:
        off = gone[n, chained(text)] if text is not None else set()
        left = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in off) if off else text
        out.append((n, left, len(off), sum(i - 1 not in off for i in off)))
    return out


def test_line_dedup_equals_brute_force(spark, monkeypatch, odd_docs, odd_rows):
    rng = np.random.default_rng(11)
    lines = [" ".join(f"w{rng.integers(0, 400)}" for _ in range(int(rng.integers(0, 30)))) for _ in range(60)] + ["", " ", "long " * 55]
    rows = list(odd_rows)
    for k in range(80):
        a, n = (int(rng.integers(0, m)) for m in (50, 12))
        rows.append((1000 + k, "\n".join(lines[i] for i in [*rng.integers(0, 63, 8), *range(a, a + n), *rng.integers(0, 63, 5)])))
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(rows[len(odd_rows) :], "doc_id long, text string"))
    for most, bits in ((1 << 25, 1 << 28), (0, 1 << 28), (0, 64)):  # broadcast; filtered and shuffled; a filter that lets through most
        monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", most)
        monkeypatch.setattr(line_dedup, "FILTER_BITS", bits)
        got = line_dedup.without_repeats(docs).collect()
        assert kept(map(tuple, got)) == kept(brute_line_dedup(rows))
    assert sum(r["removed_lines"] for r in got) > 200


def test_line_dedup_of_a_hot_row_beyond_broadcast(spark, monkeypatch):
    """A third of all rows are one document, without an id; texts without repeats stay out of the shuffle."""
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    passage = "\n".join(" ".join(f"p{i}x{k}" for k in range(20)) for i in range(3))
    rows = [(None, f"{passage}\nend")] * 700 + [(i, f"own {i}\n{passage}") for i in range(700)] + [(i, f"alone {i}") for i in range(700, 1400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = line_dedup.without_repeats(docs)
    assert kept(map(tuple, got.collect())) == kept(brute_line_dedup(rows))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "strategy=broadcast" in plan


# 8


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", low(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (name, _) in enumerate(rows):
        groups[find(i)].append(name)
    return [(name, len(sets[i]), min((n for n in groups[find(i)] if n is not None), default=None) if sets[i] else name) for i, (name, _) in enumerate(rows)]


@pytest.mark.parametrize("sizes", [None, (2, 4, 8, 0)])
def test_near_duplicates(monkeypatch, odd_docs, odd_rows, no_docs, sizes):
    if sizes:  # all groups are large, there are no rounds of hubs: tiles have to find every link
        for name, v in zip(("GROUP", "TILE", "SIDE", "ROUNDS", "TILE_TOKENS", "SIDE_TOKENS", "KEYS"), (*sizes, 300, 900, 2), strict=True):
            monkeypatch.setattr(jaccard_join, name, v)
    assert kept(map(tuple, jaccard_join.near_duplicates(odd_docs).collect())) == kept(components(odd_rows))
    assert jaccard_join.near_duplicates(no_docs).count() == 0


def sets_of(texts):
    raw = [t.encode() + b" " for t in texts]
    return module_of_sets.Sets(np.frombuffer(b"".join(raw), np.uint8), np.array(list(map(len, raw))))


@pytest.mark.parametrize("size", [40, 60, 70, 300, 2000])
def test_sketches_agree_wherever_sets_are_similar(size):
    rng = np.random.default_rng(size)
    words = [f"w{i}" for i in rng.integers(0, 1 << 40, size + 4)]
    texts = [" ".join(words)]
    for _ in range(40):
        some = list(words)
        for i in rng.integers(0, len(some), max(1, size // 35)):
            some[i] = f"v{rng.integers(0, 1 << 40)}"
        texts.append(" ".join(some[: len(some) - int(rng.integers(0, 1 + size // 8))]))
    s = sets_of(texts)
    keys = defaultdict(set)
    for key, at, sub, *_ in jaccard_join._levels(s, np.arange(len(texts))):
        for k, i in zip(key.tolist(), sub[at].tolist(), strict=True):
            keys[i].add(k)
    sets = [set(s.hashes[s.at[i] : s.at[i + 1]].tolist()) for i in range(len(texts))]
    similar = [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    assert similar and all(keys[i] & keys[j] for i, j in similar)


@pytest.mark.parametrize("small", [False, True])
def test_near_duplicates_of_families(monkeypatch, spark, small):
    """Families of near copies around the threshold, with a passage that all texts share, against brute force."""
    if small:  # many bins and slices, large groups at once
        for name, v in (("BIN", 500), ("SLICE", 700), ("GROUP", 3), ("TILE", 8), ("SIDE", 16)):
            monkeypatch.setattr(jaccard_join, name, v)
    rng = np.random.default_rng(9)
    word = lambda: f"w{rng.integers(0, 5000)}"
    passage = [word() for _ in range(30)]
    rows = []
    for family in range(12):
        base = [word() for _ in range(int(rng.integers(20, 220)))]
        for _ in range(14):
            text = [w if rng.random() > rng.choice([0.0, 0.02, 0.035, 0.05]) else word() for w in base]
            text = text[: len(text) - int(rng.integers(0, 1 + len(text) // 6))]
            rows.append((len(rows), " ".join(text + passage * int(rng.integers(0, 2)))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert kept(map(tuple, jaccard_join.near_duplicates(docs).collect())) == kept(components(rows))


def test_long_texts_and_words_are_hashed_in_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join("".join(rng.choice(list("aBc"), int(n))) for n in rng.choice([1, 5, 40, 3000], 300)), "x" * 5000, "", "  a" * 700, "A b C d E f"]
    whole = sets_of(texts)
    monkeypatch.setattr(module_of_sets, "CHUNK", 1000)
    pieces = [s for _, s in module_of_sets.in_chunks(pa.array(range(5)), pa.array(texts))]
    assert len(pieces) > 1 and np.concatenate([s.hashes for s in pieces]).tolist() == whole.hashes.tolist()
    assert np.concatenate([s.sizes for s in pieces]).tolist() == whole.sizes.tolist() == [len(shingles(t)) for t in texts]


# 9


def plain_spans(text):
    out = []
    for kind, pattern in pii.PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


PERSONAL = [
    "mail a@b.co or c.d@e-f.org, a@b.c_d@e.f x@y @z.com", "1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8 000255.0.0.1 1.1.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112, 5500005555555559", "call +49 (30) 1234-5678 or +1 2 +12345678901234567",
    "été 🙂 card: 4111111111111111 ip 10.0.0.1\nbank DE89 3704 0044 0532 0130 00, GB82WEST12345698765432 DE00370400440532013000", "1" * 6_000, "a" * 6_000 + "@", "1." * 4_000, "+" + "(" * 6_000, "+1" * 4_000, "a@b.c " * 1000,
]


def test_pii(spark, odd_docs, odd_rows, no_docs):
    rows = odd_rows + [(200 + i, t) for i, t in enumerate(PERSONAL)]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(rows[len(odd_rows) :], "doc_id long, text string"))
    got = pii.digest(docs).collect()
    want = []
    for name, text in rows:
        spans = plain_spans(text)
        want.append((name, *(sum(s.startswith(k) for s in spans) for k in pii.PLAIN), hashlib.sha256(",".join(spans).encode()).hexdigest()))
    assert kept((r["doc_id"], *(r[f"n_{k}"] for k in pii.PLAIN), r["base_sha256"]) for r in got) == kept(want)
    assert all(r["n_spans"] == sum(r[f"n_{k}"] for k in pii.KINDS) == len(r["scores"].split(",")) - (not r["scores"]) for r in got)
    spans = {r["doc_id"]: r["spans"] for r in got}
    assert spans[204].count("iban") == 2 and spans[204].count("card") == 1
    assert pii.digest(no_docs).count() == 0


def test_pii_work_grows_with_the_text_only(spark):
    import time

    def took(n):
        docs = spark.createDataFrame([(1, "é x@y.co, " * n)], "doc_id long, text string")
        began = time.time()
        assert pii.digest(docs).first()["n_email"] == n
        assert pii.redacted(docs).first()["text"] == "é [EMAIL], " * n
        return time.time() - began

    took(10)
    assert took(100_000) < 30  # with a look-up from the text's start for each span it takes minutes


def test_secrets(spark):
    good = ["24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "AKIA" + "Q7RS2TUV" * 2, "ghp_" + "aB3dE5gH7jK9" * 3]
    bad = ["0" * 40, "abcabcabc0" * 4, "1234567890" * 4, good[0] + "x", "x_" + good[0], good[0][:31]]
    docs = spark.createDataFrame([(i, f'the token = "{t}" here') for i, t in enumerate(good + bad)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_secret"], r["scores"]) for r in pii.digest(docs).collect()}
    assert [got[i][0] for i in range(9)] == [1, 1, 1] + [0] * 6 and got[0][1] == "70"


def test_redaction_across_blocks(monkeypatch, spark):
    import random

    monkeypatch.setattr(pii, "_BLOCK", 7)
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(["a@b.co", "1.2.3.4", "🙂é", " ", "x y z ", "+1 234 567 890 12"]) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r["doc_id"]: sorted((s["start"], -s["end"], s["kind"]) for s in r["pii"]) for r in pii.with_pii(docs).collect()}
    for r in pii.redacted(docs).collect():
        text, out, far = dict(rows)[r["doc_id"]], "", 0
        for start, end, kind in spans[r["doc_id"]]:
            if start >= far:
                out += text[far:start] + f"[{kind.upper()}]"
            far = max(far, -end)
        assert r["text"] == out + text[far:]


def test_redaction_and_scores(spark):
    docs = spark.createDataFrame([(1, "my card 4111111111111111, see 10.0.0.1@x.co"), (2, None), (3, "nothing")], "doc_id long, text string").withColumn("pii", F.lit(1))
    assert {r["doc_id"]: r["text"] for r in pii.redacted(docs).collect()} == {1: "my card [CARD], see [EMAIL]", 2: None, 3: "nothing"}
    found = {s["text"]: s["score"] for r in pii.with_pii(docs, out_col="spans").collect() for s in r["spans"]}
    assert found["4111111111111111"] == 0.8 and found["10.0.0.1"] == 0.6


# 10


@pytest.mark.parametrize("tile", [1024, 3])
def test_near_vectors(monkeypatch, spark, tile):
    monkeypatch.setattr(embedding_join, "TILE", tile)
    monkeypatch.setattr(embedding_join, "SIDE", 2 * tile - 1)
    monkeypatch.setattr(embedding_join, "_PAIRS", 50)
    monkeypatch.setattr(embedding_join, "_CELLS", 40)
    rng = np.random.default_rng(6)
    base = rng.standard_normal((6, 16))
    rows = []
    for k in range(160):
        v = base[k % 6] + rng.standard_normal(16) * (0.02 + 0.1 * (k % 3))
        rows.append((k, v.tolist(), int(k % 6 > 3)))
    rows += [(200 + i, rows[0][1], 0) for i in range(5)] + [(300, [2 * x for x in rows[0][1]], 0), (301, rows[0][1], None), (302, None, 0), (303, [0.0] * 16, 0), (304, [float("nan")] * 16, 0), (305, [1.0, None], 0), (306, [], 0), (307, [1.0, 2.0], 0), (None, rows[1][1], 0), (1, rows[1][1], 0), (308, [1e-200] * 16, 0), (309, [float("inf")] + [1.0] * 15, 0)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, cls int, size string")

    def good(v, label):
        return v is not None and label is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)

    unit = [np.array(v) / np.abs(v).max() if good(v, label) else None for _, v, label in rows]
    unit = [u if u is None else u / np.linalg.norm(u) for u in unit]
    n = len(rows)
    link = [[i != j and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98 for j in range(n)] for i in range(n)]
    want = []
    for i in range(n):
        reach, todo = {i}, [i]
        while todo:
            k = todo.pop()
            todo += [j for j in range(n) if link[k][j] and j not in reach]
            reach |= {j for j in range(n) if link[k][j]}
        root = min((rows[j][0] for j in reach if rows[j][0] is not None), default=None)
        want.append((rows[i][0], sum(link[i]), root, rows[i][0] == root))
    assert kept(map(tuple, embedding_join.near_vectors(df).collect())) == kept(want)
    assert embedding_join.near_vectors(df.limit(0)).count() == 0


def test_rows_leave_the_tiles_of_a_dense_group_not_pairs(spark):
    """300 vectors that are all linked with each other: each is reported once a tile, however many pairs there are."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal(64)
    rows = [(k, (base + rng.standard_normal(64) * 0.01).tolist(), 0) for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = embedding_join.near_vectors(df).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(299, 0)}
    with embedding_join.scratch():
        seen = []
        real = embedding_join.components
        embedding_join.components = lambda edges: seen.append(edges.count()) or real(edges)
        try:
            embedding_join.near_vectors(df)
        finally:
            embedding_join.components = real
    assert seen[0] < 300 * 8 * 9

"""Runs of a text: maximal stretches of words with a period, and the text with each run cut to its first period.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least
max(SHORTEST, 2 q) words long, that no neighbouring word extends.

Method (Kolpakov and Kucherov), on words as numbers, in time linear in the stretch at hand:
1. ``factors``: the stretch is cut into factors of the Lempel-Ziv kind by a suffix automaton: each is a new word, or the
   longest beginning of what is left that occurs earlier (the two may overlap). A state's first end says where.
2. ``_crossing`` (Main): runs that cross or touch the border between two factors. The part of such a run that lies before the
   border u | v is shorter than 2 |u| + |v|, so that much is looked at; longest common extensions to both sides come from
   two Z-tables and give every period at once.
3. All other runs lie strictly inside a factor, and so inside its earlier occurrence: they are copied from there.

Before that, each text is cut at words that no run can hold. In a run every stretch of WITNESS words in all but the last q words
comes again q words on, and there is one: a run has q + WITNESS words (2 q or SHORTEST, twice WITNESS, at least). These stretches
and their copies cover the run. So runs lie inside words that are covered by repeated stretches, and what is maximal there is
maximal in the text. Hashes only propose repeated stretches; one too many costs time, not rightness.

Edge cases: a null text has no words and no runs; its collapsed text is empty. Rows that repeat, or share an id, are handled each
by itself. Words are bytes: nothing is lower-cased. Columns of the input that aren't named in the call are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import documents, freed
from gleaner.llm.words import codes, covered, repeated, sliced, split, whole

SHORTEST, WITNESS = 12, 6

_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def factors(w: list[int]) -> list[tuple[int, int]]:
    """(start, start of an earlier occurrence or -1) of each factor."""
    # the automaton: a state's first transition lies in arrays, others (few states have any) in dictionaries
    length, link, first, symbol, to = (array("q", [v]) for v in (0, -1, -1, -1, -1))
    more: dict[int, dict[int, int]] = {}
    last = 0
    for i, c in enumerate(w):
        new = len(length)
        length.append(length[last] + 1)
        first.append(i)
        symbol.append(-1)
        to.append(-1)
        link.append(0)
        p, q = last, -1
        while p >= 0:
            others = more.get(p)
            if symbol[p] == c:
                q = to[p]
                break
            if others is not None and c in others:
                q = others[c]
                break
            if symbol[p] < 0:
                symbol[p], to[p] = c, new
            elif others is None:
                more[p] = {c: new}
            else:
                others[c] = new
            p = link[p]
        if q >= 0:
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(length)
                length.append(length[p] + 1)
                first.append(first[q])
                symbol.append(symbol[q])
                to.append(to[q])
                link.append(link[q])
                if q in more:
                    more[twin] = dict(more[q])
                while p >= 0:
                    if symbol[p] == c:
                        if to[p] != q:
                            break
                        to[p] = twin
                    else:
                        others = more.get(p)
                        if others is None or others.get(c) != q:
                            break
                        others[c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    out, i, n = [], 0, len(w)
    while i < n:
        state, j = 0, i
        while j < n:
            c = w[j]
            to_state = to[state] if symbol[state] == c else more[state][c]
            if first[to_state] >= j:  # what was read ends here for the first time
                break
            state, j = to_state, j + 1
        out.append((i, first[state] - (j - i) + 1 if j > i else -1))
        i = max(j, i + 1)
    return out


def z_table(s: list[int]) -> np.ndarray:
    """How many words from each place on equal the beginning (0 at the first place)."""
    n = len(s)
    z, left, right = [0] * n, 0, 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return np.array(z, np.int64)


def _crossing(w: list[int], before: int, border: int, end: int, shortest: int) -> dict[tuple[int, int], int]:
    """Smallest period by (start, end) of the runs of ``w`` that lie across or beside the border of w[before:border] and w[border:end]."""
    n = len(w)
    t, u = w[before:border], w[border:end] if border < n else [-2]
    a, b = len(t), len(u)
    zu = z_table([*u, -1, *t, *u])
    rt = t[::-1]
    zt = z_table([*rt, -1, *u[::-1], *rt])
    p = np.arange(1, b + 1)
    ahead, behind = np.append(zu[1:b], 0), zt[a + 1 + b - p]
    good = ahead + behind >= p
    found = [(border - behind[good], border + p[good] + ahead[good], p[good])]
    p = np.arange(1, a + 1)
    ahead, behind = zu[b + 1 + a - p], np.append(zt[1:a], 0)[:a]
    good = ahead + behind >= p
    found.append((border - p[good] - behind[good], border + ahead[good], p[good]))
    out: dict[tuple[int, int], int] = {}
    start, stop, period = (np.concatenate(x) for x in zip(*found, strict=True))
    for s, e, q in zip(*(x[stop - start >= np.maximum(shortest, 2 * period)].tolist() for x in (start, stop, period)), strict=True):
        if (s == 0 or w[s - 1] != w[s - 1 + q]) and (e == n or w[e] != w[e - q]):  # else the window ended, not the run
            out[s, e] = min(q, out.get((s, e), q))
    return out


def runs(w: list[int], shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbers from 0 on, by start and period."""
    n = len(w)
    if n < shortest:
        return []
    cut = [*factors(w), (n, -1)]  # the end is a factor of one word that is nowhere else
    ends = [s for s, _ in cut[1:]] + [n + 1]
    starts: list[int] = []
    at: dict[int, dict[int, int]] = {}

    def add(s: int, e: int, q: int) -> None:
        if s not in at:
            at[s] = {}
            insort(starts, s)
        at[s][e] = min(q, at[s].get(e, q))

    size = 0
    for (b, earlier), e in zip(cut, ends, strict=True):
        before, size = size, e - b
        # a run here has fewer than 2 (|u| + |v|) words
        if b and 2 * (before + size) > shortest:
            for (s, stop), q in _crossing(w, max(0, b - 2 * before - size), b, e, shortest).items():
                add(s, stop, q)
        if earlier >= 0 and size >= shortest + 2:
            k, shift = bisect_right(starts, earlier), b - earlier
            while k < len(starts) and starts[k] < e - shift:  # what is added here may be copied again
                s = starts[k]
                for stop, q in list(at[s].items()):
                    if stop < e - shift:
                        add(s + shift, stop + shift, q)
                k += 1
    return sorted((s, e - s, q) for s, some in at.items() for e, q in some.items())


def _stretches(mask: np.ndarray, owner: np.ndarray, shortest: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches of marked words of one text that could hold a run."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], np.where(mask, owner + 1, 0), [0]])))
    for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if e - s >= shortest and mask[s]:
            yield s, e


Rewrite = Callable[[list, np.ndarray], np.ndarray]


def _found(batches: Iterator[pa.RecordBatch], rewrite: Rewrite | None, shortest: int) -> Iterator[pa.RecordBatch]:
    """(id, n_words, runs, collapsed) of batches of (id, text)."""
    for b in (x for one in batches for x in sliced(one, 1)):
        count, words = split(whole(b.column(1)))
        code, base = codes(words), np.cumsum(count) - count
        at = np.arange(len(words)) if rewrite is None else rewrite(b.column(0).to_pylist(), count)
        code, owner = code[at], np.repeat(np.arange(len(count)), count)
        places, _ = repeated(code, owner, min(WITNESS, shortest // 2))
        found: list[list[dict]] = [[] for _ in count]
        gone = np.zeros(len(code) + 1, np.int64)
        for s, e in _stretches(covered(places, min(WITNESS, shortest // 2), len(code)), owner, shortest):
            _, small = np.unique(code[s:e], return_inverse=True)
            for start, length, q in runs(small.tolist(), shortest):
                found[owner[s]].append({"start": int(s + start - base[owner[s]]), "length": length, "period": q})
                gone[s + start + q] += 1
                gone[s + start + length] -= 1
        keep = np.cumsum(gone)[:-1] == 0
        left = np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=len(count)))])
        kept = pa.LargeListArray.from_arrays(pa.array(left, pa.int64()), words.take(pa.array(at[keep])).view(pa.large_string()))
        text = pc.binary_join(kept, pa.scalar(" ", pa.large_string()))
        yield pa.record_batch([b.column(0), pa.array(count), pa.array(found, _RUNS), text.cast(pa.string())], ["id", "n_words", "runs", "collapsed"])


def with_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, rewrite: Rewrite | None = None) -> DataFrame:
    """One row a document: id, n_words, runs (start in words, length, period; by start and period), collapsed text.

    In the collapsed text a word is dropped if any run holds it after that run's first period; words are joined by one space.
    ``rewrite`` may replace the words of texts by other words of theirs first: from ids and numbers of words it gives the place
    of the word that stands at each place (places run through all texts of a batch).
    """
    if shortest < 2:
        raise ValueError(f"runs have two words at least, so shortest can't be {shortest}")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = "id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    found = rows.mapInArrow(freed(lambda it: _found(it, rewrite, shortest)), kind)
    return found.select(F.col("id").alias(id_col), "n_words", "runs", "collapsed")


def rewritten(ids: list, count: np.ndarray) -> np.ndarray:
    """The contract's texts: with h = crc32 of the id and h % 10 = 0, words from a on repeat those of one period."""
    at, base = np.arange(int(count.sum())), 0
    for name, n in zip(ids, count.tolist(), strict=True):
        h = 1 if name is None else zlib.crc32(str(name).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            at[base + a : base + n] = base + a + np.arange(n - a) % p
        base += n
    return at


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_runs(documents(spark, sf_dir), rewrite=rewritten)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    some = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return some.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.expr("best.length * 1000 div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")

r"""Quality rules, lines first: bad lines go, then documents that lost too much, then those with base rules against them.

Lines (cut at \n) with a word fail by the first of these rules that applies:
 - punctuation: more than one sign of ``#*$%&|<>`` for five words, or more than one ! or ? for two (of three words and more), or, with
   PROSE words and more, no sign at the end that ends or closes a sentence;
 - navigation: three separators (of ``|>/~``, standing alone) or more, with four words or fewer to each;
 - boilerplate: LONGEST words at most, and a phrase of NOTICES;
 - repetition: ten words or more, of which one makes up over half.
The cleaned text is the lines left. A document is kept if no base rule applies (fewer than LEAST words, or over a fifth of its words in
five-word stretches that it has twice) and the lines that failed held at most LOSS percent of its words.

Counts are sums over arrays of all lines and words of a few megabytes of texts; no text meets Python code by itself.

Edge cases: a null text is empty: all counts are 0, and it isn't kept. Rows with one id are judged each by itself. Only columns named in the
call are read, so further columns, whatever their names, change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import documents, freed
from gleaner.llm.words import codes, counted, covered, exactly_repeated, sliced, split, whole

LEAST, WINDOW, PROSE, LONGEST, LOSS = 10, 5, 5, 30, 50
#: Phrases of pages' frames and notices, in lower case.
NOTICES = ("all rights reserved", "terms of service", "terms of use", "privacy policy", "cookie policy", "use of cookies", "uses cookies", "enable javascript", "javascript is disabled", "click here", "read more", "sign in", "log in", "subscribe to", "lorem ipsum", "skip to content", "back to top", "powered by")
_SIGNS, _CALLS, _SPLITS = (np.isin(np.arange(256), list(s)) for s in (b"#*$%&|<>", b"!?", b"|>/~"))
_HEADS = (np.arange(256) & 0xC0) != 0x80
_HEADS[[32, *range(9, 14)]] = False
#: A separator that stands alone; a line's end that prose has: a closing sign, and blanks.
_SEPARATOR = r"(?:^|[\x20\x09-\x0D])[|>/~]+(?:$|[\x20\x09-\x0D])"
_CLOSED = "[.!?:;,)\\]\"'…»”’。！？][\\x20\\x09-\\x0D]*$"

_ROW = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_bad_lines long, n_lost_words long, cleaned string"


def _lines(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many lines each text has, and the lines of all."""
    parts = pc.split_pattern(texts.view(pa.large_string()), "\n")
    return np.diff(parts.offsets.to_numpy()), parts.flatten().view(pa.large_binary())


def _first_seen(owner: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Whether a (text, line) comes for the first time."""
    first = np.zeros(len(code), bool)
    first[np.unique(owner * (int(code.max(initial=0)) + 1) + code, return_index=True)[1]] = True
    return first


def _most_of_one(code: np.ndarray, line: np.ndarray, lines: int) -> np.ndarray:
    """How often each line's most frequent word occurs in it."""
    out = np.zeros(lines, np.int64)
    if len(code):
        kinds = int(code.max()) + 1
        key, n = np.unique(line * kinds + code, return_counts=True)
        np.maximum.at(out, key // kinds, n)
    return out


def failures(lines: pa.Array, words: np.ndarray, code: np.ndarray, word_line: np.ndarray) -> np.ndarray:
    """Which lines fail; ``words``: words of each; ``code`` and ``word_line``: number and line of each word."""
    text = lines.view(pa.large_string())
    where = lambda regex: pc.match_substring_regex(text, regex).to_numpy(zero_copy_only=False)
    marked = (5 * counted(lines, _SIGNS) > words) | ((words >= 3) & (2 * counted(lines, _CALLS) > words))
    unclosed = (words >= PROSE) & ~where(_CLOSED)
    maybe = np.flatnonzero(counted(lines, _SPLITS) >= 3)
    splits = np.zeros(len(lines), np.int64)
    splits[maybe] = pc.count_substring_regex(text.take(pa.array(maybe)), _SEPARATOR).to_numpy()
    menu = (splits >= 3) & (words <= 4 * splits)
    notice = np.zeros(len(lines), bool)
    short = np.flatnonzero(words <= LONGEST)
    notice[short] = pc.match_substring_regex(pc.ascii_lower(text.take(pa.array(short))), "|".join(NOTICES)).to_numpy(zero_copy_only=False)
    long = words >= 10
    same = _most_of_one(code[long[word_line]], word_line[long[word_line]], len(lines))
    return (words > 0) & (marked | unclosed | menu | notice | (long & (2 * same > words)))


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (x for one in batches for x in sliced(one, 1)):
        texts = whole(b.column(1))
        rows = len(texts)
        per_text, lines = _lines(texts)
        text_of = np.repeat(np.arange(rows), per_text)
        words, every = split(lines)
        code, word_line = codes(every), np.repeat(np.arange(len(lines)), words)
        sums = lambda owner, values: np.bincount(owner, values, rows).astype(np.int64)  # noqa: B023, E731
        full = np.flatnonzero(words > 0)
        again = full[~_first_seen(text_of[full], codes(lines.take(pa.array(full))))]
        owner = text_of[word_line]
        in_pairs = covered(exactly_repeated(code, owner, WINDOW), WINDOW, len(code))
        bad = failures(lines, words, code, word_line)
        kept = np.flatnonzero(~bad)
        left = np.concatenate([[0], np.cumsum(np.bincount(text_of[kept], minlength=rows))])
        cleaned = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(left, pa.int64()), lines.take(pa.array(kept)).view(pa.large_string())), pa.scalar("\n", pa.large_string()))
        out = [sums(text_of, words), counted(texts, _HEADS), counted(texts, _SIGNS), sums(text_of[again], None), sums(owner, in_pairs), sums(text_of[full], None), sums(text_of, bad), sums(text_of, words * bad)]
        yield pa.record_batch([b.column(0), *map(pa.array, out), cleaned.cast(pa.string())], [f"c{i}" for i in range(10)])


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", loss: int = LOSS) -> DataFrame:
    """One row a document: id, the counts, base_failed, kept, and the text of the lines that are left."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = rows.mapInArrow(freed(_judged), _ROW)
    base = (F.col("n_words") < LEAST) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    few_lost = 100 * F.col("n_lost_words") <= loss * F.col("n_words")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bad_lines", "n_lost_words"]
    return found.select(F.col("id").alias(id_col), *counts, base.alias("base_failed"), (~base & few_lost).alias("kept"), "cleaned")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(documents(spark, sf_dir)).drop("cleaned")


_BLANK = r"[\x20\x09-\x0D]"
_LOWER = "translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT r, s, i, list_filter(regexp_split_to_array(s, '{_BLANK}+'), lambda x: x <> '') AS ws FROM (SELECT r, unnest(string_split(t, chr(10))) AS s, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d)),
full_lines AS (SELECT *, len(ws) AS n, row_number() OVER (PARTITION BY r, s ORDER BY i) > 1 AS again FROM l WHERE len(ws) > 0),
w AS (SELECT r, i, unnest(ws) AS x, generate_subscripts(ws, 1) AS j FROM full_lines),
most AS (SELECT r, i, max(c) AS most FROM (SELECT r, i, x, count(*) AS c FROM w GROUP BY ALL) GROUP BY ALL),
bad AS (SELECT f.*, 5 * len(regexp_replace(s, '[^#*$%&|<>]', '', 'g')) > n OR n >= 3 AND 2 * len(regexp_replace(s, '[^!?]', '', 'g')) > n
  OR n >= {PROSE} AND NOT regexp_matches(s, '{_CLOSED.replace("'", "''")}')
  OR len(regexp_replace(s, '[^|>/~]', '', 'g')) >= 3 AND len(regexp_extract_all(s, '{_SEPARATOR}')) >= 3 AND n <= 4 * len(regexp_extract_all(s, '{_SEPARATOR}'))
  OR n <= {LONGEST} AND regexp_matches({_LOWER}, '{"|".join(NOTICES)}') OR n >= 10 AND 2 * most > n AS bad FROM full_lines f JOIN most USING (r, i)),
sums AS (SELECT r, sum(n)::BIGINT AS n_words, sum(again::INT)::BIGINT AS n_dup_lines, count(*) AS n_lines, sum(bad::INT)::BIGINT AS n_bad_lines, sum(CASE WHEN bad THEN n ELSE 0 END)::BIGINT AS n_lost_words FROM bad GROUP BY r),
five AS (SELECT r, i, j, x, {", ".join(f"lead(x, {k}) OVER (PARTITION BY r ORDER BY i, j) AS x{k}" for k in range(1, WINDOW))} FROM w),
twice AS (SELECT r, i, j, x{WINDOW - 1} IS NOT NULL AND count(*) OVER (PARTITION BY r, x, {", ".join(f"x{k}" for k in range(1, WINDOW))}) > 1 AS hit FROM five),
repeated AS (SELECT r, sum(hit::INT)::BIGINT AS n_repeat_words FROM (SELECT r, max(hit) OVER (PARTITION BY r ORDER BY i, j ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS hit FROM twice) GROUP BY r),
every AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, len(regexp_replace(t, '{_BLANK}', '', 'g')) AS word_chars, len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_bad_lines, 0) AS n_bad_lines, coalesce(n_lost_words, 0) AS n_lost_words FROM d LEFT JOIN sums USING (r) LEFT JOIN repeated USING (r))
SELECT *, n_words < {LEAST} OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < {LEAST} OR 100 * n_repeat_words > 20 * n_words) AND 100 * n_lost_words <= {LOSS} * n_words AS kept FROM every"""

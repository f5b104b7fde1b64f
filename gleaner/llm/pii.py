"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Only DataFrame functions are used, so that all work stays in the JVM beside the scan; there is no shuffle.

Positions. Spark has no function for the places of a pattern's matches. ``split`` gives the text between the matches
and ``regexp_extract_all`` the matches; a running sum of their lengths gives each start in code points. The sum takes
log2(n) passes over an array of n numbers, and context is read from the end of the text before a match (back to the
last match of the kind), never by a place in the whole text. So work grows with the text, not with its spans.

Patterns are written so that Java's matcher neither recurses (possessive groups) nor scans a run of characters once
for each of its positions (a match begins where its run begins, or where the last match ended: ``\\G``). They match
just what the plain forms in ``PLAIN`` match; tests compare the two.

Edge cases: a null or empty text has no spans; a null id is returned as null; other columns are ignored; rows with
the same id or text are reported each on its own. ``with_pii`` and ``redacted`` keep further columns; the former replaces one
that is named like its result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import documents, unused

#: The plain patterns of the base kinds, in the order of reports.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The kinds that this method adds: account numbers, and keys written as hexadecimal digits or with a known beginning.
ADDED = {
    "iban": r"[A-Z][A-Z][0-9][0-9]([\x20]?[A-Z0-9][A-Z0-9][A-Z0-9][A-Z0-9]){2,7}([\x20]?[A-Z0-9]{1,3})?",
    "secret": r"([0-9a-f]{32,64}|[0-9A-F]{32,64}|AKIA[A-Z0-9]{16}|gh[opsu]_[A-Za-z0-9]{36})",
}
KINDS = (*PLAIN, *ADDED)

_USER, _LABEL = "A-Za-z0-9._%+-", "[A-Za-z0-9-]++"
_FAST = {
    "email": rf"(?:(?<![{_USER}])|\G)[{_USER}]++@{_LABEL}(?:\.{_LABEL})++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": PLAIN["phone"],
} | {k: rf"(?<![A-Za-z0-9_]){p}(?![A-Za-z0-9_])" for k, p in ADDED.items()}
#: Cheap tests that a text must pass before its pattern is tried at all.
_NEEDS = {"email": "@", "phone": "+", "ip": "."}
#: Score of a confirmed span by itself, of 100, and what a context word within CONTEXT characters before it adds.
_SCORE = {"email": 90, "ip": 60, "card": 70, "phone": 60, "iban": 80, "secret": 60}
_BONUS, CONTEXT = 10, 48
_WORDS = {
    "email": "mail|contact|address|write",
    "ip": "(^|[^a-z0-9])ip([^a-z0-9]|$)|address|host|server|login",
    "card": "card|credit|visa|payment|debit",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|transfer",
    "secret": "token|secret|key|passw|auth",
}
#: Code points of a block in which a long text is cut to be masked.
_BLOCK = 1024


def _running(values: Column, combine) -> Column:
    """Inclusive running combination of an array, in log2(n) passes (an array function, no window)."""
    steps = F.when(F.size(values) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(values).cast("double"))).cast("int") - 1))

    def step(all_so_far: Column, k: Column) -> Column:
        far = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(all_so_far, lambda x, i: F.when(i >= far, combine(x, F.get(all_so_far, i - far))).otherwise(x))

    return F.aggregate(F.coalesce(steps, F.expr("array(cast(null as int))")), values, lambda acc, k: F.when(k.isNull(), acc).otherwise(step(acc, k)))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def worth(d: Column, i: Column) -> Column:
        twice = d.cast("int") * 2
        return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d.cast("int"))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number without blanks passes the ISO 7064 mod-97 check."""
    moved = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))

    def step(left: Column, c: Column) -> Column:
        value = F.conv(c, 36, 10).cast("int")
        return F.when(c == "", left).when(value > 9, (left * 100 + value) % 97).otherwise((left * 10 + value) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def _confirmed(kind: str, match: Column) -> Column:
    n = F.length(_digits(match))
    if kind == "ip":
        number = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(match, r"\."), lambda p: (F.length(number(p)) <= 3) & (F.coalesce(number(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return n.between(13, 19) & luhn(_digits(match))
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return mod97(F.replace(match, F.lit(" "), F.lit("")))
    if kind == "secret":  # not a number, and not the same few characters again and again
        return match.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(match, ""))) > 8)
    return F.lit(True)


def _spans(kind: str, text: Column, matches: Column) -> Column:
    """Confirmed spans of a kind: array of (kind, start, end, text, score)."""
    # arrays are zipped, never indexed inside a lambda: an expression that a lambda captures is computed for each element
    gaps = F.split(text, _FAST[kind], -1)
    before = F.concat(F.array(F.lit(0)), F.transform(matches, lambda m: F.length(m)))
    starts = _running(F.zip_with(gaps, before, lambda gap, m: F.length(gap) + m), lambda a, b: a + b)
    seen = F.zip_with(gaps, matches, lambda gap, m: F.struct(m.alias("text"), F.when(m.isNotNull(), F.right(gap, F.lit(CONTEXT))).alias("near")))
    found = F.zip_with(starts, seen, lambda s, m: F.struct(s.alias("start"), m["text"].alias("text"), m["near"].alias("near")))

    def scored(s: Column) -> Column:
        score = F.lit(_SCORE[kind]) + F.when(F.lower(s["near"]).rlike(_WORDS[kind]), _BONUS).otherwise(0)
        end = s["start"] + F.length(s["text"])
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), end.alias("end"), s["text"].alias("text"), (score / 100.0).alias("score"))

    return F.transform(F.filter(found, lambda s: s["text"].isNotNull() & _confirmed(kind, s["text"])), scored)


_EMPTY = "cast(array() as array<struct<kind:string,start:int,end:int,text:string,score:double>>)"


def with_pii(docs: DataFrame, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """``docs`` with ``out_col``: array<struct<kind, start, end, text, score>>, by kind (order of ``KINDS``), then start."""
    kept = docs.columns
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))

    names = dict(zip(KINDS, unused(docs, *KINDS), strict=True))

    def matches(kind: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(_FAST[kind]), F.lit(0))
        return F.when(F.contains(text, F.lit(_NEEDS[kind])), found) if kind in _NEEDS else found

    tried = docs.withColumns({n: matches(k) for k, n in names.items()})
    spans = [F.when(F.size(F.coalesce(F.col(n), F.expr("cast(array() as array<string>)"))) > 0, _spans(k, text, F.col(n))).otherwise(F.expr(_EMPTY)) for k, n in names.items()]
    return tried.withColumn(out_col, F.concat(*spans)).select(*[f"`{c}`" for c in kept if c != out_col], f"`{out_col}`")


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each confirmed span replaced by its kind in brackets; overlapping spans are masked as one.

    A null text stays null; texts without spans stay as they are.
    """
    kept = docs.columns
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    pii, reach, heads, blocks = unused(docs, "pii", "reach", "heads", "blocks")
    # by start; of spans that begin together the longest names the mask
    key = lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))
    found = with_pii(docs, text_col, pii).withColumn(pii, F.array_sort(F.transform(pii, key)))
    s, far, h, block = F.col(pii), F.col(reach), F.col(heads), F.col(blocks)
    found = found.withColumn(reach, _running(F.transform(s, lambda x: -x["back"]), lambda a, b: F.greatest(a, b)))
    first = F.filter(F.transform(s, lambda x, i: i), lambda i: (i == 0) | (F.get(s, i)["start"] >= F.get(far, i - 1)))
    found = found.withColumn(heads, first)
    found = found.withColumn(blocks, F.when(F.size(s) > 0, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))))

    def between(begin: Column, end: Column) -> Column:
        """Part of the text, by its blocks: places count from the start of a block."""
        one, two = F.floor(begin / _BLOCK).cast("int"), F.floor(end / _BLOCK).cast("int")
        inside = F.substring(F.get(block, one), begin % _BLOCK + 1, end - begin)
        middle = F.array_join(F.slice(block, one + 2, F.greatest(two - one - 1, F.lit(0))), "")
        across = F.concat(F.substring(F.get(block, one), begin % _BLOCK + 1, F.lit(_BLOCK)), middle, F.coalesce(F.substring(F.get(block, two), F.lit(1), end % _BLOCK), F.lit("")))
        return F.when(begin >= end, "").when(one == two, inside).otherwise(across)

    def masked(i: Column, j: Column) -> Column:
        begin = F.when(j == 0, F.lit(0)).otherwise(F.get(far, i - 1))
        return F.concat(between(begin, F.get(s, i)["start"]), F.lit("["), F.upper(F.get(s, i)["kind"]), F.lit("]"))

    tail = between(F.get(far, F.size(far) - 1), F.length(text))
    new = F.when(F.size(s) > 0, F.concat(F.array_join(F.transform(h, masked), ""), tail)).otherwise(F.col(f"`{text_col}`"))
    return found.withColumn(text_col, new).select([f"`{c}`" for c in kept])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of spans, base_sha256, spans and their scores (of 100), derived from ``with_pii``."""
    found = with_pii(docs.select("doc_id", "text"))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.size("pii").cast("long").alias("n_spans"),
        F.sha2(said(F.filter("pii", lambda s: s["kind"].isin(*PLAIN))), 256).alias("base_sha256"),
        said(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",").alias("scores"),
    )


_SQL_OK = {
    "email": "true",
    "ip": "len(list_filter(string_split(m, '.'), lambda p: len(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(ltrim(p, '0') AS INT), 0) > 255)) = 0",
    "card": "len(d) BETWEEN 13 AND 19 AND list_sum(list_transform(string_split(reverse(d), ''), lambda c, j: CASE WHEN j % 2 = 1 THEN c::INT WHEN c::INT > 4 THEN c::INT * 2 - 9 ELSE c::INT * 2 END)) % 10 = 0",
    "phone": "len(d) BETWEEN 9 AND 15",
    "iban": "list_reduce(list_prepend(0, list_transform(string_split(replace(m, ' ', '')[5:] || replace(m, ' ', '')[:4], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda a, v: CASE WHEN v > 9 THEN (a * 100 + v) % 97 ELSE (a * 10 + v) % 97 END) = 1",
    "secret": "regexp_matches(m, '[A-Za-z]') AND len(list_distinct(string_split(m, ''))) > 8",
}


def oracle_sql() -> str:
    """The digest in SQL, from the plain patterns (RE2 knows no lookaround: word boundaries stand for the added kinds' guards)."""
    plain = {k: p.replace("(", "(?:") if k != "phone" else p for k, p in (PLAIN | ADDED).items()}
    plain |= {k: rf"\b{plain[k]}\b" for k in ADDED}
    tried = " UNION ALL ".join(
        f"SELECT r, {o} AS o, '{k}' AS kind, unnest(regexp_extract_all(t, '{p}')) AS m, unnest(string_split_regex(t, '{p}')) AS gap, generate_subscripts(string_split_regex(t, '{p}'), 1) AS i FROM d"
        for o, (k, p) in enumerate(plain.items())
    )
    ok = " ".join(f"WHEN '{k}' THEN {x}" for k, x in _SQL_OK.items())
    scores = " ".join(f"WHEN '{k}' THEN {_SCORE[k]} + CASE WHEN regexp_matches(lower(right(gap, {CONTEXT})), '{w}') THEN {_BONUS} ELSE 0 END" for k, w in _WORDS.items())
    counts = ", ".join([*(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS), "count(*) AS n_spans"])
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
tried AS ({tried}),
placed AS (SELECT r, o, kind, m, gap, regexp_replace(m, '[^0-9]', '', 'g') AS d,
    sum(len(gap) + coalesce(len(m), 0)) OVER (PARTITION BY r, o ORDER BY i) - coalesce(len(m), 0) AS s FROM tried),
good AS (SELECT r, o, kind, s, kind || ':' || s::BIGINT || ':' || (s + len(m))::BIGINT AS span, CASE kind {scores} END AS score FROM placed
    WHERE m IS NOT NULL AND CASE kind {ok} END),
said AS (SELECT r, {counts},
    string_agg(span, ',' ORDER BY o, s) FILTER (o < {len(PLAIN)}) AS base, string_agg(span, ',' ORDER BY o, s) AS spans, string_agg(score::VARCHAR, ',' ORDER BY o, s) AS scores FROM good GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in (*KINDS, "spans"))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN said USING (r)"""

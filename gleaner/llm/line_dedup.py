"""Line dedup: repeated passages of lines are removed, whole, but for their first occurrence.

1. A text is cut into lines, a line hashed and its words counted (by white space). Spans of lines are candidates:
   - the shortest span of MIN_WORDS words or more from each line on, and the shortest that ends with each line. Those
     inside a passage depend on its own lines only, and together they cover every line of any passage of MIN_WORDS
     words, however few its lines are and whatever stands around it;
   - content-defined chunks of MIN_LINES lines or more, whatever their words: a rolling hash over WINDOW line hashes
     ends a chunk after a line where it is 0 modulo DIVISOR; before and after a line of MIN_WORDS words one ends too.
2. Spans are counted by a 64-bit hash of their line hashes; partial counts are combined before the shuffle and texts
   aren't shuffled. Only hashes seen more than once go on.
3. Their bytes are compared: the least and the largest text of a hash are equal, or (two texts with one hash) its spans
   are grouped by their whole text. Very common hashes are joined apart (``attach_group``).
4. All lines of all but a span's first occurrence are removed (where both overlap in one text, the lines after the
   first), and what is left of a text is joined again in order.

Only DataFrame functions are used. Edge cases: a null text stays null; empty lines are lines like others; the first
occurrence (least id, nulls first, then a digest of the text, then place) stays, also within one text. Ids may repeat:
rows are told apart by id and digest; rows equal in both are one document whose copies are treated alike. Further columns are kept; ``removed_lines``
and ``removed_chunks`` of the input are replaced by the new ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import attach_group, documents, staged

WINDOW, DIVISOR = 3, 4
MIN_LINES, MIN_WORDS = 2, 50
#: Bytes to be broadcast at most (some 64 a document and 24 a span); with more, a filter of FILTER_BITS is sent instead.
BROADCAST_BYTES = 32 << 20
#: Bits of that filter, 32 MB whatever the input: only texts that it lets through are shuffled.
FILTER_BITS = 1 << 28


def _words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def _span(first: Column, last: Column) -> Column:
    """A span of lines as one number, which arrays tell apart by hashing."""
    return F.shiftleft(first.cast("long"), 32) + last.cast("long")


def _first(span: Column) -> Column:
    return F.shiftright(span, 32).cast("int")


def _last(span: Column) -> Column:
    return span.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def with_spans(docs: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """``docs`` with an array of (span, h): the candidates of a text."""
    # what a lambda reads is named at least twice in its projection, or Spark would compute it anew for each element
    names = [f"`{c}`" for c in docs.columns]
    info, marks, starts = F.col("__info"), F.col("__marks"), F.col("__starts")

    def about(x: Column) -> Column:
        return F.struct(F.xxhash64(x).alias("h"), _words(x).alias("words"))

    def end(x: Column, i: Column) -> Column:
        rolling = F.xxhash64(x["h"], *[F.when(i >= k, F.get(info, i - k)["h"]) for k in range(1, WINDOW)])
        after = F.coalesce(F.get(info, i + 1)["words"] >= MIN_WORDS, F.lit(True))
        return F.when((x["words"] >= MIN_WORDS) | after | (F.pmod(rolling, F.lit(DIVISOR)) == 0), i)

    def chunk(e: Column, j: Column) -> Column:
        first = F.when(j > 0, F.get(F.col("__ends"), j - 1) + 1).otherwise(0)
        return F.when(e - first + 1 >= MIN_LINES, _span(first, e))

    def from_here(s: Column) -> Column:
        last = F.get(marks, s + MIN_WORDS - 1)
        return F.when(last.isNotNull(), _span(F.get(marks, s), last))

    def up_to_here(s: Column, j: Column) -> Column:
        e = F.coalesce(F.get(starts, j + 1), F.size(marks)) - 1  # the line's last word
        return F.when(e >= MIN_WORDS - 1, _span(F.get(marks, F.greatest(e - MIN_WORDS + 1, F.lit(0))), F.get(marks, s)))

    cut = docs.withColumn("__info", F.transform(_lines(F.col(f"`{text_col}`")), about))
    cut = cut.withColumn("__ends", F.array_compact(F.transform(info, end)))
    cut = cut.withColumn("__marks", F.flatten(F.transform(info, lambda x, i: F.array_repeat(i, x["words"]))))  # the line of each word
    words = F.sequence(F.lit(0), F.size(marks) - 1)
    cut = cut.withColumn("__starts", F.when(F.size(marks) >= MIN_WORDS, F.filter(words, lambda p: (p == 0) | (F.get(marks, p - 1) != F.get(marks, p)))).otherwise(F.array().cast("array<int>")))  # the first word of each line with words
    every = F.concat(F.transform(F.col("__ends"), chunk), F.transform(starts, from_here), F.transform(starts, up_to_here))
    cut = cut.withColumn("__spans", F.array_distinct(F.array_compact(every))).withColumn("__h", F.transform(info, lambda x: x["h"]))
    size = lambda x: F.least(_last(x), F.size("__h") - 1) - _first(x) + 1
    return cut.select(*names, F.transform("__spans", lambda x: F.struct(x.alias("span"), F.xxhash64(F.slice(F.col("__h"), _first(x) + 1, size(x))).alias("h"))).alias(out_col))


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("digest"), F.col(f"`{text_col}`").alias("text"))


def _beside(docs: DataFrame, found: DataFrame, how: str, spans: str) -> DataFrame:
    """``docs`` (id, digest, ...) joined with one row a document of ``found`` (__id, __digest, __n, an array ``spans``).

    ``__n`` counts the document's equal rows. Where ``found`` is too large to be broadcast, rows whose bit isn't set stay
    where they are, and of the others those of one document are dealt to several tasks if they are very many.
    """
    few = (found.agg(F.sum(64 + 24 * F.size(spans))).first()[0] or 0) <= BROADCAST_BYTES
    if few:
        same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest"))
        return docs.join(F.broadcast(found.drop("__n")), same, how).drop("__id", "__digest")
    bits = found.select(_bit(F.col("__id"), F.col("__digest")).alias("bit"))
    bits = bits.groupBy(F.bitmap_bucket_number("bit").alias("__block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("__bits"))
    place = F.bitmap_bit_position(_bit(F.col("id"), F.col("digest")))
    byte = F.conv(F.hex(F.substring("__bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    seen = docs.withColumn("__block", F.bitmap_bucket_number(_bit(F.col("id"), F.col("digest")))).join(F.broadcast(staged(bits, "filter")), "__block", "left")
    seen = seen.withColumn("__maybe", F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))).drop("__block", "__bits")
    maybe = seen.filter("__maybe").drop("__maybe").withColumns({"__known": F.col("id").isNotNull(), "__id": F.coalesce("id", F.lit(0)), "__digest": F.col("digest")})
    keyed = found.withColumns({"__known": F.col("__id").isNotNull(), "__id": F.coalesce("__id", F.lit(0))})
    met = attach_group(maybe, keyed, ["__known", "__id", "__digest"], "__n", how).drop("__known", "__id", "__digest", "__n")
    return met if how == "inner" else met.unionByName(seen.filter("not __maybe").drop("__maybe"), allowMissingColumns=True)


def _bit(key: Column, digest: Column) -> Column:
    return F.pmod(F.xxhash64(key, digest), F.lit(FILTER_BITS)) + 1  # bitmaps count from 1


def _by_document(rows: DataFrame, column: str) -> DataFrame:
    """(__id, __digest, __n, __<column>s) of rows (id, digest, ``column``, n): all values of a document in one row, staged."""
    every = rows.groupBy(F.col("id").alias("__id"), F.col("digest").alias("__digest"))
    return staged(every.agg(F.max("n").alias("__n"), F.collect_list(column).alias(f"__{column}s")), "documents")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, span, n) of all lines to be removed, staged; ``n`` counts the rows with that id and digest, at least."""
    named = _named(docs, id_col, text_col)
    cut = staged(with_spans(named, "text", "spans").select("id", "digest", "spans"), "spans")
    rows = cut.select("id", "digest", F.explode("spans").alias("s")).select("id", "digest", "s.span", "s.h")
    wanted = staged(rows.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "repeated")
    held = attach_group(rows, wanted, ["h"], "n")
    held = _by_document(held.groupBy("id", "digest", F.struct("span", "h").alias("hit")).agg(F.count("*").alias("n")), "hit")
    texts = _beside(named, held, "inner", "__hits").withColumn("__lines", _lines(F.col("text"))).select("id", "digest", "__lines", F.explode("__hits").alias("s"))
    span = F.col("s.span")
    body = F.array_join(F.slice("__lines", _first(span) + 1, _last(span) - _first(span) + 1), "\n")
    texts = staged(texts.select("id", "digest", "s.span", "s.h", body.alias("text")), "texts")
    here = F.struct("id", "digest", "span")
    found = texts.groupBy("h").agg(F.min("text").alias("lo"), F.max("text").alias("hi"), F.count("*").alias("n"), F.min(here).alias("first"))
    found = staged(found.select("h", (F.col("lo") == F.col("hi")).alias("same"), "n", "first"), "compared")
    gone = attach_group(texts.select("h", "id", "digest", "span"), found, ["h"], "n").filter("same").drop("h", "n", "same")
    if found.filter("not same").limit(1).count():
        mixed = texts.join(found.filter("not same").select("h"), "h")
        gone = gone.unionByName(mixed.withColumn("first", F.min(here).over(Window.partitionBy("h", "text"))).drop("h", "text"))
    gone = gone.filter(~here.eqNullSafe(F.col("first")))
    within = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("digest") == F.col("first.digest"))
    begin = F.when(within, F.greatest(_first(F.col("span")), _last(F.col("first.span")) + 1)).otherwise(_first(F.col("span")))
    return staged(gone.groupBy("id", "digest", _span(begin, _last(F.col("span"))).alias("span")).agg(F.count("*").alias("n")), "removed")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeats removed from the text, and ``removed_lines`` and ``removed_chunks`` (stretches of removed lines)."""
    kept = [c for c in docs.columns if c not in ("removed_lines", "removed_chunks")]
    gone = _by_document(repeats(docs, id_col, text_col), "span")
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.struct(*[f"`{c}`" for c in kept]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("digest"))
    hit = _beside(rows, gone, "left", "__spans")
    hit = hit.withColumn("__gone", F.array_sort(F.array_distinct(F.flatten(F.transform("__spans", lambda x: F.sequence(_first(x), _last(x)))))))
    hit = hit.withColumn("__lines", F.when(F.col("__gone").isNotNull(), _lines(F.col("row")[text_col])))
    hit = hit.withColumn("__left", F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone"))
    left = F.when(F.size("__left") < F.size("__lines"), F.array_join(F.transform("__left", lambda i: F.get("__lines", i)), "\n"))
    stretches = F.filter(F.sequence(F.lit(0), F.size("__gone") - 1), lambda j: (j == 0) | (F.get("__gone", j - 1) + 1 != F.get("__gone", j)))
    return hit.select(
        *[F.when(F.col("__gone").isNotNull(), left).otherwise(F.col("row")[c]).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in kept],
        F.when(F.col("__gone").isNotNull(), F.size("__gone")).otherwise(0).cast("long").alias("removed_lines"),
        F.when(F.col("__gone").isNotNull(), F.size(stretches)).otherwise(0).cast("long").alias("removed_chunks"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, removed lines and chunks, and the digest of what is left (null text: empty)."""
    left = without_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return left.select("doc_id", "removed_lines", "removed_chunks", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))

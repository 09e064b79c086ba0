"""Removal of repeated multi-line passages, in DataFrame expressions only.

Texts are cut into content-defined chunks: a rolling hash over the hashes of
``span`` neighbouring lines ends a chunk wherever it is divisible by
``average``, so borders depend on nearby lines alone and survive shifts. Chunks
of two or more lines are counted over the corpus by hash; the first occurrence
(by doc_id, then place) stays, the others are repetitions.

A passage that encloses no whole chunk, or reaches beyond one, shows in the
lines that no repeated chunk covers: there every two neighbouring lines are
looked up in the same way, so that each repeated passage of two or more lines
is found at any place and in its full length.

Only hashes are counted and joined first. Then the texts of first occurrences
travel to the documents that repeat them, and bytes are compared there before
anything goes. Documents without a part in either are told by a bit map before
any shuffle, and stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmap import BitMap
from .common import materialize

MARKS = "array<struct<at:int,n:int,first_text:string>>"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row, also where the body's own lambdas read it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _rotate(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))


def _rolling(hashes: Column, i: Column, span: int) -> Column:
    """Cyclic-polynomial hash of the lines i-span+1 .. i; lines before the text count as 0."""
    out = F.get(hashes, i)
    for back in range(1, span):
        out = out.bitwiseXOR(_rotate(F.coalesce(F.get(hashes, i - back), F.lit(0).cast("long")), 7 * back))
    return out


def _lines(text: Column, body) -> Column:
    return let(F.split(text, "\n"), body)


def _hashes(lines: Column, body) -> Column:
    return let(F.transform(lines, lambda x: F.xxhash64(x)), body)


def _text(lines: Column, at: Column, n: Column) -> Column:
    return F.array_join(F.slice(lines, at + 1, n), "\n")


def _chunks(text: Column, span: int, average: int) -> Column:
    """Array of (at, n, key): first line, number of lines and hash of chunks of several lines."""

    def ends(hashes: Column) -> Column:
        last = F.size(hashes) - 1
        return F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (F.pmod(F.xxhash64(_rolling(hashes, i, span)), F.lit(average)) == 0))

    def keyed(lines: Column, cuts: Column) -> Column:
        before = lambda k: F.coalesce(F.get(cuts, k - 1), F.lit(-1))
        chunk = F.transform(cuts, lambda e, k: F.struct((before(k) + 1).alias("at"), (e - before(k)).alias("n")))
        several = F.filter(chunk, lambda c: c["n"] > 1)
        return F.transform(several, lambda c: F.struct(c["at"].alias("at"), c["n"].alias("n"), F.xxhash64(_text(lines, c["at"], c["n"]), c["n"]).alias("key")))

    return _lines(text, lambda lines: _hashes(lines, lambda hashes: let(ends(hashes), lambda cuts: keyed(lines, cuts))))


def _windows(text: Column, covered: Column) -> Column:
    """Array of (at, n, key) of every two neighbouring lines that do not both lie in one of the ``covered`` pieces."""

    def pairs(hashes: Column) -> Column:
        places = F.when(F.size(hashes) > 1, F.sequence(F.lit(0), F.size(hashes) - 2)).otherwise(F.array().cast("array<int>"))
        inner = F.flatten(F.transform(covered, lambda c: F.sequence(c["at"], c["at"] + c["n"] - 2)))
        places = F.when(covered.isNull(), places).otherwise(F.array_except(places, inner))
        return F.transform(places, lambda i: F.struct(i.alias("at"), F.lit(2).alias("n"), F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1)).alias("key")))

    return _lines(text, lambda lines: _hashes(lines, pairs))


def _repetitions(base: DataFrame, pieces: Column) -> tuple[DataFrame, DataFrame]:
    """(key, first) of repeated pieces, and (key, row_key, at, n) of their occurrences besides the first."""
    keyed = base.select("doc_id", "row_key", F.explode(pieces).alias("p")).select("doc_id", "row_key", "p.at", "p.n", "p.key")
    occurrences = materialize(keyed, "pieces")
    place = F.struct("doc_id", "row_key", "at", "n")
    counted = occurrences.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    repeated = materialize(counted.filter("first <> last").select("key", "first"), "repeated")
    # an occurrence that overlaps the first one within a text is not a repetition of it
    again = occurrences.join(repeated, "key").filter((F.col("row_key") != F.col("first.row_key")) | (F.col("at") >= F.col("first.at") + F.col("n"))).select("key", "row_key", "at", "n")
    return repeated, materialize(again, "again")


def _with(base: DataFrame, lists: DataFrame, name: str) -> DataFrame:
    """Adds the list of each row's key, null for rows without; only rows that may have one are shuffled."""
    may = BitMap(lists, "row_key").may_hold("row_key")
    apart = base.filter(~may).withColumn(name, F.lit(None).cast(lists.schema[name].dataType))
    return apart.unionByName(base.filter(may).join(lists, "row_key", "left").select(*base.columns, name))


def remove_repeated_lines(docs: DataFrame, *, span: int = 3, average: int = 4, chunks_only: bool = False) -> DataFrame:
    """(src, doc_id, n_lines, n_removed, kept_text) of every row of ``docs``; src holds the row itself.

    Every passage of two or more lines that occurred before goes; with
    ``chunks_only`` just those that are a whole chunk. Of a first occurrence go
    only lines that themselves repeat a still earlier passage, so one equal line
    of each removed line stays.

    Lines end at line feeds; a null text is the empty text, which has one empty
    line. n_removed: lines removed. kept_text: the other lines, joined by line
    feeds. A passage repeated within one text counts as repeated, unless the two
    overlap. Rows equal in doc_id and text are one text to this operator:
    neither is removed for the other, and they get equal results. A null doc_id
    sorts first. Very long texts are one row each. Columns of any name may be
    present, an empty table gives no rows.
    """
    base = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("src"))
    base = base.select("src", F.col("src.doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("src.text").cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("row_key", F.xxhash64("doc_id", "text"))
    plain = base.select("doc_id", "row_key", "text")
    repeated, again = _repetitions(plain, _chunks(F.col("text"), span, average))
    if not chunks_only:
        covered = materialize(again.groupBy("row_key").agg(F.collect_set(F.struct("at", "n")).alias("covered")), "covered")
        more, again_too = _repetitions(_with(plain, covered, "covered"), _windows(F.col("text"), F.col("covered")))
        repeated, again = repeated.unionByName(more), again.unionByName(again_too)
    # texts of the first occurrences, cut where the documents lie
    wanted = repeated.groupBy(F.col("first.row_key").alias("row_key")).agg(F.collect_set(F.struct("key", F.col("first.at").alias("at"), F.col("first.n").alias("n"))).alias("wanted"))
    wanted = materialize(wanted, "wanted")
    near = plain.select("row_key", "text").filter(BitMap(wanted, "row_key").may_hold("row_key"))
    cut = _lines(F.col("text"), lambda lines: F.transform("wanted", lambda w: F.struct(w["key"].alias("key"), _text(lines, w["at"], w["n"]).alias("first_text"))))
    sources = near.join(wanted, "row_key").select(F.explode(cut).alias("w"))
    texts = materialize(sources.select("w.key", "w.first_text").dropDuplicates(["key"]), "firsts")
    marks = again.join(texts, "key").select("row_key", F.struct("at", "n", "first_text").alias("mark"))
    marks = materialize(marks.groupBy("row_key").agg(F.array_sort(F.collect_set("mark")).alias("marks")), "marks")
    out = _with(base, marks, "marks").withColumn("found", _lines(F.col("text"), lambda lines: _without(lines, F.col("text"), F.coalesce("marks", F.array().cast(MARKS)))))
    return out.select("src", "doc_id", "found.n_lines", "found.n_removed", "found.kept_text")


def _without(lines: Column, text: Column, marks: Column) -> Column:
    """(n_lines, n_removed, kept_text) after the marked pieces whose bytes are those of the first occurrence have gone."""

    def result(gone: Column, kept: Column) -> Column:
        removed = (F.size(lines) - F.size(kept)).cast("long")
        return F.struct(F.size(lines).cast("long").alias("n_lines"), removed.alias("n_removed"), F.when(F.size(gone) == 0, text).otherwise(F.array_join(kept, "\n")).alias("kept_text"))

    def rest(gone: Column) -> Column:
        # lines between removed pieces, which may overlap: before the k-th one, and after the last
        end = lambda k: F.coalesce(F.get(gone, k)["at"], F.size(lines))
        begin = lambda k: F.coalesce(F.get(gone, k - 1)["at"] + F.get(gone, k - 1)["n"], F.lit(0))
        kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda k: F.slice(lines, begin(k) + 1, F.greatest(end(k) - begin(k), F.lit(0)))))
        return let(kept, lambda kept: result(gone, kept))

    return let(F.filter(marks, lambda m: _text(lines, m["at"], m["n"]) == m["first_text"]), rest)

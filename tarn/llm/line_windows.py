"""Removal of repeated runs of lines, by overlapping windows of three lines, and of repeated runs of words.

Each window of three consecutive lines is hashed to 128 bits. Windows that occur more than once
anywhere keep their first occurrence (the least doc_id, then text hash, then position); the lines
that the other occurrences cover, merged, are removed. All of it is DataFrame functions.

Windows are of whole lines, so a passage that fills fewer than three whole lines, or lies inside one,
is none of theirs. ``dedup_word_runs`` removes those: the same rule over runs of 50 words, wherever
lines end. Only runs whose anchor occurs twice are compared. A run's anchor is the least hash of the
19-word runs in it, so equal runs have equal anchors and none is lost; anchors are some 6 % of the words.

Scale: only (hash, doc, position) rows of windows are shuffled, written once to the shared folder
as they are read twice, and pre-aggregated before the shuffle;
a very common window is one row per task there, and the join back to the windows may be split by
adaptive execution. Nothing is broadcast by hand, and rows of a document meet only in its own row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import lasting

WINDOW = 3
#: Words of a run; the blanks before the first word, and a word with the blanks after it.
RUN = 50
_LEAD = r"^[ \t\n\r\f\x0B]*"
_WORD = r"([^ \t\n\r\f\x0B]+[ \t\n\r\f\x0B]*)"
_BLANKS = " \t\r\f\x0b"


def _lines() -> Column:
    return F.split("text", "\n", -1)


def _words() -> Column:
    """The text's words without blanks (one empty word if there is none)."""
    return F.split(F.btrim("text", F.lit(_BLANKS + "\n")), r"[ \t\n\r\f\x0B]+", -1)


def line_windows(docs: DataFrame) -> DataFrame:
    """A row for each window with a visible character: the document's key, position, and hash (a, b)."""
    hashed = docs.select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        F.transform(_lines(), lambda s: F.struct(F.xxhash64(s).alias("a"), F.xxhash64(F.lit("b"), s).alias("b"), (F.btrim(s, F.lit(_BLANKS)) != "").alias("seen"))).alias("marks"),
    )
    marks = F.col("marks")
    at = lambda i, k, name: F.get(marks, i + k)[name]
    enough = F.size("marks") >= WINDOW  # not a filter, which would compute the marks twice
    each = F.transform(
        F.when(enough, F.sequence(F.lit(0), F.greatest(F.size("marks") - WINDOW, F.lit(0)))),
        lambda i: F.struct(
            i.alias("pos"),
            F.xxhash64(*(at(i, k, "a") for k in range(WINDOW))).alias("a"),
            F.xxhash64(*(at(i, k, "b") for k in range(WINDOW))).alias("b"),
            (at(i, 0, "seen") | at(i, 1, "seen") | at(i, 2, "seen")).alias("seen"),
        ),
    )
    return hashed.select("doc_id", "text_hash", F.explode(each).alias("w")).filter("w.seen").select("doc_id", "text_hash", "w.pos", "w.a", "w.b")


def covered(windows: DataFrame, size: int) -> DataFrame:
    """For each document that loses parts: its key and the sorted positions of those parts (from 0). Windows are of ``size`` parts."""
    first = windows.groupBy("a", "b").agg(F.min(F.struct("doc_id", "text_hash", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    same_text = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    later = windows.join(first, ["a", "b"]).filter(~(same_text & (F.col("pos") == F.col("first.pos"))))
    # an occurrence that overlaps the first one covers what lies after it
    start = F.when(same_text, F.greatest("pos", F.col("first.pos") + size)).otherwise(F.col("pos"))
    ranges = later.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct(start.alias("s"), (F.col("pos") + size - 1).alias("e"))).alias("ranges"))
    positions = F.flatten(F.transform("ranges", lambda r: F.sequence(r["s"], r["e"])))
    return ranges.select("doc_id", "text_hash", F.array_sort(F.array_distinct(positions)).alias("gone"))


def covered_lines(docs: DataFrame) -> DataFrame:
    """For each document that loses lines: its key and the sorted positions of those lines (from 0)."""
    return covered(lasting(line_windows(docs)), WINDOW)


def _anchored(docs: DataFrame) -> DataFrame:
    """For each document its key, the anchor of each run of ``RUN`` words (null for shorter texts), and the 19-word hashes that it has twice."""
    key = ("doc_id", "text_hash")
    pairs = lambda name, shift, f: F.zip_with(name, F.slice(name, shift + 1, F.size(name)), f)
    here = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.transform(_words(), lambda w: F.xxhash64(w)).alias("h"))
    here = here.select(*key, F.size("h").alias("n"), F.when(F.size("h") >= RUN, F.col("h")).alias("h"))
    for shift in (1, 2, 4, 8, 3):  # hashes of 2, 4, 8, 16, 19 words; those beyond the end are cut off
        here = here.select(*key, "n", pairs("h", shift, lambda x, y: F.xxhash64(x, y)).alias("h"))
    here = here.select(*key, "n", F.slice("h", 1, F.greatest(F.col("n") - 18, F.lit(0))).alias("h"))
    here = here.select(*key, "n", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.array_sort("h")).alias("sorted"), F.col("h").alias("m"))
    for shift in (1, 2, 4, 8, 16):  # the least of 2, 4, 8, 16, 32 hashes
        here = here.select(*key, "n", "sorted", pairs("m", shift, lambda x, y: F.least(x, y)).alias("m"))
    twice = F.array_distinct(F.array_compact(pairs("sorted", 1, lambda x, y: F.when(x == y, x))))
    return here.select(*key, F.slice("m", 1, F.greatest(F.col("n") - (RUN - 1), F.lit(0))).alias("anchors"), twice.alias("twice"))


def word_runs(docs: DataFrame) -> DataFrame:
    """A row for each run of ``RUN`` words whose anchor occurs more than once: the document's key, position, and hash (a, b)."""
    key = ("doc_id", "text_hash")
    anchors = F.col("anchors")
    starts = F.array_compact(F.transform(anchors, lambda m, i: F.when((i == 0) | (m != F.get(anchors, i - 1)), i)))
    here = _anchored(docs).select(*key, "anchors", "twice", starts.alias("starts"))
    # neighbouring runs of one anchor are one row; an anchor that a document has twice is a row more, as those runs may be neighbours
    each = F.transform("starts", lambda s, k: F.struct(F.get(anchors, s).alias("anchor"), s.alias("s"), (F.coalesce(F.get("starts", k + 1), F.size(anchors)) - 1).alias("e")))
    none = F.lit(None).cast("int")
    more = F.when(F.col("twice").isNotNull(), F.transform(F.array_intersect(anchors, "twice"), lambda m: F.struct(m.alias("anchor"), none.alias("s"), none.alias("e"))))
    spans = lasting(here.select(*key, F.explode(F.concat(each, F.coalesce(more, F.array_repeat(F.get(each, F.lit(0)), 0)))).alias("w")).select(*key, "w.*"))
    common = spans.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    shared = spans.filter("s is not null").join(common, "anchor").groupBy(*key).agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    few = texts.join(shared, texts["doc_id"].eqNullSafe(shared["doc_id"]) & (texts["text_hash"] == shared["text_hash"]))
    runs = few.select(texts["doc_id"], texts["text_hash"], _words().alias("words"), F.flatten(F.transform("spans", lambda r: F.sequence(r["s"], r["e"]))).alias("at"))
    hashed = F.transform("at", lambda i: F.struct(i.alias("pos"), F.xxhash64(F.slice("words", i + 1, RUN)).alias("a"), F.xxhash64(F.lit("b"), F.slice("words", i + 1, RUN)).alias("b")))
    return runs.select(*key, F.explode(hashed).alias("w")).select(*key, "w.*")


def _without(docs: DataFrame, gone: DataFrame, parts: Column, join: Callable[[Column, Column], Column], stats: bool = False) -> DataFrame:
    """The documents without the parts at the positions in ``gone``. ``join`` makes a text of its parts and those positions."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)))  # so that no name clashes
    here = docs.select("doc_id", "text", row.alias("row"), F.xxhash64("text").alias("text_hash"))
    joined = here.join(gone, here["doc_id"].eqNullSafe(gone["doc_id"]) & (here["text_hash"] == gone["text_hash"]), "left")
    found = joined.select(here["doc_id"], "text", "row", "gone", F.when(F.col("gone").isNotNull() | F.lit(stats), parts).alias("parts"))
    untouched = F.col("gone").isNull()
    text = F.when(untouched, F.col("text")).otherwise(join(F.col("parts"), F.col("gone")))
    out = []
    for name in docs.columns:
        column = text if name == "text" else F.col("doc_id") if name == "doc_id" else F.col(f"row.c{others.index(name)}")
        if name == "n_chars":
            column = F.when(untouched, column).otherwise(F.length(text).cast(docs.schema[name].dataType))
        out.append(column.alias(name))
    if stats:
        out.append(F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("parts")).cast("long").alias("line_count"))
        out.append(F.when(untouched, F.lit(0)).otherwise(F.size("gone")).cast("long").alias("removed_lines"))
    return found.select(*out)


def _between(parts: Column, gone: Column, before_slice: Callable[[Column], Column] | None = None) -> Column:
    """The parts that stay. What lies between two removed ones is a slice, so the work is linear in the parts."""

    def piece(x: Column, y: Column) -> Column:
        kept = F.slice(parts, x + 2, y - x - 1)
        return kept if before_slice is None else F.when(y - x > 1, F.concat(F.array(before_slice(x)), kept)).otherwise(kept)

    return F.flatten(F.zip_with(F.concat(F.array(F.lit(-1)), gone), F.concat(gone, F.array(F.size(parts))), piece))


def dedup_line_windows(docs: DataFrame, stats: bool = False) -> DataFrame:
    """The documents, without the lines of later occurrences of repeated three-line windows.

    All columns stay; text loses lines, and n_chars, if there is such a column, is the length of
    the new text. With ``stats``, line_count and removed_lines follow (null text: 0 and 0).

    A null text stays null; an empty text, or one of fewer than three lines, stays as it is. A
    document may become empty, but no row goes. Windows of blank lines alone don't count. Rows with
    the same doc_id (null is an id like any other) and the same text count as one document; with
    other texts they are documents of their own. An empty table gives no rows. Other columns, of
    whatever names, are carried along.
    """
    return _without(docs, covered_lines(docs), _lines(), lambda lines, gone: F.array_join(_between(lines, gone), "\n"), stats)


def dedup_word_runs(docs: DataFrame) -> DataFrame:
    """The documents, without the words of later occurrences of repeated runs of ``RUN`` words.

    Words are parted by ASCII blanks and compared as they are. The blanks after a removed word go
    with it, but what follows a passage that ended a line starts a new one. Passages of fewer words
    stay, and so do edited ones between whose edits there are fewer. The rest is as in
    ``dedup_line_windows``.
    """

    def join(words: Column, gone: Column) -> Column:
        newline = lambda x: F.when(F.contains(F.get(words, x), F.lit("\n")), F.lit("\n")).otherwise(F.lit(""))
        return F.concat(F.regexp_extract("text", _LEAD, 0), F.array_join(_between(words, gone, newline), ""))

    return _without(docs, covered(lasting(word_runs(docs)), RUN), F.regexp_extract_all("text", F.lit(_WORD), F.lit(1)), join)


SQL = """
with l as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
w as (select doc_id, i as pos, ls[i] as a, ls[i + 1] as b, ls[i + 2] as c
      from (select doc_id, ls, unnest(range(1, len(ls) - 1)) as i from l)
      where trim(ls[i] || ls[i + 1] || ls[i + 2], ' ' || chr(9) || chr(13) || chr(12) || chr(11)) <> ''),
f as (select doc_id, pos, row_number() over k as rn, first_value(doc_id) over k as fd, first_value(pos) over k as fp
      from w window k as (partition by a, b, c order by doc_id, pos)),
gone as (select distinct doc_id, unnest(range(case when doc_id = fd then greatest(pos, fp + 3) else pos end, pos + 3)) as p from f where rn > 1),
lines as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as p from l),
kept as (select doc_id, string_agg(line, chr(10) order by p) as text from lines anti join gone using (doc_id, p) group by doc_id),
lost as (select doc_id, count(*) as n from gone group by doc_id)
select l.doc_id, cast(len(l.ls) as bigint) as line_count, coalesce(lost.n, 0) as removed_lines, coalesce(kept.text, '') as text
from l left join kept using (doc_id) left join lost using (doc_id)
"""

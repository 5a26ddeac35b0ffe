"""3. Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line's words are its runs of anything but ASCII white space. Two lines are
near-equal when their word lists are equal, or when one word edit (insertion,
deletion or substitution) makes them so and the longer has ``MIN_WORDS`` words
at least. The bound is one edit for a line of any length: longer lines that differ in
two or more words both stay. A line is removed when a near-equal line stands
earlier: under a smaller document id, or further up in the same document. Lines
are judged on the input, and lines without words always stay.

1. Every line is hashed once (the table of lines holds hashes and places, never
   text). Equal lines collapse to their first place.
2. One edit leaves the first or the last half of the shorter line unchanged, so
   lines that share no half with another line have no near-equal line. The others
   are marked in a bitmap of ``BITS`` bits (a fixed size, so it can be broadcast),
   and a second scan fetches the words of marked lines only.
3. Bitmaps let more lines pass the more lines there are, so the halves of the fetched
   lines are counted exactly. A line whose first half alone is shared can have its edit
   in the rest alone (and the other way round).
   Deletion neighbourhood: each line emits one hashed variant for each word left out
   where an edit may be, and itself. Variants that lack the same place of equally long lines
   meet (substitution), and variants meet whole lines (insertion, deletion). A
   key keeps its earliest member, so a template that a million lines vary yields
   a million links to one line and no pairs.
4. The word edit distance to that earliest line is verified on the words.
5. Removed places go back to the documents. Texts that a second bitmap shows to
   lose nothing stay where they are; only the others are shuffled.

Bitmaps let too many rows pass, never too few; what they let pass is joined exactly.

Null ids come last, null texts stay null, empty texts keep their one empty line.
Rows with equal id and equal text are one document (repeated rows lose the same
lines); rows with equal ids and different texts are compared by line number, and
a tie removes neither.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import write_scratch
from .common import fresh

MIN_WORDS = 5
BITS = 1 << 24
OTHER_SPACE = r"[\x09\x0B-\x0D]"


def _lines(text):
    """The lines of a text with spaces for all other white space: one fixed pattern for a
    whole text, and both cuts (lines, words) are by single characters, without patterns."""
    plain = F.when(F.col(text).rlike(OTHER_SPACE), F.regexp_replace(text, OTHER_SPACE, " ")).otherwise(F.col(text))
    return F.split(plain, "\n")


def _words(line):
    return F.array_remove(F.split(line, " "), "")


def _halves(words, n):
    """Hashes of the halves that any line within one edit shares one of: as the
    shorter of two lines (n // 2 words), and as the longer ((n - 1) // 2)."""
    def both(size):
        return [F.xxhash64(F.lit(0), size, F.slice(words, F.lit(1), size)),
                F.xxhash64(F.lit(1), size, F.slice(words, n - size + 1, size))]
    shorter, longer = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    # the two sizes are one where n is odd
    return (F.when((n >= MIN_WORDS) & (n % 2 == 0), F.array(*both(shorter), *both(longer)))
            .when(n >= MIN_WORDS - 1, F.array(*both(shorter))))


def _shared_halves(near: DataFrame) -> DataFrame:
    """(h1, h2, shared) of the lines that share a half with another line: bit k of ``shared``
    tells of the k-th of ``halves``. The lines are distinct and a line's halves differ, so a half
    that is counted twice is in two lines."""
    halves = near.select("h1", "h2", F.posexplode("halves").alias("k", "half"))
    twice = halves.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half")
    return halves.join(twice, "half").groupBy("h1", "h2").agg(F.expr("bit_or(shiftleft(1, k))").alias("shared"))


def _may_be_cut(i, n, size, front, back):
    """May the word at ``i`` of ``n`` be the edit, if a half of ``size`` words is shared in front or behind?"""
    bit = lambda k: F.col("shared").bitwiseAND(F.shiftleft(F.lit(1), k)) != 0
    return (bit(front) & (i >= size)) | (bit(back) & (i < n - size))


def _same_start(a, b):
    """How many words two lists share from the start."""
    m = F.least(F.size(a), F.size(b))
    differs = F.array_position(F.zip_with(F.slice(a, F.lit(1), m), F.slice(b, F.lit(1), m), lambda x, y: x != y), True)
    return F.when(differs > 0, differs - 1).otherwise(m)


def within_one_edit(a, b):
    """Word edit distance of at most one: all but one word of the longer list match from the two ends."""
    longer = F.greatest(F.size(a), F.size(b))
    ends = _same_start(a, b) + _same_start(F.reverse(a), F.reverse(b))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (ends >= longer - 1)


def _variants(lines: DataFrame) -> DataFrame:
    """(key, role, h1, h2, first) of each line's deletion variants and of the line itself.
    A variant's hash is the exclusive or of its words' hashes at their places, so all
    variants of a line come from running sums over its words. Words in front of a shared first
    half's end, or behind a shared last half's start, are left out only if the other half is shared too."""
    words = lines.select("h1", "h2", "first", "shared", F.size("words").alias("n"), F.posexplode("words").alias("i", "word"))
    words = words.withColumns({"here": F.xxhash64("word", "i"), "moved": F.xxhash64("word", F.col("i") - 1)})
    line = "partition by h1, h2"
    upto = f"({line} order by i rows between unbounded preceding and current row)"
    words = words.selectExpr(
        "h1", "h2", "first", "shared", "n", "i", f"bit_xor(here) over ({line}) as whole",
        f"bit_xor(here) over {upto} ^ here ^ (bit_xor(moved) over ({line}) ^ bit_xor(moved) over {upto}) as variant")
    n, i = F.col("n"), F.col("i")
    swap = _may_be_cut(i, n, F.floor(n / 2), 0, 1)
    # as the longer line: the halves of its own size come third and fourth where they are others
    drop = F.when(n % 2 == 0, _may_be_cut(i, n, F.floor((n - 1) / 2), 2, 3)).otherwise(swap)
    role = F.explode(F.filter(F.array(
        F.when((n >= MIN_WORDS) & swap, F.struct(F.xxhash64(F.lit("swap"), "variant", "i", "n").alias("key"), F.lit(0).alias("role"))),
        F.when((n >= MIN_WORDS) & drop, F.struct(F.xxhash64(F.lit("drop"), "variant", n - 1).alias("key"), F.lit(1).alias("role"))),
        F.when(F.col("i") == 0, F.struct(F.xxhash64(F.lit("drop"), "whole", n).alias("key"), F.lit(2).alias("role")))),
        lambda x: x.isNotNull()))
    return words.select("h1", "h2", "first", role.alias("x")).select("x.key", "x.role", "h1", "h2", "first")


def _bitmap(hashes: DataFrame, column: str) -> DataFrame:
    """(word, bits): a bitmap of the hashes, BITS / 64 numbers at most. The partial
    aggregate is a hash aggregate, so each task shuffles no more than the bitmap."""
    at = F.pmod(F.col(column), F.lit(BITS))
    return (hashes.select(F.shiftright(at, 6).alias("__word"), at.alias("at"))
            .groupBy("__word").agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("__bits")))


def _marked(rows: DataFrame, column: str, bitmap: DataFrame, wanted: bool = True) -> DataFrame:
    """The rows whose hash is marked in the bitmap (or not), by a broadcast of its fixed size."""
    at, kept, word, bits = F.pmod(F.col(column), F.lit(BITS)), rows.columns, fresh("word"), fresh("bits")
    joined = rows.withColumn(word, F.shiftright(at, 6)).join(F.broadcast(bitmap.toDF(word, bits)), word, "left")
    hit = F.getbit(F.col(bits), at.bitwiseAND(F.lit(63)).cast("int")) == 1
    return joined.filter(F.coalesce(hit, F.lit(False)) == wanted).select(*[F.col(f"`{c}`") for c in kept])


def _place(id_type: T.DataType, i: Column, pos: Column) -> Column:
    """A line's place, ordered by id (null last) and line number: one number for integral ids."""
    if not isinstance(id_type, T.IntegralType):
        return F.struct(i.isNull().alias("none"), i.alias("id"), pos.alias("pos"))
    wide = F.coalesce(i.cast("decimal(20,0)"), F.lit("18446744073709551616").cast("decimal(20,0)"))
    return (wide * F.lit(1 << 32).cast("decimal(11,0)") + pos.cast("decimal(11,0)")).cast("decimal(38,0)")


def _named(lines: DataFrame) -> DataFrame:
    """Lines with words, with their words and the 96 hash bits that name them, instead of ``line``."""
    return (lines.withColumn("words", _words(F.col("line"))).drop("line").filter(F.size("words") > 0)
            .withColumns({"h1": F.xxhash64("words"), "h2": F.hash("words")}))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, removed): the removed line numbers (from 0) of each document that loses
    lines; ``mark`` is the hash of its text."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    place = _place(source.schema["id"].dataType, F.col("id"), F.col("pos"))
    cut = _named(source.select("id", "mark", F.posexplode(_lines("text")).alias("pos", "line")))
    lines = write_scratch(cut.withColumn("halves", _halves(F.col("words"), F.size("words"))).drop("words"), "lines")
    firsts = write_scratch(lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")), "lines-first")

    halves = lines.select("h1", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b").select("half")
    some = _bitmap(_marked(halves, "half", _bitmap(shared, "half")).select("h1"), "h1")
    at = F.xxhash64("mark", "pos").alias("at")
    places = _bitmap(_marked(lines.select("h1", at), "h1", some), "at")
    # the second scan cuts words only where a marked line stands
    spread = source.select("mark", F.posexplode(_lines("text")).alias("pos", "line"))
    near = (_named(_marked(spread.select("line", at), "at", places)).select("h1", "h2", "words").dropDuplicates(["h1", "h2"])
            .join(firsts.select("h1", "h2", "first"), ["h1", "h2"]))
    near = write_scratch(near.withColumn("halves", _halves(F.col("words"), F.size("words"))), "lines-near")

    variants = write_scratch(_variants(near.join(_shared_halves(near), ["h1", "h2"])), "lines-variants")
    is_whole = F.col("role") == 2
    keys = (variants.groupBy("key").agg(F.min(F.when(is_whole, F.col("first"))).alias("whole"),
                                        F.min(F.when(~is_whole, F.col("first"))).alias("variant"), F.count("*").alias("members"))
            .filter("members > 1"))
    earliest = F.when(F.col("role") == 1, F.col("whole")).otherwise(F.col("variant"))
    linked = (variants.join(keys, "key").withColumn("earlier", earliest).filter(F.col("earlier") < F.col("first"))
              .groupBy("h1", "h2").agg(F.min("earlier").alias("earlier")))
    target = near.select(F.col("first").alias("earlier"), F.col("words").alias("other"))
    verified = (linked.join(near.select("h1", "h2", "words"), ["h1", "h2"]).join(target, "earlier")
                .filter(within_one_edit(F.col("words"), F.col("other"))).groupBy("h1", "h2").agg(F.min("earlier").alias("earlier")))
    # only lines that occur again or have an earlier neighbour can lose a place
    best = (firsts.join(verified, ["h1", "h2"], "left").filter("n > 1 or earlier is not null")
            .select("h1", "h2", F.least("first", "earlier").alias("best")))
    return (lines.select("id", "mark", "pos", "h1", "h2").join(best, ["h1", "h2"]).filter(F.col("best") < place)
            .groupBy("id", "mark").agg(F.collect_set("pos").alias("removed")))


def _kept_lines(lines, removed):
    """The other lines, joined. The text is cut once: a lambda over the bare ``lines``
    would cut it again for every line it looks up."""
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed)
    both = F.array(F.struct(lines.alias("lines"), places.alias("places")))
    return F.transform(both, lambda x: F.array_join(
        F.transform(x["places"], lambda p: F.element_at(x["lines"], p + 1)), "\n"))[0]


def _with_removed(docs: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """``docs`` with the removed line numbers in ``name`` (null: none)."""
    i, m, mark = fresh("id"), fresh("m"), fresh("mark")
    found = write_scratch(removed_lines(docs, id_col, text_col).withColumnsRenamed({"id": i, "mark": m, "removed": name}),
                          "lines-removed")
    bitmap, marked = _bitmap(found, m), docs.withColumn(mark, F.xxhash64(F.col(text_col)))
    same = _marked(marked, mark, bitmap, False).withColumn(name, F.lit(None).cast("array<int>"))
    hit = _marked(marked, mark, bitmap)
    cut = hit.join(found, hit[id_col].eqNullSafe(found[i]) & (hit[mark] == found[m]), "left").drop(i, m)
    return same.unionByName(cut.select(same.columns)).drop(mark)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, n_lines, n_removed, removed (line numbers from 0)
    and kept (the text without those lines)."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    joined = _with_removed(source, "id", "text", "removed")
    lines = F.split("text", "\n")
    removed = F.coalesce(F.array_sort("removed"), F.array().cast("array<int>"))
    return joined.select(F.col("id").alias(id_col), F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
                         F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"),
                         F.when(F.col("removed").isNull(), F.col("text")).otherwise(_kept_lines(lines, F.col("removed"))).alias("kept"))


def drop_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the removed lines cut out of ``text_col``, all columns as they were; a
    document that lost lines and has no word left goes."""
    removed = fresh("removed")
    joined = _with_removed(docs, id_col, text_col, removed)
    kept = F.when(F.col(removed).isNull(), F.col(text_col)).otherwise(_kept_lines(F.split(text_col, "\n"), F.col(removed)))
    some = F.col(removed).isNull() | F.col(text_col).rlike(r"[^\x20\x09-\x0D]")
    return joined.withColumn(text_col, kept).filter(some).select(*[F.col(f"`{c}`") for c in docs.columns])

"""Spelling variant grouping by permuterm rotations (operator 12).

Every word gets a terminator and all its rotations. Turning the ring so that the
edited character comes last makes both kinds of edit a shared prefix: words that
differ in one character have equal rotations but for their last character, and a
word that lacks a character is, as a whole rotation, the prefix of the longer word's
rotation. So each rotation is sorted under its prefix (the rotation without its last
character, the one that the edit skips), each word also under its whole rotations,
and a scan over the sorted groups emits what each member has there: how many near
words, and the best of the others. No pair of a group is written out.

A group holds at most one word per character of the alphabet and one word without
it, so no group grows with the data. A pair that differs by one deleted character of
a run (``aab``, ``ab``) shares several groups; only the first character of a run
counts it.

Nulls: a null text has no word; the words of a document with a null id are taken as
they stand (no hash to spoil them). Empty texts and tables give no word. Texts are
cut into slices at word ends, so a long text needs memory for one slice's words.
Repeated rows count each time. Ties of n go to the smallest word in code-point
order. Words with the terminator U+0000 have no near word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_scratch

TERMINATOR = "\u0000"
RUN = re.compile("[a-zÀ-ÿ]+")
#: characters of a text taken at once, and words gathered before a batch is given away
SLICE, GATHER = 1 << 20, 200_000


def runs(text: str) -> Iterator[list[str]]:
    """The lower-cased runs of a text, slice by slice (``bytes.lower`` lowers A-Z only)."""
    at = 0
    while at < len(text):
        low = text[at:at + SLICE].encode().lower().decode()
        end = at + len(low)
        while end < len(text) and (m := RUN.match(text[end:end + SLICE].encode().lower().decode())):
            low += m[0]  # a run goes on beyond the slice
            end += m.end()
        at = end
        yield RUN.findall(low)


def spoil(doc_id: str | None, run: str, every: int) -> str:
    """The run, one code point short if the hash of (id, run) says so."""
    if doc_id is None or not every:
        return run
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % every:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1:]


def word_counts(docs: DataFrame, min_length: int = 6, min_count: int = 5, spoil_every: int = 0) -> DataFrame:
    """(word, n): the words of ``min_length`` code points with ``min_count`` occurrences
    or more over all texts. Tasks add up their words before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def batch() -> pa.RecordBatch:
            out = pa.record_batch({"word": pa.array(found.keys(), pa.string()), "n": pa.array(found.values(), pa.int64())})
            found.clear()
            return out

        for rows in batches:
            for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                for part in runs(text or ""):
                    for run, n in Counter(part).items():
                        if len(run) >= min_length:
                            word = spoil(doc_id, run, spoil_every)
                            if len(word) >= min_length:
                                found[word] += n
                    if len(found) >= GATHER:
                        yield batch()
        yield batch()

    partial = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(count, "word string, n bigint")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, skipped, first, n) for each rotation of each word: with its last character
    skipped, and whole (skipped is empty). ``first``: no equal character stands before
    the skipped one."""
    size = F.length("word")
    places = (words.filter(~F.contains("word", F.lit(TERMINATOR))).select("word", "n", size.alias("size"))
              .select("*", F.explode(F.sequence(F.lit(0), 2 * F.col("size"))).alias("j")))
    whole = F.col("j") <= F.col("size")
    k = F.when(whole, F.col("j")).otherwise(F.col("j") - F.col("size") - 1)  # characters before the turn
    cut = places.select("word", "n", "size", k.alias("k"), whole.alias("whole"))
    here = F.expr("substring(word, k + 1, 1)")
    return cut.select(
        F.concat(F.expr("substring(word, if(whole, k + 1, k + 2))"), F.lit(TERMINATOR), F.expr("left(word, k)")).alias("prefix"),
        F.when(F.col("whole"), "").otherwise(here).alias("skipped"),
        (~F.col("whole") & ((F.col("k") == 0) | (F.expr("substring(word, k, 1)") != here))).alias("first"), "n")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n) of each group in which a word is near others."""
    turned = rotations(words).repartition("prefix")
    before, after = (F.substring_index("prefix", TERMINATOR, k) for k in (-1, 1))
    members = turned.select("prefix", "skipped", "first", "n", F.concat(before, "skipped", after).alias("word"))
    group = Window.partitionBy("prefix").orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = F.col("skipped") == ""
    seen = members.select(
        "word", whole.alias("whole"), "first", F.count(F.lit(1)).over(group).alias("size"),
        F.count_if(whole).over(group).alias("wholes"), F.count_if("first").over(group).alias("firsts"),
        *[F.nth_value(c, k).over(group).alias(f"{c}{k}") for c in ("word", "n") for k in (1, 2)])
    top = F.col("word") == F.col("word1")
    near = F.when(F.col("whole"), F.col("firsts")).otherwise(
        F.col("size") - F.col("wholes") - 1 + F.when(F.col("first"), F.col("wholes")).otherwise(0))
    return seen.filter("size > 1").select(
        "word", near.alias("n_near"), F.when(top, F.col("word2")).otherwise(F.col("word1")).alias("best"),
        F.when(top, F.col("n2")).otherwise(F.col("n1")).alias("best_n"))


def variant_forms(words: DataFrame, times: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n): ``form`` is the near word of largest n, if that
    is ``times`` the word's own n or more. ``words`` has distinct words and their n."""
    words = words.select("word", "n").filter("word is not null")
    near = neighbours(words)
    each = (words.withColumns({"n_near": F.lit(0).cast("long"), "best": F.lit(None).cast("string"), "best_n": F.lit(None).cast("long")})
            .unionByName(near.withColumn("n", F.lit(None).cast("long"))))
    one = each.groupBy("word").agg(
        F.max("n").alias("n"), F.sum("n_near").alias("n_near"),
        F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), "best"))).alias("best"))
    form = -F.col("best.m") >= times * F.col("n")
    return one.select("word", "n", "n_near", F.when(form, F.col("best.best")).alias("form"), F.when(form, -F.col("best.m")).alias("form_n"))


def with_roots(forms: DataFrame) -> DataFrame:
    """``forms`` with ``root``, where the forms of forms end. Only words that are some
    word's form are chained, by doubling: n grows with each step, so a chain has no
    more steps than log(largest n), and the rounds are the logarithm of that."""
    forms = write_scratch(forms, "variant-forms")
    ends = forms.filter("form is not null").select(F.col("form").alias("word")).distinct()
    step = forms.filter("form is not null").select("word", F.col("form").alias("to"))
    chain = write_scratch(ends.join(step, "word", "left").select(F.col("word").alias("at"), F.coalesce("to", "word").alias("root")), "variant-chain")
    while True:
        on = chain.select(F.col("at").alias("root"), F.col("root").alias("further"))
        moved = write_scratch(chain.join(on, "root", "left").select("at", F.coalesce("further", "root").alias("root"),
                                                                     (F.col("further") != F.col("root")).alias("moved")), "variant-chain")
        chain = moved.select("at", "root")
        if moved.filter("moved").isEmpty():
            break
    return (forms.join(chain.withColumnRenamed("at", "form"), "form", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def spelling_variants(docs: DataFrame, min_length: int = 6, min_count: int = 5, times: int = 5, spoil_every: int = 0) -> DataFrame:
    """One row per word of ``docs``: word, form, root, n, n_near, form_n. ``spoil_every``
    leaves a code point out of every so many (id, run) pairs, as planted misspellings."""
    words = write_scratch(word_counts(docs, min_length, min_count, spoil_every), "variant-words")
    return with_roots(variant_forms(words, times))

"""CSV records that hold line breaks, read in parallel from one large file.

A split of a file may begin inside a quoted field, and nothing in the split tells. So
each line is taken as a function of the state it starts in (outside or inside quotes):
it ends outside or inside. Lines without a quote keep the state. The lines with quotes
are composed per split, the splits per file (a row per split), and then every split
knows the state it begins in, which of its first lines end a record begun before, and
in which split that record began. Those lines move to that split; in it, running
states cut the lines into records.

A quote opens a field only at the field's start, and text after a closing quote runs on
to the separator, as readers of such files take it.
"""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import maybe_broadcast
from ..session import write_scratch

#: rows of a partition fit in the low bits of monotonically_increasing_id
_ROW = (1 << 33) - 1
MAX_SPLITS = 5_000_000


def _line_ends(line: Column, sep: str) -> tuple[Column, Column]:
    """Does a line that starts outside (inside) quotes end inside them?"""
    s = re.escape(sep)
    quoted = r'[^"]*+(?:""[^"]*+)*+"(?!")'
    field = rf'(?:"{quoted}[^{s}]*+|(?!")[^{s}]*+)'
    rest = rf"(?:{s}{field})*+\z"
    plain = ~F.contains(line, F.lit('"'))
    return (F.when(plain, False).otherwise(~line.rlike(rf"\A{field}{rest}")),
            F.when(plain, True).otherwise(~line.rlike(rf"\A{quoted}[^{s}]*+{rest}")))


def _lines(spark: SparkSession, paths: list[str], sep: str, encoding: str) -> DataFrame:
    raw = spark.read.option("lineSep", "\n").text(paths)
    value = F.col("value") if encoding.upper().replace("-", "") == "UTF8" else F.decode(F.col("value").cast("binary"), encoding)
    outside, inside = _line_ends(F.col("line"), sep)
    return (raw.select(value.alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
                       F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW)).alias("n"))
            .withColumns({"if_out": outside, "if_in": inside}))


def _after(start: Column, window) -> Column:
    """State (True: inside) behind the rows of ``window`` if it is ``start`` before them.

    A row that ends alike from either start sets the state; one that turns it round
    counts; the state is the last one set, turned by the turns since."""
    sets, turns = F.col("if_out") == F.col("if_in"), (F.col("if_out") & ~F.col("if_in")).cast("long")
    # a setting row's own end, and the turns up to it
    told = F.last(F.when(sets, F.struct(F.col("if_out").alias("state"), F.col("turned"))), ignorenulls=True).over(window)
    turned = F.coalesce(F.sum(turns).over(window), F.lit(0))
    return F.when(told.isNull(), start.cast("long") + turned).otherwise(told["state"].cast("long") + turned - told["turned"]) % 2 == 1


def _turned(df: DataFrame, window) -> DataFrame:
    return df.withColumn("turned", F.sum((F.col("if_out") & ~F.col("if_in")).cast("long")).over(window))


def _splits(lines: DataFrame) -> DataFrame:
    """A row per split: file, at, ordinal, starts (inside quotes?), owner (ordinal of the
    split whose record it goes on with) and until (the last line of that record here)."""
    upto = Window.partitionBy("file", "at").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    quoted = _turned(lines.filter(F.contains("line", F.lit('"'))).drop("line"), upto)
    states = quoted.select("file", "at", "n", _after(F.lit(False), upto).alias("out"), _after(F.lit(True), upto).alias("in"))
    told = states.groupBy("file", "at").agg(F.max_by("out", "n").alias("if_out"), F.max_by("in", "n").alias("if_in"),
                                            F.min(F.when(~F.col("in"), F.col("n"))).alias("until"))
    # a split without a quote keeps the state
    every = lines.select("file", "at").distinct().join(told, ["file", "at"], "left").fillna({"if_out": False, "if_in": True})
    in_file = Window.partitionBy("file").orderBy("at")
    every = _turned(every, in_file.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    every = every.withColumn("starts", _after(F.lit(False), before)).withColumn("ordinal", F.row_number().over(Window.orderBy("file", "at")) - 1)
    # a split that lies inside one field as a whole starts no record
    begins = ~F.col("starts") | F.col("until").isNotNull()
    return every.withColumn("owner", F.last(F.when(begins, F.col("ordinal")), ignorenulls=True).over(before)).select(
        "file", "at", "ordinal", "starts", "owner", "until")


def has_line_breaks(spark: SparkSession, paths: list[str], sep: str = ",", encoding: str = "UTF-8") -> bool:
    """Does a line that starts outside quotes end inside? One scan; ends at the first such line."""
    return not _lines(spark, paths, sep, encoding).filter("if_out").select("n").limit(1).isEmpty()


def _header(lines: DataFrame) -> str | None:
    """The first record of the first file: its first lines, until a record is whole."""
    first = lines.filter("at = 0").agg(F.min("file")).first()[0]
    n = 1
    while first is not None:
        # a header's lines, not the file's: twice as many each time
        got = lines.filter((F.col("at") == 0) & (F.col("file") == first)).orderBy("n").limit(n).select("line", "if_out", "if_in").collect()
        inside = False
        for k, row in enumerate(got):
            inside = row["if_in"] if inside else row["if_out"]
            if not inside:
                return "\n".join(r["line"] for r in got[:k + 1]).removeprefix("\ufeff").removesuffix("\r")
        if len(got) < n:
            return "\n".join(r["line"] for r in got)
        n *= 2
    return None


def read_quoted_csv(spark: SparkSession, paths: list[str], sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """The files' rows in file order as text columns named by the first file's header,
    empty fields null; written once in the shared folder, as later passes read it again."""
    lines = _lines(spark, paths, sep, encoding)
    header = _header(lines)
    if header is None:
        return spark.createDataFrame([], T.StructType([]))
    given = next(csv.reader([header], delimiter=sep), [])
    low = [c.lower() for c in given]
    # names as the plain reader makes them: empty and repeated ones get their place
    names = [f"_c{k}" if not c else f"{c}{k}" if low.count(c.lower()) > 1 else c for k, c in enumerate(given)]

    splits = maybe_broadcast(write_scratch(_splits(lines), "csv-splits"), MAX_SPLITS)
    goes_on = F.col("starts") & (F.col("until").isNull() | (F.col("n") <= F.col("until")))
    placed = lines.join(splits, ["file", "at"]).withColumn("home", F.when(goes_on, F.col("owner")).otherwise(F.col("ordinal")))
    home = Window.partitionBy("home").orderBy("ordinal", "n")
    upto = home.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # what is left of a split starts outside
    cut = _turned(placed.repartitionByRange("home").select("home", "ordinal", "n", "at", "line", "if_out", "if_in"), upto)
    cut = cut.withColumn("opens", ~_after(F.lit(False), home.rowsBetween(Window.unboundedPreceding, -1)))
    cut = cut.withColumn("record", F.sum(F.col("opens").cast("long")).over(upto))
    whole = cut.groupBy("home", "record").agg(F.sort_array(F.collect_list(F.struct("ordinal", "n", "line"))).alias("parts"), F.min("at").alias("at"))
    text = F.regexp_replace(F.array_join(F.transform("parts", lambda p: p["line"]), "\n"), r"\r\z", "")
    is_header = (F.col("at") == 0) & (F.col("record") == 1)
    rows = whole.sortWithinPartitions("home", "record").select(is_header.alias("header"), text.alias("text")).filter("not header and length(trim(text)) > 0")
    ddl = ", ".join("`" + c.replace("`", "``") + "` string" for c in names)
    options = {"sep": sep, "escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    return write_scratch(rows.select(F.from_csv("text", ddl, options).alias("r")).select("r.*"), "csv-rows")

"""PII: E1 detect (first values per column), E1b full-scan counts, E2 mask.

Patterns are the reference's Python patterns run by Java regex with ``(?U)``,
which makes ``\\d``, ``\\s`` and ``\\b`` Unicode-aware as they are in Python.
All matching is ``rlike`` / ``regexp_replace`` inside whole-stage codegen.

Where only the presence of a match counts, shorter patterns say the same: an
e-mail needs an ``@`` (a plain substring test first) and one character before it,
a phone number's ``+`` is optional, and a 12-digit id is always a phone match too,
so it is looked for in those values only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kinds import is_numeric, is_temporal, order_column, qcol
from ..functions.patterns import EMAIL_MASK, ID_MASK, PII_PATTERNS, java_unicode


def _pii_columns(df: DataFrame, columns: list[str] | None, compat: bool) -> list[str]:
    if columns is not None:
        return columns
    # numbers and timestamps are skipped by default: the phone pattern matches
    # every ISO date and any number with 8+ digits
    return [f.name for f in df.schema.fields
            if compat or not (is_numeric(f.dataType) or is_temporal(f.dataType) or isinstance(f.dataType, T.BooleanType))]


def _text_of(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        # Python prints floats plainly up to 1e16, Java switches to 1.0E7 notation: format
        # plainly before matching (whole numbers keep one decimal, as Python shows them)
        big = F.abs(c) >= 1e7
        plain = F.regexp_replace(F.format_string("%.10f", c), "0+$", "")
        return (F.when((c == F.floor(c)) & (F.abs(c) < 1e16), F.format_string("%.1f", c))
                .when(big, plain).otherwise(c.cast("string")))
    return c.cast("string")


def _literal(v) -> Column:
    """A collected order-key value as a literal (structs field by field)."""
    if hasattr(v, "asDict"):
        return F.struct(*[_literal(x).alias(k) for k, x in v.asDict().items()])
    return F.lit(v)


def _start_at_digit(pattern: str) -> str:
    """The same matches; word borders are only tested where a digit follows."""
    return java_unicode(r"(?=\d)" + pattern)


def pii_flags(c: Column) -> dict[str, Column]:
    """Per pattern: does ``c`` hold a match of it?"""
    email = c.contains("@") & c.rlike(r"[A-Za-z0-9._%+-]@[A-Za-z0-9.-]+\.[A-Za-z]{2}")
    phone = c.rlike(java_unicode(r"\d[\d\s\-]{6,}\d"))
    return {"email": email, "phone_international": phone,
            "aadhar_like": phone & c.rlike(_start_at_digit(PII_PATTERNS["aadhar_like"]))}


def any_pii(c: Column) -> Column:
    flags = pii_flags(c)
    return flags["phone_international"] | flags["email"]  # every 12-digit id is a phone match


def pii_detect(df: DataFrame, columns: list[str] | None = None, order_by=None, sample: int | None = 300,
               max_preview: int = 5, compat: bool = False) -> DataFrame:
    """Per column, the first ``sample`` non-missing values (in row order) are
    checked; a value counts if any pattern is found. Reports the first
    ``max_preview`` distinct matching values in order and their count.

    Output ``(column, count_examples, examples array<string>)``, detected
    columns only. ``sample=None`` checks every value.

    Texts never travel in bulk: a key-only pass (``row_number <= sample``,
    a WindowGroupLimit over ``(column, order)``) finds each column's cut-off
    position (one scalar per column); texts after it are nulled before the
    unpivot, and only matching ones -- at most ``sample`` per column over the
    whole table -- reach the final step.
    Without a sample, matching values are grouped by a whole-text fingerprint
    and only the ``max_preview`` example texts are read back.
    """
    cols = _pii_columns(df, columns, compat)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, count_examples bigint, examples array<string>")
    df, order, _ = order_column(df, order_by)
    types = {f.name: f.dataType for f in df.schema.fields}
    if sample is not None:
        present = (df.select(order.alias("_o"), F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), qcol(c).isNotNull().alias("p")) for c in cols])).alias("kv"))
            .where("kv.p").select("_o", "kv.column"))
        rn = F.row_number().over(Window.partitionBy("column").orderBy("_o"))
        # one cut-off per column: schema-sized, so it comes back as literals
        cuts = {r["column"]: r["_cut"] for r in
                present.withColumn("_rn", rn).where(F.col("_rn") <= sample).groupBy("column")
                .agg(F.max("_o").alias("_cut")).collect()}
        cols = [c for c in cols if cuts.get(c) is not None]
        if not cols:
            return df.sparkSession.createDataFrame([], "column string, count_examples bigint, examples array<string>")
        within = {c: order <= _literal(cuts[c]) for c in cols}
        sampled = (df.select(order.alias("_o"), F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.when(within[c], _text_of(qcol(c), types[c])).alias("v"))
            for c in cols])).alias("kv")).select("_o", "kv.column", "kv.v").where(F.col("v").isNotNull()))
        hits = sampled.where(any_pii(F.col("v"))).groupBy("column", "v").agg(F.min("_o").alias("_first"))
        top = F.row_number().over(Window.partitionBy("column").orderBy("_first"))
        picked = hits.withColumn("_r", top).where(F.col("_r") <= max_preview)
    else:
        from .profile import value_key
        long = (df.select(order.alias("_o"), F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), _text_of(qcol(c), types[c]).alias("v")) for c in cols
        ])).alias("kv")).select("_o", "kv.column", "kv.v").where(F.col("v").isNotNull()))
        keyed = long.where(any_pii(F.col("v"))).withColumn("k", value_key(F.col("v")))
        firsts = keyed.groupBy("column", "k").agg(F.min("_o").alias("_first"))
        top = F.row_number().over(Window.partitionBy("column").orderBy("_first"))
        first_rows = firsts.withColumn("_r", top).where(F.col("_r") <= max_preview)  # <= max_preview per column
        # fetch by (column, key, first position): the keys came from matching rows, no regex needed here
        texts = (long.withColumn("k", value_key(F.col("v")))
                 .join(F.broadcast(first_rows.select("column", "k", F.col("_first").alias("_o"))),
                       on=["column", "k", "_o"]).groupBy("column", "k").agg(F.min("v").alias("v")))
        picked = first_rows.join(texts, on=["column", "k"])
    return (picked.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("_r", "v"))).alias("_vals"))
            .select("column", F.size("_vals").cast("bigint").alias("count_examples"),
                    F.transform("_vals", lambda s: s["v"]).alias("examples")))


def pii_counts(df: DataFrame, columns: list[str] | None = None, compat: bool = False) -> DataFrame:
    """Rows matching each pattern per column over the whole table, in one
    aggregate: ``(column, pattern, n_match)``."""
    cols = _pii_columns(df, columns, compat)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, pattern string, n_match bigint")
    types = {f.name: f.dataType for f in df.schema.fields}
    pairs = [(c, name, flag) for c in cols for name, flag in pii_flags(_text_of(qcol(c), types[c])).items()]
    agg = df.agg(*[F.count_if(flag).alias(f"m{i}") for i, (_, _, flag) in enumerate(pairs)])
    return agg.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(name).alias("pattern"), F.col(f"m{i}").alias("n_match"))
        for i, (c, name, _) in enumerate(pairs)])).alias("s")).select("s.*")


def mask_text(c: Column, mask_phone: bool = False) -> Column:
    """E2 on one column: e-mails, then 12-digit ids; phones only if asked."""
    out = F.when(c.contains("@"), F.regexp_replace(c, PII_PATTERNS["email"], EMAIL_MASK)).otherwise(c)
    out = F.regexp_replace(out, _start_at_digit(PII_PATTERNS["aadhar_like"]), ID_MASK)
    if mask_phone:
        out = F.regexp_replace(out, java_unicode(PII_PATTERNS["phone_international"]), "[PHONE_MASKED]")
    return out


def pii_mask(df: DataFrame, columns: list[str], mask_phone: bool = False) -> DataFrame:
    """Mask the given columns; missing cells stay missing (the reference
    writes the text ``nan``)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[mask_text(_text_of(qcol(c), types[c]), mask_phone).alias(c) if c in columns else qcol(c)
                       for c in df.columns])


def mask_detected(df: DataFrame, detected: DataFrame, mask_phone: bool = False) -> DataFrame:
    """E1 -> E2: mask only the columns E1 reported (a per-column list)."""
    cols = [r["column"] for r in detected.select("column").collect()]
    return pii_mask(df, cols, mask_phone)

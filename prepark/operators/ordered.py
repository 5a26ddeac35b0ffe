"""Order-dependent operators that never pull a table into one task.

A window without ``partitionBy`` sorts the whole table in a single task. Here
rows are first cut into contiguous *blocks* of the order key (balanced by
approximate quantiles, so a dense key range or a hot group is split), the
window runs inside each block, and a small per-block table carries values
across block borders. The per-block table has at most ``n_blocks`` rows per
group, which is what makes the final join safe to broadcast in the global case.

Used by C5 (forward/backward fill), F4 (cumulative counts for ROC AUC) and the
exact quantiles of C1/D5.
"""

from __future__ import annotations

from collections import Counter

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kinds import qcol
from ..session import write_scratch

BLK = "_blk"


def default_blocks(df: DataFrame) -> int:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(1, min(20000, 4 * parts))


def _as_double(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, (T.TimestampType,)):
        return F.unix_micros(c).cast("double")
    if isinstance(dt, T.TimestampNTZType):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(dt, T.DateType):
        return F.unix_date(c).cast("double")
    return c.cast("double")


def _block_key(df: DataFrame, order: Column) -> Column:
    """A number key as a double; missing keys come first."""
    return F.coalesce(_as_double(order, df.select(order.alias("_o")).schema["_o"].dataType), F.lit(float("-inf")))


def _number_splits(df: DataFrame, order: Column, n_blocks: int) -> tuple[list[float] | None, int]:
    """Bucket edges of ~equal-count blocks of a number key, and how many of them at most
    are one value (a value on several edges holds several blocks' rows)."""
    if n_blocks <= 1:
        return None, 0
    key = _block_key(df, order)
    probs = [i / n_blocks for i in range(1, n_blocks)]
    accuracy = max(1000, 2 * n_blocks)  # block edges need not be exact: a small sketch per task
    row = df.select(F.percentile_approx(key, probs, accuracy).alias("b"), F.count(F.lit(1)).alias("n")).first()
    edges = [float(b) for b in (row["b"] or []) if b is not None and abs(float(b)) != float("inf")]
    hot = max(Counter(edges).values(), default=0) if row["n"] > 4 * n_blocks else 0  # a few rows repeat edges anyway
    return [float("-inf")] + sorted(set(edges)) + [float("inf")] if edges else None, hot


def block_splits(df: DataFrame, order: Column, n_blocks: int | None = None) -> list[float] | None:
    """Edges for ``assign_blocks`` from a superset of its keys (before a dedupe, say); None
    where it has to look at the keys itself."""
    if not _is_number(df.select(order.alias("_o")).schema["_o"].dataType):
        return None
    splits, hot = _number_splits(df, order, n_blocks or default_blocks(df))
    return splits if hot < HOT_EDGES else None


#: keys drawn per block for the edges of keys that are no number, and characters of a text key that an edge keeps
DRAWN_PER_BLOCK, EDGE_TEXT = 64, 256
#: a number key that is this many edges has its blocks cut inside the value
HOT_EDGES = 2


def _is_number(dt: T.DataType) -> bool:
    return isinstance(dt, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType))


def _whole_key(df: DataFrame, order: Column) -> Column:
    """The order key and, for ties, a hash of the row: rows that agree in it are equal rows,
    in any order, and a row has the same key however often its plan runs."""
    return F.struct(order.alias("k"), F.xxhash64(*[qcol(c) for c in df.columns]).alias("h"))


def _short(c: Column, dt: T.DataType) -> Column:
    """The key, its texts cut short: still a place among the keys."""
    if isinstance(dt, T.StructType):
        return F.struct(*[_short(c.getField(f.name), f.dataType).alias(f.name) for f in dt.fields])
    return F.left(c, F.lit(EDGE_TEXT)) if isinstance(dt, (T.StringType, T.VarcharType, T.CharType)) else c


def _edges(df: DataFrame, order: Column, n_blocks: int) -> DataFrame:
    """One row: ``edges``, the sorted edges of ``n_blocks`` ranges of the whole key, from a
    sample of some DRAWN_PER_BLOCK keys per block, however many rows there are."""
    share = DRAWN_PER_BLOCK * n_blocks / max(1, df.count())
    # drawn first: the keys of the other rows are not worked out
    drawn = (df if share >= 1 else df.filter(F.rand(17) < share)).select(_whole_key(df, order).alias("key"))
    drawn = drawn.select(_short(F.col("key"), drawn.schema["key"].dataType).alias("key"))
    # a bounded sample: it may be ranked in one task
    ranked = drawn.select("key", F.ntile(n_blocks).over(Window.orderBy("key")).alias("tile")).groupBy("tile").agg(F.array_min(F.collect_list("key")).alias("edge"))
    return ranked.filter("tile > 1").agg(F.sort_array(F.collect_list("edge")).alias("edges"))


def _block_by_edges(df: DataFrame, order: Column, n_blocks: int, spread: bool) -> DataFrame:
    """``BLK`` from the edges of the whole key: how many of them lie before a row, by halving.

    The edges are a subquery's value, never a column: a row that carried them would be
    copied with all of them. Equal rows that hold several edges may stand in any block
    between them; ``spread`` deals them out (for a caller that runs the plan once)."""
    edges = write_scratch(_edges(df, order, n_blocks), "block-edges").scalar()  # drawn once
    key, own = F.col("_key"), df.columns

    def place(rows: DataFrame, name: str, before) -> DataFrame:
        rows, step = rows.withColumn(name, F.lit(0)), 1 << n_blocks.bit_length()
        while step := step >> 1:
            # behind the last edge there is none: null, so the row stays
            rows = rows.withColumn(name, F.col(name) + F.when(before(F.get(edges, F.col(name) + (step - 1)), key), step).otherwise(0))
        return rows

    rows = place(df.withColumn("_key", _whole_key(df, order)), "_upto", lambda edge, k: edge <= k)
    block = F.col("_upto")
    if spread:
        rows = place(rows, "_below", lambda edge, k: edge < k)
        block = F.col("_below") + F.pmod(F.monotonically_increasing_id(), F.col("_upto") - F.col("_below") + 1)
    return rows.select(*[qcol(c) for c in own], block.cast("double").alias(BLK))


def assign_blocks(df: DataFrame, order: Column, n_blocks: int | None = None,
                  splits: list[float] | None = None, spread: bool = False) -> tuple[DataFrame, list[str]]:
    """Add block columns so that each block is a contiguous range of ``order``.

    Returns the frame and the names of the block columns, themselves in order. Number
    keys block by approximate quantiles (one extra pass that reads that column only, unless
    ``splits`` are given). Text keys, structs and number keys of which one value holds
    several blocks' rows block by edges drawn from the whole key, ties told apart by a
    hash of the row, so a hot leading value or a hot key spreads too.
    """
    n = n_blocks or default_blocks(df)
    if splits is None:
        whole_key = not _is_number(df.select(order.alias("_o")).schema["_o"].dataType)
        if not whole_key:
            splits, hot = _number_splits(df, order, n)
            whole_key = hot >= HOT_EDGES
        if whole_key and n > 1:
            return _block_by_edges(df, order, n, spread), [BLK]
        if n <= 1 or not splits:
            return df.withColumn(BLK, F.lit(0.0)), [BLK]
    df = df.withColumn("_blk_key", _block_key(df, order))
    df = Bucketizer(splits=splits, inputCol="_blk_key", outputCol=BLK, handleInvalid="keep").transform(df)
    return df.drop("_blk_key"), [BLK]


def _group_cols(partition_by: list[str] | None) -> list[Column]:
    return [qcol(c) for c in (partition_by or [])]


def _block_join(df: DataFrame, small: DataFrame, keys: list[str], bounded: bool) -> DataFrame:
    """Join per-block carries back; a missing group key is a group. In the global case
    ``small`` has at most ``n_blocks`` rows (a proven bound), so it is broadcast."""
    own = {c: f"_k{i}" for i, c in enumerate(keys)}
    side = small.withColumnsRenamed(own)
    on = F.lit(True)
    for c, k in own.items():
        on = on & qcol(c).eqNullSafe(F.col(k))
    return df.join(F.broadcast(side) if bounded else side, on, "left").drop(*own.values())


def ffill_bfill(df: DataFrame, columns: list[str], order: Column,
                partition_by: list[str] | None = None, n_blocks: int | None = None,
                backward: bool = True, splits: list[float] | None = None) -> DataFrame:
    """Forward fill then backward fill of ``columns`` in ``order``.

    Backward fill after forward fill only touches the leading nulls of a
    group, so it is the first non-null value of the group: no second window.
    """
    if not columns:
        return df
    src_cols = df.columns
    df, blk_names = assign_blocks(df, order, n_blocks, splits, spread=True)
    blk_cols = [F.col(c) for c in blk_names]
    gcols = _group_cols(partition_by)
    ties = F.xxhash64(*[qcol(c) for c in src_cols])  # the same order of ties as that of the blocks
    by_order = Window.partitionBy(*gcols, *blk_cols).orderBy(order, ties)
    in_block = by_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = df.select(
        *[qcol(c) for c in src_cols], *blk_cols, F.lead(F.lit(1)).over(by_order).isNull().alias("_end"),
        *[F.last(qcol(c), ignorenulls=True).over(in_block).alias(f"_loc_{i}") for i, c in enumerate(columns)],
        *[F.first(qcol(c), ignorenulls=True).over(in_block).alias(f"_head_{i}") for i, c in enumerate(columns) if backward])
    # written once: the last row of a block is at hand by its flag, so what blocks hand on needs
    # neither a second run of the input's plan nor an aggregate over its cells
    local = write_scratch(local, "fill-blocks")
    ends = F.struct(*[F.col(f"_loc_{i}") for i, _ in enumerate(columns)], *[F.col(f"_head_{i}") for i, _ in enumerate(columns) if backward])
    per_block = local.filter("_end").groupBy(*gcols, *blk_cols).agg(F.collect_list(ends)[0].alias("_e")).select(*[c for c in partition_by or []], *blk_cols, "_e.*")
    across = Window.partitionBy(*gcols).orderBy(*blk_cols)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    whole = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carry_cols = []
    for i, _ in enumerate(columns):
        carry_cols.append(F.last(F.col(f"_loc_{i}"), ignorenulls=True).over(before).alias(f"_carry_{i}"))
        if backward:
            carry_cols.append(F.first(F.col(f"_head_{i}"), ignorenulls=True).over(whole).alias(f"_first_{i}"))
    small = per_block.select(*gcols, *blk_cols, *carry_cols)
    keys = list(partition_by or []) + blk_names
    joined = _block_join(local, small, keys, bounded=not partition_by)
    out = []
    for c in src_cols:
        if c in columns:
            i = columns.index(c)
            parts = [F.col(f"_loc_{i}"), F.col(f"_carry_{i}")]
            if backward:
                parts.append(F.col(f"_first_{i}"))
            out.append(F.coalesce(*parts).alias(c))
        else:
            out.append(qcol(c))
    return joined.select(*out)


def prefix_sums(df: DataFrame, columns: list[str], order: Column,
                partition_by: list[str] | None = None, n_blocks: int | None = None,
                suffix: str = "_cum", blocks: list[str] | None = None) -> DataFrame:
    """Inclusive running sums of ``columns`` in ``order`` (per ``partition_by``),
    computed blockwise. Adds ``<col><suffix>`` columns. ``blocks`` names block
    columns the caller already assigned (contiguous in ``order`` per group)."""
    src_cols = [c for c in df.columns if c not in (blocks or [])]
    if blocks:
        blk_names = list(blocks)
    else:
        df, blk_names = assign_blocks(df, order, n_blocks)
    blk_cols = [F.col(c) for c in blk_names]
    gcols = _group_cols(partition_by)
    in_block = (Window.partitionBy(*gcols, *blk_cols).orderBy(order)
                .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = df.select(
        *[qcol(c) for c in src_cols], *blk_cols,
        *[F.sum(qcol(c)).over(in_block).alias(f"_loc_{i}") for i, c in enumerate(columns)],
    )
    per_block = df.groupBy(*gcols, *blk_cols).agg(
        *[F.sum(qcol(c)).alias(f"_tot_{i}") for i, c in enumerate(columns)])
    before = Window.partitionBy(*gcols).orderBy(*blk_cols).rowsBetween(Window.unboundedPreceding, -1)
    small = per_block.select(
        *gcols, *blk_cols,
        *[F.coalesce(F.sum(F.col(f"_tot_{i}")).over(before), F.lit(0)).alias(f"_carry_{i}")
          for i, _ in enumerate(columns)])
    keys = list(partition_by or []) + blk_names
    joined = _block_join(local, small, keys, bounded=not partition_by)
    return joined.select(
        *[qcol(c) for c in src_cols],
        *[(F.col(f"_loc_{i}") + F.col(f"_carry_{i}")).alias(f"{c}{suffix}") for i, c in enumerate(columns)],
    )


#: size of the quantile sketches (rank error about a thousandth), and blocks at least
SKETCH_K, QUANTILE_BLOCKS = 2048, 256


def _clean(c: str) -> Column:
    x = qcol(c).cast("double")
    return F.when(~F.isnan(x), x + F.lit(0.0))  # one zero


def sketch_of(c: str) -> Column:
    """A mergeable sketch of a number column (KLL), to ride along in an aggregate."""
    return F.kll_sketch_agg_double(_clean(c), F.lit(SKETCH_K))


def edges_of(sketch: Column, n_values: Column, n_blocks: int) -> Column:
    """Inner edges of ``n_blocks`` blocks of about equal counts from such a sketch."""
    ranks = F.array(*[F.lit(i / n_blocks) for i in range(1, n_blocks)])
    return F.when(n_values > 0, F.array_distinct(F.kll_sketch_get_quantile_double(sketch, ranks)))


def quantile_blocks(df: DataFrame) -> int:
    return min(8 * QUANTILE_BLOCKS, max(QUANTILE_BLOCKS, default_blocks(df)))


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float], n_blocks: int | None = None,
                    max_exact_distinct: int | None = None, edges: dict[str, list[float] | None] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation (pandas/numpy default), by selection.

    1. A KLL sketch of each column gives the edges of value blocks (unless a caller had
       the sketches in a pass of its own and gives ``edges``).
    2. One counting pass: values per block, which tells the block and the place in it of
       each wanted rank. Only these counts are shuffled.
    3. The values of those blocks alone are counted by value and ranked.

    One way for every size; the sketch only decides how even the blocks are. Returns
    ``(column, prob, value)``; an all-missing column has no rows. ``max_exact_distinct`` is
    kept for callers and has no effect.
    """
    n_blocks = max(2, n_blocks or quantile_blocks(df))
    if edges is None:
        got = (df.agg(*[sketch_of(c).alias(f"s{i}") for i, c in enumerate(columns)], *[F.count(_clean(c)).alias(f"n{i}") for i, c in enumerate(columns)])
               .select(*[edges_of(F.col(f"s{i}"), F.col(f"n{i}"), n_blocks).alias(f"e{i}") for i, _ in enumerate(columns)]).first())
        edges = {c: got[f"e{i}"] for i, c in enumerate(columns)}
    spark = df.sparkSession
    columns = [c for c in columns if edges.get(c)]
    if not columns:
        return spark.createDataFrame([], "column string, prob double, value double")
    # the sketch's outer values may miss the infinite ends: blocks run from -inf to inf, the last one closed
    splits = [[float("-inf"), *sorted(e for e in edges[c] if abs(e) != float("inf")), float("inf")] for c in columns]
    wide = df.select(*[_clean(c).alias(f"_v{i}") for i, c in enumerate(columns)])
    wide = Bucketizer(splitsArray=splits, inputCols=[f"_v{i}" for i in range(len(columns))],
                      outputCols=[f"_k{i}" for i in range(len(columns))], handleInvalid="keep").transform(wide)
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.when(F.col(f"_v{i}").isNotNull(), F.col(f"_k{i}")).alias("k")) for i in range(len(columns))]))
    counts = wide.select(cells.alias("x")).select("x.*").filter("k is not null").groupBy("c", "k").agg(F.count(F.lit(1)).alias("n"))
    in_column = Window.partitionBy("c")
    upto = in_column.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.select("c", "k", "n", F.sum("n").over(upto).alias("cum"), F.sum("n").over(in_column).alias("all"))
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probs]))
    at = F.col("prob") * (F.col("all") - 1)
    places = (ranked.select("*", wanted.alias("prob")).select("*", at.alias("pos"), (F.col("cum") - F.col("n")).alias("first"))
              .select("*", F.explode(F.array(F.floor("pos"), F.ceil("pos"))).alias("rank"))
              .filter("rank >= first and rank < cum").select("c", "k", "prob", "pos", (F.col("rank") - F.col("first")).alias("place"),
                                                             (F.col("rank") > F.col("pos")).alias("upper")).distinct())
    found = places.collect()  # two rows per column and probability
    blocks = {}
    for r in found:
        blocks.setdefault(r["c"], set()).add(r["k"])
    picked = F.filter(F.array(*[F.when(F.col(f"_v{i}").isNotNull() & F.col(f"_k{i}").isin(sorted(ks)), F.struct(
        F.lit(i).alias("c"), F.col(f"_k{i}").alias("k"), F.col(f"_v{i}").alias("v"))) for i, ks in blocks.items()]), lambda x: x.isNotNull())
    values = wide.select(F.explode(picked).alias("x")).select("x.*").groupBy("c", "k", "v").agg(F.count(F.lit(1)).alias("n"))
    by_value = Window.partitionBy("c", "k").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = values.withColumn("cum", F.sum("n").over(by_value))
    targets = spark.createDataFrame([tuple(r) for r in found], places.schema)
    hits = (ranked.join(F.broadcast(targets), ["c", "k"]).filter((F.col("place") >= F.col("cum") - F.col("n")) & (F.col("place") < F.col("cum")))
            .groupBy("c", "prob", "pos").agg(F.max(F.when(~F.col("upper"), F.col("v"))).alias("lo"), F.max(F.when(F.col("upper"), F.col("v"))).alias("hi")))
    hi = F.coalesce("hi", "lo")
    value = F.when(F.col("lo") == hi, F.col("lo")).otherwise(F.col("lo") + (F.col("pos") - F.floor("pos")) * (hi - F.col("lo")))
    names = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("c") + 1)
    return hits.select(names.alias("column"), "prob", value.alias("value"))

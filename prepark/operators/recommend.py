"""Recommender and similarity: G1 user cosine, G2 item scores, G3 similar items,
G4 wide matrix to long ratings.

The reference builds dense matrices (and a full n x n similarity for one
row). Here ratings are a sparse long table ``(user, item, rating)``: the
query user's row is joined on item, one grouped pass gives every user's dot
product and norm, and item scores are one more join and grouped sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kinds import qcol
from ..session import materialize, write_scratch
from .joins import DEFAULT_MAX_BROADCAST_ROWS, maybe_broadcast


def matrix_long(df: DataFrame, key: str, columns: list[str] | None = None, user_col: str = "user",
                item_col: str = "item", rating_col: str = "rating", drop_zeros: bool = True) -> DataFrame:
    """Wide key-indexed matrix -> ``(user, item, rating)``; missing counts
    as 0, and zeros are dropped unless asked (they add nothing to any dot
    product, but keeping them keeps all-zero users known)."""
    cols = columns if columns is not None else [c for c in df.columns if c != key]
    long = df.select(qcol(key).alias(user_col), *[qcol(c).cast("double").alias(c) for c in cols]).unpivot(
        user_col, cols, item_col, rating_col)
    long = long.withColumn(rating_col, F.coalesce(qcol(rating_col), F.lit(0.0)))
    return long.where(qcol(rating_col) != 0) if drop_zeros else long


def _user_row(ratings: DataFrame, user_id, user_col: str, item_col: str, rating_col: str) -> tuple[DataFrame, int, float]:
    """The query user's items, written once to the checkpoint folder (the
    ratings plan may be an expensive join), with their count and norm."""
    row = materialize(ratings.where(qcol(user_col) == F.lit(user_id)).select(item_col, qcol(rating_col).alias("_q")))
    st = row.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.sum(F.col("_q") * F.col("_q"))).alias("norm")).first()
    if st["n"] == 0:  # a user whose ratings are all 0 keeps zero rows (drop_zeros=False)
        raise KeyError(f"user {user_id!r} has no ratings")
    return row, st["n"], st["norm"] or 0.0


def user_similarity(ratings: DataFrame, user_id, user_col: str = "user", item_col: str = "item",
                    rating_col: str = "rating") -> DataFrame:
    """G1: cosine similarity of ``user_id`` to every user (itself = 1; a zero
    vector gives 0). One grouped pass computes all dot products and norms.

    The query row (one user's items) is checkpointed once and broadcast only
    under a counted size bound.
    """
    q, q_rows, q_norm = _user_row(ratings, user_id, user_col, item_col, rating_col)
    q_side = F.broadcast(q) if q_rows <= DEFAULT_MAX_BROADCAST_ROWS else q
    per_user = (ratings.join(q_side, on=item_col, how="left")
                .groupBy(user_col)
                .agg(F.sum(qcol(rating_col) * F.coalesce(F.col("_q"), F.lit(0.0))).alias("_dot"),
                     F.sqrt(F.sum(qcol(rating_col) * qcol(rating_col))).alias("_norm")))
    denom = F.col("_norm") * F.lit(float(q_norm))
    return per_user.select(user_col, F.when(denom > 0, F.col("_dot") / denom).otherwise(F.lit(0.0)).alias("similarity"))


def recommend(ratings: DataFrame, user_id=None, top_k: int = 10, user_col: str = "user", item_col: str = "item",
              rating_col: str = "rating", users: list | None = None) -> DataFrame:
    """Item scores ``sum_u sim(u) * rating(u, i)``, highest first, top k. With ``users``
    the same for each of them in one plan, in a column ``for_user`` (``recommend_users``).

    The ratings (often a join) are written once; every pass reads that table.

    Items the user already has stay in (as in the reference); ties go to the
    smaller item id. Every item of the matrix is a candidate (score 0 if no
    similar user rated it). Only users with a similarity are joined; that side
    is broadcast only after a size check.
    """
    ratings = write_scratch(ratings.select(user_col, item_col, rating_col), "ratings")
    if users is not None:
        who = ratings.sparkSession.createDataFrame([(u,) for u in dict.fromkeys(users)], T.StructType([T.StructField("for_user", ratings.schema[user_col].dataType)]))
        return recommend_users(ratings, who, top_k, user_col, item_col, rating_col)
    return _recommend(ratings, user_id, top_k, user_col, item_col, rating_col)


#: users (or raters) of one item that meet in one join key; an item with more has its ratings dealt over several
HOT_RATINGS = 50_000


def recommend_users(ratings: DataFrame, users: DataFrame, top_k: int = 10, user_col: str = "user", item_col: str = "item",
                    rating_col: str = "rating") -> DataFrame:
    """G2 for every user of ``users`` (column ``for_user``): (for_user, item, score), the
    ``top_k`` items of each, in one plan with the same few jobs for any number of users.

    1. The users' own rows are joined with all ratings on the item. An item with many
       ratings has them dealt over salted keys; the users' rows of it go to each. Dot
       products are summed where they arise and once more by (user, other).
    2. Similarities meet the others' ratings by other user and are summed by (user, item);
       the best k are cut per task before they meet.
    3. Items that no similar user rated count 0 and only fill up places, smallest ids
       first. A user with ``top_k`` items above 0 needs none; for the others the matrix's
       ids are looked at from the smallest, as many as the user's scored items and k.

    Users without ratings have no rows; scores, ties and zeros as in ``recommend``."""
    base = ratings.select(qcol(user_col).alias("u"), qcol(item_col).alias("i"), qcol(rating_col).cast("double").alias("r"))
    norms = base.groupBy("u").agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("norm"))
    who = users.select("for_user").distinct()
    own = write_scratch(base.join(who, base["u"] == who["for_user"]).select("for_user", "i", F.col("r").alias("q")), "recommend-own")
    hot = base.groupBy("i").count().filter(F.col("count") > HOT_RATINGS).select("i", F.ceil(F.col("count") / HOT_RATINGS).cast("int").alias("salts"))
    hot = maybe_broadcast(write_scratch(hot, "recommend-hot"))
    one = F.coalesce("salts", F.lit(1))
    dealt = base.join(hot, "i", "left").select("u", "i", "r", F.pmod(F.xxhash64("u"), one).cast("int").alias("salt"))
    asked = own.join(hot, "i", "left").select("for_user", "i", "q", F.explode(F.sequence(F.lit(0), one - 1)).alias("salt"))
    dots = dealt.join(asked, ["i", "salt"]).groupBy("for_user", "u").agg(F.sum(F.col("q") * F.col("r")).alias("dot"))
    mine = own.groupBy("for_user").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("own_norm"))
    scale = F.col("norm") * F.col("own_norm")
    sims = (dots.join(norms, "u").join(mine, "for_user").filter((scale > 0) & (F.col("dot") != 0))
            .select("for_user", "u", (F.col("dot") / scale).alias("similarity")))
    scores = write_scratch(sims.join(base, "u").groupBy("for_user", "i").agg(F.sum(F.col("similarity") * F.col("r")).alias("score")), "recommend-scores")
    enough = scores.groupBy("for_user").agg(F.count_if(F.col("score") > 0).alias("above"), F.count(F.lit(1)).alias("n"))
    short = write_scratch(own.select("for_user").distinct().join(enough, "for_user", "left").na.fill(0, ["above", "n"])
                          .filter(F.col("above") < top_k).select("for_user", (F.col("n") + top_k).alias("look")), "recommend-short")
    most = short.agg(F.max("look")).first()[0]
    if most:
        ids = base.select("i").distinct().orderBy("i").limit(most).withColumn("at", F.row_number().over(Window.orderBy("i")))
        wanted = short.select("for_user", F.explode(F.sequence(F.lit(1), F.col("look").cast("int"))).alias("at"))
        fill = wanted.join(ids, "at").join(scores, ["for_user", "i"], "left_anti").select("for_user", "i", F.lit(0.0).alias("score"))
        scores = scores.unionByName(fill)
    best = Window.partitionBy("for_user").orderBy(F.desc("score"), "i")
    return (scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_k)
            .select("for_user", F.col("i").alias(item_col), "score"))


def _recommend(ratings: DataFrame, user_id, top_k: int, user_col: str, item_col: str, rating_col: str) -> DataFrame:
    sims = materialize(user_similarity(ratings, user_id, user_col, item_col, rating_col)
                       .where(F.col("similarity") != 0))
    similarity = F.coalesce(F.col("similarity"), F.lit(0.0))
    scored = (ratings.join(maybe_broadcast(sims), on=user_col, how="left")
              .groupBy(item_col).agg(F.sum(similarity * qcol(rating_col)).alias("score")))
    return scored.orderBy(F.col("score").desc(), F.col(item_col)).limit(top_k)


def cosine(a, b):
    """Cosine of two array columns in double precision; 0 when a norm is 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                      lambda acc, x: acc + x)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.when((na > 0) & (nb > 0), dot / (na * nb)).otherwise(F.lit(0.0))


def similar_items(items: DataFrame, item_id, top_k: int = 10, id_col: str = "item", vec_col: str = "features") -> DataFrame:
    """The ``top_k`` items most similar to ``item_id`` by feature cosine,
    the item itself dropped; ties go to the smaller id.

    Only the query vector (one row, its size fixed by the dimension) goes to
    the driver and back as a literal; each row then scores in codegen and
    the top k is a TakeOrderedAndProject.
    """
    row = items.where(qcol(id_col) == F.lit(item_id)).select(vec_col).limit(1).collect()
    if not row:
        raise KeyError(f"item {item_id!r} has no features")
    qv = [0.0 if x is None else float(x) for x in (row[0][0] or [])]
    qlit = F.lit(qv).cast("array<double>")  # one array literal, however long the vector
    filled = F.transform(qcol(vec_col), lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    return (items.where(qcol(id_col) != F.lit(item_id))
            .select(id_col, cosine(filled, qlit).alias("similarity"))
            .orderBy(F.col("similarity").desc(), qcol(id_col)).limit(top_k))

"""8. Toxicity by a chain of linear classifiers.

The targets (label columns with values 0 and 1) are predicted in order; each
target's probability is a feature of all later ones. In training, the earlier
probabilities are out-of-fold: a row's value comes from models that did not see the
row, so later models learn how far an earlier prediction can be trusted. Models are
ridge logistic regressions on hashed words, word beginnings and a few style features,
of which those that the training rows show to depend on the target take part.

Training uses a bounded sample: the ``MAX_TRAIN`` labelled rows of smallest id hash
(the documented bound of what a task holds). Fold models and the final model of a
target are fitted side by side, one Spark group each. Prediction covers every whole
text; the model is ``DIMS`` weights per target.

Null texts and texts without a letter have null probabilities and count as not
toxic. Labelled rows with a null id, a null label or without a document are not
learned from; repeated rows count as often as they are there. Without any labelled
row nothing is toxic. Columns other than those named are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import write_scratch
from .language import letter_words

TARGETS = ("quality", "toxic")
MAX_TRAIN = 16_000
FOLDS = 3
DIMS = 1 << 18
BEGINNINGS = (4, 5)
#: features weaker than this against a target (p about 1e-5) get no weight
MIN_CHI2 = 20.0
STEPS = 150
RATE = 0.1
RIDGE = 1e-4
SLICE = 1_000


def features(text: str | None) -> np.ndarray:
    """Hashed features of one text, each once; empty if it has no letter."""
    words = letter_words(text)
    if not words:
        return np.empty(0, np.int32)
    distinct = Counter(words)
    hashed = {zlib.crc32(w) % DIMS for w in distinct}
    hashed.update(zlib.crc32(w, 2) % DIMS for w, k in distinct.items() if k > 1)
    for size in BEGINNINGS:
        hashed.update(zlib.crc32(w, size) % DIMS for w in {w[:size] for w in distinct if len(w) > size})
    n = len(text)
    style = (("upper", sum(map(str.isupper, text)) / n), ("symbol", sum(map(text.count, "#*$%&|<>!")) / n),
             ("variety", len(distinct) / len(words)), ("length", len(words) / len(text)))
    hashed.update(zlib.crc32(f"{name} {round(20 * share)}".encode(), 1) % DIMS for name, share in style)
    return np.fromiter(hashed, np.int32, len(hashed))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Sparse:
    """Rows of hashed features: features by row, and all of them in row order."""

    def __init__(self, n: np.ndarray, at: np.ndarray):
        self.n, self.at = n, at
        self.of = np.repeat(np.arange(len(n)), n)

    def rows(self, some: np.ndarray) -> "Sparse":
        return Sparse(self.n[some], self.at[some[self.of]])

    def only(self, kept: np.ndarray) -> "Sparse":
        live = kept[self.at]
        return Sparse(np.bincount(self.of[live], minlength=len(self.n)), self.at[live])

    def chi2(self, y: np.ndarray) -> np.ndarray:
        """Pearson's statistic of each feature's presence against the label."""
        n, pos = len(y), y.sum()
        seen = np.bincount(self.at, minlength=DIMS).astype(float)
        spread = seen * (n - seen) * pos * (n - pos)
        return n * (n * self.back(y) - seen * pos) ** 2 / np.where(spread > 0, spread, np.inf)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, weights[self.at], len(self.n))

    def back(self, by_row: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, by_row[self.of], DIMS)


def fit(x: Sparse, earlier: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature weights, weights of the earlier logits and the bias) of a ridge logistic
    regression, by Adam on the whole gradient with a falling rate."""
    dense = np.column_stack((earlier, np.ones(len(y))))
    w, v = np.zeros(DIMS), np.zeros(dense.shape[1])
    v[-1] = np.log((y.sum() + 0.5) / ((1 - y).sum() + 0.5))
    if not len(y) or y.min() == y.max():
        return w, v
    x = x.only(x.chi2(y) >= MIN_CHI2)
    m = [np.zeros_like(w), np.zeros_like(v)]
    s = [np.zeros_like(w), np.zeros_like(v)]
    for step in range(1, STEPS + 1):
        error = (sigmoid(x.dot(w) + dense @ v) - y) / len(y)
        rate = RATE * (1 - (step - 1) / STEPS)
        for k, (value, slope) in enumerate(((w, x.back(error) + RIDGE * w), (v, dense.T @ error))):
            m[k] = 0.9 * m[k] + 0.1 * slope
            s[k] = 0.99 * s[k] + 0.01 * slope ** 2
            value -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.99 ** step)) + 1e-8)
    return w, v


def _sample_rows(schema: pa.Schema):
    def run(batches):
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            got = [features(t) for t in batch.column("text").to_pylist()]
            rows = np.arange(k, k + len(got), dtype=np.int64) + (part << 33)
            k += len(got)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), pa.array(rows % FOLDS, pa.int32()), batch.column("y"), pa.array(got, pa.list_(pa.int32()))],
                schema=schema)
    return run


def _fit_group(schema: pa.Schema, target: int):
    """Model f < FOLDS learns from the other folds and predicts fold f; model FOLDS learns from all."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("row").combine_chunks()
        model, fold = rows.column("model")[0].as_py(), rows.column("fold").to_numpy()
        lists = rows.column("features").combine_chunks()
        x = Sparse(np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy())
        y = np.array(rows.column("y").to_pylist(), float)[:, target]
        earlier = logit(np.array(rows.column("earlier").to_pylist(), float).reshape(len(y), -1))
        seen = fold != model
        w, v = fit(x.rows(seen), earlier[seen], y[seen])
        if model == FOLDS:
            out = [(None, None, np.concatenate((w, v)).astype("<f8").tobytes())]
        else:
            p = sigmoid(x.rows(~seen).dot(w) + np.column_stack((earlier[~seen], np.ones(int((~seen).sum())))) @ v)
            out = [(r, q, None) for r, q in zip(rows.column("row").to_numpy()[~seen].tolist(), p.tolist())]
        cols = list(zip(*out)) if out else [()] * 3
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
    return run


def train_chain(docs: DataFrame, labels: DataFrame, targets=TARGETS, id_col: str = "doc_id", text_col: str = "text",
                max_train: int = MAX_TRAIN) -> tuple[list[np.ndarray], float]:
    """(the weights of each target's final model: DIMS features, earlier targets, bias; the
    probability above which the last target is predicted: the best F1 out of fold)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    y = F.array(*[F.col(t).cast("double") for t in targets])
    sample = (labels.dropna(subset=[id_col, *targets]).select(F.col(id_col).alias("sampled"), y.alias("y"))
              .orderBy(F.xxhash64("sampled"), "sampled").limit(max_train))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("fold", T.IntegerType()),
                           T.StructField("y", T.ArrayType(T.DoubleType())), T.StructField("features", T.ArrayType(T.IntegerType()))])
    rows = (texts.join(F.broadcast(sample), F.col("id") == F.col("sampled")).filter(F.col("text").isNotNull())  # at most max_train rows
            .select("text", "y").mapInArrow(_sample_rows(to_arrow_schema(schema)), schema))
    rows = write_scratch(rows.withColumn("earlier", F.array().cast("array<double>")), "toxicity-sample")
    fitted = T.StructType([T.StructField("row", T.LongType()), T.StructField("p", T.DoubleType()), T.StructField("weights", T.BinaryType())])
    chain = []
    for k in range(len(targets)):
        models = rows.withColumn("model", F.explode(F.array(*[F.lit(f) for f in range(FOLDS + 1)])))
        out = write_scratch(models.groupBy("model").applyInArrow(_fit_group(to_arrow_schema(fitted), k), fitted), "toxicity-fits")
        final = out.filter("weights is not null").select("weights").head()
        weights = np.frombuffer(final[0], "<f8") if final else np.append(np.zeros(DIMS + k), -30.0)
        chain.append(weights)
        oof = out.filter("p is not null").select("row", "p")
        if k + 1 < len(targets):
            rows = write_scratch(rows.join(oof, "row").withColumn("earlier", F.concat("earlier", F.array("p"))).drop("p"),
                                 "toxicity-sample")
    found = F.sum(F.col("y")[len(targets) - 1])
    by_p = (rows.join(oof, "row").groupBy(F.round(F.floor(F.col("p") * 100) / 100, 2).alias("cut"))
            .agg(F.count("*").alias("n"), found.alias("found")).orderBy(F.desc("cut")).collect())  # 101 rows at most
    best, cut, n, hits = 0.0, 0.5, 0, 0.0
    for r in by_p:
        n, hits = n + r.n, hits + r.found
        f1 = 2 * hits / (n + sum(x.found for x in by_p))
        if f1 > best and r.cut > 0:
            best, cut = f1, float(r.cut)
    return chain, cut


def _predict(schema: pa.Schema, chain: list[np.ndarray], cut: float):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                got = [features(t) for t in part.column("text").to_pylist()]
                n = np.fromiter(map(len, got), np.int64, len(got))
                x, blank = Sparse(n, np.concatenate(got)), n == 0
                earlier = np.empty((len(got), 0))
                cols = []
                for weights in chain:
                    p = sigmoid(x.dot(weights[:DIMS]) + np.column_stack((logit(earlier), np.ones(len(got)))) @ weights[DIMS:])
                    earlier = np.column_stack((earlier, p))
                    cols.append(pa.array(p, mask=blank))
                yield pa.RecordBatch.from_arrays([part.column("id"), *cols, pa.array(cols[-1].fill_null(0).to_numpy() > cut)],
                                                 schema=schema)
    return run


def predict_chain(docs: DataFrame, model: tuple[list[np.ndarray], float], targets=TARGETS, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, p_<target> for each target, and whether the last target is predicted."""
    from pyspark.sql.pandas.types import to_arrow_schema

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType),
                           *[T.StructField(f"p_{t}", T.DoubleType()) for t in targets],
                           T.StructField(f"{targets[-1]}", T.BooleanType())])
    return source.mapInArrow(_predict(to_arrow_schema(schema), *model), schema).withColumnRenamed("id", id_col)

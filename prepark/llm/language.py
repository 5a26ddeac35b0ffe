"""9. Language ID: script ranges narrow the candidates, Viterbi labels spans.

Words are runs of letters, lower-cased. Learning counts, over all learnable
texts, the scripts of each language's words and their hashed byte n-grams
(``GRAMS``, with word boundaries); both are sums in a table of at most languages x
(``BUCKETS`` + scripts) rows, whatever the corpus holds, which is the model.

A word's script (a table of code-point ranges) leaves the languages that were seen
in that script as candidates; their n-gram log-probabilities, averaged by word
and weighed by ``WEIGHT``, are the word's scores. Viterbi over the words with a
penalty for each switch of language finds the best labelling of the whole text,
so single foreign or unseen words don't break a span. The predicted language is
the one whose spans hold the most letters, the score its share of them.

Null texts and texts without a letter are ``und`` with score 0, and so is every
text if nothing was learned. Languages tie in alphabetical order. Rows are kept
one to one; rows with a null id are predicted, not learned from. Other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .wordtable import spread

GRAMS = (2, 3, 4)
BUCKETS = 1 << 16
WEIGHT = 6.0
SWITCH = 12.0
MIN_SCRIPT_SHARE = 0.01
MAX_LANGUAGES = 1000
FLUSH_WORDS = 300_000
#: word scores held at a time (words x languages)
CELLS = 8_000_000

#: fixed values: first and last code point of the ranges of each script (Unicode blocks)
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF), (0xFB1D, 0xFB4F)),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "gurmukhi": ((0xA00, 0xA7F),),
    "gujarati": ((0xA80, 0xAFF),),
    "tamil": ((0xB80, 0xBFF),),
    "telugu": ((0xC00, 0xC7F),),
    "kannada": ((0xC80, 0xCFF),),
    "malayalam": ((0xD00, 0xD7F),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),
    "ethiopic": ((0x1200, 0x137F),),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)),
}
OTHER = len(SCRIPTS)
_RANGES = sorted((a, b, k) for k, ranges in enumerate(SCRIPTS.values()) for a, b in ranges)
_FIRST = np.array([a for a, _, _ in _RANGES])
_LAST = np.array([b for _, b, _ in _RANGES])
_SCRIPT = np.array([k for _, _, k in _RANGES])
#: ASCII other than letters ends a word
_BLANK = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def letter_words(text: str | None) -> list[bytes]:
    """Lower-cased words as UTF-8; none if the text has no letter."""
    if not text:
        return []
    words = text.lower().encode().translate(_BLANK).split()
    return [w for w in words if w.isascii() or any(map(str.isalpha, w.decode()))]


def script_of(word: bytes) -> int:
    """The script of a word's first letter."""
    if word[0] < 128:
        return 0
    cp = next(ord(c) for c in word.decode() if c.isalpha())
    k = int(np.searchsorted(_FIRST, cp, side="right")) - 1
    return int(_SCRIPT[k]) if k >= 0 and cp <= _LAST[k] else OTHER


def gram_buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all n-grams of all words, n-grams by word)."""
    data = np.frombuffer(b"^" + b"^^".join(words) + b"^", np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(lengths) - lengths
    counts = sum(lengths - n + 1 for n in GRAMS if n <= 3) + np.maximum(lengths - 3, 0)
    where = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.int64)
    for n in GRAMS:
        rolled = np.full(len(data) - n + 1, n, np.uint64) if len(data) >= n else np.empty(0, np.uint64)
        for k in range(n):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + data[k:len(data) - n + 1 + k]
        rolled = (rolled ^ (rolled >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        own = np.maximum(lengths - n + 1, 0)
        out[spread(where, own)] = (rolled[spread(starts, own)] >> np.uint64(48)).astype(np.int64) % BUCKETS
        where = where + own
    return out, counts


def _count(schema: pa.Schema):
    """(lang, text) -> (lang, cell, n): n-gram buckets, then scripts (cell BUCKETS + k)."""
    def flush(words: dict[str, dict[bytes, int]]) -> pa.RecordBatch:
        rows = []
        for lang, count in words.items():
            spelled, n = list(count), np.fromiter(count.values(), np.int64, len(count))
            buckets, grams = gram_buckets(spelled)
            cells = np.bincount(buckets, np.repeat(n, grams), BUCKETS + OTHER + 1).astype(np.int64)
            np.add.at(cells, BUCKETS + np.fromiter(map(script_of, spelled), np.int64, len(spelled)), n)
            at = np.flatnonzero(cells)
            rows.append((np.full(len(at), lang, object), at, cells[at]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches):
        words: dict[str, dict[bytes, int]] = {}
        held = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                got = letter_words(text)
                if got:
                    count = words.setdefault(lang, {})
                    held -= len(count)
                    for w in got:
                        count[w] = count.get(w, 0) + 1
                    held += len(count)
                if held > FLUSH_WORDS:
                    yield flush(words)
                    words, held = {}, 0
        if words:
            yield flush(words)

    return run


class Model:
    """Log-probabilities of n-gram buckets and allowed scripts, by language."""

    def __init__(self, langs: list[str], cells: np.ndarray):
        self.langs = langs
        grams, scripts = cells[:, :BUCKETS], cells[:, BUCKETS:]
        if langs:
            self.logp = np.log((grams + 0.5) / (grams.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)).astype(np.float32).T.copy()
            self.candidate = (scripts >= MIN_SCRIPT_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)).T & (scripts.T > 0)
        self.code: dict[bytes, int] = {}
        self.scores = np.empty((0, len(langs)), np.float32)

    def codes(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Row numbers of ``scores`` by word; each distinct word is scored once."""
        if len(self.code) > FLUSH_WORDS:
            self.code, self.scores = {}, np.empty((0, len(self.langs)), np.float32)
        code, known = self.code, len(self.code)
        out = [np.array([code.setdefault(w, len(code)) for w in words], np.int64) for words in texts]
        new = list(code)[known:]
        if new:
            buckets, grams = gram_buckets(new)
            ends = np.cumsum(grams)
            total = np.add.reduceat(self.logp[buckets], ends - grams, axis=0) if len(buckets) else 0
            got = WEIGHT * total / grams[:, None]
            allowed = self.candidate[np.fromiter(map(script_of, new), np.int64, len(new))]
            allowed |= ~allowed.any(axis=1, keepdims=True)  # a script nobody writes leaves them all
            got = np.where(allowed, got, got.min(axis=1, keepdims=True) - SWITCH)
            self.scores = np.concatenate((self.scores, (got - got.max(axis=1, keepdims=True)).astype(np.float32)))
        return out

    def label(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi of several texts side by side, longest first: the language of each word."""
        order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
        lengths = np.array([len(texts[k]) for k in order])
        active = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(int(lengths[0]))] if len(order) else []
        best = np.zeros((len(order), len(self.langs)), np.float32)
        came, top = [], []
        steps = np.zeros((max(1, len(active)), len(order)), np.int64)
        for j, k in enumerate(order):
            steps[:lengths[j], j] = texts[k]
        for t, n in enumerate(active):
            now = best[:n]
            high = now.argmax(axis=1)
            jump = now[np.arange(n), high][:, None] - SWITCH
            came.append(jump > now if t else np.zeros_like(now, bool))
            top.append(high)
            best[:n] = (np.maximum(now, jump) if t else now) + self.scores[steps[t, :n]]
        out = np.zeros((len(order), len(active)), np.int16) if len(order) * len(active) <= 4 * CELLS else None
        paths = [np.empty(int(m), np.int16) for m in lengths] if out is None else None
        state = best.argmax(axis=1) if len(self.langs) else np.zeros(len(order), np.int64)
        for t in range(len(active) - 1, -1, -1):
            n = active[t]
            if out is not None:
                out[:n, t] = state[:n]
            else:
                for j in range(n):
                    paths[j][t] = state[j]
            jumped = came[t][np.arange(n), state[:n]]
            state[:n] = np.where(jumped, top[t], state[:n])
        labels: list = [None] * len(order)
        for j, k in enumerate(order):
            labels[k] = out[j, :lengths[j]] if out is not None else paths[j]
        return labels


def _predict(schema: pa.Schema, langs: list[str], cells: np.ndarray):
    def groups(words: list[list[bytes]]):
        """Runs of texts whose side-by-side table stays within CELLS."""
        order = sorted(range(len(words)), key=lambda k: -len(words[k]))
        at = 0
        while at < len(order):
            width = max(1, CELLS // (len(langs) * max(1, len(words[order[at]]))))
            yield order[at:at + width]
            at += width

    def run(batches):
        model = Model(langs, cells)
        for batch in batches:
            words = [letter_words(t) for t in batch.column("text").to_pylist()]
            rows: list = [("und", 0.0, [])] * len(words)
            for own in groups(words) if langs else []:
                texts = [words[k] for k in own]
                for k, text, label in zip(own, texts, model.label(model.codes(texts))):
                    if not text:
                        continue
                    letters = np.bincount(label, np.fromiter(map(len, text), np.float64, len(text)), len(langs))
                    cut = np.flatnonzero(np.diff(label)) + 1
                    starts, ends = [0, *cut.tolist()], [*cut.tolist(), len(text)]
                    best = int(letters.argmax())
                    rows[k] = (langs[best], float(letters[best] / letters.sum()),
                               [{"start": s, "end": e, "lang": langs[int(label[s])]} for s, e in zip(starts, ends)])
            cols = list(zip(*rows)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:])]],
                                             schema=schema)

    return run


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """(languages, counts by language and cell) over every row with a language; at most
    languages x (BUCKETS + scripts) sums come to the driver."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("cell", T.LongType()), T.StructField("n", T.LongType())])
    rows = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(_count(to_arrow_schema(schema)), schema).groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    table = counted.groupBy("lang").agg(F.collect_list("cell").alias("cells"), F.collect_list("n").alias("n")).orderBy("lang").toArrow()
    if len(table) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    cells = np.zeros((len(table), BUCKETS + OTHER + 1), np.float64)
    for k in range(len(table)):
        cells[k, table.column("cells")[k].values.to_numpy()] = table.column("n")[k].values.to_numpy()
    return table.column("lang").to_pylist(), cells


def predict_language(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, lang_pred, score, spans (word intervals by language)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())])
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))])
    return source.mapInArrow(_predict(to_arrow_schema(schema), *model), schema).withColumnRenamed("id", id_col)

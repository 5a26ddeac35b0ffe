"""2. Quality rules: zstandard compression bands over whole texts and fixed chunks.

A text that compresses far better than prose of its length is repetitive; one
that barely compresses is noise. Short texts compress worse than long ones, so
the limits go by length (``BANDS``); fixed chunks of ``CHUNK`` bytes all have
one length and share one band, which finds a repetitive or incompressible part
inside an otherwise normal long text. The last chunk ends with the text and may overlap
the one before, so every byte of a text of ``CHUNK`` bytes or more is judged; shorter
texts have the limits of their length only. Everything is computed row by row inside
the scan's own tasks: no shuffle, no state.

Null texts and texts without words: zero counts, null ratios, failed base
rules. Texts below the first band's length have no band of their own (their
ratio says more about the frame header than about the text). Repeated rows get
equal reports; other columns are neither read nor changed.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, words_of

LEVEL = 3
#: (least bytes, lowest ratio, highest ratio) of whole texts
BANDS = ((128, 0.45, 1.00), (256, 0.42, 0.92), (512, 0.40, 0.88), (1024, 0.36, 0.82), (2048, 0.32, 0.78),
         (4096, 0.28, 0.75), (8192, 0.25, 0.72), (16384, 0.22, 0.70), (65536, 0.20, 0.70))
CHUNK = 2048
CHUNK_BAND = (0.30, 0.80)
#: share of a text's chunks that may lie outside the chunk band
CHUNKS_OUT = 0.25
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
SYMBOLS = b"#*$%&|<>"

REPORT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()), T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()), T.StructField("base_failed", T.BooleanType()),
    T.StructField("ratio", T.DoubleType()), T.StructField("n_chunks", T.LongType()),
    T.StructField("n_chunks_out", T.LongType()), T.StructField("kept", T.BooleanType())])


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words covered by a window of ``width`` words that occurs twice or more."""
    if len(words) <= width:
        return 0
    windows = list(zip(*(words[k:] for k in range(width))))
    often = {w for w, n in Counter(windows).items() if n > 1}
    if not often:
        return 0
    covered = np.zeros(len(words), bool)
    at = np.flatnonzero(np.fromiter(map(often.__contains__, windows), bool, len(windows)))
    for k in range(width):
        covered[at + k] = True
    return int(covered.sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]  # bytes.strip: the same six characters
    return len(lines) - len(set(lines))


def code_points(data: bytes) -> int:
    """Code points of valid UTF-8: bytes that don't continue one."""
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def compression(text: bytes, compress) -> tuple[float | None, int, int, bool]:
    """(whole ratio, chunks, chunks outside their band, verdict)."""
    if not text:
        return None, 0, 0, False
    ratio = len(compress(text)) / len(text)
    band = next(((lo, hi) for least, lo, hi in reversed(BANDS) if len(text) >= least), None)
    chunks = len(text) // CHUNK
    ends = [(k + 1) * CHUNK for k in range(chunks)]
    if chunks and len(text) % CHUNK:  # the rest is judged in a last chunk of full length
        ends.append(len(text))
    chunks, out = len(ends), 0
    for end in ends:
        r = len(compress(text[end - CHUNK:end])) / CHUNK
        out += not CHUNK_BAND[0] <= r <= CHUNK_BAND[1]
    good = (band is None or band[0] <= ratio <= band[1]) and out <= CHUNKS_OUT * chunks
    return ratio, chunks, out, good


def report(text: str | None, compress) -> tuple:
    data = text.encode() if isinstance(text, str) else b""
    words = words_of(data)
    repeat = repeated_words(words)
    base_failed = len(words) < MIN_WORDS or 100 * repeat > MAX_REPEATED_PERCENT * len(words)
    ratio, chunks, out, good = compression(data, compress)
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    return (len(words), code_points(b"".join(words)), symbols, repeated_lines(data), repeat, base_failed,
            ratio, chunks, out, good and not base_failed)


@F.pandas_udf(REPORT)
def _report(text: pd.Series) -> pd.DataFrame:
    compress = zstandard.ZstdCompressor(level=LEVEL).compress
    rows = [report(t, compress) for t in text]
    return pd.DataFrame(rows, columns=REPORT.names).astype({"ratio": "float64"})


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col`` and the fields of ``REPORT``."""
    got = fresh("report")
    return docs.select(F.col(id_col), _report(F.col(text_col)).alias(got)).select(id_col, f"{got}.*")


def quality_filter(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text is kept, all columns unchanged."""
    got = fresh("report")
    return docs.withColumn(got, _report(F.col(text_col))).filter(F.col(got)["kept"]).drop(got)

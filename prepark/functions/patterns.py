"""Fixed values that must equal the reference's for equal results."""

# PII patterns (Python syntax), in the reference's order of checking.
PII_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone_international": r"\+?\d[\d\s\-]{6,}\d",
    "aadhar_like": r"\b\d{4}\s?\d{4}\s?\d{4}\b",
}

# Mask tokens.
EMAIL_MASK = "[EMAIL_MASKED]"
ID_MASK = "[PII_MASKED]"

# Field-role name rules (case-insensitive search).
ID_NAME_PATTERN = r"(id$|_id$|^id$|identifier)"
DATETIME_NAME_PATTERN = r"(date|time|timestamp|year)"
MAX_UNIQUE_FOR_CATEGORICAL = 50
ID_MIN_DISTINCT = 50

# Lower-cased column names that flag a likely target.
TARGET_NAMES = ["target", "label", "outcome", "y", "class", "status", "fraud", "is_fraud", "churn"]

# Target-column candidates when the name is not found exactly.
TARGET_CANDIDATES = ["outcome", "target", "label", "y", "class", "status"]

# Text forms a binary target may take.
BINARY_TOKENS = ["0", "1", "yes", "no", "true", "false"]

# Text fill for missing text cells.
TEXT_FILL = "missing"


def java_unicode(pattern: str) -> str:
    """Python's ``\\d``, ``\\s`` and ``\\b`` are Unicode-aware; Java's need ``(?U)``."""
    return "(?U)" + pattern

# The quick-summary sentences (D7), in the order they are emitted.
SENTENCE_SIZE = "The dataset has {rows} rows and {cols} columns."
SENTENCE_TARGETS = "Possible target columns: {targets}."
SENTENCE_NO_TARGET = "No obvious target column detected automatically."
SENTENCE_NUMERIC = "Numeric cols: {cols}{more}."
SENTENCE_MISSING = "Average missingness: {pct:.1f}% — consider cleaning/imputing."
SENTENCE_VARIANCE = "High-variance numeric cols: {cols}."
SENTENCE_CLOSING = "Preview the first rows to validate column roles."

# The quality-report (D8) headings, in order.
REPORT_TITLE = "DATA QUALITY REPORT"
REPORT_RULE = "===================="
REPORT_BEFORE = "\nSUMMARY BEFORE:"
REPORT_AFTER = "\nSUMMARY AFTER:"
REPORT_COLUMNS = "\nCOLUMN SUMMARY:"

# What output names may not hold, the extensions of formats that are
# written, and the time stamp.
UNSAFE_NAME_CHARS = r"[^\w .-]"
WRITTEN_EXTENSIONS = (".csv", ".json", ".orc", ".parquet")
NAME_STAMP = "%Y%m%d_%H%M%S"


def summary_text(rows: int, cols: int, targets: list[str], numeric: list[str], missing_pct: float,
                 high_variance: list[str]) -> str:
    """D7 text from small, already computed parts."""
    s = [SENTENCE_SIZE.format(rows=rows, cols=cols),
         SENTENCE_TARGETS.format(targets=", ".join(targets)) if targets else SENTENCE_NO_TARGET]
    if numeric:
        s.append(SENTENCE_NUMERIC.format(cols=", ".join(numeric[:5]), more="..." if len(numeric) > 5 else ""))
    if missing_pct > 0:
        s.append(SENTENCE_MISSING.format(pct=missing_pct))
    if high_variance:
        s.append(SENTENCE_VARIANCE.format(cols=", ".join(high_variance)))
    s.append(SENTENCE_CLOSING)
    return " ".join(s)

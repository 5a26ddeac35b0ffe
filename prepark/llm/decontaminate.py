"""7. Benchmark decontamination by template canonicalisation.

Words lose outer punctuation and turn into template tokens: numbers become
``<num>``, names (words that begin with a capital) ``<name>``, units of measure
``<unit>``, all others their lower case. A re-parameterised question keeps its
template and changes its slots, so windows of ``WINDOW`` template tokens are
hash-joined between documents and benchmark items, and the slots decide: along
one alignment of a document with an item, a slot value of the item must stand for
one and the same value of the document throughout. An item is found where
consistent windows cover ``COVER`` of its tokens (all that its windows reach, if that is
less). Windows with few literal words say nothing and take no part (``LITERALS``), and a
window that recurs inside an item counts where it first stands, so a repetitive item
meets a repetitive document once per window of the document, not once per pair.

These are the ``typed`` rule's tokens. Capitals change them, and windows dense in slots
take no part, so two more rules stand beside it in ``RULES``, with the same windows and
``COVER``. ``folded``: the words in one case, no slots and no literal minimum, finds verbatim
copies in any case and with any share of numbers. ``caseless``: a capital alone makes no name,
the benchmark's vocabulary decides (a word that it writes in lower case somewhere is a literal, one
that it only writes with a capital a name, in any case), finds re-parameterised copies in
upper and title case; a run of equal placeholders is one token and its words one slot value, so
slots may change their number of words (a run counts with all its words in what is
covered). A text all in lower case with names that the benchmark doesn't
have is found by its other windows only. The query and the pipeline use all ``RULES``;
the functions' default is ``typed`` alone.

Document windows are tested against a bitmap of the benchmark's window hashes in
the scanning task (fixed size, whatever the benchmark's), so only windows that may
match are shuffled; the join is on the template itself and thus exact.

Null texts and ids of either side: a null text matches nothing, a null id is
reported as null. Items of fewer than ``LITERALS`` tokens can't be found. Repeated
documents are found each by its own id; repeated items under each of their ids.
Columns other than those named are ignored.
"""

from __future__ import annotations

import re
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, words_of
from .windows import rolling

WINDOW = 8
LITERALS = 5
COVER = 13
BITS = 24
MAX_WORDS = 400_000
#: typed: as above; folded: words in one case, no slots; caseless: names by the benchmark's vocabulary
RULES = ("typed", "folded", "caseless")
CHUNK_TEXTS = 1_000

NUMBER_WORDS = frozenset("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen "
                         "sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety "
                         "hundred thousand million billion dozen half".split())
UNITS = frozenset("mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce "
                  "ounces pound pounds lb lbs ton tons ml l liter liters litre litres gallon gallons second seconds "
                  "minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro "
                  "euros percent degree degrees meter meters metre metres kilometer kilometers kilometre kilometres "
                  "watt watts volt volts joule joules mph kmh".split())
OUTER = re.compile(r"^[\W_]+|[\W_]+$")


def template_token(word: str) -> tuple[str, str | None]:
    """(template token, slot value or None); an empty token is no token."""
    core = word if word.isalpha() else OUTER.sub("", word)
    lower = core.lower()
    if not core.isalpha() and any(c.isdigit() for c in core) or lower in NUMBER_WORDS:
        return "<num>", core
    if lower in UNITS:
        return "<unit>", lower
    if core[:1].isupper():
        return "<name>", core
    return lower, None


def folded_token(word: str) -> str:
    """The word in one case, numbers and names as they stand; empty where ``template_token`` is."""
    return OUTER.sub("", word).casefold()


class Vocabulary:
    """Which words the benchmark writes in lower case, and which with a capital: two bitmaps of
    2^BITS bits by the folded word, so of one size whatever the benchmark's."""

    def __init__(self, lower: np.ndarray, upper: np.ndarray):
        self.lower = np.packbits(lower, bitorder="little").tobytes()
        self.upper = np.packbits(upper, bitorder="little").tobytes()

    def is_name(self, folded_hash: int, capital: bool) -> bool:
        """A capital alone makes no name: a word that the benchmark writes in lower case is a
        literal in any case, one that it only writes with a capital a name in any."""
        at, bit = folded_hash >> 64 - BITS + 3, 1 << (folded_hash >> 64 - BITS & 7)
        return not self.lower[at] & bit and bool(capital or self.upper[at] & bit)


PLACEHOLDERS = {t: xxhash.xxh64_intdigest(t) for t in ("<num>", "<unit>", "<name>")}


class Codes(dict):
    """Words to their codes; a word not yet there takes the next one."""

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code


class Templates:
    """Template tokens of words by each rule, each distinct word canonicalised once. Of a word only
    its hashes and kinds are kept; the tokens of the few windows that pass are made again."""

    def __init__(self, rules: tuple[str, ...], vocabulary: Vocabulary | None):
        self.rules, self.vocabulary = rules, vocabulary
        self.clear()

    def clear(self) -> None:
        self.code, self.word = Codes(), []
        self.hash = {r: np.empty(1 << 14, np.uint64) for r in self.rules}
        self.kind = {r: np.empty(1 << 14, np.int8) for r in self.rules}

    def caseless(self, word: str) -> tuple[str, str | None]:
        token, slot = template_token(word)
        if token in ("<num>", "<unit>", ""):
            return token, slot and slot.casefold()
        folded = folded_token(word)
        name = self.vocabulary.is_name(xxhash.xxh64_intdigest(folded), token == "<name>")
        return ("<name>", folded) if name else (folded, None)

    def by_rule(self, rule: str, word: str) -> tuple[str, str | None]:
        if rule == "folded":
            return folded_token(word), None
        return template_token(word) if rule == "typed" else self.caseless(word)

    def hashes(self, word: str) -> tuple:
        """(hash, kind) of the word's token by each of ``RULES``; the kinds are literal, slot and nothing."""
        token, slot = template_token(word)
        if not token:
            return 0, 2, 0, 2, 0, 2
        fold = word.casefold() if word.isalpha() else folded_token(word)
        folded = xxhash.xxh64_intdigest(fold)
        if slot is None:
            typed, kind = folded if fold == token else xxhash.xxh64_intdigest(token), 0
        else:
            typed, kind = PLACEHOLDERS[token], 1
        if token == "<num>" or token == "<unit>":
            return typed, 1, folded, 0, typed, 1
        if self.vocabulary is not None and self.vocabulary.is_name(folded, kind == 1):
            return typed, kind, folded, 0, PLACEHOLDERS["<name>"], 1
        return typed, kind, folded, 0, folded, 0

    def codes(self, words, count: int) -> np.ndarray:
        if len(self.code) > MAX_WORDS:
            self.clear()
        codes, at = np.fromiter(map(self.code.__getitem__, words), np.int64, count), len(self.word)
        new = list(islice(reversed(self.code), len(self.code) - at))[::-1]
        self.word += new
        got = np.array([self.hashes(w.decode()) for w in new], np.uint64).reshape(-1, 6)
        for rule in self.rules:
            k = 2 * RULES.index(rule)
            for held, column in ((self.hash, k), (self.kind, k + 1)):
                if len(held[rule]) < at + len(new):
                    held[rule] = np.concatenate((held[rule][:at], np.empty(at + 2 * len(new), held[rule].dtype)))
                held[rule][at:at + len(new)] = got[:, column]
        return codes

    def windows(self, split: list[list[bytes]], sizes: dict[str, list[int]] | None, bitmap: np.ndarray | None):
        """(text, rule, start token, tokens, template, slots, first word, end word, the tokens it spans
        when none are joined, bit) of each window with enough literals that the bitmap doesn't rule out; each text's number of tokens. All texts
        are one run of tokens, of which windows across a text's end are left out. Without ``sizes``
        a text has windows of ``WINDOW`` tokens, or one of all tokens if it is short."""
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        codes = self.codes(chain.from_iterable(split), int(lengths.sum()))
        texts = np.repeat(np.arange(len(split)), lengths)
        places = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        some = np.flatnonzero(self.kind[self.rules[0]][codes] != 2)  # the same words under each rule
        codes, texts, places = codes[some], texts[some], places[some]
        n_tokens = np.bincount(texts, minlength=len(split))
        starts = np.cumsum(n_tokens) - n_tokens
        out = []
        for rule in self.rules:
            heads, kinds, hashed = np.arange(len(codes)), self.kind[rule][codes], self.hash[rule][codes]
            if rule == "caseless" and len(codes):  # a run of equal placeholders is one token
                more = (kinds[1:] == 1) & (hashed[1:] == hashed[:-1]) & (kinds[:-1] == 1) & (texts[1:] == texts[:-1])
                heads = np.flatnonzero(np.concatenate(([True], ~more)))
            ends = np.append(heads[1:], len(codes))
            of, hashed, literals = texts[heads], hashed[heads], np.concatenate(([0], np.cumsum(kinds[heads] == 0)))
            n = np.bincount(of, minlength=len(split))
            before, own = np.cumsum(n) - n, np.where(n >= LITERALS, np.minimum(n, WINDOW), 0)
            for size in sorted({*own.tolist()} - {0}) if sizes is None else sizes.get(rule, []):
                if len(heads) < size:
                    continue
                hashes = rolling(hashed, size) >> np.uint64(64 - BITS)
                live = of[size - 1:] == of[:len(of) - size + 1]
                if rule != "folded":
                    live &= literals[size:] - literals[:-size] >= min(LITERALS, size)
                if sizes is None:
                    live &= own[of[:len(live)]] == size
                if bitmap is not None:
                    live &= bitmap[hashes]
                for k in np.flatnonzero(live).tolist():
                    runs = [[self.by_rule(rule, self.word[c].decode()) for c in codes[heads[j]:ends[j]].tolist()]
                            for j in range(k, k + size)]
                    text, head, end = int(of[k]), int(heads[k]), int(ends[k + size - 1])
                    out.append((text, rule, int(k - before[text]), size, " ".join([r[0][0] for r in runs]),
                                [" ".join([x for _, x in r]) for r in runs if r[0][1] is not None], int(places[head]),
                                int(places[end - 1]) + 1, int(head - starts[text]), int(end - starts[text]), int(hashes[k])))
        return out, n_tokens.tolist()


WINDOWS = T.StructType([
    T.StructField("rule", T.StringType()),
    T.StructField("pos", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("template", T.StringType()),
    T.StructField("slots", T.ArrayType(T.StringType())), T.StructField("first_word", T.IntegerType()),
    T.StructField("end_word", T.IntegerType()), T.StructField("span_from", T.IntegerType()),
    T.StructField("span_end", T.IntegerType()), T.StructField("bit", T.IntegerType()), T.StructField("n_tokens", T.IntegerType()),
    T.StructField("reach", T.IntegerType())])


def _reached(found: list[tuple]) -> list[tuple]:
    """An item's windows, the first of equal ones, each with the number of tokens that all of its rule reach."""
    first, reach = {}, {}
    for f in found:
        if first.setdefault((f[0], f[1], f[4]), f) is f:
            reach.setdefault((f[0], f[1]), set()).update(range(f[8], f[9]))
    return [(*f, len(reach[f[0], f[1]])) for f in first.values()]


def _windows(schema: pa.Schema, rules: tuple[str, ...], vocabulary: Vocabulary | None, sizes: dict | None, bitmap: np.ndarray | None):
    def run(batches):
        table = Templates(rules, vocabulary)
        for batch in batches:
            for k in range(0, batch.num_rows, CHUNK_TEXTS):
                part = batch.slice(k, CHUNK_TEXTS)
                split = [words_of(t) for t in part.column("text").cast(pa.binary()).to_pylist()]
                found, n = table.windows(split, sizes, bitmap)
                found = _reached(found) if sizes is None else [(*f, 0) for f in found]
                ids, marks = part.column("id").to_pylist(), part.column("mark").to_pylist()
                rows = [(ids[f[0]], marks[f[0]], *f[1:-1], n[f[0]], f[-1]) for f in found]
                cols = list(zip(*rows)) if rows else [()] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
    return run


def _template_windows(rows: DataFrame, id_col: str, text_col: str, rules, vocabulary, sizes=None, bitmap=None) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    source = rows.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("mark", T.LongType()), *WINDOWS.fields])
    return source.mapInArrow(_windows(to_arrow_schema(schema), rules, vocabulary, sizes, bitmap), schema)


def _bitmap(bits: DataFrame) -> np.ndarray:
    """The column ``bit`` as 2^BITS booleans: so many bits at most come back, however many rows there are."""
    bitmap = np.zeros(1 << BITS, bool)
    words = bits.selectExpr("bit div 64 as k", "shiftleft(1L, bit % 64) as v")
    for k, v in words.groupBy("k").agg(F.bit_or("v").alias("v")).toLocalIterator():
        bitmap[64 * k:64 * k + 64] = np.unpackbits(np.array([v], np.int64).view(np.uint8), bitorder="little").astype(bool)
    return bitmap


def _cases(batches):
    for batch in batches:
        words = set().union(*(words_of(t) for t in batch.column("text").cast(pa.binary()).to_pylist()))
        cores = {OUTER.sub("", w.decode()) for w in words} - {""}
        bits = [xxhash.xxh64_intdigest(c.casefold()) >> 64 - BITS for c in cores]
        yield pa.RecordBatch.from_pydict({"bit": pa.array(bits, pa.int32()),
                                          "capital": pa.array([c[:1].isupper() for c in cores], pa.bool_())})


def _vocabulary(benchmark: DataFrame, item_text: str) -> Vocabulary:
    cases = benchmark.select(F.col(item_text).alias("text")).mapInArrow(_cases, "bit int, capital boolean")
    return Vocabulary(_bitmap(cases.filter("not capital")), _bitmap(cases.filter("capital")))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", rules: tuple[str, ...] = ("typed",)) -> DataFrame:
    """One row per document and benchmark item found in it: ``id_col``, mark (hash of the text),
    ``item_id``, n_tokens of the item, n_covered, n_changed (slot values that differ), first_word
    and end_word of the passage in the document. An item is found by any of the ``rules``; where
    ``typed`` finds it, the row is that rule's."""
    vocabulary = _vocabulary(benchmark, item_text) if "caseless" in rules else None
    items = _template_windows(benchmark, item_id, item_text, rules, vocabulary).distinct()
    bitmap = _bitmap(items)  # one for all rules
    sizes = {}  # at most WINDOW sizes a rule come back
    for rule, size in sorted(map(tuple, items.select("rule", "size").distinct().collect())):
        sizes.setdefault(rule, []).append(size)
    found = _template_windows(docs, id_col, text_col, rules, vocabulary, sizes, bitmap)
    found = found.drop("span_from", "span_end", "bit", "n_tokens", "reach")
    items = items.select(F.col("id").alias("item"), "rule", F.col("pos").alias("item_pos"), "template", F.col("slots").alias("item_slots"), "n_tokens", "reach", "span_from", "span_end")
    matched = found.join(items, ["rule", "template"])
    aligned = matched.groupBy("id", "mark", "item", "rule", "n_tokens", "reach", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(
        F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("item_slots", "slots")))).alias("pairs"),
        F.array_distinct(F.flatten(F.collect_list(F.expr("sequence(span_from, span_end - 1)")))).alias("covered"),
        F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word"))
    consistent = F.size("pairs") == F.size(F.array_distinct(F.col("pairs.item_slots")))
    n_covered = F.size("covered")
    changed = F.size(F.filter("pairs", lambda p: p["item_slots"] != p["slots"]))
    passages = (aligned.filter(consistent & (n_covered >= F.least(F.lit(COVER), "reach")))
                .withColumns({"n_covered": n_covered, "n_changed": changed}))
    best = F.max(F.struct((F.col("rule") == "typed").alias("typed"), "n_covered", (-F.col("n_changed")).alias("few"), (-F.col("first_word")).alias("early"),
                          "end_word", "n_tokens")).alias("b")
    return (passages.groupBy("id", "mark", "item").agg(best)
            .select(F.col("id").alias(id_col), "mark", F.col("item").alias(item_id), "b.n_tokens", "b.n_covered",
                    (-F.col("b.few")).alias("n_changed"), (-F.col("b.early")).alias("first_word"), "b.end_word"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      rules: tuple[str, ...] = ("typed",)) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item was found, all columns unchanged."""
    i, mark = fresh("id"), fresh("mark")
    found = contamination(docs, benchmark, id_col, text_col, rules=rules).select(F.col(id_col).alias(i), F.col("mark").alias(mark)).distinct()
    return docs.join(found, docs[id_col].eqNullSafe(found[i]) & (F.xxhash64(docs[text_col]) == found[mark]), "left_anti")

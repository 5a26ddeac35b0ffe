"""Personal-data spans by weak supervision (operator 13), in DataFrame functions only.

1. Candidates. Per kind (email, ip, card, phone) the base pattern and a wider one of
   other writings (``name (at) host (dot) org``, ``1[.]2[.]3[.]4``, dotted card groups,
   phone numbers without a plus) give spans with a little text on either side.
2. Labelers vote 1, 0 or -1 on each candidate: the base rule, a validity check, a
   gazetteer (domain ends, issuer digits, calling codes, reserved networks), cue words
   before it, and what stands at its ends.
3. Candidates are counted by votes (3^5 patterns a kind at most). Expectation-
   maximisation over those counts estimates how reliable each labeler is on true and on
   false candidates, and so a probability for each pattern.
4. These probabilities train the final classifier, naive Bayes over the votes and over
   features no labeler sees (length, grouping, case, neighbours' kinds).
5. A wider candidate that the classifier takes for true is added, unless it overlaps a
   base span; base spans always stay.

Places are code points: the text between matches and the matches add up from the left,
a running sum over a text's own matches. Only spans and ids are shuffled, no text. The
patterns never back up over what they took (possessive repeats, starts that no earlier
start can reach), so their time is linear in the text and needs no deep stack; they match
what the plain patterns in ``PLAIN`` match.

Nulls: a null text is empty, a null doc_id is kept. Each row is a text of its own, so
repeated ids and repeated rows get a row each. Empty texts and tables have no span (a row
per text all the same). Spans that start together are ordered by kind as listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_scratch

KINDS = ("email", "ip", "card", "phone")

# ---- fixed values: the base patterns as they are given
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# ----

#: the same matches in linear time; card is held to its 12 to 19 digits at once
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}

_AT, _DOT = r" ?[\[({](?:at|@)[\])}] ?", r" ?[\[({](?:dot|\.)[\])}] ?"
#: other writings of the same data; spelled-out signs without brackets only before an end that is no common word
WIDER = {
    "email": rf"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{{1,64}}+(?:{_AT}[a-z0-9-]{{1,63}}+(?:(?:{_DOT}|\.)[a-z0-9-]{{1,63}}+){{1,8}}+"
             r"| at [a-z0-9-]{1,63}+(?: dot [a-z0-9-]{1,63}){0,6}? dot (?:com|org|net|edu|gov|info))(?![a-z0-9-])",
    "ip": r"(?<![0-9.\]])[0-9]{1,3}+(?: ?[\[(]\.[\])] ?[0-9]{1,3}+){3}(?![0-9]| ?[\[(]\.)",
    "card": r"(?<![0-9A-Za-z.])[0-9]{4}(?:([._/ ]|  )[0-9]{4})(?:\1[0-9]{4}){2}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+(.-])(?:00[1-9][0-9]{0,2}[ .-])?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])",
}
#: texts without a match, told cheaply
GATES = {
    ("email", "base"): lambda t: F.contains(t, F.lit("@")),
    ("email", "wider"): lambda t: t.rlike(r"(?i)[\[({](?:at|@)[\])}]| dot "),
    ("phone", "base"): lambda t: F.contains(t, F.lit("+")),
    ("ip", "wider"): lambda t: t.rlike(r"[\[(]\.[\])]"),
}

# ---- gazetteers and cue words
DOMAIN_ENDS = ("com org net edu gov mil int info biz io ai app dev me tv cc co uk us ca de fr es it nl be ch at pl se no dk fi pt gr ie cz ru ua tr "
               "in cn jp kr au nz br mx ar cl za eu name pro xyz online site").split()
CUES = {
    "email": r"e-?mail|mail|contact|write|reach|correo|adresse|courriel",
    "ip": r"\bip\b|ipv4|host|server|address|client|login|logged|from",
    "card": r"card|visa|master|amex|credit|debit|payment|karte|tarjeta|carte",
    "phone": r"phone|tel|call|mobile|cell|fax|whatsapp|sms|tel[eé]fono|telefon",
}
NOT_PERSONAL = (r"version|release|\bv\.?$|isbn|issn|order|invoice|serial|sku|part no|build|commit|hash|sha|token|checksum|uuid|doi|section|"
                r"chapter|table|price|total|=\s*[\"']?$")
# ----

VOTES = ("v_rule", "v_valid", "v_gazetteer", "v_context", "v_ends")
#: what the classifier sees beside the votes
FEATURES = (*VOTES, "f_length", "f_grouping", "f_case", "f_before", "f_after")
ROUNDS = 25


def _candidates(docs: DataFrame) -> DataFrame:
    """Every text's row and each of its candidates: row, doc_id, kind, wider, found, before, after, start, end."""
    t = F.col("text")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    digits = t.rlike("[0-9]")
    pairs = [(kind, form) for kind in KINDS for form in ("base", "wider")]
    names = {p: f"{p[0]}_{p[1]}" for p in pairs}
    patterns = {p: (BASE if p[1] == "base" else WIDER)[p[0]] for p in pairs}

    def matches(pair: tuple[str, str]) -> Column:
        gate = GATES.get(pair, lambda t: F.lit(True))(t)
        gate = gate if pair[0] == "email" else digits & gate
        return F.when(gate, F.regexp_extract_all(t, F.lit(patterns[pair]), F.lit(0)))

    held = rows.withColumns({names[p]: matches(p) for p in pairs})
    some = {p: F.size(names[p]) > 0 for p in pairs}
    held = held.withColumns({f"s_{names[p]}": F.when(some[p], F.split(t, patterns[p], -1)) for p in pairs}).drop("text")

    def spans(pair: tuple[str, str]) -> Column:
        found, between = F.col(names[pair]), F.col(f"s_{names[pair]}")
        zipped = F.arrays_zip(found.alias("found"), between.alias("left"),
                              F.slice(between, F.lit(2), F.size(found)).alias("right"), F.sequence(F.lit(0), F.size(found) - 1).alias("k"))
        return F.when(some[pair], F.transform(F.slice(zipped, F.lit(1), F.size(found)), lambda x: F.struct(
            F.lit(KINDS.index(pair[0])).alias("kind"), F.lit(pair[1] == "wider").alias("wider"), x["k"].alias("k"), x["found"].alias("found"),
            F.right(x["left"], F.lit(40)).alias("before"), F.left(x["right"], F.lit(12)).alias("after"),
            F.length(x["left"]).alias("gap"), F.length(x["found"]).alias("size")))).otherwise(F.array())

    each = held.select("row", "doc_id", F.explode_outer(F.concat(*[spans(p) for p in pairs])).alias("c")).select("row", "doc_id", "c.*")
    run = Window.partitionBy("row", "kind", "wider").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap").cast("long") + F.col("size")).over(run)
    return each.withColumn("end", end).withColumn("start", F.col("end") - F.col("size")).drop("k", "gap", "size")


def _by_kind(*columns: Column) -> Column:
    out = F.when(F.col("kind") == 0, columns[0])
    for k, c in enumerate(columns[1:], 1):
        out = out.when(F.col("kind") == k, c)
    return out


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1, -1 or 0; a vote against goes first."""
    return (F.when(yes, 1) if no is None else F.when(no, -1).when(yes, 1)).otherwise(0)


def _voted(cands: DataFrame) -> DataFrame:
    """Candidates with the base rule, votes and features; texts without one keep their row."""
    found, before, after = F.col("found"), F.col("before"), F.col("after")
    number = F.regexp_replace(found, "[^0-9]", "")
    many = F.length(number)
    octet = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    quad = F.regexp_replace(found, r"[^0-9.]", "")
    valid_ip = quad.rlike(rf"^{octet}\.{octet}\.{octet}\.{octet}$")
    luhn = many.between(12, 19) & F.call_function("luhn_check", number)
    digits_ok = many.between(9, 15)
    domain_end = F.lower(F.regexp_extract(found, r"([A-Za-z0-9-]+)$", 1))
    rule = _by_kind(F.lit(True), valid_ip, luhn, digits_ok)
    valid = _by_kind(domain_end.rlike("^[a-z]{2,12}$"), valid_ip, luhn, digits_ok & ~number.rlike(r"^([0-9])\1+$"))
    known = _by_kind(domain_end.isin(DOMAIN_ENDS), ~quad.rlike(r"^(0|127|255|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."), number.rlike("^(4|5[1-5]|2[2-7]|3[47]|6)"),
                     found.rlike(r"^(\+|00)(1|2[0-9]|3[0-9]|4[0-9]|5[0-9]|6[0-9]|7|8[1-9]|9[0-9])") | number.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$"))
    unknown = _by_kind(~domain_end.rlike("^[a-z]"), quad.rlike(r"^0*\.|^(?:[0-9]\.){3}[0-9]$"), number.rlike(r"^([0-9])\1+$"), number.rlike(r"^0+$|^([0-9])\1+$"))
    near = F.lower(before)
    cue = _by_kind(*[near.rlike(CUES[k]) for k in KINDS])
    glued = before.rlike(r"[A-Za-z0-9_]$") | after.rlike(r"^[A-Za-z0-9_]")
    apart = (before.rlike(r"(^|[\s(\[<:,;|>])$") | (before == "")) & ((after == "") | after.rlike(r"^[\s)\]>.,;:!?|<]"))
    kind_of = lambda c: F.when(c == "", "edge").when(c.rlike(r"^\s$"), "space").when(c.rlike("^[A-Za-z]$"), "letter").when(c.rlike("^[0-9]$"), "digit").otherwise("mark")
    return cands.withColumns({
        "base": ~F.col("wider") & rule,
        "v_rule": F.when(F.col("wider"), 0).when(rule, 1).otherwise(-1),
        "v_valid": F.when(valid, 1).otherwise(-1),
        "v_gazetteer": _vote(known, unknown),
        "v_context": _vote(cue, near.rlike(NOT_PERSONAL)),
        "v_ends": _vote(apart, glued),
        "f_length": F.least(F.floor(F.length(found) / 4), F.lit(8)).cast("string"),
        "f_grouping": F.when(found.rlike("^[0-9]+$"), "solid").when(found.rlike("[0-9][ -][0-9]"), "grouped").when(found.rlike(r"[\[({]"), "bracket").otherwise("other"),
        "f_case": F.when(found.rlike("[A-Z]"), "upper").when(found.rlike("[a-z]"), "lower").otherwise("none"),
        "f_before": kind_of(F.right(before, F.lit(1))), "f_after": kind_of(F.left(after, F.lit(1)))})


#: one round: every pattern's probability under the odds, the sums of true and false candidates, the odds from the weighted counts
_ROUND = """
  element_at(transform(transform(
    array(transform(patterns, x -> named_struct('n', x.n, 'at', x.at, 'p', 1 / (1 + exp(-(odds[0] + aggregate(x.at, 0D, (a, i) -> a + odds[i]))))))),
    seen -> named_struct('seen', seen, 'yes', aggregate(seen, 1D, (a, x) -> a + x.n * x.p), 'no', aggregate(seen, 1D, (a, x) -> a + x.n * (1 - x.p)))),
    m -> concat(array(ln(m.yes / m.no)), transform(sequence(1, {last}), i -> ln(
        aggregate(m.seen, {smooth} * m.yes / (m.yes + m.no), (a, x) -> a + if(array_contains(x.at, i), x.n * x.p, 0))
      / aggregate(m.seen, {smooth} * m.no / (m.yes + m.no), (a, x) -> a + if(array_contains(x.at, i), x.n * (1 - x.p), 0))) - ln(m.yes / m.no)))), 1)
"""
#: candidates of a vote or value that are taken for granted, true and false as in all of the kind: what is hardly seen says little
SMOOTH = 2.0
SURE = 5


def _estimate(counts: DataFrame) -> DataFrame:
    """(kind, odds) by expectation-maximisation: odds[0] for any candidate of the kind, and
    odds[3 j + v + 2] when labeler j votes v.

    ``counts`` has a row per kind and vote pattern, 3^5 a kind at most, so a kind is one
    short array and all rounds are one expression over it. Odds start from the majority
    of votes. One candidate is put to either side, so no estimate is certain, and ``SURE``
    with all votes for and against, so that labelers are trusted where a kind shows one side only."""
    places = F.array(*[F.col(v) + 3 * j + 2 for j, v in enumerate(VOTES)])
    sure = counts.select("kind").distinct().withColumn("x", F.explode(F.array(F.lit(1), F.lit(-1))))
    counts = counts.select("kind", *VOTES, "n").unionByName(sure.select("kind", *[F.col("x").alias(v) for v in VOTES], F.lit(SURE).alias("n")))
    patterns = counts.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct(places.alias("at"), F.col("n").cast("double").alias("n")))).alias("patterns"))
    first = "array(0D" + ", -1D, 0D, 1D" * len(VOTES) + ")"
    rounds = f"aggregate(sequence(1, {ROUNDS}), {first}, (odds, round) -> {_ROUND.format(last=3 * len(VOTES), smooth=SMOOTH)})"
    return patterns.select("kind", F.expr(rounds).alias("odds"))


def _probability(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


def _classifier(cands: DataFrame, estimate: DataFrame) -> DataFrame:
    """(kind, prior, weights): naive Bayes over the features' values, learned from the
    estimated probabilities. Each feature has a few fixed values, so a kind's weights
    are a map of some fifty entries."""
    odds = sum((F.element_at("odds", F.col(v) + 3 * j + 3) for j, v in enumerate(VOTES)), F.element_at("odds", F.lit(1)))
    told = cands.join(F.broadcast(estimate), "kind").select("kind", _probability(odds).alias("p"), F.explode(_values()).alias("value"))
    sums = told.groupBy("kind", "value").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    # each candidate has one value of each feature
    whole = Window.partitionBy("kind")
    yes, no = (F.sum(c).over(whole) / len(FEATURES) + 1 for c in ("yes", "no"))
    share = yes / (yes + no)
    weight = F.ln((F.col("yes") + SMOOTH * share) / (F.col("no") + SMOOTH * (1 - share))) - F.ln(yes / no)
    return (sums.select("kind", F.ln(yes / no).alias("prior"), "value", weight.alias("weight"))
            .groupBy("kind").agg(F.max("prior").alias("prior"), F.map_from_entries(F.collect_list(F.struct("value", "weight"))).alias("weights")))


def _values() -> Column:
    return F.array(*[F.concat_ws("=", F.lit(f), F.col(f).cast("string")) for f in FEATURES])


def pii_spans(docs: DataFrame) -> DataFrame:
    """A row per span, and one with a null kind for a text without any: row (of the text
    in this run), doc_id, kind, start, end (code points, end exclusive), found, base, score."""
    cands = write_scratch(_voted(_candidates(docs)), "pii-candidates")
    real = cands.filter("kind is not null")
    model = _classifier(real, _estimate(real.groupBy("kind", *VOTES).agg(F.count(F.lit(1)).alias("n"))))
    odds = F.aggregate(_values(), F.col("prior"), lambda total, v: total + F.coalesce(F.element_at("weights", v), F.lit(0.0)))
    scored = cands.join(F.broadcast(model), "kind", "left").withColumn("score", _probability(odds))  # a row per kind
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    kept = (scored.withColumn("reach", F.max(F.when(F.col("base"), F.col("end"))).over(before))
            .withColumn("next", F.min(F.when(F.col("base"), F.col("start"))).over(behind))
            .withColumn("kept", F.expr("base or (wider and score > 0.5 and coalesce(reach <= start, true) and coalesce(next >= end, true))")))
    # a text none of whose candidates stay keeps its first row, without a kind
    any_kept = F.max(F.coalesce("kept", F.lit(False))).over(Window.partitionBy("row"))
    first = F.row_number().over(Window.partitionBy("row").orderBy("start", "end", "kind", "wider")) == 1
    rows = kept.withColumns({"any": any_kept, "first": first}).filter("kept or (not any and first)")
    names = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    only = lambda c: F.when(F.col("kept"), c)
    return rows.select("row", "doc_id", only(F.col("kind")).alias("kind_no"), only(names).alias("kind"),
                       *[only(F.col(c)).alias(c) for c in ("start", "end", "found", "base", "score")])


def pii_digest(docs: DataFrame) -> DataFrame:
    """A row per text: counts of base spans by kind, base_sha256 and all spans as text."""
    spans = pii_spans(docs)
    listed = F.when(F.col("kind").isNotNull(), F.struct("start", "kind_no", "end", "base", F.concat_ws(":", "kind", "start", "end").alias("text")))
    one = spans.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(listed)).alias("spans"),
                                   *[F.count_if(F.coalesce((F.col("kind") == k) & F.col("base"), F.lit(False))).alias(f"n_{k}") for k in KINDS])
    text = lambda a: F.array_join(F.transform(a, lambda s: s["text"]), ",")
    return one.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(text(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
                      text(F.col("spans")).alias("spans"))

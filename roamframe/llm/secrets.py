"""Secret scan: three fixed patterns and a randomness test battery, in DataFrame operations only.

Candidates of the battery are runs of token characters of some length.  Each gets an
inferred encoding (its alphabet) and three tests:

* chi-squared uniformity over that alphabet;
* a runs test on character classes (digit, upper, lower, other), which word-like and
  number-suffixed names fail;
* lag-one serial correlation of the codes, which counters and keyboard rows fail.

A candidate is *plausible* when Bonferroni's combination of the three does not reject
uniform letters.  For its p-value the same three features (letter frequencies, class changes,
neighbouring letters) are judged jointly against a model of ordinary words, names and numbers:
the likelihood of uniform draws from the inferred alphabet over that of the model has a mean
of at most one under the model, so its inverse is a p-value (Markov's inequality), whatever
the alphabet.  A candidate is a *discovery* when this p-value passes a Benjamini-Hochberg step-up made separately per band of lengths, so that short candidates,
where the tests have little power, don't borrow evidence from long ones.  The step-up
works on counts of p-values in bins, bands x bins rows however large the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roamframe.plans.scratch import stored

# The kinds in their order, pattern, and least length of the measured group.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = ("assign", "access", "hex", "random")
#: Greedy runs: asking for the least length inside the pattern equals matching and dropping.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"

# The model of ordinary tokens.  Percent of v(owels), c(onsonants), their capitals,
# d(igits) and s(igns) after each class, ^ at the start; numbers are short, capitals begin words.
CLASSES = "vcVCds"
AFTER = {
    "^": (20, 40, 7, 18, 10, 5), "v": (20, 64, 1, 3, 4, 8), "c": (50, 33, 1, 3, 4, 9), "V": (15, 45, 8, 22, 3, 7),
    "C": (40, 20, 17, 13, 4, 6), "d": (4, 9, 4, 9, 60, 14), "s": (25, 35, 8, 15, 12, 5),
}
#: Letters in ten thousand of English text.
LETTERS = {
    "a": 817, "b": 149, "c": 278, "d": 425, "e": 1270, "f": 223, "g": 202, "h": 609, "i": 697, "j": 15, "k": 77, "l": 403, "m": 241,
    "n": 675, "o": 751, "p": 193, "q": 10, "r": 599, "s": 633, "t": 906, "u": 276, "v": 98, "w": 236, "x": 15, "y": 197, "z": 7,
}
#: Alphabets that can be inferred, and the ways the model writes a word (as it is, or in capitals).
ALPHABETS, CASES = 11, 2
LENGTH_BANDS = (24, 32, 48)
BINS_PER_DECADE, MAX_BIN = 8, 400
FALSE_DISCOVERY, REJECT_UNIFORM = 0.01, 0.001


def _matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, found), in code points."""
    kind = "struct<pos:int,out:array<struct<start:int,end:int,found:string>>>"
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    none = F.struct(F.lit(0).alias("pos"), F.array().alias("out")).cast(kind)

    def step(acc: Column, part: Column) -> Column:
        start = acc["pos"] + F.length(part["gap"])
        end = start + F.coalesce(F.length(part["found"]), F.lit(0))
        grown = F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), part["found"].alias("found")))
        return F.struct(end.alias("pos"), F.when(part["found"].isNull(), acc["out"]).otherwise(grown).alias("out")).cast(kind)

    empty = F.array().cast("array<struct<start:int,end:int,found:string>>")
    return F.when(text.rlike(pattern), F.aggregate(parts, none, step)["out"]).otherwise(empty)


def _spans(matches: Column, kind: str) -> Column:
    rank = KINDS.index(kind)
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end")))


def _normal(z: Column) -> Column:
    """Standard normal distribution function, by a logistic with a cubic term; within a factor of five to z = -6."""
    return 1 / (1 + F.exp(-(1.5976 * z + 0.070565992 * z * z * z)))


def _ordinary() -> tuple[str, str, dict[str, float]]:
    """Characters and their classes, and -log10 of the model's probabilities of class pairs and of characters in their class."""
    of = {ch: "v" if ch in "aeiou" else "c" for ch in LETTERS}
    of |= {ch.upper(): k.upper() for ch, k in of.items()} | dict.fromkeys("0123456789", "d") | dict.fromkeys("+/_-", "s")
    weight = {ch: LETTERS.get(ch.lower(), 1) for ch in of}
    total = {k: sum(w for ch, w in weight.items() if of[ch] == k) for k in CLASSES}
    cost = {ch: -math.log10(w / total[of[ch]]) for ch, w in weight.items()}
    cost |= {a + b: -math.log10(p / 100) for a, row in AFTER.items() for b, p in zip(CLASSES, row, strict=True)}
    return "".join(of), "".join(of.values()), cost


def _surprise(token: Column) -> Column:
    """-log10 of the probability of a token as ordinary words, names and numbers; in capitals throughout they are as small letters."""
    characters, classes, cost = _ordinary()
    costs = F.create_map(*[F.lit(x) for pair in cost.items() for x in pair])
    plain = F.when(token.rlike("[a-z]"), token).otherwise(F.lower(token))
    kinds = F.translate(plain, characters, classes)
    pairs = F.zip_with(F.split(F.concat(F.lit("^"), kinds), ""), F.split(kinds, ""), lambda a, b: F.concat(a, b))
    parts = F.concat(F.split(plain, ""), F.filter(pairs, lambda x: x.isNotNull()))
    return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + F.element_at(costs, x))


def _battery(token: Column) -> Column:
    """(plausible, bin of the p-value against ordinary tokens) of one candidate."""
    n = F.length(token).cast("double")
    size = (
        F.when(token.rlike("^[0-9]+$"), 10).when(token.rlike("^[0-9a-f]+$") | token.rlike("^[0-9A-F]+$"), 16)
        .when(token.rlike("^[a-z]+$") | token.rlike("^[A-Z]+$"), 26).when(token.rlike("^[A-Z2-7]+$"), 32)
        .when(token.rlike("^[a-z0-9]+$") | token.rlike("^[A-Z0-9]+$"), 36).when(token.rlike("^[A-Za-z]+$"), 52).when(token.rlike("^[A-Za-z0-9]+$"), 62).otherwise(64)
    ).cast("double")
    letters = F.split(token, "")
    squares = F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda acc, c: acc + F.pow(n - F.length(F.replace(token, c, F.lit(""))), F.lit(2.0)))
    chi = size / n * squares - n
    p_even = 1 - _normal((chi - (size - 1)) / F.sqrt(2 * (size - 1)))

    def share(cls: str) -> Column:
        return F.length(F.regexp_replace(token, f"[^{cls}]", "")) / n

    parts = [share("0-9"), share("A-Z"), share("a-z"), share("+/_-")]
    change = 1 - sum((p * p for p in parts[1:]), parts[0] * parts[0])
    runs = F.regexp_count(token, F.lit("[0-9]+|[A-Z]+|[a-z]+|[^0-9A-Za-z]+")) - 1
    p_runs = F.when(change < 0.02, 1.0).otherwise(_normal((runs - (n - 1) * change) / F.sqrt((n - 1) * change * (1 - change) + 0.25)))
    codes = F.transform(letters, lambda c: F.ascii(c).cast("double"))
    mean = F.aggregate(codes, F.lit(0.0), lambda acc, x: acc + x) / n
    var = F.aggregate(codes, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
    lagged = F.aggregate(F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: (a - mean) * (b - mean)), F.lit(0.0), lambda acc, x: acc + x)
    p_serial = F.when(var < 1e-9, 0.0).otherwise(2 * _normal(-F.abs((lagged / var + 1 / (n - 1)) * F.sqrt(n))))
    plausible = 3 * F.least(p_even, p_runs, p_serial) >= REJECT_UNIFORM
    evidence = _surprise(token) - n * F.log10(size) - math.log10(ALPHABETS * CASES)
    bin_no = F.least(F.floor(F.greatest(evidence, F.lit(0.0)) * BINS_PER_DECADE), F.lit(MAX_BIN)).cast("int")
    band = sum((F.when(n >= b, 1).otherwise(0) for b in LENGTH_BANDS), F.lit(0))
    return F.struct(plausible.alias("plausible"), bin_no.alias("bin"), band.cast("int").alias("band"))


def _step_up(found: DataFrame) -> DataFrame:
    """One row: per band the smallest bin that passes the Benjamini-Hochberg step-up, as a map."""
    counts = found.select(F.explode("candidates").alias("c")).groupBy("c.band", "c.bin").count()
    down = W.partitionBy("band").orderBy(F.desc("bin"))
    ranked = counts.select("band", "bin", F.sum("count").over(down).alias("k"), F.sum("count").over(W.partitionBy("band")).alias("m"))
    passing = ranked.filter(F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE) <= FALSE_DISCOVERY * F.col("k") / F.col("m"))
    least = passing.groupBy("band").agg(F.min("bin").alias("bin"))
    return least.agg(F.map_from_entries(F.collect_list(F.struct("band", "bin"))).alias("least"))


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Spans of secrets in every text: ``doc_id, n_assign, n_access, n_hex, n_random, base_spans, spans``.

    Each input row gives a row; null and empty texts have no spans.  Of the base kinds, matches
    run leftmost and non-overlapping per kind, and those of too short a value are dropped.  The
    battery adds spans of kind ``random`` that touch no base span.  Other columns of ``docs``
    are ignored, and an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    scanned = docs.select("doc_id", _matches(text, ASSIGN).alias("a"), _matches(text, ACCESS).alias("k"), _matches(text, HEX).alias("h"), _matches(text, CANDIDATE).alias("c"))
    long_value = F.filter("a", lambda m: F.length(F.regexp_extract(m["found"], ASSIGN, 2)) >= 6)
    spans = scanned.select("doc_id", _spans(long_value, "assign").alias("a"), _spans(F.col("k"), "access").alias("k"), _spans(F.col("h"), "hex").alias("h"), "c")
    merged = spans.withColumn("base", F.concat("a", "k", "h"))
    apart = F.filter("c", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    tested = F.transform(apart, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), _battery(m["found"]).alias("t")))
    flat = F.transform(tested, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["t"]["plausible"].alias("plausible"), m["t"]["bin"].alias("bin"), m["t"]["band"].alias("band")))
    found = merged.select(
        "doc_id", F.size("a").cast("long").alias("n_assign"), F.size("k").cast("long").alias("n_access"), F.size("h").cast("long").alias("n_hex"),
        "base", flat.alias("candidates"),
    )
    found = stored(found, "secrets")
    least = _step_up(found).scalar()
    passed = F.filter("candidates", lambda c: c["plausible"] & F.coalesce(c["bin"] >= F.element_at("least", c["band"]), F.lit(False)))
    random = F.transform(passed, lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index("random")).alias("rank"), c["end"].alias("end")))
    out = found.withColumn("least", least).withColumn("random", random)
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.size("random").cast("long").alias("n_random"),
        _joined(F.col("base")).alias("base_spans"), _joined(F.concat("base", "random")).alias("spans"),
    )

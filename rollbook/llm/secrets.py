"""Secret scans: patterns of known forms, and character Markov models for strings of no known form.

Two first-order models over the characters of keys, one of random strings and one of ordinary identifiers,
are counted from labelled samples; a long run of key characters is a secret if its log-likelihood ratio for each
character is high enough for its length, by a threshold calibrated on samples kept back.  Everything runs as
DataFrame and SQL functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.shared import packed, unpacked, written
from rollbook.llm.spans import empty, in_order, labelled, listed, masked, with_matches

#: The forms that are always reported, in the order in which equal starts are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

#: Words without which there is no assignment; a cheap test before the pattern.
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Characters of the Markov models, and runs of them.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}"


#: Ratio for each pair of characters that is asked for where no sample tells one.
LEAST = 0.6


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``assign``, ``access`` and ``hex``: the matches of the known forms in ``text``."""
    low = F.lower("text")
    named = low.contains(_WORDS[0])
    for word in _WORDS[1:]:
        named = named | low.contains(word)
    out = with_matches(docs, "assign", "text", ASSIGN, named)
    # A match with too short a value is dropped, and what it covers is not searched again.
    out = out.withColumn("assign", F.filter("assign", lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 2)) >= 6))
    out = with_matches(out, "access", "text", ACCESS, F.col("text").contains("AKIA"))
    return with_matches(out, "hex", "text", HEX, F.col("text").rlike(HEX))


#: Four words in a row.
_FOUR = "[A-Za-z]{2,}+(?:[^A-Za-z]++[A-Za-z]{2,}+){3}"

#: Lengths from which on a threshold of its own holds.
_STEPS = (24, 32, 40, 48)


def fit(docs: DataFrame, rows: int = 1000, shortest: int = 20, false: float = 0.005) -> tuple[list[float], dict[int, float]]:
    """Log-likelihood ratios of character pairs (random over ordinary, ``len(ALPHABET) ** 2``), and the least by length.

    The labelled samples come from at most ``rows`` documents with a match of a known form and ``rows`` documents at
    large, each the first in order of a hash.  Random are the values of known forms (of 16 or more characters with a
    digit, so that no word is taken for a key) and digests of the texts, written in the alphabets that keys are
    written in.  Ordinary are the words of the texts, joined as names, paths, constants and dated names, and numbers.
    A fifth of the documents is kept back: the threshold of a length is what all random strings of it but a fiftieth
    exceed, less a fifth of the way down to what all ordinary ones but a share of ``false`` stay below, and never below that.
    Pairs never seen have a value too; without any sample all ratios are zero.
    """
    texts = docs.select("text", F.xxhash64(*docs.columns).alias("_order")).where("text is not null")
    strict = ACCESS + "|" + HEX + "|" + ASSIGN.replace("]+)", "]{6,})")
    with_secret = _first(texts, F.col("text").rlike(strict), rows)
    at_large = _first(texts, F.lit(True), rows)
    keys = F.concat(
        F.transform("assign", lambda m: F.regexp_extract(m["value"], ASSIGN, 2)),
        F.transform("access", lambda m: m["value"]),
        F.transform("hex", lambda m: m["value"]),
    )
    fold = F.pmod("_order", F.lit(5)).alias("fold")
    found = base_spans(with_secret).select(fold, F.lit(1).alias("label"), F.explode(keys).alias("value")).where(r"value rlike '[0-9]' and length(value) >= 16")
    digests = at_large.select(fold, F.lit(1).alias("label"), F.explode(_random_strings()).alias("value"))
    four = F.posexplode(F.regexp_extract_all("text", F.lit(_FOUR), F.lit(0))).alias("k", "four")
    plain = base_spans(at_large).select(fold, keys.alias("keys"), four).select("fold", "keys", _ordinary_strings(F.col("four"), F.col("k")).alias("value"))
    plain = plain.where(~F.exists("keys", lambda k: F.contains(F.col("value"), k) | F.contains(k, F.col("value"))))
    samples = written(found.unionAll(digests).unionAll(plain.select("fold", F.lit(0).alias("label"), "value")))
    both = samples.where("fold <> 0").withColumn("places", _places(F.col("value"))).where(F.size("places") > 1)
    shifted = F.slice("places", F.lit(2), F.size("places") - 1)
    pairs = F.zip_with(F.slice("places", F.lit(1), F.size("places") - 1), shifted, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    counted = both.select("label", F.explode(pairs).alias("pair")).groupBy("label", "pair.a", "pair.b").count()
    size = len(ALPHABET)
    counts = [[[0.0] * size for _ in range(size)] for _ in range(2)]
    for row in counted.collect():  # at most two rows for each pair of characters
        counts[row["label"]][row["a"] - 1][row["b"] - 1] += row["count"]
    ratios = [y - x for x, y in zip(_log_chances(counts[0]), _log_chances(counts[1]), strict=True)]
    steps = [shortest, *(n for n in _STEPS if n > shortest)]
    cut = samples.where("fold = 0").select("label", "value", F.explode(F.array(*map(F.lit, steps))).alias("n")).where("length(value) >= n")
    scored = cut.select("label", "n", (score(F.expr("substring(value, 1, n)"), ratios) / (F.col("n") - 1)).alias("s"))
    ends = scored.groupBy("n").agg(
        F.expr(f"percentile_approx(s, {1 - false}) filter (where label = 0)").alias("ordinary"),
        F.expr("percentile_approx(s, 0.02) filter (where label = 1)").alias("random"),
    )
    least = {}
    for row in ends.collect():  # one row for each step
        low = max(0.0, row["ordinary"] or 0.0)
        least[row["n"]] = low + 0.8 * max(0.0, row["random"] - low) if row["random"] is not None else max(low, LEAST)
    return ratios, {n: least.get(n, LEAST) for n in steps}


def _random_strings() -> Column:
    """Strings out of digests of ``text`` in the alphabets of keys; leaving characters out keeps the others equally likely."""
    left_out = ["", "[+/=]", "[+/=a-z]", "[+/=A-Z]", "[+/=a-z0189]", "[+/=A-Z0189]"]
    digest = lambda k: F.base64(F.unhex(F.sha2(F.concat("text", F.lit(f" {k}")), 512)))
    made = [F.regexp_replace(digest(k), gone, "") if gone else F.substring(digest(k), 1, 80) for k, gone in enumerate(left_out)]
    return F.array(*made, F.translate(F.substring(digest(6), 1, 80), "+/", "-_"), F.sha2("text", 256))


def _ordinary_strings(four: Column, k: Column) -> Column:
    """Four words in a row, the ``k``-th ones of a text, joined as in names, paths, constants or dated names, or a number."""
    words = F.regexp_extract_all(four, F.lit("[A-Za-z]+"), F.lit(0))
    day = F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), F.pmod(F.xxhash64(four, k), F.lit(16000)).cast("int")), "yyyy-MM-dd")
    number = lambda seed: F.abs(F.xxhash64(four, k, F.lit(seed))).cast("string")
    capitals = F.array_join(F.transform(words, F.initcap), "")
    small = [F.lower(F.array_join(words, glue)) for glue in ("_", "-", "/", "")]
    forms = [
        *small,
        F.upper(F.array_join(words, "_")),
        capitals,
        F.concat(F.lower(F.substring(capitals, 1, 1)), F.substring(capitals, 2, 1000)),
        F.array_join(words, "-"),
        F.concat(small[1], F.lit("-"), day),
        F.concat(small[0], F.lit("_"), F.substring(number(1), 1, 4)),
        F.concat(day, F.lit("-"), small[1]),
        F.concat(number(1), number(2)),
    ]
    which = F.pmod(F.xxhash64(four, k, F.lit(3)), F.lit(len(forms)))
    out = F.when(which == 0, forms[0])
    for n, form in enumerate(forms[1:], 1):
        out = out.when(which == n, form)
    return out


def _log_chances(counts: list[list[float]], weight: float = 64.0) -> list[float]:
    """Logarithms of the chances of the second character of each pair, given the first.

    Pairs are blended with the chances of single characters, which count as ``weight`` more pairs; half an
    occurrence is added to every single character.
    """
    size = len(counts)
    single = [0.5 + sum(row[b] for row in counts) for b in range(size)]
    whole = sum(single)
    return [math.log((row[b] + weight * single[b] / whole) / (sum(row) + weight)) for row in counts for b in range(size)]


def _first(texts: DataFrame, wanted: Column, rows: int) -> DataFrame:
    """The ``rows`` wanted texts that are first in order of the hash; only hashes are sorted, no texts."""
    last = texts.where(wanted).select("_order").orderBy("_order").limit(rows).agg(F.max("_order")).first()[0]
    return texts.where(F.col("_order") <= F.lit(last).cast("long")).where(wanted).limit(rows)


def _places(value: Column) -> Column:
    """Place in the alphabet of each character of a string, from one; others are left out."""
    characters = F.regexp_extract_all(value, F.lit("."), F.lit(0))
    return F.filter(F.transform(characters, lambda c: F.call_function("instr", F.lit(ALPHABET), c)), lambda place: place > 0)


def score(value: Column, ratios: list[float]) -> Column:
    """Log-likelihood ratio of a string, random over ordinary; characters outside the alphabet are skipped."""
    table = F.expr("cast(split('" + ",".join(f"{x:.6f}" for x in ratios) + "', ',') as array<double>)")
    size = len(ALPHABET)
    start = F.struct(F.lit(0).alias("before"), F.lit(0.0).alias("sum"))

    def step(state: Column, place: Column) -> Column:
        pair = F.when(state["before"] > 0, F.element_at(table, (state["before"] - 1) * size + place)).otherwise(0.0)
        return F.struct(place.alias("before"), (state["sum"] + pair).alias("sum"))

    return F.aggregate(_places(value), start, step, lambda state: state["sum"])


def _least(length: Column, least: dict[int, float]) -> Column:
    """The value of the greatest step that the length reaches."""
    first, *others = sorted(least)
    out = F.lit(least[first])
    for n in others:
        out = F.when(length >= n, F.lit(least[n])).otherwise(out)
    return out


def scan_secrets(docs: DataFrame, ratios: list[float] | None = None, shortest: int = 20, least: dict[int, float] | None = None) -> DataFrame:
    """``docs`` with ``assign``, ``access``, ``hex``, ``random`` (matches) and ``spans`` (all of them, sorted).

    ``random`` has the runs of ``shortest`` or more key characters that touch no known form and whose log-likelihood
    ratio for each pair of characters reaches ``least``, a value by length.  Both are fitted on ``docs`` unless
    ``ratios`` are given.  A null or empty text has no spans; columns with these names are replaced.
    """
    if ratios is None:
        ratios, fitted = fit(docs, shortest=shortest)
        least = least or fitted
    least = least or {shortest: LEAST}
    out = base_spans(docs.drop(*KINDS, "spans"))
    out = with_matches(out, "random", "text", _RUN % shortest, F.col("text").rlike(_RUN % shortest))
    known = F.concat("assign", "access", "hex")
    free = F.filter("random", lambda m: ~F.exists(known, lambda k: (k["start"] < m["end"]) & (m["start"] < k["end"])))
    out = out.withColumn("random", F.when(F.size("random") > 0, free).otherwise(empty()))
    out = out.withColumn("random", F.filter("random", lambda m: score(m["value"], ratios) >= _least(F.length(m["value"]), least) * (F.length(m["value"]) - 1)))
    return out.withColumn("spans", in_order(*[labelled(F.col(kind), k, kind) for k, kind in enumerate(KINDS)]))


def secret_report(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: counts and digests of the known forms, and all spans as text."""
    found = scan_secrets(docs.select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]],
        F.sha2(listed(F.filter("spans", lambda s: s["order"] < 3)), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets, and ``n_chars``, where there is one, to match."""
    found = scan_secrets(packed(docs, F.col("text")))
    some = F.size("spans") > 0
    found = found.withColumn("text", F.when(some, masked(F.col("text"), F.col("spans"))).otherwise(F.col("text")))
    replaced = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        replaced["n_chars"] = F.when(some, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    return unpacked(found, docs, **replaced)

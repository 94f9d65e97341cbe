"""Personal data: patterns of known forms, and boosted trees over the candidates of high-recall generators.

Generators propose spans, overlapping ones too; boosted trees judge each by its format and its context, and a
threshold for each generator, calibrated on documents kept back, selects what is redacted.  Positive samples are the
checked matches of the known forms, as they are and rewritten into forms that the known patterns miss; negative ones
are candidates that fail a check, and dates, versions, ranges and other ordinary numbers put into the same texts.
Everything runs as DataFrame and SQL functions; the fitted trees become SQL expressions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.shared import packed, unpacked, written
from rollbook.llm.spans import empty, in_order, labelled, listed, masked, with_matches

#: The forms that are always reported, in the order in which equal starts are listed.  Runs are
#: possessive and begin where a run can begin, so long texts are searched in linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: Generators of candidates: anything like an address, a number with separators, four groups of four digits, a dotted quad.
GENERATORS = {
    "mail": r"(?<![^\s@\[\]():;,<>\"'])[^\s@\[\]():;,<>\"']++(?:@|\x20?[\[(]at[\])]\x20?)[^\s@\[\]():;,<>\"'.]++(?:\.[^\s@\[\]():;,<>\"'.]++)*+",
    "number": r"[+(]?[0-9](?<![0-9A-Za-z][+(]?[0-9])(?:[\x20().-]{0,2}[0-9]){6,24}+(?![0-9A-Za-z])",
    "group": r"[0-9](?<![0-9A-Za-z][0-9])[0-9]{3}(?:[\x20-]?[0-9]{4}){3}(?![0-9A-Za-z])",
    "quad": r"[0-9](?<![0-9A-Za-z.][0-9])[0-9]{0,2}(?:\.[0-9]{1,3}){3}(?![0-9])",
}

_DATE = r"^(?:(?:1[5-9]|20)[0-9]{2}[-./ ](?:0?[1-9]|1[0-2])[-./ ][0-3]?[0-9]|[0-3]?[0-9][-./ ][0-3]?[0-9][-./ ](?:1[5-9]|20)[0-9]{2})(?![0-9])"
_CONTEXT = r"(?i)(?:mail|contact|tel|phone|call|fax|mobil|card|visa|credit|pay|host|addr|server|ip)[^\n]{0,12}$"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    backwards = F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0))
    values = F.transform(backwards, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.floor(d.cast("int") / 5).cast("int") + d.cast("int") * 2 % 10))
    return F.aggregate(values, F.lit(0), lambda total, d: total + d) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``email``, ``ip``, ``card`` and ``phone``: the matches in ``text`` that pass their check."""
    text = F.col("text")
    out = with_matches(docs, "email", "text", EMAIL, text.contains("@"))
    out = with_matches(out, "ip", "text", IP, text.rlike(r"[0-9]\.[0-9]"))
    out = out.withColumn("ip", F.filter("ip", lambda m: m["value"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")))
    out = with_matches(out, "card", "text", CARD, text.rlike(CARD))
    out = out.withColumn("card", F.filter("card", lambda m: luhn(_digits(m["value"]))))
    out = with_matches(out, "phone", "text", PHONE, text.contains("+"))
    return out.withColumn("phone", F.filter("phone", lambda m: F.length(_digits(m["value"])).between(10, 15)))


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with one array of spans with ``features`` for each generator, named after it."""
    text = F.col("text")
    out = docs
    for k, (name, pattern) in enumerate(GENERATORS.items()):
        gate = text.contains("@") | text.contains("(at)") | text.contains("[at]") if name == "mail" else text.rlike(pattern)
        out = with_matches(out, name, "text", pattern, gate)
        out = out.withColumn(name, F.transform(name, _judged(text, k)))
    return out


def _judged(text: Column, generator: int) -> Callable[[Column], Column]:
    """A span with the features of its generator."""
    return lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), _features(text, m, generator).alias("f"))


def _named(generator: str) -> Callable[[Column], Column]:
    """A judged span with the name of its generator."""
    return lambda m: F.struct(F.lit(generator).alias("generator"), m["start"].alias("start"), m["end"].alias("end"), m["f"].alias("f"))


def _features(text: Column, m: Column, generator: int) -> Column:
    """Format and context of a candidate as numbers."""
    value, digits = m["value"], _digits(m["value"])
    groups = F.filter(F.split(value, "[^0-9]+"), lambda g: g != "")
    before = F.substring(text, F.greatest(m["start"] - 23, F.lit(1)), F.least(m["start"], F.lit(24)))
    after = F.substring(text, m["end"] + 1, F.lit(1))
    flags = [
        value.startswith("+"),
        value.rlike(r"(?:@|[\])]\x20?)[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$"),
        value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        F.length(digits).between(14, 19) & luhn(digits),
        before.rlike(_CONTEXT),
        before.rlike(r"[0-9A-Za-z=\"'_/-]$"),
        after.rlike(r"[0-9A-Za-z=\"'_/-]"),
        value.rlike(_DATE),
        value.startswith("("),
        value.startswith("0"),
        value.rlike("^97[89]"),
    ]
    sizes = F.transform(groups, lambda g: F.length(g))
    numbers = [
        F.length(value),
        F.length(digits),
        F.length(F.regexp_replace(value, "[0-9A-Za-z]", "")),
        F.length(F.regexp_replace(value, "[^.]", "")),
        F.size(groups),
        F.coalesce(F.array_max(sizes), F.lit(0)),
        F.coalesce(F.array_min(sizes), F.lit(0)),
        F.coalesce(F.try_element_at(sizes, F.lit(1)), F.lit(0)),
        F.coalesce(F.try_element_at(sizes, F.lit(-1)), F.lit(0)),
        F.size(F.array_distinct(F.regexp_extract_all(value, F.lit("[^0-9]+"), F.lit(0)))),
        F.lit(generator),
    ]
    return F.array(*[F.coalesce(f, F.lit(False)).cast("int").cast("double") for f in flags], *[n.cast("double") for n in numbers])


def _overlaps(m: Column, spans: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"]))


@dataclass(frozen=True)
class Model:
    """Boosted trees (weight and nested tuples ``(feature, threshold, left, right)``) and a threshold for each generator."""

    trees: list = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)

    def chance(self, features: Column) -> Column:
        """Trees are rows of numbers that a few expressions walk, so the plan does not grow with their nodes."""
        if not self.trees:
            return F.lit(0.5)
        depth = max(_depth(tree) for _, tree in self.trees)
        nodes: list[tuple[int, float]] = []
        leaves: list[float] = []
        for _, tree in self.trees:
            level = [tree]
            for _ in range(depth):
                nodes += [(at[0], at[1]) if isinstance(at, tuple) else (0, 0.0) for at in level]
                level = [below for at in level for below in (at[2:] if isinstance(at, tuple) else (at, at))]
            leaves += [float(leaf) for leaf in level]
        # A node's children follow it at twice its place; a leaf above the last level stands at both sides below it.
        places, bounds, values = _numbers([place for place, _ in nodes], "int"), _numbers([bound for _, bound in nodes], "double"), _numbers(leaves, "double")
        weights, inner = _numbers([float(weight) for weight, _ in self.trees], "double"), (1 << depth) - 1

        def leaf(tree: Column) -> Column:
            def below(at: Column, _: Column) -> Column:
                node = tree * inner + at
                return at * 2 + F.when(F.get(features, F.get(places, node)) <= F.get(bounds, node), 1).otherwise(2)

            reached = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), below) if depth else F.lit(0)
            return F.get(values, tree * (inner + 1) + reached - inner)

        each = F.sequence(F.lit(0), F.lit(len(self.trees) - 1))
        margin = F.aggregate(each, F.lit(0.0), lambda total, tree: total + F.get(weights, tree) * leaf(tree))
        return 1 / (1 + F.exp(-2 * margin))


def _numbers(values: list, kind: str) -> Column:
    """Numbers as one literal array: doubles travel as text with all their digits."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _depth(tree: object) -> int:
    return 1 + max(_depth(tree[2]), _depth(tree[3])) if isinstance(tree, tuple) else 0


def _read(lines: list[str]) -> object:
    """A tree from its printed form; consumes the lines."""
    line = lines.pop(0).strip()
    if line.startswith("Predict:"):
        return float(line.split(":")[1])
    place, threshold = re.match(r"If \(feature (\d+) <= ([-\d.Ee+]+)\)", line).groups()
    left = _read(lines)
    lines.pop(0)  # Else
    return int(place), float(threshold), left, _read(lines)


def _rewritten(kind: str, value: Column) -> Column:
    """A match of a known form as it is and in forms of the same thing that the known patterns miss."""
    digits = _digits(value)
    last = lambda begin, size: F.substring(digits, F.length(digits) - 10 + begin, F.lit(size))
    national = [last(1, 3), last(4, 3), last(7, 4)]
    four = F.regexp_extract_all(digits, F.lit("[0-9]{1,4}"), F.lit(0))
    short = F.regexp_replace(value, r"^([A-Za-z0-9]+)[^@]*@(?:[^.]+\.)*?([^.]+\.[^.]+)$", "$1@$2")
    forms = {
        "email": [F.regexp_replace(name, "@", glue) for name in (value, short) for glue in ("@", " (at) ", "(at)", " [at] ", "[at]")],
        "ip": [],
        "card": [digits, F.array_join(four, " "), F.array_join(four, "-")],
        "phone": [
            F.regexp_replace(value, r"^\+", ""),
            F.concat(F.lit("00"), F.regexp_replace(value, r"^\+", "")),
            *(F.array_join(F.array(*national), glue) for glue in ("-", ".", " ")),
            F.concat(F.lit("("), national[0], F.lit(") "), national[1], F.lit("-"), national[2]),
            F.concat(F.lit("0"), F.substring(national[0], 1, 2), F.lit(" "), national[1], F.lit(" "), national[2]),
        ],
    }
    return F.array(value, *forms[kind])


def _drawn(*seed: Column | str) -> Column:
    """Eighteen digits out of a hash."""
    return F.lpad(F.pmod(F.xxhash64(*seed), F.lit(10**18)).cast("string"), 18, "0")


def _ordinary(drawn: Column) -> Column:
    """One of the ordinary forms of numbers and addresses that are no personal data, made of drawn digits."""
    d = lambda begin, size: F.substring(drawn, begin, size)
    of = lambda begin, n: F.lpad((F.pmod(d(begin, 4).cast("int"), F.lit(n)) + 1).cast("string"), 2, "0")
    year, later, month, day = F.concat(F.lit("19"), d(1, 2)), F.concat(F.lit("20"), d(3, 2)), of(5, 12), of(9, 28)
    dashed = lambda glue, *parts: F.concat_ws(glue, *parts)
    isbn = F.when(d(1, 1) < "5", "978").otherwise("979")
    forms = [
        *(dashed(glue, y, month, day) for glue in ("-", ".", " ") for y in (year, later)),
        *(dashed(glue, day, month, y) for glue in (".", "-") for y in (year, later)),
        F.concat(dashed("-", later, month, day), F.lit(" "), of(13, 12), F.lit("."), of(9, 28)),
        dashed("-", year, later),
        F.concat(dashed("-", d(1, 3), d(4, 3)), F.lit(" "), dashed("-", d(7, 3), d(10, 3))),
        dashed("-", d(1, 4), d(5, 4)),
        dashed("-", isbn, d(1, 1), d(2, 2), d(4, 6), d(10, 1)),
        dashed("-", isbn, d(1, 1), d(2, 4), d(6, 4), d(10, 1)),
        F.concat(isbn, d(1, 10)),
        dashed(".", d(1, 2), d(3, 3), d(6, 3)),
        dashed(".", d(1, 1), d(2, 1), d(3, 2), d(5, 4)),
        dashed(".", d(1, 2), d(3, 1), d(4, 2), d(6, 4)),
        dashed(".", F.concat(F.lit("3"), d(1, 2)), d(3, 1), d(4, 2), d(6, 2)),
        dashed("-", d(1, 4), d(5, 4), d(9, 3)),
        dashed("-", d(1, 2), d(3, 5), d(8, 2)),
        dashed(" ", d(1, 2), d(3, 3), d(6, 3)),
        d(1, 8),
        d(1, 11),
        d(1, 16),
        dashed("-", d(1, 4), d(5, 4), d(9, 4), d(13, 4)),
        dashed(" ", d(1, 4), d(5, 4), d(9, 4), d(13, 4)),
        F.concat(F.lit("user"), d(1, 2), F.lit("@host"), d(3, 2)),
        F.concat(F.lit("look (at) item"), d(3, 2)),
        F.concat(dashed(".", d(1, 1), d(2, 2)), F.lit("@each")),
        F.concat(dashed(".", F.lit("part"), d(1, 1), d(2, 1), d(3, 1)), F.lit(" [at] page"), d(4, 2)),
    ]
    return F.element_at(F.array(*forms), F.pmod(F.xxhash64(drawn), F.lit(len(forms))).cast("int") + 1)


def _examples(source: DataFrame, each: int = 16) -> DataFrame:
    """``fold, generator, f, label`` of the rewritten and the ordinary forms, put into stretches of the texts.

    A rewritten form stands where its match stood; ``each`` ordinary ones stand after blanks anywhere in the text, and
    one in the place of every match.  Only forms that a generator proposes as a whole are examples.
    """
    text = F.col("text")
    before = lambda m: F.substring(text, F.greatest(m["start"] - 23, F.lit(1)), F.least(m["start"], F.lit(24)))
    after = lambda m: F.substring(text, m["end"] + 1, F.lit(12))
    parts = []
    for kind in KINDS:
        one = source.select("order", "fold", "text", F.posexplode(kind).alias("k", "m"))
        around = one.select("order", "fold", "k", before(F.col("m")).alias("before"), F.col("m.value").alias("value"), after(F.col("m")).alias("after"))
        parts.append(around.select("fold", F.lit(1.0).alias("label"), "before", F.explode(_rewritten(kind, F.col("value"))).alias("value"), "after"))
        parts.append(around.select("fold", F.lit(0.0).alias("label"), "before", _drawn("order", "k", F.lit(kind)).alias("value"), "after"))
    at = source.select("order", "fold", "text", F.explode(F.sequence(F.lit(1), F.lit(each))).alias("k"))
    at = at.withColumn("at", F.pmod(F.xxhash64("order", "k"), F.length("text") + 1).cast("int"))
    begin = F.regexp_replace(F.substring(text, F.greatest(F.col("at") - 39, F.lit(1)), F.least("at", F.lit(40))), r"[^\s]+$", "")
    rest = F.regexp_extract(F.substring(text, F.col("at") + 1, F.lit(40)), r"(?s)[\s,.;].*", 0)
    parts.append(at.select("fold", F.lit(0.0).alias("label"), begin.alias("before"), _drawn("order", "k", F.lit("")).alias("value"), rest.alias("after")))
    made = parts[0]
    for part in parts[1:]:
        made = made.unionAll(part)
    made = made.withColumn("value", F.when(F.col("label") == 1, F.col("value")).otherwise(_ordinary(F.col("value"))))
    begin, end = F.length("before"), F.length("before") + F.length("value")
    placed = made.select("fold", "label", begin.alias("begin"), end.alias("end"), F.concat("before", "value", "after").alias("text"))
    found = candidates(placed)
    parts = [F.transform(name, _named(name)) for name in GENERATORS]
    one = found.select("fold", "begin", "end", "label", F.explode(F.concat(*parts)).alias("m")).where("m.start = begin and m.end = end")
    # By chance a drawn number may be a right one.
    right = F.when(F.col("m.generator") == "quad", F.col("m.f")[_QUAD] == 1).otherwise(F.col("m.f")[_LUHN] == 1)
    return one.select("fold", "m.generator", F.col("m.f").alias("f"), "label").where(F.col("label").eqNullSafe(1.0) | ~right)


#: Places of two features: a dotted quad in range, and a number that passes the Luhn check.
_QUAD, _LUHN = 2, 3


def fit(docs: DataFrame, trees: int = 20, depth: int = 4, precision: float = 0.995, seed: int = 3) -> Model:
    """Boosted trees and thresholds from all documents with a candidate.

    Labelled 1 are candidates that are checked matches of a known form, and such matches rewritten into other forms;
    labelled 0 are candidates that overlap no match and fail their check, and ordinary numbers put into the texts
    (``_examples``).  Other candidates are left out: nobody knows what they are.  Equal examples are counted and enter
    once with that weight.  Four fifths of the documents grow the trees; on the rest each generator gets the lowest
    threshold (0.5 at least, halfway between the chances that occur) at which ``precision`` of the selected candidates
    are labelled 1, or none if there is no such.
    """
    texts = docs.select("text", F.xxhash64(*docs.columns).alias("order")).where("text is not null")
    wanted = F.col("text").contains("@") | F.col("text").rlike(GENERATORS["number"])
    source = written(base_spans(texts.where(wanted).select("text", "order", F.pmod("order", F.lit(5)).alias("fold"))))
    known = F.concat(*KINDS)
    parts = [F.transform(name, _named(name)) for name in GENERATORS]
    one = candidates(source).select("fold", known.alias("known"), F.explode(F.concat(*parts)).alias("m"))
    exact = F.exists("known", lambda s: (s["start"] == F.col("m.start")) & (s["end"] == F.col("m.end")))
    failed = ((F.col("m.generator") == "group") & (F.col("m.f")[_LUHN] == 0)) | ((F.col("m.generator") == "quad") & (F.col("m.f")[_QUAD] == 0))
    label = F.when(exact, 1.0).when(~_overlaps(F.col("m"), F.col("known")) & failed, 0.0)
    one = one.select("fold", "m.generator", F.col("m.f").alias("f"), label.alias("label")).where("label is not null")
    # The features are few small numbers: equal examples are one row with their count.
    held = (F.col("fold") == 0).alias("held")
    one = written(one.unionAll(_examples(source)).groupBy(held, "generator", "f", "label").agg(F.count(F.lit(1)).cast("double").alias("n")))
    seen = {row["label"] for row in one.where("not held").select("label").distinct().collect()}
    if len(seen) < 2:
        return Model()
    grown = one.where("not held").groupBy("f", "label").agg(F.sum("n").alias("n")).select(array_to_vector("f").alias("features"), "label", "n")
    fitted = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, featuresCol="features", labelCol="label", weightCol="n").fit(grown)
    model = Model([(weight, _read(tree.toDebugString.strip().split("\n")[1:])) for weight, tree in zip(fitted.treeWeights, fitted.trees, strict=True)])
    kept_back = one.where("held").select("generator", F.round(model.chance(F.col("f")), 3).alias("chance"), "label", "n")
    steps = kept_back.groupBy("generator", "chance").agg(F.sum(F.col("label") * F.col("n")).alias("good"), F.sum("n").alias("n")).collect()  # at most 1001 steps each
    thresholds = {}
    for name in GENERATORS:
        good = n = 0.0
        found = sorted((r for r in steps if r["generator"] == name), key=lambda r: -r["chance"])
        for row, lower in zip(found, [*(r["chance"] for r in found[1:]), 0.0], strict=True):
            good, n = good + row["good"], n + row["n"]
            if good >= precision * n and row["chance"] >= 0.5:
                thresholds[name] = max(0.5, (row["chance"] + lower) / 2)
    return Model(model.trees, thresholds)


def find_personal_data(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with the matches of each known form, the selected candidates of each generator, and ``spans`` (all, sorted).

    Selected candidates are those that touch no known form (those of "number" no selected one of "group" or "quad" either)
    and reach their generator's threshold.  The model
    is fitted on ``docs`` unless it is given.  A null or empty text has no spans; columns with these names are replaced.
    """
    model = fit(docs) if model is None else model
    names = [*KINDS, *GENERATORS]
    out = base_spans(docs.drop(*names, "spans"))
    known = F.concat(*KINDS)
    if model.thresholds:
        out = candidates(out)
    for name in sorted(GENERATORS, key=lambda name: name == "number"):
        if name not in model.thresholds:
            out = out.withColumn(name, empty())
            continue
        least = model.thresholds[name] - 0.0005  # chances were rounded
        taken = F.concat(known, "group", "quad") if name == "number" else known
        chosen = F.filter(name, _selected(model, taken, least))
        plain = F.transform(chosen, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))
        out = out.withColumn(name, F.when(F.size(name) > 0, plain).otherwise(empty()))
    return out.withColumn("spans", in_order(*[labelled(F.col(name), k, name) for k, name in enumerate(names)]))


def _selected(model: Model, known: Column, least: float) -> Callable[[Column], Column]:
    return lambda m: ~_overlaps(m, known) & (model.chance(m["f"]) >= least)


def personal_data_report(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: counts and digests of the known forms, and all spans as text."""
    found = find_personal_data(docs.select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(listed(F.filter("spans", lambda s: s["order"] < len(KINDS))), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets, and ``n_chars``, where there is one, to match."""
    found = find_personal_data(packed(docs, F.col("text")))
    some = F.size("spans") > 0
    found = found.withColumn("text", F.when(some, masked(F.col("text"), F.col("spans"))).otherwise(F.col("text")))
    replaced = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        replaced["n_chars"] = F.when(some, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    return unpacked(found, docs, **replaced)

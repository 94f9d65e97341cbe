"""Spans of pattern matches as columns: positions in code points, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Type of an array of matches.
SPANS = "array<struct<start:int,end:int,value:string>>"

#: Matches whose offsets are added up at a time; keeps the work per match bounded in texts with very many.
_RUN = 256


def empty() -> Column:
    return F.expr(f"cast(array() as {SPANS})")


def with_matches(df: DataFrame, name: str, text: str, pattern: str, gate: Column | None = None) -> DataFrame:
    """Add ``name``: all leftmost non-overlapping matches in column ``text``, as structs ``start, end, value``.

    The text is split at the matches: the lengths of the pieces between them and of the matches add up to
    the offsets.  The pattern must not match an empty string.  Only rows that pass ``gate``, which must be
    true wherever there is a match, are searched; a null text has no matches.
    """
    gate = F.col(text).isNotNull() if gate is None else gate
    df = df.withColumn("_values", F.when(gate, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))))
    some = F.size("_values") > 0
    df = df.withColumn("_gaps", F.when(some, F.split(F.col(text), pattern, -1)))
    pairs = F.zip_with(F.slice("_gaps", F.lit(1), F.size("_values")), F.col("_values"), lambda gap, value: F.struct(F.length(gap).alias("gap"), value.alias("value")))
    df = df.withColumn("_pairs", F.when(some, pairs))
    runs = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("_pairs") - 1) / _RUN).cast("int")),
        lambda k: F.aggregate(F.slice("_pairs", k * _RUN + 1, F.lit(_RUN)), F.struct(F.lit(0).alias("at"), empty().alias("found")), _placed),
    )
    df = df.withColumn("_runs", F.when(some, runs))
    begins = F.aggregate(
        F.col("_runs"),
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("begins")),
        lambda state, run: F.struct((state["at"] + run["at"]).alias("at"), F.concat(state["begins"], F.array(state["at"])).alias("begins")),
        lambda state: state["begins"],
    )
    moved = F.zip_with(
        F.col("_runs"),
        begins,
        lambda run, begin: F.transform(
            run["found"],
            lambda m: F.struct((m["start"] + begin).alias("start"), (m["end"] + begin).alias("end"), m["value"].alias("value")),
        ),
    )
    df = df.withColumn(name, F.when(some, F.flatten(moved)).otherwise(empty()))
    return df.drop("_values", "_gaps", "_pairs", "_runs")


def _placed(state: Column, piece: Column) -> Column:
    begin = state["at"] + piece["gap"]
    end = begin + F.length(piece["value"])
    one = F.struct(begin.alias("start"), end.alias("end"), piece["value"].alias("value"))
    return F.struct(end.alias("at"), F.concat(state["found"], F.array(one)).alias("found"))


def labelled(found: Column, order: int, kind: str) -> Column:
    """Spans of one kind, ready to be sorted among others: by start, then by the order of the kinds."""
    return F.transform(
        found, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("order"), m["end"].alias("end"), F.lit(kind).alias("kind"))
    )


def in_order(*parts: Column) -> Column:
    return F.array_sort(F.concat(*parts))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each stretch that sorted spans cover replaced by its first kind in square brackets."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(state: Column, span: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, span["start"] - state["at"])
        fresh = F.concat(state["out"], F.array(gap, F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))))
        return F.when(span["start"] >= state["at"], F.struct(span["end"].alias("at"), fresh.alias("out"))).otherwise(
            F.struct(F.greatest(state["at"], span["end"]).alias("at"), state["out"].alias("out"))
        )

    return F.aggregate(
        spans, start, step, lambda state: F.concat(F.array_join(state["out"], ""), F.substring(text, state["at"] + 1, F.length(text)))
    )

"""Mixing sources to target weights by subset sums over exact lengths.

Documents are counted by source and exact length.  From the counts alone a bounded subset sum decides how
many documents of each length a source takes once more than its whole passes; which ones is decided by a
seeded hash.  Texts are read once, to measure them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm.shared import written

#: Budgets up to so many words are filled by dynamic programming; the rest is dealt in proportion before.
EXACT_WORDS = 1 << 15


def word_count(text: F.Column) -> F.Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; zero for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Sources by code point, null last, weigh ``weights`` in turn.  They share ``share`` times all words; no target
    exceeds ``most`` times its source, and the excess goes to the others by weight until none is above.  That is
    one level ``x`` with ``target = min(cap, weight * x)``, found by running sums over the sources in order of
    the level at which each reaches its cap.  The table has one row a source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_level = Window.orderBy("level", F.col("source").isNull(), F.col("source"))
    every = Window.partitionBy()
    turn = ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn))
    rows = rows.withColumn("cap", F.col("source_size") * float(most)).withColumn("level", F.col("cap") / F.col("weight"))
    left = F.sum("source_size").over(every) * float(share) - F.coalesce(
        F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)
    )
    weights_left = F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("x", F.greatest(left, F.lit(0.0)) / weights_left).withColumn("place", F.row_number().over(by_level))
    # The first source that stays below its cap fixes the level for itself and all after it.
    at = F.min(F.when(F.col("x") <= F.col("level"), F.struct("place", "x"))).over(every)["x"]
    return rows.select("source", "source_size", F.coalesce(F.least("cap", F.col("weight") * at), F.col("cap")).alias("target"))


def fill(lengths: Sequence[int], counts: Sequence[int], budget: int, exact: int = EXACT_WORDS) -> list[int]:
    """How many documents of each length to take, so that the lengths add up to ``budget`` or as near below as can be.

    First a whole part of the budget is dealt over the lengths in proportion to their counts, which keeps the
    mix of lengths; then single documents, longest first, until no more than ``exact`` words are left; these are
    filled by a bounded subset sum over the documents that remain.
    """
    whole = sum(n * c for n, c in zip(lengths, counts, strict=True))
    budget = max(0, min(int(budget), whole))
    if budget == whole:
        return list(counts)
    aside = max(0, budget - exact // 2)
    taken = [c * aside // whole for c in counts]
    left = budget - sum(n * t for n, t in zip(lengths, taken, strict=True))
    order = sorted(range(len(lengths)), key=lambda k: -lengths[k])
    for k in order:
        if left <= exact:
            break
        n = lengths[k]
        if n:
            more = min(counts[k] - taken[k], (left - exact) // n)
            if more > 0:
                taken[k] += more
                left -= more * n
    # Reachable sums as the bits of one number, length by length; a length is split into powers of two.
    mask = (1 << (left + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    reach = 1
    for k in order:
        n, free = lengths[k], counts[k] - taken[k]
        free = min(free, left // n) if n else 0
        piece = 1
        while free > 0:
            size = min(piece, free)
            steps.append((k, size, reach))
            reach |= (reach << (n * size)) & mask
            free -= size
            piece *= 2
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    for k, size, before in reversed(steps):
        if not before >> at & 1:
            taken[k] += size
            at -= lengths[k] * size
    return taken


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """``doc_id, size, source_size, target, taken, source`` of every row; ``taken`` is the words the mix takes of it.

    A source takes all its documents once for every whole time that its size fits its target, and fills the rest
    by subset sum, so ``taken`` is ``size`` times 0, 1 or 2 (for ``most=2``).  Null sources are one source.  A null
    or blank text has size 0 and adds nothing.  Which of the documents of one source and size are chosen depends
    on the seed and on the row, so runs agree; equal rows are interchangeable.  Other columns are not read; an
    empty table gives an empty result.
    """
    mark = F.xxhash64(F.lit(seed), "doc_id", "source", "text").alias("mark")
    rows = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), mark))
    by_size = written(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    wanted = targets(by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most)
    decided = written(
        by_size.withColumnRenamed("source", "s")
        .join(wanted, F.col("s").eqNullSafe(F.col("source")))
        .drop("s")
        .groupBy("source")
        .applyInPandas(_plan(most), "s string, z long, n long, source_size long, target double, passes long, more long")
    )
    placed = rows.join(decided, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).drop("s", "z")
    # Rows of one source and size are dealt into about sqrt(n) cells; whole cells are taken in order, and only
    # the cell in which the number is reached is ranked.
    split = F.col("more").between(1, F.col("n") - 1)
    placed = placed.withColumn("cell", F.when(split, F.pmod("mark", F.ceil(F.sqrt("n")).cast("long"))))
    cells = placed.where(split).groupBy("source", "size", "cell").agg(F.count(F.lit(1)).alias("m"), F.max("more").alias("more"))
    before = F.sum("m").over(Window.partitionBy("source", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    quota = F.greatest(F.lit(0), F.least(F.col("m"), F.col("more") - F.coalesce(before, F.lit(0))))
    cells = written(cells.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("cell").alias("c"), "m", quota.alias("quota")))
    here = F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("cell") == F.col("c"))
    told = placed.join(cells, here, "left").drop("s", "z", "c")
    inside = F.coalesce((F.col("quota") > 0) & (F.col("quota") < F.col("m")), F.lit(False))
    whole = F.when(F.col("quota").isNull(), F.col("more") >= F.col("n")).otherwise(F.col("quota") == F.col("m"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "cell").orderBy("mark", "doc_id"))
    once_more = told.where(~inside).withColumn("once_more", whole).unionByName(told.where(inside).withColumn("once_more", rank <= F.col("quota")))
    taken = F.col("size") * (F.col("passes") + F.col("once_more").cast("long"))
    return once_more.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source")


def _plan(most: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """For the length counts of one source: whole passes, and how many documents of each length once more."""

    def plan(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("size", ignore_index=True)
        size, target = int(part["source_size"][0]), float(part["target"][0])
        passes = int(min(target // size, most)) if size else 0
        rest = round(target - passes * size)
        more = fill(part["size"].tolist(), part["n"].tolist(), rest) if rest > 0 else 0
        part = part.rename(columns={"source": "s", "size": "z"}).assign(passes=passes, more=more)
        return part[["s", "z", "n", "source_size", "target", "passes", "more"]]

    return plan

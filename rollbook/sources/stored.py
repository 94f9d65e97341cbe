"""Stored tables: parquet files in cells of a grid, and one manifest for each version of the whole database.

A manifest names the files of every table.  It is put in place in one step, only where its number is free, so a change of
several tables is seen whole or not at all, and of two writers that started from the same version one has to start again.
Readers take the newest manifest and keep its files.

The rows of a table lie in cells by the hash of its first key column and of a second column that it is looked up by.  A
keyed change reads the cells of its keys, and writes the new rows beside the old files, with the number of the change;
readers take the newest row of each key.  ``compact`` rewrites the cells that have changes, and ``retain`` removes what no
kept version names.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Sequence
from typing import NamedTuple, TypeVar

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from rollbook.operators.mutate import bulk_upsert, one_per_key, patch as patched, upsert as upserted
from rollbook.schemas import TABLES
from rollbook.session import checkpointed, staged

Result = TypeVar("Result")


class Layout(NamedTuple):
    """How a table lies in files: the columns it is looked up by, how many cells each has, and the order inside a file."""

    key: str
    side: str | None = None
    cells: tuple[int, int] = (16, 1)
    sort: tuple[str, ...] = ()


REJECTS = T.StructType([T.StructField("path", T.StringType()), T.StructField("eid", T.StringType()), T.StructField("errors", T.ArrayType(T.StringType()))])

#: Layout of every stored table.  More cells suit larger tables; the number is fixed when a table is replaced.
LAYOUTS = {
    "participants": Layout("pid", "representing_country", (16, 4), ("representing_country", "pid")),
    "participant_events": Layout("participant_id", "event_id", (16, 4), ("event_id", "participant_id")),
    "events": Layout("eid", None, (16, 1), ("eid",)),
    "tests": Layout("pid", "eid", (16, 4), ("eid", "pid")),
    "countries": Layout("cid", None, (1, 1), ("country",)),
    "rejects": Layout("path", None, (1, 1), ("path",)),
}
#: Stored tables, with their unique keys; rejects have none.
STORED = {**TABLES, "rejects": (REJECTS, ())}

_CELLS = ("key_cell", "side_cell")
_AT, _GONE = "change_no", "deleted"


class ConcurrentChange(RuntimeError):
    """Other writers were faster, again and again."""


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the versions whose manifests are there."""
    files, path = _files(spark, f"{root}/_manifests")
    if not files.exists(path):
        return []
    names = [entry.getPath().getName() for entry in files.listStatus(path)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """One version of the database, the newest unless told; an empty one where there is none."""
    if version is None:
        known = versions(spark, root)
        if not known:
            return {"version": 0, "tables": {}, "batches": {}}
        version = known[-1]
    return json.loads(spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(_opened(spark, f"{root}/_manifests/{version:012d}.json")).decode())


def _opened(spark: SparkSession, path: str):
    files, place = _files(spark, path)
    return files.open(place)


def _put(spark: SparkSession, root: str, content: dict) -> bool:
    """Put a manifest in place unless its number is taken; it is complete as soon as it can be seen."""
    files, draft = _files(spark, f"{root}/_manifests/_{uuid.uuid4().hex}")
    _, place = _files(spark, f"{root}/_manifests/{content['version']:012d}.json")
    out = files.create(draft, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    try:
        if files.getUri().getScheme() == "file":  # renaming a local file would replace another one
            os.link(draft.toUri().getPath(), place.toUri().getPath())
        else:
            jvm = spark._jvm.org.apache.hadoop.fs
            none = spark.sparkContext._gateway.new_array(getattr(jvm, "Options$Rename"), 1)
            none[0] = getattr(jvm, "Options$Rename").NONE
            jvm.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, place, none)
        return True
    except FileExistsError:
        return False
    except Exception as problem:
        if "FileAlreadyExistsException" in str(problem):
            return False
        raise
    finally:
        files.delete(draft, False)


def _cell(column: Column, cells: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(cells)).cast("int")


def _shaped(df: DataFrame, name: str, *more: str) -> DataFrame:
    """Exactly the columns of the stored schema, and ``more``."""
    known = set(df.columns)
    columns = [(F.col(f.name) if f.name in known else F.lit(None)).cast(f.dataType).alias(f.name) for f in STORED[name][0].fields]
    return df.select(*columns, *more)


def _celled(df: DataFrame, name: str, cells: Sequence[int]) -> DataFrame:
    layout = LAYOUTS[name]
    side = F.lit(0) if layout.side is None else _cell(F.col(layout.side), cells[1])
    return df.withColumns({_CELLS[0]: _cell(F.col(layout.key), cells[0]), _CELLS[1]: side})


def _read_part(spark: SparkSession, root: str, name: str, paths: list[str], *more: T.StructField) -> DataFrame:
    fields = [*STORED[name][0].fields, *more, T.StructField("part", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in _CELLS)]
    return spark.read.schema(T.StructType(fields)).option("basePath", f"{root}/{name}").parquet(*[f"{root}/{p}" for p in paths]).drop("part")


def _state(spark: SparkSession, root: str, name: str, entry: dict | None, where: Column | None = None) -> DataFrame:
    """The rows of a table with their cells; ``where`` is a condition that holds for whole keys, given to every scan."""
    fields = [*STORED[name][0].fields, *(T.StructField(c, T.IntegerType()) for c in _CELLS)]
    if entry is None or not entry["parts"] and not entry["changes"]:
        return spark.createDataFrame([], T.StructType(fields))

    def kept(df: DataFrame) -> DataFrame:
        return df if where is None else df.filter(where)

    groups: dict[tuple[int, ...] | None, list[str]] = {}
    for part in entry["parts"]:
        groups.setdefault(None if part["live"] is None else tuple(part["live"]), []).append(part["path"])
    rows = []
    for live, paths in groups.items():
        part = kept(_read_part(spark, root, name, paths))
        rows.append(part if live is None else part.filter(F.col(_CELLS[0]).isin(*live)))
    base = rows[0] if rows else spark.createDataFrame([], T.StructType(fields))
    for more in rows[1:]:
        base = base.unionByName(more)
    if not entry["changes"]:
        return base
    keys = list(STORED[name][1])
    marks = (T.StructField(_AT, T.LongType()), T.StructField(_GONE, T.BooleanType()))
    changes = kept(_read_part(spark, root, name, [c["path"] for c in entry["changes"]], *marks))
    newest = changes.groupBy(*keys).agg(F.max(_AT).alias(_AT))
    latest = changes.join(newest, [*keys, _AT], "left_semi")
    untouched = base.join(newest.select(*keys), keys, "left_anti")
    return untouched.unionByName(latest.filter(~F.col(_GONE)).drop(_AT, _GONE)).select(*[f.name for f in fields])


def read_table(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A table of the newest version, or of another that is still kept; empty where it was never written."""
    return _state(spark, root, name, manifest(spark, root, version)["tables"].get(name)).drop(*_CELLS)


def read_tables(spark: SparkSession, root: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """Several tables of one version."""
    found = manifest(spark, root)
    return {n: _state(spark, root, n, found["tables"].get(n)).drop(*_CELLS) for n in names}


def lookup(spark: SparkSession, root: str, name: str, **keys: object) -> DataFrame:
    """Rows whose columns equal the given values.

    Values of the columns that the layout names choose the cells, the others are looked for in the files of these.  Only
    values of the unique key may pick rows before the newest of a key is known; others are asked of the newest.
    """
    layout, unique = LAYOUTS[name], STORED[name][1]
    kinds = {f.name: f.dataType for f in STORED[name][0].fields}
    entry = manifest(spark, root)["tables"].get(name)
    cells = entry["cells"] if entry else layout.cells

    def condition(columns: dict[str, object]) -> Column | None:
        found = None
        for column, value in columns.items():
            typed = F.lit(value).cast(kinds[column])
            tests = [F.col(column) == typed]
            for of, cell, count in zip((layout.key, layout.side), _CELLS, cells, strict=True):
                if of == column:
                    tests.append(F.col(cell) == _cell(typed, count))
            for test in tests:
                found = test if found is None else found & test
        return found

    steady = {c: v for c, v in keys.items() if c in unique}
    rows = _state(spark, root, name, entry, condition(steady))
    # The condition on the others also reaches the scans of files that nothing has changed since.
    return rows.filter(condition(keys)).drop(*_CELLS) if keys else rows.drop(*_CELLS)


class Change:
    """What one writer does to the version it started from; nothing is seen before ``commit``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        self.base = manifest(spark, root)
        self.tables = json.loads(json.dumps(self.base["tables"]))
        self.batches = dict(self.base["batches"])
        self._steps = 0

    def read(self, name: str) -> DataFrame:
        """A table as this change has left it so far."""
        return _state(self.spark, self.root, name, self.tables.get(name)).drop(*_CELLS)

    def _write(self, df: DataFrame, name: str, order: Sequence[str]) -> str:
        path = f"{name}/part={uuid.uuid4().hex}"
        cells = [F.col(c) for c in _CELLS]
        # Cells are dealt to tasks by size, a large one to several.
        dealt = df.hint("rebalance", *cells).sortWithinPartitions(*cells, *order)
        dealt.write.partitionBy(*_CELLS).parquet(f"{self.root}/{path}")
        return path

    def replace(self, name: str, df: DataFrame, cells: tuple[int, int] | None = None) -> None:
        """New content of a table; the old files stay for their readers."""
        cells = list(cells or LAYOUTS[name].cells)
        path = self._write(_celled(_shaped(df, name), name, cells), name, LAYOUTS[name].sort)
        self.tables[name] = {"cells": cells, "parts": [{"path": path, "live": None, "cells": None}], "changes": []}

    def _entry(self, name: str) -> dict:
        return self.tables.setdefault(name, {"cells": list(LAYOUTS[name].cells), "parts": [], "changes": []})

    def _touched(self, rows: DataFrame) -> list[int]:
        """The cells of the first key column that rows lie in: a bounded number."""
        return sorted(r[0] for r in rows.select(_CELLS[0]).distinct().collect())

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows whose key is new; of a repeated key the smallest row is added.  Without a key all rows are added."""
        keys, entry = list(STORED[name][1]), self._entry(name)
        rows = _celled(_shaped(rows, name), name, entry["cells"])
        if keys:
            rows = staged(rows)
            touched = self._touched(rows)
            known = _state(self.spark, self.root, name, entry, F.col(_CELLS[0]).isin(*touched)).select(*keys)
            rows = _celled(one_per_key(rows.drop(*_CELLS).join(known, keys, "left_anti"), keys), name, entry["cells"])
        else:
            touched = list(range(entry["cells"][0]))
        entry["parts"].append({"path": self._write(rows, name, LAYOUTS[name].sort), "live": None, "cells": touched})

    def change(self, name: str, delta: DataFrame, work: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Change rows by key: ``work(old, delta)`` gets the stored rows of the delta's keys and returns the rows to store.

        Only the cells that the delta's keys lie in are read, and only the returned rows are written.
        """
        self._changed(name, delta, lambda old, new: work(old, new).withColumn(_GONE, F.lit(False)))

    def delete(self, name: str, keys: DataFrame) -> None:
        """Delete the rows of some keys."""
        self._changed(name, keys.select(*STORED[name][1]).distinct(), lambda old, _: old.withColumn(_GONE, F.lit(True)))

    def _changed(self, name: str, delta: DataFrame, work: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        keys, entry = list(STORED[name][1]), self._entry(name)
        delta = checkpointed(delta)
        first = LAYOUTS[name].key
        kind = next(f.dataType for f in STORED[name][0].fields if f.name == first)
        touched = self._touched(delta.select(_cell(F.col(first).cast(kind), entry["cells"][0]).alias(_CELLS[0])))
        if not touched:
            return
        stored = _state(self.spark, self.root, name, entry, F.col(_CELLS[0]).isin(*touched)).drop(*_CELLS)
        old = stored.join(delta.select(*keys).distinct(), keys, "left_semi")
        self._steps += 1
        number = F.lit((self.base["version"] + 1) * 1000 + self._steps).cast("long").alias(_AT)
        rows = _shaped(work(old, delta), name, number, _GONE)
        path = self._write(_celled(rows, name, entry["cells"]), name, LAYOUTS[name].sort)
        entry["changes"].append({"path": path, "cells": touched})

    def upsert(self, name: str, delta: DataFrame, nulls: str = "keep", present: str | None = None) -> None:
        """``mutate.upsert`` on the stored table."""
        self.change(name, delta, lambda old, new: upserted(old, new, STORED[name][1], nulls, present))

    def bulk_upsert(self, name: str, delta: DataFrame, order: str) -> None:
        """``mutate.bulk_upsert`` on the stored table."""
        self.change(name, delta, lambda old, new: bulk_upsert(old, new, STORED[name][1], order))

    def patch(self, name: str, delta: DataFrame) -> None:
        """``mutate.patch`` on the stored table: unknown keys are ignored."""
        self.change(name, delta, lambda old, new: patched(old, new, STORED[name][1]))

    def compact(self, name: str) -> None:
        """Rewrite the cells that were changed or added to; the files of the others stay."""
        entry = self.tables.get(name)
        if entry is None:
            return
        added = [p for p in entry["parts"] if p["cells"] is not None]
        touched = sorted({c for x in [*entry["changes"], *added] for c in x["cells"]})
        if not touched:
            return
        path = self._write(_state(self.spark, self.root, name, entry, F.col(_CELLS[0]).isin(*touched)), name, LAYOUTS[name].sort)
        parts = []
        for part in entry["parts"]:
            live = part["live"] if part["live"] is not None else part["cells"] if part["cells"] is not None else range(entry["cells"][0])
            live = [c for c in live if c not in touched]
            if live:
                parts.append({"path": part["path"], "live": live, "cells": None})
        parts.append({"path": path, "live": touched, "cells": None})
        self.tables[name] = {"cells": entry["cells"], "parts": parts, "changes": []}

    def pending(self, name: str) -> int:
        """How many changes and additions wait for ``compact``."""
        entry = self.tables.get(name, {"changes": [], "parts": []})
        return len(entry["changes"]) + sum(p["cells"] is not None for p in entry["parts"])

    def commit(self) -> bool:
        """Make the change the next version; false where another writer was faster.  No change, no version."""
        if self.tables == self.base["tables"] and self.batches == self.base["batches"]:
            return max(versions(self.spark, self.root), default=0) == self.base["version"]
        return _put(self.spark, self.root, {"version": self.base["version"] + 1, "tables": self.tables, "batches": self.batches})


def transact(spark: SparkSession, root: str, work: Callable[[Change], Result], tries: int = 5) -> Result:
    """Run ``work`` on a change and commit it; where another writer was faster, again from the version it left."""
    for _ in range(tries):
        change = Change(spark, root)
        result = work(change)
        if change.commit():
            return result
    raise ConcurrentChange(f"{root} was changed by others {tries} times")


def write_table(df: DataFrame, root: str, name: str) -> None:
    """Store the content of one table as a new version."""
    transact(df.sparkSession, root, lambda change: change.replace(name, df))


def append(spark: SparkSession, root: str, name: str, rows: DataFrame) -> None:
    """Add rows whose key is new, without rewriting the table."""
    transact(spark, root, lambda change: change.append(name, rows))


def reload(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> None:
    """Replace several tables together: readers see all of them or none."""

    def work(change: Change) -> None:
        for name, df in tables.items():
            change.replace(name, df)

    transact(spark, root, work)


def retain(spark: SparkSession, root: str, keep: int = 10, older_than_hours: float = 24) -> int:
    """Remove all but the newest ``keep`` versions, and files that none of these names; returns how many paths went.

    Files younger than ``older_than_hours`` stay: they may belong to a change that is not committed yet.
    """
    known = versions(spark, root)
    kept = known[-keep:]
    named = set()
    for version in kept:
        for entry in manifest(spark, root, version)["tables"].values():
            named |= {p["path"] for p in [*entry["parts"], *entry["changes"]]}
    before = spark._jvm.java.lang.System.currentTimeMillis() - int(older_than_hours * 3_600_000)
    gone = 0
    for version in known[:-keep]:
        files, path = _files(spark, f"{root}/_manifests/{version:012d}.json")
        gone += files.delete(path, False)
    for name in STORED:
        files, folder = _files(spark, f"{root}/{name}")
        for entry in files.listStatus(folder) if files.exists(folder) else []:
            if f"{name}/{entry.getPath().getName()}" not in named and entry.getModificationTime() <= before:
                gone += files.delete(entry.getPath(), True)
    return gone


def countries_by_name(countries: DataFrame) -> DataFrame:
    return countries.orderBy("country", "cid")


def numbered_rows(df: DataFrame, row_no: str = "row_no") -> DataFrame:
    """Rows read from files with their number, 1 first: by the name of the file, its splits in order, and the place in the split.

    ``df`` must come right from the reader.  A task numbers the rows that it reads one after the other; how many rows lie
    before a split is summed up over a table with one row for each split, so one large file may be read by many tasks.
    """
    placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_nth"))
    splits = placed.groupBy("_file", "_start").agg(F.min("_nth").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    numbered = placed.join(splits, ["_file", "_start"])
    return numbered.select(*df.columns, (F.col("_before") + F.col("_nth") - F.col("_first") + 1).alias(row_no))


def load_flat(spark: SparkSession, folder: str, fmt: str = "csv", newlines: bool = False, columns: dict[str, Sequence[str]] | None = None) -> dict[str, DataFrame]:
    """The three flat sheets ``Participant``, ``Country`` and ``Events``, all columns as text, with the number of every row.

    CSV files need a header row.  Only where cells hold ``newlines`` is a file read by one task; others are split.  The
    ``columns`` of a sheet, in the order of its files, save a look at the files.  Rows are numbered in the order of the file
    names unless a column ``row_no`` numbers them already.
    """
    sheets = {}
    for name in ("Participant", "Country", "Events"):
        reader = spark.read.format(fmt)
        if fmt == "csv":
            reader = reader.option("header", "true").option("multiLine", str(newlines).lower()).option("escape", '"')
        if columns and name in columns:
            reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns[name]]))
        df = reader.load(f"{folder}/{name}")
        df = df if "row_no" in df.columns else numbered_rows(df)
        sheets[name] = df.select(*[F.col(f"`{c}`").cast("string").alias(c) if c != "row_no" else F.col(c).cast("bigint") for c in df.columns])
    return sheets

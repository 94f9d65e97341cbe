"""Steps whose cost must not grow faster than their input: what is computed once, and what travels."""

from __future__ import annotations

import os
from datetime import datetime

from pyspark.sql import functions as F

from rollbook.functions import names
from rollbook.operators import merge, mutate
from rollbook.plans import bulk_load, catalog_stored
from rollbook.plans.bindings import SCHEMAS, Tables
from rollbook.schemas import COUNTRIES
from rollbook.sources import stored


def test_flat_files_grow_in_number_and_keep_their_order(spark, tmp_path):
    day = datetime(2020, 1, 1)
    orders = [(k, k % 50, "F", 1.0, day, "1-URGENT") for k in range(3000)]
    content = {"orders": orders, "nation": [(1, "NATION_1", 0)], "part": [(1, "one", "Brand#1", "T", 1, 2.0)]}
    for name, rows in content.items():
        spark.createDataFrame(rows, SCHEMAS[name]).write.parquet(str(tmp_path / f"{name}.parquet"))
    t = Tables(spark, str(tmp_path))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as if every partition were large
    try:
        folder = catalog_stored.flat_files(t)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = [f for f in os.listdir(f"{folder}/Participant") if f.endswith(".csv")]
    assert len(files) > 4
    rows = stored.load_flat(spark, folder)["Participant"].select("row_no", "Grade", "Name").collect()
    assert sorted(r["row_no"] for r in rows) == list(range(1, 3001))
    assert all(int(r["Grade"]) == (r["row_no"] - 1) % 4 for r in rows)


def test_rows_that_name_the_same_countries_are_coded_once(spark, monkeypatch):
    shape = "row_no long, rep_text string, birth_text string, citizen_texts array<string>"
    rows = [(k, "Croatia", None, ["Newland", "croatia"]) for k in range(2, 40)]
    rows += [(1, "Old", "Newland", []), (50, None, "Croatia", ["Old"]), (None, "Croatia", None, []), (51, "Croatia", "Old", None)]
    countries = spark.createDataFrame([("C001", "Croatia", None, 1)], COUNTRIES)
    seen, real = [], mutate.ensure_countries

    def counted(labels, *more):
        seen.append(labels.count())
        return real(labels, *more)

    monkeypatch.setattr(mutate, "ensure_countries", counted)
    coded, grown = bulk_load.with_country_codes(spark.createDataFrame(rows, shape), countries)
    found = {r["row_no"]: (r["representing_country"], r["birth_country"], r["citizenships"]) for r in coded.collect()}
    assert seen == [8]
    assert {r["cid"]: r["country"] for r in grown.collect()} == {"C001": "Croatia", "C002": "Old", "C003": "Newland"}
    assert found[2] == found[39] == ("C001", "C001", ["C003", "C001"])
    assert found[1] == ("C002", "C003", ["C002"]) and found[50] == (None, "C001", None)
    assert found[None] == found[51] == (None, None, None)


def test_the_last_row_carries_its_order_once(spark):
    rows = spark.createDataFrame([("a", 1, 5, "x", None), ("a", 2, 1, None, [1]), ("a", 2, 0, "z", None), ("b", None, None, "n", None)],
                                 "k string, o int, p int, v string, l array<int>")
    last = merge.last_row(rows, ["k"], ["o", "p"])
    assert last.columns == ["k", "o", "p", "v", "l"]
    assert sorted(tuple(r) for r in last.collect()) == [("a", 2, 1, None, [1]), ("b", None, None, "n", None)]
    assert "max_by" not in last._jdf.queryExecution().optimizedPlan().toString()
    mapped = rows.withColumn("m", F.create_map("k", "v"))
    assert merge.last_row(mapped, ["k"], ["o", "p"]).filter("k = 'a'").first()["m"] == {"a": None}


def test_plain_names_and_odd_ones_agree(evaluate):
    shown = {
        "jane mary doe": "jane mary DOE", "JANE DOE": "JANE DOE", "Jane": "Jane", " Jane  Doe ": "Jane DOE", "Doe, Jane": "Jane DOE",
        "Jane Doe": "Jane DOE", "anna weiß": "anna WEISS", "": "",
    }
    for raw, wanted in shown.items():
        assert evaluate(names.display_name("x"), raw) == wanted, raw

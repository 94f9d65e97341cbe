"""Domain tables derived from the driver's tables, in Spark and as SQL for the oracle.

Every view covers the whole of its source tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rollbook.operators.merge import last_row
from rollbook.session import prepare


#: Columns of the driver's tables; reading with a schema saves a look at the files.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


#: The number that each formatted key is made of.
NUMBERED = {
    "pid": ("P%04d", "c_custkey"), "representing_country": ("C%03d", "c_nationkey"),
    "participant_id": ("P%04d", "o_custkey"), "event_id": ("E%05d", "l_partkey"),
}


def numbered(key: str, value: str) -> tuple[str, Column]:
    """The stored column behind a key, and the test that it is the number the value was formatted from.

    The test is on the stored type, so it reaches the scan; a value that no number is formatted as is in no row.
    """
    pattern, column = NUMBERED[key]
    digits = value[1:]
    if value[:1] != pattern[0] or not digits.isascii() or not digits.isdigit() or pattern % int(digits) != value:
        return column, F.lit(False)
    return column, F.col(column) == F.lit(int(digits))


class Tables:
    """The domain views over one folder of driver tables."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = prepare(spark), folder

    def raw(self, name: str) -> DataFrame:
        """A driver table as it is."""
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")

    @property
    def countries(self) -> DataFrame:
        return self.raw("nation").select(
            F.format_string("C%03d", "n_nationkey").alias("cid"),
            F.col("n_name").alias("country"),
            F.col("n_nationkey").cast("bigint").alias("ord"),
        )

    @property
    def participants(self) -> DataFrame:
        return self.participants_where()

    def participants_where(self, **keys: str) -> DataFrame:
        """Participants with the given keys, which the scan tests as the numbers they are stored as."""
        rows = self.raw("customer")
        for name, value in keys.items():
            rows = rows.filter(numbered(name, value)[1])
        key = F.col("c_custkey")
        represented = F.format_string("C%03d", "c_nationkey")
        born = F.format_string("C%03d", (F.col("c_nationkey") + key % 3) % 27)
        other = F.format_string("C%03d", key % 28)
        return rows.select(
            F.format_string("P%04d", key).alias("pid"),
            F.col("c_name").alias("name"),
            represented.alias("representing_country"),
            F.when(key % 2 == 0, "Male").otherwise("Female").alias("gender"),
            (key % 3).cast("int").alias("grade"),
            F.date_add(F.lit("1950-01-01").cast("date"), (key * 37 % 20000).cast("int")).alias("dob"),
            F.concat(F.lit("Town "), (key % 97).cast("string")).alias("pob"),
            born.alias("birth_country"),
            F.array_distinct(F.array(represented, born, other)).alias("citizenships"),
            F.concat(F.lit("user"), key.cast("string"), F.lit("@example.org")).alias("email"),
            F.concat(F.lit("+385"), F.lpad(key.cast("string"), 8, "0")).alias("phone"),
            F.col("c_mktsegment").alias("position"),
            F.lit(None).cast("string").alias("organization"),
            key.alias("ord"),
        )

    @property
    def events(self) -> DataFrame:
        """Parts are events; suppliers are planned events that nobody attended yet."""
        key = F.col("p_partkey")
        start = F.date_add(F.lit("2020-01-01").cast("date"), (key % 1500).cast("int"))
        held = self.raw("part").select(
            F.format_string("E%05d", key).alias("eid"),
            F.col("p_name").alias("title"),
            start.cast("timestamp").alias("start_date"),
            F.date_add(start, (key % 5).cast("int")).cast("timestamp").alias("end_date"),
            F.col("p_brand").alias("place"),
            F.format_string("C%03d", key % 28).alias("country"),
            F.when(key % 2 == 0, "Training").otherwise("Workshop").alias("type"),
            F.col("p_retailprice").alias("cost"),
            F.array(F.lit("P0000")).alias("participants"),
        )
        number = F.col("s_suppkey")
        planned = self.raw("supplier").select(
            F.format_string("S%05d", number).alias("eid"),
            F.lit("").alias("title"),
            F.lit(None).cast("timestamp").alias("start_date"),
            F.lit(None).cast("timestamp").alias("end_date"),
            F.col("s_name").alias("place"),
            F.format_string("C%03d", "s_nationkey").alias("country"),
            F.lit("Other").alias("type"),
            F.col("s_acctbal").alias("cost"),
            F.when(number % 2 == 0, F.array(F.lit("P0001"), F.lit("P0002")))
            .otherwise(F.array().cast("array<string>"))
            .alias("participants"),
        )
        return held.unionByName(planned)

    @property
    def lines(self) -> DataFrame:
        """Order lines with their order, in the columns that attendance is made of."""
        orders = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
        line = self.raw("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        return line.select(
            "o_custkey", "l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag",
            "l_linestatus", "l_shipdate", "o_orderpriority", "o_orderdate",
        )

    @staticmethod
    def attendance(line: DataFrame) -> DataFrame:
        """Who attended what, with the fields of a snapshot."""
        shipped = F.col("l_shipdate").cast("date")
        return line.select(
            F.format_string("P%04d", "o_custkey").alias("participant_id"),
            F.format_string("E%05d", "l_partkey").alias("event_id"),
            F.when(F.col("l_returnflag") == "A", "Air (Airplane)")
            .when(F.col("l_returnflag") == "N", "Other")
            .otherwise("Personal Vehicle (POV)")
            .alias("transportation"),
            F.when((F.col("l_returnflag") == "N") & (F.col("l_linenumber") > 2), "bus").alias("transport_other"),
            F.format_string("C%03d", F.col("l_suppkey") % 30).alias("traveling_from"),
            F.when(F.col("l_linestatus") == "F", F.col("o_orderpriority")).otherwise("  ").alias("returning_to"),
            F.when(F.col("l_linestatus") == "F", "Passport").otherwise("ID Card").alias("travel_doc_type"),
            F.col("o_orderdate").cast("date").cast("timestamp").alias("travel_doc_issue_date"),
            shipped.cast("timestamp").alias("travel_doc_expiry_date"),
            F.format_string("C%03d", F.col("o_custkey") % 26).alias("travel_doc_issued_by"),
            F.when(F.col("l_linenumber") < 4, F.concat(F.lit("Bank "), F.col("l_linenumber").cast("string"))).alias(
                "bank_name"
            ),
            F.lit(None).cast("string").alias("iban"),
            F.when(F.col("l_linenumber") == 1, "EURO").alias("iban_type"),
            F.lit(None).cast("string").alias("swift"),
            "l_orderkey",
            "l_linenumber",
            "l_suppkey",
            "l_quantity",
        )

    @property
    def attendance_rows(self) -> DataFrame:
        """One row per order line."""
        return self.attendance(self.lines)

    @property
    def snapshots(self) -> DataFrame:
        """The last line of every participant and event; picked as numbers, formatted after."""
        order = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"]
        return self.attendance(last_row(self.lines, ["o_custkey", "l_partkey"], order)).drop(*order)

    @property
    def links(self) -> DataFrame:
        return self.links_where()

    def links_where(self, **keys: str) -> DataFrame:
        """Links with the given keys, which the scans test as the numbers they are stored as."""
        line, orders = self.raw("lineitem"), self.raw("orders")
        for name, value in keys.items():
            column, test = numbered(name, value)
            line, orders = (line.filter(test), orders) if column.startswith("l_") else (line, orders.filter(test))
        line = line.select("l_orderkey", "l_partkey").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        # The keys are made distinct as numbers and formatted once per pair.
        return line.select("o_custkey", "l_partkey").distinct().select(
            F.format_string("P%04d", "o_custkey").alias("participant_id"),
            F.format_string("E%05d", "l_partkey").alias("event_id"),
        )

    @property
    def tests(self) -> DataFrame:
        line = self.raw("lineitem").join(
            self.raw("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")
        )
        return line.select(
            F.format_string("E%05d", "l_partkey").alias("eid"),
            F.format_string("P%04d", "o_custkey").alias("pid"),
            F.when(F.col("l_linestatus") == "F", "pre").otherwise("post").alias("type"),
            F.col("l_quantity").alias("score"),
        )


#: The same views in SQL; a query names the ones it needs.
VIEWS = {
    "v_countries": "select printf('C%03d', n_nationkey) cid, n_name country, n_nationkey::bigint ord from nation",
    "v_participants": """select printf('P%04d', c_custkey) pid, c_name as name,
        printf('C%03d', c_nationkey) representing_country,
        case when c_custkey % 2 = 0 then 'Male' else 'Female' end gender, (c_custkey % 3)::int grade,
        date '1950-01-01' + (c_custkey * 37 % 20000)::int dob, 'Town ' || (c_custkey % 97) pob,
        printf('C%03d', (c_nationkey + c_custkey % 3) % 27) birth_country,
        printf('C%03d', c_custkey % 28) third_country,
        'user' || c_custkey || '@example.org' email, '+385' || lpad(c_custkey::varchar, 8, '0') phone,
        c_mktsegment as position, c_custkey ord from customer""",
    "v_events": """select printf('E%05d', p_partkey) eid, p_name title,
        (date '2020-01-01' + (p_partkey % 1500)::int)::timestamp start_date,
        (date '2020-01-01' + (p_partkey % 1500 + p_partkey % 5)::int)::timestamp end_date,
        p_brand place, printf('C%03d', p_partkey % 28) country,
        case when p_partkey % 2 = 0 then 'Training' else 'Workshop' end as type, p_retailprice as cost,
        1 embedded from part
        union all
        select printf('S%05d', s_suppkey), '', null, null, s_name, printf('C%03d', s_nationkey), 'Other', s_acctbal,
        case when s_suppkey % 2 = 0 then 2 else 0 end from supplier""",
    "v_lines": "select * from lineitem join orders on l_orderkey = o_orderkey",
    "v_attendance": """select printf('P%04d', o_custkey) participant_id, printf('E%05d', l_partkey) event_id,
        case l_returnflag when 'A' then 'Air (Airplane)' when 'N' then 'Other' else 'Personal Vehicle (POV)' end transportation,
        case when l_returnflag = 'N' and l_linenumber > 2 then 'bus' end transport_other,
        printf('C%03d', l_suppkey % 30) traveling_from,
        case when l_linestatus = 'F' then o_orderpriority else '  ' end returning_to,
        case when l_linestatus = 'F' then 'Passport' else 'ID Card' end travel_doc_type,
        o_orderdate::date::timestamp travel_doc_issue_date, l_shipdate::date::timestamp travel_doc_expiry_date,
        printf('C%03d', o_custkey % 26) travel_doc_issued_by,
        case when l_linenumber < 4 then 'Bank ' || l_linenumber end bank_name, null::varchar iban,
        case when l_linenumber = 1 then 'EURO' end iban_type, null::varchar swift,
        l_orderkey, l_linenumber, l_suppkey, l_quantity from v_lines""",
    "v_snapshots": """select * from v_attendance qualify row_number() over (partition by participant_id, event_id
        order by l_orderkey desc, l_linenumber desc, l_suppkey desc, l_quantity desc) = 1""",
    "v_links": "select distinct printf('P%04d', o_custkey) participant_id, printf('E%05d', l_partkey) event_id from v_lines",
    "v_tests": """select printf('E%05d', l_partkey) eid, printf('P%04d', o_custkey) pid,
        case when l_linestatus = 'F' then 'pre' else 'post' end as type, l_quantity score from v_lines""",
}


def with_views(names: str, query: str) -> str:
    """SQL of a query over the named views and the views those need."""
    needed: list[str] = []

    def add(name: str) -> None:
        for other in VIEWS:
            if other != name and other in VIEWS[name]:
                add(other)
        if name not in needed:
            needed.append(name)

    for name in names.split():
        add(name)
    views = ", ".join(f"{name} as ({VIEWS[name]})" for name in needed)
    return f"with {views} {query}" if views else query

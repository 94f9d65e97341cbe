"""Keyed changes of stored tables: each returns the new table, which a sink then swaps in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rollbook.functions.enums import audit_value, to_bool
from rollbook.functions.names import display_name
from rollbook.functions.phones import normalize_phone
from rollbook.functions.text import blank_to_null, same_items, text
from rollbook.operators.sequence import number_first_seen
from rollbook.operators.validate import errors_of, participant_rules
from rollbook.schemas import GENDERS, GRADES, SNAPSHOT_KEYS
from rollbook.session import checkpointed

# Names of a country that no longer exists, read as the represented country.
YUGOSLAV = ("sfrj", "jugoslavia", "yugoslavia", "yug")


def upsert(
    base: DataFrame, delta: DataFrame, keys: Sequence[str], nulls: str = "keep", present: str | None = None
) -> DataFrame:
    """Insert new keys and update known ones; keys are unique on both sides.

    ``nulls="keep"`` leaves a stored value where the delta has null.  ``nulls="overwrite"``
    stores the null; columns that the delta lacks stay, and with ``present`` (an array
    column of names) only the named columns of each row are written.
    """
    if nulls not in ("keep", "overwrite"):
        raise ValueError(f"nulls must be 'keep' or 'overwrite', not {nulls!r}")
    changed = [c for c in delta.columns if c not in keys and c != present]
    added = [c for c in changed if c not in base.columns]
    mark = delta.withColumns({f"_d_{c}": F.col(c) for c in changed}).withColumn("_in_delta", F.lit(True))
    if present:
        mark = mark.withColumn("_present", F.col(present))
    mark = mark.select(*keys, "_in_delta", *[f"_d_{c}" for c in changed], *(["_present"] if present else []))
    joined = base.join(mark, list(keys), "full")

    def value(name: str) -> Column:
        if name not in changed:
            return F.col(name)
        new = F.col(f"_d_{name}")
        old = F.col(name) if name in base.columns else F.lit(None)
        if nulls == "keep":
            return F.coalesce(new, old).alias(name)
        written = F.coalesce(F.col("_in_delta"), F.lit(False))
        if present:
            written = written & F.array_contains("_present", name)
        return F.when(written, new).otherwise(old).alias(name)

    return joined.select(*[value(c) for c in [*base.columns, *added]])


def bulk_upsert(base: DataFrame, delta: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Upsert rows that may repeat a key: per column the last value that is not null counts."""
    columns = [c for c in delta.columns if c not in (*keys, order)]
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    return upsert(base, delta.groupBy(*keys).agg(*last), keys)


def upsert_scores(base: DataFrame, rows: DataFrame, order: str) -> DataFrame:
    """Store test scores, one for each event, participant and kind: the last new score replaces the stored one."""
    return bulk_upsert(base, rows, ["eid", "pid", "type"], order)


def one_per_key(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The smallest row of every key, so that the choice does not depend on the order of the rows."""
    others = [c for c in rows.columns if c not in keys]
    if not others:
        return rows.distinct()
    least = rows.groupBy(*keys).agg(F.min(F.struct(*others)).alias("_least"))
    return least.select(*[F.col(c) if c in keys else F.col("_least").getField(c).alias(c) for c in rows.columns])


def insert_missing(base: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add rows with new keys and leave stored rows alone; of a repeated new key the smallest row is added."""
    fresh = one_per_key(delta.join(base.select(*keys), list(keys), "left_anti"), keys)
    return base.unionByName(fresh, allowMissingColumns=True)


def register_links(base: DataFrame, rows: DataFrame, order: str) -> DataFrame:
    """Rows with only the two keys guarantee a link; rows with more values update the snapshot."""
    keys = list(SNAPSHOT_KEYS)
    details = [c for c in rows.columns if c not in (*keys, order)]
    filled = F.lit(False)
    for name in details:
        filled = filled | F.col(name).isNotNull()
    linked = insert_missing(base, rows.filter(~filled).select(*keys), keys)
    return bulk_upsert(linked, rows.filter(filled), keys, order)


def patch(base: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Change columns of known keys; unknown keys of the delta are ignored."""
    changed = [c for c in delta.columns if c not in keys]
    side = delta.select(*keys, *[F.col(c).alias(f"_d_{c}") for c in changed])
    joined = base.join(side, list(keys), "left")
    return joined.select(
        *[F.coalesce(f"_d_{c}", F.col(c)).alias(c) if c in changed else F.col(c) for c in base.columns]
    )


def patch_participants(base: DataFrame, delta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge changes into participants; rows that break a rule keep their old state and are reported."""
    merged = patch(base, delta, ["pid"]).withColumn("name", display_name("name"))
    checked = merged.join(delta.select("pid", F.lit(True).alias("_changed")), "pid", "left").withColumn(
        "errors", F.when(F.col("_changed"), participant_rules()).otherwise(F.array().cast("array<string>"))
    )
    bad = checked.filter(F.size("errors") > 0).select("pid", "errors")
    good = delta.join(bad.select("pid"), "pid", "left_anti")
    phones = good.withColumn("phone", normalize_phone("phone")) if "phone" in good.columns else good
    names = phones.withColumn("name", display_name("name")) if "name" in good.columns else phones
    return patch(base, names, ["pid"]), bad


def delete(base: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return base.join(keys.select(*on), list(on), "left_anti")


def renormalize_phones(participants: DataFrame) -> DataFrame:
    """Stored phones with their normal form and whether they are ``ok``, ``changed`` or ``invalid``."""
    found = normalize_phone("phone")
    status = F.when(found.isNull(), "invalid").when(found == F.col("phone"), "ok").otherwise("changed")
    return participants.filter(F.col("phone").isNotNull()).select(
        "pid", F.col("phone").alias("stored"), found.alias("normalized"), status.alias("status")
    )


def apply_phones(participants: DataFrame) -> DataFrame:
    """Participants with every phone that can be normalised in its normal form."""
    return participants.withColumn("phone", F.coalesce(normalize_phone("phone"), F.col("phone")))


def import_audit(field: Column | str, value: Column, actor: str, ts: Column, sheet: str, row_no: Column, table: Column | None = None) -> Column:
    """Audit array with the one entry that an import writes."""
    entry = F.struct(
        ts.cast("timestamp").alias("ts"),
        F.lit(actor).alias("actor"),
        (F.lit(field) if isinstance(field, str) else field).alias("field"),
        F.lit(None).cast("string").alias("from"),
        value.cast("string").alias("to"),
        F.struct(
            F.lit(sheet).alias("sheet"),
            row_no.cast("bigint").alias("row"),
            (F.lit(None).cast("string") if table is None else blank_to_null(table)).alias("table"),
        ).alias("source"),
    )
    return F.array(entry)


# --- countries ---------------------------------------------------------------------


def ensure_countries(
    labels: DataFrame, label: str, order: str, countries: DataFrame, prefix: str = "C"
) -> tuple[DataFrame, DataFrame]:
    """Country codes for labels: returns the extended countries and ``(label, cid)``.

    Text shaped like a code is its own code, a known name or code reuses its code, and other
    labels get new numbers above every number in use, in order of first appearance.
    """
    shaped = r"^[A-Z]\d{3}$"
    seen = (
        labels.select(text(label).alias("_text"), order)
        .filter("_text <> ''")
        .groupBy(F.lower("_text").alias("_key"))
        .agg(F.min(order).alias("_at"), F.min_by("_text", order).alias("_text"))
    )
    iso = [F.col("iso")] if "iso" in countries.columns else []
    keys = (
        countries.select("cid", "ord", F.explode(F.array("country", "cid", *iso)).alias("_key"))
        .withColumn("_key", F.lower("_key"))
        .filter("_key <> ''")
        .groupBy("_key")
        .agg(F.max_by("cid", "ord").alias("_known"))
    )
    joined = seen.join(keys, "_key", "left").withColumn(
        "_known", F.when(F.upper("_text").rlike(shaped), F.upper("_text")).otherwise(F.col("_known"))
    )
    number = F.when(F.col("cid").startswith(prefix), F.regexp_extract("cid", r"(\d+)$", 1).try_cast("bigint"))
    used = countries.agg(F.greatest(F.count(F.lit(1)), F.coalesce(F.max(number), F.lit(0))).alias("top"))
    coded_texts = seen.filter(F.upper("_text").rlike(shaped) & F.upper("_text").startswith(prefix))
    claimed = coded_texts.agg(F.max(F.substring("_text", 2, 3).cast("bigint")).alias("top"))
    top = used.unionByName(claimed).agg(F.max("top").alias("top")).scalar()
    fresh = number_first_seen(
        joined.filter(F.col("_known").isNull()), ["_key"], "_at", "_new", f"{prefix}%03d", start=top + 1
    )
    # One row per label: numbered once, and read by both results.
    coded = checkpointed(
        joined.join(fresh.select("_key", "_new"), "_key", "left").withColumn("cid", F.coalesce("_known", "_new"))
    )
    mapping = coded.select("_key", "cid")
    mapped = labels.withColumn("_key", F.lower(text(label))).join(mapping, "_key", "left").drop("_key")
    extra = coded.join(countries.select("cid"), "cid", "left_anti").select(
        "cid", F.col("_text").alias("country"), (F.lit(1 << 40) + F.regexp_extract("cid", r"(\d+)$", 1).try_cast("bigint")).alias("ord")
    )
    return countries.unionByName(extra, allowMissingColumns=True), mapped


def ensure_countries_legacy(labels: DataFrame, label: str, order: str, countries: DataFrame) -> DataFrame:
    """Older numbering ``c%03d`` after the number of known countries; blank text is ``c000``."""
    size = countries.agg(F.count(F.lit(1)).alias("n")).scalar()
    keyed = labels.withColumn("_key", F.lower(text(label)))
    known = countries.groupBy(F.lower("country").alias("_key")).agg(F.min("cid").alias("_known"))
    fresh = number_first_seen(
        keyed.filter("_key <> ''").join(known, "_key", "left_anti"), ["_key"], order, "_new", "c%03d", start=size + 1
    )
    joined = keyed.join(known, "_key", "left").join(fresh.select("_key", "_new"), "_key", "left")
    code = F.when(F.col("_key") == "", "c000").otherwise(F.coalesce("_known", "_new"))
    return joined.withColumn("cid", code).drop("_key", "_known", "_new")


# --- form edits with audit -----------------------------------------------------------

_FORM_TEXT = (
    "position email phone diet_restrictions organization unit rank bio_short"
).split()
EDIT_FIELDS = [
    "name", "position", "representing_country", "birth_country", "citizenships", "grade", "gender", "dob", "pob",
    "email", "phone", "diet_restrictions", "organization", "unit", "rank", "intl_authority", "bio_short",
]


def _with_form_country(df: DataFrame, field: str, countries: DataFrame) -> DataFrame:
    """Add ``_code_<field>`` and ``_named_<field>``: the code a form value is or names."""
    value = blank_to_null(f"_f_{field}")
    codes = countries.select(F.col("cid").alias(f"_code_{field}"))
    names = (
        countries.groupBy(F.lower("country").alias("_lower")).agg(F.max_by("cid", "ord").alias(f"_named_{field}"))
    )
    joined = df.join(codes, value == F.col(f"_code_{field}"), "left")
    return joined.join(names, F.lower(value) == F.col("_lower"), "left").drop("_lower")


def edited(base: DataFrame, edits: DataFrame, countries: DataFrame) -> DataFrame:
    """Edited participants with the old row, the new values (``_v_*``) and the form's ``errors``.

    ``edits`` has one row per pid with the form fields as text and ``citizenships`` as an
    array; null means that the form left the field out.
    """
    from rollbook.functions.dates import normalize_dob

    form = edits.select("pid", *[F.col(c).alias(f"_f_{c}") for c in EDIT_FIELDS])
    joined = base.join(form, "pid")
    for field in ("representing_country", "birth_country"):
        joined = _with_form_country(joined, field, countries)
    raw = {c: blank_to_null(f"_f_{c}") for c in EDIT_FIELDS if c != "citizenships"}

    def stored_again(field: str) -> Column:
        return F.when(F.lower(raw[field]) == F.lower(F.col(field)), F.col(field))

    representing = F.coalesce(
        "_code_representing_country", "_named_representing_country", stored_again("representing_country")
    )
    birth = F.when(F.col("_code_birth_country").isNotNull(), F.col("_code_birth_country")).otherwise(
        F.when(F.lower(raw["birth_country"]).isin(*YUGOSLAV), representing).otherwise(
            F.coalesce("_named_birth_country", stored_again("birth_country"))
        )
    )
    listed = F.filter(
        F.transform("_f_citizenships", lambda c: blank_to_null(c)), lambda c: c.isNotNull()
    )
    listed = F.when(F.size(listed) > 0, listed)
    same = same_items(
        F.coalesce("citizenships", F.array().cast("array<string>")), F.coalesce(listed, F.array().cast("array<string>"))
    )
    typed_grade = raw["grade"].try_cast("int")
    authority = F.when(F.col("_f_intl_authority").isNull(), F.col("intl_authority")).otherwise(
        to_bool("_f_intl_authority", "form")
    )
    values = {
        "name": raw["name"],
        "representing_country": representing,
        "birth_country": birth,
        "citizenships": F.when(same, F.col("citizenships")).otherwise(listed),
        "grade": F.when(raw["grade"].isNull(), F.col("grade")).otherwise(typed_grade),
        "gender": raw["gender"],
        "dob": normalize_dob("_f_dob"),
        "pob": raw["pob"],
        "intl_authority": authority,
    }
    values.update({c: raw[c] for c in _FORM_TEXT})
    out = joined.withColumns({f"_v_{c}": values[c] for c in EDIT_FIELDS})
    unknown = unknown_codes(out, "_f_citizenships", countries)
    out = out.join(unknown, "pid", "left")
    rules = errors_of(
        (raw["name"].isNull(), "Name is required."),
        (raw["representing_country"].isNull(), "Representing Country is required."),
        (raw["representing_country"].isNotNull() & representing.isNull(), "Invalid country selection for 'representing_country'."),
        (raw["birth_country"].isNull(), "Birth Country is required."),
        (raw["birth_country"].isNotNull() & birth.isNull(), "Invalid country selection for 'birth_country'."),
        (F.col("_unknown") > 0, "Invalid citizenship selection."),
        (raw["grade"].isNotNull() & ~F.coalesce(typed_grade.isin(*GRADES), F.lit(False)), "Invalid grade selection."),
        (raw["gender"].isNull(), "Gender selection is required."),
        (raw["gender"].isNotNull() & ~raw["gender"].isin(*GENDERS), "Invalid selection for 'gender'."),
        (raw["dob"].isNull(), "Dob is required."),
        (raw["dob"].isNotNull() & F.col("_v_dob").isNull(), "Invalid date for 'dob'."),
        (raw["pob"].isNull(), "Place of birth is required."),
        (raw["phone"].isNotNull() & normalize_phone("_f_phone").isNull(), "phone invalid"),
        (~raw["email"].rlike(r"^[^@\s]+@[^@\s.]+(\.[^@\s.]+)+$"), "email invalid"),
    )
    return out.withColumn("errors", rules)


def unknown_codes(df: DataFrame, items: str, countries: DataFrame) -> DataFrame:
    """Number of different array items per pid that are no country code; pids without any are absent."""
    single = df.select("pid", F.explode(items).alias("_item")).withColumn("_item", blank_to_null("_item"))
    missing = single.filter(F.col("_item").isNotNull()).join(
        countries.select(F.col("cid").alias("_item")), "_item", "left_anti"
    )
    return missing.groupBy("pid").agg(F.count(F.lit(1)).alias("_unknown"))


def _audit_text(name: str, kind: str) -> Column:
    column = F.col(name)
    if kind == "date":
        return audit_value(column.cast("timestamp"), "date")
    return audit_value(column, "array" if kind.startswith("array") else "text")


def audit_changes(base: DataFrame, edits: DataFrame, countries: DataFrame, actor: str, ts: Column) -> DataFrame:
    """One row per changed field of every accepted edit: ``pid, ts, actor, field, from, to``."""
    good = edited(base, edits, countries).filter(F.size("errors") == 0)
    return good.select("pid", F.inline(_changes(dict(base.dtypes), actor, ts))).drop("source")


def _changes(kinds: dict[str, str], actor: str, ts: Column) -> Column:
    def entry(name: str) -> Column:
        old, new = F.col(name), F.col(f"_v_{name}")
        item = F.struct(
            ts.cast("timestamp").alias("ts"),
            F.lit(actor).alias("actor"),
            F.lit(name).alias("field"),
            _audit_text(name, kinds[name]).alias("from"),
            _audit_text(f"_v_{name}", kinds[name]).alias("to"),
            F.lit(None).cast("struct<sheet:string,row:bigint,table:string>").alias("source"),
        )
        return F.when(~old.eqNullSafe(new), item)

    return F.array_compact(F.array(*[entry(name) for name in EDIT_FIELDS]))


def apply_edits(
    base: DataFrame, edits: DataFrame, countries: DataFrame, actor: str, ts: Column
) -> tuple[DataFrame, DataFrame]:
    """Participants after the accepted edits, and the rejected edits with their errors.

    Changed rows get one audit entry per changed field and a new ``updated_at``; a field
    that the form cleared becomes null.
    """
    kinds = dict(base.dtypes)
    checked = edited(base, edits, countries)
    rejects = checked.filter(F.size("errors") > 0).select("pid", "errors")
    empty = F.array().cast(kinds["_audit"])
    good = checked.filter(F.size("errors") == 0).withColumn(
        "_log", _changes(kinds, actor, ts).cast(kinds["_audit"])
    )
    good = good.filter(F.size("_log") > 0)
    stored = {c: F.col(f"_v_{c}") for c in EDIT_FIELDS}
    stored["name"] = display_name("_v_name")
    stored["phone"] = normalize_phone("_v_phone")
    delta = good.select(
        "pid",
        *[stored[c].alias(c) for c in EDIT_FIELDS],
        F.concat(F.coalesce("_audit", empty), "_log").alias("_audit"),
        ts.cast("timestamp").alias("updated_at"),
    )
    return upsert(base, delta, ["pid"], nulls="overwrite"), rejects

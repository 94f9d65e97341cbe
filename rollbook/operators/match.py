"""Record linkage: country resolution, name lookups and matching of stored participants.

None of the joins here is a cross or range join.  Prefix and substring matching become
equality joins against the prefixes and substrings of the country names, and matching of
people uses lookups with one row per key, so equal names never multiply.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rollbook.functions.names import name_variants
from rollbook.functions.text import canon, split_multi_country, strip, text

# Texts that stand for "no country".
SKIPPED = ("", "n/a", "none", "no", "i don't have", "i do not have", "/", "-", "—", "–", "0")

# Patterns over lower-case text without accents, in order of precedence,
# with the country name each one stands for.
ALIASES = [
    (r"^(alb|albanian)\b", "Albania"),
    (r"^(bih)\b", "Bosnia and Herzegovina"),
    (r"^(bosn|bosna|bosnian)\b", "Bosnia and Herzegovina"),
    (r"herzeg", "Bosnia and Herzegovina"),
    (r"^(cro|hrv|hrvat|hrvatska|rh)\b", "Croatia"),
    (r"\bcroatian\b", "Croatia"),
    (r"^kos", "Kosovo"),
    (r"\bkosovar\b", "Kosovo"),
    (r"^(monte|monten|crna\s*gora)\b", "Montenegro"),
    (r"\bmontenegrin\b", "Montenegro"),
    (r"^(maced|maked|mkd|sjeverna|severna|north\s+maced)", "North Macedonia"),
    (r"\bmacedonian\b", "North Macedonia"),
    (r"^(serb|srb)\b", "Serbia"),
    (r"^r\s+serbia\b", "Serbia"),
    (r"\brepublika\s*srbija\b", "Serbia"),
    (r"\bserbian\b", "Serbia"),
]

# Names known to the older resolver, with the way they are recognised.
REGION = "Europe & Eurasia"
LEGACY_NAMES = [
    ("Bosnia and Herzegovina", "exact", "Bosnia and Herzegovina"),
    ("Croatia", "exact", "Croatia"),
    ("Kosovo", "exact", "Kosovo"),
    ("North Macedonia", "exact", "North Macedonia"),
    ("Serbia", "exact", "Serbia"),
    ("hrv", "iso", "Croatia"),
    ("bosnia herzegovina", "exact", "Bosnia and Herzegovina"),
    ("bh", "alias", "Bosnia and Herzegovina"),
    ("bih", "alias", "Bosnia and Herzegovina"),
    ("kosovar", "alias", "Kosovo"),
    ("makedonija", "alias", "North Macedonia"),
    ("republika srbija", "alias", "Serbia"),
]


# --- countries ---------------------------------------------------------------------


def _named(countries: DataFrame) -> DataFrame:
    return countries.filter((F.col("cid") != "") & (F.col("country") != "")).select("cid", "country", "ord")


def _first_by_text(countries: DataFrame, pieces: Column, how: str) -> DataFrame:
    """One row per text piece of the country names with the first country that has it."""
    exploded = _named(countries).select(F.explode(pieces).alias("key"), "cid", "country", "ord")
    first = F.min_by(F.struct("cid", "country"), F.col("ord")).alias("found")
    return exploded.groupBy("key").agg(first).select(F.lit(how).alias("how"), "key", "found")


def _prefixes(name: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(name)), lambda n: F.substring(name, F.lit(1), n))


def _substrings(name: Column) -> Column:
    starts = F.sequence(F.lit(1), F.length(name))
    return F.array_distinct(
        F.flatten(
            F.transform(
                starts,
                lambda i: F.transform(
                    F.sequence(F.lit(1), F.length(name) - i + 1), lambda n: F.substring(name, i, n)
                ),
            )
        )
    )


def country_pieces(countries: DataFrame, hows: Sequence[str]) -> DataFrame:
    """Lookup ``(how, key) -> found`` for prefix, contains and accent-free contains matches."""
    name = F.lower("country")
    folded = F.trim(canon("country"))
    pieces = {"prefix": _prefixes(name), "contains": _substrings(name), "folded": _substrings(folded)}
    tables = [_first_by_text(countries, pieces[how], how) for how in hows]
    lookup = tables[0]
    for table in tables[1:]:
        lookup = lookup.unionByName(table)
    return lookup


def country_first_match(tokens: DataFrame, token: str, countries: DataFrame, how: str = "prefix") -> DataFrame:
    """Each different token with the first country whose name starts with or contains it."""
    distinct = tokens.select(token).distinct().withColumn("key", F.lower(text(token)))
    lookup = country_pieces(countries, [how]).drop("how")
    joined = distinct.filter("key <> ''").join(lookup, "key")
    return joined.select(token, "found.cid", "found.country")


def resolve_tokens(
    tokens: DataFrame,
    token: str,
    countries: DataFrame,
    aliases: Sequence[tuple[str, str]] = ALIASES,
    strict: bool = False,
) -> DataFrame:
    """Each different token with its country: aliases, then prefix, contains, accent-free contains.

    ``strict`` stops after the prefix match.  Tokens that stand for no country or that match
    nothing are absent.  Every token yields a handful of ``(priority, how, key)`` probes,
    one equality join answers them all, and the lowest priority hit counts.
    """
    value = F.coalesce(F.col(token), F.lit(""))
    # Both forms are columns of their own, so that the many patterns below share them.
    forms = {"_folded": strip(canon(value)), "_lowered": F.lower(strip(value))}
    distinct = tokens.select(token).distinct().filter(value != "").withColumns(forms)
    folded, lowered = F.col("_folded"), F.col("_lowered")

    def probe(priority: int, how: str, key: Column) -> Column:
        return F.struct(F.lit(priority).alias("priority"), F.lit(how).alias("how"), key.alias("key"))

    probes = [
        F.when(folded.rlike(f"(?U){pattern}"), probe(no, "prefix", F.lit(name.lower())))
        for no, (pattern, name) in enumerate(aliases)
    ]
    probes.append(probe(len(aliases), "prefix", lowered))
    if not strict:
        probes.append(probe(len(aliases) + 1, "contains", lowered))
        probes.append(probe(len(aliases) + 2, "folded", folded))
    # Skipped texts get no probes.  A filter would move below the distinct, to every mention.
    wanted = F.when(~folded.isin(*SKIPPED), F.array_compact(F.array(*probes)))
    probed = distinct.select(token, F.inline(wanted)).filter("key <> ''")
    lookup = country_pieces(countries, ["prefix"] if strict else ["prefix", "contains", "folded"])
    hits = probed.join(lookup, ["how", "key"])
    return hits.groupBy(token).agg(F.min_by("found", "priority").alias("found")).select(
        token, "found.cid", "found.country"
    )


def _rule_keys(folded: Column, longest: Column) -> Column:
    """What a text is found by: its words, its beginnings as long as a literal can be, its pieces of one to three letters."""

    def tagged(how: str, keys: Column) -> Column:
        return F.transform(F.array_distinct(keys), lambda key: F.struct(F.lit(how).alias("how"), key.alias("key")))

    beginnings = F.transform(F.sequence(F.lit(0), F.least(F.length(folded), longest)), lambda n: F.substring(folded, F.lit(1), n))
    words = F.split(folded, r"[^\p{L}\p{N}_]+")
    # Pieces overlap: each is looked at from where it begins.
    inner = F.concat(*[F.regexp_extract_all(folded, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)) for size in (1, 2, 3)])
    return F.concat(tagged("word", words), tagged("prefix", beginnings), tagged("piece", inner))


def resolve_by_rules(tokens: DataFrame, token: str, countries: DataFrame, rules: DataFrame, strict: bool = False) -> DataFrame:
    """``resolve_tokens`` with the aliases as a table: ``priority, how, literal, pattern, country``.

    A rule fits a text (lower-case, without accents) that its ``pattern`` matches and that has its ``literal`` as a
    whole word, as its beginning or anywhere (``how``: word, prefix, piece).  Texts fetch rules by equality of these,
    so only fetched rules run their pattern and the table may be large; pieces are fetched by their first three letters.
    The fitting rule of least priority counts whose ``country`` begins the name of a country, then the names as in
    ``resolve_tokens``.  Rules with a null or an empty literal fit nothing.
    """
    rules = rules.filter((F.col("literal") != "") & F.col("priority").isNotNull()).select(
        "priority", F.col("how").alias("_how"), "literal", "pattern", F.lower("country").alias("_target"),
        F.when(F.col("how") == "piece", F.substring("literal", 1, 3)).otherwise(F.col("literal")).alias("_key"),
    )
    value = F.coalesce(F.col(token), F.lit(""))
    distinct = tokens.select(token).distinct().filter(value != "").withColumn("_folded", strip(canon(value)))
    # No beginning longer than the longest literal is worth a probe.
    distinct = distinct.withColumn("_longest", rules.agg(F.coalesce(F.max(F.length("literal")), F.lit(0))).scalar())
    keys = F.flatten(F.transform(F.array("_folded"), lambda folded: _rule_keys(folded, F.col("_longest"))))
    # The keys are no column of their own: a filter on one would move below the distinct and make them for every mention.
    wanted = F.when(~F.col("_folded").isin(*SKIPPED), keys)
    fetched = distinct.select(token, "_folded", F.inline(wanted)).join(rules, (F.col("how") == F.col("_how")) & (F.col("key") == F.col("_key")))
    fits = fetched.filter(F.contains("_folded", "literal") & F.regexp("_folded", F.concat(F.lit("(?U)"), F.col("pattern"))))
    lookup = country_pieces(countries, ["prefix"]).drop("how")
    ruled = fits.select(token, "priority", F.col("_target").alias("key")).join(lookup, "key")
    ruled = ruled.select(token, F.struct(F.lit(0).alias("stage"), F.col("priority").cast("long").alias("priority")).alias("place"), "found.cid", "found.country")
    named = resolve_tokens(tokens, token, countries, (), strict)
    named = named.select(token, F.struct(F.lit(1).alias("stage"), F.lit(0).cast("long").alias("priority")).alias("place"), "cid", "country")
    best = F.min_by(F.struct("cid", "country"), F.struct("place", "cid")).alias("found")
    return ruled.unionByName(named).groupBy(token).agg(best).select(token, "found.cid", "found.country")


def with_resolved_country(
    df: DataFrame, token: str, countries: DataFrame, into: str, aliases: Sequence[tuple[str, str]] = ALIASES
) -> DataFrame:
    """Add the country code of a text column; unresolved text gives null."""
    found = resolve_tokens(df, token, countries, aliases).select(
        F.col(token).alias("_resolved"), F.col("cid").alias(into)
    )
    return df.join(found, F.col(token) == F.col("_resolved"), "left").drop("_resolved")


def label_to_cid(df: DataFrame, label: str, countries: DataFrame, into: str) -> DataFrame:
    """Add the code of the first country whose name starts with the label, else the label."""
    found = country_first_match(df, label, countries).select(
        F.col(label).alias("_label"), F.col("cid").alias("_cid")
    )
    joined = df.join(found, F.col(label) == F.col("_label"), "left")
    return joined.withColumn(into, F.coalesce("_cid", F.col(label))).drop("_label", "_cid")


def birth_country(df: DataFrame, raw: str, representing: str, countries: DataFrame, into: str) -> DataFrame:
    """Code of the birth country; an unresolved one is the represented country."""
    cleaned = df.withColumn("_birth", F.regexp_replace(text(raw), r"(?i),\s*world$", ""))
    resolved = with_resolved_country(cleaned, "_birth", countries, "_birth_cid")
    return resolved.withColumn(into, F.coalesce("_birth_cid", representing)).drop("_birth", "_birth_cid")


def citizenship_cids(df: DataFrame, items: str, keys: Sequence[str], countries: DataFrame) -> DataFrame:
    """Per key the codes of all citizenships mentioned, distinct and in order; unresolved ones fall away.

    ``items`` is an array of texts.  Only keys with at least one resolved code are returned.
    """
    mentions = df.select(*keys, F.posexplode(items).alias("_at", "_text"))
    tokens = mentions.select(*keys, "_at", F.posexplode(split_multi_country("_text")).alias("_pos", "_token"))
    resolved = with_resolved_country(tokens, "_token", countries, "cid").filter(F.col("cid").isNotNull())
    seen = resolved.groupBy(*keys, "cid").agg(F.min(F.struct("_at", "_pos")).alias("_seen"))
    ordered = F.array_sort(F.collect_list(F.struct("_seen", "cid")))
    return seen.groupBy(*keys).agg(ordered.alias("_items")).select(*keys, F.col("_items.cid").alias("citizenships"))


def event_country(events: DataFrame, countries: DataFrame) -> DataFrame:
    """Replace an event's country text by the code it names, by name, code or ISO, ignoring case."""
    iso = F.col("iso") if "iso" in countries.columns else F.lit(None).cast("string")
    keys = countries.select("ord", "cid", F.explode(F.array("country", "cid", iso)).alias("_key"))
    lookup = (
        keys.withColumn("_key", F.lower("_key"))
        .filter("_key <> ''")
        .groupBy("_key")
        .agg(F.max_by("cid", "ord").alias("_found"))
    )
    joined = events.join(lookup, F.lower("country") == F.col("_key"), "left")
    return joined.withColumn("country", F.coalesce("_found", "country")).drop("_key", "_found")


def legacy_country(c: Column | str) -> Column:
    """Country, region and method of the older resolver, null for unknown text."""
    lowered = F.lower(text(c))
    entries = {key.lower(): (name, method) for key, method, name in LEGACY_NAMES}
    found = F.when(F.lit(False), F.struct(*[F.lit("").alias(f) for f in ("country", "region", "method")]))
    for key, (name, method) in entries.items():
        found = found.when(
            lowered == key,
            F.struct(F.lit(name).alias("country"), F.lit(REGION).alias("region"), F.lit(method).alias("method")),
        )
    return found


# --- people ------------------------------------------------------------------------


def lookup_attendees(
    attendees: DataFrame,
    online: DataFrame,
    positions: DataFrame,
    keys: Sequence[str],
    name: str = "name_raw",
    scope: Sequence[str] = ("path",),
) -> DataFrame:
    """Add the online and positions entries of an attendee as the structs ``online`` and ``listed``.

    Each reading of the name probes both lookups with and without the middle name.  The
    first reading with any hit decides for both lookups.  The probes of one attendee are at
    most six rows and are reduced by ``keys``.
    """
    fields = [c for c in positions.columns if c not in (*scope, "key")]
    listed = positions.select(*scope, "key", F.struct(*fields).alias("listed"))
    lookup = online.select(*scope, "key", "online").join(listed, [*scope, "key"], "full")

    def key(reading: Column, middle: bool) -> Column:
        rest = F.trim(F.concat_ws(" ", reading["first"], reading["middle"])) if middle else reading["first"]
        return F.trim(F.concat_ws("|", reading["last"], rest))

    carried = list(dict.fromkeys([*scope, *keys]))
    readings = attendees.select(*carried, F.posexplode(name_variants(name)).alias("_reading_no", "_reading"))
    probes = F.array(key(F.col("_reading"), True), key(F.col("_reading"), False))
    probed = readings.select(*carried, "_reading_no", F.posexplode(probes).alias("_probe_no", "key"))
    rank = F.struct("_reading_no", "_probe_no")

    def first(entry: str) -> list[Column]:
        present = F.when(F.col(entry).isNotNull(), rank)
        return [F.min_by(entry, present).alias(entry), F.min(present).alias(f"_{entry}_at")]

    best = (
        probed.join(lookup, [*scope, "key"])
        .groupBy(*keys)
        .agg(F.min("_reading_no").alias("_won"), *first("online"), *first("listed"))
    )
    for entry in ("online", "listed"):
        best = best.withColumn(entry, F.when(F.col(f"_{entry}_at._reading_no") == F.col("_won"), F.col(entry)))
    return attendees.join(best.select(*keys, "online", "listed"), list(keys), "left")


def match_existing(
    incoming: DataFrame,
    stored: DataFrame,
    missing_dob: str = "strict",
    into: str = "matched_pid",
    name: str = "name",
    country: str = "representing_country",
    dob: str = "dob",
    few: bool = False,
) -> DataFrame:
    """Add the pid of the first stored participant with the same name and country.

    A stored person without a date of birth fits anyone; otherwise both dates must agree.
    A missing incoming date fits only stored rows without one (``strict``) or the first
    stored row (``lenient``).

    Stored rows are reduced to one row per name and country and one per name, country and
    date before the joins, so people who share a name never multiply.  ``few`` says that the
    incoming rows are few and cheap to read twice: stored rows with other names are then
    dropped before anything is shuffled.
    """
    people = stored.select(
        F.col("name").alias("_n"), F.col("representing_country").alias("_c"), F.col("dob").alias("_d"), "pid", "ord"
    )
    if few:
        wanted = incoming.select(F.col(name).alias("_n"), F.col(country).alias("_c")).distinct()
        people = people.join(wanted, ["_n", "_c"], "left_semi")
    place = F.struct("ord", "pid")
    by_name = people.groupBy("_n", "_c").agg(
        F.min(F.when(F.col("_d").isNull(), place)).alias("_open"), F.min(place).alias("_any")
    )
    by_date = people.filter(F.col("_d").isNotNull()).groupBy("_n", "_c", "_d").agg(F.min(place).alias("_dated"))
    same_name = (F.col(name) == F.col("_n")) & (F.col(country) == F.col("_c"))
    joined = incoming.join(by_name, same_name, "left").drop("_n", "_c")
    joined = joined.join(by_date, same_name & (F.col(dob) == F.col("_d")), "left").drop("_n", "_c", "_d")
    found = F.least("_open", "_dated")
    if missing_dob == "lenient":
        found = F.when(F.col(dob).isNull(), F.col("_any")).otherwise(found)
    elif missing_dob != "strict":
        raise ValueError(f"missing_dob must be 'strict' or 'lenient', not {missing_dob!r}")
    return joined.withColumn(into, found["pid"]).drop("_open", "_any", "_dated")


def classify(attendees: DataFrame, stored: DataFrame) -> DataFrame:
    """Dry run: ``EXIST`` for attendees that match a stored participant by name and country, else ``NEW``."""
    undated = attendees.withColumn("_no_dob", F.lit(None).cast("date"))
    matched = match_existing(undated, stored, "strict", "pid", dob="_no_dob").drop("_no_dob")
    return matched.withColumn("status", F.when(F.col("pid").isNull(), "NEW").otherwise("EXIST"))


def with_event_date(rows: DataFrame, events: DataFrame, event: str = "event_id") -> DataFrame:
    """Add the start date of the row's event; unknown events leave it null, which is the oldest."""
    dates = events.select(F.col("eid").alias("_eid"), F.col("start_date").alias("event_date"))
    return rows.join(dates, F.col(event) == F.col("_eid"), "left").drop("_eid")


def choose_snapshot(rows: DataFrame, supplied: DataFrame, keys: Sequence[str], extracted: str, order: str) -> DataFrame:
    """Supplied snapshot of a key, the last one if there are several, else the one from the row itself."""
    fields = [c for c in supplied.columns if c not in (*keys, order)]
    last = supplied.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.col(order)).alias("_supplied"))
    joined = rows.join(last, list(keys), "left")
    return joined.withColumn("snapshot", F.coalesce("_supplied", extracted)).drop("_supplied")


def translate(
    df: DataFrame, columns: Sequence[str], phrases: DataFrame | None, lang: str = "en", input_lang: str | None = None
) -> DataFrame:
    """Replace texts that the phrase table ``(phrase, lang, translated, source_lang)`` knows; other text stays as it is.

    With ``input_lang`` a text counts as translated only if the table names that source
    language; ``<column>_verified`` then tells which values were.  Phrases ignore case; of several
    translations of a phrase the one of the first source language, then the first text, counts.
    Without a phrase table nothing is translated; null text becomes empty either way.
    """
    if phrases is None:
        unverified = {f"{name}_verified": F.lit(False) for name in columns} if input_lang is not None else {}
        return df.withColumns({**unverified, **{name: F.coalesce(name, F.lit("")) for name in columns}})
    known = phrases.filter(F.lower("lang") == lang.lower())
    if input_lang is not None:
        known = known.filter(F.lower("source_lang") == input_lang.lower())
    known = known.groupBy(F.lower("phrase").alias("_phrase")).agg(
        F.min_by("translated", F.struct(F.lower("source_lang"), "translated")).alias("_to")
    )
    for name in columns:
        df = df.join(known, F.lower(name) == F.col("_phrase"), "left")
        hit = F.col("_to").isNotNull()
        if input_lang is not None:
            df = df.withColumn(f"{name}_verified", hit)
        df = df.withColumn(name, F.coalesce(F.when(hit, F.col("_to")).otherwise(F.col(name)), F.lit(""))).drop("_phrase", "_to")
    return df

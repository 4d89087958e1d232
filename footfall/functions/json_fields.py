"""Reading JSON texts strictly: a field of the wrong type makes the whole text malformed.

A typed JSON reader is too lax for this (it turns the number 5 into the text '5'), so texts are parsed to
VARIANT and the type of each field is looked at before its value is taken.

The functions give SQL expression texts. The plan of a micro-batch is built anew each time, and one text is one
call to the JVM where a tree of Column objects would be hundreds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: a date-time in RFC 3339 form.
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)$"

# The fields of an event text, and what each must be when it is there and not null.
TEXT_FIELDS = ["event_id", "event_name", "channel", "campaign_id", "user_id"]
OTHER_FIELDS = ["timestamp", "tags", "metadata", "created_at"]
MUST_BE = {
    "timestamp": "a whole number",
    "tags": "a list of strings",
    "metadata": "an object",
    "created_at": "an RFC 3339 time",
}

# The stored timestamp has a range: 1970-01-01 00:00:00 to 2106-02-07 06:28:15.
FIRST_SECOND = 0
LAST_SECOND = 4294967295

# The parser stops at the end of the first value and does not look at what follows. With this mark after the
# text, anything else that follows shows.
END = "end of text"


def quoted(text: str) -> str:
    """A SQL string literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def bind(value: str, name: str, use: str) -> str:
    """``use`` of a value under a name, so that it is worked out once however often ``use`` mentions it."""
    return f"transform(array({value}), {name} -> {use})[0]"


def once(value: str) -> str:
    """A value Spark must not work out again further up.

    A filter is pushed below the projection that makes a value by copying the whole expression, so every row
    would be parsed twice. Nothing is pushed past an expression that depends on where it runs.
    """
    return f"if(spark_partition_id() >= 0, {value}, NULL)"


def document(text: str) -> str:
    """The text as the first item of a VARIANT list, so that text behind the value is noticed too."""
    return f"""try_parse_json(concat('[', {text}, ',"{END}"]'))"""


def is_json(opened: str) -> str:
    """Whether the text behind a ``document`` is one JSON value."""
    return f"coalesce(try_variant_get({opened}, '$[1]', 'string') = '{END}', false)"


def is_null(opened: str) -> str:
    return f"coalesce(is_variant_null(try_variant_get({opened}, '$[0]', 'variant')), false)"


def fields(value: str, names: list[str], path: str = "$") -> str:
    """The named fields of a VARIANT object as a struct of VARIANTs; NULL when it is not an object."""
    shape = ", ".join(f"{name}: variant" for name in names)
    return f"try_variant_get({value}, '{path}', 'struct<{shape}>')"


def odd_case(text: str, names: list[str]) -> str:
    """Whether the text may hold one of the field names in other than lower case."""
    exact = "|".join(names)
    return f"""rlike({text}, '"(?!(?:{exact})")(?i:{exact})"')"""


def any_case_fields(value: str, found: str, names: list[str], path: str = "$") -> str:
    """``found`` with each field that is missing looked up by its name in any case."""

    def alike(name: str) -> str:
        return f"get(filter(named, entry -> lower(entry.key) = '{name}'), 0).value"

    filled = ", ".join(f"'{name}', coalesce({found}.{name}, {alike(name)})" for name in names)
    entries = f"map_entries(try_variant_get({value}, '{path}', 'map<string, variant>'))"
    return f"if({found} IS NULL, NULL, {bind(entries, 'named', f'named_struct({filled})')})"


def open_objects(rows: DataFrame, text: str, names: list[str]) -> DataFrame:
    """Add ``unreadable`` (why a text is no JSON object, or NULL) and ``fields`` (its fields, as VARIANTs).

    A null text reads as an object without fields.
    """
    some_missing = " OR ".join(f"fields.{name} IS NULL" for name in names)
    looked_up = f"""if(({some_missing}) AND {odd_case(text, names)},
        {any_case_fields("document", "fields", names, "$[0]")}, fields)"""
    unreadable = f"""CASE WHEN NOT {is_json("document")} THEN 'not JSON'
        WHEN fields IS NULL AND NOT {is_null("document")} THEN 'not a JSON object' END"""
    given = [f"`{c}`" for c in rows.columns]
    return (
        rows.selectExpr(*given, f"{once(document(text))} AS document")
        .selectExpr(*given, "document", f"{once(fields('document', names, '$[0]'))} AS fields")
        .selectExpr(*given, f"{once(unreadable)} AS unreadable", f"{once(looked_up)} AS fields")
        .selectExpr(*given, "unreadable", "fields", f"{once('to_json(fields.metadata)')} AS metadata_text")
    )


def as_values(found: str, metadata_text: str, names: list[str]) -> dict[str, str]:
    """The fields as plain values; missing and null ones read as blanks.

    Metadata is given as canonical JSON: keys sorted, no white space.
    """
    return {name: _value(name, metadata_text if name == "metadata" else f"{found}.{name}") for name in names}


def as_struct(values: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in values.items()) + ")"


def wrong(found: str, metadata_text: str, names: list[str]) -> str:
    """What is wrong with the first field that has the wrong type, or NULL."""
    checks = [_wrong(name, metadata_text if name == "metadata" else f"{found}.{name}") for name in names]
    return f"coalesce({', '.join(checks)})"


def _value(name: str, value: str) -> str:
    if name == "timestamp":
        return f"coalesce(try_variant_get({value}, '$', 'bigint'), 0L)"
    if name == "tags":
        items = f"try_variant_get({value}, '$', 'array<string>')"
        return f"coalesce(transform({items}, item -> coalesce(item, '')), CAST(array() AS array<string>))"
    if name == "metadata":
        return f"if(startswith({value}, '{{'), {value}, '{{}}')"
    return f"coalesce(try_variant_get({value}, '$', 'string'), '')"


def _wrong(name: str, value: str) -> str:
    complaint = f"'field {name} must be {MUST_BE.get(name, 'a string')}'"
    if name == "metadata":
        return f"if({value} <> 'null' AND NOT startswith({value}, '{{'), {complaint}, NULL)"
    kind = f"schema_of_variant({value})"
    fits = {
        "timestamp": f"{kind} = 'BIGINT'",
        "tags": f"{kind} IN ('ARRAY<STRING>', 'ARRAY<VOID>')",
        "created_at": f"{kind} = 'STRING' AND {_is_rfc3339(value)}",
    }.get(name, f"{kind} = 'STRING'")
    return f"if({value} IS NULL OR is_variant_null({value}) OR ({fits}), NULL, {complaint})"


def _is_rfc3339(value: str) -> str:
    text = f"try_variant_get({value}, '$', 'string')"
    return f"rlike({text}, {quoted(RFC3339)}) AND try_to_timestamp({text}) IS NOT NULL"


def canonical_object(text: str) -> str:
    """Canonical JSON of a text that holds an object; what cannot be read becomes '{}'."""
    return f"if(ltrim({text}) LIKE '{{%', coalesce(to_json(try_parse_json({text})), '{{}}'), '{{}}')"


def number_at(text: Column, name: str) -> Column:
    """A JSON number out of a metadata text, as double; 0 when absent, not a number or not finite."""
    value = F.from_json(text, f"`{name}` double", {"allowNonNumericNumbers": "false"})[name]
    return F.when(F.abs(value) < F.lit(float("inf")), value).otherwise(F.lit(0.0))


def money_sum(amount: Column) -> Column:
    """The sum of amounts, 0 of none; the same in any order and however partial sums are merged.

    Amounts below 10^17 are added as decimals, as they are written, to ten places: 38 digits hold 10^11 of the largest.
    Larger doubles are whole numbers and added as such below 10^27. Only amounts beyond that, which no price is, add up
    as doubles.
    """
    size = F.abs(amount)
    written = F.sum(F.when(size < 1e17, amount).cast("decimal(38,10)"))
    whole = F.sum(F.when((size >= 1e17) & (size < 1e27), amount).cast("decimal(38,0)"))
    rest = F.sum(F.when(size >= 1e27, amount))
    parts = [F.coalesce(x.cast("double"), F.lit(0.0)) for x in (written, whole, rest)]
    return parts[0] + parts[1] + parts[2]

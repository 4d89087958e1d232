"""Client requests as rows (request_id, body): one JSON text per request, single event or bulk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions import fixed as fx
from footfall.functions import json_fields as jf
from footfall.functions.schema import COMMAND_COLUMNS


def read_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of a folder, one request per line, named by what they hold and the file they came in."""
    return _named(spark.read.text(folder))


def stream_bodies(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    return _named(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder))


def _named(lines: DataFrame) -> DataFrame:
    name = F.sha2(F.concat_ws("|", F.input_file_name(), "value"), 256)
    return lines.select(name.alias("request_id"), F.col("value").alias("body"))


def decode_single(bodies: DataFrame) -> DataFrame:
    """(request_id, request_error, the seven command columns); the error is NULL for a readable body."""
    opened = jf.open_objects(bodies.select("request_id", "body"), "body", COMMAND_COLUMNS)
    problem = f"unreadable IS NOT NULL OR {jf.wrong('fields', 'metadata_text', COMMAND_COLUMNS)} IS NOT NULL"
    values = jf.as_values("fields", "metadata_text", COMMAND_COLUMNS)
    return opened.selectExpr(
        "request_id",
        f"{jf.once(f'if({problem}, {jf.quoted(fx.SAY_BAD_BODY)}, NULL)')} AS request_error",
        *[f"{value} AS {name}" for name, value in values.items()],
    )


def decode_bulk(bodies: DataFrame) -> DataFrame:
    """(request_id, request_error, events); the request is turned down whole when the error is not NULL.

    ``events`` holds the commands in request order. A missing list counts as empty.
    """
    found = jf.fields("document", ["events"], "$[0]")
    top = f"if(odd, {jf.any_case_fields('document', found, ['events'], '$[0]')}, {found})"
    items = "try_variant_get(top.events, '$', 'array<variant>')"
    readable = f"""{jf.is_json("document")} AND (top IS NOT NULL OR {jf.is_null("document")})
        AND (top.events IS NULL OR is_variant_null(top.events) OR {items} IS NOT NULL)"""
    request_error = f"""CASE
        WHEN NOT readable OR coalesce(exists(items, i -> i.wrong IS NOT NULL), false)
          THEN {jf.quoted(fx.SAY_BAD_BODY)}
        WHEN coalesce(size(items), 0) = 0 THEN {jf.quoted(fx.SAY_BULK_EMPTY)}
        WHEN size(items) > {fx.MAX_BULK_EVENTS} THEN {jf.quoted(fx.SAY_BULK_TOO_LONG)} END"""
    return (
        bodies.selectExpr(
            "request_id",
            f"{jf.once(jf.document('body'))} AS document",
            f"{jf.once(jf.odd_case('body', ['events', *COMMAND_COLUMNS]))} AS odd",
        )
        .selectExpr("*", f"{jf.once(top)} AS top")
        .selectExpr(
            "request_id",
            f"{jf.once(readable)} AS readable",
            f"{jf.once(f'transform({items}, item -> {_item()})')} AS items",
        )
        .selectExpr(
            "request_id",
            f"{jf.once(request_error)} AS request_error",
            f"{jf.once('transform(items, i -> i.command)')} AS events",
        )
    )


def _item() -> str:
    """One event of the list: its command and what is wrong with it. A null item reads as blanks."""
    exact = jf.fields("item", COMMAND_COLUMNS)
    found = f"if(odd, {jf.any_case_fields('item', exact, COMMAND_COLUMNS)}, {exact})"
    kind = "if(x.f IS NULL AND NOT is_variant_null(item), 'not an object', NULL)"
    judged = f"""named_struct(
        'command', {jf.as_struct(jf.as_values("x.f", "x.m", COMMAND_COLUMNS))},
        'wrong', coalesce({kind}, {jf.wrong("x.f", "x.m", COMMAND_COLUMNS)}))"""
    parts = jf.bind("named_struct('f', f, 'm', to_json(f.metadata))", "x", judged)
    return jf.bind(found, "f", parts)

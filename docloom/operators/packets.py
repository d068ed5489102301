"""Form packets as tables: what XML packets hold as typed rows, and packets written from such rows.

Input is ``file_id, name, data`` as the table ``xfa`` of a scan gives it. A packet that can't be
parsed gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from xml.etree.ElementTree import ParseError

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import xfa

#: What is read: kind, packet, row schema, reader, writer of rows.
KINDS: dict[str, tuple[str, str, Callable, Callable]] = {
    "questions": ("template", "id string, name string, label string, type string, required boolean, readonly boolean, hidden boolean, default string, options array<string>, min_length long, max_length long, pattern string, script string", xfa.template_questions, xfa.questions_xml),
    "rules": ("template", "field string, kind string, activity string, script string", xfa.template_rules, xfa.rules_xml),
    "values": ("datasets", "name string, path string, value string, kind string", xfa.dataset_values, xfa.datasets_xml),
    "config": ("config", "path string, attribute string, value string", xfa.attributes, xfa.from_attributes),
    "locales": ("localeSet", "code string, name string, is_default boolean, settings map<string,string>", xfa.locale_rows, xfa.locales_xml),
    "connections": ("connectionSet", "name string, type string, uri string, properties map<string,string>", xfa.connections, xfa.connections_xml),
    "styles": ("stylesheet", "name string, type string, properties map<string,string>", xfa.styles, xfa.styles_xml),
}


def _split(schema: str) -> list[tuple[str, str]]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(tuple(schema[at:i].strip().split(" ", 1)))
            at = i + 1
    return out


def rows_of(packets: DataFrame, kind: str) -> DataFrame:
    """``file_id, idx`` and the columns of the kind, in the order of the packet."""
    packet, schema, read, _ = KINDS[kind]
    names = [n for n, _ in _split(schema)]
    whole = [n for n, t in _split(schema) if t == "long"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for f, data in zip(b["file_id"], b["data"], strict=True):
                try:
                    found = read(bytes(data or b""))
                except ParseError:
                    continue
                rows += [(f, i, *(r.get(n) for n in names)) for i, r in enumerate(found)]
            yield pd.DataFrame(rows, columns=["file_id", "idx", *names]).astype({n: "Int64" for n in whole})

    return packets.filter(F.col("name") == packet).select("file_id", "data").mapInPandas(run, f"file_id string, idx long, {schema}")


def packets_of(rows: DataFrame, kind: str) -> DataFrame:
    """``file_id, name, data``: one packet of the rows of each file, the inverse of ``rows_of``. A packet is what one file holds."""
    packet, schema, _, made = KINDS[kind]
    names = [n for n, _ in _split(schema)]

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        plain = lambda v: v.tolist() if hasattr(v, "tolist") else v if isinstance(v, (list, dict, tuple)) or not pd.isna(v) else None
        records = [{k: plain(v) for k, v in r.items()} for r in group.sort_values("idx")[names].to_dict("records")]
        return pd.DataFrame({"file_id": [key[0]], "name": [packet], "data": [made(records).encode()]})

    return rows.select("file_id", "idx", *names).groupBy("file_id").applyInPandas(run, "file_id string, name string, data binary")


def rule_type(kind: Column, activity: Column) -> Column:
    """What a rule does, from where its script stands."""
    return (
        F.when((kind == "validate") | (activity == "validate"), "validate")
        .when(activity.isin("initialize", "enter"), "set_value")
        .when((kind == "calculate") | activity.isin("change", "exit"), "calculate")
        .otherwise("calculate")
    )


#: Names of elements that are structure and not data, in lower case.
STRUCTURE = ["datasets", "data", "field", "value", "group", "template", "subform", "form", "xdp", "config", "items"]


def is_structure(name: Column) -> Column:
    return F.lower(name).isin(STRUCTURE)


def form_type(fields: DataFrame, packets: DataFrame, files: DataFrame) -> DataFrame:
    """``file_id, form_type``: acroform with at least one field, else xfa with a template, else null."""
    a = fields.select("file_id").distinct().withColumn("a", F.lit("acroform"))
    x = packets.filter("name in ('template', 'xdp')").select("file_id").distinct().withColumn("x", F.lit("xfa"))
    return files.select("file_id").join(a, "file_id", "left").join(x, "file_id", "left").select("file_id", F.coalesce("a", "x").alias("form_type"))


def form_schema(fields: DataFrame, packets: DataFrame, files: DataFrame, kind_of: Callable[[Column, Column], Column]) -> DataFrame:
    """Questions of each file by its form type: ``file_id form_type name label type required max_length options value``."""
    types = form_type(fields, packets, files).filter("form_type is not null")
    flags = F.coalesce("ff", F.lit(0)).cast("long")
    a = fields.filter("terminal").select(
        "file_id", F.lit("acroform").alias("form_type"), F.col("full_name").alias("name"), F.coalesce("tu", "full_name").alias("label"), kind_of(F.col("ft"), flags).alias("type"),
        (flags.bitwiseAND(2) != 0).alias("required"), F.col("max_len").alias("max_length"), "opt", "value",
    )
    values = rows_of(packets, "values").groupBy("file_id", "name").agg(F.min_by("value", "idx").alias("given"))
    q = rows_of(packets, "questions").join(values, ["file_id", "name"], "left")
    x = q.select(
        "file_id", F.lit("xfa").alias("form_type"), "name", "label", "type", "required", "max_length", F.col("options").alias("opt"), F.coalesce("given", "default").alias("value"),
    )
    return a.unionByName(x).withColumnRenamed("opt", "options").join(types, ["file_id", "form_type"])

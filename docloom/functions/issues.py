"""Errors and warnings as data: classes of codes, and filters over a table of warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Codes by class.
CLASSES = {"not_found": ["no_object", "no_objects", "no_page", "no_field"], "encryption": ["wrong_password", "bad_encryption", "encrypted"], "validation": ["required", "min_length", "max_length", "pattern", "not_a_number", "minimum", "maximum", "option"], "syntax": ["syntax", "xref", "too_short", "no_header", "repair", "object", "content"]}


def is_class(code: Column, name: str) -> Column:
    return code.isin(CLASSES[name])


def error_class(code: Column) -> Column:
    out = F.lit("other")
    for name, codes in CLASSES.items():
        out = F.when(code.isin(codes), name).otherwise(out)
    return out


def by_level(warnings: DataFrame, level: str) -> DataFrame:
    return warnings.filter(F.col("level") == level)


def by_code(warnings: DataFrame, code: str) -> DataFrame:
    return warnings.filter(F.col("code") == code)


SCHEMA = "code string, level string, message string, context map<string,string>"


def collector(spark: SparkSession) -> DataFrame:
    """No warnings yet."""
    return spark.createDataFrame([], SCHEMA)


def add(warnings: DataFrame, code: str, level: str, message: str, **context: str) -> DataFrame:
    """The warnings and one more; ``message`` may hold places in braces that the context fills."""
    row = [(code, level, message.format(**context), {k: str(v) for k, v in context.items()})]
    return warnings.unionByName(warnings.sparkSession.createDataFrame(row, SCHEMA))


def clear(warnings: DataFrame) -> DataFrame:
    return warnings.limit(0)


def has_level(warnings: DataFrame, level: str) -> bool:
    return not by_level(warnings, level).isEmpty()


def with_context(context: Column, key: str, value: Column) -> Column:
    """The context of an error or a warning with one more entry; a key that is there already is replaced."""
    kept = F.map_filter(F.coalesce(context, F.create_map().cast("map<string,string>")), lambda k, _: k != key)
    return F.map_concat(kept, F.create_map(F.lit(key), value.cast("string")))


def level_counts(warnings: DataFrame) -> DataFrame:
    return warnings.groupBy("code", "level").agg(F.count("*").alias("n"))

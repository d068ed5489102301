"""Types of a whole key space: a mergeable lattice as an aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import value_type

#: What a value's text is, as bits whose union is all that the merged type depends on. The digits 0 and 1 are both bool and int.
BITS = {"empty": 1, "bool": 2, "int": 4, "float": 8, "string": 16, "digit": 32}
_WITHIN = {"empty": BITS["empty"], "bool": BITS["bool"] | BITS["digit"], "int": BITS["int"] | BITS["digit"], "float": BITS["float"] | BITS["int"] | BITS["digit"]}


def kind_bits(value: Column) -> Column:
    kind = value_type(value)
    out = F.lit(BITS["string"])
    for name, bit in BITS.items():
        out = F.when(kind == name, F.lit(bit)).otherwise(out)
    return F.when(value.isin("0", "1"), F.lit(BITS["digit"])).otherwise(out)


def merged_type(bits: Column) -> Column:
    """The least type that holds all: empty below all, int below float, bool beside numbers, string above all."""
    out = F.lit("string")
    for name, bit in reversed(_WITHIN.items()):
        out = F.when(bits.bitwiseAND(F.lit(63 - (bit | BITS["empty"]))) == 0, name).otherwise(out)
    return out


def infer_schema(df: DataFrame, json_col: str) -> DataFrame:
    """``key type n n_null longest`` of all keys of JSON objects: order-free, merged map-side, so that a frequent key is cheap.

    A value counts by its text. JSON nulls and missing values are ``n_null`` and of no type; texts that are no object have no keys.
    """
    # Null values stay in the map, so that keys of nulls alone appear.
    pairs = df.select(F.explode(F.from_json(F.col(json_col), "map<string,string>")).alias("key", "value"))
    merged = pairs.groupBy("key").agg(
        F.coalesce(F.bit_or(F.when(F.col("value").isNotNull(), kind_bits(F.col("value")))), F.lit(0)).alias("bits"),
        F.count("value").alias("n"), F.count(F.when(F.col("value").isNull(), 1)).alias("n_null"), F.coalesce(F.max(F.length("value")), F.lit(0)).cast("long").alias("longest"),
    )
    return merged.select("key", merged_type(F.col("bits")).alias("type"), "n", "n_null", "longest")

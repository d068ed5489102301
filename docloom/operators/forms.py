"""Form validation: unknown fields, broken rules and missing values, as anti joins and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_failure(value: Column, *, required: bool | Column = False, min_length=None, max_length=None, pattern=None, minimum=None, maximum=None, options=None) -> Column:
    """The first rule that a value breaks, in the fixed order of the rules, or null."""
    text = value.cast("string")
    empty = value.isNull() | (text == "")
    number = F.expr("1") if minimum is None and maximum is None else text.try_cast("double")
    tests = [(F.lit(required) if isinstance(required, bool) else required) & empty, None]
    rules = [F.when(tests[0], "required")]
    filled = ~empty
    if min_length is not None:
        rules.append(F.when(filled & (F.octet_length(text) < min_length), "min_length"))
    if max_length is not None:
        rules.append(F.when(filled & (F.octet_length(text) > max_length), "max_length"))
    if pattern is not None:
        rules.append(F.when(filled & ~text.rlike(pattern), "pattern"))
    if minimum is not None or maximum is not None:
        rules.append(F.when(filled & number.isNull(), "not_a_number"))
    if minimum is not None:
        rules.append(F.when(number < minimum, "minimum"))
    if maximum is not None:
        rules.append(F.when(number > maximum, "maximum"))
    if options:
        rules.append(F.when(filled & ~text.isin(list(options)), "option"))
    return F.coalesce(*rules)


def required_empty(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull() | (F.col(column).cast("string") == ""))


def unknown_fields(data: DataFrame, schema: DataFrame, keys: list[str]) -> DataFrame:
    """Values whose field is not in the schema."""
    return data.join(schema.select(*keys).distinct(), keys, "left_anti")


def missing_fields(schema: DataFrame, data: DataFrame, keys: list[str]) -> DataFrame:
    """Fields of the schema that have no value."""
    return schema.join(data.select(*keys).distinct(), keys, "left_anti")


#: Operators of declared conditions, evaluated as an extension.
CONDITIONS = {
    "equals": lambda a, b: a == b, "notEquals": lambda a, b: a != b,
    "greaterThan": lambda a, b: a.try_cast("double") > b.try_cast("double"), "lessThan": lambda a, b: a.try_cast("double") < b.try_cast("double"),
    "greaterOrEqual": lambda a, b: a.try_cast("double") >= b.try_cast("double"), "lessOrEqual": lambda a, b: a.try_cast("double") <= b.try_cast("double"),
    "contains": lambda a, b: a.contains(b), "notContains": lambda a, b: ~a.contains(b), "startsWith": lambda a, b: a.startswith(b), "endsWith": lambda a, b: a.endswith(b),
    "isEmpty": lambda a, b: a.isNull() | (a == ""), "isNotEmpty": lambda a, b: a.isNotNull() & (a != ""), "matches": lambda a, b: F.regexp_like(a, b),
}


def condition(tree: dict) -> Column:
    """A condition tree of ``{op, field, value}`` leaves and ``{logic: AND | OR | NOT, of: [...]}`` nodes as a predicate."""
    if "logic" in tree:
        parts = [condition(t) for t in tree["of"]]
        if tree["logic"] == "NOT":
            return ~parts[0]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if tree["logic"] == "AND" else out | p
        return out
    return F.coalesce(CONDITIONS[tree["op"]](F.col(tree["field"]).cast("string"), F.lit(tree.get("value")).cast("string")), F.lit(False))


def field_kind(ft: Column, flags: Column) -> Column:
    """Response type of a field from its type and flags."""
    return (
        F.when(ft == "Tx", "text")
        .when((ft == "Btn") & (flags.bitwiseAND(0x10000) != 0), "button")
        .when((ft == "Btn") & (flags.bitwiseAND(0x8000) != 0), "radio")
        .when(ft == "Btn", "checkbox")
        .when(ft == "Ch", "select")
        .when(ft == "Sig", "signature")
        .otherwise("text")
    )


def field_failure(ft: Column, flags: Column, value: Column, max_len: Column, options: Column) -> Column:
    """The rule that a value of a field breaks, by the field's own type and flags, or null.

    Texts have a greatest length; choices and radio buttons take their options only; any value does for a
    check box; of a signature only its absence is wrong.
    """
    empty = value.isNull() | (value == "")
    kind = field_kind(ft, F.coalesce(flags, F.lit(0)).cast("long"))
    limited = kind.isin("radio", "select") & (F.size(F.coalesce(options, F.array().cast("array<string>"))) > 0)
    return (
        F.when((F.coalesce(flags, F.lit(0)).bitwiseAND(2) != 0) & empty, "required")
        .when((kind == "text") & ~empty & (F.octet_length(value) > max_len), "max_length")
        .when(limited & ~empty & ~F.array_contains(options, value), "option")
    )


def field_errors(fields: DataFrame, data: DataFrame) -> DataFrame:
    """``file_id, name, rule``: values ``file_id, name, value`` against the fields of each file; unknown names and missing values too."""
    own = fields.filter("terminal").select("file_id", F.col("full_name").alias("name"), "ft", "ff", "max_len", "opt", F.lit(True).alias("is_field"))
    both = own.join(data.select("file_id", "name", "value", F.lit(True).alias("is_given")), ["file_id", "name"], "full_outer")
    rule = F.when(F.col("is_field").isNull(), "unknown").otherwise(field_failure(F.col("ft"), F.col("ff"), F.col("value"), F.col("max_len"), F.col("opt")))
    return both.select("file_id", "name", rule.alias("rule")).filter("rule is not null")


def question_errors(questions: DataFrame, data: DataFrame) -> DataFrame:
    """``file_id, name, rule`` of values against questions with ``required min_length max_length pattern options`` columns."""
    both = questions.withColumn("is_asked", F.lit(True)).join(data.select("file_id", "name", "value"), ["file_id", "name"], "full_outer")
    value, filled = F.col("value"), F.col("value").isNotNull() & (F.col("value") != "")
    rule = (
        F.when(F.col("is_asked").isNull(), "unknown")
        .when(F.col("required") & ~filled, "required")
        .when(filled & (F.octet_length(value) < F.col("min_length")), "min_length")
        .when(filled & (F.octet_length(value) > F.col("max_length")), "max_length")
        .when(filled & (F.coalesce("pattern", F.lit("")) != "") & ~F.regexp_like(value, F.col("pattern")), "pattern")
        .when(filled & (F.size("options") > 0) & ~F.array_contains("options", value), "option")
    )
    return both.select("file_id", "name", rule.alias("rule")).filter("rule is not null")

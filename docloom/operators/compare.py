"""Comparison of whole documents, side by side, as one table of differences and a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.diff import CompareOptions, align_elements
from docloom.sources import documents

COLUMNS = ["pair_id", "kind", "page", "category", "location", "old_value", "new_value"]


def _keyed(a: DataFrame, b: DataFrame, kind: str, keys: list[str], value: Column, page: bool = True) -> DataFrame:
    """Differences of rows that share keys; the n-th row of equal keys meets the n-th."""
    on = ["pair_id", *(["page"] if page else []), *keys, "_n"]

    def side(df: DataFrame, name: str) -> DataFrame:
        from pyspark.sql import Window

        order = Window.partitionBy(*on[:-1]).orderBy(*[c for c in ("idx", "obj_num") if c in df.columns] or keys)
        return df.withColumn("_n", F.row_number().over(order)).select(*on, value.alias(name), F.lit(True).alias(f"_{name}"))

    x, y = side(a, "old_value"), side(b, "new_value")
    j = x.join(y, on, "full_outer")
    category = F.when(F.col("_old_value").isNull(), "added").when(F.col("_new_value").isNull(), "removed").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "modified")
    out = j.withColumn("category", category).filter(F.col("category").isNotNull())
    return out.select("pair_id", F.lit(kind).alias("kind"), (F.col("page") if page else F.lit(None).cast("long")).alias("page"), "category", F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("location"), "old_value", "new_value")


def compare(left: DataFrame, right: DataFrame, options: CompareOptions = CompareOptions()) -> DataFrame:
    """Differences of pairs of files ``pair_id, file_id, content``: metadata, pages, text, graphics, images, annotations, outline, fields.

    Each file is read once. Kinds and metadata fields that the options ignore are left out.
    """
    read = ["metadata", "pages", "text_elements", "graphics", "annotations", "bookmarks", "fields", "image_refs", "images"]
    once = {id(f): documents.parsed(f, read, keep=("pair_id",)) for f in (left, right)}

    def of(files: DataFrame, name: str) -> DataFrame:
        return documents.table(once[id(files)], name, keep=("pair_id",))

    both = lambda name: (of(left, name), of(right, name))
    key = lambda c: F.transform(F.col(c), lambda v: F.floor(v * 10 + 0.5).cast("long")).cast("string")
    names = ["title", "author", "subject", "keywords", "creator", "producer", "creation_date", "modified_date", "version"]
    names = [n for n in names if n not in options.ignore_metadata]
    flat = lambda df: df.select("pair_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(F.col, names)))).alias("field", "v"))
    m = [flat(t) for t in both("metadata")]
    parts = [
        _keyed(*m, "metadata", ["field"], F.col("v"), page=False),
        _keyed(*both("pages"), "page", [], F.concat_ws("x", "width", "height", "rotation")),
        _keyed(*[t.withColumn("box", key("bbox")) for t in both("graphics")], "graphic", ["type", "box"], F.col("paint")),
        _keyed(*[t.withColumn("box", key("rect")) for t in both("annotations")], "annotation", ["subtype", "box"], F.coalesce("contents", F.lit(""))),
        _keyed(*both("bookmarks"), "bookmark", ["depth", "ordinal", "title"], F.col("page").cast("string"), page=False),
        _keyed(*both("fields"), "field", ["full_name"], F.coalesce("value", F.lit("")), page=False),
        images(*both("image_refs"), *both("images")),
    ]
    text = align_elements(*both("text_elements"), ["pair_id", "page"], options)
    old, new = both("text_elements")
    text = (
        text.join(old.select("pair_id", "page", F.col("idx").alias("left_idx"), F.col("text").alias("old_value")), ["pair_id", "page", "left_idx"], "left")
        .join(new.select("pair_id", "page", F.col("idx").alias("right_idx"), F.col("text").alias("new_value")), ["pair_id", "page", "right_idx"], "left")
        .select("pair_id", F.lit("text").alias("kind"), "page", F.col("kind").alias("category"), F.concat_ws("|", F.col("left_idx").cast("string"), F.col("right_idx").cast("string")).alias("location"), "old_value", "new_value")
    )
    out = text.select(*COLUMNS)
    for p in parts:
        out = out.unionByName(p.select(*COLUMNS))
    return out.filter(~F.col("kind").isin(*options.ignore_kinds)) if options.ignore_kinds else out


def images(a_refs: DataFrame, b_refs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Placed images by their bytes: the same bytes at another place are moved."""
    side = lambda r, i: r.join(i.select("pair_id", "image_id", F.sha2("data", 256).alias("digest")), ["pair_id", "image_id"], "left").select("pair_id", "page", F.coalesce("digest", "image_id").alias("digest"), F.floor(F.col("x") + 0.5).alias("x"), F.floor(F.col("y") + 0.5).alias("y"))
    x, y = side(a_refs, a), side(b_refs, b)
    place = ["pair_id", "page", "digest", "x", "y"]
    gone, new = x.join(y, place, "left_anti"), y.join(x, place, "left_anti")
    at = lambda df, n: df.groupBy("pair_id", "page", "digest").agg(F.min(F.concat_ws(",", F.col("x").cast("string"), F.col("y").cast("string"))).alias(n))
    j = at(gone, "old_value").join(at(new, "new_value"), ["pair_id", "page", "digest"], "full_outer")
    category = F.when(F.col("old_value").isNull(), "added").when(F.col("new_value").isNull(), "removed").otherwise("moved")
    return j.select("pair_id", F.lit("image").alias("kind"), "page", category.alias("category"), F.col("digest").alias("location"), "old_value", "new_value")


def summary(differences: DataFrame) -> DataFrame:
    return differences.groupBy("pair_id", "kind", "category").agg(F.count("*").alias("n"))


def report(pairs: DataFrame, differences: DataFrame) -> DataFrame:
    """``pair_id, identical, report``: a fixed order of lines for each pair."""
    line = F.format_string("%s %s: %d", "kind", "category", "n")
    lines = summary(differences).groupBy("pair_id").agg(F.sort_array(F.collect_list(line)).alias("lines"), F.sum("n").alias("total"))
    total = F.coalesce("total", F.lit(0))
    body = F.array_join(F.concat(F.array(F.format_string("differences: %d", total.cast("long"))), F.coalesce("lines", F.array().cast("array<string>"))), "\n")
    return pairs.select("pair_id").distinct().join(lines, "pair_id", "left").select("pair_id", (total == 0).alias("identical"), body.alias("report"))


def report_json(pairs: DataFrame, differences: DataFrame) -> DataFrame:
    """``pair_id, json``: whether the files of a pair are the same, how many differences there are, and all of them in a fixed order."""
    rows = F.sort_array(F.collect_list(F.struct(*[c for c in COLUMNS if c != "pair_id"])))
    found = differences.groupBy("pair_id").agg(rows.alias("differences"))
    j = pairs.select("pair_id").distinct().join(found, "pair_id", "left")
    n = F.coalesce(F.size("differences"), F.lit(0))
    body = F.struct((n == 0).alias("identical"), n.alias("total"), F.coalesce("differences", F.array().cast(dict(found.dtypes)["differences"])).alias("differences"))
    return j.select("pair_id", F.to_json(body, {"pretty": "true"}).alias("json"))

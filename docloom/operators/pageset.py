"""Page sets: numbering, splitting, extracting, deleting, inserting, rotating, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.ranking import ordered_rank


def number_pages(df: DataFrame, doc: list[str], order: list[str], name: str = "page_number") -> DataFrame:
    return ordered_rank(df, doc, order, name)


def split_by_count(df: DataFrame, size: int, page: str = "page_number", name: str = "part") -> DataFrame:
    return df.withColumn(name, F.ceil(F.col(page) / size).cast("long"))


def split_ranges(df: DataFrame, ranges: list[tuple[int, int]], page: str = "page_number", name: str = "part") -> DataFrame:
    """A row for each inclusive range that holds the page; ranges may overlap."""
    if any(a < 1 or b < a for a, b in ranges):
        raise ValueError("ranges are 1-based and inclusive")
    held = F.array(*[F.when(F.col(page).between(a, b), F.lit(i + 1).cast("long")) for i, (a, b) in enumerate(ranges)])
    return df.withColumn(name, F.explode(F.filter(held, lambda x: x.isNotNull())))


def extract_pages(df: DataFrame, wanted: list[int], page: str = "page_number", name: str = "new_number") -> DataFrame:
    """Pages in the asked order, as often as asked for."""
    places = F.array(*[F.when(F.col(page) == p, F.lit(i + 1).cast("long")) for i, p in enumerate(wanted)])
    return df.withColumn(name, F.explode(F.filter(places, lambda x: x.isNotNull())))


def delete_pages(df: DataFrame, gone: list[int], page: str = "page_number", name: str = "new_number") -> DataFrame:
    """The other pages, numbered anew: each moves up by the deleted pages before it."""
    out = sorted(set(gone))
    before = sum(((F.col(page) > p).cast("long") for p in out), F.lit(0).cast("long"))
    return df.filter(~F.col(page).isin(out)).withColumn(name, F.col(page) - before)


def insert_page(df: DataFrame, at: int, row: DataFrame, page: str = "page_number", name: str = "new_number") -> DataFrame:
    """``row`` (one per document, without a number) becomes page ``at``; later pages move down."""
    moved = df.withColumn(name, F.col(page) + (F.col(page) >= at).cast("long"))
    return moved.unionByName(row.withColumn(page, F.lit(None).cast("long")).withColumn(name, F.lit(at).cast("long")), allowMissingColumns=True)


def rotate(current: Column, angle: int) -> Column:
    if angle % 90:
        raise ValueError("angles are multiples of 90")
    return F.pmod(current + angle, F.lit(360))


def merge_renumber(parts: list[DataFrame], number: str, name: str = "new_number") -> DataFrame:
    """Rows of several files with numbers that don't clash: each file starts after the last number of those before."""
    out, offset = None, F.lit(0).cast("long")
    tops = [p.agg(F.coalesce(F.max(number).cast("long"), F.lit(0).cast("long")).alias("top")) for p in parts]
    for i, p in enumerate(parts):
        part = p.withColumn("file_no", F.lit(i + 1).cast("long"))
        for k in range(i):
            part = part.join(F.broadcast(tops[k].withColumnRenamed("top", f"_t{k}")))  # one row: a maximum
        total = sum((F.col(f"_t{k}") for k in range(i)), offset)
        part = part.withColumn(name, F.col(number).cast("long") + total).drop(*[f"_t{k}" for k in range(i)])
        out = part if out is None else out.unionByName(part)
    return out

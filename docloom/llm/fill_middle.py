"""Fill-in-middle transformation, by DuckDB SQL over Arrow batches.

Each batch is registered with an in-memory DuckDB of the task, which cuts texts into tokens, moves the
middle to the end, and rebuilds the text from what it has made; rows come back as Arrow. A token is a
run of other signs with the white space before it, or white space at the end of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.bpe_codec import slices

TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Memory of the DuckDB of a task, which holds one slice of a batch at a time.
MEMORY = "512MB"

#: ``batch(doc_id, text)`` to all columns; {seed}, {fim} and {spm} are numbers.
TRANSFORM = rf"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{{seed}}:' || coalesce(doc_id::VARCHAR, '')) AS h, coalesce(regexp_extract_all(text, '{TOKEN}'), []) AS tokens
  FROM batch
), hashed AS (
  SELECT doc_id, text, tokens, len(tokens)::BIGINT AS n,
    list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS hs,
    text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') AS unfit
  FROM drawn
), cut AS (
  SELECT doc_id, text, tokens, n,
    CASE WHEN unfit OR hs[3] % 100 >= {{fim}} THEN 'plain' WHEN hs[4] % 100 < {{spm}} THEN 'spm' ELSE 'psm' END AS form,
    least(hs[1] % (n + 1), hs[2] % (n + 1)) AS a, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) AS b
  FROM hashed
), parts AS (
  SELECT doc_id, text, n, form,
    CASE WHEN form <> 'plain' THEN array_to_string(list_slice(tokens, 1, a), '') END AS prefix,
    CASE WHEN form <> 'plain' THEN array_to_string(list_slice(tokens, a + 1, b), '') END AS middle,
    CASE WHEN form <> 'plain' THEN array_to_string(list_slice(tokens, b + 1, n), '') END AS suffix
  FROM cut
), made AS (
  SELECT doc_id, n, form, length(prefix)::BIGINT AS prefix_chars, length(middle)::BIGINT AS middle_chars,
    CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
      WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END AS output
  FROM parts
)
SELECT doc_id, n, form, prefix_chars, middle_chars, output FROM made
"""
#: ``made(form, output, ...)`` to the text that it was made from: marks stand once each, as the text held none.
RESTORE = r"""
WITH marked AS (
  SELECT *, CASE WHEN form <> 'plain' THEN strpos(output, '<P>') END AS p, CASE WHEN form <> 'plain' THEN strpos(output, '<S>') END AS s, CASE WHEN form <> 'plain' THEN strpos(output, '<M>') END AS m
  FROM made
)
SELECT * EXCLUDE (p, s, m), CASE form
  WHEN 'psm' THEN substr(output, p + 3, s - p - 3) || substr(output, m + 3) || substr(output, s + 3, m - s - 3)
  WHEN 'spm' THEN substr(output, p + 3, m - p - 3) || substr(output, m + 3) || substr(output, s + 3, p - s - 3)
  ELSE output END AS restored
FROM marked
"""


def _duckdb():
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})


def _each_slice(batches: Iterator[pa.RecordBatch], name: str, text: str, *queries: str) -> Iterator[pa.RecordBatch]:
    """Each slice through the queries in turn: the first reads ``name``, the next the result of the last as ``made``."""
    con = _duckdb()
    try:
        for b in batches:
            for s in slices(b, text):
                table = pa.Table.from_batches([s])
                for i, q in enumerate(queries):
                    view = "made" if i else name
                    con.register(view, table)
                    table = con.sql(q).to_arrow_table()
                    con.unregister(view)
                yield from table.to_batches()
    finally:
        con.close()


def fill_in_middle(docs: DataFrame, seed: int = 42, fim: int = 50, spm: int = 80) -> DataFrame:
    """``doc_id n form prefix_chars middle_chars output`` of each row.

    ``fim`` percent of the texts have their middle moved to the end, of these ``spm`` percent with the suffix first.
    Which, and where they are cut, is decided by a hash of ``seed`` and id, so that it is the same in every run.
    Empty and null texts and those that hold a mark stay plain, with null lengths. A null id hashes as no digits.
    Rows that repeat an id are cut by the same draw, each in its own text. Other columns are left out.
    """
    query = TRANSFORM.format(seed=int(seed), fim=int(fim), spm=int(spm))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        lambda batches: _each_slice(batches, "batch", "text", query), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def restore(made: DataFrame) -> DataFrame:
    """``doc_id text``: the exact text of every row of ``doc_id form output``. Null outputs stay null."""
    query = RESTORE.replace("FROM made", "FROM batch")
    return made.select("doc_id", "form", "output").mapInArrow(
        lambda batches: _each_slice(batches, "batch", "output", f"SELECT doc_id, restored AS text FROM ({query})"), "doc_id long, text string"
    )


def fill_digests(docs: DataFrame, seed: int = 42, fim: int = 50, spm: int = 80) -> DataFrame:
    """``fill_in_middle`` with digests of output and rebuilt text in place of the texts, made in the same task."""
    query = TRANSFORM.format(seed=int(seed), fim=int(fim), spm=int(spm))
    last = f"SELECT doc_id, n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256(restored) AS restored_sha256 FROM ({RESTORE})"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        lambda batches: _each_slice(batches, "batch", "text", query, last),
        "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string",
    )


def op12_fill_middle(spark, sf_dir: str) -> DataFrame:
    return fill_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# Cut places come from the lengths of leading tokens here, and pieces from the text by those places.
OP12_SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, '42:' || coalesce(doc_id::VARCHAR, '') AS seed FROM documents
), drawn AS (
  SELECT doc_id, text, ('0x' || sha256(seed)[1:8])::UBIGINT AS h1, ('0x' || sha256(seed)[9:16])::UBIGINT AS h2,
    ('0x' || sha256(seed)[17:24])::UBIGINT AS h3, ('0x' || sha256(seed)[25:32])::UBIGINT AS h4,
    list_transform(regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+'), lambda t: length(t)) AS sizes
  FROM base
), placed AS (
  SELECT *, len(sizes) AS n, coalesce(list_sum(sizes[1:least(h1 % (len(sizes) + 1), h2 % (len(sizes) + 1))]), 0)::BIGINT AS a,
    coalesce(list_sum(sizes[1:greatest(h1 % (len(sizes) + 1), h2 % (len(sizes) + 1))]), 0)::BIGINT AS b,
    CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), made AS (
  SELECT doc_id, n, form, text, a, b, CASE form
    WHEN 'psm' THEN concat('<P>', left(text, a), '<S>', substr(text, b + 1), '<M>', substr(text, a + 1, b - a))
    WHEN 'spm' THEN concat('<S>', substr(text, b + 1), '<P>', left(text, a), '<M>', substr(text, a + 1, b - a)) ELSE text END AS output
  FROM placed
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(output) AS output_sha256, sha256(text) AS restored_sha256
FROM made
"""

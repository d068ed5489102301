"""Queries over documents: each conversation is written as a document of one page a turn, and read back."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators import compare, diff, forms, packets, pageset
from docloom.pdf import writer
from docloom.plans.catalog import query, table
from docloom.scratch import stage
from docloom.sources import documents

_NUMBERED = "(SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page, text FROM conversations)"


def _conv() -> Column:
    """The conversation of a file. A function: columns can only be made while a session runs, and this module is imported before."""
    return F.col("file_id").cast("long").alias("conv_id")


def _files(spark, d) -> DataFrame:
    turns = table(spark, d, "conversations").withColumn("title", F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")))
    return documents.built(turns, "conv_id", "turn", "text", "title").select(F.col("conv_id").cast("string").alias("file_id"), "content")


def _again(files: DataFrame) -> DataFrame:
    return files.filter("error is null").select("file_id", "content")


@query("SELECT conv_id, count(*) AS pages FROM conversations GROUP BY conv_id")
def pdf_pages(spark, d):
    return documents.table(_files(spark, d), "pages").groupBy(_conv()).agg(F.count("*").alias("pages"))


@query(f"SELECT conv_id, page, unnest(range(len(l))) AS idx, unnest(l) AS text FROM (SELECT conv_id, page, string_split(text, chr(10)) AS l FROM {_NUMBERED})")
def pdf_text_elements(spark, d):
    return documents.table(_files(spark, d), "text_elements").select(_conv(), "page", "idx", "text")


@query("SELECT conv_id, 'Conversation ' || conv_id AS title, count(*) AS page_count, false AS encrypted FROM conversations GROUP BY conv_id")
def pdf_metadata(spark, d):
    return documents.table(_files(spark, d), "metadata").select(_conv(), "title", "page_count", "encrypted")


@query("""SELECT conv_id, count(*) AS pages, sum(octet_length(encode(replace(text, chr(10), ''))))::BIGINT AS text_bytes, true AS has_text, false AS scanned FROM conversations GROUP BY conv_id""")
def pdf_summary(spark, d):
    return documents.document_summary(_files(spark, d)).select(_conv(), "pages", "text_bytes", "has_text", "scanned")


@query("SELECT conv_id, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) + 1) // 2)::BIGINT AS part, text FROM conversations")
def pdf_split(spark, d):
    parts = documents.transform(_files(spark, d), lambda x: writer.split_every(x, 2))
    files = parts.select(F.concat_ws("-", "file_id", F.col("part").cast("string")).alias("file_id"), "content")
    lines = documents.table(files, "text_elements").groupBy("file_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "\n").alias("text"))
    piece = F.split("file_id", "-")
    return lines.select(piece[0].cast("long").alias("conv_id"), piece[1].cast("long").alias("part"), "text")


@query("SELECT conv_id // 10 AS volume, count(*) AS pages FROM conversations GROUP BY 1")
def pdf_merge(spark, d):
    files = _files(spark, d).withColumn("volume", F.floor(F.col("file_id").cast("long") / 10)).withColumn("at", F.col("file_id").cast("long"))
    merged = documents.merged(files, "volume", "at").select(F.col("volume").cast("string").alias("file_id"), "content")
    return documents.table(merged, "pages").groupBy(F.col("file_id").cast("long").alias("volume")).agg(F.count("*").alias("pages"))


@query(f"SELECT conv_id, page, CASE WHEN page = 1 THEN 270 ELSE 0 END::BIGINT AS rotation FROM {_NUMBERED}")
def pdf_rotate(spark, d):
    turned = _again(documents.transform(_files(spark, d), lambda x: writer.rotate_pages(writer.rotate_pages(x, 180, [1]), 90, [1])))
    return documents.table(turned, "pages").select(_conv(), "page", "rotation")


def _pages(files: DataFrame, password: str = "") -> DataFrame:
    """Whole pages of text, line by line."""
    lines = documents.table(files, "text_elements", password)
    return lines.groupBy("file_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "\n").alias("text"))


@query(f"SELECT conv_id, page - 1 AS page, text FROM {_NUMBERED} WHERE page > 1")
def pdf_delete(spark, d):
    def rest(x: bytes) -> list[bytes]:
        n = len(writer.Document(x).pages())
        return [writer.delete_pages(x, [1])] if n > 1 else []

    left = _again(documents.transform(_files(spark, d), rest))
    return _pages(left).select(_conv(), "page", "text")


@query(f"""SELECT conv_id, CASE WHEN page >= 2 THEN page + 1 ELSE page END AS page, text FROM {_NUMBERED}
UNION ALL SELECT DISTINCT conv_id, 2, 'inserted ' || 1 FROM conversations""")
def pdf_insert(spark, d):
    other = writer.build([writer.Page().text("inserted 1", 72, 700)])
    return _pages(_again(documents.transform(_files(spark, d), lambda x: writer.insert_pages(x, 2, other)))).select(_conv(), "page", "text")


_FIRST = "(SELECT conv_id, arg_min(role, turn) AS role, count(*) AS n FROM conversations GROUP BY conv_id)"


def _filled(spark, d) -> DataFrame:
    blank = lambda _: writer.build([writer.Page()], fields=[{"name": "role", "rect": [0, 0, 90, 12], "value": "?"}, {"name": "turns", "rect": [0, 20, 90, 32]}])
    files = _again(documents.transform(_files(spark, d), blank))
    c = table(spark, d, "conversations").groupBy(F.col("conv_id").cast("string").alias("file_id")).agg(F.min_by("role", "turn").alias("role"), F.count("*").cast("string").alias("turns"))
    values = c.select("file_id", F.explode(F.map_from_arrays(F.array(F.lit("role"), F.lit("turns"), F.lit("unknown")), F.array("role", "turns", "role"))).alias("name", "value"))
    return documents.filled(files, values)


@query(f"SELECT conv_id, 'role' AS name, role AS value, 'unknown' AS unknown FROM {_FIRST} UNION ALL SELECT conv_id, 'turns', n::VARCHAR, 'unknown' FROM {_FIRST}")
def pdf_fill(spark, d):
    files = _filled(spark, d)
    unknown = files.select("file_id", F.array_join("unknown", ",").alias("unknown"))
    return documents.table(files, "fields").join(unknown, "file_id").select(_conv(), F.col("full_name").alias("name"), "value", "unknown")


@query("SELECT DISTINCT conv_id, r AS rev FROM conversations, (VALUES (1::BIGINT), (2)) v(r)")
def pdf_revisions(spark, d):
    return documents.table(_filled(spark, d), "revisions").select(_conv(), "rev")


@query("SELECT DISTINCT conv_id, 2::BIGINT AS rewritten FROM conversations")
def pdf_latest_objects(spark, d):
    """Objects of each file whose newest version stands in the second revision, besides the form itself."""
    newest = documents.latest_objects(documents.table(_filled(spark, d), "raw_objects"))
    fields = newest.filter("rev = 2").filter(F.decode("raw", "ISO-8859-1").contains("/Widget"))
    return fields.groupBy(_conv()).agg(F.count("*").alias("rewritten"))


def _locked(spark, d, method: str) -> DataFrame:
    locked = stage(_again(documents.transform(_files(spark, d), lambda x: writer.encrypt(x, b"open", b"own", method))), "locked")
    state = documents.table(locked, "metadata", "own").select("file_id", "encrypted")
    return _pages(locked, "open").join(state, "file_id").select(_conv(), "page", "text", "encrypted")


_LOCKED = f"SELECT conv_id, page, text, true AS encrypted FROM {_NUMBERED}"


@query(_LOCKED)
def pdf_encrypt(spark, d):
    return _locked(spark, d, "V2")


@query(_LOCKED)
def pdf_encrypt_aes128(spark, d):
    return _locked(spark, d, "AESV2")


@query("SELECT n_nationkey, n_name AS text, true AS encrypted FROM nation")
def pdf_encrypt_aes256(spark, d):
    files = documents.built(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey", "n_nationkey", "n_name")
    locked = _again(documents.transform(files.select(F.col("n_nationkey").cast("string").alias("file_id"), "content"), lambda x: writer.encrypt(x, b"open", b"own", "AESV3")))
    read = documents.parsed(locked, ["metadata", "text_elements"], "open")
    state = documents.table(read, "metadata").select("file_id", "encrypted")
    return documents.table(read, "text_elements").join(state, "file_id").select(F.col("file_id").cast("int").alias("n_nationkey"), "text", "encrypted")


@query("SELECT conv_id, 0::BIGINT AS lines, 'wrong_password' AS code FROM conversations GROUP BY conv_id")
def pdf_wrong_password(spark, d):
    locked = _again(documents.transform(_files(spark, d), lambda x: writer.encrypt(x, b"open", b"own", "AESV2")))
    read = documents.parsed(locked, ["text_elements", "warnings"], "guess")
    lines = documents.table(read, "text_elements").groupBy("file_id").agg(F.count("*").alias("n"))
    said = documents.table(read, "warnings").join(lines, "file_id", "left")
    return said.select(_conv(), F.coalesce("n", F.lit(0)).cast("long").alias("lines"), "code")


@query(f"SELECT conv_id, page, text, 'stream' AS kind FROM {_NUMBERED}")
def pdf_object_streams(spark, d):
    """Objects packed into streams, and cross references in a stream."""
    def packed(x: bytes) -> bytes:
        doc = writer.Document(x)
        return writer.write({n: doc.obj(n) for n in doc.entries if doc.obj(n) is not None}, {k: doc.trailer[k] for k in ("Root", "Info") if k in doc.trailer}, xref_stream=True, pack=True)

    files = documents.parsed(_again(documents.transform(_files(spark, d), packed)), ["text_elements", "xref_entries"])
    kinds = documents.table(files, "xref_entries").groupBy("file_id").agg(F.min("kind").alias("kind"))
    return _pages(files).join(kinds, "file_id").select(_conv(), "page", "text", "kind")


@query("SELECT conv_id, unnest(range(1, least(n, 3) + 1)) AS obj_num FROM (SELECT conv_id, 3 + 2 * count(*) AS n FROM conversations GROUP BY 1)")
def pdf_sample_objects(spark, d):
    return documents.sample_objects(documents.table(_files(spark, d), "xref_entries"), 3).select(_conv(), "obj_num")


@query("""SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i))::BIGINT AS place, uri FROM
  (SELECT page_id, unnest(range(len(l))) AS i, unnest(l) AS uri FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages))""")
def pdf_links(spark, d):
    """The links of each web page as link annotations of a document, read back in order."""
    links = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("file_id"), F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)).alias("uris"))

    @F.pandas_udf("binary")
    def made(uris: pd.Series) -> pd.Series:
        return pd.Series([writer.build([writer.Page()], links=[{"uri": u, "rect": [0, 10 * i, 50, 10 * i + 9]} for i, u in enumerate(us)]) for us in uris])

    found = documents.table(links.select("file_id", made("uris").alias("content")), "annotations").filter("subtype = 'Link'")
    return found.select(F.col("file_id").cast("long").alias("page_id"), (F.col("rect")[1] / 10 + 1).cast("long").alias("place"), "uri")


@query("""SELECT r_regionkey, n_name AS title, 1::BIGINT AS depth, (row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey))::BIGINT AS page FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT r_regionkey, r_name, 0, 1 FROM region""")
def pdf_bookmarks(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    each = n.groupBy("r_regionkey", "r_name").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("kids"))

    def run(batches):
        for b in batches:
            out = []
            for name, kids in zip(b["r_name"], b["kids"], strict=True):
                marks = [{"title": name, "page": 1, "children": [{"title": k["n_name"], "page": i} for i, k in enumerate(kids, 1)]}]
                out.append(writer.build([writer.Page() for _ in kids], bookmarks=marks))
            yield pd.DataFrame({"file_id": b["r_regionkey"].astype(str), "content": out})

    found = documents.table(each.mapInPandas(run, "file_id string, content binary"), "bookmarks")
    return found.select(F.col("file_id").cast("int").alias("r_regionkey"), "title", "depth", "page")


@query("""SELECT n_nationkey, 'Im1' IS NOT NULL AS placed, (n_nationkey % 5 + 1)::BIGINT AS width, (n_regionkey + 1)::BIGINT AS height, 8::BIGINT AS bits,
  repeat(printf('%02X%02X%02X', n_nationkey, n_regionkey, 7), ((n_nationkey % 5 + 1) * (n_regionkey + 1))::BIGINT) AS data FROM nation""")
def pdf_images(spark, d):
    """A picture for each nation, with row predictors, placed on a page and decoded again."""
    def png(w: int, h: int, rgb: bytes) -> bytes:
        chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
        rows = b"".join(b"\x01" + rgb + bytes(3 * (w - 1)) for _ in range(h))  # each pixel as its difference to the left one
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")

    def run(batches):
        for b in batches:
            made = [writer.build([writer.Page().image(png(int(n) % 5 + 1, int(r) + 1, bytes([int(n), int(r), 7])), 10, 20, 30, 40)]) for n, r in zip(b["n_nationkey"], b["n_regionkey"], strict=True)]
            yield pd.DataFrame({"file_id": b["n_nationkey"].astype(str), "content": made})

    files = documents.parsed(table(spark, d, "nation").select("n_nationkey", "n_regionkey").mapInPandas(run, "file_id string, content binary"), ["images", "image_refs"])
    placed = documents.table(files, "image_refs").filter("x = 10 and y = 20 and width = 30 and height = 40").select("file_id", "image_id").distinct().withColumn("placed", F.lit(True))
    seen = documents.table(files, "images").join(placed, ["file_id", "image_id"])
    return seen.select(F.col("file_id").cast("int").alias("n_nationkey"), "placed", "width", "height", "bits", F.hex("data").alias("data"))


@query(f"""SELECT conv_id, 'Conversation ' || conv_id AS title, count(*) AS pages, sum(len(string_split(text, chr(10))))::BIGINT AS lines,
  arg_min(string_split(text, chr(10))[1], page) AS first_line FROM {_NUMBERED} GROUP BY conv_id""")
def pdf_json(spark, d):
    j = documents.content_json(_files(spark, d))
    got = F.from_json("json", "metadata struct<title:string>, pages array<struct<page:long>>, text_elements array<struct<text:string>>")
    return j.select(_conv(), got.alias("c")).select("conv_id", F.col("c.metadata.title").alias("title"), F.size("c.pages").cast("long").alias("pages"), F.size("c.text_elements").cast("long").alias("lines"), F.col("c.text_elements")[0]["text"].alias("first_line"))


@query("SELECT conv_id, 'page' AS kind, 'modified' AS category, 1::BIGINT AS n FROM conversations GROUP BY conv_id")
def pdf_compare(spark, d):
    files = stage(_files(spark, d), "files")
    turned = _again(documents.transform(files, lambda x: writer.rotate_pages(x, 90, [1])))
    pair = lambda f: f.withColumn("pair_id", F.col("file_id"))
    found = compare.summary(compare.compare(pair(files), pair(turned)))
    return found.select(F.col("pair_id").cast("long").alias("conv_id"), "kind", "category", "n")


@query("""SELECT conv_id, false AS identical, 1::BIGINT AS total, 'page' AS kind, 'modified' AS category, 1::BIGINT AS page,
  '612.0x792.0x0' AS old_value, '612.0x792.0x90' AS new_value FROM conversations GROUP BY conv_id""")
def pdf_compare_json(spark, d):
    files = stage(_files(spark, d), "files")
    turned = _again(documents.transform(files, lambda x: writer.rotate_pages(x, 90, [1])))
    pair = lambda f: f.withColumn("pair_id", F.col("file_id"))
    j = compare.report_json(pair(files), compare.compare(pair(files), pair(turned)))
    shape = "identical boolean, total long, differences array<struct<kind:string,page:long,category:string,location:string,old_value:string,new_value:string>>"
    return j.select(F.col("pair_id").cast("long").alias("conv_id"), F.from_json("json", shape).alias("r")).select("conv_id", "r.identical", "r.total", F.inline("r.differences")).drop("location")


# -- text at one place, by granularity


def _granular(spark, d, granularity: str) -> DataFrame:
    """Names of parts against themselves with other signs between the words (even keys) or another word (keys that 3 divides)."""
    signs = F.when(F.col("p_partkey") % 2 == 0, F.replace("p_name", F.lit(" "), F.lit(" - "))).otherwise(F.col("p_name"))
    other = F.when(F.col("p_partkey") % 3 == 0, F.concat(signs, F.lit(" extra"))).otherwise(signs)

    def side(text):
        place = [F.lit(72.0).alias("x"), F.lit(700.0).alias("y"), F.lit("Helvetica").alias("font_name"), F.lit(12.0).alias("font_size")]
        return table(spark, d, "part").select(F.col("p_partkey").alias("pair"), F.lit(0).cast("long").alias("idx"), text.alias("text"), *place)

    o = diff.CompareOptions(granularity=granularity)
    return diff.align_elements(side(F.col("p_name")), side(other), ["pair"], o).select("pair", "kind", "left_idx", "right_idx")


_CHANGED = "SELECT p_partkey AS pair, 'modified' AS kind, 0::BIGINT AS left_idx, 0::BIGINT AS right_idx FROM part WHERE {}"


@query(_CHANGED.format("p_partkey % 3 = 0"))
def diff_words(spark, d):
    return _granular(spark, d, "word")


@query(_CHANGED.format("p_partkey % 3 = 0 OR (p_partkey % 2 = 0 AND contains(p_name, ' '))"))
def diff_chars(spark, d):
    return _granular(spark, d, "char")


# -- forms


def _form_files(spark, d) -> DataFrame:
    """A form for each nation: a required text, a text of at most 12 bytes, a choice and a check box."""
    def run(batches):
        for b in batches:
            made = [
                writer.build([writer.Page()], fields=[
                    {"name": "name", "rect": [0, 0, 90, 12], "flags": 2}, {"name": "note", "rect": [0, 20, 90, 32], "max_len": 12},
                    {"name": "choice", "rect": [0, 40, 90, 52], "type": "Ch", "options": ["BUILDING", "MACHINERY", "FURNITURE"]}, {"name": "check", "rect": [0, 60, 90, 72], "type": "Btn"},
                ])
                for _ in b["n_nationkey"]
            ]
            yield pd.DataFrame({"file_id": b["n_nationkey"].astype(str), "content": made})

    return table(spark, d, "nation").select("n_nationkey").mapInPandas(run, "file_id string, content binary")


def _note():
    return F.concat_ws(" ", "c_mktsegment", F.col("c_nationkey").cast("string"))


def _form_values(spark, d) -> DataFrame:
    """The first customer of each nation as values; nations that 5 divides give no name, all give an unknown one."""
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.min_by(F.struct("c_name", "c_mktsegment", _note().alias("note")), "c_custkey").alias("c"))
    v = F.map_from_arrays(F.array(*map(F.lit, ("name", "note", "choice", "nope"))), F.array(F.when(F.col("c_nationkey") % 5 != 0, F.col("c.c_name")), F.col("c.note"), F.col("c.c_mktsegment"), F.lit("x")))
    return c.select(F.col("c_nationkey").cast("string").alias("file_id"), F.explode(v).alias("name", "value")).filter("value is not null")


_GIVEN = """(SELECT n_nationkey, n_nationkey % 5 <> 0 AND c_name IS NOT NULL AS named, c_name, c_mktsegment AS seg, note FROM nation LEFT JOIN
  (SELECT c_nationkey, arg_min(c_name, c_custkey) AS c_name, arg_min(c_mktsegment, c_custkey) AS c_mktsegment, arg_min(c_mktsegment || ' ' || c_nationkey, c_custkey) AS note FROM customer GROUP BY 1) ON c_nationkey = n_nationkey)"""
_FITS = "seg IN ('BUILDING', 'MACHINERY', 'FURNITURE')"


@query(f"""SELECT n_nationkey::VARCHAR AS file_id, 'name' AS name, 'required' AS rule FROM {_GIVEN} WHERE NOT named
UNION ALL SELECT n_nationkey::VARCHAR, 'note', 'max_length' FROM {_GIVEN} WHERE octet_length(encode(note)) > 12
UNION ALL SELECT n_nationkey::VARCHAR, 'choice', 'option' FROM {_GIVEN} WHERE seg IS NOT NULL AND NOT {_FITS}
UNION ALL SELECT n_nationkey::VARCHAR, 'nope', 'unknown' FROM {_GIVEN} WHERE seg IS NOT NULL""")
def form_errors(spark, d):
    return documents.filled_valid(_form_files(spark, d), _form_values(spark, d))[1]


@query(f"""SELECT n_nationkey::VARCHAR AS file_id, unnest(['name', 'note', 'choice', 'check']) AS name,
  unnest([CASE WHEN named THEN c_name END, CASE WHEN octet_length(encode(note)) <= 12 THEN note END, CASE WHEN {_FITS} THEN seg END, NULL]) AS value FROM {_GIVEN}""")
def form_fill_valid(spark, d):
    full = documents.filled_valid(_form_files(spark, d), _form_values(spark, d))[0]
    return documents.table(_again(full), "fields").select("file_id", F.col("full_name").alias("name"), "value")


@query("""SELECT n_nationkey::VARCHAR AS file_id, 'acroform' AS form_type, unnest(['name', 'note', 'choice', 'check']) AS name, unnest(['text', 'text', 'select', 'checkbox']) AS type,
  unnest([true, false, false, false]) AS required, unnest([NULL, 12, NULL, NULL])::BIGINT AS max_length, unnest([0, 0, 3, 0])::BIGINT AS n_options FROM nation
UNION ALL SELECT 'x' || c_nationkey, 'xfa', c_name, CASE WHEN c_custkey % 2 = 0 THEN 'select' ELSE 'text' END, c_custkey % 3 = 0, NULL, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 0 END FROM customer""")
def form_schema(spark, d):
    """Questions of documents with plain forms and of documents with packets, each by its own kind."""
    plain = documents.parsed(_form_files(spark, d), ["fields", "xfa"])
    packed = documents.parsed(_packet_files(spark, d), ["fields", "xfa"])
    both = plain.unionByName(packed.withColumn("file_id", F.concat(F.lit("x"), "file_id")))
    got = packets.form_schema(documents.table(both, "fields"), documents.table(both, "xfa"), both, forms.field_kind)
    return got.select("file_id", "form_type", "name", "type", "required", "max_length", F.size("options").cast("long").alias("n_options"))


# -- form packets


def _customers(spark, d) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select(F.col("c_nationkey").cast("string").alias("file_id"), F.col("c_custkey").cast("long").alias("idx"), "c_name", "c_custkey", "c_mktsegment", _note().alias("c_note"))


def _questions(c: DataFrame) -> DataFrame:
    even = F.col("c_custkey") % 2 == 0
    return c.select(
        "file_id", "idx", F.col("c_name").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("label"), F.when(even, "select").otherwise("text").alias("type"),
        (F.col("c_custkey") % 3 == 0).alias("required"), F.lit(False).alias("readonly"), F.lit(False).alias("hidden"), F.col("c_note").alias("default"),
        F.when(even, F.array("c_mktsegment", F.lit("other"))).otherwise(F.array().cast("array<string>")).alias("options"),
        F.lit(None).cast("long").alias("min_length"), F.lit(None).cast("long").alias("max_length"), F.lit("").alias("pattern"), F.lit("").alias("script"),
    )


def _values(c: DataFrame) -> DataFrame:
    return c.select("file_id", "idx", F.col("c_name").alias("name"), F.concat(F.lit("all."), "c_mktsegment", F.lit("."), "c_name").alias("path"), F.col("c_custkey").cast("string").alias("value"), F.lit("int").alias("kind"))


def _packet_files(spark, d) -> DataFrame:
    c = _customers(spark, d)
    return documents.built_from_packets(packets.packets_of(_questions(c), "questions").unionByName(packets.packets_of(_values(c), "values")))


@query("""SELECT c_nationkey::VARCHAR AS file_id, c_name AS name, c_mktsegment AS label, CASE WHEN c_custkey % 2 = 0 THEN 'select' ELSE 'text' END AS type, c_custkey % 3 = 0 AS required,
  c_mktsegment || ' ' || c_nationkey AS "default", CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || '|other' ELSE '' END AS options FROM customer""")
def xfa_questions(spark, d):
    got = packets.rows_of(documents.table(_packet_files(spark, d), "xfa"), "questions")
    return got.select("file_id", "name", "label", "type", "required", "default", F.array_join("options", "|").alias("options"))


@query("""SELECT c_nationkey::VARCHAR AS file_id, c_name AS name, 'all.' || c_mktsegment || '.' || c_name AS path, c_custkey::VARCHAR AS value, CASE WHEN c_custkey IN (0, 1) THEN 'bool' ELSE 'int' END AS kind FROM customer""")
def xfa_values(spark, d):
    return packets.rows_of(documents.table(_packet_files(spark, d), "xfa"), "values").drop("idx")


@query("""SELECT c_nationkey::VARCHAR AS file_id, c_name AS name, CASE WHEN c_custkey = first THEN 'new <&>' ELSE c_custkey::VARCHAR END AS value, 'nope' AS unknown
FROM (SELECT *, min(c_custkey) OVER (PARTITION BY c_nationkey) AS first FROM customer)""")
def xfa_update(spark, d):
    """A value of each document changed in its datasets packet, by an appended revision."""
    c = _customers(spark, d).groupBy("file_id").agg(F.min_by("c_name", "c_custkey").alias("name"))
    new = c.select("file_id", "name", F.lit("new <&>").alias("value")).unionByName(c.select("file_id", F.lit("nope").alias("name"), F.lit("x").alias("value")))
    files = documents.with_packet_values(_packet_files(spark, d), new)
    unknown = files.select("file_id", F.array_join("unknown", ",").alias("unknown"))
    return packets.rows_of(documents.table(files, "xfa"), "values").join(unknown, "file_id").select("file_id", "name", "value", "unknown")


@query("""SELECT c_nationkey::VARCHAR AS file_id, name, count(*) AS n FROM (SELECT DISTINCT c_nationkey FROM customer), (VALUES ('connectionSet'), ('datasets'), ('template')) t(name) GROUP BY ALL""")
def xfa_rebuild(spark, d):
    """Documents with one packet replaced and one added."""
    c = _customers(spark, d)
    one = c.groupBy("file_id").agg(F.min("idx").alias("idx"))
    line = one.select("file_id", "idx", F.lit("c").alias("name"), F.lit("http").alias("type"), F.lit("http://x.example").alias("uri"), F.create_map(F.lit("user"), F.lit("u")).alias("properties"))
    new = packets.packets_of(line, "connections").unionByName(packets.packets_of(_values(c), "values"))
    return documents.table(_again(documents.with_packets(_packet_files(spark, d), new)), "xfa").groupBy("file_id", "name").agg(F.count("*").alias("n"))


def _nations(spark, d) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("file_id"), F.col("n_nationkey").cast("long").alias("idx"), "n_name", "n_nationkey")


def _through(spark, rows: DataFrame, kind: str) -> DataFrame:
    """Rows written as packets, the packets into documents, and read back from there."""
    return packets.rows_of(documents.table(documents.built_from_packets(packets.packets_of(rows, kind)), "xfa"), kind).drop("idx")


@query("""SELECT n_regionkey::VARCHAR AS file_id, n_name AS code, 'Name of ' || n_name AS name, n_nationkey % 7 = 0 AND n_nationkey = max(CASE WHEN n_nationkey % 7 = 0 THEN n_nationkey END) OVER (PARTITION BY n_regionkey) AS is_default,
  n_nationkey::VARCHAR AS currency FROM nation""")
def xfa_locales(spark, d):
    n = _nations(spark, d)
    rows = n.select("file_id", "idx", F.col("n_name").alias("code"), F.concat(F.lit("Name of "), "n_name").alias("name"), (F.col("n_nationkey") % 7 == 0).alias("is_default"), F.create_map(F.lit("currency"), F.col("n_nationkey").cast("string")).alias("settings"))
    return _through(spark, rows, "locales").select("file_id", "code", "name", F.coalesce("is_default", F.lit(False)).alias("is_default"), F.col("settings")["currency"].alias("currency"))


@query("SELECT n_regionkey::VARCHAR AS file_id, n_name AS name, 'http' AS type, 'http://' || lower(n_name) || '/?a=1&b=2' AS uri, n_nationkey::VARCHAR AS timeout FROM nation")
def xfa_connections(spark, d):
    n = _nations(spark, d)
    rows = n.select("file_id", "idx", F.col("n_name").alias("name"), F.lit("http").alias("type"), F.concat(F.lit("http://"), F.lower("n_name"), F.lit("/?a=1&b=2")).alias("uri"), F.create_map(F.lit("timeout"), F.col("n_nationkey").cast("string")).alias("properties"))
    return _through(spark, rows, "connections").select("file_id", "name", "type", "uri", F.col("properties")["timeout"].alias("timeout"))


@query("SELECT n_regionkey::VARCHAR AS file_id, n_name AS name, 'text' AS type, n_nationkey::VARCHAR || 'pt' AS size FROM nation")
def xfa_styles(spark, d):
    n = _nations(spark, d)
    rows = n.select("file_id", "idx", F.col("n_name").alias("name"), F.lit("text").alias("type"), F.create_map(F.lit("font.size"), F.concat(F.col("n_nationkey").cast("string"), F.lit("pt"))).alias("properties"))
    return _through(spark, rows, "styles").select("file_id", "name", "type", F.col("properties")["font.size"].alias("size"))


@query("""SELECT n_regionkey::VARCHAR AS file_id, 'config/present[' || row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) || ']' AS path, 'renderPolicy' AS attribute, n_name AS value FROM nation""")
def xfa_config(spark, d):
    n = pageset.number_pages(_nations(spark, d), ["file_id"], ["idx"])
    rows = n.select("file_id", "idx", F.concat(F.lit("config/present["), F.col("page_number").cast("string"), F.lit("]")).alias("path"), F.lit("renderPolicy").alias("attribute"), F.col("n_name").alias("value"))
    return _through(spark, rows, "config")


@query("""SELECT n_regionkey::VARCHAR AS file_id, n_name AS field, CASE n_nationkey % 3 WHEN 0 THEN 'set_value' WHEN 1 THEN 'calculate' ELSE 'validate' END AS rule, 'x = ' || n_nationkey AS script FROM nation""")
def xfa_rules(spark, d):
    n = _nations(spark, d)
    k = F.col("n_nationkey") % 3
    rows = n.select("file_id", "idx", F.col("n_name").alias("field"), F.when(k == 2, "validate").otherwise("event").alias("kind"), F.when(k == 0, "initialize").when(k == 1, "exit").otherwise("").alias("activity"), F.concat(F.lit("x = "), F.col("n_nationkey").cast("string")).alias("script"))
    got = _through(spark, rows, "rules")
    return got.select("file_id", "field", packets.rule_type(F.col("kind"), F.col("activity")).alias("rule"), "script")

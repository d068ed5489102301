"""Scans of binary documents into tables, and sinks that write documents from rows.

A file is one row; kernels run file by file in Arrow batches and give typed rows, which later steps
treat relationally. A file that can't be read is a row with an error, never a failed job.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import forms
from docloom.pdf import content, writer
from docloom.pdf.document import Document
from docloom.pdf.syntax import DocError, Stream
from docloom.scratch import shuffle_width, stage

#: What a task holds as Python objects before it hands them on: rows, and bytes of the files they are from or hold.
ROWS_AT_ONCE = 2048
BYTES_AT_ONCE = 4 << 20

_POINT = "array<double>"
SCHEMAS = {
    "metadata": "file_id string, title string, author string, subject string, keywords string, creator string, producer string, creation_date string, modified_date string, version string, page_count long, encrypted boolean, custom map<string,string>",
    "pages": f"file_id string, page long, obj_num long, width double, height double, rotation long, boxes map<string,{_POINT}>",
    "text_elements": f"file_id string, page long, idx long, text string, x double, y double, width double, height double, font_name string, font_size double, char_spacing double, word_spacing double, rise double, text_matrix {_POINT}",
    "graphics": f"file_id string, page long, idx long, type string, paint string, ops array<struct<op:string,points:array<{_POINT}>>>, bbox {_POINT}, fill {_POINT}, stroke {_POINT}, line_width double",
    "image_refs": "file_id string, page long, idx long, image_id string, obj_num long, x double, y double, width double, height double",
    "images": "file_id string, image_id string, obj_num long, width long, height long, bits long, color_space string, format string, data binary",
    "fonts": "file_id string, font_id string, name string, family string, subtype string, embedded boolean, standard boolean, encoding string, has_to_unicode boolean",
    "annotations": f"file_id string, page long, obj_num long, subtype string, rect {_POINT}, contents string, uri string, color {_POINT}, quads {_POINT}",
    "bookmarks": "file_id string, node_id long, parent_id long, ordinal long, depth long, title string, page long, uri string",
    "fields": f"file_id string, obj_num long, parent_obj long, ft string, t string, full_name string, tu string, ff long, max_len long, opt array<string>, value string, default_value string, rect {_POINT}, terminal boolean",
    "xfa": "file_id string, name string, data binary, obj_num long",
    "appearances": f"file_id string, obj_num long, full_name string, state string, bbox {_POINT}, data binary",
    "revisions": "file_id string, rev long, start_offset long, eof_offset long, end_offset long, startxref long",
    "raw_objects": "file_id string, rev long, obj_num long, gen long, offset long, end_offset long, raw binary, is_stream boolean",
    "xref_entries": "file_id string, section_no long, kind string, obj_num long, in_use boolean, offset long, gen long, stream_obj long, stream_idx long",
    "warnings": "file_id string, code string, message string",
}


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """``file_id, content`` of the files below a path of any store that Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("file_id"), "content")


def _text(v) -> str | None:
    return None if v is None else content.text_of(v) if isinstance(v, bytes) else str(v)


def _fields(rows: list[dict]) -> list[dict]:
    return [
        {k: f.get(k) for k in ("obj_num", "parent_obj", "t", "full_name", "tu", "rect", "terminal")}
        | {"ft": _text(f.get("FT")), "ff": f.get("Ff"), "max_len": f.get("MaxLen"), "opt": [_text(o[-1] if isinstance(o, list) else o) for o in f.get("Opt") or []], "value": _text(f.get("V")), "default_value": _text(f.get("DV"))}
        for f in rows
    ]


def _structure(data: bytes, password: bytes) -> dict[str, list[dict]]:
    doc = Document(data, password)
    entries = []
    for i, s in enumerate(reversed(doc.sections)):
        for n, e in s["entries"].items():
            inside = e[0] == "in"
            entries.append({"section_no": i, "kind": s["kind"], "obj_num": n, "in_use": e[0] != "free", "offset": None if inside else e[1], "gen": None if inside else e[2], "stream_obj": e[1] if inside else None, "stream_idx": e[2] if inside else None})
    return {"revisions": doc.revisions(), "raw_objects": doc.raw_objects(), "xref_entries": entries}


def _shown(data: bytes, password: bytes) -> dict[str, list[dict]]:
    out = content.extract(data, password)
    out["metadata"] = [out["metadata"]]
    out["fields"] = _fields(out["fields"])
    return out


def _kernel(name: str) -> Callable[[bytes, bytes], dict[str, list[dict]]]:
    return _structure if name in ("revisions", "raw_objects", "xref_entries") else _shown


def _in_slices(takes: list[str], columns: list[str], each: Callable[..., list], numbers: list[str] | None = None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A function for ``mapInPandas`` that gives the rows of ``each`` row in slices, so that memory does not grow with a batch or what is read from it."""

    def frame(rows: list) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=columns)
        return out.astype({c: "Int64" for c in numbers}) if numbers else out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for b in batches:
            for values in zip(*(b[c] for c in takes), strict=True):
                got = each(*values)
                rows += got
                size += sum(len(v) for v in values if isinstance(v, (bytes, bytearray, str)))
                size += sum(len(v) for r in got if isinstance(r, tuple) for v in r if isinstance(v, (bytes, bytearray, str)))
                while len(rows) >= ROWS_AT_ONCE or rows and size >= BYTES_AT_ONCE:
                    yield frame(rows[:ROWS_AT_ONCE])
                    rows, size = rows[ROWS_AT_ONCE:], 0
        if rows:
            yield frame(rows)

    return run


def _columns(name: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in _split(SCHEMAS[name])]


def table(files: DataFrame, name: str, password: str = "", keep: tuple[str, ...] = ()) -> DataFrame:
    """One of the tables of SCHEMAS over ``file_id, content``, or over ``parsed`` files. Unreadable files show in ``warnings`` only.

    ``keep``: further columns that the parsed files carry.
    """
    schema, columns = SCHEMAS[name], _columns(name)
    if name in files.columns:
        return files.select("file_id", *keep, F.inline(name)).select(*keep, *columns)
    kernel = _kernel(name)
    numbers = [c.split(" ")[0] for c in map(str.strip, _split(schema)) if c.endswith(" long")]

    def each(fid, data) -> list[dict]:
        return [{"file_id": fid} | r for r in _read(kernel, data, password).get(name, [])]

    return files.select("file_id", "content").mapInPandas(_in_slices(["file_id", "content"], columns, each, numbers), schema)


def _read(kernel: Callable[[bytes, bytes], dict[str, list[dict]]], data, password: str) -> dict[str, list[dict]]:
    try:
        return kernel(bytes(data or b""), password.encode())
    except DocError as e:
        return {"warnings": [{"code": e.code, "message": str(e)}]}
    except Exception as e:  # a damaged file must not stop the scan of the others
        return {"warnings": [{"code": "unreadable", "message": f"{type(e).__name__}: {e}"}]}


def parsed(files: DataFrame, names: list[str], password: str = "", keep: tuple[str, ...] = ()) -> DataFrame:
    """``file_id`` and an array column for each of these tables: every file is read once, and ``table`` takes it from there.

    The result is staged, since several plans start from it. ``keep``: further columns of the files that come along.
    """
    fields = {n: [c.strip().split(" ", 1) for c in _split(SCHEMAS[n])][1:] for n in names}
    kinds = dict(files.dtypes)
    schema = "file_id string, " + ", ".join([*[f"{k} {kinds[k]}" for k in keep], *[f"{n} array<struct<{', '.join(f'{c}:{t}' for c, t in fs)}>>" for n, fs in fields.items()]])
    kernels = list(dict.fromkeys(map(_kernel, names)))

    def each(fid, data, *kept) -> list[tuple]:
        got = {k: v for kernel in kernels for k, v in _read(kernel, data, password).items()}
        return [(fid, *kept, *([{c: r.get(c) for c, _ in fs} for r in got.get(n, [])] for n, fs in fields.items()))]

    run = _in_slices(["file_id", "content", *keep], ["file_id", *keep, *fields], each)
    return stage(files.select("file_id", "content", *keep).mapInPandas(run, schema), "parsed")


def content_json(files: DataFrame, password: str = "") -> DataFrame:
    """``file_id, json``: all content of each file as indented JSON; bytes in base 64. Unreadable files have null."""

    def plain(v):
        return base64.b64encode(v).decode() if isinstance(v, (bytes, bytearray)) else str(v)

    def each(fid, data) -> list[tuple]:
        got = _read(content.extract, data, password)
        return [(fid, json.dumps(got, indent=2, default=plain, ensure_ascii=False) if "metadata" in got else None)]

    kind = dict(files.dtypes)["file_id"]
    return files.select("file_id", "content").mapInPandas(_in_slices(["file_id", "content"], ["file_id", "json"], each), f"file_id {kind}, json string")


def sample_objects(xref_entries: DataFrame, most: int) -> DataFrame:
    """The first object numbers in use of each file, at most ``most``."""
    used = xref_entries.filter("in_use").groupBy("file_id").agg(F.array_sort(F.collect_set("obj_num")).alias("n"))
    return used.select("file_id", F.explode(F.slice("n", 1, most)).alias("obj_num"))


def _split(schema: str) -> list[str]:
    """Top-level columns of a schema text."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[at:i])
            at = i + 1
    return [*out, schema[at:]]


def latest_objects(raw_objects: DataFrame) -> DataFrame:
    """The newest version of each object of each file."""
    return raw_objects.groupBy("file_id", "obj_num").agg(F.max_by(F.struct("rev", "gen", "offset", "end_offset", "raw", "is_stream"), F.struct("rev", "offset")).alias("o")).select("file_id", "obj_num", "o.*")


def document_summary(files: DataFrame) -> DataFrame:
    """Pages, bytes of text, images, and flags of each file; scanned: pages with images and no text."""
    files = parsed(files, ["pages", "text_elements", "images", "bookmarks", "fields"])
    size = lambda c: F.size(c).cast("long")
    text = F.aggregate("text_elements", F.lit(0).cast("long"), lambda n, t: n + F.coalesce(F.octet_length(t["text"]), F.lit(0)))
    n = {"pages": size("pages"), "text_bytes": text, "images": size("images"), "bookmarks": size("bookmarks"), "fields": size("fields")}
    return files.select("file_id", *[n[c].cast("long").alias(c) for c in n], (n["text_bytes"] > 0).alias("has_text"), (n["images"] > 0).alias("has_images"), (n["bookmarks"] > 0).alias("has_bookmarks"), (n["fields"] > 0).alias("has_forms"), ((n["images"] > 0) & (n["text_bytes"] == 0) & (n["pages"] > 0)).alias("scanned"))


def transform(files: DataFrame, f: Callable[[bytes], bytes | list[bytes]]) -> DataFrame:
    """``file_id, part, content, error`` after a kernel of ``docloom.pdf.writer`` over each file."""

    def each(fid, data) -> list[tuple]:
        try:
            got = f(bytes(data))
            return [(fid, i, x, None) for i, x in enumerate(got if isinstance(got, list) else [got], 1)]
        except DocError as e:
            return [(fid, 0, None, str(e))]
        except Exception as e:  # a damaged or null file must not stop the others
            return [(fid, 0, None, f"{type(e).__name__}: {e}")]

    run = _in_slices(["file_id", "content"], ["file_id", "part", "content", "error"], each)
    return files.select("file_id", "content").mapInPandas(run, "file_id string, part long, content binary, error string")


def merged(files: DataFrame, group: str, order: str) -> DataFrame:
    """One document of all files of a group, in order. A group is what one output file can hold."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({group: [key[0]], "content": [writer.merge([bytes(c) for c in rows.sort_values(order)["content"]])]})

    return files.groupBy(group).applyInPandas(run, f"{group} {dict(files.dtypes)[group]}, content binary")


def filled(files: DataFrame, data: DataFrame) -> DataFrame:
    """Files with an appended revision of form values ``file_id, name, value``, and the unknown names."""
    return _with_entries(files, data.select("file_id", "name", "value"), writer.fill_form)


def filled_valid(files: DataFrame, data: DataFrame, password: str = "") -> tuple[DataFrame, DataFrame]:
    """Files filled with those values ``file_id, name, value`` that keep the rules of their fields; and what was found wrong.

    The second table is ``file_id, name, rule``: broken rules, required fields without a value, and unknown names.
    """
    fields = table(files, "fields", password)
    wrong = stage(forms.field_errors(fields, data), "form-errors")
    good = data.join(wrong.select("file_id", "name").distinct(), ["file_id", "name"], "left_anti")
    return filled(files, good), wrong


def built(rows: DataFrame, group: str, order: str, text: str, title: str | None = None) -> DataFrame:
    """Documents of plain text pages: one document a group, one page a row.

    Groups are dealt to a fixed number of tasks, as few bytes of text can be much work.
    """

    def run(key: tuple, pages: pd.DataFrame) -> pd.DataFrame:
        out = []
        for t in pages.sort_values(order)[text]:
            p = writer.Page()
            for i, line in enumerate((t or "").split("\n")):
                p.text(line, 72, 720 - 14 * i)
            out.append(p)
        meta = {"title": str(pages[title].iloc[0])} if title else None
        return pd.DataFrame({group: [key[0]], "content": [writer.build(out, meta)]})

    dealt = rows.repartition(shuffle_width(rows.sparkSession), group)
    return dealt.groupBy(group).applyInPandas(run, f"{group} {dict(rows.dtypes)[group]}, content binary")


def built_from_packets(packets: DataFrame) -> DataFrame:
    """Documents of form packets ``file_id, name, data``: one document a file, its packets in the order of their names."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parts = {n: bytes(d) for n, d in rows.sort_values("name")[["name", "data"]].itertuples(index=False)}
        return pd.DataFrame({"file_id": [key[0]], "content": [writer.build_from_packets(parts)]})

    return packets.select("file_id", "name", "data").groupBy("file_id").applyInPandas(run, "file_id string, content binary")


def with_packets(files: DataFrame, packets: DataFrame) -> DataFrame:
    """``file_id, content, error``: files in which packets ``file_id, name, data`` are new or replaced."""
    return _with_entries(files, packets.select("file_id", "name", "data"), lambda c, new: (writer.with_packets(c, {k: bytes(v) for k, v in sorted(new.items())}), []))


def with_packet_values(files: DataFrame, data: DataFrame) -> DataFrame:
    """``file_id, content, unknown, error``: files whose datasets packet has the values ``file_id, name, value``."""
    return _with_entries(files, data.select("file_id", "name", "value"), writer.update_packet_values)


def _with_entries(files: DataFrame, entries: DataFrame, f: Callable[[bytes, dict], tuple[bytes, list[str]]]) -> DataFrame:
    name, value = entries.columns[1:]
    given = entries.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct(name, value))).alias("given"))

    def one(data, new) -> tuple:
        try:
            return (*f(bytes(data), dict(new) if new is not None else {}), None)
        except Exception as e:  # a damaged file must not stop the others
            return None, None, f"{type(e).__name__}: {e}"

    def each(fid, data, new) -> list[tuple]:
        return [(fid, *one(data, new))]

    run = _in_slices(["file_id", "content", "given"], ["file_id", "content", "unknown", "error"], each)
    return files.join(given, "file_id", "left").select("file_id", "content", "given").mapInPandas(run, "file_id string, content binary, unknown array<string>, error string")


def save_files(df: DataFrame, folder: str, name: str, data: str = "content") -> DataFrame:
    """Writes each row's bytes to a file below a mounted shared folder; gives the paths and sizes.

    Files are written under a temporary name and renamed, so a repeated task leaves no half file.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            rows = []
            for n, d in zip(b[name], b[data], strict=True):
                path = os.path.join(folder, os.path.basename(str(n)))
                with open(f"{path}.{os.getpid()}.part", "wb") as f:
                    f.write(d)
                os.replace(f.name, path)
                rows.append((path, len(d)))
            yield pd.DataFrame(rows, columns=["path", "size"])

    return df.select(name, data).mapInPandas(run, "path string, size long")


def stream_bytes(files: DataFrame) -> DataFrame:
    """Decoded streams: ``file_id, obj_num, data``."""

    def each(fid, data) -> list[tuple]:
        try:
            doc = Document(bytes(data or b""))
            return [(fid, n, doc.decode(s)) for n in sorted(doc.entries) if isinstance(s := doc.obj(n), Stream)]
        except Exception:  # such a file has no streams here; its warnings are a table of their own
            return []

    run = _in_slices(["file_id", "content"], ["file_id", "obj_num", "data"], each)
    return files.select("file_id", "content").mapInPandas(run, "file_id string, obj_num long, data binary")

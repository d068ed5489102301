"""Kernels and scans over generated documents."""

import zlib

import pytest
from pyspark.sql import functions as F

from docloom.functions import codecs
from docloom.operators import compare as cmp
from docloom.pdf import content, crypto, writer
from docloom.pdf.document import Document, unpredict
from docloom.pdf.syntax import Keyword, Name, DocError, Reader, Ref, Stream, write_value
from docloom.sources import documents


def made(n=3, texts=None, value="v", **how):
    texts = texts or [f"Hello {i} (x) \\ é" for i in range(n)]
    pages = [writer.Page().text(t, 72, 720).rect(10, 10, 50, 20).line(0, 0, 5, 5) for t in texts]
    marks = [{"title": "A", "page": 1, "children": [{"title": "B", "page": len(texts)}]}]
    fields = [{"name": "f1", "rect": [1, 2, 30, 4], "value": value, "max_len": 5, "flags": 2}, {"name": "c", "type": "Btn", "rect": [5, 5, 9, 9]}, {"name": "o", "type": "Ch", "rect": [9, 5, 19, 9], "options": ["x", "y"]}]
    return writer.build(pages, {"title": "Tést", "author": "me", "X": "y"}, marks, fields, **how)


def order(data):
    return [t["text"][6] for t in content.extract(data)["text_elements"]]


def test_values_round_trip():
    v = {"A": [1, -2.5, True, None, Name("a b#"), b"(\\)\r\n", "é€", Ref(3, 0)], "B": {"C": b"\x00\xff"}}
    back = Reader(write_value(v)).value()
    assert back["A"][:5] == [1, -2.5, True, None, "a b#"] and back["A"][5] == b"(\\)\r\n" and back["A"][7] == Ref(3, 0) and back["B"]["C"] == b"\x00\xff"
    assert Reader(b"(a\\053\\\nb(c)) % note\n <4 8 65>").value() == b"a+b(c)" and Reader(b"<48656C6C6F7>").value() == b"Hellop"
    assert isinstance(Reader(b"Tj").value(), Keyword)
    with pytest.raises(DocError):
        Reader(b"<< /A ").value()


@pytest.mark.parametrize("how", [{}, {"xref_stream": True}, {"xref_stream": True, "pack": True}])
def test_extract(how):
    e = content.extract(made(**how))
    assert [t["text"] for t in e["text_elements"]] == [f"Hello {i} (x) \\ é" for i in range(3)]
    assert e["text_elements"][0]["x"] == 72 and e["text_elements"][0]["y"] == 720 and e["text_elements"][0]["font_size"] == 12
    assert e["metadata"]["title"] == "Tést" and e["metadata"]["custom"] == {"X": "y"} and e["metadata"]["page_count"] == 3
    assert [(b["title"], b["depth"], b["page"]) for b in e["bookmarks"]] == [("A", 0, 1), ("B", 1, 3)]
    assert [g["type"] for g in e["graphics"][:2]] == ["rectangle", "line"] and e["graphics"][0]["bbox"] == [10, 10, 60, 30]
    assert e["fields"][0]["V"] == b"v" and e["fields"][2]["Opt"] == [b"x", b"y"] and not e["warnings"]
    assert e["fonts"] == [{"font_id": "F1", "name": "Helvetica", "family": "Helvetica", "subtype": "Type1", "embedded": False, "standard": True, "encoding": "WinAnsiEncoding", "has_to_unicode": False}]


@pytest.mark.parametrize("method", ["V2", "AESV2", "AESV3"])
def test_encryption(method):
    doc = Document(made(2))
    objects = {n: doc.obj(n) for n, e in doc.entries.items() if e[0] == "at"}
    secret = crypto.setup(b"user", b"owner", b"0123456789abcdef", method=method)
    data = writer.write(objects, {"Root": doc.trailer["Root"], "Info": doc.trailer["Info"], "ID": [b"0123456789abcdef"] * 2}, encryption=secret)
    for password in (b"user", b"owner"):
        e = content.extract(data, password)
        assert order(made(2)) == [t["text"][6] for t in e["text_elements"]] and e["metadata"]["title"] == "Tést" and e["metadata"]["encrypted"]
    with pytest.raises(DocError) as x:
        content.extract(data, b"bad")
    assert x.value.code == "wrong_password" and b"Hello" not in data


def test_cipher_vectors():
    # The published example vectors of the two ciphers.
    assert crypto.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    key = bytes(range(16))
    assert crypto.aes_cbc(key, bytes(16), bytes.fromhex("00112233445566778899aabbccddeeff"), False, pad=False).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert crypto.aes_cbc(bytes(range(32)), bytes(16), bytes.fromhex("00112233445566778899aabbccddeeff"), False, pad=False).hex() == "8ea2b7ca516745bfeafc49904b496089"
    assert crypto.aes_cbc(key, key, crypto.aes_cbc(key, key, b"some text", False), True) == b"some text"


def test_page_sets():
    a, b = made(3), made(2)
    assert order(writer.merge([a, b])) == list("01201")
    assert [order(x) for x in writer.split(a, [(1, 2), (3, 3)])] == [["0", "1"], ["2"]] and len(writer.split_every(a, 2)) == 2
    assert order(writer.extract_pages(a, [3, 1, 3])) == list("202") and order(writer.delete_pages(a, [2])) == list("02")
    assert order(writer.insert_pages(a, 2, b)) == list("00112") and order(writer.insert_pages(a, 0, b)) == list("01201")
    assert [p["rotation"] for p in content.extract(writer.rotate_pages(writer.rotate_pages(a, 270), 180, [1]))["pages"]] == [90, 270, 270]
    for bad in (lambda: writer.rotate_pages(a, 45), lambda: writer.delete_pages(b, [1, 2]), lambda: writer.extract_pages(a, [9])):
        with pytest.raises(DocError):
            bad()


def test_forms_and_revisions():
    a = made(3)
    filled, unknown = writer.fill_form(a, {"f1": "new", "c": True, "zz": 1})
    doc = Document(filled)
    assert unknown == ["zz"] and filled.startswith(a) and [r["rev"] for r in doc.revisions()] == [1, 2]
    assert {f["t"]: f.get("V") for f in doc.fields()} == {"f1": b"new", "c": "Yes", "o": None}
    assert Document(filled[: doc.revisions()[0]["end_offset"]]).fields()[0]["V"] == b"v"
    flat = content.extract(writer.flatten_form(filled))
    assert not flat["fields"] and any(t["text"] == "new" for t in flat["text_elements"])


def test_damage():
    a = made(3)
    broken = content.extract(a.replace(b"startxref", b"startxxxx"))
    assert [t["text"][6] for t in broken["text_elements"]] == list("012") and broken["warnings"][0]["code"] == "repair"
    assert Document(a[: len(a) // 2]).warnings
    for bad, code in ((b"%PDF", "too_short"), (b"x" * 50, "no_header"), (b"%PDF-1.4 nothing here", "no_objects")):
        with pytest.raises(DocError) as x:
            Document(bad)
        assert x.value.code == code


def test_codecs():
    # Vectors of the published filter definitions.
    assert codecs.ascii_hex_decode(b"48656c 6C6F>") == b"Hello" and codecs.ascii85_decode(b"<~87cURD]j7BEbo80~>") == b"Hello world!" and codecs.ascii85_decode(b"<~z~>") == bytes(4)
    assert codecs.run_length_decode(bytes([2]) + b"Hi!" + bytes([253]) + b" " + bytes([128])) == b"Hi!    " and codecs.run_length_encode(b"AAAAA") == bytes([252, 65, 128])
    for data in (b"", b"a", b"aab" * 200, bytes(range(256)) * 3, b"x" * 1000):
        for name in ("FlateDecode", "ASCIIHexDecode", "ASCII85Decode", "RunLengthDecode"):
            assert codecs.decode_filter(codecs.ENCODERS[name](data), "/" + name) == data
        assert codecs.inflate_any(codecs.raw_deflate(data)) == (data, True)
    assert codecs.inflate_any(b"plain") == (b"plain", False)
    assert unpredict(bytes([2, 1, 2, 3, 2, 1, 1, 1, 4, 1, 1, 1]), {"Predictor": 15, "Columns": 3}) == bytes([1, 2, 3, 2, 3, 4, 3, 4, 5])


def test_fonts():
    table, width = content.parse_cmap(b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0003> <0041> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<0078> <D83DDE00>] endbfrange")
    assert width == 2 and table == {3: "A", 16: "a", 17: "b", 18: "c", 32: "x", 33: "😀"}
    assert [content.glyph_char(n) for n in ("eacute", "A", "uni20AC", "Scaron", "comma", "a.alt", "nothing")] == ["é", "A", "€", "Š", ",", "a", ""]
    f = content.Font(Document(made(1)), {"Subtype": Name("Type1"), "BaseFont": Name("X-Bold"), "Encoding": {"Differences": [65, Name("eacute"), Name("B")]}})
    assert f.decode(b"AB\x93C") == "éB“C" and f.family == "X"


def test_images():
    frame = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x02\x00\x03\x03" + bytes(12) + b"\xff\xd9"
    assert writer.jpeg_header(frame) == (3, 2, "DeviceRGB")
    raw = zlib.compress(bytes([0, 9, 8, 7]))
    chunk = lambda t, d: len(d).to_bytes(4, "big") + t + d + zlib.crc32(t + d).to_bytes(4, "big")
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0\0\0\x01\0\0\0\x01\x08\x02\0\0\0") + chunk(b"IDAT", raw) + chunk(b"IEND", b"")
    e = content.extract(writer.build([writer.Page().image(frame, 1, 2, 30, 40).image(png, 5, 6, 7, 8).watermark("DRAFT")]))
    assert [(i["format"], i["width"], i["height"]) for i in e["images"]] == [("jpeg", 3, 2), ("raw", 1, 1)] and e["images"][1]["data"] == bytes([9, 8, 7]) and e["images"][0]["data"] == frame
    assert [(r["x"], r["width"], r["height"]) for r in e["image_refs"]] == [(1, 30, 40), (5, 7, 8)] and e["text_elements"][0]["text"] == "DRAFT"


@pytest.fixture(scope="module")
def files(spark):
    filled, _ = writer.fill_form(made(2), {"f1": "w"})
    return spark.createDataFrame([("a", bytearray(made(3))), ("b", bytearray(filled)), ("bad", bytearray(b"nonsense here")), ("none", None)], "file_id string, content binary")


def test_scan_tables(files):
    n = {name: documents.table(files, name).count() for name in documents.SCHEMAS}
    assert n["pages"] == 5 and n["text_elements"] == 5 and n["graphics"] == 10 and n["fields"] == 6 and n["bookmarks"] == 4 and n["metadata"] == 2 and n["revisions"] == 3
    assert {r.file_id for r in documents.table(files, "warnings").collect()} == {"bad", "none"}
    newest = documents.latest_objects(documents.table(files, "raw_objects"))
    assert newest.filter("file_id = 'b' and rev = 2").count() >= 1 and newest.groupBy("file_id", "obj_num").count().filter("count > 1").isEmpty()
    s = {r.file_id: r for r in documents.document_summary(files).collect()}
    assert (s["a"].pages, s["a"].has_text, s["a"].scanned, s["bad"].pages) == (3, True, False, 0)


def test_sinks(spark, files, tmp_path):
    good = files.filter("file_id in ('a', 'b')").withColumn("g", F.lit("m"))
    merged = documents.merged(good, "g", "file_id").first()
    assert order(bytes(merged.content)) == list("01201")
    parts = documents.transform(files.filter("content is not null"), lambda d: writer.split_every(d, 2)).collect()
    assert sorted((r.file_id, r.part, r.error is None) for r in parts) == [("a", 1, True), ("a", 2, True), ("b", 1, True), ("bad", 0, False)]
    data = spark.createDataFrame([("a", "f1", "z"), ("a", "q", "1")], "file_id string, name string, value string")
    filled = {r.file_id: r for r in documents.filled(good, data).collect()}
    assert filled["a"].unknown == ["q"] and Document(bytes(filled["a"].content)).fields()[0]["V"] == b"z" and filled["b"].unknown == []
    rows = spark.createDataFrame([("x", 1, "first\nline"), ("x", 2, "second")], "doc string, page int, body string")
    saved = documents.save_files(documents.built(rows, "doc", "page", "body"), str(tmp_path), "doc").collect()
    back = documents.read_files(spark, str(tmp_path), "*")
    assert len(saved) == 1 and [r.text for r in documents.table(back, "text_elements").orderBy("page", "idx").collect()] == ["first", "line", "second"]


def test_compare(spark):
    pair = lambda d, side: spark.createDataFrame([("p", side, bytearray(d)), ("q", side + "q", bytearray(made(1)))], "pair_id string, file_id string, content binary")
    left, right = pair(made(texts=["Hello A", "Hello B"]), "l"), pair(made(texts=["Hello A", "Hello C", "Hello D"], value="w"), "r")
    d = cmp.compare(left, right)
    got = {(r.kind, r.category, r.page) for r in d.collect()}
    assert ("text", "modified", 2) in got and ("text", "added", 3) in got and ("page", "added", 3) in got and ("field", "modified", None) in got
    assert not any(r.pair_id == "q" for r in d.collect())
    rep = {r.pair_id: r for r in cmp.report(left, d).collect()}
    assert rep["q"].identical and rep["q"].report == "differences: 0" and not rep["p"].identical and "text modified: 1" in rep["p"].report


def test_kernels_give_slices(monkeypatch):
    """A task hands rows on before it holds all that a batch of files gives."""
    import pandas as pd

    from docloom.sources import documents

    monkeypatch.setattr(documents, "ROWS_AT_ONCE", 10)
    monkeypatch.setattr(documents, "BYTES_AT_ONCE", 100)
    seen = []

    def each(name, data):
        seen.append(name)
        return [(name, i) for i in range(len(data))]

    run = documents._in_slices(["f", "data"], ["f", "i"], each, ["i"])
    given = run(iter([pd.DataFrame({"f": list(range(40)), "data": [b"x" * (k % 4) for k in range(40)]}), pd.DataFrame({"f": [40, 41], "data": [b"y" * 99, b""]})]))
    first = next(given)
    assert len(first) <= 10 and len(seen) < 12
    rest = list(given)
    assert all(0 < len(p) <= 10 for p in rest)
    assert pd.concat([first, *rest]).values.tolist() == [[k, i] for k in range(40) for i in range(k % 4)] + [[40, i] for i in range(99)]
    assert list(run(iter([]))) == []

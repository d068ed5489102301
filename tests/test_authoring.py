import struct
import zlib

from pyspark.sql import functions as F

from docloom.__main__ import main
from docloom.pdf import authoring, content, writer
from docloom.pdf.document import Document
from docloom.pdf.syntax import Name, Ref, Stream


def test_content_operators(spark):
    c = authoring.Content().save_state().translate(5, 6).begin_text().set_font(Name("F1"), 10).char_spacing(1).text_position(1, 2).show_array([b"A", -100, b"B"]).end_text().restore_state().draw_at("Im1", 1, 2, 3, 4)
    page = writer.build([writer.Page().text("x", 0, 0)])
    doc = Document(page)
    texts, _, _ = content.interpret(doc, c.bytes(), doc.get(doc.pages()[0][1]["Resources"]))
    assert texts[0]["text"] == "AB" and (texts[0]["x"], texts[0]["y"]) == (6, 8) and texts[0]["char_spacing"] == 1
    rows = spark.createDataFrame([("d", 1, 2, "Tj", ["(b)"]), ("d", 1, 1, "BT", []), ("d", 1, 10, "ET", [])], "doc string, page int, seq int, op string, args array<string>")
    assert bytes(authoring.content_from_rows(rows, ["doc", "page"]).first().content) == b"BT\n(b) Tj\nET"


def test_fields_actions_appearances():
    data = writer.build([writer.Page()], fields=[authoring.field("radio", "r", [0, 0, 9, 9], required=True), authoring.field("choice", "c", [0, 0, 9, 9], options=["a", "b"])])
    doc = Document(data)
    assert [(f["FT"], f["Ff"]) for f in doc.fields()] == [("Btn", 0x8002), ("Ch", 0x20000)]
    num, top = doc.fields()[0]["obj_num"], max(doc.entries) + 1
    f = authoring.with_mouse_action(doc.obj(num), "up", authoring.action("URI", "http://x"))
    f = authoring.with_appearance(f, {"Yes": Ref(top), "Off": Ref(top + 1)})
    new = Document(writer.append_revision(data, {num: f, top: authoring.checkbox_appearance(True, 9, 9), top + 1: authoring.checkbox_appearance(False, 9, 9)}))
    assert new.get(new.obj(num)["AA"]["U"])["URI"] == b"http://x" and isinstance(new.get(new.obj(num)["AP"]["N"]["Yes"]), Stream)
    for s in (authoring.text_appearance("hi", 50, 20), authoring.button_appearance("go", 50, 20)):
        assert content.interpret(new, s.raw, s.attrs["Resources"])[0][0]["text"] in ("hi", "go")


def test_jobs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(writer.build([writer.Page().text(t, 1, 2) for t in "abc"]))
    main(["scan", str(tmp_path / "in"), str(tmp_path / "out")], spark)
    assert [r.text for r in spark.read.parquet(str(tmp_path / "out")).orderBy("page").collect()] == list("abc")
    main(["split", str(tmp_path / "in"), str(tmp_path / "parts"), "--pages", "2"], spark)
    assert sorted(p.name for p in (tmp_path / "parts").iterdir()) == ["a-1.pdf", "a-2.pdf"]
    main(["compare", str(tmp_path / "in"), str(tmp_path / "cmp"), "--with", str(tmp_path / "in")], spark)
    assert spark.read.parquet(str(tmp_path / "cmp")).filter(F.lit(True)).count() == 0


def png(w, h, bits, kind, rows, interlace=0, **more):
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, kind, 0, 0, interlace))
    return b"\x89PNG\r\n\x1a\n" + head + b"".join(chunk(k.encode(), v) for k, v in more.items()) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def shown(data):
    doc = Document(writer.build([writer.Page().image(data, 0, 0, 10, 10)]))
    _, attrs = doc.pages()[0]
    image = doc.get(doc.get(doc.get(attrs["Resources"])["XObject"])["Im1"])
    mask = doc.get(image.attrs.get("SMask"))
    return image.attrs["ColorSpace"], doc.decode(image), doc.decode(mask) if mask is not None else None


def test_pictures_with_alpha_palette_and_interlace():
    assert shown(png(2, 1, 8, 6, b"\0" + bytes([1, 2, 3, 9, 4, 5, 6, 8]))) == ("DeviceRGB", bytes([1, 2, 3, 4, 5, 6]), bytes([9, 8]))
    assert shown(png(2, 1, 16, 4, b"\0" + bytes([7, 0, 9, 0, 5, 0, 1, 0]))) == ("DeviceGray", bytes([7, 5]), bytes([9, 1]))
    assert shown(png(3, 1, 2, 3, b"\0" + bytes([0b00011000]), PLTE=bytes(range(9)), tRNS=b"\x05")) == ("DeviceRGB", bytes([0, 1, 2, 3, 4, 5, 6, 7, 8]), bytes([5, 255, 255]))
    plain = [[10 * y + x for x in range(9)] for y in range(5)]
    rows = b""
    for x, y, dx, dy in writer.PASSES:
        for line in plain[y::dy]:
            rows += b"\0" + bytes(line[x::dx]) if line[x::dx] else b""
    assert shown(png(9, 5, 8, 0, rows, 1)) == ("DeviceGray", bytes(v for line in plain for v in line), None)
    assert shown(png(8, 1, 1, 0, b"\0\xa0" * 1, 0))[1] == b"\xa0"


def test_translucent_watermarks():
    picture = png(1, 1, 8, 2, b"\0\x01\x02\x03")
    doc = Document(writer.build([writer.Page().watermark("DRAFT", opacity=0.25).image_watermark(picture, 50, 40, 0.5)]))
    _, attrs = doc.pages()[0]
    states = doc.get(doc.get(attrs["Resources"])["ExtGState"])
    assert sorted(float(s["ca"]) for s in states.values()) == [0.25, 0.5]
    e = content.extract(writer.build([writer.Page().watermark("DRAFT", opacity=0.25).image_watermark(picture, 50, 40, 0.5)]))
    assert [t["text"] for t in e["text_elements"]] == ["DRAFT"] and [(r["x"], r["y"]) for r in e["image_refs"]] == [(281, 376)]

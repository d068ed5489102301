"""Cases of the review's findings on the document operators."""

from docloom.operators import trees
from docloom.pdf import writer
from docloom.pdf.document import Document
from docloom.pdf.syntax import Name, Ref
from tests.test_pdf import made


def kept(data):
    d = Document(data)
    info = {k: v for k, v in d.metadata().items() if k != "page_count"}
    return info, [(b["title"], b["depth"]) for b in d.outline()], [(f["full_name"], f.get("V")) for f in d.fields()], d.form().get("DA")


def labelled():
    """Three pages (i, ii, 1), with a language and an older version."""
    doc = Document(made(3))
    objects = {n: doc.obj(n) for n in doc.entries if doc.obj(n) is not None}
    objects[doc.trailer["Root"][0]] |= {"Lang": b"en", "PageLabels": {"Nums": [0, {"S": Name("r")}, 2, {"S": Name("D")}]}}
    return writer.write(objects, {k: doc.trailer[k] for k in ("Root", "Info")}, "1.4")


def labels(data):
    flat = Document(data).get(Document(data).trailer["Root"])["PageLabels"]["Nums"]
    return [(v.get("S"), v.get("St")) for v in flat[1::2]]


def test_edits_keep_metadata_outline_form_and_catalog():
    a = labelled()
    for edited, targets in ((writer.rotate_pages(a, 90), [1, 3]), (writer.delete_pages(a, [1]), [None, 2]), (writer.insert_pages(a, 1, made(2)), [3, 5])):
        assert kept(edited) == kept(a) and kept(a)[0]["title"] == "Tést" and kept(a)[0]["version"] == "1.4"
        d = Document(edited)
        assert [b["page"] for b in d.outline()] == targets and d.get(d.trailer["Root"])["Lang"] == b"en"
    assert labels(writer.rotate_pages(a, 90)) == [("r", None), ("D", None)]
    assert labels(writer.delete_pages(a, [1])) == [("r", 2), ("D", 1)]
    assert labels(writer.insert_pages(a, 1, made(2))) == [(None, None), (None, None), ("r", 1), ("r", 2), ("D", 1)]


def test_widgets_of_the_form_are_those_on_the_page():
    d = Document(writer.rotate_pages(made(2), 90))
    (num, attrs), _ = d.pages()
    assert [r[0] for r in attrs["Annots"]] == [f["obj_num"] for f in d.fields()]
    assert all(d.obj(r[0])["P"] == Ref(num, 0) for r in attrs["Annots"])
    locked = writer.encrypt(made(2), b"u", b"o", "V2")
    assert kept(writer.rotate_pages(locked, 90, password=b"u")) == kept(made(2))


def test_compare_query_counts_all_kinds(spark, monkeypatch):
    from docloom.plans import document_queries

    rows = [("1", kind, None, "modified", "x", "a", "b") for kind in ("metadata", "bookmark", "page")]
    found = spark.createDataFrame(rows, "pair_id string, kind string, page long, category string, location string, old_value string, new_value string")
    monkeypatch.setattr(document_queries.compare, "compare", lambda *_: found)
    got = document_queries.pdf_compare(spark, "/root/testdata/sf0.001").collect()
    assert {(r.kind, r.n) for r in got} == {("metadata", 1), ("bookmark", 1), ("page", 1)}


def test_full_names_at_any_depth(spark):
    chain = [(i, i - 1 if i else None, f"t{i}") for i in range(150)]
    rest = [(200, 201, "x"), (201, 200, "y"), (202, 201, "z"), (203, 999, "w"), (204, 0, None)]
    got = {r.n: (r.full_name, r.depth) for r in trees.full_names(spark.createDataFrame(chain + rest, "n long, p long, t string"), "n", "p", "t").collect()}
    assert got == {i: (".".join(f"t{k}" for k in range(i + 1)), i) for i in range(150)} | {204: ("t0", 1)}

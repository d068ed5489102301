"""Packets, forms, issues and comparison options beside what the queries cover."""

import json

import pytest
from pyspark.sql import functions as F

from docloom.functions import issues, xfa
from docloom.operators import compare, diff, forms, packets
from docloom.pdf import authoring, content, writer
from docloom.pdf.document import Document
from docloom.pdf.syntax import Name, Ref, Stream
from docloom.sources import documents


def test_inverses_keep_what_they_read():
    config = "<config><present renderPolicy='client'><pdf version='1.7'><creator>me &amp; you</creator></pdf></present><acrobat mode='x'/></config>"
    assert xfa.attributes(xfa.from_attributes(xfa.attributes(config))) == xfa.attributes(config)
    nested = "<datasets><data><a><b><field name='f'><value>1</value></field></b><c>2</c></a><a2/></data></datasets>"
    assert xfa.dataset_values(xfa.datasets_xml(xfa.dataset_values(nested))) == xfa.dataset_values(nested)
    locales = "<localeSet default='de'><locale code='de' name='Deutsch'><currency>EUR</currency></locale><locale code='en' name='English'/></localeSet>"
    assert xfa.locale_rows(xfa.locales_xml(xfa.locale_rows(locales))) == xfa.locale_rows(locales)
    lines = "<connectionSet><connection name='c' type='http'><uri>http://x</uri><user>u</user></connection></connectionSet>"
    assert xfa.connections(xfa.connections_xml(xfa.connections(lines))) == xfa.connections(lines)
    styles = "<stylesheet><style name='s' type='t'><font family='F' size='9'/><para align='left'/></style></stylesheet>"
    assert xfa.styles(xfa.styles_xml(xfa.styles(styles))) == xfa.styles(styles)
    rules = "<template><field name='a'><event activity='exit'><script>x</script></event><calculate><script>y</script></calculate></field></template>"
    assert xfa.template_rules(xfa.rules_xml(xfa.template_rules(rules))) == xfa.template_rules(rules)
    for read in (xfa.dataset_values, xfa.locale_rows, xfa.connections, xfa.styles, xfa.template_rules):
        assert read({xfa.dataset_values: xfa.datasets_xml, xfa.locale_rows: xfa.locales_xml, xfa.connections: xfa.connections_xml, xfa.styles: xfa.styles_xml, xfa.template_rules: xfa.rules_xml}[read]([])) == []


def test_damaged_packets_and_files_stop_nothing(spark):
    rows = spark.createDataFrame([("a", "datasets", b"<datasets><data><x>1</x></data></datasets>"), ("b", "datasets", b"<no end"), ("c", "datasets", None)], "file_id string, name string, data binary")
    assert [(r.file_id, r.path, r.value) for r in packets.rows_of(rows, "values").collect()] == [("a", "x", "1")]
    files = spark.createDataFrame([("good", writer.build([writer.Page()], fields=[{"name": "f", "rect": [0, 0, 9, 9]}])), ("bad", b"nothing"), ("null", None)], "file_id string, content binary")
    values = spark.createDataFrame([(f, "f", "v") for f in ("good", "bad", "null")], "file_id string, name string, value string")
    assert {r.file_id: (r.content is not None, r.error is None) for r in documents.filled(files, values).collect()} == {"good": (True, True), "bad": (False, False), "null": (False, False)}
    assert {r.file_id: r.error is None for r in documents.transform(files, lambda x: writer.rotate_pages(x, 90)).collect()} == {"good": True, "bad": False, "null": False}
    assert {r.file_id for r in documents.stream_bytes(files).collect()} == {"good"}
    assert {r.file_id: r.json is not None for r in documents.content_json(files).collect()} == {"good": True, "bad": False, "null": False}
    read = documents.parsed(files, ["pages", "warnings"])
    assert [r.file_id for r in documents.table(read, "pages").collect()] == ["good"] and {r.file_id for r in documents.table(read, "warnings").collect()} >= {"bad", "null"}


def test_packets_in_documents():
    data = writer.build_from_packets({"template": b"<template/>", "datasets": b"<datasets><data><x>1</x></data></datasets>"})
    assert [p["name"] for p in Document(data).xfa_packets()] == ["template", "datasets"]
    new, unknown = writer.update_packet_values(data, {"x": 2, "y": 3})
    assert unknown == ["y"] and xfa.dataset_values(Document(new).xfa_packets()[1]["data"])[0]["value"] == "2" and new.startswith(data)
    more = writer.with_packets(new, {"config": b"<config/>", "template": b"<template a='b'/>"})
    assert [(p["name"], p["data"]) for p in Document(more).xfa_packets() if p["name"] != "datasets"] == [("template", b"<template a='b'/>"), ("config", b"<config/>")]
    with pytest.raises(ValueError):
        writer.update_packet_values(writer.build([writer.Page()]), {"x": 1})


def test_appearances():
    doc = Document(writer.build([writer.Page()], fields=[{"name": "c", "rect": [0, 0, 9, 9], "type": "Btn"}, {"name": "t", "rect": [0, 0, 9, 9]}]))
    objects = {n: doc.obj(n) for n in doc.entries if doc.obj(n) is not None}
    box, text = (f["obj_num"] for f in doc.fields())
    top = max(objects)
    objects |= {top + 1: authoring.checkbox_appearance(True, 9, 9), top + 2: authoring.checkbox_appearance(False, 9, 9), top + 3: Stream({"BBox": [0, 0, 9, 9]}, b"BT ET")}
    objects[box] |= {"AP": {"N": {Name("Yes"): Ref(top + 1), Name("Off"): Ref(top + 2)}}}
    objects[text] |= {"AP": {"N": Ref(top + 3)}}
    rows = content.extract(writer.write(objects, {"Root": doc.trailer["Root"]}))["appearances"]
    assert sorted((r["full_name"], str(r["state"])) for r in rows) == [("c", "Off"), ("c", "Yes"), ("t", "None")]
    assert next(r for r in rows if r["full_name"] == "t")["data"] == b"BT ET"


def test_field_rules_by_type(spark):
    rows = [("Tx", 2, None, None, None, "required"), ("Tx", 0, "toolong", 5, None, "max_length"), ("Ch", 0, "x", None, ["a"], "option"), ("Ch", 0, "a", None, ["a"], None), ("Btn", 0, "anything", None, ["a"], None),
            ("Btn", 0x8000, "x", None, ["a"], "option"), ("Sig", 2, "", None, None, "required"), ("Sig", 0, "x", 1, None, None)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "ft string, ff long, v string, n long, o array<string>, want string, i long")
    got = df.select("i", "want", forms.field_failure(F.col("ft"), F.col("ff"), F.col("v"), F.col("n"), F.col("o")).alias("rule")).collect()
    assert all(r.rule == r.want for r in got)
    questions = spark.createDataFrame([("f", "email", True, None, None, "@", []), ("f", "age", True, 1, 2, "", []), ("f", "kind", False, None, None, "", ["a", "b"])], "file_id string, name string, required boolean, min_length long, max_length long, pattern string, options array<string>")
    wrong = lambda *given: sorted((r.name, r.rule) for r in forms.question_errors(questions, spark.createDataFrame([("f", *g) for g in given], "file_id string, name string, value string")).collect())
    assert wrong(("email", "a@b"), ("age", "30"), ("kind", "a")) == []
    assert wrong(("email", "ab"), ("age", "150"), ("kind", "c"), ("more", "x")) == [("age", "max_length"), ("email", "pattern"), ("kind", "option"), ("more", "unknown")]
    assert wrong(("email", "a@b")) == [("age", "required")]


def test_issues(spark):
    w = issues.add(issues.add(issues.collector(spark), "no_page", "error", "page {page} is not there", page="7"), "xref", "warning", "mended")
    assert issues.has_level(w, "error") and not issues.has_level(w, "info") and issues.clear(w).isEmpty()
    r = w.filter("code = 'no_page'").withColumn("context", issues.with_context(F.col("context"), "page", F.lit(8))).first()
    assert r.message == "page 7 is not there" and r.context == {"page": "8"}


def element(text, x=72.0, y=720.0):
    return {"text": text, "x": x, "y": y, "font_name": "Helvetica", "font_size": 12.0}


def test_granularity_moves_and_ignored_parts(spark):
    kinds = lambda a, b, **o: sorted(d["kind"] for d in diff.align(a, b, diff.CompareOptions(**o)))
    for g in ("element", "word", "char"):
        assert kinds([element("Hello World")], [element("Hello Universe")], granularity=g) == ["modified"]
        assert kinds([element("Hello World")], [element("Hello World")], granularity=g) == []
    assert kinds([element("Hello, World")], [element("Hello World")], granularity="word") == []
    assert kinds([element("Hello, World")], [element("Hello World")], granularity="char") == ["modified"]
    assert diff.align([element("a b c d")], [element("a x c d")], diff.CompareOptions(granularity="word"))[0]["ratio"] == 0.25
    far = [element("same")], [element("same", 200.0, 600.0)]
    assert kinds(*far) == ["moved"] and kinds(*far, move_distance=500.0) == ["moved"] and kinds(*far, move_distance=50.0) == ["added", "removed"]
    with pytest.raises(ValueError):
        diff.align([], [], diff.CompareOptions(granularity="line"))
    side = lambda title, text: spark.createDataFrame([("p", "f", writer.build([writer.Page().text(text, 72, 700)], {"title": title}))], "pair_id string, file_id string, content binary")
    found = lambda **o: sorted((r.kind, r.category) for r in compare.compare(side("A", "x"), side("B", "y"), diff.CompareOptions(**o)).collect())
    assert found() == [("metadata", "modified"), ("text", "modified")]
    assert found(ignore_metadata=("title",)) == [("text", "modified")] and found(ignore_kinds=("text", "metadata")) == []
    same = side("A", "x")
    report = json.loads(compare.report_json(same, compare.compare(same, side("A", "x"))).first().json)
    assert report == {"identical": True, "total": 0, "differences": []}

"""Relational operators, text functions, packets and alignment."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.functions import issues, text, xfa
from docloom.operators import diff, forms, pageset, ranking, trees
from docloom.streaming import revisions as streaming


def element(i, t, x=72.0, y=None, font="Helvetica"):
    return {"text": t, "x": x, "y": 720.0 - 10 * i if y is None else y, "font_name": font, "font_size": 12.0}


def kinds(a, b, **o):
    out = diff.align([element(i, t) for i, t in enumerate(a)], [element(i, t) for i, t in enumerate(b)], diff.CompareOptions(**o))
    return {k: sum(d["kind"] == k for d in out) for k in ("added", "removed", "modified", "moved")}


def test_alignment():
    assert kinds("ABCD", "AXCEF", detect_moves=False) == {"added": 1, "removed": 0, "modified": 2, "moved": 0}
    long = [str(i) for i in range(100)]
    assert kinds(long, ["X" if i % 10 == 0 else t for i, t in enumerate(long)], detect_moves=False)["modified"] == 10
    assert kinds("", "AB")["added"] == 2 and kinds("AB", "")["removed"] == 2 and kinds("", "") == dict.fromkeys(("added", "removed", "modified", "moved"), 0)
    assert kinds("ABC", "CAB")["moved"] == 3
    one = diff.align([element(0, "same")], [element(0, "same", 200.0, 600.0)], diff.CompareOptions())
    assert [d["kind"] for d in one] == ["moved"]
    assert kinds(["a" * 50], ["a" * 49 + "b"], sensitivity="relaxed")["modified"] == 0
    assert kinds(["Hello World"], ["hello  world"], ignore_case=True, ignore_space=True)["modified"] == 0


def test_lcs_is_longest():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        got = diff.lcs_pairs(a, b)
        assert len(got) == table[-1][-1] and all(a[i] == b[j] for i, j in got) and got == sorted(got) and len({j for _, j in got}) == len(got)


def test_keyed_and_band(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, None), (4, "w")], "k int, v string")
    assert {(r.k, r.category) for r in diff.keyed_diff(a, b, ["k"], "v").collect()} == {(1, "removed"), (2, "modified"), (3, "equal"), (4, "added")}
    p = spark.createDataFrame([(1, 0.0), (1, 4.9), (1, 5.0), (2, 0.0)], "g int, x double")
    q = spark.createDataFrame([(1, 0.1)], "h int, y double")
    assert sorted(r.x for r in diff.band_match(p, q, [("g", "h")], "x", "y", 4.9).collect()) == [0.0, 4.9]


def test_ranks(spark):
    df = spark.range(5000).select((F.col("id") % 3 == 0).alias("hot"), ((F.col("id") * 7919) % 5000).alias("v"))
    rows = ranking.ordered_rank(df, ["hot"], ["v"]).collect()
    for k in (True, False):
        mine = sorted((r.v, r["rank"]) for r in rows if r.hot == k)
        assert [x for _, x in mine] == list(range(1, len(mine) + 1))


def test_page_sets(spark):
    pages = pageset.number_pages(spark.createDataFrame([("d", c) for c in "abcde"], "doc string, c string"), ["doc"], ["c"])
    take = lambda df, *by: [r.c for r in df.orderBy(*by).collect()]
    assert take(pageset.extract_pages(pages, [3, 1, 3]), "new_number") == list("cac")
    assert take(pageset.delete_pages(pages, [2, 4]), "new_number") == list("ace")
    assert [(r.c, r.part) for r in pageset.split_ranges(pages, [(1, 2), (2, 3)]).orderBy("part", "page_number").collect()] == [("a", 1), ("b", 1), ("b", 2), ("c", 2)]
    assert [r.part for r in pageset.split_by_count(pages, 2).orderBy("page_number").collect()] == [1, 1, 2, 2, 3]
    ins = pageset.insert_page(pages, 2, spark.createDataFrame([("d", "NEW")], "doc string, c string"))
    assert take(ins, "new_number") == ["a", "NEW", "b", "c", "d", "e"]
    with pytest.raises(ValueError):
        pageset.split_ranges(pages, [(2, 1)])
    with pytest.raises(ValueError):
        pageset.rotate(F.lit(0), 30)


def test_trees(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (8, 9, "x"), (9, 8, "y")], "n int, p int, t string")
    assert {(r.n, r.full_name, r.depth) for r in trees.full_names(df, "n", "p", "t").collect()} == {(1, "a", 0), (2, "a.b", 1), (3, "a.b.c", 2)}


def test_rules(spark):
    df = spark.createDataFrame([("a@b.c", "30"), ("bad", "150"), ("", None), (None, "x")], "email string, age string")
    out = df.select(forms.first_failure(F.col("email"), required=True, min_length=2, pattern="@").alias("e"), forms.first_failure(F.col("age"), minimum=0, maximum=120).alias("a")).collect()
    assert [(r.e, r.a) for r in out] == [(None, None), ("pattern", "maximum"), ("required", None), ("required", "not_a_number")]
    rule = {"logic": "AND", "of": [{"op": "isNotEmpty", "field": "email"}, {"logic": "NOT", "of": [{"op": "contains", "field": "email", "value": "bad"}]}]}
    assert df.filter(forms.condition(rule)).count() == 1
    flags = spark.createDataFrame([("Tx", 0), ("Btn", 0), ("Btn", 0x8000), ("Btn", 0x10000), ("Ch", 0), ("Sig", 0)], "ft string, ff int")
    assert [r[0] for r in flags.select(forms.field_kind(F.col("ft"), F.col("ff"))).collect()] == ["text", "checkbox", "radio", "button", "select", "signature"]


def test_text(spark):
    df = spark.createDataFrame([("a(b)\\n\n\t",), ("é\\\\n",), ("",), (None,)], "s string")
    assert all(r.s == r.u for r in df.select("s", text.unescape_string(text.escape_string(F.col("s"))).alias("u")).collect())
    kinds_ = spark.createDataFrame([("1",), ("12",), ("1.5",), ("true",), ("x",), ("",)], "s string").select(text.value_type(F.col("s")).alias("v"), text.style_type(F.col("s")).alias("t")).collect()
    assert [(r.v, r.t) for r in kinds_] == [("bool", "float"), ("int", "float"), ("float", "float"), ("bool", "bool"), ("string", "string"), ("empty", "empty")]
    ids = spark.createDataFrame([("My field-1",), ("9x",), ("é!",)], "s string").select(text.sanitise_id(F.col("s"), F.lit(4))).collect()
    assert [r[0] for r in ids] == ["My_field_1", "field_9x", "field_4"]
    dates = spark.createDataFrame([("D:20240115103000",), ("20240115",), ("x",)], "s string").select(text.parse_pdf_date(F.col("s")).cast("string")).collect()
    assert [r[0] for r in dates] == ["2024-01-15 10:30:00", "2024-01-15 00:00:00", None]
    e = spark.createDataFrame([("wrong_password",), ("maximum",), ("?",)], "code string").select(issues.error_class(F.col("code"))).collect()
    assert [r[0] for r in e] == ["encryption", "validation", "other"]


def test_packets():
    q = xfa.template_questions("<template><field name='A b' type='textEdit' required='1'><label>L</label></field><field name='c'><ui><checkButton/></ui><items><text>x</text></items></field></template>")
    assert [(x["id"], x["label"], x["type"], x["required"], x["options"]) for x in q] == [("A_b", "L", "text", True, []), ("c", "c", "checkbox", False, ["x"])]
    assert [x["name"] for x in xfa.template_questions(xfa.questions_xml(q))] == ["A b", "c"]
    data = "<datasets><data><field name='f1'><value>value1</value></field><field name='f2'><value>123</value></field><g><h>1.5</h></g></data></datasets>"
    assert [(v["path"], v["value"], v["kind"]) for v in xfa.dataset_values(data)] == [("f1", "value1", "string"), ("f2", "123", "int"), ("g.h", "1.5", "float")]
    new, unknown = xfa.update_values(data, {"f1": "a<b&", "nope": 1, "h": True})
    assert unknown == ["nope"] and [v["value"] for v in xfa.dataset_values(new)] == ["a<b&", "123", "true"]
    assert xfa.locales("<localeSet default='en_US'><locale code='en_US' name='English'><currency>USD</currency></locale></localeSet>")["locales"][0]["settings"] == {"currency": "USD"}
    assert xfa.connections("<connectionSet><connection name='c' type='http'><uri>http://x</uri></connection></connectionSet>") == [{"name": "c", "type": "http", "uri": "http://x", "properties": {}}]
    assert xfa.styles("<stylesheet><style name='s' type='t'><font family='F' size='9'/></style></stylesheet>")[0]["properties"] == {"font.family": "F", "font.size": "9"}
    assert {"path": "config/present[1]", "attribute": "renderPolicy", "value": "client"} in xfa.attributes("<config><present renderPolicy='client'><pdf version='1.7'/></present></config>")


def test_streaming(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    for i, df in enumerate((streaming.windowed_counts(src, "ts", ["event_type"]), streaming.latest_wins(src, "ts", ["user_id"], ["ts", "event_id"], ["value"]))):
        q = df.writeStream.outputMode("update").format("memory").queryName(f"s{i}").option("checkpointLocation", str(tmp_path / f"c{i}")).start()
        q.processAllAvailable()
        q.stop()
    batch = spark.read.parquet(str(tmp_path / "in"))
    assert spark.table("s0").agg(F.sum("n")).first()[0] == batch.count()
    assert spark.table("s1").count() == batch.select(F.to_date("ts"), "user_id").distinct().count()

"""The folder format: plans by size, pushed filters, pruned contents, and writes of which an attempt leaves nothing."""

import pytest
from pyspark.sql import functions as F

from docloom.sources import datasource as ds


@pytest.fixture
def folder(spark, tmp_path):
    ds.register(spark)
    for i in range(12):
        (tmp_path / f"{'a' if i % 2 else 'b'}{i}.pdf").write_bytes(b"x" * (100 * i))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "large.pdf").write_bytes(b"y" * 5000)
    (tmp_path / "other.txt").write_bytes(b"z")
    (tmp_path / "_hidden.pdf").write_bytes(b"z")
    return tmp_path


def read(spark, folder, schema=None, **options):
    r = spark.read.format("docloom").option("pattern", "*.pdf")
    for k, v in options.items():
        r = r.option(k, v)
    return (r.schema(schema) if schema else r).load(str(folder))


def test_reads_whole_files(spark, folder):
    rows = {r.name: (r.length, bytes(r.content)) for r in read(spark, folder).collect()}
    assert len(rows) == 13 and rows["large.pdf"] == (5000, b"y" * 5000) and rows["b0.pdf"] == (0, b"")


def test_partitions_by_size():
    files = [(f"p{i:02}", 100) for i in range(10)] + [("big", 1000)]
    parts = [[n for n, _ in p.files] for p in ds.planned(files, 300)]
    assert parts == [["big"], ["p00", "p01", "p02"], ["p03", "p04", "p05"], ["p06", "p07", "p08"], ["p09"]]
    assert ds.planned([], 300) == []


def test_filters_are_decided_before_files_are_opened(spark, folder):
    df = read(spark, folder).filter("name like 'a%' and length >= 500 and content is not null")
    (folder / "b2.pdf").unlink()  # a broken link cannot be read, but is never opened
    (folder / "b2.pdf").symlink_to(folder / "nowhere")
    assert {r.name for r in df.select("name").collect()} == {"a5.pdf", "a7.pdf", "a9.pdf", "a11.pdf"}
    reader = ds.FolderReader({"path": str(folder), "pattern": "*.pdf"}, df.schema)
    left = list(reader.pushFilters([ds.StringStartsWith(("name",), "a"), ds.LessThan(("length",), 400), ds.EqualTo(("content",), b"")]))
    assert left == [ds.EqualTo(("content",), b"")]
    assert sorted(n.rsplit("/", 1)[-1] for p in reader.partitions() for n, _ in p.files) == ["a1.pdf", "a3.pdf"]


def test_contents_are_read_only_where_asked_for(spark, folder, monkeypatch):
    slim = read(spark, folder, "name string, length long")
    assert slim.columns == ["name", "length"] and slim.agg(F.sum("length")).first()[0] == 100 * sum(range(12)) + 5000
    reader = ds.FolderReader({"path": str(folder), "pattern": "*.pdf"}, slim.schema)
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(ds.Files(tuple((f"{folder}/gone", n) for _, n in p.files)))) == 13


def test_writes_are_committed_whole(spark, folder, tmp_path):
    out = tmp_path / "out"
    df = read(spark, folder).select("name", "content").repartition(3)
    df.write.format("docloom").mode("append").save(str(out))
    assert {p.name: p.read_bytes() for p in out.iterdir()} == {r.name: bytes(r.content) for r in df.collect()}
    one = spark.createDataFrame([("only.pdf", bytearray(b"1"))], "name string, content binary")
    one.write.format("docloom").mode("overwrite").save(str(out))
    assert [p.name for p in out.iterdir()] == ["only.pdf"]


def test_failed_tasks_and_equal_names_leave_nothing(spark, folder, tmp_path):
    out = tmp_path / "none"
    names = lambda rows: spark.createDataFrame([(n, bytearray(b"1")) for n in rows], "name string, content binary").repartition(4)
    for rows in (["x.pdf", "y.pdf", "z.pdf", "../up.pdf"], ["x.pdf", "x.pdf", "y.pdf", "x.pdf"]):
        with pytest.raises(Exception, match="name"):
            names(rows).write.format("docloom").mode("append").save(str(out))
        assert not out.exists() or all(p.name.startswith("_attempts-") for p in out.iterdir())
        assert not out.exists() or read(spark, out).count() == 0


def test_an_attempt_that_was_not_accepted_leaves_nothing(folder, tmp_path):
    from pyspark.sql.types import _parse_datatype_string

    writer = ds.FolderWriter({"path": str(tmp_path / "o")}, _parse_datatype_string("name string, content binary"), False)
    lost, kept = writer.write(iter([("a.pdf", b"lost")])), writer.write(iter([("a.pdf", b"kept")]))
    writer.commit([kept])
    assert lost.folder != kept.folder and {p.name: p.read_bytes() for p in (tmp_path / "o").iterdir()} == {"a.pdf": b"kept"}

"""Stream filters: fixed inputs with what they read."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import codecs

#: Filters with what they read, in hexadecimal, and what that is.
VECTORS = [
    ("ASCIIHexDecode", "34383635364336433646" + "3E", "48656C6C6F"),
    ("AHx", "34383635366336633666" + "3E", "48656C6C6F"),
    ("ASCIIHexDecode", "34382036350A37" + "3E", "486570"),
    ("ASCII85Decode", b"<~87cURD]j7BEbo80~>".hex().upper(), b"Hello world!".hex().upper()),
    ("ASCII85Decode", b"<~z~>".hex().upper(), "00000000"),
    ("RunLengthDecode", "0448656C6C6F80", "48656C6C6F"),
    ("RunLengthDecode", "FC4180", "4141414141"),
    ("RL", "02486921FD2080", "48692120202020"),
    ("DCTDecode", "FFD8FFE0", "FFD8FFE0"),
    ("DCTDecode", "00112233", None),
    ("RunLengthDecode", "0548", None),
    ("FlateDecode", "00112233", None),
]


@pytest.mark.parametrize("name", sorted({n for n, _, _ in VECTORS}))
def test_vectors(spark, name):
    cases = [(x, want) for n, x, want in VECTORS if n == name]
    rows = spark.createDataFrame(cases, "x string, want string").withColumn("got", F.hex(codecs.decoded(F.unhex("x"), name)))
    assert all(r.got == r.want for r in rows.collect())


def test_hex_is_an_expression(spark):
    """Hexadecimal digits take no Python; the expression gives what the plain functions give."""
    data = [b"", b"48656c6C6f", b"48 65\t6c\n6c\r6f\x0c\x00>00", b"4>", b"486", b">48", b"4x", b"\xff48", "é".encode(), None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "i int, d binary").select("i", codecs.decoded(F.col("d"), "AHx").alias("a"), codecs.encoded(F.col("d"), "ASCIIHexDecode").alias("b"))
    assert "ArrowEvalPython" not in df._jdf.queryExecution().toString()
    plain = [codecs._quietly(f) for f in (codecs.ascii_hex_decode, codecs.ascii_hex_encode)]
    same = lambda x: None if x is None else bytes(x)
    assert [(same(r.a), same(r.b)) for r in df.orderBy("i").collect()] == [tuple(f(d) for f in plain) for d in data]


def test_dictionaries_are_read_once(spark):
    """Entries of one object by one call, in the order of the keys; broken objects give nulls."""
    from docloom.functions import objects

    df = spark.createDataFrame([(0, "<< /A (x) /B /y /C 3 >>"), (1, "<< /A"), (2, None)], "i int, raw string").select("i", objects.dict_values(F.col("raw"), ["C", "A", "no", "B"]).alias("v"))
    assert [r.v for r in df.orderBy("i").collect()] == [["3", "x", None, "y"], [None] * 4, [None] * 4]

import __spark_entry__ as entry_module


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_registry():
    names = entry_module.queries()
    assert set(entry_module.oracle_sql()) <= set(names) and "doc_summary" in names

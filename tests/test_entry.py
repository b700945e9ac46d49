import __spark_entry__ as E


def test_registry():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100


def test_entry(spark, data):
    assert E.entry(spark).count() > 0

import __spark_entry__


def test_entry_and_names(spark):
    out = __spark_entry__.entry(spark)
    assert out.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

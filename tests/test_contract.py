import __spark_entry__ as contract


def test_entry_has_rows(spark):
    df = contract.entry(spark)
    assert df.columns == ["source", "split", "shard_id", "n_tokens", "n_segments", "n_docs_started"]
    assert df.count() > 0


def test_sql_names_are_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) >= 100

from tessera.streaming import evidence


def test_last_state_of_a_key_counts_and_the_driver_holds_none(spark, tmp_path, monkeypatch):
    """Two files are two batches: a later vote changes a key's state, and no memory table is made."""
    schema = "raw_sequence string, endpoint string, source string, label int"
    for label in (1, 0):
        spark.createDataFrame([("ACDEFGH", "toxic", "a", label), (f"ACDEFGHI{'K' * label}", "toxic", "b", 1)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "votes"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "votes"))
    got = evidence.run_once(spark, stream, "two_batches", str(tmp_path / "checkpoint"))
    assert sorted(map(tuple, got.collect())) == [("ACDEFGH", "toxic", "a", "conflicting"), ("ACDEFGHI", "toxic", "b", "positive"), ("ACDEFGHIK", "toxic", "b", "positive")]
    assert not spark.catalog.tableExists("two_batches")


def test_no_files_give_no_states(spark, tmp_path):
    (tmp_path / "none").mkdir()
    stream = spark.readStream.schema("raw_sequence string, endpoint string, source string, label int").parquet(str(tmp_path / "none"))
    assert evidence.run_once(spark, stream, "no_batches", str(tmp_path / "checkpoint")).collect() == []

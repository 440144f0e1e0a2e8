import pytest

from linkforge.sources import tables


def test_round_trip(spark, tmp_path):
    (tmp_path / "s1.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-2\tNA\t\tUS\nS1-1\tAcme\t1 Rd\tUS\n")
    df = tables.read_either(spark, str(tmp_path / "s1"))
    assert [tuple(r) for r in df.orderBy("entity_id").collect()] == [("S1-1", "Acme", "1 Rd", "US"), ("S1-2", None, None, "US")]
    assert tables.read_records(spark, str(tmp_path / "s1.tsv"), first=1).first().entity_id == "S1-2"
    assert {r.entity_id for r in tables.read_ids(spark, str(tmp_path / "s1.tsv")).collect()} == {"S1-1", "S1-2"}
    pairs = spark.createDataFrame([("S1-1", "S3-2"), ("S1-1", "S2-1"), ("S1-1", "S2-1")], "source1_entity_id string, candidate_entity_id string")
    rolled = tables.roll_up(df.withColumnRenamed("entity_id", "source1_entity_id"), pairs)
    tables.write_tsv(rolled, str(tmp_path / "out"))
    lines = next((tmp_path / "out").glob("part-*")).read_text().splitlines()
    assert lines == ["source1_entity_id\tmatched_entity_ids", "S1-1\tS2-1,S3-2", "S1-2\t"]
    assert tables.explode_lists(rolled, "matched_entity_ids").count() == 2
    tables.write_empty_results(df.withColumnRenamed("entity_id", "source1_entity_id"), str(tmp_path / "none"))
    tables.write_json(spark, {"b": 1, "a": [0.86]}, str(tmp_path / "m"))
    assert tables.read_json(spark, str(tmp_path / "m")) == {"a": [0.86], "b": 1}
    with pytest.raises(FileNotFoundError):
        tables.read_either(spark, str(tmp_path / "nothing"))
    with pytest.raises(FileNotFoundError):
        tables.require(spark, str(tmp_path / "s1.tsv"), str(tmp_path / "model"))


def test_stream_appends_keys(spark, tmp_path):
    from linkforge.streaming.append import append_keys

    rows = spark.createDataFrame([("S2-1", "Acme Ltd", "1 Rd 12345", "US")], tables.RECORD)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(tables.RECORD).parquet(str(tmp_path / "in"))
    append_keys(stream, str(tmp_path / "keys"), str(tmp_path / "state")).awaitTermination(120)
    keys = {(r.kind, r.key) for r in spark.read.parquet(str(tmp_path / "keys")).collect()}
    assert ("token", "acme") in keys and ("postal", "12345") in keys


def test_header_errors():
    from linkforge.operators.validate import header_error

    assert header_error("A\tb", "a\tB") is None
    assert header_error("", "a") and header_error("a,b", "a\tb") and header_error("a\tc", "a\tb")

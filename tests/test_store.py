"""The contact table keeps survey names as text, moves ids, and deletes what it is told to."""

from pingframe.operators.store import delete_survey, read_contacts, upsert_contacts

SCHEMA = "id string, survey string, seq long, value double"


def test_table_upserts_and_deletes(spark, tmp_path):
    path = f"{tmp_path}/contacts"
    upsert_contacts(path, spark.createDataFrame([("a", "007", 1, 1.0), ("b", "line:01", 1, 2.0), ("c", "x", 1, 3.0)], SCHEMA))
    upsert_contacts(path, spark.createDataFrame([("a", "007", 2, 9.0), ("c", "line:01", 2, 4.0)], SCHEMA))
    rows = lambda: sorted((r.id, r.survey, r.value) for r in read_contacts(spark, path).collect())
    assert rows() == [("a", "007", 9.0), ("b", "line:01", 2.0), ("c", "line:01", 4.0)]
    delete_survey(path, "line:01")
    assert rows() == [("a", "007", 9.0)]

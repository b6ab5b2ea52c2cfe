"""Row numbers follow the files, whatever Spark packs together."""

from georeport.sources import gazetteer


def test_unequal_files_keep_their_order(spark, tmp_path):
    head = "name,group_id\n"
    (tmp_path / "a.csv").write_text(head + "a0,1\n")
    (tmp_path / "b.csv").write_text(head + "".join(f"b{i},1\n" for i in range(5000)))
    (tmp_path / "c.csv").write_text(head + "c0,1\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = [r["name"] for r in gazetteer.read_groups(spark, str(tmp_path)).orderBy("row_no").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert rows == ["a0", *(f"b{i}" for i in range(5000)), "c0"]

import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyforge.jobs.ingest import ingest, main
from tallyforge.sinks import catalog, writers


@pytest.fixture
def database(spark, folder):
    name = "t" + uuid.uuid4().hex
    spark.sql(f"CREATE DATABASE {name} LOCATION '{folder}/db'")
    return name


def test_statements_are_split_outside_quotes_and_comments():
    script = "SELECT ';' AS a; -- no ; end\nSELECT \"b;\" /* ; */ ; ;\n-- only a comment;\n"
    assert [s.replace("\n", " ") for s in catalog.split_statements(script)] == ["SELECT ';' AS a", "-- no ; end SELECT \"b;\" /* ; */"]


def test_escaped_quotes_in_scripts(spark):
    assert catalog.run_script(spark, r"SELECT 'it\'s; fine' AS a;").first()[0] == "it's; fine"


def test_scripts_run_in_name_order_and_stop_at_a_failure(spark, folder, database):
    scripts = Path(folder, "scripts")
    scripts.mkdir()
    Path(scripts, "2.hql").write_text(f"INSERT INTO {database}.t VALUES (1); INSERT INTO {database}.t VALUES (2)")
    Path(scripts, "1.hql").write_text(f"CREATE TABLE {database}.t (a INT) USING parquet")
    Path(scripts, "3.sql").write_text("not run")
    assert catalog.run_script_files(spark, str(scripts)) == ["1.hql", "2.hql"]
    assert spark.table(f"{database}.t").count() == 2
    with pytest.raises(RuntimeError, match="x.hql: statement 2 failed: SELEC 1"):
        catalog.run_script(spark, "SELECT 1; SELEC 1; SELECT 2", "x.hql")


def test_partitions_with_odd_values_are_dropped(spark, database):
    table = f"{database}.p"
    spark.sql(f"CREATE TABLE {table} (v INT, a STRING, b INT) USING parquet PARTITIONED BY (a, b)")
    data = [(1, "2024-09-10", 1), (2, "it's a/b=c:d", 2), (3, "x%3Ay", 3)]
    spark.createDataFrame(data, "v int, a string, b int").write.insertInto(table)
    assert catalog.drop_all_partitions(spark, table) == 3
    assert spark.table(table).count() == 0 and spark.sql(f"SHOW PARTITIONS {table}").count() == 0


def test_clone(spark, database):
    source, clone = f"{database}.s", f"{database}.s_bkp"
    spark.sql(f"CREATE TABLE {source} (v INT, s STRING) USING parquet PARTITIONED BY (s)")
    spark.createDataFrame([(1, "x")], "v int, s string").write.insertInto(source)
    catalog.clone_empty(spark, source, clone)
    assert spark.table(clone).schema == spark.table(source).schema and spark.table(clone).count() == 0
    assert catalog.table_location(spark, clone) != catalog.table_location(spark, source)
    with pytest.raises(ValueError, match="exists already"):
        catalog.clone_empty(spark, source, clone)
    with pytest.raises(ValueError, match="does not exist"):
        catalog.clone_empty(spark, f"{database}.none", f"{database}.other")


def test_partition_copy_leaves_others(spark, database, folder, rows):
    table = f"{database}.c"
    spark.sql(f"CREATE TABLE {table} (v INT, date STRING) USING parquet PARTITIONED BY (date)")
    spark.createDataFrame([(1, "2024-09-10"), (2, "2024-09-11")], "v int, date string").write.insertInto(table)
    for day in ("2024-09-10", "2024-09-11", "2024-09-10"):
        catalog.copy_partition(spark, [table], "date", day, f"{folder}/copy")
    assert rows(spark.read.schema("v int, date string").parquet(f"{folder}/copy/c")) == [(1, "2024-09-10"), (2, "2024-09-11")]


def test_inventory_and_sizes(spark, database, rows):
    spark.sql(f"CREATE TABLE {database}.b (x INT, y STRING) USING parquet")
    spark.sql(f"CREATE TABLE {database}.a (x INT) USING parquet")
    spark.sql(f"INSERT INTO {database}.b VALUES (1, 'x'), (2, 'y')")
    assert rows(catalog.table_inventory(spark, database)) == [("a", "x", 0), ("b", "x, y", 2)]
    sizes = {r["table_name"]: (r["n_files"], r["n_bytes"]) for r in catalog.table_sizes(spark, [f"{database}.b"]).collect()}
    files = list(Path(catalog.table_location(spark, f"{database}.b").removeprefix("file:")).glob("part-*"))
    assert sizes[f"{database}.b"] == (len(files), sum(f.stat().st_size for f in files))


def test_dynamic_overwrite_of_a_hot_partition(spark, folder, rows):
    base = f"{folder}/hot"
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5))
    writers.write_partitioned(spark.range(1000).withColumn("p", key), base, "p")
    writers.write_partitioned(spark.range(1).withColumn("p", F.lit("hot")), base, "p")
    read = spark.read.schema("id bigint, p string").parquet(base)
    assert read.where("p = 'hot'").count() == 1 and read.where("p <> 'hot'").count() == 666


def test_table_set(spark, folder):
    from pyspark.sql.types import StructType

    frames = {"a": spark.range(2).withColumn("day", F.lit("d")), "b": spark.range(1)}
    schemas = {"a": StructType.fromDDL("id string, day string"), "b": StructType.fromDDL("id int")}
    report = writers.table_set_to_parquet(spark, frames, schemas, {"a": f"{folder}/a"}, {"a": "day"})
    assert sorted(map(tuple, report.collect())) == [("a", "written"), ("b", "skipped: no path")]
    assert spark.read.parquet(f"{folder}/a").dtypes == [("id", "string")]


def test_one_bad_file_does_not_stop_ingest(spark, database, folder):
    import json

    spark.sql(f"CREATE TABLE {database}.t (v INT, active STRING) USING parquet")
    contents = {
        "good.csv": "v,active\n1,y\n2,n\n",
        "swapped.csv": "active,v\ny,1\n",
        "null_part.csv": "v,active\n1,\n",
        "all_null.csv": "v,active\nx,\n",
        "empty.csv": "v,active\n",
        "bad.txt": "x",
        "later.json": '{"v": 3, "active": "z"}\n',
    }
    for name, text in contents.items():
        Path(folder, name).write_text(text)
    entries = [
        {"csv_file_path": f"{folder}/{n}", "table_name": "t", "database_name": database, "hdfs_base_path": f"{folder}/out", "partition_column": "active"}
        for n in [*contents, "absent.csv"]
    ]
    entries.append({**entries[0], "table_name": "no_such_table"})
    Path(folder, "metadata.json").write_text(json.dumps({"files": entries}, indent=2))
    status = {(Path(r["file"]).name, r["table"].split(".")[1]): r for r in ingest(spark, f"{folder}/metadata.json").collect()}
    outcome = {k: r["status"] for k, r in status.items()}
    assert outcome == {
        ("good.csv", "t"): "ok", ("swapped.csv", "t"): "refused", ("null_part.csv", "t"): "refused",
        ("all_null.csv", "t"): "refused", ("empty.csv", "t"): "refused", ("bad.txt", "t"): "error",
        ("later.json", "t"): "ok", ("absent.csv", "t"): "error", ("good.csv", "no_such_table"): "error",
    }
    assert (status["good.csv", "t"]["n_rows"], status["good.csv", "t"]["n_partitions"]) == (2, 2)
    assert sorted(map(tuple, spark.read.schema("v int, active string").parquet(f"{folder}/out").collect())) == [(1, "y"), (2, "n"), (3, "z")]


def test_command_line(spark, database, folder, capfd):
    import json

    Path(folder, "scripts").mkdir()
    Path(folder, "scripts", "1.hql").write_text(f"CREATE TABLE {database}.cli (v INT, active STRING) USING parquet;")
    Path(folder, "in.csv").write_text("v,active\n1,y\n")
    entry = {"csv_file_path": f"{folder}/in.csv", "table_name": "cli", "database_name": database, "hdfs_base_path": f"{folder}/cli", "partition_column": "active"}
    Path(folder, "m.json").write_text(json.dumps({"files": [entry]}))
    main(["--select", f"{folder}/m.json", "--scripts", f"{folder}/scripts"])
    assert "ok" in capfd.readouterr().out
    assert Path(folder, "cli", "active=y").is_dir()

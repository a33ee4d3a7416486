import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyforge.jobs import customer
from tallyforge.operators import logs
from tallyforge.operators.records import edit_records, read_records
from tallyforge.sinks import writers
from tallyforge.sources import files, lines, readers


def put(folder, name, text):
    path = Path(folder, name)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_headers_must_match_the_schema(spark, folder, rows):
    good, bad = put(folder, "good.csv", "a,b\n1,x\n2,\n"), put(folder, "bad.csv", "b,a\nx,1\n")
    assert rows(readers.read_csv_with_schema(spark, good, "a int, b string")) == [(1, "x"), (2, None)]
    with pytest.raises(Exception, match="header does not conform"):
        readers.read_csv_with_schema(spark, bad, "a int, b string").collect()


def test_text_and_inferred(spark, folder):
    path = put(folder, "t.csv", "a,b\n1,2.5\n")
    assert [t for _, t in readers.read_csv_text(spark, path).dtypes] == ["string", "string"]
    assert [t for _, t in readers.read_csv_inferred(spark, path).dtypes] == ["int", "double"]


@pytest.mark.parametrize("separator", ["\t", "|", "|^"])
def test_separators(spark, folder, rows, separator):
    path = put(folder, "t.txt", separator.join("ab") + "\n" + separator.join(["1", "x^y"]) + "\n")
    assert rows(readers.read_delimited(spark, path, separator, "a int, b string", header=True)) == [(1, "x^y")]


def test_json_array_file(spark, folder, rows):
    path = put(folder, "a.json", json.dumps([{"a": 1, "b": {"c": "x"}}, {"a": 2, "b": None}], indent=2))
    df = readers.read_json(spark, path, "a int, b struct<c:string>")
    assert rows(df.select("a", "b.c")) == [(1, "x"), (2, None)]
    assert readers.read_json(spark, path).count() == 2


def test_extension_decides(spark, folder):
    assert readers.read_by_extension(spark, put(folder, "a.csv", "a\n1\n"), "a int").first()[0] == 1
    assert readers.read_by_extension(spark, put(folder, "b.json", '[{"a": 1}, {"a": 2}]'), "a int", array_file=True).count() == 2
    with pytest.raises(ValueError, match=".xml files cannot be read"):
        readers.read_by_extension(spark, "x.xml")


def test_many_csv_files_have_one_header(spark, folder, rows):
    paths = [put(folder, f"{n}.csv", f"a\n{n}\n") for n in (1, 2)]
    df = readers.read_csv_files(spark, paths, "a int")
    assert rows(df.select("a", F.regexp_extract("source_file", r"([^/]+)$", 1))) == [(1, "1.csv"), (2, "2.csv")]
    with pytest.raises(ValueError, match="not .csv"):
        readers.read_csv_files(spark, [*paths, "c.txt"])


def test_matching_names_and_hidden_files(spark, folder, rows):
    for name in ("a_1.csv", "a_2.csv", "b_1.csv", "_a_3.csv", ".a_4.csv"):
        put(folder, name, f"v\n{name}\n")
    assert rows(readers.read_matching(spark, folder, "*a_*.csv", header=True)) == [("a_1.csv",), ("a_2.csv",)]


def test_one_folder_is_selected(spark, folder):
    for name in ("x1_csv_data", "x2_csv_data", "y_csv_data", "y_other"):
        put(folder, f"{name}/f.csv", "a\n")
    listed = files.list_files(spark, folder)
    assert files.select_folder(listed, "csv_data", "y").endswith("/y_csv_data")
    with pytest.raises(ValueError, match="more than one"):
        files.select_folder(listed, "csv_data", "x")
    with pytest.raises(ValueError, match="no folder"):
        files.select_folder(listed, "csv_data", "z")


def test_files_by_time(spark, folder):
    for day in (1, 2, 3):
        os.utime(put(folder, f"f{day}", "x"), (day * 86400, day * 86400))
    listed = files.list_files(spark, folder)
    names = lambda df: sorted(r["name"] for r in df.collect())
    assert names(files.files_between(listed, "1970-01-02 00:00:00", "1970-01-03 00:00:00")) == ["f1", "f2"]
    assert names(files.files_between(listed, "1970-01-02 00:00:00", "1970-01-03 00:00:00", include_start=False)) == ["f2"]
    assert names(files.newest_file(listed)) == ["f3"]


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_are_numbered_across_splits(spark, folder, small_splits):
    put(folder, "a.log", "".join(f"line {i}\n" for i in range(1, 101)))
    put(folder, "b.log", "only\n\nthird without newline")
    assert lines.placed_lines(spark, folder).select("place.block").distinct().count() > 5
    got = lines.numbered_lines(spark, folder).collect()
    by_log = {name: sorted((r["line_no"], r["lines_from_end"], r["value"]) for r in got if r["log"].endswith(name)) for name in ("a.log", "b.log")}
    assert by_log["a.log"] == [(i, 101 - i, f"line {i}") for i in range(1, 101)]
    assert by_log["b.log"] == [(1, 3, "only"), (2, 2, ""), (3, 1, "third without newline")]


def test_counts_and_last_lines(spark, folder, small_splits, rows):
    put(folder, "a.log", "".join(f"line {i}\n" for i in range(1, 51)))
    put(folder, "b.log", "x\ny")
    name = F.regexp_extract("log", r"([^/]+)$", 1)
    counts = files.line_counts(spark, folder)
    assert rows(counts.select(name, "line_count")) == [("a.log", 50), ("b.log", 2)]
    assert rows(files.line_count_totals(counts)) == [(2, 52)]
    assert rows(files.last_lines(spark, folder).select(name, "last_line")) == [("a.log", "line 50"), ("b.log", "y")]


def test_skipping_records_of_each_file(spark, folder, rows):
    put(folder, "a.csv", "note\nnote\n1,x\n2,y\n")
    put(folder, "b.csv", "note\nnote\n3,z\n")
    df = readers.read_csv_skipping(spark, folder, 2, "n int, s string")
    assert rows(df.select("n", "s")) == [(1, "x"), (2, "y"), (3, "z")]


def test_log_outcomes(spark, folder, small_splits, rows):
    put(folder, "a.log", "Total Processed: 5\nTotal Error: 1\n" + "...\n" * 30 + "Total Processed: 9 \n+++++COMPLETE+++++\nend\n")
    put(folder, "b.log", "Total Success: 3\n" + "...\n" * 30 + "command successful\n")
    put(folder, "c.log", "command successful\nfailed\n")
    placed = lines.placed_lines(spark, folder).withColumn("log", F.regexp_extract("log", r"([^/]+)$", 1))
    assert rows(logs.log_metrics(placed)) == [("a.log", "9", None, "1"), ("b.log", None, "3", None), ("c.log", None, None, None)]
    assert rows(logs.log_metric_lines(placed)) == [("a.log", 2, 0, 1), ("b.log", 0, 1, 0), ("c.log", 0, 0, 0)]
    status = logs.run_status(placed)
    assert rows(status) == [("a.log", "success"), ("b.log", "success"), ("c.log", "failed")]
    assert rows(logs.status_totals(status)) == [("failed", 1), ("success", 2)]
    numbered = lines.numbered_lines(spark, folder)
    assert logs.last_n_lines(numbered, 20).groupBy("log").count().select("count").distinct().orderBy("count").collect() == [(2,), (20,)]
    assert [r["value"] for r in logs.line_slice(numbered, 1, 2).where("log LIKE '%c.log'").orderBy("line_no").collect()] == ["command successful", "failed"]


def test_messages(spark, folder, rows):
    header = "".join(f"<{n}>{n.lower()}</{n}>" for n in readers.HEADER_FIELDS)
    xml = f"<Messages><Message><Header>{header}</Header><SubHeader><InstrumentID>007</InstrumentID></SubHeader></Message></Messages>"
    df = readers.read_messages(spark, put(folder, "m.xml", xml))
    assert df.select("Header.*").first().asDict() == {n: n.lower() for n in readers.HEADER_FIELDS}
    assert rows(df.select("SubHeader.InstrumentID", "SubHeader.UserID")) == [("007", None)]
    text = spark.createDataFrame([(xml[len("<Messages>") : -len("</Messages>")],)], "x string")
    assert rows(readers.parse_messages(text, "x").select("message.Header.MessageID")) == [("messageid",)]


def test_database_reader_options():
    assert readers.jdbc_options("jdbc:x", "t") == {"url": "jdbc:x", "dbtable": "t"}
    split = readers.jdbc_options("jdbc:x", "t", "id", (0, 100), 8)
    assert split["partitionColumn"] == "id" and split["numPartitions"] == "8"
    with pytest.raises(ValueError):
        readers.jdbc_options("jdbc:x", "t", "id")


def test_json_written_at_a_given_time(spark, folder):
    path = writers.write_json_at(spark.range(3), folder, "2024-09-10_12-30-00")
    assert path.endswith("/2024-09-10_12-30-00.json") and spark.read.json(path).count() == 3


def test_records_are_read_and_edited_by_path(spark, folder, rows):
    data = [{"id": i, "a": {"b": [{"c": i, "d": "t"}]}, "s": "x"} for i in range(1, 6)]
    df = readers.read_json(spark, put(folder, "r.json", json.dumps(data)), "id int, a struct<b:array<struct<c:int,d:string>>>, s string")
    assert rows(read_records(df, ["id"], "a.b.0.c", 4, 9)) == [(4, 4), (5, 5)]
    edited, outcome = edit_records(df, ["id"], 2, 3, {"a.b.0.c": 99, "s": "new", "a.b.0": 1, "a.none": 1, "gone": 1})
    assert rows(edited.select("id", F.col("a.b")[0]["c"], F.col("a.b")[0]["d"], "s")) == [
        (1, 1, "t", "x"), (2, 99, "t", "new"), (3, 99, "t", "new"), (4, 4, "t", "x"), (5, 5, "t", "x"),
    ]
    assert outcome["s"] == outcome["a.b.0.c"] == "updated"
    assert "array" in outcome["a.b.0"] and "not found" in outcome["a.none"] and "not found" in outcome["gone"]
    with pytest.raises(IndexError):
        edit_records(df, ["id"], 2, 6, {"s": "new"})


def test_json_csv_job(spark, folder):
    source = put(folder, "in.csv", 't.id|t.amount|t.cells|t.run_date\n1|12.5|[{"key1":"a","key2":3}]|2024-01-01\n2|x|oops|2024-01-02\n')
    customer.json_csv_to_parquet(spark, source, "cells", f"{folder}/out", sep="|")
    out = spark.read.parquet(f"{folder}/out").orderBy("id")
    assert dict(out.dtypes)["amount"] == "decimal(12,0)" and "run_date" not in out.columns
    first, second = out.collect()
    assert (int(first["amount"]), [tuple(c) for c in first["parsed_json"]]) == (13, [("a", 3)])
    assert (second["amount"], second["parsed_json"]) == (None, None)


def test_message_lines_keep_line_breaks(spark, folder):
    fields = readers.message_schema()["Header"].dataType.names
    header = F.struct(*[F.when(F.lit(n == fields[0]), "two\nlines\r\n& more").otherwise("x").alias(n) for n in fields])
    sub = F.struct(*[F.lit("y").alias(n) for n in readers.message_schema()["SubHeader"].dataType.names])
    writers.write_message_lines(spark.range(2).select(header.alias("Header"), sub.alias("SubHeader")), f"{folder}/m")
    read = readers.read_message_lines(spark, f"{folder}/m").select(f"Header.{fields[0]}").collect()
    assert [r[0] for r in read] == ["two\nlines\r\n& more"] * 2
    spark.createDataFrame([("<Message><Header>",)], "v string").write.text(f"{folder}/bad")
    with pytest.raises(Exception, match="MALFORMED"):
        readers.read_message_lines(spark, f"{folder}/bad").collect()


def test_lines_are_found_by_an_index_of_the_splits(spark, folder, small_splits, rows):
    for name, n in (("a b.log", 400), ("p%20.log", 37), ("é#.log", 1)):
        put(folder, name, "".join(f"line {i} of {name}\n" for i in range(1, n + 1)))
    put(folder, "none.log", "")
    name = F.regexp_extract("log", r"([^/]+)$", 1)
    got = logs.log_tail(spark, folder, 20).select(name.alias("log"), "line_no", F.regexp_extract("value", "line ([0-9]+)", 1).cast("int").alias("n"))
    assert got.where("line_no <> n").count() == 0
    assert rows(got.groupBy("log").agg(F.min("line_no"), F.max("line_no"))) == [("a%20b.log", 381, 400), ("p%2520.log", 18, 37), ("é%23.log", 1, 1)]
    middle = logs.log_slice(spark, folder, 36, 38)
    assert rows(middle.groupBy(name).agg(F.collect_set("line_no"), F.count("*"))) == [("a%20b.log", [36, 37, 38], 3), ("p%2520.log", [36, 37], 2)]
    everything = lines.lines_within(spark, folder, 1, F.col("total"))
    assert rows(everything) == rows(lines.numbered_lines(spark, folder).drop("lines_from_end"))
    assert lines.line_index(spark, folder).groupBy("log").count().agg(F.max("count")).first()[0] > 5


def test_odd_names_and_empty_files_count(spark, folder, rows):
    for name, text in (("a b.log", "x\ncommand successful\n"), ("p%.log", "+++++COMPLETE+++++\ny"), ("é.log", "z\n"), ("empty one.log", "")):
        put(folder, name, text)
    name = F.url_decode(F.regexp_extract("log", r"([^/]+)$", 1))
    assert rows(files.line_counts(spark, folder).select(name, "line_count")) == [("a b.log", 2), ("empty one.log", 0), ("p%.log", 2), ("é.log", 1)]
    status = logs.run_status(lines.placed_lines(spark, folder), logs=lines.listed_logs(spark, folder))
    assert rows(status.select(name, "status")) == [("a b.log", "success"), ("empty one.log", "failed"), ("p%.log", "success"), ("é.log", "failed")]


def test_array_files_are_written_and_read(spark, folder, rows):
    df = spark.range(7).selectExpr("id", "if(id = 3, null, concat('}\"', id)) AS s").repartition(3)
    writers.write_json_arrays(df, f"{folder}/arrays")
    assert rows(readers.read_json(spark, f"{folder}/arrays", "id bigint, s string")) == rows(df)
    assert rows(spark.read.schema("id bigint, s string").json(f"{folder}/arrays", multiLine=True)) == rows(df)
    writers.write_json_arrays(df.limit(0), f"{folder}/none")
    assert readers.read_json(spark, f"{folder}/none", "id bigint, s string").count() == 0

"""Records of whole documents, read in splits of a few bytes, against the readers of whole files."""

import json
import random

import pytest

from tallyforge.sources import readers, records


@pytest.fixture
def tiny_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "61b", "spark.sql.files.openCostInBytes": "1b", "spark.sql.files.minPartitionNum": "16"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def put(folder, name, text, mode="w"):
    with open(f"{folder}/{name}", mode, **({} if "b" in mode else {"encoding": "utf-8", "newline": ""})) as f:
        f.write(text)
    return f"{folder}/{name}"


SCHEMA = "id bigint, s string, a array<struct<b:bigint,t:string>>, m struct<x:struct<y:string>>"
NASTY = ['"', "\\", '\\"', "{", "}", "[", "]", "}]", '"}', "\\}", "é}", "\n", "},{", "☃", "\\\\", ", ", ""]


def made_rows(seed, n):
    made = random.Random(seed)

    def text():
        return "".join(made.choices(NASTY, k=made.randint(0, 6)))

    return [
        {"id": i, "s": text(), "a": [{"b": j, "t": text()} for j in range(made.randint(0, 3))], "m": {"x": {"y": text()}}} for i in range(n)
    ]


@pytest.mark.parametrize(("indent", "ascii_only"), [(None, True), (2, False)])
def test_array_files_are_cut_where_records_end(spark, folder, tiny_splits, rows, indent, ascii_only):
    for k in range(3):
        put(folder, f"f{k}.json", json.dumps(made_rows(k, 12), indent=indent, ensure_ascii=ascii_only))
    found = records.pieces(spark, [folder], "}")
    assert found.select("file", "block").distinct().count() > 20
    want = spark.read.schema(SCHEMA).json(folder, multiLine=True)
    got = readers.read_json(spark, folder, SCHEMA)
    assert rows(got) == rows(want) and got.count() == 36
    inferred = readers.read_json(spark, folder)
    assert rows(inferred) == rows(spark.read.json(folder, multiLine=True))


@pytest.mark.parametrize(
    "text",
    ["[]", " [ ] \n", "", "  \n", '{"id": 1}', ' {"id": 1, "m": {"x": {"y": "}"}}}', '{"id": 1}\n', '[{"id": 1}]', '[{"id": 1},\n{"id": 2}]\n', '﻿[{"id": 1}]', '[{},{"m":{"x":{}}}]'],
)
def test_small_documents(spark, folder, tiny_splits, rows, text):
    path = put(folder, "one.json", text)
    want = [] if not text.strip() else rows(spark.read.schema(SCHEMA).json(path, multiLine=True))
    assert rows(readers.read_json(spark, path, SCHEMA)) == want


@pytest.mark.parametrize(
    "text", ['[{"id": 1}, {"id": 2}', '{"a": {"b": 1}\n', '[{"id": 1}, 5]', '[5, {"id": 1}]', '[[{"id": 1}]]', '[{"id": "1}]', "5", '[{"a": [1}]']
)
def test_what_is_no_array_of_objects_is_an_error(spark, folder, tiny_splits, text):
    with pytest.raises(Exception, match="ValueError"):
        readers.read_json(spark, put(folder, "bad.json", text), SCHEMA).collect()


def test_a_record_over_many_splits_and_many_records_in_one(spark, folder, tiny_splits, rows):
    data = [{"id": 1, "s": "}{" * 900}, {"id": 2, "s": "x"}, {"id": 3, "s": '"' * 400}] + [{"id": i} for i in range(4, 60)]
    path = put(folder, "long.json", json.dumps(data))
    assert rows(readers.read_json(spark, path, SCHEMA)) == rows(spark.read.schema(SCHEMA).json(path, multiLine=True))


def test_one_file_is_read_by_many_tasks(spark, folder, tiny_splits):
    path = put(folder, "long.json", json.dumps(made_rows(1, 50)))
    found = records.records(spark, [path], records.JsonArrays())
    assert found.count() == 50 and records.pieces(spark, [path], "}").rdd.getNumPartitions() > 20


def test_compressed_files_are_one_split(spark, folder, rows):
    import gzip

    path = put(folder, "z.json.gz", gzip.compress(json.dumps(made_rows(5, 20)).encode()), "wb")
    assert rows(readers.read_json(spark, path, SCHEMA)) == rows(spark.read.schema(SCHEMA).json(path, multiLine=True))


def test_other_splits_in_the_second_pass_are_an_error(spark, folder, monkeypatch):
    path = put(folder, "f.json", json.dumps(made_rows(1, 5)))
    true = records.split_states
    moved = lambda found, kind: true(found, kind).selectExpr("file", "block + 1 AS block", "length", "state", "depth", "floor", "rest")
    monkeypatch.setattr(records, "split_states", moved)
    with pytest.raises(Exception, match="split in another way"):
        records.records(spark, [path], records.JsonArrays()).collect()


def message(i, text):
    return f'<Message n="{i}>">\n  <Header><DestinationID>{text}</DestinationID></Header>\n  <SubHeader><UserID>u{i}</UserID></SubHeader>\n</Message>'


def test_messages_over_several_lines(spark, folder, tiny_splits, rows):
    parts = [message(i, t) for i, t in enumerate(["a", "<![CDATA[</Message>]]>", "b <!-- </Message> --> c", "é&amp;", "", "<![CDATA[<!-- ]]>x"] * 4)]
    text = '<?xml version="1.0"?>\n<!-- <Message> -->\n<Messages>\n' + "\n<!-- between </Message> -->".join(parts) + "<Message/><Messages2/>\n</Messages>\n"
    path = put(folder, "m.xml", text)
    got = readers.read_messages(spark, path).selectExpr("Header.DestinationID AS d", "SubHeader.UserID AS u")
    assert got.count() == 25
    want = spark.read.schema(readers.message_schema()).xml(path, rowTag="Message").selectExpr("Header.DestinationID AS d", "SubHeader.UserID AS u")
    assert rows(got) == rows(want)
    assert records.pieces(spark, [path], "</Message>").rdd.getNumPartitions() > 20


@pytest.mark.parametrize("text", ["<M><Message><a>1</a></M>", "<M><Message>1</Message >x<Message>2</Message></M>", "<M>1</Message></M>"])
def test_broken_xml_is_an_error(spark, folder, tiny_splits, text):
    with pytest.raises(Exception, match="ValueError"):
        records.records(spark, [put(folder, "m.xml", text)], records.XmlRecords("Message")).collect()


def test_a_folder_without_records(spark, folder):
    put(folder, "m.xml", "<Messages></Messages>")
    assert readers.read_messages(spark, folder).count() == 0


def test_compressed_documents_of_any_size(spark, folder):
    """A compressed file's size says nothing of its last piece, even if it happens to be what the text would have."""
    import gzip

    from pyspark.sql import types as T

    for k in range(80):
        # Bytes of the file and of its text move past each other.
        put(folder, f"f{k}.xml.gz", gzip.compress(f"<R><a>{'x' * k}</a></R>\n".encode(), mtime=0), "wb")
    read = readers.read_xml(spark, [folder], T.StructType([T.StructField("a", T.StringType())]), "R")
    assert read.count() == 80


def test_messages_are_written_compact_and_in_files_of_bounded_size(spark, folder, rows):
    from pathlib import Path

    from pyspark.sql import functions as F

    from tallyforge.sinks import writers

    def part(fields):
        return F.struct(*[F.concat(F.lit(f"{f} <&>\n"), "id").alias(f) for f in fields])

    df = spark.range(0, 1000, 1, 2).select(part(readers.HEADER_FIELDS).alias("Header"), part(readers.SUBHEADER_FIELDS).alias("SubHeader"))
    writers.write_messages(df, f"{folder}/x", file_rows=200)
    files = [p for p in Path(f"{folder}/x").iterdir() if p.name.startswith("part-")]
    assert len(files) == 6 and sum(p.stat().st_size for p in files) < 300 * 1000
    assert rows(readers.read_messages(spark, f"{folder}/x")) == rows(df)


def test_message_documents_of_the_query_take_little_room(spark, monkeypatch, folder):
    from pathlib import Path

    from tallyforge.plans import QUERIES, file_io

    monkeypatch.setattr(file_io, "scratch_path", lambda spark, label: f"{folder}/{label}")
    n = QUERIES["xml_records"](spark, "/root/testdata/sf0.001").count()
    assert sum(p.stat().st_size for p in Path(f"{folder}/xml").rglob("part-*")) < 300 * n

"""Sources, tables and streams on temporary folders."""

import json

import pytest
from pyspark.sql import functions as F

from lexiloom.catalog.fixtures import log_of, status_of
from lexiloom.operators.requests import flat_log, last_requests, request_stats, without_answers
from lexiloom.operators.status import current_state
from lexiloom.plans.ingest import ingest_documents, ingest_new
from lexiloom.sources import chunk_table as T, documents as D, email as E, files as FI, request_log as Q
from lexiloom.streaming import jobs as J

SF = "/root/testdata/sf0.001"


def plain(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_markdown_directory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.md").write_text("B one. B two.")
    (tmp_path / "sub" / "a.md").write_text("A one.")
    (tmp_path / "skip.txt").write_text("no")
    chunks = D.directory_chunks(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [c.ordinal for c in chunks] == list(range(len(chunks)))
    assert {c.chunk_prefix for c in chunks} == {chunks[0].chunk_id[:8]}
    assert " ".join(c.text for c in chunks) == "B one. B two. A one."


def test_file_metadata(spark, tmp_path):
    (tmp_path / "x.PDF").write_bytes(b"0" * 2048)
    rows = FI.file_metadata(spark, str(tmp_path))
    row = rows.first()
    assert (row.extension, row.size_bytes, row.size_mb, row.is_pdf, row.is_large_file) == (".pdf", 2048, 0.0, True, False)
    missing = FI.metadata_for(spark.createDataFrame([("nowhere",)], "path string"), rows).first()
    assert missing.size_bytes is None
    assert "content" not in rows._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]


def test_email_details(spark, tmp_path):
    (tmp_path / "m.eml").write_bytes(
        b'From: a@x\nSubject: Hi\nContent-Type: multipart/mixed; boundary="b"\n\n--b\nContent-Type: text/html; charset=utf-8\n\n'
        + "<p>café</p><style>x</style>".encode()
        + b'\n--b\nContent-Type: image/png\nContent-Disposition: inline\n\nAA==\n--b\n'
        b'Content-Type: text/plain; charset=nope\n\nlost\n--b--\n')
    (tmp_path / "n.eml").write_bytes(b"\n")
    rows = {r.stem: r for r in E.read_emails(spark, str(tmp_path)).collect()}
    assert rows["m"].body == "café" and rows["m"].has_attachments and rows["m"].attachments == []
    assert (rows["n"].subject, rows["n"].sender, rows["n"].recipient, rows["n"].date) == (
        "No Subject", "Unknown Sender", "Unknown Recipient", "Unknown Date")
    text = {r.url.rsplit("/", 1)[1]: r.text for r in E.email_documents(E.read_emails(spark, str(tmp_path))).collect()}
    assert text["n.eml"] == ("# Email: n\n\nSubject: No Subject\nFrom: Unknown Sender\nTo: Unknown Recipient\n"
                             "Date: Unknown Date\nContent-Type: text/plain\n")


def test_json_days(spark, tmp_path):
    record = {"request_id": "1", "unix_timestamp": 5.0, "request": {"documents": "u", "questions": ["q"]},
              "response": {"answers": ["a"], "processing_time": 1.5}}
    (tmp_path / "requests_2024-01-01.json").write_text(json.dumps([record, {**record, "request_id": "2", "unix_timestamp": None}]))
    (tmp_path / "requests_2024-01-02.json").write_text("[{broken")
    (tmp_path / "requests_2024-01-03.json").write_text(json.dumps(record))
    (tmp_path / "requests_2024-01-04.json").write_text("[]")
    log = Q.read_json_days(spark, str(tmp_path))
    assert [(r.request_id, str(r.log_date)) for r in log.orderBy("request_id").collect()] == [("1", "2024-01-01"), ("2", "2024-01-01")]
    assert [r.request_id for r in last_requests(log, 1).collect()] == ["1"]
    assert "answers" not in without_answers(log).select("response.*").columns
    stats = request_stats(flat_log(log)).first()
    assert (stats.total_requests, stats.total_questions, stats.unique_documents, stats.avg_processing_time) == (2, 2, 1, 1.5)
    path = str(tmp_path / "table")
    Q.append_log(log, path)
    Q.append_log(log, path)
    table = Q.read_log(spark, path, log.schema, "2024-01-01")
    assert table.count() == 4 and Q.read_log(spark, path, log.schema, "2024-01-09").count() == 0
    assert "PartitionFilters: [isnotnull(log_date" in table._jdf.queryExecution().executedPlan().toString()
    assert Q.read_log(spark, str(tmp_path / "none"), log.schema).count() == 0


def docs(spark, *texts):
    return spark.createDataFrame([(f"u{i}", t) for i, t in enumerate(texts)], "url string, text string")


def test_upsert_is_idempotent_and_leaves_no_tail(spark, tmp_path):
    path = str(tmp_path / "t")
    first = docs(spark, "a b. c d. e f. g h. i j. k l.", "x y. z.")
    assert T.open_chunks(spark, path).count() == 0
    ingest_documents(spark, first, path)
    before = plain(T.open_chunks(spark, path).drop("metadata"))
    ingest_documents(spark, first, path)
    assert plain(T.open_chunks(spark, path).drop("metadata")) == before
    ingest_documents(spark, docs(spark, "short now."), path)
    table = T.open_chunks(spark, path)
    prefix = {r.chunk_prefix: r.text for r in table.collect()}
    assert table.count() == 2 + len(before) - len([b for b in before if b[0].startswith(table.where("text = 'short now.'").first().chunk_prefix)]) - 1
    assert "short now." in prefix.values()
    chosen = table.where("text = 'short now.'").first().chunk_id
    got = T.get_chunks(table, [chosen], ["text"])
    assert [tuple(r) for r in got.collect()] == [(chosen, "short now.")]
    assert "PartitionFilters: [" in got._jdf.queryExecution().executedPlan().toString()


def test_new_documents_only(spark, tmp_path):
    path = str(tmp_path / "t")
    ingest_new(spark, docs(spark, "one. two."), path)
    ingest_new(spark, docs(spark, "changed.", "three."), path)
    assert sorted(r.text for r in T.open_chunks(spark, path).collect()) == ["one. two.", "three."]


def test_mapping_roundtrip(spark, tmp_path):
    path = str(tmp_path / "m")
    assert T.load_mapping(spark, path).count() == 0
    T.save_mapping(spark.createDataFrame([("h", "c")], "doc_hash string, cache_name string"), path)
    T.save_mapping(T.load_mapping(spark, path), path)
    assert plain(T.load_mapping(spark, path)) == [("h", "c")]
    assert T.load_mapping(spark, path, cache_enabled=False).count() == 0


@pytest.fixture(scope="module")
def event_files(spark, tmp_path_factory):
    """The events in several files, oldest first, so that a stream takes several micro-batches."""
    base = tmp_path_factory.mktemp("events")
    events = spark.read.parquet(f"{SF}/events.parquet")
    for i in range(4):
        part = events.where((F.col("event_id") >= 250 * i) & (F.col("event_id") < 250 * (i + 1)))
        part.coalesce(1).write.mode("append").parquet(str(base))
    return str(base)


def stream(spark, path):
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    return log_of(events, spark.read.parquet(f"{SF}/pages.parquet"))


def batch_log(spark):
    return log_of(spark.read.parquet(f"{SF}/events.parquet"), spark.read.parquet(f"{SF}/pages.parquet"))


def test_stream_statistics_equal_batch(spark, event_files, tmp_path):
    J.run_to_end(J.change_writer(J.daily_counts(stream(spark, event_files)), str(tmp_path / "c")), str(tmp_path / "p1"))
    J.run_to_end(J.seen_writer(J.daily_documents(stream(spark, event_files)), str(tmp_path / "s")), str(tmp_path / "p2"))
    assert len(list((tmp_path / "c").glob("batch=*"))) >= 4
    final = J.finished_stats(J.latest_changes(spark, str(tmp_path / "c"), ["log_date"]), spark.read.parquet(str(tmp_path / "s")))
    expected = request_stats(batch_log(spark)).select(*final.columns)
    assert plain(final) == plain(expected)


def test_late_days_reach_the_result(spark, tmp_path):
    """Files with the newest days first, a micro-batch each: nothing is dropped as late."""
    events, source = spark.read.parquet(f"{SF}/events.parquet"), tmp_path / "late"
    for i in (3, 1, 2, 0):
        events.where((F.col("event_id") >= 250 * i) & (F.col("event_id") < 250 * (i + 1))).coalesce(1).write.mode("append").parquet(str(source))
    J.run_to_end(J.change_writer(J.daily_counts(stream(spark, str(source))), str(tmp_path / "c")), str(tmp_path / "p1"))
    J.run_to_end(J.seen_writer(J.daily_documents(stream(spark, str(source))), str(tmp_path / "s")), str(tmp_path / "p2"))
    final = J.finished_stats(J.latest_changes(spark, str(tmp_path / "c"), ["log_date"]), spark.read.parquet(str(tmp_path / "s")))
    assert plain(final) == plain(request_stats(batch_log(spark)).select(*final.columns))
    first = J.first_submissions(stream(spark, str(source)).where("documents <> ''"), "documents").select("doc_hash")
    J.run_to_end(first.writeStream.format("parquet").option("path", str(tmp_path / "f")), str(tmp_path / "p3"))
    got = [r.doc_hash for r in spark.read.parquet(str(tmp_path / "f")).collect()]
    from lexiloom.functions.urls import doc_hash
    expected = {r[0] for r in batch_log(spark).where("documents <> ''").select(doc_hash(F.col("documents"))).collect()}
    assert len(got) == len(set(got)) and set(got) == expected


def test_stream_status_equals_batch(spark, event_files, tmp_path):
    J.run_to_end(J.change_writer(J.status_updates(status_of(stream(spark, event_files))), str(tmp_path / "c")), str(tmp_path / "p"))
    assert plain(J.latest_changes(spark, str(tmp_path / "c"), ["document_id"])) == plain(current_state(status_of(batch_log(spark))))


def test_stream_resumes_without_repeating(spark, event_files, tmp_path):
    for _ in range(2):
        J.run_to_end(J.log_writer(stream(spark, event_files), str(tmp_path / "log")), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 1000


def test_stream_ingest_skips_known_documents(spark, tmp_path):
    source, table = tmp_path / "docs", str(tmp_path / "table")
    docs(spark, "one. two.").coalesce(1).write.parquet(str(source))
    docs(spark, "changed.", "three.").coalesce(1).write.mode("append").parquet(str(source))
    arriving = spark.readStream.schema("url string, text string").option("maxFilesPerTrigger", 1).parquet(str(source))
    for _ in range(2):
        J.run_to_end(J.ingest_writer(arriving, table, digits=1), str(tmp_path / "p"))
    texts = sorted(r.text for r in T.open_chunks(spark, table).collect())
    assert texts in (["one. two.", "three."], ["changed.", "three."])


def test_documents_with_an_equal_prefix_stay_apart(spark, tmp_path):
    from lexiloom.functions.urls import chunk_prefix
    from lexiloom.plans.ingest import ingest_documents, ingest_new
    from lexiloom.sources.chunk_table import count_chunks, open_chunks
    from pyspark.sql import functions as F

    def one(url, text):
        return spark.createDataFrame([(url, text)], "url string, text string")

    a, b = "doc/99", "doc/16495"
    assert len({r[0] for r in one(a, "x").union(one(b, "x")).select(chunk_prefix(F.col("url"))).collect()}) == 1
    for name, second in (("replace", lambda p: ingest_documents(spark, one(b, "B text."), p)), ("upsert", lambda p: ingest_documents(spark, one(b, "B text."), p, "upsert")),
                         ("new", lambda p: ingest_new(spark, one(b, "B text."), p))):
        path = str(tmp_path / name)
        ingest_documents(spark, one(a, "A text."), path)
        second(path)
        assert sorted(r.text for r in open_chunks(spark, path).collect()) == ["A text.", "B text."], name
        assert tuple(count_chunks(open_chunks(spark, path)).first()) == (2, 2)
    path = str(tmp_path / "versions")
    ingest_documents(spark, one(a, "Older.").union(one(a, "Wins.")), path)
    ingest_new(spark, one(a, "Ignored.").union(one(b, "B text.")), path)
    assert sorted(r.text for r in open_chunks(spark, path).collect()) == ["B text.", "Wins."]


def test_names_of_files_are_not_held_by_the_driver(spark, tmp_path):
    """r04 F5: a folder of many files is listed into a table; rows, addresses and names are those of Spark's own reader."""
    for folder in ("", "s/t", ".z", "_x", "_x=1", "_metadata", "dir.md", "sp ace", "none"):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
    for name, content in {
        "a b%20é+#?.md": b"x", "e.md": b"", "s/_h.md": b"h", "_x/y.md": b"h", "_x=1/y.md": b"k", ".z/y.md": b"h", "bad.md": b"\xff\xfe\xc3(",
        "bom.md": "﻿q\r\nz".encode(), "U.MD": b"u", "_metadata.md": b"m", "_metadata/m.md": b"mm", "s/t/deep.md": b"deep",
        "dir.md/in.md": b"yes", "ö[]{}|^\"\\ <>`~!@$&*()=;,.md": b"odd", "sp ace/x%.md": b"sp", "two.md.gz": b"no",
    }.items():
        (tmp_path / name).write_bytes(content)
    for i in range(40):
        (tmp_path / "s" / f"{i}.md").write_text(f"Text {i}.")
    (tmp_path / "lost.md").symlink_to(tmp_path / "nothing")

    def rows(files):
        return sorted(files.select("url", F.hex("text").alias("text"), F.to_json("metadata").alias("metadata")).collect())

    own = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md")
    for path in (str(tmp_path), f"file://{tmp_path}/", str(tmp_path / "s"), str(tmp_path / "none"), str(tmp_path / "bad.md"), f"{tmp_path}/*.md"):
        files = own.text(path, wholetext=True)
        wanted = files.select(
            F.col("_metadata.file_path").alias("url"), F.col("value").alias("text"), F.create_map(F.lit("n"), F.col("_metadata.file_name")).alias("metadata")
        ).select("url", "text", F.create_map(F.lit("file_name"), F.col("metadata.n")).alias("metadata"))
        assert rows(D.read_markdown(spark, path)) == rows(wanted), path
    found = D.read_markdown(spark, str(tmp_path))
    assert found.count() > 40 and not [f for f in found.inputFiles() if f.endswith(".md")]


def test_files_are_read_by_as_many_tasks_as_they_ask_for(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(D, "READ_FILES", 4)
    monkeypatch.setattr(D, "_LISTED_AT_ONCE", 7)
    monkeypatch.setattr(D, "_SENT_BYTES", 30)
    for i in range(90):
        (tmp_path / f"{i:03}.md").write_text(f"Text {i}. " * (i % 9 + 1))
    found = D.read_markdown(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 23
    assert sorted(r.text for r in found.collect()) == sorted(f"Text {i}. " * (i % 9 + 1) for i in range(90))

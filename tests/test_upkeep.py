"""Versioned chunk table, quantised neighbours, pattern automata, status machine and stored rollups."""

import datetime as dt
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.functions import vectors as V
from lexiloom.operators import knn as N, quantised as Q, substring as S
from lexiloom.operators.requests import request_stats
from lexiloom.sources import chunk_table as T, request_log as R
from lexiloom.streaming import jobs as J, machine as M, rollup as U

SF = "/root/testdata/sf0.001"
LOG = "log_date date, documents string, question_count int, processing_time double, answers array<string>"


# ---- chunk table


def batch(spark, **documents):
    rows = [
        (f"{k}_{i}", f"{zlib.crc32(k.encode()):08x}", k, i, text, [0.5] * 64, {"source": k})
        for k, texts in documents.items() for i, text in enumerate(texts)
    ]
    return spark.createDataFrame(rows, T.CHUNK)


def texts(table):
    return sorted((r.doc_key, r.ordinal, r.text) for r in table.select("doc_key", "ordinal", "text").collect())


def files(folder):
    return {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_a_batch_leaves_every_stored_file_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    T.save_chunks(spark, path, batch(spark, a=["a0", "a1", "a2"], b=["b0"], c=["c0", "c1"]), digits=1)
    before = files(tmp_path / "t" / "data")
    T.save_chunks(spark, path, batch(spark, a=["A0"]), digits=1)
    T.save_chunks(spark, path, batch(spark, c=["c0", "C1", "C2"]), "upsert", digits=1)
    after = files(tmp_path / "t" / "data")
    assert before.items() <= after.items()
    want = [("a", 0, "A0"), ("b", 0, "b0"), ("c", 0, "c0"), ("c", 1, "C1"), ("c", 2, "C2")]
    assert texts(T.open_chunks(spark, path)) == want
    T.save_chunks(spark, path, batch(spark, c=["c0", "C1", "C2"]), "upsert", digits=1)
    assert texts(T.open_chunks(spark, path)) == want and T.committed(spark, path) == 4
    assert texts(T.open_chunks(spark, path, 1)) == [("a", 0, "a0"), ("a", 1, "a1"), ("a", 2, "a2"), ("b", 0, "b0"), ("c", 0, "c0"), ("c", 1, "c1")]


def test_empty_and_failed_batches_are_no_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    T.save_chunks(spark, path, batch(spark), digits=1)
    assert T.committed(spark, path) == 0 and texts(T.open_chunks(spark, path)) == []
    T.save_chunks(spark, path, batch(spark, a=["a0"], b=["b0"]), digits=1)
    # A writer that was lost before its commit: rows and log are there, the version is not.
    torn = batch(spark, a=["torn"], z=["torn"]).withColumn(T.BUCKET, T.bucket_of(F.col("chunk_prefix"), 1))
    torn.write.partitionBy(T.BUCKET).parquet(f"{path}/data/version=2")
    assert texts(T.open_chunks(spark, path)) == [("a", 0, "a0"), ("b", 0, "b0")]
    T.save_chunks(spark, path, batch(spark, b=["B0"]), digits=1)
    assert texts(T.open_chunks(spark, path)) == [("a", 0, "a0"), ("b", 0, "B0")]


def test_compaction_keeps_the_content(spark, tmp_path):
    path, draw = str(tmp_path / "t"), random.Random(5)
    want = {}
    for version in range(5):
        documents = {f"d{draw.randrange(30)}": [f"{version}.{i}" for i in range(draw.randrange(1, 4))] for _ in range(12)}
        mode = "replace" if version % 2 == 0 else "upsert"
        T.save_chunks(spark, path, batch(spark, **documents), mode, digits=1)
        for k, held in documents.items():
            kept = {} if mode == "replace" else want.get(k, {})
            want[k] = kept | dict(enumerate(held))
        if version == 2:
            assert T.compact(spark, path, 0.3)
            last = T.committed(spark, path)
            assert T.compact(spark, path, 1.1) == [] and T.committed(spark, path) == last
    flat = sorted((k, i, t) for k, held in want.items() for i, t in held.items())
    assert texts(T.open_chunks(spark, path)) == flat
    T.compact(spark, path, 0.0)
    stored, _ = T.stored_rows(spark, path, T.committed(spark, path))
    assert stored.count() == len(flat) and T.vacuum(spark, path) > 0
    assert texts(T.open_chunks(spark, path)) == flat
    got = T.get_chunks_of(T.open_chunks(spark, path), spark.createDataFrame([("none_0",)], "chunk_id string"), ["text"], digits=1)
    assert got.collect() == []


@pytest.mark.parametrize("small", [0, 4 << 20, "mixed"])
def test_compaction_shuffles_only_small_files(spark, tmp_path, monkeypatch, small):
    """F16: rows lie in their buckets already; only buckets of small files are merged by a shuffle."""
    path = str(tmp_path / "t")
    documents = {f"d{i}": [f"{i}.{n} " * (1 + 400 * (i % 7 == 0)) for n in range(3)] for i in range(40)}
    T.save_chunks(spark, path, batch(spark, **documents), digits=1)
    changed = {k: texts_[:1] for k, texts_ in documents.items()}
    T.save_chunks(spark, path, batch(spark, **changed), digits=1)
    sizes = sorted(p.stat().st_size for p in files(tmp_path / "t" / "data"))
    monkeypatch.setattr(T, "SMALL_FILE", sizes[len(sizes) // 2] if small == "mixed" else small)
    moved, frame = [], type(spark.range(1))
    hint = frame.hint
    # The operator makes the hinted branch in any case; it counts where rows come to it.
    monkeypatch.setattr(frame, "hint", lambda df, *a: moved.append(df.count()) or hint(df, *a))
    assert T.compact(spark, path, 0.0)
    assert {0: moved == [0], 4 << 20: moved == [40], "mixed": 0 < sum(moved) < 40}[small]
    plan = T.open_chunks(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert texts(T.open_chunks(spark, path)) == sorted((k, 0, t[0]) for k, t in changed.items())
    assert "Join" not in plan  # no row is older than the last change
    stored, _ = T.stored_rows(spark, path, T.committed(spark, path))
    assert stored.count() == 40 and T.vacuum(spark, path) > 0


def test_vectors_are_computed_where_rows_are_written(spark, tmp_path, monkeypatch):
    """F13, F16, F17: a batch without vectors is dealt to its buckets before they are computed."""
    seen, complete = [], T.complete_vectors
    monkeypatch.setattr(T, "complete_vectors", lambda rows, e: seen.append((rows.columns, str(rows._jdf.logicalPlan()))) or complete(rows, e))
    rows = batch(spark, a=["Two words", "été", ""], b=["one"]).withColumn("text", F.when(F.col("text") != "", F.col("text")))
    T.save_chunks(spark, str(tmp_path / "t"), rows.drop("embedding"), digits=1)
    (columns, plan), = seen
    assert "embedding" not in columns and "rebalance" in plan.lower()
    held = {r.chunk_id: list(r.embedding) for r in T.open_chunks(spark, str(tmp_path / "t")).collect()}
    assert held == {r.chunk_id: list(r.v) for r in rows.select("chunk_id", V.term_vector(F.col("text")).alias("v")).collect()}


@pytest.mark.parametrize("dim", [64, 48, 1])
def test_vectors_of_a_table_take_one_pass(spark, dim):
    """a text's terms are counted in one pass over Arrow batches, bytes are named once a text."""
    texts = ["", None, "...", "One two, TWO two", "été Straße \u0130\u03a3 \U0001d7d8 x_y", "word " * 5_000] + [f"row {i}" for i in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    found = V.with_term_vector(rows, "text", dim=dim)
    assert "ArrowEvalPython" in found._jdf.queryExecution().executedPlan().toString()
    bare = F.coalesce("text", F.lit(""))
    plain = F.transform(V.tokens(bare), lambda t: F.char(V.bucket(t, dim) + V._FIRST_CODE))
    wanted = rows.select("i", F.array_join(plain, "").alias("codes"), V.counts(F.array_join(plain, ""), dim).alias("v"))
    assert {r.i: r.embedding for r in found.collect()} == {r.i: r.v for r in wanted.collect()}
    assert rows.select("i", V.encode(F.col("text"), dim).alias("codes")).exceptAll(wanted.select("i", "codes")).isEmpty()


def test_a_table_keeps_its_embedding(spark, tmp_path):
    path = str(tmp_path / "t")
    three = V.model_embedding("three", 3, lambda: lambda found: [[float(len(t)), 1.0, 0.0] for t in found])
    rows = batch(spark, a=["long text", "x"]).drop("embedding")
    T.save_chunks(spark, path, rows, digits=1, embedding=three)
    assert T.table_embedding(spark, path) == ("three", 3)
    assert sorted(r.embedding[0] for r in T.open_chunks(spark, path).collect()) == [1.0, 9.0]
    with pytest.raises(ValueError, match="three"):
        T.save_chunks(spark, path, rows, digits=1)
    assert T.committed(spark, path) == 1


def test_day_files_are_read_element_by_element(spark, tmp_path):
    import json

    records = [{"request_id": f"r{i}", "request": {"documents": "u", "questions": ["{", "}]"]}, "response": {"answers": [f"a\n{i}", "[ {"]}} for i in range(400)]
    whole = json.dumps(records, indent=2)
    (tmp_path / "requests_2024-01-01.json").write_text(whole)
    (tmp_path / "requests_2024-01-02.json").write_text(json.dumps(records[:3], indent=2).replace('"r1"', '"r1'))
    (tmp_path / "requests_2024-01-03.json").write_text(whole[: len(whole) // 2])
    (tmp_path / "requests_2024-01-04.json").write_text("[]")
    (tmp_path / "other.json").write_text(whole)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        elements = R.split_json_days(spark, str(tmp_path)).cache()
        days = {}
        for r in R.json_records(elements).collect():
            days.setdefault(str(r.log_date), []).append(r)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r.request_id for r in days["2024-01-01"]) == sorted(r["request_id"] for r in records)
    assert all(r.response.answers == [f"a\n{r.request_id[1:]}", "[ {"] for r in days["2024-01-01"])
    assert sorted(r.request_id for r in days["2024-01-02"]) == ["r0", "r2"]
    assert 190 <= len(days["2024-01-03"]) <= 200 and set(days) == {"2024-01-01", "2024-01-02", "2024-01-03"}
    damaged = R.damaged_elements(elements).collect()
    assert sorted(str(r.log_date) for r in damaged) == ["2024-01-02", "2024-01-03"] and all(r.body for r in damaged)


# ---- quantised neighbours


@pytest.fixture(scope="module")
def vectors():
    draw = np.random.default_rng(3)
    points = draw.normal(size=(1500, 48)).astype(np.float32)
    points[10] = points[11]
    points[12] = 0
    return [(i, v.tolist()) for i, v in enumerate(points)] + [(5000, None)]


def test_quantised_recall_and_exact_distances(spark, vectors):
    corpus = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(5)
    asked = corpus.where("vec_id % 10 = 0 or vec_id = 5000").withColumnRenamed("vec_id", "query_id")
    exact = {(r.query_id, r.vec_id): r.distance for r in N.knn(asked, corpus, 10, item_id="vec_id").collect()}
    got = Q.quantised_knn(asked, corpus, 10, item_id="vec_id", depth=100).collect()
    near = {(r.query_id, r.vec_id): r.distance for r in got}
    both = exact.keys() & near.keys()
    assert len(both) / len(exact) >= 0.9 and all(exact[p] == near[p] for p in both)
    assert {r.query_id for r in got} == {i for i, _ in vectors if i % 10 == 0 and i != 5000} and len(got) == len(exact)
    assert near.keys() >= {(i, i) for i in range(0, 1500, 10)}


def test_quantised_plans_and_stored_codes_agree(spark, vectors):
    corpus = spark.createDataFrame(vectors[:400] + vectors[-1:], "vec_id long, embedding array<float>")
    asked = corpus.where("vec_id < 60").withColumnRenamed("vec_id", "query_id")
    book = Q.draw_codebook(corpus, "vec_id", "embedding")
    codes = Q.encode(corpus, "vec_id", "embedding", book)
    assert codes.count() == 400 and {len(r.code) for r in codes.collect()} == {Q.PARTS}
    options = dict(k=5, item_id="vec_id", depth=20, codes=codes, book=book)
    scan = Q.quantised_knn(asked, corpus, **options)
    tiled = Q.quantised_knn(asked, corpus, max_broadcast_queries=0, tile_codes=90, query_block=25, **options)
    assert sorted(map(tuple, scan.collect())) == sorted(map(tuple, tiled.collect()))
    nothing = corpus.limit(0)
    assert Q.quantised_knn(asked.limit(0), corpus, item_id="vec_id").count() == 0
    assert Q.quantised_knn(asked, nothing, item_id="vec_id").count() == 0


# ---- pattern automata


@pytest.mark.parametrize("band", [S.BAND_CHARS, 40])
def test_terms_in_bands_and_of_any_script(spark, band):
    texts = [(1, "Straße nach ÄRZTE"), (2, "ΣΊΣΥΦΟΣ"), (3, ""), (4, None), (5, "aaa"), (5, "aaa b"), (6, "日本語のテキスト 😀!"), (None, "aaa")]
    terms = [(1, "ärzte"), (2, "AA"), (3, "a"), (4, ""), (5, None), (6, "本語"), (7, "😀"), (8, "b"), (8, "B"), (9, "aa"), (10, "nothing here")]
    got = S.containments(spark.createDataFrame(texts, "i int, t string"), "i", "t", spark.createDataFrame(terms, "j int, w string"), "j", "w", band)
    want = {(i, j) for i, t in texts for j, w in terms if t and w and w.lower() in t.lower()}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_a_hundred_thousand_patterns(spark):
    draw = random.Random(1)
    words = ["".join(draw.choice("abcdefg") for _ in range(draw.randrange(5, 9))) for _ in range(100_000)]
    texts = [(i, "".join(draw.choice("abcdefgh") for _ in range(300))) for i in range(60)]
    terms = spark.createDataFrame(list(enumerate(words)), "j int, w string")
    got = S.containments(spark.createDataFrame(texts, "i int, t string"), "i", "t", terms, "j", "w")
    by_word = {}
    for j, w in enumerate(words):
        by_word.setdefault(w, []).append(j)
    want = {(i, j) for i, t in texts for n in range(5, 9) for at in range(len(t) - n + 1) for j in by_word.get(t[at : at + n], ())}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 1000


# ---- status machine

EVENTS = "document_id string, ts timestamp, seq long, status string"
FIRST = dt.datetime(2024, 1, 1)


def brute_moves(rows, stall):
    found, by_doc = [], {}
    for r in rows:
        if r[0] is not None and r[1] is not None:
            by_doc.setdefault(r[0], []).append(r)
    for doc, events in by_doc.items():
        status, since = "", None
        for _, ts, seq, asked in sorted(events, key=lambda r: (r[1], r[2], r[3] or "")):
            if status == "processing" and since + stall < ts:
                status, since = "failed", since + stall
                found.append((doc, since, None, "failed", "processing", "failed", "timeout"))
            asked, before = asked or "", status
            legal = asked in M.TRANSITIONS[status]
            if legal:
                status, since = asked, ts
            found.append((doc, ts, seq, asked, before, status, "accepted" if legal else "illegal"))
        if status == "processing":
            found.append((doc, since + stall, None, "failed", "processing", "failed", "timeout"))
    return sorted(found, key=repr)


def drawn_events(n, docs=9):
    draw = random.Random(n)
    asked = ["not_started", "processing", "processing", "completed", "failed", "odd", None]
    rows = [(f"d{draw.randrange(docs)}", FIRST + dt.timedelta(seconds=draw.randrange(90_000)), i, draw.choice(asked)) for i in range(n)]
    draw.shuffle(rows)
    return rows


def test_machine_against_brute_force(spark):
    rows = drawn_events(300) + [(None, FIRST, 1, "processing"), ("x", None, 2, "processing"), ("y", FIRST, 5, "processing"), ("y", FIRST, 4, "completed")]
    events = spark.createDataFrame(rows, EVENTS).repartition(4)
    got = sorted(map(tuple, M.transitions(events, 3600).collect()), key=repr)
    assert got == brute_moves(rows, dt.timedelta(hours=1))
    assert {r[-1] for r in got} == {"accepted", "illegal", "timeout"}
    assert M.transitions(events.limit(0), 3600).count() == 0


def write_files(spark, folder, parts, schema):
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/tmp{i}")
        (found,) = (folder / f"tmp{i}").glob("*.parquet")
        target = folder / "in" / f"{i}.parquet"
        target.parent.mkdir(exist_ok=True)
        found.rename(target)
        stamp = 1_700_000_000 + 10 * i
        import os

        os.utime(target, (stamp, stamp))
    return str(folder / "in")


def run_machine(spark, source, folder, delay):
    arriving = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    moves = M.stream_transitions(arriving, delay, 3600)
    J.run_to_end(moves.writeStream.format("parquet").option("path", str(folder / "out")).outputMode("append"), str(folder / "progress"))
    return spark.read.schema(moves.schema).parquet(str(folder / "out")).where("document_id <> 'end'")


def test_stream_of_shuffled_batches_equals_the_batch(spark, tmp_path):
    rows = drawn_events(240, docs=5)
    source = write_files(spark, tmp_path, [*(rows[i::4] for i in range(4)), [("end", dt.datetime(2100, 1, 1), 0, "")]], EVENTS)
    got = run_machine(spark, source, tmp_path, "2 days")
    assert sorted(map(tuple, got.collect()), key=repr) == brute_moves(rows, dt.timedelta(hours=1))


def test_late_events_are_left_out_and_found_in_the_log(spark, tmp_path):
    hour = dt.timedelta(hours=1)
    on_time = [("a", FIRST + i * hour, i, "processing" if i % 2 == 0 else "completed") for i in range(30)]
    late = [("a", FIRST + hour / 2, 100, "failed"), ("b", FIRST + hour, 101, "processing")]
    end = [("end", dt.datetime(2100, 1, 1), 0, "")]
    source = write_files(spark, tmp_path, [on_time, [("c", FIRST + 40 * hour, 200, "processing")], late, end], EVENTS)
    got = run_machine(spark, source, tmp_path, "1 hour")
    kept = on_time + [("c", FIRST + 40 * hour, 200, "processing")]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_moves(kept, hour)
    log = spark.createDataFrame(on_time + late, EVENTS)
    assert sorted(r.seq for r in M.late_events(log, got, "2024-02-01").collect()) == [100, 101]


# ---- rollups


def requests(draw, n):
    return [
        (dt.date(2024, 1, 1 + draw.randrange(12)), draw.choice([None, "", *(f"u{i}" for i in range(40))]), draw.choice([None, 1, 3]),
         draw.choice([None, 0.0, 1.5, 2.25]), draw.choice([None, [], ["fine"], ["Error: x", "y"]]))
        for _ in range(n)
    ]


def test_rollup_of_appended_batches_equals_a_full_run(spark, tmp_path):
    draw, path, rows = random.Random(2), str(tmp_path / "r"), []
    for number in range(4):
        # Days come in any order: nothing is late.
        part = requests(draw, 60)
        rows += part
        U.add_batch(spark.createDataFrame(part, LOG), path, number)
        U.add_batch(spark.createDataFrame(part, LOG), path, number)
        if number == 1:
            assert U.compact_rollup(spark, path) == 1 and U.compact_rollup(spark, path) is None
    want = request_stats(spark.createDataFrame(rows, LOG))
    for _ in range(2):
        got = U.daily_stats(spark, path)
        assert sorted(map(tuple, got.select(want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
        assert U.compact_rollup(spark, path) in (3, None)
    assert [p.name for p in (tmp_path / "r" / "sums").iterdir() if p.is_dir()] == ["upto=3"]


def test_sketches_hold_their_bound_over_ranges(spark, tmp_path):
    path = str(tmp_path / "r")
    log = spark.range(60_000).select(
        F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 20).cast("int")).alias("log_date"), F.concat(F.lit("u"), F.col("id") % 17_011).alias("documents"),
        F.lit(1).alias("question_count"), F.lit(1.0).alias("processing_time"), F.array(F.lit("x")).alias("answers"),
    )
    for number in range(2):
        U.add_batch(log.where(F.col("id") % 2 == number), path, number)
    ranges = [("one", 0, 0), ("week", 2, 8), ("all", 0, 19)]
    day = dt.date(2024, 1, 1)
    asked = spark.createDataFrame([(n, day + dt.timedelta(a), day + dt.timedelta(b)) for n, a, b in ranges], "range_id string, first_day date, last_day date")
    got = {r.range_id: r.estimate for r in U.estimated_documents(U.daily_sums(spark, path), asked).collect()}
    for name, first, last in ranges:
        exact = len({i % 17_011 for i in range(60_000) if first <= i % 20 <= last})
        assert abs(got[name] - exact) <= 3 * 0.01625 * exact + 1


def test_elements_are_put_together_inside_their_split(spark, tmp_path):
    import json

    whole = json.dumps([{"request_id": f"r{i}", "response": {"answers": [str(i)] * (i % 5)}} for i in range(300)], indent=2)
    (tmp_path / "requests_2024-01-01.json").write_text(whole)
    lines = spark.read.text(str(tmp_path)).select(F.lit("f").alias("file"), F.lit(0).cast("long").alias("split"), "value")
    pieces = lines.coalesce(1).mapInArrow(R._gather(2), R._PIECES).collect()
    # One row an element, of which only the last may go on in another split.
    assert [p.nth for p in pieces] == list(range(1, 301)) and [p.edge for p in pieces] == [False] * 299 + [True]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("150", "1000000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            found = R.split_json_days(spark, str(tmp_path)).select("element", "record.request_id", "record.response.answers").collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert sorted((r.element, r.request_id, r.answers) for r in found) == [(i + 1, f"r{i}", [str(i)] * (i % 5)) for i in range(300)]


def test_hashed_terms_equal_plain_search(monkeypatch):
    """Terms of any length, over the ends of hashed windows and next to the ends of rows."""
    import pyarrow as pa

    monkeypatch.setattr(S, "_WINDOW", 64)
    draw = random.Random(1)
    letters = "abé€😀 \x00"
    for _ in range(40):
        texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 60))) for _ in range(12)]
        own = {t[i : i + draw.randint(1, 40)] for t in texts for i in [draw.randint(0, 20)] if t[i:]}
        terms = sorted(own | {"".join(draw.choice(letters) for _ in range(draw.randint(1, 12))) for _ in range(20)} | {"x" * 200})
        rows, numbers = S._Terms(pa.array(terms)).hits(*S.byte_view(pa.array(texts, pa.string())))
        want = sorted((i, j) for i, t in enumerate(texts) for j, w in enumerate(terms) if w in t)
        assert list(zip(rows.tolist(), numbers.tolist())) == want

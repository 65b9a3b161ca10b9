"""Operators against brute force, on data with hot keys."""

import math
import random

import pytest
from pyspark.sql import Window, functions as F

from lexiloom.functions.vectors import term_vector
from lexiloom.operators import cache as K, chunking as C, gates as G, knn as N, lookups as L, ordering as O
from lexiloom.operators.substring import containments
from lexiloom.plans import retrieval as R


@pytest.fixture
def many_slices(spark):
    """Keep small slices apart, which at run time would be coalesced into one."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


@pytest.fixture(scope="module")
def hot(spark):
    """One key holds well over a third of the rows; ties in the order column."""
    rows = [(("hot" if i % 2 else f"k{i % 7}") if i % 11 else None, i // 3, i, float(i % 5)) for i in range(3000)]
    return spark.createDataFrame(rows, "key string, ts int, id int, v double").repartition(6)


def plain(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.mark.parametrize("limit", [0, 10_000])
def test_row_numbers(spark, hot, many_slices, limit):
    expected = hot.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("ts", "id")).cast("long"))
    assert plain(O.row_numbers(hot, ["key"], ["ts", "id"], "n", max_group=limit)) == plain(expected)


@pytest.mark.parametrize("limit", [0, 10_000])
def test_row_numbers_over_everything(spark, hot, many_slices, limit):
    got = O.row_numbers(hot, [], ["ts", "id"], "n", max_group=limit)
    assert [r.n for r in got.orderBy("ts", "id").collect()] == list(range(1, 3001))


@pytest.mark.parametrize("limit", [0, 10_000])
def test_previous_values(spark, hot, many_slices, limit):
    expected = hot.withColumn("p", F.lag("v").over(Window.partitionBy("key").orderBy("ts", "id")))
    assert plain(O.previous_values(hot, ["key"], ["ts", "id"], "v", "p", max_group=limit)) == plain(expected)


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("limit", [0, 10_000])
def test_running_sum(spark, hot, many_slices, inclusive, limit):
    window = Window.partitionBy("key").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    expected = hot.withColumn("s", F.coalesce(F.sum("v").over(window), F.lit(0.0)))
    assert plain(O.running_sum(hot, ["key"], ["ts", "id"], "v", "s", inclusive, max_group=limit)) == plain(expected)


def test_a_hot_key_is_spread_over_slices(spark, hot, many_slices):
    spread = O.sliced(hot, ["key"], ["ts", "id"]).where("key = 'hot'").groupBy("__slice").count().collect()
    assert len(spread) > 2 and max(r["count"] for r in spread) < 1000


def brute_force(queries, corpus, k):
    def distance(a, b):
        norm = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
        return 1.0 if norm == 0 else max(math.floor((1 - sum(x * y for x, y in zip(a, b)) / norm) * 1e12 + 0.5) / 1e12, 0.0)

    rows = []
    for q, a in queries:
        near = sorted((distance(a, b), i) for i, b in corpus)[:k]
        rows += [(q, r + 1, i, round(d, 6)) for r, (d, i) in enumerate(near)]
    return sorted(rows)


@pytest.fixture(scope="module")
def vectors(spark):
    """A third of the corpus is one repeated vector; some vectors are zero."""
    def vector(i):
        if i % 3 == 0:
            return [1.0, 2.0, 0.0, 1.0]
        return [0.0] * 4 if i % 50 == 1 else [float((i * p) % 9) for p in (1, 5, 7, 11)]

    corpus = [(f"c{i:03d}", vector(i)) for i in range(400)]
    queries = [(i, vector(i + 1)) for i in range(60)]
    return queries, corpus


@pytest.mark.parametrize("options", [
    {}, {"max_broadcast_queries": 0}, {"max_broadcast_queries": 0, "tile_rows": 16, "query_block": 20},
    {"max_broadcast_queries": 0, "max_pivots": 3}, {"max_broadcast_queries": 0, "max_pivots": 64, "tile_rows": 7},
])
@pytest.mark.parametrize("k", [1, 20])
def test_knn_is_exact(spark, vectors, options, k):
    queries, corpus = vectors
    q = spark.createDataFrame(queries, "query_id int, embedding array<float>").repartition(3)
    c = spark.createDataFrame(corpus, "chunk_id string, embedding array<float>").repartition(4)
    assert plain(N.knn(q, c, k, **options)) == sorted(brute_force(queries, corpus, k), key=repr)


def test_knn_plans_agree_on_doubles_and_missing_vectors(spark):
    draw = random.Random(3)
    corpus = [(i, [draw.uniform(-1, 1) for _ in range(6)]) for i in range(500)] + [(900, None), (901, [0.0] * 6)]
    # Neighbours closer than the six places shown are still ranked by their distance.
    corpus += [(910 - i, [1.0, 1e-4 * i, 0.0, 0.0, 0.0, 0.0]) for i in range(5)]
    c = spark.createDataFrame(corpus, "chunk_id int, embedding array<double>")
    q = spark.createDataFrame([(i, v) for i, v in corpus[:40]] + [(77, None), (78, [1.0] + [0.0] * 5)], "query_id int, embedding array<double>")
    scan, tiled = N.knn(q, c, 5), N.knn(q, c, 5, max_broadcast_queries=0, tile_rows=50)
    assert plain(scan) == plain(tiled) and scan.where("query_id = 77 or chunk_id = 900").count() == 0
    assert [r.chunk_id for r in scan.where("query_id = 78").orderBy("rank").collect()] == [910, 909, 908, 907, 906]


def test_knn_ranks_a_vector_first_for_itself(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    top = N.knn(v.withColumnRenamed("vec_id", "query_id"), v, 1, item_id="vec_id", max_broadcast_queries=0)
    assert top.where("query_id <> vec_id").count() == 0


def test_knn_approximate_recall(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    q = v.withColumnRenamed("vec_id", "query_id")
    exact, near = N.knn(q, v, 10, item_id="vec_id"), N.knn(q, v, 10, item_id="vec_id", nprobe=16)
    both = exact.join(near, ["query_id", "vec_id"]).count()
    assert both / exact.count() > 0.6
    everything = N.knn(q, v, 10, item_id="vec_id", nprobe=10_000)
    assert plain(everything) == plain(exact)


def test_knn_plan_limits_before_the_shuffle(spark, vectors):
    queries, corpus = vectors
    q = spark.createDataFrame(queries, "query_id int, embedding array<float>")
    c = spark.createDataFrame(corpus, "chunk_id string, embedding array<float>")
    plan = N.knn(q, c, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_empty_queries(spark):
    q = spark.createDataFrame([], "query_id int, embedding array<float>")
    c = spark.createDataFrame([("c", [1.0])], "chunk_id string, embedding array<float>")
    assert N.knn(q, c).count() == 0


def test_containments(spark):
    texts = [(i, t) for i, t in enumerate(["https://A.example.com/x?y", "https://b.example.com", "ab", "", "zzabzz", "Ünï code"] * 20)]
    terms = [(i, t) for i, t in enumerate(["example", "EXAMPLE.COM/X", "ab", "b", "missing", "https:", "ünï", "zzabzz"])]
    got = containments(spark.createDataFrame(texts, "i int, t string"), "i", "t", spark.createDataFrame(terms, "j int, w string"), "j", "w")
    assert plain(got) == sorted(((i, j) for i, t in texts for j, w in terms if w.lower() in t.lower()), key=repr)


def test_block_gate_both_ways(spark):
    urls = spark.createDataFrame([("https://Bad.com/x",), ("http://ok.com",), ("http://ok.com/GET-secret-token?a",)], "url string")
    patterns = spark.createDataFrame([("bad.COM",), ("https://never",)], "pattern string")
    for limit in (None, 0):
        assert plain(G.allowed(urls, patterns, limit=limit)) == [("http://ok.com",)]
    assert G.allowed(urls, patterns, enabled=False).count() == 3


def test_fuzzy_lookup(spark):
    places = [("New York", "Eiffel Tower"), ("London", "Statue of Liberty"), ("Tokyo", "Big Ben"), ("Dubai", "CN Tower"), ("Paris", "Taj Mahal")]
    cities = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(places)], "ord int, key string, value string")
    asked = spark.createDataFrame([("PARIS",), ("York",), ("greater london area",), ("Nowhere",), (None,)], "city string")
    expected = [("Nowhere", None), ("PARIS", "Taj Mahal"), ("York", "Eiffel Tower"), ("greater london area", "Statue of Liberty"), (None, None)]
    for limit in (512, 0):
        assert sorted(map(tuple, L.fuzzy_lookup(asked, cities, "city", limit=limit).collect()), key=lambda r: str(r[0])) == sorted(
            expected, key=lambda r: str(r[0]))
    texts = spark.createDataFrame([(1, "From the big ben to the CN TOWER"), (2, "nothing")], "id int, text string")
    for limit in (512, 0):
        got = {r.id: r.value for r in L.first_term(texts, cities, "text", "id", limit=limit).collect()}
        assert got == {1: "Big Ben", 2: None}


def test_carries_are_few_and_broadcast(spark, hot, many_slices):
    rows = O.sliced(hot, ["key"], ["ts", "id"])
    carries = O._carries(rows, ["key"], F.count(F.lit(1)), lambda n, across: F.sum(n).over(O._earlier(across)))
    assert 0 < carries.count() <= rows.select("__slice").distinct().count()


def chunked(spark, texts, **options):
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "url string, text string")
    return C.semantic_chunks(docs, **options)


def test_chunk_edges(spark):
    texts = ["", "One sentence only", "First one. Second two!", "same. same. same. same. same.", None, "a b. a b. a b. x y. x y. x y."]
    rows = chunked(spark, texts, percentile=50).orderBy("url", "ordinal").collect()
    by_url = {f"d{i}": [r.text for r in rows if r.url == f"d{i}"] for i in range(len(texts))}
    assert by_url["d0"] == [] and by_url["d4"] == []
    assert by_url["d1"] == ["One sentence only"]
    assert by_url["d2"] == ["First one. Second two!"]
    assert by_url["d3"] == ["same. same. same. same. same."]
    assert len(by_url["d5"]) > 1 and " ".join(by_url["d5"]) == texts[5]


def test_chunks_cover_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").cast("string").alias("url"), "text")
    chunks = C.semantic_chunks(docs)
    joined = chunks.groupBy("url").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda c: c.text), " ").alias("whole"),
        F.max("ordinal").alias("last"), F.count(F.lit(1)).alias("n"))
    expected = C.with_sentences(docs).select("url", F.array_join("sents", " ").alias("expected"))
    assert joined.join(expected, "url").where("whole <> expected or last <> n - 1").count() == 0
    assert chunks.where(F.size("embedding") != 64).count() == 0


@pytest.mark.parametrize("buffer", [0, 1, 2])
def test_distances_equal_their_definition(spark, monkeypatch, buffer):
    from lexiloom.functions import vectors as V

    monkeypatch.setattr(V, "_SENTENCES_AT_ONCE", 7)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    sents = C.with_sentences(docs.unionByName(spark.createDataFrame([(-1, ""), (-2, "x"), (-3, "!. ?. a.")], docs.schema)))
    fast = C.with_distances(sents, buffer).select("doc_id", "dists")
    slow = C.with_distances_inline(sents, buffer).select("doc_id", F.col("dists").alias("expected"))
    assert fast.join(slow, "doc_id").where("dists <> expected").count() == 0


def test_chunking_needs_no_shuffle(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("source").alias("url"), "text")
    plan = C.semantic_chunks(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_combined_query_equals_joined_text(spark):
    rows = [(1, "alpha beta"), (1, "beta gamma"), (2, "delta")]
    questions = R.with_embedding(spark.createDataFrame(rows, "request_id int, question string"), "question")
    got = {r.request_id: r.embedding for r in R.combined_queries(questions).collect()}
    whole = spark.createDataFrame([(1, "alpha beta beta gamma"), (2, "delta")], "i int, t string")
    assert got == {r.i: r.v for r in whole.select("i", term_vector(F.col("t")).alias("v")).collect()}


def test_ten_questions_make_four_batches(spark):
    rows = [("r", i, f"q{i}") for i in range(10)]
    batches = R.question_batches(spark.createDataFrame(rows, "request_id string, turn int, question string"), "request_id", ["turn"], "question", 10)
    assert [r.questions for r in batches.orderBy("batch_no").collect()] == [
        ["q0", "q1", "q2"], ["q3", "q4", "q5"], ["q6", "q7", "q8"], ["q9"]]


def test_prompt_keeps_braces_and_blank_question(spark):
    frame = spark.createDataFrame([([], "{x} }")], "q array<string>, c string")
    text = frame.select(R.prompt(F.col("q"), F.col("c"))).first()[0]
    assert "exactly 1 string" in text and "1. \n" in text and text.rstrip().endswith("{x} }")


def test_repeat_remembers_only_the_last_url(spark):
    rows = [("t", 1, "a"), ("t", 2, " a "), ("t", 3, "b"), ("t", 4, "a"), ("u", 5, "a"), ("u", 6, None), ("u", 7, "a")]
    got = K.repeat_submissions(spark.createDataFrame(rows, "tenant string, ts int, url string"), "tenant", ["ts"])
    assert {r.ts: r.is_repeat for r in got.collect()} == {1: False, 2: True, 3: False, 4: False, 5: False, 6: False, 7: False}


def test_cache_is_created_once_per_document(spark):
    requests = spark.createDataFrame([("http://h/a.pdf",), ("HTTP://H/a.PDF ",), ("http://h/b.xlsx",), ("http://h/c.pdf",)], "url string")
    mapping = spark.createDataFrame([], "doc_hash string, cache_name string")
    named, updated = K.get_or_create(requests, mapping)
    names = {r.url: r.cache_name for r in named.collect()}
    assert names["http://h/b.xlsx"] is None and not named.where("is_hit").count()
    again, same = K.get_or_create(requests, updated)
    assert {r.url: r.cache_name for r in again.collect()} == names
    assert plain(same) == plain(updated) and updated.count() == len({n for n in names.values() if n})
    off, untouched = K.get_or_create(requests, mapping, cache_enabled=False)
    assert off.where("cache_name is not null").count() == 0 and untouched is mapping


@pytest.mark.parametrize("limit", (512, 0))
def test_empty_null_and_repeated_terms_match_alike(spark, limit):
    urls = spark.createDataFrame([("http://ÄB.example/x",), ("http://b.example",), (None,), ("",)], "url string")
    patterns = spark.createDataFrame([("",), (None,), ("äb.EX",)], "pattern string")
    flagged = {r.url: r.is_blocked for r in G.flag_blocked(urls, patterns, markers=(), limit=limit).collect()}
    assert flagged == {"http://ÄB.example/x": True, "http://b.example": False, None: False, "": False}
    words = spark.createDataFrame([(1, "Über", "b"), (1, "Über", "a"), (2, "", "empty"), (3, None, "null"), (4, "x", ""), (5, "y", None)], "ord int, key string, value string")
    asked = spark.createDataFrame([("ÜBER",), ("",), (None,), ("none",)], "k string")
    assert sorted(map(tuple, L.fuzzy_lookup(asked, words, "k", limit=limit).collect()), key=str) == sorted(
        [("", None), (None, None), ("none", None), ("ÜBER", "a")], key=str)
    texts = spark.createDataFrame([(1, "has A and B"), (2, "only b"), (3, "zzz"), (4, None)], "id int, text string")
    got = {r.id: r.value for r in L.first_term(texts, words, "text", "id", limit=limit).collect()}
    assert got == {1: "a", 2: "b", 3: None, 4: None}


def test_long_text_is_matched_in_linear_time(spark):
    import time

    from lexiloom.operators.substring import containments

    texts = spark.createDataFrame([(1, "abcdefghij" * 8000 + "needle!")], "id int, text string")
    terms = spark.createDataFrame([(7, "NEEDLE!"), (8, "missing")], "t int, term string")
    containments(texts, "id", "text", terms, "t", "term").collect()
    start = time.perf_counter()
    assert [tuple(r) for r in containments(texts, "id", "text", terms, "t", "term").collect()] == [(1, 7)]
    assert time.perf_counter() - start < 10


def test_clearing_the_mapping_leaves_an_empty_table(spark):
    from lexiloom.operators import cache

    mapping = spark.createDataFrame([("a", "b")], "doc_hash string, cache_name string")
    left = cache.evict_all(mapping)
    assert left.count() == 0 and left.columns == mapping.columns


@pytest.mark.parametrize("few", [0, 4096])
def test_documents_that_share_a_prefix_keep_their_own_context(spark, few):
    docs = spark.createDataFrame([("doc/99", "Apples are red."), ("doc/16495", "Trains are late."), ("doc/1", "Rain falls.")], "url string, text string")
    chunks = C.semantic_chunks(docs)
    assert chunks.select("chunk_id").distinct().count() == 2
    asked = spark.createDataFrame([(1, "apples red"), (2, "trains late")], "query_id int, question string")
    found = R.retrieve(asked, chunks, k=1, max_broadcast_queries=few)
    assert plain(found.select("query_id", "n_chunks", "context")) == [(1, 1, "Apples are red."), (2, 1, "Trains are late.")]
    both = R.retrieve(asked, chunks, k=2, max_broadcast_queries=few)
    assert {r.n_chunks for r in both.collect()} == {2}


def test_lookups_keep_rows_on_repeated_keys(spark):
    from lexiloom.operators import lookups

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "a")], "id int, k string")
    entries = [(2, "a", "late"), (1, "a", "early"), (3, "b", None), (4, None, "none"), (1, "a", "early")]
    dictionary = spark.createDataFrame(entries, "ord int, key string, value string")
    got = {r.id: r.value for r in lookups.default_lookup(rows, dictionary, "k", "other").collect()}
    assert got == {1: "early", 2: "other", 3: "other", 4: "early"}
    plain = lookups.default_lookup(rows, dictionary.select("key", "value"), "k", "other").collect()
    assert sorted((r.id, r.value) for r in plain) == [(1, "early"), (2, "other"), (3, "other"), (4, "early")]
    assert lookups.default_lookup(rows, dictionary.limit(0), "k", "other").where("value = 'other'").count() == 4
    # limit=0 takes the joined form, which has to agree with the one inside the row.
    forms = [
        sorted((r.id, r.value) for r in lookups.fuzzy_lookup(rows, dictionary, "k", limit=n).collect()) for n in (0, 512)
    ]
    assert forms[0] == forms[1] and len(forms[0]) == 4

    asked = spark.createDataFrame([("a%20b",), ("a%20b",), ("c",), (None,)], "document_id string")
    states = spark.createDataFrame(
        [("a b", "ready", True), ("a b", "ready", False), ("c", "failed", None), (None, "ready", True)],
        "document_id string, status string, protected boolean",
    )
    found = lookups.status_lookup(asked, states).collect()
    assert sorted(((r.document_id or ""), r.found, r.rag_status, r.cache_protected) for r in found) == [
        ("", False, None, None), ("a%20b", True, "ready", False), ("a%20b", True, "ready", False), ("c", True, "failed", None),
    ]
    assert lookups.status_lookup(asked.limit(0), states).count() == 0

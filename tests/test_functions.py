"""Edge cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from lexiloom import dimensions as D
from lexiloom.functions import answers as A, filetypes as T, scalars as S, text as X, urls as U, vectors as V


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(
        f"{k} {'int' if isinstance(v, int) and not isinstance(v, bool) else 'array<string>' if isinstance(v, list) else 'string'}"
        for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("url,ext", [
    ("t.tar.gz", ".gz"), (".bashrc", ""), ("x.pdf/", ".pdf"), ("https://h/a.pdf;v=1", ".pdf"), ("a.pdf;v=1", ".pdf;v=1"),
    ("https://h/a b.pdf?x=1", ".pdf"), ("s3://b/a.pdf?x=1", ".pdf?x=1"), ("A.PDF", ".pdf"), ("https://h/name", ""),
    ("HTTP://h/a.pdf?x=1", ".pdf?x=1"), ("https://h", ""), ("trailing.", ""), ("https://h/a.pdf#p.q", ".pdf"), (None, None),
])
def test_extension(spark, url, ext):
    assert one(spark, U.file_extension(F.col("u")), u=url) == ext


@pytest.mark.parametrize("name,category,supported,cacheable", [
    ("document.pdf", "document", True, True), ("presentation.pptx", "presentation", True, False),
    ("spreadsheet.xlsx", "spreadsheet", True, False), ("image.jpg", "image", True, True),
    ("webpage.html", "html", True, True), ("email.eml", "email", True, True), ("archive.zip", "archive", False, False),
    ("binary.bin", "binary", False, False), ("media.mp4", "media", False, False), ("unsupported.txt", "unsupported", False, False),
])
def test_category(spark, name, category, supported, cacheable):
    found = F.col("c")
    row = spark.createDataFrame([(name,)], "u string").select(T.file_category(F.col("u")).alias("c")).select(
        "c", T.is_supported(found).alias("s"), T.can_be_cached(found, F.lit(True)).alias("k")).first()
    assert tuple(row) == (category, supported, cacheable)


def test_extension_families_are_disjoint():
    every = [e for exts in D.EXTENSIONS.values() for e in exts]
    assert len(every) == len(set(every)) == 146


@pytest.mark.parametrize("url,name", [
    ("https://h/a/b.pdf?x=1", "b.pdf"), ("https://h/a/", ""), ("HTTPS://h/q.doc", "q.doc"), ("/tmp/f.eml", "f.eml"), ("f", "f"),
])
def test_basename(spark, url, name):
    assert one(spark, U.doc_basename(F.col("u")), u=url) == name


def test_hash_and_prefix_disagree_on_case(spark):
    a, b = "HTTP://X ", "http://x"
    assert one(spark, U.doc_hash(F.col("u")), u=a) == one(spark, U.doc_hash(F.col("u")), u=b)
    assert one(spark, U.chunk_prefix(F.col("u")), u=a) != one(spark, U.chunk_prefix(F.col("u")), u=b)


@pytest.mark.parametrize("url,kind,name", [
    ("https://h/x", None, "data.pdf"), ("https://h/.pdf", None, "data.pdf"), ("https://h/x", "Application/MSWord", "data.docx"),
    ("https://h/x.txt", "application/pdf", "data.pdf"), ("https://h/x.doc", "application/pdf", "data.pdf"),
    ("https://docs.google.com/document/d/ab_c-1/edit", None, "data.docx"), ("https://docs.google.com/document/d/", None, None),
])
def test_target_filename(spark, url, kind, name):
    assert one(spark, U.target_filename(F.col("u"), F.col("k")), u=url, k=kind) == name


NA, INC, EXT, INV = D.MSG_NO_ANSWER, D.MSG_INCOMPLETE, D.MSG_EXTRACTED, D.MSG_INVALID


@pytest.mark.parametrize("raw,n,expected", [
    ('{"answers": ["a", "b"]}', 2, ["a", "b"]),
    ('{"answers": ["a"]}', 3, ["a", NA, NA]),
    ('{"answers": ["a", "b", "c"]}', 2, ["a", "b"]),
    ('```json\n{"answers": ["a"]}\n```', 1, ["a"]),
    ('```\n{"answers": ["a"]}\n``` tail', 1, ["a"]),
    ('```{"answers": ["a"]}', 1, ["a"]),  # a single fence stays, the braces inside are still found
    ('{"answers": ["a", ], }', 1, ["a"]),
    ('{"answers": ["one", "tw', 2, ["one", INC]),
    ('{"answers": ["say \\"hi\\" now", "x', 2, ['say "hi" now', INC]),
    ('{"answers": ["open \\" end', 1, [INC]),
    ('{"answer": "single"}', 3, ["single"]),
    ('Sure: {"answers": ["a"]} done', 1, ["a"]),
    ('Sure: {"answer": "a"} done', 1, [INV]),
    ('He said "a long enough string" and "short"', 2, ["a long enough string", EXT]),
    ('["a long enough answer", "answers"]', 1, ["a long enough answer"]),
    ('{"other": 1}', 1, [INV]),
    ('plain', 2, [INV, INV]), ('', 1, [INV]), (None, 1, [INV]),
    ('{"answers": ["a"]} trailing', 1, ["a"]),
    ('{"answers": [1, true, null]}', 3, ["1", "true", None]),
])
def test_salvage(spark, raw, n, expected):
    assert one(spark, A.parse_salvage(F.col("r"), F.col("n")), r=raw, n=n) == expected


@pytest.mark.parametrize("raw,n,expected", [
    ('{"answers": ["a"]}', 2, ["a", NA]), ('{"answer": "a"}', 1, ["a"]), ('["a", "b", "c"]', 2, ["a", "b"]),
    ('"text"', 1, ["text"]), ('{"k": 1}', 1, ['{"k":1}']), ('{"answers": ["a",]}', 2, [D.MSG_JSON_FAILED] * 2),
    ('nothing', 1, [D.MSG_JSON_FAILED]), (None, 1, [D.MSG_JSON_FAILED]), ('```json\n["a"]\n```', 1, ["a"]),
])
def test_strict(spark, raw, n, expected):
    assert one(spark, A.parse_strict(F.col("r"), F.col("n")), r=raw, n=n) == expected


def test_long_answers_survive(spark):
    long = "word \\\" " * 20000
    assert one(spark, A.parse_salvage(F.col("r"), F.col("n")), r='{"answers": ["' + long + '", "x', n=1) == [long.replace('\\"', '"')]


@pytest.mark.parametrize("answers,error,overload,unavailable", [
    (["fine"], False, False, False), (["Error: x"], True, False, False), (["error: x"], False, False, False),
    (["Error processing question 1"], False, False, False), (["503 - UNAVAILABLE"], False, True, True),
    (["The service temporarily OVERLOADED"], False, True, True), ([], False, False, False), (None, False, False, False),
    (["Cache processing failed\nlater 503"], False, True, False), (["Cache processing failed: 503"], False, True, True),
])
def test_answer_tests(spark, answers, error, overload, unavailable):
    row = spark.createDataFrame([(answers,)], "a array<string>").select(
        A.has_error(F.col("a")), A.is_overloaded(F.col("a")), A.is_unavailable(F.col("a"))).first()
    assert tuple(row) == (error, overload, unavailable)


def test_denied_needs_every_answer(spark):
    frame = spark.createDataFrame([([D.MSG_DENIED],), ([D.MSG_DENIED, "x"],), ([],), (None,)], "a array<string>")
    assert [r[0] for r in frame.select(A.is_denied(F.col("a"))).collect()] == [True, False, False, False]


def test_validated_and_wrap(spark):
    assert one(spark, A.validated(F.col("a")), a=["  x ", "\n", None]) == ["x", D.MSG_EMPTY_ANSWER, D.MSG_EMPTY_ANSWER]
    assert one(spark, A.wrap_single(F.col("r")), r='{"answer": "a"}') == '{"answer": "a"}'
    assert one(spark, A.wrap_single(F.col("r")), r='{"b": "é"}') == '{"answer":"{\\"b\\": \\"é\\"}"}'
    assert one(spark, A.unwrap_envelope(F.col("r")), r='{"answer": "a"}') == ["a"]
    assert one(spark, A.unwrap_envelope(F.col("r")), r="raw") == ["raw"]


@pytest.mark.parametrize("body,field", [
    ('{"data": {"city": "Oslo"}}', "Oslo"), ('"Oslo"', "Oslo"), ('{"other": 1}', '{"other":1}'), (' "Oslo ', 'Oslo'), ("Oslo", "Oslo"),
])
def test_json_field(spark, body, field):
    assert one(spark, A.json_field(F.col("b"), ".data.city"), b=body) == field


def test_scalars(spark):
    frame = spark.createDataFrame([("TRUE",), ("on",), ("0",), (None,)], "v string")
    assert [r[0] for r in frame.select(S.parse_flag(F.col("v"))).collect()] == [True, True, False, False]
    names = frame.select(S.unique_name("f", ".md").alias("n"), S.request_id().alias("i")).collect()
    assert len({r.n for r in names}) == 4 and len({r.i for r in names}) == 4
    assert one(spark, S.strip(F.col("v")), v=" \n a \t") == "a"
    assert one(spark, S.or_today(F.col("v")), v="2024-01-02") == "2024-01-02"


def test_html_text(spark):
    page = "<!DOCTYPE html><p> a&nbsp;<b>b &amp; c</b>\n</p><!-- x --><script>var t='</p>';</script><style>p{}</style>d&lt;"
    assert one(spark, X.html_to_text(F.col("h")), h=page) == "a\nb & c\nd<"


def test_vectors(spark):
    text = "One two, two; DREI über"
    vector = one(spark, V.term_vector(F.col("t")), t=text)
    assert len(vector) == 64 and sum(vector) == 5
    assert one(spark, V.cosine_distance(V.term_vector(F.col("t")), V.term_vector(F.lower("t"))), t=text) == pytest.approx(0)
    assert one(spark, V.cosine_distance(V.term_vector(F.col("t")), V.term_vector(F.lit("..."))), t=text) == 1.0
    with pytest.raises(Exception, match="length"):
        spark.createDataFrame([([1.0],)], "v array<float>").select(V.checked_dim(F.col("v"))).collect()


def test_model_is_loaded_once_and_completes_vectors(spark):
    def load():
        import os

        loads = os.getpid()

        def model(texts):
            assert len(texts) <= 3
            return [[float(len(t)), 1.0, float(loads)] for t in texts]

        return model

    embedding = V.model_embedding("lengths", 3, load, batch=3)
    rows = [("abc", None), (None, None), ("abcd", []), ("given", [9.0, 9.0, 9.0])] * 3
    given = spark.createDataFrame(rows, "text string, embedding array<float>").coalesce(1)
    got = [r.embedding for r in V.complete_vectors(given, embedding).collect()]
    assert [v[:2] for v in got] == [[3.0, 1.0], [0.0, 1.0], [4.0, 1.0], [9.0, 9.0]] * 3
    assert len({v[2] for v in got if v[0] != 9.0}) == 1

"""Documents given in parts against the same documents as one row."""

import random

import pytest
from pyspark.sql import functions as F

from lexiloom.catalog.corpus import _parts
from lexiloom.functions.text import sentences
from lexiloom.operators import chunking as C, ordering, sections as S
from lexiloom.operators.ordering import latest_values
from lexiloom.sources.documents import read_markdown, read_sections

WORDS = ["ab", "c", "Дом", "été", "x1", "."]
GLUE = [" ", " ", "  ", "\n", ". ", ".", "! \n", "? ", ".\t", "\x01", "...  "]


def random_text(rng, words):
    return "".join(rng.choice(WORDS) + rng.choice(GLUE) for _ in range(words))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    made = {f"d{i}": random_text(rng, rng.choice([1, 3, 20, 60])) for i in range(60)}
    made |= {
        "long": random_text(rng, 3_000), "white": "  \n ", "one": "only one", "dot": ".", "lead": " \n a. b", "tail": "a. b.  ",
        "mark": "\x01\x01 a\x01", "same": "a b. " * 300, "empty": "",
    }
    return made


@pytest.fixture(scope="module")
def parts(spark, texts):
    rng = random.Random(6)
    rows = []
    for url, text in texts.items():
        low = part = 0
        while low < len(text):
            high = low + rng.choice([0, 1, 1, 2, 3, 7, 30])
            rows.append((url, part, text[low:high], {"url": url, "part": str(part)}))
            low, part = high, part + 1
        rows.append((url, part, None, None))
    rows.append((None, 0, "no document. none", None))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "url string, part long, text string, metadata map<string,string>").cache()


@pytest.mark.parametrize("max_group", [10**6, 20])
def test_sentences_reach_over_the_ends_of_parts(spark, texts, parts, max_group):
    found = {(r.url, r.pos): r.sentence for r in S.section_sentences(parts, max_group=max_group).collect()}
    docs = spark.createDataFrame(list(texts.items()), "url string, text string")
    wanted = docs.select("url", F.posexplode(sentences(F.col("text"))).alias("i", "s")).collect()
    assert found == {(r.url, r.i + 1): r.s for r in wanted}


@pytest.mark.parametrize("block, max_group, percentile", [(4_096, 10**6, 95.0), (3, 20, 95.0), (7, 20, 50.0)])
def test_chunks_are_those_of_the_whole_text(spark, texts, parts, block, max_group, percentile):
    docs = spark.createDataFrame(list(texts.items()), "url string, text string")
    columns = ("chunk_id", "chunk_prefix", "doc_key", "ordinal", "text", "embedding", "url")
    found = S.section_chunks(parts, block=block, max_group=max_group, percentile=percentile)
    wanted = C.semantic_chunks(docs, percentile=percentile)
    assert found.columns == wanted.columns
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(map(tuple, wanted.select(*columns).collect()))
    assert all(r.metadata == {"url": r.url, "part": "0"} for r in found.select("url", "metadata").collect())


@pytest.mark.parametrize("buffer, percentile, bins", [(1, 95.0, 4_096), (2, 37.5, 3), (0, 100.0, 1), (1, 0.0, 64)])
def test_selected_thresholds_are_exact(spark, texts, parts, buffer, percentile, bins):
    docs = spark.createDataFrame(list(texts.items()), "url string, text string")
    wanted = C.with_threshold(C.with_distances(C.with_sentences(docs), buffer), percentile).where("threshold is not null")
    blocks = S.section_blocks(S.section_sentences(parts), buffer, block=buffer + 2)
    found = S.section_thresholds(blocks, percentile, bins, max_group=20)
    assert dict(map(tuple, found.collect())) == dict(map(tuple, wanted.select("url", "threshold").collect()))


def test_no_parts_no_chunks(spark, parts):
    none = parts.where("false")
    assert S.section_chunks(none).count() == 0
    assert S.section_sentences(none.drop("metadata")).count() == 0


def test_a_repeated_part_is_read_twice(spark):
    rows = [("d", 0, "a b"), ("d", 1, "c. d e"), ("d", 1, "c. d e"), ("d", 2, " f")]
    found = S.section_sentences(spark.createDataFrame(rows, "url string, part int, text string"))
    assert [tuple(r) for r in found.orderBy("pos").collect()] == [("d", 1, "a bc."), ("d", 2, "d ec."), ("d", 3, "d e f")]


def test_a_block_holds_more_than_a_neighbourhood(spark, parts):
    with pytest.raises(ValueError):
        S.section_blocks(S.section_sentences(parts), buffer=2, block=3)


def test_lines_of_files_are_parts_of_documents(spark, tmp_path):
    rng = random.Random(8)
    for i in range(3):
        (tmp_path / f"f{i}.md").write_bytes((random_text(rng, 2_000).replace("\x01", "\r") + "\n").encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        sections = read_sections(spark, str(tmp_path))
        assert sections.select("url", "part.start").distinct().count() > 3
        columns = ("url", "ordinal", "text", "metadata")
        found = S.section_chunks(sections, block=50).select(*columns).collect()
        wanted = C.semantic_chunks(read_markdown(spark, str(tmp_path))).select(*columns).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(found, key=lambda r: r[:2]) == sorted(wanted, key=lambda r: r[:2])


@pytest.mark.parametrize("max_group", [10**6, 5])
def test_latest_values_skip_nulls(spark, max_group):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([None, None, i])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, at int, v int").repartition(8)
    seen, wanted = {}, {}
    for key, at, value in rows:
        wanted[at] = seen.get(key)
        seen[key] = seen.get(key) if value is None else value
    found = latest_values(df, ["k"], ["at"], "v", "before", max_group)
    assert {r.at: r.before for r in found.collect()} == wanted


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_in_parts_move_once(spark, monkeypatch):
    """one shuffle by document, nothing written on the way, the largest document counted once."""
    counted = []
    measure = S.largest_group
    for module in (S, ordering):
        monkeypatch.setattr(module, "largest_group", lambda *a: counted.append(1) or measure(*a))
    monkeypatch.setattr(S, "cut_lineage", lambda df: pytest.fail("texts are written"))
    parts = spark.createDataFrame(
        [("d", 0, "One is he"), ("d", 1, "re. Two! Thr"), ("d", 2, "ee goes"), ("d", 3, " on. "), ("d", 4, "Four"), ("e", 0, ""),
         ("e", 1, "Alone"), ("e", 1, "Alone"), (None, 0, "Nobody."), ("f", 0, None)],
        "url string, part int, text string",
    )
    sentences = S.section_sentences(parts)
    assert sorted(tuple(r) for r in sentences.collect()) == [
        ("d", 1, "One is here."), ("d", 2, "Two!"), ("d", 3, "Three goes on."), ("d", 4, "Four"), ("e", 1, "AloneAlone"),
    ]
    assert len(counted) == 1
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        # Blocks of sentences keep to the same partitions.
        assert _plan(S.section_sentences(parts)).count("Exchange hashpartitioning") == 1
        assert _plan(S.section_blocks(S.section_sentences(parts), block=8)).count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_parts_of_the_fixture_are_cut_by_characters(spark, tmp_path):
    texts = ["", "a" * 97, "\U0001f600" * 98 + "\n", "x\n" * 150, None]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {}
    for r in _parts(spark, str(tmp_path)).collect():
        found.setdefault(r.url, []).append((r.part, r.text))
    want = {
        f"doc/{i}": [(n, t[n * 97 : (n + 1) * 97]) for n in range(-(-len(t) // 97) + 1)] for i, t in enumerate(texts) if t is not None
    }
    assert {k: sorted(v) for k, v in found.items()} == want

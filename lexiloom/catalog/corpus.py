"""Queries over documents: chunking, chunk table, retrieval, prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom import dimensions as D
from lexiloom.catalog.fixtures import (
    chunk_table, chunks, documents, neighbours_sql, sentence_chunks, spread, sql, table, terms_sql, user_questions,
)
from lexiloom.catalog.registry import query
from lexiloom.functions.text import html_to_text, sentences
from lexiloom.functions.vectors import model_embedding
from lexiloom.operators import chunking as C, quantised as Q, sections as S
from lexiloom.operators.knn import knn, within
from lexiloom.operators.ordering import row_numbers
from lexiloom.operators.substring import containments
from lexiloom.plans import retrieval as R
from lexiloom.plans.ingest import ingest_documents
from lexiloom.session import cut_lineage, scratch_path
from lexiloom.sources.chunk_table import compact, count_chunks, get_chunks_of, open_chunks, open_versions, save_chunks, vacuum
from lexiloom.sources.documents import directory_chunks, write_files


@query("sentence_windows", sql("""
    SELECT url, CAST(pos AS INTEGER) AS pos, concat_ws(' ', lag(s) OVER w, s, lead(s) OVER w) AS neighbourhood
    FROM sents WINDOW w AS (PARTITION BY url ORDER BY pos)""", "sents"))
def sentence_windows(spark, sf):
    docs = documents(spark, sf).withColumn("sents", sentences(F.col("text")))
    return docs.select("url", F.posexplode(C.neighbourhoods(F.col("sents"), " ")).alias("p", "neighbourhood")).select(
        "url", (F.col("p") + 1).alias("pos"), "neighbourhood"
    )


@query("sentence_distance", sql(
    "SELECT url, CAST(pos AS INTEGER) AS pos, round(dist, 9) AS distance FROM dists", "dists"))
def sentence_distance(spark, sf):
    docs = C.with_distances(C.with_sentences(documents(spark, sf)))
    # The outer form keeps the optimizer from testing the array's size with a second run of the UDF.
    return docs.select("url", F.posexplode_outer("dists").alias("p", "d")).where(F.col("d").isNotNull()).select(
        "url", (F.col("p") + 1).alias("pos"), F.round("d", 9).alias("distance")
    )


@query("break_threshold", sql("""
    SELECT u.url, u.n_sentences, round(t.threshold, 9) AS threshold
    FROM (SELECT url, CAST(count(*) AS INTEGER) AS n_sentences FROM sents GROUP BY url) u
    LEFT JOIN thresholds t ON t.url = u.url""", "sents", "thresholds"))
def break_threshold(spark, sf):
    docs = C.with_threshold(C.with_distances(C.with_sentences(documents(spark, sf))))
    return docs.select("url", F.size("sents").alias("n_sentences"), F.round("threshold", 9).alias("threshold"))


@query("semantic_chunks", sql("SELECT chunk_id, chunk_prefix, ordinal, text FROM chunk_texts", "chunk_texts"))
def semantic_chunks(spark, sf):
    return chunks(spark, sf).select("chunk_id", "chunk_prefix", "ordinal", "text")


def _parts(spark, sf, characters: int = 97):
    """The documents cut into parts, in the middle of words and sentences."""
    # One pass over the text, whatever its length; the part after the last one is empty.
    pieces = F.concat(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{characters}}}"), 0), F.array(F.lit("")))
    cuts = F.transform(pieces, lambda s, i: F.struct(i.cast("long").alias("part"), s.alias("text")))
    return documents(spark, sf).select("url", "metadata", F.inline(cuts))


@query("section_sentences", sql("SELECT url, pos, s AS sentence FROM sents", "sents"))
def section_sentences(spark, sf):
    return S.section_sentences(_parts(spark, sf))


@query("section_threshold", sql("SELECT url, round(threshold, 9) AS threshold FROM thresholds", "thresholds"))
def section_threshold(spark, sf):
    blocks = cut_lineage(S.section_blocks(S.section_sentences(_parts(spark, sf)), block=8).select("url", "dists"))
    return S.section_thresholds(blocks).select("url", F.round("threshold", 9).alias("threshold"))


@query("section_chunks", sql("SELECT chunk_id, chunk_prefix, ordinal, text FROM chunk_texts", "chunk_texts"))
def section_chunks(spark, sf):
    return S.section_chunks(_parts(spark, sf), block=8).select("chunk_id", "chunk_prefix", "ordinal", "text")


@query("chunk_ids", sql(r"""
    SELECT chunk_prefix || '_' || (pos - 1) AS chunk_id, chunk_prefix, CAST(pos - 1 AS INTEGER) AS ordinal,
           CAST(len(regexp_extract_all(lower(s), '[\p{L}\p{N}]+')) AS DOUBLE) AS n_terms FROM sents""", "sents"))
def chunk_ids(spark, sf):
    docs = documents(spark, sf)
    exploded = sentence_chunks(docs)
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x)
    return exploded.select("chunk_id", "chunk_prefix", "ordinal", total.alias("n_terms"))


@query("zipped_chunks", sql("""
    SELECT chunk_prefix || '_' || (pos - 1) AS chunk_id, s AS text FROM sents""", "sents"))
def zipped_chunks(spark, sf):
    found = sentences(F.col("text"))
    arrays = documents(spark, sf).select(
        F.transform(found, lambda s, i: F.concat(F.substring(F.md5("url"), 1, 8), F.lit("_"), i.cast("string"))).alias("i"),
        found.alias("t"),
        F.transform(found, lambda s: F.array(F.length(s).cast("float"))).alias("e"),
        F.transform(found, lambda s: F.create_map(F.lit("url"), F.col("url"))).alias("m"),
    )
    return C.zip_chunks(arrays, "i", "t", "e", "m").select("chunk_id", "text")


# The second batch holds the labelled documents, each without its last sentence. One that
# thereby lost its only sentence is not in the batch, so its old chunk stays.
_UPSERTED = """
    SELECT chunk_prefix || '_' || (pos - 1) AS chunk_id, chunk_prefix, CAST(pos - 1 AS INTEGER) AS ordinal, s AS text
    FROM sents WHERE n = 1 OR pos < n OR CAST(substr(url, 5) AS BIGINT) NOT IN (SELECT doc_id FROM labels)"""


def _upserted(spark, sf, mode="replace", tidy=False):
    docs = documents(spark, sf)
    changed = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    path = scratch_path(spark, "chunks")
    save_chunks(spark, path, sentence_chunks(docs, vectors=False), digits=1)
    save_chunks(spark, path, sentence_chunks(changed, drop_last=True, vectors=False), mode, digits=1)
    if tidy:
        compact(spark, path, dead_share=0.0)
        vacuum(spark, path)
    return open_chunks(spark, path)


@query("upsert_chunks", sql(_UPSERTED, "sents"))
def upsert_chunks(spark, sf):
    return _upserted(spark, sf).select("chunk_id", "chunk_prefix", "ordinal", "text")


@query("compacted_chunks", sql(_UPSERTED, "sents"))
def compacted_chunks(spark, sf):
    return _upserted(spark, sf, tidy=True).select("chunk_id", "chunk_prefix", "ordinal", "text")


@query("chunk_history", sql("""
    SELECT 1 AS version, count(*) AS chunks FROM sents
    UNION ALL SELECT 2, count(*) FROM sents
      WHERE n = 1 OR pos < n OR CAST(substr(url, 5) AS BIGINT) NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT 3, count(*) FROM sents
      WHERE n = 1 OR pos < n OR CAST(substr(url, 5) AS BIGINT) NOT IN (SELECT doc_id FROM labels)""", "sents"))
def chunk_history(spark, sf):
    """Chunks after each version: the first batch, a replacing one, and the same batch once more."""
    docs = documents(spark, sf)
    changed = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    path = scratch_path(spark, "chunks")
    for batch in (sentence_chunks(docs, vectors=False), *[sentence_chunks(changed, drop_last=True, vectors=False)] * 2):
        save_chunks(spark, path, batch, digits=1)
    counts = [open_versions(spark, path, v).agg(F.lit(v).alias("version"), F.count(F.lit(1)).alias("chunks")) for v in (1, 2, 3)]
    return counts[0].union(counts[1]).union(counts[2])


@query("index_count", sql("SELECT count(*) AS chunks, count(DISTINCT chunk_prefix) AS documents FROM sents", "sents"))
def index_count(spark, sf):
    return count_chunks(_upserted(spark, sf, mode="upsert"))


@query("chunk_by_id", sql("SELECT chunk_id, text FROM chunk_texts WHERE ordinal = 0", "chunk_texts"))
def chunk_by_id(spark, sf):
    path = scratch_path(spark, "chunks")
    save_chunks(spark, path, chunks(spark, sf), digits=1)
    first = documents(spark, sf).select(F.concat(F.substring(F.md5("url"), 1, 8), F.lit("_0")).alias("chunk_id"))
    return get_chunks_of(open_chunks(spark, path), first, ["text"], digits=1)


@query("directory_ingest", sql("""
    SELECT CAST(row_number() OVER (ORDER BY CAST(substr(url, 5) AS BIGINT), ordinal) - 1 AS INTEGER) AS ordinal, text
    FROM chunk_texts""", "chunk_texts"))
def directory_ingest(spark, sf):
    directory = scratch_path(spark, "markdown")
    name = F.concat(F.lit("doc_"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".md"))
    write_files(documents(spark, sf).select(name.alias("file_name"), "text"), directory)
    return directory_chunks(spark, directory).select("ordinal", "text")


_DENSE = """
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(distance, 6) + 0.0 AS distance FROM (
      SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (
        SELECT q.vec_id AS query_id, c.vec_id, greatest(round(1.0 - list_dot_product(q.v, c.v)
                 / sqrt(list_dot_product(q.v, q.v) * list_dot_product(c.v, c.v)), 12), 0.0) + 0.0 AS distance
        FROM dense q CROSS JOIN dense c)) WHERE rank <= 20"""


@query("phrase_scan", """
    WITH phrases AS (SELECT DISTINCT lower(substr(text, 11, 24)) AS phrase FROM documents WHERE length(text) >= 34)
    SELECT phrase, count(*) AS n_docs, min(doc_id) AS first_doc
    FROM phrases JOIN documents ON contains(lower(text), phrase) GROUP BY phrase""")
def phrase_scan(spark, sf):
    """In how many documents a phrase of each document occurs: a pattern list that grows with the table."""
    docs = table(spark, sf, "documents")
    phrases = docs.where(F.length("text") >= 34).select(F.lower(F.substring("text", 11, 24)).alias("phrase")).distinct()
    hits = containments(docs, "doc_id", "text", phrases.withColumn("term", F.col("phrase")), "phrase", "term")
    return hits.groupBy("phrase").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))


@query("knn_exact", f"WITH dense AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) {_DENSE}")
def knn_exact(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return knn(vectors.withColumnRenamed("vec_id", "query_id"), vectors, item_id="vec_id")


@query("knn_tiled", f"WITH dense AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) {_DENSE}")
def knn_tiled(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return knn(vectors.withColumnRenamed("vec_id", "query_id"), vectors, item_id="vec_id", max_broadcast_queries=0)


# Codebook, codes, candidates and re-ranking of the quantised search, step by step.
_QUANTISED = f"""
    dense AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    unit AS MATERIALIZED (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM dense),
    words AS MATERIALIZED (
      SELECT row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) AS j, u FROM unit QUALIFY j <= {Q.CODEWORDS}),
    parts AS (SELECT vec_id, m, u[2 * m - 1] AS a, u[2 * m] AS b FROM unit, range(1, {Q.PARTS} + 1) r(m)),
    word_parts AS (SELECT j, m, u[2 * m - 1] AS a, u[2 * m] AS b FROM words, range(1, {Q.PARTS} + 1) r(m)),
    coded AS (
      SELECT p.vec_id, p.m, arg_min(ROW(w.a, w.b), ((p.a - w.a) * (p.a - w.a) + (p.b - w.b) * (p.b - w.b), w.j)) AS w
      FROM parts p JOIN word_parts w USING (m) GROUP BY p.vec_id, p.m),
    decoded AS MATERIALIZED (SELECT vec_id, flatten(list([w[1], w[2]] ORDER BY m)) AS c FROM coded GROUP BY vec_id),
    candidates AS MATERIALIZED (
      SELECT q.vec_id AS query_id, d.vec_id FROM unit q CROSS JOIN decoded d
      QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(1.0 - list_dot_product(q.u, d.c), 12), d.vec_id) <= {Q.DEPTH}),
    near AS MATERIALIZED (
      SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, distance FROM (
        SELECT query_id, n.vec_id, greatest(round(1.0 - list_dot_product(q.v, c.v)
          / sqrt(list_dot_product(q.v, q.v) * list_dot_product(c.v, c.v)), 12), 0.0) + 0.0 AS distance
        FROM candidates n JOIN dense q ON q.vec_id = query_id JOIN dense c ON c.vec_id = n.vec_id)
      QUALIFY rank <= {D.TOP_K})"""


@query("knn_quantised", f"WITH {_QUANTISED} SELECT query_id, rank, vec_id, round(distance, 6) + 0.0 AS distance FROM near")
def knn_quantised(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return Q.quantised_knn(vectors.withColumnRenamed("vec_id", "query_id"), vectors, item_id="vec_id")


@query("knn_approx_recall", f"""
    WITH {_QUANTISED}, exact AS ({_DENSE}), hits AS (
      SELECT e.vec_id, n.vec_id AS hit FROM exact e LEFT JOIN near n ON n.query_id = e.query_id AND n.vec_id = e.vec_id)
    SELECT count(*) AS neighbours, count(hit) AS found, count(hit) / count(*) AS recall FROM hits""")
def knn_approx_recall(spark, sf):
    vectors = table(spark, sf, "embeddings")
    asked = vectors.withColumnRenamed("vec_id", "query_id")
    exact = knn(asked, vectors, item_id="vec_id")
    near = Q.quantised_knn(asked, vectors, item_id="vec_id").select("query_id", "vec_id", F.lit(1).alias("hit"))
    return exact.join(near, ["query_id", "vec_id"], "left").agg(
        F.count(F.lit(1)).alias("neighbours"),
        F.count("hit").alias("found"),
        (F.count("hit") / F.count(F.lit(1))).alias("recall"),
    )


_QUESTION_VIEWS = {"question_terms": terms_sql("user_questions", "query_id", "question")}
_CHUNK_KNN = neighbours_sql("question_terms", "user_questions", "chunk_texts", "chunk_id", "chunk_terms", D.TOP_K)


def _questions(spark, sf):
    return R.with_embedding(spread(user_questions(spark, sf)), "question")


def _shown(neighbours):
    """Neighbours with the short ``chunk_id`` of the SQL in place of the full key."""
    short = F.concat(F.substring("chunk_key", 1, 8), F.substring(F.col("chunk_key"), 33, 12))
    return neighbours.select("query_id", "rank", short.alias("chunk_id"), "distance")


@query("knn_chunks", sql("SELECT * FROM near", "user_questions", "chunk_texts", "chunk_terms",
                         **_QUESTION_VIEWS, near=_CHUNK_KNN))
def knn_chunks(spark, sf):
    return _shown(R.nearest_chunks(_questions(spark, sf), chunks(spark, sf)))


@query("context_by_query", sql("""
    SELECT query_id, count(*) AS n_chunks, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context
    FROM near JOIN chunk_texts USING (chunk_id) GROUP BY query_id""", "user_questions", "chunk_texts", "chunk_terms",
    **_QUESTION_VIEWS, near=_CHUNK_KNN))
def context_by_query(spark, sf):
    return R.retrieve(_questions(spark, sf), chunk_table(spark, sf))


_COMBINED = {
    "requests": "SELECT DISTINCT request_id AS query_id FROM user_questions",
    "request_terms": terms_sql("(SELECT request_id AS query_id, question FROM user_questions)", "query_id", "question"),
    "near": neighbours_sql("request_terms", "requests", "chunk_texts", "chunk_id", "chunk_terms", D.TOP_K),
}


@query("knn_batch_query", sql("SELECT * FROM near", "user_questions", "chunk_texts", "chunk_terms", **_COMBINED))
def knn_batch_query(spark, sf):
    combined = R.combined_queries(_questions(spark, sf)).withColumnRenamed("request_id", "query_id")
    return _shown(R.nearest_chunks(combined, chunks(spark, sf)))


def _load_prefix_counts():
    """A model of 96 components: how often the words' first three letters fall into each bucket."""
    import hashlib
    import re
    from functools import lru_cache

    find = re.compile(r"[^\W_]+").findall

    @lru_cache(1 << 16)
    def bucket(start):
        return int(hashlib.md5(start.encode()).hexdigest()[:7], 16) % 96

    def embed(texts):
        made = []
        for text in texts:
            vector = [0.0] * 96
            for word in find(text.lower()):
                vector[bucket(word[:3])] += 1.0
            made.append(vector)
        return made

    return embed


PREFIX_COUNTS = model_embedding("prefix_counts", 96, _load_prefix_counts)
_PREFIX_TERMS = r"""
    SELECT {key}, ('0x' || substr(md5(substr(t, 1, 3)), 1, 7))::BIGINT % 96 AS b, count(*) AS c
    FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+')) AS t FROM {source}) GROUP BY ALL"""


@query("model_retrieval", sql("SELECT * FROM near", "user_questions", "chunk_texts", **{
    "requests": _COMBINED["requests"],
    "asked_terms": _PREFIX_TERMS.format(key="query_id", text="question", source="(SELECT request_id AS query_id, question FROM user_questions)"),
    "held_terms": _PREFIX_TERMS.format(key="chunk_id", text="text", source="chunk_texts"),
    "near": neighbours_sql("asked_terms", "requests", "chunk_texts", "chunk_id", "held_terms", D.TOP_K),
}))
def model_retrieval(spark, sf):
    """Ingest with a model of another length, then search for the joined questions of every request."""
    path = scratch_path(spark, "model-chunks")
    ingest_documents(spark, documents(spark, sf), path, embedding=PREFIX_COUNTS, digits=1)
    asked = R.combined_queries(user_questions(spark, sf), embedding=PREFIX_COUNTS, order=["turn"])
    return _shown(R.nearest_chunks(asked.withColumnRenamed("request_id", "query_id"), open_chunks(spark, path)))


@query("empty_index", sql(f"""
    SELECT query_id, false AS is_answerable, '{D.MSG_EMPTY_INDEX}' AS errors FROM user_questions""", "user_questions"))
def empty_index(spark, sf):
    """Questions asked before anything is indexed."""
    asked, corpus = _questions(spark, sf), open_chunks(spark, scratch_path(spark, "no-chunks"))
    found = R.retrieve(asked, corpus)
    guarded = R.guarded_answers(asked.select("query_id", F.lit(1).alias("n_questions")), found, corpus)
    return guarded.select("query_id", "is_answerable", F.array_join("errors", "\n").alias("errors"))


_NEAREST = neighbours_sql("question_terms", "user_questions", "chunk_texts", "chunk_id", "chunk_terms", 1)
_LIMIT = 0.35


@query("retrieval_guard", sql(f"""
    SELECT u.query_id, f.context IS NOT NULL AS is_answerable, md5(f.context) AS context_md5,
           CASE WHEN f.context IS NULL THEN '{D.MSG_NO_RESULT}' END AS errors
    FROM user_questions u LEFT JOIN (SELECT query_id, text AS context FROM near JOIN chunk_texts USING (chunk_id)
                                     WHERE distance <= {_LIMIT}) f ON f.query_id = u.query_id""",
    "user_questions", "chunk_texts", "chunk_terms", **_QUESTION_VIEWS, near=_NEAREST))
def retrieval_guard(spark, sf):
    asked, corpus = _questions(spark, sf), chunk_table(spark, sf)
    found = R.contexts(within(R.nearest_chunks(asked, corpus, k=1), _LIMIT), corpus)
    guarded = R.guarded_answers(asked.select("query_id", F.lit(1).alias("n_questions")), found, corpus)
    return guarded.select(
        "query_id", "is_answerable", F.md5("context").alias("context_md5"), F.array_join("errors", "\n").alias("errors")
    )


@query("similar_question", sql("SELECT query_id, item_id, distance FROM near WHERE distance <= 0.6", "user_questions",
    **_QUESTION_VIEWS,
    cached_terms=terms_sql("benchmark", "item_id", "text"),
    near=neighbours_sql("question_terms", "user_questions", "benchmark", "item_id", "cached_terms", 1)))
def similar_question(spark, sf):
    cached = R.with_embedding(table(spark, sf, "benchmark"), "text")
    nearest = knn(_questions(spark, sf), cached, k=1, item_id="item_id")
    return within(nearest, 0.6).select("query_id", "item_id", "distance")


@query("question_batches", sql(
    "SELECT request_id, batch_no, array_to_string(questions, chr(10)) AS questions FROM batches", "batches"))
def question_batches(spark, sf):
    batches = R.question_batches(user_questions(spark, sf), "request_id", ["turn"], "question")
    return batches.withColumn("questions", F.array_join("questions", "\n"))


_NUMBERED = "array_to_string(list_transform(questions, lambda q, i: i || '. ' || q), chr(10))"


@query("numbered_questions", sql(f"SELECT request_id, batch_no, {_NUMBERED} AS query_list FROM batches", "batches"))
def numbered_questions(spark, sf):
    batches = R.question_batches(user_questions(spark, sf), "request_id", ["turn"], "question")
    return batches.select("request_id", "batch_no", R.numbered_list(F.col("questions")).alias("query_list"))


_PAGE_NAME = r"regexp_extract(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1)"


@query("prefixed_questions", sql(f"""
    SELECT query_id, '[' || {_PAGE_NAME} || '] ' || question AS question
    FROM user_questions JOIN pages ON page_id = request_id % (SELECT count(*) FROM pages)""", "user_questions"))
def prefixed_questions(spark, sf):
    pages = table(spark, sf, "pages")
    asked = user_questions(spark, sf).withColumn("page_id", F.col("request_id") % pages.count())
    return asked.join(pages.select("page_id", "url"), "page_id").select(
        "query_id", R.prefixed_question(F.col("url"), F.col("question")).alias("question")
    )


_TEMPLATE_SQL = R.PROMPT_TEMPLATE.replace("'", "''")


@query("prompts", sql(f"""
    SELECT b.request_id, b.batch_no, replace(replace(replace('{_TEMPLATE_SQL}', '{{count}}', CAST(len(b.questions) AS VARCHAR)),
             '{{query_list}}', {_NUMBERED}), '{{context_str}}', c.context) AS prompt
    FROM batches b JOIN (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context
                         FROM near JOIN chunk_texts USING (chunk_id) GROUP BY query_id) c ON c.query_id = b.request_id""",
    "batches", "user_questions", "chunk_texts", "chunk_terms", **_COMBINED))
def prompts(spark, sf):
    asked = user_questions(spark, sf)
    combined = R.combined_queries(_questions(spark, sf)).withColumnRenamed("request_id", "query_id")
    found = R.retrieve(combined, chunk_table(spark, sf)).withColumnRenamed("query_id", "request_id")
    batches = R.question_batches(asked, "request_id", ["turn"], "question")
    return batches.join(found, "request_id").select(
        "request_id", "batch_no", R.prompt(F.col("questions"), F.col("context")).alias("prompt")
    )


_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"


@query("html_text", rf"""
    SELECT page_id, array_to_string(list_filter(list_transform(string_split(
        replace(replace(replace(replace(replace(replace(replace(
          regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', chr(1), 'g'),
            '(?is)<script[^>]*>.*?</script>', chr(1), 'g'), '(?is)<style[^>]*>.*?</style>', chr(1), 'g'), '<[^>]*>', chr(1), 'g'),
          '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'),
        chr(1)), lambda x: trim(x, {_TRIM})), lambda x: x <> ''), chr(10)) AS text FROM pages""")
def html_text(spark, sf):
    return spread(table(spark, sf, "pages")).select("page_id", html_to_text(F.col("html")).alias("text"))


@query("question_numbers", sql("SELECT query_id, question_no FROM numbered", "numbered"))
def question_numbers(spark, sf):
    asked = user_questions(spark, sf)
    return row_numbers(asked, ["request_id"], ["turn"], "question_no", max_group=0).select("query_id", "question_no")

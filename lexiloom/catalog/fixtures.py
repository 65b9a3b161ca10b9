"""Views derived from the supplied tables, once as DataFrames and once as SQL.

The supplied data holds no request log, block list, raw model output or statuses; these
views derive them row by row from tables that do exist. ``sql`` puts the views a query
needs in front of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexiloom import dimensions as D
from lexiloom.functions.text import sentences
from lexiloom.functions.urls import chunk_id, chunk_prefix, document_key
from lexiloom.functions.vectors import with_term_vector
from lexiloom.operators.chunking import semantic_chunks
from lexiloom.session import cut_lineage


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Spread rows over the cores where the input has fewer files than there are cores.

    A table of one file with one row group is one task; large tables have files enough
    and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"))
    return docs.select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("url"), "doc_id", "text",
        F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("metadata"),
    )


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return semantic_chunks(documents(spark, sf))


def chunk_table(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks as a written table, for queries that read them more than once."""
    return cut_lineage(chunks(spark, sf).drop("metadata"))


def sentence_chunks(docs: DataFrame, drop_last: bool = False, vectors: bool = True) -> DataFrame:
    """Every sentence as a chunk of its own; optionally without the document's last one.

    The vectors can be left to ``save_chunks``, which computes the same ones where the rows are written.
    """
    url = F.col("url")
    split = docs.select(
        "url", chunk_prefix(url).alias("chunk_prefix"), document_key(url).alias("doc_key"),
        F.create_map(F.lit("url"), url).alias("metadata"), sentences(F.col("text")).alias("found"),
    )
    kept = F.slice("found", F.lit(1), F.greatest(F.size("found") - 1, F.lit(0))) if drop_last else F.col("found")
    # The outer form keeps the optimizer from testing the array's size with a second split of every text.
    rows = split.select("chunk_prefix", "doc_key", "metadata", F.posexplode_outer(kept).alias("ordinal", "text"))
    rows = rows.where(F.col("ordinal").isNotNull())
    columns = [
        chunk_id(F.col("chunk_prefix"), F.col("ordinal")).alias("chunk_id"), "chunk_prefix", "doc_key", "ordinal", "text",
    ]
    if not vectors:
        return rows.select(*columns, "metadata")
    return with_term_vector(rows, "text").select(*columns, "embedding", "metadata")


def request_log(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    return log_of(events, table(spark, sf, "pages"))


def log_of(events: DataFrame, pages: DataFrame) -> DataFrame:
    """Request log out of events (batch or stream) and the table of pages."""
    n_pages = pages.count()
    e = F.col("event_id")

    def nth(i: Column) -> Column:
        return F.concat(F.lit("Answer "), i.cast("string"), F.lit(" of "), F.col("props"))

    def some(n: Column) -> Column:
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n.cast("int") - 1), nth)).otherwise(
            F.array().cast("array<string>")
        )

    answers = (
        F.when(e % 19 == 0, F.lit(None).cast("array<string>"))
        .when(e % 13 == 0, F.array().cast("array<string>"))
        .when(F.col("event_type") == "error", F.concat(some(e % 5), F.array(F.concat(F.lit("Error: "), "props"))))
        .when(F.col("event_type") == "view", F.array(F.concat(F.lit("Error processing "), "props")))
        .otherwise(some(e % 5 + 1))
    )
    urls = pages.select(F.col("page_id").alias("__page"), "url")
    joined = events.join(urls, e % n_pages == F.col("__page"), "left")
    return joined.select(
        F.concat(F.lit("r"), e.cast("string")).alias("request_id"),
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.to_date("ts").alias("log_date"),
        F.when(e % 31 != 0, F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("unix_timestamp"),
        F.col("user_id").alias("tenant"),
        "event_type",
        F.when(e % 17 == 0, F.lit(None)).when(e % 23 == 0, F.lit("")).otherwise(F.col("url")).alias("documents"),
        (e % 5 + 1).cast("int").alias("question_count"),
        F.when(e % 11 == 0, 0.0).when(e % 29 != 0, F.col("value")).alias("processing_time"),
        answers.alias("answers"),
    )


def status_events(spark: SparkSession, sf: str) -> DataFrame:
    return status_of(request_log(spark, sf))


def status_of(log: DataFrame) -> DataFrame:
    """Status events of the requested documents, by event type."""
    kind = F.col("event_type")
    status = (
        F.when(kind == "signup", "not_started").when(kind == "purchase", "completed")
        .when(kind == "error", "failed").otherwise("processing")
    )
    protected = F.when(kind == "signup", True).when(kind.isin("purchase", "error"), False)
    return log.where(F.coalesce(F.col("documents"), F.lit("")) != "").select(
        F.col("documents").alias("document_id"), "ts", F.col("event_id").alias("seq"),
        status.alias("status"), protected.alias("protected"),
    )


def block_list(spark: SparkSession, sf: str) -> DataFrame:
    """Hosts that ever served a spam page."""
    pages = table(spark, sf, "pages").where(F.contains("url", F.lit("spam-farm")) | F.contains("url", F.lit("cheap-pills")))
    return pages.select(F.regexp_extract("url", r"^https?://([^/?#]*)", 1).alias("pattern")).distinct()


_EXTENSIONS = [ext for exts in D.EXTENSIONS.values() for ext in exts] + [""]


def file_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Page URLs that cycle through all extensions (and none) and several URL forms."""
    p = F.col("page_id")
    base = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"/+$", "")
    ext = F.element_at(F.array(*[F.lit(x) for x in _EXTENSIONS]), (p % len(_EXTENSIONS)).cast("int") + 1)
    form = p % 6
    url = (
        F.when(form == 0, F.concat(base, ext))
        .when(form == 1, F.concat(base, F.upper(ext), F.lit("?v=1.zip#a.b")))
        .when(form == 2, F.concat(base, F.lit(".tar"), ext, F.lit(";p=1")))
        .when(form == 3, F.concat(F.regexp_replace(base, "^https?://", "s3://"), ext))
        .when(form == 4, F.concat(base, F.lit("/a b"), ext, F.lit("/")))
        .otherwise(F.concat(F.regexp_replace(base, "^https?://", "/data/"), ext))
    )
    return table(spark, sf, "pages").select(F.col("page_id").alias("id"), url.alias("url"))


def doc_pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("source").alias("doc"), F.col("doc_id").alias("page_no"),
        F.length(F.trim("text")).alias("text_length"), (F.col("doc_id") % 3).cast("int").alias("image_count"),
    )


def raw_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Model outputs in ten states of repair, out of whole conversation turns."""
    text = F.regexp_replace("text", r'["\\\x00-\x1f]', " ")
    form = (F.col("conv_id") + F.col("turn")) % 10

    def put(before: str, after: str) -> Column:
        return F.concat(F.lit(before), text, F.lit(after))

    raw = (
        F.when(form == 0, put('{"answers": ["', '", "A second answer"]}'))
        .when(form == 1, put('```json\n{"answers": ["', '", "A second answer", "  "]}\n```'))
        .when(form == 2, put('{"answers": ["', '", "A second answer",]}'))
        .when(form == 3, put('{"answers": ["', '", "A second answer", "Half an ans'))
        .when(form == 4, put('Here it is: {"answers": ["', '"]} as you asked'))
        .when(form == 5, put("", ""))
        .when(form == 6, put('{"answer": "', '"}'))
        .when(form == 7, put('["', '", "A second answer"]'))
        .when(form == 8, put('They said "', '" and "too short" and "answers"'))
        .otherwise(put('```\n{"answers": ["503 UNAVAILABLE", "', '"]}\n``` done'))
    )
    return spread(table(spark, sf, "conversations")).select(
        F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        "conv_id", "turn", (F.col("turn") % 4 + 1).cast("int").alias("n_questions"), raw.alias("raw"),
    )


def cache_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answer lists of cache calls, some refused, some unavailable, some failed."""
    kind = (F.col("conv_id") + 2 * F.col("turn")) % 7
    denied = F.lit(D.MSG_DENIED)
    answers = (
        F.when(kind == 0, F.array(denied, F.concat(F.lit("x "), denied)))
        .when(kind == 1, F.array(F.col("text"), denied))
        .when(kind == 2, F.array(F.col("text"), F.lit("503 - Unavailable")))
        .when(kind == 3, F.array(F.lit("Cache processing failed - code 503"), F.col("text")))
        .when(kind == 4, F.array().cast("array<string>"))
        .otherwise(F.array(F.col("text"), F.lit("Fine")))
    )
    return table(spark, sf, "conversations").select(
        F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"),
        F.concat(F.lit("https://h/"), F.col("conv_id").cast("string"), F.lit(".pdf")).alias("url"),
        F.lit(2).alias("n_questions"), answers.alias("answers"),
        F.when(kind == 5, "Model is Temporarily Overloaded").alias("error"),
        F.col("role"), F.col("text"),
    )


def user_questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").where(F.col("role") == "user").select(
        F.col("conv_id").alias("request_id"), "turn",
        F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"),
        F.col("text").alias("question"),
    )


def lookup_dim(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("ord"), F.col("n_name").alias("key"), F.col("r_name").alias("value")
    )


# ---- the same views as SQL -------------------------------------------------------------

_EXT_ROWS = ", ".join(f"('{e}', '{c}')" for c, exts in D.EXTENSIONS.items() for e in exts)
_EXT_LIST = "[" + ", ".join(f"'{e}'" for e in _EXTENSIONS) + "]"
_EMPTY = "CAST([] AS VARCHAR[])"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "extension_dim": ((), f"SELECT * FROM (VALUES {_EXT_ROWS}) t(ext, category)"),
    "request_log": ((), f"""
        SELECT 'r' || e.event_id AS request_id, e.event_id, e.ts, CAST(e.ts AS DATE) AS log_date,
               CASE WHEN e.event_id % 31 <> 0 THEN epoch_us(e.ts) / 1000000.0 END AS unix_timestamp,
               e.user_id AS tenant, e.event_type,
               CASE WHEN e.event_id % 17 = 0 THEN NULL WHEN e.event_id % 23 = 0 THEN '' ELSE p.url END AS documents,
               CAST(1 + e.event_id % 5 AS INTEGER) AS question_count,
               CASE WHEN e.event_id % 11 = 0 THEN 0.0 WHEN e.event_id % 29 = 0 THEN NULL ELSE e.value END AS processing_time,
               CASE WHEN e.event_id % 19 = 0 THEN NULL WHEN e.event_id % 13 = 0 THEN {_EMPTY}
                    WHEN e.event_type = 'error' THEN list_concat(
                        list_transform(range(e.event_id % 5), lambda i: 'Answer ' || i || ' of ' || e.props),
                        ['Error: ' || e.props])
                    WHEN e.event_type = 'view' THEN ['Error processing ' || e.props]
                    ELSE list_transform(range(1 + e.event_id % 5), lambda i: 'Answer ' || i || ' of ' || e.props)
               END AS answers
        FROM events e LEFT JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages)"""),
    "status_events": (("request_log",), """
        SELECT documents AS document_id, ts, event_id AS seq,
               CASE event_type WHEN 'signup' THEN 'not_started' WHEN 'purchase' THEN 'completed'
                               WHEN 'error' THEN 'failed' ELSE 'processing' END AS status,
               CASE WHEN event_type = 'signup' THEN true WHEN event_type IN ('purchase', 'error') THEN false END AS protected
        FROM request_log WHERE documents <> ''"""),
    "current_status": (("status_events",), """
        SELECT document_id, last(status ORDER BY ts, seq) AS status,
               coalesce(last(protected ORDER BY ts, seq) FILTER (WHERE protected IS NOT NULL), false) AS protected
        FROM status_events GROUP BY document_id"""),
    "block_list": ((), """
        SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]*)', 1) AS pattern FROM pages
        WHERE contains(url, 'spam-farm') OR contains(url, 'cheap-pills')"""),
    "file_urls": ((), f"""
        SELECT id, CASE form WHEN 0 THEN base || ext
                 WHEN 1 THEN base || upper(ext) || '?v=1.zip#a.b'
                 WHEN 2 THEN base || '.tar' || ext || ';p=1'
                 WHEN 3 THEN regexp_replace(base, '^https?://', 's3://') || ext
                 WHEN 4 THEN base || '/a b' || ext || '/'
                 ELSE regexp_replace(base, '^https?://', '/data/') || ext END AS url
        FROM (SELECT page_id AS id, page_id % 6 AS form,
                     regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS base,
                     ({_EXT_LIST})[1 + page_id % {len(_EXTENSIONS)}] AS ext FROM pages)"""),
    "typed_urls": (("file_urls", "extension_dim"), r"""
        SELECT u.id, u.url, u.ext, coalesce(d.category, 'unsupported') AS category
        FROM (SELECT id, url, lower(regexp_extract(regexp_replace(
                CASE WHEN url LIKE 'http://%' OR url LIKE 'https://%'
                     THEN regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ';[^/]*$', '')
                     ELSE url END, '(/\.?)+$', ''), '[^/](\.[^./]+)$', 1)) AS ext FROM file_urls) u
        LEFT JOIN extension_dim d ON d.ext = u.ext"""),
    "doc_pages": ((), """
        SELECT source AS doc, doc_id AS page_no, length(trim(text)) AS text_length, doc_id % 3 AS image_count FROM documents"""),
    "page_stats": (("doc_pages",), """
        SELECT doc, max(total_pages) AS total_pages, count(*) AS analysed_pages,
               count(*) FILTER (WHERE text_length > 100) AS text_pages, count(*) FILTER (WHERE image_count > 0) AS image_pages,
               CAST(sum(text_length) AS BIGINT) AS total_text_length, CAST(sum(image_count) AS BIGINT) AS total_images
        FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page_no) AS rn,
                     count(*) OVER (PARTITION BY doc) AS total_pages FROM doc_pages)
        WHERE rn <= 10 GROUP BY doc"""),
    "page_ratios": (("page_stats",), """
        SELECT doc, total_pages, analysed_pages, text_pages, image_pages,
               text_pages / analysed_pages AS text_ratio, image_pages / analysed_pages AS image_ratio,
               total_text_length / analysed_pages AS avg_text_per_page, total_images / analysed_pages AS avg_images_per_page,
               total_text_length, total_images FROM page_stats"""),
    "raw_answers": ((), r"""
        SELECT conv_id || '_' || turn AS id, conv_id, turn, CAST(turn % 4 + 1 AS INTEGER) AS n_questions, t,
               (conv_id + turn) % 10 AS form,
               CASE (conv_id + turn) % 10
                 WHEN 0 THEN '{"answers": ["' || t || '", "A second answer"]}'
                 WHEN 1 THEN '```json' || chr(10) || '{"answers": ["' || t || '", "A second answer", "  "]}' || chr(10) || '```'
                 WHEN 2 THEN '{"answers": ["' || t || '", "A second answer",]}'
                 WHEN 3 THEN '{"answers": ["' || t || '", "A second answer", "Half an ans'
                 WHEN 4 THEN 'Here it is: {"answers": ["' || t || '"]} as you asked'
                 WHEN 5 THEN t
                 WHEN 6 THEN '{"answer": "' || t || '"}'
                 WHEN 7 THEN '["' || t || '", "A second answer"]'
                 WHEN 8 THEN 'They said "' || t || '" and "too short" and "answers"'
                 ELSE '```' || chr(10) || '{"answers": ["503 UNAVAILABLE", "' || t || '"]}' || chr(10) || '``` done' END AS raw
        FROM (SELECT *, regexp_replace(text, '["\\\x00-\x1f]', ' ', 'g') AS t FROM conversations)"""),
    "three_raw": (("raw_answers",), "SELECT * REPLACE (least(n_questions, 3) AS n_questions) FROM raw_answers"),
    "unfenced": (("raw_answers",), r"""
        SELECT id, conv_id, turn, n_questions, form, raw, CASE WHEN starts_with(r, '```') AND last_fence > 1 THEN
                 trim(CASE WHEN starts_with(r, '```json') THEN substr(r, 8, last_fence - 8)
                           ELSE substr(r, 4, last_fence - 4) END, ' ' || chr(9) || chr(10) || chr(13)) ELSE r END AS body
        FROM (SELECT *, CASE WHEN contains(r, '```') THEN length(r) - strpos(reverse(r), '```') - 1 ELSE 0 END AS last_fence
              FROM (SELECT *, trim(raw, ' ' || chr(9) || chr(10) || chr(13)) AS r FROM raw_answers))"""),
    "cache_answers": ((), f"""
        SELECT conv_id || '_' || turn AS request_id, 'https://h/' || conv_id || '.pdf' AS url, role, text,
               CASE (conv_id + 2 * turn) % 7
                 WHEN 0 THEN ['{D.MSG_DENIED}', 'x {D.MSG_DENIED}'] WHEN 1 THEN [text, '{D.MSG_DENIED}']
                 WHEN 2 THEN [text, '503 - Unavailable'] WHEN 3 THEN ['Cache processing failed - code 503', text]
                 WHEN 4 THEN {_EMPTY} ELSE [text, 'Fine'] END AS answers,
               CASE WHEN (conv_id + 2 * turn) % 7 = 5 THEN 'Model is Temporarily Overloaded' END AS error
        FROM conversations"""),
    "user_questions": ((), """
        SELECT conv_id AS request_id, turn, conv_id || '_' || turn AS query_id, text AS question
        FROM conversations WHERE role = 'user'"""),
    "numbered": (("user_questions",), """
        SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY turn) AS question_no FROM user_questions"""),
    "batches": (("numbered",), """
        SELECT request_id, CAST((question_no - 1) // 3 + 1 AS INTEGER) AS batch_no,
               list(question ORDER BY question_no) AS questions
        FROM numbered GROUP BY ALL"""),
    "lookup_dim": ((), """
        SELECT n_nationkey AS ord, n_name AS key, r_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey"""),
    "sents": ((), r"""
        SELECT url, substr(md5(url), 1, 8) AS chunk_prefix, unnest(ss) AS s, unnest(range(1, len(ss) + 1)) AS pos, len(ss) AS n
        FROM (SELECT 'doc/' || doc_id AS url, list_filter(string_split(
                regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS ss FROM documents)"""),
    "sent_terms": (("sents",), r"""
        SELECT url, pos, ('0x' || substr(md5(t), 1, 7))::BIGINT % 64 AS b, count(*) AS c
        FROM (SELECT url, pos, unnest(regexp_extract_all(lower(s), '[\p{L}\p{N}]+')) AS t FROM sents) GROUP BY ALL"""),
    "groups": (("sent_terms", "sents"), """
        SELECT g.url, g.pos, g.b, g.c FROM
          (SELECT url, pos + d AS pos, b, CAST(sum(c) AS BIGINT) AS c FROM sent_terms, (VALUES (-1), (0), (1)) v(d) GROUP BY ALL) g
        JOIN sents s ON s.url = g.url AND s.pos = g.pos"""),
    "dists": (("groups", "sents"), """
        SELECT s.url, s.pos, CASE WHEN coalesce(a.n2, 0) = 0 OR coalesce(b.n2, 0) = 0 THEN 1.0
                    ELSE 1.0 - coalesce(d.dot, 0) / sqrt(CAST(a.n2 * b.n2 AS DOUBLE)) END AS dist
        FROM sents s
        LEFT JOIN (SELECT url, pos, CAST(sum(c * c) AS BIGINT) AS n2 FROM groups GROUP BY ALL) a ON a.url = s.url AND a.pos = s.pos
        LEFT JOIN (SELECT url, pos, CAST(sum(c * c) AS BIGINT) AS n2 FROM groups GROUP BY ALL) b ON b.url = s.url AND b.pos = s.pos + 1
        LEFT JOIN (SELECT x.url, x.pos, CAST(sum(x.c * y.c) AS DOUBLE) AS dot FROM groups x JOIN groups y
                   ON y.url = x.url AND y.pos = x.pos + 1 AND y.b = x.b GROUP BY ALL) d ON d.url = s.url AND d.pos = s.pos
        WHERE s.pos < s.n"""),
    "thresholds": (("dists",), "SELECT url, quantile_cont(dist, 0.95) AS threshold FROM dists GROUP BY url"),
    "segments": (("sents", "dists", "thresholds"), """
        SELECT s.url, s.chunk_prefix, s.pos, s.s, CAST(coalesce(sum(CASE WHEN d.dist > t.threshold THEN 1 ELSE 0 END) OVER (
                   PARTITION BY s.url ORDER BY s.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS ordinal
        FROM sents s LEFT JOIN dists d ON d.url = s.url AND d.pos = s.pos LEFT JOIN thresholds t ON t.url = s.url"""),
    "chunk_terms": (("segments", "sent_terms"), """
        SELECT g.chunk_prefix || '_' || g.ordinal AS chunk_id, t.b, CAST(sum(t.c) AS BIGINT) AS c
        FROM segments g JOIN sent_terms t ON t.url = g.url AND t.pos = g.pos GROUP BY ALL"""),
    "chunk_texts": (("segments",), """
        SELECT chunk_prefix || '_' || ordinal AS chunk_id, chunk_prefix, ordinal, url, string_agg(s, ' ' ORDER BY pos) AS text
        FROM segments GROUP BY ALL"""),
    "chunk_norms": (("chunk_texts", "chunk_terms"), """
        SELECT c.chunk_id, coalesce(CAST(sum(t.c * t.c) AS BIGINT), 0) AS n2 FROM chunk_texts c
        LEFT JOIN chunk_terms t ON t.chunk_id = c.chunk_id GROUP BY ALL"""),
}


def neighbours_sql(query_terms: str, query_ids: str, items: str, item_id: str, item_terms: str, k: int) -> str:
    """Ranked cosine neighbours out of sparse term tables ``(id, b, c)``."""
    return f"""
        SELECT query_id, CAST(rank AS INTEGER) AS rank, item_id AS {item_id}, round(distance, 6) + 0.0 AS distance FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS rank FROM (
            SELECT q.query_id, i.{item_id} AS item_id,
                   CASE WHEN q.n2 = 0 OR i.n2 = 0 THEN 1.0
                        ELSE greatest(round(1.0 - coalesce(d.dot, 0) / sqrt(CAST(q.n2 AS DOUBLE) * i.n2), 12), 0.0) + 0.0 END AS distance
            FROM (SELECT u.query_id, coalesce(CAST(sum(t.c * t.c) AS BIGINT), 0) AS n2 FROM {query_ids} u
                  LEFT JOIN {query_terms} t ON t.query_id = u.query_id GROUP BY ALL) q
            CROSS JOIN (SELECT u.{item_id}, coalesce(CAST(sum(t.c * t.c) AS BIGINT), 0) AS n2 FROM {items} u
                  LEFT JOIN {item_terms} t ON t.{item_id} = u.{item_id} GROUP BY ALL) i
            LEFT JOIN (SELECT x.query_id, y.{item_id}, CAST(sum(x.c * y.c) AS DOUBLE) AS dot FROM {query_terms} x
                  JOIN {item_terms} y ON y.b = x.b GROUP BY ALL) d ON d.query_id = q.query_id AND d.{item_id} = i.{item_id}))
        WHERE rank <= {k}"""


def terms_sql(source: str, key: str, text: str) -> str:
    """Sparse term table ``(key, b, c)`` of the texts of a table."""
    return rf"""
        SELECT {key}, ('0x' || substr(md5(t), 1, 7))::BIGINT % 64 AS b, count(*) AS c
        FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+')) AS t FROM {source}) GROUP BY ALL"""


def sql(select: str, *views: str, **extra: str) -> str:
    """A query with the views it needs, each after those it builds on, in front."""
    ordered: dict[str, str] = {}

    def need(name: str) -> None:
        if name in ordered:
            return
        requires, text = VIEWS[name]
        for other in requires:
            need(other)
        ordered[name] = text

    for view in views:
        need(view)
    ordered.update(extra)
    heads = ",\n".join(f"{name} AS MATERIALIZED ({text})" for name, text in ordered.items())
    return f"WITH {heads}\n{select}" if heads else select

"""Queries over URLs: classification, gates, ingest results."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom import dimensions as D
from lexiloom.catalog.fixtures import block_list, doc_pages, documents, file_urls, sentence_chunks, sql, table
from lexiloom.catalog.registry import query
from lexiloom.functions import filetypes as T, urls as U
from lexiloom.operators import gates, ingest, pages as P
from lexiloom.plans.ingest import batch_ingest_report, document_outcomes


@query("url_extension", sql("SELECT id, url, ext FROM typed_urls", "typed_urls"))
def url_extension(spark, sf):
    return file_urls(spark, sf).withColumn("ext", U.file_extension(F.col("url")))


@query("url_category", sql("""
    SELECT id, category, category NOT IN ('archive', 'binary', 'media', 'unsupported') AS is_supported,
           category IN ('presentation', 'spreadsheet') AS forced,
           category IN ('document', 'image', 'html', 'email') AS cacheable,
           ext IN ('.doc', '.docx', '.docm', '.dot', '.dotm') AS is_word,
           category = 'email' AS is_email, contains(lower(url), '.pdf') AS is_pdf FROM typed_urls""", "typed_urls"))
def url_category(spark, sf):
    category, ext = F.col("category"), F.col("ext")
    return T.with_file_type(file_urls(spark, sf)).select(
        "id", "category", T.is_supported(category).alias("is_supported"),
        T.is_forced_retrieval(category).alias("forced"),
        T.can_be_cached(category, F.lit(True)).alias("cacheable"),
        T.is_word_document(ext).alias("is_word"), T.is_email_file(ext).alias("is_email"),
        U.is_pdf_url(F.col("url")).alias("is_pdf"),
    )


_STRATEGY_SQL = """
    SELECT id, ext AS extension, category, category NOT IN ('archive', 'binary', 'media', 'unsupported') AS is_supported,
           on_ AND category IN ('document', 'image', 'html', 'email') AS should_cache,
           category IN ('presentation', 'spreadsheet') AS force_rag,
           CASE WHEN on_ AND category IN ('document', 'image', 'html', 'email') THEN 'cache' ELSE 'rag' END AS processing_method,
           category IN ('document', 'presentation', 'spreadsheet') AS requires_llamaparse,
           category IN ('image', 'html') AS can_direct_upload
    FROM (SELECT *, id % 2 = 0 AS on_ FROM typed_urls)"""


@query("file_strategy", sql(_STRATEGY_SQL, "typed_urls"))
def file_strategy(spark, sf):
    on = F.col("id") % 2 == 0
    typed = T.with_file_type(file_urls(spark, sf))
    return typed.withColumn("s", T.processing_strategy(F.col("ext"), F.col("category"), on)).select("id", "s.*")


@query("file_info", sql(
    "SELECT id, url AS file_path_or_url, should_cache AS use_cache, processing_method AS strategy_method,"
    " processing_method AS recommended_method, requires_llamaparse AS use_llamaparse"
    f" FROM ({_STRATEGY_SQL}) s JOIN file_urls USING (id)", "typed_urls"))
def file_info(spark, sf):
    typed = T.with_file_type(file_urls(spark, sf))
    info = T.file_info(F.col("url"), F.col("ext"), F.col("category"), F.col("id") % 2 == 0)
    return typed.withColumn("i", info).select(
        "id", "i.file_path_or_url", "i.recommendations.use_cache",
        F.col("i.processing_strategy.processing_method").alias("strategy_method"),
        F.col("i.recommendations.processing_method").alias("recommended_method"),
        "i.recommendations.use_llamaparse",
    )


@query("file_kind", sql("""
    SELECT id, is_local, is_pdf, CASE WHEN is_local THEN ext WHEN is_pdf THEN '.pdf' ELSE 'unknown' END AS file_type,
           CASE WHEN is_pdf THEN 'direct' ELSE 'parse_first' END AS cache_strategy,
           CASE WHEN is_local AND is_pdf THEN 'direct' ELSE 'parse_first' END AS rag_strategy
    FROM (SELECT id, ext, starts_with(url, '/') AS is_local,
                 CASE WHEN starts_with(url, '/') THEN ext = '.pdf' ELSE contains(lower(url), '.pdf') END AS is_pdf
          FROM typed_urls)""", "typed_urls"))
def file_kind(spark, sf):
    local = F.startswith(F.col("url"), F.lit("/"))
    return file_urls(spark, sf).withColumn("k", T.file_kind(F.col("url"), local)).select("id", "k.*")


@query("doc_hash", "SELECT page_id, md5(lower(trim(url))) AS doc_hash, substr(md5(url), 1, 8) AS chunk_prefix FROM pages")
def doc_hash(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", U.doc_hash(F.col("url")).alias("doc_hash"), U.chunk_prefix(F.col("url")).alias("chunk_prefix")
    )


@query("doc_basename", sql(r"""
    SELECT id, regexp_extract(CASE WHEN regexp_matches(url, '^https?://')
        THEN regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ';[^/]*$', '') ELSE url END, '([^/]*)$', 1) AS name
    FROM file_urls""", "file_urls"))
def doc_basename(spark, sf):
    return file_urls(spark, sf).select("id", U.doc_basename(F.col("url")).alias("name"))


_LINKS_SQL = """
    SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://docs.google.com/document/d/' || md5(url) || '_x-1/edit?usp=sharing'
             WHEN 1 THEN 'https://docs.google.com/document/d/?u=' || url ELSE url END AS url FROM pages"""


def _links(spark, sf):
    url = (
        F.when(F.col("page_id") % 3 == 0,
               F.concat(F.lit("https://docs.google.com/document/d/"), F.md5("url"), F.lit("_x-1/edit?usp=sharing")))
        .when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://docs.google.com/document/d/?u="), "url"))
        .otherwise(F.col("url"))
    )
    return table(spark, sf, "pages").select("page_id", url.alias("url"))


@query("link_rewrite", f"""
    SELECT page_id, CASE WHEN page_id % 3 = 0
             THEN 'https://docs.google.com/document/d/' || regexp_extract(url, 'd/([0-9a-zA-Z_-]+)/edit', 1) || '/export?format=docx'
             ELSE url END AS fetch_url FROM ({_LINKS_SQL})""")
def link_rewrite(spark, sf):
    return _links(spark, sf).select("page_id", U.rewrite_shared_link(F.col("url")).alias("fetch_url"))


_TYPES = (
    "application/pdf", "application/msword", "text/html; charset=utf-8",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "application/vnd.ms-excel", "application/msexcel",
)
_TYPE_LIST = "[" + ", ".join(f"'{t}'" for t in _TYPES) + ", NULL]"


@query("target_filename", sql(f"""
    SELECT id, requested_name,
           CASE WHEN contains(ct, 'application/vnd.openxmlformats') THEN
                  CASE WHEN suffix(requested_name, '.docx') OR suffix(requested_name, '.doc') THEN requested_name ELSE 'data.docx' END
                WHEN contains(ct, 'application/pdf') THEN
                  CASE WHEN suffix(requested_name, '.pdf') THEN requested_name ELSE 'data.pdf' END
                ELSE requested_name END AS file_name
    FROM (SELECT id, ct, CASE WHEN ext <> '' THEN 'data' || ext WHEN contains(ct, 'pdf') THEN 'data.pdf'
             WHEN contains(ct, 'wordprocessingml') OR contains(ct, 'msword') THEN 'data.docx'
             WHEN contains(ct, 'presentationml') THEN 'data.pptx'
             WHEN contains(ct, 'msexcel') THEN 'data.xlsx' ELSE 'data.pdf' END AS requested_name
          FROM (SELECT id, ext, coalesce(({_TYPE_LIST})[1 + (id // 3) % {len(_TYPES) + 1}], '') AS ct FROM typed_urls))""",
    "typed_urls"))
def target_filename(spark, sf):
    kinds = F.array(*[F.lit(t) for t in _TYPES], F.lit(None).cast("string"))
    position = (F.floor(F.col("id") / 3) % (len(_TYPES) + 1)).cast("int")
    typed = file_urls(spark, sf).withColumn("content_type", F.get(kinds, position))
    url, kind = F.col("url"), F.col("content_type")
    return typed.select(
        "id", U.requested_filename(url, kind).alias("requested_name"), U.target_filename(url, kind).alias("file_name")
    )


_BLOCKED = """(contains(lower(p.url), 'get-secret-token')
    OR EXISTS (SELECT 1 FROM block_list b WHERE contains(lower(p.url), lower(b.pattern))))"""


@query("blocked_urls", sql(f"SELECT page_id, url FROM pages p WHERE {_BLOCKED}", "block_list"))
def blocked_urls(spark, sf):
    return gates.blocked(table(spark, sf, "pages").select("page_id", "url"), block_list(spark, sf), key="page_id")


@query("allowed_urls", sql(f"SELECT page_id, url FROM pages p WHERE NOT {_BLOCKED}", "block_list"))
def allowed_urls(spark, sf):
    urls = table(spark, sf, "pages").select("page_id", "url")
    return gates.allowed(urls, block_list(spark, sf), key="page_id", limit=0)


@query("blocklist_status", sql("SELECT true AS enabled, count(*) AS blocked_urls_count FROM block_list", "block_list"))
def blocklist_status(spark, sf):
    return gates.blocklist_status(block_list(spark, sf))


@query("blocklist_entries", sql("SELECT pattern FROM block_list", "block_list"))
def blocklist_entries(spark, sf):
    return gates.blocklist_entries(block_list(spark, sf))


_FEED_SQL = "SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]*)', 1) AS pattern FROM pages WHERE contains(url, 'utm_source=feed')"


def _feed_hosts(spark, sf):
    pages = table(spark, sf, "pages").where(F.contains("url", F.lit("utm_source=feed")))
    return pages.select(F.regexp_extract("url", r"^https?://([^/?#]*)", 1).alias("pattern"))


@query("blocklist_add", sql(f"SELECT pattern FROM block_list UNION {_FEED_SQL}", "block_list"))
def blocklist_add(spark, sf):
    return gates.add_patterns(block_list(spark, sf), _feed_hosts(spark, sf))


@query("blocklist_remove", sql(f"SELECT pattern FROM block_list EXCEPT {_FEED_SQL}", "block_list"))
def blocklist_remove(spark, sf):
    return gates.remove_patterns(block_list(spark, sf), _feed_hosts(spark, sf))


@query("extension_map", sql("""
    SELECT d.category, string_agg(d.ext, ' ' ORDER BY d.ext) AS extensions, CAST(sum(coalesce(u.n, 0)) AS BIGINT) AS urls
    FROM extension_dim d LEFT JOIN (SELECT ext, count(*) AS n FROM typed_urls GROUP BY ext) u ON u.ext = d.ext
    GROUP BY d.category""", "typed_urls"))
def extension_map(spark, sf):
    seen = T.with_file_type(file_urls(spark, sf)).groupBy("ext").agg(F.count(F.lit(1)).alias("n"))
    known = T.extension_dimension(spark).join(seen, "ext", "left")
    return known.groupBy("category").agg(
        F.array_join(F.array_sort(F.collect_set("ext")), " ").alias("extensions"),
        F.sum(F.coalesce("n", F.lit(0))).alias("urls"),
    )


@query("extension_families", sql("""
    SELECT family, count(DISTINCT ext) AS extensions, count(*) AS urls FROM (
      SELECT 'supported' AS family, ext FROM typed_urls WHERE category NOT IN ('archive', 'binary', 'media', 'unsupported')
      UNION ALL SELECT 'rejected', ext FROM typed_urls WHERE category IN ('archive', 'binary', 'media')
      UNION ALL SELECT 'cacheable', ext FROM typed_urls WHERE category IN ('document', 'image', 'html', 'email'))
    GROUP BY family""", "typed_urls"))
def extension_families(spark, sf):
    dim = T.extension_dimension(spark)
    families = None
    for name, categories in (
        ("supported", D.SUPPORTED_CATEGORIES), ("rejected", D.REJECTED_CATEGORIES), ("cacheable", D.CACHEABLE_CATEGORIES)
    ):
        family = dim.where(F.col("category").isin(*categories)).select(F.lit(name).alias("family"), "ext")
        families = family if families is None else families.union(family)
    urls = T.with_file_type(file_urls(spark, sf)).select("ext")
    return families.distinct().join(urls, "ext").groupBy("family").agg(
        F.count_distinct("ext").alias("extensions"), F.count(F.lit(1)).alias("urls")
    )


@query("parse_route", sql("""
    SELECT u.id, CASE WHEN category NOT IN ('document', 'image', 'html', 'email') THEN 'forced_retrieval'
             WHEN contains(lower(url), '.pdf') AND NOT heavy THEN 'pdf_direct_upload'
             WHEN contains(lower(url), '.pdf') THEN 'pdf_parse'
             WHEN ext IN ('.doc', '.docx', '.docm', '.dot', '.dotm') THEN 'word_markdown'
             WHEN category = 'email' THEN 'email_markdown' ELSE 'parse' END AS parse_route
    FROM typed_urls u LEFT JOIN (SELECT doc, text_ratio < 0.3 OR avg_text_per_page < 50
             OR (image_ratio > 0.7 AND avg_text_per_page < 200) AS heavy FROM page_ratios) p ON p.doc = 'src' || (u.id % 20)""",
    "typed_urls", "page_ratios"))
def parse_route(spark, sf):
    heavy = P.image_heavy(doc_pages(spark, sf), P.page_stats(doc_pages(spark, sf))).select("doc", "is_image_heavy")
    urls = T.with_file_type(file_urls(spark, sf)).withColumn("doc", F.concat(F.lit("src"), (F.col("id") % 20).cast("string")))
    return urls.join(heavy, "doc", "left").select(
        "id", T.parse_route(F.col("url"), F.col("ext"), F.col("category"), F.col("is_image_heavy")).alias("parse_route")
    )


# A URL counts as indexed if it is German, as fetched unless Spanish, as readable unless French.
_BATCH_SQL = {
    "asked": "SELECT url, any_value(ext) AS ext, any_value(category) AS category FROM typed_urls GROUP BY url",
    "outcomes": """
        SELECT url, NOT contains(url, '/es/') AND NOT contains(url, '/fr/') AS success,
               CASE WHEN contains(url, '/es/') THEN 'document not found'
                    WHEN contains(url, '/fr/') THEN 'document has no text' ELSE '' END AS error, 0.0::DOUBLE AS processing_time FROM asked""",
    "results": f"""
        SELECT p.url, CASE WHEN blocked THEN 'failed' WHEN NOT ok OR known THEN 'skipped' WHEN success THEN 'success' ELSE 'failed' END AS status,
               CASE WHEN blocked THEN '{D.MSG_BLOCKED}'
                    WHEN NOT ok THEN CASE category WHEN 'archive' THEN '{D.SKIP_MESSAGES['archive']}' WHEN 'binary' THEN '{D.SKIP_MESSAGES['binary']}'
                           WHEN 'media' THEN '{D.SKIP_MESSAGES['media']}' ELSE 'File type ''' || category || ''' is not supported' END
                    WHEN known THEN '{D.MSG_ALREADY_INDEXED}'
                    WHEN NOT success THEN 'Processing failed: ' || error
                    WHEN category = 'presentation' THEN 'Presentation processed via RAG pipeline'
                    WHEN category = 'spreadsheet' THEN 'Spreadsheet processed via RAG pipeline'
                    ELSE '{D.MSG_INDEXED}' END AS message,
               0.0::DOUBLE AS processing_time, CASE WHEN NOT blocked THEN category END AS file_type
        FROM (SELECT p.*, o.success, o.error, {_BLOCKED} AS blocked,
                     category NOT IN ('archive', 'binary', 'media', 'unsupported') AS ok, contains(p.url, '/de/') AS known
              FROM asked p JOIN outcomes o ON o.url = p.url) p""",
}


def _batch_docs(spark, sf):
    urls = file_urls(spark, sf).join(
        table(spark, sf, "pages").select(F.col("page_id").alias("id"), "html"), "id"
    ).where(~F.contains("url", F.lit("/es/")))
    text = F.when(~F.contains("url", F.lit("/fr/")), F.col("html"))
    return urls.groupBy("url").agg(F.max(text).alias("text"))


def page_index(urls):
    """First chunks of the German documents."""
    german = urls.where(F.contains("url", F.lit("/de/")))
    return german.select(U.chunk_prefix(F.col("url")).alias("chunk_prefix"), U.document_key(F.col("url")).alias("doc_key"), F.lit(0).alias("ordinal"))


def _report(spark, sf):
    urls = file_urls(spark, sf)
    return batch_ingest_report(urls, _batch_docs(spark, sf), block_list(spark, sf), page_index(urls))


@query("ingest_result", sql("SELECT * FROM results", "typed_urls", "block_list", **_BATCH_SQL))
def ingest_result(spark, sf):
    return _report(spark, sf)


@query("ingest_summary", sql("""
    SELECT count(*) AS total_documents, count(*) FILTER (WHERE status = 'success') AS processed_successfully,
           count(*) FILTER (WHERE status = 'failed') AS failed_documents,
           count(*) FILTER (WHERE status = 'skipped') AS skipped_documents,
           round(sum(processing_time), 2) AS processing_time FROM results""", "typed_urls", "block_list", **_BATCH_SQL))
def ingest_summary(spark, sf):
    return ingest.ingest_summary(_report(spark, sf))


@query("multi_doc_results", sql("SELECT * FROM outcomes", "typed_urls", **{
    k: _BATCH_SQL[k] for k in ("asked", "outcomes")}))
def multi_doc_results(spark, sf):
    return document_outcomes(file_urls(spark, sf).select("url").distinct(), _batch_docs(spark, sf))


@query("batch_success", sql("""
    SELECT count(*) FILTER (WHERE success) AS successful, count(*) AS total,
           round(count(*) FILTER (WHERE success) / count(*), 4) AS success_ratio FROM outcomes""", "typed_urls", **{
    k: _BATCH_SQL[k] for k in ("asked", "outcomes")}))
def batch_success(spark, sf):
    return ingest.batch_success(multi_doc_results(spark, sf))


def _labelled_index(spark, sf):
    docs = documents(spark, sf)
    labels = table(spark, sf, "labels").select("doc_id")
    return sentence_chunks(docs.join(labels, "doc_id", "left_semi"))


@query("new_documents", """
    SELECT 'doc/' || doc_id AS url, substr(md5('doc/' || doc_id), 1, 8) AS chunk_prefix FROM documents
    WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def new_documents(spark, sf):
    return ingest.new_documents(documents(spark, sf).select("url"), _labelled_index(spark, sf))


@query("indexed_documents", """
    SELECT 'doc/' || doc_id AS url, substr(md5('doc/' || doc_id), 1, 8) AS chunk_prefix FROM documents
    WHERE doc_id IN (SELECT doc_id FROM labels)""")
def indexed_documents(spark, sf):
    return ingest.indexed_documents(documents(spark, sf).select("url"), _labelled_index(spark, sf))

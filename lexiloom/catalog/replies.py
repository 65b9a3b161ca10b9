"""Queries over model outputs, conversations, lookups and mail."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom import dimensions as D
from lexiloom.catalog.fixtures import cache_answers, doc_pages, lookup_dim, raw_answers, spread, sql, table, user_questions
from lexiloom.catalog.registry import query
from lexiloom.functions import answers as A
from lexiloom.functions.scalars import pad_to, repeat_message
from lexiloom.operators import lookups as L, messages as M, pages as P, status as S
from lexiloom.operators.ordering import row_numbers
from lexiloom.plans import answers as N
from lexiloom.sources.email import email_markdown, parse_messages


def _joined(answers):
    return F.array_join(answers, "|", "<null>")


def _padded(items: str, n: str, message: str) -> str:
    """SQL: exactly n items, joined."""
    return (f"list_slice(list_concat({items}, list_transform(range({n}), lambda i: '{message}')), 1, {n})")


_ANSWER = "'A second answer'"
_STRICT_SQL = f"""
    SELECT id, conv_id, turn, n_questions, CASE form
        WHEN 0 THEN {_padded(f"[t, {_ANSWER}]", "n_questions", D.MSG_NO_ANSWER)}
        WHEN 1 THEN {_padded(f"[t, {_ANSWER}, '  ']", "n_questions", D.MSG_NO_ANSWER)}
        WHEN 6 THEN {_padded("[t]", "n_questions", D.MSG_NO_ANSWER)}
        WHEN 7 THEN {_padded(f"[t, {_ANSWER}]", "n_questions", D.MSG_NO_ANSWER)}
        WHEN 9 THEN {_padded("['503 UNAVAILABLE', t]", "n_questions", D.MSG_NO_ANSWER)}
        ELSE {_padded("CAST([] AS VARCHAR[])", "n_questions", D.MSG_JSON_FAILED)} END AS answers FROM raw_answers"""


@query("parse_strict", sql("""
    SELECT u.id, array_to_string(CASE WHEN form NOT IN (2, 3, 4) AND json_valid(body) THEN list_slice(list_concat(
               CASE json_type(body) WHEN 'ARRAY' THEN json_extract_string(body, '$[*]')
                    ELSE coalesce(CASE WHEN json_type(body, '$.answers') = 'ARRAY' THEN json_extract_string(body, '$.answers[*]') END,
                                  [json_extract_string(body, '$.answer')]) END,
               list_transform(range(n_questions), lambda i: 'NONE')), 1, n_questions)
             ELSE list_transform(range(n_questions), lambda i: 'FAILED') END, '|') AS answers FROM unfenced u"""
    .replace("NONE", D.MSG_NO_ANSWER).replace("FAILED", D.MSG_JSON_FAILED), "unfenced"))
def parse_strict(spark, sf):
    return raw_answers(spark, sf).select(
        "id", _joined(A.parse_strict(F.col("raw"), F.col("n_questions"))).alias("answers"))


_SALVAGE_SQL = f"""
    SELECT id, conv_id, turn, n_questions, CASE form
        WHEN 0 THEN {_padded(f"[t, {_ANSWER}]", "n_questions", D.MSG_NO_ANSWER)}
        WHEN 1 THEN {_padded(f"[t, {_ANSWER}, '  ']", "n_questions", D.MSG_NO_ANSWER)}
        WHEN 2 THEN {_padded(f"[t, {_ANSWER}]", "n_questions", D.MSG_NO_ANSWER)}
        WHEN 3 THEN {_padded(f"[t, {_ANSWER}]", "n_questions", D.MSG_INCOMPLETE)}
        WHEN 4 THEN {_padded("[t]", "n_questions", D.MSG_NO_ANSWER)}
        WHEN 6 THEN [t]
        WHEN 7 THEN {_padded(f"list_filter([t, {_ANSWER}], lambda s: length(s) > 10)", "n_questions", D.MSG_EXTRACTED)}
        WHEN 8 THEN CASE WHEN length(t) > 10 THEN {_padded("[t]", "n_questions", D.MSG_EXTRACTED)}
                         ELSE {_padded("CAST([] AS VARCHAR[])", "n_questions", D.MSG_INVALID)} END
        WHEN 9 THEN {_padded("['503 UNAVAILABLE', t]", "n_questions", D.MSG_NO_ANSWER)}
        ELSE {_padded("CAST([] AS VARCHAR[])", "n_questions", D.MSG_INVALID)} END AS answers FROM raw_answers"""


@query("parse_salvage", sql(f"SELECT id, array_to_string(answers, '|') AS answers FROM ({_SALVAGE_SQL})", "raw_answers"))
def parse_salvage(spark, sf):
    return raw_answers(spark, sf).select(
        "id", _joined(A.parse_salvage(F.col("raw"), F.col("n_questions"))).alias("answers"))


@query("answers_padded", sql(f"""
    SELECT id, array_to_string({_padded(r"list_filter(regexp_extract_all(t, '\S+'), lambda w: w <> '')", "n_questions", D.MSG_MISSING)}, '|') AS answers,
           array_to_string(list_transform(range(n_questions), lambda i: t), '|') AS repeated FROM raw_answers""", "raw_answers"))
def answers_padded(spark, sf):
    rows = raw_answers(spark, sf)
    text = F.regexp_replace("text", r'["\\\x00-\x1f]', " ")
    source = table(spark, sf, "conversations").select(
        F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), text.alias("t"))
    words = F.regexp_extract_all("t", F.lit(r"(\S+)"), 1)
    n = F.col("n_questions")
    return rows.join(source, "id").select(
        "id", _joined(pad_to(words, n, D.MSG_MISSING)).alias("answers"), _joined(repeat_message(F.col("t"), n)).alias("repeated"))


_TRIMMED = "trim(a, ' ' || chr(9) || chr(10) || chr(13))"
_VALID = f"list_transform(answers, lambda a: CASE WHEN {_TRIMMED} = '' THEN '{D.MSG_EMPTY_ANSWER}' ELSE {_TRIMMED} END)"


@query("answers_valid", sql(f"""
    SELECT id, CAST(json_object('answers', {_VALID}) AS VARCHAR) AS body, len(answers) = 0 AS is_rejected
    FROM ({_STRICT_SQL})""", "raw_answers"))
def answers_valid(spark, sf):
    strict = raw_answers(spark, sf).withColumn("answers", A.parse_strict(F.col("raw"), F.col("n_questions")))
    return strict.select(
        "id", A.answers_json(A.validated(F.col("answers"))).alias("body"), A.violates(F.col("answers")).alias("is_rejected"))


_OVERLOADED = ("list_contains(list_transform(answers, lambda a: contains(a, '503') OR contains(lower(a), 'overload') "
               "OR contains(lower(a), 'unavailable')), true)")


def _overridden(answers: str) -> str:
    return f"CASE WHEN {_OVERLOADED} THEN list_transform(range(n_questions), lambda i: '{D.MSG_OVERLOADED}') ELSE {answers} END"


@query("overload_override", sql(f"""
    SELECT id, coalesce({_OVERLOADED}, false) AS is_overloaded, array_to_string({_overridden('answers')}, '|') AS answers
    FROM ({_STRICT_SQL})""", "raw_answers"))
def overload_override(spark, sf):
    strict = raw_answers(spark, sf).withColumn("answers", A.parse_strict(F.col("raw"), F.col("n_questions")))
    return strict.select(
        "id", A.is_overloaded(F.col("answers")).alias("is_overloaded"),
        _joined(A.override_overload(F.col("answers"), F.col("n_questions"))).alias("answers"))


# Every turn is taken as one batch of a conversation's questions.
@query("normalised_answers", sql(f"""
    SELECT q.conv_id AS request_id, q.question_no, coalesce(a.answer, '{D.MSG_MISSING}') AS answer
    FROM (SELECT conv_id, unnest(range(1, 3 * (max(turn) + 1) + 1)) AS question_no FROM conversations GROUP BY conv_id) q
    LEFT JOIN (SELECT conv_id, 3 * turn + unnest(range(1, len(answers) + 1)) AS question_no, unnest(answers) AS answer
               FROM (SELECT conv_id, turn, {_overridden(_VALID)} AS answers FROM ({_SALVAGE_SQL.replace("FROM raw_answers", "FROM three_raw")}))) a
      ON a.conv_id = q.conv_id AND a.question_no = q.question_no""", "three_raw"))
def normalised_answers(spark, sf):
    outputs = raw_answers(spark, sf).select(
        F.col("conv_id").alias("request_id"), (F.col("turn") + 1).alias("batch_no"),
        F.least("n_questions", F.lit(3)).alias("n_questions"), "raw")
    asked = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("request_id")).agg(
        F.max("turn").alias("last")).select("request_id", F.explode(F.sequence(F.lit(1), 3 * (F.col("last") + 1))).alias("question_no"))
    return N.complete_answers(asked, N.concatenated(N.normalised_batches(outputs, salvage=True)))


@query("single_answers", sql("""
    SELECT id, CASE WHEN starts_with(body, '{') AND suffix(body, '}') AND form <> 2 AND json_valid(body)
                         AND json_extract_string(body, '$.answer') IS NOT NULL THEN body
                    ELSE CAST(json_object('answer', body) AS VARCHAR) END AS answer FROM unfenced""", "unfenced"))
def single_answers(spark, sf):
    return raw_answers(spark, sf).select("id", A.wrap_single(F.col("raw")).alias("answer"))


@query("unwrapped_answers", sql("""
    SELECT id, array_to_string(CASE WHEN form NOT IN (2, 3, 4, 7) AND json_valid(raw) THEN
               coalesce(CASE WHEN json_type(raw, '$.answers') = 'ARRAY' THEN json_extract_string(raw, '$.answers[*]') END,
                        [json_extract_string(raw, '$.answer')]) ELSE [raw] END, '|') AS answers FROM raw_answers""", "raw_answers"))
def unwrapped_answers(spark, sf):
    return raw_answers(spark, sf).select("id", _joined(A.unwrap_envelope(F.col("raw"))).alias("answers"))


@query("plausible_strings", sql("""
    SELECT id, array_to_string(list_filter(regexp_extract_all(raw, '"([^"]*)"', 1),
             lambda s: s NOT IN ('answers', 'answer') AND length(s) > 10), '|') AS strings FROM raw_answers""", "raw_answers"))
def plausible_strings(spark, sf):
    return raw_answers(spark, sf).select("id", _joined(A.plausible_strings(F.col("raw"))).alias("strings"))


_UNAVAILABLE = "list_contains(list_transform(answers, lambda a: regexp_matches(a, '(?i)" + "|".join(
    f"(?:{p})" for p in D.UNAVAILABLE_PATTERNS) + "')), true)"


@query("unavailable_answers", sql(f"SELECT request_id FROM cache_answers WHERE {_UNAVAILABLE}", "cache_answers"))
def unavailable_answers(spark, sf):
    return cache_answers(spark, sf).where(A.is_unavailable(F.col("answers"))).select("request_id")


@query("denied_answers", sql(f"""
    SELECT request_id, 'Error: ' || url || ' is not accessable' AS answers FROM cache_answers
    WHERE len(answers) > 0 AND len(list_filter(answers, lambda a: NOT contains(a, '{D.MSG_DENIED}'))) = 0""", "cache_answers"))
def denied_answers(spark, sf):
    rows = cache_answers(spark, sf).where(A.is_denied(F.col("answers")))
    return rows.select("request_id", _joined(A.denied_answer(F.col("url"))).alias("answers"))


@query("fallback_answers", sql(f"""
    SELECT request_id, needs AS is_fallback, array_to_string(CASE WHEN NOT needs THEN answers
               WHEN role = 'user' THEN ['Retrieved ' || text] ELSE ['{D.MSG_FALLBACK_FAILED}', '{D.MSG_FALLBACK_FAILED}'] END, '|') AS answers
    FROM (SELECT *, coalesce({_UNAVAILABLE}, false) OR coalesce(contains(lower(error), 'temporarily overloaded'), false) AS needs
          FROM cache_answers)""", "cache_answers"))
def fallback_answers(spark, sf):
    cached = cache_answers(spark, sf)
    retrieved = cached.where("role = 'user'").select(
        "request_id", F.array(F.concat(F.lit("Retrieved "), "text")).alias("answers"))
    chosen = S.with_fallback(cached, retrieved)
    return chosen.select("request_id", (F.col("answer_source") == "retrieval").alias("is_fallback"), _joined(F.col("answers")).alias("answers"))


# ---- conversations ---------------------------------------------------------------------


@query("role_messages", "SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'")
def role_messages(spark, sf):
    return M.role_messages(table(spark, sf, "conversations"))


@query("first_phrase_message", """
    SELECT conv_id, min(turn) AS turn, arg_min(text, turn) AS text FROM conversations WHERE contains(text, 'the ') GROUP BY conv_id""")
def first_phrase_message(spark, sf):
    return M.first_message_with(table(spark, sf, "conversations"), "the ")


# ---- lookups ---------------------------------------------------------------------------

_BODIES_SQL = """
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"data": ' || props || '}' WHEN 1 THEN '"' || event_type || '"'
             WHEN 2 THEN props WHEN 3 THEN '  "' || event_type || ' ' ELSE '[' || event_id || ',2]' END AS body FROM events"""


@query("json_field", f"""
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN json_extract_string(body, '$.data.k') WHEN 1 THEN json_extract_string(body, '$')
             WHEN 2 THEN CAST(json(body) AS VARCHAR) WHEN 3 THEN trim(trim(body), '"') ELSE body END AS field FROM ({_BODIES_SQL})""")
def json_field(spark, sf):
    e = F.col("event_id")
    body = (
        F.when(e % 5 == 0, F.concat(F.lit('{"data": '), "props", F.lit("}")))
        .when(e % 5 == 1, F.concat(F.lit('"'), "event_type", F.lit('"'))).when(e % 5 == 2, F.col("props"))
        .when(e % 5 == 3, F.concat(F.lit('  "'), "event_type", F.lit(" ")))
        .otherwise(F.concat(F.lit("["), e.cast("string"), F.lit(",2]")))
    )
    return table(spark, sf, "events").select("event_id", A.json_field(body, ".data.k").alias("field"))


_ASKED_SQL = """
    SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'nation_' || c_nationkey WHEN 1 THEN 'The Nation_' || c_nationkey || ' trade'
             WHEN 2 THEN 'ION_' || (c_nationkey % 3) ELSE c_name END AS asked FROM customer"""


def _asked(spark, sf):
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    asked = (
        F.when(c % 4 == 0, F.concat(F.lit("nation_"), n.cast("string")))
        .when(c % 4 == 1, F.concat(F.lit("The Nation_"), n.cast("string"), F.lit(" trade")))
        .when(c % 4 == 2, F.concat(F.lit("ION_"), (n % 3).cast("string"))).otherwise(F.col("c_name"))
    )
    return table(spark, sf, "customer").select("c_custkey", asked.alias("asked"))


_FUZZY_SQL = sql(f"""
    SELECT c_custkey, asked, (SELECT arg_min(l.value, CASE WHEN lower(l.key) = lower(asked) THEN -1 ELSE l.ord END) FROM lookup_dim l
        WHERE contains(lower(l.key), lower(asked)) OR contains(lower(asked), lower(l.key))) AS value FROM ({_ASKED_SQL})""", "lookup_dim")


@query("fuzzy_lookup", _FUZZY_SQL)
def fuzzy_lookup(spark, sf):
    return L.fuzzy_lookup(_asked(spark, sf), lookup_dim(spark, sf), "asked")


@query("fuzzy_lookup_joined", _FUZZY_SQL)
def fuzzy_lookup_joined(spark, sf):
    return L.fuzzy_lookup(_asked(spark, sf), lookup_dim(spark, sf), "asked", limit=0)


@query("term_scan", """
    SELECT doc_id, (SELECT arg_min(b.text, b.item_id) FROM benchmark b WHERE contains(lower(d.text), lower(b.text))) AS value
    FROM documents d""")
def term_scan(spark, sf):
    terms = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("ord"), F.lit(None).cast("string").alias("key"), F.col("text").alias("value"))
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return L.first_term(docs, terms, "text", "doc_id").drop("text")


@query("default_lookup", sql(f"""
    SELECT c_custkey, coalesce(l.value, 'elsewhere') AS value FROM ({_ASKED_SQL}) a
    LEFT JOIN lookup_dim l ON lower(l.key) = a.asked""", "lookup_dim"))
def default_lookup(spark, sf):
    entries = lookup_dim(spark, sf).withColumn("key", F.lower("key"))
    return L.default_lookup(_asked(spark, sf), entries, "asked", "elsewhere").select("c_custkey", "value")


# ---- pages and mail --------------------------------------------------------------------


@query("page_stats", sql("SELECT * FROM page_ratios", "page_ratios"))
def page_stats(spark, sf):
    return P.page_stats(doc_pages(spark, sf))


@query("image_heavy", sql("""
    SELECT d.doc, coalesce(total_pages, 0) AS total_pages, coalesce(analysed_pages, 0) AS analysed_pages, heavy AS is_image_heavy,
           CASE WHEN heavy THEN 'llamaparse' ELSE 'direct_upload' END AS recommended_processing
    FROM (SELECT DISTINCT doc FROM doc_pages UNION SELECT 'page' || page_id FROM pages) d
    LEFT JOIN page_ratios p ON p.doc = d.doc,
    LATERAL (SELECT coalesce(text_ratio < 0.3 OR avg_text_per_page < 50 OR (image_ratio > 0.7 AND avg_text_per_page < 200), true) AS heavy)""",
    "page_ratios", "doc_pages"))
def image_heavy(spark, sf):
    known = doc_pages(spark, sf)
    unread = table(spark, sf, "pages").select(F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("doc"))
    return P.image_heavy(known.select("doc").union(unread), P.page_stats(known)).select(
        "doc", "total_pages", "analysed_pages", "is_image_heavy", "recommended_processing")


def mail_messages(spark, sf):
    """Conversation turns as raw messages: plain, missing headers, or with an attachment."""
    turn, form = F.col("turn"), (F.col("conv_id") + F.col("turn")) % 3
    head = F.concat_ws(
        "\n",
        F.when(form != 1, F.concat(F.lit("Subject: Case "), F.col("conv_id").cast("string"))),
        F.concat(F.lit("From: "), "role", F.lit("@example.com")),
        F.when(form != 2, F.lit("To: desk@example.com")),
        F.when(turn != 0, F.concat(F.lit("Date: Day "), turn.cast("string"))),
    )
    plain = F.concat(head, F.lit("\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), "text")
    mixed = F.concat(
        head, F.lit('\nContent-Type: multipart/mixed; boundary="=cut="\n\n--=cut=\nContent-Type: text/plain; charset=utf-8\n\n'),
        F.col("text"), F.lit("\n--=cut=\nContent-Type: text/html; charset=utf-8\n\n<p>Seen &amp; <b>noted</b></p><script>x()</script>"),
        F.lit('\n--=cut=\nContent-Type: application/pdf\nContent-Disposition: attachment; filename="a.pdf"\n\nJVBERg==\n--=cut=--\n'),
    )
    name = F.concat(F.lit("/mail/m_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"), F.lit(".eml"))
    return table(spark, sf, "conversations").select(
        name.alias("path"), F.encode(F.when(form == 2, mixed).otherwise(plain), "UTF-8").alias("content"))


@query("eml_records", """
    SELECT path, subject, sender, recipient, date, content_type, has_attachments, body, attachments,
           '# Email: ' || stem || chr(10) || chr(10) || 'Subject: ' || subject || chr(10) || 'From: ' || sender || chr(10) || 'To: ' || recipient
             || chr(10) || 'Date: ' || date || chr(10) || 'Content-Type: ' || content_type || chr(10)
             || chr(10) || 'BODY:' || chr(10) || body || chr(10)
             || CASE WHEN has_attachments THEN chr(10) || 'ATTACHMENTS:' || chr(10) || '- ' || attachments || ' (application/pdf)' ELSE '' END AS markdown
    FROM (SELECT '/mail/m_' || conv_id || '_' || turn || '.eml' AS path, 'm_' || conv_id || '_' || turn AS stem,
                 CASE WHEN form = 1 THEN 'No Subject' ELSE 'Case ' || conv_id END AS subject, role || '@example.com' AS sender,
                 CASE WHEN form = 2 THEN 'Unknown Recipient' ELSE 'desk@example.com' END AS recipient,
                 CASE WHEN turn = 0 THEN 'Unknown Date' ELSE 'Day ' || turn END AS date,
                 CASE WHEN form = 2 THEN 'multipart/mixed' ELSE 'text/plain' END AS content_type, form = 2 AS has_attachments,
                 CASE WHEN form = 2 THEN text || chr(10) || chr(10) || 'Seen &' || chr(10) || 'noted' ELSE text END AS body,
                 CASE WHEN form = 2 THEN 'a.pdf' ELSE '' END AS attachments
          FROM (SELECT *, (conv_id + turn) % 3 AS form FROM conversations))""")
def eml_records(spark, sf):
    mails = parse_messages(mail_messages(spark, sf))
    return mails.select(
        "path", "subject", "sender", "recipient", "date", "content_type", "has_attachments", "body",
        F.array_join(F.transform("attachments", lambda a: a.filename), "|").alias("attachments"), email_markdown().alias("markdown"))

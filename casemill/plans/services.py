"""Queries behind the ledger, the pages, the listings, the conversations, the predictions and the engine as a whole, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.engine import Engine
from casemill.functions import lexicons, records
from casemill.functions import sql as functions
from casemill.functions import text as T
from casemill.functions.encoding import BytePairs
from casemill.operators import calls, chunking, intake, ledger, listings, predict, stats, store
from casemill.plans import registry as R
from casemill.session import dealt, table
from casemill.sources import case_folders as folders
from casemill.sources import files
from casemill.sources.scratch import folder

NOW = "2025-01-01 00:00:00"
q = R.q


def scraped(spark: SparkSession, d: str) -> DataFrame:
    """orders as collected cases, by rules on the key."""
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    status = F.when(s == "F", "complete").when(s == "P", "skipped").when(k % 5 == 0, "failed").otherwise("pending")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("deposit", "adjacent", "other")]), (k % 3 + 1).cast("int"))
    rows = table(spark, d, "orders").select(k.alias("k"), F.concat(F.lit("LON_"), k).alias("case_reference"), F.year("o_orderdate").alias("year"), status.alias("status"), kind.alias("category"))
    return rows.withColumn("error_message", F.when(F.col("status") == "failed", "timeout"))


SCRAPED_SQL = """s AS (SELECT *, CASE WHEN status = 'failed' THEN 'timeout' END AS error_message FROM (SELECT o_orderkey AS k, 'LON_' || o_orderkey AS case_reference, year(o_orderdate)::INTEGER AS year,
  CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'P' THEN 'skipped' ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'pending' END END AS status, ['deposit', 'adjacent', 'other'][o_orderkey % 3 + 1] AS category FROM orders))"""


def list_pages(spark, d):
    """Year pages made of pages' URLs: entries of all kinds, some of which do not count."""
    k = F.col("page_id").cast("string")
    html = F.concat(
        F.lit('<ul class="x"><li><a href="/c/2021/LON_'), k, F.lit('.html">Smith &amp; Jones '), k, F.lit("</a> (Housing "), k, F.lit(") 3 March 2021</li><li>See <a class='y' "), F.lit('href="CHI_'), k, F.lit('.html">go</a> decided 2020-01-0'), (F.col("page_id") % 9 + 1).cast("string"),
        F.lit('</li><li><a href="/c/1999/MAN_1.html">old</a></li><li><a href="index.html">up there</a> <a href="BIR_2.html">Two in one</a> (x)</li><p><a href="a.pdf">pdf</a></p></ul>'),
    )
    return table(spark, d, "pages").select("page_id", F.posexplode(records.index_entries(html, F.lit(2021))).alias("pos", "e")).select("page_id", "pos", "e.*")


LIST_SQL = """WITH p AS (SELECT page_id, unnest([0, 1, 2]) AS pos FROM pages) SELECT page_id, pos::INTEGER AS pos, ['LON_' || page_id, 'CHI_' || page_id, 'BIR_2'][pos + 1] AS case_reference, ['/c/2021/LON_' || page_id || '.html', 'CHI_' || page_id || '.html', 'BIR_2.html'][pos + 1] AS href,
  ['Smith & Jones ' || page_id, 'See go decided 2020-01-0' || (page_id % 9 + 1), 'Two in one'][pos + 1] AS title, ['3 March 2021', '2020-01-0' || (page_id % 9 + 1), NULL][pos + 1] AS near_date, ['Housing ' || page_id, NULL, 'x'][pos + 1] AS category_text FROM p"""


def case_pages(spark, d):
    """Decision pages made of parts: dates, citations and PDF links in the head, in the text, or nowhere."""
    k, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    meta = F.when(k % 3 == 0, F.concat(F.lit('<meta name="DC.date" content="2021-03-0'), (k % 9 + 1).cast("string"), F.lit('">'))).when(k % 3 == 1, '<meta name="DC.date" content="soon">').otherwise("")
    ident = F.when(k % 4 == 0, F.concat(F.lit('<meta name="DC.identifier" content="ID '), n, F.lit('">'))).otherwise("")
    said = F.when(k % 2 == 0, F.concat(F.lit("Decision dated 5 April 2020. See [2020]  ukftt LON_"), n, F.lit("."))).otherwise("No label")
    pdf = F.when(k % 5 == 0, '<a href="/pdf/a.pdf">PDF</a>').when(k % 5 == 1, '<a href="b.pdf">PDF</a>').when(k % 5 == 2, '<a href="http://y.org/c.pdf">PDF</a>').otherwise('<a href="d.html">x</a>')
    html = F.concat(F.lit("<html><head>"), meta, ident, F.lit("</head><body>"), said, pdf, F.lit("</body></html>"))
    rows = table(spark, d, "part").select("p_partkey", html.alias("html")).withColumn("text", records.html_text(F.col("html")))
    ref = F.concat(F.lit("LON_"), F.col("p_partkey"))
    return rows.select("p_partkey", records.decision_date(F.col("text"), F.col("html")).cast("string").alias("decided"), records.neutral_citation(F.col("html"), F.col("text"), ref, F.lit(2020)).alias("citation"), records.pdf_link(F.col("html"), F.lit("http://x.org/c/2020/e.html")).alias("pdf"))


CASE_PAGES_SQL = """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '2021-03-0' || (p_partkey % 9 + 1) WHEN p_partkey % 2 = 0 THEN '2020-04-05' END AS decided,
  CASE WHEN p_partkey % 4 = 0 THEN 'ID ' || p_partkey WHEN p_partkey % 2 = 0 THEN '[2020] ukftt LON_' || p_partkey ELSE '[2020] UKFTT LON_' || p_partkey END AS citation,
  CASE p_partkey % 5 WHEN 0 THEN 'http://x.org/pdf/a.pdf' WHEN 1 THEN 'http://x.org/c/2020/b.pdf' WHEN 2 THEN 'http://y.org/c.pdf' END AS pdf FROM part"""


def index_rows(spark, d):
    rows = scraped(spark, d).select("case_reference", "year", F.concat(F.lit("Case "), "k").alias("title"), F.when(F.col("k") % 2 == 0, F.make_date("year", F.lit(3), F.lit(1))).alias("decision_date"), F.lit("Housing").alias("case_type_name"))
    return rows.select(*records.index_row(base=F.lit("http://x.org"), path=F.lit("/c/"), year=F.col("year")))


def updated(spark, d):
    """Statuses that a run brings: every third case is complete now, every fourth has an error."""
    rows = scraped(spark, d).select("case_reference", "status", "error_message").withColumn("scraped_at", F.lit(None).cast("timestamp"))
    new = scraped(spark, d).filter("k % 3 = 0 or k % 4 = 0").select("case_reference", F.when(F.col("k") % 3 == 0, "complete").alias("status"), F.when(F.col("k") % 4 == 0, "again").alias("error_message"))
    return store.update(rows, new, "case_reference", stamp=("scraped_at", F.lit(NOW).cast("timestamp")))


def runs(spark, d):
    opened = ledger.open_run(scraped(spark, d).select("year"), F.lit("run-1"), F.lit(NOW).cast("timestamp"))
    return ledger.close_run(opened, "run-1", F.lit("2025-01-02 00:00:00").cast("timestamp")).withColumn("years", F.array_join("years", ","))


def exported(spark, d):
    """The JSON lines with their place, and the envelope's total beside each."""
    envelope, lines = store.export_ordered(scraped(spark, d).select("year", "case_reference", "status"), F.lit(NOW).cast("timestamp"))
    return lines.select(F.md5("json").alias("m"), F.get_json_object("json", "$.year").cast("int").alias("year")).join(envelope.select("total"))  # one row


def disputes(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k.alias("dispute_id"), F.when(k % 3 != 0, k * 2).alias("tenant_session_id"), F.when(k % 5 != 0, k * 2 + 1).alias("landlord_session_id"), F.col("o_orderdate").alias("created_at"), intake.invite_code(k).alias("code"),
        F.when(k % 7 == 0, "both_complete").otherwise("in_progress").alias("status"), F.when(k % 2 == 0, "old").alias("property_address"), F.when(k % 4 == 0, "").alias("property_postcode"), F.when(k % 3 == 0, 0.0).otherwise(5.0).alias("deposit_amount"),
        F.lit(False).alias("tenant_complete"), (k % 6 == 0).alias("landlord_complete"),
    )


DISPUTES_SQL = """dp AS (SELECT o_orderkey AS k, o_orderkey AS dispute_id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey * 2 END AS tenant_session_id, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey * 2 + 1 END AS landlord_session_id,
  o_orderdate AS created_at, upper(substring(sha256(o_orderkey::VARCHAR), 1, 8)) AS code, CASE WHEN o_orderkey % 7 = 0 THEN 'both_complete' ELSE 'in_progress' END AS status FROM orders)"""


def sync(spark, d):
    """Each dispute hears of its tenant's case; every second tenant is done."""
    k = F.col("o_orderkey")
    cases = table(spark, d, "orders").select(k.alias("dispute_id"), F.lit("tenant").alias("role"), (k % 2 == 0).alias("intake_complete"), F.lit("new").alias("property_address"), F.lit("N1").alias("property_postcode"), F.lit(9.0).alias("deposit_amount"))
    return intake.sync_disputes(disputes(spark, d), cases).select("dispute_id", "property_address", "property_postcode", "deposit_amount", "tenant_complete", "landlord_complete", "status")


def joins(spark, d):
    """Requests for tenants' slots: two for every second dispute, which they name, as codes of so many ids repeat, and one for a code that nobody has."""
    k = F.col("o_orderkey")
    asked = table(spark, d, "orders").filter(k % 2 == 0).select(F.lower(intake.invite_code(k)).alias("code"), k.alias("dispute_id"), F.explode(F.array(k + 7, k + 8)).alias("session_id"), F.lit("tenant").alias("role"))
    nobody = spark.createDataFrame([("zz", None, 1, "tenant")], "code string, dispute_id long, session_id long, role string")
    return intake.join_outcomes(disputes(spark, d), asked.unionByName(nobody))


def created(spark, d):
    """Requests for disputes of which the codes of every tenth are in use."""
    k = F.col("o_orderkey")
    taken = table(spark, d, "orders").filter(k % 10 == 0).select(intake.invite_code(k).alias("code"))
    return intake.create_disputes(table(spark, d, "orders").select(k.alias("dispute_id"), (k * 2).alias("session_id"), F.when(k % 2 == 0, "tenant").otherwise("landlord").alias("role")), taken)


FIELDS = {"address": "string", "start_date": "string", "deposit_amount": "double"}


def steps(spark, d):
    """Conversations whose extractor answers by turn: an address, then a date, nothing new, broken JSON, then an amount."""
    user = table(spark, d, "conversations").filter("role = 'user'").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "text", F.lit("tenant").alias("role"))
    t = F.col("seq") % 10
    answer = F.when(t == 0, F.concat(F.lit('```json\n{"address": {"value": "'), F.col("session_id").cast("string"), F.lit(' High St", "confidence": 0.8}}\n```'))).when(t == 2, '{"start_date": "2020-01-01"}').when(t == 4, '{"no_new_info": true, "address": "lost"}').when(t == 6, "{broken").otherwise('{"deposit_amount": {"value": 900, "confidence": 0.5}}')
    answers = user.select("session_id", "seq", answer.alias("answer"))
    return intake.message_step(user, answers, FIELDS).select("session_id", "seq", "stage", "tries", "is_complete", *FIELDS)


STEPS_SQL = f"""WITH RECURSIVE m AS MATERIALIZED (SELECT conv_id, turn, coalesce(text, '') AS text, turn % 10 AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE role = 'user'),
kn AS MATERIALIZED (SELECT *, bool_or(t = 0) OVER w AS a, bool_or(t = 2) OVER w AS s, bool_or(t NOT IN (0, 2, 4, 6)) OVER w AS dep FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r(conv_id, rn, stage, tries) AS (SELECT DISTINCT conv_id, 0::BIGINT, 'basic_details', 0 FROM m UNION ALL
  SELECT conv_id, rn, CASE WHEN need THEN CASE WHEN met OR tries + 1 >= 3 THEN nxt ELSE stage END WHEN stage IN ('evidence_collection', 'claim_amounts', 'narrative') THEN nxt WHEN said THEN 'complete' ELSE stage END,
    CASE WHEN need THEN CASE WHEN met OR tries + 1 >= 3 THEN 0 ELSE tries + 1 END WHEN stage IN ('evidence_collection', 'claim_amounts', 'narrative') OR said THEN 0 ELSE tries END
  FROM (SELECT r.conv_id, kn.rn, stage, tries, stage IN ('basic_details', 'tenancy_details', 'deposit_details', 'issue_identification') AS need, CASE stage WHEN 'basic_details' THEN a WHEN 'tenancy_details' THEN s ELSE false END AS met,
    [{', '.join(q(x) for x in intake.STAGES)}][list_position([{', '.join(q(x) for x in intake.STAGES)}], stage) + 1] AS nxt, stage = 'confirmation' AND ({' OR '.join(f'contains(lower(text), {q(w)})' for w in intake.CONFIRM)}) AS said FROM r JOIN kn ON kn.conv_id = r.conv_id AND kn.rn = r.rn + 1))
SELECT conv_id AS session_id, turn AS seq, stage, tries, stage = 'complete' AS is_complete, CASE WHEN a THEN conv_id || ' High St' END AS address, CASE WHEN s THEN '2020-01-01' END AS start_date, CASE WHEN dep THEN 900.0 END::DOUBLE AS deposit_amount
FROM r JOIN kn USING (conv_id, rn)"""

GUIDANCE = {"tenant": {"basic_details": "Ask where they lived."}, "landlord": {"basic_details": "Ask which property it is."}}


def told(spark, d):
    rows = R.cases(spark, d).withColumn("stage", F.when(F.col("case_id") % 2 == 0, "basic_details").otherwise("narrative")).withColumn("deposit_amount", F.when(F.col("case_id") % 7 != 0, F.floor("deposit_amount")))
    return rows.select("case_id", intake.response_context(GUIDANCE).alias("told"))


TOLD_SQL = f"""WITH {R.CASES_SQL}, m AS (SELECT *, concat_ws(', ', CASE WHEN k % 5 = 0 THEN 'property address' END, CASE WHEN k % 7 = 0 THEN 'deposit amount' END, CASE WHEN issue IS NULL THEN 'dispute issues' END) AS missing,
  (k % 5 = 0)::INTEGER + (k % 7 = 0)::INTEGER + (issue IS NULL)::INTEGER AS lack FROM c)
SELECT k AS case_id, concat_ws(chr(10), CASE WHEN k % 2 = 0 THEN 'Ask where they lived.' ELSE {q(intake.NATURALLY)} END, '', {q(intake.COLLECTED)}, CASE WHEN k % 5 <> 0 THEN '- Property: addr ' || o_custkey END, '- Tenancy start: ' || s, '- Tenancy end: ' || e,
  CASE WHEN k % 7 <> 0 THEN '- Deposit: £' || floor(o_totalprice)::BIGINT END, '- Deposit protection: ' || CASE WHEN k % 2 = 1 THEN 'Protected' ELSE 'NOT PROTECTED' END, CASE WHEN issue IS NOT NULL THEN '- Issues: ' || issue END, '- Evidence mentioned: ' || kind,
  CASE WHEN lack > 0 THEN {q(intake.STILL_MISSING)} || missing || chr(10) || {q(intake.ASK)} ELSE {q(intake.ALL_THERE)} END, chr(10) || 'Completeness: ' || (100 - lack * 20) || '%') AS told FROM m"""


def predicted(spark, d):
    """Cases of which every third's gate is shut and every fifth has no retrieval; the model answers in turn as parsed_answers() does."""
    rows = R.cases(spark, d).withColumn("facts", intake.case_summary())
    got = rows.filter("case_id % 5 <> 0").select("case_id", F.when(F.col("case_id") % 3 == 0, "abstain_cases").otherwise("proceed").alias("gate"), F.lit("[1] x").alias("context"))
    return predict.predict(rows, got, predict.Canned('{"overall_outcome": "split", "overall_confidence": 0.6, "reasoning_trace": [{"citations": [{}, {}]}], "issue_predictions": [{"supporting_cases": [{}]}]}'))


def graded(spark, d):
    """Answers of which some are no JSON and some lack a field: what a declared schema accepts, and why not."""
    k = F.col("event_id")
    text = F.when(k % 3 == 0, F.concat(F.lit('{"name": "n'), k.cast("string"), F.lit('", "score": 1}'))).when(k % 3 == 1, '{"score": 2}').otherwise("none")
    good, bad = predict.structured(table(spark, d, "events").select("event_id", text.alias("answer")), "name string, score int", ("name",))
    return good.select("event_id", "name", "score", F.lit(None).cast("string").alias("problem")).unionByName(bad.select("event_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("score"), "problem"))


def answered_once(spark, d):
    """The whole texts as prompts of a provider that answers from last to first; the English ones are asked before, and not again."""

    def backwards(texts):
        import hashlib

        return [(i, hashlib.md5(t.encode()).hexdigest().upper()) for i, t in enumerate(texts)][::-1]

    rows, place = table(spark, d, "documents").select("doc_id", "lang", "text"), folder(spark, "answers")
    calls.answered(rows.filter("lang = 'en'"), backwards, place, column="text", batch=200)
    return calls.answered(rows, backwards, place, column="text", batch=200).select("doc_id", "answer")


def case_folders(spark, d):
    """The pages as cases in folders, read back: every third has a PDF too, its URL's bytes."""
    k, n = F.col("page_id"), F.col("page_id").cast("string")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("deposit", "adjacent", "odd")]), (k % 3 + 1).cast("int"))
    rows = table(spark, d, "pages").select(F.concat(F.lit("LON/"), n).alias("case_reference"), (k % 20 + 2000).cast("int").alias("year"), kind.alias("category"), "url", "html", F.when(k % 3 == 0, F.encode("url", "utf-8")).alias("pdf"))
    place = folder(spark, "cases")
    folders.write_cases(rows, place)
    return folders.read_cases(spark, place, "case_reference string, year int, category string, url string").select("folder", "case_reference", "year", "category", "url", F.md5("html").alias("html_md5"), F.md5("pdf").alias("pdf_md5"))


CASE_FOLDERS_SQL = """SELECT ['deposit', 'adjacent', 'other'][page_id % 3 + 1] || '-cases/' || (page_id % 20 + 2000) || '/LON%2F' || page_id AS folder, 'LON/' || page_id AS case_reference, (page_id % 20 + 2000)::INTEGER AS year,
  ['deposit', 'adjacent', 'odd'][page_id % 3 + 1] AS category, url, md5(nullif(html, '')) AS html_md5, CASE WHEN page_id % 3 = 0 THEN md5(nullif(url, '')) END AS pdf_md5 FROM pages WHERE html <> '' OR (page_id % 3 = 0 AND url <> '')"""


def byte_pairs() -> BytePairs:
    import public_tokenizers as P

    return BytePairs.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def byte_pair_counts(spark, d):
    return dealt(table(spark, d, "documents")).select("doc_id", byte_pairs().count(F.col("text")).alias("tokens"))


def chunk_byte_pairs(spark, d):
    made = chunking.chunks(dealt(table(spark, d, "documents")), encoder=byte_pairs())
    return made.select("chunk_id", "id", "chunk_index", "section", "token_count", F.md5("text").alias("m"))


def answer_steps(spark, d):
    k = F.col("event_id")
    text = F.when(k % 2 == 0, F.concat(F.lit('{"reasoning_trace": [{"content": "a"}, {"step_number": 9, "confidence": 0.2, "citations": [{"case_reference": "c'), k.cast("string"), F.lit('"}]}]}'))).otherwise(F.concat(F.lit("no JSON "), k.cast("string")))
    rows = predict.parse(table(spark, d, "events").select("event_id", text.alias("answer"))).select("event_id", F.explode("steps").alias("s"))
    return rows.select("event_id", "s.step", "s.category", "s.content", "s.confidence", F.array_join(F.transform("s.citations", lambda c: F.concat_ws(":", c["case_reference"], c["year"].cast("string"))), ",").alias("cited"))


def query_log(spark, d):
    return table(spark, d, "events").select("event_id", "ts", F.get_json_object("props", "$.k").cast("double").alias("hits"), F.col("event_type").alias("component"), F.when(F.col("event_id") % 10 == 0, "timeout").alias("error"))


def stored_chunks(spark, d):
    k = F.col("vec_id")
    rows = table(spark, d, "embeddings").select(k.cast("string").alias("chunk_id"), F.when(k % 2 == 0, "R").alias("case_reference"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("section_type"), F.lit(None).cast("int").alias("chunk_index"), F.when(k % 3 == 0, "2019").when(k % 3 == 1, "soon").alias("year"), F.when(k % 2 == 0, "").otherwise("LON").alias("region"), F.lit("").alias("case_type"), F.lit(None).cast("int").alias("token_count"))
    return files.stored_chunks(rows)


def uploads(spark, d):
    k = F.col("page_id")
    mime = F.element_at(F.array(*[F.lit(x) for x in ("application/pdf", "image/JPEG", "text/html", "image/heic")]), (k % 4 + 1).cast("int"))
    rows = table(spark, d, "pages").select("page_id", F.concat(F.lit("up/"), k.cast("string"), F.element_at(F.array(*[F.lit(x) for x in (".x", "-receipt", "-photo", "-letter", "-nothing")]), (k % 5 + 1).cast("int"))).alias("path"), mime.alias("mime"), F.lit("d").alias("description"), F.lit("body\nof it").alias("text"))
    return files.uploads_processed(files.allowed_uploads(rows)).select("page_id", "evidence_id", "evidence_type", "evidence_text")


UPLOADS_SQL = """WITH u AS (SELECT page_id, 'up/' || page_id || ['.x', '-receipt', '-photo', '-letter', '-nothing'][page_id % 5 + 1] AS path, page_id % 4 IN (1, 3) AS img FROM pages WHERE page_id % 4 <> 2),
k AS (SELECT *, CASE WHEN img THEN CASE page_id % 5 WHEN 2 THEN 'photos_after' ELSE 'photos_after' END ELSE ['other', 'receipts', 'photos_after', 'correspondence', 'other'][page_id % 5 + 1] END AS kind FROM u)
SELECT page_id, substring(sha256(path), 1, 8) AS evidence_id, kind AS evidence_type, CASE kind WHEN 'photos_after' THEN 'Photos After' ELSE upper(kind[1]) || kind[2:] END || ': ' || CASE WHEN img THEN '[image]' ELSE 'body of it' END AS evidence_text FROM k"""


def sql_functions(spark, d):
    functions.register(spark)
    docs = dealt(table(spark, d, "documents"))
    return spark.sql("SELECT doc_id, md5(clean_text(text)) AS cleaned, md5(array_join(bm25_tokens(text), ' ')) AS tokens, round(jaccard(array(lang), array('en', 'fr')), 6) AS jac, md5(redact_pii(text)) AS redacted FROM {docs}", docs=docs)


def sql_cosine(spark, d):
    functions.register(spark)
    return spark.sql("SELECT vec_id, round(cosine_sim(cast(embedding AS array<double>), transform(cast(embedding AS array<double>), (x, i) -> x + i)), 6) AS c FROM {v}", v=table(spark, d, "embeddings"))


_engines: dict[tuple, Engine] = {}


def engine_ingest(spark: SparkSession, d: str) -> DataFrame:
    """A new engine over a folder's documents; gives the counters of its ingest."""
    engine = Engine(spark, folder(spark, "engine"), issues=R.SYLLABLES, evidence=R.PROOF, as_of_year=R.YEAR)
    docs = R.corpus(spark, d).select(F.col("doc_id").cast("string").alias("case_reference"), "text", "year", "region", F.col("source").alias("case_type"))
    counts = engine.ingest(docs)
    _engines[R.state_of(spark, d, "documents")] = engine
    return counts


def engine_of(spark: SparkSession, d: str) -> Engine:
    """The engine over a folder's documents, made by the first query of a session that needs it."""
    key = R.state_of(spark, d, "documents")
    if key not in _engines:
        engine_ingest(spark, d)
    return _engines[key]


def engine_retrieve(spark, d):
    return engine_of(spark, d).retrieve(R.asked(spark)).select("query_id", "id", "rerank_rank", "rerank_score", "explanation")


def engine_stats(spark, d):
    return engine_of(spark, d).get_stats().withColumns({"years": F.array_join("years", ","), "regions": F.array_join("regions", ","), "top_types": F.array_join("top_types", ",")}).drop("total_tokens", "avg_tokens")


_PARAGRAPHS = R.STRIP_SQL(R.PII_SQL(R._ws(R._replaced(R.ENC_SQL, [(p, " ") for p in T.NOISE if p != r"\n{3,}"], True))))
_CLEANED = f"SELECT doc_id AS id, {_PARAGRAPHS} AS whole FROM documents"
_CHUNKED = R.chunks_sql(_CLEANED, 500, 50)

QUERIES: dict[str, tuple] = {
    "index_entries": (list_pages, LIST_SQL),
    "case_page_fields": (case_pages, CASE_PAGES_SQL),
    "index_rows": (index_rows, f"WITH {SCRAPED_SQL} SELECT case_reference, 'Case ' || k AS title, CASE WHEN k % 2 = 0 THEN year || '-03-01' END AS decision_date, 'Housing' AS category_text, 'http://x.org/c/' || year || '/' || case_reference || '.html' AS html_url, 'http://x.org/c/' || year || '/' || case_reference || '.pdf' AS pdf_url FROM s"),
    "category_flags": (R._plain("documents", lambda t: t.select("doc_id", lexicons.keyword_hits(F.col("text"), R.FIRST).alias("a"), lexicons.keyword_hits(F.col("text"), R.SECOND).alias("b"), lexicons.tier(F.col("text"), R.FIRST, R.SECOND).alias("tier")).select("doc_id", *[(F.array_join(c, ",") if n == "all_keywords" else c).alias(n) for n, c in lexicons.category_flags(F.col("tier"), F.col("a"), F.col("b")).items()])),
        f"WITH h AS (SELECT doc_id, {', '.join(f'list_sort(list_filter([' + ', '.join(f'CASE WHEN contains(lower(text), {q(w)}) THEN {q(w)} END' for w in words) + f'], lambda x: x IS NOT NULL)) AS {name}' for name, words in (('a', R.FIRST), ('b', R.SECOND)))} FROM documents) SELECT doc_id, len(a) > 0 AS is_deposit_case, len(a) = 0 AND len(b) > 0 AS is_adjacent_case, array_to_string(list_concat(a, b), ',') AS all_keywords FROM h"),
    "pending": (lambda s, d: ledger.pending(scraped(s, d), 1995).select("case_reference", "status"), f"WITH {SCRAPED_SQL} SELECT case_reference, status FROM s WHERE status NOT IN ('complete', 'skipped') AND year = 1995"),
    "resume_years": (lambda s, d: ledger.resume_years(scraped(s, d)), f"WITH {SCRAPED_SQL} SELECT DISTINCT year FROM s WHERE status NOT IN ('complete', 'skipped')"),
    "to_fetch": (lambda s, d: ledger.to_fetch(scraped(s, d).select("case_reference", "year"), scraped(s, d)), f"WITH {SCRAPED_SQL} SELECT case_reference, year FROM s WHERE status <> 'complete'"),
    "error_log": (lambda s, d: ledger.errors(scraped(s, d), F.lit(NOW).cast("timestamp")), f"WITH {SCRAPED_SQL} SELECT case_reference, error_message, TIMESTAMP '{NOW}' AS occurred_at FROM s WHERE error_message IS NOT NULL"),
    "run_log": (runs, f"WITH {SCRAPED_SQL} SELECT 'run-1' AS run_id, TIMESTAMP '{NOW}' AS started_at, TIMESTAMP '2025-01-02 00:00:00' AS completed_at, array_to_string(list_sort(list(DISTINCT year)), ',') AS years FROM s"),
    "output_folders": (lambda s, d: scraped(s, d).select(ledger.output_folder(F.col("category"), F.col("year"), F.col("case_reference")).alias("folder")), f"WITH {SCRAPED_SQL} SELECT category || '-cases/' || year || '/' || case_reference AS folder FROM s"),
    "scrape_statistics": (lambda s, d: ledger.statistics(scraped(s, d)), f"WITH {SCRAPED_SQL}, u AS (SELECT unnest(['status', 'category', 'year']) AS dimension, unnest([status, category, year::VARCHAR]) AS value FROM s) SELECT dimension, value, count(*)::DOUBLE AS n FROM u GROUP BY ALL UNION ALL SELECT unnest(['total', 'errors', 'completion_rate']), '', unnest([count(*), count(error_message), round(count(*) FILTER (status = 'complete') * 100.0 / count(*), 2)::DOUBLE]) FROM s"),
    "run_summary": (lambda s, d: ledger.run_summary(scraped(s, d)), f"WITH {SCRAPED_SQL} SELECT year, count(*) AS cases, count(*) FILTER (status = 'complete') AS succeeded, count(*) FILTER (status = 'failed') AS failed, round(count(*) FILTER (status = 'complete') * 100.0 / count(*), 2)::DOUBLE AS success_rate FROM s GROUP BY ROLLUP (year)"),
    "deposit_list": (lambda s, d: ledger.deposit_cases(scraped(s, d)).select("case_reference", "year"), f"WITH {SCRAPED_SQL} SELECT case_reference, year FROM s WHERE category = 'deposit'"),
    "status_update": (updated, f"WITH {SCRAPED_SQL} SELECT case_reference, CASE WHEN k % 3 = 0 THEN 'complete' ELSE status END AS status, CASE WHEN k % 4 = 0 THEN 'again' ELSE error_message END AS error_message, CASE WHEN k % 3 = 0 THEN TIMESTAMP '{NOW}' END AS scraped_at FROM s"),
    "export_lines": (exported, f"""WITH {SCRAPED_SQL} SELECT md5('{{"year":' || year || ',"case_reference":"' || case_reference || '","status":"' || status || '"}}') AS m, year, count(*) OVER () AS total FROM s"""),
    "deletes": (lambda s, d: store.deleted(table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id")), table(s, d, "labels"), "doc_id"), "SELECT vec_id AS doc_id, vec_id IN (SELECT doc_id FROM labels) AS deleted FROM embeddings"),
    "cascading_delete": (lambda s, d: store.delete_cascading(table(s, d, "labels"), "doc_id", docs=table(s, d, "documents").select("doc_id"), labels=table(s, d, "labels"))["docs"], "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "collection_row": (lambda s, d: stats.collection(R.corpus(s, d), "source", "lang").withColumns({"years": F.array_join("years", ","), "regions": F.array_join("regions", ","), "top_types": F.array_join("top_types", ",")}),
        "WITH t AS (SELECT lang, count(*) AS n FROM documents WHERE lang <> '' GROUP BY lang ORDER BY n DESC, lang LIMIT 10) SELECT count(*) AS chunks, count(DISTINCT source) AS cases, array_to_string(list_sort(list(DISTINCT 2005 + doc_id % 20)), ',') AS years, array_to_string(list_sort(list(DISTINCT ['LON','CHI','MAN','BIR','CAM'][doc_id % 5 + 1])), ',') AS regions, (SELECT array_to_string(list(lang ORDER BY n DESC, lang), ',') FROM t) AS top_types, round(count(*)::DOUBLE / count(DISTINCT source), 2) AS avg_chunks FROM documents"),
    "running_means": (lambda s, d: stats.running_mean(query_log(s, d), "hits", "ts", tie="event_id").select("event_id", F.round("running_mean", 6).alias("running_mean")), "SELECT event_id, round(avg((props->>'$.k')::DOUBLE) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS running_mean FROM events"),
    "component_usage": (lambda s, d: stats.usage(query_log(s, d), "hits"), "SELECT event_type AS component, count(*) AS calls, count(*) FILTER (event_id % 10 = 0) AS failed, sum((props->>'$.k')::DOUBLE) AS hits FROM events GROUP BY event_type"),
    "mean_confidence": (lambda s, d: table(s, d, "events").select("event_id", F.round(stats.mean_confidence(F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("a"), F.lit(0.5), F.lit("b"), (F.col("event_id") % 10) / 10.0))), 6).alias("c")), "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN round((0.5 + (event_id % 10) / 10.0) / 2, 6) ELSE 0 END::DOUBLE AS c FROM events"),
    "kpis": (lambda s, d: listings.kpis(disputes(s, d), R.dispute_rows(s, d)[1]), f"WITH {DISPUTES_SQL} SELECT count(*) AS total_disputes, count(*) FILTER (k % 3 <> 0 AND k % 5 <> 0) AS both_joined, count(*) FILTER (k % 3 = 0 OR k % 5 = 0) AS waiting, count(*) FILTER (k % 7 = 0) AS ready, 2 * count(*) AS total_sessions, count(*) FILTER (k % 2 = 0) + count(*) FILTER (k % 4 < 3) AS complete_sessions FROM dp"),
    "by_region_and_year": (lambda s, d: listings.by_region_and_year(R.corpus(s, d), "lon", 2010).select("doc_id"), "SELECT doc_id FROM documents WHERE doc_id % 5 = 0 AND 2005 + doc_id % 20 = 2010"),
    "disputes_of_status": (lambda s, d: listings.disputes_of_status(disputes(s, d), "both_complete", 50).select("dispute_id"), f"WITH {DISPUTES_SQL} SELECT dispute_id FROM dp WHERE status = 'both_complete' ORDER BY created_at DESC, dispute_id LIMIT 50"),
    "dispute_list": (lambda s, d: listings.dispute_list(disputes(s, d)).select("dispute_id", "code", "has_tenant", "has_landlord"), f"WITH {DISPUTES_SQL} SELECT dispute_id, code, k % 3 <> 0 AS has_tenant, k % 5 <> 0 AS has_landlord FROM dp"),
    "dispute_of_session": (lambda s, d: listings.dispute_of_session(disputes(s, d), table(s, d, "labels").select(F.col("doc_id").alias("session_id"))), f"WITH {DISPUTES_SQL}, b AS (SELECT tenant_session_id AS session_id, dispute_id, 'tenant' AS side FROM dp UNION ALL SELECT landlord_session_id, dispute_id, 'landlord' FROM dp) SELECT * FROM b WHERE session_id IN (SELECT doc_id FROM labels)"),
    "existing_ids": (lambda s, d: listings.existing(table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id")), table(s, d, "documents"), "doc_id"), "SELECT vec_id AS doc_id, vec_id IN (SELECT doc_id FROM documents) AS \"exists\" FROM embeddings"),
    "predictions_of": (lambda s, d: listings.predictions_of(table(s, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), "l_linenumber", F.col("l_shipdate").alias("created_at")), table(s, d, "labels").select(F.col("doc_id").alias("case_id"))).select("case_id", "l_linenumber"), "SELECT l_orderkey AS case_id, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT doc_id FROM labels)"),
    "session_status": (lambda s, d: listings.session_status(table(s, d, "conversations").select(F.col("conv_id").alias("session_id")).distinct(), table(s, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", "text")).select("session_id", "n_messages", F.md5(F.array_join(F.transform("messages", lambda m: F.concat_ws("|", m["seq"].cast("string"), m["role"], m["text"])), "~")).alias("m")),
        "SELECT conv_id AS session_id, count(*) AS n_messages, md5(string_agg(concat_ws('|', turn::VARCHAR, role, text), '~' ORDER BY turn, role, text)) AS m FROM conversations GROUP BY conv_id"),
    "sync_disputes": (sync, "SELECT o_orderkey AS dispute_id, CASE WHEN o_orderkey % 2 = 0 THEN 'old' ELSE 'new' END AS property_address, 'N1' AS property_postcode, CASE WHEN o_orderkey % 3 = 0 THEN 9.0 ELSE 5.0 END::DOUBLE AS deposit_amount, o_orderkey % 2 = 0 AS tenant_complete, o_orderkey % 6 = 0 AS landlord_complete, CASE WHEN o_orderkey % 6 = 0 OR o_orderkey % 7 = 0 THEN 'both_complete' ELSE 'in_progress' END AS status FROM orders"),
    "join_outcomes": (joins, f"WITH {DISPUTES_SQL}, a AS (SELECT k, code, unnest([k + 7, k + 8]) AS session_id FROM dp WHERE k % 2 = 0) SELECT code, session_id, 'tenant' AS role, CASE WHEN k % 3 <> 0 OR session_id = k + 8 THEN 'taken' ELSE 'joined' END AS outcome FROM a UNION ALL SELECT 'ZZ', 1, 'tenant', 'unknown'"),
    "create_disputes": (created, f"WITH {DISPUTES_SQL} SELECT dispute_id, CASE WHEN k % 10 = 0 THEN upper(substring(sha256(k || '#1'), 1, 8)) ELSE code END AS code, CASE WHEN k % 2 = 0 THEN k * 2 END AS tenant_session_id, CASE WHEN k % 2 = 1 THEN k * 2 END AS landlord_session_id, CASE WHEN k % 2 = 0 THEN 'waiting_for_landlord' ELSE 'waiting_for_tenant' END AS status FROM dp"),
    "force_ready": (lambda s, d: intake.force_ready(disputes(s, d), table(s, d, "labels").select(F.col("doc_id").alias("session_id"))), f"WITH {DISPUTES_SQL}, b AS (SELECT tenant_session_id AS session_id, * FROM dp UNION ALL SELECT landlord_session_id, * FROM dp) SELECT l.doc_id AS session_id, dispute_id, status AS old_status, CASE WHEN k % 3 <> 0 AND k % 5 <> 0 THEN 'ready_for_mediation' ELSE status END AS new_status FROM labels l LEFT JOIN b ON b.session_id = l.doc_id"),
    "message_steps": (steps, STEPS_SQL),
    "response_context": (told, TOLD_SQL),
    "predict_cases": (predicted, "SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 THEN 'uncertain' ELSE 'split' END AS outcome, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 THEN 0.0 ELSE 0.6 END::DOUBLE AS confidence, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 THEN 0 ELSE 3 END AS n_citations, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 THEN 'abstain_cases' END AS reason FROM orders"),
    "structured_answers": (graded, "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'n' || event_id END AS name, CASE WHEN event_id % 3 = 0 THEN 1 END AS score, CASE event_id % 3 WHEN 1 THEN 'missing: name' WHEN 2 THEN 'not JSON' END AS problem FROM events"),
    "byte_pair_counts": (byte_pair_counts, None),
    "chunk_byte_pairs": (chunk_byte_pairs, None),
    "case_folders": (case_folders, CASE_FOLDERS_SQL),
    "answered_once": (answered_once, "SELECT doc_id, upper(md5(text)) AS answer FROM documents"),
    "answer_steps": (answer_steps, "SELECT event_id, unnest([1, 9]) AS step, 'analysis' AS category, unnest(['a', '']) AS content, unnest([0.7, 0.2])::DOUBLE AS confidence, unnest(['', 'c' || event_id || ':2022']) AS cited FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 1, 'analysis', 'no JSON ' || event_id, 0.3, '' FROM events WHERE event_id % 2 = 1"),
    "stored_chunks": (stored_chunks, "SELECT vec_id::VARCHAR AS chunk_id, CASE WHEN vec_id % 2 = 0 THEN 'R' ELSE '' END AS case_reference, '' AS text, 'unknown' AS section_type, 0 AS chunk_index, CASE WHEN vec_id % 3 = 0 THEN 2019 ELSE 2020 END AS year, CASE WHEN vec_id % 2 = 1 THEN 'LON' END AS region, NULL::VARCHAR AS case_type, 0 AS token_count FROM embeddings"),
    "uploads": (uploads, UPLOADS_SQL),
    "sql_functions": (sql_functions, f"SELECT doc_id, md5({R.CLEAN_SQL}) AS cleaned, md5(array_to_string({R.TOKENS_SQL}, ' ')) AS tokens, CASE WHEN lang IN ('en', 'fr') THEN 0.5 ELSE 0 END::DOUBLE AS jac, md5({R.PII_SQL('text')}) AS redacted FROM documents"),
    "sql_cosine": (sql_cosine, "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], list_transform(embedding::DOUBLE[], lambda x, i: x + i - 1)), 6) AS c FROM embeddings"),
    "engine_ingest": (engine_ingest, f"WITH n AS (SELECT count(*) AS chunks FROM ({_CHUNKED})) SELECT count(*) AS total, count(*) FILTER (whole <> '') AS processed, count(*) FILTER (whole = '') AS skipped, 0::BIGINT AS failed, any_value(chunks) AS chunks FROM ({_CLEANED}), n"),
    "engine_stats": (engine_stats, f"""WITH k AS MATERIALIZED (SELECT ch.id, source, 2005 + id % 20 AS year, ['LON','CHI','MAN','BIR','CAM'][id % 5 + 1] AS region FROM ({_CHUNKED}) ch JOIN documents ON doc_id = ch.id), t AS (SELECT source, count(*) AS n FROM k WHERE source <> '' GROUP BY source ORDER BY n DESC, source LIMIT 10)
  SELECT count(*) AS chunks, count(DISTINCT id) AS cases, array_to_string(list_sort(list(DISTINCT year)), ',') AS years, array_to_string(list_sort(list(DISTINCT region)), ',') AS regions, (SELECT array_to_string(list(source ORDER BY n DESC, source), ',') FROM t) AS top_types, round(count(*)::DOUBLE / count(DISTINCT id), 2) AS avg_chunks FROM k"""),
    "engine_retrieve": (engine_retrieve, None),
}

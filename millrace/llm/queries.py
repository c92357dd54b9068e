"""One query for each operator of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_chats, read_loss, read_turns, text_part
from .decontaminate import decontaminate, is_contaminated
from .fingerprint import compare_with_next
from .jaccard import jaccard_components
from .lines import repeated_units
from .mixing import cyclic_weights, mix_sources, n_words
from .scoring import backoff_scores
from .secrets import find_secrets, labelled_findings, train
from .toxicity import fit, score
from .warc import resolve_revisits


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = "\\### Assistant: </turn> ok"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(marks).alias("text"))
    messages = rows.unionByName(own).withColumn("content", text_part(F.coalesce("text", F.lit(""))))
    chats = format_chats(messages).withColumn("turns", read_turns(F.col("formatted"))).withColumn("learned", read_loss(F.col("formatted"), F.col("loss")))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        _sha256(turns).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        _sha256(F.col("learned")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        F.col("expanded").alias("expanded_tokens"),
    )


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = backoff_scores(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select("doc_id", F.col("lm_words").alias("n_words"), F.round("lm_score", 3).alias("log_score"), F.col("lm_backed_off").alias("n_backed_off"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    short = docs.select("doc_id", "source", n_words(F.col("text")).alias("words"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))
    mixed = mix_sources(short, cyclic_weights(docs), F.col("words"), content=F.col("digest"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"), F.col("mix_whole").alias("whole_repetitions"))


def held_out(id: str = "doc_id") -> Column:
    """A null id is not."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the secrets are; of a secret itself only its digest."""
    found = find_secrets(_table(spark, sf_dir, "documents"), train(labelled_findings(spark)))
    return found.select("doc_id", "start", F.length("token").cast("long").alias("length"), _sha256(F.col("token")).alias("secret_sha256"), "probability")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, _table(spark, sf_dir, "labels"), use=~held_out())
    found = score(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "toxicity.score", (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"), F.size("toxicity.passages").cast("long").alias("n_passages"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), n=4, threshold=0.85)


def captures(pages: DataFrame) -> DataFrame:
    """Archive records for ``pages``: a full response of each page, and a not-modified revisit two weeks later.

    The page's number is the time in hours. Of the revisits, every 7th has another entity tag, every 11th none; every
    13th response and revisit have a date of last modification instead.
    """
    n, null = F.col("page_id"), F.lit(None).cast("string")
    tag = F.concat(F.lit('"'), F.substring(F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256), 1, 16), F.lit('"'))
    dated = F.when(n % 13 == 0, F.concat(F.lit("day "), (n % 28).cast("string")))
    size = F.length(F.coalesce("html", F.lit(""))).cast("string")
    head = lambda *pairs: F.map_filter(F.create_map(*(x for k, v in pairs for x in (F.lit(k), v))), lambda k, v: v.isNotNull())
    full = head(("ETag", F.when(n % 13 != 0, tag)), ("Last-Modified", dated), ("Content-Type", F.lit("text/html")), ("Content-Length", size), ("Date", n.cast("string")), ("Cache-Control", F.lit("max-age=60")))
    newer = F.when(n % 7 == 0, F.lit('"other"')).when((n % 11 != 0) & (n % 13 != 0), F.concat(F.lit("W/"), tag))
    seen = head(("etag", newer), ("Last-Modified", dated), ("Content-Length", F.lit("0")), ("Date", (n + 336).cast("string")), ("Vary", F.lit("accept")), ("gone", null))
    record = lambda kind, time, status, headers: F.struct(F.concat(F.lit(kind), n.cast("string")).alias("record_id"), F.col("url"), time.cast("long").alias("time"), F.lit(status).alias("status"), headers.alias("headers"))
    return pages.select(F.inline(F.array(record("response-", n, 200, full), record("revisit-", n + 336, 304, seen))))


def op7_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(captures(_table(spark, sf_dir, "pages")))
    return found.select("record_id", "canonical_url", "time", "response_id", "response_time", "outcome", *(F.col("headers")[h].alias(a) for h, a in (("etag", "etag"), ("date", "date"), ("vary", "vary"), ("content-length", "content_length"), ("cache-control", "cache_control"))))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    items = F.col("search.items")
    return found.select(
        "doc_id",
        "search.n_words",
        "search.n_hit",
        F.size(items).cast("long").alias("n_items"),
        _sha256(F.array_join(items, ",")).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_repeated_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, cut at the ends of sentences, of any length: short ones repeat most, and long ones differ in a word at an end."""
    return repeated_units(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_lm_scores": op2_lm_scores,
    "op3_mix_sources": op3_mix_sources,
    "op4_secret_scan": op4_secret_scan,
    "op5_toxicity": op5_toxicity,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_revisit_resolution": op7_revisit_resolution,
    "op8_decontaminate": op8_decontaminate,
    "op9_fingerprints": op9_fingerprints,
    "op10_repeated_units": op10_repeated_units,
}

_CANONICAL = """
  WITH a AS (SELECT page_id, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages),
  b AS (SELECT page_id, html, split_part(bare, '?', 1) AS address, CASE WHEN instr(bare, '?') > 0 THEN substr(bare, instr(bare, '?') + 1) ELSE '' END AS query FROM a),
  c AS (SELECT page_id, html,
    regexp_replace(regexp_replace(lower(split_part(address, '/', 1)), '^(www|m)[.]', ''), ':(80|443)$', '')
    || regexp_replace(substr(address, length(split_part(address, '/', 1)) + 1), '/+$', '') AS place,
    list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[a-z0-9_]+|ref|fbclid|gclid|sessionid|phpsessid)(=|$)'))) AS kept FROM b),
  d AS (SELECT page_id AS n, place || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS u,
    '"' || substr(sha256(coalesce(html, '')), 1, 16) || '"' AS tag, length(coalesce(html, '')) AS size FROM c)"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES: dict[str, str] = {
    "op1_chat_format": r"""
  WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) t(i))
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(14 + length(role) + 2 * length(regexp_replace(role, '[^%:#<]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g'))) AS BIGINT) AS formatted_chars,
    CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS expanded_tokens
  FROM m GROUP BY conv_id""",
    "op3_mix_sources": r"""
  WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5('0-' || doc_id || '-' || md5(coalesce(text, ''))) AS place FROM documents),
  t AS (SELECT source, CAST(sum(size) AS BIGINT) AS total, 3.0::DOUBLE * sum(size)::DOUBLE AS cap,
    CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM d GROUP BY source),
  r AS (SELECT *, cap / weight AS ratio,
    (sum(total) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM t),
  g AS (SELECT source, total, least(cap, weight * (SELECT max(level) FROM r WHERE ratio >= level)) AS target FROM r),
  h AS (SELECT *, CAST(round(target) AS BIGINT) // greatest(total, 1) AS whole FROM g),
  p AS (SELECT d.*, h.total, h.target, h.whole, CAST(round(h.target) AS BIGINT) - h.whole * h.total AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source)
  SELECT doc_id, size, total AS source_size, target, CAST(whole * size + least(greatest(rest - start, 0), size) AS BIGINT) AS taken, whole AS whole_repetitions FROM p""",
    "op6_ngram_jaccard_join": rf"""
  WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
  p AS (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM d WHERE len(w) > 0),
  s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM p),
  n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
  o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
  l AS (SELECT x, y FROM o JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * common >= 85 * (nx.size + ny.size - common)),
  e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
  r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x)
  SELECT d.doc_id, coalesce(any_value(n.size), 0) AS n_shingles, min(r.b) AS component_id FROM d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op10_repeated_units": rf"""
  WITH f AS (SELECT doc_id, string_split(replace(regexp_replace(coalesce(text, ''), '([.!?])([ \t\r])', '\1' || chr(1) || '\2', 'g'), chr(10), chr(10) || chr(1)), chr(1)) AS us FROM documents),
  p AS (SELECT doc_id, unnest(us) AS u, generate_subscripts(us, 1) - 1 AS no FROM f),
  q AS (SELECT doc_id, no, u, coalesce(sum(length(u)) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    regexp_extract_all(translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM p),
  r AS (SELECT *, array_to_string(w, ' ') AS key FROM q WHERE len(w) > 0),
  s AS (SELECT *, min(doc_id) OVER (PARTITION BY key) AS kept_in, row_number() OVER (PARTITION BY key, doc_id ORDER BY no) AS turn FROM r)
  SELECT doc_id, no AS unit_no, CAST(start AS BIGINT) AS start, CAST(start + length(u) AS BIGINT) AS "end", len(w) AS n_words, kept_in FROM s WHERE doc_id <> kept_in OR turn > 1""",
    "op8_decontaminate": rf"""
  WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
  b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
  i AS (SELECT item, w, least(len(w), 13) AS n, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0),
  x AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM i),
  p AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM x) WHERE len(w) >= n),
  f AS (SELECT p.doc_id, p.i, p.n, x.item FROM p JOIN x ON x.n = p.n AND x.g = array_to_string(p.w[p.i:p.i + p.n - 1], ' ')),
  h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS pos FROM f) GROUP BY doc_id),
  m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM f) GROUP BY doc_id)
  SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items, sha256(coalesce(m.items, '')) AS items_sha256,
    coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
  FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id""",
    "op2_lm_scores": f"""
  WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
  t AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS c FROM d),
  p AS (SELECT *, lag(c) OVER o AS b, lag(c, 2) OVER o AS a FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
  q AS (SELECT doc_id, i,
    count(*) OVER () AS n, count(*) OVER (PARTITION BY c) AS c1,
    CASE WHEN i > 1 THEN count(*) OVER (PARTITION BY b, c) END AS c2,
    CASE WHEN i > 2 THEN count(*) OVER (PARTITION BY a, b, c) END AS c3 FROM p),
  r AS (SELECT *, lag(c1) OVER o AS before1, lag(c2) OVER o AS before2 FROM q WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
  s AS (SELECT doc_id, CASE WHEN c3 >= 2 THEN ln(c3) - ln(before2) WHEN c2 >= 2 THEN ln(c2) - ln(before1) ELSE ln(c1) - ln(n) END
    + CASE WHEN i > 2 AND c3 < 2 THEN ln(0.4) ELSE 0 END + CASE WHEN i > 1 AND c2 < 2 THEN ln(0.4) ELSE 0 END AS score,
    CASE WHEN i > 2 AND c3 < 2 OR i = 2 AND c2 < 2 THEN 1 ELSE 0 END AS backed FROM r)
  SELECT d.doc_id, any_value(len(d.w)) AS n_words, round(sum(s.score), 3) AS log_score, CAST(coalesce(sum(s.backed), 0) AS BIGINT) AS n_backed_off
  FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id""",
    "op7_revisit_resolution": _CANONICAL
    + """,
  r AS (SELECT n, u, n AS t0, 'response-' || n AS id, CASE WHEN n % 13 <> 0 THEN tag END AS tag, CASE WHEN n % 13 = 0 THEN 'day ' || (n % 28) END AS dated, size FROM d),
  v AS (SELECT n, u, n + 336 AS t0, 'revisit-' || n AS id,
    CASE WHEN n % 7 = 0 THEN '"other"' WHEN n % 11 <> 0 AND n % 13 <> 0 THEN 'W/' || tag END AS tag,
    CASE WHEN n % 13 = 0 THEN 'day ' || (n % 28) END AS dated FROM d),
  m AS (SELECT v.id, v.u, v.t0, v.tag, v.dated, max_by(r.id, (r.t0, r.id)) AS rid, max(r.t0) AS rat,
    max_by({'t': r.tag, 'd': r.dated, 's': r.size}, (r.t0, r.id)) AS x
    FROM v LEFT JOIN r ON r.u = v.u AND r.t0 < v.t0 GROUP BY ALL),
  o AS (SELECT *, coalesce(regexp_replace(tag, '^W/', '') = x.t, dated = x.d) AS same FROM m)
  SELECT id AS record_id, u AS canonical_url, t0 AS time, rid AS response_id, rat AS response_time,
    CASE WHEN rid IS NULL THEN 'no response' WHEN same IS NULL THEN 'unchecked' WHEN same THEN 'resolved' ELSE 'mismatch' END AS outcome,
    CASE WHEN same THEN coalesce(tag, x.t) ELSE tag END AS etag, CAST(t0 AS VARCHAR) AS date, 'accept' AS vary,
    CASE WHEN same THEN CAST(x.s AS VARCHAR) ELSE '0' END AS content_length,
    CASE WHEN same THEN 'max-age=60' END AS cache_control
  FROM o""",
}

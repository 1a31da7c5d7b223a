"""Registered queries: scoring summaries, risk tiers, request stats, URL
safety, saved-analysis history, model-id validation, login lockout."""

from __future__ import annotations

from pyspark.sql import functions as F

from msgscope.functions import patterns as P
from msgscope.functions import service as SV
from msgscope.functions.text import snippet
from msgscope.operators.ranking import rank_newest
from msgscope.operators.scoring import score_with_models, summarize_batch
from msgscope.plans import sqlparts as S
from msgscope.plans.q_eval import sql_rule_score
from msgscope.plans.registry import query
from msgscope.plans.rules import RULE_MODELS, rule_score
from msgscope.sources.tables import read_table
from msgscope.streaming.lockout import lockout_batch


def rounded(c, digits: int):
    """Half to even, as Python rounds."""
    return F.rint(c * F.lit(10.0**digits)) / F.lit(10.0**digits)


def sql_rounded(c: str, digits: int) -> str:
    return f"(round_even(({c}) * {10.0**digits}, 0) / {10.0**digits})"


def _sql_tiers(p: str) -> tuple[str, str]:
    t = "CASE " + " ".join(f"WHEN {p} > {thr} THEN '{typ}'" for thr, typ, _ in P.RISK_TIERS) + f" ELSE '{P.RISK_DEFAULT[0]}' END"
    lv = "CASE " + " ".join(f"WHEN {p} > {thr} THEN '{lvl}'" for thr, _, lvl in P.RISK_TIERS) + f" ELSE '{P.RISK_DEFAULT[1]}' END"
    return t, lv


# --------------------------------------------------------------------------- PRJ-08/09/10
_T, _LV = _sql_tiers("p")
SQL_RISK_TIER = f"""
SELECT conv_id, turn, p AS spam_probability, {_T} AS risk_type, {_LV} AS risk_level,
       CAST(floor(p * 100 + 0.5) AS INTEGER) AS spam_percent, CAST(100 - floor(p * 100 + 0.5) AS INTEGER) AS ham_percent,
       {sql_rounded('abs(p - 0.5) * 2', 4)} AS confidence
FROM (SELECT conv_id, turn, {sql_rule_score('t')} AS p FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations))
"""


@query("risk_tier", SQL_RISK_TIER)
def risk_tier(spark, d):
    c = read_table(spark, d, "conversations").select("conv_id", "turn", rule_score("text").alias("p"))
    typ, lvl = SV.risk_tier(F.col("p"))
    pct = SV.spam_percent(F.col("p"))
    return c.select(
        "conv_id", "turn", F.col("p").alias("spam_probability"), typ.alias("risk_type"), lvl.alias("risk_level"),
        pct.alias("spam_percent"), (F.lit(100) - pct).cast("int").alias("ham_percent"),
        rounded(SV.confidence(F.col("p")), 4).alias("confidence"),
    )


# --------------------------------------------------------------------------- BAT-01, AGG-34
def _sql_model_union() -> str:
    parts = []
    for name, (wu, wb) in RULE_MODELS.items():
        parts.append(
            f"SELECT '{name}' AS model_id, msg_id, p, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS prediction FROM "
            f"(SELECT conv_id * 1000 + turn AS msg_id, {sql_rule_score('t', wu, wb)} AS p "
            f"FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations))"
        )
    return "\nUNION ALL\n".join(parts)


SQL_BATCH_SUMMARY = f"""
WITH preds AS ({_sql_model_union()}),
req AS (SELECT * FROM (VALUES {', '.join(f"('{m}')" for m in RULE_MODELS)}) r(model_id))
SELECT r.model_id, CAST(count(p.msg_id) AS BIGINT) AS predictions,
       CAST(coalesce(sum(p.prediction), 0) AS BIGINT) AS spam,
       CAST(count(p.msg_id) - coalesce(sum(p.prediction), 0) AS BIGINT) AS ham,
       {sql_rounded('coalesce(avg(abs(p.p - 0.5) * 2), 0)', 4)} AS avg_confidence, {sql_rounded('coalesce(avg(p.p), 0)', 4)} AS avg_spam_probability
FROM req r LEFT JOIN preds p ON p.model_id = r.model_id GROUP BY r.model_id
"""


def turns(spark, d):
    return read_table(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), "text"
    )


@query("batch_summary", SQL_BATCH_SUMMARY)
def batch_summary(spark, d):
    preds = score_with_models(turns(spark, d), RULE_MODELS)
    s = summarize_batch(preds, list(RULE_MODELS))
    return s.select(
        "model_id", "predictions", "spam", "ham",
        rounded(F.col("avg_confidence"), 4).alias("avg_confidence"), rounded(F.col("avg_spam_probability"), 4).alias("avg_spam_probability"),
    )


# --------------------------------------------------------------------------- PRJ-06, FLT-04
SQL_TEXT_STATS = f"""
SELECT conv_id, turn, CAST(length(t) AS INTEGER) AS char_count, CAST(len({S.words('t')}) AS INTEGER) AS word_count,
       CAST(greatest(1, {S.count_literal('t', '.')} + {S.count_literal('t', '!')} + {S.count_literal('t', '?')}) AS INTEGER) AS sentence_count,
       {sql_rounded(f"CASE WHEN len({S.words('t')}) > 0 THEN length(regexp_replace(t, {S.rx('[' + P.SPACE + ']+')}, '', 'g')) / len({S.words('t')}) ELSE 0.0 END", 2)} AS avg_word_length,
       CASE WHEN text IS NULL OR {S.strip('text')} = '' THEN 'empty' WHEN length(text) > {P.MAX_TEXT_CHARS} THEN 'too_long' END AS rejected
FROM (SELECT conv_id, turn, text, coalesce(text, '') AS t FROM conversations)
"""


@query("text_stats", SQL_TEXT_STATS)
def text_stats(spark, d):
    c = read_table(spark, d, "conversations")
    cols = dict(SV.request_text_stats(F.col("text")))
    return c.select(
        "conv_id", "turn", cols["char_count"].alias("char_count"), cols["word_count"].alias("word_count"),
        cols["sentence_count"].alias("sentence_count"), rounded(cols["avg_word_length"], 2).alias("avg_word_length"),
        SV.text_rejection(F.col("text")).alias("rejected"),
    )


# --------------------------------------------------------------------------- FLT-09/10, JN-09
def _sql_unsafe(url: str) -> str:
    scheme = f"lower(regexp_extract({url}, {S.rx(SV.URL_SCHEME)}, 1))"
    netloc = f"regexp_extract({url}, {S.rx(SV.URL_NETLOC)}, 1)"
    host = f"lower(split_part({netloc}, ':', 1))"
    parts = [f"TRY_CAST(regexp_extract({host}, {S.rx(SV.IPV4)}, {i}) AS BIGINT)" for i in range(1, 5)]
    ok = f"regexp_matches({host}, {S.rx(SV.IPV4)}) AND " + " AND ".join(f"{p} BETWEEN 0 AND 255" for p in parts)
    val = f"({parts[0]} * 16777216 + {parts[1]} * 65536 + {parts[2]} * 256 + {parts[3]})"
    ranges = " OR ".join(f"{val} BETWEEN {lo} AND {hi}" for lo, hi in (SV.cidr_bounds(c) for c in SV.UNSAFE_IPV4))
    blocked = ", ".join(f"'{h}'" for h in P.BLOCKED_HOSTS)
    return (
        f"CASE WHEN {scheme} NOT IN ('http', 'https') THEN 'scheme' WHEN {netloc} = '' THEN 'no_host' "
        f"WHEN {host} IN ({blocked}) THEN 'blocked_host' WHEN ({ok}) AND ({ranges}) THEN 'private_ip' END"
    )


SQL_URL_SAFETY = f"""
SELECT page_id, (lower({S.strip('url')}) LIKE 'http://%' OR lower({S.strip('url')}) LIKE 'https://%')
                AND regexp_extract({S.strip('url')}, {S.rx(SV.URL_NETLOC)}, 1) <> '' AS is_url,
       lower(split_part(regexp_extract(url, {S.rx(SV.URL_NETLOC)}, 1), ':', 1)) AS host,
       {_sql_unsafe('url')} AS unsafe_reason
FROM pages
"""


@query("url_safety", SQL_URL_SAFETY)
def url_safety(spark, d):
    p = read_table(spark, d, "pages")
    return p.select(
        "page_id", SV.is_url(F.col("url")).alias("is_url"), F.lower(SV.url_host(F.col("url"))).alias("host"),
        SV.unsafe_url_reason(F.col("url")).alias("unsafe_reason"),
    )


# --------------------------------------------------------------------------- HIS-01, SNK-10, TOP-06/07, FLT-06/07
def analyses(spark, d):
    """Saved analyses derived from the user turns of conversations."""
    c = read_table(spark, d, "conversations").where(F.col("role") == "user")
    p = rule_score("text")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.col("text").alias("message_text"),
        F.when(p > 0.5, F.array(F.lit("rule_caps"), F.lit("rule_bangs"))).otherwise(F.array(F.lit("rule_caps"))).alias("selected_models"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(mins=(F.col("conv_id") * 60 + F.col("turn")).cast("int"))).alias("created_at"),
        F.concat(F.lit("u"), (F.col("conv_id") % 10).cast("string")).alias("user_id"),
    )


SQL_ANALYSES = f"""analyses AS (
  SELECT conv_id * 1000 + turn AS id, text AS message_text,
         CASE WHEN {sql_rule_score('coalesce(text, \'\')')} > 0.5 THEN ['rule_caps', 'rule_bangs'] ELSE ['rule_caps'] END AS selected_models,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(conv_id * 60 + turn AS INTEGER)) AS created_at,
         'u' || CAST(conv_id % 10 AS VARCHAR) AS user_id
  FROM conversations WHERE role = 'user')"""

HISTORY_OWNER, HISTORY_QUERY, PAGE, PAGE_SIZE = "u3", "le", 2, 5

SQL_HISTORY_PAGE = f"""WITH {SQL_ANALYSES},
f AS (SELECT *, substr(message_text, 1, {P.SNIPPET_CHARS}) AS snip FROM analyses
      WHERE user_id = '{HISTORY_OWNER}' AND (contains(lower(substr(message_text, 1, {P.SNIPPET_CHARS})), lower('{HISTORY_QUERY}'))
            OR contains(lower(CAST(created_at AS VARCHAR)), lower('{HISTORY_QUERY}')))),
o AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, id DESC) AS pos, count(*) OVER () AS total FROM f)
SELECT id, snip AS snippet, CAST(len(selected_models) AS INTEGER) AS n_models, CAST(pos AS BIGINT) AS position,
       CAST(total AS BIGINT) AS total, pos > 1 AND {PAGE} > 1 AS has_prev, total > {PAGE * PAGE_SIZE} AS has_next
FROM o WHERE pos > {(PAGE - 1) * PAGE_SIZE} AND pos <= {PAGE * PAGE_SIZE}
"""


@query("history_page", SQL_HISTORY_PAGE)
def history_page(spark, d):
    from msgscope.operators.history import search_page

    return search_page(analyses(spark, d), HISTORY_OWNER, HISTORY_QUERY, PAGE, PAGE_SIZE)


SQL_HISTORY_LIST = f"""WITH {SQL_ANALYSES}
SELECT id, user_id, substr(message_text, 1, {P.SNIPPET_CHARS}) AS snippet, CAST(len(selected_models) AS INTEGER) AS n_models,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS BIGINT) AS recency_rank
FROM analyses
"""


@query("history_list", SQL_HISTORY_LIST)
def history_list(spark, d):
    rows = analyses(spark, d).select(
        "id", "user_id", "created_at", snippet(F.col("message_text")).alias("snippet"), F.size("selected_models").cast("int").alias("n_models")
    )
    return rank_newest(rows, ["user_id"], "created_at", "id", "recency_rank").drop("created_at")


# --------------------------------------------------------------------------- PRJ-07, SET-03/04
VALID_MODELS = list(RULE_MODELS)
SQL_MODEL_VALIDATE = f"""
SELECT conv_id, turn, array_to_string(list_distinct_ordered, ',') AS models, array_to_string(invalid, ',') AS invalid FROM (
  SELECT conv_id, turn,
         list_filter(list_distinct_keep_order, lambda x: list_contains([{', '.join(f"'{m}'" for m in VALID_MODELS)}], x)) AS list_distinct_ordered,
         list_filter(list_distinct_keep_order, lambda x: NOT list_contains([{', '.join(f"'{m}'" for m in VALID_MODELS)}], x)) AS invalid
  FROM (SELECT conv_id, turn,
               list_filter(req, lambda x, i: list_position(req, x) = i) AS list_distinct_keep_order
        FROM (SELECT conv_id, turn, ['rule_caps', CASE WHEN role = 'user' THEN 'rule_bangs' ELSE 'unknown_model' END, 'rule_caps',
                     CASE WHEN turn > 2 THEN 'rule_mixed' ELSE 'legacy_model' END] AS req FROM conversations)))
"""


@query("model_validate", SQL_MODEL_VALIDATE)
def model_validate(spark, d):
    c = read_table(spark, d, "conversations")
    req = F.array(
        F.lit("rule_caps"), F.when(F.col("role") == "user", "rule_bangs").otherwise("unknown_model"), F.lit("rule_caps"),
        F.when(F.col("turn") > 2, "rule_mixed").otherwise("legacy_model"),
    )
    ok, bad = SV.validate_model_ids(req, VALID_MODELS)
    return c.select("conv_id", "turn", F.array_join(ok, ",").alias("models"), F.array_join(F.array_distinct(bad), ",").alias("invalid"))


# --------------------------------------------------------------------------- STR-02 (batch)
SQL_LOCKOUT = f"""
WITH RECURSIVE ev AS (
  SELECT event_id, user_id AS ident, ts, event_type = 'signup' AS success,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events WHERE event_type IN ('error', 'signup')),
st(ident, rn, event_id, decision, attempts, lock_until) AS (
  SELECT ident, rn, event_id, CASE WHEN success THEN 'ok' ELSE 'failed' END, CASE WHEN success THEN 0 ELSE 1 END,
         CAST(NULL AS TIMESTAMP)
  FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.ident, e.rn, e.event_id,
    CASE WHEN s.lock_until IS NOT NULL AND e.ts < s.lock_until THEN 'locked' WHEN e.success THEN 'ok' ELSE 'failed' END,
    CASE WHEN s.lock_until IS NOT NULL AND e.ts < s.lock_until THEN s.attempts WHEN e.success THEN 0
         ELSE (CASE WHEN s.lock_until IS NOT NULL THEN 0 ELSE s.attempts END) + 1 END,
    CASE WHEN s.lock_until IS NOT NULL AND e.ts < s.lock_until THEN s.lock_until WHEN e.success THEN NULL
         WHEN (CASE WHEN s.lock_until IS NOT NULL THEN 0 ELSE s.attempts END) + 1 >= {P.LOCKOUT_ATTEMPTS}
           THEN e.ts + INTERVAL {P.LOCKOUT_SECONDS} SECOND
         ELSE NULL END
  FROM st s JOIN ev e ON e.ident = s.ident AND e.rn = s.rn + 1)
SELECT event_id, ident AS identifier, decision, CAST(attempts AS INTEGER) AS attempts, coalesce(epoch_us(lock_until), 0) AS lockout_until_us FROM st
"""


@query("lockout_fold", SQL_LOCKOUT)
def lockout_fold(spark, d):
    ev = read_table(spark, d, "events").where(F.col("event_type").isin("error", "signup")).select(
        "event_id", F.col("user_id").alias("identifier"), "ts", (F.col("event_type") == "signup").alias("success")
    )
    return lockout_batch(ev)

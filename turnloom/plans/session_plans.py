"""Registered queries of event sessions, pair scores and batch embedding."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.operators import turns as U
from turnloom.operators.embedding import embed_batch, score_cross
from turnloom.plans.base import BUDGET, CHUNKS, ENC, MSGS, STORE, O, assemble_sql, chunk_table, messages, s_bow, s_dot, s_hedge, s_sanitize, s_strip, s_tokens, scratch, settings, tidy
from turnloom.streaming.sessions import keep_typed_state, session_stream

QUERIES, ORACLES = {}, {}


def reg(name, sql=None, **kw):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = O(sql, **kw)
        return fn

    return wrap


# ------------------------------------------------------------------ curate, observe, reset
EVERY = 5  # a conversation of the tables is reset before each user message whose number this divides


def session_events(s, d, cfg):
    """Messages as events: user text is curated, assistant text observed, and now and then the conversation is reset."""
    m = U.with_user_turn(messages(s, d), cfg).where(F.col("role").isin("user", "assistant"))
    kind = F.when(F.col("role") == "user", "curate").otherwise("observe")
    said = m.select("conv_id", (F.col("turn") * 2 + 1).alias("event_no"), kind.alias("kind"), "text")
    again = m.where((F.col("role") == "user") & (F.col("user_turn") % EVERY == 0))
    return said.union(again.select("conv_id", (F.col("turn") * 2).alias("event_no"), F.lit("reset").alias("kind"), F.lit(None).cast("string").alias("text")))


# the parts of a conversation between resets are conversations of their own, with turns counted anew
_PARTS = f"""{MSGS},
ev AS (SELECT conv_id, turn, role, user_turn // {EVERY} AS epoch, {s_strip("coalesce(text, '')")} AS plain FROM msgs WHERE role IN ('user', 'assistant')),
e1 AS (SELECT *, {s_sanitize('plain')} AS content, plain <> '' AND (role = 'user' OR NOT {s_hedge('plain')}) AS live FROM ev),
e2 AS (SELECT *, sum(CASE WHEN live AND role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, epoch ORDER BY turn)::BIGINT AS part_turn FROM e1),
e3 AS (SELECT *, substr(md5(part_turn || ':' || content), 1, 12) AS chunk_id FROM e2),
e4 AS (SELECT *, live AND row_number() OVER (PARTITION BY conv_id, epoch, live, chunk_id ORDER BY turn) = 1 AS stored FROM e3),
e5 AS (SELECT *, sum(stored::INT) OVER (PARTITION BY conv_id, epoch ORDER BY turn)::BIGINT AS n FROM e4),
chunks AS (SELECT conv_id * 100000 + epoch AS conv_id, n - 1 AS seq, part_turn AS user_turn, turn, role, chunk_id, content, {s_tokens('content')} AS tokens FROM e5 WHERE stored)"""
_SESSIONS = f"""WITH {_PARTS}{ENC[len(CHUNKS):]}, {assemble_sql(near=False)},
o AS (SELECT e.conv_id, e.turn * 2 + 1 AS event_no, CASE role WHEN 'user' THEN 'curate' ELSE 'observe' END AS kind,
  CASE WHEN role = 'user' THEN CASE WHEN live THEN 'handed out' ELSE 'rejected' END WHEN NOT live THEN 'left out' WHEN stored THEN 'stored' ELSE 'known' END AS outcome,
  epoch, part_turn AS turn, least(n, {STORE}) AS store_chunks, live AND role = 'user' AS asks FROM e5 e)
SELECT o.conv_id, event_no, kind, outcome, epoch, turn, store_chunks, c.route, c.budget, c.used_tokens, c.top_raw, array_to_string(c.selected_ids, ',') AS selected_ids
FROM o LEFT JOIN ctx c ON asks AND c.conv_id = o.conv_id * 100000 + epoch AND c.q_turn = o.turn
UNION ALL SELECT conv_id, turn * 2, 'reset', 'reset', user_turn // {EVERY}, 0, 0, NULL, NULL, NULL, NULL, NULL FROM msgs WHERE role = 'user' AND user_turn % {EVERY} = 0"""


@reg("session_stream", _SESSIONS, d="top_raw")
def _session_stream(s, d):
    """Events in three lots, each a batch of its own; a conversation's events of a lot are in one file."""
    cfg = settings(s, d, fixed_budget=BUDGET)
    src, out = scratch(s), scratch(s)
    ev = session_events(s, d, cfg)
    for lot in range(3):
        part = F.least(F.floor(F.col("event_no") / 16), F.lit(2)) == lot
        ev.where(part).repartition("conv_id").write.mode("append").parquet(src)
    keep_typed_state(s)
    n = s.read.parquet(src).select(F.input_file_name()).distinct().count()
    st = s.readStream.schema("conv_id long, event_no long, kind string, text string").option("maxFilesPerTrigger", max(1, n // 3)).parquet(src)
    q = session_stream(st, cfg).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "_ckpt").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    r = s.read.parquet(out)
    return tidy(r).select(*[F.when(F.col("route").isNotNull(), F.col(c)).alias(c) if c == "selected_ids" else c for c in r.columns])


# ------------------------------------------------------------------ second tier and batch encoding
_UNIT = "list_transform(c.vec, lambda x: CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


@reg("score_cross", f"""WITH {ENC}, p AS (SELECT q.conv_id, q.seq AS q_seq, c.seq, c.chunk_id, {s_dot('q.vec', 'c.vec')} AS d, q.norm * q.norm AS qq, c.norm * c.norm AS cc,
  {s_dot('q.vec', _UNIT)} / greatest(list_sum(q.vec), 1) AS max_similarity FROM enc q JOIN enc c ON c.conv_id = q.conv_id AND c.seq < q.seq AND c.seq >= q.seq - {STORE} WHERE q.role = 'user')
SELECT conv_id, q_seq, seq, chunk_id, CASE WHEN qq = 0 THEN 0.0 ELSE coalesce((qq + d) / nullif(sqrt(qq) * sqrt(qq + 2 * d + cc), 0), 0.0) END AS relevance, max_similarity,
  0.85::DOUBLE AS confidence, 'medium' AS source FROM p""", d="relevance max_similarity")
def _score_cross(s, d):
    cfg = settings(s, d)
    return tidy(score_cross(chunk_table(s, d, cfg), cfg))


@reg("embed_batch", f"""WITH k AS (SELECT DISTINCT md5(coalesce(text, '')) AS k FROM conversations WHERE role = 'user')
SELECT conv_id, turn, md5(coalesce(text, '')) IN (SELECT k FROM k) AS cached, array_to_string(list_transform({s_bow("coalesce(text, '')")}, lambda x: x::BIGINT), ',') AS vec FROM conversations""")
def _embed_batch(s, d):
    """All messages; vectors of the user's texts are on disk from a run before."""
    path = scratch(s)
    embed_batch(messages(s, d).where("role = 'user'")).select(T.content_key(T.text_or_empty(F.col("text"))).alias("key"), "vec").write.parquet(path)
    r = embed_batch(messages(s, d), cache=s.read.parquet(path))
    return r.select("conv_id", "turn", "cached", F.array_join(F.transform("vec", lambda x: x.cast("long").cast("string")), ",").alias("vec"))

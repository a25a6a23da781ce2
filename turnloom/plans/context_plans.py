"""Candidates, duplicates, drift, assembly, archive, replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.functions import fixed as V
from turnloom.functions import text as T
from turnloom.functions import vectors as X
from turnloom.operators import assemble as A
from turnloom.operators import candidates as C
from turnloom.operators import experiments as E
from turnloom.operators import labels as L
from turnloom.operators import metrics as M
from turnloom.operators import select as S
from turnloom.operators import turns as U
from turnloom.operators.replay import prepare_replay, replay_turns
from turnloom.operators.turns import stored_chunks
from turnloom.plans.base import (
    ANSWERS, BUDGET, DRIFT, DUP, ENC, MSGS, O, STALE, STORE, WINDOW, arms_sql, assemble_sql, cand_sql, chunk_table, messages, near_sql, s_dot, s_hedge, s_sanitize,
    s_terms, s_tokens, s_words4, scratch, settings, tidy,
)
from turnloom.session import checkpointed
from turnloom.sources import readers, sinks

QUERIES, ORACLES = {}, {}

# ANSWERS and ENC start with the same first table
_BOTH = ANSWERS + ENC[len(MSGS):]


def reg(name, sql=None, **kw):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = O(sql, **kw)
        return fn

    return wrap


def _enc(s, d, **kw):
    cfg = settings(s, d, **kw)
    return chunk_table(s, d, cfg), cfg


_SCAND = f"WITH {ENC}, {cand_sql()}"


@reg("candidates", f"{_SCAND} SELECT conv_id, q_seq, seq, role, tokens FROM cand")
def _candidates(s, d):
    enc, cfg = _enc(s, d)
    return tidy(C.candidates(enc, cfg).select("conv_id", "q_seq", "seq", "role", "tokens"))


@reg("score_join", f"{_SCAND} SELECT conv_id, q_seq, seq, cosine, base FROM cand", d="cosine base")
def _score_join(s, d):
    enc, cfg = _enc(s, d)
    return tidy(C.candidates(enc, cfg).select("conv_id", "q_seq", "seq", "cosine", "base"))


@reg("score_bi", f"{_SCAND} SELECT conv_id, q_seq, seq, cosine AS relevance, 0.85::DOUBLE AS confidence, 'medium' AS source FROM cand", d="relevance")
def _score_bi(s, d):
    from turnloom.functions import vectors as X

    enc, cfg = _enc(s, d)
    v = enc.select("conv_id", "seq", "vec")
    p = C.candidates(enc, cfg).select("conv_id", "q_seq", "seq")
    j = p.join(v, ["conv_id", "seq"]).join(v.select("conv_id", F.col("seq").alias("q_seq"), F.col("vec").alias("q_vec")), ["conv_id", "q_seq"])
    return tidy(j.select("conv_id", "q_seq", "seq", X.cosine(F.col("q_vec"), F.col("vec"), X.drift_cosine).alias("relevance"), F.lit(0.85).alias("confidence"), F.lit("medium").alias("source")))


_CONF = "CASE WHEN seq % 2 = 0 THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END"


@reg("is_uncertain", f"{_SCAND} SELECT conv_id, q_seq, seq FROM cand WHERE base > 0.7 AND {_CONF} < 0.6")
def _is_uncertain(s, d):
    enc, cfg = _enc(s, d)
    c = C.candidates(enc, cfg)
    return tidy(c.where(C.is_uncertain(F.col("base"), F.when(F.col("seq") % 2 == 0, 0.5).otherwise(0.9))).select("conv_id", "q_seq", "seq"))


@reg("escalate_merge", f"""{_SCAND} SELECT conv_id, q_seq, seq, CASE WHEN base > 0.7 AND {_CONF} < 0.6 THEN 0.5 ELSE base END AS relevance,
CASE WHEN base > 0.7 AND {_CONF} < 0.6 THEN 0.85 ELSE {_CONF} END AS confidence, CASE WHEN base > 0.7 AND {_CONF} < 0.6 THEN 'medium_validated' ELSE 'ultra_small' END AS source FROM cand""", d="relevance confidence")
def _escalate_merge(s, d):
    enc, cfg = _enc(s, d)
    c = checkpointed(C.candidates(enc, cfg).select("conv_id", "q_seq", "seq", F.col("base").alias("relevance"), F.when(F.col("seq") % 2 == 0, 0.5).otherwise(0.9).alias("confidence"), F.lit("ultra_small").alias("source")))
    # the second tier only ever sees the uncertain rows
    second = c.where(C.is_uncertain(F.col("relevance"), F.col("confidence"))).select("conv_id", "q_seq", "seq", F.lit(0.5).alias("relevance"), F.lit(0.85).alias("confidence"))
    return tidy(C.escalate_merge(c, second, ["conv_id", "q_seq", "seq"]))


@reg("duplicate_pairs", f"""WITH {ENC} SELECT j.conv_id, j.seq, count(*) AS n_dups, min(i.seq) AS first_dup_seq,
max({s_dot('i.vec', 'j.vec')} / (i.norm * j.norm)) AS max_sim FROM enc i JOIN enc j ON j.conv_id = i.conv_id AND i.seq < j.seq AND i.seq >= j.seq - {STORE}
WHERE {s_dot('i.vec', 'j.vec')} / (i.norm * j.norm) > {DUP} GROUP BY ALL""", d="max_sim")
def _duplicate_pairs(s, d):
    enc, cfg = _enc(s, d)
    return tidy(C.duplicate_pairs(enc, cfg))


def _dedup_sql(rank):
    return f"""{_SCAND}, {near_sql(rank=rank)} SELECT q.conv_id, q.seq AS q_seq, coalesce(array_to_string(list_sort(list_distinct(g.dead)), ','), '') AS dropped,
coalesce(array_to_string(list_transform(list_sort(list_distinct(list_transform(g.fresh, lambda f: f.s))), lambda x: x || ':' || list_max(list_transform(list_filter(g.fresh, lambda f: f.s = x), lambda f: f.t))), ','), '') AS refreshed
FROM enc q LEFT JOIN greedy ON greedy.conv_id = q.conv_id AND greedy.q_seq = q.seq WHERE q.role = 'user'"""


def _dedup(s, d, policy):
    enc, cfg = _enc(s, d)
    x = C.dedup_chunks(enc, cfg, policy)
    show = F.transform("refreshed", lambda r: F.concat_ws(":", r.fresh_seq.cast("string"), r.fresh_turn.cast("string")))
    return tidy(x.select("conv_id", "q_seq", "dropped", show.alias("refreshed")))


@reg("dedup_chunks", _dedup_sql("density"))
def _dedup_chunks(s, d):
    return _dedup(s, d, "densest")


@reg("dedup_policy", _dedup_sql("user_turn"))
def _dedup_policy(s, d):
    return _dedup(s, d, "recency")


@reg("refresh_apply", f"""{_SCAND}, {near_sql()}, fr AS (SELECT conv_id, f.s AS seq, max(f.t) AS t FROM (SELECT conv_id, unnest(g.fresh) AS f FROM greedy) GROUP BY ALL)
SELECT e.conv_id, e.seq, greatest(e.last_ref, coalesce(fr.t, 0)) AS last_ref FROM enc e LEFT JOIN fr USING (conv_id, seq)""")
def _refresh_apply(s, d):
    enc, cfg = _enc(s, d)
    f = C.near_facts(enc, cfg).select("conv_id", F.explode(F.arrays_zip("fresh_seq", "fresh_turn")).alias("f")).select("conv_id", F.col("f.fresh_seq").alias("seq"), F.col("f.fresh_turn").alias("fresh_turn"))
    return tidy(A.refresh_apply(enc.select("conv_id", "seq", "last_ref"), f))


@reg("drift_check", f"""{_SCAND}, {near_sql()} SELECT q.conv_id, q.seq AS q_seq, coalesce(drift.drift, 0.0) AS drift_score, coalesce(drift.drift, 0.0) > {DRIFT} AS should_reset
FROM enc q LEFT JOIN drift ON drift.conv_id = q.conv_id AND drift.q_seq = q.seq WHERE q.role = 'user'""", d="drift_score")
def _drift_check(s, d):
    enc, cfg = _enc(s, d)
    return tidy(C.drift_check(enc, cfg))


@reg("drift_check_wide", f"""WITH {ENC}, {cand_sql(6)}, {near_sql(recent=2)} SELECT q.conv_id, q.seq AS q_seq, coalesce(drift.drift, 0.0) AS drift_score, coalesce(drift.drift, 0.0) > 0.2 AS should_reset
FROM enc q LEFT JOIN drift ON drift.conv_id = q.conv_id AND drift.q_seq = q.seq WHERE q.role = 'user'""", d="drift_score")
def _drift_check_wide(s, d):
    """A store of six, so that the five-chunk floor is passed."""
    enc, cfg = _enc(s, d, max_chunks=6, drift_recent_turns=2, drift_threshold=0.2)
    return tidy(C.drift_check(enc, cfg))


_CTX = "conv_id, q_seq, q_turn, route, budget, used_tokens, chunks_used, array_to_string(selected_ids, ',') AS selected_ids, top_raw, top_seq, drift_detected, n_candidates, n_survivors"
_CTX_COLS = ["conv_id", "q_seq", "q_turn", "route", "budget", "used_tokens", "chunks_used", "selected_ids", "top_raw", "top_seq", "drift_detected", "n_candidates", "n_survivors"]


@reg("assemble", f"WITH {ENC}, {assemble_sql(m=6, recent=2, drift=0.2)} SELECT {_CTX} FROM ctx", d="top_raw")
def _assemble(s, d):
    """The flagship: route, score, dedup, drift, decay, budget and fill for every user turn."""
    enc, cfg = _enc(s, d, fixed_budget=BUDGET, max_chunks=6, drift_recent_turns=2, drift_threshold=0.2)
    return tidy(A.assemble(enc, cfg, encoded=True).select(*_CTX_COLS))


_CTX_TEXT_ID = _CTX.replace("conv_id,", "'conv-' || conv_id AS conv_id,", 1)


@reg("assemble_from_files", f"WITH {ENC}, {assemble_sql(m=6, recent=2, drift=0.2)} SELECT {_CTX_TEXT_ID} FROM ctx", d="top_raw")
def _assemble_from_files(s, d):
    """From conversation files with text ids to assembled contexts: reader, ingest, encoder and assembly in one go."""
    path = scratch(s)
    m = messages(s, d)
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    # the files are this query's own fixture, one document per conversation as in the product's format
    doc = m.groupBy("conv_id").agg(F.transform(turns, lambda x: F.struct(x.role.alias("role"), x.content.alias("content"))).alias("turns"))
    name = F.concat(F.lit("conv-"), F.col("conv_id").cast("string"))
    sinks.write_documents(doc.select(F.to_json(F.struct(name.alias("conversation_id"), "turns")).alias("value")), path)
    cfg = settings(s, d, fixed_budget=BUDGET, max_chunks=6, drift_recent_turns=2, drift_threshold=0.2)
    chunks = checkpointed(stored_chunks(readers.read_conversations(s, path, "*.txt"), cfg))
    return tidy(A.assemble(chunks, cfg).select(*_CTX_COLS))


@reg("assemble_wide_encoder", f"WITH {ENC}, {assemble_sql(m=6, recent=2, drift=0.2)} SELECT {_CTX} FROM ctx", d="top_raw")
def _assemble_wide(s, d):
    """An encoder of 128 dimensions with its content in the upper half: the result is that of the 64 alone."""
    cfg = settings(s, d, fixed_budget=BUDGET, max_chunks=6, drift_recent_turns=2, drift_threshold=0.2)
    wide = lambda c: F.concat(F.array_repeat(F.lit(0), 64), X.hashed_embedding(c, 64))
    return tidy(A.assemble(checkpointed(stored_chunks(messages(s, d), cfg)), cfg, encoder=wide).select(*_CTX_COLS))


@reg("assemble_adaptive", f"WITH {ENC}, {assemble_sql(budget=None, m=1000, stale=20, dup=0.92, drift=0.6)} SELECT {_CTX} FROM ctx", d="top_raw")
def _assemble_adaptive(s, d):
    """All parameters at their defaults."""
    enc, cfg = _enc(s, d, max_chunks=1000, stale_threshold=20, dedup_threshold=0.92, drift_threshold=0.6)
    return tidy(A.assemble(enc, cfg, encoded=True).select(*_CTX_COLS))


@reg("budget_select", f"""{_SCAND}, i AS (SELECT conv_id, q_seq, list({{'s': seq::BIGINT, 't': tokens::BIGINT}} ORDER BY base DESC, seq) AS xs FROM cand GROUP BY ALL),
f AS (SELECT conv_id, q_seq, list_reduce(xs, lambda a, x: CASE WHEN a.u + x.t <= {BUDGET} THEN {{'u': a.u + x.t, 'k': list_append(a.k, x.s)}} ELSE a END, {{'u': 0::BIGINT, 'k': []::BIGINT[]}}) AS r FROM i)
SELECT conv_id, q_seq, {BUDGET}::BIGINT AS budget, r.u AS used_tokens, len(r.k) AS chunks_used, array_to_string(r.k, ',') AS selected FROM f""")
def _budget_select(s, d):
    enc, cfg = _enc(s, d)
    return tidy(S.budget_select(C.candidates(enc, cfg).withColumn("score", F.col("base")), ["conv_id", "q_seq"], F.lit(BUDGET)))


@reg("format_context", f"""WITH {ENC}, {assemble_sql()}, p AS (SELECT conv_id, q_seq, unnest(selected) AS seq, generate_subscripts(selected, 1) AS pos FROM ctx),
t AS (SELECT p.conv_id, p.q_seq, string_agg(e.content, chr(10) || chr(10) ORDER BY p.pos) AS content, sum(e.tokens) AS n FROM p JOIN enc e USING (conv_id, seq) GROUP BY ALL)
SELECT c.conv_id, c.q_seq, md5(coalesce(t.content, '')) AS content_md5, c.used_tokens FROM ctx c LEFT JOIN t USING (conv_id, q_seq)""")
def _format_context(s, d):
    enc, cfg = _enc(s, d, fixed_budget=BUDGET)
    x = A.with_content(A.assemble(enc, cfg, encoded=True), enc)
    return tidy(x.select("conv_id", "q_seq", F.md5("content").alias("content_md5"), "used_tokens"))


_SERIES = f"""{ENC}, {assemble_sql()},
se AS (SELECT conv_id, turn, user_turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM msgs
  WHERE user_turn >= 1 AND role IN ('user', 'assistant') AND (role = 'user' OR text <> '')),
sraw AS (SELECT conv_id, pos, user_turn, role, greatest(1, (sum(length(text)) OVER w + (count(*) OVER w - 1) * 2) // 4) AS raw FROM se WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
sh AS (SELECT x.conv_id, x.pos, list({{'t': m.pos::BIGINT, 'c': ({s_tokens('m.text')})::BIGINT, 'n': length(m.text)::BIGINT}} ORDER BY m.pos DESC) AS items FROM se x JOIN se m ON m.conv_id = x.conv_id AND m.pos <= x.pos WHERE x.role = 'user' GROUP BY ALL),
sf AS (SELECT conv_id, pos, list_reduce(items, lambda a, x: CASE WHEN a.k = 0 OR a.u + x.c <= {WINDOW} THEN {{'u': a.u + x.c, 'k': a.k + 1, 'n': a.n + x.n}} ELSE a END, {{'u': 0::BIGINT, 'k': 0::BIGINT, 'n': 0::BIGINT}}) AS r FROM sh),
series AS (SELECT w.conv_id, w.user_turn AS turn, coalesce(c.used_tokens, 0)::BIGINT AS curated, greatest(1, (sf.r.n + (sf.r.k - 1) * 2) // 4)::BIGINT AS fifo, w.raw::BIGINT AS raw
  FROM sraw w JOIN sf USING (conv_id, pos) LEFT JOIN ctx c ON c.conv_id = w.conv_id AND c.q_turn = w.user_turn WHERE w.role = 'user')"""


def _series(s, d):
    """Tokens per turn of the assembled context, the FIFO window and the whole history."""
    enc, cfg = _enc(s, d, fixed_budget=BUDGET)
    ctx = A.assemble(enc, cfg, encoded=True).select("conv_id", F.col("q_turn").alias("user_turn"), "used_tokens")
    return E.context_series(messages(s, d), ctx, WINDOW, cfg)


@reg("context_series", f"WITH {_SERIES} SELECT * FROM series")
def _context_series(s, d):
    return tidy(_series(s, d))


@reg("token_growth", f"""WITH {_SERIES} SELECT CASE WHEN turn <= 1 THEN '1' WHEN turn <= 5 THEN '2-5' WHEN turn <= 10 THEN '6-10' WHEN turn <= 20 THEN '11-20' WHEN turn <= 40 THEN '21-40' ELSE '41+' END AS turns, count(*) AS n, round(median(curated), 1) AS curated_median, round(median(fifo), 1) AS fifo_median,
round(median(raw), 1) AS raw_median FROM series GROUP BY 1""")
def _token_growth(s, d):
    return tidy(E.token_growth(checkpointed(_series(s, d))))


_H = [p.replace("'", "''") for p in V.JUDGE_PROMPT.split("%s")]
_PROMPT = f"'{_H[0]}' || coalesce(t.content, '') || '{_H[1]}' || ex.query || '{_H[2]}' || ex.reply || '{_H[3]}'"


@reg("judge_prompts", f"""WITH {_BOTH}, {assemble_sql()}, p AS (SELECT conv_id, q_turn, unnest(selected) AS seq, generate_subscripts(selected, 1) AS pos FROM ctx),
t AS (SELECT p.conv_id, p.q_turn, string_agg(e.content, chr(10) || chr(10) ORDER BY p.pos) AS content FROM p JOIN enc e USING (conv_id, seq) GROUP BY ALL)
SELECT ex.conv_id, ex.turn, md5({_PROMPT}) AS prompt_md5, length({_PROMPT}) AS n_chars FROM ex LEFT JOIN t ON t.conv_id = ex.conv_id AND t.q_turn = ex.user_turn WHERE reply IS NOT NULL""")
def _judge_prompts(s, d):
    """The judge sees the context that the turn's assembly handed out."""
    enc, cfg = _enc(s, d, fixed_budget=BUDGET)
    m = messages(s, d)
    x = A.with_content(A.assemble(enc, cfg, encoded=True), enc).select("conv_id", F.col("q_turn").alias("user_turn"), F.col("content").alias("context"))
    at = U.with_user_turn(m.select("conv_id", "turn", "role"), cfg).select("conv_id", "turn", "user_turn")
    ex = U.exchanges(m, cfg).where(F.col("reply").isNotNull()).join(at, ["conv_id", "turn"]).join(x, ["conv_id", "user_turn"], "left")
    p = L.judge_prompts(ex.withColumn("context", F.coalesce("context", F.lit(""))))
    return tidy(p.select("conv_id", "turn", F.md5("prompt").alias("prompt_md5"), F.length("prompt").alias("n_chars")))


@reg("inspect_turn", f"""WITH {ENC}, {assemble_sql()}, cr AS (SELECT c.conv_id, c.q_turn, w.seq, w.raw, list_contains(c.selected, w.seq) AS is_selected FROM ctx c JOIN raws w USING (conv_id, q_seq)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, q_turn, is_selected ORDER BY raw DESC, seq) AS position FROM cr)
SELECT n.conv_id, n.q_turn, e.chunk_id, round(n.raw, 3) AS raw_score, n.is_selected, n.position,
CASE WHEN length(e.content) > 200 THEN substr(e.content, 1, 200) || '…' ELSE e.content END AS preview FROM n JOIN enc e USING (conv_id, seq) WHERE is_selected OR position <= 20""")
def _inspect_turn(s, d):
    enc, cfg = _enc(s, d, fixed_budget=BUDGET)
    return tidy(A.inspect_turn(checkpointed(A.assemble(enc, cfg, encoded=True)), enc))


_HIST = f"""WITH {ENC}, {assemble_sql()}, se AS (SELECT conv_id, q_seq, q_turn, unnest(selected) AS seq FROM ctx),
hist AS (SELECT s.conv_id, s.seq, count(*) AS n, array_to_string(list(s.q_turn || ':' || round(r.raw, 3) ORDER BY s.q_turn), ',') AS history FROM se s JOIN raws r USING (conv_id, q_seq, seq) GROUP BY ALL)"""


@reg("relevance_history", f"{_HIST} SELECT conv_id, seq, n FROM hist")
def _relevance_history(s, d):
    enc, cfg = _enc(s, d, fixed_budget=BUDGET)
    h = A.relevance_history(A.assemble(enc, cfg, encoded=True))
    return tidy(h.select("conv_id", "seq", F.size("history").alias("n")))


def _state(s, d):
    """Chunk state at the last turn of each conversation."""
    enc, cfg = _enc(s, d, fixed_budget=BUDGET)
    a = checkpointed(A.assemble(enc, cfg, encoded=True))
    last = a.groupBy("conv_id").agg(F.max_by(F.struct("q_turn", "selected", F.map_from_entries("raw_scores").alias("raws")), "q_turn").alias("l"))
    h = A.relevance_history(a).select("conv_id", "seq", F.size("history").alias("history_size"))
    j = enc.select("conv_id", "seq", "last_ref", "chunk_id", "content").join(last, "conv_id").join(h, ["conv_id", "seq"], "left")
    return j.select(
        "conv_id", "seq", "chunk_id", "content", F.col("l.q_turn").alias("current_turn"), "last_ref", F.array_contains("l.selected", F.col("seq")).alias("selected"),
        F.try_element_at("l.raws", F.col("seq")).alias("raw"), F.coalesce("history_size", F.lit(0)).alias("history_size"), F.lit(1.0).alias("multiplier"),
    )


_STATE = f"""{_HIST}, la AS (SELECT conv_id, max(q_turn) AS current_turn FROM ctx GROUP BY 1),
lc AS (SELECT ctx.* FROM ctx JOIN la ON la.conv_id = ctx.conv_id AND la.current_turn = ctx.q_turn),
st AS (SELECT e.conv_id, e.seq, e.chunk_id, lc.q_turn AS current_turn, e.last_ref, list_contains(lc.selected, e.seq) AS selected, r.raw, coalesce(h.n, 0) AS history_size
FROM enc e JOIN lc USING (conv_id) LEFT JOIN raws r ON r.conv_id = e.conv_id AND r.q_seq = lc.q_seq AND r.seq = e.seq LEFT JOIN hist h ON h.conv_id = e.conv_id AND h.seq = e.seq)"""


@reg("is_stale", f"{_STATE} SELECT conv_id, seq, current_turn - last_ref > {STALE} AS stale FROM st")
def _is_stale(s, d):
    return tidy(_state(s, d).select("conv_id", "seq", A.is_stale(F.col("current_turn"), F.col("last_ref"), STALE).alias("stale")))


@reg("once_curated", f"{_STATE} SELECT conv_id, seq, history_size > 0 AS curated FROM st")
def _once_curated(s, d):
    return tidy(_state(s, d).select("conv_id", "seq", A.once_curated(F.col("history_size"), F.col("multiplier")).alias("curated")))


_EVICT = f"{_STATE} SELECT conv_id, seq, chunk_id FROM st WHERE current_turn - last_ref > {STALE} AND (NOT selected OR coalesce(raw, 1.0) < 0.85) AND history_size > 0"


@reg("evict_candidates", _EVICT)
def _evict_candidates(s, d):
    return tidy(A.evict_candidates(_state(s, d), STALE, 0.85).select("conv_id", "seq", "chunk_id"))


@reg("evict_to_archive", f"{_STATE} SELECT conv_id, count(*) FILTER (NOT m) AS live, count(*) FILTER (m) AS archived FROM (SELECT conv_id, current_turn - last_ref > {STALE} AND (NOT selected OR coalesce(raw, 1.0) < 0.85) AND history_size > 0 AS m FROM st) GROUP BY 1")
def _evict_to_archive(s, d):
    st = checkpointed(_state(s, d))
    out = A.evict_candidates(st, STALE, 0.85).select("conv_id", "seq")
    live = st.join(out, ["conv_id", "seq"], "left_anti").groupBy("conv_id").agg(F.count("*").alias("live"))
    gone = out.groupBy("conv_id").agg(F.count("*").alias("archived"))
    return tidy(live.join(gone, "conv_id", "full").select("conv_id", F.coalesce("live", F.lit(0)).alias("live"), F.coalesce("archived", F.lit(0)).alias("archived")))


@reg("remembrance", f"""WITH {ENC}, {cand_sql()}, b AS (SELECT conv_id, q_seq, seq, base, seq % 3 AS saved0 FROM cand)
SELECT conv_id, q_seq, seq, base >= 0.65 AS saved, CASE WHEN base >= 0.65 THEN 1.2::DOUBLE * (1.8::DOUBLE + saved0 * 0.3::DOUBLE) ELSE 1.2::DOUBLE END AS decay_multiplier,
CASE WHEN base >= 0.65 THEN saved0 + 1 ELSE saved0 END AS times_saved FROM b""", d="decay_multiplier", i="times_saved")
def _remembrance(s, d):
    enc, cfg = _enc(s, d)
    b = C.candidates(enc, cfg).select("conv_id", "q_seq", "seq", F.col("base").alias("relevance"), F.lit(1.2).alias("decay_multiplier"), (F.col("seq") % 3).alias("times_saved"))
    b = b.join(enc.select("conv_id", "seq", "content"), ["conv_id", "seq"])
    return tidy(A.remembrance(b).select("conv_id", "q_seq", "seq", "saved", "decay_multiplier", "times_saved"))


# ------------------------------------------------------------------ archive
_GATE = f"""WITH {ENC}, {assemble_sql()},
g0 AS (SELECT c.conv_id, c.q_seq, c.q_turn, c.top_raw, c.query, e.content AS tt, {s_words4('e.content')} AS cw, {s_words4('c.query')} AS qw FROM ctx c LEFT JOIN enc e ON e.conv_id = c.conv_id AND e.seq = c.top_seq),
gate AS (SELECT *, coalesce(tt <> query AND len(cw) > 0 AND len(list_intersect(cw, qw))::DOUBLE / len(cw) >= 0.8, false) AS echo FROM g0)"""


@reg("archive_gate", f"{_GATE} SELECT conv_id, q_seq, q_turn, top_raw, echo, (top_raw < 0.85 OR echo) AS gate_fires FROM gate", d="top_raw")
def _archive_gate(s, d):
    enc, cfg = _enc(s, d, fixed_budget=BUDGET)
    return tidy(A.gate_turns(A.assemble(enc, cfg, encoded=True), enc, cfg))


_ECHO_SQL = f"""WITH {ENC} SELECT a.conv_id, a.seq, coalesce(a.content <> b.content AND len({s_words4('b.content')}) > 0 AND len(list_intersect({s_words4('b.content')}, {s_words4('substr(b.content, 1, 120) || a.content')}))::DOUBLE / len({s_words4('b.content')}) >= 0.8, false) AS echo
FROM enc a JOIN enc b ON b.conv_id = a.conv_id AND b.seq = a.seq + 1"""


@reg("is_query_echo", _ECHO_SQL)
def _is_query_echo(s, d):
    enc, _ = _enc(s, d)
    b = enc.select("conv_id", (F.col("seq") - 1).alias("seq"), F.col("content").alias("top"))
    j = enc.select("conv_id", "seq", "content").join(b, ["conv_id", "seq"])
    return tidy(j.select("conv_id", "seq", (T.is_query_echo(F.concat(F.substring("top", 1, 120), F.col("content")), F.col("top")) & (F.col("content") != F.col("top"))).alias("echo")))


_RETR = f"""ret0 AS (SELECT q.conv_id, q.seq AS q_seq, q.user_turn AS q_turn, c.seq, c.chunk_id, c.user_turn, c.tokens, c.last_ref,
  len(list_intersect(CASE WHEN len({s_words4('q.content')}) > 0 THEN {s_words4('q.content')} ELSE [lower(q.content)] END, {s_words4('c.content')})) AS overlap
  FROM enc q JOIN enc c ON c.conv_id = q.conv_id AND q.user_turn - c.user_turn > {STALE} AND q.user_turn - c.user_turn <= 1000 WHERE q.role = 'user'),
retr AS (SELECT *, row_number() OVER (PARTITION BY conv_id, q_seq ORDER BY overlap DESC, last_ref DESC, seq) AS rank FROM ret0 WHERE overlap > 0 QUALIFY rank <= 2)"""


@reg("archive_retrieve", f"WITH {ENC}, {_RETR} SELECT conv_id, q_seq, seq, overlap, rank FROM retr")
def _archive_retrieve(s, d):
    enc, cfg = _enc(s, d, archive_top_k=2)
    q = enc.where(F.col("role") == "user").select("conv_id", F.col("seq").alias("q_seq"), F.col("user_turn").alias("q_turn"), F.col("content").alias("query"))
    return tidy(A.archive_retrieve(q, enc, cfg, older_than=STALE).select("conv_id", "q_seq", "seq", "overlap", "rank"))


QUERIES["archive_topk"], ORACLES["archive_topk"] = QUERIES["archive_retrieve"], ORACLES["archive_retrieve"]


@reg("touch", f"WITH {ENC}, {_RETR} SELECT e.conv_id, e.seq, e.chunk_id, greatest(e.last_ref, coalesce(max(r.q_turn), 0)) AS last_ref FROM enc e LEFT JOIN retr r ON r.conv_id = e.conv_id AND r.seq = e.seq GROUP BY e.conv_id, e.seq, e.chunk_id, e.last_ref")
def _touch(s, d):
    enc, cfg = _enc(s, d, archive_top_k=2)
    q = enc.where(F.col("role") == "user").select("conv_id", F.col("seq").alias("q_seq"), F.col("user_turn").alias("q_turn"), F.col("content").alias("query"))
    used = A.archive_retrieve(q, enc, cfg, older_than=STALE).select("conv_id", "chunk_id", F.col("q_turn").alias("used_turn"))
    return tidy(A.touch(enc.select("conv_id", "seq", "chunk_id", "last_ref"), used))


@reg("candidate_union", f"WITH {ENC}, {cand_sql()}, {_RETR} SELECT conv_id, q_seq, seq, false AS from_archive FROM cand UNION ALL SELECT conv_id, q_seq, seq, true FROM retr")
def _candidate_union(s, d):
    enc, cfg = _enc(s, d, archive_top_k=2)
    q = enc.where(F.col("role") == "user").select("conv_id", F.col("seq").alias("q_seq"), F.col("user_turn").alias("q_turn"), F.col("content").alias("query"))
    a = A.archive_retrieve(q, enc, cfg, older_than=STALE).select("conv_id", "q_seq", "seq", F.lit(True).alias("from_archive"))
    return tidy(C.candidates(enc, cfg).select("conv_id", "q_seq", "seq", F.lit(False).alias("from_archive")).unionByName(a))


@reg("assemble_with_archive")
def _assemble_with_archive(s, d):
    enc, cfg = _enc(s, d, fixed_budget=BUDGET, max_chunks=1000)
    a = A.assemble_with_archive(enc, cfg, encoded=True)
    return tidy(a.select("conv_id", "q_seq", "q_turn", "route", "used_tokens", "chunks_used", "selected_ids", "gate_fires", "archive_hits", "resurrected"))


# ------------------------------------------------------------------ replay
def _replayed(s, d, **kw):
    cfg = settings(s, d, fixed_budget=BUDGET, **kw)
    return replay_turns(prepare_replay(messages(s, d), cfg), cfg)


@reg("replay_turns")
def _replay_turns(s, d):
    return tidy(_replayed(s, d))


@reg("replay_turns_default")
def _replay_turns_default(s, d):
    cfg = settings(s, d, max_chunks=1000, stale_threshold=20, dedup_threshold=0.92, drift_threshold=0.6)
    return tidy(replay_turns(prepare_replay(messages(s, d), cfg), cfg, use_archive=False))


# without archive and with room for everything the walk and the one-pass assembly agree, so SQL can check it
ORACLES["replay_turns_default"] = O(
    f"WITH {ENC}, {assemble_sql(budget=None, m=1000, stale=20, dup=0.92, drift=0.6)} SELECT conv_id, q_turn AS turn, route, budget, used_tokens, chunks_used, array_to_string(selected_ids, ',') AS selected_ids, top_raw, drift_detected, "
    "false AS gate_fired, 0::BIGINT AS archive_hits, 0::BIGINT AS resurrected, 0::BIGINT AS archived, n_candidates + (SELECT count(*) FROM enc e WHERE e.conv_id = ctx.conv_id AND e.user_turn = ctx.q_turn) AS store_chunks, 0::BIGINT AS archive_chunks FROM ctx", d="top_raw")


@reg("archive_totals")
def _archive_totals(s, d):
    return tidy(E.archive_totals(_replayed(s, d)))


# ------------------------------------------------------------------ pairs and retrieval metrics
def _pairs_ctes():
    return f"""{_BOTH}, {cand_sql()},
pairs AS (SELECT c.conv_id, c.q_seq, c.q_turn, c.seq, c.base AS score, c.cosine, len(list_intersect(f.facts, {s_terms('e.content')})) > 0 AS relevant
  FROM cand c JOIN facts0 f ON f.conv_id = c.conv_id AND f.user_turn = c.q_turn AND len(f.facts) > 0 JOIN enc e ON e.conv_id = c.conv_id AND e.seq = c.seq WHERE c.role = 'assistant')"""


_PAIRS = _pairs_ctes()


def _pairs(s, d):
    enc, cfg = _enc(s, d)
    return L.causal_pairs(messages(s, d), enc, cfg)


@reg("causal_pairs", f"WITH {_PAIRS} SELECT conv_id, q_seq, seq, score, relevant FROM pairs", d="score")
def _causal_pairs(s, d):
    return tidy(_pairs(s, d).select("conv_id", "q_seq", "seq", "score", "relevant"))


_PAIR_TEXTS = f"""{_PAIRS}, ptext AS (SELECT p.conv_id, p.q_seq, p.seq, q.content AS query, c.content AS chunk, p.relevant
  FROM pairs p JOIN enc q ON q.conv_id = p.conv_id AND q.seq = p.q_seq JOIN enc c ON c.conv_id = p.conv_id AND c.seq = p.seq)"""


def _pair_texts(s, d):
    """Labelled pairs with both texts; the texts come in after the pairs are known."""
    enc, cfg = _enc(s, d)
    t = enc.select("conv_id", "seq", "content")
    p = L.causal_pairs(messages(s, d), enc, cfg).select("conv_id", "q_seq", "seq", "relevant")
    p = p.join(t.withColumnRenamed("content", "chunk"), ["conv_id", "seq"])
    return p.join(t.select("conv_id", F.col("seq").alias("q_seq"), F.col("content").alias("query")), ["conv_id", "q_seq"])


@reg("read_pairs", f"WITH {_PAIR_TEXTS} SELECT md5(query) AS query_md5, md5(chunk) AS chunk_md5, relevant FROM ptext")
def _read_pairs(s, d):
    """Pair files written from the conversations, read back whole."""
    path = scratch(s)
    sinks.write_json_arrays(_pair_texts(s, d).select("conv_id", "q_seq", "query", "chunk", "relevant"), path, ["conv_id"], "q_seq", 512)
    return tidy(readers.read_pairs(s, path).select(F.md5("query").alias("query_md5"), F.md5("chunk").alias("chunk_md5"), "relevant"))


@reg("training_positives", f"WITH {_PAIRS} SELECT conv_id, q_seq, seq FROM pairs WHERE relevant")
def _training_positives(s, d):
    return tidy(L.training_positives(_pairs(s, d)).select("conv_id", "q_seq", "seq"))


@reg("confusion", f"""WITH {_PAIRS}, c AS (SELECT count(*) FILTER (score > 0.5 AND relevant) AS tp, count(*) FILTER (score > 0.5 AND NOT relevant) AS fp, count(*) FILTER (NOT score > 0.5 AND relevant) AS fn, count(*) AS pairs FROM pairs)
SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END AS recall FROM c""", d="precision recall")
def _confusion(s, d):
    return tidy(M.confusion(_pairs(s, d)))


@reg("p2_pairs", f"""WITH {_PAIRS}, c AS (SELECT count(*) FILTER (score > 0.5 AND relevant) AS tp, count(*) FILTER (score > 0.5 AND NOT relevant) AS fp, count(*) FILTER (NOT score > 0.5 AND relevant) AS fn, count(*) AS pairs FROM pairs),
e AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END AS recall FROM c)
SELECT *, CASE WHEN precision >= 0.85 AND recall >= 0.9 THEN 'PASS' ELSE 'FAIL' END AS status FROM e""", d="precision recall")
def _p2_pairs(s, d):
    return tidy(E.p2_pairs(_pairs(s, d)))


@reg("topk_metrics", f"""WITH {_PAIRS}, g AS (SELECT conv_id, q_seq, count(*) AS n, count(*) FILTER (relevant) AS n_rel FROM pairs GROUP BY ALL HAVING n >= 2 AND n_rel > 0),
r AS (SELECT p.*, row_number() OVER (PARTITION BY p.conv_id, p.q_seq ORDER BY score DESC, seq) AS rn FROM pairs p),
k AS (SELECT unnest([1, 3, 5, 8, 10]) AS k), x AS (SELECT g.*, k.k, count(*) FILTER (r.relevant AND r.rn <= k.k) AS hit FROM g JOIN k ON g.n >= k.k JOIN r USING (conv_id, q_seq) GROUP BY ALL)
SELECT k::BIGINT AS k, round(avg(hit / k), 4) AS precision, round(avg(hit / n_rel), 4) AS recall, count(*) AS queries FROM x GROUP BY k""")
def _topk_metrics(s, d):
    return tidy(M.topk_metrics(_pairs(s, d), ["conv_id", "q_seq"], ["seq"]))


@reg("threshold_curve", f"""WITH {_PAIRS}, o AS (SELECT *, row_number() OVER (ORDER BY score, conv_id, q_seq, seq) AS i, count(*) OVER () AS n, count(*) FILTER (relevant) OVER () AS n_rel FROM pairs),
c AS (SELECT *, count(*) FILTER (relevant) OVER (ORDER BY i DESC) AS tp, count(*) OVER (ORDER BY i DESC) AS above FROM o),
e AS (SELECT *, tp::DOUBLE / above AS precision, tp::DOUBLE / n_rel AS recall FROM c)
SELECT n AS n_pairs, n_rel AS n_relevant, n - n_rel AS n_irrelevant, round(precision, 4) AS best_precision, round(score, 4) AS best_threshold, round(recall, 4) AS best_recall
FROM e WHERE recall >= 0.9 ORDER BY e.precision DESC, i LIMIT 1""")
def _threshold_curve(s, d):
    return tidy(M.threshold_curve(_pairs(s, d), ["conv_id", "q_seq", "seq"]))


@reg("score_distribution", f"WITH {_PAIRS} SELECT relevant, round(avg(score), 4) AS mean, round(median(score), 4) AS p50, count(*) AS n FROM pairs GROUP BY 1")
def _score_distribution(s, d):
    return tidy(M.score_distribution(checkpointed(_pairs(s, d))))


@reg("p6_escalation", f"""WITH {_PAIRS}, e AS (SELECT *, score > 0.3 AND 1.0 - least(abs(score - 0.5) / 0.2, 1.0) < 0.6 AS unsure FROM pairs),
s AS (SELECT count(*) FILTER (relevant) AS nr, count(*) FILTER (relevant AND score > 0.5) AS t1, count(*) FILTER (relevant AND (CASE WHEN unsure THEN 0.5 ELSE score END) > 0.5) AS t2, count(*) FILTER (unsure) AS nu, count(*) AS n FROM e),
r AS (SELECT t1::DOUBLE / nr AS small_recall, t2::DOUBLE / nr AS escalated_recall, nu::DOUBLE / n AS escalation_rate FROM s)
SELECT *, escalated_recall - small_recall AS improvement, CASE WHEN escalated_recall - small_recall >= 0.05 AND escalation_rate < 0.15 THEN 'PASS' ELSE 'FAIL' END AS status FROM r""", d="small_recall escalated_recall escalation_rate improvement")
def _p6(s, d):
    return tidy(E.p6_escalation(_pairs(s, d)))


@reg("confidence_margin", f"WITH {_PAIRS} SELECT conv_id, q_seq, seq, 1.0 - least(abs(score - 0.5) / 0.2, 1.0) AS margin FROM pairs", d="margin")
def _confidence_margin(s, d):
    from turnloom.functions import vectors as X

    return tidy(_pairs(s, d).select("conv_id", "q_seq", "seq", X.confidence_margin(F.col("score")).alias("margin")))


@reg("is_lexically_retrievable", f"""WITH {_PAIRS} SELECT p.conv_id, p.q_seq, bool_or(p.relevant AND len(list_intersect({s_terms('q.content')}, {s_terms('c.content')})) > 0) AS retrievable
FROM pairs p JOIN enc q ON q.conv_id = p.conv_id AND q.seq = p.q_seq JOIN enc c ON c.conv_id = p.conv_id AND c.seq = p.seq GROUP BY ALL""")
def _is_lex(s, d):
    enc, cfg = _enc(s, d)
    p = L.causal_pairs(messages(s, d), enc, cfg)
    t = enc.select("conv_id", "seq", T.diagnostic_terms(F.col("content")).alias("terms"))
    j = p.join(t, ["conv_id", "seq"]).join(t.select("conv_id", F.col("seq").alias("q_seq"), F.col("terms").alias("q_terms")), ["conv_id", "q_seq"])
    hit = F.col("relevant") & F.arrays_overlap("terms", "q_terms")
    return tidy(j.groupBy("conv_id", "q_seq").agg(F.max(hit).alias("retrievable")))


@reg("subchunk_pairs")
def _subchunk_pairs(s, d):
    enc, cfg = _enc(s, d)
    p = L.causal_pairs(messages(s, d), enc, cfg).select("conv_id", "q_seq", "seq")
    t = enc.select("conv_id", "seq", F.col("content").alias("chunk"))
    q = enc.select("conv_id", F.col("seq").alias("q_seq"), F.col("content").alias("query"))
    p = p.join(t, ["conv_id", "seq"]).join(q, ["conv_id", "q_seq"])
    u = L.subchunk_pairs(p, L.global_answer_facts(messages(s, d), cfg), ["conv_id", "q_seq", "seq"], 200)
    return tidy(u.select("conv_id", "q_seq", "seq", "unit_no", F.md5("unit").alias("unit_md5"), "relevant"))


_UNITS = "list_reduce(parts, lambda a, x: CASE WHEN a.buf <> '' AND length(a.buf) + length(x) > 200 THEN {'units': list_append(a.units, a.buf), 'buf': x} ELSE {'units': a.units, 'buf': CASE WHEN a.buf = '' THEN x ELSE a.buf || ' ' || x END} END, {'units': []::VARCHAR[], 'buf': ''})"
_PARTS = "list_filter(list_transform(string_split_regex(regexp_replace(c.content, '([.!?])\\s+', '\\1' || chr(1), 'g'), '[' || chr(1) || chr(10) || ']+'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"
ORACLES["subchunk_pairs"] = f"""WITH {_PAIRS}, gf AS (SELECT md5(query) AS k, list_distinct(flatten(list(facts))) AS facts FROM facts0 WHERE len(facts) > 0 GROUP BY 1),
up AS (SELECT p.conv_id, p.q_seq, p.seq, md5(q.content) AS k, {_PARTS} AS parts FROM pairs p JOIN enc q ON q.conv_id = p.conv_id AND q.seq = p.q_seq JOIN enc c ON c.conv_id = p.conv_id AND c.seq = p.seq),
uf AS (SELECT conv_id, q_seq, seq, k, {_UNITS} AS st FROM up), ul AS (SELECT conv_id, q_seq, seq, k, CASE WHEN st.buf <> '' THEN list_append(st.units, st.buf) ELSE st.units END AS us FROM uf),
uu AS (SELECT conv_id, q_seq, seq, k, generate_subscripts(us, 1) - 1 AS unit_no, unnest(us) AS unit FROM ul)
SELECT conv_id, q_seq, seq, unit_no, md5(unit) AS unit_md5, coalesce(len(list_intersect({s_terms('unit')}, gf.facts)) > 0, false) AS relevant FROM uu LEFT JOIN gf USING (k)"""


@reg("item_sample", f"""WITH {_PAIR_TEXTS}, l AS (SELECT *, 'live' AS source, 0 AS src FROM ptext WHERE relevant ORDER BY conv_id, q_seq, seq LIMIT 24),
fx AS (SELECT *, 'fixture' AS source, 1 AS src FROM ptext WHERE NOT relevant ORDER BY conv_id, q_seq, seq LIMIT 40),
i AS (SELECT * FROM (SELECT * FROM l UNION ALL SELECT * FROM fx) ORDER BY src, conv_id, q_seq, seq LIMIT 40)
SELECT conv_id, q_seq, seq, md5(query) AS query_md5, md5(chunk) AS chunk_md5, relevant, source,
printf('item_%04d', row_number() OVER (ORDER BY md5('3:' || source || ':' || conv_id || ':' || q_seq || ':' || seq)) - 1) AS item_id FROM i""")
def _item_sample(s, d):
    p = checkpointed(_pair_texts(s, d))
    x = L.item_sample(p.where("relevant"), p.where(~F.col("relevant")), 40, 3, ["conv_id", "q_seq", "seq"])
    return tidy(x.select("conv_id", "q_seq", "seq", F.md5("query").alias("query_md5"), F.md5("chunk").alias("chunk_md5"), "relevant", "source", "item_id"))


# ------------------------------------------------------------------ evaluation jobs
def _diag_ctes():
    return f"""{_BOTH}, {assemble_sql()},
rseen AS (SELECT conv_id, term, min(turn) AS first_turn FROM (SELECT conv_id, turn, unnest({s_terms('text')}) AS term FROM msgs WHERE role = 'assistant' AND NOT {s_hedge('text')}) GROUP BY ALL),
rst AS (SELECT f.conv_id, f.turn, list(f.term) AS st FROM (SELECT conv_id, turn, unnest(facts) AS term FROM facts0) f JOIN rseen s USING (conv_id, term) WHERE s.first_turn < f.turn GROUP BY ALL),
pos AS (SELECT conv_id, q_seq, q_turn, unnest(selected) AS seq, generate_subscripts(selected, 1) AS pos FROM ctx),
ct AS (SELECT p.conv_id, p.q_turn AS user_turn, string_agg(e.content, chr(10) || chr(10) ORDER BY p.pos) AS content FROM pos p JOIN enc e USING (conv_id, seq) GROUP BY ALL),
cx AS (SELECT ctx.conv_id, ctx.q_turn AS user_turn, coalesce(ct.content, '') AS content, {s_terms("coalesce(ct.content, '')")} AS ctx_terms FROM ctx LEFT JOIN ct ON ct.conv_id = ctx.conv_id AND ct.user_turn = ctx.q_turn)"""


_DIAG = "WITH " + _diag_ctes()
_SENTS = "list_filter(string_split_regex(regexp_replace(x.content, '([.!?])\\s+', '\\1' || chr(1), 'g'), '[' || chr(1) || chr(10) || ']+'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g') <> '')"
_DT = f"""{_DIAG}, dt AS (SELECT f.conv_id, f.turn, f.user_turn, len(f.facts) AS n_facts, coalesce(len(r.st), 0) AS n_stated, coalesce(len(list_intersect(r.st, x.ctx_terms)), 0) AS n_hits,
CASE WHEN len(r.st) > 0 THEN len(list_intersect(r.st, x.ctx_terms))::DOUBLE / len(r.st) END AS hit_ratio, CASE WHEN len(f.facts) > 0 THEN coalesce(len(r.st), 0)::DOUBLE / len(f.facts) END AS ingestion_ratio,
NOT ret.retrievable AS first_mention,
CASE WHEN len({s_terms('f.query')}) > 0 AND len({_SENTS}) > 0 THEN len(list_filter({_SENTS}, lambda s: len(list_intersect({s_terms('s')}, {s_terms('f.query')})) > 0))::DOUBLE / len({_SENTS}) END AS precision
FROM facts0 f LEFT JOIN rst r USING (conv_id, turn) LEFT JOIN cx x ON x.conv_id = f.conv_id AND x.user_turn = f.user_turn LEFT JOIN ret ON ret.conv_id = f.conv_id AND ret.turn = f.first_turn WHERE coalesce(f.answer, '') <> '')"""


@reg("diagnostic_turns", f"{_DT} SELECT * FROM dt", d="hit_ratio ingestion_ratio precision")
def _diagnostic_turns(s, d):
    enc, cfg = _enc(s, d, fixed_budget=BUDGET)
    return tidy(E.diagnostic_turns(messages(s, d), enc, cfg))


@reg("retrieval_diagnostic", f"""{_DT} SELECT count(*) AS sampled_turns, count(hit_ratio) AS measurable_turns, count(*) FILTER (n_stated > 0) AS retrievable_turns, count(*) - count(*) FILTER (n_stated > 0) AS first_mention_turns,
round(avg(CASE WHEN hit_ratio IS NOT NULL THEN (hit_ratio >= 0.5)::INT END) * 100, 1) AS retrieval_recall, round(avg(ingestion_ratio) * 100, 1) AS ingestion_rate,
round(count(*) FILTER (hit_ratio IS NOT NULL AND ingestion_ratio = 1.0)::DOUBLE / greatest(count(hit_ratio), 1) * 100, 1) AS ceiling, round(avg(precision) * 100, 1) AS retrieval_precision FROM dt""")
def _retrieval_diagnostic(s, d):
    enc, cfg = _enc(s, d, fixed_budget=BUDGET)
    return tidy(E.retrieval_diagnostic(E.diagnostic_turns(messages(s, d), enc, cfg)))


_PAIRED = f"""{_DIAG}, tok AS (SELECT conv_id, turn, role, text, greatest(1, length(text) // 4) AS tokens FROM conversations),
fh AS (SELECT q.conv_id, q.turn, list({{'t': m.turn, 'c': m.tokens, 'x': m.text}} ORDER BY m.turn DESC) AS items FROM tok q JOIN tok m ON m.conv_id = q.conv_id AND m.turn <= q.turn WHERE q.role = 'user' GROUP BY ALL),
ff AS (SELECT conv_id, turn, list_reduce(items, lambda a, x: CASE WHEN a.k = '' OR a.u + x.c <= {BUDGET} THEN {{'u': a.u + x.c, 'k': CASE WHEN a.k = '' THEN x.x ELSE x.x || chr(10) || chr(10) || a.k END}} ELSE a END, {{'u': 0::BIGINT, 'k': ''}}) AS r FROM fh),
pr AS (SELECT f.conv_id, f.turn, f.user_turn, f.facts, x.ctx_terms AS a, {s_terms('ff.r.k')} AS b, {s_terms('f.answer')} AS rt FROM facts0 f JOIN ret ON ret.conv_id = f.conv_id AND ret.turn = f.first_turn AND ret.retrievable
 LEFT JOIN cx x ON x.conv_id = f.conv_id AND x.user_turn = f.user_turn LEFT JOIN ff ON ff.conv_id = f.conv_id AND ff.turn = f.turn WHERE len(f.facts) > 0),
pw AS (SELECT conv_id, turn, user_turn, len(facts) AS n_facts, len(list_intersect(facts, a))::DOUBLE / len(facts) AS a_hit, len(list_intersect(facts, a)) = len(facts) AS a_full,
 len(list_intersect(facts, b))::DOUBLE / len(facts) AS b_hit, len(list_intersect(facts, b)) = len(facts) AS b_full,
 CASE WHEN len(rt) > 0 THEN len(list_intersect(rt, a))::DOUBLE / len(rt) ELSE 0.0 END AS a_fidelity, CASE WHEN len(rt) > 0 THEN len(list_intersect(rt, b))::DOUBLE / len(rt) ELSE 0.0 END AS b_fidelity FROM pr)"""


@reg("paired_arms", f"{_PAIRED} SELECT * FROM pw", d="a_hit b_hit a_fidelity b_fidelity")
def _paired_arms(s, d):
    enc, cfg = _enc(s, d, fixed_budget=BUDGET)
    return tidy(E.paired_rows(messages(s, d), enc, BUDGET, cfg))


def _half(s, d):
    """Arms judged at half presence, so that the buckets are not empty on invented text."""
    enc, cfg = _enc(s, d, fixed_budget=BUDGET)
    r = E.paired_rows(messages(s, d), enc, BUDGET, cfg)
    return r.withColumn("a_full", F.col("a_hit") >= 0.05).withColumn("b_full", F.col("b_hit") >= 0.05)


_WIN = """count(*) FILTER (a AND NOT b) AS curated_only, count(*) FILTER (NOT a AND b) AS fifo_only, count(*) FILTER (a AND b) AS both, count(*) FILTER (NOT a AND NOT b) AS neither, count(*) AS compared,
count(*) FILTER (a OR b) AS fact_retrievable, CASE WHEN count(*) FILTER (a OR b) > 0 THEN count(*) FILTER (a)::DOUBLE / count(*) FILTER (a OR b) ELSE 0.0 END AS curated_ge_fifo,
CASE WHEN count(*) FILTER (a OR b) > 0 THEN count(*) FILTER (a AND NOT b)::DOUBLE / count(*) FILTER (a OR b) ELSE 0.0 END AS strict_ratio"""


@reg("win_buckets", f"{_PAIRED} SELECT {_WIN} FROM (SELECT a_hit >= 0.05 AS a, b_hit >= 0.05 AS b FROM pw)", d="curated_ge_fifo strict_ratio")
def _win_buckets(s, d):
    return tidy(M.win_buckets(_half(s, d)))


@reg("p3_sufficiency", f"{_PAIRED}, w AS (SELECT {_WIN} FROM (SELECT a_hit >= 0.05 AS a, b_hit >= 0.05 AS b FROM pw)) SELECT *, CASE WHEN curated_ge_fifo >= 0.8 THEN 'PASS' ELSE 'FAIL' END AS status FROM w", d="curated_ge_fifo strict_ratio")
def _p3(s, d):
    return tidy(E.p3_sufficiency(_half(s, d)))


@reg("paired_ab", f"""{_PAIRED} SELECT {_WIN}, avg((a_hit >= 0.5)::INT) AS curated_recall, avg((b_hit >= 0.5)::INT) AS fifo_recall, avg(a_hit) AS curated_hit, avg(b_hit) AS fifo_hit, avg(a_fidelity) AS curated_fidelity, avg(b_fidelity) AS fifo_fidelity,
avg((a_fidelity >= b_fidelity)::INT) AS fidelity_ge FROM (SELECT *, a_hit >= 0.05 AS a, b_hit >= 0.05 AS b FROM pw)""", d="curated_ge_fifo strict_ratio curated_recall fifo_recall curated_hit fifo_hit curated_fidelity fifo_fidelity fidelity_ge")
def _paired_ab(s, d):
    return tidy(E.paired_ab(checkpointed(_half(s, d))))


_ARMS = [{"arm": name, **{k: False for k in off if k != "remembrance"}} for name, off in V.ABLATION_ARMS]
_ABL = f"WITH {ENC}, {arms_sql(_ARMS, budget=None)}"


@reg("ablation_rows", f"{_ABL} SELECT conv_id, q_turn, arm, used_tokens, budget FROM ctx")
def _ablation_rows(s, d):
    enc, cfg = _enc(s, d)
    return tidy(E.ablation_rows(enc, cfg).select("conv_id", "q_turn", "arm", "used_tokens", "budget"))


@reg("ablation_table", f"""{_ABL}, u AS (SELECT arm, used_tokens::DOUBLE / budget AS u FROM ctx),
m AS (SELECT arm, round(avg(CASE WHEN u < 0.6 THEN u * 100 WHEN u > 0.95 THEN 100 - (u - 0.95) * 1000 ELSE 100 END), 3) AS mean_metric FROM u GROUP BY 1)
SELECT arm, mean_metric, CASE WHEN arm <> 'full' THEN round((SELECT mean_metric FROM m WHERE arm = 'full') - mean_metric, 3) END AS contribution FROM m""")
def _ablation_table(s, d):
    enc, cfg = _enc(s, d)
    return tidy(M.ablation_table(E.ablation_rows(enc, cfg)))


QUERIES["arm_union"], ORACLES["arm_union"] = QUERIES["ablation_rows"], ORACLES["ablation_rows"]


def _p4_sql(mults):
    arms = [{"arm": str(m), "mult": m} for m in mults]
    return f"""WITH {_BOTH}, {arms_sql(arms, m=1000)},
fx AS (SELECT f.conv_id, f.user_turn, f.facts FROM facts0 f JOIN stated s USING (conv_id, turn) WHERE len(f.facts) > 0 AND len(s.stated) >= len(f.facts) * 0.05),
sw AS (SELECT a.arm::DOUBLE AS multiplier, sum(coalesce(len(list_intersect(f.facts, s.ctx_terms)), 0)) AS found, sum(len(f.facts)) AS expected
  FROM fx f CROSS JOIN arms a LEFT JOIN said s ON s.conv_id = f.conv_id AND s.user_turn = f.user_turn AND s.arm = a.arm GROUP BY 1)"""


@reg("p4_decay_sweep", f"{_p4_sql(V.DECAY_CANDIDATES)} SELECT 'all' AS domain, multiplier, found, expected, found::DOUBLE / expected AS recall FROM sw", d="recall", i="found expected")
def _p4(s, d):
    """Facts count from one in twenty said before on, because invented text repeats little."""
    enc, cfg = _enc(s, d, fixed_budget=BUDGET, max_chunks=1000)
    return tidy(E.p4_decay_sweep(messages(s, d), enc, cfg, V.DECAY_CANDIDATES, min_share=0.05))


@reg("p4_verdict", f"""{_p4_sql([1.2, 2.5])}, r AS (SELECT multiplier, found::DOUBLE / expected AS recall FROM sw)
SELECT 'all' AS domain, max(recall) AS best_recall, min(recall) AS worst_recall, max(multiplier) FILTER (recall >= 0.9 * (SELECT max(recall) FROM r)) AS m90, max(recall) - min(recall) < 0.01 AS flat FROM r""", d="best_recall worst_recall")
def _p4v(s, d):
    enc, cfg = _enc(s, d, fixed_budget=BUDGET, max_chunks=1000)
    return tidy(E.p4_verdict(checkpointed(E.p4_decay_sweep(messages(s, d), enc, cfg, [1.2, 2.5], min_share=0.05))))


_FC = f"""WITH {_BOTH}, {{asm}}, fx AS (SELECT f.conv_id, f.user_turn, f.facts FROM facts0 f JOIN stated s USING (conv_id, turn) WHERE len(f.facts) > 0 AND len(s.stated) >= len(f.facts) * 0.05),
se AS (SELECT c.conv_id, c.q_turn AS user_turn, e.tokens, {s_terms('e.content')} AS terms FROM (SELECT conv_id, q_turn, unnest(selected) AS seq FROM ctx) c JOIN enc e USING (conv_id, seq)),
pt AS (SELECT f.conv_id, f.user_turn, f.facts, s.tokens, coalesce(list_intersect(f.facts, s.terms), []) AS part FROM fx f LEFT JOIN se s USING (conv_id, user_turn)),
fc AS (SELECT conv_id, user_turn, bool_or(len(part) = len(facts)) AS any_cover, min(tokens) FILTER (len(part) = len(facts)) AS cover_cost, coalesce(sum(tokens) FILTER (len(part) > 0 AND len(part) < len(facts)), 0) AS part_cost,
 len(list_distinct(flatten(list(part)))) = max(len(facts)) AS uni FROM pt GROUP BY ALL),
res AS (SELECT f.conv_id, f.user_turn, any_cover OR uni AS hit, (CASE WHEN any_cover THEN cover_cost WHEN uni THEN part_cost ELSE 0 END)::BIGINT AS fact_tokens, c.n_candidates - c.n_survivors AS merges FROM fc f JOIN ctx c ON c.conv_id = f.conv_id AND c.q_turn = f.user_turn)"""


@reg("fact_cost", _FC.replace("{asm}", assemble_sql()) + " SELECT conv_id, user_turn, hit, fact_tokens, merges FROM res")
def _fact_cost(s, d):
    enc, cfg = _enc(s, d, fixed_budget=BUDGET)
    return tidy(E.policy_rows(messages(s, d), enc, "densest", cfg, 0.05).select("conv_id", "user_turn", "hit", "fact_tokens", "merges"))


@reg("per_1k", _FC.replace("{asm}", assemble_sql(rank="user_turn")) + " SELECT conv_id, user_turn, CASE WHEN hit AND fact_tokens > 0 THEN 1000.0 / fact_tokens ELSE 0.0 END AS per_1k, merges FROM res", d="per_1k")
def _per_1k(s, d):
    enc, cfg = _enc(s, d, fixed_budget=BUDGET)
    return tidy(E.policy_rows(messages(s, d), enc, "recency", cfg, 0.05).select("conv_id", "user_turn", "per_1k", "merges"))


def _fc_rows(**kw):
    return f"{_FC.replace('{asm}', assemble_sql(**kw))} SELECT conv_id, user_turn, hit, fact_tokens, merges, CASE WHEN hit AND fact_tokens > 0 THEN 1000.0 / fact_tokens ELSE 0.0 END AS per_1k FROM res"


@reg("p9_duplicates", f"""WITH d AS ({_fc_rows()}), r AS ({_fc_rows(rank='user_turn')}),
s AS (SELECT count(*) AS turns, count(*) FILTER (d.per_1k > r.per_1k) AS densest_wins, count(*) FILTER (r.per_1k > d.per_1k) AS recency_wins, count(*) FILTER (d.per_1k = r.per_1k) AS ties,
 coalesce(sum(d.merges + r.merges), 0) AS merges, count(*) FILTER (d.hit) AS dh, sum(d.fact_tokens) AS densest_fact_tokens, count(*) FILTER (r.hit) AS rh, sum(r.fact_tokens) AS recency_fact_tokens FROM d JOIN r USING (conv_id, user_turn))
SELECT turns, densest_wins, recency_wins, ties, merges, densest_fact_tokens, recency_fact_tokens, round(1000.0 * dh / nullif(densest_fact_tokens, 0), 1) AS densest_per_1k, round(1000.0 * rh / nullif(recency_fact_tokens, 0), 1) AS recency_per_1k,
CASE WHEN merges = 0 OR turns = 0 THEN 'SKIP' WHEN recency_wins / turns >= 0.55 THEN 'FAIL' WHEN abs(densest_wins / turns - recency_wins / turns) <= 0.05 THEN 'FAIL' ELSE 'PASS' END AS status FROM s""", i="merges densest_fact_tokens recency_fact_tokens")
def _p9(s, d):
    enc, cfg = _enc(s, d, fixed_budget=BUDGET)
    m = messages(s, d)
    return tidy(E.p9_duplicates(E.policy_rows(m, enc, "densest", cfg, 0.05), E.policy_rows(m, enc, "recency", cfg, 0.05)))


@reg("p10_drift", f"""WITH {_BOTH}, useen AS (SELECT conv_id, term, min(turn) AS first_turn FROM (SELECT conv_id, turn, unnest(terms) AS term FROM own) GROUP BY ALL),
kn AS (SELECT o.conv_id, o.turn, count(*) AS k FROM (SELECT conv_id, turn, unnest(terms) AS term FROM own) o JOIN useen s USING (conv_id, term) WHERE s.first_turn < o.turn GROUP BY ALL),
st0 AS (SELECT conv_id, min(turn) AS start_turn FROM own WHERE len(terms) > 0 GROUP BY 1),
sw AS (SELECT o.conv_id, o.turn, o.user_turn, coalesce(st0.start_turn < o.turn, false) AND kn.k IS NULL AS is_switch FROM own o LEFT JOIN kn USING (conv_id, turn) LEFT JOIN st0 USING (conv_id)),
tss AS (SELECT *, coalesce(user_turn - max(CASE WHEN is_switch THEN user_turn END) OVER (PARTITION BY conv_id ORDER BY user_turn), 99) AS since FROM sw),
{arms_sql([{"arm": "on", "thr": 0.1}, {"arm": "off", "thr": 0.99}], m=1000, recent=1)},
fx AS (SELECT f.conv_id, f.user_turn, f.facts FROM facts0 f JOIN tss t USING (conv_id, turn) WHERE len(f.facts) > 0 AND t.since <= 3),
v AS (SELECT a.arm, sum(coalesce(len(list_intersect(f.facts, s.ctx_terms)), 0)) AS found, sum(len(f.facts)) AS expected FROM fx f CROSS JOIN arms a LEFT JOIN said s ON s.conv_id = f.conv_id AND s.user_turn = f.user_turn AND s.arm = a.arm GROUP BY 1),
w AS (SELECT max(expected) AS expected, max(found) FILTER (arm = 'on')::DOUBLE / max(expected) AS reset_on_recall, max(found) FILTER (arm = 'off')::DOUBLE / max(expected) AS reset_off_recall FROM v)
SELECT *, reset_on_recall - reset_off_recall AS improvement, CASE WHEN reset_on_recall - reset_off_recall >= 0.05 THEN 'PASS' ELSE 'FAIL' END AS status FROM w""", d="reset_on_recall reset_off_recall improvement", i="expected")
def _p10(s, d):
    enc, cfg = _enc(s, d, fixed_budget=BUDGET, max_chunks=1000, drift_recent_turns=1)
    return tidy(E.p10_drift(messages(s, d), enc, cfg))


def _p11_rows(s, d):
    base = {"archive_top_k": 8}
    full = settings(s, d, max_chunks=1000, **base)
    press = settings(s, d, max_chunks=3, fixed_budget=BUDGET, **base)
    m = messages(s, d)
    prep = checkpointed(prepare_replay(m, full))
    enc = chunk_table(s, d, full)
    runs = {
        "full": replay_turns(prep, full, False), "full_archive": replay_turns(prep, full, True),
        "press": replay_turns(prep, press, False), "press_archive": replay_turns(prep, press, True),
    }
    ret = m.where(F.col("role") == "user").select("conv_id", (F.floor(F.col("turn") / 2) + 1).cast("int").alias("user_turn")).where(F.col("user_turn") >= 3)
    return E.p11_archive(m, runs, enc, ret, 3, full)


@reg("p11_archive")
def _p11(s, d):
    return tidy(_p11_rows(s, d))


@reg("archive_probe")
def _archive_probe(s, d):
    enc, cfg = _enc(s, d, max_chunks=1000)
    return tidy(E.archive_probe(E.archive_cases(messages(s, d), enc, cfg, 3, 2)))


_PROBE = _pairs_ctes().replace(cand_sql(), cand_sql(1000))
ORACLES["archive_probe"] = O(f"""WITH {_PROBE}, cs AS (SELECT p.conv_id, p.q_turn, p.seq, q.turn - c.turn > 3 AS ia, q.turn - c.turn <= 2 AS ist, p.relevant, len(list_intersect({s_words4('q.content')}, {s_words4('c.content')})) AS ov, p.cosine AS score
 FROM pairs p JOIN enc q ON q.conv_id = p.conv_id AND q.seq = p.q_seq JOIN enc c ON c.conv_id = p.conv_id AND c.seq = p.seq),
rk AS (SELECT *, row_number() OVER (PARTITION BY conv_id, q_turn ORDER BY (CASE WHEN ia THEN ov ELSE -1 END) DESC, seq) AS rn FROM cs),
qq AS (SELECT conv_id, q_turn, bool_or(ia AND relevant) AS ir, bool_or(ia AND relevant AND ov > 0) AS rt, {', '.join(f'bool_or(ia AND relevant AND ov > 0 AND rn <= {k}) AS h{k}' for k in (1, 3, 5, 8))},
 coalesce(max(score) FILTER (ist), 1.0) AS ts, max(score) FILTER (ia) AS ta, max(score) FILTER (ist AND relevant) AS br FROM rk GROUP BY ALL)
SELECT count(*) FILTER (ir) AS n_return, count(*) FILTER (ir AND rt) AS n_retrievable, {', '.join(f'avg((ts < {g})::INT) FILTER (ir) AS gate_{int(g * 10)}' for g in (0.4, 0.5, 0.6, 0.7))},
count(*) FILTER (NOT ir AND br IS NOT NULL) AS n_crowding, count(*) FILTER (NOT ir AND ta > br) AS n_crowded,
{', '.join(f'count(*) FILTER (ir AND rt AND h{k})::DOUBLE / nullif(count(*) FILTER (ir AND rt), 0) AS recall_at_{k}' for k in (1, 3, 5, 8))} FROM qq""", d="gate_4 gate_5 gate_6 gate_7 recall_at_1 recall_at_3 recall_at_5 recall_at_8")


# ------------------------------------------------------------------ end-to-end reports
@reg("e2e_report", f"""WITH {ENC}, {assemble_sql()}, e AS (SELECT conv_id, q_turn AS turn, route, used_tokens, budget, used_tokens::DOUBLE / budget AS u, drift_detected FROM ctx)
SELECT conv_id, turn, route, used_tokens, budget, round(u, 6) AS utilization, drift_detected, round(CASE WHEN u < 0.6 THEN u * 100 WHEN u > 0.95 THEN 100 - (u - 0.95) * 1000 ELSE 100 END, 6) AS pes FROM e""")
def _e2e_report(s, d):
    enc, cfg = _enc(s, d, fixed_budget=BUDGET)
    return tidy(E.e2e_turns(A.assemble(enc, cfg, encoded=True)))


@reg("e2e_aggregate", None)
def _e2e_aggregate(s, d):
    enc, cfg = _enc(s, d, fixed_budget=BUDGET)
    return tidy(E.e2e_aggregate(E.e2e_turns(A.assemble(enc, cfg, encoded=True))))


ORACLES["e2e_aggregate"] = f"""WITH {ENC}, {assemble_sql()}, e AS (SELECT conv_id, used_tokens::DOUBLE / budget AS u, drift_detected FROM ctx),
p AS (SELECT conv_id, u AS util, drift_detected, CASE WHEN u < 0.6 THEN u * 100 WHEN u > 0.95 THEN 100 - (u - 0.95) * 1000 ELSE 100 END AS pes FROM e)
SELECT conv_id, count(*) AS user_turns, round(avg(util), 6) AS avg_utilization, round(min(pes), 6) AS pes_min, round(avg(pes), 6) AS pes_mean, count(*) FILTER (drift_detected) AS drift_events FROM p GROUP BY 1"""


@reg("emit_turn_events", f"""WITH {ENC}, {assemble_sql()} SELECT conv_id, q_turn AS turn, 'router' AS component, 'task_classified' AS event_type, route AS detail FROM ctx
UNION ALL SELECT conv_id, q_turn, 'assembly', 'context_assembled', used_tokens::VARCHAR FROM ctx
UNION ALL SELECT conv_id, q_turn, 'congestion', 'congestion_detected', 'warning' FROM ctx WHERE used_tokens > 150""")
def _emit_turn_events(s, d):
    from turnloom.operators.events import emit_turn_events

    enc, cfg = _enc(s, d, fixed_budget=BUDGET)
    t = A.assemble(enc, cfg, encoded=True).select(
        "conv_id", F.col("q_turn").alias("turn"), F.lit(None).cast("timestamp").alias("ts"), "route", "used_tokens", "chunks_used", "budget", F.lit(0).alias("level"),
        F.lit(1.0).alias("total_ms"), F.when(F.col("used_tokens") > 150, "warning").otherwise("normal").alias("severity"),
    )
    e = emit_turn_events(t)
    detail = F.coalesce(F.try_element_at("payload", F.lit("routed_to")), F.try_element_at("payload", F.lit("total_tokens")), F.try_element_at("payload", F.lit("severity")))
    return tidy(e.select("conv_id", "turn", "component", "event_type", detail.alias("detail")))


# ------------------------------------------------------------------ cache
@reg("cache_lookup", f"""SELECT DISTINCT md5({s_sanitize('text')}) AS text_md5 FROM conversations WHERE turn >= 4 AND md5({s_sanitize('text')}) NOT IN (SELECT md5({s_sanitize('text')}) FROM conversations WHERE turn < 4)""")
def _cache_lookup(s, d):
    from turnloom.operators.sessions import cache_lookup

    m = messages(s, d).withColumn("text", T.sanitize_for_storage(F.col("text")))
    have = m.where(F.col("turn") < 4).select(T.content_key(F.col("text")).alias("text_md5"))
    return tidy(cache_lookup(m.where(F.col("turn") >= 4), have).select("text_md5"))


@reg("cache_stats", """WITH c AS (SELECT DISTINCT md5(text) AS k FROM conversations WHERE turn < 4), l AS (SELECT md5(text) AS k, md5(text) IN (SELECT k FROM c) AS hit FROM conversations)
SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, count(*) FILTER (hit)::DOUBLE / count(*) AS hit_rate, count(DISTINCT k) AS size FROM l""", d="hit_rate")
def _cache_stats(s, d):
    from turnloom.operators.sessions import cache_stats

    m = messages(s, d).select(F.md5("text").alias("text_md5"), "turn")
    have = m.where(F.col("turn") < 4).select("text_md5").distinct().withColumn("h", F.lit(True))
    return tidy(cache_stats(m.join(have, "text_md5", "left").select("text_md5", F.coalesce("h", F.lit(False)).alias("hit"))))


"""Messages, turns, exchanges, windows over conversations, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.functions import fixed as V
from turnloom.functions import text as T
from turnloom.operators import experiments as E
from turnloom.operators import gate as G
from turnloom.operators import labels as L
from turnloom.operators import metrics as M
from turnloom.operators import select as S
from turnloom.operators.fifo import fifo_window
from turnloom.operators import turns as U
from turnloom.plans.base import (
    ANSWERS, CHUNKS, DEMO_TOPICS, MSGS, O, WINDOW, lit, messages, s_except, s_gate_terms, s_gate_words, s_hedge, s_route_for, s_route_score, s_set,
    s_terms, s_tokens, s_topic, settings, tidy,
)
from turnloom.session import checkpointed

QUERIES, ORACLES = {}, {}


def reg(name, sql=None, **kw):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = O(sql, **kw)
        return fn

    return wrap


@reg("user_turns", f"WITH {MSGS} SELECT conv_id, turn, user_turn FROM msgs WHERE role = 'user'")
def _user_turns(s, d):
    return tidy(U.user_turns(messages(s, d), settings(s, d)).select("conv_id", "turn", "user_turn"))


@reg("user_turns_blocked", f"WITH {MSGS} SELECT conv_id, turn, role, user_turn FROM msgs")
def _user_turns_blocked(s, d):
    """The path for conversations of any length, with blocks of two messages."""
    cfg = settings(s, d, longest=None, block_rows=2)
    return tidy(U.with_user_turn(messages(s, d), cfg).select("conv_id", "turn", "role", "user_turn"))


@reg("user_queries", "SELECT conv_id, turn, md5(text) AS text_md5 FROM conversations WHERE role = 'user'")
def _user_queries(s, d):
    return tidy(U.by_role(messages(s, d), "user").select("conv_id", "turn", F.md5("text").alias("text_md5")))


@reg("assistant_chunks", "SELECT conv_id, turn, md5(text) AS text_md5 FROM conversations WHERE role = 'assistant'")
def _assistant_chunks(s, d):
    return tidy(U.by_role(messages(s, d), "assistant").select("conv_id", "turn", F.md5("text").alias("text_md5")))


@reg("exchanges", f"WITH {ANSWERS} SELECT conv_id, turn, md5(query) AS query_md5, md5(reply) AS reply_md5 FROM ex")
def _exchanges(s, d):
    return tidy(U.exchanges(messages(s, d), settings(s, d)).select("conv_id", "turn", F.md5("query").alias("query_md5"), F.md5("reply").alias("reply_md5")))


@reg("next_reply", "SELECT conv_id, turn, lead(role) OVER w AS next_role, md5(lead(text) OVER w) AS next_md5 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def _next_reply(s, d):
    from turnloom.operators.ordered import following

    n = following(messages(s, d), ["conv_id"], "turn", {"next_role": "role", "next_text": "text"}, block_rows=2)
    return tidy(n.select("conv_id", "turn", "next_role", F.md5("next_text").alias("next_md5")))


@reg("answer_map", f"WITH {ANSWERS} SELECT conv_id, first_turn AS turn, md5(query) AS query_md5, md5(answer) AS answer_md5 FROM amap")
def _answer_map(s, d):
    return tidy(U.answer_map(messages(s, d), settings(s, d)).select("conv_id", "turn", F.md5("query").alias("query_md5"), F.md5("answer").alias("answer_md5")))


@reg("run_fixture_join", f"WITH {ANSWERS} SELECT conv_id, turn, user_turn, first_turn, md5(query) AS query_md5, md5(answer) AS answer_md5 FROM answered")
def _run_fixture_join(s, d):
    a = U.answered_turns(messages(s, d), settings(s, d))
    return tidy(a.select("conv_id", "turn", "user_turn", "first_turn", F.md5("query").alias("query_md5"), F.md5("answer").alias("answer_md5")))


@reg("answer_facts", f"WITH {ANSWERS} SELECT conv_id, turn, {s_set('facts')} AS facts FROM facts0 WHERE facts IS NOT NULL")
def _answer_facts(s, d):
    f = U.with_facts(U.answered_turns(messages(s, d), settings(s, d))).where(F.col("facts").isNotNull())
    return tidy(f.select("conv_id", "turn", F.array_sort("facts").alias("facts")))


@reg("global_answer_facts", f"WITH {ANSWERS} SELECT DISTINCT md5(query) AS query_key, unnest(facts) AS fact FROM facts0 WHERE len(facts) > 0")
def _global_answer_facts(s, d):
    return tidy(L.global_answer_facts(messages(s, d), settings(s, d)))


@reg("prior_text", f"""WITH {ANSWERS}, fresh AS (SELECT conv_id, first_turn AS turn, count(*) AS n FROM seen GROUP BY ALL)
SELECT o.conv_id, o.turn, o.user_turn, coalesce((SELECT sum(n) FROM fresh f WHERE f.conv_id = o.conv_id AND f.turn < o.turn), 0) AS prior_terms,
o.n_terms, o.known_terms FROM ret o""", i="prior_terms n_terms known_terms")
def _prior_text(s, d):
    return tidy(U.prior_term_stats(messages(s, d), settings(s, d)))


@reg("is_retrievable", f"WITH {ANSWERS} SELECT conv_id, turn, user_turn, retrievable FROM ret")
def _is_retrievable(s, d):
    return tidy(U.is_retrievable(messages(s, d), settings(s, d)).select("conv_id", "turn", "user_turn", "retrievable"))


@reg("prior_stored", f"""WITH {MSGS}, r AS (SELECT conv_id, turn, {s_terms('text')} AS terms FROM msgs WHERE role = 'assistant' AND NOT {s_hedge('text')}),
f AS (SELECT conv_id, term, min(turn) AS first_turn FROM (SELECT conv_id, turn, unnest(terms) AS term FROM r) GROUP BY ALL)
SELECT m.conv_id, m.turn, count(f.term) AS prior_stored_terms FROM msgs m LEFT JOIN f ON f.conv_id = m.conv_id AND f.first_turn < m.turn WHERE m.role = 'user' GROUP BY ALL""")
def _prior_stored(s, d):
    from turnloom.operators.ordered import running

    m = messages(s, d)
    cfg = settings(s, d)
    seen = U.first_seen(m.where((F.col("role") == "assistant") & ~T.is_hedge(F.col("text"))), T.diagnostic_terms(F.col("text")))
    fresh = seen.groupBy("conv_id", F.col("first_turn").alias("turn")).agg(F.count("*").alias("n"))
    r = running(m.join(fresh, ["conv_id", "turn"], "left"), ["conv_id"], "turn", {"prior_stored_terms": ("sum", F.coalesce("n", F.lit(0)))}, inclusive=False, limit=cfg.longest)
    return tidy(r.where(F.col("role") == "user").select("conv_id", "turn", "prior_stored_terms"))


_SWITCH = f"""WITH {ANSWERS}, useen AS (SELECT conv_id, term, min(turn) AS first_turn FROM (SELECT conv_id, turn, unnest(terms) AS term FROM own) GROUP BY ALL),
kn AS (SELECT o.conv_id, o.turn, count(*) AS k FROM (SELECT conv_id, turn, unnest(terms) AS term FROM own) o JOIN useen s USING (conv_id, term) WHERE s.first_turn < o.turn GROUP BY ALL),
st AS (SELECT conv_id, min(turn) AS start_turn FROM own WHERE len(terms) > 0 GROUP BY 1),
sw AS (SELECT o.conv_id, o.turn, o.user_turn, coalesce(st.start_turn < o.turn, false) AND kn.k IS NULL AS is_switch FROM own o LEFT JOIN kn USING (conv_id, turn) LEFT JOIN st USING (conv_id)),
tss AS (SELECT *, coalesce(user_turn - max(CASE WHEN is_switch THEN user_turn END) OVER (PARTITION BY conv_id ORDER BY user_turn), 99) AS turns_since_switch FROM sw)"""


@reg("turns_since_switch", f"{_SWITCH} SELECT * FROM tss")
def _turns_since_switch(s, d):
    return tidy(U.turns_since_switch(messages(s, d), settings(s, d)))


@reg("post_switch_turns", f"{_SWITCH} SELECT conv_id, turn, turns_since_switch FROM tss WHERE turns_since_switch <= 3")
def _post_switch_turns(s, d):
    t = U.turns_since_switch(messages(s, d), settings(s, d))
    return tidy(t.where(F.col("turns_since_switch") <= 3).select("conv_id", "turn", "turns_since_switch"))


@reg("every_nth", "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS n FROM conversations WHERE role = 'user') WHERE n % 10 = 0")
def _every_nth(s, d):
    q = U.by_role(messages(s, d), "user").select("conv_id", "turn")
    return tidy(U.every_nth(q, ["conv_id", "turn"], 0.1).select("conv_id", "turn"))


@reg("conversation_split", "SELECT conv_id, CASE WHEN ('0x' || substr(md5('0:' || conv_id), 1, 7))::BIGINT % 10 < 8 THEN 'train' ELSE 'held_out' END AS split, count(*) AS n FROM conversations GROUP BY 1")
def _conversation_split(s, d):
    return tidy(U.conversation_split(messages(s, d)).groupBy("conv_id", "split").agg(F.count("*").alias("n")))


# ------------------------------------------------------------------ store
_COLS = ["conv_id", "seq", "user_turn", "turn", "role", "chunk_id", "fingerprint", "tokens"]


@reg("add_chunk", f"WITH {CHUNKS} SELECT {', '.join(_COLS)} FROM chunks")
def _add_chunk(s, d):
    return tidy(U.stored_chunks(messages(s, d), settings(s, d)).select(*_COLS))


@reg("recent_chunks", f"WITH {CHUNKS} SELECT conv_id, seq, user_turn FROM chunks QUALIFY dense_rank() OVER (PARTITION BY conv_id ORDER BY user_turn DESC) <= 2")
def _recent_chunks(s, d):
    return tidy(S.recent_chunks(U.stored_chunks(messages(s, d), settings(s, d)), 2).select("conv_id", "seq", "user_turn"))


@reg("lru_evict", f"WITH {CHUNKS} SELECT conv_id, seq, chunk_id FROM chunks QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY last_ref DESC, seq DESC) <= 3")
def _lru_evict(s, d):
    return tidy(S.lru_evict(U.stored_chunks(messages(s, d), settings(s, d)), 3).select("conv_id", "seq", "chunk_id"))


@reg("deletion_candidates", f"WITH {CHUNKS} SELECT conv_id, seq, chunk_id FROM chunks QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY last_ref DESC, seq DESC) > 3")
def _deletion_candidates(s, d):
    return tidy(S.deletion_candidates(U.stored_chunks(messages(s, d), settings(s, d)), 3).select("conv_id", "seq", "chunk_id"))


@reg("archive_prune", f"""WITH {CHUNKS}, cur AS (SELECT conv_id, max(user_turn) AS current_turn FROM chunks GROUP BY 1)
SELECT conv_id, seq, chunk_id FROM chunks JOIN cur USING (conv_id) WHERE last_ref >= current_turn - 2
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY last_ref DESC, seq DESC) <= 3""")
def _archive_prune(s, d):
    c = checkpointed(U.stored_chunks(messages(s, d), settings(s, d)))
    cur = c.groupBy("conv_id").agg(F.max("user_turn").alias("current_turn"))
    return tidy(S.archive_prune(c, cur, 2, 3).select("conv_id", "seq", "chunk_id"))


@reg("store_state", f"WITH {CHUNKS} SELECT conv_id, max(user_turn) AS turn, count(*) AS live_chunks, sum(tokens) AS live_tokens FROM chunks GROUP BY 1", i="live_tokens")
def _store_state(s, d):
    from turnloom.operators.sessions import store_state

    return tidy(store_state(U.stored_chunks(messages(s, d), settings(s, d))))


def _s_esc(x):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = f"replace({x}, {lit(a)}, {lit(b)})"
    return x


@reg("export_transcript", f"""WITH {CHUNKS}, g AS (SELECT conv_id, user_turn, arg_min(content, seq) AS q, arg_max(content, seq) AS r, count(*) AS n FROM chunks GROUP BY ALL)
SELECT conv_id, user_turn, md5('## Turn ' || user_turn || chr(10) || '**User:** ' || {_s_esc('q')} ||
CASE WHEN n > 1 AND r <> '' THEN chr(10) || chr(10) || '**Assistant:** ' || {_s_esc('r')} ELSE '' END || chr(10)) AS md_md5 FROM g""")
def _export_transcript(s, d):
    from turnloom.operators.sessions import export_transcript

    x = export_transcript(U.stored_chunks(messages(s, d), settings(s, d)))
    return tidy(x.select("conv_id", "user_turn", F.md5("markdown").alias("md_md5")))


# ------------------------------------------------------------------ windows
_FIFO = f"""tok AS (SELECT conv_id, turn, role, text, {s_tokens('text')} AS tokens FROM conversations),
h AS (SELECT q.conv_id, q.turn, list({{'t': m.turn, 'c': m.tokens}} ORDER BY m.turn DESC) AS items FROM tok q JOIN tok m ON m.conv_id = q.conv_id AND m.turn <= q.turn GROUP BY ALL),
f AS (SELECT conv_id, turn, list_reduce(items, lambda a, x: CASE WHEN len(a.k) = 0 OR a.u + x.c <= {WINDOW} THEN {{'u': a.u + x.c, 'k': list_append(a.k, x.t)}} ELSE a END,
      {{'u': 0::BIGINT, 'k': []::BIGINT[]}}) AS r FROM h)"""


def _tok(s, d):
    return messages(s, d).withColumn("tokens", T.estimate_tokens(F.col("text")))


@reg("fifo_window", f"WITH {_FIFO} SELECT conv_id, turn, r.u AS used_tokens, array_to_string(list_sort(r.k), ',') AS kept FROM f")
def _fifo_window(s, d):
    return tidy(fifo_window(_tok(s, d), WINDOW, cfg=settings(s, d)))


@reg("fifo_window_long", f"WITH {_FIFO} SELECT conv_id, turn, r.u AS used_tokens, array_to_string(list_sort(r.k), ',') AS kept FROM f")
def _fifo_window_long(s, d):
    """Histories over many blocks and groups of blocks: blocks of four messages, groups of two."""
    return tidy(fifo_window(_tok(s, d), WINDOW, cfg=settings(s, d, block_rows=4), fan=2))


@reg("rolling_window", f"SELECT conv_id, turn, count(*) OVER w AS n_messages, sum({s_tokens('text')}) OVER w AS prompt_tokens FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)", i="prompt_tokens")
def _rolling_window(s, d):
    return tidy(S.rolling_window(_tok(s, d), settings(s, d)).select("conv_id", "turn", "n_messages", "prompt_tokens"))


@reg("keep_last_n", "SELECT conv_id, turn, coalesce(array_to_string(list(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ','), '') AS window FROM conversations")
def _keep_last_n(s, d):
    k = S.keep_last_n(messages(s, d), 3, F.col("turn"), cfg=settings(s, d, longest=None, block_rows=4))
    return tidy(k.select("conv_id", "turn", "window"))


@reg("run_baselines", f"""WITH {ANSWERS.replace('msgs AS (', 'msgs AS (', 1)}, {_FIFO}
SELECT a.conv_id, a.turn, {s_tokens('a.answer')} AS completion_tokens, f.r.u AS prompt_tokens FROM answered a JOIN f ON f.conv_id = a.conv_id AND f.turn = a.turn""", i="completion_tokens prompt_tokens")
def _run_baselines(s, d):
    return tidy(E.run_baselines(messages(s, d), "fifo", WINDOW, settings(s, d)))


# ------------------------------------------------------------------ labels
_TOPIC = f"tp AS (SELECT conv_id, turn, role, text, {s_topic('text')} AS topic FROM conversations)"


@reg("needed_later", f"""WITH {_TOPIC}, l AS (SELECT conv_id, topic, max(turn) AS last_asked FROM tp WHERE role = 'user' AND topic IS NOT NULL GROUP BY ALL)
SELECT t.conv_id, t.turn, t.topic, coalesce(l.last_asked > t.turn, false) AS needed_later FROM tp t LEFT JOIN l USING (conv_id, topic) WHERE t.role = 'assistant'""")
def _needed_later(s, d):
    return tidy(L.needed_later(messages(s, d), DEMO_TOPICS).drop("chunk"))


QUERIES["label_evictions"], ORACLES["label_evictions"] = QUERIES["needed_later"], ORACLES["needed_later"]


@reg("label_pairs", f"""WITH {_TOPIC} SELECT q.conv_id, q.turn AS q_turn, c.turn AS c_turn, q.topic = c.topic AS relevant FROM tp q JOIN tp c USING (conv_id)
WHERE q.role = 'user' AND c.role = 'assistant' AND q.topic IS NOT NULL AND c.topic IS NOT NULL ORDER BY q.conv_id, q.turn, relevant DESC, c.turn LIMIT 200""")
def _label_pairs(s, d):
    return tidy(L.label_pairs(messages(s, d), 200, DEMO_TOPICS).select("conv_id", "q_turn", "c_turn", "relevant"))


@reg("fair_pair_sample", f"""WITH {_TOPIC}, p AS (SELECT q.conv_id, q.turn AS q_turn, c.turn AS c_turn, q.topic = c.topic AS relevant FROM tp q JOIN tp c USING (conv_id)
WHERE q.role = 'user' AND c.role = 'assistant' AND q.topic IS NOT NULL AND c.topic IS NOT NULL ORDER BY q.conv_id, q.turn, relevant DESC, c.turn LIMIT 200)
SELECT * FROM p ORDER BY md5('7:' || conv_id || ':' || q_turn || ':' || c_turn) LIMIT 50""")
def _fair_pair_sample(s, d):
    p = L.label_pairs(messages(s, d), 200, DEMO_TOPICS).select("conv_id", "q_turn", "c_turn", "relevant")
    return tidy(L.fair_pair_sample(p, 50, 7, ["conv_id", "q_turn", "c_turn"]))


@reg("label_routes", f"SELECT conv_id, turn, {s_route_for(s_route_score('text'))} AS optimal_route FROM conversations WHERE role = 'user'")
def _label_routes(s, d):
    return tidy(L.label_routes(messages(s, d), settings(s, d)).drop("query"))


@reg("route_decisions", f"""SELECT conv_id, turn, 'route' AS decision_type, score, optimal, CASE WHEN {s_route_for('score')} = optimal THEN 'correct' ELSE 'wrong' END AS outcome
FROM (SELECT conv_id, turn, greatest({s_route_score('text')}, 1) AS score, {s_route_for(s_route_score('text'))} AS optimal FROM conversations WHERE role = 'user')""", i="score")
def _route_decisions(s, d):
    return tidy(M.route_decisions(U.by_role(messages(s, d), "user").withColumnRenamed("text", "query")))


@reg("predict_router", None)
def _predict_router(s, d):
    from turnloom.functions import routing as R

    q = U.user_turns(messages(s, d), settings(s, d))
    # long queries count as hard ones here, so the tree has something to learn
    label = F.when(F.length("text") > 400, "escalation").when(F.length("text") > 150, "medium").otherwise("ultra_small")
    f = checkpointed(q.select("conv_id", "turn", label.alias("optimal_route"), *R.route_features(F.col("text"), F.col("user_turn"), F.lit(0.0), F.lit(0.0))))
    return tidy(L.predict_router(L.train_router(f), f).select("conv_id", "turn", "optimal_route", "predicted_route"))


# the tree learns its split points, so there is no SQL twin

# ------------------------------------------------------------------ reply gate
_GATE = f"""WITH {ANSWERS},
gx AS (SELECT e.conv_id, e.turn, e.query, e.reply, CASE WHEN coalesce(a.answer, '') <> '' THEN {s_except(s_gate_terms('a.answer'), s_gate_terms('a.query'))} ELSE []::VARCHAR[] END AS imprint,
  {s_gate_terms('e.reply')} AS reply_terms, {s_except(s_gate_terms('e.reply'), s_gate_terms('e.query'))} AS reply_facts, {s_hedge('e.reply')} AS rule_hedge
  FROM ex e LEFT JOIN amap a ON a.conv_id = e.conv_id AND a.query = e.query WHERE coalesce(e.reply, '') <> ''),
gr AS (SELECT *, len(imprint) AS imprint_facts, CASE WHEN len(imprint) > 0 THEN len(list_intersect(reply_terms, imprint))::DOUBLE / len(imprint) END AS ratio FROM gx),
gate AS (SELECT *, CASE WHEN rule_hedge THEN 'reject' WHEN imprint_facts > 0 AND ratio >= 0.4 THEN 'accept' WHEN imprint_facts > 0 AND ratio < 0.2 THEN 'reject' WHEN imprint_facts > 0 THEN 'flag'
  WHEN len(reply_facts) >= 3 THEN 'accept' ELSE 'reject' END AS decision,
  CASE WHEN rule_hedge THEN 'rule_hedge' WHEN imprint_facts > 0 AND ratio >= 0.4 THEN 'copy' WHEN imprint_facts > 0 AND ratio < 0.2 THEN 'not_copy' WHEN imprint_facts > 0 THEN 'borderline'
  WHEN len(reply_facts) >= 3 THEN 'substantive_first_mention' ELSE 'thin' END AS reason FROM gr)"""


def _gate(s, d):
    cfg = settings(s, d)
    m = messages(s, d)
    return G.confirmation_gate(U.exchanges(m, cfg), G.fixture_imprint(m, cfg), cfg)


@reg("fixture_imprint", f"WITH {ANSWERS} SELECT conv_id, md5(query) AS query_key, CASE WHEN coalesce(answer, '') <> '' THEN {s_set(s_except(s_gate_terms('answer'), s_gate_terms('query')))} ELSE '' END AS imprint FROM amap")
def _fixture_imprint(s, d):
    return tidy(G.fixture_imprint(messages(s, d), settings(s, d)).withColumn("imprint", F.array_sort("imprint")))


@reg("confirmation_gate", f"{_GATE} SELECT conv_id, turn, imprint_facts, ratio, rule_hedge, decision, reason FROM gate", d="ratio")
def _confirmation_gate(s, d):
    return tidy(_gate(s, d).select("conv_id", "turn", "imprint_facts", "ratio", "rule_hedge", "decision", "reason"))


@reg("gate_summary", f"""{_GATE} SELECT count(*) FILTER (decision = 'accept') AS accepted, count(*) FILTER (decision = 'reject') AS rejected, count(*) FILTER (decision = 'flag') AS flagged,
count(*) FILTER (reason = 'rule_hedge') AS rule_hedge_rejects, count(*) FILTER (reason = 'thin') AS thin_rejects, count(*) FILTER (rule_hedge AND decision <> 'reject') AS stored_refusals,
round(avg(ratio), 3) AS mean_ingestion_ratio FROM gate""")
def _gate_summary(s, d):
    return tidy(G.gate_summary(_gate(s, d)))


@reg("ingestion_rate", f"""{_GATE}, e AS (SELECT DISTINCT conv_id, unnest(imprint) AS fact FROM gate),
w AS (SELECT conv_id, unnest({s_gate_words('reply')}) AS fact, NOT rule_hedge AS a, decision IN ('accept', 'flag') AS b FROM gate),
w2 AS (SELECT conv_id, fact, bool_or(a) AS a, bool_or(b) AS b FROM w GROUP BY ALL),
n AS (SELECT e.conv_id, count(*) AS expected_facts, count(*) FILTER (w2.a) AS na, count(*) FILTER (w2.b) AS nb FROM e LEFT JOIN w2 USING (conv_id, fact) GROUP BY 1),
c AS (SELECT conv_id, count(*) FILTER (NOT rule_hedge) AS stored_a, count(*) FILTER (decision IN ('accept', 'flag')) AS stored_b, count(*) FILTER (rule_hedge AND decision IN ('accept', 'flag')) AS refusals_b FROM gate GROUP BY 1)
SELECT conv_id, expected_facts, stored_a, stored_b, refusals_b, na::DOUBLE / expected_facts AS ingestion_a, nb::DOUBLE / expected_facts AS ingestion_b FROM n JOIN c USING (conv_id)""", d="ingestion_a ingestion_b")
def _ingestion_rate(s, d):
    return tidy(G.ingestion_rate(checkpointed(_gate(s, d))))


@reg("gate_ab", f"""{_GATE}, e AS (SELECT DISTINCT unnest(imprint) AS fact FROM gate), sc AS (SELECT * FROM gate WHERE conv_id IN (SELECT conv_id FROM gate WHERE len(imprint) > 0)),
w AS (SELECT fact, bool_or(a) AS a, bool_or(b) AS b FROM (SELECT unnest({s_gate_words('reply')}) AS fact, NOT rule_hedge AS a, decision IN ('accept', 'flag') AS b FROM sc) GROUP BY 1),
n AS (SELECT count(*) AS t, count(*) FILTER (w.a) AS na, count(*) FILTER (w.b) AS nb FROM e LEFT JOIN w USING (fact)),
c AS (SELECT count(*) FILTER (NOT rule_hedge) AS stored_a, count(*) FILTER (decision IN ('accept', 'flag')) AS stored_b, count(*) FILTER (rule_hedge AND decision IN ('accept', 'flag')) AS refusals_b FROM sc)
SELECT t AS imprint_facts_total, stored_a, stored_b, refusals_b, 0::BIGINT AS refusals_a, na::DOUBLE / greatest(t, 1) AS ingestion_a, nb::DOUBLE / greatest(t, 1) AS ingestion_b,
(t > 0 AND nb >= na AND refusals_b <= 0) AS hypothesis_supported FROM n, c""", d="ingestion_a ingestion_b")
def _gate_ab(s, d):
    return tidy(G.gate_ab(checkpointed(_gate(s, d))))


@reg("digest_gate", None)
def _digest_gate(s, d):
    cfg = settings(s, d, block_rows=8)
    return tidy(G.digest_gate(U.exchanges(messages(s, d), cfg), cfg))


# the sequential walk as a fold over the ordered replies of a conversation
_ACC = "(CASE WHEN x.h THEN 0 WHEN len(a.f) > 0 THEN (CASE WHEN len(list_intersect(x.r, a.f))::DOUBLE / len(a.f) >= 0.4 THEN 1 WHEN len(list_intersect(x.r, a.f))::DOUBLE / len(a.f) < 0.2 THEN 2 ELSE 3 END) WHEN len(x.n) >= 3 THEN 4 ELSE 5 END)"
ORACLES["digest_gate"] = O(f"""{_GATE}, o AS (SELECT conv_id, list({{'t': turn, 'h': rule_hedge, 'r': reply_terms, 'n': reply_facts}} ORDER BY turn) AS xs FROM gate GROUP BY 1),
w AS (SELECT conv_id, list_reduce(xs, lambda a, x: {{'f': CASE WHEN {_ACC} IN (1, 4) THEN list_distinct(list_concat(a.f, x.n)) ELSE a.f END,
  'o': list_append(a.o, {{'turn': x.t, 'code': {_ACC}, 'ratio': CASE WHEN len(a.f) > 0 THEN len(list_intersect(x.r, a.f))::DOUBLE / len(a.f) END, 'k': len(a.f)::BIGINT, 'nn': len(x.n)::BIGINT}})}},
  {{'f': []::VARCHAR[], 'o': []::STRUCT(turn BIGINT, code INTEGER, ratio DOUBLE, k BIGINT, nn BIGINT)[]}}) AS r FROM o),
u AS (SELECT conv_id, unnest(r.o) AS e FROM w)
SELECT conv_id, e.turn AS turn, CASE WHEN e.code IN (1, 4) THEN 'accept' WHEN e.code = 3 THEN 'flag' ELSE 'reject' END AS decision,
CASE e.code WHEN 0 THEN 'rule_hedge' WHEN 1 THEN 'copy' WHEN 2 THEN 'not_copy' WHEN 3 THEN 'borderline' WHEN 4 THEN 'substantive_first_mention' ELSE 'thin' END AS reason,
e.ratio AS ratio, e.k AS imprint_facts, e.nn AS n_new FROM u""", d="ratio")


@reg("predictive_preload", f"""WITH {CHUNKS}, q AS (SELECT conv_id, turn, seq, list(content) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS qs FROM chunks WHERE role = 'user'),
l AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1),
p AS (SELECT *, regexp_matches(lower(array_to_string(qs, ' ')), {lit('|'.join(V.ERROR_TERMS))}) AS dbg, regexp_matches(lower(array_to_string(qs, ' ')), {lit('|'.join(V.FUNCTION_TERMS))}) AS fn,
 list_transform(qs, lambda x: list_distinct(list_filter(string_split_regex(lower(x), '\\s+'), lambda w: w <> '' AND NOT list_contains({'[' + ', '.join(lit(w) for w in V.PRELOAD_STOPWORDS) + ']'}, w)))) AS ws FROM l),
a AS (SELECT *, len(qs) >= 3 AND list_max(list_transform(range(len(ws) - 1), lambda i: CASE WHEN len(list_distinct(list_concat(ws[i+1], ws[i+2]))) = 0 THEN 1.0 ELSE len(list_intersect(ws[i+1], ws[i+2]))::DOUBLE / len(list_distinct(list_concat(ws[i+1], ws[i+2]))) END)) < 0.1 AS alt FROM p),
m AS (SELECT a.conv_id, c.seq, c.chunk_id, CASE WHEN (dbg AND regexp_matches(lower(c.content), {lit('|'.join(V.ERROR_TERMS))})) OR (fn AND regexp_matches(lower(c.content), {lit('|'.join(V.FUNCTION_TERMS))})) THEN 0
 WHEN alt AND len(list_filter(string_split_regex(lower(qs[len(qs)]), '\\s+'), lambda w: length(w) > 4 AND contains(lower(c.content), w))) > 0 THEN 1 END AS tier FROM a JOIN chunks c USING (conv_id))
SELECT conv_id, chunk_id, row_number() OVER (PARTITION BY conv_id ORDER BY tier, seq) AS position FROM m WHERE tier IS NOT NULL""")
def _predictive_preload(s, d):
    from turnloom.operators.preload import predictive_preload

    cfg = settings(s, d, max_chunks=1000)
    return tidy(predictive_preload(checkpointed(U.stored_chunks(messages(s, d), cfg)), cfg).select("conv_id", "chunk_id", "position"))



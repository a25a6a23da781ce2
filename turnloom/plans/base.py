"""Loaders and SQL fragments shared by the registered queries.

Each plan module has ``QUERIES`` (name -> function(spark, sf_dir)) and
``ORACLES`` (name -> SQL for the same result on the same tables).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from turnloom.config import Settings
from turnloom.functions import fixed as V
from turnloom.functions import routing as R
from turnloom.functions import text as T
from turnloom.operators.candidates import encode_chunks
from turnloom.operators.turns import longest_turn, stored_chunks
from turnloom.session import checkpointed, shared_root

# small parameters, so that windows, caps and walls bind on short conversations
STORE, STALE, BUDGET, WINDOW = 4, 1, 200, 200
DUP, DRIFT, DIMS = 0.75, 0.3, 64

# topics by frequent words of the languages in the tables
DEMO_TOPICS = {
    "english": {"feature": "the and", "decisions": {"ing": "tion", "ther": "hand"}},
    "french": {"feature": "que les", "decisions": {"eau": "eux", "ment": "aux"}},
    "german": {"feature": "der und", "decisions": {"sch": "ung", "ein": "lich"}},
    "spanish": {"feature": "que los", "decisions": {"cion": "ado", "para": "dad"}},
}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def messages(spark, d) -> DataFrame:
    return table(spark, d, "conversations")


def settings(spark, d, **kw) -> Settings:
    base = {
        "max_chunks": STORE, "stale_threshold": STALE, "dedup_threshold": DUP, "drift_threshold": DRIFT,
        "longest": longest_turn(messages(spark, d)),
    }
    return Settings(**{**base, **kw})


def chunk_table(spark, d, cfg) -> DataFrame:
    """The ingested, encoded chunks, written once per query because many branches read them."""
    return checkpointed(encode_chunks(stored_chunks(messages(spark, d), cfg), cfg))


def scratch(spark) -> str:
    """A new folder beside the checkpoints, where all executors can write."""
    return f"{shared_root(spark).rstrip('/')}/turnloom-{uuid.uuid4().hex}"


def tidy(df: DataFrame) -> DataFrame:
    """Plain comparable columns: long integers, doubles at six places, arrays as text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (ty.IntegerType, ty.ShortType, ty.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (ty.DoubleType, ty.FloatType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, ty.ArrayType):
            c = F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))
        out.append(c.alias(f.name))
    return df.select(*out)


def names(c):
    """A set of strings in a fixed order."""
    return F.array_sort(c)


# --------------------------------------------------------------- SQL fragments
def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(words) -> str:
    return "[" + ", ".join(lit(w) for w in words) + "]"


def O(sql: str, d: str = "", i: str = "") -> str:  # noqa: E743
    """Round the double columns ``d`` and cast the integer columns ``i`` of an oracle."""
    rep = [f"round({c}, 6) AS {c}" for c in d.split()] + [f"CAST({c} AS BIGINT) AS {c}" for c in i.split()]
    if not rep:
        return sql
    return f"SELECT * REPLACE ({', '.join(rep)}) FROM ({sql}) AS t"


def s_strip(x):
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def s_tokens(x):
    return f"greatest(1, length(coalesce({x}, '')) // 4)"


def s_replace_all(x, pairs):
    for a, b in pairs:
        x = f"replace({x}, {lit(a)}, {lit(b)})"
    return x


def s_hedge(x):
    t = f"lower({s_strip(f'coalesce({x}, {lit(str())})')})"
    lead = f"substr({s_replace_all(t, V.CONTRACTIONS)}, 1, {V.REFUSAL_WINDOW})"
    return f"({t} = '' OR regexp_matches({lead}, {lit('|'.join(V.REFUSAL_MARKERS))}))"


def s_regex_all(x, rules):
    for p, r in rules:
        repl = r.replace("$1", "\\1").replace("$2", "\\2")
        x = f"regexp_replace({x}, {lit(p)}, {lit(repl)}, 'g')"
    return x


def s_sanitize(x, n=4000):
    y = s_regex_all(x, [*V.SECRET_RULES, (V.BASE64_BLOB, V.BASE64_MARK)])
    return f"CASE WHEN length({y}) > {n} THEN substr({y}, 1, {n}) || {lit(V.TRUNCATION_MARK)} ELSE {y} END"


def s_words4(x):
    return f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]{{4,}}'))"


def s_minus(lst, words):
    return f"list_filter({lst}, lambda w: NOT list_contains({sql_list(words)}, w))"


def s_gate_words(x):
    return f"list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9_+#./-]+'))"


def s_gate_terms(x):
    return s_minus(s_gate_words(x), V.GATE_STOPWORDS)


def s_terms(x):
    plain = f"lower(regexp_replace(coalesce({x}, ''), {lit(T.CODE_FENCE)}, ' ', 'g'))"
    return s_minus(f"list_distinct(regexp_extract_all({plain}, '[a-z][a-z\\-]{{3,}}'))", V.DIAGNOSTIC_STOPWORDS)


def s_except(a, b):
    return f"list_filter({a}, lambda z: NOT list_contains({b}, z))"


def s_set(lst):
    return f"array_to_string(list_sort({lst}), ',')"


def s_has_term(x):
    return f"(len(list_filter({sql_list(T.DEFAULT_VOCAB)}, lambda v: contains(lower({x}), v))) > 0)"


def s_matched(x):
    return f"list_distinct(regexp_extract_all({x}, {lit(T.vocabulary_pattern(T.DEFAULT_VOCAB))}))"


def s_nwords(x):
    return f"len(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+'))"


def s_sentences(x, extra=""):
    return f"string_split_regex(regexp_replace({x}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1){extra})"


def s_density(x):
    sents = s_sentences(s_strip(x))
    return (
        f"((len({s_matched(x)})::DOUBLE / greatest({s_nwords(x)}, 1)) * "
        f"(list_sum(list_transform({sents}, lambda s: {s_nwords('s')}))::DOUBLE / greatest(len({sents}), 1)))"
    )


def s_bow(x, dims=DIMS):
    b = f"list_transform(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: ('0x' || substr(md5(w), 1, 7))::BIGINT % {dims})"
    return f"list_transform(range({dims}), lambda i: len(list_filter({b}, lambda b: b = i)))::DOUBLE[]"


def s_dot(a, b):
    return f"list_inner_product({a}, {b})"


def s_route_score(q, depth="0"):
    low = f"lower({q})"
    parts = [f"(CASE WHEN contains({low}, {lit(k)}) THEN 1 ELSE 0 END)" for k in V.ROUTE_KEYWORDS]
    parts += [f"(CASE WHEN regexp_matches({low}, {lit(p.replace('.+', '[^\\n]+'))}) THEN 1 ELSE 0 END)" for p in V.ROUTE_PATTERNS]
    parts += [
        f"(CASE WHEN {s_blocks(q)} >= 3 THEN 2 ELSE 0 END)", f"(CASE WHEN length({q}) > 500 THEN 1 ELSE 0 END)",
        f"(CASE WHEN {depth} > 30 THEN 1 ELSE 0 END)",
    ]
    return "(" + " + ".join(parts) + ")"


def s_blocks(q):
    return f"((length({q}) - length(replace({q}, '```', ''))) // 3)"


def s_reason(q):
    low = f"lower({q})"
    parts = [f"CASE WHEN contains({low}, {lit(k)}) THEN {lit('keyword:' + k)} END" for k in V.ROUTE_KEYWORDS]
    parts += [f"CASE WHEN regexp_matches({low}, {lit(p.replace('.+', '[^\\n]+'))}) THEN {lit('pattern:' + p)} END" for p in V.ROUTE_PATTERNS]
    parts += [
        f"CASE WHEN {s_blocks(q)} >= 3 THEN 'code_density:' || {s_blocks(q)} END",
        f"CASE WHEN length({q}) > 500 THEN 'length:' || length({q}) END",
    ]
    return f"coalesce(nullif(concat_ws(',', {', '.join(parts)}), ''), 'default')"


def s_route_for(score, t=2):
    return f"(CASE WHEN {score} >= 3 THEN 'escalation' WHEN {score} >= {t} THEN 'medium' ELSE 'ultra_small' END)"


def s_topic(x, topics=None):
    """Hits per topic; the first topic with the most wins."""
    w = R.topic_weights(DEMO_TOPICS if topics is None else topics)
    hits = {n: "(" + " + ".join(f"(CASE WHEN contains(lower({x}), {lit(t)}) THEN {k} ELSE 0 END)" for t, k in ts) + ")" for n, ts in w.items()}
    top = "greatest(" + ", ".join(hits.values()) + ")"
    cases = " ".join(f"WHEN {h} = {top} THEN {lit(n)}" for n, h in hits.items())
    return f"(CASE WHEN {top} = 0 THEN NULL {cases} END)"


MSGS = """msgs AS (
  SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS user_turn
  FROM conversations)"""

CHUNKS = f"""{MSGS},
c0 AS (
  SELECT conv_id, turn, user_turn, role, {s_sanitize('text')} AS content FROM msgs
  WHERE user_turn >= 1 AND role IN ('user', 'assistant') AND (role = 'user' OR (NOT {s_hedge('text')} AND text <> ''))),
c1 AS (SELECT *, substr(md5(user_turn || ':' || content), 1, 12) AS chunk_id FROM c0),
c2 AS (SELECT * FROM c1 QUALIFY row_number() OVER (PARTITION BY conv_id, chunk_id ORDER BY turn) = 1),
chunks AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, user_turn, turn, role, chunk_id,
         substr(md5(content), 1, 12) AS fingerprint, content, {s_tokens('content')} AS tokens, user_turn AS last_ref
  FROM c2)"""

ENC = f"""{CHUNKS},
enc0 AS (SELECT *, {s_bow('content')} AS vec, {s_has_term('content')} AS has_term, {s_density('content')} AS density FROM chunks),
enc AS (SELECT *, sqrt({s_dot('vec', 'vec')}) AS norm FROM enc0)"""

ANSWERS = f"""{MSGS},
nx AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM msgs WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
ex AS (SELECT conv_id, turn, user_turn, text AS query, CASE WHEN nr = 'assistant' THEN nt END AS reply FROM nx WHERE role = 'user' AND text <> ''),
amap AS (SELECT conv_id, query, turn AS first_turn, reply AS answer FROM ex QUALIFY row_number() OVER (PARTITION BY conv_id, query ORDER BY turn) = 1),
answered AS (
  SELECT m.conv_id, m.turn, m.user_turn, a.first_turn, m.text AS query, a.answer
  FROM msgs m LEFT JOIN amap a ON a.conv_id = m.conv_id AND a.query = m.text WHERE m.role = 'user'),
facts0 AS (
  SELECT *, CASE WHEN coalesce(answer, '') <> '' THEN {s_except(s_terms('answer'), s_terms('query'))} END AS facts FROM answered),
seen AS (
  SELECT conv_id, term, min(turn) AS first_turn
  FROM (SELECT conv_id, turn, unnest({s_terms('text')}) AS term FROM msgs) GROUP BY ALL),
own AS (SELECT conv_id, turn, user_turn, {s_terms('text')} AS terms FROM msgs WHERE role = 'user'),
known AS (
  SELECT o.conv_id, o.turn, count(*) AS known_terms
  FROM (SELECT conv_id, turn, unnest(terms) AS term FROM own) o JOIN seen s USING (conv_id, term)
  WHERE s.first_turn < o.turn GROUP BY ALL),
ret AS (
  SELECT o.conv_id, o.turn, o.user_turn, len(o.terms) AS n_terms, coalesce(k.known_terms, 0) AS known_terms,
         (len(o.terms) = 0 OR coalesce(k.known_terms, 0) >= 2) AS retrievable
  FROM own o LEFT JOIN known k USING (conv_id, turn)),
stated AS (
  SELECT f.conv_id, f.turn, list(f.term) AS stated
  FROM (SELECT conv_id, turn, unnest(facts) AS term FROM facts0) f JOIN seen s USING (conv_id, term)
  WHERE s.first_turn < f.turn GROUP BY ALL)"""


def cand_sql(m=STORE, boost=0.15):
    """Query x store candidates on top of ENC."""
    return f"""cand AS (
  SELECT q.conv_id, q.seq AS q_seq, q.user_turn AS q_turn, c.seq, c.chunk_id, c.user_turn, c.role, c.tokens, c.density, c.vec,
         {s_dot('q.vec', 'c.vec')} / (q.norm * c.norm + 1e-9) AS cosine,
         {s_dot('q.vec', 'c.vec')} / (q.norm * c.norm + 1e-9) + (CASE WHEN c.has_term THEN {boost} ELSE 0.0 END) AS base, c.norm
  FROM enc q JOIN enc c ON c.conv_id = q.conv_id AND c.seq < q.seq AND c.seq >= q.seq - {m} WHERE q.role = 'user')"""


def near_sql(dup=DUP, recent=3, rank="density"):
    """Greedy duplicate pass and drift score per query, on top of ``cand``."""
    sim = f"{s_dot('i.vec', 'j.vec')} / (CASE WHEN i.norm * j.norm = 0 THEN 1e-9 ELSE i.norm * j.norm END)"
    live = "(CASE WHEN a.cur = e.i THEN a.live ELSE NOT list_contains(a.dead, e.i) END)"
    act = f"({live} AND NOT list_contains(a.dead, e.j))"
    return f"""edges AS (
  SELECT i.conv_id, i.q_seq,
         list({{'i': i.seq::BIGINT, 'j': j.seq::BIGINT, 'win': (CASE WHEN i.{rank} >= j.{rank} THEN i.seq ELSE j.seq END)::BIGINT,
                'lose': (CASE WHEN i.{rank} >= j.{rank} THEN j.seq ELSE i.seq END)::BIGINT,
                't': greatest(i.user_turn, j.user_turn)::BIGINT}} ORDER BY i.seq, j.seq) AS es
  FROM cand i JOIN cand j ON j.conv_id = i.conv_id AND j.q_seq = i.q_seq AND i.seq < j.seq
  WHERE {sim} > {dup} GROUP BY i.conv_id, i.q_seq),
greedy AS (
  SELECT conv_id, q_seq, list_reduce(es, lambda a, e: {{
      'dead': CASE WHEN {act} THEN list_append(a.dead, e.lose) ELSE a.dead END, 'cur': e.i, 'live': {live},
      'fresh': CASE WHEN {act} THEN list_append(a.fresh, {{'s': e.win, 't': e.t}}) ELSE a.fresh END}},
    {{'dead': []::BIGINT[], 'cur': -1::BIGINT, 'live': true, 'fresh': []::STRUCT(s BIGINT, t BIGINT)[]}}) AS g
  FROM edges),
ord AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, q_seq ORDER BY seq) AS rn, count(*) OVER (PARTITION BY conv_id, q_seq) AS n FROM cand),
pd AS (
  SELECT a.conv_id, a.q_seq, {s_dot('a.vec', 'b.vec')} AS d, a.user_turn >= a.q_turn - {recent} AS ar, b.user_turn >= b.q_turn - {recent} AS br,
         a.rn <= a.n // 2 AS ah, b.rn <= b.n // 2 AS bh
  FROM ord a JOIN ord b USING (conv_id, q_seq) WHERE a.n >= 5),
dr0 AS (
  SELECT conv_id, q_seq, coalesce(sum(d) FILTER (ar AND bh), 0) AS rh, sqrt(coalesce(sum(d) FILTER (ar AND br), 0)) * sqrt(coalesce(sum(d) FILTER (ah AND bh), 0)) AS den
  FROM pd GROUP BY ALL HAVING count(*) FILTER (ar) > 0),
drift AS (SELECT conv_id, q_seq, 1.0 - (CASE WHEN den = 0 THEN 0.0 ELSE rh / den END) AS drift FROM dr0)"""


def assemble_sql(budget=BUDGET, dup=DUP, drift=DRIFT, stale=STALE, recent=3, mult=1.0, rank="density", near=True, m=STORE, boost=0.15):
    """CTE chain from ENC to ``ctx``: one row per user turn with the selected chunks."""
    eff_budget = str(budget) if budget is not None else (
        "least(CASE r.route WHEN 'ultra_small' THEN floor(1000 + 2000 * least(h.high / 10.0, 1.0)) "
        "WHEN 'medium' THEN floor(3000 + 2000 * least(h.high / 10.0, 1.0)) ELSE floor(4000 + 2000 * least(h.high / 10.0, 1.0)) END, 6144)"
    )
    nr = near_sql(dup, recent, rank) if near else (
        "greedy AS (SELECT 0 AS conv_id, 0 AS q_seq, {'dead': []::BIGINT[], 'fresh': []::STRUCT(s BIGINT, t BIGINT)[]} AS g WHERE false), "
        "drift AS (SELECT 0 AS conv_id, 0 AS q_seq, 0.0 AS drift WHERE false)"
    )
    return f"""{cand_sql(m, boost)}, {nr},
q AS (SELECT conv_id, seq AS q_seq, user_turn AS q_turn, content AS query FROM enc WHERE role = 'user'),
dep AS (SELECT conv_id, q_seq, min(user_turn) AS t0 FROM cand GROUP BY ALL),
r AS (
  SELECT q.*, {s_route_for(s_route_score('q.query', 'coalesce(q.q_turn - d.t0, 0)'))} AS route,
         coalesce(dr.drift, 0.0) > {drift} AS drift_detected, g.g
  FROM q LEFT JOIN dep d USING (conv_id, q_seq) LEFT JOIN drift dr USING (conv_id, q_seq) LEFT JOIN greedy g USING (conv_id, q_seq)),
raws AS (
  SELECT c.*, r.g, r.drift_detected, CASE WHEN r.route = 'medium' THEN 0.5 ELSE c.base END AS raw
  FROM cand c JOIN r USING (conv_id, q_seq)),
surv AS (
  SELECT *, q_turn - greatest(user_turn, coalesce(list_max(list_transform(list_filter(g.fresh, lambda f: f.s = seq), lambda f: f.t)), 0)) AS age
  FROM raws WHERE g IS NULL OR NOT list_contains(g.dead, seq)),
effs AS (
  SELECT *, greatest(0.0, raw / pow({mult}, least(age / 10.0, 3.0)) * (CASE WHEN drift_detected AND user_turn < q_turn - {recent} THEN 0.1 ELSE 1.0 END)
         * (CASE WHEN age > {stale} THEN 0.5 ELSE 1.0 END)) AS eff FROM surv),
h AS (
  SELECT conv_id, q_seq, count(*) FILTER (eff > 0.6) AS high, count(*) AS n_survivors,
         list({{'seq': seq::BIGINT, 'tok': tokens::BIGINT, 'id': chunk_id}} ORDER BY eff DESC, seq) AS items FROM effs GROUP BY ALL),
tops AS (SELECT conv_id, q_seq, max(raw) AS top_raw, arg_min(seq, (-raw, seq)) AS top_seq, count(*) AS n_candidates,
                list({{'seq': seq, 'raw': raw}}) AS raw_list FROM raws GROUP BY ALL),
ctx0 AS (
  SELECT r.conv_id, r.q_seq, r.q_turn, r.query, r.route, r.drift_detected, ({eff_budget.replace('h.high', 'coalesce(h.high, 0)')})::BIGINT AS budget,
         h.items, coalesce(h.n_survivors, 0) AS n_survivors, t.top_raw, t.top_seq, coalesce(t.n_candidates, 0) AS n_candidates
  FROM r LEFT JOIN h USING (conv_id, q_seq) LEFT JOIN tops t USING (conv_id, q_seq)),
ctx1 AS (
  SELECT *, list_reduce(coalesce(items, []), lambda a, x: CASE WHEN a.u + x.tok <= budget
      THEN {{'u': a.u + x.tok, 'seqs': list_append(a.seqs, x.seq), 'ids': list_append(a.ids, x.id)}} ELSE a END,
      {{'u': 0::BIGINT, 'seqs': []::BIGINT[], 'ids': []::VARCHAR[]}}) AS f FROM ctx0),
ctx AS (
  SELECT conv_id, q_seq, q_turn, query, route, budget, f.u AS used_tokens, len(f.ids) AS chunks_used, f.seqs AS selected, f.ids AS selected_ids,
         coalesce(top_raw, 0.0) AS top_raw, top_seq, drift_detected, n_candidates, n_survivors FROM ctx1)"""


def arms_sql(arms, budget=BUDGET, dup=DUP, stale=STALE, recent=3, m=STORE):
    """As ``assemble_sql`` for several named arms at once; ``ctx`` has one row per (turn, arm)."""
    base = {"dedup": True, "drift": True, "decay": True, "drones": True, "adaptive": True, "mult": 1.0, "thr": DRIFT}
    rows = ", ".join(
        "(" + ", ".join(lit(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"{v}::DOUBLE" for v in {"arm": "", **base, **a}.values()) + ")"
        for a in arms
    )
    high = "CASE WHEN adaptive THEN coalesce(high, 0) ELSE 0 END"
    span = "least(CASE route WHEN 'ultra_small' THEN floor(1000 + 2000 * least(({0}) / 10.0, 1.0)) WHEN 'medium' THEN floor(3000 + 2000 * least(({0}) / 10.0, 1.0)) ELSE floor(4000 + 2000 * least(({0}) / 10.0, 1.0)) END, 6144)"
    eff_budget = str(budget) if budget is not None else span.format(high)
    return f"""{cand_sql(m)}, {near_sql(dup, recent)},
arms(arm, dedup, drift, decay, drones, adaptive, mult, thr) AS (VALUES {rows}),
q AS (SELECT conv_id, seq AS q_seq, user_turn AS q_turn, content AS query FROM enc WHERE role = 'user'),
dep AS (SELECT conv_id, q_seq, min(user_turn) AS t0 FROM cand GROUP BY ALL),
rt AS (SELECT q.*, {s_route_for(s_route_score('q.query', 'coalesce(q.q_turn - d.t0, 0)'))} AS route, coalesce(dr.drift, 0.0) AS dscore, g.g
  FROM q LEFT JOIN dep d USING (conv_id, q_seq) LEFT JOIN drift dr USING (conv_id, q_seq) LEFT JOIN greedy g USING (conv_id, q_seq)),
ra AS (SELECT rt.*, a.*, a.drift AND rt.dscore > a.thr AS drift_detected FROM rt, arms a),
raws AS (SELECT c.*, ra.* EXCLUDE (conv_id, q_seq, q_turn, query, drift), CASE WHEN NOT ra.drones THEN 0.5 WHEN ra.route = 'medium' THEN 0.5 ELSE c.base END AS raw FROM cand c JOIN ra USING (conv_id, q_seq)),
surv AS (SELECT *, q_turn - greatest(user_turn, CASE WHEN dedup THEN coalesce(list_max(list_transform(list_filter(g.fresh, lambda f: f.s = seq), lambda f: f.t)), 0) ELSE 0 END) AS age
  FROM raws WHERE NOT dedup OR g IS NULL OR NOT list_contains(g.dead, seq)),
effs AS (SELECT *, CASE WHEN decay THEN greatest(0.0, raw / pow(mult, least(age / 10.0, 3.0)) * (CASE WHEN drift_detected AND user_turn < q_turn - {recent} THEN 0.1 ELSE 1.0 END)
  * (CASE WHEN age > {stale} THEN 0.5 ELSE 1.0 END)) ELSE raw END AS eff FROM surv),
h AS (SELECT conv_id, q_seq, arm, count(*) FILTER (eff > 0.6) AS high, list({{'seq': seq::BIGINT, 'tok': tokens::BIGINT}} ORDER BY eff DESC, seq) AS items FROM effs GROUP BY ALL),
ctx0 AS (SELECT ra.conv_id, ra.q_seq, ra.q_turn, ra.arm, ({eff_budget})::BIGINT AS budget, h.items FROM ra LEFT JOIN h USING (conv_id, q_seq, arm)),
ctx1 AS (SELECT *, list_reduce(coalesce(items, []), lambda a, x: CASE WHEN a.u + x.tok <= budget THEN {{'u': a.u + x.tok, 'seqs': list_append(a.seqs, x.seq)}} ELSE a END,
  {{'u': 0::BIGINT, 'seqs': []::BIGINT[]}}) AS f FROM ctx0),
ctx AS (SELECT conv_id, q_seq, q_turn, arm, budget, f.u AS used_tokens, f.seqs AS selected FROM ctx1),
said AS (SELECT c.conv_id, c.q_turn AS user_turn, c.arm, list_distinct(flatten(list({s_terms('e.content')}))) AS ctx_terms
  FROM (SELECT conv_id, q_turn, arm, unnest(selected) AS seq FROM ctx) c JOIN enc e USING (conv_id, seq) GROUP BY ALL)"""

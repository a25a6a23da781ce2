"""Readers and writers, each through files written from the given tables, and the streaming replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.functions import vectors as X
from turnloom.operators import experiments as E
from turnloom.operators import labels as L
from turnloom.operators import metrics as M
from turnloom.operators import turns as U
from turnloom.operators.replay import prepare_replay, replay_turns
from turnloom.plans.base import ANSWERS, BUDGET, CHUNKS, DEMO_TOPICS, ENC, O, assemble_sql, chunk_table, lit, messages, s_route_for, s_route_score, s_topic, scratch, settings, table, tidy
from turnloom.session import checkpointed
from turnloom.sources import readers, sinks
from turnloom.streaming.replay import replay_stream

QUERIES, ORACLES = {}, {}


def reg(name, sql=None, **kw):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = O(sql, **kw)
        return fn

    return wrap


@reg("read_conversations", "SELECT conv_id::VARCHAR AS conv_id, turn, role, md5(text) AS text_md5 FROM conversations")
def _read_conversations(s, d):
    """JSON documents, one per message block; ``turn`` continues across a conversation's documents."""
    path = scratch(s)
    m = messages(s, d)
    # documents of at most 4096 messages, so no document grows with its conversation
    doc = m.groupBy("conv_id", F.floor(F.col("turn") / 4096).alias("part")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda x: F.struct(x.role.alias("role"), x.content.alias("content"))).alias("turns"))
    name = F.concat_ws("#", F.col("conv_id").cast("string"), F.col("part").cast("string"))
    sinks.write_documents(doc.select(F.to_json(F.struct(name.alias("conversation_id"), "turns")).alias("value")), path)
    r = readers.read_conversations(s, path, "*.txt")
    parts = F.split("conv_id", "#")
    return tidy(r.select(parts[0].alias("conv_id"), (F.col("turn") + parts[1].cast("long") * 4096).alias("turn"), "role", F.md5("text").alias("text_md5")))


def _report(s, d, path):
    """A run report per conversation group, from the recorded exchanges."""
    cfg = settings(s, d)
    ex = U.exchanges(messages(s, d), cfg)
    t = F.struct(F.col("turn").cast("int").alias("turn"), "query", "reply", F.lit(70.0).alias("pes"), F.length("query").alias("token_count"))
    # reports hold at most 512 turns each
    g = ex.groupBy("conv_id", F.floor(F.col("turn") / 1024).alias("part")).agg(F.array_sort(F.collect_list(t)).alias("turns"))
    rep = g.select(
        F.concat(F.lit("r"), F.col("conv_id").cast("string")).alias("run_id"), F.lit("replay").alias("mode"),
        F.struct(F.size("turns").alias("user_turns"), F.lit(1).alias("conversations")).alias("aggregate"),
        F.struct((F.col("conv_id") % 100).cast("double").alias("pes"), F.lit("GREEN").alias("band")).alias("post_run_pes"),
        F.struct((F.col("conv_id") % 50).cast("double").alias("retrieval_recall"), F.lit(12.5).alias("some_ceiling")).alias("retrieval_diagnostic"),
        F.array(F.struct(F.lit("P1").alias("id"), F.lit("t").alias("title"), F.lit("PASS").alias("status"))).alias("protocol"),
        F.array(F.struct(F.col("conv_id").cast("string").alias("conversation_id"), F.lit("short").alias("profile"), "turns")).alias("conversations"),
    )
    sinks.write_documents(rep.select(F.to_json(F.struct("*")).alias("value")), path)


@reg("read_run_report", f"WITH {ANSWERS} SELECT 'r' || conv_id AS run_id, 'replay' AS mode, count(*) AS turns, (conv_id % 100)::DOUBLE AS pes, 'GREEN' AS pes_band, (conv_id % 50)::DOUBLE AS recall, 12.5::DOUBLE AS ceiling, NULL::DOUBLE AS ingestion, 'PASS' AS p1 FROM ex GROUP BY conv_id")
def _read_run_report(s, d):
    path = scratch(s)
    _report(s, d, path)
    r = readers.read_run_report(s, path)
    return tidy(r.select("run_id", "mode", "turns", "pes", "pes_band", "recall", "ceiling", "ingestion", F.col("verdicts")["P1"].alias("p1")))


@reg("run_report_to_conversations", f"WITH {ANSWERS} SELECT conv_id::VARCHAR AS conv_id, turn * 2 AS turn, 'user' AS role, md5(trim(query)) AS text_md5 FROM ex WHERE trim(query) <> '' UNION ALL SELECT conv_id::VARCHAR, turn * 2 + 1, 'assistant', md5(trim(reply)) FROM ex WHERE trim(coalesce(reply, '')) <> ''")
def _report_to_conv(s, d):
    path = scratch(s)
    _report(s, d, path)
    return tidy(readers.run_report_to_conversations(readers.read_run_turns(s, path)).select("conv_id", "turn", "role", F.md5("text").alias("text_md5")))


@reg("write_run_report", f"WITH {ANSWERS} SELECT 'turns' AS block, count(*) AS n FROM ex UNION ALL SELECT 'answers', count(*) FROM amap")
def _write_run_report(s, d):
    path = scratch(s)
    cfg = settings(s, d)
    m = messages(s, d)
    sinks.write_run_report({"turns": U.exchanges(m, cfg), "answers": U.answer_map(m, cfg)}, path)
    blocks = [s.read.parquet(f"{path}/{b}").agg(F.count("*").alias("n")).select(F.lit(b).alias("block"), "n") for b in ("turns", "answers")]
    return tidy(blocks[0].unionByName(blocks[1]))


_TOPIC = f"tp AS (SELECT conv_id, turn, role, text, {s_topic('text')} AS topic FROM conversations)"


@reg("write_labels", f"WITH {_TOPIC} SELECT 'routes' AS name, count(*) AS n FROM conversations WHERE role = 'user' UNION ALL SELECT 'evictions', count(*) FROM conversations WHERE role = 'assistant'")
def _write_labels(s, d):
    m = messages(s, d)
    counts = sinks.write_labels({"routes": L.label_routes(m, settings(s, d)), "evictions": L.needed_later(m, DEMO_TOPICS)}, scratch(s))
    return tidy(s.createDataFrame(sorted(counts.items()), "name string, n long"))


_ROUTE_LABEL = f"SELECT conv_id, turn, {s_route_for(s_route_score('text'))} AS optimal_route FROM conversations WHERE role = 'user'"


@reg("read_labels", f"SELECT *, 'file' AS origin FROM ({_ROUTE_LABEL}) UNION ALL SELECT *, 'derived' FROM ({_ROUTE_LABEL})")
def _read_labels(s, d):
    """Label files written from the messages; where there is no file, the labeller derives the labels."""
    path, schema = scratch(s), "conv_id long, turn long, optimal_route string"
    derive = lambda: L.label_routes(messages(s, d), settings(s, d)).select("conv_id", "turn", "optimal_route")
    sinks.write_json_arrays(derive(), path, ["conv_id"], "turn", 4096)
    a = readers.read_labels(s, path, schema, derive).withColumn("origin", F.lit("file"))
    return tidy(a.unionByName(readers.read_labels(s, scratch(s), schema, derive).withColumn("origin", F.lit("derived"))))


_VOCAB_WORDS = 20


@reg("read_vocab", f"""WITH w AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{{7,}}')) AS w FROM conversations) GROUP BY w),
v AS (SELECT list(w) AS terms FROM (SELECT w FROM w ORDER BY n DESC, w LIMIT {_VOCAB_WORDS}))
SELECT doc_id, len(list_filter(terms, lambda t: contains(lower(text), t))) > 0 AS hit FROM documents, v""")
def _read_vocab(s, d):
    """A vocabulary file of the conversations' most frequent long words, met by all documents."""
    path = scratch(s)
    w = messages(s, d).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{7,}"), 0)).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    top = w.orderBy(F.desc("n"), "w").limit(_VOCAB_WORDS).agg(F.to_json(F.struct(F.collect_list("w").alias("terms"))).alias("value"))
    top.coalesce(1).write.text(f"{path}/frequent.json")
    vocab = readers.read_vocab("frequent", folder=path, spark=s)
    return tidy(table(s, d, "documents").select("doc_id", T.vocab_matches(F.col("text"), vocab).alias("hit")))


# ------------------------------------------------------------------ archive and store files
@reg("read_archive", f"WITH {CHUNKS} SELECT chunk_id AS id, max(user_turn) AS turn, 1.0::DOUBLE AS decay_multiplier, 0::BIGINT AS times_saved, max(user_turn) + 5 AS last_referenced_turn FROM chunks GROUP BY chunk_id")
def _read_archive(s, d):
    """Every record twice, the later with a newer reference, and broken lines between."""
    path = scratch(s)
    c = U.stored_chunks(messages(s, d), settings(s, d))
    rec = c.select("chunk_id", F.to_json(F.struct(F.col("chunk_id").alias("id"), "content", F.col("user_turn").alias("turn"), F.col("user_turn").alias("last_referenced_turn"))).alias("a"),
                   F.to_json(F.struct(F.col("chunk_id").alias("id"), "content", F.col("user_turn").alias("turn"), (F.col("user_turn") + 5).alias("last_referenced_turn"))).alias("b"))
    lines = rec.select("chunk_id", F.posexplode(F.array("a", F.lit("{broken"), "b")).alias("n", "value"))
    lines.repartition(4, "chunk_id").sortWithinPartitions("chunk_id", "n").select("value").write.text(path)
    r = readers.read_archive(s, path)
    # the same text in two conversations may share an id
    return tidy(r.groupBy("id").agg(F.max("turn").alias("turn"), F.max("decay_multiplier").alias("decay_multiplier"), F.max("times_saved").alias("times_saved"), F.max("last_referenced_turn").alias("last_referenced_turn")))


@reg("write_archive", f"WITH {CHUNKS} SELECT conv_id, chunk_id, last_ref FROM chunks")
def _write_archive(s, d):
    path, compact = scratch(s), scratch(s)
    c = U.stored_chunks(messages(s, d), settings(s, d)).select("conv_id", "chunk_id", "last_ref", "content")
    sinks.write_archive(c, path)
    back = s.read.schema("conv_id long, chunk_id string, last_ref int, content string").json(path)
    sinks.flush_archive(back, compact)
    return tidy(s.read.schema("conv_id long, chunk_id string, last_ref int").json(compact))


@reg("save_store", f"WITH {CHUNKS} SELECT conv_id, seq, chunk_id, 1.0::DOUBLE AS decay_multiplier, 0::BIGINT AS times_saved FROM chunks")
def _save_store(s, d):
    path = scratch(s)
    sinks.save_store(U.stored_chunks(messages(s, d), settings(s, d)), path, "base_1.0")
    return tidy(sinks.load_store(s, path, "base_1.0").select("conv_id", "seq", "chunk_id", "decay_multiplier", "times_saved"))


QUERIES["load_store"], ORACLES["load_store"] = QUERIES["save_store"], ORACLES["save_store"]


@reg("auto_checkpoint", f"WITH {CHUNKS} SELECT 'pes_' || (conv_id * 7 % 100) || '_x' AS tag, count(*) AS n FROM chunks WHERE conv_id * 7 % 100 > 80 GROUP BY 1")
def _auto_checkpoint(s, d):
    path = scratch(s)
    st = U.stored_chunks(messages(s, d), settings(s, d)).select("conv_id", "seq", (F.col("conv_id") * 7 % 100).cast("double").alias("pes"))
    sinks.auto_checkpoint(st, path, "x")
    tags = sinks.list_checkpoints(s, path)
    return tidy(s.read.parquet(path).groupBy("tag").agg(F.count("*").alias("n")).join(tags, "tag", "left_semi"))


@reg("persist_embeddings", f"SELECT DISTINCT md5(text) AS text_md5, 64::BIGINT AS dims FROM conversations")
def _persist_embeddings(s, d):
    path = scratch(s)
    v = messages(s, d).select(T.content_key(F.col("text")).alias("text_md5"), "text").dropDuplicates(["text_md5"])
    sinks.persist_embeddings(v.select("text_md5", X.hashed_embedding(F.col("text")).alias("embedding")), path, "hashed words/64")
    sinks.persist_embeddings(v.limit(3).select("text_md5", F.array(F.lit(0.0)).alias("embedding")), path, "other")
    return tidy(readers.read_embedding_cache(s, path, "hashed_words_64").select("text_md5", F.size("embedding").alias("dims")))


QUERIES["read_embedding_cache"], ORACLES["read_embedding_cache"] = QUERIES["persist_embeddings"], ORACLES["persist_embeddings"]


@reg("write_baseline_report", f"WITH {ANSWERS} SELECT round(avg(length(query)), 4) AS baseline_tps FROM ex", d="baseline_tps")
def _write_baseline_report(s, d):
    path = scratch(s)
    ex = U.exchanges(messages(s, d), settings(s, d))
    per = ex.groupBy("conv_id").agg(F.count("*").alias("turns"))
    agg = ex.agg(F.struct(F.round(F.avg(F.length("query")), 4).alias("avg_tokens_per_sec")).alias("aggregate"))
    sinks.write_baseline_report(per, agg, path, "rolling")
    return tidy(readers.read_baseline_tps(s, f"{path}/aggregate"))


@reg("read_baseline_tps", f"""WITH {ANSWERS}, c AS (SELECT conv_id, avg(length(coalesce(reply, '')) / 4.0) AS tps FROM ex GROUP BY conv_id)
SELECT round(avg(tps), 4) AS measured, 30.0::DOUBLE AS fallback, count(*) AS conversations FROM c""", d="measured")
def _read_baseline_tps(s, d):
    """The rate of a written baseline report, and the default where no report is."""
    path = scratch(s)
    ex = U.exchanges(messages(s, d), settings(s, d))
    per = ex.groupBy("conv_id").agg(F.avg(F.length(F.coalesce("reply", F.lit(""))) / 4.0).alias("tps"))
    sinks.write_baseline_report(per, per.agg(F.struct(F.round(F.avg("tps"), 4).alias("avg_tokens_per_sec")).alias("aggregate")), path, "rolling")
    measured = readers.read_baseline_tps(s, f"{path}/aggregate").select(F.col("baseline_tps").alias("measured"))
    fallback = readers.read_baseline_tps(s, scratch(s)).select(F.col("baseline_tps").alias("fallback"))
    n = s.read.json(f"{path}/conversations").agg(F.count("*").alias("conversations"))
    return tidy(M.one_row_join(M.one_row_join(measured, fallback), n))


@reg("populate_ground_truth", f"""WITH u AS (SELECT conv_id, turn, text, row_number() OVER (ORDER BY conv_id, turn) - 1 AS n FROM conversations WHERE role = 'user')
SELECT conv_id, turn, {s_route_for(s_route_score('text'))} AS optimal, greatest({s_route_score('text')}, 1)::BIGINT AS score, n % 10 = 0 AS sampled FROM u""")
def _populate(s, d):
    q = U.by_role(messages(s, d), "user").withColumnRenamed("text", "query")
    routes = M.route_decisions(q).select("conv_id", "turn", "optimal", "score")
    sample = U.every_nth(q.select("conv_id", "turn"), ["conv_id", "turn"], 0.1).select("conv_id", "turn", F.lit(True).alias("sampled"))
    return tidy(routes.join(sample, ["conv_id", "turn"], "left").withColumn("sampled", F.coalesce("sampled", F.lit(False))))


@reg("train_router", None)
def _train_router(s, d):
    from turnloom.functions import routing as R

    q = U.user_turns(messages(s, d), settings(s, d))
    label = F.when(F.length("text") > 400, "escalation").when(F.length("text") > 150, "medium").otherwise("ultra_small")
    f = checkpointed(q.select(label.alias("optimal_route"), *R.route_features(F.col("text"), F.col("user_turn"), F.lit(0.0), F.lit(0.0))))
    p = L.predict_router(L.train_router(f), f)
    return tidy(p.groupBy("optimal_route").agg(F.avg((F.col("optimal_route") == F.col("predicted_route")).cast("double")).alias("accuracy"), F.count("*").alias("n")))


# ------------------------------------------------------------------ report and distillation
@reg("report_tables", f"""WITH {ENC}, {assemble_sql()}, e AS (SELECT used_tokens::DOUBLE / budget AS u, drift_detected FROM ctx)
SELECT 'turns' AS item, count(*)::DOUBLE AS value FROM e UNION ALL SELECT 'avg_utilization', avg(u) FROM e UNION ALL SELECT 'drift_events', count(*) FILTER (drift_detected) FROM e""", d="value")
def _report_tables(s, d):
    cfg = settings(s, d, fixed_budget=BUDGET)
    from turnloom.operators.assemble import assemble

    t = E.e2e_turns(assemble(chunk_table(s, d, cfg), cfg, encoded=True))
    a = t.agg(F.count("*").cast("double").alias("turns"), F.avg("utilization").alias("avg_utilization"), F.count_if("drift_detected").cast("double").alias("drift_events"))
    return tidy(a.select(F.explode(F.create_map(*[x for c in ("turns", "avg_utilization", "drift_events") for x in (F.lit(c), F.col(c))])).alias("item", "value")))


@reg("p12_distill")
def _p12(s, d):
    """Fact sentences of stored replies: compressed, cut to units."""
    c = U.stored_chunks(messages(s, d), settings(s, d)).where(F.col("role") == "assistant")
    u = c.select("conv_id", "seq", F.posexplode(T.subchunk(T.compress(F.col("content")), 200)).alias("unit_no", "unit"))
    return tidy(u.select("conv_id", "seq", "unit_no", F.md5("unit").alias("unit_md5"), T.estimate_tokens(F.col("unit")).alias("tokens")))


# ------------------------------------------------------------------ streaming replay
@reg("replay_stream")
def _replay_stream(s, d):
    """The replay as a stream over files of exchanges; the batch walk gives the same rows."""
    src, out = scratch(s), scratch(s)
    cfg = settings(s, d, fixed_budget=BUDGET)
    m = U.with_user_turn(messages(s, d), cfg).where((F.col("user_turn") >= 1) & F.col("role").isin("user", "assistant"))
    ex = m.groupBy("conv_id", "user_turn").agg(F.max(F.when(F.col("role") == "user", F.col("text"))).alias("query"), F.max(F.when(F.col("role") == "assistant", F.col("text"))).alias("reply"))
    ex.select("conv_id", "user_turn", "query", "reply", F.lit(None).cast("string").alias("control")).write.parquet(src)
    st = s.readStream.schema("conv_id long, user_turn long, query string, reply string, control string").parquet(src)
    q = replay_stream(st, cfg).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "_ckpt").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return tidy(s.read.parquet(out).select("conv_id", "turn", "route", "used_tokens", "selected_ids", "gate_fired", "resurrected", "archived"))


@reg("curate_observe")
def _curate_observe(s, d):
    """Batch form of the same step: what would be handed out per turn, without archive."""
    cfg = settings(s, d, fixed_budget=BUDGET)
    return tidy(replay_turns(prepare_replay(messages(s, d), cfg), cfg, False).select("conv_id", "turn", "selected_ids", "used_tokens"))

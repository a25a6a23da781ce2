"""Evaluation jobs: diagnostics, paired arms, sweeps and baselines."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.config import Settings
from turnloom.functions import fixed as V
from turnloom.functions import health as H
from turnloom.functions import routing as R
from turnloom.functions import text as T
from turnloom.operators.assemble import assemble, with_content
from turnloom.operators.candidates import candidates
from turnloom.operators.metrics import confusion, label_metrics, one_row_join, ratio, routing_accuracy, win_buckets
from turnloom.operators.ordered import dense_ordinal, exact_quantiles, running
from turnloom.operators.fifo import fifo_window
from turnloom.operators.select import keep_last_n
from turnloom.operators.turns import (
    answered_turns, first_seen, is_retrievable, turns_since_switch, user_turns, with_facts, with_user_turn,
)

CFG = Settings()


# ------------------------------------------------------------------- contexts
def fact_turns(msgs: DataFrame, cfg: Settings = CFG) -> DataFrame:
    """User turns with expected facts, and whether their topic came up before the query was first asked."""
    f = with_facts(answered_turns(msgs, cfg)).where(F.size("facts") > 0)
    r = is_retrievable(msgs, cfg).select("conv_id", F.col("turn").alias("first_turn"), "retrievable")
    return f.join(r, ["conv_id", "first_turn"], "left")


def assembled_terms(enc: DataFrame, cfg: Settings = CFG, arms: list[dict] | None = None, policy: str = "densest") -> DataFrame:
    """Terms of each assembled context (conv_id, user_turn, arm, content, terms)."""
    a = with_content(assemble(enc, cfg, arms, policy, encoded=True), enc)
    return a.select("conv_id", F.col("q_turn").alias("user_turn"), "arm", "content", T.diagnostic_terms(F.col("content")).alias("ctx_terms"))


def fifo_contexts(msgs: DataFrame, window: int = 4000, cfg: Settings = CFG) -> DataFrame:
    """FIFO context text per user message; only kept messages are fetched."""
    tok = msgs.withColumn("tokens", T.estimate_tokens(F.col("text")))
    f = fifo_window(tok, window, cfg=cfg).join(msgs.where(F.col("role") == "user").select("conv_id", "turn"), ["conv_id", "turn"], "left_semi")
    k = f.select("conv_id", F.col("turn").alias("q"), F.explode("kept").alias("turn"))
    got = k.join(msgs.select("conv_id", "turn", "text"), ["conv_id", "turn"])
    g = got.groupBy("conv_id", F.col("q").alias("turn")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("p"))
    return g.select("conv_id", "turn", F.concat_ws("\n\n", F.transform("p", lambda x: x.text)).alias("content"))


def known_facts(facts: DataFrame, seen: DataFrame) -> DataFrame:
    """Facts already mentioned before the turn, per turn."""
    ex = facts.select("conv_id", "turn", F.explode("facts").alias("term"))
    hit = ex.join(seen, ["conv_id", "term"]).where(F.col("first_turn") < F.col("turn"))
    return hit.groupBy("conv_id", "turn").agg(F.collect_list("term").alias("stated"))


# ----------------------------------------------------------------- diagnostic
def diagnostic_turns(msgs: DataFrame, enc: DataFrame, cfg: Settings = CFG) -> DataFrame:
    """Per answered turn: facts stated before, facts retrieved, ingestion and sentence precision."""
    f = with_facts(answered_turns(msgs, cfg)).where(T.text_or_empty(F.col("answer")) != "")
    stored = msgs.where((F.col("role") == "assistant") & ~T.is_hedge(F.col("text")))
    known = known_facts(f, first_seen(stored, T.diagnostic_terms(F.col("text"))))
    ctx = assembled_terms(enc, cfg)
    ret = is_retrievable(msgs, cfg).select("conv_id", F.col("turn").alias("first_turn"), "retrievable")
    none = F.array().cast("array<string>")
    j = f.join(known, ["conv_id", "turn"], "left").join(ctx, ["conv_id", "user_turn"], "left").join(ret, ["conv_id", "first_turn"], "left")
    j = j.withColumn("stated", F.coalesce("stated", none))
    hits = F.size(F.array_intersect("stated", F.coalesce("ctx_terms", none)))
    n = F.size("stated")
    return j.select(
        "conv_id", "turn", "user_turn", F.size("facts").alias("n_facts"), n.alias("n_stated"), hits.alias("n_hits"),
        F.when(n > 0, hits / n).alias("hit_ratio"), F.when(F.size("facts") > 0, n / F.size("facts")).alias("ingestion_ratio"),
        (~F.col("retrievable")).alias("first_mention"), T.turn_precision(F.col("query"), F.col("content")).alias("precision"),
    )


def retrieval_diagnostic(turns: DataFrame) -> DataFrame:
    measurable = F.col("hit_ratio").isNotNull()
    s = turns.agg(
        F.count("*").alias("sampled_turns"), F.count_if(measurable).alias("measurable_turns"),
        F.count_if(F.col("n_stated") > 0).alias("retrievable_turns"),
        F.avg(F.when(measurable, (F.col("hit_ratio") >= 0.5).cast("double"))).alias("recall"),
        F.avg("ingestion_ratio").alias("ingestion"), F.count_if(measurable & (F.col("ingestion_ratio") == 1.0)).alias("full"),
        F.avg("precision").alias("prec"),
    )
    pct = lambda c: F.round(c * 100.0, 1)
    return s.select(
        "sampled_turns", "measurable_turns", "retrievable_turns",
        (F.col("sampled_turns") - F.col("retrievable_turns")).alias("first_mention_turns"),
        pct(F.col("recall")).alias("retrieval_recall"), pct(F.col("ingestion")).alias("ingestion_rate"),
        pct(ratio(F.col("full"), F.col("measurable_turns"))).alias("ceiling"), pct(F.col("prec")).alias("retrieval_precision"),
    )


# ----------------------------------------------------------------- paired arms
def paired_rows(msgs: DataFrame, enc: DataFrame, window: int = 4000, cfg: Settings = CFG) -> DataFrame:
    """Curated against FIFO context on every retrievable fact turn, with recorded replies for fidelity."""
    f = fact_turns(msgs, cfg).where("retrievable")
    ctx = assembled_terms(enc, cfg).select("conv_id", "user_turn", F.col("content").alias("cur"), "ctx_terms")
    ff = fifo_contexts(msgs, window, cfg).select("conv_id", "turn", F.col("content").alias("fifo"))
    j = f.join(ctx, ["conv_id", "user_turn"], "left").join(ff, ["conv_id", "turn"], "left")
    j = j.withColumn("fifo_terms", T.diagnostic_terms(F.col("fifo")))
    a, b = T.fact_hit(F.col("facts"), F.col("ctx_terms")), T.fact_hit(F.col("facts"), F.col("fifo_terms"))
    r = T.diagnostic_terms(F.col("answer"))
    return j.select(
        "conv_id", "turn", "user_turn", F.size("facts").alias("n_facts"),
        a["hit_ratio"].alias("a_hit"), a["full"].alias("a_full"), b["hit_ratio"].alias("b_hit"), b["full"].alias("b_full"),
        F.coalesce(T.term_share(F.col("ctx_terms"), r), F.lit(0.0)).alias("a_fidelity"),
        F.coalesce(T.term_share(F.col("fifo_terms"), r), F.lit(0.0)).alias("b_fidelity"),
    )


def paired_ab(rows: DataFrame) -> DataFrame:
    s = rows.agg(
        F.avg((F.col("a_hit") >= 0.5).cast("double")).alias("curated_recall"), F.avg((F.col("b_hit") >= 0.5).cast("double")).alias("fifo_recall"),
        F.avg("a_hit").alias("curated_hit"), F.avg("b_hit").alias("fifo_hit"),
        F.avg("a_fidelity").alias("curated_fidelity"), F.avg("b_fidelity").alias("fifo_fidelity"),
        F.avg((F.col("a_fidelity") >= F.col("b_fidelity")).cast("double")).alias("fidelity_ge"),
    )
    return one_row_join(win_buckets(rows), s)


def p3_sufficiency(rows: DataFrame) -> DataFrame:
    return win_buckets(rows).withColumn("status", F.when(F.col("curated_ge_fifo") >= 0.80, "PASS").otherwise("FAIL"))


def p2_pairs(pairs: DataFrame) -> DataFrame:
    ok = (F.col("precision") >= 0.85) & (F.col("recall") >= 0.90)
    return confusion(pairs).withColumn("status", F.when(ok, "PASS").otherwise("FAIL"))


def p6_escalation(pairs: DataFrame, second: float = 0.5) -> DataFrame:
    """Recall gain when pairs near the decision boundary take the second tier's score."""
    conf = F.lit(1.0) - F.least(F.abs(F.col("score") - 0.5) / 0.2, F.lit(1.0))
    unsure = (F.col("score") > 0.3) & (conf < 0.6)
    esc = F.when(unsure, F.lit(second)).otherwise(F.col("score"))
    rel = F.col("relevant")
    s = pairs.agg(
        F.count_if(rel).alias("n_rel"), F.count_if(rel & (F.col("score") > 0.5)).alias("tp1"),
        F.count_if(rel & (esc > 0.5)).alias("tp2"), F.count_if(unsure).alias("n_unsure"), F.count("*").alias("n"),
    )
    s = s.select(
        ratio(F.col("tp1"), F.col("n_rel")).alias("small_recall"), ratio(F.col("tp2"), F.col("n_rel")).alias("escalated_recall"),
        ratio(F.col("n_unsure"), F.col("n")).alias("escalation_rate"),
    )
    gain = F.col("escalated_recall") - F.col("small_recall")
    return s.withColumn("improvement", gain).withColumn("status", F.when((gain >= 0.05) & (F.col("escalation_rate") < 0.15), "PASS").otherwise("FAIL"))


def p8_routing(labels: DataFrame, msgs: DataFrame, cfg: Settings = CFG) -> DataFrame:
    """Share of queries routed as labelled (conv_id, turn, optimal_route)."""
    q = user_turns(msgs, cfg).select("conv_id", "turn", R.route(F.col("text"))["route_to"].alias("predicted"))
    acc = q.join(labels, ["conv_id", "turn"]).agg(F.count("*").alias("n"), F.avg((F.col("predicted") == F.col("optimal_route")).cast("double")).alias("accuracy"))
    return acc.withColumn("status", F.when(F.col("accuracy") >= 0.85, "PASS").otherwise("FAIL"))


# ---------------------------------------------------------------------- sweeps
def p4_decay_sweep(msgs: DataFrame, enc: DataFrame, cfg: Settings = CFG, candidates_: list[float] = V.DECAY_CANDIDATES, domain=None, min_share: float = 1.0
) -> DataFrame:
    """Fact survival per decay multiplier and domain at a fixed budget; all multipliers share one candidate join.

    A turn counts when ``min_share`` of its facts (all by default) were said before.
    """
    f = with_facts(answered_turns(msgs, cfg)).where(F.size("facts") > 0)
    known = known_facts(f, first_seen(msgs, T.diagnostic_terms(F.col("text")))).where(F.size("stated") > 0)
    f = f.join(known, ["conv_id", "turn"]).where(F.size("stated") >= F.size("facts") * min_share)
    cfg = replace(cfg, fixed_budget=cfg.fixed_budget or 1000)
    ctx = assembled_terms(enc, cfg, [{"arm": str(m), "multiplier": m} for m in candidates_])
    j = f.join(ctx, ["conv_id", "user_turn"]).withColumn("domain", F.lit("all") if domain is None else domain)
    s = j.groupBy("domain", F.col("arm").cast("double").alias("multiplier")).agg(
        F.sum(F.size(F.array_intersect("facts", "ctx_terms"))).alias("found"), F.sum(F.size("facts")).alias("expected")
    )
    return s.withColumn("recall", ratio(F.col("found"), F.col("expected")))


def p4_verdict(sweep_rows: DataFrame) -> DataFrame:
    """Per domain: best recall and m90, the largest multiplier with at least 90 % of it."""
    top = sweep_rows.groupBy("domain").agg(F.max("recall").alias("best_recall"), F.min("recall").alias("worst_recall"))
    j = sweep_rows.join(top, "domain")
    return j.groupBy("domain", "best_recall", "worst_recall").agg(
        F.max(F.when(F.col("recall") >= F.col("best_recall") * 0.9, F.col("multiplier"))).alias("m90")
    ).withColumn("flat", F.col("best_recall") - F.col("worst_recall") < 0.01)


def p10_drift(msgs: DataFrame, enc: DataFrame, cfg: Settings = CFG, on: float = 0.1, off: float = 0.99, within: int = 3) -> DataFrame:
    """Fact survival within ``within`` turns after a topic switch, drift reset forced on against off."""
    sw = turns_since_switch(msgs, cfg).where(F.col("turns_since_switch") <= within).select("conv_id", "turn")
    f = with_facts(answered_turns(msgs, cfg)).where(F.size("facts") > 0).join(sw, ["conv_id", "turn"], "left_semi")
    ctx = assembled_terms(enc, cfg, [{"arm": "on", "drift_threshold": on}, {"arm": "off", "drift_threshold": off}])
    j = f.join(ctx, ["conv_id", "user_turn"])
    hit = F.size(F.array_intersect("facts", "ctx_terms"))
    s = j.agg(
        *[F.sum(F.when(F.col("arm") == a, hit).otherwise(0)).alias(f"found_{a}") for a in ("on", "off")],
        F.sum(F.when(F.col("arm") == "on", F.size("facts")).otherwise(0)).alias("expected"),
    )
    s = s.select("expected", *[ratio(F.coalesce(f"found_{a}", F.lit(0)), F.col("expected")).alias(f"reset_{a}_recall") for a in ("on", "off")])
    gain = F.col("reset_on_recall") - F.col("reset_off_recall")
    return s.withColumn("improvement", gain).withColumn("status", F.when(gain >= 0.05, "PASS").otherwise("FAIL"))


def ablation_rows(enc: DataFrame, cfg: Settings = CFG) -> DataFrame:
    """One row per (turn, arm) with the health score of its context; all arms in one job."""
    arms = [{"arm": name, **{k: False for k in off if k != "remembrance"}} for name, off in V.ABLATION_ARMS]
    a = assemble(enc, cfg, arms, encoded=True)
    score = H.pes(used=F.col("used_tokens"), total=F.col("budget"))
    return a.select("conv_id", "q_turn", "arm", "used_tokens", "budget", score["raw"].alias("pes"))


# ----------------------------------------------------------- duplicate policies
def fact_cost(selected: DataFrame, facts: DataFrame) -> DataFrame:
    """Per (conv_id, user_turn): facts present in the selected chunks, and the tokens that carry them.

    ``selected``: conv_id, user_turn, tokens, terms.  A single covering chunk
    counts alone, else all chunks with any fact together.
    """
    j = facts.join(selected, ["conv_id", "user_turn"], "left")
    part = F.coalesce(F.size(F.array_intersect("facts", "terms")), F.lit(0))
    covering = part == F.size("facts")
    g = j.withColumn("part", part).withColumn("covering", covering).groupBy("conv_id", "user_turn").agg(
        F.max("covering").alias("any_cover"), F.min(F.when(F.col("covering"), F.col("tokens"))).alias("cover_cost"),
        F.sum(F.when((F.col("part") > 0) & ~F.col("covering"), F.col("tokens")).otherwise(0)).alias("part_cost"),
        F.size(F.array_distinct(F.flatten(F.collect_list(F.array_intersect("facts", F.coalesce("terms", F.array().cast("array<string>"))))))).alias("n_union"),
        F.max(F.size("facts")).alias("n_facts"),
    )
    full = F.col("n_union") == F.col("n_facts")
    cost = F.when(F.col("any_cover"), F.col("cover_cost")).when(full, F.col("part_cost")).otherwise(0)
    return g.select("conv_id", "user_turn", (F.col("any_cover") | full).alias("hit"), cost.cast("long").alias("fact_tokens"))


def policy_rows(msgs: DataFrame, enc: DataFrame, policy: str, cfg: Settings = CFG, min_share: float = 1.0) -> DataFrame:
    """Per fact turn under one keep policy: facts carried, their token cost and the merges seen."""
    f = with_facts(answered_turns(msgs, cfg)).where(F.size("facts") > 0)
    known = known_facts(f, first_seen(msgs, T.diagnostic_terms(F.col("text"))))
    f = f.join(known, ["conv_id", "turn"]).where(F.size("stated") >= F.size("facts") * min_share).select("conv_id", "user_turn", "facts")
    a = assemble(enc, cfg, policy=policy, encoded=True)
    pos = a.select("conv_id", F.col("q_turn").alias("user_turn"), F.explode("selected").alias("seq"))
    sel = pos.join(enc.select("conv_id", "seq", "tokens", T.diagnostic_terms(F.col("content")).alias("terms")), ["conv_id", "seq"])
    c = fact_cost(sel.select("conv_id", "user_turn", "tokens", "terms"), f)
    merged = a.select("conv_id", F.col("q_turn").alias("user_turn"), (F.col("n_candidates") - F.col("n_survivors")).alias("merges"))
    per_1k = F.when(F.col("hit") & (F.col("fact_tokens") > 0), F.lit(1000.0) / F.col("fact_tokens")).otherwise(0.0)
    return c.join(merged, ["conv_id", "user_turn"], "left").withColumn("per_1k", per_1k)


def p9_duplicates(densest: DataFrame, recency: DataFrame) -> DataFrame:
    """Densest-kept against recency-kept copies, turn by turn."""
    d = densest.select("conv_id", "user_turn", *[F.col(c).alias(f"d_{c}") for c in ("hit", "fact_tokens", "per_1k", "merges")])
    r = recency.select("conv_id", "user_turn", *[F.col(c).alias(f"r_{c}") for c in ("hit", "fact_tokens", "per_1k", "merges")])
    j = d.join(r, ["conv_id", "user_turn"])
    s = j.agg(
        F.count("*").alias("turns"), F.count_if(F.col("d_per_1k") > F.col("r_per_1k")).alias("densest_wins"),
        F.count_if(F.col("r_per_1k") > F.col("d_per_1k")).alias("recency_wins"), F.count_if(F.col("d_per_1k") == F.col("r_per_1k")).alias("ties"),
        F.coalesce(F.sum(F.col("d_merges") + F.col("r_merges")), F.lit(0)).alias("merges"),
        (F.count_if("d_hit") * 1000.0).alias("_dh"), F.sum("d_fact_tokens").alias("densest_fact_tokens"),
        (F.count_if("r_hit") * 1000.0).alias("_rh"), F.sum("r_fact_tokens").alias("recency_fact_tokens"),
    )
    s = s.withColumn("densest_per_1k", F.round(ratio(F.col("_dh"), F.col("densest_fact_tokens"), None), 1)).withColumn(
        "recency_per_1k", F.round(ratio(F.col("_rh"), F.col("recency_fact_tokens"), None), 1)
    )
    ds, rs = ratio(F.col("densest_wins"), F.col("turns")), ratio(F.col("recency_wins"), F.col("turns"))
    status = F.when((F.col("merges") == 0) | (F.col("turns") == 0), "SKIP").when(rs >= 0.55, "FAIL").when(F.abs(ds - rs) <= 0.05, "FAIL").otherwise("PASS")
    return s.withColumn("status", status).drop("_dh", "_rh")


# --------------------------------------------------------------------- archive
def archive_cases(msgs: DataFrame, enc: DataFrame, cfg: Settings = CFG, return_age: int = 15, store_window: int = 10) -> DataFrame:
    """Per (query, earlier reply) of a fact turn: age in messages, tier, relevance, word overlap and score."""
    f = with_facts(answered_turns(msgs, cfg)).where(F.size("facts") > 0)
    f = f.select("conv_id", F.col("user_turn").alias("q_turn"), F.col("turn").alias("q_msg"), "facts", T.words4(F.col("query")).alias("q_words"))
    e = enc.withColumn("terms", T.diagnostic_terms(F.col("content"))).withColumn("c_words", T.words4(F.col("content"))).withColumn("c_msg", F.col("turn"))
    c = candidates(e, cfg, ["terms", "c_words", "c_msg"]).where(F.col("role") == "assistant").join(f, ["conv_id", "q_turn"])
    age = F.col("q_msg") - F.col("c_msg")
    return c.select(
        "conv_id", "q_turn", "seq", age.alias("age"), (age > return_age).alias("in_archive"), (age <= store_window).alias("in_store"),
        F.arrays_overlap("facts", "terms").alias("relevant"), F.size(F.array_intersect("q_words", "c_words")).alias("overlap"), F.col("cosine").alias("score"),
    )


def archive_probe(cases: DataFrame, ks: tuple = (1, 3, 5, 8)) -> DataFrame:
    """Recall@k of lexical archive retrieval on return turns, and how often the gate would fire."""
    w = Window.partitionBy("conv_id", "q_turn").orderBy(F.desc(F.when(F.col("in_archive"), F.col("overlap")).otherwise(-1)), "seq")
    r = cases.withColumn("rank", F.row_number().over(w))
    rel = F.col("in_archive") & F.col("relevant")
    found = F.col("in_archive") & (F.col("overlap") > 0) & F.col("relevant")
    q = r.groupBy("conv_id", "q_turn").agg(
        F.max(rel).alias("is_return"), F.max(rel & (F.col("overlap") > 0)).alias("retrievable"),
        *[F.max(found & (F.col("rank") <= k)).alias(f"hit{k}") for k in ks],
        F.coalesce(F.max(F.when(F.col("in_store"), F.col("score"))), F.lit(1.0)).alias("top_store"),
        F.max(F.when(F.col("in_archive"), F.col("score"))).alias("top_archive"),
        F.max(F.when(F.col("in_store") & F.col("relevant"), F.col("score"))).alias("best_recent"),
    )
    ret = F.col("is_return")
    s = q.agg(
        F.count_if(ret).alias("n_return"), F.count_if(ret & F.col("retrievable")).alias("n_retrievable"),
        *[F.count_if(ret & F.col("retrievable") & F.col(f"hit{k}")).alias(f"h{k}") for k in ks],
        *[F.avg(F.when(ret, (F.col("top_store") < t).cast("double"))).alias(f"gate_{i}") for i, t in enumerate((0.4, 0.5, 0.6, 0.7), 4)],
        F.count_if(~ret & F.col("best_recent").isNotNull()).alias("n_crowding"),
        F.count_if(~ret & (F.col("top_archive") > F.col("best_recent"))).alias("n_crowded"),
    )
    for k in ks:
        s = s.withColumn(f"recall_at_{k}", ratio(F.col(f"h{k}"), F.col("n_retrievable"), None)).drop(f"h{k}")
    return s


def p11_archive(msgs: DataFrame, replays: dict[str, DataFrame], enc: DataFrame, return_turns: DataFrame, n: int = 8, cfg: Settings = CFG) -> DataFrame:
    """Return-turn recall of replays with and without archive, in full and pressed stores, against keep-last-N.

    ``replays`` has full, full_archive, press, press_archive; ``return_turns``
    is (conv_id, user_turn) of the questions that come back to an old topic.
    """
    f = with_facts(answered_turns(msgs, cfg)).where(F.size("facts") > 0).select("conv_id", "turn", "user_turn", "facts")
    ret = return_turns.select("conv_id", "user_turn").distinct().withColumn("is_return", F.lit(True))
    f = f.join(ret, ["conv_id", "user_turn"], "left").withColumn("is_return", F.coalesce("is_return", F.lit(False)))
    terms = enc.select("conv_id", "chunk_id", T.diagnostic_terms(F.col("content")).alias("terms"))
    rows = None
    for arm, r in replays.items():
        sel = r.select("conv_id", F.col("turn").alias("user_turn"), F.explode("selected_ids").alias("chunk_id")).withColumn("arm", F.lit(arm))
        rows = sel if rows is None else rows.unionByName(sel)
    said = rows.join(terms, ["conv_id", "chunk_id"]).select("arm", "conv_id", "user_turn", F.explode("terms").alias("term")).distinct()
    arms = F.explode(F.array(*[F.lit(a) for a in replays]))
    need = f.withColumn("arm", arms).select("arm", "conv_id", "user_turn", "is_return", F.size("facts").alias("n_facts"), F.explode("facts").alias("term"))
    hit = need.join(said.withColumn("got", F.lit(1)), ["arm", "conv_id", "user_turn", "term"], "left").groupBy(
        "arm", "conv_id", "user_turn", "is_return", "n_facts"
    ).agg(F.count("got").alias("present"))
    ok = F.col("present") >= F.greatest(F.lit(1), F.floor(F.col("n_facts") * 0.5))
    s = hit.groupBy("arm").agg(
        F.count_if("is_return").alias("n_return"),
        ratio(F.count_if(F.col("is_return") & ok), F.count_if("is_return")).alias("return_recall"),
        ratio(F.count_if(~F.col("is_return") & ok), F.count_if(~F.col("is_return"))).alias("other_recall"),
    )
    window = keep_last_n(msgs, n, F.col("text"), cfg=cfg).select("conv_id", "turn", T.diagnostic_terms(F.array_join("window", "\n\n")).alias("terms"))
    k = f.join(window, ["conv_id", "turn"]).withColumn("ok", T.half_presence(F.col("facts"), F.col("terms")))
    k = k.agg(
        F.count_if("is_return").alias("n_return"), ratio(F.count_if(F.col("is_return") & F.col("ok")), F.count_if("is_return")).alias("return_recall"),
        ratio(F.count_if(~F.col("is_return") & F.col("ok")), F.count_if(~F.col("is_return"))).alias("other_recall"),
    )
    return s.unionByName(k.withColumn("arm", F.lit("keep_last_n")))


def p11_verdict(rows: DataFrame) -> DataFrame:
    """The four clauses over the per-arm recalls."""
    pick = lambda arm, c: F.max(F.when(F.col("arm") == arm, F.col(c)))
    s = rows.agg(
        pick("press_archive", "return_recall").alias("pa"), pick("press", "return_recall").alias("p"), pick("full_archive", "return_recall").alias("fa"),
        pick("full", "return_recall").alias("f"), pick("full_archive", "other_recall").alias("fao"), pick("full", "other_recall").alias("fo"),
        pick("keep_last_n", "return_recall").alias("k"), F.max("n_return").alias("n"),
    )
    s = s.select(
        ((F.col("n") > 0) & (F.col("pa") >= 0.90) & (F.col("pa") >= F.col("p"))).alias("mechanism"),
        (F.col("fa") >= F.col("f") - 0.05).alias("no_regression"), (F.col("fao") >= F.col("fo") - 0.05).alias("no_crowding"),
        (F.col("pa") >= F.col("k")).alias("beats_keep_last_n"),
    )
    ok = F.col("mechanism") & F.col("no_regression") & F.col("no_crowding") & F.col("beats_keep_last_n")
    return s.withColumn("status", F.when(ok, "PASS").otherwise("FAIL"))


# ------------------------------------------------------------------- baselines
def context_series(msgs: DataFrame, curated: DataFrame, window: int = 1500, cfg: Settings = CFG) -> DataFrame:
    """Per turn the tokens of the curated, FIFO and raw context.  ``curated``: conv_id, user_turn, used_tokens."""
    d = with_user_turn(msgs, cfg).where((F.col("user_turn") >= 1) & F.col("role").isin("user", "assistant"))
    d = d.where((F.col("role") == "user") | (F.col("text") != "")).withColumn("chars", F.length("text"))
    d = running(d, ["conv_id"], "turn", {"n": ("sum", F.lit(1)), "total": ("sum", F.col("chars"))}, block_rows=cfg.block_rows, limit=cfg.longest)
    d = d.withColumn("pos", (F.col("n") - 1).cast("long")).withColumn("tokens", T.estimate_tokens(F.col("text")))
    raw = F.greatest(F.lit(1), F.floor((F.col("total") + (F.col("n") - 1) * 2) / 4))
    q = d.where(F.col("role") == "user").select("conv_id", "pos", "user_turn", raw.alias("raw"))
    kept = fifo_window(d.select("conv_id", "pos", "tokens"), window, order="pos", cfg=cfg).select("conv_id", "pos", "kept")
    ex = q.join(kept, ["conv_id", "pos"]).select("conv_id", F.col("pos").alias("q"), F.explode("kept").alias("pos"))
    size = ex.join(d.select("conv_id", "pos", "chars"), ["conv_id", "pos"]).groupBy("conv_id", F.col("q").alias("pos")).agg(
        F.greatest(F.lit(1), F.floor((F.sum("chars") + (F.count("*") - 1) * 2) / 4)).alias("fifo")
    )
    j = q.join(size, ["conv_id", "pos"]).join(curated, ["conv_id", "user_turn"], "left")
    return j.select("conv_id", F.col("user_turn").cast("int").alias("turn"), F.coalesce("used_tokens", F.lit(0)).alias("curated"), "fifo", "raw")


def token_growth(series: DataFrame) -> DataFrame:
    """Medians per turn bucket; the three columns share one counting pass."""
    b = series.withColumn("turns", H.bucket_label(F.col("turn")))
    long = b.select("turns", F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).cast("long").alias("v")) for c in ("curated", "fifo", "raw")])).alias("e")).select("turns", "e.*")
    m = exact_quantiles(long, ["turns", "what"], "v", {"median": 0.5})
    g = m.groupBy("turns").agg(*[F.round(F.max(F.when(F.col("what") == c, F.col("median"))), 1).alias(f"{c}_median") for c in ("curated", "fifo", "raw")])
    return b.groupBy("turns").agg(F.count("*").alias("n")).join(g, "turns")


def baseline_rollup(calls: DataFrame, max_context: int = 32768, baseline_tps: float = V.BASELINE_TPS) -> DataFrame:
    """Per conversation from recorded calls (conv_id, turn, completion_tokens, latency_ms, prompt_tokens, error)."""
    ok = F.col("error").isNull()
    tps = F.when(F.col("latency_ms") > 0, F.col("completion_tokens") / (F.col("latency_ms") / 1000.0)).otherwise(0.0)
    g = calls.groupBy("conv_id").agg(
        F.count("*").alias("total_turns"), F.coalesce(F.avg(F.when(ok, tps)), F.lit(0.0)).alias("tps"),
        F.coalesce(F.avg(F.when(ok, F.col("latency_ms"))), F.lit(0.0)).alias("lat"),
        F.coalesce(F.max_by(F.when(ok, F.col("prompt_tokens")), F.when(ok, F.col("turn"))), F.lit(0)).alias("last_prompt_tokens"),
        F.coalesce(F.max(F.when(ok, F.col("prompt_tokens"))), F.lit(0)).alias("max_prompt_tokens"),
        F.count_if(F.col("error") == "oom").alias("oom_events"), F.count_if(F.col("error") != "oom").alias("errors"),
    )
    score = H.pes(latency_ms=F.col("lat"), tps=F.col("tps"), baseline_tps=F.lit(baseline_tps), used=F.col("max_prompt_tokens"), total=F.lit(max_context))
    return g.select(
        "conv_id", "total_turns", F.round("tps", 2).alias("avg_tokens_per_sec"), "last_prompt_tokens", "max_prompt_tokens",
        F.round(F.least(F.lit(1.0), F.col("max_prompt_tokens") / max_context), 3).alias("context_utilization"),
        "oom_events", "errors", F.round("lat", 2).alias("avg_latency_ms"), score["composite"].alias("pes"),
    )


def baseline_aggregate(rollup: DataFrame) -> DataFrame:
    avg = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 2)
    return rollup.agg(
        avg("avg_tokens_per_sec").alias("avg_tokens_per_sec"), avg("avg_latency_ms").alias("avg_latency_ms"), avg("pes").alias("avg_pes"),
        avg("context_utilization").alias("avg_context_utilization"), F.sum("oom_events").alias("total_oom_events"),
        F.sum("errors").alias("total_errors"), F.count_if(F.col("oom_events") > 0).alias("with_oom"), F.count("*").alias("conversation_count"),
    )


def run_baselines(msgs: DataFrame, mode: str, window: int = 4000, cfg: Settings = CFG) -> DataFrame:
    """Prompt size of every user turn under the rolling or the FIFO window, beside its recorded reply."""
    tok = msgs.withColumn("tokens", T.estimate_tokens(F.col("text")))
    if mode == "fifo":
        p = fifo_window(tok, window, cfg=cfg).select("conv_id", "turn", F.col("used_tokens").alias("prompt_tokens"))
    else:
        from turnloom.operators.select import rolling_window

        p = rolling_window(tok, cfg).select("conv_id", "turn", "prompt_tokens")
    q = answered_turns(msgs, cfg).select("conv_id", "turn", T.estimate_tokens(F.col("answer")).alias("completion_tokens"))
    return q.join(p, ["conv_id", "turn"])


def p1_throughput(samples: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Early against late tokens per second after dropping turns beyond five times the median time.

    ``samples``: keys, order, gen_ms, tps.
    """
    med = exact_quantiles(samples, keys, "gen_ms", {"median_ms": 0.5})
    clean = samples.join(med, keys).where(F.col("gen_ms") <= F.col("median_ms") * 5.0)
    n_all = samples.groupBy(*keys).agg(F.count("*").alias("n_all"))
    d = dense_ordinal(clean, keys, order)
    n = d.groupBy(*keys).agg(F.count("*").alias("n")).join(n_all, keys)
    half = F.floor(F.col("n") / 2)
    early = F.col("ordinal") < F.least(half, F.lit(10))
    late = F.col("ordinal") >= F.greatest(half, F.col("n") - 10)
    g = d.join(n, keys).groupBy(*keys, "n", "n_all").agg(F.avg(F.when(early, F.col("tps"))).alias("early"), F.avg(F.when(late, F.col("tps"))).alias("late"))
    drift = F.abs(F.col("late") - F.col("early")) / F.col("early")
    status = F.when(F.col("n") < 6, "SKIP").when(drift <= 0.10, "PASS").otherwise("FAIL")
    return g.select(*keys, "n", (F.col("n_all") - F.col("n")).alias("dropped"), F.round("early", 1).alias("early_tps"), F.round("late", 1).alias("late_tps"), drift.alias("drift"), status.alias("status"))


def post_run_pes(turns: DataFrame, labels: DataFrame, decisions: DataFrame, baseline_tps: float = V.BASELINE_TPS) -> DataFrame:
    """Health score of a run from measured turns, judge labels and route decisions.

    ``turns``: total_ms, generation_ms, token_count, budget, completion_tokens.
    """
    t = turns.agg(
        F.avg(F.coalesce("total_ms", F.lit(0.0))).alias("avg_ms"), F.avg(F.col("token_count") / F.greatest("budget", F.lit(1))).alias("util"),
        F.sum("completion_tokens").alias("toks"), (F.sum(F.coalesce("generation_ms", F.lit(0.0))) / 1000.0).alias("secs"), F.count("*").alias("turns"),
    )
    lab = one_row_join(label_metrics(labels), labels.agg(F.count("*").alias("n_labels")))
    s = one_row_join(t, lab, routing_accuracy(decisions))
    tps = F.when((F.col("toks") > 0) & (F.col("secs") > 0), F.col("toks") / F.when(F.col("secs") > 0, F.col("secs")))
    prec = F.when(F.col("n_labels") > 0, F.col("retrieval_precision"))
    score = H.pes(prec, F.col("routing_accuracy"), F.col("avg_ms"), tps, F.lit(baseline_tps), F.col("util"), F.lit(1.0))
    return s.withColumn("s", score).select("turns", F.col("s.composite").alias("pes"), F.col("s.band").alias("band"), F.round("avg_ms", 1).alias("avg_total_ms"),
                                           F.round(F.col("util") * 100.0, 1).alias("avg_context_utilization_pct"), F.round(tps, 1).alias("actual_tps"), "n_labels")


def run_aggregate(turns: DataFrame) -> DataFrame:
    """Whole-run figures (conv_id, pes, total_ms, mode, level)."""
    return turns.agg(
        F.count("*").alias("user_turns"), F.count_distinct("conv_id").alias("conversations"), F.round(F.avg("pes"), 2).alias("avg_pes"),
        F.round(F.min("pes"), 2).alias("min_pes"), F.round(F.avg("total_ms"), 2).alias("avg_total_ms"),
        F.count_if(F.col("mode") == "fifo_fallback").alias("fifo_fallbacks"), F.count_if(F.col("level") >= 1).alias("degraded_turns"),
    )


def e2e_turns(assembled: DataFrame) -> DataFrame:
    """Per-turn rows of an end-to-end report; health counts the budget use, the one measure batch rows have."""
    util = F.col("used_tokens") / F.greatest("budget", F.lit(1))
    score = H.pes(used=F.col("used_tokens"), total=F.col("budget"))
    return assembled.select("conv_id", F.col("q_turn").alias("turn"), "route", "used_tokens", "budget", util.alias("utilization"), "drift_detected", score["raw"].alias("pes"))


def e2e_aggregate(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(
        F.count("*").alias("user_turns"), F.avg("utilization").alias("avg_utilization"), F.min("pes").alias("pes_min"),
        F.avg("pes").alias("pes_mean"), F.count_if("drift_detected").alias("drift_events"),
    )


def archive_totals(replayed: DataFrame) -> DataFrame:
    return replayed.agg(
        F.sum("archived").alias("archived"), F.sum("resurrected").alias("resurrected"),
        F.count_if(F.col("resurrected") > 0).alias("archive_hits"), F.count_if("gate_fired").alias("gate_fired"),
    )


def ttft_stats(turns: DataFrame) -> DataFrame:
    """Probes, median, min and max of the first-token time."""
    d = turns.where(F.col("ttft_ms").isNotNull())
    s = d.agg(F.count("*").alias("probes"), F.min("ttft_ms").alias("ttft_min"), F.max("ttft_ms").alias("ttft_max"))
    return one_row_join(s, exact_quantiles(d, [], "ttft_ms", {"ttft_median": 0.5}))


def protocol_table(jobs: dict[str, DataFrame]) -> DataFrame:
    """Verdict rows of the protocol jobs (each has one row with ``status``)."""
    out = None
    for name, df in jobs.items():
        row = df.select(F.lit(name).alias("id"), F.col("status"))
        out = row if out is None else out.unionByName(row)
    return out


def protocol_counts(table: DataFrame) -> DataFrame:
    return table.agg(F.count_if(F.col("status") == "PASS").alias("passes"), F.count("*").alias("total"))

"""Reply gate: grade replies before they enter the store."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.config import Settings
from turnloom.functions import text as T
from turnloom.operators.metrics import one_row_join
from turnloom.operators.turns import answer_map
from turnloom.session import checkpointed

CFG = Settings()


def decide(hedge: Column, ratio: Column, n_facts: Column, n_new: Column, cfg: Settings = CFG) -> Column:
    """struct(decision, reason) of one reply; ``n_facts`` imprint facts, ``n_new`` terms beyond the query."""
    decision = (
        F.when(hedge, "reject")
        .when((n_facts > 0) & (ratio >= cfg.gate_accept), "accept")
        .when((n_facts > 0) & (ratio < cfg.gate_flag), "reject")
        .when(n_facts > 0, "flag")
        .when(n_new >= cfg.gate_floor, "accept")
        .otherwise("reject")
    )
    reason = (
        F.when(hedge, "rule_hedge")
        .when((n_facts > 0) & (ratio >= cfg.gate_accept), "copy")
        .when((n_facts > 0) & (ratio < cfg.gate_flag), "not_copy")
        .when(n_facts > 0, "borderline")
        .when(n_new >= cfg.gate_floor, "substantive_first_mention")
        .otherwise("thin")
    )
    return F.struct(decision.alias("decision"), reason.alias("reason"))


def fixture_imprint(msgs: DataFrame, cfg: Settings = CFG) -> DataFrame:
    """Expected facts per (conversation, query): terms of the known answer beyond the query."""
    m = answer_map(msgs, cfg)
    known = T.text_or_empty(F.col("answer")) != ""
    facts = F.when(known, T.fact_terms(F.col("query"), F.col("answer"), T.gate_terms)).otherwise(F.array().cast("array<string>"))
    return m.select("conv_id", "query_key", facts.alias("imprint"))


def confirmation_gate(ex: DataFrame, imprint: DataFrame, cfg: Settings = CFG) -> DataFrame:
    """Grade each (query, reply) against fixed expected facts.  Stateless: one join."""
    d = ex.where(T.text_or_empty(F.col("reply")) != "").withColumn("query_key", F.md5("query"))
    j = d.join(imprint, ["conv_id", "query_key"], "left")
    none = F.array().cast("array<string>")
    j = j.withColumn("imprint", F.coalesce("imprint", none)).withColumn("reply_terms", T.gate_terms(F.col("reply")))
    j = j.withColumn("reply_facts", F.array_except("reply_terms", T.gate_terms(F.col("query"))))
    n = F.size("imprint")
    stated = F.size(F.array_intersect("reply_terms", "imprint"))
    j = j.withColumn("imprint_facts", n).withColumn("ratio", F.when(n > 0, stated / n)).withColumn("rule_hedge", T.is_hedge(F.col("reply")))
    g = decide(F.col("rule_hedge"), F.col("ratio"), F.col("imprint_facts"), F.size("reply_facts"), cfg)
    return j.withColumn("g", g).select(
        "conv_id", "turn", "query", "reply", "imprint_facts", "ratio", "rule_hedge", "reply_facts", "imprint",
        F.col("g.decision").alias("decision"), F.col("g.reason").alias("reason"),
    )


DIGEST_SCHEMA = "turn long, decision string, reason string, ratio double, imprint_facts int, n_new int"
DIGEST_COLS = ["turn", "decision", "reason", "ratio", "imprint_facts", "n_new"]


def walk_block(rows: pd.DataFrame, known: set[str], n: int, cfg: Settings = CFG) -> list[tuple]:
    """Decisions over a block's replies in order.

    ``n`` facts are confirmed before the block; ``known`` are those of them that its replies mention, which is all a decision needs.
    """
    out = []
    for r in rows.sort_values("turn", kind="stable").itertuples(index=False):
        new = list(r.new_terms)
        ratio = len(known.intersection(r.reply_terms)) / n if n else None
        if r.hedge:
            got = ("reject", "rule_hedge")
        elif n:
            got = ("accept", "copy") if ratio >= cfg.gate_accept else ("reject", "not_copy") if ratio < cfg.gate_flag else ("flag", "borderline")
        else:
            got = ("accept", "substantive_first_mention") if len(new) >= cfg.gate_floor else ("reject", "thin")
        out.append((r.turn, *got, ratio, n, len(new)))
        if got[0] == "accept":
            n += len(set(new) - known)
            known.update(new)
    return out


def digest_gate(ex: DataFrame, cfg: Settings = CFG) -> DataFrame:
    """Grade replies against the facts of earlier *accepted* replies.

    Each decision depends on those before it.  Conversations are cut into blocks of ``block_rows`` messages that run in parallel, each from a
    guess of what earlier blocks confirmed.  From the decisions comes a first-mention table (conversation, term, first accepting block); it
    gives each block the number of facts before it and those among its own terms.  Blocks for which that differs from their guess run again, until
    none does: the walk's own result, as the first block starts right and each block is right once all before it are.  A round
    writes the blocks that ran; no task holds more than a block and its own terms.
    """
    none = F.array().cast("array<string>")
    d = ex.where(T.text_or_empty(F.col("reply")) != "")
    d = d.withColumn("reply_terms", T.gate_terms(F.col("reply"))).withColumn("hedge", T.is_hedge(F.col("reply")))
    d = d.withColumn("new_terms", F.array_except("reply_terms", T.gate_terms(F.col("query"))))
    block = F.floor(F.col("turn") / cfg.block_rows).cast("long").alias("block")
    rows = checkpointed(d.select("conv_id", block, F.col("turn").cast("long").alias("turn"), "hedge", "reply_terms", "new_terms"))
    keys = ["conv_id", "block"]
    mentions = checkpointed(rows.select(*keys, F.explode("reply_terms").alias("term")).distinct())
    schema = f"conv_id {ex.schema['conv_id'].dataType.simpleString()}, block long, {DIGEST_SCHEMA}"

    def run(key, replies: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        known, n = (set(start["known"].iloc[0]), int(start["n"].iloc[0])) if len(start) else (set(), 0)
        out = pd.DataFrame(walk_block(replies, known, n, cfg) if len(start) else [], columns=DIGEST_COLS)
        out.insert(0, "block", key[1])
        out.insert(0, "conv_id", key[0])
        return out

    def decided(starts: DataFrame) -> DataFrame:
        """Decisions of the blocks in ``starts``."""
        own = starts.select(*[F.col(c).alias(c) for c in (*keys, "n", "known")])
        asked = rows.join(own, keys, "left_semi").select(*[F.col(c).alias(c) for c in rows.columns])
        return checkpointed(asked.groupBy(*keys).cogroup(own.groupBy(*keys)).applyInPandas(run, schema))

    starts = checkpointed(rows.select(*keys).distinct().select(*keys, F.lit(0).cast("long").alias("n"), none.alias("known")))
    done = decided(starts)
    while True:
        accepted = done.where("decision = 'accept'").select("conv_id", "turn")
        # a fact counts from the block after the one that first accepts it
        first = rows.join(accepted, ["conv_id", "turn"], "left_semi").select("conv_id", "block", F.explode("new_terms").alias("term"))
        first = checkpointed(first.groupBy("conv_id", "term").agg(F.min("block").alias("first_block")))
        # one row a block
        added = first.groupBy("conv_id", F.col("first_block").alias("block")).agg(F.count("*").alias("c"))
        before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        counts = starts.select(*keys).join(added, keys, "left").select(*keys, F.coalesce(F.sum("c").over(before), F.lit(0)).alias("n"))
        met = mentions.join(first, ["conv_id", "term"]).where(F.col("first_block") < F.col("block")).groupBy(*keys).agg(F.array_sort(F.collect_list("term")).alias("known"))
        now = checkpointed(counts.join(met, keys, "left").select(*keys, "n", F.coalesce("known", none).alias("known")))
        wrong = now.join(starts.select(*keys, F.col("n").alias("n0"), F.col("known").alias("known0")), keys).where("n <> n0 or known <> known0").select(*keys, "n", "known")
        wrong = checkpointed(wrong)
        if wrong.isEmpty():
            return done.drop("block")
        done = done.join(wrong.select(*keys), keys, "left_anti").unionByName(decided(wrong))
        starts = now


def gate_summary(decisions: DataFrame) -> DataFrame:
    def n(cond):
        return F.count_if(cond)

    d, r = F.col("decision"), F.col("reason")
    return decisions.agg(
        n(d == "accept").alias("accepted"), n(d == "reject").alias("rejected"), n(d == "flag").alias("flagged"),
        n(r == "rule_hedge").alias("rule_hedge_rejects"), n(r == "thin").alias("thin_rejects"),
        n(F.col("rule_hedge") & (d != "reject")).alias("stored_refusals"),
        F.round(F.avg("ratio"), 3).alias("mean_ingestion_ratio"),
    )


def _ingested(replies: DataFrame, expected: DataFrame, keys: list[str], name: str) -> DataFrame:
    said = replies.select("conv_id", F.explode(T.gate_words(F.col("reply"))).alias("fact")).select(*keys, "fact").distinct()
    return expected.join(said, [*keys, "fact"], "left_semi").groupBy(*keys).agg(F.count("*").alias(name))


def ingestion_rate(decisions: DataFrame) -> DataFrame:
    """Share of expected facts present in stored replies, per conversation, rule filter (a) against gate (b)."""
    expected = decisions.select("conv_id", F.explode("imprint").alias("fact")).distinct()
    a = decisions.where(~F.col("rule_hedge"))
    b = decisions.where(F.col("decision").isin("accept", "flag"))
    total = expected.groupBy("conv_id").agg(F.count("*").alias("expected_facts"))
    counts = decisions.groupBy("conv_id").agg(
        F.count_if(~F.col("rule_hedge")).alias("stored_a"),
        F.count_if(F.col("decision").isin("accept", "flag")).alias("stored_b"),
        F.count_if(F.col("rule_hedge") & F.col("decision").isin("accept", "flag")).alias("refusals_b"),
    )
    out = total.join(counts, "conv_id").join(_ingested(a, expected, ["conv_id"], "_a"), "conv_id", "left").join(
        _ingested(b, expected, ["conv_id"], "_b"), "conv_id", "left"
    )
    for s in ("a", "b"):
        out = out.withColumn(f"ingestion_{s}", F.coalesce(f"_{s}", F.lit(0)) / F.col("expected_facts"))
    return out.drop("_a", "_b")


def gate_ab(decisions: DataFrame) -> DataFrame:
    """Hedge rule against gate over the distinct union of expected facts, with the verdict."""
    expected = decisions.select(F.explode("imprint").alias("fact")).distinct()
    with_facts = decisions.select("conv_id", F.explode("imprint")).select("conv_id").distinct()
    scoped = decisions.join(with_facts, "conv_id", "left_semi")
    said = scoped.select(
        F.explode(T.gate_words(F.col("reply"))).alias("fact"), ~F.col("rule_hedge"),
        F.col("decision").isin("accept", "flag"),
    ).toDF("fact", "in_a", "in_b").groupBy("fact").agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    f = expected.join(said, "fact", "left").agg(
        F.count("*").alias("imprint_facts_total"), F.count_if("in_a").alias("hit_a"), F.count_if("in_b").alias("hit_b")
    )
    s = scoped.agg(
        F.count_if(~F.col("rule_hedge")).alias("stored_a"),
        F.count_if(F.col("decision").isin("accept", "flag")).alias("stored_b"),
        F.count_if(F.col("rule_hedge") & F.col("decision").isin("accept", "flag")).alias("refusals_b"),
    )
    j = one_row_join(f, s)
    den = F.greatest("imprint_facts_total", F.lit(1))
    j = j.withColumn("ingestion_a", F.col("hit_a") / den).withColumn("ingestion_b", F.col("hit_b") / den)
    ok = (F.col("imprint_facts_total") > 0) & (F.col("ingestion_b") >= F.col("ingestion_a")) & (F.col("refusals_b") <= 0)
    return j.withColumn("refusals_a", F.lit(0)).withColumn("hypothesis_supported", ok).drop("hit_a", "hit_b")


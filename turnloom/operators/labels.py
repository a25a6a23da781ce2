"""Labellers: topics, pairs, routes, evictions, judge prompts, router training."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.config import Settings
from turnloom.functions import fixed as V
from turnloom.functions import routing as R
from turnloom.functions import text as T
from turnloom.operators.candidates import candidates
from turnloom.operators.turns import answered_turns, user_turns, with_facts

CFG = Settings()


def with_topic(msgs: DataFrame, topics: dict | None = None) -> DataFrame:
    return msgs.withColumn("topic", R.topic_of(F.col("text"), topics))


def needed_later(msgs: DataFrame, topics: dict | None = None) -> DataFrame:
    """Per assistant message: does a later user message have its topic?  One maximum per (conversation, topic)."""
    t = with_topic(msgs, topics)
    last = t.where((F.col("role") == "user") & F.col("topic").isNotNull()).groupBy("conv_id", "topic").agg(F.max("turn").alias("last_asked"))
    j = t.where(F.col("role") == "assistant").join(last, ["conv_id", "topic"], "left")
    return j.select("conv_id", "turn", "topic", F.col("text").alias("chunk"), F.coalesce(F.col("last_asked") > F.col("turn"), F.lit(False)).alias("needed_later"))


def label_pairs(msgs: DataFrame, n: int = 200, topics: dict | None = None) -> DataFrame:
    """The first ``n`` (query, chunk, relevant) pairs: conversations in order, per query same-topic chunks first.

    Every query that has a partner gives at least one pair, so ``n`` queries
    and, per conversation and topic, ``n`` chunks hold all the pairs needed.
    """
    t = with_topic(msgs, topics).where(F.col("topic").isNotNull())
    c = t.where(F.col("role") == "assistant").select("conv_id", F.col("turn").alias("c_turn"), F.col("topic").alias("c_topic"), F.col("text").alias("chunk"))
    q = t.where(F.col("role") == "user").select("conv_id", F.col("turn").alias("q_turn"), F.col("topic").alias("q_topic"), F.col("text").alias("query"))
    q = q.join(c.select("conv_id").distinct(), "conv_id", "left_semi").orderBy("conv_id", "q_turn").limit(n)
    c = c.join(F.broadcast(q.select("conv_id").distinct()), "conv_id", "left_semi")
    rn = F.row_number().over(Window.partitionBy("conv_id", "c_topic").orderBy("c_turn"))
    c = c.withColumn("_rn", rn).where(F.col("_rn") <= n).drop("_rn")
    p = q.join(c, "conv_id").withColumn("relevant", F.col("q_topic") == F.col("c_topic"))
    return p.orderBy("conv_id", "q_turn", F.desc("relevant"), "c_turn").limit(n)


def fair_pair_sample(pairs: DataFrame, n: int, seed: int, key: list[str]) -> DataFrame:
    """``n`` pairs in a seeded shuffle: the md5 of (seed, key) orders them."""
    h = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), *[F.col(k).cast("string") for k in key]))
    return pairs.withColumn("_h", h).orderBy("_h", *key).limit(n).drop("_h")


def label_routes(msgs: DataFrame, cfg: Settings = CFG) -> DataFrame:
    q = user_turns(msgs, cfg)
    return q.select("conv_id", "turn", F.col("text").alias("query"), R.route(F.col("text"))["route_to"].alias("optimal_route"))


def causal_pairs(msgs: DataFrame, enc: DataFrame, cfg: Settings = CFG) -> DataFrame:
    """Query x earlier stored reply, relevant iff they share an expected fact; ``score`` is the first-tier score."""
    facts = with_facts(answered_turns(msgs, cfg)).where(F.size("facts") > 0).select("conv_id", F.col("user_turn").alias("q_turn"), "facts")
    terms = enc.withColumn("terms", T.diagnostic_terms(F.col("content")))
    c = candidates(terms, cfg, ["terms"]).where(F.col("role") == "assistant")
    j = c.join(facts, ["conv_id", "q_turn"])
    return j.select(
        "conv_id", "q_seq", "q_turn", "seq", "user_turn", F.col("base").alias("score"), "cosine",
        F.arrays_overlap("facts", "terms").alias("relevant"),
    )


def training_positives(pairs: DataFrame) -> DataFrame:
    return pairs.where("relevant")


def global_answer_facts(msgs: DataFrame, cfg: Settings = CFG) -> DataFrame:
    """query -> expected facts over all conversations, one row per (query, fact)."""
    f = with_facts(answered_turns(msgs, cfg)).where(F.size("facts") > 0)
    return f.select(F.md5("query").alias("query_key"), F.explode("facts").alias("fact")).distinct()


def subchunk_pairs(pairs: DataFrame, facts: DataFrame, key: list[str], max_len: int = 600) -> DataFrame:
    """Pairs at unit level, relabelled: a unit is relevant iff it holds an expected fact of its query."""
    u = pairs.withColumn("query_key", F.md5("query")).select(*key, "query_key", F.posexplode(T.subchunk(F.col("chunk"), max_len)).alias("unit_no", "unit"))
    hit = (
        u.select(*key, "unit_no", "query_key", F.explode(T.diagnostic_terms(F.col("unit"))).alias("fact"))
        .join(facts, ["query_key", "fact"], "left_semi").select(*key, "unit_no").distinct().withColumn("relevant", F.lit(True))
    )
    return u.join(hit, [*key, "unit_no"], "left").withColumn("relevant", F.coalesce("relevant", F.lit(False)))


def item_sample(live: DataFrame, fixture: DataFrame, n: int, seed: int, key: list[str], live_share: float = 0.6) -> DataFrame:
    """``n`` items: all of ``live`` up to its share first, topped up from ``fixture``, shuffled and numbered."""
    cols = [*key, "query", "chunk", "relevant"]
    a = live.orderBy(*key).limit(n).select(*cols, F.lit("live").alias("source"), F.lit(0).alias("_src"))
    b = fixture.orderBy(*key).limit(n).select(*cols, F.lit("fixture").alias("source"), F.lit(1).alias("_src"))
    n_live = int(n * live_share)
    a = a.orderBy(*key).limit(n_live)
    items = a.unionByName(b).orderBy("_src", *key).limit(n)
    h = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), "source", *[F.col(k).cast("string") for k in key]))
    # n rows only: the sample itself bounds this window
    w = Window.partitionBy(F.lit(0)).orderBy(h, "source", *key)
    return items.withColumn("item_id", F.format_string("item_%04d", F.row_number().over(w) - 1)).drop("_src")


def judge_prompts(turns: DataFrame) -> DataFrame:
    """The evaluation prompt per turn (context, query, reply); replies come back through ``parse_judge_json``."""
    head, mid1, mid2, tail = V.JUDGE_PROMPT.split("%s")
    return turns.withColumn(
        "prompt", F.concat(F.lit(head), F.col("context"), F.lit(mid1), F.col("query"), F.lit(mid2), F.col("reply"), F.lit(tail))
    )


def router_pipeline():
    """Decision tree of depth 5 over the six router features."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    return Pipeline(
        stages=[
            VectorAssembler(inputCols=R.FEATURES, outputCol="features"),
            StringIndexer(inputCol="optimal_route", outputCol="label", handleInvalid="keep"),
            DecisionTreeClassifier(maxDepth=5, seed=0),
        ]
    )


def train_router(features: DataFrame):
    return router_pipeline().fit(features)


def predict_router(model, features: DataFrame) -> DataFrame:
    labels = model.stages[1].labels
    names = F.array(*[F.lit(x) for x in labels])
    return model.transform(features).withColumn("predicted_route", F.get(names, F.col("prediction").cast("int")))


def mlm_mask(texts: DataFrame, key: str, targeted: bool = False, p: float = 0.15, seed: int = 0) -> DataFrame:
    """Mark words for masking: 80 % mask, 10 % random word, 10 % kept.

    A seeded hash of (text id, position) stands in for a random generator, so
    a retried task masks the same words.  ``targeted`` masks domain words only.
    """
    d = texts.select(key, F.posexplode(T.word_list(F.col("text"))).alias("pos", "word"))

    def draw(salt):
        h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), F.col(key).cast("string"), F.col("pos").cast("string")))
        return F.conv(F.substring(h, 1, 7), 16, 10).cast("double") / float(16**7)

    if targeted:
        vocab = T.string_list(T.DEFAULT_VOCAB)
        domain = T.bind(F.col("word"), lambda w: F.exists(vocab, lambda t: F.contains(t, w) | F.contains(w, t)))
    else:
        domain = F.lit(True)
    # the draw first: only words it picks are held against the vocabulary
    masked = (draw("pick") < p) & domain
    kind = draw("kind")
    action = F.when(~masked, "none").when(kind < 0.8, "mask").when(kind < 0.9, "random").otherwise("keep")
    return d.select(key, "pos", "word", masked.alias("masked"), action.alias("action"))


def word_ids(texts: DataFrame, key: str, length: int = 128, vocab_size: int = 30000) -> DataFrame:
    """Successive sequences of ``length`` token ids that cover a text, the last one padded; ids are word hashes unless a tokenizer is plugged in."""
    ids = F.transform(T.word_list(F.col("text")), lambda w: (F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("long") % (vocab_size - 1) + 1).cast("int"))
    d = texts.where(T.strip(F.col("text")) != "").select(key, ids.alias("ids"))
    parts = F.greatest(F.lit(1), F.ceil(F.size("ids") / length).cast("int"))
    d = d.select(key, "ids", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return d.select(key, "part", T.pad_tokens(F.slice("ids", F.col("part") * length + 1, F.lit(length)), length).alias("token_ids"))

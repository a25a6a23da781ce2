"""Retrieval metrics, label metrics, comparisons and tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions import fixed as V
from turnloom.functions import routing as R
from turnloom.functions import text as T
from turnloom.operators.ordered import exact_quantiles, ranged_running_sum

KS = [1, 3, 5, 8, 10]


def row_value(one_row: DataFrame) -> Column:
    """The columns of a one-row frame as a struct, through a scalar subquery."""
    return one_row.select(F.struct(*[F.col(c) for c in one_row.columns]).alias("s")).scalar()


def one_row_join(*frames: DataFrame) -> DataFrame:
    """Single-row aggregates side by side."""
    out = frames[0]
    for f in frames[1:]:
        out = out.withColumn("_s", row_value(f)).select("*", "_s.*").drop("_s")
    return out


def ratio(num: Column, den: Column, empty: float | None = 0.0) -> Column:
    return F.when(den > 0, num / F.when(den > 0, den)).otherwise(F.lit(empty).cast("double"))


def confusion(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """tp / fp / fn, precision and recall of ``score > threshold`` against ``relevant``."""
    p, r = F.col("score") > threshold, F.col("relevant")
    c = pairs.agg(
        F.count_if(p & r).alias("tp"), F.count_if(p & ~r).alias("fp"), F.count_if(~p & r).alias("fn"), F.count("*").alias("pairs")
    )
    return c.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn(
        "recall", ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    )


def topk_metrics(pairs: DataFrame, query: list[str], tie: list[str], ks: list[int] = KS) -> DataFrame:
    """Mean precision@k and recall@k over queries.

    Queries with fewer than two candidates or no relevant one are left out,
    and for each k those with fewer than k.  Only the first max(ks) rows of a
    query survive the ranking, map side first.
    """
    size = pairs.groupBy(*query).agg(F.count("*").alias("n"), F.count_if("relevant").alias("n_rel"))
    size = size.where((F.col("n") >= 2) & (F.col("n_rel") > 0))
    w = Window.partitionBy(*query).orderBy(F.desc("score"), *tie)
    top = pairs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max(ks))
    hits = top.groupBy(*query).agg(
        *[F.count_if(F.col("relevant") & (F.col("_rn") <= k)).alias(f"h{k}") for k in ks]
    )
    per_k = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("hit")) for k in ks])
    j = size.join(hits, query).select(*query, "n", "n_rel", F.explode(per_k).alias("e"))
    j = j.select("n", "n_rel", "e.k", "e.hit").where(F.col("n") >= F.col("k"))
    return j.groupBy("k").agg(
        F.round(F.avg(F.col("hit") / F.col("k")), 4).alias("precision"),
        F.round(F.avg(F.col("hit") / F.col("n_rel")), 4).alias("recall"),
        F.count("*").alias("queries"),
    )


def threshold_curve(pairs: DataFrame, order: list[str], floor: float = 0.90) -> DataFrame:
    """Every score as a threshold: precision and recall, and the best precision at recall >= ``floor``.

    One distributed sort and running counts in place of a scan per threshold.
    Equal scores are separated by ``order``.
    """
    d = pairs.withColumn("_all", F.lit(0))
    cum = ranged_running_sum(
        d, ["_all"], ["score", *order],
        {"seen": F.lit(1), "seen_rel": F.when(F.col("relevant"), 1).otherwise(0)},
    )
    tot = pairs.agg(F.count("*").alias("n"), F.count_if("relevant").alias("n_rel"))
    j = cum.withColumn("_t", row_value(tot)).select("*", "_t.*")
    # rows from this one upward are predicted relevant
    tp = F.col("n_rel") - F.col("seen_rel") + F.when(F.col("relevant"), 1).otherwise(0)
    above = F.col("n") - F.col("seen") + 1
    j = j.withColumn("precision", tp / above).withColumn("recall", ratio(tp, F.col("n_rel")))
    ok = (F.col("n_rel") > 0) & (F.col("n_rel") < F.col("n"))
    best = F.max(F.when(F.col("recall") >= floor, F.struct("precision", (-F.col("seen")).alias("early"), "score", "recall")))
    return j.where(ok).groupBy("n", "n_rel").agg(best.alias("b")).select(
        F.col("n").alias("n_pairs"), F.col("n_rel").alias("n_relevant"), (F.col("n") - F.col("n_rel")).alias("n_irrelevant"),
        F.round("b.precision", 4).alias("best_precision"), F.round("b.score", 4).alias("best_threshold"),
        F.round("b.recall", 4).alias("best_recall"),
    )


def score_distribution(pairs: DataFrame) -> DataFrame:
    q = exact_quantiles(pairs, ["relevant"], "score", {"p50": 0.5})
    m = pairs.groupBy("relevant").agg(F.avg("score").alias("mean"), F.count("*").alias("n"))
    return m.join(q, "relevant").select("relevant", F.round("mean", 4).alias("mean"), F.round("p50", 4).alias("p50"), "n")


# ------------------------------------------------------------- ground truth
def newest(df: DataFrame, n: int = 100, by: str = "id") -> DataFrame:
    """The newest ``n`` rows: a top-n per task, then one of n rows each."""
    return df.orderBy(F.desc(by)).limit(n)


def label_metrics(labels: DataFrame, n: int = 100) -> DataFrame:
    """Retrieval precision, recall and false-eviction rate in percent over the newest ``n`` labels."""
    p, a = F.col("predicted_relevant"), F.col("actually_relevant")
    pct = lambda num, den: ratio(F.count_if(num), F.count_if(den)) * 100.0
    return newest(labels, n).agg(
        pct(p & a, p).alias("retrieval_precision"),
        pct(p & a, a).alias("retrieval_recall"),
        pct(~p & a, ~p).alias("false_eviction_rate"),
    )


def routing_accuracy(decisions: DataFrame, n: int = 100) -> DataFrame:
    d = newest(decisions.where(F.col("decision_type") == "route"), n)
    return d.agg((ratio(F.count_if(F.col("outcome") == "correct"), F.count("*")) * 100.0).alias("routing_accuracy"))


def route_decisions(queries: DataFrame) -> DataFrame:
    """Ground-truth rows for routing: heuristic score, best route, outcome at the default threshold."""
    d = queries.withColumn("r", R.route(F.col("query")))
    score = R.router_score(F.col("r.reason"))
    return d.select(
        "conv_id", "turn", F.lit("route").alias("decision_type"), score.alias("score"), F.col("r.route_to").alias("optimal"),
        F.when(R.route_for(score) == F.col("r.route_to"), "correct").otherwise("wrong").alias("outcome"),
    )


# ----------------------------------------------------------------- agreement
def last_label(ratings: DataFrame) -> DataFrame:
    """item -> label where the last line wins."""
    return ratings.groupBy("item_id").agg(F.max_by("label", "line_no").alias("label"))


def agreement(items: DataFrame, a: DataFrame, b: DataFrame, floor: float = 0.90) -> DataFrame:
    """Share of equal labels of two raters; degenerate queries are left out."""
    clean = items.where(~T.is_degenerate_query(F.col("query"))).select("item_id")
    j = clean.join(a.select("item_id", F.col("label").alias("a")), "item_id").join(b.select("item_id", F.col("label").alias("b")), "item_id")
    out = j.agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same"))
    out = one_row_join(out, items.agg(F.count_if(T.is_degenerate_query(F.col("query"))).alias("n_degenerate")))
    share = ratio(F.col("same"), F.col("n"), None)
    return out.select(
        F.round(share, 4).alias("agreement"), "n", (F.col("n") - F.col("same")).alias("n_discordant"), "n_degenerate",
        F.when(share >= floor, "PASS").otherwise("FAIL").alias("verdict"),
    )


def discordant(items: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    clean = items.where(~T.is_degenerate_query(F.col("query"))).select("item_id")
    j = clean.join(a.select("item_id", F.col("label").alias("label_a")), "item_id").join(
        b.select("item_id", F.col("label").alias("label_b")), "item_id"
    )
    return j.where(F.col("label_a") != F.col("label_b"))


# ------------------------------------------------------------------- A/B etc.
AB_KEYS = ["retrieval_precision", "routing_accuracy", "latency_ms", "context_utilization", "pes"]


def ab_metrics(rows: DataFrame, keys: list[str] = AB_KEYS) -> DataFrame:
    return rows.groupBy("arm").agg(*[F.round(F.avg(k), 3).alias(k) for k in keys])


def tolerance_winner(a: Column, b: Column) -> Column:
    tol = F.greatest(F.greatest(a, b) * 0.02, F.lit(1e-6))
    return F.when(a.isNull() | b.isNull() | (F.abs(a - b) <= tol), "tie").when(a > b, "A").otherwise("B")


def _normal_sf(z: Column) -> Column:
    """Upper tail of the standard normal: the error-function series below z = 2.8, a continued fraction beyond."""
    x = z / F.sqrt(F.lit(2.0))
    one = F.struct(x.alias("term"), x.alias("total"))

    def add(s, k):
        term = -s.term * x * x / k
        return F.struct(term.alias("term"), (s.total + term / (k * 2 + 1)).alias("total"))

    erf = F.aggregate(F.sequence(F.lit(1), F.lit(40)), one, add, lambda s: s.total) * F.lit(1.1283791670955126)
    frac = F.aggregate(F.sequence(F.lit(30), F.lit(1), F.lit(-1)), F.lit(0.0), lambda f, k: k / 2.0 / (x + f))
    tail = F.exp(-(x * x)) / F.lit(1.7724538509055159) / (x + frac)
    return F.when(x > 2.0, tail).otherwise(F.lit(1.0) - erf) / 2.0


def mann_whitney(rows: DataFrame, key: str = "value", alpha: float = 0.05) -> DataFrame:
    """Two-sided U test of arms A and B on ``key``: winner A / B / tie, or none where it cannot run.

    Ranks come from one count per distinct value and a running sum, so samples
    of any size and skew are fine.  Normal approximation with tie and
    continuity correction; small samples without ties use ``exact_u_pvalue``.
    """
    d = rows.where(F.col(key).isNotNull())
    g = d.groupBy(F.col(key).alias("v")).agg(F.count_if(F.col("arm") == "A").alias("na"), F.count("*").alias("n"))
    cum = ranged_running_sum(g.withColumn("_all", F.lit(0)), ["_all"], ["v"], {"upto": F.col("n")})
    mid = F.col("upto") - F.col("n") + (F.col("n") + 1) / 2.0
    s = cum.agg(
        F.sum("na").cast("double").alias("n_a"), F.sum(F.col("n") - F.col("na")).cast("double").alias("n_b"),
        F.sum(mid * F.col("na")).alias("rank_a"),
        F.sum(F.pow(F.col("n").cast("double"), F.lit(3)) - F.col("n")).alias("ties"),
        F.count_if(F.col("na") > 0).alias("distinct_a"), F.count_if(F.col("n") > F.col("na")).alias("distinct_b"),
    )
    means = d.agg(F.avg(F.when(F.col("arm") == "A", F.col(key))).alias("mean_a"), F.avg(F.when(F.col("arm") == "B", F.col(key))).alias("mean_b"))
    s = one_row_join(s, means)
    na, nb = F.col("n_a"), F.col("n_b")
    n = na + nb
    u = F.col("rank_a") - na * (na + 1) / 2.0
    u_max = F.greatest(u, na * nb - u)
    sigma = F.sqrt(na * nb / 12.0 * ((n + 1) - F.col("ties") / F.greatest(n * (n - 1), F.lit(1.0))))
    z = (u_max - na * nb / 2.0 - 0.5) / F.when(sigma > 0, sigma)
    p = F.least(F.lit(1.0), _normal_sf(F.col("z")) * 2.0)
    runs = (na >= 3) & (nb >= 3) & (F.col("distinct_a") >= 2) & (F.col("distinct_b") >= 2)
    s = s.withColumn("u", u).withColumn("z", z).withColumn("p_value", F.when(runs, p))
    win = F.when(~runs, F.lit(None)).when(F.col("p_value") > alpha, "tie").when(F.col("mean_a") > F.col("mean_b"), "A").otherwise("B")
    return s.select(
        na.cast("long").alias("n_a"), nb.cast("long").alias("n_b"), "u", "z", "p_value", win.alias("winner"),
        "mean_a", "mean_b", (F.col("ties") > 0).alias("has_ties"),
    )


def exact_u_pvalue(u: float, n_a: int, n_b: int) -> float:
    """Exact two-sided p of U without ties, for small samples (at most 8 in one arm)."""
    counts = {(0, 0): {0: 1}}
    for i in range(n_a + 1):
        for j in range(n_b + 1):
            if i == j == 0:
                continue
            c: dict[int, int] = {}
            if i:
                for k, v in counts[i - 1, j].items():
                    c[k + j] = c.get(k + j, 0) + v
            if j:
                for k, v in counts[i, j - 1].items():
                    c[k] = c.get(k, 0) + v
            counts[i, j] = c
    dist = counts[n_a, n_b]
    top = max(u, n_a * n_b - u)
    tail = sum(v for k, v in dist.items() if k >= top) / sum(dist.values())
    return min(1.0, 2 * tail)


def ab_winner(test: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Final winner: the exact small-sample p where it applies, the normal one else, the 2 % rule where no test runs.

    ``test`` is the one row of ``mann_whitney``; this last step runs on the driver.
    """
    r = test.first()
    winner, p = r["winner"], r["p_value"]
    if p is not None and not r["has_ties"] and min(r["n_a"], r["n_b"]) <= 8:
        p = exact_u_pvalue(r["u"], r["n_a"], r["n_b"])
        winner = "tie" if p > alpha else ("A" if r["mean_a"] > r["mean_b"] else "B")
    out = test.sparkSession.createDataFrame([(r["mean_a"], r["mean_b"], p, winner)], "mean_a double, mean_b double, p_value double, winner string")
    return out.withColumn("winner", F.coalesce("winner", tolerance_winner(F.col("mean_a"), F.col("mean_b"))))


def ablation_table(rows: DataFrame, key: str = "pes") -> DataFrame:
    """Mean metric per arm and what the full arm gains over it."""
    m = rows.groupBy("arm").agg(F.round(F.avg(key), 3).alias("mean_metric"))
    full = m.where(F.col("arm") == "full").select(F.col("mean_metric").alias("full_metric"))
    j = m.withColumn("full_metric", full.scalar())
    gain = F.when(F.col("arm") != "full", F.col("full_metric") - F.col("mean_metric"))
    return j.select("arm", "mean_metric", F.round(gain, 3).alias("contribution"))


def shadow_eval(log: DataFrame, n: int = 100, margin: float = 0.05) -> DataFrame:
    """Newest ``n`` turns of a shadow log (turn, production, shadow): promote, discard or continue."""
    s = newest(log, n, "turn").agg(
        F.avg("production").alias("pa"), F.avg("shadow").alias("sa"), F.count("*").alias("turns")
    )
    base = F.greatest(F.col("pa"), F.lit(1e-6)) * margin
    none = F.col("pa").isNull() | F.col("sa").isNull()
    rec = F.when(none, "continue").when(F.col("sa") > F.col("pa") + base, "promote").when(F.col("sa") < F.col("pa") - base, "discard").otherwise("continue")
    z = F.lit(0.0)
    return s.select(
        rec.alias("recommend"), F.when(none, z).otherwise(F.col("pa")).alias("production_avg"),
        F.when(none, z).otherwise(F.col("sa")).alias("shadow_avg"),
        F.when(none, z).otherwise(F.col("sa") - F.col("pa")).alias("improvement"),
        F.when(none, 0).otherwise(F.col("turns")).cast("long").alias("turns"),
    )


def win_buckets(rows: DataFrame, a: str = "a_full", b: str = "b_full") -> DataFrame:
    """Paired outcome counts and ratios over turns where at least one arm had the facts."""
    x, y = F.col(a), F.col(b)
    s = rows.agg(
        F.count_if(x & ~y).alias("curated_only"), F.count_if(~x & y).alias("fifo_only"),
        F.count_if(x & y).alias("both"), F.count_if(~x & ~y).alias("neither"), F.count("*").alias("compared"),
    )
    den = F.col("curated_only") + F.col("fifo_only") + F.col("both")
    return s.withColumn("fact_retrievable", den).withColumn(
        "curated_ge_fifo", ratio(F.col("curated_only") + F.col("both"), den)
    ).withColumn("strict_ratio", ratio(F.col("curated_only"), den))


def run_compare(runs: DataFrame, order: str, metrics: list[str], margin: float = 1.0) -> DataFrame:
    """Headline metrics of each run against the first one; a drop beyond ``margin`` points is a regression."""
    first = runs.orderBy(order).limit(1).select(*[F.col(m).alias(f"_b_{m}") for m in metrics])
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.col(f"_b_{m}").cast("double").alias("base")) for m in metrics])
    j = runs.withColumn("_f", row_value(first)).select("*", "_f.*").select(order, F.explode(cells).alias("c"))
    delta = F.col("c.value") - F.col("c.base")
    return j.select(
        order, "c.metric", F.round("c.value", 6).alias("value"), F.round(delta, 6).alias("delta"),
        F.coalesce(delta < -margin, F.lit(False)).alias("regression"),
    )


def bench_gate(current: Column, baseline: Column, threshold: float = 5.0) -> Column:
    return F.when(current - baseline < -threshold, "REGRESSION").otherwise("PASS")


def append_history(history: DataFrame, entry: DataFrame, keep: int = 30) -> DataFrame:
    """Append runs and keep the newest ``keep``."""
    return history.unionByName(entry).orderBy(F.desc("timestamp")).limit(keep)


def sweep(values: DataFrame, candidate: str = "candidate", objective: str = "objective", minimize: bool = True) -> DataFrame:
    """All results of a sweep with the best candidate marked; the first listed wins ties."""
    o = F.col(objective) if minimize else -F.col(objective)
    best = values.agg(F.min_by(candidate, F.struct(o, F.col(candidate))).alias("best"))
    return values.withColumn("is_best", F.col(candidate) == best.scalar())


def replay_decay(labels: DataFrame, candidates: list[float] = V.DECAY_CANDIDATES) -> DataFrame:
    """False-eviction and keep rate of stored labels under each decay multiplier; labels are read once."""
    d = labels.withColumn("max_turn", labels.agg(F.max("turn")).scalar())
    factor = F.least((F.col("max_turn") - F.col("turn")) / 10.0, F.lit(3.0))
    aggs = []
    for i, m in enumerate(candidates):
        kept = F.coalesce("score", F.lit(0.0)) / F.pow(F.lit(m), factor) > V.DECAY_KEEP_THRESHOLD
        aggs += [F.count_if(kept).alias(f"k{i}"), F.count_if(~kept & F.col("actually_relevant")).alias(f"f{i}")]
    s = d.agg(F.count("*").alias("n"), *aggs)
    cells = F.array(*[F.struct(F.lit(m).alias("candidate"), F.col(f"k{i}").alias("kept"), F.col(f"f{i}").alias("wrong")) for i, m in enumerate(candidates)])
    s = s.select("n", F.explode(cells).alias("c")).select("n", "c.*")
    fe, keep = ratio(F.col("wrong"), F.col("n") - F.col("kept")), ratio(F.col("kept"), F.col("n"))
    return s.select("candidate", fe.alias("false_eviction_rate"), keep.alias("keep_rate"), (fe + keep * V.BLOAT_WEIGHT).alias("objective"))


def replay_routing(decisions: DataFrame, candidates: list[int] = V.ROUTING_CANDIDATES) -> DataFrame:
    """Accuracy and second-tier rate of stored route decisions under each threshold."""
    live = F.col("optimal").isNotNull()
    aggs = []
    for i, t in enumerate(candidates):
        pred = R.route_for(F.col("score"), t)
        aggs += [F.count_if(live & (pred == F.col("optimal"))).alias(f"c{i}"), F.count_if(live & (pred == "medium")).alias(f"m{i}")]
    s = decisions.agg(F.count("*").alias("n"), *aggs)
    cells = F.array(*[F.struct(F.lit(t).alias("candidate"), F.col(f"c{i}").alias("correct"), F.col(f"m{i}").alias("medium")) for i, t in enumerate(candidates)])
    s = s.select("n", F.explode(cells).alias("c")).select("n", "c.*")
    acc, med = ratio(F.col("correct"), F.col("n")), ratio(F.col("medium"), F.col("n"))
    return s.select("candidate", acc.alias("accuracy"), med.alias("medium_rate"), (acc - med * V.ROUTING_COST_WEIGHT).alias("objective"))

"""Consensus over evaluations(claim_id, evaluator_id, score, confidence), fusion and scoring: one aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HIGH, MEDIUM = 0.05, 0.15  # population variance below which agreement is high, medium
BOOST, PENALTY = 1.1, 0.85
REVIEW, REJECT = 0.6, 0.5
#: Additive bias of each source of estimates.  Fixed values.
SOURCE_BIAS = {"thought_buffer": 0.0, "adaptive_expansion": 0.02, "collaborative_inference": -0.01, "metacognitive": 0.01, "trm_refinement": 0.0}
#: Default weights of the compound score.  Fixed values.
WEIGHTS = {"relevance": 0.3, "uniqueness": 0.2, "impact": 0.3, "confidence": 0.2}


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _six(c: Column) -> Column:
    """Six places as SQL engines round doubles, scaled in doubles (0.5203125 * 1e6 is under 520312.5), where Spark's round goes by the
    shortest decimal text of the number."""
    return F.round(c * 1e6) / 1e6


def agreement(variance: Column) -> Column:
    return F.when(variance < HIGH, "high").when(variance < MEDIUM, "medium").otherwise("low")


def _weighted() -> Column:
    c = F.sum("confidence")
    return F.when(c < 1e-10, F.avg("score")).otherwise(F.sum(F.col("score") * F.col("confidence")) / F.nullif(c, F.lit(0.0)))


def weighted_average(evaluations: DataFrame) -> DataFrame:
    g = evaluations.groupBy("claim_id").agg(_weighted().alias("s"), F.var_pop("score").alias("v"), F.avg("confidence").alias("c"), F.count("*").alias("n"))
    g = g.withColumn("agreement_level", agreement(F.round("v", 12)))
    level = F.col("agreement_level")
    conf = F.when(level == "high", F.least(F.lit(1.0), F.col("c") * BOOST)).when(level == "low", F.col("c") * PENALTY).otherwise(F.col("c"))
    act = F.when((level == "medium") & (F.col("s") < REVIEW), "flag_for_review").when((level == "low") & (F.col("s") < REJECT), "reject").otherwise("accept")
    return g.select("claim_id", "n", _six(F.col("s")).alias("consensus_score"), _six(conf).alias("consensus_confidence"), "agreement_level", act.alias("resolution"))


def bayesian(evaluations: DataFrame, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """Posterior mean of a Beta prior over scores of at least one half; the interval is ``with_interval``'s."""
    g = evaluations.groupBy("claim_id").agg(F.sum(F.when(F.col("score") >= 0.5, 1).otherwise(0)).alias("yes"), F.count("*").alias("n"), F.var_pop("score").alias("v"))
    score = (F.col("yes") + alpha) / (F.col("n") + alpha + beta)
    g = g.withColumn("agreement_level", agreement(F.round("v", 12)))
    act = F.when(F.col("agreement_level") == "high", "accept").when(F.col("agreement_level") == "low", "re_evaluate").when(score < REVIEW, "flag_for_review").otherwise("accept")
    return g.select(
        "claim_id", (F.col("yes") + alpha).alias("alpha"), (F.col("n") - F.col("yes") + beta).alias("beta"), F.round(score, 6).alias("consensus_score"), "agreement_level", act.alias("resolution")
    )


def with_interval(posterior: DataFrame, level: float = 0.95, places: int = 6) -> DataFrame:
    """Adds lower, upper and consensus_confidence.  The Beta quantile is found by halving on the regularised incomplete
    beta function, by distinct (alpha, beta) only, vectorised over them."""
    pairs = posterior.select("alpha", "beta").distinct()

    def run(batches):
        import numpy as np

        for d in batches:
            a, b = d["alpha"].to_numpy(), d["beta"].to_numpy()
            out = d.copy()
            for name, p in (("lower", (1 - level) / 2), ("upper", 1 - (1 - level) / 2)):
                lo, hi = np.zeros(len(a)), np.ones(len(a))
                for _ in range(60):
                    mid = (lo + hi) / 2
                    under = beta_cdf(mid, a, b) < p
                    lo, hi = np.where(under, mid, lo), np.where(under, hi, mid)
                out[name] = (lo + hi) / 2
            yield out

    q = pairs.mapInPandas(run, "alpha double, beta double, lower double, upper double")
    c = 1 - (F.col("upper") - F.col("lower"))
    c = F.when(F.col("agreement_level") == "high", F.least(F.lit(1.0), c * BOOST)).when(F.col("agreement_level") == "low", c * PENALTY).otherwise(c)
    return posterior.join(q, ["alpha", "beta"]).withColumns({"lower": F.round("lower", places), "upper": F.round("upper", places), "consensus_confidence": F.round(_clamp(c), places)})


def beta_cdf(x, a, b):
    """Regularised incomplete beta function by its continued fraction (Lentz), over numpy arrays."""
    import math

    import numpy as np

    x, a, b = (np.asarray(v, dtype=float) for v in (x, a, b))
    flip = x > (a + 1) / (a + b + 2)
    y = np.where(flip, 1 - x, x)
    p, q = np.where(flip, b, a), np.where(flip, a, b)
    lg = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore"):
        front = np.exp(lg(p + q) - lg(p) - lg(q) + p * np.log(y) + q * np.log1p(-y)) / p
    tiny = 1e-300
    c = np.ones_like(y)
    d = 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    out = front * h
    return np.where(flip, 1 - out, out)


def majority(evaluations: DataFrame, threshold: float = 0.5, acceptance: float = 0.5, tie_breaker: str = "highest_confidence") -> DataFrame:
    """tie_breaker: highest_confidence, random_seeded (first hex digit of the SHA-256 of the sorted scores) or
    escalate_to_debate."""
    yes = F.col("score") >= threshold
    g = evaluations.groupBy("claim_id").agg(
        F.sum(F.when(yes, 1).otherwise(0)).alias("yes"), F.count("*").alias("n"),
        F.coalesce(F.avg(F.when(yes, F.col("confidence"))), F.lit(0.0)).alias("cy"), F.coalesce(F.avg(F.when(~yes, F.col("confidence"))), F.lit(0.0)).alias("cn"),
        F.sort_array(F.collect_list("score")).alias("scores"),
    )
    tie = F.col("yes") * 2 == F.col("n")
    if tie_breaker == "highest_confidence":
        broken = F.col("cy") >= F.col("cn")
    elif tie_breaker == "random_seeded":
        text = F.array_join(F.transform("scores", lambda s: F.format_string("%.6f", s)), ",")
        broken = F.substring(F.sha2(text, 256), 1, 1) >= "8"
    else:
        broken = F.lit(False)
    ratio = F.col("yes") / F.col("n")
    accepted = F.when(tie, broken).otherwise(ratio >= acceptance)
    margin = F.abs(F.col("yes") * 2 - F.col("n")) / F.col("n")
    escalate = tie & F.lit(tie_breaker == "escalate_to_debate")
    act = F.when(escalate, "re_evaluate").when(accepted, "accept").when(margin < 0.2, "flag_for_review").otherwise("reject")
    return g.select(
        "claim_id", "n", "yes", accepted.alias("accepted"), F.round(F.when(accepted, ratio).otherwise(1 - ratio), 6).alias("consensus_score"), F.round(margin, 6).alias("margin"),
        F.when(margin >= 0.8, "high").when(margin >= 0.2, "medium").otherwise("low").alias("agreement_level"), act.alias("resolution"), (~escalate).alias("converged"),
    )


def adaptive_stability(evaluations: DataFrame, threshold: float = 0.1, min_samples: int = 3, max_samples: int = 20) -> DataFrame:
    w = Window.partitionBy("claim_id").orderBy("score", "evaluator_id")
    ranked = evaluations.withColumns({"i": F.row_number().over(w), "m": F.count("*").over(Window.partitionBy("claim_id"))})
    g = ranked.groupBy("claim_id").agg(
        F.count("*").alias("n"), _weighted().alias("s"), F.var_pop("score").alias("v"), F.avg("score").alias("mean"), F.avg("confidence").alias("c"),
        F.max(F.abs(F.col("i") / F.col("m") - F.col("score"))).alias("ks"),
    )
    g = g.withColumns({"ks": F.when(F.col("n") < 2, 0.0).otherwise(F.round("ks", 9)), "v": F.round("v", 9)})
    stable = (F.col("ks") < threshold) | (F.col("v") < 0.02)
    done = stable & (F.col("n") >= min_samples)
    ratio = F.col("mean") * (1 - F.col("mean")) / F.greatest("v", F.lit(1e-10)) - 1
    size = F.ceil(F.round((F.greatest(F.lit(0.1), F.col("mean") * ratio) + F.greatest(F.lit(0.1), (1 - F.col("mean")) * ratio)) / threshold, 6))
    need = F.when(F.col("v") < 1e-10, min_samples).otherwise(F.greatest(F.lit(min_samples), F.least(size, F.lit(max_samples))))
    return g.select(
        "claim_id", _six(F.col("s")).alias("consensus_score"), _six(F.least(F.lit(1.0), F.when(stable, F.col("c") * BOOST).otherwise(F.col("c")))).alias("consensus_confidence"),
        agreement(F.col("v")).alias("agreement_level"), _six(F.col("ks")).alias("ks"), done.alias("converged"), F.when(done, "accept").otherwise("re_evaluate").alias("resolution"),
        F.when(done, 1).otherwise(need).cast("int").alias("iteration_count"),
    )


def route(evaluations: DataFrame, algorithm: str, **options) -> DataFrame:
    """The algorithm by name."""
    return {"weighted_average": weighted_average, "bayesian": bayesian, "majority_voting": majority, "adaptive_stability": adaptive_stability}[algorithm](evaluations, **options)


def fuse(estimates: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """estimates(group_id, source, value, uncertainty) -> point with lower and upper bound."""
    bias = F.lit(0.0)
    weight = F.lit(1.0)
    for s, b in SOURCE_BIAS.items():
        bias = F.when(F.col("source") == s, F.lit(b)).otherwise(bias)
    for s, w in (weights or {}).items():
        weight = F.when(F.col("source") == s, F.lit(w)).otherwise(weight)
    e = estimates.withColumns({"x": _clamp(F.col("value") - bias), "w": weight})
    total = F.sum("w")
    g = e.groupBy("group_id").agg(
        F.when(total < 1e-10, F.avg("x")).otherwise(F.sum(F.col("x") * F.col("w")) / F.nullif(total, F.lit(0.0))).alias("f"),
        F.avg("uncertainty").alias("u"), (F.max("value") - F.min("value")).alias("d"),
    )
    spread = F.col("u") + F.col("d") * 0.5
    agree = F.round(1 - F.col("d"), 9)
    g = g.withColumn("f", F.when((agree > 0.8) & (F.col("f") > 0.7), F.least(F.lit(1.0), F.col("f") + (agree - 0.8) * 0.2)).otherwise(F.col("f")))
    return g.select("group_id", _six(F.col("f")).alias("point"), _six(F.greatest(F.lit(0.0), F.col("f") - spread)).alias("lower"), _six(F.least(F.lit(1.0), F.col("f") + spread)).alias("upper"))


def compound_score(signals: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    w = weights or WEIGHTS
    total = sum(w.values())
    if abs(total) < 1e-10:
        raise ValueError("weights add up to zero")
    s = sum((F.col(k) * (v / total) for k, v in w.items()), F.lit(0.0))
    return signals.withColumn("weighted_total", F.round(s, 10))


def debate(finals: DataFrame, converged: float = 0.05) -> DataFrame:
    """finals(claim_id, evaluator_id, score): mean of the agents' last scores."""
    g = finals.groupBy("claim_id").agg(F.avg("score").alias("m"), F.var_pop("score").alias("v"))
    done = F.round("v", 12) < converged
    return g.select("claim_id", F.round("m", 6).alias("consensus_score"), done.alias("converged"), F.when(done, 0.85).otherwise(0.65).alias("consensus_confidence"))


def debate_round(scores: DataFrame, own: float = 0.6) -> DataFrame:
    """One refinement without a model: own score and the mean of the others."""
    w = Window.partitionBy("claim_id")
    others = (F.sum("score").over(w) - F.col("score")) / F.nullif(F.count("*").over(w) - 1, F.lit(0))
    return scores.withColumn("refined", F.round(F.col("score") * own + F.coalesce(others, F.col("score")) * (1 - own), 6))


def chain_of_verification(answers: DataFrame) -> DataFrame:
    """answers(claim_id, score): verdict from the mean answer score (one half without answers)."""
    m = F.coalesce(F.avg("score"), F.lit(0.5))
    g = answers.groupBy("claim_id").agg(m.alias("m"))
    r = F.round("m", 9)
    return g.select("claim_id", F.round(F.col("m") + 1e-9, 4).alias("score"), F.when(r >= 0.7, "pass").when(r >= 0.4, "inconclusive").otherwise("fail").alias("verdict"), F.round(F.least(F.lit(1.0), F.col("m") * 1.1) + 1e-9, 4).alias("confidence"))


def path_consensus(paths: DataFrame) -> DataFrame:
    """Whether the positive confidences of a claim's paths agree."""
    ok = paths.where("confidence > 0").groupBy("claim_id").agg(F.var_pop("confidence").alias("v"), F.avg("confidence").alias("m"))
    return ok.select("claim_id", ((F.round("v", 12) < 0.02) & (F.round("m", 12) > 0.7)).alias("consensus"))


NLI = {"entailment": (1.0, 1.0), "neutral": (0.6, 0.3), "contradiction": (0.0, 0.0)}  # label -> (lenient, strict).  Fixed values.


def nli_score(label: Column, strict: bool = False) -> Column:
    out = F.lit(None).cast("double")
    for k, v in NLI.items():
        out = F.when(F.lower(label) == k, F.lit(v[int(strict)])).otherwise(out)
    return out


def decay(initial: Column, seen: Column, half_life_days: Column, now: Column) -> Column:
    """Relevance after exponential half-life decay."""
    days = (F.unix_micros(now) - F.unix_micros(seen)) / F.lit(86_400_000_000.0)
    return initial * F.pow(F.lit(0.5), days / half_life_days)


def reinforce(relevance: Column, count: Column) -> Column:
    return F.least(F.lit(1.0), relevance * (1 + 0.05 * (count + 1)))


def budget_level(used: Column, total: Column) -> Column:
    share = used / F.nullif(total, F.lit(0))
    return F.when(share >= 0.93, "l1_config").when(share >= 0.70, "l2_summary").otherwise("l3_full")


def trajectory(scores: DataFrame) -> DataFrame:
    """scores(claim_id, seq, score): at each place what the trajectory so far shows, and the intervention it asks for."""
    w = Window.partitionBy("claim_id").orderBy("seq")
    d1 = F.round(F.col("score") - F.lag("score").over(w), 9)
    d0 = F.round(F.lag("score").over(w) - F.lag("score", 2).over(w), 9)
    s = scores.withColumns({"d1": d1, "d0": d0})
    move = F.when(F.col("score") >= 0.85, "terminate").when(F.col("d1") < -0.1, "switch_strategy").when(F.abs("d1") < 0.01, "trigger_reflection").otherwise("continue")
    return s.select(
        "claim_id", "seq", F.coalesce(F.abs("d1") < 0.02, F.lit(False)).alias("converged"), F.coalesce(F.col("d1") * F.col("d0") < 0, F.lit(False)).alias("oscillates"),
        F.coalesce(F.abs("d1") < 0.01, F.lit(False)).alias("diminishing"), move.alias("intervention"),
    )

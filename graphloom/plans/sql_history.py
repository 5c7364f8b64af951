"""Queries over the history and evaluation projections, with their SQL."""

from __future__ import annotations

from ..operators import consensus as C
from ..operators import history as H
from .projections import cte, frame
from .registry import Registry

q = Registry()


COCHANGE = """, n AS (SELECT file, count(*) AS n FROM commit_files GROUP BY file),
p AS (SELECT a.file AS file_a, b.file AS file_b, count(*) AS support FROM commit_files a JOIN commit_files b ON a.commit_id = b.commit_id AND a.file < b.file GROUP BY 1, 2),
pairs AS (SELECT file_a, file_b, support, round(support * 1.0 / na.n, 4) AS confidence_ab, round(support * 1.0 / nb.n, 4) AS confidence_ba
  FROM p JOIN n na ON na.file = file_a JOIN n nb ON nb.file = file_b
  WHERE support >= 3 AND greatest(support * 1.0 / na.n, support * 1.0 / nb.n) >= 0.1)
"""


@q("g10_cochange_support", cte("commit_files") + """
SELECT a.file AS file_a, b.file AS file_b, count(*) AS support FROM commit_files a JOIN commit_files b ON a.commit_id = b.commit_id AND a.file < b.file
GROUP BY 1, 2 HAVING count(*) >= 2""")
def _(s, d):
    return H.cochange_support(frame(s, d, "commit_files"), 2)


@q("g11_cochange", cte("commit_files") + COCHANGE + "SELECT * FROM pairs")
def _(s, d):
    return H.cochange(frame(s, d, "commit_files"), 3, 0.1)


@q("g12_cochange_top", cte("commit_files") + COCHANGE + "SELECT * FROM pairs ORDER BY support DESC, file_a, file_b LIMIT 100")
def _(s, d):
    return H.cochange_top(H.cochange(frame(s, d, "commit_files"), 3, 0.1))


@q("g12_cochange_of_target", cte("commit_files") + COCHANGE + "SELECT * FROM pairs WHERE file_a = (SELECT min(file_a) FROM pairs) ORDER BY support DESC, file_b LIMIT 50")
def _(s, d):
    pairs = H.cochange(frame(s, d, "commit_files"), 3, 0.1)
    first = pairs.agg({"file_a": "min"}).first()[0]
    return H.cochange_of(pairs, first)


OWN = """, t AS (SELECT *, sum(line_count) OVER (PARTITION BY file) AS total FROM blame),
own AS (SELECT file, round(max(line_count * 1.0 / total), 4) AS ownership_ratio, count(*) AS author_count,
  sum(CASE WHEN line_count * 1.0 / total < 0.05 THEN 1 ELSE 0 END) AS minor_count FROM t GROUP BY file),
r AS (SELECT file, author, row_number() OVER (PARTITION BY file ORDER BY line_count DESC, author) AS k FROM blame),
edges AS (SELECT file, author, round(line_count * 1.0 / total, 4) AS confidence FROM t)
"""


@q("g1_ownership", cte("blame") + OWN + "SELECT own.*, r.author AS top_contributor FROM own JOIN r ON r.file = own.file AND r.k = 1")
def _(s, d):
    return H.ownership(frame(s, d, "blame"))


@q("g2_ownership_stats", cte("blame") + OWN + """SELECT count(*) AS files_analyzed, sum(CASE WHEN ownership_ratio < 0.5 THEN 1 ELSE 0 END) AS low_ownership,
  (SELECT count(DISTINCT author) FROM blame) AS contributors FROM own""")
def _(s, d):
    return H.ownership_stats(frame(s, d, "blame"))


@q("g3_authored_by", cte("blame") + OWN + "SELECT * FROM edges")
def _(s, d):
    return H.authored_by(frame(s, d, "blame"))


@q("g4_ownership_report", cte("blame") + OWN + """, k AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY confidence DESC, author) AS rank FROM edges),
top AS (SELECT file, confidence AS ratio FROM k WHERE rank = 1 ORDER BY ratio, file LIMIT 100)
SELECT k.file, ratio, rank, author, confidence FROM top JOIN k ON k.file = top.file WHERE rank <= 10""")
def _(s, d):
    return H.ownership_report(H.authored_by(frame(s, d, "blame")))


BUS = OWN + """, prim AS (SELECT file, author FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY confidence DESC, author) AS k FROM edges) x WHERE k = 1),
cov AS (SELECT author, count(*) AS covered FROM prim GROUP BY author),
run AS (SELECT author, covered, row_number() OVER (ORDER BY covered DESC, author) AS rank,
  sum(covered) OVER (ORDER BY covered DESC, author ROWS UNBOUNDED PRECEDING) AS cum, (SELECT sum(covered) FROM cov) AS total FROM cov),
steps AS (SELECT rank, author, covered, round(cum * 1.0 / total, 4) AS orphaned FROM run WHERE (cum - covered) * 1.0 / total < 0.5)
"""


@q("g5_bus_factor_steps", cte("blame") + BUS + "SELECT * FROM steps")
def _(s, d):
    return H.bus_factor_steps(H.authored_by(frame(s, d, "blame")))


@q("g6_bus_factor", cte("blame") + BUS + """SELECT bus_factor, total_files, CASE WHEN total_files = 0 THEN 'UNKNOWN' WHEN bus_factor <= 1 THEN 'CRITICAL' WHEN bus_factor <= 3 THEN 'HIGH'
  WHEN bus_factor <= 6 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM (SELECT count(*) AS bus_factor, (SELECT count(DISTINCT file) FROM edges) AS total_files FROM steps) x""")
def _(s, d):
    return H.bus_factor(H.authored_by(frame(s, d, "blame")))


CHURN = """, c AS (SELECT file, count(*) AS churn_count, sum(added) AS lines_added, sum(deleted) AS lines_deleted FROM numstat GROUP BY file),
per AS (SELECT loc.file, total_loc, coalesce(churn_count, 0) AS churn_count, coalesce(lines_added, 0) AS lines_added, coalesce(lines_deleted, 0) AS lines_deleted,
  round(coalesce(coalesce(lines_added, 0) * 1.0 / nullif(total_loc, 0), 0), 4) AS relative_added, round(coalesce(coalesce(lines_deleted, 0) * 1.0 / nullif(total_loc, 0), 0), 4) AS relative_deleted
  FROM loc LEFT JOIN c ON c.file = loc.file)
"""


@q("g7_churn", cte("numstat", "loc") + CHURN + "SELECT * FROM per")
def _(s, d):
    return H.churn(frame(s, d, "numstat"), frame(s, d, "loc"))


@q("g8_churn_summary", cte("numstat", "loc") + CHURN + """SELECT count(*) AS total_files, sum(CASE WHEN churn_count > 0 THEN 1 ELSE 0 END) AS with_churn,
  round(sum(CASE WHEN churn_count > 0 THEN 1 ELSE 0 END) * 1.0 / count(*), 4) AS churn_ratio FROM per""")
def _(s, d):
    return H.churn_summary(H.churn(frame(s, d, "numstat"), frame(s, d, "loc")))


@q("g9_line_count", """SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END END AS lines
FROM documents""")
def _(s, d):
    from pyspark.sql import functions as F

    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", H.line_count(F.col("text")).alias("lines"))


AGREE = "CASE WHEN {v} < 0.05 THEN 'high' WHEN {v} < 0.15 THEN 'medium' ELSE 'low' END"


@q("g22_weighted_average", cte("evaluations") + f""", g AS (SELECT claim_id, count(*) AS n, avg(confidence) AS c, round(var_pop(score), 12) AS v,
  CASE WHEN sum(confidence) < 1e-10 THEN avg(score) ELSE sum(score * confidence) / sum(confidence) END AS s FROM evaluations GROUP BY claim_id),
h AS (SELECT *, {AGREE.format(v="v")} AS agreement_level FROM g)
SELECT claim_id, n, round(s, 6) AS consensus_score, round(CASE agreement_level WHEN 'high' THEN least(1.0, c * 1.1) WHEN 'low' THEN c * 0.85 ELSE c END, 6) AS consensus_confidence, agreement_level,
  CASE WHEN agreement_level = 'medium' AND s < 0.6 THEN 'flag_for_review' WHEN agreement_level = 'low' AND s < 0.5 THEN 'reject' ELSE 'accept' END AS resolution FROM h""")
def _(s, d):
    return C.weighted_average(frame(s, d, "evaluations"))


@q("g23_bayesian", cte("evaluations") + f""", g AS (SELECT claim_id, sum(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) AS yes, count(*) AS n, round(var_pop(score), 12) AS v FROM evaluations GROUP BY claim_id),
h AS (SELECT *, {AGREE.format(v="v")} AS agreement_level, (yes + 1.0) / (n + 2.0) AS s FROM g)
SELECT claim_id, yes + 1.0 AS alpha, n - yes + 1.0 AS beta, round(s, 6) AS consensus_score, agreement_level,
  CASE agreement_level WHEN 'high' THEN 'accept' WHEN 'low' THEN 're_evaluate' ELSE CASE WHEN s < 0.6 THEN 'flag_for_review' ELSE 'accept' END END AS resolution FROM h""")
def _(s, d):
    return C.bayesian(frame(s, d, "evaluations"))


@q("g23_bayesian_interval")
def _(s, d):
    return C.with_interval(C.bayesian(frame(s, d, "evaluations")))


MAJOR = """, g AS (SELECT claim_id, sum(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) AS yes, count(*) AS n, coalesce(avg(CASE WHEN score >= 0.5 THEN confidence END), 0) AS cy,
  coalesce(avg(CASE WHEN score < 0.5 THEN confidence END), 0) AS cn, string_agg(printf('%.6f', score), ',' ORDER BY score) AS scores FROM evaluations GROUP BY claim_id),
h AS (SELECT *, CASE WHEN yes * 2 = n THEN {tie} ELSE yes * 1.0 / n >= 0.5 END AS accepted, yes * 1.0 / n AS ratio, abs(yes * 2 - n) * 1.0 / n AS m FROM g)
SELECT claim_id, n, yes, accepted, round(CASE WHEN accepted THEN ratio ELSE 1 - ratio END, 6) AS consensus_score, round(m, 6) AS margin,
  CASE WHEN m >= 0.8 THEN 'high' WHEN m >= 0.2 THEN 'medium' ELSE 'low' END AS agreement_level,
  CASE WHEN {esc} THEN 're_evaluate' WHEN accepted THEN 'accept' WHEN m < 0.2 THEN 'flag_for_review' ELSE 'reject' END AS resolution, NOT ({esc}) AS converged FROM h"""


@q("g24_majority", cte("evaluations") + MAJOR.format(tie="cy >= cn", esc="false"))
def _(s, d):
    return C.majority(frame(s, d, "evaluations"))


@q("g25_majority_seeded", cte("evaluations") + MAJOR.format(tie="substr(sha256(scores), 1, 1) >= '8'", esc="false"))
def _(s, d):
    return C.majority(frame(s, d, "evaluations"), tie_breaker="random_seeded")


@q("g25_majority_escalated", cte("evaluations") + MAJOR.format(tie="false", esc="yes * 2 = n"))
def _(s, d):
    return C.majority(frame(s, d, "evaluations"), tie_breaker="escalate_to_debate")


@q("g26_adaptive_stability", cte("evaluations") + f""", r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score, evaluator_id) AS i, count(*) OVER (PARTITION BY claim_id) AS m FROM evaluations),
g AS (SELECT claim_id, count(*) AS n, round(var_pop(score), 9) AS v, avg(score) AS mean, avg(confidence) AS c, CASE WHEN count(*) < 2 THEN 0 ELSE round(max(abs(i * 1.0 / m - score)), 9) END AS ks,
  CASE WHEN sum(confidence) < 1e-10 THEN avg(score) ELSE sum(score * confidence) / sum(confidence) END AS s FROM r GROUP BY claim_id),
h AS (SELECT *, ks < 0.1 OR v < 0.02 AS stable, mean * (1 - mean) / greatest(v, 1e-10) - 1 AS ratio FROM g),
k AS (SELECT *, stable AND n >= 3 AS converged, CASE WHEN v < 1e-10 THEN 3 ELSE greatest(3, least(20, ceil(round((greatest(0.1, mean * ratio) + greatest(0.1, (1 - mean) * ratio)) / 0.1, 6)))) END AS need FROM h)
SELECT claim_id, round(s, 6) AS consensus_score, round(least(1.0, CASE WHEN stable THEN c * 1.1 ELSE c END), 6) AS consensus_confidence, {AGREE.format(v="v")} AS agreement_level, round(ks, 6) AS ks,
  converged, CASE WHEN converged THEN 'accept' ELSE 're_evaluate' END AS resolution, CAST(CASE WHEN converged THEN 1 ELSE need END AS INTEGER) AS iteration_count FROM k""")
def _(s, d):
    return C.adaptive_stability(frame(s, d, "evaluations"))


BIAS = "CASE source WHEN 'adaptive_expansion' THEN 0.02 WHEN 'collaborative_inference' THEN -0.01 WHEN 'metacognitive' THEN 0.01 ELSE 0 END"


@q("g27_confidence_fusion", cte("estimates") + f""", g AS (SELECT group_id, avg(greatest(0.0, least(1.0, value - {BIAS}))) AS f, avg(uncertainty) AS u, max(value) - min(value) AS dis FROM estimates GROUP BY group_id),
h AS (SELECT group_id, u + dis * 0.5 AS spread, CASE WHEN round(1 - dis, 9) > 0.8 AND f > 0.7 THEN least(1.0, f + (round(1 - dis, 9) - 0.8) * 0.2) ELSE f END AS f FROM g)
SELECT group_id, round(f, 6) AS point, round(greatest(0.0, f - spread), 6) AS lower, round(least(1.0, f + spread), 6) AS upper FROM h""")
def _(s, d):
    return C.fuse(frame(s, d, "estimates"))


@q("g29_compound_score", cte("signals") + "SELECT *, round(relevance * 0.3 + uniqueness * 0.2 + impact * 0.3 + confidence * 0.2, 10) AS weighted_total FROM signals")
def _(s, d):
    return C.compound_score(frame(s, d, "signals"))


@q("g31_chain_of_verification", cte("evaluations") + """, g AS (SELECT claim_id, coalesce(avg(score), 0.5) AS m FROM evaluations GROUP BY claim_id)
SELECT claim_id, round(m, 4) AS score, CASE WHEN round(m, 9) >= 0.7 THEN 'pass' WHEN round(m, 9) >= 0.4 THEN 'inconclusive' ELSE 'fail' END AS verdict, round(least(1.0, m * 1.1), 4) AS confidence FROM g""")
def _(s, d):
    return C.chain_of_verification(frame(s, d, "evaluations"))


@q("g32_debate", cte("evaluations") + """, r AS (SELECT claim_id, evaluator_id, round(score * 0.6 + coalesce((sum(score) OVER w - score) / nullif(count(*) OVER w - 1, 0), score) * 0.4, 6) AS score
  FROM evaluations WINDOW w AS (PARTITION BY claim_id)), g AS (SELECT claim_id, avg(score) AS m, round(var_pop(score), 12) < 0.05 AS converged FROM r GROUP BY claim_id)
SELECT claim_id, round(m, 6) AS consensus_score, converged, CASE WHEN converged THEN 0.85 ELSE 0.65 END AS consensus_confidence FROM g""")
def _(s, d):
    from pyspark.sql import functions as F

    return C.debate(C.debate_round(frame(s, d, "evaluations")).select("claim_id", "evaluator_id", F.col("refined").alias("score")))


@q("g33_path_consensus", cte("evaluations") + "SELECT claim_id, round(var_pop(confidence), 12) < 0.02 AND round(avg(confidence), 12) > 0.7 AS consensus FROM evaluations WHERE confidence > 0 GROUP BY claim_id")
def _(s, d):
    return C.path_consensus(frame(s, d, "evaluations"))


@q("w6_w7_trajectory", cte("evaluations") + """, d AS (SELECT claim_id, evaluator_id AS seq, score, round(score - lag(score) OVER w, 9) AS d1, round(lag(score) OVER w - lag(score, 2) OVER w, 9) AS d0
  FROM evaluations WINDOW w AS (PARTITION BY claim_id ORDER BY evaluator_id))
SELECT claim_id, seq, coalesce(abs(d1) < 0.02, false) AS converged, coalesce(d1 * d0 < 0, false) AS oscillates, coalesce(abs(d1) < 0.01, false) AS diminishing,
  CASE WHEN score >= 0.85 THEN 'terminate' WHEN d1 < -0.1 THEN 'switch_strategy' WHEN abs(d1) < 0.01 THEN 'trigger_reflection' ELSE 'continue' END AS intervention FROM d""")
def _(s, d):
    e = frame(s, d, "evaluations")
    return C.trajectory(e.withColumnRenamed("evaluator_id", "seq"))


@q("x3_decay", """SELECT event_id, round(0.5 + (event_id % 5) / 10.0, 6) AS initial, round((0.5 + (event_id % 5) / 10.0) * pow(0.5, epoch_us(TIMESTAMP '2024-06-01 00:00:00' - INTERVAL 0 SECOND) / 86400000000.0 / 30 - epoch_us(ts) / 86400000000.0 / 30), 6) AS relevance,
  round(least(1.0, (0.5 + (event_id % 5) / 10.0) * (1 + 0.05 * ((event_id % 7) + 1))), 6) AS reinforced FROM events""")
def _(s, d):
    from pyspark.sql import functions as F

    e = s.read.parquet(f"{d}/events.parquet")
    initial = F.lit(0.5) + (F.col("event_id") % 5) / F.lit(10.0)
    now = F.to_timestamp(F.lit("2024-06-01 00:00:00"))
    return e.select(
        "event_id", F.round(initial, 6).alias("initial"), F.round(C.decay(initial, F.col("ts").cast("timestamp"), F.lit(30.0), now), 6).alias("relevance"),
        F.round(C.reinforce(initial, F.col("event_id") % 7), 6).alias("reinforced"),
    )


@q("x5_context_budget", "SELECT doc_id, n_chars AS used, CASE WHEN n_chars / 8000.0 >= 0.93 THEN 'l1_config' WHEN n_chars / 8000.0 >= 0.7 THEN 'l2_summary' ELSE 'l3_full' END AS level, n_chars / 8000.0 >= 0.93 AS compact FROM documents")
def _(s, d):
    from pyspark.sql import functions as F

    t = s.read.parquet(f"{d}/documents.parquet")
    return t.select("doc_id", F.col("n_chars").alias("used"), C.budget_level(F.col("n_chars"), F.lit(8000)).alias("level"), (F.col("n_chars") / 8000 >= 0.93).alias("compact"))


@q("x17_nli_score", "SELECT event_id, CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'click' THEN 0.3 WHEN 'error' THEN 0.0 END AS strict, CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'click' THEN 0.6 WHEN 'error' THEN 0.0 END AS lenient FROM events")
def _(s, d):
    from pyspark.sql import functions as F

    label = F.expr("CASE event_type WHEN 'purchase' THEN 'entailment' WHEN 'click' THEN 'neutral' WHEN 'error' THEN 'contradiction' END")
    e = s.read.parquet(f"{d}/events.parquet").withColumn("label", label)
    return e.select("event_id", C.nli_score(F.col("label"), True).alias("strict"), C.nli_score(F.col("label")).alias("lenient"))

"""Queries over conformal calibration, its evaluation and its resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import conformal, metrics, resample, scores
from plumbline.plans.base import query
from plumbline.session import table

ALPHAS = (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4)
SQL_ALPHAS = "alphas AS (SELECT unnest([" + ", ".join(f"{a}::DOUBLE" for a in ALPHAS) + "]) AS alpha)"
SQL_ROWS = "scored AS (SELECT DISTINCT id, type, answerable, score, loss, verdict, refused_by_prompt, answer, model FROM gate_scores_v3_14b WHERE score IS NOT NULL AND loss IS NOT NULL)"


def thresholds_sql(source: str, by: str, name: str, levels: str = "alphas") -> str:
    """CTEs up to ``name`` (by, alpha, threshold, feasible) for calibration rows ``source`` (by, score, loss)."""
    cols = by + ", " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    group = f"GROUP BY {by}, lam" if by else "GROUP BY lam"
    return f"""{name}_p AS (SELECT {cols}lam, sum(c) AS c, sum(l) AS l FROM (SELECT {cols}score AS lam, count(*) AS c, sum(loss) AS l FROM {source} GROUP BY {cols}score
UNION ALL SELECT DISTINCT {cols}0.0::DOUBLE, 0, 0 FROM {source} UNION ALL SELECT DISTINCT {cols}1.0::DOUBLE, 0, 0 FROM {source}) {group}),
{name}_k AS (SELECT {cols}lam, sum(c) OVER ({part}ORDER BY lam DESC)::BIGINT AS n, sum(l) OVER ({part}ORDER BY lam DESC) AS ls FROM {name}_p),
{name} AS (SELECT {cols}alpha, coalesce(min(lam) FILTER (n > 0 AND (n / (n + 1.0::DOUBLE)) * (CASE WHEN n > 0 THEN ls / n ELSE 0 END) + 1.0::DOUBLE / (n + 1.0::DOUBLE) <= alpha), 1.0) AS threshold,
min(lam) FILTER (n > 0 AND (n / (n + 1.0::DOUBLE)) * (CASE WHEN n > 0 THEN ls / n ELSE 0 END) + 1.0::DOUBLE / (n + 1.0::DOUBLE) <= alpha) IS NOT NULL AS feasible FROM {name}_k CROSS JOIN {levels} GROUP BY {cols}alpha)"""


WITH = "WITH " + SQL_ROWS + ", " + SQL_ALPHAS
SQL_SPLIT = "parts AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY md5('7:' || id), id) <= count(*) OVER () // 2 THEN 'cal' ELSE 'test' END AS part FROM scored)"
RISK = "coalesce(avg({l}) FILTER ({c}), 0.0) AS risk, avg(CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0 END) AS answer_rate, count(*) FILTER ({c}) AS n_answered, count(*) AS n_total"


def rows(spark, sf):
    cols = ["id", "type", "answerable", "score", "loss", "verdict", "refused_by_prompt", "answer", "model"]
    return table(spark, sf, "gate_scores_v3_14b").where("score is not null and loss is not null").select(*cols).distinct()


def alphas(spark):
    return spark.createDataFrame([(a,) for a in ALPHAS], "alpha double")


@query(WITH + ", " + thresholds_sql("scored", "", "t") + " SELECT alpha, threshold, feasible FROM t")
def conformal_threshold(spark, sf):
    return conformal.thresholds(conformal.check_losses(rows(spark, sf)), alphas(spark), [])


@query(WITH + ", " + thresholds_sql("scored", "", "t") + " SELECT lam, n, round(CASE WHEN n > 0 THEN ls / n ELSE 0 END, 6) AS risk FROM t_k")
def kept_risk_curve(spark, sf):
    return conformal.kept_risks(rows(spark, sf), []).select("lam", "n", F.round("risk", 6).alias("risk"))


SQL_GROUPS = "grouped AS (SELECT type AS grp, score, loss FROM scored WHERE type IN (SELECT type FROM scored GROUP BY type HAVING count(*) >= 30) UNION ALL SELECT '_global', score, loss FROM scored)"


@query(WITH + ", " + SQL_GROUPS + ", " + thresholds_sql("grouped", "grp", "t") + " SELECT grp, alpha, threshold, feasible FROM t")
def mondrian_thresholds(spark, sf):
    return conformal.mondrian(rows(spark, sf), alphas(spark), "type")


SQL_DECIDED = "gate AS (SELECT grp, threshold FROM t WHERE alpha = 0.3::DOUBLE), decided AS (SELECT s.*, coalesce(g.threshold, (SELECT threshold FROM gate WHERE grp = '_global')) AS threshold FROM scored s LEFT JOIN gate g ON g.grp = s.type)"


@query(WITH + ", " + SQL_GROUPS + ", " + thresholds_sql("grouped", "grp", "t") + ", " + SQL_DECIDED + " SELECT id, type, score, threshold, score >= threshold AS answered FROM decided")
def gate_decisions(spark, sf):
    r = rows(spark, sf)
    gate = conformal.mondrian(r, spark.createDataFrame([(0.3,)], "alpha double"), "type").select("grp", "threshold")
    return conformal.decide(r, gate, "type").select("id", "type", "score", "threshold", "answered")


@query(WITH + ", " + SQL_GROUPS + ", " + thresholds_sql("grouped", "grp", "t") + ", " + SQL_DECIDED + " SELECT type, round(risk, 6) AS risk, round(answer_rate, 6) AS answer_rate, n_answered, n_total FROM (SELECT type, " + RISK.format(l="loss", c="score >= threshold") + " FROM decided GROUP BY type)")
def selective_risk(spark, sf):
    r = rows(spark, sf)
    gate = conformal.mondrian(r, spark.createDataFrame([(0.3,)], "alpha double"), "type").select("grp", "threshold")
    out = conformal.selective_risk(conformal.decide(r, gate, "type"), ["type"])
    return out.select("type", F.round("risk", 6).alias("risk"), F.round("answer_rate", 6).alias("answer_rate"), "n_answered", "n_total")


@query(WITH + ", " + SQL_SPLIT + ", cal AS (SELECT * FROM parts WHERE part = 'cal'), " + thresholds_sql("cal", "", "t") + """, e AS (SELECT alpha, threshold, """ + RISK.format(l="p.loss", c="p.score >= t.threshold") + """ FROM t CROSS JOIN (SELECT * FROM parts WHERE part = 'test') p GROUP BY alpha, threshold)
SELECT alpha, threshold, round(risk, 6) AS risk, round(answer_rate, 6) AS answer_rate, risk <= alpha AS met_any, n_answered > 0 AND risk <= alpha AS met FROM e""")
def alpha_sweep(spark, sf):
    """Both readings of 'met': with and without asking for an answered row."""
    parts = resample.half_split(rows(spark, sf), 7)
    gate = conformal.thresholds(parts.where("part = 'cal'"), alphas(spark), []).select("alpha", "threshold")
    test = parts.where("part = 'test'").crossJoin(F.broadcast(gate))
    e = conformal.selective_risk(test, ["alpha", "threshold"], F.col("score") >= F.col("threshold"))
    met = F.col("risk") <= F.col("alpha")
    return e.select("alpha", "threshold", F.round("risk", 6).alias("risk"), F.round("answer_rate", 6).alias("answer_rate"), met.alias("met_any"), (met & (F.col("n_answered") > 0)).alias("met"))


#: Four signals of each answer, derived from what the table has: its score, its length, its citations and its verdict.
SQL_SIGNALS = r"""sig AS (SELECT id, loss, score AS su, least(1.0::DOUBLE, coalesce(length(answer), 0) / 400.0::DOUBLE) AS gr, least(1.0::DOUBLE, len(regexp_extract_all(coalesce(answer, ''), '\[(\d+)\]', 1)) / 2.0::DOUBLE) AS sc,
CASE WHEN answerable THEN score ELSE score * score END AS v2, coalesce(refused_by_prompt, false) AS refused FROM scored)"""
SQL_RULES = """rules AS (SELECT id, loss, unnest(['support_v1', 'support_v2', 'groundedness', 'self_consistency', 'geo(gr,sc)', 'mean(su,gr)', 'min(su,gr)', 'min(su,sc)', 'min(gr,sc)', 'min(su,gr,sc)', 'min(su,gr,v2)', 'min(su,gr)+veto', 'su+veto']) AS rule,
unnest([su, v2, gr, sc, sqrt(gr * sc), (su + gr) / 2, least(su, gr), least(su, sc), least(gr, sc), least(su, gr, sc), least(su, gr, v2), CASE WHEN refused THEN 0 ELSE least(su, gr) END, CASE WHEN refused THEN 0 ELSE su END]) AS score FROM sig)"""


def rule_scores(spark, sf):
    c = F.col
    r = rows(spark, sf).select(
        "id", "loss",
        c("score").alias("su"),
        F.least(F.lit(1.0), F.coalesce(F.length("answer"), F.lit(0)) / 400.0).alias("gr"),
        F.least(F.lit(1.0), F.size(F.regexp_extract_all(F.coalesce("answer", F.lit("")), F.lit(r"\[(\d+)\]"), F.lit(1))) / 2.0).alias("sc"),
        F.when(c("answerable"), c("score")).otherwise(c("score") * c("score")).alias("v2"),
        F.coalesce("refused_by_prompt", F.lit(False)).alias("refused"),
    )
    rules = scores.combination_rules(c("su"), c("v2"), c("gr"), c("sc"), c("refused"))
    return r.select("id", "loss", F.inline(F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("score")) for k, v in rules.items()])))


@query("WITH " + SQL_ROWS + ", " + SQL_SIGNALS + ", " + SQL_RULES + " SELECT id, rule, round(score, 6) AS score FROM rules")
def score_combine_rules(spark, sf):
    return rule_scores(spark, sf).select("id", "rule", F.round("score", 6).alias("score"))


@query("WITH " + SQL_ROWS + ", " + SQL_SIGNALS + ", " + SQL_RULES + ", o AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY score DESC, id) AS r, count(*) OVER (PARTITION BY rule) AS n FROM (SELECT id, loss, rule, round(score, 9) AS score FROM rules)) SELECT rule, count(*) AS head, round(avg(loss), 6) AS risk FROM o WHERE r <= greatest(1, floor(n * 0.3::DOUBLE)) GROUP BY rule")
def head_purity(spark, sf):
    r = rule_scores(spark, sf).withColumn("score", F.round("score", 9))
    return conformal.head_purity(r, ["rule"], 0.3).select("rule", "head", F.round("risk", 6).alias("risk"))


SQL_RULE_EVAL = """rp AS (SELECT r.rule, r.id, r.loss, round(r.score, 9) AS score, p.part FROM rules r JOIN (SELECT id, part FROM parts) p ON p.id = r.id), rcal AS (SELECT rule, score, loss FROM rp WHERE part = 'cal'), one AS (SELECT 0.3::DOUBLE AS alpha), """ + thresholds_sql("rcal", "rule", "rt", "one") + """,
ev AS (SELECT rp.rule, rp.part, rt.threshold, """ + RISK.format(l="rp.loss", c="rp.score >= rt.threshold") + """ FROM rp JOIN rt ON rt.rule = rp.rule GROUP BY rp.rule, rp.part, rt.threshold)"""


@query("WITH " + SQL_ROWS + ", " + SQL_SPLIT + ", " + SQL_SIGNALS + ", " + SQL_RULES + ", " + SQL_RULE_EVAL + """, pick AS (SELECT rule FROM ev WHERE part = 'cal' AND n_answered > 0 AND risk <= 0.3 ORDER BY round(answer_rate, 9) DESC, rule LIMIT 1)
SELECT rule, part, round(threshold, 6) AS threshold, round(risk, 6) AS risk, round(answer_rate, 6) AS answer_rate, n_answered FROM ev WHERE rule IN (SELECT rule FROM pick)""")
def rule_selection(spark, sf):
    """The rule is chosen on the calibration half alone: most coverage among those that hold the level."""
    parts = resample.half_split(rows(spark, sf), 7).select("id", "part")
    rp = rule_scores(spark, sf).withColumn("score", F.round("score", 9)).join(parts, "id")
    gate = conformal.thresholds(rp.where("part = 'cal'"), spark.createDataFrame([(0.3,)], "alpha double"), ["rule"]).select("rule", "threshold")
    ev = conformal.selective_risk(rp.join(F.broadcast(gate), "rule"), ["rule", "part", "threshold"], F.col("score") >= F.col("threshold"))
    best = ev.where("part = 'cal' and n_answered > 0 and risk <= 0.3").orderBy(F.desc(F.round("answer_rate", 9)), "rule").limit(1).select("rule")
    r6 = lambda c: F.round(c, 6).alias(c)
    return ev.join(F.broadcast(best), "rule").select("rule", "part", r6("threshold"), r6("risk"), r6("answer_rate"), "n_answered")


@query("WITH " + SQL_ROWS + """, ps AS (SELECT type, score AS s FROM scored WHERE loss = 0), ns AS (SELECT type, score AS s FROM scored WHERE loss <> 0),
w AS (SELECT p.type, sum(CASE WHEN p.s > n.s THEN 1.0::DOUBLE WHEN p.s = n.s THEN 0.5::DOUBLE ELSE 0 END) AS w FROM ps p JOIN ns n ON n.type = p.type GROUP BY p.type),
c AS (SELECT type, count(*) FILTER (loss = 0) AS positives, count(*) FILTER (loss <> 0) AS negatives FROM scored GROUP BY type)
SELECT c.type, positives, negatives, round(w.w / (positives * negatives), 6) AS auc FROM c LEFT JOIN w ON w.type = c.type""")
def auc_mann_whitney(spark, sf):
    return metrics.auc(rows(spark, sf), F.col("score"), F.col("loss") == 0, ["type"])


@query("WITH " + SQL_ROWS + """ SELECT type, round(avg(score) FILTER (loss = 0), 6) AS mean_right, round(avg(score) FILTER (loss <> 0), 6) AS mean_wrong, round(avg(score) FILTER (loss = 0) - avg(score) FILTER (loss <> 0), 6) AS gap, count(DISTINCT round(score, 3)) AS distinct_scores FROM scored GROUP BY type""")
def class_gap(spark, sf):
    right, wrong = F.avg(F.when(F.col("loss") == 0, F.col("score"))), F.avg(F.when(F.col("loss") != 0, F.col("score")))
    return rows(spark, sf).groupBy("type").agg(F.round(right, 6).alias("mean_right"), F.round(wrong, 6).alias("mean_wrong"), F.round(right - wrong, 6).alias("gap"), F.count_distinct(F.round("score", 3)).alias("distinct_scores"))


@query("WITH " + SQL_ROWS + ", ths AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95]::DOUBLE[]) AS threshold) SELECT threshold, round(risk, 6) AS risk, round(answer_rate, 6) AS answer_rate, n_answered, n_total FROM (SELECT threshold, " + RISK.format(l="loss", c="score >= threshold") + " FROM scored CROSS JOIN ths GROUP BY threshold)")
def risk_coverage_curve(spark, sf):
    ths = spark.createDataFrame([(x,) for x in (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95)], "threshold double")
    e = conformal.selective_risk(rows(spark, sf).crossJoin(F.broadcast(ths)), ["threshold"], F.col("score") >= F.col("threshold"))
    return e.select("threshold", F.round("risk", 6).alias("risk"), F.round("answer_rate", 6).alias("answer_rate"), "n_answered", "n_total")


@query("WITH " + SQL_ROWS + ", cov AS (SELECT unnest([0.1, 0.2, 0.3, 0.5, 0.8, 1.0]::DOUBLE[]) AS coverage), o AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY score DESC, id) AS r, count(*) OVER (PARTITION BY type) AS m FROM scored) SELECT type, coverage, count(*) AS n, round(avg(loss), 6) AS risk FROM o CROSS JOIN cov WHERE r <= round_even(coverage * m, 0) GROUP BY type, coverage")
def risk_at_coverage(spark, sf):
    cov = spark.createDataFrame([(x,) for x in (0.1, 0.2, 0.3, 0.5, 0.8, 1.0)], "coverage double")
    return conformal.risk_at_coverage(rows(spark, sf), ["type"], cov).select("type", "coverage", "n", F.round("risk", 6).alias("risk"))


TRIALS = 60
SQL_MARGINS = "margins AS (SELECT unnest([" + ", ".join(f"{m}::DOUBLE" for m in conformal.MARGINS) + "]) AS alpha, unnest([" + ", ".join(str(i) for i in range(len(conformal.MARGINS))) + "]) AS margin_no)"


def nested_sql(by: str, trial_cte: str) -> str:
    t = lambda a: ", ".join(f"{a}.{c}" for c in by.split(", "))
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in by.split(", "))
    return f"""{trial_cte}, tcal AS (SELECT {by}, score, loss FROM tr WHERE part = 'cal'), {thresholds_sql("tcal", by, "tt", "margins")},
val AS (SELECT {t("tr")}, m.margin_no, tt.alpha AS margin, tt.threshold, {RISK.format(l="tr.loss", c="tr.score >= tt.threshold")} FROM tr JOIN tt ON {on("tr", "tt")} JOIN margins m ON m.alpha = tt.alpha WHERE tr.part = 'val' GROUP BY {t("tr")}, m.margin_no, tt.alpha, tt.threshold),
pick AS (SELECT * FROM val WHERE n_answered > 0 AND risk <= 0.3 QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY answer_rate DESC, margin_no) = 1),
done AS (SELECT {t("tr")}, p.margin, p.threshold, {RISK.format(l="tr.loss", c="tr.score >= p.threshold")} FROM tr JOIN pick p ON {on("tr", "p")} WHERE tr.part = 'test' GROUP BY {t("tr")}, p.margin, p.threshold),
trials AS (SELECT {by}, margin, threshold, risk, answer_rate AS coverage, risk <= 0.3 AS met FROM done WHERE n_answered > 0)"""


SQL_THIRDS = f"""tr AS (SELECT trial, score, loss, CASE WHEN pos <= n // 3 THEN 'cal' WHEN pos <= 2 * (n // 3) THEN 'val' ELSE 'test' END AS part FROM (SELECT t.trial, s.score, s.loss, row_number() OVER (PARTITION BY t.trial ORDER BY md5(t.trial || ':' || s.id), s.id) AS pos, count(*) OVER (PARTITION BY t.trial) AS n FROM scored s CROSS JOIN (SELECT range AS trial FROM range({TRIALS})) t))"""
SUMMARY = """count(*) AS n_trials, round(avg(met::INT), 6) AS met_rate, round(sqrt(avg(met::INT) * (1 - avg(met::INT)) / count(*)), 6) AS met_se, round(avg(coverage), 6) AS coverage_mean, round(quantile_cont(coverage, 0.25), 6) AS coverage_p25, round(quantile_cont(coverage, 0.75), 6) AS coverage_p75,
round(avg(risk), 6) AS risk_mean, round(stddev_pop(threshold), 6) AS threshold_sd, count(DISTINCT round(threshold, 4)) AS distinct_thresholds"""


@query("WITH " + SQL_ROWS + ", " + SQL_MARGINS + ", " + nested_sql("trial", SQL_THIRDS) + " SELECT trial, margin, threshold, round(risk, 6) AS risk, round(coverage, 6) AS coverage, met FROM trials")
def nested_gate(spark, sf):
    t = conformal.nested_trials(resample.three_way_trials(rows(spark, sf), TRIALS), 0.3, ["trial"])
    return t.select("trial", "margin", "threshold", F.round("risk", 6).alias("risk"), F.round("coverage", 6).alias("coverage"), "met")


@query("WITH " + SQL_ROWS + ", " + SQL_MARGINS + ", " + nested_sql("trial", SQL_THIRDS) + f" SELECT {SUMMARY} FROM trials")
def nested_gate_summary(spark, sf):
    return conformal.trial_summary(conformal.nested_trials(resample.three_way_trials(rows(spark, sf), TRIALS), 0.3, ["trial"]), [])


SIZES, N_VAL, N_TEST = (20, 40, 80, 120), 60, 60
SQL_SIZED = f"""tr AS (SELECT trial, n_cal, score, loss, part FROM (SELECT o.trial, z.n_cal, o.score, o.loss, CASE WHEN pos <= n_cal THEN 'cal' WHEN pos <= n_cal + {N_VAL} THEN 'val' WHEN pos <= n_cal + {N_VAL + N_TEST} THEN 'test' END AS part FROM (SELECT t.trial, s.score, s.loss, row_number() OVER (PARTITION BY t.trial ORDER BY md5(t.trial || ':' || s.id), s.id) AS pos, count(*) OVER (PARTITION BY t.trial) AS n FROM scored s CROSS JOIN (SELECT range AS trial FROM range({TRIALS})) t) o
CROSS JOIN (SELECT unnest({list(SIZES)}) AS n_cal) z WHERE z.n_cal + {N_VAL + N_TEST} <= n) WHERE part IS NOT NULL)"""


@query("WITH " + SQL_ROWS + ", " + SQL_MARGINS + ", " + nested_sql("n_cal, trial", SQL_SIZED) + f" SELECT n_cal, {SUMMARY} FROM trials GROUP BY n_cal")
def calibration_curve(spark, sf):
    parts = resample.sized_trials(rows(spark, sf), TRIALS, list(SIZES), N_VAL, N_TEST)
    return conformal.trial_summary(conformal.nested_trials(parts, 0.3, ["n_cal", "trial"]), ["n_cal"])


DRAWS = 200
SQL_BOOT = f"""b AS (SELECT row_number() OVER (ORDER BY md5('3:' || id), id) - 1 AS pos, count(*) OVER () AS n, score, loss FROM scored),
d AS (SELECT r.range AS draw, (('0x' || substr(md5(r.range || ':' || b.pos), 1, 8))::BIGINT % b.n) AS pos FROM range({DRAWS}) r CROSS JOIN b),
e AS (SELECT d.draw, coalesce(avg(loss) FILTER (score >= 0.5), 0) - coalesce(avg(loss) FILTER (score >= 0.8), 0) AS diff FROM d JOIN b ON b.pos = d.pos GROUP BY d.draw)"""


@query("WITH " + SQL_ROWS + ", " + SQL_BOOT + """ SELECT round((SELECT coalesce(avg(loss) FILTER (score >= 0.5), 0) - coalesce(avg(loss) FILTER (score >= 0.8), 0) FROM b), 6) AS diff, round(quantile_cont(diff, 0.025), 6) AS lo, round(quantile_cont(diff, 0.975), 6) AS hi FROM e""")
def paired_bootstrap(spark, sf):
    """Difference of the risks at two thresholds, both on the same resampled questions."""
    b = resample.ordered_position(rows(spark, sf), [], 3, "id").select((F.col("pos") - 1).cast("bigint").alias("pos"), "n", "score", "loss")
    risk = lambda t: F.coalesce(F.avg(F.when(F.col("score") >= t, F.col("loss"))), F.lit(0.0))
    draws = resample.bootstrap_counts(b, DRAWS, F.col("n"))
    e = draws.groupBy("draw").agg((risk(0.5) - risk(0.8)).alias("diff")).agg(F.round(F.percentile("diff", 0.025), 6).alias("lo"), F.round(F.percentile("diff", 0.975), 6).alias("hi"))
    return b.agg(F.round(risk(0.5) - risk(0.8), 6).alias("diff")).crossJoin(e)


@query("""WITH a AS (SELECT id, any_value(answerable) AS answerable, any_value(type) AS type, min(score) AS score FROM gate_scores_v3_14b GROUP BY id)
SELECT CASE WHEN answerable THEN CASE WHEN id LIKE 'gen-%' THEN 'generated' ELSE 'hand-written' END WHEN id LIKE 'g-%' OR id LIKE 'gen-%' THEN 'outside corpus' ELSE 'in-domain, absent' END AS category, count(*) AS n, CASE WHEN answerable THEN 0.0::DOUBLE ELSE 1.0 END AS derived_loss, round(avg(score), 6) AS mean_score FROM a GROUP BY 1, answerable""")
def category_summary(spark, sf):
    a = table(spark, sf, "gate_scores_v3_14b").groupBy("id").agg(F.first("answerable").alias("answerable"), F.min("score").alias("score"))
    gen, g = F.col("id").startswith("gen-"), F.col("id").startswith("g-")
    cat = F.when(F.col("answerable"), F.when(gen, "generated").otherwise("hand-written")).otherwise(F.when(gen | g, "outside corpus").otherwise("in-domain, absent"))
    return a.groupBy(cat.alias("category"), F.when(F.col("answerable"), 0.0).otherwise(1.0).alias("derived_loss")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


@query("WITH " + SQL_ROWS + """ SELECT model, CASE WHEN grouping(type) = 1 THEN 'all' ELSE type END AS type, count(*) AS n, round(avg(loss) FILTER (answerable), 6) AS base_error, round(avg(loss), 6) AS base_error_all, round(avg(CASE WHEN loss = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS right_rate, round(avg(CASE WHEN upper(coalesce(answer, '')) LIKE '%INSUFFICIENT EVIDENCE%' THEN 1.0::DOUBLE ELSE 0 END), 6) AS declined, count(DISTINCT score) AS distinct_scores FROM scored GROUP BY GROUPING SETS ((model), (model, type))""")
def model_summary(spark, sf):
    """Per model and per model and type in one pass; base error over answerable questions and over all."""
    from plumbline.functions.text import is_refusal

    r = rows(spark, sf)
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    g = r.groupingSets([["model"], ["model", "type"]], "model", "type").agg(
        F.grouping("type").alias("gt"), F.count("*").alias("n"), F.round(F.avg(F.when(F.col("answerable"), F.col("loss"))), 6).alias("base_error"), F.round(F.avg("loss"), 6).alias("base_error_all"),
        share(F.col("loss") == 0).alias("right_rate"), share(is_refusal(F.col("answer"))).alias("declined"), F.count_distinct("score").alias("distinct_scores"),
    )
    return g.withColumn("type", F.when(F.col("gt") == 1, "all").otherwise(F.col("type"))).drop("gt")


@query("WITH " + SQL_ROWS + ", test AS (SELECT id FROM scored WHERE substr(md5('11:' || id), 1, 1) < '4'), cal AS (SELECT s.score, s.loss FROM scored s WHERE s.type = 'factual' AND s.id NOT IN (SELECT id FROM test)), one AS (SELECT 0.3::DOUBLE AS alpha), " + thresholds_sql("cal", "", "t", "one") + ", e AS (SELECT threshold, " + RISK.format(l="s.loss", c="s.score >= t.threshold") + " FROM scored s SEMI JOIN test ON test.id = s.id CROSS JOIN t GROUP BY threshold) SELECT threshold, round(risk, 6) AS risk, round(answer_rate, 6) AS answer_rate, n_answered, n_total FROM e")
def fixed_test_provenance(spark, sf):
    """A gate calibrated on one provenance, without the test's ids, judged on a fixed test."""
    r = rows(spark, sf)
    test = r.where(F.substring(resample.draw(11, F.col("id")), 1, 1) < "4")
    cal = r.where("type = 'factual'").join(test.select("id"), "id", "left_anti")
    gate = conformal.thresholds(cal, spark.createDataFrame([(0.3,)], "alpha double"), []).select("threshold")
    e = conformal.selective_risk(test.crossJoin(F.broadcast(gate)), ["threshold"], F.col("score") >= F.col("threshold"))
    return e.select("threshold", F.round("risk", 6).alias("risk"), F.round("answer_rate", 6).alias("answer_rate"), "n_answered", "n_total")

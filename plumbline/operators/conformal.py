"""Calibrated abstention: thresholds with a risk bound, gates and their evaluation.

All operators work on many calibration sets at once: ``by`` names the columns that tell the sets
apart. Rows are first counted per distinct score, so sorts and running sums go over scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.session import small_side

MIN_GROUP = 30


def check_losses(df: DataFrame) -> DataFrame:
    """The rows, failing at run time if a loss lies outside 0 to 1."""
    return df.where(F.assert_true(F.col("loss").between(0, 1), F.lit("losses must lie in [0, 1]")).isNull())


def kept_risks(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, lam, n, risk): for each candidate threshold the rows kept (score >= lam) and their mean loss.

    Candidates are the set's scores, 0 and 1. Rows with a null score or loss do not take part.
    """
    rows = df.where("score is not null and loss is not null")
    per = rows.groupBy(*by, F.col("score").alias("lam")).agg(F.count("*").alias("c"), F.sum("loss").alias("l"))
    ends = rows.select(*by).distinct().withColumn("lam", F.explode(F.array(F.lit(0.0), F.lit(1.0)))).withColumn("c", F.lit(0).cast("bigint")).withColumn("l", F.lit(0.0))
    per = per.unionByName(ends).groupBy(*by, "lam").agg(F.sum("c").alias("c"), F.sum("l").alias("l"))
    w = Window.partitionBy(*by).orderBy(F.desc("lam"))
    kept = per.withColumn("n", F.sum("c").over(w)).withColumn("loss_sum", F.sum("l").over(w))
    return kept.select(*by, "lam", "n", F.coalesce(F.try_divide("loss_sum", "n"), F.lit(0.0)).alias("risk"))


def thresholds(df: DataFrame, alphas: DataFrame, by: list[str]) -> DataFrame:
    """(by, alpha, threshold, feasible): the least candidate whose corrected risk is within alpha.

    The bound is (n / (n + 1)) * risk + 1 / (n + 1) with n the rows kept, in this form because
    the algebraically equal one differs at the border. Without a feasible candidate the
    threshold is 1.0, at which rows scoring exactly 1.0 are still answered.
    """
    n = F.col("n").cast("double")
    bound = (n / (n + 1)) * F.col("risk") + F.lit(1.0) / (n + 1)
    best = F.min(F.when((F.col("n") > 0) & (bound <= F.col("alpha")), F.col("lam")))
    met = kept_risks(df, by).crossJoin(F.broadcast(alphas))  # a handful of levels
    out = met.groupBy(*by, "alpha").agg(best.alias("best"))
    return out.select(*by, "alpha", F.coalesce("best", F.lit(1.0)).alias("threshold"), F.col("best").isNotNull().alias("feasible"))


def mondrian(df: DataFrame, alphas: DataFrame, group: str, min_group: int = MIN_GROUP) -> DataFrame:
    """(grp, alpha, threshold, feasible): one row for all rows (grp '_global') and one per large enough group."""
    rows = df.select(F.col(group).alias("grp"), "score", "loss")
    large = rows.where("score is not null and loss is not null").groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") >= min_group)
    own = rows.join(large.select("grp"), "grp", "left_semi")
    return thresholds(own.unionByName(rows.withColumn("grp", F.lit("_global"))), alphas, ["grp"])


def decide(df: DataFrame, gate: DataFrame, group: str) -> DataFrame:
    """Adds ``threshold`` and ``answered``: the group's threshold, else the global one; score >= threshold answers.

    ``gate`` is (grp, threshold). Rows without score are not answered.
    """
    small = small_side(gate.select(F.col("grp").alias(group), F.col("threshold").alias("own")), gate.count())
    everyone = F.broadcast(gate.where("grp = '_global'").limit(1).select(F.col("threshold").alias("common")))
    out = df.join(small, group, "left").crossJoin(everyone)
    out = out.withColumn("threshold", F.coalesce("own", "common")).drop("own", "common")
    return out.withColumn("answered", F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False)))


def selective_risk(df: DataFrame, by: list[str], answered: Column | None = None) -> DataFrame:
    """(by, risk, answer_rate, n_answered, n_total): risk among the answered rows, 0.0 if there are none."""
    yes = F.col("answered") if answered is None else answered
    return df.groupBy(*by).agg(
        F.coalesce(F.avg(F.when(yes, F.col("loss"))), F.lit(0.0)).alias("risk"),
        F.avg(F.when(yes, 1.0).otherwise(0.0)).alias("answer_rate"),
        F.count(F.when(yes, 1)).alias("n_answered"),
        F.count("*").alias("n_total"),
    )


def _means_of_best(df: DataFrame, by: list[str], sizes: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """(keys, n, risk): mean loss of the ``want`` best-scored rows of each set; ties go by id.

    ``sizes`` is (keys, want), ``keys`` being ``by`` and what tells several sizes of a set apart.
    Counts and losses are summed per score first; of the rows themselves only those of the score at
    the border are ranked.
    """
    per = df.groupBy(*by, "score").agg(F.count("*").alias("c"), F.sum("loss").alias("l"), F.count("loss").alias("m"))
    meet = lambda a, b: a.join(b, by) if by else a.crossJoin(b)
    upto = Window.partitionBy(*by).orderBy(F.desc("score"))
    per = per.select(*by, "score", "c", *[(F.sum(x).over(upto) - F.coalesce(F.col(x), F.lit(0))).alias(f"{x}_above") for x in ("c", "l", "m")])
    border = meet(per, sizes).where((F.col("c_above") < F.col("want")) & (F.col("want") <= F.col("c_above") + F.col("c")))
    border = border.withColumnRenamed("score", "at").select(*keys, "at", "want", "c_above", "l_above", "m_above")
    ranked = meet(df, border.select(*by, F.col("at").alias("__at")).distinct()).where(F.col("score").eqNullSafe(F.col("__at"))).drop("__at")
    ranked = ranked.withColumn("__r", F.row_number().over(Window.partitionBy(*by, "score").orderBy(ident)))
    met = meet(border, ranked.select(*by, "score", "loss", "__r")).where(F.col("score").eqNullSafe(F.col("at")) & (F.col("__r") <= F.col("want") - F.col("c_above")))
    sums = met.groupBy(*keys).agg(F.first("want").alias("n"), (F.first("l_above") + F.coalesce(F.sum("loss"), F.lit(0.0))).alias("l"), (F.first("m_above") + F.count("loss")).alias("m"))
    return sums.select(*keys, "n", F.try_divide("l", "m").alias("risk"))


def head_purity(df: DataFrame, by: list[str], keep: float = 0.3, ident: str = "id") -> DataFrame:
    """(by, head, risk): mean loss of the best-scored share, at least one row; ties go by id."""
    sizes = df.groupBy(*by).agg(F.greatest(F.lit(1), F.floor(F.count("*") * keep)).alias("want"))
    return _means_of_best(df, by, sizes, by, ident).withColumnRenamed("n", "head")


def risk_at_coverage(df: DataFrame, by: list[str], coverages: DataFrame, ident: str = "id") -> DataFrame:
    """(by, coverage, n, risk): mean loss of the top round(coverage * n) rows, halves rounded to even."""
    totals = df.groupBy(*by).agg(F.count("*").alias("__n"))
    sizes = totals.crossJoin(F.broadcast(coverages)).select(*by, "coverage", F.bround(F.col("coverage") * F.col("__n")).cast("bigint").alias("want"))
    return _means_of_best(df, by, sizes, [*by, "coverage"], ident)


#: Trials of the nested gate: margins tried on the validation part.
MARGINS = (0.20, 0.175, 0.15, 0.125, 0.10, 0.075, 0.05)


def nested_trials(parts: DataFrame, alpha: float, by: list[str]) -> DataFrame:
    """One row per set of ``by`` in which some margin holds on validation and the test part has answers.

    ``parts`` is (by, part, score, loss) with part cal, val or test. Calibration fits a threshold
    per margin, validation picks the margin of most coverage whose risk is within alpha (the first
    on ties), test is looked at once. All sets and margins run through one plan.
    """
    spark = parts.sparkSession
    margins = spark.createDataFrame([(m, i) for i, m in enumerate(MARGINS)], "alpha double, margin_no int")
    thr = thresholds(parts.where("part = 'cal'"), margins.select("alpha"), by).join(F.broadcast(margins), "alpha")
    thr = thr.select(*by, F.col("alpha").alias("margin"), "margin_no", "threshold")

    def judged(part: str, gate: DataFrame) -> DataFrame:
        rows = parts.where(F.col("part") == part).select(*by, "score", "loss").join(gate, by)
        return selective_risk(rows, [*by, "margin", "margin_no", "threshold"], F.col("score") >= F.col("threshold"))

    val = judged("val", thr).where((F.col("n_answered") > 0) & (F.col("risk") <= alpha))
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("answer_rate"), "margin_no"))
    picked = val.withColumn("__r", best).where("__r = 1").select(*by, "margin", "margin_no", "threshold")
    test = judged("test", picked).where("n_answered > 0")
    return test.select(*by, "margin", "threshold", "risk", F.col("answer_rate").alias("coverage"), (F.col("risk") <= alpha).alias("met"))


def trial_summary(trials: DataFrame, by: list[str]) -> DataFrame:
    met = F.when(F.col("met"), 1.0).otherwise(0.0)
    r6 = lambda c: F.round(c, 6)
    return trials.groupBy(*by).agg(
        F.count("*").alias("n_trials"),
        r6(F.avg(met)).alias("met_rate"),
        r6(F.sqrt(F.avg(met) * (1 - F.avg(met)) / F.count("*"))).alias("met_se"),
        r6(F.avg("coverage")).alias("coverage_mean"),
        r6(F.percentile("coverage", 0.25)).alias("coverage_p25"),
        r6(F.percentile("coverage", 0.75)).alias("coverage_p75"),
        r6(F.avg("risk")).alias("risk_mean"),
        r6(F.stddev_pop("threshold")).alias("threshold_sd"),
        F.count_distinct(F.round("threshold", 4)).alias("distinct_thresholds"),
    )

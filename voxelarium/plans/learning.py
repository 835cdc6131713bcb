"""Queries on splits, weights, scores, metrics, losses and training histories."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from voxelarium import bindings as b
from voxelarium.operators import calibration, cohort, history, scoring, splits, weights
from voxelarium.plans.registry import HIST, LAB, PRED, SCAN, VOX, query, r, rounded
from voxelarium.plans.voxels import hash_sql
from voxelarium.sources.tables import read_epoch_log
from voxelarium.storage import new_folder


def order_sql(key: str, seed: int = 42) -> str:
    return f"md5(concat_ws('|', '{seed}', CAST({key} AS VARCHAR)))"


# Splits ----------------------------------------------------------------------

STRATIFIED_SQL = f"""{LAB}, ranked AS (SELECT *, row_number() OVER (PARTITION BY grade ORDER BY {order_sql('case_id')}) AS rn,
    count(*) OVER (PARTITION BY grade) AS n FROM lab),
  parts AS (SELECT case_id, grade, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train'
    WHEN rn <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM ranked)"""


def _parts(spark, sf_dir):
    return splits.stratified_split(b.lab(spark, sf_dir).select("case_id", "grade"), "grade")


@query("stratified_split", f"WITH {STRATIFIED_SQL} SELECT * FROM parts")
def stratified_split(spark, sf_dir):
    return _parts(spark, sf_dir)


@query(
    "random_split",
    f"""WITH {LAB}, ranked AS (SELECT case_id, row_number() OVER (ORDER BY {order_sql('case_id')}) AS rn,
      count(*) OVER () AS n FROM lab)
    SELECT case_id, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM ranked""",
)
def random_split(spark, sf_dir):
    return splits.random_split(b.lab(spark, sf_dir).select("case_id"))


@query(
    "k_fold",
    f"""WITH {LAB} SELECT case_id, grade,
      CAST((row_number() OVER (PARTITION BY grade ORDER BY {order_sql('case_id')}) - 1) % 5 AS INTEGER) AS fold FROM lab""",
)
def k_fold(spark, sf_dir):
    return splits.k_fold(b.lab(spark, sf_dir).select("case_id", "grade"), 5, "grade")


GROUP_SQL = f"""spot AS (SELECT o_orderkey AS case_id, o_custkey AS patient,
    {hash_sql('42', 'o_custkey')} / 4294967296.0::DOUBLE AS p FROM orders),
  grouped AS (SELECT case_id, patient, CASE WHEN p < 0.8 THEN 'train' WHEN p < 0.9 THEN 'val' ELSE 'test' END AS split FROM spot)"""


@query("group_split", f"WITH {GROUP_SQL} SELECT * FROM grouped")
def group_split(spark, sf_dir):
    return splits.group_split(b.cases(spark, sf_dir), "patient")


@query(
    "split_leakage",
    f"""WITH {GROUP_SQL}, ranked AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY {order_sql('o_orderkey')}) AS rn,
      count(*) OVER () AS n FROM orders),
    mixed AS (SELECT o_custkey AS patient, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM ranked),
    s AS (SELECT patient, count(DISTINCT split) AS k FROM mixed GROUP BY patient),
    g AS (SELECT patient, count(DISTINCT split) AS k FROM grouped GROUP BY patient)
    SELECT 'by_case' AS split_by, count(*) AS n_groups, count(*) FILTER (k > 1) AS n_leaking FROM s
    UNION ALL SELECT 'by_patient', count(*), count(*) FILTER (k > 1) FROM g""",
)
def split_leakage(spark, sf_dir):
    cases = b.cases(spark, sf_dir)
    by_case = splits.split_leakage(splits.random_split(cases), "patient")
    by_patient = splits.split_leakage(splits.group_split(cases, "patient"), "patient")
    return by_case.withColumn("split_by", F.lit("by_case")).unionByName(
        by_patient.withColumn("split_by", F.lit("by_patient"))
    )


@query(
    "balanced_batches",
    f"""WITH {LAB}, ranked AS (SELECT case_id, grade, row_number() OVER (PARTITION BY grade ORDER BY {order_sql('case_id')}) AS rn FROM lab),
    t AS (SELECT count(*) AS n, count(*) FILTER (grade = 1) AS n1, count(*) FILTER (grade = 0) AS n0 FROM lab),
    slots AS (SELECT i // 8 AS batch, CAST(i % 8 AS INTEGER) AS slot FROM (SELECT unnest(range((n // 8) * 8)) AS i FROM t)),
    draws AS (SELECT batch, slot, CASE WHEN slot < 4 THEN 1 ELSE 0 END AS grade,
      {hash_sql('42', 'batch', 'slot', digits=15)} % CASE WHEN slot < 4 THEN n1 ELSE n0 END + 1 AS rn,
      {hash_sql('42', 'batch', 'slot', "'place'", digits=15)} AS position FROM slots CROSS JOIN t)
    SELECT d.batch, d.slot, d.grade, d.position, k.case_id FROM draws d JOIN ranked k ON k.grade = d.grade AND k.rn = d.rn""",
)
def balanced_batches(spark, sf_dir):
    return splits.balanced_batches(b.lab(spark, sf_dir), "grade", 8)


@query(
    "combined_splits",
    f"WITH {STRATIFIED_SQL} SELECT grade, count(*) AS n FROM parts WHERE split IN ('train', 'val') GROUP BY grade",
)
def combined_splits(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    both = cohort.combine_splits(parts.where("split = 'train'"), parts.where("split = 'val'"))
    return both.groupBy("grade").agg(F.count(F.lit(1)).alias("n"))


# Weights -----------------------------------------------------------------------


@query(
    "inverse_frequency_weights",
    f"""WITH {LAB} SELECT CAST(g AS INTEGER) AS grade, count(case_id) AS n,
      {r('coalesce((SELECT count(*) FROM lab) / nullif(2.0::DOUBLE * count(case_id), 0), 1)')} AS weight
    FROM (SELECT unnest([0, 1]) AS g) LEFT JOIN lab ON grade = g GROUP BY g""",
)
def inverse_frequency_weights(spark, sf_dir):
    return rounded(weights.inverse_frequency_weights(b.lab(spark, sf_dir), "grade"))


@query(
    "effective_number_weights",
    f"""WITH {LAB}, w AS (SELECT grade, count(*) AS n, (1 - 0.999::DOUBLE) / (1 - pow(0.999::DOUBLE, count(*))) AS w
      FROM lab GROUP BY grade)
    SELECT grade, n, {r('w * 2 / (SELECT sum(w) FROM w)')} AS weight FROM w""",
)
def effective_number_weights(spark, sf_dir):
    return rounded(weights.effective_number_weights(b.lab(spark, sf_dir), "grade"))


@query(
    "majority_baseline",
    f"""WITH {STRATIFIED_SQL}, c AS (SELECT split, grade, count(*) AS n FROM parts GROUP BY ALL)
    SELECT split, CAST(sum(n) AS BIGINT) AS n, {r('max(n)::DOUBLE / sum(n)')} AS majority FROM c GROUP BY split""",
)
def majority_baseline(spark, sf_dir):
    return rounded(weights.majority_baseline(_parts(spark, sf_dir), "grade", "split"))


# Features and scores -------------------------------------------------------------


@query(
    "scalar_features",
    f"""WITH {LAB} SELECT case_id, {r('ln(1 + et_volume) / 12')} AS et_log, {r('ln(1 + wt_volume) / 12')} AS wt_log,
      {r('et_volume / (wt_volume + 1e-8::DOUBLE)')} AS ratio_train,
      {r('CASE WHEN wt_volume > 0 THEN et_volume / wt_volume ELSE 0 END')} AS ratio_serve FROM lab""",
)
def scalar_features(spark, sf_dir):
    found = scoring.scalar_features(b.lab(spark, sf_dir))
    return rounded(found.select("case_id", "et_log", "wt_log", "ratio_train", "ratio_serve"))


POOLED_SQL = f"""{VOX}, pooled AS (SELECT case_id, avg(value) FILTER (modality = 0) AS m0, avg(value) FILTER (modality = 1) AS m1,
    avg(value) FILTER (modality = 2) AS m2, avg(value) FILTER (modality = 3) AS m3 FROM vox GROUP BY case_id)"""


def _pooled(spark, sf_dir):
    means = [F.avg(F.when(F.col("modality") == m, F.col("value"))).alias(f"m{m}") for m in range(4)]
    return b.vox(spark, sf_dir).groupBy("case_id").agg(*means)


@query(
    "feature_matrix",
    f"""WITH {LAB}, {POOLED_SQL} SELECT p.case_id, {r('m0')} AS f0, {r('m1')} AS f1, {r('m2')} AS f2, {r('m3')} AS f3,
      {r('ln(1 + et_volume) / 12')} AS f4, {r('ln(1 + wt_volume) / 12')} AS f5 FROM pooled p JOIN lab l ON l.case_id = p.case_id""",
)
def feature_matrix(spark, sf_dir):
    joined = _pooled(spark, sf_dir).join(scoring.scalar_features(b.lab(spark, sf_dir)), "case_id")
    matrix = scoring.feature_matrix(joined, ["m0", "m1", "m2", "m3", "et_log", "wt_log"])
    return rounded(matrix.select("case_id", *[F.get("features", F.lit(i)).alias(f"f{i}") for i in range(6)]))


@query(
    "batch_scores",
    f"""WITH {POOLED_SQL}, s AS (SELECT case_id, 4 * m0 - 3 * m1 + 2 * m2 - m3 + 0.05 AS logit FROM pooled),
    p AS (SELECT *, 1 / (1 + exp(-logit)) AS prob FROM s)
    SELECT case_id, {r('logit')} AS logit, {r('prob')} AS prob, CAST(prob > 0.5 AS INTEGER) AS prediction,
      CASE WHEN prob > 0.5 THEN 'HIGH' ELSE 'LOW' END AS grade_text,
      {r('CASE WHEN prob > 0.5 THEN prob ELSE 1 - prob END')} AS confidence FROM p""",
)
def batch_scores(spark, sf_dir):
    matrix = scoring.feature_matrix(_pooled(spark, sf_dir), ["m0", "m1", "m2", "m3"])
    scored = scoring.score_to_prediction(scoring.linear_score(matrix, [4.0, -3.0, 2.0, -1.0], 0.05))
    return rounded(scored.drop("features"))


SCORED_SQL = f"""{PRED}, scored AS (SELECT case_id, label, logit, 1 / (1 + exp(-logit)) AS prob,
  CAST(logit > 0 AS INTEGER) AS prediction FROM pred)"""


def _scored(spark, sf_dir):
    return scoring.score_to_prediction(b.pred(spark, sf_dir))


@query(
    "scored_predictions",
    f"""WITH {SCORED_SQL} SELECT case_id, label, {r('logit')} AS logit, {r('prob')} AS prob, prediction,
      CASE WHEN prediction = 1 THEN 'HIGH' ELSE 'LOW' END AS grade_text,
      {r('CASE WHEN prediction = 1 THEN prob ELSE 1 - prob END')} AS confidence FROM scored""",
)
def scored_predictions(spark, sf_dir):
    return rounded(_scored(spark, sf_dir))


@query(
    "attached_predictions",
    f"""WITH {SCORED_SQL} SELECT case_id, label, prediction, CAST(label = prediction AS INTEGER) AS correct FROM scored""",
)
def attached_predictions(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    labels = b.pred(spark, sf_dir).select("case_id", "label")
    return scoring.attach_predictions(labels, scored.select("case_id", "prediction"))


CONFUSION_SQL = f"""{SCORED_SQL}, cm AS (SELECT count(*) FILTER (label = 1 AND prediction = 1) AS tp,
    count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
    count(*) FILTER (label = 1 AND prediction = 0) AS fn FROM scored)"""


@query("confusion_matrix", f"WITH {CONFUSION_SQL} SELECT * FROM cm")
def confusion_matrix(spark, sf_dir):
    return scoring.confusion_matrix(_scored(spark, sf_dir))


def metrics_sql(eps: str) -> str:
    return f"""SELECT tp, tn, fp, fn, {r(f'(tp + tn) / (tp + tn + fp + fn{eps})')} AS accuracy,
      {r(f'tp / (tp + fn{eps})')} AS sensitivity, {r(f'tn / (tn + fp{eps})')} AS specificity,
      {r(f'tp / (tp + fp{eps})')} AS precision,
      {r(f'2 * (tp / (tp + fp{eps})) * (tp / (tp + fn{eps})) / (tp / (tp + fp{eps}) + tp / (tp + fn{eps}){eps})')} AS f1"""


@query(
    "binary_metrics",
    f"""WITH {CONFUSION_SQL} {metrics_sql('')}, 'plain' AS variant FROM cm
    UNION ALL {metrics_sql(' + 1e-8::DOUBLE')}, 'smoothed' FROM cm""",
)
def binary_metrics(spark, sf_dir):
    confusion = scoring.confusion_matrix(_scored(spark, sf_dir))
    plain = scoring.binary_metrics(confusion).withColumn("variant", F.lit("plain"))
    smoothed = scoring.binary_metrics(confusion, smoothed=True).withColumn("variant", F.lit("smoothed"))
    return rounded(plain.unionByName(smoothed))


REPORT_SQL = f"""{SCORED_SQL}, rep AS (SELECT CAST(k AS INTEGER) AS class, count(*) FILTER (label = k AND prediction = k) AS tp,
    count(*) FILTER (prediction = k) AS p, count(*) FILTER (label = k) AS support
    FROM scored CROSS JOIN (SELECT unnest([0, 1]) AS k) GROUP BY k)"""


@query(
    "grade_report",
    f"""WITH {REPORT_SQL} SELECT class, {r('coalesce(tp::DOUBLE / nullif(p, 0), 0)')} AS precision,
      {r('coalesce(tp::DOUBLE / nullif(support, 0), 0)')} AS recall,
      {r('coalesce(2.0::DOUBLE * tp / nullif(p + support, 0), 0)')} AS f1, support FROM rep""",
)
def grade_report(spark, sf_dir):
    return rounded(scoring.grade_report(_scored(spark, sf_dir), [0, 1]))


@query(
    "macro_f1",
    f"WITH {REPORT_SQL} SELECT {r('avg(coalesce(2.0::DOUBLE * tp / nullif(p + support, 0), 0))')} AS macro_f1 FROM rep",
)
def macro_f1(spark, sf_dir):
    return rounded(scoring.macro_f1(_scored(spark, sf_dir), [0, 1]))


LOSS_SQL = f"""{PRED}, bces AS (SELECT case_id, label, greatest(logit, 0) - logit * label + ln(1 + exp(-abs(logit))) AS bce FROM pred),
  losses AS (SELECT case_id, bce, (1 - exp(-bce)) * bce AS focal,
    (1 - exp(-bce)) * bce * CASE label WHEN 1 THEN 0.476::DOUBLE ELSE 1.524::DOUBLE END AS weighted_focal,
    bce * CASE label WHEN 1 THEN 0.476::DOUBLE ELSE 1.524::DOUBLE END AS weighted_bce FROM bces)"""
CLASS_WEIGHTS = [1.524, 0.476]


@query(
    "mean_losses",
    f"""WITH {LOSS_SQL} SELECT {r('avg(bce)')} AS bce, {r('avg(focal)')} AS focal, {r('avg(weighted_focal)')} AS weighted_focal,
      {r('avg(weighted_bce)')} AS weighted_bce FROM losses""",
)
def mean_losses(spark, sf_dir):
    return rounded(scoring.mean_losses(scoring.row_losses(b.pred(spark, sf_dir), CLASS_WEIGHTS)))


@query(
    "batch_mean_losses",
    f"""WITH {LOSS_SQL}, n AS (SELECT bce, (row_number() OVER (ORDER BY concat('case-', case_id)) - 1) // 32 AS batch FROM losses),
    m AS (SELECT batch, avg(bce) AS m FROM n GROUP BY batch)
    SELECT count(*) AS n_batches, {r('avg(m)')} AS bce_by_batch FROM m""",
)
def batch_mean_losses(spark, sf_dir):
    losses = scoring.row_losses(b.pred(spark, sf_dir), CLASS_WEIGHTS)
    named = losses.withColumn("case_id", F.concat(F.lit("case-"), F.col("case_id").cast("string")))
    return rounded(scoring.mean_of_batch_means(named, 32))


@query(
    "fitted_baseline",
    f"""WITH {LAB}, c AS (SELECT grade, (1 - 0.999::DOUBLE) / (1 - pow(0.999::DOUBLE, count(*))) AS w FROM lab GROUP BY grade),
    x AS (SELECT grade, 1.0::DOUBLE AS intercept, ln(1 + et_volume) / 12 AS et_log, ln(1 + wt_volume) / 12 AS wt_log,
      w * 2 / (SELECT sum(w) FROM c) AS w FROM lab JOIN c USING (grade)),
    s AS (UNPIVOT (SELECT sum(w * grade * intercept) / sum(w) AS intercept, sum(w * grade * et_log) / sum(w) AS et_log,
      sum(w * grade * wt_log) / sum(w) AS wt_log FROM x) ON intercept, et_log, wt_log INTO NAME feature VALUE v)
    SELECT feature, {r('v', 4)} AS fitted FROM s""",
)
def fitted_baseline(spark, sf_dir):
    """Weighted means of probability times feature; at the optimum they are those of label times feature."""
    labels = scoring.scalar_features(b.lab(spark, sf_dir))
    by_class = weights.effective_number_weights(labels, "grade").select("grade", "weight")
    weighted = labels.join(F.broadcast(by_class), "grade")
    features = ["et_log", "wt_log"]
    scored = scoring.fit_baseline(weighted, features, "grade", "weight").transform(weighted)
    chance = F.get(vector_to_array("probability"), F.lit(1)) * F.col("weight")
    named = {"intercept": F.lit(1.0), **{f: F.col(f) for f in features}}
    means = scored.agg(*[F.try_divide(F.sum(chance * x), F.sum("weight")).alias(f) for f, x in named.items()])
    return rounded(means.unpivot([], list(named), "feature", "fitted"), 4)


# Ranking, calibration, fusion -----------------------------------------------------


@query(
    "ranking_metrics",
    f"""WITH {PRED}, s AS (SELECT logit, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM pred GROUP BY logit),
    t AS (SELECT sum(pos) AS p, sum(neg) AS n FROM s),
    c AS (SELECT *, sum(neg) OVER (ORDER BY logit) - neg AS below, sum(pos) OVER (ORDER BY logit DESC) AS tp,
      sum(neg) OVER (ORDER BY logit DESC) AS fp FROM s)
    SELECT {r('sum(pos * (below + neg / 2.0::DOUBLE)) / any_value(p * n)')} AS auroc,
      {r('sum(pos * (tp::DOUBLE / (tp + fp))) / any_value(p)')} AS pr_auc FROM c CROSS JOIN t""",
)
def ranking_metrics(spark, sf_dir):
    return rounded(calibration.ranking_metrics(b.pred(spark, sf_dir)))


@query(
    "cohen_kappa",
    f"""WITH {CONFUSION_SQL}, k AS (SELECT (tp + tn)::DOUBLE / (tp + tn + fp + fn) AS po,
      ((tp + fp)::DOUBLE * (tp + fn) + (tn + fn)::DOUBLE * (tn + fp)) / pow(tp + tn + fp + fn, 2) AS pe FROM cm)
    SELECT {r('(po - pe) / (1 - pe)')} AS kappa FROM k""",
)
def cohen_kappa(spark, sf_dir):
    return rounded(calibration.cohen_kappa(scoring.confusion_matrix(_scored(spark, sf_dir))))


TEMPERATURES = [0.25 * i for i in range(1, 41)]


@query(
    "temperature_scaling",
    f"""WITH {PRED}, g AS (SELECT 0.25::DOUBLE * i AS temperature FROM (SELECT unnest(range(1, 41)) AS i)),
    n AS (SELECT temperature, avg(greatest(logit / temperature, 0) - logit / temperature * label
      + ln(1 + exp(-abs(logit / temperature)))) AS nll FROM pred CROSS JOIN g GROUP BY temperature)
    SELECT temperature, {r('nll')} AS nll, CAST(row_number() OVER (ORDER BY nll, temperature) = 1 AS INTEGER) AS best FROM n""",
)
def temperature_scaling(spark, sf_dir):
    return rounded(calibration.temperature_scaling(b.pred(spark, sf_dir), TEMPERATURES))


@query(
    "reliability_bins",
    f"""WITH {SCORED_SQL}, g AS (SELECT CAST(least(floor(prob * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(prob) AS p,
      avg(label) AS y FROM scored GROUP BY ALL)
    SELECT bin, n, {r('p')} AS mean_prob, {r('y')} AS rate, {r('abs(p - y)')} AS gap FROM g""",
)
def reliability_bins(spark, sf_dir):
    return rounded(calibration.reliability_bins(_scored(spark, sf_dir)))


MEMBERS_SQL = f"""{SCAN}, members AS (SELECT case_id, modality, 1 / (1 + exp(-(value - 40.0::DOUBLE) / 20.0::DOUBLE)) AS prob FROM scan),
  ens AS (SELECT case_id, count(*) AS n_members, avg(prob) AS p, stddev_pop(prob) AS s, var_pop(prob) AS v FROM members GROUP BY case_id),
  unc AS (SELECT *, -p * ln(p) - (1 - p) * ln(1 - p) AS h FROM ens)"""


def _members(spark, sf_dir):
    scan = b.scan(spark, sf_dir)
    return calibration.with_probability(scan.withColumn("logit", (F.col("value") - 40.0) / 20.0))


@query(
    "ensemble_uncertainty",
    f"""WITH {MEMBERS_SQL} SELECT case_id, n_members, {r('p')} AS mean_prob, {r('s')} AS std_prob, {r('v')} AS variance,
      {r('h')} AS entropy, CAST(v > 0.3 OR h > 0.5 AS INTEGER) AS review FROM unc""",
)
def ensemble_uncertainty(spark, sf_dir):
    return rounded(calibration.ensemble_uncertainty(_members(spark, sf_dir)))


UNCERTAIN_SQL = f"""{SCORED_SQL}, u AS (SELECT round(CASE WHEN prediction = 1 THEN 1 - prob ELSE prob END, 3) AS threshold,
    CAST(label <> prediction AS INTEGER) AS wrong FROM scored),
  sweep AS (SELECT threshold, CAST(sum(count(*)) OVER w AS BIGINT) AS accepted, CAST(sum(sum(wrong)) OVER w AS BIGINT) AS errors,
    (5.0::DOUBLE * sum(sum(wrong)) OVER w + 1.0 * ((SELECT count(*) FROM u) - sum(count(*)) OVER w)) / (SELECT count(*) FROM u) AS cost
    FROM u GROUP BY threshold WINDOW w AS (ORDER BY threshold))"""


def _uncertain(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    return scored.select(
        F.round(1 - F.col("confidence"), 3).alias("uncertainty"),
        (F.col("label") != F.col("prediction")).cast("int").alias("wrong"),
    )


@query(
    "review_threshold_sweep",
    f"WITH {UNCERTAIN_SQL} SELECT threshold, accepted, errors, {r('cost')} AS cost FROM sweep",
)
def review_threshold_sweep(spark, sf_dir):
    return rounded(calibration.threshold_sweep(_uncertain(spark, sf_dir), 5.0, 1.0))


@query(
    "best_review_threshold",
    f"""WITH {UNCERTAIN_SQL} SELECT threshold, accepted, errors, {r('cost')} AS cost FROM sweep
    ORDER BY round(sweep.cost, 9), threshold LIMIT 1""",
)
def best_review_threshold(spark, sf_dir):
    return rounded(calibration.best_threshold(calibration.threshold_sweep(_uncertain(spark, sf_dir), 5.0, 1.0)))


FUSION_SQL = f"""{MEMBERS_SQL}, per AS (SELECT case_id, modality, avg(prob) AS p FROM members GROUP BY ALL)"""


@query(
    "late_fusion",
    f"""WITH {FUSION_SQL} SELECT case_id, count(*) AS n_modalities, {r('avg(p)')} AS mean_prob,
      CAST(avg(p) > 0.5 AS INTEGER) AS by_average, CAST(2 * count(*) FILTER (p > 0.5) > count(*) AS INTEGER) AS by_majority
    FROM per GROUP BY case_id""",
)
def late_fusion(spark, sf_dir):
    return rounded(calibration.late_fusion(_members(spark, sf_dir)))


@query(
    "modality_ablation",
    f"""WITH {FUSION_SQL}, truth AS (SELECT case_id, CAST(avg(value) > 45 AS INTEGER) AS label FROM scan GROUP BY case_id),
    m AS (SELECT DISTINCT modality FROM scan),
    full_acc AS (SELECT avg(CAST(CAST(f.p > 0.5 AS INTEGER) = t.label AS INTEGER)) AS a
      FROM (SELECT case_id, avg(p) AS p FROM per GROUP BY case_id) f JOIN truth t ON t.case_id = f.case_id),
    left_out AS (SELECT m.modality, t.case_id, t.label, coalesce(avg(p.p), 0) AS p FROM truth t CROSS JOIN m
      LEFT JOIN per p ON p.case_id = t.case_id AND p.modality <> m.modality GROUP BY ALL),
    acc AS (SELECT modality, avg(CAST(CAST(p > 0.5 AS INTEGER) = label AS INTEGER)) AS a FROM left_out GROUP BY modality)
    SELECT modality AS without, {r('f.a')} AS full, {r('acc.a')} AS accuracy, {r('f.a - acc.a')} AS drop
    FROM acc CROSS JOIN full_acc f""",
)
def modality_ablation(spark, sf_dir):
    members = _members(spark, sf_dir)
    truth = members.groupBy("case_id").agg((F.avg("value") > 45).cast("int").alias("label"))
    types = ["click", "error", "purchase", "signup", "view"]
    return rounded(calibration.modality_ablation(members, truth, types))


# Histories ---------------------------------------------------------------------------


@query(
    "early_stop",
    f"""WITH {HIST}, p AS (SELECT *, row_number() OVER w AS i, min(val_loss) OVER (PARTITION BY run ORDER BY epoch
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM hist WINDOW w AS (PARTITION BY run ORDER BY epoch)),
    m AS (SELECT *, prev IS NULL OR val_loss < prev AS better FROM p),
    c AS (SELECT *, i - max(CASE WHEN better THEN i END) OVER (PARTITION BY run ORDER BY epoch) AS counter FROM m)
    SELECT run, epoch, val_loss, CAST(better AS INTEGER) AS improved, CAST(counter AS INTEGER) AS counter,
      CAST(counter >= 5 AS INTEGER) AS stop, CAST(coalesce(max(CAST(counter >= 5 AS INTEGER)) OVER (PARTITION BY run ORDER BY epoch
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS after_stop FROM c""",
)
def early_stop(spark, sf_dir):
    return rounded(history.early_stop(b.hist(spark, sf_dir), 5))


PLATEAU_SQL = f"""{HIST}, i AS (SELECT run, epoch, val_loss, row_number() OVER (PARTITION BY run ORDER BY epoch) AS i FROM hist),
  fold(run, i, epoch, best, bad, lr) AS (
    SELECT run, i, epoch, val_loss, 0, 0.005::DOUBLE FROM i WHERE i = 1
    UNION ALL SELECT n.run, n.i, n.epoch,
      CASE WHEN n.val_loss < f.best * (1 - 1e-4::DOUBLE) THEN n.val_loss ELSE f.best END,
      CASE WHEN n.val_loss < f.best * (1 - 1e-4::DOUBLE) THEN 0 WHEN f.bad + 1 > 3 THEN 0 ELSE f.bad + 1 END,
      CASE WHEN NOT n.val_loss < f.best * (1 - 1e-4::DOUBLE) AND f.bad + 1 > 3 THEN f.lr * 0.5 ELSE f.lr END
    FROM fold f JOIN i n ON n.run = f.run AND n.i = f.i + 1)"""


@query("plateau_lr", f"WITH RECURSIVE {PLATEAU_SQL} SELECT run, epoch, {r('lr', 9)} AS lr FROM fold")
def plateau_lr(spark, sf_dir):
    return rounded(history.plateau_lr(b.hist(spark, sf_dir), 0.005, patience=3), 9)


@query(
    "lr_changes",
    f"""WITH RECURSIVE {PLATEAU_SQL}, l AS (SELECT run, epoch, lr, lag(lr) OVER (PARTITION BY run ORDER BY epoch) AS previous FROM fold)
    SELECT run, epoch, {r('lr', 9)} AS lr, {r('previous', 9)} AS previous FROM l WHERE lr <> previous""",
)
def lr_changes(spark, sf_dir):
    return rounded(history.lr_changes(history.plateau_lr(b.hist(spark, sf_dir), 0.005, patience=3)), 9)


@query(
    "growth_alerts",
    f"""WITH {HIST}, l AS (SELECT *, lag(val_loss) OVER (PARTITION BY run ORDER BY epoch) AS previous FROM hist)
    SELECT * FROM l WHERE val_loss > previous * 1.10::DOUBLE""",
)
def growth_alerts(spark, sf_dir):
    return history.growth_alerts(b.hist(spark, sf_dir), "val_loss")


@query(
    "best_checkpoints",
    f"""WITH {HIST}, n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY val_loss, epoch) AS lo,
      row_number() OVER (PARTITION BY run ORDER BY val_loss DESC, epoch) AS hi FROM hist)
    SELECT run, epoch, val_loss, 'min' AS mode FROM n WHERE lo = 1 UNION ALL SELECT run, epoch, val_loss, 'max' FROM n WHERE hi = 1""",
)
def best_checkpoints(spark, sf_dir):
    hist = b.hist(spark, sf_dir)
    lowest = history.best_checkpoint(hist, "val_loss").withColumn("mode", F.lit("min"))
    highest = history.best_checkpoint(hist, "val_loss", "max").withColumn("mode", F.lit("max"))
    return lowest.unionByName(highest)


LOG_SQL = """log AS (SELECT event_type AS run, CAST(day(ts) AS INTEGER) AS epoch, max(ts) AS last, max(value) / 100 AS v,
  min(value) / 100 AS t FROM events GROUP BY ALL)"""


def _log_lines(spark, sf_dir):
    """Log lines of one run per event type, an epoch line per day with a start line before it."""
    daily = b.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("run"), F.day("ts").alias("epoch")).agg(
        F.max("ts").alias("last"), (F.max("value") / 100).alias("v"), (F.min("value") / 100).alias("t")
    )
    stamp = F.concat(F.date_format("last", "yyyy-MM-dd HH:mm:ss"), F.lit(","), F.date_format("last", "SSS"))
    first = F.format_string(
        "%s INFO Epoch %3d | Train: loss=%.4f acc=0.5000 | Val: loss=%.4f acc=0.7500 f1=0.0000",
        stamp, "epoch", "t", "v",
    )
    second = F.format_string(
        "%s - INFO - Epoch %d/50 | train_loss=%.4fe-00 train_acc=0.5000 | val_loss=%.4f val_acc=0.7500",
        stamp, "epoch", "t", "v",
    )
    text = F.when(F.col("epoch") % 2 == 0, second).otherwise(first)
    start = F.concat(stamp, F.lit(" INFO Training on cuda"))
    return daily.select("run", F.explode(F.array(start, text)).alias("value"))


@query(
    "epoch_log",
    f"""WITH {LOG_SQL} SELECT run, epoch, {r("CAST(printf('%.4f', t) AS DOUBLE)")} AS train_loss, 0.5::DOUBLE AS train_acc,
      {r("CAST(printf('%.4f', v) AS DOUBLE)")} AS val_loss, 0.75::DOUBLE AS val_acc,
      strftime(last, '%Y-%m-%d %H:%M:%S.%g') AS ts FROM log""",
)
def epoch_log(spark, sf_dir):
    parsed = history.parse_epoch_lines(_log_lines(spark, sf_dir), "run")
    return rounded(parsed.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")))


@query(
    "epoch_durations",
    f"""WITH {LOG_SQL}, d AS (SELECT run, epoch, lag(epoch) OVER w AS prev,
      epoch_ms(date_trunc('milliseconds', last)) - lag(epoch_ms(date_trunc('milliseconds', last))) OVER w AS ms FROM log WINDOW w AS (PARTITION BY run ORDER BY last))
    SELECT run, epoch, {r('coalesce(CASE WHEN prev = epoch - 1 THEN ms / 1000.0 END, -1)')} AS seconds FROM d""",
)
def epoch_durations(spark, sf_dir):
    durations = history.epoch_durations(history.parse_epoch_lines(_log_lines(spark, sf_dir), "run"))
    return rounded(durations.fillna(-1.0, ["seconds"]))


@query(
    "epoch_log_files",
    f"WITH {LOG_SQL} SELECT epoch, count(*) AS n, {r('''sum(CAST(printf('%.4f', v) AS DOUBLE))''')} AS val_loss FROM log GROUP BY epoch",
)
def epoch_log_files(spark, sf_dir):
    path = new_folder(spark, "logs")
    _log_lines(spark, sf_dir).select("value").write.text(path)
    parsed = read_epoch_log(spark, path)
    return rounded(parsed.groupBy("epoch").agg(F.count(F.lit(1)).alias("n"), F.sum("val_loss").alias("val_loss")))

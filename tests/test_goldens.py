"""Published numbers the operators must reproduce."""

import pytest
from pyspark.sql import functions as F

from voxelarium.operators import history, regions, scoring, splits, weights

# Validation loss of the first training history, epochs 1 to 23.
VAL_LOSS = [
    1.0572332061570267, 0.8033642549624388, 0.8227725028991699, 0.7107732748163158, 1.0173322853000684,
    0.7883444845837824, 1.103074536926445, 0.6044404945154299, 0.6321356597988085, 1.0608325614326302,
    0.87925586104393, 0.7477513216007715, 0.43660078309048184, 0.8134489953517914, 0.9555758809906313,
    0.7398465402509974, 0.7099143376295594, 1.016278886932066, 0.6345487538425402, 0.6620510487720884,
    0.6004444768373993, 0.7613385806138488, 0.6406390862218265,
]
# Validation accuracy of the second training history, epochs 1 to 14.
VAL_ACC = [
    0.9655172413793104, 0.9655172413793104, 0.9885057471264368, 0.9885057471264368, 0.9655172413793104,
    0.9885057471264368, 0.9885057471264368, 0.9885057471264368, 0.9885057471264368, 0.9885057471264368,
    1.0, 0.9885057471264368, 1.0, 1.0,
]


@pytest.fixture
def loss_history(spark):
    rows = [("first", i, v) for i, v in enumerate(VAL_LOSS, 1)]
    return spark.createDataFrame(rows, "run string, epoch int, val_loss double")


@pytest.fixture
def labels(spark):
    return spark.range(876).select(F.col("id").alias("case_id"), (F.col("id") < 704).cast("int").alias("grade"))


def test_early_stop(loss_history):
    row = history.early_stop_summary(loss_history, 10).first()
    assert (row.best_epoch, row.stop_epoch, row.stopped_early) == (13, 23, 1)


def test_plateau_schedule_on_loss(loss_history):
    change = history.lr_changes(history.plateau_lr(loss_history, 0.005)).collect()
    assert [(r.epoch, r.previous, r.lr) for r in change] == [(19, 0.005, 0.0025)]


def test_plateau_schedule_on_accuracy(spark):
    rows = [("second", i, v) for i, v in enumerate(VAL_ACC, 1)]
    hist = spark.createDataFrame(rows, "run string, epoch int, val_acc double")
    lrs = history.plateau_lr(hist, 0.005, mode="max", metric="val_acc")
    assert [(r.epoch, r.lr) for r in history.lr_changes(lrs).collect()] == [(9, 0.0025)]
    assert history.best_checkpoint(hist, "val_acc", "max").first().epoch == 11


def test_class_weights(labels):
    found = {r.grade: round(r.weight, 3) for r in weights.effective_number_weights(labels, "grade").collect()}
    assert found == {0: 1.524, 1: 0.476}


def test_empty_class_weighs_one(labels):
    only = labels.where("grade = 1")
    found = {r.grade: r.weight for r in weights.inverse_frequency_weights(only, "grade").collect()}
    assert found == {0: 1.0, 1: 0.5}


def test_split_sizes(labels):
    parts = splits.stratified_split(labels, "grade").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in parts} == {"train": 700, "val": 87, "test": 89}


def _confusion(spark, tp, fn, tn, fp):
    return spark.createDataFrame([(tp, tn, fp, fn)], "tp long, tn long, fp long, fn long")


def test_metrics_of_committed_predictions(spark):
    row = scoring.binary_metrics(_confusion(spark, 52, 19, 13, 5)).first()
    found = [round(v, 4) for v in (row.accuracy, row.sensitivity, row.specificity, row.precision)]
    assert found == [0.7303, 0.7324, 0.7222, 0.9123]


def test_metrics_of_report(spark):
    row = scoring.binary_metrics(_confusion(spark, 60, 11, 10, 7)).first()
    found = [round(v, 4) for v in (row.accuracy, row.precision, row.sensitivity, row.specificity, row.f1)]
    assert found == [0.7955, 0.8955, 0.8451, 0.5882, 0.8696]


def test_zero_denominators(spark):
    row = scoring.binary_metrics(_confusion(spark, 0, 0, 4, 0)).first()
    assert (row.accuracy, row.sensitivity, row.precision, row.f1) == (1.0, 0.0, 0.0, 0.0)


def test_majority_baseline(spark):
    rows = spark.range(87).select(F.lit("val").alias("split"), (F.col("id") < 70).cast("int").alias("grade"))
    assert round(weights.majority_baseline(rows, "grade", "split").first().majority, 4) == 0.8046


def test_region_summary_denominators(spark):
    # Volumes of three cases, one without the region.
    volumes = spark.createDataFrame([(1, "core", 6.0), (2, "core", 0.0), (3, "core", 3.0)],
                                    "case_id int, region string, mm3 double")
    row = regions.region_summary(volumes).first()
    assert (row.n_cases, row.n_positive, row.total_mm3, row.mean_all, row.mean_positive) == (3, 2, 9.0, 3.0, 4.5)


def test_core_is_necrosis_plus_enhancing(spark):
    seg = spark.range(1000).select((F.col("id") % 7).alias("case_id"), (F.col("id") % 5).cast("int").alias("label"))
    both = regions.region_volumes(seg, {"core": [2, 3], "ncr": [2], "et": [3]})
    total = {r.region: r.v for r in both.groupBy("region").agg(F.sum("voxels").alias("v")).collect()}
    assert total["core"] == total["ncr"] + total["et"]


def test_log_durations(spark):
    # Time stamps of the epoch lines of the logged run.
    stamps = [
        "21:45:26,478", "21:53:05,556", "22:01:08,357", "22:09:01,486", "22:17:47,534", "22:30:38,138",
        "22:38:31,462", "22:46:54,740", "23:00:23,188", "23:07:32,398", "23:14:41,978", "23:21:47,893",
        "23:28:35,926", "23:35:07,395",
    ]
    lines = [
        f"2026-08-07 {s} INFO Epoch {i:3d} | Train: loss=0.0100 acc=0.9900 | Val: loss=0.0200 acc=0.9655 f1=0.9781"
        for i, s in enumerate(stamps, 1)
    ]
    lines.insert(0, "2026-08-07 21:36:14,228 INFO Training on cuda")
    frame = spark.createDataFrame([("run", line) for line in lines], "run string, value string")
    epochs = history.parse_epoch_lines(frame, "run")
    seconds = [r.seconds for r in history.epoch_durations(epochs).collect() if r.seconds is not None]
    assert epochs.count() == 14 and len(seconds) == 13
    assert round(sum(seconds), 3) == 6580.917

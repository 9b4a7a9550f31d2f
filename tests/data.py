"""The small mixed table used by several tests."""

from lacuna.schema import FeatureSchema

SCHEMA = FeatureSchema(
    ids=("id",),
    continuous=("age", "weight"),
    binary=("ismale",),
    onehot={"fries": ("fries_s", "fries_m", "fries_l")},
    split="split",
    order=("age", "weight", "ismale", "fries_s", "fries_m", "fries_l"),
)
N = None
DATA = [
    (0, "train", 44.0, N, 0, 0, 1, 0),
    (1, "train", 49.0, 57.2, 1, 0, 0, 1),
    (2, "val", 26.0, 26.3, 0, N, N, N),
    (3, "val", 16.0, 73.4, 1, 1, 0, 0),
    (4, "test", N, 56.5, 1, 0, 1, 0),
    (5, "test", 57.0, 29.6, 0, 1, 0, 0),
]
TRUTH = [
    (0, "train", 44.0, 15.1, 0, 0, 1, 0),
    (1, "train", 49.0, 57.2, 1, 0, 0, 1),
    (2, "val", 26.0, 26.3, 0, 0, 1, 0),
    (3, "val", 16.0, 73.4, 1, 1, 0, 0),
    (4, "test", 13.0, 56.5, 1, 0, 1, 0),
    (5, "test", 57.0, 29.6, 0, 1, 0, 0),
]
DDL = "id bigint, split string, age double, weight double, ismale int, fries_s int, fries_m int, fries_l int"
BINS = {
    "age": [(0, 20), (20, 40), (40, 80)],
    "weight": [(0, 15.5), (15.5, 31), (31, 50.5), (50.5, 80.4)],
}


def frames(spark):
    return spark.createDataFrame(DATA, DDL), spark.createDataFrame(TRUTH, DDL)


def wrong(spark):
    rows = [list(r) for r in TRUTH]
    rows[0][3] = 9.1
    rows[2][5:] = [1, 0, 0]
    rows[4][2], rows[4][4] = 15.0, 0
    return spark.createDataFrame([tuple(r) for r in rows], DDL)

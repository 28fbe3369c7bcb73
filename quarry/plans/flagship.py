"""The minimum end-to-end slice: request scan -> target cleaning -> fill -> scale ->
time index -> sequential split -> group-mean model -> metrics per split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.operators import evaluate, impute, scale
from quarry.operators.baseline import fit_group_mean, predict_group_mean
from quarry.operators.clean import target_filter
from quarry.operators.split import add_time_index, split_sequential
from quarry.sources.fact import KEY_COLUMNS, TIME_COLUMN, fact
from quarry.session import materialize
from quarry.sources.scan import Request, scan_filtered

FLAGSHIP_REQUEST = dict(target_metric="TS_N", time_range="19970101-19981231")


def modelling_frame(spark: SparkSession, sf_dir: str, request: dict | None = None,
                    group: str = "SG_SIGN", test_size: float = 0.2) -> DataFrame:
    """Rows (of the request, or all) with ``split`` and the group-mean ``prediction`` of the target."""
    target = (request or {}).get("target_metric", "TS_N")
    keep = list(dict.fromkeys([*KEY_COLUMNS, TIME_COLUMN, target, group, "ELM_C", "QTY"]))
    rows = fact(spark, sf_dir, *keep)
    if request:
        rows = scan_filtered(rows, Request(**request))
    # every fit below is an action over these rows: read and join the sources once,
    # keeping only the columns this model uses (a persisted frame is not pruned later)
    rows = materialize(target_filter(rows, target).select(*keep))
    rows, _, _ = impute.impute_mean(rows, "ELM_C")
    rows, _, _ = scale.standard_scale_column(rows, "QTY")
    indexed = add_time_index(rows, TIME_COLUMN, KEY_COLUMNS)
    n = indexed.count()
    split = split_sequential(indexed, n, test_size)
    model = fit_group_mean(split.filter("split = 'train'"), group, target)
    return predict_group_mean(split, model, group)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = modelling_frame(spark, sf_dir, FLAGSHIP_REQUEST)
    return evaluate.metrics_by_split(frame, "TS_N", "prediction", "split",
                                     {"type": "percentage", "value": 5.0})

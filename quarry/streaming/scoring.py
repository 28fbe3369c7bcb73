"""Scoring rows as they arrive (M4 on a file stream).

A model is fitted in batch; its preprocessing state and Spark ML model are
then applied to a Structured Streaming source. Every step of the replay is a
projection or a stream-static join with a small fitted map, so each
micro-batch is scored independently and no state is kept between batches. The
sink is an append-only parquet table with a checkpoint under the cluster's
``spark.checkpoint.dir``, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.learners import FittedModel
from quarry.plans.executor import freeze_state, replay_plan
from quarry.session import ensure_checkpoint_dir


def score_stream(rows: DataFrame, fitted_plan: dict, model: FittedModel, keep: list[str],
                 pred_col: str = "prediction") -> DataFrame:
    """Preprocess ``rows`` (batch or streaming) with a fitted plan and predict."""
    prepared = replay_plan(rows, fitted_plan)
    return model.predict(prepared.select(*dict.fromkeys([*keep, *model.features])), pred_col) \
        .select(*keep, F.col(pred_col))


def start_scoring(spark: SparkSession, source_dir: str, schema, fitted_plan: dict, model: FittedModel,
                  keep: list[str], sink_dir: str, name: str = "quarry_scoring",
                  available_now: bool = True, max_files_per_trigger: int = 64):
    """Stream parquet files landing in ``source_dir`` into scored rows under ``sink_dir``."""
    fitted_plan = freeze_state(fitted_plan)
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
           .parquet(source_dir))
    scored = score_stream(src, fitted_plan, model, keep)
    ckpt = os.path.join(ensure_checkpoint_dir(spark), "streams", name)
    w = (scored.writeStream.format("parquet").outputMode("append").option("checkpointLocation", ckpt)
         .option("path", sink_dir).queryName(name))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()

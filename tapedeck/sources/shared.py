"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, computed and written to the checkpoint folder (spark.checkpoint.dir): later steps survive a lost executor without redoing it."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(found or f"/tmp/checkpoints/tapedeck-{uuid.uuid4().hex}")
    return df.checkpoint()

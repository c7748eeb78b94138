"""Python workers that can import this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame

_ROOT = str(Path(__file__).resolve().parents[2])


def prepared(df: DataFrame) -> DataFrame:
    """``df``, with the package's folder on its Python workers' search path.

    A session can be started from any folder then.  On a cluster ship the package with the
    application (``--py-files``); a folder that a machine lacks does no harm.
    """
    environment = df.sparkSession.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in known:
        environment["PYTHONPATH"] = os.pathsep.join([*known, _ROOT])
    return df

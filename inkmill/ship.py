"""Sending the package to the executors, so that their Python finds it wherever the driver was started."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from .functions import tokens

ROOT = os.path.dirname(os.path.abspath(__file__))
_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's context once, as an archive through Spark's own file server."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    _SENT.add(context.applicationId)
    folder = tempfile.mkdtemp(prefix="inkmill-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "inkmill.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for top, _, names in os.walk(ROOT):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(top, name)
                    z.write(path, os.path.join("inkmill", os.path.relpath(path, ROOT)))
    context.addPyFile(archive)
    for file in tokens.STAND_INS.values():  # the vocabularies too, a few MB, so that all workers count by the same ones
        if path := tokens.vocabulary(file):
            context.addFile(path)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, which first sends the package."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run

import os
import sys

import numpy as np
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cellgrid.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return configure(session)


class Tables:
    """Arrays as model tables."""

    def __init__(self, spark):
        self.spark = spark

    def pixels(self, image, dataset="d", channel="A"):
        rows = [
            (dataset, channel, y, x, float(image[y, x]))
            for y in range(image.shape[0])
            for x in range(image.shape[1])
        ]
        return self.spark.createDataFrame(rows, "dataset string, channel string, y int, x int, value double")

    def labels(self, array, dataset="d", seg="s"):
        rows = [(dataset, seg, int(y), int(x), int(array[y, x])) for y, x in zip(*np.nonzero(array))]
        return self.spark.createDataFrame(rows, "dataset string, seg string, y int, x int, label int")

    def mask(self, array, dataset="d", mask="m"):
        rows = [(dataset, mask, int(y), int(x), int(array[y, x])) for y, x in zip(*np.nonzero(array))]
        return self.spark.createDataFrame(rows, "dataset string, mask string, y int, x int, value smallint")

    def frames(self, height, width, dataset="d", channels=("A",), metadata=None):
        return self.spark.createDataFrame(
            [(dataset, height, width, list(channels), metadata or {})],
            "dataset string, height int, width int, channel_names array<string>, metadata map<string,string>",
        )

    def array(self, df, shape, value="value"):
        out = np.zeros(shape)
        for r in df.select("y", "x", value).collect():
            out[r[0], r[1]] = r[2]
        return out


@pytest.fixture(scope="session")
def tables(spark):
    return Tables(spark)

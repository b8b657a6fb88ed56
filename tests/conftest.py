import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("vitrine-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from vitrine.sources.orders import slate_tables

    return slate_tables(spark, SF)


def make_log(spark, users, n_steps=20, width=25):
    """Wide log from {user_id: [(slate, click[, type]), ...]}; row_idx in order."""
    from vitrine.schema import LOG

    rows = []
    for i, (user, steps) in enumerate(users.items()):
        clicks, idx, lens, kinds, slates = [], [], [], [], []
        for slate, click, *kind in steps:
            clicks.append(click)
            idx.append(slate.index(click) if click in slate else 0)
            lens.append(len(slate))
            kinds.append(kind[0] if kind else 1)
            slates.append(list(slate) + [0] * (width - len(slate)))
        more = n_steps - len(steps)
        rows.append((i, user, clicks + [0] * more, idx + [0] * more, lens + [0] * more,
                     kinds + [0] * more, slates + [[0] * width] * more))
    return spark.createDataFrame(rows, LOG)


def vectors(spark, table):
    """Vector table from {id: list}."""
    return spark.createDataFrame(
        [(int(i), [float(x) for x in v]) for i, v in table.items()],
        "id bigint, vec array<double>")

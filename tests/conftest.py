import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gridloom.session import local_session  # noqa: E402
from gridloom.sources import from_coo  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "6g", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture
def shuffled(spark):
    """Nothing may be broadcast by the library's own choice."""
    spark.conf.set("gridloom.broadcast.maxBytes", "0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("gridloom.broadcast.maxBytes")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture(scope="session")
def tensor(spark):
    """Tensor from a NumPy array; zeros are left out unless asked for."""

    def make(array, keep_zeros=False):
        array = np.asarray(array, dtype=float)
        names = [f"k{m}" for m in range(array.ndim)]
        rows = [
            (*map(int, at), float(v)) for at, v in np.ndenumerate(array) if keep_zeros or v != 0
        ]
        fields = ", ".join(f"{n} bigint" for n in names)
        df = spark.createDataFrame(rows, f"{fields}, x double")
        return from_coo(df, names, "x", array.shape)

    return make


@pytest.fixture(scope="session")
def factor_table(spark):
    def make(array):
        rows = [(i, [float(v) for v in row]) for i, row in enumerate(np.asarray(array))]
        return spark.createDataFrame(rows, "idx bigint, vec array<double>")

    return make

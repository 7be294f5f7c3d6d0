import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

@pytest.fixture(scope="session")
def spark():
    from panelflow import build_session

    session = build_session(
        "local[8]", "tests", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "6g"}
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_panel(spark):
    """``{series: values}`` -> staged daily panel; None stands for a null."""
    from panelflow.plans.staging import stage

    def build(data, start="2020-01-01"):
        rows = []
        for name, values in data.items():
            for i, v in enumerate(values):
                ts = (pd.Timestamp(start) + pd.Timedelta(days=i)).to_pydatetime()
                rows.append((name, ts, None if v is None or v != v else float(v)))
        return stage(spark.createDataFrame(rows, "series_id string, ts timestamp, value double"))

    return build


@pytest.fixture(scope="session")
def holes():
    """Three series of different length with about a fifth of the values missing."""
    rng = np.random.default_rng(0)
    data = {}
    for name, n in (("a", 300), ("b", 37), ("c", 1)):
        v = np.round(rng.normal(100, 5, n), 2)
        data[name] = [None if rng.random() < 0.2 else float(x) for x in v]
    return data


@pytest.fixture(scope="session")
def system():
    """Three-variable VAR(1) sample; the third variable has a large level."""
    rng = np.random.default_rng(1)
    a = np.array([[0.4, 0.2, 0], [0, 0.3, 0.1], [0.1, 0, 0.5]])
    e, y = rng.normal(size=(300, 3)), np.zeros((300, 3))
    for t in range(1, 300):
        y[t] = a @ y[t - 1] + e[t] + 0.5
    return y + np.array([0, 0, 1000])


@pytest.fixture(scope="session")
def system_panel(make_panel, system):
    return make_panel({n: system[:, i] for i, n in enumerate("abc")})

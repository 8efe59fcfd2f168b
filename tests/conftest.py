import os
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df):
    """Rows as a sorted list of tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="session")
def sf():
    if not SF.exists():
        pytest.skip("no test data here")
    return str(SF)


def compare(name, queries, oracles, spark, sf):
    """The query's rows and DuckDB's, in one notation."""
    import duckdb
    import numpy as np
    import pandas as pd

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(sf).iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")

    def plain(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "<null>"
        if isinstance(v, (float, np.floating)):
            return repr(round(float(v), 5))
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        return str(int(v)) if isinstance(v, (int, np.integer)) else str(v)

    def table(pdf):
        pdf = pdf[sorted(pdf.columns)]
        return list(pdf.columns), sorted(map(tuple, pdf.map(plain).values.tolist()))

    return table(queries[name](spark, sf).toPandas()), table(con.execute(oracles[name]).fetch_df())

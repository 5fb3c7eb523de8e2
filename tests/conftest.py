import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[2]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def same(spark):
    """Holds a registered query against its SQL on the smallest tables."""

    def check(name, sf_dir=SMALL):
        import duckdb
        import pandas as pd

        import __spark_entry__ as entry

        db = duckdb.connect()
        for f in os.listdir(sf_dir):
            db.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
        got, want = entry.queries()[name](spark, sf_dir).toPandas(), db.sql(entry.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)

        def rows(df):
            plain = lambda v: None if v is None or pd.isna(v) else round(float(v), 6) + 0.0 if isinstance(v, float) else int(v) if hasattr(v, "__index__") and not isinstance(v, bool) else str(v)
            return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)

        number = lambda v: float(v) if isinstance(v, int) and not isinstance(v, bool) else v
        a, b = ([tuple(number(v) for v in r) for r in rows(x)] for x in (got, want))
        assert sorted(a, key=str) == sorted(b, key=str)

    return check

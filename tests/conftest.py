import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def same_rows(spark, run, sql, folder):
    """Whether a query's rows are the SQL's, names and values."""
    import math

    import duckdb

    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.6g}"
        if isinstance(v, (list, tuple)):
            return str([plain(x) for x in v])
        return str(v)

    def rows(table):
        names = sorted(table.column_names)
        return names, sorted(tuple(map(plain, r)) for r in zip(*(table.column(c).to_pylist() for c in names)))

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    want = con.sql(sql).arrow()
    want = want.read_all() if hasattr(want, "read_all") else want
    return rows(run(spark, folder).toArrow()) == rows(want)

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tracelab.session import build_session

    scratch = tempfile.mkdtemp(prefix="spark-")
    session = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.local.dir": scratch, "spark.checkpoint.dir": f"file://{scratch}/shared", "spark.sql.warehouse.dir": f"{scratch}/warehouse", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    for name in os.listdir(SF):
        path = f"{SF}/{name}" + ("/*.parquet" if os.path.isdir(f"{SF}/{name}") else "")
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con

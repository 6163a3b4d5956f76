"""The earlier rules' queries against their SQL, where a recording ends before the gate."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from herdlens.operators import legacy as L
from herdlens.queries import ORACLE_SQL, QUERIES
from herdlens.queries.fixtures import FPS, NODES, staged
from herdlens.queries.legacy import FACTOR, GATE
from herdlens.queries.pairs import scaled


@pytest.fixture(scope="module", params=[GATE - 18, GATE + 1])
def short_dir(request, spark, data, tmp_path_factory):
    """A whole recording and one of so many frames."""
    folder = tmp_path_factory.mktemp("short")
    rows = spark.read.parquet(f"{data}/sf0.01/embeddings.parquet")
    whole = rows.where("vec_id < 200").unionByName(rows.where("vec_id < 50").withColumn("vec_id", F.col("vec_id") + 200))
    both = whole.unionByName(rows.where(F.col("vec_id") < request.param).withColumn("vec_id", F.col("vec_id") + 250))
    both.coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder), request.param


@pytest.mark.parametrize("name", ["legacy_detectors", "legacy_detectors_swapped", "legacy_identities"])
def test_recordings_that_end_before_the_gate(spark, short_dir, name):
    import duckdb

    folder, frames = short_dir
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{folder}/embeddings.parquet/*.parquet')")
    got, want = QUERIES[name](spark, folder).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert set(want.session) == ({"s0", "s1"} if frames > GATE else {"s0"})
    order = lambda df: df.sort_values(["session", "sidx", "tA", "tB"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want[list(got.columns)]), check_dtype=False)


def test_detectors_keep_short_recordings(spark, short_dir):
    folder, frames = short_dir
    found = L.detectors(scaled(spark, folder, FACTOR, staged), FPS, len(NODES))
    assert found.where("session = 's1'").count() == 6 * frames

"""Point queries against their SQL on values that the supplied tables don't hold."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from tests.compare import rows_of, rows_of_sql
from voxlake.plans.registry import ORACLES, PLANS


def test_log_of_values_beyond_a_type_and_of_none(spark, tmp_path):
    odd = [None, float("nan"), float("inf"), -float("inf"), 1638.4, 5000.0, -5000.0, 3e9, 1e30, -1e30, -0.01, 0.0, 0.07]
    vectors = [[x] + [0.3] * 63 for x in odd]
    pq.write_table(pa.table({"vec_id": pa.array(range(len(odd)), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([0] * len(odd), pa.int32())}), tmp_path / "embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    assert rows_of(PLANS["p_log"](spark, str(tmp_path))) == rows_of_sql(c, ORACLES["p_log"])

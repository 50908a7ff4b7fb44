"""Queries whose work must grow with their tables and no faster."""

import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from strandline import queries
from strandline.functions import geometry
from strandline.proxies import frame_points


def test_triangle_makes_its_distances_once(spark, tmp_path):
    assert str(geometry.triangle_angle(F.col("p"))).count("array_max") == 1
    rows = [(1, [float((7 * k * k + 3) % 11) for k in range(64)], 0), (1, [float((5 * k * k + 2) % 13) for k in range(64)], 0), (2, [float((3 * k * k + 1) % 17) for k in range(64)], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    points = frame_points(spark, str(tmp_path))
    assert {(r.frame, len(r.points)) for r in points.collect()} == {(1, 42), (2, 21)}
    assert "Generate" not in points._jdf.queryExecution().optimizedPlan().toString()  # a frame is shuffled as one row, not as its atoms
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = dict(con.execute(f"SELECT frame, bend FROM ({queries.ORACLES['triangle_bend']})").fetchall())
    assert {r.frame: r.bend for r in queries.QUERIES["triangle_bend"](spark, str(tmp_path)).where("frame = 2").collect()} == {2: want[2]}


def test_medoids_on_a_line_without_pairs(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(k, int(rng.integers(0, 9)), None if k % 29 == 0 else float(rng.integers(-5000, 5000)) / 100) for k in range(1, 400)] + [(900, 3, 7.25), (901, 3, 7.25)]
    rows = [(k, n, x) for k, n, x in rows if n % 4 != 1 or x is not None]  # one cluster without nulls, whose items would all win
    con = duckdb.connect()
    for name, part in (("many", rows), ("odd", [*rows, (950, None, 1.0), (951, 3, 0.12345)]), ("two", [(1, 0, 2.5), (2, 0, 9.0), (3, 1, 4.0)])):
        spark.createDataFrame(part, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/{name}/supplier.parquet")
        con.execute(f"CREATE OR REPLACE VIEW supplier AS SELECT * FROM '{tmp_path}/{name}/supplier.parquet/*.parquet'")
        df = queries.QUERIES["medoid"](spark, f"{tmp_path}/{name}")
        want = con.execute(f"SELECT cluster, item, mean_distance FROM ({queries.ORACLES['medoid']})").fetchall()
        assert {tuple(r) for r in df.select("cluster", "item", "mean_distance").collect()} == set(want)
        if name == "many":
            assert not re.search(r"i#\d+L? < j#", df._jdf.queryExecution().optimizedPlan().toString())  # no join makes pairs

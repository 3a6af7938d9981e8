"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from compare import SF, assert_same, duck
from rasterspark.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return duck()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert_same(df, ORACLES[name], con)
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("rows", [497, 498, 499])
def test_label_repair_of_a_source_that_lacks_tiles(spark, tmp_path, rows):
    """The last source has one to three of its four tiles: its other pixels are outside the tiles, but of the image."""
    spark.read.parquet(f"{SF}/embeddings.parquet").where(f"vec_id >= 480 AND vec_id < {rows}").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert_same(QUERIES["label_repair"](spark, str(tmp_path)), ORACLES["label_repair"], con)

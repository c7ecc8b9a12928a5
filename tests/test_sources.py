import json

from pyspark.sql import functions as F

from quern.operators import index, vectors
from quern.sources import files
from quern.sources.paged import PagedSource


def test_paged_source_reads_every_page_once(spark, tmp_path):
    for page in range(7):
        (tmp_path / f"{page}.json").write_text(json.dumps([{"id": 10 * page + i, "name": f"n{i}"} for i in range(3)] + [{"id": None}]))
    spark.dataSource.register(PagedSource)
    rows = spark.read.format("quern_paged").schema("id bigint, name string").option("template", f"file://{tmp_path}/{{page}}.json").option("pages", 7).option("per_partition", 2).load()
    assert rows.count() == 28 and rows.where("id IS NOT NULL").select("id").distinct().count() == 21


def test_append_missing_twice(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(10).withColumn("v", F.col("id") * 2)
    files.append_missing(rows.where("id < 4"), path, "id")
    files.append_missing(rows, path, "id")
    files.append_missing(rows, path, "id")
    assert spark.read.parquet(path).count() == 10


def test_missing_columns_are_reported(spark):
    import pytest

    with pytest.raises(ValueError, match="label"):
        files.require(spark.range(1), {"id", "label"})


def test_index_recall_against_exact_search(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), "embedding")
    found = index.search(asked, rows, index.fit(rows, 16), 10, probes=11).select("q_id", "vec_id")
    exact = vectors.top_k(asked, rows, 10).select("q_id", "vec_id")
    assert found.intersect(exact).count() >= 0.9 * exact.count()


def test_index_search_ranks_exactly_in_the_probed_cells_without_moving_rows(spark):
    import numpy as np

    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), "embedding")
    centre = index.fit(rows, 16)
    found = index.search(asked, rows, centre, 10, probes=3, block_bytes=64 * 8 * 4)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    held = rows.orderBy("vec_id").toPandas()
    unit = vectors.unit_rows(np.stack(held["embedding"]).astype(float))
    cell, plain = (unit @ centre.T).argmax(1), {}
    for q in range(0, len(unit), 50):
        near = np.flatnonzero(np.isin(cell, np.argsort(-(centre @ unit[q]), kind="stable")[:3]))
        sim = np.round(unit[near] @ unit[q], 6)
        plain[q] = near[np.lexsort((near, -sim))[:10]].tolist()
    ours = {}
    for r in found.orderBy("q_id", "rank").collect():
        ours.setdefault(r.q_id, []).append(r.vec_id)
    assert ours == plain

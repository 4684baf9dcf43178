import duckdb
import pandas as pd
import pytest
from helpers import awkward, make_docs, prose

import corpus_pipeline
from peerpanel.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    bench = prose(900, 40)
    rows = [(i, "\n".join(prose(100 * i + j, 12) for j in range(6))) for i in range(100, 130)] + awkward()
    rows += [(200, rows[0][1]), (201, prose(7, 20) + "\n" + bench)]
    docs = make_docs(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(d, 1, 0) for d, _ in rows if d], "doc_id long, quality int, toxic int") \
        .write.parquet(f"{tmp_path}/labels.parquet")
    x, kept = docs, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        y = stage(spark, x, str(tmp_path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert y.columns == docs.columns and y.dtypes == docs.dtypes, name
        y.write.parquet(f"{tmp_path}/{name}")
        x = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r["doc_id"] for r in x.select("doc_id").collect()}
    clean = set(range(100, 130))
    assert all(clean <= ids for ids in kept.values())
    assert 200 in kept["line_dedup"] and 200 not in kept["simhash_near_dedup"]
    assert 201 in kept["simhash_near_dedup"] and 201 not in kept["benchmark_decontamination"]
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in run.select("doc_id").collect()} == kept["bpe_encoding"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    order = lambda x: x[cols].astype(str).sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want))

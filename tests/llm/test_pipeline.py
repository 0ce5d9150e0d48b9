from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from crestline.llm import decontam
from crestline.llm.queries import QUERIES
from crestline.llm.shared import table

SF = "/root/testdata/sf0.001"


def test_stages_narrow_the_table(spark):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        path = corpus_pipeline.scratch(spark, "test-stage")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    assert docs.groupBy("text").count().where("count > 1").count() == 0
    assert docs.where(F.size(decontam.leaked(docs, table(spark, SF, "benchmark"))) > 0).count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF).toPandas().sort_values("doc_id")
    assert (out.start.to_numpy()[1:] == out.n_tokens.cumsum().to_numpy()[:-1]).all() and out.start.iloc[0] == 0


def test_stages_on_odd_tables(spark):
    docs = table(spark, SF, "documents")
    odd = docs.limit(3).unionByName(spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "src0", 0), (10**6 + 2, "many words " * 5_000, None, None, 1)], docs.schema)).withColumn("score", F.lit("extra"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SF).count() <= odd.count()
        assert stage(spark, odd.where("false"), SF).count() == 0, name


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))

"""The stages one after another over a small table."""

from corpus_pipeline import STAGES, run
from landgrid.llm.shared import shared_path

FOLDER = "/root/testdata/sf0.001"


def test_every_stage(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in STAGES:
        path = shared_path(spark, "test")
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != STAGES[-1][0]:
            assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] > counts[3] == counts[4] > 0.6 * counts[0]
    pieces = docs.groupBy("doc_id").sum("length").count()
    assert pieces == counts[4] and run(spark, FOLDER).count() == counts[5]

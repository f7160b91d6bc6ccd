"""The stages of the pipeline, each on what the one before kept."""

import corpus_pipeline
from pyspark.sql import functions as F

from formloom.llm import quality


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf)
        docs = corpus_pipeline.written(docs, name)
        sizes.append(docs.count())
        if name != "best_fit_packing":
            assert docs.columns == columns
        if name == "quality_rules":
            kept = {r.doc_id for r in quality.rules(before).where("kept").collect()}
            assert {r.doc_id for r in docs.collect()} == kept
    assert sizes[0] > sizes[1] > sizes[4] > 0.5 * sizes[0]
    assert {"doc_id", "sequence_id", "offset"} <= set(docs.columns)


def test_stages_on_odd_tables(spark):
    """Empty tables, nulls in every column, repeated rows and columns named like the operators' own."""
    sf, schema = "/root/testdata/sf0.001", "doc_id long, text string, lang string, source string, n_chars long"
    prose = "The river ran past the old mill and the people of the town went down to it on the first day of the month to wash their clothes and talk."
    rows = [(1, prose, "en", "s", 1), (1, prose, "en", "s", 1), (2, None, None, None, None), (None, prose + " More.", None, None, None), (3, "", "en", "s", 0)]
    odd = ["doc", "th", "i", "starts", "hits", "kept", "comp", "rep", "n_lines", "n_removed", "w", "h", "ref", "common"]
    table = spark.createDataFrame(rows, schema)
    for k, c in enumerate(odd):
        table = table.withColumn(c, F.lit(k))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, sf)
        assert out.columns == table.columns
        assert all([r[c] for c in odd] == list(range(len(odd))) for r in out.collect())
        assert stage(spark, table.limit(0), sf).count() == 0
    assert corpus_pipeline.best_fit_packing(spark, table, sf).count() == len(rows)

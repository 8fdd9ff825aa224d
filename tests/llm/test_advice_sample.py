"""One labelled id on very many rows: the sample's bound holds for rows, and every id has its first text."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushframe.llm.common import TEXTS, held_out, labelled_sample


def test_rows_of_an_id_are_bounded(spark):
    hot = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 2000).cast("string")).alias("text"))
    rest = spark.range(100, 160).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    docs = hot.unionByName(rest).unionByName(rest)
    labels = docs.select("doc_id", F.lit(1).alias("toxic")).distinct()
    ids = {r.doc_id for r in rest.filter(~held_out(F.col("doc_id"))).collect()}
    assert not spark.range(1).filter(held_out(F.lit(1))).count()
    for bound, own in ((100, 100 - len(ids)), (1000, TEXTS)):
        rows = labelled_sample(docs, labels, "toxic", bound).collect()
        assert sorted(r.id for r in rows if r.id != 1) == sorted(ids)
        assert len({r.text for r in rows if r.id == 1}) == sum(r.id == 1 for r in rows) == own

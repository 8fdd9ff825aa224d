"""Exact copies where an id is both kept and dropped: the longest original stays."""

from __future__ import annotations

from hushframe.llm import exact


def test_longest_original_of_a_repeated_id_stays(spark):
    rows = [
        (5, "a b"), (5, "a   b"), (5, "a  b"), (6, "ab"), (None, "c d"), (None, "cd"), (None, "c  d "), (None, "c  d\t"),
        (None, "e"), (4, "f g"), (4, "fg"), (3, "f  g"),
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted(((r.doc_id, r.text) for r in exact.drop_exact_copies(table).collect()), key=repr)
    assert got == sorted([(5, "a   b"), (None, "c  d\t"), (None, "e"), (3, "f  g")], key=repr)

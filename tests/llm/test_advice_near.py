"""Near copies where ids are null or repeated: each component keeps its document."""

from __future__ import annotations

import brute
from hushframe.llm import simhash

A, B, C, D, E, G = (" ".join(f"{w}{i}" for i in range(40)) for w in "abcdeg")


def test_every_component_keeps_its_document(spark):
    rows = [
        (3, B), (5, A), (5, B), (5, A),  # 5 names A's component only
        (None, B), (None, C), (None, C.upper()), (None, C), (None, D), (7, E), (None, E),
        (8, G), (8, G.upper()), (9, G),
    ]
    table = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, near_root int")
    left = simhash.drop_near_copies(table.repartition(3))
    assert left.columns == table.columns
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=repr)
    assert got == sorted([(3, B), (5, A), (None, C.upper()), (None, D), (7, E), (8, G), (8, G.upper())], key=repr)
    roots = brute.components(list(range(len(rows))), [brute.fingerprint(t) for _, t in rows])
    of_text = {t: c for (_, t), c in zip(rows, roots)}
    assert {of_text[t] for _, t in got} == set(roots)
    assert sum(i is None for i, _ in got) == len({of_text[C], of_text[D]})


def test_ids_that_only_go(spark):
    table = spark.createDataFrame([(1, A), (None, A), (None, A), (2, A), (2, A)], "doc_id long, text string")
    assert [(r.doc_id, r.text) for r in simhash.drop_near_copies(table).collect()] == [(1, A)]

"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

from __future__ import annotations

import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from hushframe.llm import exact, language, lengths, neighbours, packing, pieces, quality, revisits, simhash, toxicity
from hushframe.llm import transducers as T
from hushframe.llm.common import blocks, held_out

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ROWS = [
    (1, "the cat sat on the mat", "en"),
    (2, "the cat  sat on\tthe mat", "en"),
    (3, "the cat sat on the mat", "en"),
    (3, "the cat sat on the mat", "en"),
    (4, None, "en"),
    (5, "", None),
    (6, " \n\t ", "en"),
    (None, "le chat est sur la table", "fr"),
    (None, None, None),
    (8, LONG, "en"),
    (9, LONG + " ", "en"),
    (10, "x" * 5000, None),
    (11, "<|endoftext|> ΣΑΣ İ \U0001f600 �", "fr"),
    (12, "12345 !!! ...", None),
]
#: Names that the operators use inside.
EXTRA = (
    "id score kept group_size keep_id text_sha256 body bytes digit row next rest round size label part print key n "
    "low high node component root least lang_pred found held_out piece start length ids sequence_id offset pack_shard "
    "gone_id twice_id kept_id kept_sha exact_sha stay go points sha"
).split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, None, None if t is None else len(t)) for i, t, lang in ROWS]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(None).cast("string") for c in EXTRA}).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (3, 0, 1), (3, None, None), (None, 1, 1), (8, 1, 0), (999, 0, 1), (10, 0, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def by_id(rows, *names):
    return sorted((tuple(r[n] for n in ("doc_id", *names)) for r in rows), key=repr)


def test_exact(docs, empty):
    got = exact.exact_classes(docs, first=4, growth=3).collect()
    expected, stay = brute.exact([(i, t) for i, t, _ in ROWS])
    assert by_id(got, "keep_id", "group_size", "text_sha256") == expected
    assert sum(r.kept for r in got) == stay
    again = exact.exact_classes(docs).collect()
    assert by_id(again, "keep_id", "group_size", "text_sha256") == expected
    assert exact.exact_classes(empty).collect() == []


def test_drop_exact(docs, empty):
    left = exact.drop_exact_copies(docs)
    assert left.columns == docs.columns
    assert len(left.collect()) == brute.exact([(i, t) for i, t, _ in ROWS])[1]
    assert 2 in {r.doc_id for r in left.collect()}  # two spaces and a tab: the longest original
    assert exact.drop_exact_copies(empty).collect() == []


def test_exact_groups_of_every_size(spark):
    draw = random.Random(5)
    texts = ["".join(draw.choices("ab \n", k=draw.randint(0, 9))) for _ in range(500)]
    texts += ["long " * 400 + tail for tail in "aabbc"] + ["é" * n for n in (31, 32, 33, 33)]
    got = exact.exact_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), first=2, growth=2)
    expected, stay = brute.exact(list(enumerate(texts)))
    rows = got.collect()
    assert by_id(rows, "keep_id", "group_size", "text_sha256") == expected and sum(r.kept for r in rows) == stay


def test_simhash(docs, empty):
    got = simhash.simhash_groups(docs).collect()
    prints = [brute.fingerprint(t) for _, t, _ in ROWS]
    roots = brute.components([i for i, _, _ in ROWS], prints)
    assert by_id(got, "fingerprint", "component_id") == sorted(
        ((i, f"{p:016x}", c) for (i, _, _), p, c in zip(ROWS, prints, roots)), key=repr
    )
    assert simhash.simhash_groups(empty).collect() == []


def test_drop_near(docs, empty):
    left = simhash.drop_near_copies(docs)
    assert left.columns == docs.columns
    ids = sorted(r.doc_id for r in left.collect() if r.doc_id is not None)
    assert ids == [1, 4, 8, 10, 11, 12]  # 4 is the first without a word
    assert simhash.drop_near_copies(empty).collect() == []


def test_language(docs, empty):
    model = language.learn_languages(docs, F.lit(True))
    assert model.languages == ["en", "fr"]
    got = language.identify(docs, model).collect()
    assert len(got) == len(ROWS)
    for r, text in zip(by_id(got, "lang_pred", "score"), [t for _, t in sorted(((i, t) for i, t, _ in ROWS), key=repr)]):
        if not any(c.isalpha() for c in text or ""):
            assert r[1:] == ("und", 0.0)
        assert 0 <= r[2] <= 1
    nothing = language.learn_languages(empty, F.lit(True))
    assert nothing.languages == [] and language.identify(empty, nothing).collect() == []
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}
    kept = language.drop_unknown(docs, nothing)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, None, 8, 9, 10, 11}


def test_more_than_eight_languages(spark):
    names = [f"l{i:02}" for i in range(19)]
    rows = [(i, " ".join(f"{chr(97 + i)}{c}{d}" for c in "aeiou" for d in "bcd") + " " + "z" * (i % 3), n) for i, n in enumerate(names)]
    table = spark.createDataFrame(rows * 2, "doc_id long, text string, lang string")
    model = language.learn_languages(table, F.lit(True))
    assert model.masks.shape[1] == 3
    got = {r.doc_id: r.lang_pred for r in language.identify(table, model).collect()}
    assert got == {i: n for i, _, n in rows}


def test_false_positives_are_corrected():
    text = "some words of any kind"
    model = language.LanguageModel(["a", "b"], np.full((1024, 1), 2, np.uint8))
    for _, code in language.gram_codes([text]):
        for position in language.positions(code, 1024):
            model.masks[position] |= 1
    names, score = model.predict([text])
    assert names == ["a"] and score[0] > 0.9  # b's filter is full, so what it finds says nothing


def test_toxicity(docs, empty, labels):
    for known in (labels, labels.limit(0)):
        model = toxicity.learn_toxicity(docs, known)
        got = toxicity.score_toxicity(docs, model).collect()
        assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
        assert toxicity.score_toxicity(empty, model).collect() == []
        assert toxicity.drop_toxic(docs, model).columns == docs.columns
    assert toxicity.learn_toxicity(empty, labels).score([None, "", "you stupid idiot, you moron"])[2] >= 0.3


def test_clauses_and_not_words():
    rate = toxicity.Grammar(toxicity._classes()).clause
    plain, aimed = rate("an idiot"), rate("you are an idiot")
    assert rate("they said nothing") == 0
    assert 0 < rate("not an idiot") < plain < aimed
    assert rate("they said that idiot") < rate("that idiot")
    assert rate("kill time") < rate("kill you") and rate("never kill you") < rate("kill you")
    assert rate("idiot idiot") < 2 * plain


def test_composition_is_feeding_one_into_the_other():
    parts = [T.reported_speech(), T.negation(), T.target(), T.insult(), T.threat()]
    following, weights = T.grammar()
    draw = random.Random(3)
    for _ in range(200):
        marks = [draw.randrange(6) for _ in range(draw.randint(0, 12))]
        expected, line = 0.0, marks
        for part in parts:
            state, written = part.start, []
            for mark in line:
                state, out, weight = part.step(state, mark)
                written.append(out)
                expected += weight
            line = written
        state, total = 0, 0.0
        for mark in marks:
            total += weights[state][mark]
            state = following[state][mark]
        assert total == pytest.approx(expected)


def test_quality(docs, empty, labels):
    for known in (labels, labels.limit(0)):
        model = quality.learn_quality(docs, known)
        got = quality.score_quality(docs, model).collect()
        assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
        assert quality.score_quality(empty, model).collect() == []
    quality.learn_quality(empty, labels)


def test_passage_sums_do_not_depend_on_neighbours():
    texts = [None, "", "  lead", "ONE two two | $$ 3", "a " * 200, "é ß", LONG[:3000], "tail \n"]
    alone = {i: np.concatenate([f for _, f in quality.passages([t])] or [np.zeros((0, quality.WIDTH))]) for i, t in enumerate(texts)}
    owner, features = map(np.concatenate, zip(*quality.passages(texts)))
    for i in range(len(texts)):
        assert np.allclose(features[owner == i], alone[i])
        words = len((texts[i] or "").split())
        assert len(alone[i]) == -(-words // quality.PASSAGE)
    row = alone[3][0]
    assert row[quality.CLASSES + 1] == pytest.approx(1 / 6) and row[quality.CLASSES + 2] == pytest.approx(5 / 6)


def test_attention_learns_which_passage_counts():
    draw = np.random.default_rng(1)
    sizes = draw.integers(1, 9, 300)
    features = draw.normal(0, 1, (sizes.sum(), quality.WIDTH))
    first = np.cumsum(sizes) - sizes
    y = draw.integers(0, 2, 300).astype(float)
    features[first[y == 1] + draw.integers(0, sizes[y == 1]), 3] += 6  # one passage of each good bag
    model = quality.fit(features, sizes, y)
    hidden = model.encode(features)
    logit = model.attention(hidden)
    right = 0
    for a, n, label in zip(first, sizes, y):
        share = np.exp(logit[a : a + n] - logit[a : a + n].max())
        z = share @ hidden[a : a + n] / share.sum()
        right += (z @ model.weights["c"] + model.weights["b"] > 0) == label
    assert right / 300 > 0.95


def test_pieces(docs, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = pieces.encode_pieces(docs, PIECES).collect()
    expected = sorted(((i, library.encode(t or "", add_eos=True)) for i, t, _ in ROWS), key=repr)
    assert by_id(got, "ids") == expected
    for r in got:
        assert r.decoded == library.decode(r.ids) and len(r.starts) == len(r.ends) == len(r.ids)
    assert pieces.encode_pieces(empty, PIECES).collect() == []


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    cut = packing.token_pieces(docs, WORDS, context=64)
    got = packing.pack(cut, context=64, shard=50).collect()
    want = []
    for i, t, _ in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(i, k, np.array(ids[64 * k : 64 * k + 64], "<u4").tobytes()) for k in range(-(-len(ids) // 64))]
    assert by_id([r for r in got], "piece", "ids") == sorted(((i, k, bytearray(b)) for i, k, b in want), key=repr)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in places.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(packing.token_pieces(empty, WORDS)).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_sum_of_squares_by_brute_force(sizes):
    sequences, offsets = packing.sum_of_squares(np.array(sizes, np.int64), 20)
    gaps: dict[int, int] = {}
    for size, sequence, offset in zip(sizes, sequences.tolist(), offsets.tolist()):
        def cost(gap):
            left = list(gaps.values())
            left.remove(gap)
            left.append(gap - size)
            return sum(left.count(g) ** 2 for g in set(left) if 0 < g < 20)

        fits = {gap for gap in gaps.values() if gap >= size}
        if fits:
            assert cost(gaps[sequence]) == min(map(cost, fits))
        else:
            assert sequence not in gaps
        gap = gaps.get(sequence, 20)
        assert offset == 20 - gap
        gaps[sequence] = gap - size
        if not gaps[sequence]:
            gaps[sequence] = 0


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from([chr(i) for i in range(9, 0x250)] + list(" ' s re <| ")), max_size=80))
def test_words_are_encoded_like_texts(text):
    use = packing.word_ids(WORDS)
    assert use([text])[0] == np.array(use.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_lengths(docs, empty):
    count = lengths.token_count(docs, RANKS, public_tokenizers.PATTERN)
    got = lengths.length_histogram(docs, count).collect()
    assert sum(r.documents for r in got) == len(ROWS) and min(r.length for r in got) == 0
    none = lengths.length_histogram(empty, lengths.token_count(empty, RANKS, public_tokenizers.PATTERN))
    assert none.collect() == []
    limits = empty.sparkSession.createDataFrame([(3,)], "limit long")
    assert [r.total for r in lengths.truncated_totals(none, limits).collect()] == [None]


def test_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(100, 130)] + [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
        (8, [0.0, 1.0]), (9, [1.0, 1.0]), (9, [1.0, 1.0]), (None, [1.0, 0.0]), (10, []), (11, [1.0, 0.0, 0.0]),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns(
        {c: F.lit(0) for c in ("id", "v", "size", "shard", "block", "score", "rank", "query_id")}
    )
    for factor, shard in ((1.0, 4096), (1.0, 3), (1.1, 7)):
        got = neighbours.nearest(table, table, factor=factor, shard=shard, block=5).collect()
        answers = {}
        for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
            answers.setdefault(r.query_id, []).append(r.vec_id)
        assert set(answers) == {1, 2, 8, 9, *range(100, 130)}  # 11 has no other vector of its length
        if factor == 1.0:
            assert answers[1] == [2, 100, 101, 102, 103] and answers[100] == [1, 2, 101, 102, 103]
            assert answers[8] == [9, 9, 1, 2, 100]
    assert neighbours.nearest(table.limit(0), table.limit(0)).collect() == []
    assert neighbours.nearest(table, table.limit(0)).collect() == []


def test_revisits(spark):
    at = "2024-01-01 00:00:0"
    tag = {"ETag": '"a"'}
    rows = [
        (1, "response", "http://www.A.com:80/x/?b=2&a=1&utm_source=q#f", at + "1", 200, {"etag": 'W/"a"', "Content-Type": "t", "Age": "1"}, "s1"),
        (2, "response", "https://a.com/x?a=1&b=2", at + "3", 404, tag, "s2"),
        (3, "revisit", "a.com/x?a=1&b=2", at + "5", 304, {"ETAG": '"a"', "Content-Type": "u", "AGE": "2", "x": None}, None),
        (3, "revisit", "a.com/x?a=1&b=2", at + "5", 304, {"ETAG": '"a"', "Content-Type": "u", "AGE": "2", "x": None}, None),
        (4, "revisit", "http://a.com/x?a=1&b=2", at + "1", 304, tag, None),
        (5, "revisit", None, at + "9", 304, tag, None),
        (6, "revisit", "http://a.com/x?a=1&b=2", None, 304, tag, None),
        (7, "revisit", "http://a.com/x?a=1&b=2", at + "9", 304, None, None),
        (8, "revisit", "http://a.com/x?a=1&b=2", at + "9", 304, {"etag": '"z"'}, None),
        (None, "revisit", "http://a.com/x", at + "9", 304, tag, None),
        (9, None, "http://a.com/x", at + "9", 200, tag, "s9"),
        (10, "response", "http://a.com/x?a=1&b=2", at + "6", 200, {}, "s10"),
        (11, "response", "http://a.com/x?a=1&b=2", at + "6", 200, {"etag": '"a"'}, "s11"),
        (12, "revisit", "http://a.com/x?a=1&b=2", at + "7", 304, tag, None),
    ]
    schema = "record_id long, record_type string, url string, captured string, status int, headers map<string,string>, body string"
    table = spark.createDataFrame(rows, schema).withColumns({c: F.lit(0) for c in ("key", "at", "full", "stored", "update", "bucket")})
    for bucket in (1, 3, 1024):
        got = {r.record_id: r for r in revisits.resolve_revisits(table, ("body",), bucket).collect()}
        assert {i: (r.state, r.response_id, r.body) for i, r in got.items()} == {
            3: ("resolved", 1, "s1"), 4: ("missing", None, None), 5: ("missing", None, None), 6: ("missing", None, None),
            7: ("unvalidated", 11, "s11"), 8: ("mismatch", None, None), 12: ("resolved", 11, "s11"),
        }
        assert got[3].headers == {"etag": '"a"', "content-type": "t", "age": "2"} and got[7].headers == {"etag": '"a"'}
    assert revisits.resolve_revisits(table.limit(0)).collect() == []


def test_crowded_captures_are_split(spark):
    """One URL has all records but one, which lies decades before: no bucket holds much more than its size."""
    rows = [(0, "b.com", 0, True)] + [(i, "a.com", 10**15 + i // 2, i % 3 == 0) for i in range(1, 4000)]
    table = spark.createDataFrame(rows, "record_id long, key string, at long, full boolean")
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(folder.iterdir())
    got = dict(revisits.latest_responses(table, 100).collect())
    want, latest, waiting = {}, None, None
    for i, _, at, full in rows[1:]:
        if at != (rows[i - 1][2] if i > 1 else None):
            latest, waiting = waiting if waiting is not None else latest, None
        if full:
            waiting = i
        elif latest is not None:
            want[i] = latest
    assert got == want
    [times] = [p for p in set(folder.iterdir()) - before if p.name.startswith("capture-times")]
    sizes = spark.read.parquet(str(times)).groupBy("key", "bucket").count().collect()
    assert max(r["count"] for r in sizes) < 300


def test_rows_that_share_an_id_are_spread(spark):
    """Pieces without an id and vectors of one id go to many shards."""
    cut = spark.range(2000).select(
        F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"),
        (F.col("id") % 60 + 1).alias("length"),
    )
    got = packing.pack(cut, context=64, shard=100).collect()
    shards = Counter(r.sequence_id % 20 for r in got)
    assert len(got) == 2000 and len(shards) == 20 and max(shards.values()) < 200
    vectors = spark.range(500).select(
        F.lit(7).cast("long").alias("vec_id"), F.array(F.cos("id"), F.sin("id")).alias("embedding")
    )
    asked = spark.createDataFrame([(50, [1.0, 0.0])], "vec_id long, embedding array<double>")
    best = neighbours.nearest(vectors, asked, factor=1.0, shard=50).collect()
    cosines = sorted((math.cos(i) for i in range(500)), reverse=True)[:5]
    assert [r.vec_id for r in best] == [7] * 5
    assert [r.score for r in sorted(best, key=lambda r: r.rank)] == pytest.approx(cosines)


def test_blocks_hold_every_character():
    texts = [None, "", "a b c " * 50, "x" * 99, "y"]
    got = ["" for _ in texts]
    for owners, parts in blocks(texts, 40):
        assert sum(map(len, parts)) <= 80 and all(len(p) <= 40 for p in parts)
        for owner, part in zip(owners, parts):
            got[owner] += part
    assert got == [t or "" for t in texts]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, empty, labels, tmp_path, name, stage):
    folder = str(tmp_path)
    labels.write.parquet(f"{folder}/labels.parquet")
    got = stage(spark, docs, folder)
    if name != "packing":
        assert got.schema == docs.schema
    assert got.count() > 0
    assert stage(spark, empty, folder).count() == 0


def test_whole_pipeline(spark):
    """Every stage against a plain version of it, each on the rows that the plain one before left."""
    folder = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r.text for r in source.collect()}
    model = language.learn_languages(source, ~held_out(F.col("doc_id")))
    names, score = model.predict(list(rows.values()))
    rows = {i: t for (i, t), n, s in zip(rows.items(), names, score) if n != "und" and s >= language.LEAST_SHARE}
    left = source.filter(F.col("doc_id").isin(list(rows)))
    judge = toxicity.learn_toxicity(left, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = {i: t for (i, t), s in zip(rows.items(), judge.score(list(rows.values()))) if s < toxicity.THRESHOLD}
    keep = {k for _, k, _, _ in brute.exact(list(rows.items()))[0]}
    rows = {i: t for i, t in rows.items() if i in keep}
    roots = brute.components(list(rows), [brute.fingerprint(t) for t in rows.values()])
    rows = {i: t for (i, t), c in zip(rows.items(), roots) if i == c}
    use = packing.word_ids(WORDS)
    want = []
    for i, t in rows.items():
        ids = np.frombuffer(use([t])[0], "<u4").tolist() + [0]
        want += [(i, k, 2048 * k, len(ids[2048 * k : 2048 * k + 2048]), brute.crc(ids[2048 * k : 2048 * k + 2048])) for k in range(-(-len(ids) // 2048))]
    got = corpus_pipeline.run(spark, folder).collect()
    assert by_id(got, "piece", "start", "length", "ids_crc32") == sorted(want, key=repr)
    assert 0 < len(rows) < 200

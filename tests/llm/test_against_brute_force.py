"""Each registered query over whole tables against a plain version, a round trip or held-out labels."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest

import brute
from compare import connect, differences
from hushframe.llm import lengths, neighbours, pieces, revisits, simhash
from hushframe.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()


def run(spark, name):
    return QUERIES[name](spark, FOLDER).collect()


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    assert differences(QUERIES[name](spark, FOLDER), connect(FOLDER), SQL[name]) == []


def test_language(spark, docs):
    rows = {r.doc_id: r for r in run(spark, "op1_language_bitmask")}
    assert len(rows) == len(docs) and all(r.held_out == held(r.doc_id) for r in rows.values())
    judged = [(rows[d["doc_id"]].lang_pred, d["lang"]) for d in docs if held(d["doc_id"])]
    assert sum(a == b for a, b in judged) / len(judged) > 0.95
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_sentencepiece(spark, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = {r.doc_id: r for r in run(spark, "op2_sentencepiece_offsets")}
    for d in docs:
        ids = library.encode(d["text"] or "", add_eos=True)
        r = rows[d["doc_id"]]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_token_counts(spark, docs):
    from tokenizers import Tokenizer

    byte = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    byte.encode_special_tokens = True
    sizes = [len(byte.encode(d["text"] or "", add_special_tokens=False)) for d in docs]
    rows = run(spark, "op3_token_counts")
    assert {r.length: r.documents for r in rows} == Counter(sizes)
    for r in rows:
        assert r.tokens_at_least == sum(s for s in sizes if s >= r.length)
        assert r.documents_at_least == sum(s >= r.length for s in sizes)
        assert r.documents_up_to == sum(s <= r.length for s in sizes)
        assert r.truncated_total == sum(min(s, r.length) for s in sizes)


def test_token_count_answers(spark):
    sizes = [0, 3, 3, 7, 1500, 5000, 5000]
    histogram = lengths.length_histogram(spark.createDataFrame([(s,) for s in sizes], "n int"), _col("n"))
    limits = [0, 1, 3, 4, 8, 1499, 1500, 2048, 4999, 5000, 9000, None]
    asked = spark.createDataFrame([(x,) for x in limits], "limit long")
    got = {r.limit: r.total for r in lengths.truncated_totals(histogram, asked).collect()}
    assert got == {x: None if x is None else sum(min(s, x) for s in sizes) for x in limits}
    parts = [0.1, 0.5, 0.75, 1.0]
    got = {r.share: r.length for r in lengths.length_quantiles(histogram, parts).collect()}
    assert got == {p: sorted(sizes)[int(np.ceil(p * len(sizes))) - 1] for p in parts}


def _col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_toxicity(spark, docs):
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{FOLDER}/labels.parquet").to_pylist()}
    rows = {r.doc_id: r for r in run(spark, "op4_toxicity_grammar")}
    assert len(rows) == len(docs)
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows.values())
    english = {d["doc_id"] for d in docs if d["lang"] == "en"}
    judged = [(rows[i].predicted, toxic) for i, toxic in labels.items() if held(i) and i in english]
    assert sum(p == t for p, t in judged) / len(judged) > 0.95
    clean = [rows[i].predicted for i, toxic in labels.items() if not toxic]
    assert sum(clean) / len(clean) < 0.02


def test_exact(spark, docs):
    rows = run(spark, "op5_exact_radix")
    expected, stay = brute.exact([(d["doc_id"], d["text"]) for d in docs])
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=repr) == expected
    assert sum(r.kept for r in rows) == stay and all(r.kept == (r.doc_id == r.keep_id) for r in rows)


def test_quality(spark, docs):
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{FOLDER}/labels.parquet").to_pylist()}
    rows = {r.doc_id: r for r in run(spark, "op6_quality_attention")}
    assert len(rows) == len(docs)
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows.values())
    judged = [(rows[i].predicted, good) for i, good in labels.items() if held(i)]
    assert sum(p == g for p, g in judged) / len(judged) > 0.95


@pytest.mark.parametrize("factor", [1.0, neighbours.FACTOR])
def test_neighbours(spark, factor):
    table = pq.read_table(f"{FOLDER}/embeddings.parquet")
    ids = table["vec_id"].to_pylist()
    vectors = [[float(x) for x in v] for v in table["embedding"].to_pylist()]
    source = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    found = defaultdict(list)
    small = neighbours.nearest(source, source.filter("vec_id % 50 = 0"), factor=factor, shard=100, block=4)
    for r in small.orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for query in range(0, 500, 50):
        expected = brute.cosines(vectors, ids, query)
        assert [r for r, _, _ in found[query]] == [1, 2, 3, 4, 5]
        hits += len({i for i, _ in expected} & {i for _, i, _ in found[query]})
        total += 5
        if factor == 1.0:
            assert [i for _, i, _ in found[query]] == [i for i, _ in expected]
            assert np.allclose([s for _, _, s in found[query]], [s for _, s in expected], atol=1e-12)
    assert hits / total >= (1.0 if factor == 1.0 else 0.9)


def test_registered_neighbours_recall(spark):
    table = pq.read_table(f"{FOLDER}/embeddings.parquet")
    ids, vectors = table["vec_id"].to_pylist(), [[float(x) for x in v] for v in table["embedding"].to_pylist()]
    rows = run(spark, "op7_vantage_points")
    hits = 0
    for query in range(0, 500, 50):
        hits += len({i for i, _ in brute.cosines(vectors, ids, query)} & {r.vec_id for r in rows if r.query_id == query})
    assert hits / 50 >= 0.9


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    word = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = run(spark, "op8_best_fit_packing")
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert len(by_doc) == len(docs)
    total = 0
    for d in docs:
        ids = word.encode(d["text"] or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        own = sorted(by_doc[d["doc_id"]], key=lambda r: r.piece)
        cut = [ids[i : i + 2048] for i in range(0, len(ids), 2048)]
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in own] == [
            (i, 2048 * i, len(c), brute.crc(c)) for i, c in enumerate(cut)
        ]
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by_sequence) <= 1.01 * total / 2048 + 2


def test_simhash(spark, docs):
    rows = {r.doc_id: r for r in run(spark, "op10_simhash_bitsliced")}
    ids = [d["doc_id"] for d in docs]
    prints = [brute.fingerprint(d["text"]) for d in docs]
    assert [rows[i].fingerprint for i in ids] == [f"{p:016x}" for p in prints]
    assert [rows[i].component_id for i in ids] == brute.components(ids, prints)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_near_links(spark, radius):
    draw = np.random.default_rng(radius)
    centres = draw.integers(0, 2**64, 12, np.uint64)
    prints = {int(c) for c in centres}
    for c in centres:
        for _ in range(60):
            p = int(c)
            for bit in draw.integers(0, 64, draw.integers(0, 5)):
                p ^= 1 << int(bit)
            prints.add(p)
    prints = sorted(prints)
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    table = spark.createDataFrame([(p,) for p in signed], "print long")
    for tile in (7, 4096):
        links = simhash.near_links(table, radius, tile).collect()
        root = {p: p for p in signed}

        def find(p):
            while root[p] != p:
                p = root[p]
            return p

        for a, b in links:
            root[find(a)] = find(b)
        mine = [find(p) for p in signed]
        theirs = brute.components(list(range(len(prints))), prints, radius)
        assert len(set(zip(mine, theirs))) == len(set(mine)) == len(set(theirs))


def test_revisits(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    records = revisits.captures_of(pages).withColumn("url_key", revisits.canonical_url(_col("url"))).collect()
    got = {r.record_id: r for r in QUERIES["op9_revisit_resolution"](spark, FOLDER).collect()}
    visits = [r for r in records if r.record_type == "revisit"]
    assert set(got) == {r.record_id for r in visits}
    states = Counter()
    for v in visits:
        before = [
            r for r in records if r.status == 200 and r.url_key == v.url_key and r.captured < v.captured
        ]
        best = max(before, key=lambda r: (r.captured, r.record_id), default=None)
        update = {k.lower(): x for k, x in v.headers.items()}
        state, merged = "missing", update
        if best is not None:
            stored = {k.lower(): x for k, x in best.headers.items()}
            state = "unvalidated"
            for name in ("etag", "last-modified"):
                if name in stored and name in update:
                    state = "resolved" if stored[name] == update[name].removeprefix("W/") else "mismatch"
                    break
            if state != "mismatch":
                merged = stored | {k: x for k, x in update.items() if k not in revisits.FIXED_HEADERS}
        r = got[v.record_id]
        states[state] += 1
        assert r.state == state
        assert r.response_id == (best.record_id if state in ("resolved", "unvalidated") else None)
        assert r.headers == "; ".join(f"{k}: {x}" for k, x in sorted(merged.items()))
        assert r.body_sha256 == (best.body_sha256 if state in ("resolved", "unvalidated") else None)
    assert len(states) == 4


def test_spans_cover_the_text():
    use = pieces.coder(public_tokenizers.path("piece_bpe_32k.model"))
    for text in ["", " ", "a  b", "Ärger, 漢字 \U0001f600!\n\tx ", "▁ and\x00 so"]:
        ids = np.array(use.library.encode(text, add_eos=True), np.int32)
        starts, ends = use.spans(text, ids)
        data = text.encode()
        assert ends[-1] == starts[-1] == len(data)
        assert (starts[1:] == ends[:-1]).all() and starts[0] == 0
        for one, a, b in zip(ids.tolist(), starts, ends):
            piece = use.library.id_to_piece(one)
            if not use.library.is_byte(one) and not use.library.is_control(one):
                assert data[a:b].decode().replace(" ", "▁") in (piece, piece[1:])


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "nmt_nfkc_cf"])
def test_mapped_normalisation(rule):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = sentencepiece_model_pb2.ModelProto.FromString(library.serialized_model_proto()).normalizer_spec
    use = pieces.coder(public_tokenizers.path("piece_bpe_32k.model"))
    other = object.__new__(pieces.PieceCoder)
    other.map = pieces.CharacterMap(spec.precompiled_charsmap)
    other.prefix, other.squeeze, other.escape, other.suffix = (
        spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, False,
    )
    assert use.map.units == []
    for text in ["ｆｕｌｌ　ｗｉｄｔｈ", "  ① ½ ﬁne  Ⅳ ", "é ㌔ ​ x", "ＡＢＣ ß İ", "", "   "]:
        normal, origin = other.normalise(text)
        assert normal.decode() == library.normalize(text)
        assert len(origin) == len(normal) + 1 and (np.diff(origin) >= 0).all()

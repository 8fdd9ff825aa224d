"""Host rules, conversation repair and periodic runs against plain versions, and their edge cases."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hushframe.llm import hosts, periods, turns
from hushframe.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# host rules


def plain_measures(text):
    text = text or ""
    words = [w for w in SPACE.split(text) if w]
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [line for line in text.split("\n") if SPACE.sub("", line)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines),
        len(lines) - len(set(lines)), len(covered),
    )


TEXTS = [
    None, "", " \n\t\x0b ", "a b c a b c", "a b c d a b c", "one\n\none\n one\none", "x" * 900, "a a a a a",
    "## $5 | <b>\r\n## $5 | <b>", "déjà vu \U0001f600 déjà vu \U0001f600 déjà", "a b c a b c a",
    " ".join(f"w{i % 611}" for i in range(40_000)), "\n".join(["same line here"] * 60),
]


def test_measures(spark):
    rows = [(i, t, f"h{i % 3}") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string")
    clash = docs.withColumns({c: F.lit(1) for c in "host words lines hashes body n n_words kept hot_failed".split()})
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    got = {r.doc_id: tuple(r[n] for n in names) for r in hosts.measure(clash).collect()}
    assert got == {i: plain_measures(t) for i, t in enumerate(TEXTS)}


def test_equal_hashes_do_not_decide(spark):
    """Windows whose hashes are equal are still compared as texts."""
    one = spark.createDataFrame([("a b c d e f a b c".split(),)], "words array<string>")
    hashes = F.array(*[F.lit(h).cast("long") for h in (7, 1, 7, 2, 3, 4, 7)])  # window 2 (c d e) collides with a b c
    assert one.select(hosts.repeated_words(F.col("words"), hashes).alias("n")).first().n == 6


def test_host_query(spark):
    docs = pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = {r.doc_id: r for r in QUERIES["op11_host_rules"](spark, FOLDER).collect()}
    assert len(got) == len(docs)
    for d in docs:
        m = plain_measures(d["text"])
        row = got[d["doc_id"]]
        assert tuple(row[n] for n in names) == m[:3] + m[4:]
        assert row.base_failed == (m[0] < 50 or 100 * m[5] > 50 * m[0])
        assert row.kept == (not row.base_failed)  # no host of the table fails


GOOD = " ".join(f"word{i}" for i in range(60))


def test_bad_hosts_fall_and_small_ones_follow_the_prior(spark):
    bad = GOOD + " ###" * 10
    rows = [("good", GOOD)] * 400 + [("bad", bad)] * 300 + [("bad", GOOD)] * 20
    for i in range(100):
        rows += [(f"mixed{i}", GOOD)] * 9 + [(f"mixed{i}", bad)]
    rows += [("one", bad), (None, GOOD), (None, None), ("empty", "")]
    docs = spark.createDataFrame([(i, h, t) for i, (h, t) in enumerate(rows)], "doc_id int, source string, text string")
    judged = hosts.judge_documents(docs).collect()
    assert len(judged) == len(rows)
    by_host = defaultdict(set)
    for r in judged:
        by_host[r.host].add(r.host_failed)
    assert by_host["bad"] == {True} and by_host["good"] == by_host["mixed5"] == by_host[None] == {False}
    kept = {(r.host, r.n_words) for r in judged if r.kept}
    assert ("bad", 60) not in kept and (None, 60) in kept and (None, 0) not in kept and ("good", 60) in kept


def test_shrinking():
    # 40 hosts of 10 documents that all behave alike: no spread beyond chance, so every host gets the mean
    assert hosts._strength(40, 400.0, 4000.0, 80.0, 80 * 0.2 + 0.16 * 30) == float("inf")
    # half of the hosts fail always, half never: no shrinking at all
    assert hosts._strength(40, 400.0, 4000.0, 200.0, 200.0) == pytest.approx(0.0, abs=1e-9)
    assert hosts._strength(1, 5.0, 25.0, 2.0, 0.8) == float("inf")


def test_hosts_hot_and_many(spark):
    """A host with most rows, a thousand small ones and none: each row once, joined to its own host."""
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.lit(GOOD).alias("text"),
        F.when(F.col("id") < 4000, "hot").when(F.col("id") < 5990, F.concat(F.lit("h"), (F.col("id") % 1500).cast("string"))).alias("source"),
    )
    judged = hosts.judge_documents(docs)
    assert judged.count() == 6000 and judged.filter("kept").count() == 6000
    assert hosts.judge_documents(docs.limit(0)).collect() == []


# conversations


def plain_damage(rows):
    """(conv, turn, role, text) rows after damage, and all ids."""
    out, ids = [], set()
    for conv, turn, role, text in rows:
        ids.add(conv)
        shown = lambda v: " " if v is None else str(v)
        harm = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        if harm == 0:
            continue
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        out += [(conv, turn, "user" if harm == 4 else role, text)] * (1 + (harm == 3))
    return out, ids


def plain_repair(conv, rows):
    """The result row of one conversation by searching over whole edit strings."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:64], sha(r[3])))
    known = [r[1] for r in rows if r[1] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    faults, seen = [], set()
    for _, _, role, text in rows:
        shown = SPACE.sub("", text)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "" if shown[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faults.append(fault)
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, last, written = heapq.heappop(heap)
        if (at, last) in done:
            continue
        done.add((at, last))
        if at == len(rows) and last in ("", "a"):
            break
        may = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        for role in "ua":
            if role in may:
                full = "user" if role == "u" else "assistant"
                heapq.heappush(heap, (cost + 2, audit + "I", at, role, (*written, f"{full}:")))
                if at < len(rows) and faults[at] not in ("blank", "duplicate"):
                    more = cost + 2 + (faults[at] == "truncated")
                    heapq.heappush(heap, (more, audit + "R", at + 1, role, (*written, f"{full}:{rows[at][3]}")))
        if at < len(rows):
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, last, written))
            if initials[at] and initials[at] in may and faults[at] not in ("blank", "duplicate"):
                more = cost + (faults[at] == "truncated")
                heapq.heappush(heap, (more, audit + "K", at + 1, initials[at], (*written, f"{rows[at][2]}:{rows[at][3]}")))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (conv, gaps, *counts, illegal, cost, audit, sha("\n".join(written)))


def plain_conversations(rows, damage=True):
    shown = [tuple(v if i < 2 or v is not None else " " for i, v in enumerate(r)) for r in rows]
    after, ids = plain_damage(rows) if damage else (shown, {r[0] for r in rows})
    held = defaultdict(list)
    for r in after:
        held[r[0]].append(r)
    return sorted((plain_repair(c, held[c]) for c in ids), key=repr)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_conversation_query(spark):
    rows = [tuple(r.values()) for r in pq.read_table(f"{FOLDER}/conversations.parquet").to_pylist()]
    assert collected(QUERIES["op12_conversation_repair"](spark, FOLDER)) == plain_conversations(rows)


def rows_of(draw, count):
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["Yes.", "No!", "cut", "", " \n", "q? \t", None]
    return [(draw.choice([1, 2, None, 7]), draw.choice([None, 0, 1, 2, 5, 9]), draw.choice(roles), draw.choice(texts)) for _ in range(count)]


def test_conversations_of_every_kind(spark):
    draw = random.Random(3)
    rows = []
    for conv in range(400):
        start = len(rows)
        for turn in range(draw.randint(1, 9)):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool"])
            rows.append((conv, draw.choice([turn, turn, turn + 3, None]), role, f"{draw.choice('abc')}{draw.choice('.. !?')}"))
        if conv % 7 == 0:
            rows += rows[start:]
    rows += rows_of(draw, 60)
    # mixed texts so that ties at a turn have an order: the schema's extra columns are not read
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(
        {c: F.lit(1) for c in "phase place first fault digest lead n harm known".split()}
    )
    assert collected(turns.repair_turns(turns.damage_turns(df.repartition(5)))) == plain_conversations(rows)
    assert collected(turns.repair_turns(df, held=8)) == plain_conversations(rows, damage=False)
    assert turns.repair_turns(turns.damage_turns(df.limit(0))).collect() == []


def test_long_conversation_spills_and_crosses_batches(spark):
    rows = [("big", i, "user" if i % 5 else "assistant", f"text {i}" + "." * (i % 3)) for i in range(3000)]
    rows += [("big", 3000 + i, "user", "again.") for i in range(50)] + [("small", 0, "user", "Hi.")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 97)
    try:
        df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
        got = collected(turns.repair_turns(df, held=64))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain_conversations(rows, damage=False)


def test_situations_stay_few():
    """Costs are kept relative and hopeless states are left, so the automaton has a fixed number of situations."""
    automaton, draw = turns.Automaton(), random.Random(1)
    for _ in range(200):
        situation = automaton.begin()
        for _ in range(200):
            situation, _, _ = automaton.step(situation, draw.choice("sua?"), draw.randrange(4))
    assert len(automaton.memory) < 3000


# periodic runs


def plain_runs(words):
    found, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            end = i
            while end + q < n and words[end] == words[end + q]:
                end += 1
            start, length = i, end + q - i
            body = words[start : start + length]
            if length >= max(6, 4 * q) and all(body[p:] != body[:-p] for p in range(1, q)):
                found.append((start, length, q))
            i = end
    return sorted(found)


def numbers(texts):
    code = {}
    flat = [code.setdefault(w, len(code)) for t in texts for w in t]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return np.array(flat, np.int64), bounds


@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60), max_size=4))
@settings(max_examples=300, deadline=None)
def test_runs_of_two_words(texts):
    assert periods.find_runs(*numbers(texts)) == [plain_runs(t) for t in texts]


@given(st.integers(0, 10**9))
@settings(max_examples=150, deadline=None)
def test_planted_runs(seed):
    draw = random.Random(seed)
    texts = []
    for _ in range(draw.randint(1, 3)):
        text = []
        for _ in range(draw.randint(0, 4)):
            text += draw.choices("abcdefgh", k=draw.randint(0, 12))
            unit = draw.choices("abc", k=draw.randint(1, 23))
            for _ in range(draw.choice([1, 1, 2])):
                text += (unit * 12)[: draw.randint(1, 8 * len(unit))]
        texts.append(text)
    assert periods.find_runs(*numbers(texts)) == [plain_runs(t) for t in texts]


def test_nested_runs():
    unit = list("aaaaaabaaaaaac")
    text = list("xy") + unit * 9 + unit[:5] + list("zz")
    assert periods.find_runs(*numbers([text, text, list("ab") * 40])) == [plain_runs(text)] * 2 + [[(0, 80, 2)]]


@pytest.mark.parametrize("width", [1, 2, 4, 16, 64])
def test_squared_differences_are_exact(width):
    draw = np.random.default_rng(width)
    blocks = draw.integers(0, 1 << 30, (5, width))
    windows = draw.integers(0, 1 << 30, (5, 2 * width - 1))
    for prime, generator in periods.PRIMES:
        got = periods.mismatches(blocks, windows, prime, generator)
        for r in range(5):
            for i in range(width):
                exact = sum((int(a) - int(b)) ** 2 for a, b in zip(blocks[r], windows[r, i : i + width]))
                assert int(got[r, i]) == exact % prime


def test_primes():
    for prime, generator in periods.PRIMES:
        assert all(prime % k for k in range(2, int(prime**0.5) + 1))
        assert (prime - 1) % (1 << 26) == 0 and pow(generator, (prime - 1) // 2, prime) == prime - 1


def plain_result(doc_id, text, damage):
    words = [w for w in SPACE.split(text or "") if w]
    if damage and words and doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        if h % 10 == 0:
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words) if len(words) < 4000 else periods.find_runs(*numbers([words]))[0]
    kept = [True] * len(words)
    for s, n, q in runs:
        kept[s + q : s + n] = [False] * (n - q)
    collapsed = " ".join(w for w, k in zip(words, kept) if k)
    best = max(runs, key=lambda r: (r[1] * 10**12 // r[2], -r[0], -r[2])) if runs else None
    top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *top, sha(listed), sha(collapsed))


def test_run_query(spark):
    docs = pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, FOLDER).collect()}
    assert len(got) == len(docs)
    small = [d for d in docs if len((d["text"] or "").split()) < 700]
    assert len(small) > 800
    for d in small:
        assert got[d["doc_id"]] == plain_result(d["doc_id"], d["text"], True)
    assert sum(r[1] for r in got.values()) > 50


def test_run_edges(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a " * 6), (5, "a " * 5), (5, "a " * 5), (None, "x y " * 9), (7, long),
            (8, "same word " * 20_000), (9, "ab ba " * 3), (10, "é\x0bé\x0cé\ré\té\né")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit("z") for c in "id start length period n_runs collapsed".split()}
    )
    for damage in (False, True):
        got = collected(periods.periodic_runs(docs, damage=damage).drop("collapsed"))
        assert got == sorted((plain_result(i, t, damage) for i, t in rows), key=repr)
    whole = {r.doc_id: r for r in periods.periodic_runs(docs).collect()}
    assert whole[7].period == 977 and whole[7].collapsed == " ".join(f"w{i}" for i in range(977))
    assert whole[8].collapsed == "same word" and whole[4].collapsed == "a" and whole[5].collapsed == "a a a a a"
    assert periods.periodic_runs(docs.limit(0)).collect() == []


def test_shards_of_pieces_have_a_task_each(spark):
    """Five shards lie in five tasks, each about a fifth; with fewer tasks than shards they take turns."""
    from hushframe.llm import packing

    rows = spark.range(5000).select(
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit(0).alias("piece"), (F.col("id") % 700 + 1).alias("length")
    )
    packed = packing.pack(rows, shard=1000)
    per_task = [r["count"] for r in packed.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per_task) == 5 and max(per_task) < 1200 and sum(per_task) == 5000
    tasks = packing.TASKS
    packing.TASKS = 2
    try:
        turns = packing.pack(rows, shard=1000).persist()
        assert turns.groupBy(F.spark_partition_id()).count().count() == 2
        shares = turns.groupBy((F.col("sequence_id") % 5).alias("shard")).count().collect()
        assert len(shares) == 5 and sum(r["count"] for r in shares) == 5000
        both = [turns, packed]
    finally:
        packing.TASKS = tasks
    for table in both:
        ends = F.max(F.col("offset") + F.col("length")).alias("end")
        inside = table.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.min("offset").alias("at"), ends)
        assert inside.filter("n > 2048 or at <> 0 or end <> n").isEmpty()


def test_keepers_of_large_groups_without_a_shuffle_of_their_rows(spark):
    """Half of the rows are copies of one text; the others have pairs. Every row has its group's size and keeper."""
    from hushframe.llm.exact import exact_classes

    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 2 == 0, F.lit("hot text")).otherwise(F.concat(F.lit("t"), F.floor(F.col("id") / 4))).alias("text"),
    )
    found = {r["doc_id"]: r for r in exact_classes(docs).collect()}
    assert len(found) == 6000
    for i, r in found.items():
        wanted = (0, 3000) if i % 2 == 0 else (i - i % 4 + 1, 2)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (*wanted, i == wanted[0])
    assert exact_classes(docs.limit(0)).count() == 0

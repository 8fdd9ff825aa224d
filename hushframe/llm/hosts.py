"""Quality rules with verdicts on whole hosts, as DataFrame expressions only.

Each text is measured once. Rule failures are then added up by host, and each host's failure rate is
shrunk towards that of all hosts by a beta prior whose strength is estimated from the spread between
hosts: a host with three documents is judged mostly by the prior, one with a million by itself. A host
whose shrunk rate is too high under any rule fails as a whole, and its verdict is joined to its documents.

The host table has a row per host. Hosts with over a thousandth of the rows, of which there can be no more than a
thousand, are joined by broadcast; all others by a shuffle in which no host holds more than that share.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.plans.materialise import materialise

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: A host fails if the shrunk share of its documents that break a rule is larger.
HOST_LIMIT = 0.5
#: Hosts with more than one of so many rows are joined by broadcast: there are at most so many of them.
HOT_PARTS = 1000

#: Which documents break a rule. The first two decide on the document itself.
BASE_RULES = {
    "few_words": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
}
HOST_RULES = BASE_RULES | {
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 3 * n_words or word_chars > 12 * n_words",
}


def _twins(sorted_items: Column, name: str) -> Column:
    """The structs of a sorted array whose field `name` also stands in a neighbour."""

    def twin(item: Column, at: Column) -> Column:
        before, after = F.get(sorted_items, at - 1)[name], F.get(sorted_items, at + 1)[name]
        return item[name].eqNullSafe(before) | item[name].eqNullSafe(after)

    return F.filter(sorted_items, twin)


def _bind(value: Column, body) -> Column:
    """The body with a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column, hashes: Column) -> Column:
    """How many words lie in a window of three words that occurs twice or more, the first one included.

    Windows are told by hash first. Only a text with two equal hashes sorts them, and the windows behind equal
    hashes are then compared as texts.
    """

    def spelled(item: Column) -> Column:
        at = item["at"]
        three = F.concat_ws(" ", F.get(words, at), F.get(words, at + 1), F.get(words, at + 2))
        return F.struct(three.alias("window"), at.alias("at"))

    marked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("hash"), i.alias("at"))))
    alike = _bind(marked, lambda m: F.array_sort(F.transform(_twins(m, "hash"), spelled)))
    found = _bind(alike, lambda m: _twins(m, "window"))
    covered = F.flatten(F.transform(found, lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2)))
    several = F.size(hashes) > F.size(F.array_distinct(hashes))
    return F.when(several, F.size(F.array_distinct(covered))).otherwise(F.lit(0))


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of each row.

    Whole texts; null has no words. Words are separated by `[\\x20\\x09-\\x0D]`. Lines count if they have a word.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("host"), body.alias("body"))
    rows = rows.withColumn("words", F.array_remove(F.split("body", SPACE), ""))
    lines = F.filter(F.split("body", "\n"), lambda line: F.translate(line, BLANKS, "") != "")
    last = F.size("words") - 3
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    hashed = F.transform(at, lambda i: F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(3)]))
    rows = rows.withColumns({"lines": lines, "hashes": hashed})
    counts = {
        "n_words": F.size("words"),
        "word_chars": F.char_length(F.translate("body", BLANKS, "")),
        "n_symbols": F.char_length("body") - F.char_length(F.translate("body", SYMBOLS, "")),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": repeated_words(F.col("words"), F.col("hashes")),
    }
    return rows.select("doc_id", "host", *[c.cast("long").alias(name) for name, c in counts.items()])


def _strength(hosts: int, n: float, squares: float, failed: float, spread: float) -> float:
    """a + b of the beta prior, from the spread of host rates beyond that of equal hosts; infinite without any.

    With overall rate m, sum(n (rate - m)^2) has the mean m (1 - m) (K - 1 + rho (n - sum(n^2) / n - K + 1)) over K
    hosts, and a + b = 1 / rho - 1.
    """
    rate = failed / n
    room = n - squares / n - (hosts - 1)
    if not 0 < rate < 1 or room <= 0:
        return math.inf
    rho = (max(spread - failed * rate, 0.0) / (rate * (1 - rate)) - (hosts - 1)) / room
    return math.inf if rho <= 0 else max(1.0 / rho - 1.0, 0.0)


def host_rates(measured: DataFrame, rules: Mapping[str, str] = HOST_RULES) -> DataFrame:
    """host, n and for each rule its `failed_` count and `rate_`, shrunk by the empirical beta prior.

    Rows without a host are left out. The prior is one row of sums over all hosts.
    """
    failed = [F.count_if(F.expr(rule)).alias(f"failed_{name}") for name, rule in rules.items()]
    known = measured.filter("host is not null")
    hosts = materialise(known.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *failed), "host-failures")
    n = F.col("n").cast("double")
    sums = [F.count(F.lit(1)).alias("hosts"), F.sum(n).alias("n"), F.sum(n * n).alias("squares")]
    for name in rules:
        count = F.col(f"failed_{name}").cast("double")
        sums += [F.sum(count).alias(f"failed_{name}"), F.sum(count * count / n).alias(f"spread_{name}")]
    total = hosts.agg(*sums).first()
    rates = {}
    for name in rules:
        count = F.col(f"failed_{name}")
        if not total["hosts"]:
            rates[f"rate_{name}"] = count / n
            continue
        prior = _strength(total["hosts"], total["n"], total["squares"], total[f"failed_{name}"], total[f"spread_{name}"])
        mean = total[f"failed_{name}"] / total["n"]
        rates[f"rate_{name}"] = F.lit(mean) if math.isinf(prior) else (count + mean * prior) / (n + prior)
    return hosts.withColumns(rates)


def host_verdicts(rates: DataFrame, rules: Mapping[str, str] = HOST_RULES, limit: float = HOST_LIMIT) -> DataFrame:
    """host, n and host_failed: whether the shrunk rate of any rule exceeds the limit."""
    over = F.lit(False)
    for name in rules:
        over = over | (F.col(f"rate_{name}") > limit)
    return rates.select("host", "n", over.alias("host_failed"))


def join_verdicts(measured: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The measured rows with `host_failed`, which is false where there is no host."""
    total = verdicts.agg(F.sum("n")).first()[0] or 0
    hot = verdicts.filter(F.col("n") * HOT_PARTS > F.lit(total))
    few = hot.select("host", F.col("host_failed").alias("hot_failed"))
    rest = verdicts.join(F.broadcast(few.select("host")), "host", "left_anti").select("host", "host_failed")
    marked = measured.join(F.broadcast(few), "host", "left")
    known = F.col("host").isNull() | F.col("hot_failed").isNotNull()
    done = marked.filter(known).withColumn("host_failed", F.coalesce("hot_failed", F.lit(False))).drop("hot_failed")
    cold = marked.filter(~known).drop("hot_failed").join(rest, "host")
    return done.unionByName(cold)


def judge_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
    rules: Mapping[str, str] = HOST_RULES, limit: float = HOST_LIMIT,
) -> DataFrame:
    """One row per row of `docs`: its measures, `base_failed`, `host_failed` and `kept`.

    A document is kept if it breaks no base rule and its host does not fail. Null texts have no words and fail. A row
    without a host is judged by itself only. Repeated rows and ids count each. An empty table gives no row.
    """
    measured = materialise(measure(docs, doc_id, text, host), "host-measures")
    verdicts = materialise(host_verdicts(host_rates(measured, rules), rules, limit), "host-verdicts")
    failed = F.expr(" or ".join(f"({rule})" for rule in BASE_RULES.values()))
    judged = join_verdicts(measured, verdicts).withColumn("base_failed", failed)
    judged = judged.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))
    return judged.withColumnRenamed("doc_id", doc_id) if doc_id != "doc_id" else judged

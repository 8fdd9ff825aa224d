"""Exact duplicates by distributed radix partitioning, most significant byte first.

Texts are equal when the same bytes are left after white space is deleted. A text's key is its
length followed by its bytes. The first round deals rows by the length and the first bytes; each
further round splits the groups that still have several rows by the next stretch of bytes. Groups
of one row are finished, and so are groups whose bytes have ended: their rows are equal, without a
digest. Stretches grow by a constant factor, so the longest text needs few rounds.

A group is told by counting (partial sums before the shuffle), and rows find their group by a join
that adaptive execution can split, so a group of copies of any size never meets in one task. Only
rows of groups that go on are read and carried further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.llm.common import unused
from hushframe.plans.materialise import materialise

#: Bytes of the first round, and how much longer each stretch is than the one before.
FIRST, GROWTH = 64, 8
#: Groups with more than one of so many copied rows find their keeper by broadcast: there are fewer of them than this.
LARGE_PARTS = 1000


def squeezed(text: Column) -> Column:
    """The text without space, tab, line feed, vertical tab, form feed and carriage return."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def _normalised(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = squeezed(F.col(text)).cast("binary")
    return docs.select(
        F.col(doc_id).alias("id"), F.char_length(F.coalesce(text, F.lit(""))).alias("points"), body.alias("body")
    )


def _repeated(rows: DataFrame, *key: str) -> DataFrame:
    """A number for each key that several rows have. Written once, as the numbers depend on the plan."""
    several = rows.groupBy(*key).count().filter("count > 1").select(*key)
    return materialise(several.withColumn("next", F.monotonically_increasing_id()), "exact-groups")


def exact_classes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", first: int = FIRST, growth: int = GROWTH
) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points in the original text stays, then the smallest
    doc_id (a null id comes last), then any one of the rows that are equal in both. Null counts as
    an empty text, and empty texts are equal. Repeated rows are copies like others: one stays. The
    digest is that of the normalised text; nothing is decided by it. Other columns are not read.
    """
    found = _normalised(docs, doc_id, text)
    heads = materialise(
        found.select(
            "id",
            "points",
            F.octet_length("body").alias("bytes"),
            F.substring("body", 1, first).alias("digit"),
            F.sha2("body", 256).alias("sha"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "exact-heads",
    )
    groups = _repeated(heads, "bytes", "digit")
    dealt = materialise(heads.join(groups, ["bytes", "digit"], "left").drop("digit"), "exact-dealt")
    ended = [dealt.filter(f"next is not null and bytes <= {first}").select("id", "points", "sha", "row", "next")]
    single = [dealt.filter("next is null").select("id", "sha")]
    going = dealt.filter(f"next is not null and bytes > {first}")

    ids = going.select(F.col("id").alias("going_id")).distinct()
    source = docs.join(ids, docs[doc_id].eqNullSafe(ids["going_id"]), "left_semi")
    rest = F.col("body").substr(F.lit(first + 1), F.octet_length("body"))
    state = (
        _normalised(source, doc_id, text)
        .select("*", F.octet_length("body").alias("bytes"), F.substring("body", 1, first).alias("digit"))
        .filter(f"bytes > {first}")
        .join(groups, ["bytes", "digit"])
        .select(
            "id", "points", F.sha2("body", 256).alias("sha"), F.monotonically_increasing_id().alias("row"),
            F.col("next").alias("group"), rest.alias("rest"),
        )
    )
    width = first
    while True:
        state = materialise(state, "exact-rows")
        if state.isEmpty():
            break
        width *= growth
        state = state.withColumn("digit", F.substring("rest", 1, width))
        groups = _repeated(state, "group", "digit")
        on = F.octet_length("rest") > width
        dealt = materialise(
            state.join(groups, ["group", "digit"], "left").select(
                "id", "points", "sha", "row", "next",
                F.when(F.col("next").isNotNull() & on, F.col("rest").substr(F.lit(width + 1), F.octet_length("rest"))).alias("rest"),
            ),
            "exact-dealt",
        )
        single.append(dealt.filter("next is null").select("id", "sha"))
        ended.append(dealt.filter("next is not null and rest is null").select("id", "points", "sha", "row", "next"))
        state = dealt.filter("rest is not null").withColumnRenamed("next", "group").select(
            "id", "points", "sha", "row", "group", "rest"
        )

    equal = ended[0].withColumn("round", F.lit(0))
    for number, part in enumerate(ended[1:], 1):
        equal = equal.unionByName(part.withColumn("round", F.lit(number)))
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("u"), "id", "row")).alias("best")
    keepers = materialise(equal.groupBy("round", "next").agg(best, F.count(F.lit(1)).alias("size")), "exact-keepers")
    shared = _with_keepers(equal, keepers).select(
        "id", F.col("best.id").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"), F.col("sha").alias("text_sha256"),
    )
    alone = single[0]
    for part in single[1:]:
        alone = alone.unionByName(part)
    alone = alone.select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"),
    )
    return shared.unionByName(alone).withColumnRenamed("id", doc_id)


def _with_keepers(equal: DataFrame, keepers: DataFrame) -> DataFrame:
    """The rows with their group's keeper; rows of large groups stay where they are and meet a broadcast."""
    key = ["round", "next"]
    total = keepers.agg(F.sum("size")).first()[0] or 0
    large = F.broadcast(keepers.filter(F.col("size") * LARGE_PARTS > F.lit(total)))
    small = keepers.filter(F.col("size") * LARGE_PARTS <= F.lit(total))
    others = equal.join(large.select(*key), key, "left_anti")
    return equal.join(large, key).unionByName(others.join(small, key))


def drop_exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns.

    Rows are told by their id. Where an id is both kept and dropped (repeated rows, or a null id), its
    rows are compared by id and normalised text, of which the row with the most code points in the
    original text stays, then the first by text.
    """
    classes = materialise(exact_classes(docs, doc_id, text), "exact-classes")
    by_id = materialise(
        classes.groupBy(F.col(doc_id).alias("gone_id"))
        .agg(F.count_if("kept").alias("stay"), F.count_if(~F.col("kept")).alias("go"))
        .filter("go > 0"),
        "exact-gone",
    )
    gone = by_id.filter("stay = 0")
    both = by_id.filter("stay > 0")
    left = docs.join(gone, docs[doc_id].eqNullSafe(gone["gone_id"]), "left_anti")
    if both.isEmpty():
        return left
    plain = left.join(both, left[doc_id].eqNullSafe(both["gone_id"]), "left_anti")
    kept = classes.filter("kept").select(F.col(doc_id).alias("kept_id"), F.col("text_sha256").alias("kept_sha")).distinct()
    sha, rank = unused(docs, "exact_sha"), unused(docs, "exact_rank")
    twice = left.join(both, left[doc_id].eqNullSafe(both["gone_id"]), "left_semi")
    twice = twice.withColumn(sha, F.sha2(squeezed(F.col(text)).cast("binary"), 256))
    same = twice[doc_id].eqNullSafe(kept["kept_id"]) & (twice[sha] == kept["kept_sha"])
    longest = Window.partitionBy(doc_id, sha).orderBy(F.desc(F.char_length(F.coalesce(text, F.lit("")))), text)
    stays = twice.join(kept, same, "left_semi").withColumn(rank, F.row_number().over(longest)).filter(F.col(rank) == 1)
    return plain.unionByName(stays.drop(sha, rank))

"""The registered queries of this subpackage, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm import (
    exact, hosts, language, lengths, neighbours, packing, periods, pieces, quality, revisits, simhash, toxicity, turns,
)
from hushframe.llm.common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = sql
        return run

    return add


@register()
def op1_language_bitmask(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = held_out(F.col("doc_id"))
    found = language.identify(docs, language.learn_languages(docs, ~out))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


@register()
def op2_sentencepiece_offsets(spark: SparkSession, folder: str) -> DataFrame:
    found = pieces.encode_pieces(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@register()
def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    count = lengths.token_count(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return lengths.length_histogram(docs, count)


@register()
def op4_toxicity_grammar(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.learn_toxicity(docs, table(spark, folder, "labels"))
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    found = toxicity.score_toxicity(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


@register("""
with d as (
    select doc_id, length(coalesce(text, '')) as points,
           regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]', '', 'g') as body
    from documents),
k as (
    select doc_id, body,
           first_value(doc_id) over (partition by body order by points desc, doc_id) as keep_id,
           count(*) over (partition by body) as group_size
    from d)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(body) as text_sha256 from k
""")
def op5_exact_radix(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_classes(table(spark, folder, "documents"))


@register()
def op6_quality_attention(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.learn_quality(docs, table(spark, folder, "labels"))
    predicted = (F.col("score") >= quality.THRESHOLD).cast("int")
    found = quality.score_quality(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


@register()
def op7_vantage_points(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return neighbours.nearest(vectors, vectors.filter("vec_id % 50 = 0"))


@register()
def op8_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digests)


@register()
def op9_revisit_resolution(spark: SparkSession, folder: str) -> DataFrame:
    records = revisits.captures_of(table(spark, folder, "pages"))
    found = revisits.resolve_revisits(records, ("body_sha256", "body_bytes"))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.withColumn("headers", F.array_join(lines, "; "))


@register()
def op10_simhash_bitsliced(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, folder, "documents"))


@register(r"""
with d as (
    select doc_id, source, row_number() over () as r, coalesce(text, '') as body from documents),
w as (
    select *, list_filter(string_split_regex(body, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') as words,
           list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\f\r]')) as lines
    from d),
i as (select r, words, unnest(range(1, len(words) - 1)) as pos from w),
g as (select r, pos, count(*) over (partition by r, words[pos], words[pos + 1], words[pos + 2]) as n from i),
c as (select r, count(distinct p) as n_repeat_words from (select r, unnest([pos, pos + 1, pos + 2]) as p from g where n > 1) group by r),
m as (
    select doc_id, source, len(words) as n_words, length(regexp_replace(body, '[ \t\n\x0b\f\r]', '', 'g')) as word_chars,
           length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) as n_symbols, len(lines) as n_lines,
           len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
    from w left join c using (r)),
rules as (
    select *, unnest([1, 2, 3, 4, 5]) as rule,
           unnest([n_words < 50, 100 * n_repeat_words > 50 * n_words, 10 * n_symbols > n_words, 100 * n_dup_lines > 30 * n_lines,
                   word_chars < 3 * n_words or word_chars > 12 * n_words]) as broken
    from m where source is not null),
h as (select source, rule, count(*)::double as n, count(*) filter (broken)::double as f from rules group by all),
t as (
    select rule, count(*) - 1 as k, sum(n) as n, sum(n * n) as squares, sum(f) / sum(n) as m, sum(f * f / n) - sum(f) * sum(f) / sum(n) as spread
    from h group by rule),
p as (
    select rule, m, case when m > 0 and m < 1 and n - squares / n - k > 0
           then (greatest(spread, 0) / (m * (1 - m)) - k) / (n - squares / n - k) else 0 end as rho from t),
v as (
    select source, bool_or(case when rho <= 0 then m else (f + m * greatest(1 / rho - 1, 0)) / (n + greatest(1 / rho - 1, 0)) end > 0.5) as failed
    from h join p using (rule) group by source)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
       n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
       n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and not coalesce(failed, false) as kept
from m left join v using (source)
""")
def op11_host_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = hosts.judge_documents(table(spark, folder, "documents"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *counts, "base_failed", "kept")


@register()
def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return turns.repair_turns(turns.damage_turns(table(spark, folder, "conversations")))


@register()
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periods.periodic_runs(table(spark, folder, "documents"), damage=True).drop("collapsed")

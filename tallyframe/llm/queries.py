"""One query for each operator of this subpackage, applied to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import detect

    out = detect(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", "n_passages")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import Rule, linked

    return linked(_read(spark, sf_dir, "documents"), Rule(words=3, num=90, den=100))


def op3_byte_pair_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import digests

    return digests(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import deduplicate

    out = deduplicate(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import detect

    return detect(_read(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import classify

    return classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    out = judge(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "good")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import by_line

    return by_line(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


OP2_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (select distinct doc_id, array_to_string(w[i:i + 2], ' ') as s from words, unnest(range(1, greatest(len(w) - 1, 2))) as t(i) where len(w) > 0),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (select a.doc_id as x, b.doc_id as y, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from common join sizes a on a.doc_id = x join sizes b on b.doc_id = y where 100 * c >= 90 * (a.n + b.n - c)),
steps as (select x as a, y as b from links union all select y, x from links),
reach as (select doc_id, doc_id as r from documents union select reach.doc_id, b from reach join steps on a = r)
select doc_id, coalesce(any_value(n), 0) as n_shingles, min(r) as component_id from reach left join sizes using (doc_id) group by doc_id
"""

OP4_SQL = r"""
with words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as k from words, unnest(range(1, len(w) - 48)) as t(i)),
first as (select k, min(doc_id) as m from windows group by k),
gone as (select distinct doc_id, i + j as p from windows join first using (k), unnest(range(0, 50)) as t(j) where m < doc_id),
places as (select doc_id, p, w[p] as word from words, unnest(range(1, len(w) + 1)) as t(p)),
kept as (select doc_id, string_agg(word, ' ' order by p) as text, count(*) as n from places anti join gone using (doc_id, p) group by doc_id)
select doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(text, '')) as kept_sha256 from words left join kept using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL expresses; the tests hold the others against brute force, other libraries or labels."""
    return {"op2_ngram_join": OP2_SQL, "op4_substring_dedup": OP4_SQL}

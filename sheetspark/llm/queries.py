"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .line_dedup import report_sql
from .warc import ARCHIVE_SQL

#: Sites from which on a line is boilerplate. Among the tables' 20 sources copies of documents reach 3 or 4, boilerplate
#: 11 to 20 where it is spread evenly, and about half as many where a third of all rows come from one source.
SITES = 6


def op1_byte_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_codec import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_counts

    return mix_counts(table(spark, sf_dir, "documents"))


def op3_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_mcd import judge

    return judge(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(table(spark, sf_dir, "documents"))


def op5_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_fm import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_count import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_report

    return line_report(table(spark, sf_dir, "documents"), min_sites=SITES)


def op8_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_pages

    return archive_pages(table(spark, sf_dir, "pages"))


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import classes

    return classes(table(spark, sf_dir, "documents"), k=3, percent=85)


def op10_mpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mpeg_audio import store_texts

    return store_texts(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_byte_bpe_codec, op2_source_mix, op3_quality_mcd, op4_language_id, op5_quality_fm, op6_token_count, op7_line_dedup, op8_warc_archive, op9_near_dup, op10_mpeg_media)}

SQL: dict[str, str] = {"op7_line_dedup": report_sql(SITES), "op8_warc_archive": ARCHIVE_SQL}

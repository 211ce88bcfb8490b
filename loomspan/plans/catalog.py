"""Makes tables and operators reachable from spark.sql."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import SparkSession

from loomspan.functions import code

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def register(spark: SparkSession, sf_dir: str, tables: list[str] = TABLES) -> None:
    """Temporary views of the tables; the Python-backed scanners as functions code_outline and
    code_first_defined; and SQL
    functions for tokens and cache keys."""
    for name in tables:
        spark.read.parquet(str(PurePosixPath(sf_dir) / f"{name}.parquet") if "://" not in sf_dir else f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    spark.udf.register("code_outline", code.outline_column)
    spark.udf.register("code_first_defined", code.first_defined_column)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION text_tokens(t STRING) RETURNS BIGINT RETURN greatest(1L, coalesce(length(t) div 4, 1L))")
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION cache_key_hash(t STRING) RETURNS STRING RETURN sha2(trim(regexp_replace(lower(t), r'(?U)\s+', ' ')), 256)")

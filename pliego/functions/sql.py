"""Functions for use in SQL text, declared in SQL so that they stay plain expressions."""

from __future__ import annotations

from pyspark.sql import SparkSession

NIT_BASE = """
CREATE OR REPLACE TEMPORARY FUNCTION nit_base(digits STRING) RETURNS STRING
RETURN CASE WHEN digits = '' THEN NULL WHEN length(digits) = 10 AND left(digits, 1) IN ('8', '9') THEN left(digits, 9) ELSE digits END
"""


def register(spark: SparkSession) -> None:
    """nit_base(digits): the same rule as text.nit_base."""
    spark.sql(NIT_BASE)

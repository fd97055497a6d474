"""Typing a raw bank: template and gold from freeform format and answer text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeline.functions import typing as ty
from gradeline.functions.compare import value_kind, value_text


def type_bank(bank: DataFrame) -> DataFrame:
    """Add ``template`` and ``gold`` (VARIANT object under ``answer``) where either is missing.

    Items that have both keep them, so a second run changes nothing.
    """
    body = ty.response_placeholder(F.col("response_format"))
    rows = bank.withColumn("_hint", ty.placeholder_hint(body))
    rows = rows.withColumn(
        "_value", ty.coerce_value(F.coalesce("gold_answer", F.lit("")), F.col("_hint"))
    )
    rows = rows.withColumns({"_k": value_kind(F.col("_value")), "_t": value_text(F.col("_value"))})
    new_hint = ty.widen_hint(F.col("_hint"), F.col("_k"), F.col("_t"))
    new_value = F.when(
        F.col("_k") == "str",
        ty.widen_gold(F.col("_hint"), F.col("_k"), F.col("_t")).cast("variant"),
    ).otherwise(F.coalesce("_value", F.parse_json(F.lit("null"))))
    template = ty.render_template(
        F.array(F.struct(F.lit("answer").alias("key"), new_hint.alias("hint")))
    )
    gold = F.to_variant_object(F.struct(new_value.alias("answer")))
    have = F.col("template").isNotNull() & F.col("gold").isNotNull()
    return rows.withColumns(
        {
            "template": F.when(have, F.col("template")).otherwise(template),
            "gold": F.when(have, F.col("gold")).otherwise(gold),
        }
    ).drop("_hint", "_value", "_k", "_t")

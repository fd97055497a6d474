"""JSON text: salvage, response classes, canonical form and hashes."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeline.functions.text import strip_space

# Wording that marks a refusal, matched in lower case.
REFUSALS = [
    "i cannot",
    "i can't",
    "i'm unable",
    "i am unable",
    "cannot assist",
    "can't help",
    "against my",
    "i won't",
]


def salvage_json(text: Column) -> Column:
    """The text as VARIANT, else its first ``{`` to last ``}``, else NULL."""
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.when(inner != "", inner)))


def response_class(text: Column) -> Column:
    """``empty``, ``none`` (an answer was read), ``refusal`` or ``parse_error``."""
    t = strip_space(F.coalesce(text, F.lit("")))
    answer = salvage_json(t)
    low = F.lower(t)
    refused = F.lit(False)
    for marker in REFUSALS:
        refused = refused | low.contains(marker)
    return (
        F.when(t == "", "empty")
        .when(answer.isNotNull() & ~F.is_variant_null(answer), "none")
        .when(refused, "refusal")
        .otherwise("parse_error")
    )


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """Sorted keys and ``", "`` / ``": "`` separators, number spelling kept."""
    return text.map(
        lambda t: None if t is None else json.dumps(json.loads(t), sort_keys=True)
    )


def condition_hash(condition_json: Column) -> Column:
    """Twelve hex digits that do not depend on key order."""
    return F.left(F.sha2(canonical_json(condition_json), 256), F.lit(12))


def direct_key(entry_id: Column, condition_json: Column) -> Column:
    """The system key of a direct leg: registry id and condition hash."""
    return F.concat(F.lit("vlm__"), entry_id, F.lit("__"), condition_hash(condition_json))

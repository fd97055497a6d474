"""Small reference tables: capability buckets, price catalog, registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET_SCHEMA = "ord int, name string, tags array<string>, `desc` string"


def capability_buckets(spark: SparkSession, entries) -> DataFrame:
    """Bucket definitions in declared order; names and tags are checked."""
    rows = []
    for i, entry in enumerate(entries):
        if isinstance(entry, dict):
            if "name" not in entry or "tags" not in entry:
                raise ValueError(f"bucket {i} needs a name and tags")
            entry = (entry["name"], entry["tags"], entry.get("desc", ""))
        name, tags, desc = entry
        if not isinstance(tags, list) or not all(isinstance(t, str) for t in tags):
            raise ValueError(f"bucket {name!r}: tags must be a list of strings")
        rows.append((i, str(name), tags, str(desc)))
    return spark.createDataFrame(rows, BUCKET_SCHEMA)


PRICE_SCHEMA = (
    "provider string, unit string, usd double, input_usd_per_1k double, output_usd_per_1k double"
)


def price_catalog(spark: SparkSession, entries: dict[str, dict]) -> DataFrame:
    """Rates per provider, by page or by token."""
    rows = []
    for name, e in entries.items():
        if e.get("unit") == "page":
            rows.append((name, "page", float(e["usd"]), None, None))
        elif e.get("unit") == "tokens":
            rates = float(e["input_usd_per_1k"]), float(e["output_usd_per_1k"])
            rows.append((name, "tokens", None, *rates))
        else:
            raise ValueError(f"unknown pricing unit {e.get('unit')!r} for {name}")
    return spark.createDataFrame(rows, PRICE_SCHEMA)


def catalog_stamp(catalog: DataFrame) -> DataFrame:
    """Twelve hex digits that change when any rate changes."""
    row = F.to_json(F.struct(*[F.col(c) for c in catalog.columns]))
    return catalog.agg(
        F.left(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), "\n"), 256), F.lit(12))
        .alias("catalog_sha")
    )


REGISTRY_SCHEMA = """id string, shape string, transport string, model string,
  upstream_parser string, precision string, weights_licence string,
  provider_tos_commercial string, tos_note string, provenance string, release_date string,
  local boolean, promptable boolean, input_mode string,
  input_per_mtok double, output_per_mtok double"""


def registry(*parts: DataFrame) -> DataFrame:
    """Several registry tables as one; an id that appears twice stops the job."""
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    copies = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    clash = copies.agg(F.array_join(F.array_sort(F.collect_set("id")), ", ").alias("ids")).scalar()
    return rows.where(
        F.when(F.coalesce(clash, F.lit("")) == "", True).otherwise(
            F.raise_error(F.concat(F.lit("duplicate registry ids: "), clash)).cast("boolean")
        )
    )

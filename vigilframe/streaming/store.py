"""Versioned tables for learned state: one folder per version and a pointer to the current one."""

from __future__ import annotations

import json
import logging
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA_VERSION = 1
log = logging.getLogger(__name__)


class NewerVersionError(RuntimeError):
    """The stored state was written by a newer version."""


def save_tables(
    spark: SparkSession, path: str, tables: dict[str, DataFrame], meta: dict, keep: int = 3
) -> str:
    """Write all tables under a new version, then move the pointer: readers see whole sets only."""
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    for name, df in tables.items():
        df.write.parquet(f"{path}/v-{version}/{name}")
    row = {"version": version, "schema_version": SCHEMA_VERSION, "tables": ",".join(sorted(tables)), "meta": json.dumps(meta)}
    # The pointer is an append: the row with the largest version is the current one.
    spark.createDataFrame([row]).coalesce(1).write.mode("append").json(f"{path}/pointer")
    return version


def load_tables(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict] | None:
    """(tables, meta) of the current version; None if nothing is stored; refuses a newer format."""
    try:
        pointer = spark.read.schema(
            "version string, schema_version int, tables string, meta string"
        ).json(f"{path}/pointer")
    except AnalysisException:
        return None
    row = pointer.orderBy(F.col("version").desc()).limit(1).collect()
    if not row:
        return None
    row = row[0]
    if row.schema_version > SCHEMA_VERSION:
        raise NewerVersionError(f"{path}: schema {row.schema_version} is newer than {SCHEMA_VERSION}")
    names = [n for n in row.tables.split(",") if n]
    return {n: spark.read.parquet(f"{path}/v-{row.version}/{n}") for n in names}, json.loads(row.meta)


def checkpoint_baselines(
    spark: SparkSession, path: str, baselines: DataFrame, profiles: DataFrame, registry: DataFrame,
    bucket_seconds: int, hostname: str, last_snapshot_us: int, state: dict[str, DataFrame] | None = None,
) -> str:
    """Replace the whole learned set atomically; ``state`` (see `operators.live`) lets it be learned on."""
    learned = {f"state_{n}": df for n, df in (state or {}).items()}
    return save_tables(
        spark, path, {"baselines": baselines, "profiles": profiles, "registry": registry, **learned},
        {"bucket_seconds": bucket_seconds, "hostname": hostname, "last_snapshot_us": last_snapshot_us},
    )


def restore_baselines(
    spark: SparkSession, path: str, bucket_seconds: int, hostname: str
) -> dict[str, DataFrame] | None:
    """Learned set for a restart.  Another bucket length: baselines are dropped, templates kept.
    Another host: a warning only."""
    found = load_tables(spark, path)
    if found is None:
        return None
    tables, meta = found
    if meta["hostname"] != hostname:
        log.warning("baselines at %s were learned on %s", path, meta["hostname"])
    if meta["bucket_seconds"] != bucket_seconds:
        log.warning("bucket length changed from %s: baselines dropped", meta["bucket_seconds"])
        return {"registry": tables["registry"]}
    return tables


def restored_state(found: dict[str, DataFrame] | None) -> dict[str, DataFrame] | None:
    """The learned state in what `restore_baselines` found; None if it holds none."""
    state = {n.removeprefix("state_"): df for n, df in (found or {}).items() if n.startswith("state_")}
    return state or None


def checkpoint_notes(spark: SparkSession, path: str, notes: DataFrame) -> str:
    return save_tables(spark, path, {"notes": notes}, {"kind": "notes"})


def restore_notes(spark: SparkSession, path: str) -> DataFrame | None:
    """Stored note state; None (rebuild from the files) if it is missing or of another version."""
    try:
        found = load_tables(spark, path)
    except NewerVersionError as err:
        log.warning("note state set aside: %s", err)
        return None
    if found is None or "notes" not in found[0]:
        return None
    return found[0]["notes"]


def write_if_changed(new: DataFrame, path: str) -> bool:
    """Overwrite a table only if its rows differ (symmetric difference); True if written."""
    spark = new.sparkSession
    from vigilframe.operators.ordered import stage

    staged = stage(new, "changed")
    try:
        old = spark.read.parquet(path)
        if (
            old.columns == staged.columns
            and staged.exceptAll(old).isEmpty()
            and old.exceptAll(staged).isEmpty()
        ):
            return False
    except AnalysisException:
        log.info("no previous table at %s", path)
    staged.write.mode("overwrite").parquet(path)
    return True

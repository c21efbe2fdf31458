"""Mart-load queries: last write wins, retention, upsert, idempotent rerun, unique docs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pricelens.operators import load as LD
from pricelens.plans.registry import register
from pricelens.session import ensure_checkpoint_dir, stored
from pricelens.sources import versions as V
from pricelens.sources.tables import shape, shape_cte

RUN_DS = "2000-01-16"
CTE = shape_cte("parts_master", "staged_mart")
MART_COLS = ["part_official_name", "car_type", "extracted_at", "min_price", "max_price"]


def _out(df):
    return df.select(*[F.col(c).cast("string").alias(c) if c == "extracted_at" else F.col(c) for c in MART_COLS])


def _staged(spark, sf, cache=None):
    return shape(spark, sf, "staged_mart", cache)


LWW_SQL = (
    "lww AS (SELECT part_official_name, car_type, extracted_at, min_price, max_price FROM (SELECT *, row_number() OVER "
    "(PARTITION BY part_official_name, car_type, extracted_at ORDER BY seq1 DESC, seq2 DESC, min_price DESC, max_price DESC) AS rn "
    "FROM staged_mart) WHERE rn = 1)"
)
UPSERT_SQL = (
    LWW_SQL + ", up AS (SELECT * FROM (SELECT part_official_name, car_type, extracted_at, min_price, max_price FROM parts_master "
    f"WHERE extracted_at >= DATE '{RUN_DS}' - INTERVAL 1 MONTH) x WHERE NOT EXISTS (SELECT 1 FROM lww s WHERE "
    "s.part_official_name = x.part_official_name AND s.car_type = x.car_type AND s.extracted_at = x.extracted_at) "
    "UNION ALL SELECT * FROM lww)"
)


@register(
    "last_write_wins",
    CTE + ", " + LWW_SQL + " SELECT part_official_name, car_type, CAST(extracted_at AS VARCHAR) AS extracted_at, min_price, max_price FROM lww",
)
def q_last_write_wins(spark, sf):
    st = _staged(spark, sf)
    return _out(LD.last_write_wins(st, LD.MART_KEY, STAGED_ORDER))


@register(
    "retention",
    CTE + "SELECT part_official_name, car_type, CAST(extracted_at AS VARCHAR) AS extracted_at, min_price, max_price FROM parts_master "
    f"WHERE extracted_at >= DATE '{RUN_DS}' - INTERVAL 1 MONTH",
)
def q_retention(spark, sf):
    return _out(LD.retention(shape(spark, sf, "parts_master"), RUN_DS))


@register(
    "retention_delete",
    CTE + "SELECT CAST(extracted_at AS VARCHAR) AS extracted_at, count(*) AS n_deleted FROM parts_master "
    f"WHERE extracted_at < DATE '{RUN_DS}' - INTERVAL 1 MONTH GROUP BY extracted_at",
)
def q_retention_delete(spark, sf):
    deleted = LD.expired(shape(spark, sf, "parts_master"), RUN_DS)
    return deleted.groupBy(F.col("extracted_at").cast("string").alias("extracted_at")).agg(F.count(F.lit(1)).alias("n_deleted"))


STAGED_ORDER = ["seq1", "seq2", "min_price", "max_price"]


def _upsert(spark, sf, twice=False):
    cache: dict = {}
    existing = shape(spark, sf, "parts_master", cache).select(*MART_COLS)
    st = _staged(spark, sf, cache)
    out = LD.upsert_mart(existing, st, RUN_DS, STAGED_ORDER)
    if twice:
        out = LD.upsert_mart(out, st, RUN_DS, STAGED_ORDER)
    return _out(out)


@register(
    "upsert_mart",
    CTE + ", " + UPSERT_SQL + " SELECT part_official_name, car_type, CAST(extracted_at AS VARCHAR) AS extracted_at, min_price, max_price FROM up",
)
def q_upsert_mart(spark, sf):
    return _upsert(spark, sf)


@register(
    "write_idempotent",
    CTE + ", " + UPSERT_SQL + " SELECT part_official_name, car_type, CAST(extracted_at AS VARCHAR) AS extracted_at, min_price, max_price FROM up",
)
def q_write_idempotent(spark, sf):
    """A rerun of the same date on the already-upserted table gives the same table."""
    return _upsert(spark, sf, twice=True)


@register(
    "sink_mart_versions",
    CTE + ", " + UPSERT_SQL + " SELECT part_official_name, car_type, CAST(extracted_at AS VARCHAR) AS extracted_at, min_price, max_price FROM up",
)
def q_sink_mart_versions(spark, sf):
    """The mart on storage: imported, loaded, loaded again, read back by its latest version."""
    cache: dict = {}
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pricelens-io/versions-{uuid.uuid4().hex}"
    # the inputs that several of the shapes below read, each made once
    for name in ("est_parts", "price_mart"):
        cache[name] = stored(shape(spark, sf, name, cache))
    existing = shape(spark, sf, "parts_master", cache).select(*MART_COLS)
    V.import_version(spark, root, existing)
    staged = stored(_staged(spark, sf, cache))
    for _ in range(2):
        V.load_version(spark, root, staged, RUN_DS, STAGED_ORDER, existing.schema)
    return _out(V.read_days(spark, root, V.read_version(spark, root), existing.schema))

"""Parts and staged rows: nothing is gathered in a fixed number of tasks or read again."""

import uuid

from pyspark.sql import functions as F

from pricelens.plans import q_io
from pricelens.session import ensure_checkpoint_dir
from pricelens.sources import io as IO
from pricelens.sources import versions as V


def test_compacted_parts_are_as_many_as_their_tasks(spark, monkeypatch):
    rows = spark.range(0, 900, numPartitions=9).select(*[F.concat(F.lit(c), F.col("id")).alias(c) for c in IO.RAW_STORE_COLUMNS])
    monkeypatch.setattr(q_io, "_raw_listing", lambda *_: rows)
    parts = []
    compact = IO.compact_parts

    def counted(spark, parts_dir, *rest):
        parts.extend(IO.list_files(spark, parts_dir))
        return compact(spark, parts_dir, *rest)

    monkeypatch.setattr(IO, "compact_parts", counted)
    assert sorted(q_io.q_compact_parts(spark, "").collect()) == sorted(rows.collect()) and len(parts) == 9


def test_a_load_reads_its_staged_rows_once(spark):
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/test-versions-{uuid.uuid4().hex}"
    schema = spark.range(0).selectExpr("'' as part_official_name", "'' as car_type", "date'2026-03-16' as extracted_at", "0 as min_price", "0 as max_price").schema
    rows = spark.range(60).selectExpr("concat('n', id % 20) as part_official_name", "'v' as car_type", "date'2026-03-16' - cast(id % 2 as int) as extracted_at",
                                      "cast(id as int) as min_price", "cast(id + 1 as int) as max_price", "id as seq")
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    version = V.load_version(spark, root, rows.mapInArrow(count, rows.schema), "2026-03-16", "seq", schema)
    got = sorted(tuple(r) for r in V.read_days(spark, root, version, schema).select("part_official_name", "min_price").collect())
    assert got == sorted((f"n{k % 20}", k) for k in range(40, 60)) and read.value == 60

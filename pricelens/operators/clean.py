"""Clean jobs: source-specific raw crawl rows -> one clean schema, one row per part x vehicle.

``clean_listings(df, rules, dt)`` is the single entry for all three rule sets.  The plan is
scan -> project -> filter -> generate (explode) with no shuffle: every expression is a
native Column expression, so filters are evaluated before the explode and the scan only
reads the columns a rule set needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.functions import text as T
from pricelens.functions.vehicles import RULE_SETS

CLEAN_COLUMNS = ["part_no", "name", "price", "car_type"]


def _nonblank(c):
    # a null length drops the row too, so no separate isNotNull: Catalyst pushes these
    # filters below the staged projections with the expression inlined, and each extra
    # reference re-evaluates the whole part-number cascade in the scan-side filter
    return F.length(c) > 0


def _market(df: DataFrame) -> DataFrame:
    name = T.strip_trailing_paren(F.col("name"))
    part_no = F.trim(F.col("part_no"))
    return df.select(
        part_no.alias("part_no"),
        name.alias("name"),
        T.price_to_int(F.col("price")).alias("price"),
        F.col("car_type").alias("cell"),
    ).where(_nonblank(F.col("name")) & _nonblank(F.col("part_no")))


def _store(df: DataFrame) -> DataFrame:
    official = F.trim(F.col("official_name"))
    return df.where(_nonblank(official)).select(
        T.part_no_from_name(F.col("official_name"), F.col("part_no")).alias("part_no"),
        T.name_without_part_no(F.col("official_name")).alias("name"),
        T.price_to_int(F.col("price")).alias("price"),
        F.col("applicable").alias("cell"),
    ).where(_nonblank(F.col("name")) & _nonblank(F.col("part_no")))


def _partsro(df: DataFrame) -> DataFrame:
    # staged projections: every regex result is referenced by name, so Catalyst keeps it
    # computed once (CollapseProject does not inline an expensive expression used twice)
    # the part-number test is the cascade's one-regex twin: the filter is pushed to the
    # scan and must not inline the five-candidate cascade
    raw = df.where(_nonblank(F.trim(F.col("official_name"))) & T.part_no_present(F.trim(F.col("part_no")))).select(
        F.trim(F.col("official_name")).alias("official"),
        F.trim(F.col("part_no")).alias("raw_part"),
        T.price_to_int(F.col("price")).alias("base_price"),
        F.col("applicable").alias("cell"),
    )
    parts = raw.select(
        "official", "base_price", "cell", "raw_part",
        F.regexp_extract("raw_part", T.PACK_RE, 1).alias("pack"),
        F.regexp_extract("raw_part", T.PACK_RE, 2).alias("qty_s"),
    )
    out = parts.select(
        T.part_no_cascade(F.col("raw_part"), pack=F.col("pack")).alias("part_no"),
        T.strip_trailing_paren(F.col("official")).alias("name"),
        T.unit_price_from_pack(F.col("base_price"), F.when(F.length("qty_s") > 0, F.col("qty_s").try_cast("int"))).alias("price"),
        "cell",
    )
    return out.where(_nonblank(F.col("name")))


_PROJECTIONS = {"market": _market, "store": _store, "partsro": _partsro}


def tag_lineage(df: DataFrame, source: str, dt: str | None = None) -> DataFrame:
    """Add ``dt`` only when given, then ``source``."""
    out = df.withColumn("dt", F.lit(dt)) if dt else df
    return out.withColumn("source", F.lit(source))


def parse_cells(df: DataFrame, cell_col: str, rules: str, out_col: str = "vehicles", dedupe: bool = True,
                cells_from: DataFrame | None = None) -> DataFrame:
    """Add the parsed vehicle list of ``cell_col``.

    With ``dedupe`` the parser runs once per *distinct* cell (partial aggregation keeps the
    distinct step cheap) and the result is joined back null-safely; the mapping is small
    (cells repeat across rows and days), so AQE broadcasts it, and a hot cell on the big
    side is split by AQE's skew handling.  Without it, the parse is a plain projection.
    """
    parse = RULE_SETS[rules]
    if not dedupe:
        return df.withColumn(out_col, parse(F.col(cell_col)))
    # distinct cells come from the raw cell column when given (a superset, one-column scan)
    src = df.select(F.col(cell_col).alias("_cell")) if cells_from is None else cells_from.toDF("_cell")
    cells = src.distinct().select("_cell", parse(F.col("_cell")).alias(out_col))
    return df.join(cells, df[cell_col].eqNullSafe(cells["_cell"]), "inner").drop("_cell")


def clean_listings(df: DataFrame, rules: str, dt: str | None = None, source: str | None = None,
                   dedupe_cells: bool = True) -> DataFrame:
    """Raw rows of one site -> (part_no, name, price, car_type[, dt], source)."""
    if rules not in _PROJECTIONS:
        raise ValueError(f"unknown rule set {rules!r}; expected one of {sorted(_PROJECTIONS)}")
    raw_cell = "car_type" if rules == "market" else "applicable"
    projected = parse_cells(_PROJECTIONS[rules](df), "cell", rules, "vehicles", dedupe_cells, cells_from=df.select(raw_cell))
    # explode_outer: a parsed list is never empty, so the rows are the same, and no
    # size(vehicles) > 0 filter is inferred and pushed below the distinct-cell join
    out = projected.select("part_no", "name", "price", F.explode_outer("vehicles").alias("car_type"))
    return tag_lineage(out, source or rules, dt)


def vehicle_rows(df: DataFrame, cell_col: str, rules: str, keys: list[str], dedupe_cells: bool = True) -> DataFrame:
    """G1-G3 alone: one row per (keys..., vehicle) with the 1-based position in the cell."""
    parsed = parse_cells(df.select(*keys, cell_col), cell_col, rules, "vehicles", dedupe_cells)
    return parsed.select(*keys, F.posexplode_outer("vehicles").alias("pos", "vehicle")).withColumn("pos", F.col("pos") + 1)

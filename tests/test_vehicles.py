import pytest
from pyspark.sql import functions as F

from pricelens.functions.vehicles import vehicles_market, vehicles_partsro, vehicles_store

CASES = [
    # (rule set, cell, expected)
    ("market", None, ["All"]),
    ("store", None, ["All"]),
    ("partsro", None, ["All"]),
    ("market", "   ", ["All"]),
    ("store", "", ["All"]),
    ("market", "[차종 및 연식] 전차종", ["All"]),
    ("market", "전차종 쏘나타(LF)(2014~2017) 아반떼(AD)", ["All", "쏘나타(LF)", "아반떼(AD)"]),
    ("market", "포터 4X2/4X4", ["포터 4X2", "포터 4X4"]),
    ("store", "포터 4X2/4X4", ["포터 4X2", "포터 4X4"]),
    ("partsro", "포터 4X2 / 4X4", ["포터 4X2", "4X4"]),
    ("store", "쏘나타 16,19년식, 아반떼", ["쏘나타 16,19년식", "아반떼"]),
    ("partsro", "쏘나타(LF) 2014~2017", ["쏘나타"]),
    ("market", "BRACKET ASSY", ["All"]),
    ("store", "BRACKET ASSY", ["All"]),
    ("partsro", "BRACKET ASSY", ["All"]),
    ("market", "A_B, X", ["All"]),
    ("store", "A_B, X", ["All"]),
    ("partsro", "A_B, X", ["All"]),
    ("market", "아반떼, 아반떼", ["아반떼"]),
    ("store", "아반떼, 아반떼", ["아반떼"]),
    ("partsro", "아반떼, 아반떼", ["아반떼"]),
    ("market", "차종: 그랜저(IG)", ["그랜저(IG)"]),
    ("market", "전 차종", ["All"]),
    # inline years go before the date-style rule, so a 20xx year leaves "12:JAN." behind
    ("partsro", "K5 &amp; K7, 12:JAN.2015 스포티지", ["K5 & K7", "12:JAN. 스포티지"]),
    ("partsro", "12:JAN.3015 스포티지", ["스포티지"]),
    ("market", "Clipper, nutcase van", ["All"]),
]

FN = {"market": vehicles_market, "store": vehicles_store, "partsro": vehicles_partsro}


@pytest.mark.parametrize("rules,cell,expected", CASES)
def test_vehicle_cells(spark, rules, cell, expected):
    df = spark.createDataFrame([(cell,)], "cell string")
    got = df.select(FN[rules](F.col("cell")).alias("v")).first()["v"]
    assert got == expected


def test_explode_never_loses_a_row(spark):
    cells = [(c,) for _, c, _ in CASES]
    df = spark.createDataFrame(cells, "cell string")
    for fn in FN.values():
        n = df.select(F.explode(fn(F.col("cell")))).count()
        assert n >= df.count()

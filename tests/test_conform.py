import difflib
import random

from pyspark.sql import functions as F

from pricelens.functions.similarity import sequence_ratio
from pricelens.functions.text import norm_text, token_set
from pricelens.operators.conform import conform_vehicles, match_vehicles

CANON = ["쏘나타(LF)", "G80(DH)", "G80(RG3)", "투싼(JM)", "투싼(TL)", "투싼(NX4)", "아반떼(AD)", "GV70 일렉트릭"]


def _canon(spark, names=CANON):
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "canonical_name string, idx long")


def _match(spark, raws, names=CANON):
    df = spark.createDataFrame([(r,) for r in raws], "raw string")
    return {r["raw"]: (r["canonical"], r["score"]) for r in match_vehicles(df, _canon(spark, names)).collect()}


def test_fixture_goldens(spark):
    got = _match(spark, [None, "", "All", "---", "쏘나타(LF)", "쏘나타 LF", "G80", "투싼"])
    assert got[None][0] == "all" and got[""][0] == "all" and got["All"][0] == "all"
    assert got["---"][0] == "unknown"
    assert got["쏘나타(LF)"][0] == "쏘나타(LF)" and abs(got["쏘나타(LF)"][1] - 1.0) < 1e-9
    assert got["쏘나타 LF"][0] == "쏘나타(LF)" and abs(got["쏘나타 LF"][1] - 1.0) < 1e-9
    assert got["G80"][0] == "G80(DH)" and abs(got["G80"][1] - 0.725) < 1e-9
    assert got["투싼"][0] == "투싼(JM)"


def test_ratio_matches_difflib_and_is_ordered(spark):
    rng = random.Random(7)
    alphabet = "abcde가나다12 "
    pairs = [("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))),
              "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12)))) for _ in range(300)]
    pairs += [("tide", "diet"), ("diet", "tide")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r["r"] for r in df.select(sequence_ratio("a", "b").alias("r")).collect()]
    want = [difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    assert all(abs(x - y) < 1e-12 for x, y in zip(got, want))
    assert abs(got[-2] - 0.25) < 1e-12 and abs(got[-1] - 0.5) < 1e-12


def _brute(raw, names):
    """All-pairs evaluation of the documented rule (M1-M6) in plain Python."""
    t = (raw or "").strip()
    if not t or t.lower() == "all":
        return "all"
    norm = lambda s: "".join(ch for ch in s.strip().lower() if ch.isalnum())
    toks = lambda s: {x for x in __import__("re").split(r"[^\w]+|_", s.lower()) if x}
    n = norm(t)
    if not n:
        return "unknown"
    best, best_s = None, -1.0
    for name in names:
        cn = norm(name)
        r = difflib.SequenceMatcher(None, n, cn).ratio()
        a, b = toks(t), toks(name)
        j = len(a & b) / len(a | b) if (a | b) else 0.0
        c = 1.0 if (n in cn or cn in n) else 0.0
        s = 0.7 * r + 0.2 * j + 0.1 * c
        if s > best_s:
            best, best_s = name, s
    return best if best_s >= 0.55 else None


def test_pruned_candidates_equal_all_pairs(spark):
    names = ["red widget", "blue bolt hybrid", "K5 small ring", "green gear (K3)", "cold plate", "old rod"]
    raws = ["red widget", "RED WIDGET x", "blue", "small ring", "ring K5", "gear", "zzz", "qq plate", "old  rod", "widget red"]
    got = _match(spark, raws, names)
    for r in raws:
        want = _brute(r, names)
        if want is not None:
            assert got[r][0] == want, r


def test_conform_keeps_row_count(spark):
    rows = [("p1", "쏘나타(LF)"), ("p2", "쏘나타 LF"), ("p3", None), ("p4", "  "), ("p5", "G80"), ("p6", "G80")]
    df = spark.createDataFrame(rows, "part_no string, car_type string")
    out = conform_vehicles(df, _canon(spark))
    assert out.count() == len(rows)
    assert out.columns == ["part_no", "car_type"]
    got = dict((r["part_no"], r["car_type"]) for r in out.collect())
    assert got == {"p1": "쏘나타(LF)", "p2": "쏘나타(LF)", "p3": "all", "p4": "all", "p5": "G80(DH)", "p6": "G80(DH)"}


def test_no_python_eval_outside_ratio(spark):
    df = spark.createDataFrame([("G80",)], "raw string")
    plan = match_vehicles(df, _canon(spark))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan


def test_ratio_bound_pruning_is_exact_on_random_names(spark):
    """Many near-ties over a tiny alphabet: the pruned argmax equals all-pairs argmax."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcab가") for _ in range(rng.randint(1, 5)))
    names = list(dict.fromkeys(" ".join(word() for _ in range(rng.randint(1, 2))) for _ in range(25)))
    raws = list(dict.fromkeys(" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(150)))
    got = _match(spark, raws, names)
    checked = 0
    for r in raws:
        want = _brute(r, names)
        if want is not None:
            assert got[r][0] == want, r
            checked += 1
    assert checked > 50

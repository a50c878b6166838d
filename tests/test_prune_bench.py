from slimctx.plans.api import CorpusIndex, render_text
from conftest import make_files
from fixtures import JS_APP, PY_APP, TS_APP

ALL = {**PY_APP, **JS_APP, **TS_APP}


def test_prune_python(spark):
    idx = CorpusIndex(make_files(spark, PY_APP))
    p = {r.path: r for r in idx.prune(idx.seeds(["sky/plan.py"], "schedule")).collect()}
    entry = p["sky/plan.py"].source
    assert entry.startswith("from .units import to_degrees\n\ndef schedule(target, nights=(1, 2)")
    assert "rise" not in entry and "Dome" not in entry
    assert p["sky/units.py"].source == "def to_degrees(hours, minutes=0):\n    pass\n"
    assert p["sky/units.py"].estimated_tokens == max(1, len(p["sky/units.py"].source) // 4)
    assert p["sky/plan.py"].symbols == ["schedule"]


def test_unknown_request_keeps_everything(spark):
    idx = CorpusIndex(make_files(spark, PY_APP))
    p = {r.path: r for r in idx.prune(idx.seeds(["sky/plan.py"], "nothing_here")).collect()}
    assert list(p) == ["sky/plan.py"]                       # nothing followed
    src = p["sky/plan.py"].source
    assert "def schedule" in src and "def rise" in src and "class Dome" in src
    assert p["sky/plan.py"].symbols == []


def test_render_text(spark):
    idx = CorpusIndex(make_files(spark, PY_APP))
    t = render_text(idx.prune(idx.seeds(["sky/plan.py"], "schedule"))).first().text
    assert t.startswith("# === sky/plan.py (")
    assert "# === sky/units.py (" in t and t.endswith(" tokens across 2 file(s)\n")


def _bench(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    idx = CorpusIndex(make_files(spark, ALL))
    b, f = idx.benchmark(idx.seeds())
    out = ({r.entry: r.asDict() for r in b.collect()}, {(r.entry, r.path): r.asDict() for r in f.collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    return out


def test_bench_invariants_and_partition_independence(spark):
    b, f = _bench(spark, 1)
    for e, r in b.items():
        assert r["tokens_saved"] == r["baseline_tokens"] - r["pruned_tokens"]
        files = [v for (ee, _), v in f.items() if ee == e]
        assert r["baseline_files"] == len(files)
        assert r["baseline_tokens"] == sum(v["raw_tokens"] for v in files)
        assert r["pruned_tokens"] == sum(v["pruned_tokens"] for v in files)
        assert r["pruned_tokens"] <= r["baseline_tokens"]
        assert r["compression_ratio"] >= 1.0
    assert b["sky/plan.py"]["baseline_files"] == 2 and b["sky/plan.py"]["reduction_pct"] > 0
    assert (b, f) == _bench(spark, 16)

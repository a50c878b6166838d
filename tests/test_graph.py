import pytest

from slimctx.plans.api import CorpusIndex
from conftest import make_files
from fixtures import CYCLE, DIAMOND, JS_APP, PY_APP

LATE = {
    "late/top.py": "from .mid import m1\nfrom .side import s1\n\n\ndef go():\n    return m1() + s1()\n",
    "late/side.py": "from .mid import m2\n\n\ndef s1():\n    return m2()\n",
    "late/mid.py": "from .leaf import z\n\n\ndef m1():\n    return 1\n\n\ndef m2():\n    return z()\n",
    "late/leaf.py": "def z():\n    return 0\n",
}

STAR = {
    "st/a.py": "from .b import *\n\n\ndef a():\n    return 1\n",
    "st/b.py": "from .c import *\n\n\ndef b():\n    return 2\n",
    "st/c.py": "def c():\n    return 3\n",
}


def _nodes(spark, files, entry, syms, depth=3, mode="bfs"):
    idx = CorpusIndex(make_files(spark, files))
    n = idx.graph(idx.seeds([entry], syms), depth, mode)
    return {r.path: (r.depth, list(r.syms)) for r in n.collect()}


def test_entry_and_dependency(spark):
    n = _nodes(spark, PY_APP, "sky/plan.py", "schedule")
    assert n == {"sky/plan.py": (0, ["schedule"]), "sky/units.py": (1, ["to_degrees"])}


def test_depth_zero_is_entry_only(spark):
    assert list(_nodes(spark, PY_APP, "sky/plan.py", "schedule", depth=0)) == ["sky/plan.py"]


def test_cycle_terminates_and_merges_back(spark):
    n = _nodes(spark, CYCLE, "hill/up.py", "climb", depth=5)
    assert n == {"hill/up.py": (0, ["camp", "climb"]), "hill/down.py": (1, ["rest"])}


def test_diamond(spark):
    n = _nodes(spark, DIAMOND, "bread/loaf.py", "bake")
    assert n["bread/mill.py"] == (2, ["bran", "flour"])


def test_late_merge_is_output_only_in_bfs(spark):
    bfs = _nodes(spark, LATE, "late/top.py", "go")
    assert bfs["late/mid.py"] == (1, ["m1", "m2"])
    assert "late/leaf.py" not in bfs                     # m2 arrived after mid was expanded
    clo = _nodes(spark, LATE, "late/top.py", "go", mode="closure")
    assert clo["late/leaf.py"] == (3, ["z"])
    assert set(bfs) <= set(clo)


def test_star_imports_are_followed(spark):
    n = _nodes(spark, STAR, "st/a.py", "a")
    assert n["st/b.py"] == (1, ["*"]) and n["st/c.py"] == (2, ["*"])


def test_javascript_traversal(spark):
    n = _nodes(spark, JS_APP, "seeds/catalog.js", "pack")
    assert n["seeds/scale.js"] == (1, ["weigh"])


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_closure_monotone_in_depth(spark, depth):
    a = _nodes(spark, LATE, "late/top.py", "go", depth=depth, mode="closure")
    b = _nodes(spark, LATE, "late/top.py", "go", depth=depth + 1, mode="closure")
    assert set(a) <= set(b)

from slimctx.plans.api import CorpusIndex
from slimctx.sources.corpus import scan_source_tree
from fixtures import PY_APP


def _tree(tmp_path, files):
    for rel, text in files.items():
        p = tmp_path / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text.encode() if isinstance(text, str) else text)


def test_scan_tree_and_prune(spark, tmp_path):
    _tree(tmp_path, {**PY_APP, "app/logo.png": b"\x89PNG\xff\x00", "app/bad.py": b"x = '\xff'\n"})
    files = scan_source_tree(spark, str(tmp_path))
    got = {r.path: r for r in files.collect()}
    assert set(got) == {"sky/plan.py", "sky/units.py", "app/bad.py"}          # assets left out
    assert got["app/bad.py"].text == "x = '�'\n" and got["app/bad.py"].raw_bytes == 8
    idx = CorpusIndex(files)
    p = {r.path for r in idx.prune(idx.seeds(["sky/plan.py"], "schedule")).collect()}
    assert p == {"sky/plan.py", "sky/units.py"}
    with_assets = scan_source_tree(spark, str(tmp_path), include_assets=True)
    assert {r.path: r.language for r in with_assets.collect()}["app/logo.png"] == "javascript"

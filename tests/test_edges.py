"""Unreadable files keep their edge; paths, blocks and requests."""

import pytest
from conftest import make_files
from fixtures import PY_APP

from slimctx.plans.api import CorpusIndex, render_blocks, write_text
from slimctx.sources.corpus import scan_source_tree


def test_unreadable_dependency_keeps_its_edge(spark):
    files = {"u/a.py": "from .lost import x\nfrom .b import y\n\n\ndef a():\n    return x() + y()\n",
             "u/b.py": "def y():\n    return 1\n"}
    listing = spark.createDataFrame([(p,) for p in [*files, "u/lost.py"]], "path string")
    idx = CorpusIndex(make_files(spark, files), listing=listing)
    assert {(r.dst, r.readable) for r in idx.file_edges().collect()} == {("u/lost.py", False), ("u/b.py", True)}
    assert {r.path for r in idx.graph(idx.seeds(["u/a.py"]), 3).collect()} == {"u/a.py", "u/b.py"}
    plain = CorpusIndex(make_files(spark, files))
    assert {r.dst for r in plain.file_edges().collect()} == {"u/b.py"}


def test_requests_with_blanks_do_not_collide(spark):
    files = {"k/m.js": "export const a = 1;\nexport const b = 2;\nexport { c as d };\n",
             "k/e.js": 'import { a } from "./m";\nexport const z = a;\n'}
    idx = CorpusIndex(make_files(spark, files))
    ask = spark.createDataFrame([("k/m.js", ["a b"]), ("k/e.js", ["z"])], "entry string, syms array<string>")
    got = {(r.entry, r.path): list(r.symbols) for r in idx.prune(idx.seeds(ask)).collect()}
    assert got["k/m.js", "k/m.js"] == [] and got["k/e.js", "k/m.js"] == ["a"]


def test_blocks_are_written_in_order(spark, tmp_path):
    idx = CorpusIndex(make_files(spark, PY_APP))
    pruned = idx.prune(idx.seeds(["sky/plan.py"], "schedule"))
    assert render_blocks(pruned).count() == 3
    write_text(pruned, str(tmp_path / "t"))
    text = "".join(r.value + "\n" for r in spark.read.text(str(tmp_path / "t")).coalesce(1).collect())
    assert text.index("# === sky/plan.py") < text.index("# === sky/units.py") < text.index("# Total: ")


@pytest.mark.parametrize("form", ["{}", "{}/", "file://{}", "file:{}"])
def test_roots_with_and_without_scheme(spark, tmp_path, form):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.py").write_text("from .b import x\n\n\ndef f():\n    return x\n")
    (tmp_path / "p" / "b.py").write_text("x = 1\n")
    files = scan_source_tree(spark, form.format(tmp_path))
    assert {r.path for r in files.collect()} == {"p/a.py", "p/b.py"}
    assert CorpusIndex(files).sym_edges.count() == 1


def test_no_local_folder_on_a_cluster():
    from slimctx import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *a):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        session.checkpoint_root(Session())


def test_scratch_tables_can_be_cleaned(spark):
    import os

    from slimctx import session
    before = len(session._WRITTEN)
    path = session.materialize(spark.range(3), "clean-me").inputFiles()[0]
    assert os.path.exists(path.removeprefix("file://")) and len(session._WRITTEN) == before + 1
    mine = session._WRITTEN[before:]
    kept, session._WRITTEN[:] = session._WRITTEN[:before], mine
    assert session.clean_scratch(spark) == 1
    session._WRITTEN[:] = kept
    assert not os.path.exists(path.removeprefix("file://"))

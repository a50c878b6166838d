from pyspark.sql import functions as F

from slimctx.functions.paths import language_of, normpath
from slimctx.operators.extract import parse_files
from slimctx.operators.resolve import resolve_specifiers
from conftest import make_files


def test_language_and_normpath(spark):
    df = spark.createDataFrame([("a/b.py",), ("x.TSX",), ("c.mjs",), ("logo.png",)], "p string")
    assert [r.l for r in df.select(language_of(F.col("p")).alias("l")).collect()] == \
        ["python", "typescript", "javascript", "javascript"]
    df = spark.createDataFrame([("src/p3/./../p1/m2",), ("a/../../b",), ("./x",), ("a/b/..",)], "p string")
    assert [r.n for r in df.select(normpath(F.col("p")).alias("n")).collect()] == ["src/p1/m2", "../b", "x", "a"]


def _resolve(spark, files):
    f = make_files(spark, files)
    r = resolve_specifiers(parse_files(f), f.select("path"))
    return {(x.src, x.specifier): x.dst for x in r.collect()}


def test_python_relative(spark):
    files = {
        "pkg/sub/mod.py": "from ..util import a\nfrom . import b\nfrom .deep.x import c\nimport os\n",
        "pkg/util.py": "a = 1\n",
        "pkg/sub/__init__.py": "b = 2\n",
        "pkg/sub/deep/x/__init__.py": "c = 3\n",
    }
    r = _resolve(spark, files)
    assert r[("pkg/sub/mod.py", "..util")] == "pkg/util.py"
    assert r[("pkg/sub/mod.py", ".")] == "pkg/sub/__init__.py"
    assert r[("pkg/sub/mod.py", ".deep.x")] == "pkg/sub/deep/x/__init__.py"
    assert ("pkg/sub/mod.py", "os") not in r                     # external


def test_extension_priority_and_index(spark):
    files = {
        "w/a.js": 'import { f } from "./lib";\nimport { g } from "./dir";\nimport { h } from "react";\n'
                  'import { m } from "./missing";\n',
        "w/b.ts": 'import { f } from "./lib";\n',
        "w/lib.js": "export function f() {}\n",
        "w/lib.ts": "export function f() {}\n",
        "w/dir/index.ts": "export function g() {}\n",
    }
    r = _resolve(spark, files)
    assert r[("w/a.js", "./lib")] == "w/lib.js"        # javascript tries .js first
    assert r[("w/b.ts", "./lib")] == "w/lib.ts"        # typescript tries .ts first
    assert r[("w/a.js", "./dir")] == "w/dir/index.ts"
    assert ("w/a.js", "react") not in r and ("w/a.js", "./missing") not in r

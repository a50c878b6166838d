import time

import pytest
from conftest import make_files
from fixtures import DECORATED, JS_APP, JS_FORMS, PY_APP, TS_APP
from pyspark.sql import functions as F

from slimctx.operators.extract import imports_table, parse_files, symbols_table


def _syms(spark, files):
    s = symbols_table(parse_files(make_files(spark, files)))
    return {(r.path, r.name): r for r in s.collect()}


def _imps(spark, files):
    return [(r.path, r.local_name, r.export_name, r.specifier)
            for r in imports_table(parse_files(make_files(spark, files))).orderBy("path", "line").collect()]


def _kinds(syms, path):
    return {n: r.kind for (p, n), r in syms.items() if p == path}


@pytest.fixture(scope="module")
def py(spark):
    return _syms(spark, PY_APP)


@pytest.fixture(scope="module")
def js(spark):
    return _syms(spark, JS_APP)


def test_python_symbols(py):
    assert _kinds(py, "sky/plan.py") == {
        "QUERY": "variable", "schedule": "function", "rise": "function", "wait": "function",
        "Dome": "class", "limit": "variable"}
    assert _kinds(py, "sky/units.py") == {"to_degrees": "function", "to_hours": "function", "EPOCH": "variable"}
    assert all(r.is_exported for r in py.values())
    assert py["sky/plan.py", "schedule"].used == ["to_degrees"]


def test_python_text_keeps_strings_and_brackets(py):
    q = py["sky/plan.py", "QUERY"]
    assert q.text == 'QUERY = """\nSELECT star\ndef not_code():\n"""'
    assert (q.start_line, q.end_line) == (9, 12)
    assert py["sky/plan.py", "limit"].text == "limit: int = len([\n3,\n4])"


def test_python_signatures(py):
    sig = {n: r.sig for (p, n), r in py.items()}
    assert sig["schedule"] == \
        "def schedule(target, nights=(1, 2), *, site: dict[str, int] = None) -> list:\n    pass"
    assert sig["rise"] == "def rise(t):\n    pass"
    assert sig["wait"] == 'async def wait(\n    seconds,\n    label="): not the end",\n):\n    pass'
    assert sig["Dome"] == "class Dome(object):\n    pass"
    assert sig["to_degrees"] == "def to_degrees(hours, minutes=0):\n    pass"


def test_python_imports(spark):
    assert _imps(spark, PY_APP) == [("sky/plan.py", "to_degrees", "to_degrees", ".units"),
                                    ("sky/plan.py", "os", "os", "os"),
                                    ("sky/plan.py", "js", "json", "json")]


def test_decorators_over_several_lines(spark):
    s = _syms(spark, DECORATED)
    c = s["oven/heat.py", "heated"]
    assert c.sig == "@contextlib.contextmanager\n@retry(\n    times=3,\n)\ndef heated(degrees):\n    pass"
    assert (c.start_line, c.decl_line, c.end_line) == (3, 7, 8)
    assert s["oven/heat.py", "PREHEAT"].kind == "variable"


def test_javascript_symbols(js):
    assert _kinds(js, "seeds/catalog.js") == {
        "path": "variable", "pack": "function", "label": "function", "twice": "function",
        "inline": "function", "rows": "variable", "beds": "variable", "sow": "variable", "Plot": "class",
        "module.exports": "variable"}
    assert _kinds(js, "seeds/scale.js") == {"weigh": "function", "tare": "function", "module.exports": "variable"}


def test_javascript_signatures(js):
    sig = {n: r.sig for (p, n), r in js.items()}
    assert sig["pack"] == "function pack({\n  kind,\n  count = 12,\n}) {}"
    assert sig["label"] == "const label = ({\n  name,\n}) => {};"
    assert sig["twice"] == "const twice = (f) => {};"
    assert sig["inline"] == "function inline(a) {}"
    assert sig["tare"] == "const tare = function (g) {};"
    assert js["seeds/scale.js", "weigh"].sig == "function weigh(g) {}"
    assert sig["Plot"] == ('class Plot {\n  #area = 4;\n  // grow the ( plot\n  async water(\n    litres,\n'
                           '    { warm = false } = {},\n  ) {}\n  static of(s = "}{") {}\n}')
    assert js["seeds/catalog.js", "label"].text.endswith("function phantom() {`;\n};")


def test_javascript_requires(spark):
    got = _imps(spark, JS_APP)
    assert ("seeds/catalog.js", "weigh", "weigh", "./scale") in got
    assert ("seeds/catalog.js", "path", "default", "path") in got and len(got) == 2


def test_typescript(spark):
    s = _syms(spark, TS_APP)
    assert _kinds(s, "ferry/board.ts") == {"next": "function", "late": "function", "quay": "function"}
    assert _kinds(s, "ferry/tables.ts") == {"Crossing": "interface", "Tide": "type", "Deck": "type",
                                            "tidal": "function"}
    sig = {n: r.sig for (p, n), r in s.items()}
    assert sig["next"] == "function next(c: Crossing, at: { hour: number }): { port: string } {}"
    assert sig["late"] == "const late = async (c: Crossing): Promise<number> => {};"
    assert s["ferry/tables.ts", "Crossing"].text.startswith("interface Crossing")
    assert not s["ferry/board.ts", "quay"].is_exported
    assert sorted(s["ferry/board.ts", "next"].used) == ["Crossing", "Tide"]


def test_es_module_forms(spark):
    s = _syms(spark, JS_FORMS)
    assert _kinds(s, "map/view.js") == {"Sheet": "class", "Page": "variable", "default": "function"}
    assert s["map/view.js", "Sheet"].sig == "class Sheet extends Paper {\n  constructor(w) {}\n  fold() {}\n}"
    imps = _imps(spark, JS_FORMS)
    assert imps == [("map/view.js", "Tiles", "default", "./layer"), ("map/view.js", "scale", "zoom", "./layer"),
                    ("map/view.js", "pan", "pan", "./layer"), ("map/view.js", "all", "*", "./layer")]


def test_awkward_files(spark):
    files = {"a.py": "", "b.js": "", "c.py": "\n\n# only a comment\n", "d.py": "x = 'open\ny = 1\n",
             "e.js": "const a = `never closed\nfunction f() {}\n", "f.py": "def f(:\n  pass\n\ndef g():\n  pass\n",
             "g.js": "const p = <p>it's (open</p>;\n\nfunction after(x) {\n  return x;\n}\n", "h.py": "@alone\n",
             "i.js": "// " + "{" * 3000 + "\nfunction z() {}\n", "j.py": 'S = "' + "a" * 200_000 + '"\n'}
    s = _syms(spark, files)
    names = {p: {n for (q, n) in s if q == p} for p in files}
    assert names == {"a.py": set(), "b.js": set(), "c.py": set(), "d.py": {"x", "y"}, "e.js": {"a"},
                     "f.py": {"f", "g"}, "g.js": {"p", "after"}, "h.py": set(), "i.js": {"z"}, "j.py": {"S"}}


def test_parsing_is_linear(spark):
    def seconds(n):
        text = "".join(f"from .m{i} import f{i}\n" for i in range(n)) + "".join(
            f"\n\ndef g{i}(x):\n    return f{i}(x)\n" for i in range(n))
        df = make_files(spark, {"big.py": text})
        best = 1e9
        for _ in range(2):
            t = time.time()
            got = symbols_table(parse_files(df)).agg(F.count("*"), F.sum(F.size("used"))).first()
            best = min(best, time.time() - t)
            assert tuple(got) == (n, n)
        return best

    seconds(100)                                   # compile
    small, large = seconds(1600), seconds(3200)
    assert large <= 2.5 * small + 0.5


def test_invalid_utf8_is_replaced(spark):
    from slimctx.functions.text import lossy_utf8
    raw = b"sea \xe2\x28 \xfe shore"
    df = spark.createDataFrame([(bytearray(raw),)], "b binary")
    assert df.select(lossy_utf8(F.col("b")).alias("t")).first().t == raw.decode("utf-8", errors="replace")


def test_names_in_every_script(spark):
    files = {"a.py": "from größe.maß import länge as ü\n\ndef café(a):\n    return a + ü\n\nclass Élan:\n    x = 1\n\nñ = 2\n",
             "b.ts": "import { été } from './saison';\nexport function número(a: string): string {\n  return a;\n}\nconst 変数 = 1;\n"}
    s = _syms(spark, files)
    assert _kinds(s, "a.py") == {"café": "function", "Élan": "class", "ñ": "variable"}
    assert "return" not in s["a.py", "café"].sig and "return" not in s["b.ts", "número"].sig
    assert set(_kinds(s, "b.ts")) == {"número", "変数"}
    assert _imps(spark, files) == [("a.py", "ü", "länge", "größe.maß"), ("b.ts", "été", "été", "./saison")]


LAYOUTS = {
    "one.js": "import a from './a';function one(x){return a(x)}function two(y){return y}",
    "indent.js": "   function ind(x) {\n     return x;\n   }\n   const k = 3;\n",
    "semi.js": "const a = 1; const b = 2; // both\n",
    "semi.py": "x = 1; y = ';'\ndef f(): z = 1; w = 2\nimport os; import sys\n",
    "open.js": "function f(a)\n{\n  return a;\n}\nconst t =\n  5\nconst u = [\n1,\n];\n",
    "tight.js": "class A{a(){return{}}b=1}class B extends A{}let h=2;export default function(){}",
    "types.ts": "abstract class Q<T extends {a: number}> {\n  go(): void { this.x = {}; }\n}\ntype U =\n| 'a'\n| 'b';\n"
                "export class M extends mix({x: 1}) implements I { m() { return {}; } }\n",
    "deco.ts": "@Part({\n  at: 'x',\n})\n@Other\nclass C {\n  m() { return 1; }\n}\n",
    "cont.py": "total = 1 + \\\n2\nz = 3\n",
}


def test_layouts(spark):
    s = _syms(spark, LAYOUTS)
    assert {p: list(_kinds(s, p)) for p in LAYOUTS} == {
        "one.js": ["one", "two"], "indent.js": ["ind", "k"], "semi.js": ["a", "b"], "semi.py": ["x", "y", "f"],
        "open.js": ["f", "t", "u"], "tight.js": ["A", "B", "h", "default"], "types.ts": ["Q", "U", "M"],
        "deco.ts": ["C"], "cont.py": ["total", "z"]}
    sig = {n: r.sig for (_, n), r in s.items()}
    assert sig["two"] == "function two(y) {}" and sig["ind"] == "function ind(x) {}"
    assert s["semi.js", "a"].text == "const a = 1;" and s["semi.py", "y"].text == "y = ';'"
    assert s["open.js", "f"].sig == "function f(a) {}" and s["open.js", "t"].text == "const t =\n  5"
    assert s["semi.py", "f"].sig == "def f():\n    pass"
    assert sig["A"] == "class A{\na(){}b=1\n}" and sig["B"] == "class B extends A{\n}"
    assert sig["Q"] == "abstract class Q<T extends {a: number}> {\n  go(): void {}\n}"
    assert sig["M"] == "class M extends mix({x: 1}) implements I {\n m() {} \n}"
    assert sig["U"] == "type U =\n| 'a'\n| 'b';"
    assert sig["C"] == "@Part({\n  at: 'x',\n})\n@Other\nclass C {\n  m() {}\n}"
    assert (s["deco.ts", "C"].start_line, s["deco.ts", "C"].decl_line) == (0, 4)
    assert s["cont.py", "total"].text == "total = 1 + \\\n2"
    assert _imps(spark, LAYOUTS) == [("one.js", "a", "default", "./a"), ("semi.py", "os", "os", "os"),
                                     ("semi.py", "sys", "sys", "sys")]


def test_brackets_of_depth_50(spark):
    group, block = "(" * 50 + "1" + ")" * 50, "{ if (a) " * 50 + "{}" + " }" * 50
    files = {"a.py": f"def f(a={group}):\n    return a\n\nb = 1\n",
             "b.js": f"class M {{\n  run(a) {block}\n\n  next() {{ return 1; }}\n}}\n"
                     f"function g(x = {group}) {{ return x; }}\nlet p = {group}, q = [{group}], r;\n"}
    s = _syms(spark, files)
    assert s["a.py", "f"].sig == f"def f(a={group}):\n    pass"
    assert s["b.js", "M"].sig == "class M {\n  run(a) {}\n  next() {}\n}"
    assert s["b.js", "g"].sig == f"function g(x = {group}) {{}}"
    assert {n for (_, n) in s} == {"f", "b", "M", "g", "p", "q", "r"}


def test_byte_spans(spark):
    files = {"a.py": "# größe ☃\nx = 'é'; y = 2\n\n@dec\ndef café():\n    return '☃'\n",
             "b.ts": "const ü = 'ü';\nexport function número(a) { return '€'; }\nexport const z = 1;\n", "c.js": ""}
    rows = _syms(spark, files)
    assert len(rows) == 6
    for (path, _), r in rows.items():
        assert files[path].encode()[r.start_byte:r.end_byte].decode() == r.text


def test_many_statements_cross_the_blocks_of_the_running_sums(spark):
    for n in (63, 64, 65, 129, 4097):
        s = _syms(spark, {"a.js": "".join(f"const v{i} = [{i}];\n" for i in range(n))})
        assert all(s["a.js", f"v{i}"].start_line == i and s["a.js", f"v{i}"].text == f"const v{i} = [{i}];"
                   for i in range(n)) and len(s) == n

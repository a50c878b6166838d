"""Code corpora as tables ``files(path, language, text)``.

Two sources:

* ``scan_source_tree`` — a real tree on any Hadoop filesystem through the
  ``binaryFile`` source (S1/S2), decoded lossily (X15).
* ``corpus_from_documents`` — the deterministic test corpus derived from the
  ``documents`` table: every document becomes one Python / JavaScript /
  TypeScript module that carries the **whole** document text as comments,
  so file sizes follow the data.  Import neighbours come from ``doc_id``
  arithmetic (no window, no join), so the projection is narrow and scales
  with the table.

The file text is one SQL expression (``content_sql``) that both Spark and
DuckDB evaluate identically; the oracle builds the same corpus with it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slimctx.functions.paths import language_of, SUPPORTED_EXTS, extension_of
from slimctx.functions.text import lossy_utf8

# ---------------------------------------------------------------- templates
# SQL snippets valid in both Spark SQL and DuckDB.  Backslashes are avoided
# on purpose (the two parsers treat them differently); specifiers inside
# the generated code use double quotes so SQL literals need no escaping.

NL = "chr(10)"


def _s(x: str) -> str:
    return f"CAST({x} AS STRING)"


D = "doc_id"
A = "((2 * doc_id + 1) % n_docs)"
B = "((3 * doc_id + 2) % n_docs)"
C = "((5 * doc_id + 3) % n_docs)"
H = "(doc_id % 5)"          # hub: five modules everyone imports from
PKG = "(doc_id % 9 = 0)"    # package / index layout


def _dir(x: str) -> str:
    return f"'p' || {_s(f'({x}) % 7')}"


def _line(expr: str) -> str:
    return f"{expr} || {NL}"


def _cat(parts: list[str]) -> str:
    return "(" + "\n || ".join(parts) + ")"


def _folded(dialect: str) -> str:
    pat = f"'[^ -~' || {NL} || ']'"
    if dialect == "duckdb":
        return f"regexp_replace(coalesce(text, ''), {pat}, '?', 'g')"
    return f"regexp_replace(coalesce(text, ''), {pat}, '?')"


def _comment(dialect: str, prefix: str) -> str:
    return f"'{prefix}' || replace({_folded(dialect)}, {NL}, {NL} || '{prefix}')"


PY_REL = f"CASE WHEN {PKG} THEN '...' ELSE '..' END"
JS_REL = f"CASE WHEN {PKG} THEN '../../' ELSE '../' END"


def _py_mod(x: str) -> str:
    return f"{PY_REL} || {_dir(x)} || '.m' || {_s(x)}"


def _js_mod(x: str) -> str:
    return f"{JS_REL} || {_dir(x)} || '/m' || {_s(x)}"


# A template is a list of statements.  A statement knows its lines and, by
# construction, the symbols and imports they hold: the oracle takes its
# expectations from here and never parses a file.

class Sym(NamedTuple):
    name: str                        # SQL
    kind: str
    exported: bool = True
    sig: list[str] | None = None     # SQL of the signature's lines; None: no body, kept whole


class Stmt(NamedTuple):
    lines: list[str]                 # SQL of each line; COMMENT stands for the document as comment
    when: str | None = None          # SQL condition
    symbols: tuple[Sym, ...] = ()
    imports: tuple[tuple[str, str, str], ...] = ()    # SQL of local name, export name, specifier
    skip: int = 0                    # lines of decorators
    export: bool = False             # 'export ' stands in front, outside of the symbol's text
    indent: str = ""                 # blanks in front of the first line in the file
    end: str | None = None           # what follows on the same line; None: a line break


COMMENT = "COMMENT"
BLANK = Stmt(["''"])
DEEP = "(" * 30 + "1" + ")" * 30
DEEP_BLOCK = "{ if (a) " * 30 + "{}" + " }" * 30


def _n(prefix: str, x: str = D) -> str:
    """The SQL of a name such as f_17."""
    return f"'{prefix}' || {_s(x)}"


def _code(*parts: str) -> str:
    """SQL of a line; a part in {braces} is SQL, all else is text."""
    return " || ".join(p[1:-1] if p.startswith("{") and p.endswith("}") else f"'{p}'" for p in parts)


def _d(name: str, x: str = D) -> str:
    return "{" + _n(name, x) + "}"


def _spec(sql: str) -> str:
    return "{" + sql + "}"


PY_ONE = f"{D} % 13 = 0"


def python_template() -> list[Stmt]:
    a, b, h, c = map(_py_mod, (A, B, H, C))
    again = f"{PY_REL} || '.src.' || {_dir(A)} || '.m' || {_s(A)}"
    missing = _n(".missing_")
    return [
        Stmt(["'\"\"\"Module docstring ( with code'", "'class Fake:'", "'def fake(): pass'", "'Usage = 1'",
              "'\"\"\"'"], f"{D} % 4 = 0"),
        Stmt([_code("from ", _spec(a), " import ", _d("f_", A))], None, (), ((_n("f_", A), _n("f_", A), a),)),
        Stmt([_code("from ", _spec(b), " import ", _d("f_", B), ", ", _d("g_", B), " as gg")], None, (),
             ((_n("f_", B), _n("f_", B), b), ("'gg'", _n("g_", B), b))),
        Stmt([_code("from ", _spec(h), " import ", _d("V_", H))], None, (), ((_n("V_", H), _n("V_", H), h),)),
        Stmt(["'import os'"], None, (), (("'os'", "'os'", "'os'"),)),
        Stmt([_code("from ", _spec(missing), " import nothing")], f"{D} % 10 = 0", (),
             (("'nothing'", "'nothing'", missing),)),
        Stmt(["'from requests import get'"], f"{D} % 11 = 0", (), (("'get'", "'get'", "'requests'"),)),
        Stmt([_code("from ", _spec(again), " import ", _d("f_", A), " as fa2")], PY_ONE, (),
             (("'fa2'", _n("f_", A), again),)),
        Stmt([_code("from ", _spec(c), " import *")], f"{D} % 17 = 0", (), (("'*'", "'*'", c),)),
        BLANK, BLANK,
        Stmt([_code("def ", _d("f_"), "(x):"), COMMENT,
              _code("    return ", _d("f_", A), "(x) + 1") + f" || CASE WHEN {PY_ONE} THEN ' + fa2(x)' ELSE '' END"],
             None, (Sym(_n("f_"), "function", True, [_code("def ", _d("f_"), "(x):"), "'    pass'"]),)),
        BLANK, BLANK,
        Stmt(["'@dec'", _code("def ", _d("g_"), "(y):"), _code("    return ", _d("f_", B), "(y) + gg(y)")], None,
             (Sym(_n("g_"), "function", True, ["'@dec'", _code("def ", _d("g_"), "(y):"), "'    pass'"]),), (), 1),
        BLANK,
        Stmt([_code("def ", _d("one_"), "(a, b=(1, 2)): return ", _d("f_", A), "(a)")], f"{D} % 5 = 1",
             (Sym(_n("one_"), "function", True, [_code("def ", _d("one_"), "(a, b=(1, 2)):"), "'    pass'"]),)),
        Stmt([_code("def ", _d("wide_"), "("), "'    a,'", "'    b=\"): no\",'", "'):'", "'    return a'"],
             f"{D} % 5 = 2",
             (Sym(_n("wide_"), "function", True,
                  [_code("def ", _d("wide_"), "("), "'    a,'", "'    b=\"): no\",'", "'):'", "'    pass'"]),)),
        Stmt([_code(_d("SQL_"), " = \"\"\""), "'SELECT x'", "'def not_code():'", "'\"\"\"'"], f"{D} % 5 = 3",
             (Sym(_n("SQL_"), "variable"),)),
        Stmt(["'if os: w = 1'"], f"{D} % 5 = 4"), Stmt(["'else: w = 2'"], f"{D} % 5 = 4"),
        BLANK,
        Stmt([_code("class ", _d("C_"), ":"), "'    def run(self):'", _code("        return ", _d("V_", H))],
             f"{D} % 3 <> 0", (Sym(_n("C_"), "class", True, [_code("class ", _d("C_"), ":"), "'    pass'"]),)),
        Stmt(["'@register('", "'    1,'", "')'", _code("class ", _d("C_"), "(object):"), "'    def run(self):'",
              _code("        return ", _d("V_", H))], f"{D} % 3 = 0",
             (Sym(_n("C_"), "class", True, ["'@register('", "'    1,'", "')'",
                                            _code("class ", _d("C_"), "(object):"), "'    pass'"]),), (), 3),
        BLANK, BLANK,
        Stmt([_code(_d("V_"), " = 7")], None, (Sym(_n("V_"), "variable"),)),
        # several statements on a line, brackets of any depth
        Stmt([_code(_d("P_"), " = \"a;b\"")], f"{D} % 6 = 0", (Sym(_n("P_"), "variable"),), end="; "),
        Stmt([_code(_d("R_"), ": int = [2]")], f"{D} % 6 = 0", (Sym(_n("R_"), "variable"),)),
        Stmt([_code("def ", _d("far_"), f"(a={DEEP}):"), "'    b = a; return b'"], f"{D} % 6 = 1",
             (Sym(_n("far_"), "function", True, [_code("def ", _d("far_"), f"(a={DEEP}):"), "'    pass'"]),)),
    ]


def javascript_template() -> list[Stmt]:
    a, b, c, h = map(_js_mod, (A, B, C, H))
    missing, again = _n("./missing_"), f"'./' || {_js_mod(B)}"
    inside = [_code("class ", _d("Box"), " {"), "'  #seen = 0;'"]
    methods = ["'  constructor(v) {'", "'    this.v = { v };'", "'  }'", "'  // between { methods'",
               "'  async get('", "'    k,'", "'    { deep = \"}\" } = {},'", "'  ) {'",
               _code("    if (k) { return ", _d("fn_", C), "(this.v); }"), "'  }'",
               "'  static of() { return 1; }'"]
    emptied = ["'  constructor(v) {}'", "'  // between { methods'", "'  async get('", "'    k,'",
               "'    { deep = \"}\" } = {},'", "'  ) {}'", "'  static of() {}'"]
    return [
        Stmt([_code("import ", _d("Def", A), " from \"", _spec(a), "\";")], None, (),
             ((_n("Def", A), "'default'", a),)),
        Stmt([_code("import { ", _d("fn_", B), ", ", _d("util_", B), " as ", _d("u", B), " } from \"", _spec(b), "\";")],
             None, (), ((_n("fn_", B), _n("fn_", B), b), (_n("u", B), _n("util_", B), b))),
        Stmt([_code("import * as hub from \"", _spec(h), "\";")], None, (), (("'hub'", "'*'", h),)),
        Stmt([_code("const { ", _d("fn_", C), " } = require(\"", _spec(c), "\"), path = require(\"path\");")], None,
             (Sym("'path'", "variable", False),),
             ((_n("fn_", C), _n("fn_", C), c), ("'path'", "'default'", "'path'"))),
        Stmt([_code("import { nope } from \"", _spec(missing), "\";")], f"{D} % 10 = 0", (),
             (("'nope'", "'nope'", missing),)),
        Stmt(["'import React from \"react\";'"], f"{D} % 11 = 0", (), (("'React'", "'default'", "'react'"),)),
        Stmt([_code("import { ", _d("fn_", B), " as again } from \"", _spec(again), "\";")], PY_ONE, (),
             (("'again'", _n("fn_", B), again),)),
        Stmt(["'import \"./styles.css\";'"], f"{D} % 17 = 0"),
        BLANK,
        Stmt([_code("function ", _d("fn_"), "(x) {"), COMMENT,
              _code("  return ", _d("fn_", B), "(x) + ", _d("u", B), "(x) + ", _d("fn_", C), "(x)")
              + f" || CASE WHEN {PY_ONE} THEN ' + again(x)' ELSE '' END || ';'", "'}'"], None,
             (Sym(_n("fn_"), "function", True, [_code("function ", _d("fn_"), "(x) {}")]),), (), 0, True),
        BLANK,
        Stmt([_code("const ", _d("util_"), " = (y) => {"), _code("  return ", _d("Def", A), "(y) + hub.V;"), "'};'"],
             None, (Sym(_n("util_"), "function", True, [_code("const ", _d("util_"), " = (y) => {};")]),), (), 0, True),
        BLANK,
        Stmt([_code("function ", _d("Card"), "({"), "'  title,'", "'  rows = [1, 2],'", "'}) {'",
              _code("  return ", _d("fn_", B), "(title);"), "'}'"], f"{D} % 4 = 1",
             (Sym(_n("Card"), "function", True,
                  [_code("function ", _d("Card"), "({"), "'  title,'", "'  rows = [1, 2],'", "'}) {}'"]),), (), 0, True),
        Stmt([_code("const ", _d("Row"), " = ({"), "'  cell,'", "'}) => {'", "'  return `$' || '{cell} }'",
              "'function phantom() {`;'", "'};'"], f"{D} % 4 = 2",
             (Sym(_n("Row"), "function", False, [_code("const ", _d("Row"), " = ({"), "'  cell,'", "'}) => {};'"]),)),
        Stmt([_code("function ", _d("flat"), "(q) { return hub.V + q; }")], f"{D} % 4 = 3",
             (Sym(_n("flat"), "function", False, [_code("function ", _d("flat"), "(q) {}")]),)),
        Stmt([_code("let ", _d("one"), " = 1, ", _d("two"), " = [2, 3], ", _d("sum"), " = (p, q) => p + q;")],
             f"{D} % 4 = 0",
             (Sym(_n("one"), "variable", False), Sym(_n("two"), "variable", False), Sym(_n("sum"), "variable", False))),
        Stmt(["'/* function hidden() {'", "'*/'"]),
        BLANK,
        Stmt(inside + methods + ["'}'"], None, (Sym(_n("Box"), "class", False, inside + emptied + ["'}'"]),)),
        BLANK,
        Stmt([_code("export { ", _d("Box"), " as ", _d("Crate"), " };")], None, (Sym(_n("Crate"), "variable"),)),
        BLANK,
        Stmt(["'export default function (z) {'", "'  return z;'", "'}'"], None,
             (Sym("'default'", "function", True, ["'export default function (z) {}'"]),)),
        BLANK,
        # several statements on a line, indented ones, brackets of any depth
        Stmt([_code("let ", _d("left"), " = 1;")], f"{D} % 6 = 0", (Sym(_n("left"), "variable", False),), end=" "),
        Stmt([_code("let ", _d("right"), " = { a: [2] };")], f"{D} % 6 = 0", (Sym(_n("right"), "variable", False),),
             end=""),
        Stmt([_code("function ", _d("tight"), "(x) { return x; }")], f"{D} % 6 = 0",
             (Sym(_n("tight"), "function", False, [_code("function ", _d("tight"), "(x) {}")]),), end=""),
        Stmt([_code("class ", _d("Tiny"), " { m() { return {}; } }")], f"{D} % 6 = 0",
             (Sym(_n("Tiny"), "class", False, [_code("class ", _d("Tiny"), " {"), "' m() {} '", "'}'"]),)),
        Stmt([_code("function ", _d("inner"), "(x) {"), "'      return x;'", "'    }'"], f"{D} % 6 = 1",
             (Sym(_n("inner"), "function", False, [_code("function ", _d("inner"), "(x) {}")]),), indent="    "),
        Stmt([_code("function ", _d("brace"), f"(a = {DEEP})"), "'{'", "'  return a;'", "'}'"], f"{D} % 6 = 2",
             (Sym(_n("brace"), "function", False, [_code("function ", _d("brace"), f"(a = {DEEP}) {{}}")]),)),
        Stmt([_code("class ", _d("Deep"), " {"), f"'  run(a) {DEEP_BLOCK}'", "''", "'  next() { return 1; }'", "'}'"],
             f"{D} % 6 = 3", (Sym(_n("Deep"), "class", False, [_code("class ", _d("Deep"), " {"), "'  run(a) {}'",
                                                               "'  next() {}'", "'}'"]),)),
        Stmt([_code("module.exports = { ", _d("fn_"), ", ", _d("util_"), " };")], None,
             (Sym("'module.exports'", "variable"),)),
    ]


def typescript_template() -> list[Stmt]:
    a, b = map(_js_mod, (A, B))
    missing, again = _n("./missing_"), f"'./' || {_js_mod(A)}"
    fn, util = _code("function ", _d("fn_"), "(x: number): number {"), _code("const ", _d("util_"), " = (y: number): number => {")
    wide = [_code("function ", _d("Panel"), "("), _code("  shape: ", _d("Shape", A), ","), "'  at: { x: number },'"]
    return [
        Stmt([_code("import { ", _d("fn_", A), ", type ", _d("Shape", A), " } from \"", _spec(a), "\";")], None, (),
             ((_n("fn_", A), _n("fn_", A), a), (_n("Shape", A), _n("Shape", A), a))),
        Stmt([_code("import ", _d("Def", B), " from \"", _spec(b), "\";")], None, (), ((_n("Def", B), "'default'", b),)),
        Stmt([_code("import { nope } from \"", _spec(missing), "\";")], f"{D} % 10 = 0", (),
             (("'nope'", "'nope'", missing),)),
        Stmt(["'import * as lodash from \"lodash\";'"], f"{D} % 11 = 0", (), (("'lodash'", "'*'", "'lodash'"),)),
        Stmt([_code("import { ", _d("fn_", A), " as again } from \"", _spec(again), "\";")], PY_ONE, (),
             (("'again'", _n("fn_", A), again),)),
        BLANK,
        Stmt([_code("interface ", _d("Shape"), " {"), "'  id: number;'", "'  label: string;'", "'}'"], None,
             (Sym(_n("Shape"), "interface"),), (), 0, True),
        BLANK,
        Stmt([_code("type ", _d("Id"), " = number | string;")], None, (Sym(_n("Id"), "type"),), (), 0, True),
        BLANK,
        Stmt([_code("enum ", _d("Mode"), " {"), "'  On,'", "'  Off,'", "'}'"], None, (Sym(_n("Mode"), "type"),), (), 0, True),
        BLANK,
        Stmt([_code("declare function ", _d("ext"), "(x: number): number;")], None, (Sym(_n("ext"), "function"),)),
        BLANK,
        Stmt([fn, COMMENT, _code("  return ", _d("fn_", A), "(x) + ", _d("ext"), "(x)")
              + f" || CASE WHEN {PY_ONE} THEN ' + again(x)' ELSE '' END || ';'", "'}'"], None,
             (Sym(_n("fn_"), "function", True, [fn + " || '}'"]),), (), 0, True),
        BLANK,
        Stmt([util, _code("  return ", _d("Def", B), "(y);"), "'};'"], None,
             (Sym(_n("util_"), "function", True, [util + " || '};'"]),), (), 0, True),
        BLANK,
        Stmt([*wide, "'): { id: number } {'", "'  return { id: at.x };'", "'}'"], f"{D} % 3 = 1",
             (Sym(_n("Panel"), "function", True, [*wide, "'): { id: number } {}'"]),), (), 0, True),
        Stmt([_code("function ", _d("helper"), "(s: ", _d("Shape", A), "): number {"), "'  return s.id;'", "'}'"], None,
             (Sym(_n("helper"), "function", False, [_code("function ", _d("helper"), "(s: ", _d("Shape", A), "): number {}")]),)),
        BLANK,
        # header with braces, a type over several lines
        Stmt([_code("abstract class ", _d("Queue"), "<T extends {a: number}> {"), "'  go(): void { this.x = {}; }'", "'}'"],
             f"{D} % 4 < 2", (Sym(_n("Queue"), "class", True,
                                  [_code("abstract class ", _d("Queue"), "<T extends {a: number}> {"),
                                   "'  go(): void {}'", "'}'"]),), (), 0, True),
        Stmt([_code("type ", _d("Side"), " ="), "'| \"port\"'", "'| \"bow\";'"], f"{D} % 4 > 1",
             (Sym(_n("Side"), "type", False),)),
        BLANK,
        Stmt(["'export default function (z: number): number {'", "'  return z;'", "'}'"], None,
             (Sym("'default'", "function", True, ["'export default function (z: number): number {}'"]),)),
    ]


#: (SQL condition on lang, comment prefix, template)
TEMPLATES = (
    ("lang = 'en'", "    # ", python_template()),
    ("lang IN ('de', 'es')", "  // ", typescript_template()),
    ("coalesce(lang, '') NOT IN ('en', 'de', 'es')", "  // ", javascript_template()),
)


def statement_lines(st: Stmt, dialect: str, prefix: str, in_file: bool = True) -> list[str]:
    """SQL of the lines, as they are in the file or in the symbol's text."""
    lines = [_comment(dialect, prefix) if x == COMMENT else x for x in st.lines]
    if st.export and in_file:
        lines[st.skip] = f"'export ' || {lines[st.skip]}"
    if st.indent and in_file:
        lines[0] = f"'{st.indent}' || {lines[0]}"
    return lines


def _template_sql(template: list[Stmt], dialect: str, prefix: str) -> str:
    parts = []
    for st in template:
        lines = statement_lines(st, dialect, prefix)
        last = _line(lines[-1]) if st.end is None else f"({lines[-1]}) || '{st.end}'"
        text = " || ".join([*map(_line, lines[:-1]), last])
        parts.append(f"CASE WHEN {st.when} THEN {text} ELSE '' END" if st.when else text)
    return _cat(parts)


def path_sql() -> str:
    """Path of the module made from one document."""
    base = f"'src/' || {_dir(D)} || '/m' || {_s(D)}"
    ext = "CASE lang WHEN 'en' THEN '.py' WHEN 'de' THEN '.ts' WHEN 'es' THEN '.tsx' ELSE '.js' END"
    init = "CASE lang WHEN 'en' THEN '/__init__.py' WHEN 'de' THEN '/index.ts' " \
           "WHEN 'es' THEN '/index.tsx' ELSE '/index.js' END"
    return f"{base} || CASE WHEN {PKG} THEN {init} ELSE {ext} END"


def content_sql(dialect: str = "spark") -> str:
    """Text of the module made from one document (needs columns doc_id,
    lang, text and n_docs = number of documents)."""
    cases = " ".join(f"WHEN {cond} THEN {_template_sql(template, dialect, prefix)}"
                     for cond, prefix, template in TEMPLATES)
    return f"CASE {cases} END"


def corpus_from_documents(documents: DataFrame) -> DataFrame:
    """``files(path, language, text)`` — one module per document."""
    docs = documents.select("doc_id", "lang", "text")
    # one distributed count; only the number reaches the driver.  As a
    # literal it folds into the template and lets filters on path/language
    # be pushed below the (expensive) text projection.
    n_docs = F.lit(documents.count()).cast("bigint")
    return (docs.select("doc_id", "lang", "text", n_docs.alias("n_docs"))
            .select(F.expr(path_sql()).alias("path"), F.expr(content_sql("spark")).alias("text"))
            .select("path", language_of(F.col("path")).alias("language"), "text"))


def load_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slimctx.sources.tables import table
    return corpus_from_documents(table(spark, sf_dir, "documents"))


def scan_source_tree(spark: SparkSession, root: str, include_assets: bool = False) -> DataFrame:
    """Scan a source tree (any Hadoop path) into ``files(path, language,
    text, raw_bytes)``.  Paths are made relative to ``root``.  Unsupported
    extensions are left out unless ``include_assets`` (then, like the
    reference, they are read as JavaScript)."""
    reader = (spark.read.format("binaryFile")
              .option("recursiveFileLookup", "true")
              .option("ignoreCorruptFiles", "true"))
    if not include_assets:
        reader = reader.option("pathGlobFilter", "*.{py,js,jsx,mjs,ts,tsx}")
    raw = reader.load(root).select("path", "content")
    # the source reports full URIs, whatever form the root was given in
    bare = lambda c: F.regexp_replace(c, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    prefix = bare(F.lit(root.rstrip("/") + "/"))
    path = bare(F.col("path"))
    outside = F.raise_error(F.concat(F.lit("not below the root: "), F.col("path")))
    rel = F.when(path.startswith(prefix), path.substr(F.length(prefix) + 1, F.length(path))) \
        .otherwise(outside.cast("string"))
    out = raw.select(rel.alias("path"), lossy_utf8(F.col("content")).alias("text"),
                     F.octet_length("content").alias("raw_bytes"))
    if not include_assets:
        out = out.where(extension_of(F.col("path")).isin(*SUPPORTED_EXTS))
    return out.select("path", language_of(F.col("path")).alias("language"), "text", "raw_bytes")


"""Per-file extraction of symbols and imports.

The text of a file is cut into lexemes by one regular expression; strings and
comments are masked character by character.  ``flatten`` then follows the
bracket depth over the masked text and fills what lies inside of any bracket,
however deep, so in the flat text every bracketed group is ``(...)`` with
fill between: its partner is the next closing bracket, and a line break or
semicolon that is left stands at depth 0.  Masked and flat text have the
length of the original.  Statements are cut on the flat text: at semicolons,
after a closing brace that a declaration follows, and at line breaks.
Decorators belong to the statement that follows.  Headers and bodies are
found on the flat statement and cut out of the original at the same positions.

All of it runs inside one row per file with higher-order array functions, so
extraction is a narrow, shuffle-free projection and the file text is never
exploded into many rows; only the slim result arrays are exploded afterwards.
Every intermediate value is bound by ``let``, so it is computed once and the
work is linear in the size of the file (running sums go by blocks).

Columns of ``parse_files``' result:
  path, language,
  symbols ARRAY<STRUCT<name, kind, start_line, decl_line, end_line, start_byte, end_byte,
                       is_exported, has_body, text, sig, used, ord>>,
  imports ARRAY<STRUCT<line, local_name, export_name, specifier, stmt>>

``text`` is the symbol's source (entry form), ``sig`` its signature form
(dependency form), ``used`` the import-local names its text mentions.
``start_byte`` and ``end_byte`` span ``text`` in the file's UTF-8 bytes; with
decorators before an export they span both and the word between them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slimctx.functions.bind import let, record
from slimctx.functions.text import IDENT_RE, rstrip_ws, split_names

#: Names in headers and imports: letters of every script.
PY_NAME = r"[\p{L}\p{Nl}_][\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}]*"
NAME = r"[\p{L}\p{Nl}_$][\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}$]*"
STRING, COMMENT = "\x01", "\x02"     # in masked text
FILL, JOIN, CUT = "\x04", "\x05", "\x06"     # in flat text: inside of brackets, joined lines, new statement

# Possessive quantifiers throughout: linear, and no recursion on long texts.
_DQ = r'"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"?'
_SQ = r"'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'?"
_TEMPLATE = r"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`?"
_REGEX = (r"(?<=[=(,:\[!&|?{};]|[=(,:\[!&|?{};]\s|return\s)/(?![/*])[^/\\\n\[]*+"
          r"(?:(?:\\.|\[[^\]\\\n]*+(?:\\.[^\]\\\n]*+)*+\])[^/\\\n\[]*+)*+/")
PY_LEX = "|".join([r'"""[\s\S]*?(?:"""|\z)', r"'''[\s\S]*?(?:'''|\z)", _DQ, _SQ, r"#[^\n]*+",
                   r"""[^"'#]++"""])
_JS_OPAQUE = [r"/\*[\s\S]*?(?:\*/|\z)", r"//[^\n]*+", _TEMPLATE, _DQ, _SQ, _REGEX]
JS_LEX = "|".join([*_JS_OPAQUE, r"""[^"'`/]++""", "/"])


# in flat text
PAREN, BRACE = r"\(\x04*+\)", r"\{\x04*+\}"
_GENERIC = rf"(?:<(?:[^()]|{PAREN})*?>\s*)?"
_RETURNS = rf"(?::\s*(?:{BRACE}(?:\[\])?|(?:[^{{}};]|{BRACE}(?=\s*[>|&,\[\]]))+?))?"
_VAR = rf"^(?:const|let|var)\s+{NAME}\s*(?::(?:[^=]|=>)*?)?=(?!>)\s*"
JS_FUNCTION = (rf"^(?:default\s+)?(?:async\s+)?function\b\s*\*?\s*(?:{NAME})?\s*{_GENERIC}{PAREN}"
               rf"\s*{_RETURNS}\s*\{{")
JS_ARROW = (rf"{_VAR}(?:async\s+)?(?:{_GENERIC}{PAREN}\s*(?::(?:[^={{}};]|\{{[^{{}}]*\}})*)?|{NAME}\s*)"
            r"\s*=>")
JS_FUNCTION_VALUE = rf"{_VAR}(?:async\s+)?function\b\s*\*?\s*(?:{NAME})?\s*{_GENERIC}{PAREN}\s*{_RETURNS}\s*\{{"
# the body of a class is the group that ends the statement
JS_CLASS = (rf"^(?:default\s+)?(?:abstract\s+)?class\b(?:[^{{}}]++|{BRACE}(?![;\s\x02]*+\z))*+"
            rf"\{{(?=\x04*+\}}[;\s\x02]*+\z)")
PY_HEADER = (rf"^(?:(?:async\s+)?def\s+{PY_NAME}\s*(?:\[[^\]]*\]\s*)?{PAREN}\s*(?:->[^:]*)?"
             rf"|class\s+{PY_NAME}\s*(?:\[[^\]]*\]\s*)?(?:{PAREN})?\s*):")
# Words that can stand before a colon without naming a variable.
PY_WORDS = ("else", "try", "finally", "except", "lambda", "if", "elif", "while", "for", "with",
            "return", "match", "case")


def _ws_collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", " ")


def _len(c: Column) -> Column:
    return F.length(c)


def _from(c: Column, start: Column) -> Column:
    """The text after ``start`` characters."""
    return F.substring(c, start + 1, F.lit(1 << 30))


def _first(c: Column, n: Column) -> Column:
    return F.substring(c, F.lit(1), n)


# ------------------------------------------------------------------ units

def _masked(text: Column, py: bool) -> Column:
    def mask(x: Column) -> Column:
        hide = lambda mark: F.repeat(F.lit(mark), _len(x))
        if py:
            return (F.when(x.startswith("#"), hide(COMMENT))
                    .when(x.startswith('"') | x.startswith("'"), hide(STRING)).otherwise(x))
        return (F.when(x.startswith("//") | x.startswith("/*"), hide(COMMENT))
                .when(x.startswith('"') | x.startswith("'") | x.startswith("`")
                      | (x.startswith("/") & (F.length(x) > 1)), hide(STRING)).otherwise(x))

    return F.array_join(F.transform(
        F.regexp_extract_all(text, F.lit(PY_LEX if py else JS_LEX), 0), mask), "")


#: Running sums go by blocks of this size: no array grows element by element
#: over a whole file.
SHIFT = 6
SPAN = 1 << SHIFT


def _blocks(steps: Column) -> Column:
    def of(all_: Column) -> Column:      # bound: else the steps are computed again for every block
        last = F.shiftright(F.greatest(F.size(all_) - 1, F.lit(0)), SHIFT)
        return F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(all_, c * SPAN + 1, SPAN))

    return let(steps, of)


def _running(steps: Column, body: Callable[[Callable], Column]) -> Column:
    """``body`` of a function i -> the sum of the first i steps (0 <= i <=
    size), where a sum never falls below 0.

    Over a block the sum x becomes max(x + s, t), so blocks are summed up
    first and each one starts from what lies before it."""
    def effect(block: Column) -> Column:
        return F.aggregate(block, record(s=F.lit(0), t=F.lit(0)), lambda acc, d: record(
            s=acc["s"] + d, t=F.greatest(acc["t"] + d, F.lit(0))))

    def starts(effects: Column) -> Column:
        return F.aggregate(effects, F.array(F.lit(0)), lambda acc, e: F.concat(
            acc, F.array(F.greatest(F.element_at(acc, -1) + e["s"], e["t"]))))

    def within(block: Column, start: Column) -> Column:
        return F.aggregate(block, F.array(start), lambda acc, d: F.concat(
            acc, F.array(F.greatest(F.element_at(acc, -1) + d, F.lit(0)))))

    def sums(blocks: Column) -> Column:
        return let(starts(F.transform(blocks, effect)), lambda st: F.transform(
            blocks, lambda block, c: within(block, F.get(st, c))))

    def read(all_: Column) -> Column:
        def at(i: Column) -> Column:
            c = F.least(F.shiftright(i, SHIFT), F.size(all_) - 1)
            return F.get(F.get(all_, c), i - c * SPAN)
        return body(at)

    return let(_blocks(steps), lambda blocks: let(sums(blocks), read))


def _cut(text: Column, lengths: Column) -> Column:
    """``text`` in pieces of the given lengths.  A substring is searched from
    the start of its text, so whole blocks of pieces are cut first."""
    def cut(t: Column, sizes: Column) -> Column:
        def of(at: Callable) -> Column:
            n = F.size(sizes)
            big = F.transform(_blocks(sizes), lambda b, c: F.substring(
                t, at(c * SPAN) + 1, at(F.least(c * SPAN + SPAN, n)) - at(c * SPAN)))

            def piece(bigs: Column) -> Column:
                def one(k: Column, i: Column) -> Column:
                    c = F.shiftright(i, SHIFT)
                    return F.substring(F.get(bigs, c), at(i) - at(c * SPAN) + 1, k)
                return F.transform(sizes, one)

            return let(big, piece)

        return _running(sizes, of)

    return let(text, lambda t: let(lengths, lambda sizes: cut(t, sizes)))


#: A statement may start in spite of open brackets (a lexeme misread) when a
#: blank line and one of these words announce it.
_RESTART = {True: r"(?:(?:def|class|async|from|import)\b|@)",
            False: r"(?:export|import|function|class|const|let|var|interface|type|enum|declare)\b"}
_CLOSE_ALL = -1_000_000


def flatten(mask: Column, restart: str = r"(?!)") -> Column:
    """The masked text with everything inside of brackets filled."""
    again = rf"\n[ \t\r]*+\n(?={restart})"
    tokens = F.regexp_extract_all(
        mask, F.lit(rf"{again}|[(\[{{]|[)\]}}]|(?:[^()\[\]{{}}\n]++|(?!{again})\n)++"), 0)
    opens = lambda t: t.isin("(", "[", "{")
    closes = lambda t: t.isin(")", "]", "}")
    resets = lambda t: t.startswith("\n") & t.endswith("\n") & t.rlike(r"\A\n[ \t\r]*+\n\z")

    def of(ts: Column) -> Column:
        # only blank lines before a restart word are tokens of their own
        found = let(F.size(ts), lambda n: F.transform(ts, lambda t, i: record(t=t, d=(
            F.when(opens(t), 1).when(closes(t), -1)
            .when(resets(t) & F.coalesce(F.get(ts, i + 1), F.lit("")).rlike(rf"\A{restart}"), _CLOSE_ALL)
            .otherwise(0)))))

        def fill(steps: Column, at: Callable) -> Column:
            hidden = lambda t, i: F.when(t["d"] == -1, at(i + 1) > 0).otherwise(
                (t["d"] >= 0) & (at(i) > 0))
            return F.array_join(F.transform(steps, lambda t, i: F.when(
                hidden(t, i), F.repeat(F.lit(FILL), _len(t["t"]))).otherwise(t["t"])), "")

        return let(found, lambda steps: _running(
            F.transform(steps, lambda t: t["d"]), lambda at: fill(steps, at)))

    return let(tokens, of)


# Words that open a block statement, whose semicolons are its own.
_PY_BLOCKS = r"(?:async|def|class|if|elif|else|for|while|with|try|except|finally|match|case)\b"
#: What can only be the start of a declaration.
_JS_DECLARES = (rf"(?:export\b|import\b|(?:async\s+)?function\b|(?:abstract\s+)?class\s+{NAME}"
                rf"|(?:const|let|var)\s+(?:{NAME}|[{{\[])|interface\s+{NAME}|(?:const\s+)?enum\s+{NAME}"
                rf"|type\s+{NAME}\s*[<=]|declare\s|module\.exports\b)")


def _marked(flat: Column, py: bool) -> Column:
    """The flat text with a mark before each statement."""
    def apply(c: Column, *rules) -> Column:
        for pattern, by in rules:
            c = F.regexp_replace(c, pattern, by)
        return c

    if py:
        return apply(
            flat, (r"\\\r?\n", JOIN * 2),
            # a decorator and the line that follows
            (r"(?md)^(@[^\n]*+(?:\n[ \t\r]*+(?:\x02++\r?)?(?=\n))*+)\n", "$1" + JOIN),
            (rf"(?md)(?:^(?!{_PY_BLOCKS})(?=[^\s)\]}}\x01\x02@])|(?!^)\G)[^;\n]*+;[ \t]*+(?=[^\s\x02])",
             "$0" + CUT),
            (r"\n(?=[^\s)\]}\x01\x02\x05])", "\n" + CUT))
    goes_on = r"(?<!(?:=>|[=,+\-*%&|?:.<^!~])[ \t\r]{0,8}\n)"
    return apply(
        flat,
        (rf"(?md)^([ \t]*+@{NAME}(?:\.{NAME})*+(?:{PAREN})?[ \t\r\x02]*+)\n", "$1" + JOIN),
        (r";[ \t\r]*+\x02*+", "$0" + CUT),
        (rf"\}}(?=[ \t]*+{_JS_DECLARES})", "}" + CUT),
        (rf"\n{goes_on}(?=[^\s)\]}}\x01\x02\x06{{.,?:=&|+\-*%<^]|[ \t]++{_JS_DECLARES})", "\n" + CUT))


_DECORATORS = {True: r"^(?:@[^\x05]*+\x05[\s\x02]*+)++",
               False: rf"^(?:@{NAME}(?:\.{NAME})*+(?:{PAREN})?[\s\x02\x05]*+)++"}
_TAIL = {True: r"(?:\n(?:\x02[^\n]*+|[ \t\r]*+(?=\n|\z)))*+[;\s]*+\z",
         False: r"(?:\n[ \t]*+(?:\x02[\x02 \t\r]*+)?(?=\n|\z))*+\s*+\z"}


def _statements(mask: Column, py: bool) -> Column:
    """The flat text of each statement, with what stands before it."""
    return let(flatten(mask, _RESTART[py]), lambda flat: F.split(_marked(flat, py), CUT))


def _lines(c: Column) -> Column:
    return F.octet_length(c) - F.octet_length(F.replace(c, F.lit("\n"), F.lit("")))


def _placed(flats: Column, raws: Column, masks: Column) -> Column:
    """The statements with the lines and bytes that stand before them."""
    return _running(F.transform(raws, _lines), lambda line: _running(
        F.transform(raws, F.octet_length), lambda byte: F.transform(flats, lambda f, i: record(
            flat=f, raw=F.get(raws, i), mask=F.get(masks, i), line=line(i), byte=byte(i)))))


def _units(pieces: Column, py: bool) -> Column:
    """ARRAY<STRUCT<line, begin, byte, off, raw, m, mask, d>>: the statements
    with their text, its flat and its masked form, the offset of the
    declaration behind decorators, the lines and bytes before them, and the
    declaration with its fill squeezed, which tells what it is."""
    def unit(p: Column) -> Column:
        def of(lead: Column) -> Column:
            before = F.substring(p["raw"], F.lit(1), lead)
            body = F.regexp_replace(_from(p["flat"], lead), _TAIL[py], "")
            return let(body, lambda m: let(
                record(m=m, off=_len(F.regexp_extract(m, _DECORATORS[py], 0)),
                       raw=F.substring(p["raw"], lead + 1, _len(m)),
                       begin=p["line"] + _lines(before)),
                lambda u: record(
                    line=u["begin"] + _lines(_first(u["raw"], u["off"])), begin=u["begin"],
                    byte=p["byte"] + F.octet_length(before), off=u["off"], raw=u["raw"], m=u["m"],
                    mask=F.substring(p["mask"], lead + 1, _len(m)),
                    d=F.regexp_replace(_from(m, u["off"]), FILL + "++", FILL))))

        return let(_len(F.regexp_extract(p["flat"], r"^[\s\x02\x05]*+", 0)), of)

    return F.filter(F.transform(pieces, unit), lambda u: u["m"] != "")


# ---------------------------------------------------------------- imports

def _item(u, local, export, spec):
    return F.struct(u["line"].alias("line"), local.alias("local_name"), export.alias("export_name"),
                    spec.alias("specifier"), u["raw"].alias("stmt"))


def _none(u):
    return F.filter(F.array(_item(u, F.lit(""), F.lit(""), F.lit(""))), lambda s: F.lit(False))


_FROM = r"^from\s+(\.*)\s*([\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}.]*)\s+import\s+(.*)$"
_AS = r"\s+as\s+"


def _py_imports(u: Column) -> Column:
    def of(t: Column) -> Column:
        spec = F.concat(F.regexp_extract(t, _FROM, 1), F.regexp_extract(t, _FROM, 2))
        names = split_names(F.regexp_replace(F.regexp_extract(t, _FROM, 3), r"[()]", ""))

        def from_item(x):
            base = F.regexp_replace(x, rf"{_AS}.*$", "")
            aliased = x.rlike(_AS)
            local = F.when(aliased, F.regexp_extract(x, rf"{_AS}(\S+)$", 1)).otherwise(base)
            export = F.when(aliased, F.element_at(F.split(base, r"\."), -1)).otherwise(base)
            return _item(u, local, export, spec)

        def plain_item(x):
            base = F.regexp_replace(x, rf"{_AS}.*$", "")
            local = F.when(x.rlike(_AS), F.regexp_extract(x, rf"{_AS}(\S+)$", 1)).otherwise(base)
            return _item(u, local, base, base)

        plain = split_names(F.regexp_extract(t, r"^import\s+(.*)$", 1))
        return (F.when(t.rlike(r"^from\s"), F.transform(names, from_item))
                .when(t.rlike(r"^import\s"), F.transform(plain, plain_item))
                .otherwise(_none(u)))

    bare = F.trim(_ws_collapse(F.regexp_replace(u["raw"], r"#[^\n]*", "")))
    return F.when(u["d"].rlike(r"^(?:from|import)\s"), let(bare, of)).otherwise(_none(u))


_ES = r"""^import\s+(?:type\s+)?(.*?)\s*from\s*["'`]([^"'`]*)["'`]"""
_REQ = (r"""(?:^(?:const|let|var)\s|,)\s*(\{[^}]*\}|""" + NAME +
        r""")\s*=\s*require\(\s*["'`]([^"'`]*)["'`]\s*\)""")


def _js_imports(u: Column) -> Column:
    def es(t: Column) -> Column:
        clause, spec = F.regexp_extract(t, _ES, 1), F.regexp_extract(t, _ES, 2)
        default_name = F.regexp_extract(clause, rf"^({NAME})", 1)
        ns_name = F.regexp_extract(clause, rf"\*\s*as\s+({NAME})", 1)
        named = split_names(F.regexp_extract(clause, r"\{([^}]*)\}", 1))

        def named_item(x):
            x2 = F.regexp_replace(x, r"^type\s+", "")
            local = F.when(x2.rlike(_AS), F.regexp_extract(x2, rf"{_AS}({NAME})", 1)).otherwise(x2)
            return _item(u, local, F.regexp_replace(x2, rf"{_AS}.*$", ""), spec)

        items = F.concat(
            F.filter(F.array(_item(u, default_name, F.lit("default"), spec)),
                     lambda s: s["local_name"] != ""),
            F.transform(named, named_item),
            F.filter(F.array(_item(u, ns_name, F.lit("*"), spec)), lambda s: s["local_name"] != ""))
        return F.when(spec != "", items).otherwise(_none(u))

    def required(t: Column) -> Column:
        patterns = F.regexp_extract_all(t, F.lit(_REQ), 1)
        specs = F.regexp_extract_all(t, F.lit(_REQ), 2)

        def of(p: Column, spec: Column) -> Column:
            def pair_item(x):
                local = F.when(x.contains(":"), F.trim(F.regexp_extract(x, r":\s*(.*)$", 1))).otherwise(x)
                return _item(u, local, F.trim(F.regexp_replace(x, r":.*$", "")), spec)
            return (F.when(p.startswith("{"), F.transform(split_names(F.regexp_replace(p, r"[{}]", "")),
                                                          pair_item))
                    .otherwise(F.array(_item(u, p, F.lit("default"), spec))))

        return F.flatten(F.zip_with(patterns, specs, of))

    t = F.trim(_ws_collapse(u["raw"]))
    return (F.when(u["d"].rlike(r"^import\s"), let(t, es))
            .when(u["d"].rlike(r"^(?:const|let|var)\s") & u["d"].contains("require"), let(t, required))
            .otherwise(_none(u)))


# ---------------------------------------------------------------- symbols

def _sym(u, name, kind, exported, has_body, text, sig, used):
    return F.struct(name.alias("name"), kind.alias("kind"),
                    u["begin"].alias("start_line"), u["line"].alias("decl_line"),
                    (u["begin"] + _lines(text)).alias("end_line"),
                    (u["byte"] + F.when(u["off"] > 0, 0).otherwise(
                        F.octet_length(u["raw"]) - F.octet_length(text))).alias("start_byte"),
                    (u["byte"] + F.octet_length(u["raw"])).alias("end_byte"),
                    exported.alias("is_exported"), has_body.alias("has_body"),
                    text.alias("text"), sig.alias("sig"), used.alias("used"))


def _names(locals_: Column) -> Column:
    """The import-local names, and those of them that a text can mention."""
    return let(locals_, lambda ls: record(
        locals=ls, words=F.filter(ls, lambda n: n.rlike(r"\A[A-Za-z_$][A-Za-z0-9_$]*\z"))))


def _used(text: Column, names: Column) -> Column:
    """The import-local names that a text mentions.  An identifier lies within
    a line, so lines that hold none of the names are not read word by word."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.exists(names["words"], lambda w: x.contains(w)))
    return F.array_intersect(F.array_distinct(F.regexp_extract_all(
        F.array_join(lines, "\n"), F.lit(IDENT_RE), 1)), names["locals"])


def _py_symbols(u: Column, names: Column) -> Column:
    def of(d: Column) -> Column:
        fn = F.regexp_extract(d, rf"^(?:async\s+)?def\s+({PY_NAME})", 1)
        cl = F.regexp_extract(d, rf"^class\s+({PY_NAME})", 1)
        va = F.regexp_extract(d, rf"^({PY_NAME})\s*(?::[^=]*)?=(?:[^=]|$)", 1)
        named = record(fn=fn, cl=cl, va=F.when(va.isin(*PY_WORDS), "").otherwise(va),
                       head=F.when((fn != "") | (cl != ""), _len(F.regexp_extract(
                           _from(u["m"], u["off"]), PY_HEADER, 0))).otherwise(0))

        def symbol(n: Column) -> Column:
            kind = (F.when(n["fn"] != "", "function").when(n["cl"] != "", "class")
                    .when(n["va"] != "", "variable"))
            has_body = (n["fn"] != "") | (n["cl"] != "")
            sig = F.when(has_body & (n["head"] > 0),
                         F.concat(_first(u["raw"], u["off"] + n["head"]), F.lit("\n    pass"))) \
                .otherwise(u["raw"])
            one = _sym(u, F.concat(n["fn"], n["cl"], n["va"]), kind, F.lit(True), has_body, u["raw"], sig,
                       _used(u["raw"], names))
            return F.filter(F.array(one), lambda s: s["kind"].isNotNull())

        return let(named, symbol)

    return of(u["d"])


def _more_names(d: Column) -> Column:
    """The names a const/let/var statement declares after the first one."""
    bare = F.regexp_replace(d, r"<(?:[^<>=()]|<[^<>=()]*+>)*+>", "")
    parts = F.split(F.regexp_replace(bare, r"^(?:const|let|var)\s+", ""), ",")
    names = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
                        lambda p: F.regexp_extract(p, rf"^\s*({NAME})\s*(?::[^=]*)?(?:=(?!>)|;|\z)", 1))
    return F.filter(names, lambda n: n != "")


def _class_sig(text: Column, head: Column, mask: Column) -> Column:
    """A class with the blocks of its members emptied and its blank lines
    dropped.  ``mask`` is the masked text behind the ``head`` characters of
    the header, body brace included."""
    def of(inner: Column) -> Column:
        parts = F.regexp_extract_all(flatten(inner), F.lit(
            rf"{BRACE}|\n\s*+|(?:[^\n{{]++|(?!{BRACE})\{{)++"), 0)

        def shorten(ps: Column) -> Column:
            raws = _cut(F.substring(text, head + 1, _len(inner)), F.transform(ps, _len))
            return F.array_join(F.zip_with(ps, raws, lambda p, raw: (
                F.when(p.startswith("\n"), F.regexp_extract(raw, r"\n[^\n]*+\z", 0))
                .when(p.rlike(rf"\A{BRACE}\z"), "{}").otherwise(raw))), "")

        kept = F.regexp_replace(let(parts, shorten), r"\A[ \t\r]*+(?:\n|\z)|\n[ \t\r]*+\z", "")
        tail = _from(text, head + _len(inner) + 1)
        return let(kept, lambda k: F.concat(
            _first(text, head), F.lit("\n"),
            F.when(k == "", "").otherwise(F.concat(k, F.lit("\n"))), F.lit("}"), tail))

    return let(F.regexp_extract(mask, r"^([\s\S]*)\}[^}]*+\z", 1), of)


def _js_symbols(u: Column, names: Column, is_ts: Column) -> Column:
    def declared(d: Column) -> Column:
        """What the declaration ``d`` is; ``b`` and ``flat`` begin behind export."""
        exported, default = d.rlike(r"^export\s"), d.rlike(r"^export\s+default\s")
        clause = d.rlike(r"^export\s*\{")
        # an exported declaration's span is the inner declaration
        behind = _len(F.regexp_extract(d, r"^export\s+(?:default\s+)?", 0))
        cut = F.when(exported & ~default & ~clause, _len(F.regexp_extract(d, r"^export\s+", 0))).otherwise(0)
        return record(
            exported=exported, default=default, clause=clause, mexp=d.rlike(r"^module\.exports\s*="),
            b=_from(d, behind), flat=_from(u["m"], u["off"] + behind),
            text=F.concat(_first(u["raw"], u["off"]), _from(u["raw"], u["off"] + cut)))

    def named(a: Column) -> Column:
        b = a["b"]
        ts = lambda p: F.when(is_ts, F.regexp_extract(b, p, 1)).otherwise("")
        fn = F.regexp_extract(b, rf"^(?:async\s+)?function\b\s*\*?\s*({NAME})", 1)
        cls = F.regexp_extract(b, rf"^(?:abstract\s+)?class\s+({NAME})", 1)
        or_default = lambda n: F.when(n != "", n).when(a["default"], "default")
        is_fn, is_cls = b.rlike(r"^(?:async\s+)?function\b"), b.rlike(r"^(?:abstract\s+)?class\b")
        head = lambda cond, p: F.when(cond, F.regexp_extract(a["flat"], p, 0)).otherwise("")
        is_var = b.rlike(r"^(?:const|let|var)\s")
        return record(
            fn=F.when(is_fn, or_default(fn)), cls=F.when(is_cls, or_default(cls)),
            iface=ts(rf"^interface\s+({NAME})"), alias=ts(rf"^type\s+({NAME})"),
            enum=ts(rf"^(?:const\s+)?enum\s+({NAME})"), ext=ts(rf"^declare\s+function\s+({NAME})"),
            var=F.regexp_extract(b, rf"^(?:const|let|var)\s+({NAME})", 1),
            fn_head=head(is_fn, JS_FUNCTION), arrow=head(is_var, JS_ARROW),
            value_head=head(is_var, JS_FUNCTION_VALUE), cls_head=head(is_cls, JS_CLASS))

    def symbols(a: Column, n: Column) -> Column:
        enum_like = (n["alias"] != "") | (n["enum"] != "")
        is_var = (n["var"] != "") & (n["enum"] == "")
        calls = is_var & ((n["arrow"] != "") | (n["value_head"] != ""))
        kind = (F.when(a["mexp"], "variable").when(n["fn"].isNotNull(), "function")
                .when(n["cls"].isNotNull(), "class").when(n["iface"] != "", "interface")
                .when(enum_like, "type").when(n["ext"] != "", "function")
                .when(calls, "function").when(is_var, "variable"))
        name = (F.when(a["mexp"], "module.exports").when(n["fn"].isNotNull(), n["fn"])
                .when(n["cls"].isNotNull(), n["cls"]).when(n["iface"] != "", n["iface"])
                .when(n["alias"] != "", n["alias"]).when(n["enum"] != "", n["enum"])
                .when(n["ext"] != "", n["ext"]).when(is_var, n["var"]))
        is_fn = n["fn"].isNotNull() | (calls & (n["ext"] == ""))
        text = a["text"]
        # where the declaration b starts in the text: it is its last part
        at = _len(text) - _len(a["flat"])
        block = F.when(n["fn"].isNotNull(), n["fn_head"]).otherwise(n["value_head"])
        tail = F.regexp_extract(text, r"\}([^}\n]*)\z", 1)
        cut = lambda k: rstrip_ws(_first(text, at + k))
        fn_sig = (F.when(block != "", F.concat(cut(_len(block) - 1), F.lit(" {}"), tail))
                  .when(n["arrow"] != "", F.concat(
                      cut(_len(n["arrow"])), F.lit(" {}"),
                      F.when(_from(a["flat"], _len(n["arrow"])).rlike(r"^\s*\{"), tail)
                      .when(text.endswith(";"), ";").otherwise("")))
                  .otherwise(text))
        cls_sig = F.when(n["cls_head"] != "",
                         _class_sig(text, at + _len(n["cls_head"]),
                                    _from(u["mask"], _len(u["mask"]) - _len(a["flat"])
                                          + _len(n["cls_head"])))).otherwise(text)
        sig = F.when(is_fn, fn_sig).when(kind == "class", cls_sig).otherwise(text)
        exported = a["mexp"] | a["exported"] | (n["ext"] != "")
        used = _used(text, names)
        one = F.filter(F.array(_sym(u, name, kind, exported, is_fn | (kind == "class"), text, sig, used)),
                       lambda s: s["name"].isNotNull())
        plain = lambda x, ex: _sym(u, x, F.lit("variable"), ex, F.lit(False), text, text, used)
        declares = a["b"].rlike(r"^(?:const|let|var)\s") & (n["enum"] == "")
        more = F.when(declares, F.transform(_more_names(a["b"]), lambda x: plain(x, exported))) \
            .otherwise(F.filter(one, lambda s: F.lit(False)))
        # export { a, b as c }: one variable symbol per specifier, named by alias
        clause = F.transform(
            split_names(F.regexp_extract(_ws_collapse(text), r"\{([^}]*)\}", 1)),
            lambda x: plain(F.when(x.rlike(_AS), F.regexp_extract(x, rf"{_AS}({NAME})", 1)).otherwise(x),
                            F.lit(True)))
        return F.when(a["clause"], clause).otherwise(F.concat(one, more))

    return let(declared(u["d"]),
               lambda a: let(named(a), lambda n: symbols(a, n)))


# ------------------------------------------------------------------ entry

PASS_THROUGH = ("raw_bytes", "raw_tokens", "content")


def _extra(df: DataFrame) -> list[str]:
    """Per-file columns that are carried along."""
    return [c for c in PASS_THROUGH if c in df.columns]


def _found(units: Column, py: bool, is_ts: Column) -> Column:
    imports = F.flatten(F.transform(units, _py_imports if py else _js_imports))

    def with_imports(imps: Column) -> Column:
        locals_ = F.array_distinct(F.transform(imps, lambda x: x["local_name"]))

        def with_locals(names: Column) -> Column:
            symbols = F.flatten(F.transform(
                units, lambda u: _py_symbols(u, names) if py else _js_symbols(u, names, is_ts)))
            return record(symbols=F.transform(symbols, lambda s, i: s.withField("ord", i)),
                          imports=imps)

        return let(_names(locals_), with_locals)

    return let(imports, with_imports)


def parse_files(files: DataFrame) -> DataFrame:
    """``files(path, language, text)`` to one row per file with its symbol
    and import arrays (see module doc), in one pass that picks the rules by
    the row's language."""
    keep = ["path", "language", *_extra(files)]

    def by_language(rules: Callable) -> Column:
        return F.when(F.col("language") == "python", rules(True)).otherwise(rules(False))

    # Steps keep the nesting of lambdas low.  Each reads the columns of the
    # one before through let: they may be merged into one projection.
    masked = files.select(*keep, F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "mask", by_language(lambda py: let(F.col("text"), lambda t: _masked(t, py))))
    cut = masked.withColumn("flats", by_language(lambda py: let(
        F.col("mask"), lambda m: _statements(m, py))))
    lengths = lambda body: let(F.transform("flats", _len), body)
    placed = (cut.withColumn("raws", lengths(lambda n: let(F.col("text"), lambda t: _cut(t, n))))
              .withColumn("masks", F.when(F.col("language") != "python",     # for the bodies of classes
                                        lengths(lambda n: let(F.col("mask"), lambda m: _cut(m, n)))))
              .withColumn("pieces", let(F.col("flats"), lambda fs: let(F.col("raws"), lambda rs: let(
                  F.col("masks"), lambda ms: _placed(fs, rs, ms))))))
    units = placed.select(*keep, by_language(lambda py: let(
        F.col("pieces"), lambda ps: _units(ps, py))).alias("units"))
    is_ts = F.col("language") == "typescript"
    found = units.select(*keep, by_language(lambda py: let(
        F.col("units"), lambda us: _found(us, py, is_ts))).alias("found"))
    return found.select("path", "language", "found.symbols", "found.imports", *_extra(files))


def explode_rows(df: DataFrame, keep: list[str], arr, alias: str) -> DataFrame:
    """Explode an array column into rows.  ``explode_outer`` + a null filter
    instead of ``explode``: an inner explode makes the optimizer infer a
    ``size(arr) > 0`` predicate and push it below the projection, which
    copies the array's whole definition into the filter."""
    return (df.select(*keep, F.explode_outer(arr).alias(alias))
            .where(F.col(alias).isNotNull()))


def with_texts_apart(parsed: DataFrame) -> DataFrame:
    """``parsed`` with the symbols' texts in a column ``texts`` of their own:
    whoever needs names, signatures or imports reads and shuffles no text."""
    kept = [f for f in _fields(parsed) if f != "text"]
    return parsed.select(
        *[F.transform("symbols", lambda s: record(**{f: s[f] for f in kept})).alias(c) if c == "symbols"
          else F.col(c) for c in parsed.columns],
        F.transform("symbols", lambda s: s["text"]).alias("texts"))


def with_texts(apart: DataFrame) -> DataFrame:
    """The way back from ``with_texts_apart``."""
    fields = _fields(apart)
    order = [f for f in _SYMBOL if f == "text" or f in fields]
    return apart.select(*[F.zip_with("symbols", "texts", lambda s, t: record(
        **{f: t if f == "text" else s[f] for f in order})).alias(c) if c == "symbols" else F.col(c)
        for c in apart.columns if c != "texts"])


def _fields(parsed: DataFrame) -> list[str]:
    return parsed.schema["symbols"].dataType.elementType.names


_SYMBOL = ["name", "kind", "start_line", "decl_line", "end_line", "start_byte", "end_byte", "is_exported",
           "has_body", "text", "sig", "used", "ord"]


def symbols_table(parsed: DataFrame) -> DataFrame:
    """One row per symbol: (path, language, name, kind, ..., ord)."""
    return explode_rows(parsed, ["path", "language"], "symbols", "s").select("path", "language", "s.*")


def imports_table(parsed: DataFrame) -> DataFrame:
    """One row per imported name: (path, language, line, local_name, export_name, specifier, stmt)."""
    return explode_rows(parsed, ["path", "language"], "imports", "i").select("path", "language", "i.*")

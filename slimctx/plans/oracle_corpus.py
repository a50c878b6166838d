"""DuckDB oracle SQL for the corpus queries.

Written as plain SQL over the pre-registered ``documents`` view.  The expected
symbols, signatures, lines and imports follow by construction from the
statements of the templates (``slimctx.sources.corpus``) and doc_id
arithmetic; no file is parsed here.  The traversal is three unrolled levels
with anti joins.
"""

from __future__ import annotations

from slimctx.functions.text import IDENT_RE
from slimctx.sources.corpus import (COMMENT, TEMPLATES, Stmt, content_sql, path_sql,
                                    statement_lines)


def q(s: str) -> str:
    """SQL string literal (DuckDB keeps backslashes as they are)."""
    return "'" + s.replace("'", "''") + "'"


NAME = r"[A-Za-z_$][\w$]*"


def rx(s: str, p: str) -> str:
    return f"regexp_matches({s}, {q(p)})"


def ex(s: str, p: str, g: int = 1) -> str:
    return f"regexp_extract({s}, {q(p)}, {g})"


def rstrip(s: str) -> str:
    return f"regexp_replace({s}, {q(r'\s+$')}, '')"


def strip(s: str) -> str:
    return f"regexp_replace(regexp_replace({s}, {q(r'\s+$')}, ''), {q(r'^\s+')}, '')"


def collapse(s: str) -> str:
    return f"regexp_replace({s}, {q(r'\s+')}, ' ', 'g')"


def split_names(s: str) -> str:
    return f"list_filter(list_transform(string_split({s}, ','), lambda x: trim(x)), lambda x: x <> '')"


def tokens(s: str) -> str:
    return f"CAST(greatest(1, length({s}) // 4) AS BIGINT)"


def pct2(num: str, den: str) -> str:
    return (f"CASE WHEN ({den}) = 0 THEN 0.0 ELSE CAST(sign({num}) * ((abs({num}) * 20000 + ({den})) "
            f"// (2 * ({den}))) AS DOUBLE) / 100 END")


def ratio2(num: str, den: str) -> str:
    return f"CAST((({num}) * 200 + ({den})) // (2 * ({den})) AS DOUBLE) / 100"


# ---------------------------------------------------------------- corpus

CORPUS = f"""
docs AS (SELECT doc_id, lang, text, (SELECT count(*) FROM documents) AS n_docs FROM documents),
files0 AS (SELECT {path_sql()} AS path, {content_sql('duckdb')} AS text FROM docs),
files AS (
  SELECT path,
         CASE WHEN lower({ex('path', r'(\.[^./]+)$')}) = '.py' THEN 'python'
              WHEN lower({ex('path', r'(\.[^./]+)$')}) IN ('.ts', '.tsx') THEN 'typescript'
              ELSE 'javascript' END AS language,
         text
  FROM files0
)"""

# ---------------------------------------------------------------- extraction

def _start(template: list[Stmt], k: int, comment_lines: str) -> str:
    """The line a statement begins at: what stands before it."""
    parts = ["0"]
    for st in template[:k]:
        n = " + ".join(comment_lines if x == COMMENT else "1" for x in st.lines)
        if st.end is not None:      # the next one starts on the same line
            n += " - 1"
        parts.append(f"CASE WHEN {st.when} THEN {n} ELSE 0 END" if st.when else f"({n})")
    return " + ".join(parts)


def _text(lines: list[str]) -> str:
    return " || chr(10) || ".join(f"({x})" for x in lines)


def _expected() -> tuple[str, str]:
    """The rows of all symbols and imports, from the templates alone."""
    symbols, imports = [], []
    for cond, prefix, template in TEMPLATES:
        for k, st in enumerate(template):
            where = f"{cond} AND ({st.when})" if st.when else cond
            begin = _start(template, k, "n_comment")
            text = _text(statement_lines(st, "duckdb", prefix, False))
            for sub, y in enumerate(st.symbols):
                symbols.append(
                    f"SELECT path, {begin} AS \"begin\", {st.skip} AS skip, {100 * k + sub} AS sub, {y.name} AS name, "
                    f"'{y.kind}' AS kind, {str(y.exported).lower()} AS is_exported, "
                    f"{str(y.sig is not None).lower()} AS has_body, {text} AS ftext, "
                    f"{_text(y.sig) if y.sig is not None else text} AS sig FROM docs2 WHERE {where}")
            whole = _text(statement_lines(st._replace(indent=""), "duckdb", prefix))
            for sub, (local, export, spec) in enumerate(st.imports):
                imports.append(
                    f"SELECT path, {begin} + {st.skip} AS line, {100 * k + sub} AS sub, {whole} AS stmt, {local} AS local_name, "
                    f"{export} AS export_name, {spec} AS specifier FROM docs2 WHERE {where}")
    return "\nUNION ALL\n".join(symbols), "\nUNION ALL\n".join(imports)


_SYMBOLS, _IMPORTS = _expected()

# What every statement holds is known from the template that made it: nothing
# below parses a file.  The only pattern is that of an identifier.
EXTRACT = f"""
docs2 AS (
  SELECT *, {path_sql()} AS path,
         1 + length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS n_comment
  FROM docs
),
imps AS ({_IMPORTS}),
locs AS (SELECT path, list_distinct(list(local_name)) AS locals FROM imps GROUP BY path),
syms0 AS ({_SYMBOLS}),
syms AS (
  SELECT s.path,
         CAST(row_number() OVER (PARTITION BY s.path ORDER BY s."begin", s.sub) - 1 AS INTEGER) AS ord,
         s.name, s.kind, CAST(s."begin" AS INTEGER) AS start_line, CAST(s."begin" + s.skip AS INTEGER) AS decl_line,
         CAST(s."begin" + len(string_split(s.ftext, chr(10))) - 1 AS INTEGER) AS end_line,
         s.is_exported, s.has_body, s.ftext AS text, s.sig,
         list_intersect(list_distinct(regexp_extract_all(s.ftext, {q(IDENT_RE)}, 1)),
                        coalesce(l.locals, [])) AS used
  FROM syms0 s LEFT JOIN locs l USING (path)
)"""

# ------------------------------------------------------ resolution and edges

RESOLVE = f"""
specs AS (
  SELECT DISTINCT i.path AS src, f.language, i.specifier
  FROM imps i JOIN files f USING (path) WHERE starts_with(i.specifier, '.')
),
spec2 AS (
  SELECT *, length({ex('specifier', r'^\.+', 0)}) AS dots,
         substr(specifier, length({ex('specifier', r'^\.+', 0)}) + 1) AS rest,
         {ex('src', r'^(.*)/[^/]*$')} AS dir
  FROM specs
),
spec3 AS (
  SELECT *,
         CASE WHEN len(string_split(src, '/')) - dots > 0
              THEN array_to_string(list_slice(string_split(src, '/'), 1, len(string_split(src, '/')) - dots), '/')
              ELSE '' END AS base,
         CASE WHEN dir = '' THEN specifier ELSE dir || '/' || specifier END AS joined
  FROM spec2
),
spec4 AS (
  SELECT *,
         CASE WHEN base = '' THEN replace(rest, '.', '/') ELSE base || '/' || replace(rest, '.', '/') END AS module,
         list_reduce(string_split(joined, '/'), lambda acc, x:
            CASE WHEN x = '..' AND len(acc) > 0 AND acc[-1] <> '..' THEN list_slice(acc, 1, len(acc) - 1)
                 WHEN x = '.' OR x = '' THEN acc
                 ELSE list_append(acc, x) END, []::VARCHAR[]) AS normparts
  FROM spec3
),
spec5 AS (
  SELECT *, CASE WHEN array_to_string(normparts, '/') = '' THEN '.' ELSE array_to_string(normparts, '/') END AS raw
  FROM spec4
),
cands AS (
  SELECT src, specifier, c.ord, c.cand FROM (
    SELECT src, specifier, unnest(
      CASE WHEN language = 'python' THEN
             CASE WHEN rest = '' THEN [{{'ord': 0, 'cand': CASE WHEN base = '' THEN '__init__.py' ELSE base || '/__init__.py' END}}]
                  ELSE [{{'ord': 0, 'cand': module || '.py'}}, {{'ord': 1, 'cand': module || '/__init__.py'}}] END
           WHEN language = 'typescript' THEN
             [{{'ord': 0, 'cand': raw}}, {{'ord': 1, 'cand': raw || '.ts'}}, {{'ord': 2, 'cand': raw || '.tsx'}},
              {{'ord': 3, 'cand': raw || '.js'}}, {{'ord': 4, 'cand': raw || '.jsx'}}, {{'ord': 5, 'cand': raw || '.mjs'}},
              {{'ord': 6, 'cand': raw || '/index.js'}}, {{'ord': 7, 'cand': raw || '/index.jsx'}},
              {{'ord': 8, 'cand': raw || '/index.ts'}}, {{'ord': 9, 'cand': raw || '/index.tsx'}}]
           ELSE
             [{{'ord': 0, 'cand': raw}}, {{'ord': 1, 'cand': raw || '.js'}}, {{'ord': 2, 'cand': raw || '.jsx'}},
              {{'ord': 3, 'cand': raw || '.mjs'}}, {{'ord': 4, 'cand': raw || '.ts'}}, {{'ord': 5, 'cand': raw || '.tsx'}},
              {{'ord': 6, 'cand': raw || '/index.js'}}, {{'ord': 7, 'cand': raw || '/index.jsx'}},
              {{'ord': 8, 'cand': raw || '/index.ts'}}, {{'ord': 9, 'cand': raw || '/index.tsx'}}]
      END) AS c
    FROM spec5)
),
resolved AS (
  SELECT src, specifier, arg_min(c.cand, c.ord) AS dst
  FROM cands c JOIN files f ON f.path = c.cand GROUP BY src, specifier
),
sym_edges_all AS (
  SELECT s.path AS src, s.name AS src_sym, i.specifier, r.dst, i.export_name AS dst_sym
  FROM syms s JOIN imps i ON i.path = s.path AND list_contains(s.used, i.local_name)
  JOIN resolved r ON r.src = s.path AND r.specifier = i.specifier
),
sym_edges AS (SELECT DISTINCT * FROM sym_edges_all),
star_edges AS (
  SELECT DISTINCT i.path AS src, i.specifier, r.dst
  FROM imps i JOIN resolved r ON r.src = i.path AND r.specifier = i.specifier
  WHERE i.local_name = '*'
)"""

# ------------------------------------------------------------- traversal

SEEDS = """
dflt AS (
  SELECT f.path AS entry,
         list_sort(list_distinct(coalesce(
           CASE WHEN count(*) FILTER (WHERE s.is_exported) > 0
                THEN list(s.name) FILTER (WHERE s.is_exported)
                ELSE list(s.name) FILTER (WHERE s.name IS NOT NULL) END, []))) AS syms
  FROM files f LEFT JOIN syms s USING (path) GROUP BY f.path
),
seeds AS (SELECT entry, syms FROM dflt)"""


def _ask(frontier: str) -> str:
    return f"""(
  SELECT entry, path, list_sort(list_distinct(list(sym))) AS syms FROM (
    SELECT f.entry, e.dst AS path, e.dst_sym AS sym
    FROM (SELECT entry, path, unnest(syms) AS sym FROM {frontier}) f
    JOIN sym_edges e ON e.src = f.path AND e.src_sym = f.sym
    UNION ALL
    SELECT f.entry, s.dst AS path, '*' AS sym
    FROM {frontier} f JOIN (SELECT DISTINCT src, dst FROM star_edges) s ON s.src = f.path
  ) GROUP BY entry, path)"""


BFS = f"""
lv0 AS (SELECT entry, entry AS path, syms FROM seeds),
lv1 AS {_ask('lv0')},
fr1 AS (SELECT a.* FROM lv1 a ANTI JOIN lv0 v USING (entry, path)),
lv2 AS {_ask('fr1')},
fr2 AS (SELECT a.* FROM lv2 a ANTI JOIN (SELECT entry, path FROM lv0 UNION ALL SELECT entry, path FROM fr1) v
        USING (entry, path)),
lv3 AS {_ask('fr2')},
nodes AS (
  SELECT entry, path, min(depth) AS depth, list_sort(list_distinct(flatten(list(syms)))) AS syms FROM (
    SELECT *, 0 AS depth FROM lv0 UNION ALL SELECT *, 1 FROM lv1
    UNION ALL SELECT *, 2 FROM lv2 UNION ALL SELECT *, 3 FROM lv3)
  GROUP BY entry, path
)"""

CLOSURE = """
c0 AS (SELECT entry, entry AS path, unnest(syms) AS sym FROM seeds),
c1n AS (
  SELECT DISTINCT * FROM (
    SELECT c.entry, e.dst AS path, e.dst_sym AS sym FROM c0 c JOIN sym_edges e ON e.src = c.path AND e.src_sym = c.sym
    UNION ALL
    SELECT c.entry, s.dst, '*' FROM (SELECT DISTINCT entry, path FROM c0) c
      JOIN (SELECT DISTINCT src, dst FROM star_edges) s ON s.src = c.path)
),
c1 AS (SELECT * FROM c1n ANTI JOIN c0 USING (entry, path, sym)),
c2n AS (
  SELECT DISTINCT * FROM (
    SELECT c.entry, e.dst AS path, e.dst_sym AS sym FROM c1 c JOIN sym_edges e ON e.src = c.path AND e.src_sym = c.sym
    UNION ALL
    SELECT c.entry, s.dst, '*' FROM (SELECT DISTINCT entry, path FROM c1) c
      JOIN (SELECT DISTINCT src, dst FROM star_edges) s ON s.src = c.path)
),
c2 AS (SELECT * FROM c2n ANTI JOIN (SELECT * FROM c0 UNION ALL SELECT * FROM c1) USING (entry, path, sym)),
c3n AS (
  SELECT DISTINCT * FROM (
    SELECT c.entry, e.dst AS path, e.dst_sym AS sym FROM c2 c JOIN sym_edges e ON e.src = c.path AND e.src_sym = c.sym
    UNION ALL
    SELECT c.entry, s.dst, '*' FROM (SELECT DISTINCT entry, path FROM c2) c
      JOIN (SELECT DISTINCT src, dst FROM star_edges) s ON s.src = c.path)
),
c3 AS (SELECT * FROM c3n ANTI JOIN (SELECT * FROM c0 UNION ALL SELECT * FROM c1 UNION ALL SELECT * FROM c2)
       USING (entry, path, sym)),
cnodes AS (
  SELECT entry, path, min(depth) AS depth, list_sort(list_distinct(list(sym) FILTER (WHERE sym IS NOT NULL))) AS syms
  FROM (SELECT entry, entry AS path, NULL AS sym, 0 AS depth FROM seeds
        UNION ALL SELECT *, 0 FROM c0 UNION ALL SELECT *, 1 FROM c1
        UNION ALL SELECT *, 2 FROM c2 UNION ALL SELECT *, 3 FROM c3)
  GROUP BY entry, path
)"""

# ------------------------------------------------------------- rewrite

PRUNE = f"""
psym AS (
  SELECT path, list(struct_pack(ord := ord, name := name, text := text, sig := sig, used := used)
                    ORDER BY ord) AS symbols
  FROM syms GROUP BY path
),
pimp AS (
  SELECT path, list(struct_pack(line := line, local_name := local_name, specifier := specifier, stmt := stmt)
                    ORDER BY line) AS imports
  FROM imps GROUP BY path
),
keys AS (SELECT DISTINCT path, depth = 0 AS is_entry, syms FROM nodes),
k1 AS (
  SELECT k.*, coalesce(ps.symbols, []) AS symbols, coalesce(pi.imports, []) AS imports,
         list_filter(coalesce(ps.symbols, []), lambda s: list_contains(k.syms, s.name)) AS hit
  FROM keys k LEFT JOIN psym ps USING (path) LEFT JOIN pimp pi USING (path)
),
k2 AS (
  SELECT *, CASE WHEN len(hit) = 0 AND len(syms) > 0 THEN symbols ELSE hit END AS kept FROM k1
),
k3 AS (
  SELECT *, list_filter(imports, lambda i: list_contains(
              list_distinct(flatten(list_transform(kept, lambda s: s.used))), i.local_name)
              OR i.local_name = '*') AS imps_used
  FROM k2
),
k4 AS (
  SELECT k3.*,
         (SELECT list(stmt ORDER BY line) FROM (
             SELECT DISTINCT line, stmt FROM (
               SELECT x.specifier, arg_min(x.line, x.line) AS line, arg_min(x.stmt, x.line) AS stmt
               FROM (SELECT unnest(k3.imps_used) AS x) GROUP BY x.specifier))) AS stmts
  FROM k3
),
ptext AS (
  SELECT path, is_entry, syms,
         {strip("CASE WHEN len(coalesce(stmts, [])) > 0 THEN array_to_string(stmts, chr(10)) || chr(10) ELSE '' END "
                "|| coalesce(array_to_string(list_transform(kept, lambda s: chr(10) || "
                "CASE WHEN is_entry THEN s.text ELSE s.sig END || chr(10)), ''), '')")} || chr(10) AS source,
         list_transform(hit, lambda s: s.name) AS symbols
  FROM k4
),
pruned AS (
  SELECT n.entry, n.path, n.path AS rel_path, n.depth, n.depth = 0 AS is_entry, t.symbols, t.source,
         {tokens('t.source')} AS estimated_tokens
  FROM nodes n JOIN ptext t ON t.path = n.path AND t.is_entry = (n.depth = 0) AND t.syms = n.syms
),
raw AS (SELECT path, CAST(octet_length(encode(text)) AS BIGINT) AS raw_bytes, {tokens('text')} AS raw_tokens FROM files),
bfiles AS (
  SELECT n.entry, n.path, n.depth, r.raw_bytes, r.raw_tokens,
         CAST(coalesce(p.estimated_tokens, 0) AS BIGINT) AS pruned_tokens
  FROM nodes n JOIN raw r USING (path) LEFT JOIN pruned p ON p.entry = n.entry AND p.path = n.path
),
bench AS (
  SELECT b.entry, s.syms AS requested_symbols, 3 AS depth,
         count(*) AS baseline_files, CAST(sum(raw_tokens) AS BIGINT) AS baseline_tokens,
         count(*) AS pruned_files, CAST(sum(pruned_tokens) AS BIGINT) AS pruned_tokens,
         CAST(sum(raw_bytes) AS BIGINT) AS raw_bytes,
         CAST(sum(raw_tokens) - sum(pruned_tokens) AS BIGINT) AS tokens_saved
  FROM bfiles b JOIN seeds s USING (entry) GROUP BY b.entry, s.syms
)"""


def corpus_with(*parts: str) -> str:
    return "WITH " + ",".join([CORPUS] + list(parts))


FULL = corpus_with(EXTRACT, RESOLVE, SEEDS, BFS)
FULL_PRUNE = corpus_with(EXTRACT, RESOLVE, SEEDS, BFS, PRUNE)


def _csv(x: str) -> str:
    return f"array_to_string({x}, ',')"


_EXT = r"(\.[^./]+)$"
_SYMS_BASE = corpus_with(EXTRACT)

CORPUS_SQL = {
    "corpus_language_counts": corpus_with() + f"""
SELECT language, count(*) AS files, CAST(sum(octet_length(encode(text))) AS BIGINT) AS raw_bytes,
       CAST(sum({tokens('text')}) AS BIGINT) AS raw_tokens,
       CAST(sum(CASE WHEN lower({ex('path', _EXT)}) IN ('.py','.js','.jsx','.mjs','.ts','.tsx') THEN 1 ELSE 0 END)
            AS BIGINT) AS supported
FROM files GROUP BY language""",
    "symbols_py": _SYMS_BASE + """
SELECT s.path, s.ord, s.name, s.kind, s.start_line, s.decl_line, s.end_line, s.is_exported, s.has_body
FROM syms s JOIN files f USING (path) WHERE f.language = 'python'""",
    "symbols_js": _SYMS_BASE + """
SELECT s.path, s.ord, s.name, s.kind, s.start_line, s.decl_line, s.end_line, s.is_exported, s.has_body
FROM syms s JOIN files f USING (path) WHERE f.language = 'javascript'""",
    "symbols_ts": _SYMS_BASE + """
SELECT s.path, s.ord, s.name, s.kind, s.start_line, s.decl_line, s.end_line, s.is_exported, s.has_body
FROM syms s JOIN files f USING (path) WHERE f.language = 'typescript'""",
    "imports_py": _SYMS_BASE + """
SELECT path, line, local_name, export_name, specifier FROM imps WHERE path LIKE '%.py'""",
    "imports_js": _SYMS_BASE + """
SELECT path, line, local_name, export_name, specifier FROM imps WHERE path NOT LIKE '%.py'""",
    "identifiers_per_symbol": _SYMS_BASE + f"""
SELECT path, ord, name, len(list_distinct(regexp_extract_all(text, {q(IDENT_RE)}, 1))) AS n_identifiers,
       {_csv('list_sort(used)')} AS used
FROM syms""",
    "strip_python": _SYMS_BASE + """
SELECT s.path, s.ord, s.name, s.kind, s.sig FROM syms s JOIN files f USING (path)
WHERE f.language = 'python' AND s.has_body""",
    "strip_js": _SYMS_BASE + """
SELECT s.path, s.ord, s.name, s.kind, s.sig FROM syms s JOIN files f USING (path)
WHERE f.language <> 'python' AND s.kind = 'function'""",
    # the corpus is ASCII: bytes are characters
    "symbol_bytes": _SYMS_BASE + """
SELECT s.path, s.ord, s.name, CAST(strpos(f.text, s.text) - 1 AS INTEGER) AS start_byte,
       CAST(strpos(f.text, s.text) - 1 + length(s.text) AS INTEGER) AS end_byte, true AS same
FROM syms s JOIN files f USING (path)""",
    "strip_class": _SYMS_BASE + """
SELECT s.path, s.ord, s.name, s.kind, s.sig FROM syms s JOIN files f USING (path)
WHERE f.language <> 'python' AND s.kind = 'class'""",
    "default_exports": corpus_with(EXTRACT, SEEDS) + f"""
SELECT entry AS path, len(syms) AS n, {_csv('syms')} AS syms FROM dflt""",
    "requested_or_all": _SYMS_BASE + f"""
, req AS (SELECT list_sort(list_distinct({split_names(q("fn_0, f_1 ,, Shape2, V_3, default"))})) AS r),
per AS (
  SELECT f.path,
         list(s.name ORDER BY s.ord) FILTER (WHERE s.name IS NOT NULL) AS alln,
         list(s.name ORDER BY s.ord) FILTER (WHERE list_contains((SELECT r FROM req), s.name)) AS hit
  FROM files f LEFT JOIN syms s USING (path) GROUP BY f.path
)
SELECT path, (coalesce(len(hit), 0) = 0) AS fallback,
       CAST(CASE WHEN coalesce(len(hit), 0) = 0 THEN coalesce(len(alln), 0) ELSE len(hit) END AS INTEGER) AS n_kept,
       CASE WHEN coalesce(len(hit), 0) = 0 THEN coalesce({_csv('alln')}, '') ELSE {_csv('hit')} END AS kept
FROM per""",
    "used_imports": corpus_with(EXTRACT, SEEDS) + """
, nodes AS (SELECT entry AS path, 0 AS depth, syms FROM dflt)
, """ + PRUNE.split("keys AS", 1)[0].strip().rstrip(",") + """
, keys AS (SELECT path, true AS is_entry, syms FROM nodes)
, """ + "k1 AS" + PRUNE.split("k1 AS", 1)[1].split("ptext AS", 1)[0].strip().rstrip(",") + """
SELECT path, CAST(len(coalesce(stmts, [])) AS INTEGER) AS n_stmts,
       coalesce(array_to_string(stmts, chr(10)), '') AS stmts
FROM k4""",
    "resolve_specifiers": corpus_with(EXTRACT, RESOLVE) + """
SELECT src, specifier, dst FROM resolved""",
    "symbol_edges": corpus_with(EXTRACT, RESOLVE) + """
SELECT src, src_sym, specifier, dst, dst_sym FROM sym_edges""",
    "needed_imports": corpus_with(EXTRACT, RESOLVE) + f"""
SELECT src, specifier, CAST(len(list_distinct(list(dst_sym))) AS INTEGER) AS n,
       {_csv('list_sort(list_distinct(list(dst_sym)))')} AS names
FROM sym_edges GROUP BY src, specifier""",
    "bfs_depth3": FULL + f"""
SELECT entry, path, depth, {_csv('syms')} AS syms FROM nodes""",
    "closure_depth3": corpus_with(EXTRACT, RESOLVE, SEEDS, CLOSURE) + f"""
SELECT entry, path, depth, {_csv('syms')} AS syms FROM cnodes""",
    "cycles_diamonds": FULL + f"""
SELECT n.entry, {_csv('s.syms')} AS initial, {_csv('n.syms')} AS merged,
       {_csv('list_filter(n.syms, lambda x: NOT list_contains(s.syms, x))')} AS added
FROM nodes n JOIN seeds s USING (entry) WHERE n.path = n.entry AND n.syms <> s.syms""",
    "prune_files": FULL_PRUNE + f"""
SELECT entry, path, rel_path, depth, is_entry, {_csv('symbols')} AS symbols, source, estimated_tokens
FROM pruned""",
    "render_text": FULL_PRUNE + """
, blocks AS (
  SELECT entry, depth, path, estimated_tokens,
         '# === ' || rel_path || ' (' || CAST(estimated_tokens AS VARCHAR) || ' tokens) ===' || chr(10)
         || """ + strip("source") + """ || chr(10) AS b
  FROM pruned
)
SELECT entry, CAST(sum(estimated_tokens) AS BIGINT) AS total_tokens, count(*) AS files,
       string_agg(b, chr(10) ORDER BY depth, path) || chr(10) || '# ---' || chr(10) || '# Total: '
       || CAST(sum(estimated_tokens) AS VARCHAR) || ' tokens across ' || CAST(count(*) AS VARCHAR)
       || ' file(s)' || chr(10) AS text
FROM blocks GROUP BY entry""",
    "render_json": FULL_PRUNE + f"""
SELECT p.entry, b.pruned_tokens AS total_tokens, {_csv('b.requested_symbols')} AS requested_symbols, p.path, p.rel_path,
       p.depth, p.is_entry, {_csv('p.symbols')} AS symbols, p.source, p.estimated_tokens
FROM pruned p JOIN bench b ON b.entry = p.entry""",
    "prune_below_root": FULL_PRUNE + """
SELECT entry, path, CASE WHEN starts_with(path, 'src/p1/') THEN substr(path, 8) ELSE path END AS rel_path, depth
FROM pruned""",
    "token_estimate": f"""
SELECT doc_id, length(text) AS chars, {tokens('text')} AS tokens FROM documents""",
    "token_totals": FULL_PRUNE + """
SELECT count(*) AS entries, CAST(sum(baseline_files) AS BIGINT) AS files,
       CAST(sum(baseline_tokens) AS BIGINT) AS baseline_tokens, CAST(sum(pruned_tokens) AS BIGINT) AS pruned_tokens,
       CAST(sum(tokens_saved) AS BIGINT) AS tokens_saved
FROM bench""",
    "bench_entry": FULL_PRUNE + f"""
SELECT entry, {_csv('requested_symbols')} AS requested_symbols, depth, baseline_files, baseline_tokens,
       pruned_files, pruned_tokens, raw_bytes, tokens_saved,
       {pct2('tokens_saved', 'baseline_tokens')} AS reduction_pct,
       {ratio2('baseline_tokens', 'pruned_tokens')} AS compression_ratio
FROM bench""",
    "bench_files": FULL_PRUNE + f"""
SELECT entry, path, depth, raw_bytes, raw_tokens, pruned_tokens,
       {pct2('raw_tokens - pruned_tokens', 'raw_tokens')} AS reduction_pct
FROM bfiles""",
    "bench_request_totals": FULL_PRUNE + f"""
SELECT {ex('entry', r'^(.*)/[^/]*$')} AS request, count(*) AS files,
       CAST(sum(baseline_tokens) AS BIGINT) AS baseline_tokens, CAST(sum(pruned_tokens) AS BIGINT) AS pruned_tokens,
       CAST(sum(tokens_saved) AS BIGINT) AS tokens_saved, CAST(sum(baseline_files) AS BIGINT) AS files_traversed,
       CASE WHEN count(*) > 1 AND sum(baseline_tokens) > 0
            THEN {pct2('sum(tokens_saved)', 'sum(baseline_tokens)')} END AS weighted_reduction_pct
FROM bench GROUP BY 1""",
    "sweep_top_savers": FULL_PRUNE + f"""
SELECT entry, baseline_files, baseline_tokens, pruned_tokens, tokens_saved,
       {pct2('tokens_saved', 'baseline_tokens')} AS reduction_pct,
       {ratio2('baseline_tokens', 'pruned_tokens')} AS compression_ratio
FROM bench ORDER BY tokens_saved DESC, entry ASC LIMIT 10""",
    "invalid_utf8": """
SELECT doc_id, length(text) + 2 AS chars,
       2 + length(text) - length(replace(text, chr(65533), '')) AS replaced,
       octet_length(encode(text)) + 2 AS raw_bytes
FROM documents""",
    "unparseable_skipped": f"""
SELECT 'web/page' || CAST(page_id AS VARCHAR) || '.html' AS path, '.html' AS ext, 'javascript' AS read_as,
       {tokens('html')} AS raw_tokens
FROM pages""",
    "log_append_roundtrip": FULL_PRUNE + f"""
SELECT '2026-01-01T00:00:00Z' AS ts, entry AS file, {_csv('requested_symbols')} AS symbols,
       CAST(depth AS BIGINT) AS depth, baseline_tokens, pruned_tokens, tokens_saved,
       {pct2('tokens_saved', 'baseline_tokens')} AS reduction_pct,
       CAST(baseline_files AS BIGINT) AS files_traversed
FROM bench""",
}

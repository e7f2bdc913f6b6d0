"""DuckDB SQL computing the same answers as the Spark queries.

The SQL runs on the given tables (views named after them). Column names and
types are aliased to the Spark output. Blocks are plain CTE text so every
query states its whole derivation.
"""

from __future__ import annotations

from srcindex.functions.text import STRIP_PATTERN

# --- shared CTE blocks ----------------------------------------------------

STRIP = STRIP_PATTERN.replace("'", "''")


def pystrip(expr: str) -> str:
    return f"regexp_replace({expr}, '{STRIP}', '', 'g')"


def is_blank(expr: str) -> str:
    return f"({expr} IS NULL OR length({pystrip(expr)}) = 0)"


def bucket(expr: str, dim: int = 1024) -> str:
    return f"CAST(CAST(('0x' || substr(md5({expr}), 1, 8)) AS BIGINT) % {dim} AS INTEGER)"


TOKENS = r"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"

CORPUS = f"""
corpus_raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS txt,
         generate_subscripts(string_split(text, chr(10)), 1) AS p
  FROM documents
),
corpus AS (
  SELECT doc_id || ':' || p AS entry_id, doc_id, CAST(p AS INTEGER) AS line_no, txt
  FROM corpus_raw WHERE NOT {is_blank('txt')}
)"""


def postings_cte(name: str, src: str, id_col: str, text_col: str) -> str:
    """Long-form sparse vectors ``name``(id, bucket, tf) and ``name_norm``(id, norm2)."""
    return f"""
{name}_tok AS (
  SELECT {id_col} AS id, unnest({TOKENS.format(x=text_col)}) AS tok FROM {src}
),
{name} AS (
  SELECT id, {bucket('tok')} AS bucket, CAST(count(*) AS INTEGER) AS tf
  FROM {name}_tok GROUP BY ALL
),
{name}_norm AS (
  SELECT id, CAST(sum(CAST(tf AS BIGINT) * tf) AS BIGINT) AS norm2 FROM {name} GROUP BY id
)"""


def distance_expr(dot: str, n1: str, n2: str) -> str:
    return f"(2.0::DOUBLE - (2.0::DOUBLE * {dot}) / sqrt(CAST({n1} AS DOUBLE) * CAST({n2} AS DOUBLE)))"


def sparse_pairs_cte(qpost: str, dpost: str, name: str = "pairs") -> str:
    return f"""
{name}_dot AS (
  SELECT q.id AS query_id, d.id AS entry_id, sum(CAST(q.tf AS BIGINT) * d.tf) AS dot
  FROM {qpost} q JOIN {dpost} d ON q.bucket = d.bucket GROUP BY ALL
),
{name} AS (
  SELECT p.query_id, p.entry_id, {distance_expr('p.dot', 'qn.norm2', 'dn.norm2')} AS distance
  FROM {name}_dot p JOIN {qpost}_norm qn ON qn.id = p.query_id JOIN {dpost}_norm dn ON dn.id = p.entry_id
)"""


def topk_cte(src: str, k: int, name: str = "topk", where: str = "TRUE") -> str:
    return f"""
{name} AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, entry_id) AS INTEGER) AS rank,
         entry_id, distance
  FROM {src} WHERE {where}
  QUALIFY rank <= {k}
)"""


def with_(*blocks: str) -> str:
    return "WITH " + ",".join(b.strip("\n") for b in blocks)


# --- queries ----------------------------------------------------------------

SQL: dict[str, str] = {}

SQL["embed_documents"] = with_(CORPUS, postings_cte("dpost", "corpus", "entry_id", "txt")) + """
SELECT id AS entry_id, bucket, tf FROM dpost"""

SQL["embed_queries"] = with_(postings_cte("qpost", "benchmark", "item_id", "text")) + """
SELECT id AS query_id, bucket, tf FROM qpost"""

_KNN_BASE = (CORPUS, postings_cte("dpost", "corpus", "entry_id", "txt"),
             postings_cte("qpost", "benchmark", "item_id", "text"), sparse_pairs_cte("qpost", "dpost"))

SQL["knn_sparse"] = with_(*_KNN_BASE, topk_cte("pairs", 5)) + """
SELECT query_id, rank, entry_id, distance FROM topk"""

SQL["knn_threshold"] = with_(*_KNN_BASE, topk_cte("pairs", 5, where="distance <= 0.55")) + """
SELECT query_id, rank, entry_id, distance FROM topk"""


# --- review assembly (2.E) -----------------------------------------------------

from srcindex.operators import review as R  # noqa: E402


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_fill(template: str, **exprs: str) -> str:
    out, rest = [], template
    while rest:
        i = rest.find("{")
        if i < 0:
            out.append(lit(rest))
            break
        j = rest.index("}", i)
        if i:
            out.append(lit(rest[:i]))
        out.append(f"({exprs[rest[i + 1:j]]})")
        rest = rest[j + 1:]
    return " || ".join(out)


def trunc(expr: str) -> str:
    return (f"CASE WHEN length({expr}) > {R.SNIPPET_MAX_CHARS} "
            f"THEN substr({expr}, 1, {R.SNIPPET_MAX_CHARS}) || {lit(R.SNIPPET_ELLIPSIS)} ELSE {expr} END")


REQUESTS = f"""
req AS (
  SELECT item_id AS request_id, text AS code FROM benchmark
  UNION ALL
  SELECT -item_id - 1 AS request_id, '  ' || chr(10) || chr(9) || ' ' AS code FROM benchmark WHERE item_id % 10 = 0
),
valid AS (SELECT request_id, code FROM req WHERE NOT {is_blank('code')})"""

SIMILAR = (REQUESTS, CORPUS, postings_cte("dpost", "corpus", "entry_id", "txt"),
           postings_cte("qpost", "valid", "request_id", "code"), sparse_pairs_cte("qpost", "dpost"),
           topk_cte("pairs", 5, where="distance <= 0.55"), f"""
sim AS (
  SELECT t.query_id AS request_id,
         string_agg('[Code ' || CAST(t.rank AS VARCHAR) || ']' || chr(10) || '```' || chr(10)
                    || {pystrip(trunc('c.txt'))} || chr(10) || '```', chr(10) || chr(10) ORDER BY t.rank)
           AS similar_code
  FROM topk t JOIN corpus c ON c.entry_id = t.entry_id
  GROUP BY 1
)""", f"""
dup AS (
  SELECT v.request_id,
         CASE WHEN s.similar_code IS NULL OR s.similar_code = '' THEN ''
              ELSE {sql_fill(R.DUPLICATION_TEMPLATE, code=pystrip('v.code'), similar='s.similar_code')} END AS prompt
  FROM valid v LEFT JOIN sim s ON s.request_id = v.request_id
)""", f"""
prompts AS (
  SELECT request_id, 'style' AS kind, {sql_fill(R.STYLE_TEMPLATE, code=pystrip('code'))} AS prompt FROM valid
  UNION ALL
  SELECT request_id, 'duplication' AS kind, prompt FROM dup WHERE prompt <> ''
)""")

SQL["review_rejects"] = with_(REQUESTS) + f"""
SELECT request_id, {lit(R.EMPTY_CODE_DETAIL)} AS reason FROM req WHERE {is_blank('code')}"""

SQL["prompt_style"] = with_(REQUESTS) + f"""
SELECT request_id, {sql_fill(R.STYLE_TEMPLATE, code=pystrip('code'))} AS prompt FROM valid"""

SQL["similar_snippets"] = with_(*SIMILAR) + """
SELECT request_id, similar_code FROM sim"""

SQL["prompt_duplication"] = with_(*SIMILAR) + """
SELECT request_id, prompt FROM dup"""

SQL["job_review_prompts"] = with_(*SIMILAR) + """
SELECT request_id, kind, prompt FROM prompts"""

_o = R.MODEL_OPTIONS
SQL["model_requests"] = with_(*SIMILAR) + f"""
SELECT request_id, kind,
       CAST(json_object('model', {lit(R.MODEL_NAME)}, 'prompt', prompt,
                        'temperature', {_o['temperature']}::DOUBLE, 'top_k', {_o['top_k']},
                        'top_p', {_o['top_p']}::DOUBLE, 'repeat_penalty', {_o['repeat_penalty']}::DOUBLE,
                        'stream', false) AS VARCHAR) AS payload
FROM prompts"""

TURNS = """
turns AS (
  SELECT u.conv_id || ':' || u.turn || c AS request_id, c, u.text AS code, a.text AS answer
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant',
    (VALUES (''), (':alone'), (':damaged')) cases(c)
  WHERE u.role = 'user'
),
resp AS (
  SELECT request_id, 'style' AS kind, answer AS response FROM turns
  UNION ALL
  SELECT request_id, 'duplication', 'duplication: ' || answer FROM turns WHERE c <> ':alone'
  UNION ALL
  SELECT request_id, 'summary', 'summary: ' || answer FROM turns WHERE c = ''
)"""

SQL["model_responses"] = with_(TURNS) + """
SELECT request_id, kind, response FROM resp"""

SQL["response_rejects"] = with_(TURNS) + """
SELECT request_id, 'summary' AS kind, 'unreadable response body' AS reason FROM turns WHERE c = ':damaged'"""

SQL["prompt_summary"] = with_(TURNS) + f"""
SELECT request_id,
       {pystrip(sql_fill(R.SUMMARY_TEMPLATE, duplication="'duplication: ' || answer", style='answer'))} AS prompt
FROM turns WHERE c <> ':alone'"""

SQL["review_assemble"] = with_(TURNS) + f"""
SELECT request_id,
       CASE WHEN c = '' THEN 'duplication: ' || answer ELSE {lit(R.NO_DUPLICATION)} END AS duplication_review,
       answer AS style_review,
       CASE WHEN c = '' THEN 'summary: ' || answer ELSE answer END AS summary
FROM turns WHERE c <> ':damaged' AND NOT {is_blank('code')}"""


# --- chunking and analysis (2.B): closed forms over `part` ----------------------

from srcindex.sources import fixtures as FX  # noqa: E402

NL = "chr(10)"
IF4 = FX.IF_BLOCK.replace("        ", "    ", 1).replace("            ", "        ", 1)


def _s(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


MODS_T = """
{name} AS (
  SELECT p_partkey AS k, p_size AS s, p_size % 4 AS m, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS e,
         p_name AS pn, p_type AS pt, {brand} AS pb,
         'corpus/part_' || {_s('p_partkey')} || '.py' AS filepath,
         CASE WHEN p_partkey % 7 = 0 THEN 'Migration' ELSE 'Part' || {_s('p_partkey')} END AS cls,
         CASE WHEN p_partkey % 5 = 0 THEN 'AbstractBase, pkg.Mixin' ELSE 'Base' || {_s('p_size % 3')} END AS bases_src,
         CASE WHEN p_partkey % 5 = 0 THEN 'AbstractBase,pkg.Mixin' ELSE 'Base' || {s3} END AS bases_txt
  FROM part
)"""
MODS_T = MODS_T.replace("{_s('p_partkey')}", _s('p_partkey')).replace("{_s('p_size % 3')}", "{s3}")
MODS = MODS_T.format(name="mods", brand="p_brand", s3=_s("p_size % 3"))

_SCALE_HEAD = lit('def scale(self, by: float = 1.5, *rest, **opts) -> "Part":\n')
_SCALE_UNTAGGED = (f"{_SCALE_HEAD} || repeat({lit(FX.IF_BLOCK)}, m) || CASE WHEN e = 1 THEN {lit(FX.SUPER_LINE)} "
                   f"ELSE '' END || '        raise ValueError(\"' || pb || '\")'")
_SCALE_TAGGED = (f"{_SCALE_HEAD} || repeat({lit(IF4)}, m) || CASE WHEN e = 1 THEN {lit('    super().scale(by)' + chr(10))} "
                 f"ELSE '' END || '    raise ValueError(\"' || pb || '\")'")
_LABEL = ("'def label(self) -> str:' || {nl} || '{i}\"\"\"Label of ' || pn || '.\"\"\"' || {nl} "
          "|| '{i}return osp.join(\"' || pt || '\", self.size)'")
_CLASS_CODE = (f"'class ' || cls || '(' || bases_src || '):' || {NL} || '    \"\"\"' || pn || ' part.\"\"\"' || {NL} "
               f"|| '    def __init__(self, size=' || {_s('s')} || '):' || {NL} || '        self.size = size' || {NL} "
               f"|| '    @property' || {NL} || '    def label(self) -> str:' || {NL} "
               f"|| '        \"\"\"Label of ' || pn || '.\"\"\"' || {NL} "
               f"|| '        return osp.join(\"' || pt || '\", self.size)' || {NL} || {_SCALE_UNTAGGED.replace('def scale', '    def scale', 1)}")
_SCALE_CALLS = "'ValueError' || CASE WHEN m > 0 THEN ',root' ELSE '' END || CASE WHEN e = 1 THEN ',super,super().scale' ELSE '' END"
_SCALE_ATTRS = "concat_ws(',', CASE WHEN m > 0 THEN 'self.size' END, CASE WHEN e = 1 THEN 'super().scale' END)"

# columns: filepath, filename, seq, type, name, start_line, end_line, code, docstring, class_name,
# class_docstring, method_name, is_async, is_function, is_static, is_classmethod, is_property,
# decorators, parameters, return_annotation, calls_functions, accesses_attributes, imports_used,
# raises_exceptions, overrides_method, complexity_score, base_classes, methods, is_abstract
_FN_NULL_CLASS = "NULL::VARCHAR, NULL::VARCHAR, NULL::BOOLEAN"


def _row(seq, typ, name, start, end, code, doc, cls, cdoc, is_async, prop, decos, params, ret, calls,
         attrs, imports, raises, overrides, complexity, where, meta=None):
    return f"""
  SELECT k, {meta} AS params_meta, filepath, 'part_' || {_s('k')} || '.py' AS filename, CAST({seq} AS BIGINT) AS seq, '{typ}' AS type,
         {name} AS name, CAST({start} AS INTEGER) AS start_line, CAST({end} AS INTEGER) AS end_line,
         {code} AS code, {doc} AS docstring, {cls} AS class_name, {cdoc} AS class_docstring,
         {name} AS method_name, {is_async} AS is_async, TRUE AS is_function, FALSE AS is_static,
         FALSE AS is_classmethod, {prop} AS is_property, {decos} AS decorators, {params} AS parameters,
         {ret} AS return_annotation, {calls} AS calls_functions, {attrs} AS accesses_attributes,
         {imports} AS imports_used, {raises} AS raises_exceptions, {overrides} AS overrides_method,
         CAST({complexity} AS INTEGER) AS complexity_score, {_FN_NULL_CLASS.split(', ')[0]} AS base_classes,
         NULL::VARCHAR AS methods, NULL::BOOLEAN AS is_abstract
  FROM {{mods}} WHERE {where}"""


_P_INIT = "'self:::positional,size::' || " + _s("s") + " || ':positional'"
_P_LABEL = "'self:::positional'"
_P_SCALE = "'self:::positional,by:float:1.5:positional,*rest:::var_positional,**opts:::var_keyword'"
_P_LOAD = "'path:::positional,retries:int:3:positional'"
_P_SCALE_META = "'self:None,by:float,*rest:None,**opts:None'"
_NORMAL = "k % 7 <> 0"
_LOAD_START = "15 + 2 * m + e"
_SCALE_END = "13 + 2 * m + e"

CHUNKS_T = "{mods},\n{expected} AS (" + f"""
  SELECT k, NULL::VARCHAR AS params_meta, filepath, 'part_' || {_s('k')} || '.py' AS filename, CAST(0 AS BIGINT) AS seq, 'ClassDef' AS type,
         cls AS name, CAST(4 AS INTEGER) AS start_line, CAST({_SCALE_END} AS INTEGER) AS end_line,
         {_CLASS_CODE} AS code, pn || ' part.' AS docstring, NULL::VARCHAR AS class_name,
         NULL::VARCHAR AS class_docstring, NULL::VARCHAR AS method_name, FALSE AS is_async, FALSE AS is_function,
         FALSE AS is_static, FALSE AS is_classmethod, FALSE AS is_property, NULL::VARCHAR AS decorators,
         NULL::VARCHAR AS parameters, NULL::VARCHAR AS return_annotation, NULL::VARCHAR AS calls_functions,
         NULL::VARCHAR AS accesses_attributes, NULL::VARCHAR AS imports_used, NULL::VARCHAR AS raises_exceptions,
         NULL::BOOLEAN AS overrides_method, NULL::INTEGER AS complexity_score, bases_txt AS base_classes,
         '__init__,label,scale' AS methods, (k % 5 = 0) AS is_abstract
  FROM {{mods}} WHERE {_NORMAL}
  UNION ALL""" + " UNION ALL".join([
    _row(3, "FunctionDef", "'__init__'", 6, 7,
         f"'def __init__(self, size=' || {_s('s')} || '):' || {NL} || '    self.size = size'",
         "NULL::VARCHAR", "cls", "pn || ' part.'", "FALSE", "FALSE", "''", _P_INIT, "NULL::VARCHAR",
         "''", "'self.size'", "''", "''", "FALSE", 1, _NORMAL, "'self:None,size:None'"),
    _row(4, "FunctionDef", "'label'", 9, 11, _LABEL.format(nl=NL, i="    "), "'Label of ' || pn || '.'",
         "cls", "pn || ' part.'", "FALSE", "TRUE", "'property'", _P_LABEL, "'str'", "'osp.join'",
         "'osp.join,self.size'", "'os.path'", "''", "FALSE", 1, _NORMAL, "'self:None'"),
    _row(5, "FunctionDef", "'scale'", 12, _SCALE_END, _SCALE_TAGGED, "NULL::VARCHAR", "cls", "pn || ' part.'",
         "FALSE", "FALSE", "''", _P_SCALE, "'''Part'''", _SCALE_CALLS, _SCALE_ATTRS,
         "CASE WHEN m > 0 THEN 'math.sqrt' ELSE '' END", "'ValueError'", "(e = 1)", "1 + 2 * m", _NORMAL,
         _P_SCALE_META),
    _row(1 << 32, "AsyncFunctionDef", "'load_' || " + _s("k"), _LOAD_START, "16 + 2 * m + e",
         f"'async def load_' || {_s('k')} || '(path, retries: int = 3):' || {NL} || '    return await fetch(path)'",
         "NULL::VARCHAR", "NULL::VARCHAR", "NULL::VARCHAR", "TRUE", "FALSE", "''", _P_LOAD, "NULL::VARCHAR",
         "'fetch'", "''", "''", "''", "FALSE", 1, "TRUE", "'path:None,retries:int'"),
    _row(3 << 32, "FunctionDef", "'label'", 9, 11, _LABEL.format(nl=NL, i="        "),
         "'Label of ' || pn || '.'", "NULL::VARCHAR", "NULL::VARCHAR", "FALSE", "TRUE", "'property'", _P_LABEL,
         "'str'", "'osp.join'", "'osp.join,self.size'", "'os.path'", "''", "FALSE", 1, "TRUE", "'self:None'"),
    _row(4 << 32, "FunctionDef", "'scale'", 12, _SCALE_END, _SCALE_UNTAGGED, "NULL::VARCHAR", "NULL::VARCHAR",
         "NULL::VARCHAR", "FALSE", "FALSE", "''", _P_SCALE, "'''Part'''", _SCALE_CALLS, _SCALE_ATTRS,
         "CASE WHEN m > 0 THEN 'math.sqrt' ELSE '' END", "'ValueError'", "FALSE", "1 + 2 * m", "TRUE",
         _P_SCALE_META),
]) + "\n)"

def chunks_cte(expected: str = "expected", mods: str = "mods", brand: str = "p_brand") -> str:
    head = MODS_T.format(name=mods, brand=brand, s3=_s("p_size % 3"))
    body = CHUNKS_T.replace("{mods},", head + ",", 1).replace("{expected}", expected)
    return body.replace("{mods}", mods)


CHUNKS = chunks_cte()
_C = with_(CHUNKS)
SQL["chunk_definitions"] = _C + "\nSELECT filepath, seq, type, name, start_line, end_line, class_name FROM expected"
SQL["chunk_skiplist"] = with_(MODS) + """
SELECT filepath, 'FunctionDef' AS type, '__init__' AS name, CAST(6 AS INTEGER) AS start_line FROM mods
UNION ALL
SELECT filepath, 'ClassDef', 'Migration', CAST(4 AS INTEGER) FROM mods WHERE k % 7 = 0"""
SQL["chunk_code"] = _C + "\nSELECT filepath, seq, code FROM expected WHERE class_name IS NULL"
SQL["chunk_dedent"] = _C + "\nSELECT filepath, seq, code FROM expected WHERE class_name IS NOT NULL"
SQL["chunk_methods"] = _C + """
SELECT filepath, seq, name, class_name, class_docstring, start_line, end_line FROM expected
WHERE class_name IS NOT NULL"""
SQL["chunk_metadata"] = _C + """
SELECT filepath, filename, seq, type, name, docstring, method_name, is_async, is_function, start_line, end_line
FROM expected"""
for _q, _col in [("fn_calls", "calls_functions"), ("fn_attributes", "accesses_attributes"),
                 ("fn_raises", "raises_exceptions"), ("fn_decorators", "decorators"),
                 ("fn_imports_used", "imports_used"), ("fn_parameters", "parameters"),
                 ("fn_returns", "return_annotation"), ("fn_complexity", "complexity_score"),
                 ("fn_overrides", "overrides_method")]:
    SQL[_q] = _C + f"\nSELECT filepath, seq, {_col} FROM expected WHERE is_function"
SQL["fn_flags"] = _C + "\nSELECT filepath, seq, is_static, is_classmethod, is_property FROM expected"
SQL["file_imports"] = with_(MODS) + """
SELECT filepath, 'osp' AS alias, 'os.path' AS full_name FROM mods
UNION ALL SELECT filepath, 'root', 'math.sqrt' FROM mods"""
SQL["cls_members"] = _C + "\nSELECT filepath, seq, base_classes, methods FROM expected WHERE type = 'ClassDef'"
SQL["cls_abstract"] = _C + "\nSELECT filepath, seq, is_abstract FROM expected WHERE type = 'ClassDef'"


# --- index (2.C, SNK, Q-5..Q-7, J-1) ---------------------------------------------

def _json_str(key: str, expr: str) -> str:
    return f"CASE WHEN {expr} IS NOT NULL AND {expr} <> '' THEN '\"{key}\":' || to_json({expr}) END"


def _json_raw(key: str, expr: str) -> str:
    return f"CASE WHEN {expr} IS NOT NULL THEN '\"{key}\":' || CAST({expr} AS VARCHAR) END"


def _json_bool(key: str, expr: str) -> str:
    return f"CASE WHEN {expr} IS NOT NULL THEN '\"{key}\":' || CASE WHEN {expr} THEN 'true' ELSE 'false' END END"


_META_PARTS = [
    _json_str("type", "type"), _json_str("name", "name"), _json_raw("start_line", "start_line"),
    _json_raw("end_line", "end_line"), _json_str("class_name", "class_name"), _json_str("method_name", "method_name"),
    _json_bool("is_async", "is_async"), _json_bool("is_function", "is_function"), _json_bool("is_static", "is_static"),
    _json_bool("is_classmethod", "is_classmethod"), _json_bool("is_property", "is_property"),
    _json_str("filepath", "filepath"), _json_str("filename", "filename"), _json_str("decorators", "decorators"),
    _json_str("parameters", "params_meta"), _json_str("return_annotation", "return_annotation"),
    _json_str("calls_functions", "calls_functions"), _json_str("accesses_attributes", "accesses_attributes"),
    _json_str("imports_used", "imports_used"), _json_str("raises_exceptions", "raises_exceptions"),
    _json_bool("overrides_method", "overrides_method"), _json_raw("complexity_score", "complexity_score"),
    _json_str("base_classes", "base_classes"), _json_str("methods", "methods"), _json_bool("is_abstract", "is_abstract"),
]
METADATA_SQL = "'{' || concat_ws(',', " + ", ".join(_META_PARTS) + ") || '}'"
DOCUMENT_SQL = ("concat_ws(chr(10), CASE WHEN class_docstring <> '' THEN '# Class docstring: ' || class_docstring END, "
                "CASE WHEN class_name <> '' THEN '# Class: ' || class_name END, "
                "CASE WHEN docstring <> '' THEN '''''''' || docstring || '''''''' END, code)")
CHUNK_ID_SQL = ("CASE WHEN length({b}) > 100 THEN name || ':' || substr(md5({b}), 1, 8) ELSE {b} END"
                .format(b="(filepath || ':' || CAST(start_line AS VARCHAR) || ':' || name)"))


def entries_cte(name: str, expected: str) -> str:
    return f"""
{name} AS (
  SELECT k, filepath, seq, {CHUNK_ID_SQL} AS chunk_id, {DOCUMENT_SQL} AS document, {METADATA_SQL} AS metadata,
         start_line, name
  FROM {expected} WHERE NOT {is_blank('code')}
),
{name}_first AS (
  SELECT * FROM {name} QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY filepath, seq) = 1
)"""


_E = with_(CHUNKS, entries_cte("entries", "expected"))
SQL["index_nonblank"] = _E + "\nSELECT filepath, seq, chunk_id FROM entries"
SQL["index_document"] = _E + "\nSELECT filepath, seq, document FROM entries"
SQL["index_metadata"] = _E + "\nSELECT filepath, seq, metadata FROM entries"
SQL["index_chunk_id"] = _E + "\nSELECT filepath, seq, chunk_id FROM entries"
SQL["index_keep_first"] = _E + "\nSELECT chunk_id, filepath, seq FROM entries_first"
SQL["long_chunk_id"] = """
WITH ids AS (SELECT page_id, repeat(url, 2) AS filepath, CAST(page_id AS INTEGER) AS start_line, 'page' AS name
             FROM pages)
SELECT page_id, """ + CHUNK_ID_SQL + " AS chunk_id FROM ids"
SQL["stream_index_insert"] = _E + "\nSELECT chunk_id, document FROM entries_first"
SQL["index_reopen"] = _E + "\nSELECT chunk_id, filepath, start_line, name FROM entries_first"
SQL["job_index"] = _E + "\nSELECT chunk_id, document, metadata FROM entries_first"
_STORE = (CHUNKS, entries_cte("entries", "expected"), """
req AS (SELECT 'r' || CAST(item_id AS VARCHAR) AS request_id, text FROM benchmark)""",
          postings_cte("dpost", "entries_first", "chunk_id", "document"), postings_cte("qpost", "req", "request_id", "text"),
          sparse_pairs_cte("qpost", "dpost"))


def _store_sql(where: str = "TRUE") -> str:
    return with_(*_STORE, f"""
allpairs AS (
  SELECT b.request_id AS query_id, g.chunk_id AS entry_id, coalesce(p.distance, 2.0::DOUBLE) AS distance
  FROM req b CROSS JOIN (SELECT chunk_id FROM entries_first WHERE {where}) g
  LEFT JOIN pairs p ON p.query_id = b.request_id AND p.entry_id = g.chunk_id
)""", topk_cte("allpairs", 5), """
hits AS (
  SELECT t.query_id AS request_id, t.rank, t.entry_id AS chunk_id, t.distance, e.document, e.metadata
  FROM topk t JOIN entries_first e ON e.chunk_id = t.entry_id
)""")


SQL["store_query"] = _store_sql() + "\nSELECT request_id, rank, chunk_id, distance, document, metadata FROM hits"
SQL["store_query_where"] = _store_sql("""
  json_extract_string(metadata, '$.is_static') = 'false'
  AND coalesce(json_extract_string(metadata, '$.class_name'), '') <> 'Part2'
  AND coalesce(json_extract_string(metadata, '$.decorators'), '') <> 'property'""") + """
SELECT request_id, rank, chunk_id, distance FROM hits"""
SQL["store_query_nested"] = _store_sql() + """
SELECT request_id, string_agg(chunk_id, chr(10) ORDER BY rank) AS ids, string_agg(document, chr(10) ORDER BY rank) AS documents,
       string_agg(metadata, chr(10) ORDER BY rank) AS metadatas,
       string_agg(CAST(CAST(round(distance * 1e6) AS BIGINT) AS VARCHAR), ',' ORDER BY rank) AS distances_e6
FROM hits GROUP BY request_id"""
SQL["job_index_rejects"] = """
SELECT 'corpus/part_' || CAST(p_partkey AS VARCHAR) || '.py' AS filepath, 'syntax' AS reason FROM part WHERE p_partkey % 13 = 0"""
SQL["index_stats"] = _E + """
SELECT CAST(count(*) AS BIGINT) AS total_documents,
       array_to_string(json_keys(arg_min(metadata, chunk_id)), ',') AS sample_metadata_keys,
       'code_repository' AS collection_name
FROM entries_first"""
SQL["index_peek"] = _E + "\nSELECT chunk_id, metadata FROM entries_first ORDER BY chunk_id LIMIT 5"
_UPDATES = (CHUNKS, entries_cte("entries", "expected"), chunks_cte("expected_upd", "mods_upd", "'changed'"),
            entries_cte("upd_all", "expected_upd"), """
upd AS (
  SELECT chunk_id, document FROM upd_all WHERE k % 10 = 0
  QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY seq DESC, filepath DESC) = 1
),
upd_first AS (
  SELECT chunk_id, document FROM upd_all WHERE k % 10 = 0
  QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY filepath, seq) = 1
),
stored AS (
  SELECT chunk_id, document FROM entries WHERE k % 7 <> 0
  QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY filepath, seq) = 1
)""")
SQL["index_insert_new"] = with_(*_UPDATES) + """
SELECT chunk_id, document FROM stored
UNION ALL SELECT chunk_id, document FROM upd_first WHERE chunk_id NOT IN (SELECT chunk_id FROM stored)"""
SQL["index_upsert"] = with_(*_UPDATES) + """
SELECT chunk_id, document FROM stored WHERE chunk_id NOT IN (SELECT chunk_id FROM upd)
UNION ALL SELECT chunk_id, document FROM upd"""


# --- dense / filtered / nested search ------------------------------------------

def dense_sql(where: str = "TRUE", cut: str = "TRUE") -> str:
    return f"""
WITH pairs AS (
  SELECT q.vec_id AS query_id, d.vec_id AS entry_id,
         list_sum(list_transform(range(1, len(q.embedding) + 1),
                  lambda i: (CAST(q.embedding[i] AS DOUBLE) - CAST(d.embedding[i] AS DOUBLE))
                          * (CAST(q.embedding[i] AS DOUBLE) - CAST(d.embedding[i] AS DOUBLE)))) AS distance
  FROM embeddings q, (SELECT * FROM embeddings WHERE {where}) d
),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), entry_id) AS INTEGER)
           AS rank, entry_id, distance
  FROM pairs WHERE {cut}
  QUALIFY rank <= 5
)
SELECT query_id, rank, entry_id, round(distance, 6) AS distance FROM ranked"""


SQL["knn_dense"] = dense_sql()
SQL["knn_dense_filtered"] = dense_sql(where="label IN (1, 3, 5)", cut="distance <= 1.5")

SQL["knn_filtered"] = with_(CORPUS, """
corpus_q AS (SELECT c.* FROM corpus c JOIN labels l ON l.doc_id = c.doc_id WHERE l.quality = 1)""",
                            postings_cte("dpost", "corpus_q", "entry_id", "txt"),
                            postings_cte("qpost", "benchmark", "item_id", "text"),
                            sparse_pairs_cte("qpost", "dpost"), topk_cte("pairs", 5)) + """
SELECT query_id, rank, entry_id, distance FROM topk"""

SQL["knn_nested"] = with_(*_KNN_BASE, topk_cte("pairs", 5)) + """
SELECT query_id,
       string_agg(CAST(entry_id AS VARCHAR), ',' ORDER BY rank) AS entry_ids,
       string_agg(CAST(CAST(round(distance * 1e6) AS BIGINT) AS VARCHAR), ',' ORDER BY rank) AS distances_e6
FROM topk GROUP BY query_id"""


# --- file sources (2.A) --------------------------------------------------------

MODULE_SQL = (f"{lit('import os.path as osp' + chr(10) + 'from math import sqrt as root' + chr(10) + chr(10))} || "
              f"{_CLASS_CODE} || {NL} || {NL} || 'async def load_' || {_s('k')} || "
              f"{lit('(path, retries: int = 3):' + chr(10) + '    return await fetch(path)' + chr(10))}")
FILES = MODS + f""",
files AS (
  SELECT k,
         CASE WHEN k % 17 = 0 THEN '_private/part_' || {_s('k')} || '.py'
              WHEN k % 19 = 0 THEN 'part_' || {_s('k')} || '/__init__.py'
              ELSE 'part_' || {_s('k')} || '.py' END AS relpath,
         CASE WHEN k % 11 = 0 THEN '\\xFF'::BLOB || CAST({MODULE_SQL} AS BLOB)
              WHEN k % 13 = 0 THEN CAST('def (' || {MODULE_SQL} AS BLOB)
              ELSE CAST({MODULE_SQL} AS BLOB) END AS content
  FROM mods
)"""
SQL["scan_sources"] = "WITH " + FILES.strip("\n") + """
SELECT relpath, CAST(octet_length(content) AS BIGINT) AS n_bytes, md5(content) AS content_md5 FROM files"""
SQL["source_rejects"] = "WITH " + FILES.strip("\n") + """
SELECT relpath, CASE WHEN k % 11 = 0 THEN 'encoding' ELSE 'syntax' END AS reason
FROM files WHERE k % 11 = 0 OR k % 13 = 0"""


# --- streaming (J-3, J-4): same final tables as the batch jobs --------------------
SQL["stream_index_upsert"] = with_(*_UPDATES[:-1], _UPDATES[-1].split(",\nupd_first")[0]) + """
SELECT chunk_id, document FROM entries_first WHERE chunk_id NOT IN (SELECT chunk_id FROM upd)
UNION ALL SELECT chunk_id, document FROM upd"""

SQL["knn_fill"] = with_(postings_cte("dpost", "pages", "page_id", "url"),
                       postings_cte("qpost", "benchmark", "item_id", "text"), sparse_pairs_cte("qpost", "dpost"), """
allpairs AS (
  SELECT b.item_id AS query_id, g.page_id AS entry_id, coalesce(p.distance, 2.0::DOUBLE) AS distance
  FROM benchmark b CROSS JOIN pages g
  LEFT JOIN pairs p ON p.query_id = b.item_id AND p.entry_id = g.page_id
)""", topk_cte("allpairs", 5)) + """
SELECT query_id, rank, entry_id, distance FROM topk"""

SQL["knn_tfidf"] = with_(CORPUS, postings_cte("dpost", "corpus", "entry_id", "txt"),
                        postings_cte("qpost", "benchmark", "item_id", "text"), """
idf AS (
  SELECT bucket, ln((SELECT count(*) FROM corpus)::DOUBLE / count(*)) AS w FROM dpost GROUP BY bucket
),
dw AS (SELECT d.id, d.bucket, d.tf * i.w AS v FROM dpost d JOIN idf i USING (bucket)),
qw AS (SELECT q.id, q.bucket, q.tf * i.w AS v FROM qpost q JOIN idf i USING (bucket)),
dn AS (SELECT id, sum(v * v) AS n FROM dw GROUP BY id),
qn AS (SELECT id, sum(v * v) AS n FROM qw GROUP BY id),
dots AS (SELECT q.id AS query_id, d.id AS entry_id, sum(q.v * d.v) AS dot
         FROM qw q JOIN dw d USING (bucket) GROUP BY ALL),
pairs AS (
  SELECT p.query_id, p.entry_id, 2.0::DOUBLE - (2.0::DOUBLE * p.dot) / sqrt(a.n * b.n) AS distance
  FROM dots p JOIN qn a ON a.id = p.query_id JOIN dn b ON b.id = p.entry_id
  WHERE p.dot > 0
),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), entry_id) AS INTEGER)
           AS rank, entry_id, distance
  FROM pairs QUALIFY rank <= 5
)""") + """
SELECT query_id, rank, entry_id, round(distance, 6) AS distance FROM ranked"""

# Class-tagged methods sliced from the class text with file line numbers: the
# class starts on line 4, so a method spanning file lines s..e reads file
# lines s+3..e+3 cut at the class end; blank slices are dropped.
_CLASS_LINES = f"string_split({_CLASS_CODE}, chr(10))"


def _class_slice(start: str, end: str, margin: int) -> str:
    return (f"array_to_string(list_transform(list_slice({_CLASS_LINES}, {start}, {end}), "
            f"lambda l: substr(l, {margin + 1})), chr(10))")


SQL["chunk_methods_class_slice"] = with_(MODS, f"""
sliced AS (
  SELECT filepath, CAST(3 AS BIGINT) AS seq, '__init__' AS name, {_class_slice('6', '7', 4)} AS code
  FROM mods WHERE k % 7 <> 0
  UNION ALL
  SELECT filepath, CAST(4 AS BIGINT), 'label', {_class_slice('9', '11', 4)} FROM mods WHERE k % 7 <> 0
  UNION ALL
  SELECT filepath, CAST(5 AS BIGINT), 'scale', {_class_slice('12', '10 + 2 * m + e', 8)} FROM mods WHERE k % 7 <> 0
)""") + """
SELECT filepath, seq, name, code FROM sliced WHERE length(code) > 0"""

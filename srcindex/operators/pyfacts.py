"""The only per-row Python step of the engine: walking a Python syntax tree.

``module_record(code)`` parses one module with the standard ``ast`` module and
returns everything that is known about it in one nested record: its imports and,
in breadth-first walk order, its definitions with their references, signature,
class context and the imports they use. Whatever needs the whole file is settled
here, while the file is at hand; ``parsed_rows`` hands the records to Spark as one
Arrow row per definition (see :mod:`srcindex.operators.chunks`).

``source_facts(code)`` is the same record as flat rows tagged by ``kind``, for
SQL's ``LATERAL py_facts(code)``: ``def``, ``call`` / ``attr`` / ``raise``
(distinct names in a function's body statements, nested code included),
``branch`` (``ord`` = branch nodes anywhere in it), ``decorator`` / ``param`` /
``returns`` / ``base`` (ordered signature parts), ``import`` (``def_id = -1``) and
``error`` (``value`` = reason).
"""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql.functions import udtf

FACT_SCHEMA = (
    "kind string, def_id int, parent_id int, ord int, name string, value string, "
    "detail string, tag string, start_line int, end_line int, docstring string, src string"
)

#: One row per definition, import name or unreadable module.
ROW_SCHEMA = (
    "kind string, def_id int, parent_id int, type string, name string, value string, start_line int, end_line int, "
    "docstring string, src string, calls array<string>, attrs array<string>, raises array<string>, decorators array<string>, "
    "is_static boolean, is_classmethod boolean, is_property boolean, "
    "parameters array<struct<name:string,type:string,default:string,kind:string>>, returns string, branches int, "
    "imports_used array<string>, bases array<string>, methods array<string>, "
    "class_name string, class_docstring string, class_has_bases boolean, src_in_class string"
)

_FUNCS = (ast.FunctionDef, ast.AsyncFunctionDef)
_DEFINED = frozenset((*_FUNCS, ast.ClassDef))
#: Branch nodes; a BoolOp stands for the And or Or that it holds.
_BRANCHES = frozenset((ast.If, ast.While, ast.For, ast.AsyncFor, ast.ExceptHandler, ast.BoolOp))
#: What needs no visit: plain values, names, constants, contexts and operators.
_LEAVES = frozenset((str, int, bool, bytes, type(None), ast.Name, ast.Constant,
                     *(k for base in (ast.expr_context, ast.boolop, ast.operator, ast.unaryop, ast.cmpop) for k in base.__subclasses__())))


class _Fields(dict):
    """The fields of a kind of node that can hold nodes to visit."""

    PLAIN = frozenset(("ctx", "op", "ops", "id", "attr", "arg", "name", "names", "type_comment", "asname", "module", "level", "kind", "rest", "conversion"))

    def __missing__(self, kind: type) -> tuple[str, ...]:
        self[kind] = fields = tuple(f for f in kind._fields if f not in self.PLAIN)
        return fields


_FIELDS = _Fields()


# --- text of expressions ----------------------------------------------------------

def dotted(node: ast.expr) -> str | None:
    """A name or an attribute chain as written, else None.

    The chain is followed down to what it hangs on: a name stands for itself, a call
    of something dotted for that with ``()``, any other call for ``<call>``, anything
    else for ``<expr>``.
    """
    trail: list[str] = []
    while isinstance(node, ast.Attribute):
        trail.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        trail.append(node.id)
    elif not trail:
        return None
    elif isinstance(node, ast.Call):
        called = dotted(node.func)
        trail.append(called + "()" if called else "<call>")
    else:
        trail.append("<expr>")
    return ".".join(reversed(trail))


def expression_text(node: ast.expr | None, subscripts: bool = False) -> str | None:
    """``ast.unparse`` with the deviations of this data model.

    Dotted forms as in ``dotted``; constants by ``repr``; with ``subscripts`` (for
    annotations) the parts of ``x[y]`` follow the same rules, so a tuple inside keeps
    its brackets.
    """
    if node is None:
        return None
    if isinstance(node, ast.Constant):
        return repr(node.value)
    if subscripts and isinstance(node, ast.Subscript):
        outer, inner = (expression_text(part, True) for part in (node.value, node.slice))
        return f"{outer}[{inner}]"
    return dotted(node) or ast.unparse(node)


def decorator_text(node: ast.expr) -> str | None:
    """Dotted decorators as written, calls of dotted ones with ``()``; others have no text."""
    if isinstance(node, ast.Call):
        inner = dotted(node.func)
        return inner and inner + "()"
    return dotted(node)


# --- one module -----------------------------------------------------------------------

def _parameters(args: ast.arguments) -> list[dict]:
    """Ordinary arguments, to whose end the defaults belong, then ``*args`` and ``**kwargs``."""
    defaults = [None] * len(args.args) + list(args.defaults)
    rows = [("", "positional", a, d) for a, d in zip(args.args, defaults[len(args.defaults):])]
    rows += [("*", "var_positional", args.vararg, None)] * bool(args.vararg)
    rows += [("**", "var_keyword", args.kwarg, None)] * bool(args.kwarg)
    return [{"name": mark + a.arg, "type": expression_text(a.annotation, True), "default": expression_text(d), "kind": kind}
            for mark, kind, a, d in rows]


def _imported(node: ast.Import | ast.ImportFrom) -> list[tuple[str, str]]:
    """(alias, full name) of an import statement; relative dots are not part of the name."""
    source = getattr(node, "module", None)
    return [(a.asname or a.name, ".".join(filter(None, (source, a.name)))) for a in node.names]


def _definition(node, def_id: int, parent: dict | None, lines: list[str]) -> dict:
    out = {"def_id": def_id, "parent_id": parent and parent["def_id"], "type": type(node).__name__, "name": node.name,
           "start_line": node.lineno, "end_line": node.end_lineno, "docstring": ast.get_docstring(node),
           "src": "\n".join(lines[node.lineno - 1:node.end_lineno])}
    texts = [(i, decorator_text(d), isinstance(d, ast.Name)) for i, d in enumerate(node.decorator_list)]
    out["marks"] = [t for t in texts if t[1] is not None]
    out["decorators"] = [t for _, t, _ in out["marks"]]
    plain = {t for _, t, bare in texts if bare}
    out |= {"is_static": "staticmethod" in plain, "is_classmethod": "classmethod" in plain, "is_property": "property" in plain}
    if isinstance(node, ast.ClassDef):
        out["base_places"] = [(i, t) for i, b in enumerate(node.bases) if isinstance(b, (ast.Name, ast.Attribute)) and (t := dotted(b))]
        out["bases"] = [t for _, t in out["base_places"]]
        out["methods"] = [item.name for item in node.body if isinstance(item, _FUNCS)]
        return out
    out |= {"parameters": _parameters(node.args), "returns": expression_text(node.returns, True)}
    if parent:
        above = parent["start_line"] - 1  # file lines applied to the class text
        inside = lines[above + node.lineno - 1:min(above + node.end_lineno, parent["end_line"])]
        out |= {"class_name": parent["name"], "class_docstring": parent["docstring"], "class_has_bases": bool(parent["bases"]),
                "src_in_class": "\n".join(inside)}
    return out


class _Names:
    """What a function's statements call, access and raise, and the branch nodes anywhere in it."""

    __slots__ = ("made", "call", "attr", "raised", "branches", "around", "holder")

    def __init__(self, made: dict, around: _Names | None, holder: _Names | None):
        self.made, self.around, self.holder = made, around, holder  # around: whose statements it is in; holder: whom it is anywhere in
        self.call, self.attr, self.raised, self.branches = set(), set(), set(), 0

    def close(self) -> None:
        """Hand what was found to the definition, and on to the functions around it."""
        self.made |= {"calls": sorted(self.call), "attrs": sorted(self.attr), "raises": sorted(self.raised), "branches": self.branches}
        if self.around:
            self.around.call |= self.call
            self.around.attr |= self.attr
            self.around.raised |= self.raised
        if self.holder:
            self.holder.branches += self.branches


def _record(code: str) -> dict:
    """One walk, breadth first as ``ast.walk``: every node is met once, with the functions whose statements (``names``)
    and whose nodes (``inside``) it is among; what they hold is added up from the innermost outwards at the end."""
    tree, lines = ast.parse(code), code.split("\n")
    statements: list[tuple[str, str, str]] = []
    found: list[dict] = []
    functions: list[_Names] = []
    owner: dict[int, dict] = {}
    waiting: list[tuple[ast.AST, _Names | None, _Names | None]] = [(tree, None, None)]
    for node, names, inside in waiting:  # grows while it is read
        kind = type(node)
        if kind in _BRANCHES and inside:
            inside.branches += 1
        if names:
            if kind is ast.Attribute:
                names.attr.add(dotted(node))
            elif kind is ast.Call:
                called = dotted(node.func)
                if called is not None:
                    names.call.add(called)
            elif kind is ast.Raise:
                exc = node.exc.func if isinstance(node.exc, ast.Call) else node.exc
                if isinstance(exc, ast.Name):
                    names.raised.add(exc.id)
        if kind is ast.Import or kind is ast.ImportFrom:
            statements += [(alias, full, "import" if kind is ast.Import else "from") for alias, full in _imported(node)]
            continue
        own = None
        if kind in _DEFINED:
            made = _definition(node, len(found), owner.get(id(node)), lines)
            found.append(made)
            if kind is ast.ClassDef:
                owner |= {id(item): made for item in node.body if isinstance(item, _FUNCS)}
            else:
                own = _Names(made, names, inside)
                functions.append(own)
                inside = own
        for field in _FIELDS[kind]:
            value = getattr(node, field, None)
            among = own if own and field == "body" else names
            if type(value) is list:
                waiting += [(v, among, inside) for v in value if type(v) not in _LEAVES]
            elif type(value) not in _LEAVES:
                waiting.append((value, among, inside))
    for f in reversed(functions):
        f.close()
    # one meaning per alias: the last statement's, from-imports before plain ones
    imports = {alias: full for wanted in ("import", "from") for alias, full, tag in statements if tag == wanted}
    for d in found:
        if "calls" in d:
            refs = (*d["calls"], *d["attrs"])
            d["imports_used"] = sorted({full for alias, full in imports.items() if any(r.startswith(alias) for r in refs)})
    return {"statements": statements, "imports": imports, "defs": found}


def module_record(code: str) -> dict:
    """All or nothing: a module that cannot be parsed or walked has only ``error`` (reason, detail)."""
    try:
        return _record(code)
    except SyntaxError as e:
        return {"error": ("syntax", str(e))}
    except (RecursionError, MemoryError, ValueError) as e:
        return {"error": (type(e).__name__, str(e))}


# --- rows for Spark ------------------------------------------------------------------

def parsed_rows(code: str) -> list[dict]:
    """Rows of ROW_SCHEMA of one module."""
    m = module_record(code)
    if "error" in m:
        return [{"kind": "error", "value": m["error"][0]}]
    return [{"kind": "import", "name": alias, "value": full} for alias, full in m["imports"].items()] + [{"kind": "def"} | d for d in m["defs"]]


def source_facts(code: str) -> list[tuple]:
    """Flat rows of FACT_SCHEMA of one module."""
    columns = [c.split()[0] for c in FACT_SCHEMA.split(", ")]
    m = module_record(code)
    rows: list[dict] = []
    if "error" in m:
        rows.append({"kind": "error", "def_id": -1, "value": m["error"][0], "detail": m["error"][1]})
        return [tuple(r.get(c) for c in columns) for r in rows]
    rows += [{"kind": "import", "def_id": -1, "ord": i, "name": alias, "value": full, "tag": tag}
             for i, (alias, full, tag) in enumerate(m["statements"])]
    for d in m["defs"]:
        me = {"def_id": d["def_id"]}
        rows.append({c: d.get(c) for c in ("def_id", "parent_id", "name", "start_line", "end_line", "docstring", "src")}
                    | {"kind": "def", "value": d["type"]})
        rows += [me | {"kind": "decorator", "ord": i, "name": t, "tag": "bare" if bare else None} for i, t, bare in d["marks"]]
        rows += [me | {"kind": "base", "ord": i, "name": t} for i, t in d.get("base_places", ())]
        if "calls" in d:
            rows += [me | {"kind": kind, "name": n} for kind, key in (("call", "calls"), ("attr", "attrs"), ("raise", "raises")) for n in d[key]]
            rows += [me | {"kind": "param", "ord": i, "name": p["name"], "value": p["type"], "detail": p["default"], "tag": p["kind"]}
                     for i, p in enumerate(d["parameters"])]
            if d["returns"] is not None:
                rows.append(me | {"kind": "returns", "value": d["returns"]})
            rows.append(me | {"kind": "branch", "ord": d["branches"]})
    return [tuple(r.get(c) for c in columns) for r in rows]


def arrow_schema(kinds: str = ROW_SCHEMA) -> pa.Schema:
    strings = pa.list_(pa.string())
    parameter = pa.struct([(f, pa.string()) for f in ("name", "type", "default", "kind")])
    known = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": strings}
    return pa.schema([(name, known.get(kind, pa.list_(parameter))) for name, kind in (c.split(" ", 1) for c in kinds.split(", "))])


@udtf(returnType=FACT_SCHEMA, useArrow=False)
class PyFacts:
    """Table function for SQL: ``LATERAL py_facts(code)`` -> flat rows of one module."""

    def eval(self, code: str):
        if code is None:
            return
        yield from source_facts(code)

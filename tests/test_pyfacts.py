"""The AST walker alone (pure Python): every rule of the definition walk."""

from collections import Counter

from srcindex.operators.pyfacts import source_facts


def facts(code):
    return list(source_facts(code))


def defs(code):
    return [r for r in facts(code) if r[0] == "def"]


def of(code, kind, def_id=None):
    return [r for r in facts(code) if r[0] == kind and (def_id is None or r[1] == def_id)]


def names(code, kind, def_id):
    return sorted({r[4] for r in of(code, kind, def_id)})


def test_breadth_first_order_and_parents():
    code = "class A:\n    def m(self):\n        def inner():\n            pass\n    class B:\n        def n(self): pass\ndef f(): pass\n"
    d = defs(code)
    assert [(r[1], r[4]) for r in d] == [(0, "A"), (1, "f"), (2, "m"), (3, "B"), (4, "inner"), (5, "n")]
    parent = {r[4]: r[2] for r in d}
    assert parent == {"A": None, "f": None, "m": 0, "B": None, "inner": None, "n": 3}


def test_line_span_excludes_decorators_and_raw_slice():
    code = "@dec\n@other(1)\ndef f(x):\n    return x\n"
    (d,) = defs(code)
    assert (d[8], d[9]) == (3, 4)
    assert d[11] == "def f(x):\n    return x"


def test_decorator_forms():
    code = "@a\n@m.b\n@c()\n@m.d(1)\n@x[0]\n@(lambda f: f)\ndef f(): pass\n"
    decos = [(r[3], r[4], r[7]) for r in of(code, "decorator")]
    assert decos == [(0, "a", "bare"), (1, "m.b", None), (2, "c()", None), (3, "m.d()", None)]


def test_branches_count_boolop_once():
    code = ("def f(a, b, c):\n    if a and b and c:\n        pass\n    elif a or b:\n        pass\n"
            "    for x in a:\n        pass\n    while b:\n        break\n    try:\n        pass\n"
            "    except ValueError:\n        pass\n    except KeyError:\n        pass\n"
            "    y = [i for i in a if i]\n    z = 1 if a else 2\n")
    # if, elif(if), and-op, or-op, for, while, 2 handlers = 8; comprehension / ternary not counted
    assert [r[3] for r in of(code, "branch")] == [8]


def test_async_for_and_match_not_counted():
    code = "async def g(x):\n    async for i in x:\n        pass\n    match x:\n        case 1:\n            pass\n"
    assert [r[3] for r in of(code, "branch")] == [1]


def test_parameters_rules():
    code = "def f(a, /, b, c=1, *args, d, e=2, **kw): pass\n"
    params = [(r[3], r[4], r[5], r[6], r[7]) for r in of(code, "param")]
    # positional-only and keyword-only are left out; defaults right-aligned over args
    assert params == [(0, "b", None, None, "positional"), (1, "c", None, "1", "positional"),
                      (2, "*args", None, None, "var_positional"), (3, "**kw", None, None, "var_keyword")]


def test_defaults_text():
    code = "def f(a='s', b=None, c=os.sep, d=x, e=[1, 2]): pass\n"
    assert [r[6] for r in of(code, "param")] == ["'s'", "None", "os.sep", "x", "[1, 2]"]


def test_annotations_text():
    code = ("def f(a: Dict[str, int], b: 'Fwd', c: None, d: typing.List[int], e: int | None)"
            " -> Optional[str]: pass\n")
    assert [r[5] for r in of(code, "param")] == ["Dict[(str, int)]", "'Fwd'", "None", "typing.List[int]",
                                                 "int | None"]
    assert of(code, "returns")[0][5] == "Optional[str]"


def test_call_and_attribute_names():
    code = "def f():\n    f2()()\n    x[0]()\n    g().a.b\n    x[0].a\n    self.v = 1\n    h().k()\n"
    calls = names(code, "call", 0)
    attrs = names(code, "attr", 0)
    assert calls == ["f2", "g", "h", "h().k"]
    assert attrs == ["<expr>.a", "g().a", "g().a.b", "h().k", "self.v"]


def test_unnamed_call_attribute():
    code = "def f():\n    (a or b)().x\n"
    assert names(code, "attr", 0) == ["<call>.x"]


def test_raise_forms():
    code = "def f():\n    raise X\n    raise Y()\n    raise m.Z()\n    raise\n"
    assert names(code, "raise", 0) == ["X", "Y"]


def test_body_only_for_refs_but_whole_node_for_branches():
    code = "@deco(a.b)\ndef f(x=g(y.z)):\n    pass\n"
    assert of(code, "call", 0) == [] and of(code, "attr", 0) == []


def test_imports_relative_star_duplicates():
    code = "import a.b\nimport c as d\nfrom . import e\nfrom ..p import q as r\nfrom s import *\nimport c as d2\ndef f():\n    import t\n"
    imps = [(r[3], r[4], r[5], r[7]) for r in of(code, "import")]
    assert (0, "a.b", "a.b", "import") in imps
    assert (1, "d", "c", "import") in imps
    assert (2, "e", "e", "from") in imps
    assert (3, "r", "p.q", "from") in imps
    assert (4, "*", "s.*", "from") in imps
    assert any(r[1] == "t" for r in imps)


def test_bases_name_dotted_only():
    code = "class A(B, m.C, G[int], metaclass=M): pass\n"
    assert [(r[3], r[4]) for r in of(code, "base")] == [(0, "B"), (1, "m.C")]


def test_docstrings():
    code = 'def f():\n    """"""\ndef g():\n    """\n    Text.\n      more\n    """\ndef h(): pass\n'
    d = {r[4]: r[10] for r in defs(code)}
    assert d == {"f": "", "g": "Text.\n  more", "h": None}


def test_parse_errors_become_rows():
    for code, reason in [("\ufeffx = 1\n", "syntax"), ("x = 1\x00\n", "syntax"), ("def (:\n", "syntax")]:
        rows = facts(code)
        assert rows and rows[0][0] == "error" and rows[0][5] == reason, code


def test_deep_nesting_is_reported_not_raised():
    code = "x = " + "(" * 5000 + ")" * 5000 + "\n"
    rows = facts(code)
    assert rows[0][0] == "error"


def test_kinds_counter_on_sample():
    code = "import os\nclass K(Base):\n    def m(self):\n        return os.path.join(self.a)\n"
    c = Counter(r[0] for r in facts(code))
    assert c["def"] == 2 and c["import"] == 1 and c["base"] == 1


def test_walker_failure_is_one_error_row(monkeypatch):
    import srcindex.operators.pyfacts as P

    def boom(node):
        raise RecursionError("too deep")
    monkeypatch.setattr(P, "dotted", boom)
    rows = facts("def f():\n    a.b\n")
    assert len(rows) == 1 and rows[0][0] == "error" and rows[0][5] == "RecursionError"


def test_nested_functions_are_walked_once(monkeypatch):
    """Every function holds the names of those inside it, and yet no node is read twice."""
    from srcindex.operators import pyfacts as P
    depth, seen, real = 40, [], P.dotted
    code = "".join(f"{' ' * i}def f{i}(a=g{i}.d):\n{' ' * i} x{i}.y()\n{' ' * i} if p: raise E{i}\n" for i in range(depth))
    monkeypatch.setattr(P, "dotted", lambda node: seen.append(node) or real(node))
    found = P.module_record(code)["defs"]
    assert [len(d["raises"]) for d in found] == [depth - i for i in range(depth)]
    assert [d["branches"] for d in found] == [depth - i for i in range(depth)]
    assert found[0]["calls"] == sorted(f"x{i}.y" for i in range(depth))
    # a default belongs to the statements around its function, not to its own
    assert found[-1]["attrs"] == [f"x{depth - 1}.y"] and f"g{depth - 1}.d" in found[-2]["attrs"] and "g0.d" not in found[0]["attrs"]
    assert len(seen) <= 6 * depth

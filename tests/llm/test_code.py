"""Syntax by derivatives, documentation, hand-written files."""

import ast
import random
import string
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.llm.derivatives import Grammar
from loomline.llm.descriptions import description
from loomline.llm.functions import component_function, documented_functions, find_functions, function_pairs
from loomline.llm.handwritten import FEATURES, forest_quality, not_handwritten, notices, path_evidence, shape
from loomline.llm.parsing import broken_rates, syntax_errors
from loomline.llm.syntax import first_error

GOOD = {
    "python": [
        "x = 1\nif x:\n    y = {'a': [1, 2], **k}\nelse:\n    pass\n", "async def f(a, /, b: int = 1, *c, d=2, **e) -> None:\n    async with x as y, z:\n        await g(*a, **b)\n    return [i async for i in a if i]\n",
        "match x:\n    case {'a': [1, *r], **k} if r:\n        pass\n    case A.B(x=1) | None as n:\n        pass\nmatch = 1\nprint(match)\n", "@d(1)\nclass A[T](B, metaclass=M):\n    x: int = 3\n    def f(self): return lambda *a, k=1: (yield)\n",
        "s = f'{x!r:>{w}} {\"q\"} {{}}' 'b'\nt = '''a\nb'''\nif (n := 3) > 2: pass; x = 1\n", "def f():\n\tif 1:\n\t\treturn\n\n# c\n\treturn 2", "x = 1 if y else (2,)\nfor i, *j in z: break\nelse: pass\ntry: a\nexcept* E as e: b\nfinally: c\n",
        "del a[1:2, ::3], b.c\nassert x, 'm'\nglobal g\nraise E from None\nx: int\ny += yield\nimport a.b as c\nfrom . import (d as e,)\n", "\ufeffx = '{ not a block'\n",
    ],
    "javascript": [
        "import a, { b as c } from './x'; import * as n from 'y'\nexport default class A extends B { #p = 1; static async *m({ a, b = 2 }, ...c) { yield* a } get x() { return this.#p } static { f() } }\n",
        "const f = async (a, [b], { c }) => ({ a, [b]: 1, ...c })\nlet r = /[/{(]+/g.test(`a${`b${1}`}c`) ? a ?? b : x?.y?.[0]?.()\n", "for (const x of y) { if (x) continue; else break }\nfor (let i = 0, n = 3; i < n; i++) ;\nlabel: do { x++ } while (x)\nreturn_: switch (a) { case 1: default: }\n",
        "a = b\n++c\nvar d = function* () {}\nexport { d as default }\nexport * from 'z'\nif (a) b; else c\ntry { } catch { } finally { }\nnew Foo\nnew (a.b)(c)\nx = y / z / 2\n", "!function(t){\"use strict\";t.a=[1,2]}(this);var d=(w,n)=>w?n.index:void 0;try{v.w=!0}catch(t){}\n",
        "export const data = [\n  0x1, -2.5e3, 'a\\'b', \"<<<<<<< ours\",\n];\n", "async function f() { for await (const x of y) await x }\nconst { a = 1, ...b } = c\nthrow new Error(`x`)\n",
    ],
    "typescript": [
        "import type { A } from './a';\nexport interface B<T extends object = {}> extends A, C<T> { readonly x?: number; [k: string]: any; m<U>(a: U): void; new (x: string): B<T>; }\n",
        "type X<T> = T extends (infer U)[] ? U : { [K in keyof T]?: T[K] } | 'a' | -1 | [a: string, ...b: number[]] | (() => void) | typeof x;\nenum E { A = 1, B, 'c' }\ndeclare module 'm' { const x: number; }\n",
        "export abstract class A<T> extends B<T> implements C, D { private readonly x: Map<string, Array<number>> = new Map<string, Array<number>>(); constructor(private y?: T, public z = 1) { super() } abstract m(): void; get v(): number { return this.x as any } }\n",
        "function f(this: Window, a: number, b?: string): a is string;\nfunction f<T,>(x: T) { return x!.y satisfies Z as const }\nconst g = <T,>(a: T): T => a, h = async (x: number): Promise<void> => {};\nlet z = a < b && c > d, w = f<number>(1)\n",
        "namespace N.M { export import X = Y.Z; }\n@dec() class Q { @Input() p!: string; static #s?: number }\nlet u: unique symbol, t: `a${string}`\nabstract class R { }\n",
    ],
    "java": [
        "package a.b;\nimport static x.Y.*;\n@A(v = {1, 2})\npublic final class C<T extends D & E> extends F<T> implements G, H<? super T> {\n  private final Map<String, List<int[]>> m = new HashMap<>();\n  static { x(); }\n  C(int... a) throws E { this(1); }\n  <U> U f(final U u) { return (U) (Object) u; }\n}\n",
        "class A { void f() { for (String s : m.keySet()) { try (var r = o(); s) { } catch (X | Y e) { } finally { } }\n int x = a ? b : c -> d; Runnable q = () -> { }; var z = List::of; int[] y = {1, 2,}; long n = a.stream().filter(it -> it != null).count();\n switch (x) { case 1, 2 -> f(); default -> { } } do { } while (i++ < 3); label: for (;;) break label; } }\n",
        "enum E implements I { A(1) { void g() { } }, B; int v; E(int... x) { } }\nrecord R<T>(int a, @N T b) { R { } static int c; }\nsealed interface S permits R { default void m() { } int K = 1 >>> 2; }\n@interface Z { String v() default \"\"; }\n",
        "class T { String s = \"\"\"\n  a \"b\"\n  \"\"\"; char c = '{'; int f(Object o) { if (o instanceof String t && t.length() > 1) return 1; return switch (o) { case Integer i when i > 0 -> 1; case R(int a, var b) -> 2; default -> { yield 3; } }; } }\n",
    ],
    "go": [
        "package a\n\nimport (\n\t\"log\"\n\tx \"y/z\"\n)\n\ntype T struct {\n\ta, b int `json:\"x\"`\n\t*E\n\tp.Q\n}\n\nfunc (t *T) F(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[a]; ok && v != (T{1}) {\n\t\treturn v, nil\n\t} else if x {\n\t}\n\tfor i := range y {\n\t}\n\tfor {\n\t}\n\tgo func() { <-c }()\n\tdefer x.Close()\n\treturn\n}\n",
        "package m\nconst (\n\tA = iota\n\tB\n)\nvar x, y = map[string][]int{\"a\": {1, 2}, \"b\": nil}, []byte(`raw {`)\ntype N[K comparable, V ~int | string] interface {\n\tM(K) V\n\terror\n}\nfunc G[T any](a T) chan<- T {\n\tswitch z := a.(type) {\n\tcase int, string:\n\t\tfallthrough\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-c:\n\t\tx[1:2:3] = v\n\tcase d <- 1:\n\t}\nL:\n\tgoto L\n}\n",
        "package data\n\nvar Rows = []Row{\n\t{1, \"a\", 0.5},\n}\nvar r = '{'\n",
    ],
}
BAD = {
    "python": ["def f(:\n  pass\n", "if x\n  y\n", "x = (1,\n", "  x = 1\n", "if 1:\n        a\n    b\n", "print 'x'\n", "<<<<<<< HEAD\nx = 1\n", "x = 'a\n", "return {{ a.b }}(x):\n", "const x = 1;\n", "a = 08\n", "class A:\n"],
    "javascript": ["function f( {\n", "const x: number = 1;\n", "a b\n", "{ \"a\": 1 }\n", "x = `a\n", "x = 'a\n", "<<<<<<< HEAD\n", "return {{ a }}(b) {\n", "interface A { x: string }\n", "def f():\n    pass\n", "class A { m( }\n", "<!DOCTYPE html>\n", "package a\nimport x\n"],
    "typescript": ["function f(a: ) {}\n", "type = ;\nx y\n", "class A { x: number y: number }\n", ">>>>>>> theirs\n", "let x: Map<string = 1;\n", "package a.b;\n", "<!DOCTYPE html>\n", "please do not merge yet - x\n"],
    "java": ["class A { void f( { } }\n", "class A { int x = ; }\n", "import { a } from 'b';\n", "class A { String s = \"a; }\n", "class A {\n=======\n}\n", "class A { } }\n", "public Object {{ a }}(int b) { }\n", "class A { char c = 'ab'; }\n"],
    "go": ["import \"x\"\n", "package a\nfunc f( {\n}\n", "package a\nfunc f() {\n", "package a\n=======\n", "package a\nvar x = \"a\n", "package a;\nclass B {}\n", "package a\nfunc f() { x y }\n", "package a\nvar x = []int{\n1\n}\n"],
}


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, v in GOOD.items() for t in v])
def test_valid_texts(language, text):
    assert first_error(text, language) is None
    assert first_error(text.replace("\n", "\r\n"), language) is None or language == "java"


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, v in BAD.items() for t in v])
def test_invalid_texts(language, text):
    assert first_error(text, language) is not None


def test_kinds_of_errors():
    assert first_error("def f():\n    x = (1 +\n", "python")[0] == "end"
    assert first_error("x = )\n", "python") == ("token", 4, ")")
    assert first_error(None, "go") is None and first_error(" \n", "java") is None


@settings(max_examples=150, deadline=None)
@given(st.randoms(use_true_random=False), st.sampled_from(range(len(GOOD["python"]))))
def test_damaged_python_agrees_with_the_parser(rng: random.Random, k):
    text = GOOD["python"][k].lstrip("\ufeff")
    at = rng.randrange(len(text))
    text = text[:at] + rng.choice(["", "(", ")", "'", ":", " ", "\n", "x"]) + text[at + rng.choice([0, 1]) :]
    try:
        ast.parse(text)
        valid = True
    except (SyntaxError, ValueError):
        valid = False
    if not valid:
        return  # the grammar accepts a little more than the language (see the module)
    assert first_error(text, "python") is None


def test_library_sources_are_valid():
    import pathlib

    some = sorted(pathlib.Path(ast.__file__).parent.glob("*.py"))[:40]
    assert [p.name for p in some if first_error(p.read_text("utf-8", "replace"), "python") is not None] == []


def test_forgetting_within_a_file(monkeypatch):
    from loomline.llm import derivatives

    monkeypatch.setattr(derivatives, "MOST_NODES", 10)
    g = Grammar("E = T { ( '+' | '-' ) T } ; T = F { '*' F } ; F = ID | '(' E ')' ;", "E")
    long = ["(", "ID", "*", "(", "ID", ")", "-", "ID", ")", "+"] * 3000 + ["ID"]
    assert g.recognise(long) is None and g.recognise([*long, ")"]) == len(long) and len(g.table) < 2000


def test_grammar_notation():
    g = Grammar("E = T { ( '+' | '-' ) T } ; T = F { '*' F } ; F = ID | '(' E ')' ;", "E")
    assert g.recognise(["ID", "+", "(", "ID", ")"]) is None and g.recognise(["ID", "*"]) == 2 and g.recognise(["ID", ")"]) == 1
    with pytest.raises(ValueError):
        Grammar("E = [ 'a' ] E 'b' ;", "E")
    deep = ["("] * 3000 + ["ID"] + [")"] * 3000
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 100_000))
    assert g.recognise(deep) is None


FILES = "relative_path string, repo_name string, file_text string, language string, broken string"


def test_syntax_errors(spark, rows):
    df = spark.createDataFrame([
        ("r/a.py", "r", "x = 1\n", "java", "c"), ("r/b.py", "r", "x = (\n", None, "c"), ("r/b.py", "r", "x = (\n", None, "c"), ("r/c.go", "r", None, "go", "c"), ("r/d.txt", "r", "(((", None, "c"),
        ("r/e.mjs", "r", "\ufeffconst a = 1", None, "c"), ("r/f.ts", "r", "", None, "c"), (None, "r", "x", None, "c"), ("r/g.JAVA", None, "class A {", None, "c"),
    ], FILES)
    assert rows(syntax_errors(df), "relative_path", "broken", "kind") == [("r/a.py", False, None), ("r/b.py", True, "end"), ("r/e.mjs", False, None), ("r/g.JAVA", True, "end")]
    rates = {(r["repo_name"], r["language"]): (r["n_files"], r["n_broken"]) for r in broken_rates(df).collect()}
    assert rates == {("r", "python"): (2, 1), ("r", "javascript"): (1, 0), (None, "java"): (1, 1)}
    assert syntax_errors(df.where("false")).count() == 0


@pytest.mark.parametrize("text", [
    "Safe to call twice.", "/** Counts each row once, even if it came twice. */", "// Not reentrant; take the lock first.", "当记录超过 8 条时分批提交。", "TODO(me): tune it. Until then each row is read twice.", "Fasst doppelte Einträge zusammen.",
    "Merges rows.\n\n@param a the first row", ":param load: the channel to start from",
])
def test_documentation(text):
    assert description(text, "K.load_orders", ["load", "size"])


@pytest.mark.parametrize("text", [
    None, "", "TODO", "TODO: document", "FIXME", "XXX", "tbd", "n/a", "None", "...", "-", "----------", "Placeholder", "Not documented yet.", "Noch nicht dokumentiert.", "À compléter", "待补充", "{@inheritDoc}", "@see Foo", "See above.",
    "Load orders.", "loads the orders", "load_orders load_orders()", "The load_orders function.", "Description of load_orders.", "@param load\n@return", ":param load:\n:return:", "Args:\n    load:\n    size:", "@param load the load\n@return the result",
    "noqa: E501 pylint: disable=x", "noinspection unused", "Copyright 2020 the authors. All rights reserved.", "return a.b", "for (x of y) { x += 1; }\nreturn y;", "load = size", "Auto-generated method stub", "This function does what its name says.",
    "/** */", "// -", "TODO write documentation for this method, see the team",
])
def test_no_documentation(text):
    assert not description(text, "K.load_orders", ["load", "size"])


PY = '# above\n# it all matters here\n@dec(\n  1)\ndef f(a,\n      b):\n    """Reads the rows\n    again."""\n    return """\ndef no(): pass\n"""\n\nclass C:\n    def g(self): pass\n\n    # detached comment words\n\n    def h(self):\n        # inside words here\n        return 1\n'
JS = "/**\n * Splits it at the borders.\n */\nexport async function f(a) {\n  if (a) {\n  }\n}\n\nclass A {\n  // Keeps the order of arrival.\n  static m(x) {\n    return '}';\n  }\n}\nconst g = (a) => {\n};\n"


def test_find_functions():
    got = [(f.name, f.start, f.end) for f in find_functions(PY, "py")]
    assert got == [("f", 5, 11), ("g", 14, 14), ("h", 18, 20)]
    f, g, h = find_functions(PY, "py")
    assert "Reads the rows" in f.comment and g.comment == "" and h.comment == ""
    got = {f.name: (f.start, f.end, f.comment) for f in find_functions(JS, "js")}
    assert got["f"][:2] == (4, 7) and "Splits it" in got["f"][2] and got["m"][:2] == (11, 13) and "Keeps" in got["m"][2] and got["g"][:2] == (15, 16)
    rb = "# Adds both numbers up.\ndef add(a)\n  if a\n    1\n  end\nend\nx\n"
    assert [(f.name, f.start, f.end) for f in find_functions(rb, "rb")] == [("add", 2, 6)]
    assert list(find_functions(None, "py")) == list(find_functions("x", "zz")) == []
    f = component_function("// Waits for it.\nfunc (s *T) Run(a int) error {\n\treturn nil\n}\nvar x = 1", "go", "T.Run")
    assert f.above == "// Waits for it." and f.code.endswith("return nil\n}") and component_function(None, "go") is None
    assert component_function("/* Odd. */\noperator+ (a) {\n}", "js").above == "/* Odd. */"
    # signatures and decorators of any length
    long = "# It sorts them all.\n@dec(\n" + "    1,\n" * 400 + ")\ndef f(\n" + "".join(f"    a{k},\n" for k in range(900)) + "):\n    return 1\nx = 2\n"
    (f,) = find_functions(long, "py")
    assert f.end == 2 + 400 + 1 + 1 + 900 + 1 + 1 and "sorts" in f.above


def test_documented_functions(spark, rows):
    s = "id string, name string, class_name string, component_type string, node_type string, parameters array<string>, docstring string, source_code string, relative_path string, has_docstring boolean, code string"
    df = spark.createDataFrame([
        ("a.py::f", "f", None, "Function", "x", ["a"], "Waits for the lock.", None, "a.py", False, "c"), ("a.py::f", "f", None, "Function", "x", ["a"], "Waits for the lock.", None, "a.py", False, "c"),
        ("a.py::g", "g", None, "", "function", None, "TODO", "def g():\n    '''Never blocks on it.'''", ".\\a.py", None, "c"), ("a.js::h", "h", None, None, "METHOD", None, None, "/** Keeps the order. */\nh() {\n}", None, True, "c"),
        ("a.py::C", "C", None, "class", "class", None, "A long and good text.", None, "a.py", True, "c"), ("a.py::n", "n", None, "function", None, None, None, None, "a.py", True, "c"), ("a.py::r", "r", None, "function", None, None, "r", "", "a.py", True, "c"),
    ], s)
    assert rows(documented_functions(df), "id", "found_in") == [("a.js::h", "above"), ("a.py::f", "docstring"), ("a.py::g", "below")]
    assert documented_functions(df.where("false")).count() == 0
    files = spark.createDataFrame([("a.py", PY), ("b.js", JS), ("b.js", JS), ("c.py", None), ("d.md", "x"), (None, PY)], "relative_path string, file_text string")
    assert rows(function_pairs(files), "relative_path", "name") == [("a.py", "f"), ("b.js", "f"), ("b.js", "m")]


@pytest.mark.parametrize(("text", "want"), [
    ("// Code generated by x v1. DO NOT EDIT.\npackage a", (True, False, False)), ("# <auto-generated> by x 1.2\n", (True, False, False)), ("/*\n * @generated by y\n */\nx", (True, False, False)), ("x = 1\n# Do not modify: output of x, input y.def\n", (True, False, False)),
    ("// Diese Datei wurde maschinell erzeugt (x) - bitte nicht von Hand ändern.\n", (True, False, False)), ("# once generated by x, kept by hand since 2019\n", (False, False, False)), ("BANNER = '// Code generated by x. DO NOT EDIT.'\n", (False, False, False)),
    ("// writes the line \"DO NOT EDIT\" into what it emits\nf()", (False, False, False)), ("/** Auto-generated stub, replace this comment and the body below. */\nf()", (False, False, False)), ("// Vendored copy of moor 7.2; send changes upstream.\n", (False, True, False)),
    ("// Copyright 2019 the flux authors\n", (False, True, False)), ("// Copyright 2024 the shop-api authors\n", (False, False, False)), ("// SPDX-License-Identifier: Proprietary\n", (False, False, False)), ("var a=1\n//# sourceMappingURL=a.js.map", (False, False, True)), ("/* a " + "x" * 600 + " Code generated by x. DO NOT EDIT. */var a=1", (True, False, False)), ("// " + "x " * 400 + "@generated by y\n", (True, False, False)), (None, (False, False, False)),
])
def test_notices(text, want):
    assert notices(text, "shop-api") == want


def test_paths_and_shapes():
    assert [path_evidence(p) for p in ("r/a_pb2.py", "r/x.min.js", "r/__generated__/a.ts", "r/vendor/x/a.go", "r/vendor_portal/a.go", "r/generator/gen_alpha/a.py", "vendor/a.py", None)] == [
        (True, False), (True, False), (True, False), (False, True), (False, False), (False, False), (False, False), (False, False),
    ]
    v = dict(zip(FEATURES, shape("# top\n\nabc = 1\n# note\nxy = abc + 22\nxy = abc + 33\n\n# end\n"), strict=True))
    assert v["comment_share"] == 0.25 and v["line_max"] == 13.0 and v["ident_distinct"] == 0.4 and v["ident_mean"] == 2.6 and v["ident_short"] == 0.4 and v["literal_share"] == 0.0
    data = dict(zip(FEATURES, shape("ROWS = [\n" + "".join(f'  {{"id": {i}, "kind": "a"}},\n' for i in range(60)) + "]\n"), strict=True))
    assert data["literal_share"] > 0.95 and data["comment_share"] == 0
    assert shape("") == shape(None) == shape("// only a comment\n") == [0.0] * len(FEATURES)


def test_forest(spark, rows):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randrange(4, 9)))
    hand = lambda: "\n".join(f"def {word()}_{word()}({word()}):\n    # {word()} {word()}\n    {word()} = {word()}({word()}, {rng.randrange(99)})\n    return {word()}\n" for _ in range(8))
    made = lambda: "\n".join(f"class {word()}_{i:02}:\n    FIELD_{i} = {i}\n    def to_wire(self):\n        return pack('<I', self.FIELD_{i})\n" for i in range(20))
    mini = lambda: "!function(t){t.a=1}(this);" + "".join(f"var {rng.choice('bcdf')}{i}=function(t){{for(var e=0;e<t.length;e++)t[e].{word()}(e,{i});return t}};" for i in range(12))
    data = [(f"r/src/h{i}.py", hand()) for i in range(90)] + [(f"r/src/m{i}.py", "# @generated by x\n" + made()) for i in range(60)] + [(f"r/src/q{i}.py", made()) for i in range(2)]
    data += [(f"r/web/c{i}.js", mini() + "\n//# sourceMappingURL=a.js.map") for i in range(50)] + [(f"r/web/p{i}.js", mini()) for i in range(3)]
    data += [("r/vendor/a.py", hand()), ("r/src/none_pb2.py", None), ("r/src/empty.py", ""), (None, made()), ("r/src/h0.py", data[0][1]), ("r/d.py", "D = [\n" + "    1, 2, 3,\n" * 90 + "]\n")]
    df = spark.createDataFrame(data, "relative_path string, file_text string").selectExpr("*", "1 as said", "2 as features", "'x' as label")
    got = {r["relative_path"]: (r["reason"], r["said"]) for r in not_handwritten(df).collect()}
    assert {k for k in got if "/h" in k or k == "r/src/empty.py"} == set()
    assert got["r/vendor/a.py"] == ("vendored", True) and got["r/src/none_pb2.py"] == ("path", True) and got["r/d.py"][1] is False
    # files that neither notice nor name betrays are the forest's own finds
    assert all(got.get(f"r/src/q{i}.py") == ("forest", False) for i in range(2)) and all(got.get(f"r/web/p{i}.js") == ("forest", False) for i in range(3))
    assert len(got) == 60 + 2 + 50 + 3 + 3
    assert not_handwritten(df.where("false")).count() == 0
    quality = {(r["notice"], r["forest"]): r["n_files"] for r in forest_quality(df.where("relative_path not like '%/vendor/%' and relative_path not like '%/q%' and relative_path not like '%/p%'")).collect() if not r["by_name"]}
    assert quality[("written", True)] > 5 and quality[("compressed", True)] > 5 and ("written", False) not in quality and ("none", True) not in quality


def test_forest_needs_two_labels(spark):
    hand = "\n".join(f"def f{i}(a):\n    # adds {i}\n    return a + {i}\n" for i in range(8))
    data = [(f"r/src/h{i}.py", hand + f"# {i}\n") for i in range(40)] + [(f"r/gen/g{i}.py", hand) for i in range(9)]
    got = {r["relative_path"]: (r["reason"], r["probability"]) for r in not_handwritten(spark.createDataFrame(data, "relative_path string, file_text string")).collect()}
    assert got == {f"r/gen/g{i}.py": ("path", 0.0) for i in range(9)}


def test_pairs_of_python_agree_with_the_parser():
    """Signatures, bodies and docstrings of the standard library's files against `ast`."""
    import pathlib

    n = same = 0
    for path in sorted(pathlib.Path(ast.__file__).parent.glob("*.py"))[:60]:
        text = path.read_text("utf-8", "replace")
        found = {f.start: f for f in find_functions(text, "py")}
        for node in ast.walk(ast.parse(text)):
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                f, n = found.get(node.lineno), n + 1
                same += f is not None and f.name == node.name and f.end == node.end_lineno and bool(f.below) == bool(ast.get_docstring(node))
    assert n > 2000 and same >= 0.99 * n

"""Normalisation, patterns, flattening, discovery and extraction."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiloom.functions import templates as T
from lexiloom.functions import text as X
from lexiloom.sources import catalog as C
from lexiloom.sources import files as S
from lexiloom.sources import lexer

TEXTS = ["  Sign   in ", "HELLO\t\nWORLD", "CAFÉ", "OK", "Sign in", "", "  x y\u0085", "ΟΔΟΣ", "İX", "Straße", "　", "a​b"]


def test_normalize(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = df.select(X.normalize("t").alias("n"), X.trimmed_length("t").alias("k")).collect()
    assert [r.n for r in got] == [T.normalize(t) for t in TEXTS]
    assert [r.k for r in got] == [T.trimmed_length(t) for t in TEXTS]
    assert [r.n for r in got][:4] == ["sign in", "hello world", "café", "ok"] and got[4].k == 8 and got[3].k == 2
    assert [r.n for r in got][6:9] == ["x y", "οδοσ", "ix"]


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_normalize_twice(t):
    once = T.normalize(t)
    assert T.normalize(once) == once and T.collapse_whitespace(once) == once


def test_patterns():
    assert T.pattern("Hello, {name}")[1] == "hello, "
    assert T.pattern("{{name}} hello") is None and T.pattern("{} hello") is None and T.pattern("ab {x}") is None
    assert T.pattern("{a, b} hello") is None and T.pattern("hello") is None
    assert T.templates("{count, plural, =0 {none} one {# invite} other {# {x} invites}}") == ["# invite", "# {x} invites"]
    assert T.templates("plural one {x") == ["plural one {x"]
    assert T.pattern("Hello, {name}")[2] == "whello" and T.pattern("{n}items left# now")[2] == "wnow" and T.pattern("ab_cde {x}")[2] == "wcde"
    assert T.pattern("{n}items")[2] == "sems" and T.pattern("items{n}")[2] == "pite" and T.pattern("{a}items{n}")[2] is None and T.pattern("{a}items{n}x")[2] == "sx"
    assert T.pattern("item {open # one")[0] == r"\Aitem \{open [0-9]+ one\z"


def test_flatten(spark):
    want = {"a.b": "x", "a.c.d": "y"}
    js = '{"a": {"b": "x", "c": {"d": "y", "n": 1, "l": ["z"], "o": null}}, "t": true}'
    assert {r.key: r.value for r in C.from_json(spark, js).collect()} == want
    df = spark.createDataFrame([(1, js), (2, "{}"), (3, None), (4, '{"k": "a", "k": "b"}')], "id int, js string")
    got = sorted((r.id, r.key, r.value) for r in C.flatten_json(df, "js", "id").collect())
    assert got == [(1, "a.b", "x"), (1, "a.c.d", "y"), (4, "k", "b")]
    for bad in ("[1]", "{", '"x"'):
        with pytest.raises(C.CatalogError):
            C.from_json(spark, bad)
    cat = C.index(C.from_json(spark, '{"a": "Sign in", "b": "sign  in", "c": "OK"}'))
    assert cat.count() == 2 and C.size(cat).first().n == 1


def test_flatten_deep_and_many(spark):
    deep = '{"k": ' * 101 + '"x"' + "}" * 101
    odd = '{"a\\\\": "{[{", "b\\\"{": {"c": "}"}}'
    df = spark.createDataFrame([(1, deep), (2, odd), (3, '[{"a": "b"}]'), (4, "3")], "id int, js string")
    assert C.depth(df, "js") == 101
    got = sorted((r.id, r.key, r.value) for r in C.flatten_json(df, "js", "id").collect())
    assert got == [(1, ".".join(["k"] * 101), "x"), (2, "a\\", "{[{"), (2, 'b"{.c', "}")]
    many = spark.range(600_000).selectExpr("id", "'{\"a\": \"x\", \"b\": {\"c\": \"y\"}}' AS js")  # more leaves than a recursive query may have
    assert C.flatten_json(many, "js", "id").count() == 1_200_000


def test_discover(tmp_path, spark):
    for name in ("src/a.ts", "src/b.go", "node_modules/c.ts", "custom/d.tsx", "src/_x.js", "src/.h/e.js", "src/F.TS", "src/ts"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("f('x')")
    rel = lambda x: [os.path.relpath(p, tmp_path) for p in x]
    assert rel(S.discover(str(tmp_path), exclude=["custom"])) == ["src/.h/e.js", "src/_x.js", "src/a.ts"]
    assert rel(S.discover(str(tmp_path), [".ts"], ["src/*.ts"])) == []
    assert rel(S.discover(str(tmp_path), ["ts"], ["src/"])) == ["src/a.ts"]
    assert S.discover(str(tmp_path / "src/a.ts")) == []
    with pytest.raises(OSError):
        S.discover(str(tmp_path / "none"))
    assert rel(sorted(r.path for r in S.read(spark, str(tmp_path), exclude=["custom"]).collect())) == ["src/.h/e.js", "src/_x.js", "src/a.ts"]
    (tmp_path / "empty").mkdir()
    assert S.read(spark, str(tmp_path / "empty")).count() == 0


def test_globs():
    assert S.glob_regex("*.ts").match("a.ts") and not S.glob_regex("*.ts").match("a/b.ts")
    assert S.glob_regex("[^a]?").match("bc") and not S.glob_regex("[^a]?").match("ab") and S.glob_regex("[a-c]").match("b")
    assert S.glob_regex("[a") is None and S.glob_regex("\\") is None and S.glob_regex(r"\*").match("*")


SNIPPETS = [
    ("a.ts", 'const a = "Sign in"', 1), ("a.ts", "const a = `Sign in`", 1), ("a.ts", "const a = `Sign in ${n}`", 0), ("a.ts", 'import x from "Sign in"', 0),
    ("a.js", 'const x = require("Sign in")', 0), ("a.js", 'x.require("Sign in")', 1), ("a.js", 'import("Sign in")', 1), ("a.ts", 'const a = {"Sign in": 1}', 0),
    ("a.ts", 'const a = {k: "Sign in"}', 1), ("a.ts", 'const a={["Sign in"]: 1}', 1), ("a.ts", 'type L = {"Sign in": string}', 0), ("a.ts", 'enum E { A = "Sign in" }', 0),
    ("a.ts", 'export const a = "Sign in"', 0), ("a.ts", "export const a = `Sign in`", 1), ("a.tsx", 'export function V(){ return <b>{"Sign in"}</b> }', 1),
    ("a.tsx", "const a = <button>Sign in</button>", 1), ("a.tsx", "const a = <p>Hello\n  world</p>", 1), ("a.tsx", 'function V(){ return <input placeholder="Sign in"/> }', 1),
    ("a.tsx", 'function V(){ return <input data-testid="Sign in"/> }', 0), ("a.tsx", 'function V(){ return <input data-testid={"Sign in"}/> }', 0),
    ("a.tsx", "const a = <b data-testid={`Sign in`}/>", 1), ("a.tsx", 'const a = <b onClick={() => alert("Sign in")}/>', 0), ("a.tsx", 'const a = <b onClick={() => { alert("Sign in") }}/>', 1),
    ("a.ts", '// stop\nconst a = "Sign in"', 0), ("a.ts", 'interface A { k: "Sign in" }\nconst b = "Sign out"', 1), ("a.ts", 'const f = (x: {a: "Sign in"}) => { return "Sign out" }', 1),
    ("a.ts", 'export const a = {\n k: "Sign in"\n}\nconst b = "Sign out"', 1), ("a.ts", "const r = /\"[/]'/.test(z); const s = 'Sign in'", 1),
    ("a.ts", 'if (x) /re"gex/.test("Sign in here")', 1), ("a.ts", "while (x) /a\"b/.exec('Sign in here')", 1), ("a.ts", 'for (const a of b) /"/.test("Sign in here")', 1),
    ("a.ts", 'const o = { a: 1 };\n/re"x/.test("Sign in here")', 1), ("a.ts", 'if (a) { b() }\n/re"x/.test("Sign in here")', 1), ("a.ts", 'const a = (b) / c; const d = "Sign in here" // "/', 1),
    ("a.tsx", '<A<B<C>> label="Sign in here">x</A>', 1), ("a.tsx", '<A<(x: B) => C<"Sign out now">> id="Sign in here">Hello there</A>', 1),
    ("a.ts", 'const a: Map<B, C<D>> = f(); x!; y++; let g = (h?: A<B>) => { return "Sign in here" }', 1), ("a.ts", "for (;;) { f('Sign in here', ) }", 1),
    ("a.ts", 'switch (x) { case 1: } const a = [1, ]; export * from "Sign in here"; function* g() { yield* "Sign in here"; }', 1),
    ("a.ts", 'export class A { x = "Sign in"; m(): string { return "Sign out" } }', 1), ("a.ts", 'switch (x) { case "Sign in": { f("Sign out") } }', 2),
]


@pytest.mark.parametrize(("path", "source", "n"), SNIPPETS)
def test_extract(path, source, n):
    assert len([f for f in lexer.literals(path, source.encode(), "stop") if T.trimmed_length(f.raw) >= 8]) == n


@pytest.mark.parametrize("source", ["const = ;", "x = ;", "f(a +)", "const a = { b: }", "var = 1", "a, ;", "[a =>]", "x.;", "<A<B>x</A>", "f('a", "a = `b", "(", "}"])
def test_wrong_syntax(source):
    with pytest.raises(lexer.SyntaxProblem):
        lexer.literals("a.tsx", source.encode(), "stop")


def test_places_and_escapes():
    f = lexer.literals("a.ts", 'x\n é("Sign \\"in\\"")'.encode(), "stop")[0]
    assert (f.line, f.column, f.raw) == (2, 5, 'Sign "in"')
    for text, want in (("a\\n\\x41\\u00e9\\101", "a\nAéA"), ("\\u{41}", None), ("\\0", None), ("\\ud83d", None), ("\\'", None), ("a\\", None)):
        assert lexer.unescape(text, '"') == (want or text)
    for bad in ('const a = "x', "f(", "`a", "<b>", "f)", "/* x"):
        with pytest.raises(lexer.SyntaxProblem):
            lexer.literals("a.tsx", bad.encode(), "stop")


def test_paths(spark):
    df = spark.createDataFrame([("a/b.ts",), ("c.TSX",), ("d/e",)], "p string")
    got = df.select(X.extension("p").alias("e"), X.language_of("p").alias("l"), X.has_segment("p", "d").alias("s"), X.percent(F.lit(0.815)).alias("n")).collect()
    assert [tuple(r) for r in got] == [("ts", "typescript", False, 82), ("TSX", "tsx", False, 82), ("", "javascript", True, 82)]

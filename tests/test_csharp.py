"""The C# reader on inline sources."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.sources.csharp import EVERY, KINDS, columns, extract, tokens


def by_name(source, name):
    return next(s for s in extract(source).symbols if s.symbol_name == name)


def member(body, name="Foo"):
    return {s.method_name: s for s in extract(f"class {name} {{ {body} }}").symbols if s.method_name}


def test_namespaces():
    e = extract("namespace Acme { class Foo { void Bar() {} } }")
    assert [s.symbol_name for s in e.symbols] == ["Acme.Foo", "Acme.Foo.Bar"] and e.namespaces == ["Acme"] and e.top_level_types == ["Foo"]
    assert extract("namespace Acme;\nclass Foo {}").symbols[0].namespace == "Acme"
    e = extract("class Foo {}")
    assert e.namespaces == [""] and e.symbols[0].record_type == "class_summary" and e.symbols[0].namespace is None


def test_kinds_of_types():
    e = extract("record R(int A); interface I {} enum E { X } record struct S { } struct T { } delegate int Reducer(int a);")
    assert e.top_level_types == ["R", "I", "E", "S", "T", "Reducer"]
    assert [s.symbol_kind for s in e.symbols if s.record_type == "class_summary"] == ["Record", "Interface", "Enum", "Record", "Struct", "Class"]


def test_members():
    m = member(
        "public int Bar { get; set; } = 3; Foo() {} static Foo() {} public int this[int i] => i; int a, b, c; event EventHandler Changed; event EventHandler Other { add {} remove {} } ~Foo() {}"
        " public static Foo operator +(Foo l, Foo r) => l; public static implicit operator decimal(Foo f) => 1m; const int K = 1;"
    )
    assert set(m) == {"Bar", ".ctor", "this[]", "a", "b", "c", "Changed", "Other", "~Foo", "operator +", "implicit operator decimal", "K"}
    assert m["Bar"].symbol_kind == "Property" and m["a"].symbol_kind == "Field" and m["K"].metadata["is_const"]
    assert sum(s.method_name == ".ctor" for s in extract("class Foo { Foo() {} static Foo() {} }").symbols) == 2


@pytest.mark.parametrize(
    ("body", "n"),
    [
        ("{ if (a) {} if (b) {} }", 3), ("{ }", 1), ("=> a ? b : c;", 2), ("{ int? x = null; string? y; x?.Foo(); }", 1), ("{ while (a) {} do { } while (b); }", 2),
        ("{ switch (x) { case 1: case 2: break; case int n: break; case > 5: break; default: break; } }", 3), ("{ for (;;) {} foreach (var x in y) {} try {} catch {} }", 4),
        ("{ var s = $\"{(a ? b : c)} {d && e}\"; }", 3), ("{ // if (x)\n /* while (y) */ var t = \"if (z) && ||\"; }", 1), ("{ var x = a ?? b; return x switch { 1 => 2, _ => 3 }; }", 1),
    ],
)
def test_complexity(body, n):
    assert member(f"int M(int x) {body}")["M"].metadata["cyclomatic_complexity"] == n


def test_calls():
    m = member('void M() { Validate(x); _log.Log("a").Then(y => Run<int>(y)); var l = new Logger(Make()); new List<string> { Add(1) }; Target t = new(); nameof(x); if (a) { } }')["M"].metadata
    assert m["calls"] == ["Validate", "Then", "Log", "Run", "Make", "Add", "nameof"] and m["instantiates"] == ["Logger", "List<string>"]


def test_local_functions_and_nested_types():
    e = extract("namespace N; class C { void M() { int Helper(int z) => Inner(z); Helper(1); } class D { void Compute() {} } }")
    local = next(s for s in e.symbols if s.metadata.get("kind") == "local_function")
    assert local.symbol_name == "N.C.M.Helper" and local.metadata["enclosing_method"] == "M" and local.summary == "local function C.M.Helper"
    assert {"N.D", "N.D.Compute"} <= {s.symbol_name for s in e.symbols} and e.top_level_types == ["C"]


def test_usings_and_external_types():
    e = extract("using System; using static System.Math; using X = A.B; global using G; class C : Base<int>, I { Task<int> M(Stream s) { using (var x = f()) {} return new List<int>(); } List<string> f; }")
    assert e.usings == ["System", "System.Math", "A.B", "G"]
    assert e.external_types == ["Base<int>", "I", "Stream", "Task<int>", "List<string>", "List<int>"]


def test_text_and_lines():
    s = by_name('// lead\n[Obsolete("x")]\npublic sealed class Foo<T>\n  : Base\n{\n  int P { get; }\n\n  void M(int a,\n    int b) { }\n}\n', "Foo")
    assert (s.line_start, s.line_end) == (2, 10) and s.metadata["attributes"] == ["Obsolete"] and s.metadata["is_sealed"]
    assert s.code_snippet == "public sealed class Foo : Base\n{\n    int P { get; set; }\n    void M(int a,\n    int b);\n}"
    v = by_name("enum E\n{\n  Red, Green = 2,\n  Blue\n}", "E.Green")
    assert v.metadata["value"] == "2" and v.metadata["signature"] == "Green = 2" and v.line_start == 3


def test_strings_hide_code():
    source = 'class A { string a = @"class X { ""q"" }"; string b = """ class Y { } """; char c = \'"\'; string d = $@"{f(1)} }} {{ class Z"; void M() { } }\n#if X\n#endif'
    assert [s.symbol_name for s in extract(source).symbols] == ["A", "A.M", "A.a", "A.b", "A.c", "A.d"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='{}()[]<>"\'$@;,.:=?&| \n\\abclsnewify#/*+', max_size=80))
def test_any_text_can_be_read(source):
    assert extract(source).line_count == len(source.replace("\r\n", "\n").replace("\r", "\n").split("\n"))
    assert all(t.start <= t.end <= len(source) for t in tokens(source))


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet='{}()"\'$@;,.=?/* \n\r\t\\ab9_#é²', max_size=40))
def test_pieces_are_the_tokens(source):
    found = [(KINDS[t.kind], "" if t.kind == "string" else t.text, t.start, t.end) for t in tokens(source)]
    assert list(zip(*columns(source), strict=True)) == found


def test_kinds_alone_are_as_among_all():
    source = (
        "namespace N; class C : B { int P { get; set; } C() {} int this[int i] => i; public static C operator +(C a, C b) => a; public static implicit operator int(C c) => 1; ~C() {} string f = new X().Y(); event E Z; event E W { add {} }"
        " void M() { int L(int z) => z; L(1); new List<int>(); } } enum Q { Red } delegate void D(int a);"
    )
    whole = extract(source).symbols
    kind = lambda s: s.metadata.get("kind") or ("type" if s.record_type == "class_summary" else "property" if s.symbol_kind == "Property" else "method")
    for wanted in EVERY - {"file"}:
        found = extract(source, (wanted,)).symbols
        assert found and found == [s for s in whole if kind(s) == wanted]
    assert extract(source, ()).symbols == [] and extract(source, ("file",)).external_types == extract(source).external_types

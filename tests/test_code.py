"""Tokens, symbols, calls, renames and skeletons of nested, quoted and commented code in each language."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.functions.code import LANGUAGES, Code, tokens
from tracewright.operators import graph, packing

RUST = r"""
/* fn no() { f() } /* nested */ fn no() {} */
#[derive(Foo, Call(x))]
pub struct Foo<'a> { x: &'a str, y: fn(u8) }
impl<'a> Foo<'a> {
    pub(crate) async fn outer(&self) -> char where Self: Fn(u8) { // call()
        fn inner() { deep::er(1); }
        let s = "call(\"fn no() {"; println!("{}", call(1));
        self.field.method(Foo::new('"'), b'\'', '\u{1F600}'); Vec::<u8>::with(2); x.y::<T>(3); (self.g)(4);
        match x { Some(y) if guard(y) => arm(y), A { z } => other(), Ok(Some(_)) | Err(_) => '}' }
    }
}
trait Tr { fn only(&self); fn given() { r#"x" fn q() {"# ; last() } }
enum E { A(u8), B { c: u8 } }
"""
PYTHON = '''
@wrap(first)
class K(Base):
    """class no:
    def no(): call()"""
    async def outer(self, x=default()):
        def inner():
            return deep.er(1)  # call()
        if a // b: return self.y.method(x)[0](1)
        print(f"{shown(1)!r} {{hidden(2)}} {d['k']}", rf'{a}(')

    class N: pass
def one(): return two()
lst = [
def_(3),
]
text = "\\"def no():" 'x(' """ " call( """
'''
GO = """
type S struct { f func(int) }
// func no() { f() }
func (s *S) Outer(x interface{}, g func(int) string) (int, error) {
\tfmt.Println(`func no() {`, '"', "call(")
\tgo run(func() int { return inner(1) })
\tb := []byte(x)
\treturn s.x.field(), nil
}
type (
\tA int
\tB interface {
\t\tM(int) error
\t}
\tC = A
)
func G[T any](x T) T { return H[int](x) }
"""
SCRIPT = r"""
export default class K extends Base {
  /* function no() { */ static re = /[/'"]call\(/; #p = 1;
  constructor(private a) { super(a); }
  async outer(a: { b: number }): Promise<void> {
    console.log(`call( ${shown(`${deep(1)}`)} {`); this.method(new Made(2)); a / half(3) / 2;
    function inner() { nested(); }
    if (a) { ok?.go(1); }
  }
  get #q() { return q1(); }
}
const f = function no() { g1(); };
const o = { m(x) { return x; }, n: (y) => { h1(y); } };
"""


def told(text, ext):
    code = Code(text, ext)
    return [(s.kind, s.name, s.line_start, s.line_end) for s in code.symbols], [(s.name, x) for s, x in code.calls()]


def test_rust():
    symbols, calls = told(RUST, "rs")
    assert symbols == [("Struct", "Foo", 4, 4), ("Function", "outer", 6, 11), ("Function", "inner", 7, 7), ("Trait", "Tr", 13, 13), ("Function", "given", 13, 13), ("Enum", "E", 14, 14)]
    # A call belongs to the symbol that opened last, so that those after a nested one are its own.
    assert calls == [("inner", x) for x in ("deep", "method", "Foo", "Vec", "y", "g", "guard", "arm", "other")] + [("given", "last")]


def test_python():
    symbols, calls = told(PYTHON, "py")
    assert symbols == [("Class", "K", 3, 12), ("Function", "outer", 6, 10), ("Function", "inner", 7, 8), ("Class", "N", 12, 12), ("Function", "one", 13, 13)]
    assert calls == [("outer", "default"), ("inner", "er"), ("inner", "method"), ("inner", "print"), ("inner", "shown"), ("one", "two"), ("one", "def_")]


def test_go():
    symbols, calls = told(GO, "go")
    assert symbols == [("Struct", "S", 2, 2), ("Method", "Outer", 4, 9), ("Struct", "A", 11, 11), ("Struct", "B", 12, 14), ("Function", "G", 17, 17)]
    assert calls == [("Outer", "fmt"), ("Outer", "run"), ("Outer", "inner"), ("Outer", "s"), ("G", "H")]


def test_scripts():
    symbols, calls = told(SCRIPT, "tsx")
    assert symbols == [("Class", "K", 2, 11), ("Method", "constructor", 4, 4), ("Method", "outer", 5, 9), ("Function", "inner", 7, 7), ("Method", "#q", 10, 10), ("Method", "m", 13, 13)]
    assert calls == [("outer", x) for x in ("console", "shown", "deep", "half")] + [("inner", "nested"), ("inner", "ok"), ("#q", "q1"), ("#q", "g1"), ("m", "h1")]


def test_self_calls_go_and_repeats_count_once():
    assert told("fn a() { a(); b(); b(); }", "rs")[1] == [("a", "b")]


@pytest.mark.parametrize("ext", sorted(LANGUAGES))
def test_any_text_is_taken(ext):
    rng = random.Random(1)
    pieces = list("(){}[]<>'\"`/\\#*:;,.=!?@$ \n\tax1é") + ["fn ", "def ", "class ", "func ", "type ", "=>", "r#\"", "f\"{", "${", "'''", "/*", "*/", "//", "function ", "impl ", "match ", "let ", "new "]
    for _ in range(300):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 60)))
        code = Code(text, ext)
        code.calls()
        assert all(a.end <= b.start or b.text == '"' or a.text == '"' for a, b in zip(code.t, code.t[1:], strict=False))
        assert all(0 <= a < b <= len(text) for a, b in code.outer_bodies())
        assert packing.code_skeleton(text, ext) is not None


def test_deep_and_long_texts_take_linear_time():
    for text, ext in (("fn a() {" * 3000, "rs"), ("(" * 50_000, "go"), ("def a():\n" + " x = [1]\n" * 30_000, "py"), ("`${" * 5000, "js"), ("a.b(" * 20_000, "ts"), ("/*" * 20_000, "rs")):
        Code(text, ext).calls()


def test_tokens_leave_quotes_and_comments():
    assert [t.text for t in tokens("a /* b */ 'c' \"d\" // e\nf", "js")] == ["a", '"', '"', "f"]
    assert [t.text for t in tokens("x = a // b # c", "py")] == ["x", "=", "a", "/", "/", "b"]


def test_rename_plan(spark):
    rows = [
        ("a.rs", "rs", "#[derive(Foo)]\nimpl<'a> Foo<'a> { fn é() { Foo::x(); \"Foo\"; } }\n// Foo\nstruct Foo;\nstruct FooBar;"),
        ("b.py", "py", "def user():\n    x = a // Foo()\n    return f'{Foo}' + 'Foo'  # Foo\n"),
        ("c.py", "py", "Foo = 1\n"),  # neither defines nor calls it
        ("d.txt", "txt", "Foo()"),
    ]
    files = spark.createDataFrame(rows, "path string, ext string, content string")
    symbols, calls = graph.extracted_symbols(files), graph.extracted_calls(files)
    plan = {r.file_path: r for r in graph.rename_plan(symbols, calls, files, "Foo", "Bar").collect()}
    assert sorted(plan) == ["a.rs", "b.py"]
    assert plan["a.rs"].content == "#[derive(Bar)]\nimpl<'a> Bar<'a> { fn é() { Bar::x(); \"Foo\"; } }\n// Foo\nstruct Bar;\nstruct FooBar;"
    assert plan["b.py"].content == "def user():\n    x = a // Bar()\n    return f'{Bar}' + 'Foo'  # Foo\n"
    for path, _, text in rows[:2]:
        assert plan[path].sites == len(plan[path].places)
        assert all(text.encode()[p.byte_start : p.byte_end] == b"Foo" and text.encode()[: p.byte_start].count(b"\n") + 1 == p.line for p in plan[path].places)
    sites = graph.identifier_sites(files, "Foo").collect()
    assert {(r.file_path, r.line) for r in sites} == {("a.rs", 1), ("a.rs", 2), ("a.rs", 4), ("b.py", 2), ("b.py", 3), ("c.py", 1)} and len(sites) == 7
    with pytest.raises(ValueError, match="identifier"):
        graph.rename_plan(symbols, calls, files, "Foo", "Bar$1")


def test_symbols_and_calls_as_tables(spark):
    rows = [("a.rs", "rs", RUST), ("b.py", "PY", PYTHON), ("c.go", "go", GO), ("d.ts", "ts", SCRIPT), ("e.md", "md", "fn no() {}"), ("f.rs", "rs", None), ("g.rs", "rs", ""), ("h.rs", "rs", "fn a() { b() }\nfn a() {\n c() }")]
    files = spark.createDataFrame(rows, "path string, ext string, content string")
    got = {(r.kind, r.name, r.line_start, r.line_end) for r in graph.extracted_symbols(files).collect() if r.file_path != "h.rs"}
    assert got == {x for _, ext, text in rows[:4] for x in told(text, ext)[0]}
    last = [(r.id, r.line_start, r.line_end) for r in graph.extracted_symbols(files).where("file_path = 'h.rs'").collect()]
    assert last == [("Function:h.rs:a", 2, 3)]
    calls = {(r.caller_id, r.callee_name) for r in graph.extracted_calls(files).collect()}
    assert ("Method:c.go:Outer", "fmt") in calls and {("Function:h.rs:a", "b"), ("Function:h.rs:a", "c")} <= calls
    assert len(calls) == sum(len(told(text, ext)[1]) for _, ext, text in rows[:4]) + 2


def test_skeletons_by_tokens():
    rust = packing.code_skeleton(RUST, "rs")
    assert "async fn outer(&self) -> char where Self: Fn(u8) { /* collapsed */ }\n}" in rust and "inner" not in rust and "fn given() { /* collapsed */ }" in rust and "fn only(&self);" in rust
    python = packing.code_skeleton(PYTHON, "py")
    assert "async def outer(self, x=default()):\n            pass  # collapsed\n\n    class N: pass\ndef one():     pass  # collapsed\nlst" in python and "def no(): call()" in python
    assert "(int, error) { /* collapsed */ }\ntype (" in packing.code_skeleton(GO, "go")
    script = packing.code_skeleton(SCRIPT, "ts")
    assert "Promise<void> { /* collapsed */ }\n  get #q() { /* collapsed */ }\n}\nconst f = function no() { /* collapsed */ };\nconst o = { m(x) { /* collapsed */ }, n: (y) => { /* collapsed */ } };" in script
    java = "class A {\n  A() { x(); }\n  int b(int c) throws D {\n    return e();\n  }\n}\n"
    assert packing.code_skeleton(java, "java") == "class A {\n  A() { x(); }\n  int b(int c) throws D { /* collapsed */ }\n}\n"
    assert packing.code_skeleton("<template/><script setup lang=\"ts\">\nfunction f(a: number) {\n x\n}\n</script>", "vue") == "<script>\nfunction f(a: number) { /* collapsed */ }\n</script>\n<!-- template/style omitted -->"
    # No function body: by lines; other types as they are.
    assert packing.code_skeleton("class A:\n    x = 1\n", "py") == "class A:\n    pass  # collapsed\n"
    assert packing.code_skeleton("int main(int c) {\n  return 0;\n}\n", "c") == "int main(int c) { /* collapsed */ }\n"
    assert packing.code_skeleton("a {", "txt") == "a {"


def test_skeleton_column(spark):
    rows = spark.createDataFrame([("rs", RUST), ("PY", PYTHON), ("txt", "a {"), (None, "b"), ("rs", ""), ("rs", None)], "e string, t string")
    got = [r.x for r in rows.select(packing.skeleton(F.col("t"), F.col("e")).alias("x")).collect()]
    assert got == [packing.code_skeleton(RUST, "rs"), packing.code_skeleton(PYTHON, "py"), "a {", "b", "", None]

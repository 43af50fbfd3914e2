"""Parsers: complexity, entrypoints, calls, imports and token norms of each language."""

import pytest

from codelake.parse import PARSERS

GOLDEN = {
    "java": ("A.java", "class A { int f(int a) { if (a > 0 && a < 9) { return 2; } if (a == 2) return 1; return 0; } }", "f", 4),
    "ruby": ("a.rb", "def f(a)\n  if a\n    1\n  elsif a > 2\n    2\n  end\n  while a\n    a -= 1\n  end\nend\n", "f", 4),
    "typescript": ("a.ts", "function f(a: number) { if (a > 0 && a < 9) { return 1; } for (const i of [1]) { } return 0; }", "f", 4),
    "python": ("a.py", "def f(a):\n    if a and b:\n        return 1\n    for i in a:\n        pass\n", "f", 4),
    "go": ("a.go", "package a\nfunc f(a int) int {\n\tif a > 0 && a < 9 { return 1 }\n\tfor { break }\n\treturn 0\n}\n", "f", 4),
    "rust": ("a.rs", "fn f(x: i32) -> i32 { if x > 0 && x < 9 { return 1; } match x { 0 => 1, _ => 2 } }", "f", 5),
}


def names(p, kind="function"):
    return [s[2] for s in p.symbols if s[1] == kind]


def called(p):
    at = {s[0]: s[2] for s in p.symbols}
    return {(at[a] if a else "", at[b]) for a, b, k, _ in p.edges if k == "calls"}


def entries(p):
    at = {s[0]: s[2] for s in p.symbols}
    return {at[i] for i in p.entrypoints}


@pytest.mark.parametrize("lang", GOLDEN)
def test_complexity(lang):
    file, src, name, cx = GOLDEN[lang]
    p = PARSERS[lang](file, src)
    ids = {s[0]: s[2] for s in p.symbols}
    assert {ids[i]: c for i, c in p.complexity} == {name: cx}


@pytest.mark.parametrize("lang", PARSERS)
@pytest.mark.parametrize("src", ["", "\n\n", "}{)(][", '"', "'", "`${", "def class fn func (", "é ∑ 😀 = 1", "/*", "#", "if " * 200])
def test_damaged_sources_still_give_a_file(lang, src):
    p = PARSERS[lang]("dir/x", src)
    assert p.symbols[0][1] == "file"
    end = len(src.encode())
    assert all(0 <= a < b <= end for a, b, *_ in p.tokens)


def test_offsets_are_bytes():
    p = PARSERS["java"]("A.java", 'class A { String s = "é"; void f() { g(); } }')
    start, end = p.symbols[2][4:6]
    assert 'class A { String s = "é"; void f() { g(); } }'.encode()[start:end] == b"void f() { g(); }"


def test_java():
    p = PARSERS["java"]("A.java", """package com.acme;
import com.acme.util.B;
import java.util.*;
public class A extends C {
    A() { super(); }
    public static void main(String[] args) { new A().run(x -> help(x)); new Thread(new Runnable() { public void run() { help(1); } }); }
    @Deprecated(since = "1") List<String> run(int a) throws E { switch (a) { case 1: return null; default: return a > 1 ? null : null; } }
    private <T> void help(T a) { do { other(); } while (a != null); }
    abstract void open();
    int field = compute();
}
interface I { void later(); }
""")
    assert names(p, "class") == ["A"] and p.symbols[1][3] == "com.acme.A"
    assert sorted(names(p)) == ["help", "later", "main", "open", "run", "run"]
    assert [s[2] for s in p.symbols if s[1] == "dependency"] == ["com.acme.util.B", "java.util"]
    assert entries(p) == {"main"}
    assert {("main", "run"), ("main", "help"), ("run", "help")} <= called(p)
    assert sorted(c for _, c in p.unresolved) == ["compute", "other"]
    by = {(s[2], s[5] - s[4]): dict(p.complexity)[s[0]] for s in p.symbols if s[1] == "function"}
    assert {v for (n, _), v in by.items() if n == "help"} == {2} and 4 in {v for (n, _), v in by.items() if n == "run"}


def test_ruby():
    p = PARSERS["ruby"]("lib/a.rb", """require_relative "../x/b"
module M
  class Foo
    def bar(a, b = 1)
      greet unless a
      items.each do |i| puts "#{helper} x" end
      x = case a when 1 then 2 when 3 then 4 end
      /re(/.match(a) ? 1 : 2
    end
    def self.build; end
    def short(x) = x + 1
    def helper
      <<~TXT
        if end def
      TXT
    end
  end
end
""")
    assert names(p) == ["bar", "short", "helper"] and names(p, "class") == ["Foo"] and names(p, "module") == ["M"]
    assert [s[2] for s in p.symbols if s[1] == "dependency"] == ["x/b.rb"]
    assert ("bar", "helper") in called(p)
    assert {"greet", "items", "each", "puts"} <= {c for _, c in p.unresolved}
    assert dict(p.complexity)[[s[0] for s in p.symbols if s[2] == "bar"][0]] == 5
    assert p.entrypoints == [0]


def test_typescript():
    p = PARSERS["typescript"]("src/app/a.tsx", """import { b } from "../lib/b.js";
import "./side";
import React from "react";
export class C { constructor(private x: number) { this.m(); } async m(): Promise<void> { await load?.(1); } }
export const h = async (x: number): Promise<number> => { return x ? f(x) : x ?? 0; };
function f(a?: number): number { switch (a) { case 1: return 1; default: return 2; } }
const o = { run() { return f(1); } };
const g = function (a) { return `t${f(a)} ${a}`; }, n = 3;
abstract class D { abstract q(): void; }
const re = /if \\(x/g;
new C(1);
""")
    assert set(names(p)) == {"constructor", "m", "h", "f", "run", "g"} and names(p, "class") == ["C"]
    assert [s[2] for s in p.symbols if s[1] == "dependency"] == ["src/lib/b", "src/app/side"]
    assert p.symbols[0][3] == "src/app/a"
    assert entries(p) == {"src/app/a.tsx", "C", "constructor", "m", "h"}
    assert {("h", "f"), ("run", "f"), ("g", "f"), ("constructor", "m")} <= called(p)
    at = {s[2]: dict(p.complexity).get(s[0]) for s in p.symbols}
    assert at["h"] == 3 and at["f"] == 2


def test_python():
    p = PARSERS["python"]("pkg/__init__.py", 'import a.b, c\nfrom d.e import f\nfrom . import g, h\nfrom ..up import k\n@dec(1)\ndef one(x):\n    """doc"""\n    return two(x) if x else obj.three()\nasync def two(x):\n    import late\n    match x:\n        case 1: pass\n        case _: pass\n')
    assert p.symbols[0][3] == "pkg"
    assert [s[2] for s in p.symbols if s[1] == "dependency"] == ["a/b", "c", "d/e", "pkg/g", "pkg/h", "up"]
    assert called(p) == {("one", "two")} and ("three" in {c for _, c in p.unresolved})
    assert {s[2]: c for s in p.symbols for i, c in p.complexity if s[0] == i} == {"one": 2, "two": 3}
    norms = [t[3] for t in p.tokens]
    assert norms[norms.index('"""') : norms.index('"""') + 3] == ['"""', "STR", '"""']
    assert [s[1] for s in PARSERS["python"]("x.py", "def f(:").symbols] == ["file"]


def test_go():
    p = PARSERS["go"]("pkg/a.go", 'package a\nimport (\n\t"fmt"\n\tx "host/m/b"\n)\nimport "os"\ntype (\n\tA struct{ n int }\n\tB interface {\n\t\tM()\n\t}\n)\ntype C = int\nfunc (t *A) Run(f func(int) int) (int, error) {\n\tselect {\n\tcase <-c: help()\n\tdefault:\n\t}\n\treturn f(1), nil\n}\nfunc help() { fmt.Println("text") }\nfunc init() {}\nfunc Map[T any](x T) T { return x }\n')
    assert names(p, "class") == ["A", "B", "C"] and names(p) == ["Run", "help", "init", "Map"]
    assert [s[2] for s in p.symbols if s[1] == "dependency"] == ["fmt", "host/m/b", "os"]
    assert p.symbols[0][3] == "pkg" and entries(p) == {"Run", "init", "Map"}
    assert called(p) == {("Run", "help")} and "text" in [t[3] for t in p.tokens]


def test_rust():
    p = PARSERS["rust"]("src/m.rs", """
pub fn open() {}
pub(crate) async fn near() -> Result<(), E> { far()?; Ok(()) }
fn far() { loop { break; } }
#[cfg(test)]
mod tests {
    #[tokio::test]
    // note
    async fn works() { assert_eq!(helper(1), 2); }
}
trait Greeter { fn hello(&self); fn given(&self) { far() } }
impl<T> Greeter for S<T> { fn hello(&self) { let s: &'static str = "a"; let c = 'x'; s.len(); } }
impl S<u8> { fn own(&self) { m::far(); } }
fn helper(x: i32) -> i32 { x }
enum E { A } struct S<T>(T);
""")
    assert names(p) == ["open", "near", "far", "works", "given", "hello", "own", "helper"]
    assert entries(p) == {"open", "near", "works", "hello"}
    assert {("near", "far"), ("works", "helper"), ("given", "far")} == called(p)
    assert ("own", "far") not in called(p) and names(p, "class") == ["Greeter", "E", "S"]
    assert dict(p.complexity)[[s[0] for s in p.symbols if s[2] == "far"][0]] == 1
    norms = [t[3] for t in p.tokens]
    assert "STR" in norms and not any("hello" in n for n in norms)


def test_renamed_copies_have_equal_norms():
    a = [t[3] for t in PARSERS["go"]("a.go", 'func f(x int) int { return x + 1 }').tokens]
    b = [t[3] for t in PARSERS["go"]("b.go", 'func g(yy int) int { return yy + 22 }').tokens]
    assert a == b

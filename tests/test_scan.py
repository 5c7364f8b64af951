import pytest
from pyspark.sql.functions import spark_partition_id

from graphloom.sources import scan as S

KINDS = {"CALL", "NEW", "IMPORT", "EXTENDS", "IMPLEMENTS"}


def rows(lang, text):
    return list(S._python(text) if lang == "python" else S._walk(S.Tokens(text, lang), lang))


def defs(lang, text):
    return [(r[0], r[1], r[2], r[3], r[4]) for r in rows(lang, text) if r[0] not in KINDS]


def calls(lang, text):
    return [(r[1], r[5], r[6], r[2]) for r in rows(lang, text) if r[0] in ("CALL", "NEW")]


def imports(lang, text):
    return [(r[1], r[7], r[8]) for r in rows(lang, text) if r[0] == "IMPORT"]


def heritage(lang, text):
    return [(r[1], r[5], r[0][0]) for r in rows(lang, text) if r[0] in ("EXTENDS", "IMPLEMENTS")]


def test_python():
    assert calls("python", "def main():\n    foo()\n    print(x, y, z)\n") == [("foo", "", 0, "main"), ("print", "", 3, "main")]
    assert calls("python", "def p(self):\n    self.bar()\n    obj.method()\n    MyClass()\n") == [("bar", "self", 0, "p"), ("method", "obj", 0, "p"), ("MyClass", "", 0, "p")]
    assert {c[0] for c in calls("python", "def __init__(self):\n    super().__init__()\n")} == {"super", "__init__"}
    assert [(r[1], r[3], r[2]) for r in rows("python", "foo()\n")] == [("foo", 1, "")]
    assert calls("python", "def outer():\n    def inner():\n        foo()\n") == [("foo", "", 0, "inner")]
    assert imports("python", "import os\nfrom os.path import join\nfrom . import sibling\nfrom a import *\nimport numpy as np\n") == [("os", [], False), ("os.path", ["join"], False), (".", ["sibling"], False), ("a", [], True), ("numpy", [], False)]
    assert heritage("python", "class Foo(Bar, a.Baz): pass\nclass P: pass\n") == [("Foo", "Bar", "E"), ("Foo", "Baz", "E")]
    assert rows("python", "def broken(:") == []


def test_scripts():
    code = """// import no from 'no'; call()
import React, { useState as s, type B } from "react";
import * as fs from 'fs';
import './side';
export { z } from './z';
export * from './all';
const q = require('q'), s = "call('x')";
/* class No {} */
export class A<T> extends Base<T> implements I, J {
  constructor(private x: number) { super(x); this.run(`a ${call()} b`); }
  async run(n: string): Promise<void> { await fetch(n, { a: [1, 2] }); }
}
interface K extends L { f(x: number): void }
export const arrow = async (a, b) => { inner(a, b); };
const short = x => other(x);
function plain() { if (a) { return new Map([[1, 2]]).get(1); } }
const lazy = () => import('dyn');
"""
    assert imports("typescript", code) == [("react", ["React", "useState", "B"], False), ("fs", ["fs"], True), ("./side", [], False), ("./z", ["z"], False), ("./all", [], True), ("q", [], False), ("dyn", [], False)]
    assert defs("typescript", code) == [("Class", "A", "", 9, 12), ("Method", "constructor", "A", 10, 10), ("Method", "run", "A", 11, 11), ("Interface", "K", "", 13, 13), ("Function", "arrow", "", 14, 14), ("Function", "short", "", 15, 15), ("Function", "plain", "", 16, 16), ("Function", "lazy", "", 17, 17)]
    assert heritage("typescript", code) == [("A", "Base", "E"), ("A", "I", "I"), ("A", "J", "I"), ("K", "L", "E")]
    got = calls("typescript", code)
    assert ("fetch", "", 2, "run") in got and ("inner", "", 2, "arrow") in got and ("other", "", 1, "short") in got and ("run", "this", 1, "constructor") in got
    assert ("Map", "", 1, "plain") in got and ("get", "Map()", 1, "plain") in got and ("super", "", 1, "constructor") in got and ("require", "", 1, "") in got
    assert not any(c[0] in ("call", "if", "f") for c in got)


@pytest.mark.parametrize(
    ("lang", "code", "modules"),
    [
        ("go", 'package m\nimport "fmt"\nimport (\n  "os"\n  x "a/b"\n  . "c"\n)\n', [("fmt", False), ("os", False), ("a/b", False), ("c", True)]),
        ("java", "import a.b.C;\nimport static a.D.*; // import no.No;\nclass X {}", [("a.b.C", False), ("a.D.*", True)]),
        ("kotlin", "import a.b as c\nimport d.*\n", [("a.b", False), ("d.*", True)]),
        ("csharp", "using System.Text;\nusing F = A.B;\nusing static C.D;\nclass X { void f() { using (var x = g()) { } using var y = h(); } }", [("System.Text", False), ("A.B", False), ("C.D", False)]),
        ("swift", "import UIKit\n@testable import struct Foo.Bar\n", [("UIKit", False)]),
        ("cpp", '#include <vector>\n  #  include "a.h"\n// #include <no>\n', [("vector", False), ("a.h", False)]),
        ("rust", "use std::{fs, io::{self, Read as R}};\nuse crate::x as y;\npub use a::*;\n", [("std::fs", False), ("std::io", False), ("std::io::Read", False), ("crate::x", False), ("a", True)]),
        ("php", "<?php\nuse App\\Models\\User as U;\nuse A\\{B, C as D};\nuse function x\\y;\nclass G { use T; }", [("App\\Models\\User", False), ("A\\B", False), ("A\\C", False), ("x\\y", False)]),
        ("ruby", "require 'json'\nrequire_relative(\"./a\")\n# require 'no'\n", [("json", False), ("./a", False)]),
    ],
)
def test_imports(lang, code, modules):
    assert [(m, w) for m, _, w in imports(lang, code)] == modules


@pytest.mark.parametrize(
    ("lang", "code", "want"),
    [
        ("java", "public class X<T extends Q> extends Y<T> implements Z, W.V {\n}\ninterface I extends J, K {}", [("X", "Y", "E"), ("X", "Z", "I"), ("X", "W.V", "I"), ("I", "J", "E"), ("I", "K", "E")]),
        ("kotlin", "class P(val x: Int) : Q(x), R<Int> {\n}\nobject O : S", [("P", "Q", "E"), ("P", "R", "E"), ("O", "S", "E")]),
        ("csharp", "class K<T> : L, M<T> where T : N { }", [("K", "L", "E"), ("K", "M", "E")]),
        ("cpp", "class S : public T, private u::V {\n};\nstruct F; struct S s;", [("S", "T", "E"), ("S", "u::V", "E")]),
        ("rust", "trait A: B + C {}\nimpl<T> fmt::Display for Thing<T> {\n}\nimpl Thing<u8> {}", [("A", "B", "E"), ("A", "C", "E"), ("Thing", "fmt::Display", "I")]),
        ("php", "<?php class G extends H implements I, J { use T, U; }", [("G", "H", "E"), ("G", "I", "I"), ("G", "J", "I"), ("G", "T", "I"), ("G", "U", "I")]),
        ("ruby", "class U < V::W\n  include M, N\nend\n", [("U", "V::W", "E"), ("U", "M", "I"), ("U", "N", "I")]),
        ("swift", "class N: O, P {\n}\nextension Q: R {}", [("N", "O", "E"), ("N", "P", "E"), ("Q", "R", "E")]),
        ("javascript", "class Foo extends Bar {}\nclass Baz {}\nx.class = 1", [("Foo", "Bar", "E")]),
    ],
)
def test_heritage(lang, code, want):
    assert heritage(lang, code) == want


@pytest.mark.parametrize(
    ("lang", "code", "want_defs", "want_calls"),
    [
        ("go", "package m\ntype T struct {\n\tx int\n}\nfunc (t *T) Get(a int) error {\n\treturn fmt.Errorf(\"x (%d)\", a)\n}\nfunc main() {\n\tt.Get(1)\n\tgo run()\n}\n",
         [("Struct", "T", "", 2, 4), ("Method", "Get", "T", 5, 7), ("Function", "main", "", 8, 11)], [("Errorf", "fmt", 2, "Get"), ("Get", "t", 1, "main"), ("run", "", 0, "main")]),
        ("rust", "struct P { x: i32 }\nimpl P {\n    pub fn new(x: i32) -> Self {\n        println!(\"{}\", x);\n        P::make(x, 'a', r#\"f(\"#)\n    }\n}\nfn main<'a>() { v.iter().collect::<Vec<_>>(); }\n",
         [("Struct", "P", "", 1, 1), ("Method", "new", "P", 3, 6), ("Function", "main", "", 8, 8)], [("println", "", 2, "new"), ("make", "P", 3, "new"), ("iter", "v", 0, "main"), ("collect", "v.iter()", 0, "main")]),
        ("java", "class A {\n  int x = start(1);\n  A(int y) { this.x = y; }\n  public <T> List<T> get(T t) throws E {\n    return new Foo<T>(t, 2).bar();\n  }\n  abstract void none();\n}\n",
         [("Class", "A", "", 1, 8), ("Constructor", "A", "A", 3, 3), ("Method", "get", "A", 4, 6), ("Method", "none", "A", 7, 7)], [("start", "", 1, "A"), ("Foo", "", 2, "get"), ("bar", "Foo()", 0, "get")]),
        ("cpp", "namespace n {\nclass A {\n  A() : x(1), y{2} { go(); }\n  int f() const;\n};\nint A::f() const {\n  return std::max(a, b->c(1));\n}\n}\nstatic int main(int argc) { A a(1); if (x) { run(); } }\n",
         [("Class", "A", "n", 2, 5), ("Constructor", "A", "A", 3, 3), ("Method", "f", "A", 6, 8), ("Function", "main", "", 10, 10)], [("go", "", 0, "A"), ("max", "std", 2, "f"), ("c", "b", 1, "f"), ("a", "", 1, "main"), ("run", "", 0, "main")]),
        ("kotlin", "class A(val x: Int) {\n  constructor() : this(1)\n  fun f(a: Int) = g(a)\n  fun String.ext(): Int {\n    return a?.b(1) { it }\n  }\n}\nfun top() { A(2) }\n",
         [("Class", "A", "", 1, 7), ("Constructor", "constructor", "A", 2, 2), ("Method", "f", "A", 3, 3), ("Method", "ext", "A", 4, 6), ("Function", "top", "", 8, 8)], [("this", "", 1, "constructor"), ("g", "", 1, "f"), ("b", "a", 1, "ext"), ("A", "", 1, "top")]),
        ("ruby", "module M\n  class C\n    def self.make(x)\n      return if x\n      new(x).run do |y|\n        y.go\n      end\n    end\n  end\nend\ndef top\n  while a do b(1) end\nend\n",
         [("Module", "M", "", 1, 10), ("Class", "C", "M", 2, 9), ("Method", "make", "C", 3, 8), ("Function", "top", "", 11, 13)], [("new", "", 1, "make"), ("run", "new()", 0, "make"), ("go", "y", 0, "make"), ("b", "", 1, "top")]),
        ("php", "<?php\nfunction f($a) { # f(1)\n  return $this->g($a, h('x(1)'))::k();\n}\nclass A { public function m() { return new B\\C(1); } }\n",
         [("Function", "f", "", 2, 4), ("Class", "A", "", 5, 5), ("Method", "m", "A", 5, 5)], [("g", "$this", 2, "f"), ("h", "", 1, "f"), ("k", "$this.g()", 0, "f"), ("C", "", 1, "m")]),
        ("swift", "struct S {\n  init(x: Int) { self.x = x }\n  func f<T>(_ a: T) -> Int {\n    return g(a, b: 2)\n  }\n}\nlet v = S(x: 1)\n",
         [("Struct", "S", "", 1, 6), ("Constructor", "init", "S", 2, 2), ("Method", "f", "S", 3, 5)], [("g", "", 2, "f"), ("S", "", 1, "")]),
        ("csharp", "namespace N {\npublic class A : B {\n  public A() : base(1) { }\n  public int P { get; set; }\n  int F(string s) => Parse(s);\n  string G() { return $\"{x}\" + @\"q(\"\"\" + nameof(A); }\n}\n}\n",
         [("Class", "A", "", 2, 7), ("Constructor", "A", "A", 3, 3), ("Method", "F", "A", 5, 5), ("Method", "G", "A", 6, 6)], [("base", "", 1, "A"), ("Parse", "", 1, "F"), ("nameof", "", 1, "G")]),
        ("c", "#define X(a) f(a)\nstruct s { int x; };\nint g(int);\nstatic struct s *make(int a, int b)\n{\n  return g(a) + sizeof(b);\n}\n",
         [("Struct", "s", "", 2, 2), ("Function", "make", "", 4, 7)], [("g", "", 1, "make")]),
    ],
)
def test_definitions_and_calls(lang, code, want_defs, want_calls):
    assert defs(lang, code) == want_defs
    got = calls(lang, code)
    assert got == want_calls


@pytest.mark.parametrize("lang", [*S.LEXICON, "python"])
def test_broken_texts_end(lang):
    for text in ("", "(", "}}}{{{((", "class", "class A {", "def f(", "fn f<T", '"open', "'", "/* open", "use a::{b", "import (", "impl", "x" * 5000, "f(" * 2000, "a.b(" * 500 + "é 日本\n" * 10):
        rows(lang, text)


def test_as_a_query_over_files(spark):
    files = spark.createDataFrame([("a.java", "java", "class A { void f() { g(1); new B(); this.h(); } }"), ("n", "java", None), ("e", "go", ""), ("u", "cobol", "x(1)")], "path string, language string, content string")
    got = {(r["path"], r["kind"], r["name"], r["form"]) for r in S.scan(files).collect()}
    assert got == {("a.java", "Class", "A", None), ("a.java", "Method", "f", None), ("a.java", "CALL", "g", "free"), ("a.java", "NEW", "B", "constructor"), ("a.java", "CALL", "h", "member")}


def test_texts_of_one_file_are_scanned_in_many_tasks(spark):
    files = spark.range(0, 400, 1, 1).selectExpr("CAST(id AS STRING) AS path", "'go' AS language", "concat('func f', id, '() { g() }') AS content")
    found = S.scan(files).withColumn("task", spark_partition_id())
    assert found.count() == 800 and found.select("task").distinct().count() > 1

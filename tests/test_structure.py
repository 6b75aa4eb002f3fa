import random

import pytest

from lodestone.operators import structure

SOURCES = {
    "a.ts": "import { x } from './x';\nexport class Cart extends Base {\n  total: number = 0;\n  add(item: Item): void {\n    this.total += 1;\n  }\n}\nexport interface Item {\n  id: string;\n}\ntype Id = string;\nexport enum Kind { A, B }\nexport function pay(c: Cart): Receipt {\n  return run();\n}\nexport const mul = (a: number) => a;\nconst LIMIT = 3;\n",
    "b.py": "import os\nfrom x import y\nclass Color(Enum):\n    RED = 1\nclass Dog(Animal):\n    kind = 'd'\n    def bark(self, n: int) -> None:\n        pass\ndef main():\n    pass\nLIMIT = 3\n",
    "c.go": "package m\nimport \"fmt\"\ntype Box struct {\n\tSize int\n}\nfunc (b *Box) Grow(n int) {\n}\nfunc Run() error {\n\treturn nil\n}\nvar Max = 3\n",
    "d.rs": "use std::fmt;\npub struct Point {\n    x: i32,\n}\npub enum Dir { N, S }\nimpl Point {\n    pub fn len(&self) -> i32 {\n        1\n    }\n}\nfn main() {\n}\nconst K: i32 = 1;\n",
    "e.swift": "import SwiftUI\nprotocol Named {\n    var name: String { get }\n}\nstruct Card: View {\n    let id: Int\n    func draw() {\n    }\n}\nenum Suit { case a }\ntypealias Id = Int\nfunc run() {\n}\n#Preview { Card() }\n",
    "F.java": "import java.util.List;\npublic class Shop extends Base {\n    private int total;\n    public int sum(List<Item> xs) {\n        return total;\n    }\n}\n",
    "g.c": "#include <stdio.h>\n#define MAX 3\nstruct node {\n    int v;\n};\nint add(int a, int b) {\n    return a + b;\n}\nstatic int count = 0;\n",
    "h.cpp": "#include \"x.hpp\"\nclass Engine {\npublic:\n    void start(int n);\n    int size;\n};\nint run(int a) {\n    return a;\n}\n",
    "I.cs": "using System;\nnamespace App {\npublic class Room {\n    public int Size { get; set; }\n    public void Open(int n) {\n    }\n}\npublic interface IDoor {\n}\n}\n",
    "j.rb": "require 'json'\nclass Tree\n  LIMIT = 3\n  def grow(n)\n  end\nend\ndef top\nend\n",
    "k.php": "<?php\nuse App\\Base;\nclass Cart extends Base {\n    private $total = 0;\n    public function add($x) {\n        return 1;\n    }\n}\nfunction run($a) {\n}\n",
    "l.dart": "import 'dart:io';\nclass Car {\n  int speed = 0;\n  void drive(int n) {\n  }\n}\nenum Color { red }\ntypedef Fn = int;\nint run(int a) {\n  return a;\n}\n",
    "m.js": "import y from 'y';\nclass Old {\n  go() {\n  }\n}\nfunction start() {\n}\n",
    "n.tsx": "export function View(props: Props) {\n  return null;\n}\n",
}
EXPECTED = {
    "a.ts": {("class", "Cart"), ("property", "total"), ("method", "add"), ("interface", "Item"), ("property", "id"), ("alias", "Id"), ("enum", "Kind"), ("function", "pay"), ("function", "mul"), ("var", "LIMIT")},
    "b.py": {("import", "import os"), ("enum", "Color"), ("class", "Dog"), ("property", "kind"), ("method", "bark"), ("function", "main"), ("var", "LIMIT")},
    "c.go": {("class", "Box"), ("property", "Size"), ("method", "Grow"), ("function", "Run"), ("var", "Max")},
    "d.rs": {("class", "Point"), ("property", "x"), ("enum", "Dir"), ("method", "len"), ("function", "main"), ("var", "K")},
    "e.swift": {("interface", "Named"), ("class", "Card"), ("property", "id"), ("method", "draw"), ("enum", "Suit"), ("alias", "Id"), ("function", "run"), ("preview", "#Preview")},
    "F.java": {("class", "Shop"), ("property", "total"), ("method", "sum")},
    "g.c": {("macro", "MAX"), ("class", "node"), ("property", "v"), ("function", "add"), ("var", "count")},
    "h.cpp": {("class", "Engine"), ("method", "start"), ("property", "size"), ("function", "run")},
    "I.cs": {("class", "Room"), ("property", "Size"), ("method", "Open"), ("interface", "IDoor")},
    "j.rb": {("class", "Tree"), ("property", "LIMIT"), ("method", "grow"), ("function", "top")},
    "k.php": {("class", "Cart"), ("property", "total"), ("method", "add"), ("function", "run")},
    "l.dart": {("class", "Car"), ("property", "speed"), ("method", "drive"), ("enum", "Color"), ("alias", "Fn"), ("function", "run")},
    "m.js": {("class", "Old"), ("method", "go"), ("function", "start")},
    "n.tsx": {("function", "View")},
}


@pytest.fixture(scope="module")
def found(spark):
    return structure.symbols(spark.createDataFrame(list(SOURCES.items()), "path string, content string")).cache()


@pytest.mark.parametrize("path", sorted(SOURCES))
def test_names_of_a_language(found, path):
    got = {(r["kind"], r["name"]) for r in found.where(found.path == path).collect()}
    assert EXPECTED[path] <= got, EXPECTED[path] - got


def test_members_know_their_container_and_line(found):
    rows = {(r["path"], r["name"]): r for r in found.collect()}
    assert rows["c.go", "Grow"]["container"] == "Box" and rows["d.rs", "len"]["container"] == "Point"
    assert rows["a.ts", "add"]["container"] == "Cart" and rows["a.ts", "add"]["line_no"] == 4
    assert rows["a.ts", "pay"]["signature"] == "export function pay(c: Cart): Receipt"


def test_index_references_and_text(spark, found):
    index = {(r["type_name"], r["path"]) for r in structure.type_index(found).collect()}
    assert ("Cart", "a.ts") in index and ("Cart", "k.php") in index
    refs = {r["type_name"] for r in structure.references(found).where("path = 'a.ts'").collect()}
    assert {"Receipt", "Base"} <= refs and not {"Cart", "Item", "String"} & refs
    text = structure.codemaps(found).where("path = 'a.ts'").first()["text"]
    assert text.startswith("File: a.ts\nImports:\n") and "  - Cart\n    Methods:\n      - L4: add(item: Item): void" in text
    assert structure.index_table(structure.type_index(found)).where("type_name = 'Cart'").first()["paths"] == ["a.ts", "k.php"]


def test_long_lists_are_capped(spark):
    source = "class Big {\n" + "".join(f"  method{i}(argument: SomeType): AnotherType {{ }}\n" for i in range(400)) + "}\n"
    text = structure.codemaps(structure.symbols(spark.createDataFrame([("a.ts", source)], "path string, content string"))).first()["text"]
    assert "more)" in text and len(text) < 10_000


def test_cache_is_keyed_by_content(spark, tmp_path):
    files = lambda t: spark.createDataFrame([("a.py", t), ("b.py", "x = 1\n"), ("c.txt", "")], "path string, content string")
    folder = str(tmp_path / "cache")
    assert tuple(structure.warm(files("def a():\n    pass\n"), folder).first()) == (0, 2, 1)
    assert tuple(structure.warm(files("def a():\n    pass\n"), folder).first()) == (2, 0, 1)
    assert tuple(structure.warm(files("def b():\n    pass\n"), folder).first()) == (1, 1, 1)


def test_manifest(spark):
    text = 'let package = Package(\n name: "Kit",\n products: [.library(name: "Kit", targets: ["Kit"])],\n dependencies: [.package(url: "https://x/y", from: "1.0.0")],\n targets: [.target(name: "Kit"), .testTarget(name: "KitTests")])'
    row = structure.package_manifest(spark.createDataFrame([("Package.swift", text)], "path string, content string")).first()
    assert (row["name"], row["products"], row["dependencies"], row["targets"]) == ("Kit", ["Kit"], ["https://x/y"], ["Kit", "KitTests"])


HARD = {
    "a.ts": "const t = `\n{\nclass Not {\n`;\nimport y from 'http://x/y';\nexport class Real {\n  run() {\n    const re = /[{]/;\n  }\n  /* { */ stop() {\n  }\n}\nfunction last({ a, b }: P): void {\n}\n",
    "b.rb": "# {\nmodule Outer\n  class Inner\n    def grow(n)\n      x = '('\n      y = 2\n    end\n\n    def shrink\n    end\n  end\nend\ndef top\nend\n",
    "C.cs": "using System;\nnamespace N\n{\n    public class Room\n    {\n        public int Size { get; set; }\n        public void Open(int n)\n        {\n            var x = \"{\";\n        }\n        public void Close()\n        {\n        }\n    }\n}\n",
    "d.py": "class Dog:\n  kind = 'd'\n  def bark(self):\n    local = 1\n    return local\n  def sit(self):\n    \"\"\"x = 1\n  y = 2\n    \"\"\"\ndef main(\n  a=1,\n  b=2,\n):\n  inner = 3\nLIMIT = [\n  1,\n]\n",
    "e.java": "class A {\n  static class B {\n    int hidden;\n  }\n  int shown;\n  String s = \"}\";\n  void f(\n      int a,\n      int b) {\n    int local = 1;\n  }\n}\n",
    "f.rs": "mod inner {\n    pub fn f<'a>(x: &'a str) -> char {\n        '{'\n    }\n    struct S {\n        v: i32,\n    }\n}\nfn g() {\n}\n",
    "g.go": "import (\n\t\"fmt\"\n)\nvar q = `{\n`\nfunc Run() {\n}\n",
    "h.cpp": "namespace a\n{\nclass E\n{\n  int size;\n};\n}\nint run(int a)\n{\n  int local = 1;\n}\n",
}
HARD_NAMES = {
    "a.ts": {("import", "'http://x/y'", None), ("var", "t", None), ("class", "Real", None), ("export", "export class Real", None), ("method", "run", "Real"), ("method", "stop", "Real"), ("function", "last", None)},
    "b.rb": {("class", "Outer", None), ("class", "Inner", None), ("method", "grow", "Inner"), ("method", "shrink", "Inner"), ("function", "top", None)},
    "C.cs": {("import", "using System;", None), ("class", "Room", None), ("property", "Size", "Room"), ("method", "Open", "Room"), ("method", "Close", "Room")},
    "d.py": {("class", "Dog", None), ("property", "kind", "Dog"), ("method", "bark", "Dog"), ("method", "sit", "Dog"), ("function", "main", None), ("var", "LIMIT", None)},
    "e.java": {("class", "A", None), ("property", "shown", "A"), ("property", "s", "A"), ("method", "f", "A")},
    "f.rs": {("function", "f", None), ("class", "S", None), ("property", "v", "S"), ("function", "g", None)},
    "g.go": {("import", '"fmt"', None), ("var", "q", None), ("function", "Run", None)},
    "h.cpp": {("class", "E", None), ("property", "size", "E"), ("function", "run", None)},
}


@pytest.mark.parametrize("path", sorted(HARD))
def test_literals_comments_and_layouts_lose_nothing(path):
    language = {"a.ts": "ts", "b.rb": "ruby", "C.cs": "c_sharp", "d.py": "py", "e.java": "java", "f.rs": "rust", "g.go": "go", "h.cpp": "cpp"}[path]
    assert {(kind, name, holder) for _, _, kind, name, holder, _ in structure.declared(HARD[path], language)} == HARD_NAMES[path]


def test_files_without_declarations_or_contents(spark):
    rows = spark.createDataFrame([("a.ts", ""), ("b.py", None), ("c.txt", "class A {}"), ("d.go", "\n\n")], "path string, content string")
    assert structure.symbols(rows).count() == 0
    assert structure.symbols(rows.limit(0)).count() == 0


def test_types_over_lines_and_imported_names_are_references(spark):
    text = "import {\n  Alpha,\n  Beta,\n} from 'm';\nexport function f(\n  a: Widget,\n  b: Gadget,\n): Promise<Thing> {\n  return new Hidden();\n}\n"
    found = structure.symbols(spark.createDataFrame([("a.ts", text)], "path string, content string"))
    assert {r["type_name"] for r in structure.references(found).collect()} == {"Alpha", "Beta", "Widget", "Gadget", "Thing"}


def test_unclosed_and_odd_sources_end_well():
    rng = random.Random(1)
    signs = ["{", "}", "(", ")", "[", "]", ";", "\n", "class A", "def f", "type X", '"', "'", "`", "/*", "*/", "//", "#", "<", ">", "=>", ",", "=", "end", "struct", "  ", "x", "import", ":"]
    for language in ("ts", "js", "tsx", "py", "go", "rust", "swift", "java", "c", "cpp", "c_sharp", "ruby", "php", "dart"):
        for _ in range(120):
            text = "".join(rng.choice(signs) + rng.choice(["", " "]) for _ in range(rng.randrange(0, 40)))
            for line, _, kind, name, _, code in structure.declared(text, language):
                assert 1 <= line <= text.count("\n") + 1 and kind and code == " ".join(code.split()) and name is not None
        assert len(list(structure.declared("class A {\n}\n" * 3000, language))) in (0, 3000)

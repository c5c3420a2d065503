import pytest

from graphloom.sources.extract import extract


def read(language, source):
    rows = extract("a.x", language, source)
    names = {r["id"]: r["qualified_name"] for r in rows if r["what"] == "node"}
    kinds = {r["qualified_name"]: r["kind"] for r in rows if r["what"] == "node" and r["kind"] not in ("file", "unresolved")}
    calls = [(names[r["source"]], names[r["target"]], r["provenance"]) for r in rows if r["what"] == "edge" and r["kind"] == "calls"]
    return kinds, calls, {r["qualified_name"]: (r["start_line"], r["end_line"]) for r in rows if r["what"] == "node"}


EXACT, OPEN = "ast_exact", "unresolved"
CASES = [
    ("python", "def login(u):\n    return validate(u)\ndef validate(u):\n    return len(u) > 0", {"login": "function", "validate": "function"}, [("login", "validate", EXACT), ("validate", "<unresolved>.len", OPEN)]),
    ("go", "package main\nfunc Login(u string) bool { return validate(u) }\nfunc validate(u string) bool { return len(u) > 0 }\ntype Box struct { a int }\nfunc (b *Box) Run() { b.go(1) }", {"Login": "function", "validate": "function", "Box": "struct", "Run": "method"}, [("Login", "validate", EXACT), ("validate", "<unresolved>.len", OPEN), ("Run", "<unresolved>.go", OPEN)]),
    ("rust", "fn login(u: &'a str) -> bool { validate(u) }\nfn validate(u: &str) -> bool { true }\npub trait Shape { }\nenum E { A }", {"login": "function", "validate": "function", "Shape": "interface", "E": "enum"}, [("login", "validate", EXACT)]),
    ("java", "class A { boolean login(String u){ return validate(u); } boolean validate(String u){ return true; } }\ninterface I {\n  List<String> all(int n) throws E;\n}", {"A": "class", "A.login": "method", "A.validate": "method", "I": "interface", "I.all": "method"}, [("A.login", "A.validate", EXACT)]),
    ("c_sharp", "public class A {\n  public static int Run(int a) { return Go(a); }\n  int Go(int a) => a;\n}\nstruct P { }", {"A": "class", "A.Run": "method", "A.Go": "method", "P": "struct"}, [("A.Run", "A.Go", EXACT)]),
    ("php", "<?php\nfunction login($u) { return validate($u); }\nfunction validate($u) { return strlen($u); }\nclass A { public function run() { return $this->go(); } function go() { } }", {"login": "function", "validate": "function", "A": "class", "A.run": "method", "A.go": "method"}, [("login", "validate", EXACT), ("validate", "<unresolved>.strlen", OPEN), ("A.run", "A.go", EXACT)]),
    ("ruby", "module M\n  class A\n    def login(u)\n      validate(u)\n    end\n    def validate(u)\n      true\n    end\n  end\nend", {"M": "module", "M.A": "class", "M.A.login": "method", "M.A.validate": "method"}, [("M.A.login", "M.A.validate", EXACT)]),
    ("c", "int login(char* u){ return validate(u); } int validate(char* u){ return 1; }", {"login": "function", "validate": "function"}, [("login", "validate", EXACT)]),
    ("cpp", "class A { public: bool run(){ return go(); } bool go(){ return true; } };\nstruct P { int x; };\nvoid A::far(int a) const {\n  p->near(a);\n}", {"A": "class", "A.run": "function", "A.go": "function", "P": "struct", "far": "function"}, [("A.run", "A.go", EXACT), ("far", "<unresolved>.near", OPEN)]),
    ("swift", "func login(_ u: String) -> Bool { return validate(u) }\nfunc validate(_ u: String) -> Bool { true }\nprotocol P { }\nstruct S { }", {"login": "function", "validate": "function", "P": "interface", "S": "class"}, [("login", "validate", EXACT)]),
    ("kotlin", "fun login(u: String): Boolean { return validate(u) }\nfun validate(u: String) = true\nclass A { fun go() { x.run() } }", {"login": "function", "validate": "function", "A": "class", "A.go": "function"}, [("login", "validate", EXACT), ("A.go", "<unresolved>.run", OPEN)]),
    ("scala", "object M { def login(u: String): Boolean = validate(u); def validate(u: String): Boolean = true }\ntrait T { }", {"M": "module", "M.login": "function", "M.validate": "function", "T": "interface"}, [("M.login", "M.validate", EXACT)]),
    ("zig", "fn login(u: []const u8) bool { return validate(u); }\nfn validate(u: []const u8) bool { return true; }", {"login": "function", "validate": "function"}, [("login", "validate", EXACT)]),
    ("lua", "local function validate(u)\n  return true\nend\nfunction M.login(u)\n  obj:send(u)\n  return validate(u) -- no(u)\nend", {"validate": "function", "login": "function"}, [("login", "<unresolved>.send", OPEN), ("login", "validate", EXACT)]),
    ("solidity", "contract C { function login() public returns (bool) { return validate(); } function validate() public returns (bool) { return true; } struct S { uint a; } }", {"C": "class", "C.login": "function", "C.validate": "function", "C.S": "struct"}, [("C.login", "C.validate", EXACT)]),
    ("elixir", "defmodule Math do\n  def add(a, b), do: a + b\n  def run do\n    add(1, 2)\n    missing(3)\n  end\nend", {"Math": "module", "Math.add": "function", "Math.run": "function"}, [("Math.run", "Math.add", EXACT), ("Math.run", "<unresolved>.missing", OPEN)]),
    ("ocaml", "let add a b = a + b\nlet run () = add 1 2", {"add": "function", "run": "function"}, [("run", "add", EXACT)]),
    ("rescript", "let add = (a, b) => a + b\nlet run = () => add(1, 2)", {"add": "function", "run": "function"}, [("run", "add", EXACT)]),
    ("bash", "greet() {\n  echo hi\n}\ngreet\nls -la # no", {"greet": "function"}, [("greet", "<unresolved>.echo", OPEN), ("<file>", "greet", EXACT), ("<file>", "<unresolved>.ls", OPEN)]),
    ("objc", "@interface Foo : NSObject\n- (int)bar:(int)x;\n@end\n@implementation Foo\n- (int)bar:(int)x { return [self baz:x]; }\n- (int)baz:(int)y { return y; }\n@end", {"Foo": "class", "bar": "method", "baz": "method"}, [("bar", "baz", EXACT)]),
]


@pytest.mark.parametrize("language, source, kinds, calls", CASES, ids=[c[0] for c in CASES])
def test_definitions_and_calls(language, source, kinds, calls):
    got = read(language, source)
    assert got[0] == kinds and got[1] == calls


def test_where_definitions_end():
    lines = read("ruby", CASES[6][1])[2]
    assert lines["M.A.login"] == (3, 5) and lines["M"] == (1, 10)
    assert read("python", "def a():\n    x = (\n  1)\n\n    return 2\n\nb = 3")[2]["a"] == (1, 5)
    assert read("go", "func A(\n\ta int,\n) bool {\n\treturn b(a)\n}\nvar x = 1")[2]["A"] == (1, 5)

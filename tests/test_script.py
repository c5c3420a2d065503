from graphloom.sources.extract import extract


def read(source, path="a.ts", language="typescript"):
    rows = extract(path, language, source)
    names = {r["id"]: r["qualified_name"] for r in rows if r["what"] == "node"}
    nodes = {r["qualified_name"]: r for r in rows if r["what"] == "node"}
    edges = [(names[r["source"]], names[r["target"]], r["kind"], r["read_write"], r["provenance"], r["line"]) for r in rows if r["what"] == "edge" and r["kind"] != "contains"]
    return nodes, edges, [(r["local_name"], r["imported_name"], r["module_spec"]) for r in rows if r["what"] == "import"]


def test_calls_and_what_is_done_to_variables():
    nodes, edges, _ = read("function helper(){ return 1 } function main(){ let x = helper(); x = x + 1; x += 2; x++; return x }")
    assert ("main", "helper", "calls", "call", "ast_exact", 1) in edges
    assert {e[3] for e in edges if e[1] == "main.x"} == {"write", "read", "readwrite"}
    assert nodes["helper"]["signature"] == "function helper()" and nodes["main.x"]["kind"] == "variable"


def test_the_innermost_name_counts():
    nodes, edges, _ = read("function helper(){ return 1 }\nfunction main(){\n  const helper = () => 2;\n  return helper();\n}")
    assert [e[:3] for e in edges if e[2] == "calls"] == [("main", "main.helper", "calls")]
    assert nodes["main.helper"]["kind"] == "function" and nodes["main.helper"]["start_line"] == 3


def test_unknown_names_are_boundaries_at_each_site():
    nodes, edges, imports = read('import { realFn } from "./api.js";\nrealFn("a");\nrealFn("b");')
    assert [(e[1], e[4], e[5]) for e in edges] == [("<unresolved>.realFn", "unresolved", 2), ("<unresolved>.realFn", "unresolved", 3)]
    assert imports == [("realFn", "realFn", "./api.js")] and nodes["<unresolved>.realFn"]["kind"] == "unresolved"


def test_receivers_have_types():
    source = "class Repo {\n  find(){ return 1 }\n  save(){ return this.find() }\n}\nfunction use(){ const r = new Repo(); return r.find(); }\nfunction go(s: Repo){ return s.save() }\nfunction no(s){ return s.save() }"
    _, edges, _ = read(source)
    assert [(e[0], e[1], e[4]) for e in edges if e[2] == "calls"] == [("Repo.save", "Repo.find", "ast_inferred"), ("use", "Repo.find", "ast_inferred"), ("go", "Repo.save", "ast_inferred"), ("no", "<unresolved>.save", "unresolved")]


def test_all_kinds_of_imports():
    _, _, imports = read("import a, { b, c as d, type E } from './x';\nimport * as n from 'y';\nimport type { F } from './f';\nimport './side';\nconst z = import('./lazy');")
    assert imports == [("a", "default", "./x"), ("b", "b", "./x"), ("d", "c", "./x"), ("E", "E", "./x"), ("n", "*", "y"), ("F", "F", "./f")]


def test_declarations():
    source = """export interface Shape { area(): number }
export type Id = string | number;
export enum Color { Red }
export const LIMIT = 3, other = `a ${LIMIT + 1} }`;
export default class Box<T> extends Base<T> implements Shape {
  private size: number = 1;
  constructor(readonly w: number, h = 2) { super(); }
  @dec() async area(): Promise<number> { return this.w * LIMIT; }
  static make = (n: number): Box<string> => new Box(n);
  get big() { return true }
}
export async function load(path: string, { deep } = {}): Promise<void> {
  for (const line of path.split(/[/]"/)) { await store(line) }
  try { } catch (err) { report(err) }
}
const obj = { run(x) { return x }, key: 1 };
"""
    nodes, edges, _ = read(source)
    kinds = {n: r["kind"] for n, r in nodes.items() if r["kind"] not in ("unresolved", "file")}
    assert kinds == {
        "Shape": "interface", "Id": "type_alias", "Color": "enum", "LIMIT": "constant", "other": "constant", "Box": "class", "Box.constructor": "method", "Box.constructor.w": "variable", "Box.constructor.h": "variable",
        "Box.area": "method", "Box.n": "variable", "Box.big": "method", "load": "function", "load.path": "variable", "load.line": "constant", "load.err": "variable", "obj": "constant", "run": "method", "run.x": "variable",
    }
    assert nodes["Box"]["is_exported"] and nodes["load"]["is_exported"] and not nodes["LIMIT"]["is_exported"]
    assert ("load", "<unresolved>.store", "calls", "call", "unresolved", 13) in edges and ("load", "load.line", "references", "read", "ast_exact", 13) in edges
    assert ("<file>", "LIMIT", "references", "read", "ast_exact", 4) in edges and ("Box.area", "LIMIT", "references", "read", "ast_exact", 8) in edges
    assert nodes["Box"]["end_line"] == 11 and nodes["load"]["signature"].startswith("export async function load(path: string,")


def test_signature_stops_at_the_brace_only():
    nodes, _, _ = read("function wide(\n  a: number,\n  b: number,\n): number {\n  return a;\n}")
    assert nodes["wide"]["signature"] == "function wide(\n  a: number,\n  b: number,\n): number"


def test_broken_text_is_read_as_far_as_it_goes():
    for source in ("function (", "class {", "const = ;", "}}}", "((((", "`${`${", "import {", "x => ", "/* open", "a.b.(", "'", "function f(a, { b", "@", "=>", "class A { @", "for (const"):
        assert extract("a.ts", "typescript", source)[0]["kind"] == "file"
    assert len(extract("a.ts", "typescript", "f(" * 20_000)) >= 1

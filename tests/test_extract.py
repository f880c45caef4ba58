from hypothesis import given, settings
from hypothesis import strategies as st

from gneissflow.extract.lexer import tokenize
from gneissflow.extract.script import extract

SAMPLE = '''/** Signs people in. */
export class AuthService extends BaseService implements IAuth {
  private x = foo(1);
  constructor(private readonly a: string) { super(); this.tokenize(a); }
  // TODO: rotate keys
  async rotate(token: string): Promise<{ a: string }> { return helper(token); }
  get value() { return hidden(); }
  static make<T>(x: T) { return new AuthService(x).rotate(`a${inner(x)}b`); }
}
export function main(): void { unresolvedFunc(); foo(bar()); chain.a().b(); if (x) { go(); } }
const arrow = async (x: number): Promise<void> => { call1(x); };
export const two = (y) => y + call2(y), three = 3;
interface Foo extends A, B<C> { method(x: string): void; }
type Bar = | 'a' | { x: (y: number) => void };
export enum Color { Red, Green }
const o = { meth(x) { return deep(x); }, re: /a(b)\\/c/.test(s) };
'''


def names(source, path="src/a.ts"):
    return {s["qualified_name"].split("#")[1]: s for s in extract(path, source)["symbols"]}


def test_symbols():
    got = names(SAMPLE)
    assert {k: v["kind"] for k, v in got.items()} == {
        "AuthService": "class", "AuthService.constructor": "constructor", "AuthService.rotate": "method", "AuthService.make": "method", "main": "function",
        "arrow": "callable-variable", "two": "callable-variable", "Foo": "interface", "Bar": "type", "Color": "enum",
    }
    assert got["AuthService"]["heritage"] == {"extends": ["BaseService"], "implements": ["IAuth"]} and got["AuthService"]["jsdoc"] == "Signs people in."
    assert got["Foo"]["heritage"]["extends"] == ["A", "B"] and got["AuthService"]["range"] == {"startLine": 2, "endLine": 9}
    assert {k for k, v in got.items() if v["exported"]} == {"AuthService", "AuthService.constructor", "AuthService.rotate", "AuthService.make", "main", "two", "Color"}


def test_calls():
    got = [(c["caller_qualified_name"].split("#")[-1], c["callee_text"], c["receiver"]) for c in extract("src/a.ts", SAMPLE)["calls"]]
    assert got == [
        ("AuthService.constructor", "super", "unresolved"), ("AuthService.constructor", "this.tokenize", "this"), ("AuthService.rotate", "helper", "identifier"),
        ("AuthService.make", "new AuthService(x).rotate", "property"), ("AuthService.make", "inner", "identifier"), ("main", "unresolvedFunc", "identifier"),
        ("main", "foo", "identifier"), ("main", "bar", "identifier"), ("main", "chain.a().b", "property"), ("main", "chain.a", "property"), ("main", "go", "identifier"),
        ("arrow", "call1", "identifier"), ("two", "call2", "identifier"), ("", "deep", "identifier"), ("", "/a(b)\\/c/.test", "property"),
    ]


def test_exports():
    exported = lambda s: {k for k, v in names(s).items() if v["exported"]}
    assert exported("class Service { go() {} }\nexport { Service };") == {"Service", "Service.go"}
    assert exported("function handle() {}\nmodule.exports = { handle };") == {"handle"}
    assert exported("function run() {}\nexports.run = run;") == {"run"}
    assert exported("function main() {}\nexport = main;") == {"main"}
    assert exported("class app { m() {} }\nexport default app") == {"app", "app.m"}
    assert exported("const a = () => 1;\nexport { a as b };") == set()
    assert exported("export default function f() {}") == {"f"}


def test_imports():
    source = "import './side';\nimport def, * as ns from 'pkg';\nimport { a, b as c, type D } from \"./m\";\nimport type { E } from './e';\nconst x = import('lazy');"
    got = [(i["kind"], i["imported_name"], i["module_specifier"]) for i in extract("a.ts", source)["imports"]]
    assert got == [("side-effect", None, "./side"), ("default", "def", "pkg"), ("namespace", "ns", "pkg"), ("named", "a", "./m"), ("named", "c", "./m"), ("named", "D", "./m"), ("named", "E", "./e")]


def test_routes():
    source = "app.get('/a', h); router.post('/b', c.d); server.put('/c', () => 1); api.delete('/d', x);\nmap.get(key); app.get(build(), handler); other.get('/e', f);\nclass C { @Get('/health') check() {} }"
    got = [(r["method"], r["route_path"], r["handler_name"]) for r in extract("a.ts", source)["routes"]]
    assert got == [("GET", "/a", "h"), ("POST", "/b", "d"), ("PUT", "/c", None), ("DELETE", "/d", "x"), ("GET", "/health", None)]


def test_rationale():
    got = extract("a.ts", "// HACK: odd\nfunction f() {}\n// TODO: more\nfunction g() {}\n")["rationale"]
    assert [(r["marker"], r["text"], r["symbol_qualified_name"]) for r in got] == [("HACK", "odd", "a.ts#f"), ("TODO", "more", "a.ts#g")]


def test_jsx_and_other_files():
    source = "export const V = () => <div title=\"it's\" onClick={() => run()}>don't {show(1)} <b/></div>;\nfunction after() { tail(); }"
    f = extract("a.tsx", source)
    assert [c["callee_text"] for c in f["calls"]] == ["run", "show", "tail"] and len(f["symbols"]) == 2
    assert extract("a.md", "function f() {}")["symbols"] == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=list("(){}[]<>;,.=:?!&|'\"`$/\\* \nabfunctioclasnewexpr0123"), max_size=80))
def test_never_fails(source):
    tokenize(source, True)
    extract("a.tsx", source)
    extract("a.ts", source)

"""Function extraction and metrics on literal sources."""

import time

import pytest

from codequarry.functions import code
from codequarry.functions.masked import Source
from codequarry.operators import security
from codequarry.plans.code import BLOCKS
from codequarry.schemas import FUNCTIONS


def names(src, ext):
    return [f[0] for f in code.functions_of(src, ext)]


def test_go_functions_and_methods():
    src = 'package p\n\nfunc A(x int) {\n\ts := "}"\n\tif x > 0 {\n\t}\n}\n\nfunc (t *T) B(a, b int, c ...string) error {\n\treturn nil\n}\n'
    a, b = code.functions_of(src, ".go")
    assert (a[0], a[1], a[2], a[3], a[4], a[5]) == ("A", 3, 7, 5, 2, 2)
    assert b[0] == "B" and b[7] == ["int", "int", "string"]


def test_go_unterminated_function_is_dropped():
    assert names("func A() {\n x := 1\n", ".go") == []


@pytest.mark.parametrize(
    ("src", "ext", "expected"),
    [
        ("def a(x):\n    return 1\n\ndef b(\n    y,\n):\n    pass\n", ".py", ["a", "b"]),
        ("def a(x)\n    return 1\n", ".py", []),
        ("function f() {\n}\nconst g = (a) => {\n};\nlet h = (1 + 2);\n", ".ts", ["f", "g"]),
        ("var k = async function (x) {\n}\n", ".js", ["k"]),
        ("public int add(int a) {\n  return a;\n}\n@Override\n", ".java", ["add"]),
        ("fun run(a: Int) {\n}\n", ".kt", ["run"]),
        ("anything", ".txt", []),
        ("", ".go", []),
    ],
)
def test_headers(src, ext, expected):
    assert names(src, ext) == expected


@pytest.mark.parametrize(
    ("lines", "n"),
    [(["a", "", "// c", "# d", "b // e"], 2), (["/* a", "b", "*/ c"], 1), (['"only literal"'], 0), (["x = `", "raw", "`"], 1), (["/* a */ b"], 1)],
)
def test_nloc(lines, n):
    assert code.nloc(lines) == n


@pytest.mark.parametrize(
    ("lines", "n"),
    [(["if a && b {", "} else if c {"], 3), (['x := "if"'], 0), (["// if a"], 0), (["a ? b : c"], 1), (["for i {", "case 1:", "default:"], 3)],
)
def test_cyclomatic(lines, n):
    assert code.cyclomatic(lines) == n


def test_nesting_and_bumps():
    assert code.max_nesting(["a {", "b { '{' }", "}"]) == 2
    assert code.bumpy_road(["if a {", "  x", "}", "if b {", "}", "if c {", "}"])
    assert not code.bumpy_road(["if a {", "}", "x := 1", "if b {", "}", "if c {", "}"])
    assert not code.bumpy_road(["if a {", "  if b {", "if c {"])


@pytest.mark.parametrize(("text", "types"), [("", []), ("a, b int", ["int", "int"]), ("int, string", ["int", "string"]), ("p *T, q []byte", ["T", "byte"]), ("f func(", []), ("c chan int", ["chan int"])])
def test_go_params(text, types):
    assert code.go_params(text) == types


def test_structural_markers(spark):
    body = "\n".join(["\tif a {"] * 5 + ["\t}"] * 5)
    src = f"func Big(a, b, c, d, e, f int) {{\n{body}\n" + "\n".join(f"\tx{i} := a && b || c" for i in range(70)) + "\n}\n"
    files = spark.createDataFrame([("r", "a.go", ".go", src), ("r", "b.txt", ".txt", src)], "repo_id string, path string, ext string, content string")
    nodes = spark.createDataFrame([("r", "file", "a.go", 0.9)], "repo_id string, node_type string, path string, pagerank double")
    least = spark.createDataFrame([("r", 0.5)], "repo_id string, value double")
    got = {r.type for r in code.structural_markers(code.function_metrics(files), nodes, least).collect()}
    assert got == {"brain_method", "nested_complexity", "bumpy_road", "complex_method", "large_method", "primitive_obsession"}
    cold = spark.createDataFrame([("r", 0.95)], "repo_id string, value double")
    assert "brain_method" not in {r.type for r in code.structural_markers(code.function_metrics(files), nodes, cold).collect()}


def test_messages_of_structural_markers(spark):
    row = ("r", "a.go", ".go", "Big", 3, 90, 88, 16, 5, True, ["int"] * 7)
    found = spark.createDataFrame([row], FUNCTIONS)
    nodes = spark.createDataFrame([("r", "file", "a.go", 0.9)], "repo_id string, node_type string, path string, pagerank double")
    out = code.structural_markers(found, nodes, spark.createDataFrame([("r", 0.5)], "repo_id string, value double"))
    assert "format_string" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.message for r in out.collect()) == [
        "Brain method 'Big': NLOC=88 cyclomatic=16 nesting=5",
        "Bumpy road in 'Big': ≥3 sequential branches at same level",
        "Complex method 'Big': cyclomatic=16",
        "Large method 'Big': 88 NLOC (threshold 60)",
        "Nested complexity in 'Big': max depth=5",
        "Primitive obsession in 'Big': 7 primitive params",
    ]


@pytest.mark.parametrize(
    ("src", "ext", "masked"),
    [
        ('a = "b\\"c" // d', ".go", 'a = "    "     '),
        ("x := `a\n{`\ny", ".go", "x := ` \n `\ny"),
        ("/* {\n} */ f() # g", ".tf", "    \n     f()    "),
        ('"""a\n{"""\nb # c', ".py", '"   \n   "\nb    '),
        ("'a' + \"it's\"", ".js", "' ' + \"    \""),
        ("'open\nnext", ".java", "'    \nnext"),
        ("", ".go", ""),
    ],
)
def test_comments_and_literals_are_blanked(src, ext, masked):
    s = Source(src, ext)
    assert s.code == masked and len(s.text) == len(src)


def test_brackets_and_what_they_hold():
    s = Source('f(a, g(b, c), "x, y", {d: [1, 2]}) }', ".js")
    assert [x.strip() for x, _, _ in s.arguments(1)] == ["a", "g()", '"    "', "{}"]
    assert [s.text[a:b].strip() for _, a, b in s.arguments(1)][1:3] == ["g(b, c)", '"x, y"']
    assert s.code[s.partner[1]] == ")" and s.line(3) == 1
    assert Source("f((a", ".js").partner == {} and Source("(a]b)", ".js").partner == {0: 4}
    assert Source("{ a; if (b) { c; } d\n e }", ".js").statements(0) == ["a", "if () {", "d", "e"]


def test_functions_of_harder_shapes():
    """Comments, literals and inner functions; headers over lines; groups of parameters."""
    src = "// func X() {\nfunc A(a, b int, c []string) (x int) {\n\t/* } */ s := \"}\" // }\n\tgo func() {\n\t}()\n}\n\nfunc (t *T) B() {\n\tc := '{'\n}\n"
    assert [(f[0], f[1], f[2], f[7]) for f in code.functions_of(src, ".go")] == [("A", 2, 6, ["int", "int", "string"]), ("B", 8, 10, [])]
    src = "# def x():\nclass S:\n    @p\n    def a(\n        self, f=lambda x: x(x),\n        g={'a': 1}): \n        '''def y():'''\n        return 1\n    def b(self) -> int:\n        return 2\n"
    assert [(f[0], f[1]) for f in code.functions_of(src, ".py")] == [("a", 4), ("b", 9)]
    src = "const parse = (\n  raw,\n  f(value)\n) => {\n  return 1;\n};\nconst h = async function run(\n  a, m(fn => fn(a))\n) {\n};\n// function no() {}\nlet x = (a)\n  + 1;\n"
    assert [(f[0], f[1], f[2]) for f in code.functions_of(src, ".js")][0][0] == "parse" and names(src, ".js")[-1] == "run" and "x" not in names(src, ".js")
    src = 'class R {\n    @T(readOnly = true)\n    public Map<String, List<Item>> find(\n        String t,\n        P<String> m(tag)\n    ) throws D {\n        return r.f("{");\n    }\n}\n'
    assert names(src, ".java")[0] == "find"
    assert names("class U {\n    @J\n    fun load(\n        id: String,\n    ): User {\n        return r\n    }\n}\n", ".kt") == ["load"]


@pytest.mark.parametrize("text", [" " * 300_000, '"' * 200_001, "{" * 100_000, "(" * 50_000 + ")" * 50_000, "public " * 40_000, "func f() {\n}\n" * 20_000, "/*" * 100_000, "a => {" * 20_000, "a => {" * 20_000 + "}" * 20_000, "x.query(" * 20_000 + ")" * 20_000, "x pay(" * 20_000, "x pay() " * 20_000, "." + "query" * 40_000, "function f()" * 20_000])
@pytest.mark.parametrize("ext", [".java", ".js"])
def test_hostile_files_take_linear_time(text, ext):
    began = time.time()
    code.functions_of(text, ext)
    security.hits(text, ext)
    assert time.time() - began < 8


def test_blocks_hit_where_they_should():
    for ext, lines, expected in BLOCKS:
        assert sorted(security.hits("\n".join(lines), ext)) == sorted(expected)
    assert security.hits("go func(a int) {}(1)", ".go") == [("unsecured_goroutine", 1, 1)]

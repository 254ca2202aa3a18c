import pytest

import plain_scan
from defectlens.operators import extraction as X, ranking as R
from defectlens.plans.extraction import extract_tree, write_extraction
from defectlens.plans.scoring import score_files
from defectlens.schemas import FUNCTION_METRICS
from defectlens.sources.code_tree import list_source_files, read_source_files

PYTHON = '''
import os

class Stack:
    """if for while"""

    @property
    def top(self):
        return self.items[-1] if self.items else None

    async def push(
        self,
        item, *,
        flag=(1, 2),
    ):
        # if or and
        text = "if x and y"
        for i in range(3):
            while i and flag:
                i -= 1
        return """two
lines"""


def outer(a: dict[str, int], /, b=None, *rest, **more):
    """Docstring with if.

    More.
    """
    total = 0

    def inner(x): return x or 1

    try:
        total = inner(a)
    except (ValueError, KeyError):
        total = [c for c in b if c]
    return total
# comment
'''
# name, start, end, nloc, ccn, token, params, length
PYTHON_ROWS = [
    ("top", 8, 9, 2, 2, 19, 1, 2),
    ("push", 11, 22, 11, 4, None, 3, 12),
    ("outer", 25, 38, 7, 4, None, 4, 14),
    ("inner", 32, 32, 1, 2, 9, 1, 1),
]


def scan(spark, *files):
    """Functions of (path, text) by the engine, in source order."""
    rows = X.extract_functions(spark.createDataFrame(list(files), "path string, content string")).collect()
    return sorted(map(tuple, rows), key=lambda r: (r[0] or "", r[2], -r[3], r[1]))


def plain(*files):
    rows = [(path, *row) for path, text in files
            for row in plain_scan.functions_in("." + path.rsplit(".", 1)[1] if path else None, text or "")]
    return sorted(rows, key=lambda r: (r[0] or "", r[2], -r[3], r[1]))


def test_python_functions(spark):
    rows = {r[1]: r[1:] for r in scan(spark, ("a.py", PYTHON))}
    assert list(rows) == ["top", "push", "outer", "inner"]
    for want in PYTHON_ROWS:
        got = rows[want[0]]
        assert [g for g, w in zip(got, want) if w is not None] == [w for w in want if w is not None], (got, want)


def test_damaged_and_empty_python(spark):
    assert scan(spark, ("a.py", ""), ("b.py", "def"), ("c.py", None)) == []
    assert [r[1] for r in scan(spark, ("a.py", "def f(a:\n  return 1\n"))] == ["f"]


def test_scan_agrees_with_a_plain_one(spark):
    files = [
        ("p.py", PYTHON), ("twice.py", "def f(): pass\n"), ("twice.py", "def f(): pass\n"), ("gone.js", None),
        (None, "function a() { }"), ("tabs.py", "class A:\n\tdef b(self, x=(1, 2), **k):\n\t\treturn [\nself]\n\tasync def c(self): return x if y else z\n"),
        ("long.py", "def g():\n    x = \'\'\'" + "text if\n" * 3000 + "\'\'\'\n    return x\n\n" + "def h(a, b): return a and b\n" * 50),
        ("back.py", "def a():\n    if x:\n        def b():\n            def c(): pass\n    def d(): pass\ny = 1\ndef e(): pass"),
        ("init.cpp", "Foo::Foo(int a) : x(a) {\n}\nint q(int b)\n : x(a) {\n}\n"),
        ("calls.js", "const a = foo(b)\nbar(\n x\n) {\n}\nasync function z(a,b=()=>{return 1}){}\nfoo()\nif (x) { y() }\n"
                     "x = async q => { await q }\nclass A { async go(a) { return a ? 1 : 2 } get x() {} }\n"
                     "it('a', function() { call(function(a, b) { }) })\n} }\nfunction last() {"),
    ]
    assert scan(spark, *files) == plain(*files)


def test_lines_between_headers_and_ends_are_summed(spark):
    body = "".join(f"    if a and b:\n\n        c = [{i},\n 2]  # if\n" for i in range(5))
    files = [
        ("a.py", f"x = 1\nif x: y\ndef f(a,\n  b):\n{body}\n"), ("b.py", f"def f(a): return a\ndef g(b):\n    \"\"\"if\"\"\"\n{body}    def h():\n{body}\nz = 1\nwhile z: z"),
        ("c.rb", f"def go(a)\n{body}end\nx = 1\ndef low b\n{body}\n  def in\n    c\n  end\n  d if e\nend\nq if r\n"),
    ]
    assert scan(spark, *files) == plain(*files)


def test_scan_runs_in_the_jvm(spark):
    files = spark.createDataFrame([("a.py", PYTHON)], "path string, content string")
    plan = X.extract_functions(files)._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "Python" not in plan and "InArrow" not in plan


@pytest.mark.parametrize("ext, text, expected", [
    (".js", "function a(x, y) {\n  if (x && y) { return 1; }\n}\n", [("a", 1, 3, 3, 3, 2)]),
    (".js", "const f = (a, b) => {\n  return a ? b : 0;\n};\nrun(x => {\n  y();\n});\n",
     [("(anonymous)", 1, 3, 3, 2, 2), ("(anonymous)", 4, 6, 3, 1, 1)]),
    (".ts", "class A {\n  go(a: number): string {\n    for (;;) { stop(); }\n  }\n}\n", [("go", 2, 4, 3, 2, 1)]),
    (".java", "class A {\n  @Test(x)\n  public void b(int a, Map<String, Integer> m) throws E {\n    // if\n"
              "    switch (a) { case 1: c(); }\n  }\n  void d();\n}\n", [("b", 3, 6, 3, 2, 2)]),
    (".c", "#include <a.h>\nint main(void)\n{\n  /* if\n while */\n  while (1) { f(\"}\"); }\n  return 0;\n}\n",
     [("main", 2, 8, 5, 2, 0)]),
    (".go", "func (r *T) Run(a int, b string) error {\n  if a > 0 || b == \"\" {\n    return nil\n  }\n  x := g(a)\n"
            "  for x {\n  }\n  return nil\n}\n", [("Run", 1, 9, 9, 4, 2)]),
    (".cpp", "Foo::Foo(int a) : x(a), y(0) {\n}\nint Foo::get() const {\n  return x;\n}\n",
     [("Foo", 1, 2, 2, 1, 1), ("get", 3, 5, 3, 1, 0)]),
    (".rb", "def go(a, b)\n  if a\n    b\n  end\nend\n\ndef low c\n  c\nend\n", [("go", 1, 5, 5, 2, 2), ("low", 7, 9, 3, 1, 1)]),
])
def test_other_languages(spark, ext, text, expected):
    got = [(r[1], r[2], r[3], r[4], r[5], r[7]) for r in scan(spark, ("a" + ext, text))]
    assert got == expected


def test_function_table(spark):
    files = spark.createDataFrame([("data\\repos\\r1\\tests\\m.py", PYTHON), ("x/none.go", ""), ("y/null.c", None)],
                                  "path string, content string")
    table = X.function_rows(X.extract_functions(files))
    rows = {r["function"]: r for r in table.collect()}
    top = rows["top"]
    assert (top["repo_name"], top["file_id"], top["file_name"], top["language"], top["is_test_file"]) == (
        "r1", "data/repos/r1/tests/m.py", "m.py", "Python", 1)
    assert (top["function_id"], top["line_span"], top["radon_cc"], top["radon_grade"], top["bug_label"]) == (
        "data/repos/r1/tests/m.py::top::8", 2, 2, "", "")
    per_file = {r["file"]: r["function_count"] for r in X.analyzed_files(files, table).collect()}
    assert per_file == {"data/repos/r1/tests/m.py": 4, "x/none.go": 0, "y/null.c": 0}
    status = {(r["file"], r["status"], r["function_count"]) for r in X.file_status(files, table).collect()}
    assert status == {("data/repos/r1/tests/m.py", "analyzed", 4), ("x/none.go", "empty", 0), ("y/null.c", "failed", 0)}
    total = X.extraction_summary(X.analyzed_files(files, table)).first()
    assert tuple(total) == (1, 2, 4)


# A published complexity report (nloc, ccn, token, params, length, first line).
REPORT = [
    ("s1.py", "f1", 7, 3, 29, 1, 7, 1), ("s1.py", "f2", 9, 3, 40, 1, 9, 10), ("s1.py", "f3", 15, 7, 76, 1, 15, 21),
    ("s1.py", "f4", 13, 5, 75, 2, 13, 38), ("s2.py", "g1", 6, 3, 28, 3, 6, 1), ("s2.py", "g2", 12, 5, 53, 1, 12, 9),
]


@pytest.fixture
def report(spark):
    return spark.createDataFrame(
        REPORT, "file string, function string, nloc int, ccn int, token int, params int, length int, start_line int")


def test_rollup(report):
    rows = {r["file"]: r for r in X.complexity_rollup(report).collect()}
    rounded = lambda r: (r["total_nloc"], round(r["avg_nloc"], 1), round(r["avg_ccn"], 1), round(r["avg_token"], 1),
                         r["function_count"], r["warning_count"], r["warning_rate"], r["warning_nloc_rate"])
    assert rounded(rows["s1.py"]) == (44, 11.0, 4.5, 55.0, 4, 0, 0, 0)
    assert rounded(rows["s2.py"]) == (18, 9.0, 4.0, 40.5, 2, 0, 0, 0)
    assert rounded(rows[None]) == (62, 10.3, 4.3, 50.2, 6, 0, 0, 0)


def test_listing(report):
    listed = R.complexity_listing(report).orderBy("file", "position").collect()
    assert [(r["function"], r["grade"], r["ccn"]) for r in listed] == [
        ("f3", "B", 7), ("f4", "A", 5), ("f1", "A", 3), ("f2", "A", 3), ("g2", "A", 5), ("g1", "A", 3)]


def test_source_tree(spark, tmp_path):
    content = {
        "r/__init__.py": "a", "r/__tests__/b.py": "b\r\nb", "r/E.PY": "c", "r/.hid/c.py": "d", "r/deep/1/2/3/4/x.go": "e",
        "r/readme.md": "no", "r/bad.c": "é",
    }
    for name, text in content.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode("latin-1" if name.endswith("bad.c") else "utf-8"))
    roots = [f"{tmp_path}/r", f"{tmp_path}/r/E.PY", f"{tmp_path}/absent", f"{tmp_path}/r/readme.md"]
    got = {r["path"]: r["content"] for r in read_source_files(spark, roots, base=str(tmp_path)).collect()}
    assert got == {"r/__init__.py": "a", "r/__tests__/b.py": "b\nb", "r/E.PY": "c", "r/.hid/c.py": "d",
                   "r/deep/1/2/3/4/x.go": "e", "r/bad.c": ""}
    for scheme in ("file://", "file:"):
        by_uri = read_source_files(spark, [f"{scheme}{tmp_path}/r/deep/"])
        assert [r["path"] for r in by_uri.collect()] == [f"{scheme}{tmp_path}/r/deep/1/2/3/4/x.go"]


def test_extract_and_score_a_tree(spark, tmp_path):
    (tmp_path / "repos/r1/tests").mkdir(parents=True)
    (tmp_path / "repos/r1/tests/a.py").write_text("def f(a):\n    return a\n\ndef g(a, b):\n    return a and b\n")
    (tmp_path / "repos/r1/b.js").write_text("// nothing\n")
    extracted = extract_tree(spark, [f"{tmp_path}/repos"], base=str(tmp_path))
    assert {r["function"]: r["ccn"] for r in extracted.functions.collect()} == {"f": 1, "g": 2}
    assert {r["file"]: r["function_count"] for r in extracted.files.collect()} == {
        "repos/r1/tests/a.py": 2, "repos/r1/b.js": 0}
    write_extraction(extracted, f"file://{tmp_path}/out")
    assert spark.read.csv(f"file://{tmp_path}/out/function_metrics", header=True).columns == FUNCTION_METRICS.names
    assert spark.read.json(f"file://{tmp_path}/out/summary").first()["files_skipped"] == 1
    files = read_source_files(spark, [f"{tmp_path}/repos"], base=str(tmp_path))
    ranked = score_files(files, test_flag=False).orderBy("rank").collect()
    assert [(r["function"], r["is_test_file"], r["display_score"]) for r in ranked] == [
        ("f", 0, "#1 · Low"), ("g", 0, "#2 · Low")]


def test_deep_trees_are_listed_level_by_level(spark, tmp_path):
    """Twelve levels, the last of them wide; no task lists more than the directories dealt to it."""
    deep = tmp_path.joinpath(*[f"d{i}" for i in range(11)])
    for i in range(60):
        (deep / f"wide{i}").mkdir(parents=True)
        (deep / f"wide{i}" / "m.py").write_text("x")
    (tmp_path / "d0" / "top.go").write_text("y")
    listed = list_source_files(spark, [str(tmp_path), str(deep)])
    assert sorted(r["path"] for r in listed.collect()) == sorted([f"{deep}/wide{i}/m.py" for i in range(60)] + [f"{tmp_path}/d0/top.go"])

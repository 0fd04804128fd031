"""The rules of one file on planted and clean samples, and the facts behind them."""

import pytest
from quarrylens.functions.facts import Text, dependencies, extract, facts_of
from quarrylens.operators.rules import all_findings, keyword_pattern, leaked_authority, per_fact
from quarrylens.plans.sources import SAMPLES
from quarrylens.runtime import spread


@pytest.fixture(scope="module")
def found(spark):
    """(signal, line) of each sample and of each further snippet, all in one scan."""
    rows = [(f"src/s{k}/{s.name}", f"/r/src/s{k}/{s.name}", s.text) for k, s in enumerate(SAMPLES)]
    rows += [(f"src/x{k}/a.py", f"/r/src/x{k}/a.py", text) for k, (text, _) in enumerate(MORE)]
    out: dict[str, list] = {}
    for r in per_fact(extract(spark.createDataFrame(rows, "path string, abs_path string, text string"))).collect():
        out.setdefault(r["path"], []).append((r["signal"], r["line"]))
    return out


def body(*lines: str) -> str:
    return "def f(p, q):\n" + "".join(f"    {x}\n" for x in lines)


GAP = "CI22_RESOURCE_CLEANUP_GAP"
MORE = [
    (body("return open(p)"), []),
    (body("h = open(p)", "return h"), []),
    (body("h = open(p)", "return h, 1"), []),
    (body("h = open(p)", "h.close()"), []),
    (body("h = open(p)", "x = h.read()", "h.close()", "return x"), []),
    (body("h = open(p)", "if q:", "    h.close()"), [(GAP, 2)]),
    (body("q.h = open(p)"), []),
    (body("h = open(p)", "q.h = h"), []),
    (body("h = open(p)", "with h:", "    pass"), []),
    (body("with closing(open(p)) as h:", "    pass"), []),
    (body("h = closing(open(p))", "with h:", "    pass"), []),
    (body("with ExitStack() as s:", "    h = s.enter_context(open(p))"), []),
    (body("with ExitStack() as s:", "    h = open(p)", "    s.callback(h.close)"), []),
    (body("with ExitStack() as s:", "    h = open(p)", "    s.callback(lambda: h.close())"), []),
    (body("with ExitStack() as s:", "    h = open(p)", "    s.callback(partial(close, h))"), []),
    (body("with ExitStack() as s:", "    put = s.push", "    h = open(p)", "    put(h)"), []),
    (body("s = ExitStack()", "h = open(p)", "s.callback(h.close)"), [(GAP, 3)]),
    (body("h = open(p)", "def end(x):", "    x.close()", "try:", "    use(h)", "finally:", "    end(h)"), []),
    (body("h = open(p)", "try:", "    use(h)", "except OSError:", "    h.close()", "else:", "    h.close()"), []),
    (body("h = open(p)", "try:", "    use(h)", "except OSError:", "    pass", "else:", "    h.close()"), [(GAP, 2)]),
    (body("h = open(p)", "later = lambda: h.close()", "return later"), [(GAP, 2)]),
    (body("data = open(p).read()"), [(GAP, 2)]),
    (body("h = file_path.open()", "use(h)", "if q: pass"), [(GAP, 2)]),
    (body("h = door.open()", "if q: pass"), []),
    (body("t = tempfile.NamedTemporaryFile()", "while q: pass"), [(GAP, 2)]),
    ("h = open('x')\n", [(GAP, 1)]),
    (body("x = request.args.get('q')", "db.execute('select ' + x)"), [("CI14_TAINTED_FLOW", 3)]),
    (body("x = request.method", "db.execute('select ' + x)"), []),
    (body("x = os.environ['A'].strip()", "y, z = x, 1", "eval(x)"), [("CI14_DYNAMIC_CODE_EXECUTION", 4), ("CI14_TAINTED_FLOW", 4)]),
    (body("x = int(input())", "os.system(x)"), []),
    ("try:\n    x = f()\nexcept Exception:\n    x = None\n", []),
    (body("try:", "    g()", "except Exception as e:", "    log(e)"), []),
    (body("try:", "    g()", "except (ValueError, Exception):", "    pass"), []),
    (body("try:", "    g()", "except Exception:", "    return 0"), [("CI21_BROAD_EXCEPTION_SWALLOW", 4), ("CI21_SILENT_EXCEPTION_RETURN", 4)]),
    ("import pickle\nclass pickle2: pass\nx.pickle.loads(b)\n", []),
    ("def f(pickle):\n    pickle.loads(b)\n", []),
    ("from datetime import datetime\nimport datetime as d\nd.datetime.today()\nrandom.choice(x)\n", [("CI25_ENVIRONMENT_DRIFT", 3), ("CI25_ENVIRONMENT_DRIFT", 4)]),
    ("def f(a, b, c, d, e, g=1):\n    pass\n", []),
    ("def record_it(a, b, c, d, e, g):\n    \"\"\"Best-effort.\"\"\"\n    log.info(a)\n", []),
    ("def record_it(a, b, c, d, e, g):\n    pass\n", [("CI18_PARAMETER_CLUSTER", 1)]),
    ("class A(Base):\n    def __init__(self, x):\n        self.x = x\n    def go(self):\n        return self.x.go()\n", []),
    ("class A:\n    def __init__(self, x):\n        self.x = x\n    def go(self):\n        return self.x.go() + 1\n", []),
    ("password: str = 'abcdefgh1'\ncfg.token = 'x-1234567'\ntoken = 'short'\n", [("CI14_PLAINTEXT_SECRET", 1), ("CI14_PLAINTEXT_SECRET", 2)]),
]


def test_samples(found):
    for k, s in enumerate(SAMPLES):
        assert sorted(found.get(f"src/s{k}/{s.name}", [])) == sorted(s.expected), s.name


def test_more_snippets(found):
    wrong = {text: got for k, (text, want) in enumerate(MORE) if sorted(got := found.get(f"src/x{k}/a.py", [])) != sorted(want)}
    assert not wrong


def test_facts_of_awkward_files():
    assert [f["kind"] for f in facts_of("a.py", "a.py", "def f(:")] == ["broken"]
    assert [f["kind"] for f in facts_of("a.py", "a.py", "x = 1\n\x00")] == ["broken"]
    assert list(facts_of("a.md", "a.md", "")) == []
    assert any(f["kind"] == "broken" for f in facts_of("a.py", "a.py", "(" * 3000 + ")" * 3000))
    assert [f["line"] for f in facts_of("a.yaml", "a.yaml", 'k: 1\ntoken:\n "abcdefgh"\n') if f["kind"] == "secret"] == [2]


@pytest.mark.parametrize(
    "name, text, drifting",
    [
        ("requirements-dev.txt", "a===1\nb ~= 2\n-e .\ngit+https://x\nc @ https://y\n\n# z\nd>=1,==1.2\n", ["b ~= 2"]),
        ("package.json", "[1]", []),
        ("package.json", "{broken", []),
        ("package.json", '{"dependencies": {"a": "*", "b": 1, "c": "1.0"}}', ["a"]),
        ("pyproject.toml", "broken = [", []),
        ("pyproject.toml", '[dependency-groups]\nx = ["a>1", {include = "b"}]\n[tool.poetry.group.g.dependencies]\nc = {version = "*"}\nd = {path = "."}\n', ["a>1", "c"]),
        ("Containerfile", "from a:latest as b\nFROM c\nFROM d:latest-x\n", ["a:latest"]),
    ],
)
def test_dependencies(name, text, drifting):
    assert [d for _, d, _, exact, _ in dependencies(Text(name, name, text)) if not exact] == drifting


def test_cycles_across_modules(spark):
    files = [("p/__init__.py", ""), ("p/a.py", "from . import b\nimport json\n"), ("p/b.py", "from p.c import x\n"), ("p/c.py", "import p.a\n"), ("p/d.py", "def f():\n    import p.e\n"), ("p/e.py", "import p.d\n")]
    out = [r for r in all_findings(extract(spark.createDataFrame(files, "path string, text string")), {"CI13_CIRCULAR_IMPORT"}).collect()]
    assert [(r["path"], r["excerpt"]) for r in out] == [("p/a.py", "p.a <-> p.b <-> p.c")]


def test_keywords(spark):
    assert keyword_pattern() is None and keyword_pattern(" ", "{x}") is None
    files = spark.createDataFrame([("a.md", "the helper decides\nthe helper is a side program that decides\nnothing\nA.B decides"), ("b.md", None)], "path string, text string")
    assert [r["line"] for r in leaked_authority(files, ["helper", "a.b"], ["DECIDES"]).orderBy("line").collect()] == [1, 4]
    assert leaked_authority(files, [], ["x"]).count() == 0


def test_many_small_rows_are_many_tasks(spark):
    assert spread(spark.range(100_001)).rdd.getNumPartitions() == 11
    assert spread(spark.range(5)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_walks_see_the_nodes_of_a_tree_in_their_order():
    import ast

    from quarrylens.functions.nodes import walk

    for s in SAMPLES:
        if s.name.endswith(".py") and s.name != "broken.py":
            tree = ast.parse(s.text)
            assert walk(tree) == list(ast.walk(tree)) and walk(*tree.body) == list(ast.walk(ast.Module(tree.body, [])))[1:]

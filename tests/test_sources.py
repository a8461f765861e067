import pytest
from pyspark.sql import functions as F

from skein.sources import files as S
from skein.sources import manifests as N
from skein.sources import parsers as P

SNIPPETS = {
    "rust": ("/// A store.\n#[derive(Debug)]\npub struct Store { a: u8 }\nuse std::fmt as f;\nimpl Show for Store {\n    pub fn get(&self) -> u8 {\n        1\n    }\n}\n", {("Store", "struct"), ("Store", "impl"), ("get", "function")}, ("std::fmt", "f")),
    "python": ('import os as o\nX = 1\nclass A:\n    """Doc."""\n    def m(self):\n        return 1\n', {("X", "constant"), ("A", "class"), ("m", "function")}, ("os", "o")),
    "go": ('package x\nimport "a/b"\ntype T struct {\n}\nfunc (t *T) Run() {\n}\n', {("T", "struct"), ("Run", "function")}, ("a/b", None)),
    "javascript": ("import x from './x';\nexport class A {\n}\nconst f = (a) => a;\nlet n = 3;\n", {("A", "class"), ("f", "function"), ("n", "variable")}, ("./x", None)),
    "typescript": ("import { x } from 'y';\nexport interface I {\n}\ntype T = string;\nenum E { A }\n", {("I", "interface"), ("T", "type"), ("E", "enum")}, ("y", None)),
    "java": ("import java.util.List;\npublic class A {\n  public int run(int a) {\n    return a;\n  }\n}\n", {("A", "class"), ("run", "function")}, ("java.util.List", None)),
    "csharp": ("using System.IO;\nnamespace N {\npublic interface I { }\npublic class A {\n  void Go() {\n  }\n}\n}\n", {("N", "module"), ("I", "interface"), ("A", "class"), ("Go", "function")}, ("System.IO", None)),
}


@pytest.mark.parametrize("language", list(SNIPPETS))
def test_parsers(language):
    source, want, first = SNIPPETS[language]
    got, imports = P.parse_source(source, language)
    assert {(e[0], e[1]) for e in got} == want
    assert imports[0][:2] == first
    assert all(1 <= e[2] <= e[3] <= source.count("\n") + 1 for e in got)


def test_broken_sources_fall_back_to_lines():
    got, imports = P.parse_source("import os\nclass A(:\n    def m(self):\n        x", "python")
    assert {e[0] for e in got} == {"A", "m"} and imports[0][0] == "os"
    assert P.parse_source("", "rust") == ([], [])


def test_scan(spark, tmp_path):
    for path, text in {"src/a.rs": "fn a() {}", "src/b.txt": "x", "build/c.rs": "fn c() {}", "src/build/d.rs": "fn d() {}", "x/node_modules/e.js": "1", "docs/f.py": "y = 1"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "src/bad.rs").write_bytes(b"\xff\xfe")
    got = {r.path: r.language for r in S.scan(spark, str(tmp_path), exclude=["docs/**"]).collect()}
    assert got == {"src/a.rs": "rust", "src/build/d.rs": "rust"}
    files = S.scan(spark, str(tmp_path))
    cache = files.select("path", "sha256", F.lit(1).alias("parsed"))
    reused, rest = S.cached(files, cache, spark.createDataFrame([("src/a.rs",)], "path string"))
    assert {r.path for r in rest.collect()} == {"src/a.rs"} and {r.path for r in reused.collect()} == {"src/build/d.rs", "docs/f.py"}
    S.write_cache(cache, str(tmp_path / "cache"))
    assert S.read_cache(spark, str(tmp_path / "cache"), "path string, sha256 string, parsed int").count() == 3
    assert S.read_cache(spark, str(tmp_path / "none"), "path string, sha256 string, parsed int").count() == 0


def test_sql_blocks_and_lists(spark):
    text = "-- x\nCREATE TABLE a (\n  b int\n);\ncreate table c (d int);\nCREATE TABLE open (\n"
    got = S.create_table_blocks(spark.createDataFrame([("f", text)], "path string, text string")).orderBy("start").collect()
    assert [(r.start, r.block) for r in got] == [(1, "CREATE TABLE a (\n  b int\n);"), (4, "create table c (d int);")]
    lines = [(1, "# list"), (2, "https://h/x/repo.git"), (3, "n | ./p | abc"), (4, "a|b|c|d"), (5, " ")]
    rows = S.repository_list(spark.createDataFrame(lines, "line int, text string")).orderBy("line").collect()
    assert [(r.name, r.location, r.commit, r.error) for r in rows[:2]] == [("repo", "https://h/x/repo.git", None, None), ("n", "./p", "abc", None)]
    assert rows[2].error == "line 4: malformed"


def test_manifests(spark):
    files = [
        ("Cargo.toml", '[dependencies]\nserde = "1"\ntokio = { version = "2" }\nlocal = { path = "x" }\n[dev-dependencies]\nrstest = "0.1"\n'),
        ("package.json", '{"dependencies": {"a": "^1"}, "devDependencies": {"b": 3}}'),
        ("pyproject.toml", '[project]\ndependencies = ["x>=1"]\n[project.optional-dependencies]\nt = ["y"]\n'),
        ("requirements.txt", "x==2\n# c\n-r o.txt\nz ~= 3\n"),
        ("go.mod", "module m\nrequire (\n  g/h v1 // indirect\n)\nrequire q v2\n"),
        ("sub/package.json", "not json"),
    ]
    e = N.parse(spark.createDataFrame(files, "path string, text string"))
    lock = spark.createDataFrame(list(N.cargo_lock('[[package]]\nname = "serde"\nversion = "1.0.9"\n').items()), "name string, version string")
    got = {(r.category, r.name): r.version for r in N.tech_stack(e, lock).collect()}
    assert got == {("cargo", "serde"): "1.0.9", ("cargo", "tokio"): "2", ("cargo", "local"): "", ("cargo-dev", "rstest"): "0.1", ("npm", "a"): "^1", ("npm-dev", "b"): "", ("python", "x"): ">=1", ("python", "y"): "", ("python", "z"): "~= 3", ("go", "g/h"): "v1", ("go", "q"): "v2"}

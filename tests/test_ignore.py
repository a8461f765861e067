import subprocess

import pytest

from skein.sources import files as S
from skein.sources.ignore import Ignored, rules

TREE = {
    ".gitignore": "*.gen.rs\n!keep.gen.rs\n/build2/\nlogs/**/x.rs\n# no\n\\#odd.rs\nsub/only.rs\ndeep/**\n!deep/a.rs\nspaces.rs  \n[ab]?.py\n[!a]z.go\nquiet/\n",
    "sub/.gitignore": "!*.gen.rs\n/here.rs\nlocal/\n",
    "sub/local/.gitignore": "!*\n",
}
SOURCES = [
    "a.rs", "a.gen.rs", "keep.gen.rs", "build2/a.rs", "x/build2/a.rs", "logs/x.rs", "logs/a/b/x.rs", "logs/a/y.rs", "#odd.rs", "sub/only.rs", "x/sub/only.rs", "deep/a.rs", "deep/b/c.rs", "spaces.rs", "a1.py", "c1.py", "az.go", "bz.go",
    "sub/a.gen.rs", "sub/here.rs", "sub/x/here.rs", "sub/local/a.rs", "x/quiet/a.rs", "x/quiet.rs", "odd[1].rs", "with space.rs", "node_modules/a.rs",
]


def test_scan_opens_what_it_keeps(spark, tmp_path):
    """As the version control's own answer; what is left out by its name is not among the files that are read."""
    for name, text in TREE.items() | {(n, "fn a() {}\n") for n in SOURCES}:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = S.scan(spark, str(tmp_path))
    kept = {r.path for r in got.collect()}
    try:
        subprocess.run(["git", "init", "-q", str(tmp_path)], check=True, capture_output=True)
        said = subprocess.run(["git", "-C", str(tmp_path), "check-ignore", "--stdin", "--no-index"], input="\n".join(SOURCES), capture_output=True, text=True).stdout.split("\n")
        want = {n for n in SOURCES if n not in said and f'"{n}"' not in said and not n.startswith("node_modules")}
        assert kept == want
    except FileNotFoundError:
        pytest.skip("no git")
    read = {f.rpartition(tmp_path.name + "/")[2].replace("%20", " ").replace("%5B", "[").replace("%5D", "]").replace("%23", "#") for f in got.inputFiles()}
    assert read == kept
    assert {r.path for r in S.scan(spark, str(tmp_path), ignored=["*.rs"]).collect()} == {n for n in SOURCES if not n.endswith(".rs")}


def test_nothing_comes_back_below_an_ignored_directory():
    known = Ignored({"": rules("a/\n!a/b.rs\nc/*\n!c/b.rs\n"), "a": rules("!b.rs\n")})
    assert known.file("a/b.rs") and not known.file("c/b.rs") and known.file("c/d/e.rs") and not known.file("b/a.rs")

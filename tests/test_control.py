"""Retries, locks, caches, outputs, histories, and a run from sources to pages that an incremental run leaves as a full one would."""

import os
import socket
import subprocess
import sys

import pytest

from skein import api, control
from skein.operators import graph as G
from skein.operators import retrieval as R
from skein.sources import files as S
from skein.sources import history, output


def test_retry_waits_longer_and_gives_up():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise control.Transient("busy")
        return "done"

    assert control.retry(call, sleep=waits.append) == "done" and len(waits) == 2
    with pytest.raises(control.Transient):
        control.retry(lambda: (_ for _ in ()).throw(control.Transient("no")), tries=2, sleep=waits.append)
    with pytest.raises(ValueError):
        control.retry(lambda: (_ for _ in ()).throw(ValueError("not again")), sleep=waits.append)
    assert all(w <= 8 for w in waits)


def test_one_run_at_a_time(tmp_path):
    with control.run_lock(str(tmp_path)) as held:
        assert held
        with control.run_lock(str(tmp_path), skip=True) as again:
            assert not again
        with pytest.raises(control.Busy), control.run_lock(str(tmp_path), wait_s=0.1):
            pass
    with control.run_lock(str(tmp_path)) as held:
        assert held


def test_query_vectors_are_kept_by_model():
    asked = []

    def embed(texts):
        asked.append(texts)
        return [[1.0]]

    v = control.QueryVectors(embed, "m", most=2)
    for q in ("a", "b", "a", "c", "a", "b"):
        v(q)
    assert asked == [["a"], ["b"], ["c"], ["b"]]


def test_vectors_come_in_batches_and_in_order(spark):
    texts = spark.createDataFrame([(i, f"word{i} " * (i + 1)) for i in range(45)], "id long, text string")
    got = {r.id: r.v for r in R.embed(texts, R.hashed_vector, 64).collect()}
    assert got == {i: R.hashed_vector([f"word{i} " * (i + 1)])[0] for i in range(45)}
    with pytest.raises(Exception, match="another length"):
        R.embed(texts, lambda t: [[0.0]] * len(t), 64).collect()


def test_a_failing_engine_drops_out_of_hybrid_search(spark):
    docs = spark.createDataFrame([(1, "red river"), (2, "green hill")], "node long, text string")
    postings = R.postings(docs, "node", {"text": 1})
    vectors = spark.createDataFrame([(1, [1.0, 0.0])], "node long, v array<double>")

    def broken(_):
        raise RuntimeError("no model")

    assert [r.node for r in api.search("river", postings=postings, vectors=vectors, embed=broken).collect()] == [1]
    with pytest.raises(RuntimeError):
        api.search("river", vectors=vectors, embed=broken, engine="semantic")
    index = spark.createDataFrame([("a", ["x"], ["y"])], "name string, callers array<string>, callees array<string>")
    hits = api.enriched(api.search("river", postings=postings, engine="text"), spark.createDataFrame([(1, "a")], "node long, name string"), index, "text").collect()
    assert [(r.node, r.callers, r.source) for r in hits] == [(1, ["x"], "text")]


def test_keywords_across_words_and_repeats(spark):
    pages = spark.createDataFrame([("p", "one two one two x"), ("q", "ONE two")], "page string, text string")
    asked = spark.createDataFrame([(1, "one two"), (1, "o"), (1, "o"), (1, ""), (2, "zz")], "query int, keyword string")
    got = [tuple(r) for r in R.page_hits(pages, asked).orderBy("rank").collect()]
    assert got == [(1, "p", 2 + 2 * 4, 1, "one two one two x"), (1, "q", 2 * 1, 2, "ONE two")]


def test_files_are_put_in_place(spark, tmp_path):
    files = spark.createDataFrame([("a/x.md", "one"), ("b.md", None)], "path string, content string")
    assert output.write_files(files, str(tmp_path)) == 2
    folder = output.Folder(spark, str(tmp_path))
    folder.put("b.md", "zwei é")
    assert (folder.get("a/x.md"), folder.get("b.md"), folder.get("c")) == ("one", "zwei é", None)
    assert folder.remove("b.md") and not list(tmp_path.glob("**/*.draft"))
    pages = spark.createDataFrame([("p", "P <1>", "# T\n[a](q.md)"), ("q", "Q", "text")], "page string, title string, text string")
    assert output.write_html(pages, str(tmp_path)) == 2
    assert 'href="q.html"' in folder.get("p.html") and "P &lt;1&gt;" in folder.get("index.html")
    output.write_timings(spark, str(tmp_path), {"scan": 3})
    assert folder.get("timings.json") == '{"scan": 3}'
    one = spark.createDataFrame([("a", 1)], "name string, n int")
    assert output.cached_call_index(one, str(tmp_path), "s1").collect() == one.collect()
    assert output.cached_call_index(one.limit(0), str(tmp_path), "s1").count() == 1 and output.cached_call_index(one.limit(0), str(tmp_path), "s2").count() == 0


TREE = {
    "src/net/tcp.rs": "use crate::udp_send;\npub fn tcp_send() {\n    udp_send();\n}\n", "src/net/udp.rs": "pub fn udp_send() {\n}\n",
    "src/http/server.rs": "pub fn serve() {\n    tcp_send();\n}\n", "src/http/client.rs": "pub struct Client {}\n", "tools/gen.py": "def gen():\n    return 1\n", "node_modules/x.js": "function no() {}\n", "skip/me.rs": "fn skipped() {}\n",
}


def tree(path, files):
    for name, text in files.items():
        (path / name).parent.mkdir(parents=True, exist_ok=True)
        (path / name).write_text(text)


def pages(folder):
    return {str(p.relative_to(folder)): p.read_text() for p in folder.glob("wiki/**/*.md")}


def test_an_incremental_run_ends_as_a_full_one(spark, tmp_path):
    tree(tmp_path / "repo", TREE)
    (tmp_path / "repo/.gitignore").write_text("# no\nskip/\n")
    root, out = str(tmp_path / "repo"), str(tmp_path / "out")
    first = control.run(spark, root, out)
    names = {(r.kind, r.name) for r in first.nodes.collect()}
    assert {("Function", "tcp_send"), ("File", "udp.rs"), ("Module", "net"), ("Struct", "Client"), ("Project", "project")} <= names and ("Function", "skipped") not in names
    by_id = {r.id: r.name for r in first.nodes.collect()}
    edges = {(by_id[r.src], by_id[r.dst], r.kind) for r in first.edges.collect()}
    assert {("tcp_send", "udp_send", "Calls"), ("serve", "tcp_send", "Calls"), ("net", "tcp.rs", "Contains"), ("project", "src", "Contains")} <= edges
    assert len(pages(tmp_path / "out")) == 3
    assert control.run(spark, root, out).skipped
    tree(tmp_path / "repo", {"src/net/udp.rs": "pub fn udp_send() {\n}\npub fn udp_more() {\n}\n"})
    got = control.run(spark, root, out)
    reasons = {r.path: r.reason for r in got.scope.collect()}
    assert reasons["src/net/udp.rs"] == "changed" and reasons["src/http/server.rs"] == "impact" and "tools/gen.py" not in reasons
    control.run(spark, root, str(tmp_path / "fresh"))
    assert pages(tmp_path / "out") == pages(tmp_path / "fresh")
    with control.run_lock(out):
        assert control.run(spark, root, out) is None
    assert {r.name: r.ok for r in control.doctor(spark, root, R.hashed_vector).collect()}["embedder"]
    assert control.communities_of(first).count() == 5


def test_oversized_and_odd_files_are_counted(spark, tmp_path):
    tree(tmp_path, {"a.rs": "fn a() {}\n"})
    (tmp_path / "big.rs").write_bytes(b"x" * (S.MOST_BYTES + 1))
    (tmp_path / "odd.rs").write_bytes(b"\xff\xfe")
    assert {r.path: r.reason for r in S.skipped(spark, str(tmp_path)).collect()} == {"big.rs": "oversized", "odd.rs": "no text"}
    assert [r.path for r in S.scan(spark, str(tmp_path)).collect()] == ["a.rs"]
    assert S.every_file(spark, str(tmp_path)).count() == 3


def test_history(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    try:
        git("init", "-q")
    except (OSError, subprocess.CalledProcessError):
        pytest.skip("no git")
    assert history.head(str(tmp_path)) is None
    for n, files in enumerate(({"a.rs": "fn a() {}\n", "wiki/x.md": "1"}, {"b.rs": "fn b() {}\n", "a.rs": "fn a2() {}\n"}, {"wiki/x.md": "2"})):
        tree(tmp_path, files)
        git("add", "-A")
        git("commit", "-qm", str(n))
    got = [(r.place, r.path, r.status) for r in history.commits(spark, str(tmp_path), output="wiki").orderBy("place", "path").collect()]
    assert got == [(0, "a.rs", "added"), (1, "a.rs", "modified"), (1, "b.rs", "added"), (2, None, None)]
    base = history.commits(spark, str(tmp_path)).where("place = 0").first().commit
    assert [r.name for r in history.old_entities(spark, str(tmp_path), base, ["a.rs", "b.rs"]).collect()] == ["a"]
    (tmp_path / "new é.rs").write_text("x")
    assert [r.path for r in history.work_tree(spark, str(tmp_path)).collect()] == ["new é.rs"]


def test_jaccard_of_pairs(spark):
    e = spark.createDataFrame([(1, 7), (1, 8), (2, 8), (2, 8), (3, 9)], "node int, neighbor int")
    p = spark.createDataFrame([(1, 2), (1, 3), (3, 4)], "a int, b int")
    assert {(r.a, r.b): r.jaccard for r in G.neighbor_jaccard(e, p).collect()} == {(1, 2): 0.5, (1, 3): 0.0, (3, 4): 0.0}


def test_a_dead_runs_lock_is_taken_over(tmp_path):
    gone = subprocess.run([sys.executable, "-c", "import os; print(os.getpid())"], capture_output=True, text=True).stdout.strip()
    for owner, free in ((f"{socket.gethostname()} {gone}", True), (f"elsewhere {gone}", False), (f"{socket.gethostname()} {os.getpid()}", False), ("", False)):
        (tmp_path / ".lock").write_text(owner)
        with control.run_lock(str(tmp_path), skip=True) as held:
            assert held is free
        (tmp_path / ".lock").unlink(missing_ok=True)

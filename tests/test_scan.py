import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import fixed, paths
from tidemark.operators import rules, scan
from tidemark.sources.tree import list_tree

# Put together from parts, so that this file has nothing that the scan itself would report.
HOME = "/Users" + "/bob/"
KEY = "AK" + "IA" + "ABCDEFGH01234567"


def pem(kind):
    return "-----BEGIN " + kind + "PRIVATE" + " KEY-----"


#: (path, content, [(kind, rule)])
CASES = [
    ("notes.md", HOME, ["home"]),
    ("a.PY", HOME, ["home"]),
    ("report.docx", "x", ["high-risk file"]),
    ("DB.SQLITE", "x", ["high-risk file"]),
    ("app.log", HOME, ["high-risk file"]),
    (".log", HOME, []),
    ("data.xlsx", "x", ["unapproved xlsx"]),
    ("input/简称.xlsx", "x", []),
    ("input/简称.XLSX", "x", ["unapproved xlsx"]),
    (".gitignore", HOME, ["home"]),
    ("sub/.gitignore", HOME, ["home"]),
    ("sub/__pycache__/c.py", HOME, []),
    (".git/x.txt", HOME, []),
    (".github/w.yml", HOME, ["home"]),
    ("tools/own.py", HOME, []),
    ("sub/tools/own.py", HOME, ["home"]),
    ("bad.txt", b"\xff\xfe" + HOME.encode(), []),
    ("noext", HOME, []),
    (".env", HOME, []),
    ("a.tar.gz", HOME, []),
    ("photo.png", HOME, []),
    ("two.md", HOME + " " + HOME, ["home"]),
    ("multi.md", KEY + " " + HOME, ["home", "key"]),
    ("empty.md", "", []),
    ("w1.md", "/Users" + "/a b/", []),
    ("w2.md", "/Users" + "//", []),
    ("w3.md", "/users" + "/bob/", []),
    ("w4.md", "/Users" + "/a　b/", []),
    ("u.md", "xxALICExx", ["account"]),
    ("k1.json", KEY, ["key"]),
    ("k2.json", KEY + "A", []),
    ("k2b.json", "x" + KEY, []),
    ("k2c.json", "中" + KEY, []),
    ("k3.json", "-" + KEY, ["key"]),
    ("p1.txt", pem(""), ["pem"]),
    ("p1r.txt", pem("RSA "), ["pem"]),
    ("p1e.txt", pem("EC "), ["pem"]),
    ("p1o.txt", pem("OPENSSH "), ["pem"]),
    ("p2.txt", pem("DSA "), []),
    ("d.docx/y.md", HOME, ["home"]),
    ("name with # and space.md", HOME, ["home"]),
    ("_lead.md", HOME, ["home"]),
]


@pytest.fixture
def tree(tmp_path):
    for rel, content, _ in CASES:
        p = tmp_path / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(content if isinstance(content, bytes) else content.encode())
    (tmp_path / "s.md").symlink_to(tmp_path / "nowhere")
    return str(tmp_path)


def found_in(spark, tree, names=("alice",)):
    ids = {r.shown: r.rule_id for r in rules.rule_list(names)}
    issues = scan.release_issues(spark, tree, rules.rule_list(names), own_path="tools/own.py")
    return sorted((r["rel"], ids.get(r["detail"], r["kind"])) for r in issues.collect())


def test_tree_gives_the_expected_issues(spark, tree):
    assert found_in(spark, tree) == sorted((rel, kind) for rel, _, kinds in CASES for kind in kinds)


def test_order_within_a_file_is_that_of_the_rules(spark, tree):
    issues = scan.release_issues(spark, tree, rules.rule_list(["alice"])).filter("rel = 'multi.md'").orderBy("ord")
    assert [r["detail"] for r in issues.collect()] == [fixed.HOME_RULE[1], fixed.KEY_RULE[1]]


def test_status_tells_unreadable_from_skipped(spark, tree):
    status = {r["rel"]: r["scan_status"] for r in scan.scan_status(spark, tree, "tools/own.py").collect()}
    assert status["bad.txt"] == "unreadable" and status["photo.png"] == "skipped" and status["notes.md"] == "scanned"
    assert "sub/__pycache__/c.py" not in status and "tools/own.py" not in status


def test_report_of_issues_and_of_none(spark, tree, tmp_path_factory):
    row = scan.report(scan.rendered(scan.release_issues(spark, tree, rules.rule_list([])))).first()
    assert row["verdict"] == "FAIL" and row["n_issues"] == len(row["report"].split("\n"))
    assert "high-risk file: app.log" in row["report"] and f"sensitive text: notes.md / {fixed.HOME_RULE[1]}" in row["report"]
    empty = str(tmp_path_factory.mktemp("empty"))
    row = scan.report(scan.rendered(scan.release_issues(spark, empty, rules.rule_list([])))).first()
    assert tuple(row) == ("PASS", 0, "")


def test_more_rules_than_are_unrolled_give_the_same(spark, tree):
    few, many = ["alice"], ["alice", *(f"nobody-{i}" for i in range(rules.UNROLLED))]
    assert found_in(spark, tree, few) == found_in(spark, tree, many)


def test_listing_has_hidden_files_and_no_dangling_links(spark, tree, monkeypatch):
    near = sorted(r["rel"] for r in list_tree(spark, tree).collect())
    assert ".gitignore" in near and "_lead.md" in near and "s.md" not in near and len(near) == len(CASES)
    monkeypatch.setattr("tidemark.sources.tree.DRIVER_DIRS", 0)
    assert sorted(r["rel"] for r in list_tree(spark, tree).collect()) == near


def test_listing_of_many_directories_and_of_uris(spark, tree, monkeypatch):
    near = sorted(map(tuple, list_tree(spark, tree).collect()))
    assert sorted(map(tuple, list_tree(spark, f"file://{tree}").collect())) == near
    for name, value in (("MOST_DIRS", 1), ("LISTED", 2)):
        monkeypatch.setattr(f"tidemark.sources.tree.{name}", value)
    assert sorted(map(tuple, list_tree(spark, tree).collect())) == near
    # As a file system that only pyarrow opens.
    from pyarrow import fs

    from tidemark.sources import tree as trees

    monkeypatch.setattr(trees, "_local", lambda root: None)
    found = [x for x in trees._listed(f"file://{tree}", "sub")]
    assert {x[0] for x in found} >= {"sub/.gitignore", "sub/tools"} and trees._content(f"file://{tree}", "two.md") == f"{HOME} {HOME}".encode()
    assert trees._content(f"file://{tree}", "none") is None and fs is not None


def test_exit_status_tells_whether_there_are_issues(spark, tree, tmp_path_factory, capsys):
    assert scan.main([tree, "tools/own.py"], ["alice"]) == 1
    assert "high-risk file: app.log" in capsys.readouterr().out.split("\n")
    clean = tmp_path_factory.mktemp("clean")
    (clean / "a.md").write_text("nothing here")
    assert scan.main([str(clean)], []) == 0
    assert capsys.readouterr().out == "release scan: PASS\n"


def test_long_reports_are_cut_and_written_whole(spark, tmp_path):
    issues = spark.createDataFrame([(f"f{i:03}", 0, f"line {i}") for i in range(50)], "rel string, ord int, line string")
    row = scan.report(issues.repartition(4), most=3).first()
    assert tuple(row) == ("FAIL", 50, "line 0\nline 1\nline 2")
    scan.write_report(issues.repartition(4), str(tmp_path / "report"))
    lines = [x for p in sorted((tmp_path / "report").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == [f"line {i}" for i in range(50)]


def test_account_names(spark):
    names = [r["name"] for r in rules.account_names(spark.createDataFrame([(c,) for c in ("bob", "alice", "alice", None, "", "al")], "name string")).collect()]
    assert names == ["alice", "bob"]
    assert rules.default_rules(spark, ["zed", None])[1].rule_id == "account"


@pytest.mark.parametrize(("name", "text", "hit"), [("a.b", "xA.Bx", True), ("a.b", "axb", False), ("é", "É", True), ("a\\Eb", "A\\eB", True), ("a(b", "a(b", True)])
def test_account_names_are_literal_and_in_any_case(spark, name, text, hit):
    df = spark.createDataFrame([(text,)], "text string")
    assert rules.match_rules(df, "text", [rules.Rule(0, "account", re.escape(name), rules.quoted(name))], ["text"]).count() == hit


def test_suffix(spark):
    names = {"a.PY": ".py", ".log": "", "x.": "", "a.b/c": "", "a/.b.c": ".c", "中.文": ".文", "a..b": ".b", "noext": "", "d.docx/y.md": ".md", "a\nb.txt": ".txt"}
    df = spark.createDataFrame(list(names.items()), "rel string, want string")
    assert df.filter(paths.suffix(F.col("rel")) != F.col("want")).collect() == []


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab/Users \n中AKIS019", max_size=40), max_size=6))
def test_each_rule_is_found_once_a_text_as_python_finds_it(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    found = sorted((r["i"], r["rule_id"]) for r in rules.match_rules(df, "text", rules.rule_list(["ab."]), ["i"]).collect())
    patterns = {"home": fixed.HOME_RULE[1], "account": r"(?i)ab\.", "key": fixed.KEY_RULE[1]}
    assert found == sorted((i, k) for i, t in enumerate(texts) for k, p in patterns.items() if re.search(p, t))


def test_a_cluster_must_name_a_shared_folder():
    from types import SimpleNamespace

    from tidemark.sources import shared

    def session(master, named=None):
        conf = SimpleNamespace(get=lambda key, default=None: named)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))

    assert shared.shared_dir(session("local[4]")) == shared.FALLBACK_DIR
    assert shared.shared_dir(session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,3000]"):
        with pytest.raises(ValueError, match="checkpoint"):
            shared.shared_dir(session(master))

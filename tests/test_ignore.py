"""Ignore rules against git, and the listing of a tree."""

from __future__ import annotations

import os
import shutil
import subprocess

import pytest

from evigraph.operators.ignore import ignore_rules, ignored
from evigraph.sources.listing import LocalFiles, TreeReader
from evigraph.sources.tree import source_tree

RULES = {
    "": "# note\n*.log\n!keep.log\nbuild/\n/top.txt\ndocs/**/draft.md\nsrc/*.tmp\n**/cache/x?.bin\n[a-c]1.py\n[!a-c]2.py\nsp\\ ace.txt\ntrail.txt   \n\\#hash.txt\n\\!bang.txt\nlone\\\n[bad.txt\n"
    "deep/**\n!deep/keep/\n\n/only/here\nd[[:digit:]].txt\na**b.txt\n*.tar.gz\n]x.txt\r\ncrlf.txt\r\nq[]]z.txt\n&[&&b].md",
    "src": "!x.tmp\n/inner.log\n!*.log\nlocal/\n*.py\n!main.py",
    "src/a": "main.py\n!/b/\nb",
    "build": "!*",
}
PATHS = """top.txt sub/top.txt a.log keep.log src/a.log src/inner.log src/z/inner.log build/x.py sub/build/y/z.py sub/build.txt build.py docs/draft.md docs/q/draft.md docs/q/r/draft.md docs/q/final.md
src/x.tmp src/y.tmp src/z/y.tmp cache/x1.bin p/q/cache/xy.bin cache/x12.bin a1.py d1.py d2.py a2.py sub/b1.py sp ace.txt|trail.txt #hash.txt !bang.txt lone [bad.txt deep/a deep/keep/a deep/b/c
only/here sub/only/here d7.txt dx.txt aqqb.txt a/b.txt x.tar.gz y.gz ]x.txt crlf.txt q]z.txt &b.md &c.md src/main.py src/other.py src/a/main.py src/a/b/f.txt src/local/f.md src/a/c/local/g.md
src/local local""".replace("sp ace.txt|", "sp_ace.txt ").split()
PATHS = ["sp ace.txt" if p == "sp_ace.txt" else p for p in PATHS]


def rules_of(spark, texts):
    return ignore_rules(spark.createDataFrame(list(texts.items()), "folder string, text string"))


@pytest.mark.skipif(shutil.which("git") is None, reason="git is missing")
def test_agrees_with_git(spark, tmp_path):
    run = lambda *a, **k: subprocess.run(["git", *a], cwd=tmp_path, capture_output=True, **k)
    run("init", "-q")
    for folder, text in RULES.items():
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / ".gitignore").write_bytes(text.encode())
    paths = [p for p in PATHS if p not in ("src/local",)]
    for path in paths:
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x")
    out = run("check-ignore", "--no-index", "-v", "-n", "-z", "--stdin", input="\0".join(paths).encode()).stdout.decode().split("\0")
    git = {}
    for source, line, pattern, path in zip(*[iter(out[:-1])] * 4, strict=True):
        git[path] = (source.removesuffix(".gitignore").rstrip("/"), int(line), not pattern.startswith("!")) if source else None
    got = ignored(spark.createDataFrame([(p,) for p in paths], "path string"), rules_of(spark, RULES)).collect()
    ours = {r.path: (r.rule_folder, r.rule_line, r.ignored) if r.rule is not None else None for r in got}
    assert {p: (ours[p], git[p]) for p in paths if ours[p] != git[p]} == {}
    assert sum(r.ignored for r in got) > 25


def test_tracked_repeated_and_null_paths(spark):
    paths = spark.createDataFrame([("a.log", 1), ("a.log", 2), (None, 3), ("b.log", 4), ("c.py", 5)], "path string, n int")
    tracked = spark.createDataFrame([("b.log",), ("b.log",)], "path string")
    got = {r.n: (r.ignored, r.rule) for r in ignored(paths, rules_of(spark, {"": "*.log", "x": None}), tracked).collect()}
    assert got == {1: (True, "*.log"), 2: (True, "*.log"), 3: (False, None), 4: (False, "*.log"), 5: (False, None)}
    assert ignored(paths.limit(0), rules_of(spark, {"": "*.log"})).count() == 0
    assert ignored(paths, rules_of(spark, {"": ""})).where("ignored").count() == 0


def test_tree_with_ignore_file(spark, tmp_path):
    files = {".gitignore": "*.log.py\nout/\n", "a/__init__.py": "x = 1", "a/_b.py": "y", "a/.hidden.py": "", "a/c.log.py": "", "out/d.py": "", "a/out/e.py": "", "a/.gitignore": "!c.log.py\n", ".venv/lib/f.py": ""}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    os.symlink(tmp_path / "a", tmp_path / "linked")
    os.symlink(tmp_path / "a" / "_b.py", tmp_path / "g.py")
    whole = {r.path: r.text for r in source_tree(spark, str(tmp_path)).collect()}
    assert whole == {"a/__init__.py": "x = 1", "a/_b.py": "y", "a/.hidden.py": "", "a/c.log.py": "", "out/d.py": "", "a/out/e.py": ""}
    assert sorted(r.path for r in source_tree(spark, str(tmp_path), ignore_file=".gitignore").collect()) == ["a/.hidden.py", "a/__init__.py", "a/_b.py", "a/c.log.py"]
    tracked = spark.createDataFrame([("out/d.py",)], "path string")
    assert "out/d.py" in {r.path for r in source_tree(spark, f"file://{tmp_path}", ignore_file=".gitignore", tracked=tracked).collect()}


def test_many_folders_go_to_many_tasks(spark, tmp_path, monkeypatch):
    for i in range(300):
        (tmp_path / "pkg" / f"d{i}" / "sub").mkdir(parents=True)
        for j in range(4):
            (tmp_path / "pkg" / f"d{i}" / "sub" / f"f{j}.py").write_text("")
    (tmp_path / "node_modules" / "m").mkdir(parents=True)
    (tmp_path / "node_modules" / "m" / "x.py").write_text("")
    opened = []
    entries = LocalFiles.entries
    monkeypatch.setattr(LocalFiles, "entries", lambda self, folder: opened.append(folder) or entries(self, folder))
    reader = TreeReader({"root": str(tmp_path), "suffixes": '["py"]', "excluded": '["node_modules"]', "tasks": "16"})
    parts = reader.partitions()
    assert len(parts) == 16 and len(opened) <= 3
    counts = [sum(b.num_rows for b in reader.read(p)) for p in parts]
    assert sum(counts) == 1200 and max(counts) <= 2 * 1200 / 16
    assert not any(folder.startswith("node_modules") for folder in opened)
    assert source_tree(spark, str(tmp_path)).count() == 1200


def test_missing_and_vanished_files(tmp_path):
    (tmp_path / "a.py").write_text("x")
    reader = TreeReader({"root": str(tmp_path), "suffixes": '["py"]'})
    parts = reader.partitions()
    reader._walk = lambda store, part: iter([("a.py", 1), ("gone.py", 1)])
    assert [(r["path"], r["status"]) for b in reader.read(parts[0]) for r in b.to_pylist()] == [("a.py", "read"), ("gone.py", "unreadable")]
    assert list(TreeReader({"root": str(tmp_path / "none"), "suffixes": '["py"]'}).read(parts[0])) == []

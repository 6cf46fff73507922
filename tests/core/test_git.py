import subprocess

import pytest

from tidemark.sources import git


def test_commands():
    assert git.names_command()[-1] == "HEAD" and git.names_command(until="b")[-1] == "HEAD"
    assert git.names_command("a", "b")[-1] == "a...b" and git.names_command("a")[-1] == "a"
    assert git.hunks_command(staged=True)[-1] == "--cached"


def test_hunks():
    diff = "diff --git a/x.php b/x.php\n--- a/x.php\n+++ b/x.php\n@@ -1 +3 @@\n+a\n@@ -5,2 +9,0 @@\n@@ -7,0 +12,4 @@ f\n"
    assert git.parse_hunks(diff) == [("x.php", 3, 1), ("x.php", 9, 0), ("x.php", 12, 4)]


def test_repository(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=tmp_path, check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.php").write_text("1\n2\n3\n")
    (tmp_path / "gone.php").write_text("x\n")
    run("add", "."), run("commit", "-qm", "one")
    (tmp_path / "a.php").write_text("1\ntwo\n3\n")
    (tmp_path / "gone.php").unlink()
    assert git._run(git.names_command(), str(tmp_path)).split() == ["a.php"]
    assert git.parse_hunks(git._run(git.hunks_command(), str(tmp_path))) == [("a.php", 2, 1)]
    with pytest.raises(RuntimeError):
        git._run(git.names_command("no-such-ref"), str(tmp_path))
    (tmp_path / "new.php").write_text("x")
    project = spark.createDataFrame([("a.php",), ("new.php",), ("other.php",)], "path string")
    assert sorted(r.path for r in git.php_changes_or_all(spark, str(tmp_path), project).collect()) == ["a.php", "new.php"]
    (tmp_path / ".git" / "HEAD").unlink()
    assert git.php_changes_or_all(spark, str(tmp_path), project).count() == 3

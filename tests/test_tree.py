"""The data source of trees."""

import pytest

from quarry.sources import tree
from quarry.sources.files import scan_files


@pytest.fixture
def root(tmp_path):
    base = tmp_path / "a tree %20"
    for name, data in {
        "a.cs": b"class A {}", ".env": b"K=v", "_under/x.cs": b"\xef\xbb\xbfx", ".git/HEAD": b"ref", "Bin/y.cs": b"y", "src/bin2/z.cs": b"z", "src/deep/er/w.cs": "wé".encode(), "bad.cs": b"\xff\xfe", "big.cs": b"x" * 1025, "full.cs": b"x" * 1024, "empty.cs": b"",
        "src/vendor/lib/v.cs": b"v", "vendor/k.cs": b"k",
    }.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_bytes(data)
    return base


WANT = {("a.cs", 10, "class A {}"), (".env", 3, "K=v"), ("_under/x.cs", 4, "x"), ("src/bin2/z.cs", 1, "z"), ("src/deep/er/w.cs", 3, "wé"), ("bad.cs", 2, None), ("full.cs", 1024, "x" * 1024), ("empty.cs", 0, ""), ("vendor/k.cs", 1, "k")}


@pytest.mark.parametrize("planned", [256, 2, 1])
def test_files_of_a_tree(spark, root, monkeypatch, planned):
    monkeypatch.setattr(tree, "PLANNED", planned)
    got = [tuple(r) for r in scan_files(spark, str(root), ["bin", ".git", "src\\Vendor/"], max_kb=1).collect()]
    assert sorted(got) == sorted(WANT)
    assert scan_files(spark, str(root / "none")).count() == 0 and scan_files(spark, str(root / "a.cs")).count() == 0


def test_planning_lists_few_folders_and_reads_nothing(root, monkeypatch):
    reader = tree.TreeReader({"path": f"file:{root}", "ignore": '["bin"]', "maxbytes": "1024"})
    whole = {p for part in reader.partitions() for p in part.parts}
    assert all(not below for _, below in whole)
    monkeypatch.setattr(tree, "PLANNED", 1)
    parts = [p for part in reader.partitions() for p in part.parts]
    assert sum(below for _, below in parts) == 4 and not any("Bin" in folder for folder, _ in parts)  # ignored folders are not planned
    monkeypatch.setattr(tree, "TASKS", 2)
    assert len(reader.partitions()) == 3
    monkeypatch.setattr(tree, "BATCH_FILES", 2)
    batches = [b for part in reader.partitions() for b in reader.read(part)]
    assert max(b.num_rows for b in batches) == 2 and sum(b.num_rows for b in batches) == 11


def test_files_that_have_gone(root):
    reader = tree.TreeReader({"path": str(root)})
    part = tree.Folders([(str(root / "gone"), True), (str(root / "src"), True)])
    assert sum(b.num_rows for b in reader.read(part)) == 3


def test_many_folders_are_few_tasks(tmp_path):
    for i in range(200):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "f.cs").write_text("x")
    parts = tree.TreeReader({"path": str(tmp_path)}).partitions()
    assert len(parts) == 4 and sum(len(p.parts) for p in parts) == 200


def test_clones(spark, tmp_path, monkeypatch):
    import shutil
    import subprocess

    from quarry.sources.files import clone_folder, git_clone, load_url

    if not shutil.which("git"):
        pytest.skip("no git here")
    origin = tmp_path / "svc.git"
    origin.mkdir()
    run = lambda *a: subprocess.run(["git", "-c", "user.name=x", "-c", "user.email=x@example.com", *a], cwd=origin, check=True, capture_output=True)
    run("init", "-q", "-b", "dev")
    (origin / "A.cs").write_text("class A {}")
    run("add", ".")
    run("commit", "-q", "-m", "one")
    seen = []
    monkeypatch.setenv("GIT_TOKEN", "s3cret/with:marks")
    real = subprocess.run
    monkeypatch.setattr(subprocess, "run", lambda args, **kw: (seen.append(args), real(args, **kw))[1])
    folder = clone_folder(spark)
    repo = load_url(str(origin), lambda url, branch: git_clone(url, branch, folder), "dev")
    assert (repo.name, repo.branch) == ("svc", "dev") and len(repo.commit_sha) == 40 and repo.path.startswith(folder)
    assert not any("s3cret" in x for args in seen for x in args)
    assert [r["path"] for r in scan_files(spark, repo.path).collect()] == ["A.cs"]
    helper = next(x for args in seen for x in args if x.startswith("credential.helper=!"))
    answer = real(["sh", "-c", helper.removeprefix("credential.helper=!") + " get"], capture_output=True, text=True, check=True).stdout
    assert answer == "username=git\npassword=s3cret/with:marks\n"

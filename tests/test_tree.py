"""A tree of files, of which skipped folders are not listed and other files not opened."""

import os

from patchlake.sources import files


def test_pruned_tree(spark, tmp_path):
    root = tmp_path / "tree"
    made = {
        "a.py": b"x = 1\r\n", "src/b.js": "é".encode(), "src/c.bin": b"\xff", "src/deep/er/d.go": b"\xe9", "node_modules/one/two/three/four/e.py": b"no", ".git/f.py": b"no", "empty/": b"",
        "src/node_modules/g.py": b"no", "src/README": b"no",
    }
    for path, content in made.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        if not path.endswith("/"):
            (root / path).write_bytes(content)
    (root / "empty").mkdir(exist_ok=True)
    unreadable = root / "src" / "gone.bin"
    os.symlink(tmp_path / "nowhere", unreadable)  # a file that can't be opened, and need not be
    listed = files.list_tree(spark, str(root), str(tmp_path / "levels"))
    assert sorted(r.file_path for r in listed.collect() if "gone" not in r.file_path) == ["a.py", "src/README", "src/b.js", "src/c.bin", "src/deep/er/d.go"]
    assert {r.file_path: r.size for r in listed.collect()}["a.py"] == 7
    assert sorted(os.listdir(tmp_path / "levels")) == [f"level-{k}" for k in range(4)]  # the deep skipped folder was not entered
    read = files.read_pruned_tree(spark, str(root), "o/r", str(tmp_path / "again")).collect()
    whole = {r.file_path: r.content for r in files.read_tree(spark, str(root), "o/r").collect()}
    assert {r.file_path: r.content for r in read} == whole == {"a.py": "x = 1\n", "src/b.js": "é", "src/deep/er/d.go": "é"}
    assert {r.repo for r in read} == {"o/r"}


def test_empty_tree(spark, tmp_path):
    (tmp_path / "tree").mkdir()
    assert files.read_pruned_tree(spark, f"file://{tmp_path}/tree", "o/r", str(tmp_path / "levels")).count() == 0

"""Commands over working trees on disk."""

import io
import os
import random
import stat

import pytest

from casframe import cli
from casframe.repository import Layout, Repository, RepositoryError, fsck_folder
from casframe.sources.worktree import read_worktree


def write(root, path, data):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())


def fill(root):
    write(root, "alpha.txt", "alpha\n")
    write(root, "nested/beta.txt", "beta\n")
    write(root, "nested/deeper/gamma.txt", "gamma\n")
    write(root, "tool.sh", "#!/bin/sh\n")
    os.chmod(os.path.join(root, "tool.sh"), 0o755)
    write(root, "caf\u00e9.txt", "caf\u00e9\n")
    os.symlink("alpha.txt", os.path.join(root, "link"))
    os.makedirs(os.path.join(root, "hollow"))


def listing(root):
    out = {}
    for folder, dirs, files in os.walk(root):
        if ".casframe" in dirs:
            dirs.remove(".casframe")
        for d in dirs:
            out[os.path.relpath(os.path.join(folder, d), root) + "/"] = None
        for f in files:
            p = os.path.join(folder, f)
            rel = os.path.relpath(p, root)
            out[rel] = ("->", os.readlink(p)) if os.path.islink(p) else (bool(os.stat(p).st_mode & 0o111), open(p, "rb").read())
    return out


def changes(frame):
    return [(r.status, r.path) for r in frame.collect()]


def call(spark, root, *args):
    out, err = io.StringIO(), io.StringIO()
    return cli.run(["-C", str(root), *args], spark, out, err), out.getvalue(), err.getvalue()


def test_worktree_source(spark, tmp_path):
    fill(tmp_path)
    write(tmp_path, ".casframe/format", "x")
    write(tmp_path, "inner/.casframe/format", "x")
    write(tmp_path, "inner/kept", "x")
    write(tmp_path, "_hidden/.dot", "x")
    open(os.path.join(os.fsencode(tmp_path), b"bad\xff\xfename"), "w").close()
    rows = {r.path: r for r in read_worktree(spark, str(tmp_path)).collect()}
    assert set(rows) == {"alpha.txt", "nested", "nested/beta.txt", "nested/deeper", "nested/deeper/gamma.txt", "tool.sh", "caf\u00e9.txt", "link", "hollow", "inner", "inner/kept", "_hidden", "_hidden/.dot", "bad\ufffdname"}
    assert rows["tool.sh"].executable and not rows["alpha.txt"].executable
    assert (rows["link"].kind, rows["link"].link_target, rows["hollow"].kind, rows["alpha.txt"].size) == (3, "alpha.txt", 2, 6)
    os.mkfifo(tmp_path / "pipe")
    with pytest.raises(Exception, match="unsupported file type"):
        read_worktree(spark, str(tmp_path)).collect()


def test_snapshot_diff_restore(spark, tmp_path):
    root = tmp_path / "work"
    root.mkdir()
    fill(root)
    r = Repository.init(spark, str(root))
    with pytest.raises(RepositoryError):
        Repository.init(spark, str(root))
    assert len(changes(r.diff())) == 7
    first = r.snapshot(" one ")
    before = listing(root)
    assert changes(r.diff()) == []
    write(root, "alpha.txt", "changed\n")
    write(root, "hollow/child", "x")
    os.remove(root / "link")
    write(root, "link", "a file now")
    os.chmod(root / "tool.sh", 0o644)
    os.remove(root / "nested/beta.txt")
    want = [("M", "alpha.txt"), ("A", "hollow/child"), ("T", "link"), ("D", "nested/beta.txt"), ("M", "tool.sh")]
    assert changes(r.diff()) == want
    second = r.snapshot("two")
    assert changes(r.diff(first, second)) == want and changes(r.diff("HEAD~")) == want
    log = r.log().collect()
    assert [c.id for c in log] == [second, first] and [c.message for c in log] == ["two", "one"] and log[0].parents == [first]
    again = r.snapshot("nothing new")
    assert again != second and changes(r.diff("@~", "@")) == []
    write(root, "dirty", "x")
    with pytest.raises(RepositoryError, match="changes"):
        r.restore(first)
    r.restore(first, force=True)
    assert listing(root) == before and r.head() == again and not os.path.exists(root / ".casframe/cache")
    other = tmp_path / "copy"
    r.restore("HEAD~1", str(other))
    assert listing(other)["alpha.txt"] == (False, b"changed\n") and stat.S_IMODE(os.stat(other / "alpha.txt").st_mode) == 0o600
    for bad in ("/", str(root / "inside"), str(tmp_path), os.path.expanduser("~")):
        with pytest.raises(RepositoryError):
            r.restore(first, bad, force=True)
    with pytest.raises(RepositoryError, match="not empty"):
        r.restore(first, str(other))
    for bad in ("", "a\0b"):
        with pytest.raises(RepositoryError):
            r.snapshot(bad)


def test_lock_and_marker(spark, tmp_path):
    r = Repository.init(spark, str(tmp_path))
    with r.lock(), pytest.raises(RepositoryError, match="lock"):
        r.snapshot("x")
    (tmp_path / ".casframe/restore-in-progress").write_text(f"{'ab' * 32}\n{r.root}\n")
    with pytest.raises(RepositoryError, match="interrupted"):
        r.snapshot("x")
    with pytest.raises(RepositoryError, match="interrupted"):
        r.diff()
    assert ("warning", None, "a restore was interrupted") in fsck_folder(spark, str(tmp_path))


def test_unchanged_files_come_from_the_cache(spark, tmp_path, monkeypatch):
    fill(tmp_path)
    for p in ("alpha.txt", "tool.sh"):
        os.utime(tmp_path / p, ns=(10**18, 10**18))
    r = Repository.init(spark, str(tmp_path))
    r.snapshot("one")
    os.chmod(tmp_path / "alpha.txt", 0)
    if os.geteuid():  # root reads it anyway
        assert {x.path for x in r.scan().collect()} >= {"alpha.txt"}
    os.chmod(tmp_path / "alpha.txt", 0o644)
    write(tmp_path, "alpha.txt", "omega\n")  # same size, same time: taken for unchanged
    os.utime(tmp_path / "alpha.txt", ns=(10**18, 10**18))
    assert changes(r.diff()) == []


def versions(n):
    r = random.Random(1)
    lines = [f"line {i} {r.random()}\n" for i in range(1200)]
    for _ in range(n):
        for _ in range(5):
            lines[r.randrange(len(lines))] = f"edit {r.random()}\n"
        yield "".join(lines)


def stored(root):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(root / ".casframe/objects") for f in files)


def test_repack(spark, tmp_path):
    r = Repository.init(spark, str(tmp_path))
    with pytest.raises(RepositoryError, match="format 1"):
        r.repack()
    ids = []
    for i, text in enumerate(versions(6)):
        write(tmp_path, "doc.txt", text)
        write(tmp_path, "small", str(i))
        ids.append(r.snapshot(f"v{i}"))
        if i == 2:
            assert r.upgrade() and not r.upgrade()
    before = stored(tmp_path)
    dry = r.repack(dry_run=True).where("form <> 'keep'").collect()
    assert stored(tmp_path) == before
    done = r.repack().where("form <> 'keep'").collect()
    assert sorted(map(tuple, dry)) == sorted(map(tuple, done)) and sum(c.form == "delta" for c in done) == 5
    assert stored(tmp_path) < before / 2 and before - stored(tmp_path) == sum(c.before - c.after for c in done)
    assert [f for f in fsck_folder(spark, str(tmp_path)) if f[0] == "error"] == []
    assert r.repack().where("form <> 'keep'").collect() == []
    for commit, text in zip(ids, versions(6), strict=True):
        r.restore(commit, force=True)
        assert (tmp_path / "doc.txt").read_text() == text


def test_swapped_names_make_no_cycle(spark, tmp_path):
    r = Repository.init(spark, str(tmp_path))
    r.upgrade()
    a, b = versions(2)
    for x, y in ((a, b), (b, a), (a, b)):
        write(tmp_path, "a.txt", x)
        write(tmp_path, "b.txt", y)
        r.snapshot("swap")
        r.repack()
        assert [f for f in fsck_folder(spark, str(tmp_path)) if f[0] == "error"] == []


def test_search(spark, tmp_path):
    r = Repository.init(spark, str(tmp_path))
    write(tmp_path, "pay.txt", "Payment systems process transactions between banks.\n")
    write(tmp_path, "cats.txt", "Cats sleep all day.\n")
    write(tmp_path, "bin", b"\x01" * 100)
    r.snapshot("one\nbody")
    with pytest.raises(RepositoryError, match="index"):
        r.find("x")
    s = r.index().first()
    assert (s.blobs, s.chunks, s.skipped) == (2, 2, 1)
    best = r.find("bank transactions").first()
    assert (best.path, best.message) == ("pay.txt", "one\nbody") and "Payment" in best.snippet
    os.rename(tmp_path / "pay.txt", tmp_path / "paid.txt")
    second = r.snapshot("renamed")
    assert (r.find("banks", 1).first().path, r.find("banks", 1).first().commit_id) == ("paid.txt", second)
    from casframe.functions.codecs import decode_index

    r.export_index(str(tmp_path / "out.idx"))
    index = decode_index((tmp_path / "out.idx").read_bytes())
    assert (index.embedder, index.dim, len(index.entries)) == ("builtin-lexical-v1", 512, 2)


def test_fsck_of_broken_repositories(spark, tmp_path):
    assert fsck_folder(spark, str(tmp_path)) == [("error", None, "no metadata directory")]
    fill(tmp_path)
    r = Repository.init(spark, str(tmp_path))
    assert ("note", None, "no refs") in fsck_folder(spark, str(tmp_path))
    r.snapshot("one")
    r.snapshot("two")
    assert fsck_folder(spark, str(tmp_path)) == []
    tree = [(d, f) for d, _, files in os.walk(r.objects_dir) for f in files]
    d, f = tree[0]
    original = open(f"{d}/{f}", "rb").read()
    open(f"{d}/{f}", "wb").write(original[:-2] + b"xx")
    assert any(s == "error" for s, _, _ in fsck_folder(spark, str(tmp_path)))
    os.remove(f"{d}/{f}")
    assert any(m == "object is missing" for _, _, m in fsck_folder(spark, str(tmp_path)))
    open(f"{d}/{f}", "wb").write(original)
    (tmp_path / ".casframe/refs/heads/main").write_text("junk\n")
    assert any("not an object id" in m for _, _, m in fsck_folder(spark, str(tmp_path)))
    (tmp_path / ".casframe/HEAD").write_text("ref: ../x\n")
    (tmp_path / ".casframe/format").write_text("casframe 9\n")
    found = [m for _, _, m in fsck_folder(spark, str(tmp_path))]
    assert "HEAD is malformed" in found and any("unsupported" in m for m in found)
    with pytest.raises(RepositoryError):
        Repository.open(spark, str(tmp_path))


def test_names_that_fold_together(spark, tmp_path):
    r = Repository.init(spark, str(tmp_path))
    write(tmp_path, "d/Name", "1")
    write(tmp_path, "d/name", "2")
    c = r.snapshot("x")
    with pytest.raises(RepositoryError, match="case"):
        r.restore(c, force=True)


def test_another_layout(spark, tmp_path):
    layout = Layout(".store", "store")
    r = Repository.init(spark, str(tmp_path), layout)
    write(tmp_path, "a", "b")
    r.snapshot("x")
    assert (tmp_path / ".store/format").read_text() == "store 1\n"
    assert Repository.open(spark, str(tmp_path), layout).head()


def test_commands(spark, tmp_path):
    assert call(spark, tmp_path, "version") == (0, cli.VERSION + "\n", "")
    assert call(spark, tmp_path, "help")[0] == 0 and call(spark, tmp_path)[0] == 0
    for bad in (["nope"], ["log", "--limit", "0"], ["restore"], ["find"], ["diff", "a", "b", "c"], ["index", "--embedder", "x"]):
        assert call(spark, tmp_path, *bad)[0] == 2, bad
    assert call(spark, tmp_path, "log")[0] == 1
    assert call(spark, tmp_path, "init")[0] == 0 and call(spark, tmp_path, "init")[0] == 1
    assert call(spark, tmp_path, "log") == (0, "No snapshots yet.\n", "")
    write(tmp_path, "a\tb", "text of a file")
    code, out, _ = call(spark, tmp_path, "snapshot", "-m", "First line\nmore")
    assert code == 0 and out.startswith("Snapshot ")
    short = out.split()[1]
    assert call(spark, tmp_path, "log", "--oneline")[1] == f"{short} First line\n"
    log = call(spark, tmp_path, "log")[1].splitlines()
    assert log[0].startswith(f"commit {short}") and log[1].startswith("Date:   2") and log[2:] == ["", "    First line", "    more", ""]
    assert call(spark, tmp_path, "diff")[1] == "No changes.\n"
    os.makedirs(tmp_path / "empty")
    os.remove(tmp_path / "a\tb")
    assert call(spark, tmp_path, "diff")[1] == "D\ta\\tb\nA\tempty/\n2 changes\n"
    assert call(spark, tmp_path, "restore", "HEAD", "--force")[1] == f"Restored {short} to {os.path.realpath(tmp_path)}\n"
    assert call(spark, tmp_path, "upgrade")[1] == "Upgraded repository to format 2\n"
    assert call(spark, tmp_path, "upgrade")[1] == "repository is already format 2\n"
    assert "repack" in call(spark, tmp_path, "repack", "--dry-run")[1]
    assert call(spark, tmp_path, "index")[1] == "indexed 1 blobs (1 chunks) with builtin-lexical-v1\n"
    assert call(spark, tmp_path, "find", "file")[1].splitlines()[1] == "    text of a file"
    assert call(spark, tmp_path, "fsck")[0] == 0


def test_a_file_of_300_mib_comes_back(spark, tmp_path):
    """Above what is held at once: written, checked and restored in pieces."""
    root = tmp_path / "work"
    root.mkdir()
    piece = random.Random(1).randbytes(1 << 20)
    with open(root / "big", "wb") as f:
        for _ in range(300):
            f.write(piece)
    write(root, "small", "x")
    r = Repository.init(spark, str(root))
    first = r.snapshot("one")
    assert fsck_folder(spark, str(root)) == []
    r.restore(first, to := str(tmp_path / "copy"))
    with open(f"{to}/big", "rb") as f:
        assert all(f.read(1 << 20) == piece for _ in range(300)) and not f.read(1)
    assert open(f"{to}/small").read() == "x"
    with open(next(os.path.join(d, n) for d, _, names in os.walk(r.objects_dir) for n in names if os.path.getsize(os.path.join(d, n)) > 1 << 20), "r+b") as f:
        f.seek(1000)
        f.write(b"corrupt")
    assert any(s == "error" for s, _, _ in fsck_folder(spark, str(root)))
    with pytest.raises(RepositoryError, match="cannot be restored"):
        r.restore(first, str(tmp_path / "again"))


def test_log_reads_the_commits_it_shows_only(spark, tmp_path, monkeypatch):
    from casframe.sources import objects as store

    for i in range(30):
        write(tmp_path, f"d{i % 3}/f{i}", f"{i}")
    r = Repository.init(spark, str(tmp_path))
    ids = [r.snapshot("one"), r.snapshot("two"), r.snapshot("three")]
    read = []
    load = store.load
    monkeypatch.setattr(store, "load", lambda folder, id_, *a: (read.append(id_), load(folder, id_, *a))[1])
    monkeypatch.setattr(store, "read_objects", None)  # would read every object
    assert [x.id for x in r.log(limit=1).collect()] == ids[-1:] and read == ids[-1:]
    read.clear()
    assert r.resolve("HEAD~2") == ids[0] and set(read) == set(ids[1:])
    assert [x.message for x in r.log(ids[1][:9]).collect()] == ["two", "one"]
    assert changes(r.diff(ids[0], ids[2])) == []


def test_folders_that_are_no_part_of_the_store(spark, tmp_path):
    r = Repository.init(spark, str(tmp_path))
    write(tmp_path, "a", "x")
    r.snapshot("one")
    os.makedirs(f"{r.objects_dir}/zz/deep")
    stray = next(os.path.join(d, f) for d, _, files in os.walk(r.objects_dir) for f in files)
    os.makedirs(f"{r.objects_dir}/ee", exist_ok=True)
    open(f"{r.objects_dir}/ee/{'e' * 62}", "wb").write(open(stray, "rb").read()[:-3])  # nothing reaches it: sound or not, a warning
    found = fsck_folder(spark, str(tmp_path))
    assert {s for s, _, _ in found} == {"warning"} and sum("unexpected directory" in m for _, _, m in found) == 2

import os
import tarfile

import pytest

from tsumugi import errors
from tsumugi.sources import install as I


@pytest.fixture
def archive(folder, tmp_path):
    path = tmp_path / "tables.tar.gz"
    (tmp_path / "README.md").write_text("no table")
    with tarfile.open(path, "w:gz") as t:
        t.add(folder, "dist/tables")
        t.add(tmp_path / "README.md", "dist/README.md")
        t.add(tmp_path / "README.md", "../../entries/evil.sh")
    return str(path)


def test_archive(spark, archive, tmp_path):
    root = str(tmp_path / "root")
    d = I.install_with(spark, I.InstallOptions(archive, "1.0", root))
    assert d.lookup_by_id("1000") is not None
    names = [f for _, _, fs in os.walk(root) for f in fs]
    assert "README.md" not in names and "evil.sh" not in names
    assert not (tmp_path / "entries").exists()
    # Whole already: the archive is not read again, unless by force.
    again = I.InstallOptions(str(tmp_path / "gone"), "1.0", root)
    assert I.install_with(spark, again).count() == d.count()
    with pytest.raises(errors.DataNotFound):
        I.install_with(spark, I.InstallOptions(again.source, "1.0", root, force=True))


def test_a_broken_install_leaves_no_trace(spark, archive, tmp_path, monkeypatch):
    """An extraction that stops half-way installs nothing, and by force leaves what was there."""
    root = str(tmp_path / "root")
    real = I.shutil.copyfileobj
    left = [3]

    def stops(src, out):
        left[0] -= 1
        if left[0] < 0:
            raise OSError("disk full")
        real(src, out)

    monkeypatch.setattr(I.shutil, "copyfileobj", stops)
    with pytest.raises(errors.StorageError):
        I.install_with(spark, I.InstallOptions(archive, "1.0", root))
    assert not any(fs for _, _, fs in os.walk(root))
    monkeypatch.setattr(I.shutil, "copyfileobj", real)
    n = I.install_with(spark, I.InstallOptions(archive, "1.0", root)).count()
    left[0] = 3
    monkeypatch.setattr(I.shutil, "copyfileobj", stops)
    with pytest.raises(errors.StorageError):
        I.install_with(spark, I.InstallOptions(archive, "1.0", root, force=True))
    assert I.install_with(spark, I.InstallOptions("gone", "1.0", root)).count() == n
    monkeypatch.setattr(I.shutil, "copyfileobj", real)
    assert I.install_with(spark, I.InstallOptions(archive, "1.0", root, force=True)).count() == n
    assert not [d for d in os.listdir(os.path.join(root, "tsumugi", f"fmt{I.FORMAT_VERSION}")) if d.startswith(".")]


def test_bad_archives(spark, tmp_path):
    bad = tmp_path / "bad.tar.gz"
    bad.write_bytes(b"not an archive")
    with pytest.raises(errors.DataCorrupted):
        I.install_with(spark, I.InstallOptions(str(bad), cache_dir=str(tmp_path / "a")))
    with tarfile.open(bad, "w:gz"):
        pass
    with pytest.raises(errors.DataCorrupted):
        I.install_with(spark, I.InstallOptions(str(bad), cache_dir=str(tmp_path / "a")))
    with pytest.raises(errors.NetworkError):
        I.install_with(spark, I.InstallOptions("http://127.0.0.1:9/x.tar.gz", cache_dir=str(tmp_path / "b")))


def test_cache_root(monkeypatch, tmp_path):
    monkeypatch.setattr(I, "_cache_root", None)
    monkeypatch.delenv("XDG_CACHE_HOME", raising=False)
    monkeypatch.delenv("HOME", raising=False)
    with pytest.raises(errors.CacheDirRequired):
        I.resolved_cache_dir()
    monkeypatch.setenv("HOME", str(tmp_path))
    assert I.resolved_cache_dir() == tmp_path / ".cache"
    I.init_cache_dir(str(tmp_path / "own"))
    assert I.resolved_cache_dir() == tmp_path / "own"
    with pytest.raises(errors.CacheDirAlreadySet):
        I.init_cache_dir("/other")


def test_source_cache(tmp_path):
    def fails():
        raise OSError("no network")

    c = I.SourceCache(tmp_path / "c", "words.json", "1")
    with pytest.raises(OSError):
        c.load(fails)
    assert c.load(lambda: b"one") == b"one" == c.load(fails)
    c.file.write_bytes(b"")
    assert c.load(lambda: b"two") == b"two"
    c.stamp.unlink()
    assert c.load(fails) == b"two"  # what still is there serves
    c.load(lambda: b"three")
    with pytest.raises(OSError):  # another version's file doesn't
        I.SourceCache(tmp_path / "c", "words.json", "2").load(fails)
    assert not c.file.exists()


def test_json_in_archive(tmp_path):
    (tmp_path / "w.json").write_text("{}")
    with tarfile.open(tmp_path / "a.tgz", "w:gz") as t:
        t.add(tmp_path / "w.json", "sub/w.json")
    assert I.json_in_archive((tmp_path / "a.tgz").read_bytes()) == b"{}"


def test_codes():
    kinds = [errors.DataNotFound, errors.DataVersionMismatch, errors.DataCorrupted, errors.InvalidQuery, errors.StorageError, errors.DeserializationError, errors.CacheDirRequired, errors.NetworkError, errors.CacheDirAlreadySet]
    assert [k.code for k in kinds] == list(range(1, 10))


def test_versions(capsys):
    from tsumugi.__main__ import main

    main(["versions"])
    assert "format 4" in capsys.readouterr().out

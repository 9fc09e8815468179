"""Installing a dictionary folder from an archive, and the version-keyed source cache. Driver-side, no Spark."""

from __future__ import annotations

import os
import re
import shutil
import tarfile
import tempfile
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from io import BytesIO
from pathlib import Path

from pyspark.sql import SparkSession

from ..errors import CacheDirAlreadySet, CacheDirRequired, DataCorrupted, DataNotFound, NetworkError, StorageError
from ..schema import FORMAT_VERSION, TABLES
from .dictionary import Dictionary

MAX_BYTES = 50 * 1024 * 1024
_PART = re.compile(r"(part-[\w.-]+\.parquet|_SUCCESS)")
_cache_root: Path | None = None


@dataclass(frozen=True)
class InstallOptions:
    """source: an archive's path or URL. cache_dir: root instead of the process's. force: replace what is installed."""

    source: str
    version: str = "local"
    cache_dir: str | None = None
    force: bool = False


def init_cache_dir(path: str) -> None:
    """The cache root of this process; set once."""
    global _cache_root
    if _cache_root is not None:
        raise CacheDirAlreadySet(str(_cache_root))
    _cache_root = Path(path)


def resolved_cache_dir() -> Path:
    if _cache_root is not None:
        return _cache_root
    home = os.environ.get("XDG_CACHE_HOME") or (os.path.join(os.environ["HOME"], ".cache") if os.environ.get("HOME") else None)
    if home is None:
        raise CacheDirRequired("no HOME and no XDG_CACHE_HOME; call init_cache_dir()")
    return Path(home)


def complete(folder: Path) -> bool:
    """Whether the folder was put in place as a whole: install_with() moves nothing else there."""
    return all(any((folder / t).glob("*.parquet")) for t in TABLES)


def download(url: str) -> bytes:
    try:
        with urllib.request.urlopen(url) as r:
            data = r.read(MAX_BYTES + 1)
    except (urllib.error.URLError, OSError, ValueError) as e:
        raise NetworkError(str(e)) from e
    if len(data) > MAX_BYTES:
        raise NetworkError(f"more than {MAX_BYTES} bytes")
    return data


def extract(archive: tarfile.TarFile, target: Path) -> None:
    """Only part files of the known tables are taken, by their last two names; nothing lands elsewhere."""
    for member in archive:
        parts = Path(member.name).parts
        if not member.isfile() or len(parts) < 2 or parts[-2] not in TABLES or not _PART.fullmatch(parts[-1]):
            continue
        if member.size > MAX_BYTES:
            raise DataCorrupted(f"{member.name} has {member.size} bytes")
        to = target / parts[-2] / parts[-1]
        to.parent.mkdir(parents=True, exist_ok=True)
        with archive.extractfile(member) as src, to.open("wb") as out:
            shutil.copyfileobj(src, out)


def put_in_place(made: Path, target: Path) -> None:
    """Renames a whole folder to the target; what was installed before goes only then."""
    old = None
    if target.exists():
        old = Path(tempfile.mkdtemp(dir=target.parent, prefix=".old-")) / "tables"
        target.rename(old)
    try:
        made.rename(target)
    except OSError:
        if old is not None:
            old.rename(target)
        raise
    if old is not None:
        shutil.rmtree(old.parent, ignore_errors=True)


def install_with(spark: SparkSession, options: InstallOptions) -> Dictionary:
    """Opens what is installed under the root; where it is not whole, or by force, from the archive anew.

    The archive is extracted beside the target and renamed once it is whole, so a broken extraction leaves nothing that
    counts as installed, and a failed one by force leaves what was there.
    """
    root = Path(options.cache_dir) if options.cache_dir else resolved_cache_dir()
    target = root / "tsumugi" / f"fmt{FORMAT_VERSION}" / options.version
    if options.force or not complete(target):
        aside = None
        try:
            target.parent.mkdir(parents=True, exist_ok=True)
            aside = Path(tempfile.mkdtemp(dir=target.parent, prefix=".new-"))
            if re.match("https?://", options.source):
                archive = tarfile.open(fileobj=BytesIO(download(options.source)), mode="r:gz")
            else:
                archive = tarfile.open(options.source, mode="r:gz")
            with archive:
                extract(archive, aside / "tables")
            if not complete(aside / "tables"):
                raise DataCorrupted(f"{options.source} has not all of {', '.join(TABLES)}")
            put_in_place(aside / "tables", target)
        except FileNotFoundError as e:
            raise DataNotFound(options.source) from e
        except (tarfile.TarError, EOFError) as e:
            raise DataCorrupted(options.source) from e
        except OSError as e:
            raise StorageError(str(e)) from e
        finally:
            if aside is not None:
                shutil.rmtree(aside, ignore_errors=True)
    return Dictionary.open(spark, str(target))


def install_from_archive(spark: SparkSession, path: str) -> Dictionary:
    return install_with(spark, InstallOptions(path))


def install_from_url(spark: SparkSession, url: str) -> Dictionary:
    return install_with(spark, InstallOptions(url))


def json_in_archive(data: bytes) -> bytes:
    """The first .json file of a .tgz."""
    with tarfile.open(fileobj=BytesIO(data), mode="r:gz") as archive:
        for member in archive:
            if member.isfile() and member.name.endswith(".json"):
                return archive.extractfile(member).read()
    raise DataNotFound("no .json in the archive")


@dataclass(frozen=True)
class SourceCache:
    """One file kept with the version it belongs to."""

    folder: Path
    name: str
    version: str

    @property
    def file(self) -> Path:
        return self.folder / self.name

    @property
    def stamp(self) -> Path:
        return self.folder / f"{self.name}.version"

    def _fresh(self) -> bool:
        """A file of another version is deleted, so that no failed download can bring it back."""
        if not (self.file.exists() and self.stamp.exists()):
            return False
        try:
            if self.stamp.read_text().strip() == self.version:
                return True
        except (OSError, UnicodeDecodeError):
            pass
        self.file.unlink(missing_ok=True)
        self.stamp.unlink(missing_ok=True)
        return False

    def load(self, fetch: Callable[[], bytes]) -> bytes:
        """The cached bytes; fetched and kept if there are none, they are empty, or of another version.

        If fetching fails, a file that still is there serves.
        """
        self.folder.mkdir(parents=True, exist_ok=True)
        if self._fresh() and (data := self.file.read_bytes()):
            return data
        try:
            data = fetch()
        except Exception:
            if self.file.exists():
                return self.file.read_bytes()
            raise
        self.file.write_bytes(data)
        self.stamp.write_text(self.version)
        return data

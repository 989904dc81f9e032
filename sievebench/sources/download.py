"""Fetching raw datasets: a file by URL with a checked digest, and archives unpacked inside their folder only."""

from __future__ import annotations

import hashlib
import shutil
import tarfile
import urllib.request
import zipfile
from pathlib import Path


def fetch(url: str, path: str, sha256: str | None = None, timeout: float = 60.0) -> str:
    """Writes what the URL gives to ``path`` and returns its digest; a file that is there with the wanted digest is kept.

    A digest other than the wanted one is an error and leaves no file. The file appears whole or not at all.
    """
    target = Path(path)
    if target.exists() and sha256 is not None and digest_of(path) == sha256:
        return sha256
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(target.name + ".part")
    with urllib.request.urlopen(url, timeout=timeout) as source, part.open("wb") as out:  # noqa: S310 - the caller names the source
        shutil.copyfileobj(source, out)
    found = digest_of(str(part))
    if sha256 is not None and found != sha256:
        part.unlink()
        raise ValueError(f"{url} has the digest {found}, not {sha256}")
    part.rename(target)
    return found


def digest_of(path: str) -> str:
    total = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            total.update(block)
    return total.hexdigest()


def extract(archive: str, folder: str) -> list[str]:
    """Unpacks a zip or tar archive and returns its files, sorted; a name that leads out of the folder is an error."""
    root = Path(folder).resolve()
    root.mkdir(parents=True, exist_ok=True)

    def check(name: str) -> None:
        if not (root / name).resolve().is_relative_to(root):
            raise ValueError(f"{archive} has a file outside its folder: {name}")

    if zipfile.is_zipfile(archive):
        with zipfile.ZipFile(archive) as z:
            names = [i.filename for i in z.infolist() if not i.is_dir()]
            for name in names:
                check(name)
            z.extractall(root)
    else:
        with tarfile.open(archive) as t:
            names = [m.name for m in t.getmembers() if m.isfile()]
            for name in names:
                check(name)
            t.extractall(root, filter="data")
    return sorted(names)

"""Downloads and extraction as utilities of the driver: resumed, checked, from alternate addresses, unpacked once.

Addresses are opened by a function that is a parameter, so nothing here needs a network: `open_url` serves files and the
web, tests give their own.
"""

from __future__ import annotations

import gzip
import os
import shutil
import tarfile
import time
import urllib.request
import zipfile
from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from typing import BinaryIO

#: (address, first byte wanted) -> (stream from that byte on or from the start, whether it begins there, size in all or None)
Opener = Callable[[str, int], tuple[BinaryIO, bool, "int | None"]]


def open_url(url: str, offset: int) -> tuple[BinaryIO, bool, int | None]:
    """An address by the standard library, from a byte on where the server serves ranges."""
    request = urllib.request.Request(url, headers={"Range": f"bytes={offset}-"} if offset else {})
    answer = urllib.request.urlopen(request, timeout=60)
    begins = offset == 0 or getattr(answer, "status", 200) == 206
    size = answer.headers.get("Content-Length")
    return answer, begins, None if size is None else int(size) + (offset if begins and offset else 0)


def download(urls: str | Sequence[str], target: str | Path, attempts: int = 3, pause: float = 0.5, contains: bytes | None = None, opener: Opener = open_url) -> Path:
    """The file at `target`, fetched unless it is there: the first address, and the alternates once its attempts are used up.

    What was fetched before an error is kept in `<target>.part` and gone on with where ranges are served. The file takes its
    place only when its size is right and it holds `contains`. If all addresses fail, the last error's kind is raised
    without the address, which may hold secrets.
    """
    target = Path(target)
    if target.exists():
        return target
    part = target.with_name(target.name + ".part")
    part.parent.mkdir(parents=True, exist_ok=True)
    kind = "no address"
    for url in [urls] if isinstance(urls, str) else urls:
        for attempt in range(attempts):
            try:
                had = part.stat().st_size if part.exists() else 0
                stream, begins, size = opener(url, had)
                with stream, part.open("ab" if begins and had else "wb") as out:
                    shutil.copyfileobj(stream, out)
                if size is not None and part.stat().st_size != size:
                    raise OSError("size differs")
                if contains is not None and contains not in part.read_bytes():
                    part.unlink()
                    raise ValueError("content lacks what it must hold")
                os.replace(part, target)
                return target
            except Exception as e:
                kind = type(e).__name__
                time.sleep(pause * (attempt + 1))
        part.unlink(missing_ok=True)  # another address may serve another file
    raise RuntimeError(f"{target.name} couldn't be fetched ({kind})")


def download_all(files: Mapping[str, str | Sequence[str]], folder: str | Path, threads: int = 8, **options) -> list[Path]:
    """Several files by name, a few at a time."""
    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(lambda f: download(f[1], Path(folder) / f[0], **options), files.items()))


def spellings(identifier: str, patterns: Iterable[str]) -> list[str]:
    """The addresses under which a page may be found: each pattern with the identifier as it is, in capitals and small, once each."""
    forms = dict.fromkeys([identifier, identifier.upper(), identifier.lower(), identifier.replace(" ", ""), identifier.replace("-orig", "Orig")])
    return list(dict.fromkeys(p.format(f) for p in patterns for f in forms))


def extract(archive: str | Path, folder: str | Path) -> Path:
    """An archive (tar with any compression, zip, or one gzipped file) unpacked into a folder, once: a marker there says that it is complete. Members that lead out of the folder are an error."""
    archive, folder = Path(archive), Path(folder)
    marker = folder / f".{archive.name}.extracted"
    if marker.exists():
        return folder
    folder.mkdir(parents=True, exist_ok=True)
    top = folder.resolve()
    if zipfile.is_zipfile(archive):
        with zipfile.ZipFile(archive) as z:
            if any(not (top / n).resolve().is_relative_to(top) for n in z.namelist()):
                raise ValueError("a member leads out of the folder")
            z.extractall(folder)
    elif tarfile.is_tarfile(archive):
        with tarfile.open(archive) as t:
            t.extractall(folder, filter="data")
    elif archive.suffix == ".gz":
        with gzip.open(archive) as source, (folder / archive.stem).open("wb") as out:
            shutil.copyfileobj(source, out)
    else:
        raise ValueError(f"{archive.name} is no archive")
    marker.touch()
    return folder

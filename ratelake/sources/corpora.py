"""Fetching corpora: what is there is not fetched again. Addresses are parameters; nothing here runs without a network,
except with another ``get``."""

from __future__ import annotations

import json
import shutil
import subprocess
from collections.abc import Callable, Iterable
from pathlib import Path

from ratelake.sources.readers import extract, fetch, valid_zip

Get = Callable[[str, str], object]


def record_files(record: str) -> list[tuple[str, str]]:
    """(name, address) of the files in the JSON text of a repository record."""
    return [(f["key"], f["links"]["self"]) for f in json.loads(record)["files"]]


def fetch_files(files: Iterable[tuple[str, str]], out: str, get: Get = fetch) -> list[str]:
    """Files by name, fetched unless they are there; archives are unpacked either way. Returns what was fetched."""
    folder, new = Path(out), []
    folder.mkdir(parents=True, exist_ok=True)
    for name, url in files:
        dest = folder / name
        if not dest.exists():
            get(url, str(dest))
            new.append(name)
        extract(str(dest), out)
    return new


def fetch_tolerant(files: Iterable[tuple[str, str]], out: str, get: Get = fetch) -> dict[str, str]:
    """Like ``fetch_files``, but a file that can't be had is left out, and so is a broken archive, which is deleted.

    Returns what became of each: there, fetched, failed or broken.
    """
    folder, state = Path(out), {}
    folder.mkdir(parents=True, exist_ok=True)
    for name, url in files:
        dest = folder / name
        if dest.exists():
            state[name] = "there"
            continue
        try:
            get(url, str(dest))
        except OSError:
            state[name] = "failed"
            continue
        state[name] = "fetched" if dest.exists() else "failed"
        if state[name] == "fetched" and name.endswith(".zip"):
            if valid_zip(str(dest)):
                extract(str(dest), out)
            else:
                state[name] = "broken"
    return state


def fetch_once(url: str, out: str, marker: str, archive: str = "corpus.zip", get: Get = fetch) -> bool:
    """Fetches and unpacks an archive unless a file below ``out`` fits ``marker``; the archive goes when it is unpacked."""
    folder = Path(out)
    folder.mkdir(parents=True, exist_ok=True)
    if next(folder.glob(f"**/{marker}"), None):
        return False
    dest = folder / archive
    if not dest.exists():
        get(url, str(dest))
    extract(str(dest), out)
    dest.unlink(missing_ok=True)
    return True


def clone_and_fetch(repository: str, url: str, out: str, audio: str, get: Get = fetch, clone: Get | None = None) -> tuple[bool, bool]:
    """Labels by a clone and audio by an archive, each unless it is there; whether either was fetched."""
    clone = clone or (lambda source, dest: subprocess.run(["git", "clone", source, dest], check=True))
    labels = not Path(out).exists()
    if labels:
        clone(repository, out)
    sounds = not (Path(out) / audio).exists()
    if sounds:
        dest = Path(out) / "audio.zip"
        get(url, str(dest))
        extract(str(dest), out)
    return labels, sounds


def first_copy(patterns: Iterable[str], root: str, dest: str) -> str | None:
    """Copies the first file below ``root`` that fits one of the patterns, in their order; None if none does."""
    for pattern in patterns:
        for found in sorted(Path(root).glob(pattern)):
            Path(dest).mkdir(parents=True, exist_ok=True)
            return shutil.copy(found, dest)
    return None


def linked(source: str, dest: str) -> str:
    """``dest`` as a link to a folder that is attached elsewhere; one that is there stays."""
    at = Path(dest)
    at.parent.mkdir(parents=True, exist_ok=True)
    if not at.exists():
        at.symlink_to(source, target_is_directory=True)
    return dest


def config(path: str) -> dict:
    """Settings from a YAML file."""
    import yaml

    return yaml.safe_load(Path(path).read_text())

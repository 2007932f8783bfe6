"""Model files over HTTP: a download that goes on where it stopped, and a store of models with a default."""

from __future__ import annotations

import os
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from docspark.operators.hardware import MODEL_BYTES

PIECE = 1 << 20


class Canceled(Exception):
    """Raised between two pieces once the caller asks to stop; what was read stays for the next try."""


def download(url: str, path: str, progress: Callable[[int, int], None] = lambda done, total: None, stop: Callable[[], bool] = lambda: False, least: int = MODEL_BYTES) -> int:
    """The file at url, written beside path as .part and renamed; its bytes. A file with `least` bytes is not fetched again.

    What an earlier try has read is asked for no more (Range); a server that sends all of it nevertheless (200) starts anew.
    progress gets the bytes so far and the total, 0 if it is not known. A result of fewer bytes than the total, or than
    `least`, is an error.
    """
    target, part = Path(path), Path(f"{path}.part")
    if target.is_file() and target.stat().st_size >= least:
        return target.stat().st_size
    target.parent.mkdir(parents=True, exist_ok=True)
    done = part.stat().st_size if part.is_file() else 0
    request = urllib.request.Request(url, headers={"Range": f"bytes={done}-"} if done else {})
    try:
        answer = urllib.request.urlopen(request, timeout=60)
    except urllib.error.HTTPError as error:
        if error.code != 416:
            raise
        part.unlink()  # what was read is more than there is
        return download(url, path, progress, stop, least)
    with answer:
        if answer.status != 206:
            done = 0
        _, _, whole = answer.headers.get("Content-Range", "").rpartition("/")
        total = int(whole) if whole.isdigit() else done + int(answer.headers.get("Content-Length") or -done)
        with part.open("ab" if done else "wb") as out:
            while piece := answer.read(PIECE):
                out.write(piece)
                done += len(piece)
                progress(done, total)
                if stop():
                    raise Canceled(url)
    if done < max(total, least):
        raise OSError(f"{url}: {done} bytes of {max(total, least)}")
    os.replace(part, target)
    return done


@dataclass
class Models:
    """Models by id and address; what is going on with each, and which one is the default."""

    folder: str
    urls: dict[str, str]
    notify: Callable[[str, str, float], None] = lambda model, status, percent: None
    least: int = MODEL_BYTES
    default: str | None = None
    running: dict[str, float] = field(default_factory=dict)

    def path(self, model: str) -> Path:
        return Path(self.folder, f"{model}.gguf")

    def status(self, model: str) -> str:
        if model in self.running:
            return "downloading"
        there = self.path(model).is_file() and self.path(model).stat().st_size >= self.least
        return "available" if there else "not-downloaded"

    def fetch(self, model: str, stop: Callable[[], bool] = lambda: False) -> None:
        """Download a model. Where the default is not usable, it is the default from then on."""

        def progress(done: int, total: int) -> None:
            self.running[model] = 100 * done / total if total else 0.0
            self.notify(model, "downloading", self.running[model])

        self.running[model] = 0.0
        try:
            download(self.urls[model], str(self.path(model)), progress, stop, self.least)
        except Exception:
            del self.running[model]
            self.notify(model, "error", 0.0)
            raise
        del self.running[model]
        if self.default is None or self.status(self.default) != "available":
            self.default = model
        self.notify(model, "available", 100.0)

    def remove(self, model: str) -> None:
        """Delete a model's file; if it was the default, the first available one is."""
        if model in self.running:
            raise ValueError(f"{model} is being downloaded")
        self.path(model).unlink(missing_ok=True)
        if self.default == model:
            self.default = next((m for m in self.urls if self.status(m) == "available"), None)
        self.notify(model, "not-downloaded", 0.0)

    def set_default(self, model: str) -> None:
        if self.status(model) != "available":
            raise ValueError(f"{model} is not available")
        self.default = model

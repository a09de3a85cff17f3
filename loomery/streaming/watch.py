"""Watching a project folder: changed files are taken in, and what they touch runs and is tested again."""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from ..plans.project import Project, Result, read_folder

DEBOUNCE_S = 0.05


def snapshot(folder: str) -> dict[str, tuple[float, int]]:
    out = {}
    for top, _, names in os.walk(folder):
        for n in names:
            full = os.path.join(top, n)
            try:
                s = os.stat(full)
            except FileNotFoundError:
                continue
            out[os.path.relpath(full, folder).replace(os.sep, "/")] = (s.st_mtime, s.st_size)
    return out


class Watcher:
    """Call poll() again and again, or loop(); each returns what ran."""

    def __init__(self, project: Project, run: bool = True, test: bool = True):
        if project.folder is None:
            raise ValueError("only a project with a folder can be watched")
        self.project, self.run, self.test = project, run, test
        self.seen = snapshot(project.folder)

    def changes(self) -> list[str]:
        """Paths changed, new or gone since the last call. Changes closer than the debounce count together."""
        now = snapshot(self.project.folder)
        if now == self.seen:
            return []
        while True:
            time.sleep(DEBOUNCE_S)
            later = snapshot(self.project.folder)
            if later == now:
                break
            now = later
        changed = sorted(p for p in now.keys() | self.seen.keys() if self.seen.get(p) != now.get(p))
        self.seen = now
        return changed

    def poll(self) -> tuple[list[str], list[Result]]:
        changed = self.changes()
        if not changed:
            return [], []
        texts = read_folder(self.project.folder)
        stale: set[str] = set()
        for path in [p for p in changed if p not in texts and p in self.project.texts]:
            stale |= self.project.remove(path)
        for path in changed:
            if path in texts:
                stale |= self.project.replace(path, texts[path])
        broken = self.project.refresh(stale)
        stale -= {r.name for r in broken}
        models = sorted(n for n in stale if n in self.project.files and self.project.files[n].kind == "model")
        ran = self.project.run(*models) if models and self.run else []
        results = self.project.test(*models) if models and self.test else []
        return ran, broken + results

    def loop(self, until: Callable[[], bool], step: float = 0.2) -> None:
        while not until():
            self.poll()
            time.sleep(step)

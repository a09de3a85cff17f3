"""The graph of models, macros and tests: selection, closure, order, and running it with many workers."""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable, Iterable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait

from ..template.values import TemplateError


class CycleError(TemplateError):
    pass


class Graph:
    """Nodes by name, and for each the nodes it needs that are in the graph too."""

    def __init__(self, needs: dict[str, set[str]]):
        self.needs = {n: {u for u in us if u in needs and u != n} for n, us in needs.items()}
        self.done: set[str] = set()

    def __len__(self) -> int:
        return len(self.needs)

    def __contains__(self, name: str) -> bool:
        return name in self.needs

    def order(self) -> list[str]:
        """Every node after all it needs; by name where that leaves a choice. A cycle is an error that shows it."""
        left = {n: len(us) for n, us in self.needs.items()}
        users: dict[str, list[str]] = {}
        for n, us in self.needs.items():
            for u in us:
                users.setdefault(u, []).append(n)
        ready, out = sorted(n for n, k in left.items() if not k), []
        while ready:
            layer, ready = ready, []
            for n in layer:
                out.append(n)
                for d in users.get(n, []):
                    left[d] -= 1
                    if not left[d]:
                        ready.append(d)
            ready.sort()
        if len(out) < len(self.needs):
            raise CycleError("models need each other in a circle: " + " -> ".join(self._cycle({n for n, k in left.items() if k})))
        return out

    def _cycle(self, among: set[str]) -> list[str]:
        path, at = [], min(among)
        while at not in path:
            path.append(at)
            at = min(u for u in self.needs[at] if u in among)
        return [*path[path.index(at) :], at]

    def depth(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for n in self.order():
            out[n] = 1 + max((out[u] for u in self.needs[n]), default=-1)
        return out

    def mark_run(self, names: Iterable[str]) -> None:
        self.done |= set(names)

    def unmark_run(self, names: Iterable[str]) -> None:
        self.done -= set(names)

    def execute(self, run: Callable[[str], None], threads: int, on_error: Callable[[], None] | None = None) -> list[str]:
        """Run each node that isn't done when all it needs is. The first error stops new starts and is raised once all have ended."""
        self.order()
        users: dict[str, list[str]] = {}
        left = {n: len(us - self.done) for n, us in self.needs.items() if n not in self.done}
        for n in left:
            for u in self.needs[n]:
                users.setdefault(u, []).append(n)
        finished: list[str] = []
        error: BaseException | None = None
        with ThreadPoolExecutor(max(1, threads)) as pool:
            running: dict[Future, str] = {pool.submit(run, n): n for n in sorted(left) if not left[n]}
            while running:
                for f in wait(running, return_when=FIRST_COMPLETED).done:
                    name = running.pop(f)
                    if f.cancelled():
                        continue
                    if (e := f.exception()) is not None:
                        if error is None:
                            error = e
                            for other in running:
                                other.cancel()
                            if on_error:
                                on_error()
                        continue
                    finished.append(name)
                    self.done.add(name)
                    for d in sorted(users.get(name, [])):
                        left[d] -= 1
                        if not left[d] and error is None:
                            running[pool.submit(run, d)] = d
        if error is not None:
            raise error
        return finished


def closure(start: Iterable[str], step: Callable[[str], Iterable[str]]) -> set[str]:
    """All that is reachable from start, itself included."""
    seen = set(start)
    todo = deque(seen)
    while todo:
        for n in step(todo.popleft()):
            if n not in seen:
                seen.add(n)
                todo.append(n)
    return seen


def for_each(items: list, f: Callable, threads: int) -> list:
    """f of each item by many workers; the first error wins and stops the rest."""
    stop = threading.Event()

    def one(x):
        if stop.is_set():
            return None
        try:
            return f(x)
        except BaseException:
            stop.set()
            raise

    with ThreadPoolExecutor(max(1, threads)) as pool:
        return list(pool.map(one, items))

"""The record of what has been pulled: a small JSON file that several processes may update."""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
from collections.abc import Callable, Iterator


@contextlib.contextmanager
def _held(path: str) -> Iterator[None]:
    with open(f"{path}.lock", "w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        yield


def read(path: str) -> dict[str, dict]:
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def update(path: str, name: str, **changes: object) -> dict:
    """Merge changes into one dataset's entry; other entries stay as other processes left them. The file is replaced whole."""
    with _held(path):
        all_of = read(path)
        entry = all_of.setdefault(name, {}) | changes
        all_of[name] = entry
        with open(f"{path}.new", "w", encoding="utf-8") as f:
            json.dump(all_of, f, ensure_ascii=False, indent=1)
        os.replace(f"{path}.new", path)
    return entry


def try_all(jobs: dict[str, Callable[[], object]]) -> dict[str, object]:
    """Run every job; if some failed, raise one error that names them all, after the rest have run."""
    done, failed = {}, {}
    for name, job in jobs.items():
        try:
            done[name] = job()
        except Exception as e:  # noqa: BLE001  every failure is reported below
            failed[name] = e
    if failed:
        raise RuntimeError("; ".join(f"{n}: {e}" for n, e in failed.items()))
    return done

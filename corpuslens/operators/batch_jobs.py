"""Remote batch jobs for request files: upload, create, poll until done, download.

The service is four functions, so any endpoint (or a test) can stand behind it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Service:
    """upload(path) -> file id; create(file id) -> job id; status(job id) -> {state, output, error}; download(file id) -> bytes."""

    upload: Callable[[str], str]
    create: Callable[[str], str]
    status: Callable[[str], dict]
    download: Callable[[str], bytes]


#: States in which a job does not change any more.
FINAL = {"completed", "failed", "expired", "cancelled"}


def run_job(service: Service, path: str, out_dir: str, poll_s: float = 30, most_s: float = 30 * 3600, sleep: Callable[[float], None] = time.sleep) -> dict:
    """{path, state, files}: the job's outcome and the files written to out_dir; state "timeout" after most_s."""
    job = service.create(service.upload(path))
    waited, now = 0.0, service.status(job)
    while now["state"] not in FINAL:
        if waited >= most_s:
            return {"path": path, "state": "timeout", "files": []}
        sleep(poll_s)
        waited += poll_s
        now = service.status(job)
    written = []
    for kind in ("output", "error"):
        if now.get(kind):
            target = Path(out_dir) / f"{Path(path).stem}_{kind}.jsonl"
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_bytes(service.download(now[kind]))
            written.append(str(target))
    return {"path": path, "state": now["state"], "files": written}


def run_jobs(service: Service, paths: Iterable[str], out_dir: str, at_once: int = 1, **options) -> list[dict]:
    """The outcome of each file in path order; a file that fails does not stop the others."""

    def one(path: str) -> dict:
        try:
            return run_job(service, path, out_dir, **options)
        except Exception as error:  # noqa: BLE001  the outcome names it
            return {"path": path, "state": f"error: {error}", "files": []}

    with ThreadPoolExecutor(max_workers=at_once) as pool:
        return list(pool.map(one, sorted(paths)))

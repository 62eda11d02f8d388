"""How long it takes until what was written can be read."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from typing import Any

TARGET_P95_S = 5.0


def freshness(write: Callable[[str], None], visible: Callable[[str], bool], probes: int = 50, timeout_s: float = 30.0, poll_s: float = 0.05, clock: Callable[[], float] = time.perf_counter) -> dict[str, Any]:
    """Write a marked row and poll until it is there, again and again; the distribution in milliseconds.

    ``ok`` if every probe became visible and the 95th percentile (by index) is within the target.
    """
    run, took, lost = uuid.uuid4().hex[:8], [], 0
    for i in range(probes):
        marker = f"{run}-{i}"
        write(marker)
        began = clock()
        while not (there := visible(marker)) and clock() - began < timeout_s:
            time.sleep(poll_s)
        if there:
            took.append((clock() - began) * 1000)
        else:
            lost += 1
    took.sort()
    at = lambda q: took[round(q * (len(took) - 1))] if took else None
    p95 = at(0.95)
    return {"probes": probes, "timeouts": lost, "min_ms": at(0), "p50_ms": at(0.5), "p95_ms": p95, "max_ms": at(1), "ok": not lost and p95 is not None and p95 <= TARGET_P95_S * 1000}

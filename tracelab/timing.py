"""Wall time of driver-side calls."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable


def timed(call: Callable, report: Callable[[str, float], None] = lambda name, s: print(f"{name}: {s:.3f} s")) -> Callable:
    """``call`` with its wall time reported after each run."""

    @functools.wraps(call)
    def run(*args, **kwargs):
        began = time.perf_counter()
        try:
            return call(*args, **kwargs)
        finally:
            report(call.__name__, time.perf_counter() - began)

    return run

"""Calls to a remote model from inside a scorer: a few attempts, longer and longer apart."""

from __future__ import annotations

import random
import re
import time

# Attempts, first pause in seconds, statuses that may pass by themselves.
ATTEMPTS = 4
FIRST_PAUSE = 2.0
PASSING = frozenset({429, 500, 502, 503, 504})


def status_of(error: Exception) -> int | None:
    for name in ("code", "status_code", "status"):
        if isinstance(value := getattr(error, name, None), int):
            return value
    digits = re.sub(r"\D", "", str(error)[:4])
    return int(digits) if len(digits) == 3 else None


def calling(function, attempts: int = ATTEMPTS, pause: float = FIRST_PAUSE, sleep=time.sleep):
    """function(), again after an error of a passing or unknown status."""
    for n in range(attempts):
        try:
            return function()
        except Exception as error:
            status = status_of(error)
            if n + 1 == attempts or status is not None and status not in PASSING:
                raise
            sleep(pause * 2**n + random.uniform(0, 0.5))

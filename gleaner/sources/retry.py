"""Reading from a source that fails now and then."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from typing import TypeVar

R = TypeVar("R")
PERMANENT = (FileNotFoundError, PermissionError, ValueError, KeyError, TypeError)


def with_retries(read: Callable[[], R], what: str, tries: int = 5, first_wait: float = 1.0, most_wait: float = 60.0, permanent: tuple = PERMANENT, pause: Callable[[float], None] = time.sleep, seed: int | None = None) -> tuple[R, int]:
    """What ``read`` gives, and the number of tries it took.

    An error of a ``permanent`` kind is raised at once. After any other the read is tried again, up to
    ``tries`` times in all, after waits that double up to ``most_wait``, each shortened by up to a half
    at random so that readers don't come back together.
    """
    rng = random.Random(seed)
    for number in range(1, tries + 1):
        try:
            return read(), number
        except permanent:
            raise
        except Exception as error:
            if number == tries:
                raise RuntimeError(f"{what}: given up after {tries} tries") from error
            pause(min(most_wait, first_wait * 2 ** (number - 1)) * (1 - rng.random() / 2))
    raise ValueError("tries must be 1 or more")

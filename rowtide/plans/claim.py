"""One collector at a time: an advisory lock that readers do not take."""

from __future__ import annotations

import os

from ..functions.predicates import Refused

try:
    import fcntl
except ImportError:  # platforms without it
    fcntl = None


class Claim:
    """Hold the lock file beside a store while collecting; released with the process."""

    def __init__(self, path: str):
        if fcntl is None:
            raise Refused("this platform has no file locks, so one collector at a time cannot be enforced")
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        self.file = open(path, "a")  # noqa: SIM115
        try:
            fcntl.flock(self.file, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError:
            self.file.close()
            raise Refused(f"another collector holds {path}") from None

    def release(self) -> None:
        if not self.file.closed:
            fcntl.flock(self.file, fcntl.LOCK_UN)
            self.file.close()

    def __enter__(self) -> Claim:
        return self

    def __exit__(self, *_) -> None:
        self.release()

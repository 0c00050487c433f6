"""Repeating a step in the background: updates every few hours, embedding rounds while there is work."""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable

# Fixed values, in seconds: the pause after a failure, and the longest wait for news.
AFTER_FAILURE, LONGEST_WAIT = 60.0, 600.0


class Repeat:
    """Runs ``step`` again and again until ``stop``. A step gives the seconds to wait, or None to wait for ``wake``, at most
    ``LONGEST_WAIT``. A failure is logged and followed by a pause."""

    def __init__(self, step: Callable[[], float | None], name: str = "repeat"):
        self._step, self._name = step, name
        self._woken, self._ended = threading.Event(), threading.Event()
        self._thread = threading.Thread(target=self.run, name=name, daemon=True)

    def run(self, wait: Callable[[float], object] | None = None) -> None:
        pause = wait or self._woken.wait
        while not self._ended.is_set():
            try:
                seconds = self._step()
                seconds = LONGEST_WAIT if seconds is None else seconds
            except Exception:
                logging.getLogger("sillar").exception("%s failed", self._name)
                seconds = AFTER_FAILURE
            if not self._ended.is_set():
                pause(seconds)
                self._woken.clear()

    def start(self) -> Repeat:
        self._thread.start()
        return self

    def wake(self) -> None:
        self._woken.set()

    def stop(self, timeout: float | None = None) -> None:
        self._ended.set()
        self._woken.set()
        if self._thread.is_alive():
            self._thread.join(timeout)

"""Running an external tool from a task: its output as a stream, the end of its messages, a time limit, and nothing left running."""

from __future__ import annotations

import subprocess
import threading
from collections import deque
from collections.abc import Iterator, Sequence
from typing import IO

from .binaries import find_binary


class ToolError(RuntimeError):
    """A tool ended with an error."""


class Tool:
    """A running tool, for use in a with statement. `of` says which stream is read; the other is drained or dropped.

    The tool is found when the task starts it, on the machine of the task. After `limit` seconds it is stopped, which counts as an
    error. Leaving early (a limit in the query, a lost task) stops it too.
    """

    def __init__(self, name: str, arguments: Sequence[str], of: str = "stdout", limit: float | None = None, folder: str | None = None):
        self._said: deque[str] = deque(maxlen=20)
        self._late = False
        pipe = subprocess.PIPE
        self._p = subprocess.Popen([find_binary(name, folder), *arguments], stdin=subprocess.DEVNULL, stdout=pipe if of == "stdout" else subprocess.DEVNULL, stderr=pipe)
        self._drain = threading.Thread(target=self._listen, daemon=True) if of == "stdout" else None
        if self._drain:
            self._drain.start()
        self._timer = threading.Timer(limit, self._stop) if limit else None
        if self._timer:
            self._timer.daemon = True
            self._timer.start()

    def _stop(self) -> None:
        self._late = True
        self._p.kill()

    def _listen(self) -> None:
        for line in self._p.stderr:
            self._said.append(line.decode(errors="replace").rstrip())

    def __enter__(self) -> Tool:
        return self

    def __exit__(self, *_: object) -> None:
        if self._timer:
            self._timer.cancel()
        if self._p.poll() is None:
            self._p.kill()
        self._p.wait()
        if self._drain:
            self._drain.join()
        for stream in (self._p.stdout, self._p.stderr):
            if stream:
                stream.close()

    @property
    def stdout(self) -> IO[bytes]:
        return self._p.stdout

    def lines(self) -> Iterator[str]:
        """The lines of the error stream, as most tools report there."""
        for line in self._p.stderr:
            text = line.decode(errors="replace").rstrip()
            self._said.append(text)
            yield text

    def finish(self) -> None:
        """Wait for the end; ToolError with the tool's last messages unless it ended well."""
        code = self._p.wait()
        if self._drain:
            self._drain.join()
        if self._late:
            raise ToolError("stopped at the time limit")
        if code:
            raise ToolError("; ".join(x for x in self._said if x) or f"exit code {code}")

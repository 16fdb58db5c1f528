"""A daemon that answers each client's lines on its own connection, one line for each, in order.

For few lines at a time: the model is held in memory, as in the predictor for single
lines, and connections share it. Streams of many lines go through serve.py.
"""

from __future__ import annotations

import socketserver
import threading
from collections.abc import Callable

from ..sources.local import Command, ParseError, Predictor, parse_line

Load = Callable[[str], Predictor]


class Daemon(socketserver.ThreadingTCPServer):
    """Serves a model of a path; at most `children` connections at a time, the others wait."""

    allow_reuse_address = daemon_threads = True

    def __init__(self, load: Load, path: str, host: str = "127.0.0.1", port: int = 26542, children: int = 10):
        self.load, self.predictor = load, load(path)
        self.places = threading.BoundedSemaphore(children)
        super().__init__((host, port), _Connection)

    def answer(self, line: str) -> str | None:
        """A prediction of six decimals, an error or a command's answer; nothing for a flush."""
        current = self.predictor  # one model for the whole line, whatever is loaded meanwhile
        try:
            parse_line(line, current.spec.catalog)
        except Command as command:
            return self._loaded(command.argument) if command.name == "hogwild_load" else None
        except ParseError as error:
            return f"ERR: {error}"
        return f"{current.predict(line):.6f}"

    def _loaded(self, path: str | None) -> str:
        try:
            found = self.load(path or "")
            if found.spec.to_json() != self.predictor.spec.to_json():
                raise ValueError("another specification")
        except Exception:  # any unreadable model: the one in use stays, and the client is told
            return "ERR: hogwild_load fail"
        self.predictor = found
        return "hogwild_load success"


class _Connection(socketserver.StreamRequestHandler):
    server: Daemon

    def handle(self) -> None:
        with self.server.places:
            for raw in self.rfile:
                found = self.server.answer(raw.decode("utf-8", "replace").rstrip("\r\n"))
                if found is not None:
                    self.wfile.write(f"{found}\n".encode())
                self.wfile.flush()

"""A small HTTP front: GET reads by name or pattern, PUT commits lines."""

from __future__ import annotations

import itertools
import time
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote

from pyspark.sql import SparkSession

from .lines import iterate_lines, put
from .store import Database, Snapshot

#: A reader's snapshot serves further requests for so many seconds, or until the server's own next commit.
SNAPSHOT_SECONDS = 10


def server(spark: SparkSession, root: str, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server to be run by the caller; ``server_address`` has the port."""
    db = Database(spark, root)
    held: list[tuple[float, Snapshot]] = []

    def snapshot() -> Snapshot:
        if not held or time.time() - held[0][0] > SNAPSHOT_SECONDS:
            held[:] = [(time.time(), db.snapshot())]
        return held[0][1]

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def _answer(self, code: int, text: str = "") -> None:
            body = text.encode()
            self.send_response(code)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self) -> None:
            path, _, query = self.path.partition("?")
            begun = False
            try:
                rows = snapshot().get_filter(unquote(path.lstrip("/")))
                lines = iterate_lines(rows, time="%Y-%m-%dT%H:%M:%S%.f" if query == "human" else "nanos")
                first = next(lines, None)  # a query that fails at once is answered as failed
                self.send_response(200)
                self.send_header("Transfer-Encoding", "chunked")
                begun = True
                self.end_headers()
                for x in itertools.chain([] if first is None else [first], lines):  # streamed, not gathered
                    self._chunk(f"{x}\n".encode())
                self._chunk(b"")
            except Exception as e:
                if begun:  # the body stays without its end, so the client sees that it is cut off
                    self.close_connection = True
                else:
                    self._answer(500, f"{e}\n")

        def _chunk(self, data: bytes) -> None:
            self.wfile.write(b"%x\r\n%s\r\n" % (len(data), data))

        def _body(self) -> Iterator[bytes]:
            """The request's body in chunks."""
            if self.headers.get("Transfer-Encoding", "").lower() == "chunked":
                while size := int(self.rfile.readline().split(b";")[0], 16):
                    yield self.rfile.read(size)
                    self.rfile.readline()
                return
            left = int(self.headers.get("Content-Length", 0))
            while left:
                chunk = self.rfile.read(min(left, 1 << 20))
                if not chunk:
                    raise ConnectionError("the body is cut off")
                left -= len(chunk)
                yield chunk

        def do_PUT(self) -> None:
            try:
                put(db, self._body())
                held.clear()
                self._answer(201)
            except Exception as e:
                self._answer(500, f"{e}\n")

        def _refuse(self) -> None:
            self._answer(400)

        do_POST = do_DELETE = do_PATCH = _refuse

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)

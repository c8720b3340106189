"""A small server for the graph's page, its document and news of its changes."""

from __future__ import annotations

import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .plans.documents import page


class GraphServer:
    """Serves ``/``, ``/api/graph`` and ``/api/events`` on this machine alone, any origin allowed; port 0 takes a free one."""

    def __init__(self, document: str, port: int = 3000, keep_alive: float = 30):
        self.document, self.version, self._news = document, 0, threading.Condition()
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self) -> None:
                if self.path == "/":
                    self._send("text/html; charset=utf-8", page(None))
                elif self.path == "/api/graph":
                    self._send("application/json", outer.document)
                elif self.path == "/api/events":
                    self._follow()
                else:
                    self.send_error(404)

            def _head(self, kind: str) -> None:
                self.send_response(200)
                self.send_header("Content-Type", kind)
                self.send_header("Access-Control-Allow-Origin", "*")

            def _send(self, kind: str, text: str) -> None:
                body = text.encode()
                self._head(kind)
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def _follow(self) -> None:
                """A message for each new version, a comment when nothing happens for a while."""
                seen = outer.version
                self._head("text/event-stream")
                self.end_headers()
                try:
                    while True:
                        with outer._news:
                            outer._news.wait_for(lambda: outer.version != seen, keep_alive)
                            now = outer.version
                        self.wfile.write(f"data: {now}\n\n".encode() if now != seen else b": still here\n\n")
                        self.wfile.flush()
                        seen = now
                except (BrokenPipeError, ConnectionResetError):
                    return

            def log_message(self, *args) -> None:
                return

        self._server = ThreadingHTTPServer(("127.0.0.1", port), Handler)
        self._server.daemon_threads = True
        self.port = self._server.server_address[1]

    def replace(self, document: str) -> None:
        with self._news:
            self.document, self.version = document, self.version + 1
            self._news.notify_all()

    def run(self) -> None:
        self._server.serve_forever()

    def stop(self) -> None:
        self._server.shutdown()
        self._server.server_close()

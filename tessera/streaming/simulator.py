"""A TCP server that sends a file's lines to one client, one at a time."""

from __future__ import annotations

import socket
import sys
import time


def serve(path: str, port: int = 9999, pause: float = 0.001, host: str = "localhost") -> None:
    with socket.create_server((host, port)) as server:
        client, _ = server.accept()
        with client, open(path, encoding="utf-8") as lines:
            for line in lines:
                client.sendall(line.rstrip("\n").encode() + b"\n")
                time.sleep(pause)


if __name__ == "__main__":
    serve(sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 9999)

"""A session behind a WebSocket at /ws, in JSON-RPC messages with the fields jsonrpc, id, method and param; and a small client.

A result is {"Ok": value} or {"Err": kind}, where some kinds carry a text; what isn't a request or names no method gets an error.

Requests on the session are taken one at a time. Transactions and subscriptions belong to a connection and end with it. After each
request that may change rows, subscribers get one message for each row that came or went. Any failure that is not the session's own
is reported as DatabaseError.
"""

from __future__ import annotations

import base64
import hashlib
import json
import logging
import os
import socket
import socketserver
import struct
import threading
from typing import Any

from ..plans import ir
from ..sources import json_io
from .session import Session, SessionError

# fixed by RFC 6455
_GUID = "258EAFA5-E914-47DA-95CA-C5AB0DC85B11"
_TEXT, _BINARY, _CLOSE, _PING, _PONG = 1, 2, 8, 9, 10

_CHANGING = {"SetProgram", "UpdateInput", "ClearInput"}
_DETAILED = {"InvalidProgram", "NoSuchRelation", "TypeMismatch"}
_PLAIN = {*_CHANGING, "GetProgram", "ListRelations", "CheckTuples"}


def encoded(ty: ir.Type, value: Any) -> dict:
    """A value as JSON, tagged by its type."""
    if not isinstance(ty, str):
        return {"tuple": [encoded(t, v) for t, v in zip(ty, value)]}
    return {ty.lower(): value}


def decoded(x: dict) -> Any:
    ((tag, value),) = x.items()
    if tag == "tuple":
        return tuple(decoded(v) for v in value)
    return float(value) if tag == "real" else value


def send_frame(sock: socket.socket, kind: int, data: bytes, mask: bool) -> None:
    n = len(data)
    head = bytes([0x80 | kind])
    bit = 0x80 if mask else 0
    head += bytes([bit | n]) if n < 126 else bytes([bit | 126]) + struct.pack(">H", n) if n < 1 << 16 else bytes([bit | 127]) + struct.pack(">Q", n)
    if mask:
        key = os.urandom(4)
        head, data = head + key, _masked(data, key)
    sock.sendall(head + data)


def _masked(data: bytes, key: bytes) -> bytes:
    n = len(data)
    whole = (key * (n // 4 + 1))[:n]
    return (int.from_bytes(data, "big") ^ int.from_bytes(whole, "big")).to_bytes(n, "big")


def _exactly(stream: Any, n: int) -> bytes:
    data = stream.read(n)
    if len(data) < n:
        raise ConnectionError("the other side has gone")
    return data


def read_message(sock: socket.socket, stream: Any, mask: bool) -> bytes | None:
    """The next text or binary message, from all its frames; None at a close. Pings are answered, with a mask if mask."""
    parts = []
    while True:
        a, b = _exactly(stream, 2)
        n = b & 127
        if n > 125:
            n = struct.unpack(">H", _exactly(stream, 2))[0] if n == 126 else struct.unpack(">Q", _exactly(stream, 8))[0]
        key = _exactly(stream, 4) if b & 128 else b""
        data = _exactly(stream, n)
        if key:
            data = _masked(data, key)
        kind = a & 15
        if kind == _CLOSE:
            return None
        if kind == _PING:
            send_frame(sock, _PONG, data, mask)
        elif kind != _PONG:
            parts.append(data)
            if a & 128:
                return b"".join(parts)


class _Connection(socketserver.StreamRequestHandler):
    server: Server

    def handle(self) -> None:
        asked = self.rfile.readline().split()
        headers = {}
        while (line := self.rfile.readline().strip()):
            name, _, value = line.decode("latin-1").partition(":")
            headers[name.lower()] = value.strip()
        key = headers.get("sec-websocket-key")
        if len(asked) < 2 or asked[1].split(b"?")[0] != b"/ws" or not key:
            self.wfile.write(b"HTTP/1.1 404 Not Found\r\nContent-Length: 0\r\n\r\n")
            return
        accept = base64.b64encode(hashlib.sha1((key + _GUID).encode()).digest())
        self.wfile.write(b"HTTP/1.1 101 Switching Protocols\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Accept: " + accept + b"\r\n\r\n")
        self.own, self.begun, self.watched = f"{id(self)}", set(), {}
        self.server.peers.add(self)
        try:
            while (message := read_message(self.connection, self.rfile, False)) is not None:
                with self.server.lock:
                    self.say(self.answer(message))
                    self.server.tell()
        except ConnectionError:
            pass
        finally:
            with self.server.lock:
                self.server.peers.discard(self)
                for tx in self.begun:
                    self.server.session.rollback(tx)
                for key in self.watched.values():
                    self.server.session.unwatch(key)

    def say(self, message: dict) -> None:
        send_frame(self.connection, _BINARY, json.dumps({"jsonrpc": "2.0"} | message).encode(), False)

    def answer(self, message: bytes) -> dict:
        request_id = None
        try:
            request = json.loads(message)
            request_id = request["id"]
            method, param = request["method"], request.get("param") or {}
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            return {"id": request_id, "error": {"code": -32700, "message": f"not a request: {e!r}"}}
        try:
            return {"id": request_id, "result": {"Ok": self.call(method, param)}}
        except LookupError as e:
            if isinstance(e, KeyError):
                return {"id": request_id, "error": {"code": -32602, "message": f"missing: {e}"}}
            return {"id": request_id, "error": {"code": -32601, "message": str(e)}}
        except SessionError as e:
            detail = str(e).partition(": ")[2]
            return {"id": request_id, "result": {"Err": {e.kind: detail} if e.kind in _DETAILED else e.kind}}
        except Exception:  # noqa: BLE001 - the client is told, the server goes on
            logging.getLogger(__name__).exception("request %s", method)
            return {"id": request_id, "result": {"Err": "DatabaseError"}}

    def _tx(self, number: int) -> str:
        tx = f"{self.own}:{number}"
        if tx not in self.begun:
            raise SessionError("UnknownTransaction", str(number))
        return tx

    def call(self, method: str, param: dict) -> Any:
        session = self.server.session
        if method in _PLAIN:
            result = self.plain(method, param, None)
            self.server.stale |= method in _CHANGING
            return {"tx": {}, "response": result}
        if method.startswith("Tx") and method[2:] in _PLAIN:
            return self.plain(method[2:], param["request"], self._tx(param["tx"]))
        if method == "BeginTx":
            tx = f"{self.own}:{param['tx']}"
            session.begin(tx)
            self.begun.add(tx)
            return None
        if method == "CommitTx":
            tx = self._tx(param["tx"])
            self.begun.discard(tx)
            session.commit(tx)
            self.server.stale = True
            return {}
        if method == "GetTuples":
            ty = session._relation(param["id"], "Input", "Output").ty
            return [encoded(ty, v) for v in session.values(param["id"])]
        if method == "SubscribeWatchTuples":
            key = session.watch(param["param"]["id"], f"{self.own}:{param['id']}")
            self.watched[param["id"]] = key
            self.server.stale = True
            return None
        if method == "UnsubscribeWatchTuples":
            if param["id"] not in self.watched:
                raise SessionError("UnknownSubscription", str(param["id"]))
            session.unwatch(self.watched.pop(param["id"]))
            return None
        raise LookupError(f"no method {method}")

    def plain(self, method: str, param: dict, tx: str | None) -> Any:
        session = self.server.session
        if method == "SetProgram":
            session.set_program(json.dumps(param["program"]), tx)
        elif method == "UpdateInput":
            session.update_input(param["id"], [(u["state"], decoded(u["value"])) for u in param["updates"]], tx=tx)
        elif method == "ClearInput":
            session.clear_input(param["id"], tx)
        else:
            with session.inside(tx):
                if method == "GetProgram":
                    return json.loads(json_io.dumps(session.get_program()))
                if method == "CheckTuples":
                    return session.check_tuples(param["id"], [decoded(v) for v in param["tuples"]])
                return [r.asDict() | {"ty": json.loads(r.ty)} for r in session.list_relations().collect()]
        return None

    def news(self) -> None:
        session = self.server.session
        for number, key in list(self.watched.items()):
            name = session._watched[key][0]
            for row in session.changes(key).collect():
                state, *values = row
                value = encoded(session._relation(name, "Input", "Output").ty, session.nested(name, values))
                self.say({"id": None, "method": "WatchTuples", "param": {"id": number, "event": {"state": state, "value": value}}})


class Server(socketserver.ThreadingTCPServer):
    """Serves a session; port 0 takes a free one, which server_address[1] names. Use as a context, or call close()."""

    allow_reuse_address = daemon_threads = True

    def __init__(self, session: Session, host: str = "127.0.0.1", port: int = 0):
        self.session, self.lock, self.peers, self.stale = session, threading.RLock(), set(), False
        super().__init__((host, port), _Connection)
        threading.Thread(target=self.serve_forever, daemon=True).start()

    def tell(self) -> None:
        """Sends subscribers what has changed; one that has gone, or whose relation has, does not hold up the others."""
        if self.stale:
            self.stale = False
            for peer in list(self.peers):
                try:
                    peer.news()
                except (ConnectionError, SessionError):
                    continue

    def close(self) -> None:
        self.shutdown()
        self.server_close()

    def __exit__(self, *_: Any) -> None:
        self.close()


class Client:
    """call() sends one request and waits for its answer; events holds what subscriptions brought meanwhile."""

    def __init__(self, host: str, port: int):
        self.events: list[dict] = []
        self._next = 0
        self._sock = socket.create_connection((host, port))
        self._stream = self._sock.makefile("rb")
        key = base64.b64encode(os.urandom(16)).decode()
        head = f"GET /ws HTTP/1.1\r\nHost: {host}:{port}\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Key: {key}\r\nSec-WebSocket-Version: 13\r\n\r\n"
        self._sock.sendall(head.encode())
        if b" 101 " not in self._stream.readline():
            raise SessionError("Disconnected", "no WebSocket there")
        while self._stream.readline().strip():
            pass

    def _receive(self) -> dict:
        try:
            data = read_message(self._sock, self._stream, True)
        except ConnectionError as e:
            raise SessionError("Disconnected") from e
        if data is None:
            raise SessionError("Disconnected")
        return json.loads(data)

    def call(self, method: str, **param: Any) -> Any:
        self._next += 1
        send_frame(self._sock, _TEXT, json.dumps({"jsonrpc": "2.0", "id": self._next, "method": method, "param": param}).encode(), True)
        while True:
            got = self._receive()
            if "method" in got:
                self.events.append(got["param"])
            elif got["id"] == self._next:
                if "error" in got:
                    raise SessionError("JsonRpcError", f"{got['error']['code']} {got['error']['message']}")
                if "Err" in got["result"]:
                    e = got["result"]["Err"]
                    ((kind, detail),) = e.items() if isinstance(e, dict) else ((e, ""),)
                    raise SessionError(kind, detail)
                return got["result"]["Ok"]

    def event(self) -> dict:
        """The next event of a subscription, waiting for it."""
        while not self.events:
            self.events.append(self._receive()["param"])
        return self.events.pop(0)

    def close(self) -> None:
        try:
            send_frame(self._sock, _CLOSE, b"", True)
        finally:
            self._stream.close()
            self._sock.close()

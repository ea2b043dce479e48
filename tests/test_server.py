import json
import socket

import pytest

from lodestone.sources import json_io
from lodestone.sources.language import compile_text
from lodestone.streaming.server import Client, Server, _masked, encoded, decoded
from lodestone.streaming.session import Session, SessionError


def test_values_and_masks():
    value = (3, ("x", True), 0.5)
    assert decoded(encoded(("Integer", ("Symbol", "Boolean"), "Real"), value)) == value
    assert _masked(_masked(b"\0abcdefg\0", b"\0\1\2\3"), b"\0\1\2\3") == b"\0abcdefg\0"


def test_requests_transactions_and_feeds(spark):
    program = json.loads(json_io.dumps(compile_text("define input In (Integer, String). define output Out String. Out x :- In(i, x).")))
    row = lambda i, s: {"tuple": [{"integer": i}, {"string": s}]}
    with Server(Session(spark)) as server:
        a, b = (Client(*server.server_address) for _ in range(2))
        with pytest.raises(SessionError) as e:
            a.call("GetProgram")
        assert e.value.kind == "NoProgramLoaded"
        assert a.call("SetProgram", program=program) == {"tx": {}, "response": None}
        assert b.call("GetProgram")["response"] == program
        assert [(r["name"], r["is_input"]) for r in b.call("ListRelations")["response"]] == [("In", True), ("Out", False)]
        b.call("SubscribeWatchTuples", param={"id": "Out"}, id=7)
        long = "long" * 20000
        a.call("UpdateInput", id="In", updates=[{"state": True, "value": row(1, "x")}, {"state": True, "value": row(2, long)}])
        assert sorted((x["id"], x["event"]["value"]["string"]) for x in (b.event(), b.event())) == [(7, long), (7, "x")]
        a.call("BeginTx", tx=1)
        a.call("TxUpdateInput", tx=1, request={"id": "In", "updates": [{"state": False, "value": row(1, "x")}]})
        asked = {"id": "In", "tuples": [row(1, "x"), row(2, long)]}
        assert a.call("TxCheckTuples", tx=1, request=asked) == [False, True]
        assert b.call("CheckTuples", **asked)["response"] == [True, True]
        assert a.call("CommitTx", tx=1) == {}
        assert b.event() == {"id": 7, "event": {"state": False, "value": {"string": "x"}}}
        assert b.call("GetTuples", id="Out") == [{"string": long}]
        for method, param, kind in [("CommitTx", {"tx": 1}, "UnknownTransaction"), ("GetTuples", {"id": "No"}, "NoSuchRelation"), ("UnsubscribeWatchTuples", {"id": 8}, "UnknownSubscription"), ("Nothing", {}, "JsonRpcError"), ("GetTuples", {}, "JsonRpcError"), ("UpdateInput", {"id": "In", "updates": 5}, "DatabaseError")]:
            with pytest.raises(SessionError) as e:
                b.call(method, **param)
            assert e.value.kind == kind, method
        b.call("UnsubscribeWatchTuples", id=7)
        a.call("BeginTx", tx=2)
        a.close()
        assert b.call("ClearInput", id="In")["response"] is None
        assert b.events == [] and b.call("GetTuples", id="Out") == []
        b._sock.shutdown(socket.SHUT_RDWR)
        with pytest.raises((SessionError, OSError)):
            b.call("GetProgram")

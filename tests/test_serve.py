import io
import json
from datetime import datetime

import pytest

from folioforge.__main__ import parser, run
from folioforge.operators.catalog import CatalogError
from folioforge.plans import serve


class Fake:
    read_only = False
    tools = ["search_docs", "get_page", "list_sources", "add_source"]

    def get_page(self, source, path=None, url=None):
        if path is None and url is None:
            raise ValueError("which?")
        return f"{source}/{path}"

    def list_sources(self, as_of=None):
        return [{"name": "a", "at": datetime(2024, 1, 2)}]

    def add_source(self, spec, *a, **k):
        raise CatalogError("is there")

    def remove_source(self, name, keep):
        self.removed = (name, keep)


def test_messages():
    lines = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "get_page", "arguments": {"source": "s", "path": "p"}}}, {"id": 4, "method": "tools/call", "params": {"name": "list_sources"}}, {"id": 5, "method": "tools/call", "params": {"name": "add_source", "arguments": {"spec": "x"}}}, {"id": 6, "method": "tools/call", "params": {"name": "refresh_source"}}, {"id": 7, "method": "tools/call", "params": {"name": "get_page", "arguments": {"source": "s"}}}, {"id": 8, "method": "none"}, {"id": 9, "method": "ping"}]
    out = io.StringIO()
    serve.serve(Fake(), ["\n", *(json.dumps({"jsonrpc": "2.0"} | x) for x in lines), "no json"], out)
    got = {x["id"]: x for x in map(json.loads, out.getvalue().splitlines())}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, 8, 9, None}
    assert [t["name"] for t in got[2]["result"]["tools"]] == Fake.tools
    text = lambda i: got[i]["result"]["content"][0]["text"]
    assert json.loads(text(3)) == "s/p" and json.loads(text(4)) == [{"name": "a", "at": "2024-01-02T00:00:00"}]
    assert [got[i]["result"]["isError"] for i in (3, 5, 6, 7)] == [False, True, True, True]
    assert got[8]["error"]["code"] == -32601 and got[None]["error"]["code"] == -32700


@pytest.mark.parametrize("line,code,said", [("page s p", 0, "s/p"), ("add x", 1, "error: is there"), ("rm a --keep-files", 0, None)])
def test_commands(line, code, said):
    out, engine = [], Fake()
    assert run(engine, parser().parse_args(line.split()), out.append) == code
    assert out == ([said] if said else []) and (said or engine.removed == ("a", True))

import io
import json

import pytest

from tessera import cli
from tessera.plans.engine import Engine
from tessera.server import serve


@pytest.fixture(scope="module")
def vault(tmp_path_factory):
    folder = tmp_path_factory.mktemp("served")
    (folder / "sea.md").write_text("# Sea\n\nA lighthouse warns ships of rocks, and its keeper lights the lamp. See [[Coast]].\n")
    return folder


def talk(engine, *messages):
    out = io.StringIO()
    serve(engine, io.StringIO("\n".join(m if isinstance(m, str) else json.dumps(m) for m in messages)), out)
    return [json.loads(line) for line in out.getvalue().splitlines()]


def test_server(spark, vault, tmp_path):
    call = lambda i, name, **arguments: {"jsonrpc": "2.0", "id": i, "method": "tools/call", "params": {"name": name, "arguments": arguments}}
    replies = talk(
        Engine(spark, str(tmp_path)), {"id": 1, "method": "initialize"}, {"method": "initialized"}, {"id": 2, "method": "tools/list"}, "no json", call(3, "rebuild", workspace=str(vault)),
        call(4, "query", query="lighthouse lamp"), call(5, "query"), call(6, "nothing"), call(7, "status"), call(8, "scan", workspace=str(vault)), call(9, "compile", workspace=str(vault)), call(10, "rebuild", workspace="/no/such/folder"),
    )
    by = {r["id"]: r for r in replies}
    text = lambda i: by[i]["result"]["content"][0]["text"]
    assert len(replies) == 11 and by[None]["error"]["code"] == -32700
    assert len(by[2]["result"]["tools"]) == 5 and json.loads(text(3))["objects_indexed"] == 2
    assert "sea.md" in text(4) and by[5]["error"]["code"] == -32602 and by[6]["error"]["code"] == -32601
    assert json.loads(text(7))["active"] == 1 and json.loads(text(8)) == [] and {o["type"] for o in json.loads(text(9))} == {"concept", "implementation"}
    assert by[10]["result"]["isError"]


def test_commands(spark, vault, tmp_path, capsys):
    def run(*arguments):
        assert cli.main(["--home", str(tmp_path), *arguments]) == 0
        return capsys.readouterr().out

    assert "NEW" in run("scan", str(vault))
    assert json.loads(run("rebuild", str(vault)))["files_scanned"] == 1
    assert json.loads(run("update"))[str(vault)]["files_scanned"] == 0
    assert "sea.md" in run("query", "lighthouse") and json.loads(run("query", "--json", "--stale", "lighthouse"))[0]["name"] == "sea"
    assert json.loads(run("status"))["objects"] == 2
    assert "concept_" in run("hubs") and "concept_sea" in run("compile", str(vault))
    assert json.loads(run("parse", str(vault / "sea.md")))["links"][0]["target"] == "Coast"
    with pytest.raises(SystemExit):
        run("parse", str(vault / "sea.unknown"))
    assert "concept_coast" in run("context", "concept_sea", "--hops", "1")
    assert run("graph", "--out", str(tmp_path / "g.html")).strip().endswith("g.html") and (tmp_path / "g.html").exists()

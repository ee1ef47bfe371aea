"""The HTTP surface, end to end."""

import base64
import io
import json
import threading
import urllib.error
import urllib.request
import zipfile

import pytest

from lakeseek.functions.vectors import HashingEncoder
from lakeseek.plans import index as plans
from lakeseek.plans import server


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    http = server.serve(spark, str(tmp_path_factory.mktemp("indexes")), 0, encoder=HashingEncoder(32), chunking=plans.Chunking(max_length=200, overlap=20))
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}"
    http.shutdown()


def call(url, body=None):
    try:
        with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode() if body is not None else None)) as r:
            return r.status, r.read().decode()
    except urllib.error.HTTPError as error:
        return error.code, error.read().decode()


def test_flow(base, tmp_path):
    (tmp_path / "a.py").write_text("def resolve():\n    return 'redirects'\n")
    status, lines = call(f"{base}/api/index", {"path": str(tmp_path), "name": "one"})
    events = [json.loads(x) for x in lines.splitlines()]
    assert status == 200 and events[0]["event"] == "log" and events[-1]["event"] == "done"
    assert [x["name"] for x in json.loads(call(f"{base}/api/indexes")[1])] == ["one"]
    assert json.loads(call(f"{base}/api/indexes/one")[1])["documents"] == 1
    result = json.loads(call(f"{base}/api/query", {"index": "one", "query": "redirects"})[1])["results"][0]
    assert result["doc_id"] == "a.py" and result["hits"][0]["snippet"]["status"] == "ok"
    for body, want in (({"index": "none", "query": "x"}, 404), ({"index": "../x", "query": "x"}, 400), ({"index": "one", "query": " "}, 422), ({"index": "one", "query": "x", "top_k": 101}, 422)):
        assert call(f"{base}/api/query", body)[0] == want
    assert call(base)[0] == 200 and call(f"{base}/nope")[0] == 404


def test_zip_upload_and_errors(base):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("top/b.py", "beta = 1\n")
    events = [json.loads(x) for x in call(f"{base}/api/index", {"zip": base64.b64encode(data.getvalue()).decode(), "name": "two"})[1].splitlines()]
    assert events[-1]["event"] == "done"
    assert json.loads(call(f"{base}/api/index", {"path": "/no/such"})[1].splitlines()[-1])["event"] == "error"
    assert server.parse_versions("last 3") == (None, 3) and server.parse_versions("v1, v2") == (["v1", "v2"], None) and server.parse_versions("2") == (None, 2)

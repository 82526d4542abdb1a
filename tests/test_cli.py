import json
import os
import subprocess
import sys

HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(*args):
    return subprocess.run([sys.executable, "-m", "lodestone", *args], cwd=HOME, capture_output=True, text=True, timeout=300)


def test_one_value_out_and_reuse(tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("some words to count")
    out = tmp_path / "d" / "out.json"
    first = run(str(tmp_path / "d"), "-o", str(out))
    assert first.returncode == 0, first.stderr[-2000:]
    bundle = json.loads(first.stdout)
    assert [f["path"] for f in bundle["files"]] == ["a.txt"] and json.loads(out.read_text()) == bundle
    assert any(json.loads(x)["type"] == "progress" for x in first.stderr.splitlines() if x.startswith("{"))
    second = run(str(tmp_path / "d"), str(out))
    assert json.loads(second.stdout)["summary"]["cache_hits"] == 1


def test_errors_are_lines_with_codes(tmp_path):
    bad = run(str(tmp_path / "absent"), "--workers", "99")
    assert bad.returncode == 2 and json.loads(bad.stderr.splitlines()[-1])["error"]["code"] == "invalid_request"

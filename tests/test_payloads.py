"""Payloads as a data source: forms, pieces, rejects, and a stream that reads each file once."""

from __future__ import annotations

import json
import random

import pytest

from winnow.sources import payloads as ps
from winnow.sources import registry


def put(root, path, body):
    file = root / path
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_bytes(body if isinstance(body, bytes) else body.encode())


FAULTY = {
    "json": [("[1]", None), ("[1", "not JSON"), ("", "empty"), (b"\xff[]", "not UTF-8 at byte 0"), ("[" * 200_000, "not JSON")],
    "lines": [("{}", None), ("3", "not an object")],
    "xml": [("<a><b/></a>", None), ("<a><b></a>", "not XML"), (" \n", "empty")],
    "html": [("<p>any<b>", None), (b"\xc3(", "not UTF-8 at byte 0")],
}


@pytest.mark.parametrize(("form", "raw", "want"), [(f, r, w) for f, cases in FAULTY.items() for r, w in cases])
def test_faults(form, raw, want):
    got = ps.fault(form, raw if isinstance(raw, bytes) else raw.encode())
    assert got == want if want is None or "UTF" in want else got.startswith(want)


def test_lines_of_all_pieces_are_the_lines(tmp_path, monkeypatch):
    """Whatever the pieces and chunks, every line is read once, at its byte."""
    monkeypatch.setattr(ps, "CHUNK", 7)
    rng = random.Random(3)
    for k in range(60):
        raw = b"\n".join(bytes(rng.choices(b"ab\r", k=rng.choice([0, 1, 5, 6, 7, 30]))) for _ in range(rng.randint(0, 9))) + rng.choice([b"", b"\n"])
        put(tmp_path, f"{k}.jsonl", raw)
        want, at = [], 0
        for line in raw.split(b"\n")[: None if raw[-1:] != b"\n" else -1]:
            want.append((at, line))
            at += len(line) + 1
        want = [x for x in want if x[1].strip()]
        for step in (1, 2, 6, 7, 8, 1000):
            reading = ps._Reading({"path": str(tmp_path), "pieceBytes": step})
            pieces = [p for t in reading.dealt([(str(tmp_path / f"{k}.jsonl"), len(raw))]) for p in t.value]
            assert all(p.end - p.start <= step for p in pieces)
            assert [x for p in pieces for x in ps._payloads(ps._open(str(tmp_path))[0], p, "lines")] == want


def test_small_files_share_tasks_and_large_ones_dont(tmp_path):
    reading = ps._Reading({"path": str(tmp_path), "pieceBytes": 10, "pieceFiles": 3})
    sizes = lambda files: [[p.end - p.start for p in t.value] for t in reading.dealt(files)]
    assert sizes([("a.json", 4), ("b.json", 6), ("c.json", 1), ("d.json", 50), ("e.json", 0)]) == [[4, 6], [1], [50], [0]]
    assert sizes([(f"{i}.json", 1) for i in range(7)]) == [[1] * 3, [1] * 3, [1]]
    assert sizes([("a.jsonl", 25)]) == [[10], [10], [5]]


def test_folder_of_sources(spark, tmp_path):
    job = {"id": 1, "title": "Ops", "content": "d", "location": {"name": "Remote"}}
    put(tmp_path, "source=greenhouse/company=acme/a.json", json.dumps({"jobs": [job]}))
    put(tmp_path, "source=greenhouse/company=torn/b.json", json.dumps({"jobs": [job]})[:-1])
    put(tmp_path, "source=greenhouse/company=gone/c.json", '{"status": 404}')
    put(tmp_path, "source=greenhouse/company=none/d.json", '{"jobs": []}')
    put(tmp_path, "source=greenhouse/_tmp/e.json", "half")
    put(tmp_path, "source=lever/company=zed/a.json", json.dumps([{"id": "9", "text": "Lead"}]))
    put(tmp_path, "source=remote3/p.html", b"\xff\xfe")
    put(tmp_path, "z.json", "{}")
    put(tmp_path, "source=contra/p.html", '<a href="/opportunity/a1">Great work</a>')
    found, rejects = registry.read_folder(spark, f"file://{tmp_path}", f"file://{tmp_path}/_landed")
    assert sorted((r.id, r.company) for r in found.collect()) == [("gh_1", "acme"), ("lv_9", "zed")]  # contra is off by default
    bad = {(r.source, r.path.rsplit("/", 1)[-1]): r.error for r in rejects.collect()}
    assert bad.pop(("greenhouse", "b.json")).startswith("not JSON")
    assert bad == {("greenhouse", "c.json"): "no array of items", ("", "z.json"): "unknown source", ("remote3", "p.html"): "not UTF-8 at byte 0"}
    assert registry.read_folder(spark, f"file://{tmp_path}/absent", f"file://{tmp_path}/_none")[0].count() == 0


def test_stream_reads_each_file_once(spark, tmp_path):
    """Files that come later, one of them older than all and first by name; after each run the rows are those of a batch."""
    import os

    def run():
        rows = ps.payload_stream(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/index")
        rows.writeStream.option("checkpointLocation", f"file://{tmp_path}/offsets").trigger(availableNow=True).start(f"file://{tmp_path}/out", format="parquet").awaitTermination()
        key = lambda df: sorted((r.path, r.at, r.body, r.error) for r in df.collect())
        out = key(spark.read.schema(ps.SCHEMA).parquet(f"file://{tmp_path}/out"))
        assert out == key(ps.payloads(spark, f"file://{tmp_path}/in"))
        return len(out)

    put(tmp_path, "in/b.jsonl", '{"id": 1}\n\n{"id": 2\n{"id": " "}')
    put(tmp_path, "in/c.json", "[1]")
    assert run() == 4
    assert run() == 4
    put(tmp_path, "in/a.jsonl", '{"id": 3}\n')
    os.utime(tmp_path / "in/a.jsonl", (1, 1))
    assert run() == 5
    assert len([x for x in (tmp_path / "index").iterdir() if x.suffix == ".json"]) == 2

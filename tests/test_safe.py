"""Clustering that keeps what it has done and lives with failed buckets; files and states."""

from __future__ import annotations

import json

import numpy as np

from frameloom.operators import vectors
from frameloom.sinks import writers
from frameloom.sources import readers

SCHEMA = "proposal_id bigint, coarse string, embedding array<double>"


def blobs(start, coarse, centres, n=20, seed=0):
    r = np.random.default_rng(seed)
    return [(start + i, coarse, (np.array(centres[i % len(centres)]) + r.normal(0, 0.01, 3)).tolist()) for i in range(n)]


def test_safe_clusters_resume_and_isolate(spark, tmp_path):
    good = blobs(0, "pot", [(1, 0, 0), (0, 1, 0)]) + blobs(100, None, [(0, 0, 1)], 8)
    bad = [(200 + i, "lid", [1.0, 2.0] if i == 3 else [1.0, 0.0, float(i)]) for i in range(6)]
    rows, failed = vectors.safe_clusters(spark.createDataFrame(good + bad, SCHEMA), str(tmp_path / "c"))
    found = {r["proposal_id"]: r for r in rows.collect()}
    assert sorted(found) == sorted(x[0] for x in good + bad)
    assert {found[i]["cluster_key"] for i in range(20)} == {"pot_b000_c000", "pot_b000_c001"}
    assert len({found[i]["cluster_key"] for i in range(0, 20, 2)}) == 1
    assert {found[i]["cluster_key"] for i in range(100, 108)} <= {"unknown_b000_c000", "unknown_b000_noise"}
    assert {found[i]["cluster_key"] for i in range(200, 206)} == {"lid_b000_noise"}
    (told,) = failed.collect()
    assert (told["coarse"], told["bucket"], told["n"]) == ("lid", 0, 6) and "ValueError" in told["error"]
    # the next run takes what is there and does the failed label again
    moved = [(i, c, [9.0, 9.0, 9.0]) for i, c, _ in good]
    fixed = blobs(200, "lid", [(1, 0, 0)], 8)
    again, failed = vectors.safe_clusters(spark.createDataFrame(moved + fixed, SCHEMA), str(tmp_path / "c"))
    now = {r["proposal_id"]: r["cluster_key"] for r in again.collect()}
    assert {i: now[i] for i in range(20)} == {i: found[i]["cluster_key"] for i in range(20)}
    assert failed.count() == 0 and sorted(i for i in now if i >= 200) == list(range(200, 208))
    empty, none = vectors.safe_clusters(spark.createDataFrame([], SCHEMA), str(tmp_path / "d"))
    assert empty.count() == none.count() == 0


def test_saved_states_and_records(spark, tmp_path):
    states = [{"cluster_id": 1, "label": "pot"}, {"cluster_id": 2, "label": None}]
    (tmp_path / "list.json").write_text(json.dumps(states, indent=1))
    (tmp_path / "object.json").write_text(json.dumps({"clusters": states}))
    for name in ("list.json", "object.json"):
        assert [tuple(r) for r in readers.cluster_states(spark, str(tmp_path / name), "cluster_id int, label string").orderBy("cluster_id").collect()] == [(1, "pot"), (2, None)]
    assert readers.cluster_states(spark, str(tmp_path / "none.json"), "cluster_id int").count() == 0
    d = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "id int, name string")
    assert readers.record(d, "id", 1).first()["name"] == "a" and readers.record(d, "id", 9).count() == 0


def test_documents_in_parts_and_newest(spark):
    d = spark.createDataFrame([("train", i, f"f{i % 7}", 0, "pot") for i in range(30)], "split string, proposal_id int, frame string, class_idx int, label string").selectExpr("*", "struct(1.0D as x1, 2.0D as y1, 3.0D as x2, 4.0D as y2) as bbox")
    parts = writers.coco_documents(d, "split", documents=3).collect()
    assert len(parts) > 1 and sum(len(json.loads(r["document"])["annotations"]) for r in parts) == 30
    frames = [{i["file_name"] for i in json.loads(r["document"])["images"]} for r in parts]
    assert sum(map(len, frames)) == 7  # a frame is in one document
    names = spark.createDataFrame([(f"s{i:02d}",) for i in range(13)], "session string")
    assert sorted(r[0] for r in writers.newest(names, "session", 10).collect()) == ["s00", "s01", "s02"]


def test_connector_gets_bounded_lists(spark, tmp_path):
    folder = str(tmp_path)

    def send(rows):
        import uuid
        from pathlib import Path

        Path(folder, uuid.uuid4().hex).write_text(str(len(rows)))

    writers.to_connector(spark.range(0, 250, 1, 2), send, at_once=100)
    assert sorted(int(p.read_text()) for p in tmp_path.iterdir()) == [25, 25, 100, 100]

import hashlib
import json

import pytest

from loomspark.queries import demo_configs
from loomspark.sources import records
from loomspark.storage import latest_complete, publish, write_json


def test_study_files(spark, tmp_path):
    for k, (name, config) in enumerate(demo_configs(3).items()):
        folder = tmp_path / "candidates" / name
        folder.mkdir(parents=True)
        write_json(folder / "result.json", {"candidate_id": name, "status": "ready", "nll_curve": [{"tokens": 8, "nll": 4.0 - k}], "scores": {"quality": 0.5}, "profile": {"static": {"weight_bytes": 4}}})
        write_json(folder / "architecture.json", config)
    got = records.results(spark, str(tmp_path)).orderBy("candidate_id").collect()
    assert [r.nll_curve[0].nll for r in got] == [4.0, 3.0, 2.0] and got[0].profile.static.weight_bytes == 4
    assert sorted(r.candidate_id for r in records.architectures(spark, str(tmp_path)).collect()) == ["000000", "000001", "000002"]
    assert records.tree_bytes(spark, str(tmp_path)) == sum(p.stat().st_size for p in tmp_path.rglob("*") if p.is_file())


def test_journal(spark, tmp_path):
    digests = [hashlib.blake2b(bytes([k]), digest_size=16).digest() for k in range(5)]
    (tmp_path / "j").write_bytes(b"".join(digests))
    assert [bytes(r.dedup_hash) for r in records.journal(spark, str(tmp_path / "j")).orderBy("ord").collect()] == digests
    (tmp_path / "cut").write_bytes(digests[0][:9])
    with pytest.raises(Exception, match="cut off"):
        records.journal(spark, str(tmp_path / "cut")).collect()
    (tmp_path / "twice").write_bytes(digests[0] * 2)
    with pytest.raises(Exception, match="repeated"):
        records.journal(spark, str(tmp_path / "twice")).collect()


def test_small_files(spark, tmp_path):
    write_json(tmp_path / "a.json", {"x": 1})
    (tmp_path / "b.json").write_text(json.dumps([1]))
    assert records.experiment(str(tmp_path), "a") == {"x": 1}
    with pytest.raises(ValueError):
        records.experiment(str(tmp_path), "b")
    for n in (3, 12):
        (tmp_path / f"complete_{n}").touch()
    assert latest_complete(tmp_path) == 12 and latest_complete(tmp_path / "none") is None
    (tmp_path / "s").mkdir()
    (tmp_path / "t").mkdir()
    publish(tmp_path / "s", tmp_path / "t")
    (tmp_path / "t" / "f").touch()
    (tmp_path / "s").mkdir()
    with pytest.raises(FileExistsError):
        publish(tmp_path / "s", tmp_path / "t")
    manifest = {"sources": [{"id": "a", "splits": {"train": {"shards": [{"path": "p", "tokens": 5, "sha256": "h"}, {"path": "q", "tokens": 2, "sha256": "i"}]}}}]}
    assert [r.end for r in records.manifest_table(spark, manifest).orderBy("shard").collect()] == [5, 7]

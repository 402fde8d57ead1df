import copy

import pytest

from loomspark.config import DEDUP_POLICY, Phase, PrepSettings, disk_needed, disk_preflight, parse_phases, quotas


def settings(**over):
    """A build of a news and a forum archive, made up for these tests."""
    archive = lambda name: {"id": name, "repo": f"archive/{name}", "tree_path": "parquet", "content_column": "body", "metadata_columns": {"year": "published"}}
    raw = {
        "seed": 31,
        "sources": [archive("news"), archive("forum")],
        "requested_train_tokens": 900,
        "mixture": {"phases": [{"end_tokens": 500, "weights": {"news": 30, "forum": 70}}, {"end_tokens": 900, "weights": {"news": 55, "forum": 45}}]},
        "validation_fraction": 0.05,
        "validation_tokens_per_source": 40,
        "dedup": dict(DEDUP_POLICY),
        "filtering": {"min_chars": 3, "max_chars": 5_000},
        "shards": {"tokens": 64, "maximum_loader_microbatch_tokens": 0},
    }
    return copy.deepcopy(raw | over)


def test_quotas_and_targets():
    s = PrepSettings.parse(settings())
    assert s.quotas == {"news": 150 + 220, "forum": 350 + 180} and s.reserve == 0
    assert s.target("forum", "train") == 530 and s.target("news", "val") == 40


def test_quotas_of_three_phases():
    """By hand: 40 x 25 % + 60 x 50 % + 100 x 0 %, and so on."""
    phases = [Phase(40, {"x": 25, "y": 75}), Phase(100, {"x": 50, "y": 50}), Phase(200, {"x": 0, "y": 100})]
    assert quotas(phases) == {"x": 10 + 30, "y": 30 + 30 + 100}


def test_reserve_is_a_microbatch_for_each_phase_and_one_more():
    s = PrepSettings.parse(settings(shards={"tokens": 64, "maximum_loader_microbatch_tokens": 1_000}))
    assert s.reserve == 3 * 1_000


@pytest.mark.parametrize(
    "phases",
    [
        [],
        [{"end_tokens": 600, "weights": {"a": 100}}],
        [{"end_tokens": 600, "weights": {"a": 60, "b": 39}}],
        [{"end_tokens": 600, "weights": {"a": 60, "b": 30, "z": 10}}],
        [{"end_tokens": 300, "weights": {"a": 10, "b": 90}}, {"end_tokens": 300, "weights": {"a": 10, "b": 90}}],
        [{"end_tokens": 500, "weights": {"a": 10, "b": 90}}],
        [{"end_tokens": 7, "weights": {"a": 10, "b": 90}}, {"end_tokens": 600, "weights": {"a": 10, "b": 90}}],
        [{"end_tokens": True, "weights": {"a": 10, "b": 90}}],
    ],
)
def test_bad_phases(phases):
    with pytest.raises(ValueError):
        parse_phases(["a", "b"], {"phases": phases}, 600)


@pytest.mark.parametrize(
    "over",
    [
        {"dedup": {}}, {"validation_fraction": 0}, {"validation_fraction": 1.5}, {"filtering": {"min_chars": 5, "max_chars": 1}},
        {"filtering": {"min_chars": 0, "max_chars": 3_000_000}}, {"shards": {"tokens": 0, "maximum_loader_microbatch_tokens": 0}}, {"extra": 1}, {"sources": {}},
    ],
)
def test_bad_settings(over):
    with pytest.raises(ValueError):
        PrepSettings.parse(settings(**over))


@pytest.mark.parametrize("change", [{"id": "x/y"}, {"surprise": 1}, {"filters": {"min_score": 0.5}}, {"filters": {"language": "en"}}, {"metadata_columns": {"a": 1}}, {"filters": {"other": 1}}])
def test_bad_sources(change):
    raw = settings()
    raw["sources"][0] |= change
    with pytest.raises(ValueError):
        PrepSettings.parse(raw)


def test_disk():
    s = PrepSettings.parse(settings())
    need = disk_needed(s)
    assert need["packed"] == 2 * (900 + 2 * 40) and need["total"] == need["packed"] + 25 * 1024**3
    assert disk_preflight(s, need["total"])["free"] == need["total"]
    assert disk_preflight(s, need["total"] - 10, staged=10)
    with pytest.raises(ValueError):
        disk_preflight(s, need["total"] - 11, staged=10)

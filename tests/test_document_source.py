"""The stored documents' JSON source: compressed, and its tables made of one join."""

from pathlib import Path

from quaylight.plans import registry

SF = "/root/testdata/sf0.001"


def test_json_source_is_compressed(spark, monkeypatch):
    made, new_path = {}, registry.new_path
    monkeypatch.setattr(registry, "new_path", lambda s, label: made.setdefault(label, new_path(s, label)))
    registry._stored_documents(spark, SF, "backtest")
    files = [f for f in Path(made["json"].removeprefix("file://")).iterdir() if f.name.startswith("part-")]
    assert files and all(f.name.endswith(".json.gz") for f in files)

import pytest

from sieveglass.errors import RulesetError
from sieveglass.rules import clusters, merge
from sieveglass.sources import rulesets as S

ONE = "[[rules]]\nid='a'\nregex='k1_[a-z]{4}'\n"


def test_update_and_resolve(tmp_path, monkeypatch):
    monkeypatch.delenv(S.VARIABLE, raising=False)
    monkeypatch.chdir(tmp_path)
    src, folder = tmp_path / "new.toml", tmp_path / "data"
    src.write_text(ONE)
    assert S.resolve(folder) == S.BUNDLED.read_text()
    assert S.update(str(src), folder, check_only=True) is S.UpdateResult.AVAILABLE and S.UpdateResult.AVAILABLE.exit_code == 1
    assert S.update(str(src), folder) is S.UpdateResult.UPDATED
    assert S.update(str(src), folder) is S.UpdateResult.CURRENT
    assert S.update(str(src), folder, check_only=True) is S.UpdateResult.CHECKED
    assert "k1_" in S.resolve(folder)
    (folder / "local.toml").write_text("[[rules]]\nid='b'\nregex='mine'\n")
    assert S.update(str(src), folder) is S.UpdateResult.UPDATED
    assert "mine" in S.resolve(folder)
    (folder / "rules.toml").write_text("broken")
    assert S.cached(folder) is None and S.resolve(folder) == S.BUNDLED.read_text()
    (folder / "local.toml").write_text("[[rules]]\nid='b'\n")
    with pytest.raises(RulesetError):
        S.update(str(src), folder)
    with pytest.raises(RulesetError):
        S.update("https://example.org/x", folder)


def test_environment_is_strict(tmp_path, monkeypatch):
    at = tmp_path / "r.toml"
    at.write_text("[[rules]]\nid='a'\nregex='(?=x)'\n")
    monkeypatch.setenv(S.VARIABLE, str(at))
    with pytest.raises(RulesetError):
        S.resolve(tmp_path)


def test_manifest_order():
    rows = [{"name": "b", "priority": 1, "embed": True}, {"name": "a", "priority": 1}, {"name": "c", "priority": 9, "embed": True}]
    assert [r["name"] for r in merge.select({"sources": rows})] == ["c", "a", "b"]
    assert [r["name"] for r in merge.select({"sources": rows}, True)] == ["c", "b"]


def test_behavioural_clusters():
    rules = [{"id": "x", "regex": "ghp_[A-Za-z0-9]{36}"}, {"id": "y", "regex": r"(?i)\bghp_[a-z0-9]{36}\b"}, {"id": "z", "regex": "AKIA[A-Z2-7]{16}"}, {"id": "bad", "regex": "(?=x)"}, {"id": "none"}]
    assert clusters.behavioural(rules) == [["x", "y"]]
    assert clusters.groups([(0, 1), (1, 2), (4, 5)], 7) == [[0, 1, 2], [4, 5]]

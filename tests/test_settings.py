import pytest

from marginalia import settings as S
from marginalia.functions.scoring import fail_on_rank


def write(tmp_path, text):
    path = tmp_path / S.FILE_NAME
    path.write_text(text)
    return str(path)


def test_profile_thresholds_and_flags_override_in_order(tmp_path):
    path = write(tmp_path, 'version = 1\nprofile = "strict"\n[thresholds.accuracy]\nerror = 33\n')
    resolved = S.load(path).resolve(delete_threshold=12)
    assert (resolved.accuracy_error, resolved.accuracy_warning, resolved.usefulness_delete) == (33, 70, 12)
    assert resolved.commented_out_code == "delete"
    assert S.load(path).resolve(profile="lenient").usefulness_warning == 20


def test_prefixes_extend_or_replace(tmp_path):
    extended = S.load(write(tmp_path, '[comments]\nextend_exempt_prefixes = ["zzz"]\n'))
    assert extended.exempt_prefixes[0] == "TODO" and extended.exempt_prefixes[-1] == "zzz"
    replaced = S.load(write(tmp_path, '[comments]\nexempt_prefixes = ["only"]\n'))
    assert replaced.all_exempt_prefixes == ("only", "marginalia:")


@pytest.mark.parametrize("text", ["unknown = 1", "[comments]\nnope = 2", "version = 3", "profile = 4", "[cache]\nttl = \"soon\""])
def test_bad_files_are_errors(tmp_path, text):
    with pytest.raises(S.ConfigError):
        S.load(write(tmp_path, text))


def test_unknown_profile_and_policy():
    with pytest.raises(S.ConfigError):
        S.Settings(profile="odd").resolve()
    with pytest.raises(S.ConfigError):
        S.Settings(commented_out_code="hide").resolve()


@pytest.mark.parametrize("text, seconds", [("3s", 3), ("90d", 90 * 86400), ("1.5d", 129600), ("1h30m", 5400), ("250ms", 0.25)])
def test_durations(text, seconds):
    assert S.parse_duration(text) == pytest.approx(seconds)


def test_search_stops_at_a_repository_root(tmp_path):
    write(tmp_path, "version = 1")
    inner = tmp_path / "repo" / "pkg"
    inner.mkdir(parents=True)
    assert S.find(str(inner)).endswith(S.FILE_NAME)
    (tmp_path / "repo" / ".git").mkdir()
    assert S.find(str(inner)) == ""


def test_dotenv_fills_gaps_only(tmp_path, monkeypatch):
    env = tmp_path / ".env"
    env.write_text("A_GAP=one\nA_SET='two'\n# no\n")
    monkeypatch.setenv("A_SET", "kept")
    monkeypatch.delenv("A_GAP", raising=False)
    assert S.load_dotenv((str(env), str(tmp_path / "absent"))) == [str(env)]
    import os
    assert (os.environ["A_GAP"], os.environ["A_SET"]) == ("one", "kept")
    monkeypatch.delenv("A_GAP")


def test_rubric_needs_four_levels(tmp_path):
    assert S.load_rubric().version == 3
    path = tmp_path / "rubric.toml"
    path.write_text('rubric_version = 9\n[accuracy]\ninstructions="x"\ncriteria=["a"]\n')
    with pytest.raises(S.ConfigError):
        S.load_rubric(str(path))


def test_fail_on_words():
    assert [fail_on_rank(w) for w in ("never", "info", "warning", "error", "odd")] == [0, 1, 2, 3, 3]

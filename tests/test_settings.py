import pytest

from pupilage.config import Abstain, Gate, Label, SpecError, StudentSettings, TaskSpec
from tests.fixtures import task


@pytest.mark.parametrize(
    "changes",
    [
        {"labels": (Label("only", "x"),)},
        {"labels": (Label("a", "x"), Label("a", "y"))},
        {"labels": (Label("Bad", "x"), Label("b", "y"))},
        {"abstain": Abstain("nobody", 0.5)},
        {"abstain": Abstain("ask", 1.0)},
        {"abstain": None},
        {"teacher": Gate("noul", 0.5, "drop")},
        {"teacher": Gate("choice", 1.0, "drop")},
        {"student": StudentSettings(hash_dimensions=1)},
        {"student": StudentSettings(l2_grid=(0.1,))},
        {"instructions": ""},
    ],
)
def test_bad_settings_are_refused(changes):
    with pytest.raises(SpecError):
        task(**changes)


def test_round_trip_and_unknown_keys():
    import json

    spec = task()
    raw = json.loads(spec.to_json())
    assert TaskSpec.from_dict(raw) == spec
    raw["teacher"]["min_confidense"] = 0.5
    with pytest.raises(SpecError, match="unknown field"):
        TaskSpec.from_dict(raw)


def test_question_hash_follows_the_question_only():
    assert task().question_hash == task(student=StudentSettings(l2=1.0)).question_hash
    assert task().question_hash != task(instructions="Gate it.").question_hash


def test_options_by_question_type():
    assert task().options[0] == "allow: allow description"
    assert task(teacher=Gate("score", 0.5, "drop")).options[0] == "level 0: allow: allow description"
    two = task(labels=(Label("safe", "safe description"), Label("unsafe", "unsafe description")), abstain=None, teacher=Gate("noul", 0.5, "drop"))
    assert two.options == ["false: safe description", "true: unsafe description"]

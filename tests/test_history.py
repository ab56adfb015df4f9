import subprocess
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
#: The last commit before this rule was tested.
BASE = "e581683"
LLM = ("wardline/llm/", "tests/llm/", "corpus_pipeline.py")


def git(*args):
    return subprocess.run(["git", "-C", str(ROOT), *args], capture_output=True, text=True, check=True).stdout


def test_commits_touch_the_training_data_operators_or_the_rest():
    try:
        commits = git("log", "--format=%h %s", f"{BASE}..HEAD").splitlines()
    except (OSError, subprocess.CalledProcessError):
        pytest.skip("no history here")
    for commit, _, subject in (c.partition(" ") for c in commits):
        files = git("show", "--format=", "--name-only", commit).split()
        if not subject.startswith("Verdict"):
            assert len({f.startswith(LLM) for f in files}) <= 1, (commit, subject)

"""The rest of the library does without this subpackage and the pipeline made of it."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

HIDDEN = """
import importlib.abc, sys
import tidewell

class Hide(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == "tidewell.llm" or name.startswith("tidewell.llm."):
            raise ModuleNotFoundError(name, name=name)
        return None

import importlib.util
found = importlib.util.find_spec
importlib.util.find_spec = lambda name, package=None: None if name in HIDDEN_NAMES else found(name, package)
sys.meta_path.insert(0, Hide())
import __spark_entry__
names = set(__spark_entry__.queries())
assert "error_profile" in names and set(__spark_entry__.oracle_sql()) <= names, names
print(sorted(n for n in names if n.startswith("op") and n[2].isdigit() or n == "pipeline"))
"""


def entries(hidden):
    code = HIDDEN.replace("HIDDEN_NAMES", repr(hidden))
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout.strip()


def test_entry_without_the_subpackage():
    assert entries({"tidewell.llm"}) == "[]"


def test_entry_without_both():
    assert entries({"tidewell.llm", "corpus_pipeline"}) == "[]"

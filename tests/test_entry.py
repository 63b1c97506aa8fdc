"""The registry without the optional text operators."""

import subprocess
import sys
import textwrap

import pytest

LISTED = """
    import sys
    {before}
    import __spark_entry__ as entry
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and "rank_leaderboard" in names
    print(len(names), sum(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in names))
"""


@pytest.mark.parametrize("missing", ["ahocorasick", "panelsmith.llm", "corpus_pipeline"])
def test_queries_load_without(missing):
    """A blocked module takes its own queries with it and no others."""
    code = textwrap.dedent(LISTED.format(before=f"sys.modules[{missing!r}] = None"))
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", code], capture_output=True, text=True, timeout=120, check=False)
    assert done.returncode == 0, done.stderr
    every, text = map(int, done.stdout.split())
    assert every - text > 240 and (text == 0 if missing == "panelsmith.llm" else True)

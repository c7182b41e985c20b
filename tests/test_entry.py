"""The driver's contract, with and without the corpus operators."""

import os
import re
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_works_without_the_corpus_operators():
    code = "import sys; sys.modules['newsloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and 'pipeline' not in q and not [n for n in q if n.startswith('op')], q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_outside_imports_the_corpus_operators():
    for folder, _, names in os.walk(os.path.join(ROOT, "newsloom")):
        if "llm" in folder.split(os.sep):
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert not re.search(r"newsloom\.llm|corpus_pipeline", f.read()), name

"""The library works without the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_without_the_training_data_operators(tmp_path):
    kept = shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache")
    for pipeline in (True, False):
        to = tmp_path / str(pipeline)
        shutil.copytree(ROOT, to, ignore=kept)
        if not pipeline and (to / "corpus_pipeline.py").exists():
            (to / "corpus_pipeline.py").unlink()
        code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q); assert not [k for k in q if k.startswith('op') or k == 'pipeline']"
        subprocess.run([sys.executable, "-c", code], cwd=to, env=os.environ | {"PYTHONPATH": str(to)}, check=True)


def test_queries_where_a_module_is_missing():
    """The operators need modules that a machine may lack; the other queries stay."""
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); assert 'w_similarity_pairs' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, check=True)

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_without_the_llm_package(tmp_path):
    """The other queries stay registered where loresmith/llm is gone, whether or not corpus_pipeline.py is."""
    for name in ("catalog", "loresmith"):
        shutil.copytree(f"{ROOT}/{name}", tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    code = (
        "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); "
        "assert 'r5_bm25_topk' in q and set(s) <= set(q); "
        "assert not [n for n in q if n.startswith('op') or n == 'pipeline'], list(q)"
    )
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)

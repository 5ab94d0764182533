"""The driver's contract, with and without the training-data operators."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

HERE = os.path.dirname(os.path.abspath(entry.__file__))


def test_queries_have_names_and_oracles():
    known = entry.queries()
    assert all(map(callable, known.values())) and set(entry.oracle_sql()) <= set(known)


@pytest.mark.parametrize("gone", [("quillspark/llm", "tests/llm"), ("quillspark/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_the_rest_stands_alone(tmp_path, gone):
    """On a copy without the parts in gone the contract still holds, for the rest."""
    copy = tmp_path / "copy"
    shutil.copytree(HERE, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", *[os.path.basename(g) for g in gone if g.endswith(".py")]))
    for g in gone:
        shutil.rmtree(copy / g, ignore_errors=True)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q, callable(e.entry))"
    env = os.environ | {"PYTHONPATH": str(copy)}
    said = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    n, operators, pipeline, entered = said.stdout.split()[-4:]
    assert int(n) > 100 and (operators == "0") == ("quillspark/llm" in gone) and pipeline == "False" and entered == "True"


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from quillspark import state

    unset = SimpleNamespace(get=lambda *a: None)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        session = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master=master, getConf=lambda: unset))
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            state.shared_dir(session)

"""Scratch tables, components, and the entry without the text operators."""

from __future__ import annotations

import os
import random
import subprocess
import sys

import pytest

from isolume.operators.components import components
from isolume.storage import clear, session_dir, shared_dir, stored

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_components_equal_union_find(spark):
    rnd = random.Random(5)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for a, b in edges for x in (a, b) if a != b}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_stored_tables(spark):
    df = stored(spark.createDataFrame([(1, "a"), (2, None)], "i int, s string"), "t", "i")
    assert sorted(r.i for r in df.collect()) == [1, 2]
    assert stored(df.limit(0), "t").count() == 0
    folder = session_dir(spark).removeprefix("file://")
    assert os.path.isdir(folder) and clear(spark) and not os.path.exists(folder)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session)


def test_library_does_not_need_the_text_operators():
    code = "import sys; sys.modules['isolume.llm'] = sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q); assert not any('llm' in (m or '') for m in sys.modules if m != 'isolume.llm')"
    assert subprocess.run([sys.executable, "-c", code], cwd=REPO, timeout=120).returncode == 0


@pytest.mark.parametrize("name", ["assemble_transcripts", "best_codes", "gene_spans", "event_islands"])
def test_queries_run_on_the_smallest_tables(spark, name):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    from isolume.plans import lenses

    assert lenses.QUERIES[name](spark, folder).count() > 0

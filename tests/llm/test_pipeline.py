"""The pipeline: order, columns, every stage's decisions, and the entry guard."""

import os
import subprocess
import sys
from collections import Counter

import corpus_pipeline
import pytest
from medialake.llm import decontaminate, near_dup, quality, queries
from medialake.session import materialize

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """(name, input, output) of each stage, run one after the other."""
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, docs, SF))
        out.append((name, docs, after))
        docs = after
    return out


def test_order_and_columns(stages):
    assert [n for n, _, _ in stages] == ["quality classifier", "near-dedup", "decontamination", "source mixing", "sharding"]
    assert all(after.columns == COLUMNS for _, _, after in stages[:-1])
    assert stages[-1][2].columns == [*COLUMNS, "shard", "shard_depth", "shard_oversize"]


def test_stages_do_what_their_operators_say(spark, stages):
    ids = [(Counter(r[0] for r in a.select("doc_id").collect()), Counter(r[0] for r in b.select("doc_id").collect())) for _, a, b in stages]
    _, docs, kept = stages[0]
    scored = quality.score_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(ids[0][1]) == {r["doc_id"] for r in scored.collect() if r["predicted"]}
    groups = near_dup.near_duplicates(kept).collect()
    assert ids[1][1] == Counter(r["doc_id"] for r in groups if r["kept"])
    found = decontaminate.find_contamination(stages[2][1], spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert set(ids[2][1]) == set(ids[2][0]) - {r["doc_id"] for r in found.collect()}
    assert set(ids[3][1]) <= set(ids[3][0]) and ids[4][0] == ids[4][1]


def test_clean_documents_stay(spark, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = ({r[0] for r in x.select("doc_id").collect()} for x in stages[0][1:])
    good = {i for i, q in labels.items() if q == 1} & before
    assert len(good & after) >= 0.97 * len(good)


def test_empty_tables(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_entry_works_without_the_subpackage(tmp_path):
    """As if the folder and the pipeline had been deleted."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = ("import sys\n"
            "class Gone:\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name in ('corpus_pipeline', 'medialake.llm'): raise ModuleNotFoundError(name)\n"
            "sys.meta_path.insert(0, Gone())\n"
            "import __spark_entry__ as e\n"
            "q = e.queries()\n"
            "assert len(q) > 80 and 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q)\n"
            "assert set(e.oracle_sql()) <= set(q)\n")
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)

import os
import subprocess
import sys

import __spark_entry__ as entry
from fleetrisk.llm.queries import ORACLE, QUERIES


def test_every_operator_and_the_pipeline_are_registered():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in QUERIES} and set(QUERIES) | {"pipeline"} <= set(names)
    assert set(ORACLE) <= set(QUERIES) and set(ORACLE) <= set(entry.oracle_sql())


def test_entry_survives_a_missing_tokenizer_package():
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; assert 'kb_ranking' in e.queries() and 'op3_packing' in e.queries()"
    root = os.path.dirname(os.path.abspath(entry.__file__))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


def test_the_quality_draw_decides(spark, tmp_path):
    """The query draws among the kept texts: the largest keys, and not all of them."""
    spark.createDataFrame([(k, f"fine words about topic{k % 7} number{k}") for k in range(60)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = QUERIES["op9_quality"](spark, str(tmp_path)).collect()
    kept, drawn = ([r for r in rows if r[c]] for c in ("kept", "selected"))
    assert 0 < len(drawn) < len(kept) and all(r.kept for r in drawn)
    assert min(r.gumbel_key for r in drawn) >= max(r.gumbel_key for r in kept if not r.selected)

"""The driver's contract, also where the training-data subpackage is absent."""

import subprocess
import sys

CODE = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("arcweave.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "knn_angle_7d" in e.queries() and not any(n.startswith("op") for n in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""


def test_without_subpackage():
    subprocess.run([sys.executable, "-c", CODE], check=True, cwd=__file__.rsplit("/", 2)[0])


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["query_id", "place", "id", "angle"] and df.count() == 5000
    assert set(e.oracle_sql()) <= set(e.queries())

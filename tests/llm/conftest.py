import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
SF = os.environ.get("ECONCHECK_TEST_SF", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string, lang_pred string, ids string, n int, component_id int"


@pytest.fixture(scope="session")
def llm(spark):
    """The session with this package on the workers' path."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, known)])
    return spark


@pytest.fixture(scope="session")
def docs_of(llm):
    """Documents from (doc_id, text[, lang]) with columns whose names clash with outputs."""

    def make(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", 0, "x", "y", "z", "w", 3, 4) for r in rows]
        return llm.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("test tables not present")
    return SF

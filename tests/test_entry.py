"""The driver's entry module must load wherever Spark runs it."""

import subprocess
import sys
import zipfile
from pathlib import Path

import pyspark
from pyspark.ml.feature import StopWordsRemover

from civictopics.functions.stopwords import ENGLISH, PORTUGUESE

REPO = Path(__file__).resolve().parents[1]


def test_entry_loads_with_pyspark_as_a_zip(tmp_path):
    """A cluster may give the driver PySpark and Py4J only as zip files."""
    home = Path(pyspark.__file__).parent
    zipped = tmp_path / "pyspark.zip"
    with zipfile.ZipFile(zipped, "w") as archive:
        for path in home.rglob("*"):
            if path.suffix in (".py", ".json") and "jars" not in path.parts:
                archive.write(path, f"pyspark/{path.relative_to(home)}")
    code = (
        f"import sys; sys.path.insert(0, {str(zipped)!r}); import pyspark;"
        "assert '.zip' in pyspark.__file__; import __spark_entry__ as e;"
        "print(len(e.queries()), len(e.oracle_sql()))"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    queries, oracles = map(int, done.stdout.split()[-2:])
    assert queries >= oracles > 40


def test_stop_words_are_those_of_spark(spark):
    assert list(ENGLISH) == StopWordsRemover.loadDefaultStopWords("english")
    assert list(PORTUGUESE) == StopWordsRemover.loadDefaultStopWords("portuguese")

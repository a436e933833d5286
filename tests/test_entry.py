import subprocess
import sys

import __spark_entry__ as e


def test_every_oracle_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark):
    assert e.entry(spark).count() == 5


def test_the_rest_does_not_import_the_subpackage():
    code = "import sys, tallyspark.queries; assert not [m for m in sys.modules if m.startswith('tallyspark.llm')]"
    assert subprocess.run([sys.executable, "-c", code], cwd=e.__file__.rsplit("/", 1)[0]).returncode == 0

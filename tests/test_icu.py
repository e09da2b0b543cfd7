"""Tables come through the JVM, wherever Spark's jars lie."""

import pyspark
from glyphward.sources import icu


def test_tables_with_the_python_package_elsewhere(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(pyspark, "__file__", str(tmp_path / "pyspark" / "__init__.py"))
    t = icu.load(spark)
    assert len(t.confusables) > 6000 and t.confusables[0x430] == "a"

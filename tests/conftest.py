import json
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]
from dictionary_words import WORDS  # noqa: E402

os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def source(tmp_path_factory):
    path = tmp_path_factory.mktemp("source") / "words.json"
    path.write_text(json.dumps({"words": WORDS}, ensure_ascii=False, indent=1), encoding="utf-8")
    return str(path)


@pytest.fixture(scope="session")
def folder(spark, source, tmp_path_factory):
    from tsumugi.plans.build import build_indexes

    out = str(tmp_path_factory.mktemp("dictionary") / "tables")
    build_indexes(spark, source, out, "1.0")
    return out


@pytest.fixture(scope="session")
def dictionary(spark, folder):
    from tsumugi.sources.dictionary import Dictionary

    return Dictionary.open(spark, folder)

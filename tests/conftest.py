import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


RAW = "doc_id bigint, page int, text string, x0 double, y0 double, x1 double, y1 double"


@pytest.fixture(scope="session")
def make_blocks(spark):
    from blocklens.sources.tables import to_blocks

    def make(rows):
        return to_blocks(spark.createDataFrame(rows, RAW))
    return make


def row_of_words(doc, words, y=100.0, page=1):
    """Blocks side by side, 5 pt a character and 5 pt apart."""
    out, x = [], 72.0
    for w in words:
        out.append((doc, page, w, x, y, x + 5 * len(w), y + 11))
        x += 5 * len(w) + 5
    return out

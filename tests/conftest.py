import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").appName("quirework-tests")
        .config("spark.sql.shuffle.partitions", "2").config("spark.sql.codegen.wholeStage", "false")
        .config("spark.sql.codegen.factoryMode", "NO_CODEGEN").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("rows")))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SCHEMA = (
    "doc_id string, block_id string, seq long, page_number int, reading_order int, block_type string, text string, "
    "x0 double, y0 double, x1 double, y1 double, font_size double, font_family string, bold boolean, italic boolean, "
    "confidence double, provenance string, page_width double, page_height double, doc_rows long"
)


@pytest.fixture(scope="session")
def blocks(spark):
    """Build a block table from short dictionaries; omitted fields get plain defaults."""

    def build(rows, doc="d"):
        out, per = [], {}
        for r in rows:
            d = r.get("doc_id", doc)
            seq = per.get(d, 0)
            per[d] = seq + 1
            out.append((
                d, r.get("block_id", f"{d}{seq}"), seq, r.get("page", 1), r.get("ro", seq), r.get("type", "PARAGRAPH"),
                r.get("text", ""), float(r.get("x0", 50)), float(r.get("y0", 100 + 20 * seq)), float(r.get("x1", 500)),
                float(r.get("y1", r.get("y0", 100 + 20 * seq) + 12)), r.get("size", 10.0), r.get("family", "Times"),
                r.get("bold", False), r.get("italic", False), r.get("conf", 1.0), r.get("prov", "NATIVE"),
                r.get("w", 600.0), r.get("h", 800.0), 0,
            ))
        out = [(*o[:-1], per[o[0]]) for o in out]
        return spark.createDataFrame(out, SCHEMA)

    return build

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from riskgraph.session import build_session  # noqa: E402

SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session(master="local[4]", shuffle_partitions=4, app="riskgraph-tests",
                      extra={"spark.driver.memory": "8g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def fixture_graph(spark):
    """The hand-made 10-node graph: multi-edge, reciprocal pair, self-loop, edge to a
    node without a row (99), isolated node 10, node 9 without a label row, NaN/null features."""
    from riskgraph.sources.tables import GraphInputs

    nan = float("nan")
    nodes = spark.createDataFrame(
        [(i, 1 if i <= 5 else 2, float(i), float(i) / 2, 1.0) for i in range(1, 11) if i != 8]
        + [(8, 2, nan, None, 1.0)],
        "id long, time_step int, f_001 double, f_002 double, f_003 double",
    )
    edges = spark.createDataFrame(
        [(1, 2), (1, 2), (2, 3), (3, 2), (3, 4), (4, 5), (5, 5), (6, 7), (7, 8), (8, 9), (4, 99)],
        "src long, dst long",
    )
    labels = spark.createDataFrame(
        [(1, "1"), (2, "2"), (3, "2")] + [(i, "unknown") for i in (4, 5, 6, 7, 8, 10)],
        "id long, class_raw string",
    )
    from riskgraph.functions.labels import decode_class
    from pyspark.sql import functions as F

    labels = labels.withColumn("label_name", decode_class(F.col("class_raw")))
    return GraphInputs(nodes=nodes, edges=edges, labels=labels)

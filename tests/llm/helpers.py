"""Rows with every awkward case, and readers of the driver's tables."""

import duckdb

SF = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, spans int, label string, row int, key int, n int"


def rows(table, columns, sf=SF):
    return duckdb.sql(f"select {columns} from '{sf}/{table}.parquet'").fetchall()


def awkward_texts():
    long = " ".join(f"word{i % 997} of{i}" for i in range(30000))
    near = [" ".join(f"w{i}" if i != k else "changed" for i in range(200)) for k in (-1, 60, 140)]
    return [(1, None), (2, ""), (3, " \n\t "), (None, "orphan text here"), (5, "same row"), (5, "same row"), (7, long), (8, long),
            (9, near[0]), (10, near[1]), (11, near[2]), (12, near[0]), (13, "é中😀" * 150), (14, "x" * 5000), (15, "one two"),
            (16, "password = hunter2secret"), (None, None)]


def awkward_docs(spark):
    data = [(i, t, "en" if k % 3 else None, f"s{k % 2}" if k % 5 else None, None if t is None else len(t), "x", 1, "l", 2, 3, 4)
            for k, (i, t) in enumerate(awkward_texts())]
    return spark.createDataFrame(data, DOC_SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)

"""Command line: ``python -m riskgraph --data-dir DIR --pages PATH --output-dir DIR``.

Runs the whole review (discover -> load -> score -> sample -> exposure ->
retrieval -> contexts -> draft requests -> drafts -> cases -> write) on the caller's
inputs.  Shuffle partitions, memory and the shared folder (spark.checkpoint.dir)
are the environment's.
"""

from __future__ import annotations

import argparse

from riskgraph import config as C
from riskgraph.plans import pipeline as P
from riskgraph.session import build_session


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="riskgraph")
    ap.add_argument("--data-dir", required=True, help="folder searched for the three input CSVs")
    ap.add_argument("--pages", required=True, help="guidance page table (parquet: source_id, page, text)")
    ap.add_argument("--output-dir", required=True)
    ap.add_argument("--skip-top", type=int, default=C.SKIP_TOP_N)
    ap.add_argument("--batch-size", type=int, default=C.BATCH_SIZE)
    ap.add_argument("--seed", type=int, default=C.SAMPLING_SEED)
    ap.add_argument("--weights", choices=C.WEIGHT_MODES, default="published")
    ap.add_argument("--n-features", type=int, default=165)
    ap.add_argument("--responses", help="model answers (JSON Lines: id, content); without, drafts are templates")
    ap.add_argument("--master", default=None, help="Spark master (default: the environment's)")
    a = ap.parse_args(argv)
    spark = build_session(master=a.master)
    pages = spark.read.parquet(a.pages)
    opts = P.RunOptions(skip_top=a.skip_top, batch_size=a.batch_size, seed=a.seed, weights=a.weights,
                        n_features=a.n_features)
    answers = spark.read.schema("id long, content string").json(a.responses) if a.responses else None
    P.run(spark, a.data_dir, pages, a.output_dir, opts, responses=answers).show(truncate=False)


if __name__ == "__main__":
    main()

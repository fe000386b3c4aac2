"""Run catalogue queries against their DuckDB oracles.

    python tests/run_oracles.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle import compare, duck  # noqa: E402

from pairwright.plans.catalog import ORACLES, QUERIES  # noqa: E402
from pairwright.session import get_spark  # noqa: E402


def main(argv):
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark = get_spark("local[8]", 8)
    con = duck(sf)
    bad = 0
    for n in names:
        t = time.time()
        df = QUERIES[n](spark, sf)
        if n in ORACLES:
            try:
                ok, msg = compare(df, ORACLES[n], con)
            except Exception as e:  # noqa: BLE001
                ok, msg = False, f"error: {str(e)[:400]}"
        else:
            ok, msg = True, f"rows only: {df.count()}"
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'} {n:24s} {time.time() - t:6.1f}s {msg}", flush=True)
    spark.catalog.clearCache()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)

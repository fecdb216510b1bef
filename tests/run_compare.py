"""python tests/run_compare.py SF_DIR [query ...]: every named query against its SQL twin."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shardloom.session import build_session  # noqa: E402
from tests.compare import connect, difference  # noqa: E402
from shardloom.plans.catalog import QUERIES  # noqa: E402


def main() -> int:
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = build_session("compare", 8)
    db = connect(sf_dir)
    bad = 0
    for name in names:
        q = QUERIES[name]
        began = time.time()
        try:
            df = q.run(spark, sf_dir)
            problem = difference(df, q.sql, db) if q.sql else (None if df.count() else "no rows")
        except Exception as error:  # report and go on with the next query
            problem = "".join(traceback.format_exception_only(error))[:1500]
        bad += problem is not None
        kind = "sql" if q.sql else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind:4} {time.time() - began:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())

"""python tests/run_compare.py SF_DIR [name ...]: every query against its SQL, with timings."""

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from compare import connect, difference  # noqa: E402
from quillstrata.session import local_session  # noqa: E402

if __name__ == "__main__":
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session("8")
    oracle, con = oracle_sql(), connect(sf_dir)
    for name, query in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in oracle:
                problem = difference(df, con, oracle[name])
                verdict = "ok" if problem is None else f"DIFFERS {problem}"
            else:
                verdict = f"rows {len(df.collect())}"
        except Exception as e:
            verdict = f"FAILED {type(e).__name__} {str(e)[:500]}"
            if names:
                traceback.print_exc()
        print(f"{name:30s} {time.time() - start:6.2f}s {verdict}", flush=True)

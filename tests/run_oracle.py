"""Compare all (or the named) queries: python tests/run_oracle.py SF_DIR [name ...]"""

import sys
import time
import traceback
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parents[1]), str(Path(__file__).parent)]

from oracle import connect, differences  # noqa: E402

from tallyforge.plans import ORACLES, QUERIES  # noqa: E402
from tallyforge.session import local_session  # noqa: E402

if __name__ == "__main__":
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark, con = local_session(), connect(sf_dir)
    bad = 0
    for name in names:
        began = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            problem = differences(df, con, ORACLES[name]) if name in ORACLES else (df.count() == 0 and "no rows") or None
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
            if "-v" in names:
                traceback.print_exc()
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:32} {time.time() - began:6.2f}s {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    sys.exit(bad > 0)

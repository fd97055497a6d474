"""Command line check: python tests/check.py [sf] [name-prefix ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as e  # noqa: E402
from gradeline.session import local_session  # noqa: E402
from harness import compare, duck  # noqa: E402

sf = "/root/testdata/" + (sys.argv[1] if len(sys.argv) > 1 else "sf0.001")
only = sys.argv[2:]
spark = local_session()
con = duck(sf)
oracles = e.oracle_sql()
bad = 0
for name, fn in e.queries().items():
    if only and not any(name.startswith(o) for o in only):
        continue
    t = time.time()
    try:
        if name in oracles:
            why = compare(spark, con, sf, fn, oracles[name])
        else:
            n = fn(spark, sf).count()
            why = None if n else "no rows"
    except Exception as x:  # noqa: BLE001
        why = f"{type(x).__name__}: {str(x)[:600]}"
    bad += why is not None
    print(f"{'ok  ' if why is None else 'FAIL'} {name} {time.time() - t:.1f}s"
          f"{'' if name in oracles else ' (rows only)'} {why or ''}", flush=True)
print("failed:", bad)

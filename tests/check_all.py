"""Command line: compare registered queries with their SQL. ``check_all.py [sf] [name-part ...]``"""

import os
import tempfile
import sys
import time
import traceback

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

from oracle import compare, connect

from tideline.catalog import ORACLES, QUERIES
from tideline.session import get_session

sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
parts = sys.argv[2:]
spark = get_session(**{"spark.master": f"local[{os.environ.get('CHECK_CPUS', 8)}]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tideline-check-"), "spark.ui.showConsoleProgress": "false"})
spark.sparkContext.setLogLevel("ERROR")
folder = f"/root/testdata/sf{sf}"
con = connect(folder)
bad = 0
for name, plan in QUERIES.items():
    if parts and not any(p in name for p in parts):
        continue
    start = time.time()
    try:
        if name in ORACLES:
            problem = compare(spark, con, name, plan, ORACLES[name], folder)
        else:
            rows = plan(spark, folder).collect()
            problem = None if rows else "no rows"
    except Exception as error:
        lines = [x for x in str(error).splitlines() if x.strip()][:4]
        problem = f"{type(error).__name__}: {lines}"
        if "-v" in sys.argv:
            traceback.print_exc()
    took = time.time() - start
    mark = "ok  " if problem is None else "BAD "
    bad += problem is not None
    if problem or took > 4 or name not in ORACLES:
        print(f"{mark}{name:26s} {took:5.1f}s {'' if name in ORACLES else '(rows only)'} {(problem or '')[:600]}", flush=True)
print("checked", len([n for n in QUERIES if not parts or any(p in n for p in parts)]), "bad", bad)

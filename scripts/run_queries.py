"""Run every registered query once and print row counts and times."""
import sys, time
sys.path.insert(0, __import__("os").path.dirname(__import__("os").path.dirname(__import__("os").path.abspath(__file__))))
from tessera.session import local_session
from tessera.plans.queries import QUERIES

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
only = sys.argv[2:] or list(QUERIES)
spark = local_session(8)
for name in only:
    t0 = time.time()
    try:
        df = QUERIES[name](spark, sf)
        n = df.count()
        print(f"{name:28s} rows={n:8d} {time.time()-t0:6.1f}s cols={df.columns}", flush=True)
    except Exception as e:
        print(f"{name:28s} ERROR {type(e).__name__}: {str(e)[:400]}", flush=True)

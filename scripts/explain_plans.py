"""Print the formatted physical plans of the main stages and count their exchanges.

Usage: python scripts/explain_plans.py [sf_dir]
"""
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from tessera.operators.groups import page_groups  # noqa: E402
from tessera.operators.render import render_pages  # noqa: E402
from tessera.operators.requests import translate_requests  # noqa: E402
from tessera.operators.segments import plan_segments  # noqa: E402
from tessera.operators.tokenize import fragments  # noqa: E402
from tessera.options import Options  # noqa: E402
from tessera.plans.queries import QUERIES  # noqa: E402
from tessera.session import local_session  # noqa: E402


def show(name, df):
    plan = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    ex = re.findall(r"Exchange (\w+\([^)]*\))", df._jdf.queryExecution().executedPlan().toString())
    print(f"==== {name}: {len(ex)} exchange(s): {ex}")
    print(plan)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # show the static plan
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    f = fragments(pages)
    planned = plan_segments(page_groups(pages, f), 1638, carry=["text", "n_shreds", "shreds"])
    show("grouping -> segments -> requests", translate_requests(planned.filter(F.col("seg_no").isNotNull()), Options()))
    edits = spark.createDataFrame([(0, 5, "x")], "page_id long, frag_no int, new_text string")
    failed = spark.createDataFrame([(3, "e")], "page_id long, error string")
    show("render", render_pages(f, edits, failed))
    for q in ("rate_check", "backoff", "chunk_assembly", "fit_choice"):
        show(q, QUERIES[q](spark, sf))


if __name__ == "__main__":
    main()

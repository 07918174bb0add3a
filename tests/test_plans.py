"""Physical plan checks: the grouping-to-requests path shuffles once, on page_id."""

import re

from pyspark.sql import functions as F

from tessera.operators.groups import page_groups
from tessera.operators.requests import translate_requests
from tessera.operators.segments import plan_segments
from tessera.operators.tokenize import fragments
from tessera.options import Options


def test_single_hash_exchange_on_page_id(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
        f = fragments(pages)
        planned = plan_segments(page_groups(pages, f), 1638, carry=["text", "n_shreds", "shreds"])
        reqs = translate_requests(planned.filter(F.col("seg_no").isNotNull()), Options())
        plan = reqs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    hashed = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    # the kept and oversize branches share one exchange (reused); all are on page_id only
    assert hashed and all(h.startswith("page_id") and h.count(",") == 1 for h in hashed), hashed
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan


def test_scan_prunes_columns(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = fragments(pages)._jdf.queryExecution().executedPlan().toString()
    assert "url" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_pages_are_spread_only_when_asked(spark):
    from tessera.operators.tokenize import fragments

    pages = spark.range(50).selectExpr("id as page_id", "'<p>a</p>' as html").coalesce(1)
    plain = fragments(pages)._jdf.queryExecution().executedPlan().toString()
    asked = fragments(pages, 8)._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" not in plain
    assert "RoundRobinPartitioning(8)" in asked


def test_rendering_does_not_shuffle_tokens(spark):
    from tessera.operators.render import render_pages
    from tessera.operators.tokenize import page_rows

    pages = spark.range(50).selectExpr("id as page_id", "'<p>a</p>' as html")
    edits = spark.createDataFrame([(1, 1, "b")], "page_id long, frag_no int, new_text string")
    plan = render_pages(page_rows(pages), edits)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Aggregate") == 1  # the edits of a page

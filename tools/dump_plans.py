"""Write PLANS.md: formatted physical plans of the main operators (sf0.01)."""

import io
import os
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vecspark.operators.ir import quality_scores  # noqa: E402
from vecspark.operators.knn import search_one  # noqa: E402
from vecspark.operators.perf import exact_quantiles  # noqa: E402
from vecspark.plans.views import Views  # noqa: E402
from vecspark.session import get_session  # noqa: E402

SF = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"


def main():
    spark = get_session("local[8]", shuffle_partitions=8)
    v = Views(spark, SF)
    items = [
        ("Exact k-NN (`knn_exact`)", v.gt),
        ("Inverted-list search (`ivf_search`, nprobe 4)", v.pred),
        ("Single-query search (`search_one`, payload joined for the k winners)",
         search_one(v.index.withColumn("payload", v.index.vector_id.cast("string")),
                    v.queries.orderBy("query_id").limit(1), 10, keep=["payload"])),
        ("Quality metrics per k (`quality_scores`)", quality_scores(v.pred, v.gt)),
        ("Skew-safe exact quantiles (`exact_quantiles`)",
         exact_quantiles(v.lat.select("engine", "worker_count", (v.lat.latency_s * 1000).alias("ms")),
                         ["engine", "worker_count"], "ms", (0.5, 0.95, 0.99))),
    ]
    out = ["# Physical plans of the main operators\n",
           f"Generated by `tools/dump_plans.py` on `{SF}` (local[8], AQE on); "
           "the AdaptiveSparkPlan is shown before execution.\n"]
    for title, df in items:
        buf = io.StringIO()
        with redirect_stdout(buf):
            df.explain("formatted")
        out.append(f"\n## {title}\n\n```\n{buf.getvalue().strip()}\n```\n")
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("".join(out))
    spark.stop()


if __name__ == "__main__":
    main()

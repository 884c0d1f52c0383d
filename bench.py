"""Benchmark: headline queries on the corpus seeded from ``orders`` (one file per order).

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Prints ONE JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Each query runs to completion through the no-op sink (every row is
produced, nothing is collected); the value is the sum of the query times.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from compliance_scan import rules  # noqa: E402
from compliance_scan.operators import laws as law_ops  # noqa: E402
from compliance_scan.operators import report  # noqa: E402
from compliance_scan.plans.scan import scan, scan_counts, scan_lines  # noqa: E402
from compliance_scan.session import local_session  # noqa: E402
from compliance_scan.sources.corpus import corpus_sources  # noqa: E402
from compliance_scan.sources.files import to_lines  # noqa: E402
from compliance_scan.sources.laws import load_laws  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
TABLE = os.environ.get("BENCH_TABLE", "orders")


def _run(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    spark = local_session(CPUS, shuffle_partitions=int(CPUS) * 2,
                          extra={"spark.sql.files.maxPartitionBytes": str(32 << 20)})
    src = corpus_sources(spark, SF_DIR, TABLE).cache()
    n_files = src.count()  # materialise the generated corpus once (not timed)
    n_lines = src.select(F.sum(F.size(F.split("content", "\n", -1)))).first()[0]

    # one line in a hundred carries something, as whole files and as a table of lines
    sparse = corpus_sources(spark, SF_DIR, TABLE, percent=1).cache()
    sparse.count()
    lines = to_lines(sparse)

    laws = load_laws(spark)
    plans = {
        "full_scan": lambda: scan(src),
        "full_scan_no_prefilter": lambda: scan(src, prefilter=False),
        "report_summary": lambda: report.header(scan_counts(src, target="src")),
        "report_json": lambda: report.finding_json(scan(src)),
        "full_scan_sparse": lambda: scan(sparse),
        "lines_scan_sparse": lambda: scan_lines(lines),
        "findings_with_laws": lambda: law_ops.expand_findings(scan(src), laws),
    }
    for d in rules.DETECTORS:
        plans["detect_" + re.sub(r"\W", "_", d.id.lower())] = (lambda d=d: scan(src, [d.id]))

    _run(scan(src))  # warm-up: JIT, first-job overheads
    times = {}
    for name, build in plans.items():
        t0 = time.time()
        _run(build())
        times[name] = round(time.time() - t0, 3)
    total = round(sum(times.values()), 3)
    sf = re.search(r"sf([0-9.]+)", SF_DIR)
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec",
                      "queries": times, "sf": float(sf.group(1)) if sf else SF_DIR,
                      "files": n_files, "lines": int(n_lines),
                      "lines_per_sec_full_scan": round(n_lines / times["full_scan"]),
                      "cpus": int(CPUS)}))


if __name__ == "__main__":
    main()

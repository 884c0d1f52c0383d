import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from compliance_scan.session import local_session

    s = local_session(4, shuffle_partitions=8)
    # tests own their checkpoint folder (a cluster names one in spark.checkpoint.dir)
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cs-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture()
def scan_files(spark):
    """Scan in-memory files: ``{path: text}`` -> sorted list of finding dicts.

    Files are scanned whole and as a table of lines in chunks; both must agree.
    """
    from compliance_scan.plans.scan import scan, scan_lines
    from compliance_scan.sources.files import to_lines

    def told(found):
        return sorted((r.asDict() for r in found.collect()), key=lambda r: (r["file_path"], r["detector_ord"], r["line_number"]))

    def run(files, detectors=None, chunk_lines=7, prefilter=True):
        src = spark.createDataFrame(list(files.items()), "file_path STRING, content STRING")
        out = told(scan(src, detectors, prefilter=prefilter))
        assert told(scan_lines(to_lines(src), detectors, chunk_lines=chunk_lines)) == out
        return out

    return run


def java(*lines):
    return "\n".join(lines)

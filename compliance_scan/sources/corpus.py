"""Synthetic source corpus derived from a key column of the driver tables.

The driver's tables hold no source code, so the scanner is exercised on Java
files generated from their keys (``customer.c_custkey`` for correctness,
``orders.o_orderkey`` for the benchmark).  One file per key ``k``:

* ``file_path = 'src/m' || (k % 7) || '/F' || k || '.java'``
* ``line_no   = 1 .. 12 + k % 29``
* ``line      = TEMPLATES[(k*7919 + n*n*31 + n*k + n*17) % 41]`` (``n = line_no``)
* ``content   = lines joined with '\\n'``

Integer arithmetic only, so DuckDB (the oracle) generates the same corpus.
The file text is built row-wise with ``transform(sequence(...))``: no
aggregation, no shuffle; the work grows with the key table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# FIXED VALUES -- corpus line templates (0-based; leading blanks matter,
# template 39 starts with a TAB).
TEMPLATES: tuple[str, ...] = (
    "package com.acme.app;",
    "import java.util.List;",
    "",
    "// note: retention and marketing consent are handled elsewhere",
    '    @Column(name = "c")',
    "    @Encrypted",
    "    private String ssn;",
    "    private String residentNumber;",
    "    private String 주민번호;",
    "    private String cardNumber;",
    "    private String account_no;",
    "    private String cardNotice;",
    "    private Integer creditScore;",
    "    private String 카드번호;",
    "    private Long orderId;",
    "    private String 주문번호;",
    "    private String orderNorm;",
    "    private Instant retentionUntil;",
    '    @PostMapping("/join")',
    '    @PutMapping("/profile/{id}")',
    '    @GetMapping("/find")',
    "    public void save(Form f) {",
    "    }",
    "        if (f.ready()) {",
    "        String email = f.getEmail();",
    "        if (!f.isConsentGiven()) { return; }",
    '        log.info("signup " + email);',
    '        log.DEBUG("ok");',
    '        log.warn("전화 " + p);',
    '        logger.info("phone " + phone);',
    "        this.ssn = encrypt(v);",
    "        String shown = mask(v);",
    "        mailer.sendEmail(to, body);",
    "        push.notifyAll(to);",
    '        String body = "spring promotion";',
    '        String body = "광고 안내";',
    '        String footer = "end of subscription";',
    "        boolean ok = user.optIn();",
    "        int total = a + b;",
    '\tString 이름 = f.get("n");',
    '        // log.error("password " + pw);',
)

# key column per driver table
KEY_COLUMNS = {"customer": "c_custkey", "orders": "o_orderkey"}


def _file_path(k: Column) -> Column:
    return F.concat(F.lit("src/m"), (k % 7).cast("string"), F.lit("/F"),
                    k.cast("string"), F.lit(".java"))


def _template_at(k: Column, n: Column) -> Column:
    idx = (k * 7919 + n * n * 31 + n * k + n * 17) % len(TEMPLATES)
    return F.element_at(F.array(*[F.lit(t) for t in TEMPLATES]), (idx + 1).cast("int"))


def _keys(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The key column, spread over at least the cluster's default parallelism.

    A driver table is one small parquet file (one partition); generating all
    files from it in one task would serialise the whole scan.  Keys are 8
    bytes, so the round-robin shuffle is cheap; a key table that already has
    enough partitions (large inputs) is left as it is.
    """
    key = KEY_COLUMNS[table]
    keys = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).cast("long").alias("k"))
    parallelism = spark.sparkContext.defaultParallelism
    if keys.rdd.getNumPartitions() < parallelism:
        keys = keys.repartition(parallelism * 2)
    return keys


PLAIN_LINE = 38  # a template that no rule looks at


def corpus_sources(spark: SparkSession, sf_dir: str, table: str = "customer", percent: int = 100) -> DataFrame:
    """``(file_path, content)``: one generated Java file per key of ``table``.

    ``percent`` of the lines are as above and the others plain code, as in real sources most are.
    """
    k = F.col("k")
    n_lines = (k % 29 + 12).cast("int")

    def line(n):
        if percent >= 100:
            return _template_at(k, n)
        return F.when((k * 13 + n * 7) % 100 < percent, _template_at(k, n)).otherwise(F.lit(TEMPLATES[PLAIN_LINE]))

    content = F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), n_lines.cast("long")), line), "\n")
    return _keys(spark, sf_dir, table).select(_file_path(k).alias("file_path"),
                                              content.alias("content"))


def corpus_lines(spark: SparkSession, sf_dir: str, table: str = "customer") -> DataFrame:
    """``(file_path, line_no, line)`` generated directly, without building the text."""
    k = F.col("k")
    n = F.col("n")
    return (_keys(spark, sf_dir, table)
            .select("k", F.explode(F.sequence(F.lit(1).cast("long"), (k % 29 + 12))).alias("n"))
            .select(_file_path(k).alias("file_path"), n.cast("int").alias("line_no"),
                    _template_at(k, n).alias("line")))

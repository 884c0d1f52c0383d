"""Law provision table: bundled rows, override file, unique-key check.

The bundle is a 40-row dimension table kept in code; ``ord`` is the load
order (acts in file-name order: credit information, e-commerce, network,
personal information; articles in document order).  Summaries are short
descriptions written for this package; statute text (``full_text_ko``) is
not bundled and stays NULL unless an override file supplies it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from .files import read_lines

LAW_SCHEMA = ("ord INT, id STRING, name_ko STRING, name_en STRING, summary STRING, "
              "url STRING, risk_level STRING, full_text_ko STRING")

# FIXED VALUES -- provisions: (id, name_ko, name_en, url, risk_level, summary)
LAWS: tuple[tuple[str, str, str, str, str, str], ...] = (
    ("CIA-15", "신용정보의 이용 및 보호에 관한 법률 제15조", "Credit Information Act Article 15 (Principles of Collection and Investigation)", "https://www.law.go.kr/법령/신용정보의이용및보호에관한법률/제15조", "MEDIUM", "How credit information may be gathered and checked"),
    ("CIA-17", "신용정보의 이용 및 보호에 관한 법률 제17조", "Credit Information Act Article 17 (Prohibition on Disclosure Beyond Business Purpose)", "https://www.law.go.kr/법령/신용정보의이용및보호에관한법률/제17조", "HIGH", "Limits on passing credit information outside its business purpose"),
    ("CIA-19", "신용정보의 이용 및 보호에 관한 법률 제19조", "Credit Information Act Article 19 (Security Protection of Credit Information Computer Systems)", "https://www.law.go.kr/법령/신용정보의이용및보호에관한법률/제19조", "HIGH", "Technical safeguards for systems that hold credit information"),
    ("CIA-20", "신용정보의 이용 및 보호에 관한 법률 제20조", "Credit Information Act Article 20 (Maintenance of Accuracy and Currency of Credit Information)", "https://www.law.go.kr/법령/신용정보의이용및보호에관한법률/제20조", "MEDIUM", "Keeping credit information correct and up to date"),
    ("CIA-32", "신용정보의 이용 및 보호에 관한 법률 제32조", "Credit Information Act Article 32 (Consent for Provision and Use of Personal Credit Information)", "https://www.law.go.kr/법령/신용정보의이용및보호에관한법률/제32조", "HIGH", "Consent before personal credit information is provided"),
    ("CIA-33", "신용정보의 이용 및 보호에 관한 법률 제33조", "Credit Information Act Article 33 (Use of Personal Credit Information)", "https://www.law.go.kr/법령/신용정보의이용및보호에관한법률/제33조", "HIGH", "Purposes for which personal credit information may be used"),
    ("CIA-34", "신용정보의 이용 및 보호에 관한 법률 제34조", "Credit Information Act Article 34 (Provision and Use of Personal Credit Information)", "https://www.law.go.kr/법령/신용정보의이용및보호에관한법률/제34조", "HIGH", "Conditions on providing and using personal credit information"),
    ("CIA-38", "신용정보의 이용 및 보호에 관한 법률 제38조", "Credit Information Act Article 38 (Protection of Credit Information)", "https://www.law.go.kr/법령/신용정보의이용및보호에관한법률/제38조", "MEDIUM", "Access and correction rights over one's credit information"),
    ("CIA-39", "신용정보의 이용 및 보호에 관한 법률 제39조", "Credit Information Act Article 39 (Notification and Reporting of Credit Information Leakage)", "https://www.law.go.kr/법령/신용정보의이용및보호에관한법률/제39조", "HIGH", "Notice and reporting after credit information leaks"),
    ("CIA-40", "신용정보의 이용 및 보호에 관한 법률 제40조", "Credit Information Act Article 40 (Rights of Credit Information Subjects)", "https://www.law.go.kr/법령/신용정보의이용및보호에관한법률/제40조", "MEDIUM", "Further rights of the people the credit information is about"),
    ("ECA-6", "전자상거래 등에서의 소비자보호에 관한 법률 제6조", "E-Commerce Act Article 6 (Preservation of Transaction Records)", "https://www.law.go.kr/법령/전자상거래등에서의소비자보호에관한법률/제6조", "MEDIUM", "Keeping transaction records for set periods"),
    ("ECA-7", "전자상거래 등에서의 소비자보호에 관한 법률 제7조", "E-Commerce Act Article 7 (Prevention of Operational Errors)", "https://www.law.go.kr/법령/전자상거래등에서의소비자보호에관한법률/제7조", "MEDIUM", "Steps against ordering mistakes by consumers"),
    ("ECA-11", "전자상거래 등에서의 소비자보호에 관한 법률 제11조", "E-Commerce Act Article 11 (Securing Reliability of Electronic Payment)", "https://www.law.go.kr/법령/전자상거래등에서의소비자보호에관한법률/제11조", "HIGH", "Trustworthy electronic payment handling"),
    ("ECA-13", "전자상거래 등에서의 소비자보호에 관한 법률 제13조", "E-Commerce Act Article 13 (Provision of Information on Identity and Transaction Conditions)", "https://www.law.go.kr/법령/전자상거래등에서의소비자보호에관한법률/제13조", "MEDIUM", "Showing seller identity and trade terms"),
    ("ECA-14", "전자상거래 등에서의 소비자보호에 관한 법률 제14조", "E-Commerce Act Article 14 (Confirmation of Order)", "https://www.law.go.kr/법령/전자상거래등에서의소비자보호에관한법률/제14조", "MEDIUM", "Confirming orders to the consumer"),
    ("ECA-17", "전자상거래 등에서의 소비자보호에 관한 법률 제17조", "E-Commerce Act Article 17 (Withdrawal of Subscription)", "https://www.law.go.kr/법령/전자상거래등에서의소비자보호에관한법률/제17조", "HIGH", "Consumer withdrawal from a purchase"),
    ("ECA-21", "전자상거래 등에서의 소비자보호에 관한 법률 제21조", "E-Commerce Act Article 21 (Use of Consumer Information)", "https://www.law.go.kr/법령/전자상거래등에서의소비자보호에관한법률/제21조", "HIGH", "Provisions that may concern how information about consumers is used"),
    ("ECA-24", "전자상거래 등에서의 소비자보호에 관한 법률 제24조", "E-Commerce Act Article 24 (Securing Safety of Cyber Mall)", "https://www.law.go.kr/법령/전자상거래등에서의소비자보호에관한법률/제24조", "HIGH", "Safe operation of online shops"),
    ("ECA-26", "전자상거래 등에서의 소비자보호에 관한 법률 제26조", "E-Commerce Act Article 26 (Protection of Consumer Information)", "https://www.law.go.kr/법령/전자상거래등에서의소비자보호에관한법률/제26조", "HIGH", "Care for consumer information in online trade"),
    ("NIA-22", "정보통신망 이용촉진 및 정보보호 등에 관한 법률 제22조", "Network Act Article 22 (Consent for Collection and Use of Personal Information)", "https://www.law.go.kr/법령/정보통신망이용촉진및정보보호등에관한법률/제22조", "HIGH", "Consent for gathering user data online"),
    ("NIA-23", "정보통신망 이용촉진 및 정보보호 등에 관한 법률 제23조", "Network Act Article 23 (Restrictions on Collection of Personal Information)", "https://www.law.go.kr/법령/정보통신망이용촉진및정보보호등에관한법률/제23조", "HIGH", "Limits on which user data may be gathered"),
    ("NIA-23-2", "정보통신망 이용촉진 및 정보보호 등에 관한 법률 제23조의2", "Network Act Article 23-2 (Restrictions on Use of Resident Registration Numbers)", "https://www.law.go.kr/법령/정보통신망이용촉진및정보보호등에관한법률/제23조의2", "HIGH", "Limits on resident registration numbers online"),
    ("NIA-24", "정보통신망 이용촉진 및 정보보호 등에 관한 법률 제24조", "Network Act Article 24 (Restrictions on Use of Personal Information)", "https://www.law.go.kr/법령/정보통신망이용촉진및정보보호등에관한법률/제24조", "HIGH", "Limits on using gathered user data"),
    ("NIA-24-2", "정보통신망 이용촉진 및 정보보호 등에 관한 법률 제24조의2", "Network Act Article 24-2 (Provision of Personal Information to Third Parties)", "https://www.law.go.kr/법령/정보통신망이용촉진및정보보호등에관한법률/제24조의2", "HIGH", "Sharing user data with other parties"),
    ("NIA-27", "정보통신망 이용촉진 및 정보보호 등에 관한 법률 제27조", "Network Act Article 27 (Protection Measures for Personal Information)", "https://www.law.go.kr/법령/정보통신망이용촉진및정보보호등에관한법률/제27조", "HIGH", "Measures that may be expected to protect personal information"),
    ("NIA-28", "정보통신망 이용촉진 및 정보보호 등에 관한 법률 제28조", "Network Act Article 28 (Entrustment of Personal Information)", "https://www.law.go.kr/법령/정보통신망이용촉진및정보보호등에관한법률/제28조", "MEDIUM", "Points that may apply when handling of personal information is entrusted to others"),
    ("NIA-28-2", "정보통신망 이용촉진 및 정보보호 등에 관한 법률 제28조의2", "Network Act Article 28-2 (Notification and Reporting of Personal Information Breach)", "https://www.law.go.kr/법령/정보통신망이용촉진및정보보호등에관한법률/제28조의2", "HIGH", "Handling of user data leaks"),
    ("NIA-44", "정보통신망 이용촉진 및 정보보호 등에 관한 법률 제44조", "Network Act Article 44 (User Protection in Information and Communications Networks)", "https://www.law.go.kr/법령/정보통신망이용촉진및정보보호등에관한법률/제44조", "MEDIUM", "Duties toward users of online services"),
    ("NIA-44-7", "정보통신망 이용촉진 및 정보보호 등에 관한 법률 제44조의7", "Network Act Article 44-7 (Prohibition on Distribution of Illegal Information)", "https://www.law.go.kr/법령/정보통신망이용촉진및정보보호등에관한법률/제44조의7", "MEDIUM", "Kinds of information whose distribution may be prohibited"),
    ("NIA-50", "정보통신망 이용촉진 및 정보보호 등에 관한 법률 제50조", "Network Act Article 50 (Restrictions on Transmission of Advertising Information for Profit)", "https://www.law.go.kr/법령/정보통신망이용촉진및정보보호등에관한법률/제50조", "MEDIUM", "Opt-in before sending advertising messages"),
    ("PIPA-15", "개인정보 보호법 제15조", "PIPA Article 15 (Collection and Use of Personal Information)", "https://www.law.go.kr/법령/개인정보보호법/제15조", "HIGH", "A lawful basis, usually consent, before gathering personal data"),
    ("PIPA-17", "개인정보 보호법 제17조", "PIPA Article 17 (Provision of Personal Information to Third Parties)", "https://www.law.go.kr/법령/개인정보보호법/제17조", "HIGH", "Consent before handing personal data to others"),
    ("PIPA-18", "개인정보 보호법 제18조", "PIPA Article 18 (Restriction on Use and Provision Beyond Purpose)", "https://www.law.go.kr/법령/개인정보보호법/제18조", "HIGH", "Use only within the purpose of gathering"),
    ("PIPA-21", "개인정보 보호법 제21조", "PIPA Article 21 (Destruction of Personal Information)", "https://www.law.go.kr/법령/개인정보보호법/제21조", "MEDIUM", "Deleting personal data once it is no longer needed"),
    ("PIPA-23", "개인정보 보호법 제23조", "PIPA Article 23 (Restriction on Processing Sensitive Information)", "https://www.law.go.kr/법령/개인정보보호법/제23조", "HIGH", "Extra limits for sensitive data"),
    ("PIPA-24", "개인정보 보호법 제24조", "PIPA Article 24 (Restriction on Processing Unique Identification Information)", "https://www.law.go.kr/법령/개인정보보호법/제24조", "HIGH", "Extra limits for unique identifiers"),
    ("PIPA-24-2", "개인정보 보호법 제24조의2", "PIPA Article 24-2 (Restrictions on Resident Registration Numbers)", "https://www.law.go.kr/법령/개인정보보호법/제24조의2", "HIGH", "Resident registration numbers: limited use, kept encrypted"),
    ("PIPA-29", "개인정보 보호법 제29조", "PIPA Article 29 (Duty of Safety Measures)", "https://www.law.go.kr/법령/개인정보보호법/제29조", "HIGH", "Technical and organisational safeguards for personal data"),
    ("PIPA-30", "개인정보 보호법 제30조", "PIPA Article 30 (Privacy Policy)", "https://www.law.go.kr/법령/개인정보보호법/제30조", "MEDIUM", "Publishing a privacy policy"),
    ("PIPA-34", "개인정보 보호법 제34조", "PIPA Article 34 (Notification of Data Breach)", "https://www.law.go.kr/법령/개인정보보호법/제34조", "HIGH", "Telling people and the regulator about a leak"),
)

def bundled_laws(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, lid, ko, en, summary, url, risk, None)
            for i, (lid, ko, en, url, risk, summary) in enumerate(LAWS)]
    return spark.createDataFrame(rows, LAW_SCHEMA)


BROADCAST_BYTES = 8 << 20  # an override of at most so many bytes is broadcast by the joins

_TEXTS = ("id", "name_ko", "name_en", "summary", "url", "risk_level", "full_text_ko")
_LAW = "struct<" + ",".join(f"{c}:string" for c in _TEXTS) + ",ord:int>"


def _override(spark: SparkSession, path: str, fmt: str, multi_line: bool) -> DataFrame:
    """Rows of an override with ``file`` and ``place``: where they stand."""
    if fmt == "parquet":
        raw = spark.read.parquet(path)
        at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")]
        law = [(F.col(c).cast("string") if c in raw.columns else F.lit(None).cast("string")).alias(c) for c in _TEXTS]
        own = F.col("ord").cast("int") if "ord" in raw.columns else F.lit(None).cast("int")
        return raw.select(*at, *law, own.alias("ord"))
    if multi_line:  # one document a file
        docs = (spark.read.format("text").option("wholetext", "true").load(path)
                .select(F.col("_metadata.file_path").alias("file"), F.from_json("value", f"struct<laws:array<{_LAW}>>").alias("doc")))
        return docs.select("file", F.posexplode("doc.laws").alias("place", "law")).select("file", "place", "law.*")
    lines = read_lines(spark, path, "*").where(F.trim("line") != "")
    return lines.select(F.col("file_path").alias("file"), F.col("line_no").alias("place"),
                        F.from_json("line", _LAW).alias("law")).select("file", "place", "law.*")


def load_laws(spark: SparkSession, path: str | None = None, fmt: str | None = None,
              multi_line: bool = False) -> DataFrame:
    """The bundled table, or an override that replaces it (no merge).

    The override is a file or a folder of files, JSON (one object per line;
    ``{"laws": [...]}`` documents with ``multi_line=True``) or Parquet; the YAML
    parser of the original is not rebuilt.  An override of a few megabytes is
    marked for broadcast, a larger one is joined by shuffle.  ``ord`` is the load order 1..n over
    all files: by file name, then by place in the file; a column ``ord`` of the
    files comes first.  Duplicate IDs raise ``ValueError`` naming them (S8).
    """
    if path is None:
        laws = bundled_laws(spark)
    else:
        fmt = fmt or ("parquet" if path.endswith(".parquet") else "json")
        raw = _override(spark, path, fmt, multi_line).withColumnRenamed("ord", "given")
        order = [F.asc_nulls_last("given"), F.regexp_extract("file", r"([^/]*)$", 1), F.col("file"), F.col("place")]
        laws = numbered(raw, order, name="ord").select(F.col("ord").cast("int").alias("ord"), *_TEXTS)
        size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in _TEXTS), F.lit(64))
        if (laws.agg(F.sum(size.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES:
            laws = F.broadcast(laws)  # a checkpointed table has no statistics of its own
    check_unique_ids(laws)
    return laws


def duplicate_ids(laws: DataFrame) -> DataFrame:
    """Every law ID that occurs more than once, with its ``count``."""
    return laws.groupBy("id").count().where("count > 1")


def check_unique_ids(laws: DataFrame) -> None:
    """Raises with the number of duplicate IDs and the first of them; ``duplicate_ids`` has all."""
    dups = duplicate_ids(laws)
    first = [str(r["id"]) for r in dups.orderBy("id").take(10)]
    if first:
        raise ValueError(f"duplicate law ID: {', '.join(first)} ({dups.count()} in all)")

"""Postings derived from the driver's orders and customer tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYWORDS = [
    "fresh graduate", "graduate trainee", "it support junior", "data analyst junior",
    "staff akuntansi fresh graduate", "staff gudang fresh graduate",
    "customer service fresh graduate", "magang mahasiswa",
]
TITLES = [
    "Junior Data Analyst", "Backend Developer", "Management Trainee", "Staff Akuntansi",
    "Admin Staff", "Mechanical Engineer", "IT Support", "Sales Executive", "Barista Part Time",
    "Corp 2020 Officer", "Customer Service", "Tax Staff",
]
PLACES = [
    "Jakarta Selatan", "Bandung", "Surabaya", "Semarang", "Balikpapan", "Medan", "Makassar",
    "Cikarang", "Karawang", "Gresik", "Solo", "Pontianak", "Jambi", "Manado", "Denpasar",
    "Sleman", "Jawa Timur", "Bogor", "Kota Batang", "Papua",
]
NBSP, TAB, IDEOGRAPHIC = chr(0xA0), chr(9), chr(0x3000)
SENTENCES = [
    "Pendidikan minimal S1 Informatika, IPK minimum 3,25 dan transkrip nilai.",
    "D3 atau diploma 3 Akuntansi, minimal 2 tahun pengalaman.",
    "Lulusan magister manajemen, gpa >= 3; 1 year experience, 3 years experience.",
    "Fresh graduate welcome, aktif organisasi, panitia event dan komunikasi baik.",
    "Sertifikat brevet, TOEFL 500, Bahasa Inggris aktif.",
    "Menguasai Microsoft Office, SQL dan Python; portofolio GitHub.",
    "Pengalaman minimal 2 tahun, leadership dan kerja sama tim.",
    "Magang atau internship, tugas akhir, beasiswa penuh.",
    "Prestasi akademik dan lomba menjadi nilai tambah, ipk: 3.5",
    "Teknik mesin, 2-3 tahun pengalaman, ketua himpunan.",
    "gpa 4.5 minimum gpa 3.0, 2 years of experience preferred.",
    "Pengalaman kerja minimal 2 tahun di bidang ekonomi.",
    "Communication and teamwork, final project showcase.",
    "ipk > 3, bisnis atau business administration, volunteer.",
    f"  Tanpa{NBSP}syarat{TAB}khusus.{IDEOGRAPHIC}",
    "ipk 30 dan 5 thn pengalaman, koordinator, 1.000 karyawan.",
]
# Text that makes a card long enough to be one.
FILLER = "Kami mencari rekan kerja yang teliti dan rajin untuk bergabung dengan tim. " * 3
NO_COMPANY = "cast(NULL AS STRING)"
PHONE = " hubungi 081234567890"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index: str) -> str:
    listed = ", ".join("'" + v.replace("'", "\\'") + "'" for v in values)
    return f"get(array({listed}), cast({index} AS INT))"


def posting_columns(orders: DataFrame, company: str) -> DataFrame:
    """Posting columns computed from order rows; also works on a stream of orders."""
    rows = orders.withColumnsRenamed({"o_orderkey": "k"}).selectExpr(
        "*", "cast(floor(o_totalprice * 30) AS BIGINT) AS amt").selectExpr(
        "*", "amt div 1000000 AS m", "(amt div 100000) % 10 AS d",
        "concat(cast(amt div 1000000 AS STRING), '.', "
        "lpad(cast((amt div 1000) % 1000 AS STRING), 3, '0'), '.', "
        "lpad(cast(amt % 1000 AS STRING), 3, '0')) AS dots")
    return rows.selectExpr(
        "k AS pos", "cast(k % 4 AS INT) AS piece",
        f"{_pick(KEYWORDS, 'k % 8')} AS source_keyword",
        f"{_pick(TITLES, 'k % 12')} AS job_title",
        f"CASE WHEN k % 13 <> 0 THEN {company} END AS company",
        f"CASE WHEN k % 17 = 0 THEN NULL WHEN k % 19 = 0 THEN '  ' "
        f"ELSE {_pick(PLACES, '(k * 7) % 20')} END AS location",
        """CASE k % 10 WHEN 1 THEN concat('Rp ', dots)
           WHEN 2 THEN concat('Rp ', dots, ' - Rp ', dots, ' per bulan')
           WHEN 3 THEN concat(m, ',', d, ' juta') WHEN 4 THEN concat('IDR ', amt)
           WHEN 5 THEN concat('rp ', amt div 1000, 'k') WHEN 6 THEN 'Kompetitif'
           WHEN 7 THEN concat(m, ' - ', m + 2, ' juta')
           WHEN 8 THEN concat('gaji ', m, '.', d, 'jt per month') WHEN 9 THEN ' ' END AS salary_text""",
        f"concat({_pick(SENTENCES, 'k % 16')}, CASE WHEN k % 11 = 0 THEN '{PHONE}' ELSE '' END) "
        "AS job_description",
        "CASE WHEN k % 23 <> 0 THEN concat('https://jobs.example.org/job/', "
        "CASE WHEN k % 5 < 2 THEN k div 4 ELSE k END) END AS job_url",
        "date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') AS scraped_at",
    )


def postings(spark: SparkSession, sf_dir: str, with_company: bool = True) -> DataFrame:
    """One posting per order.

    The customer table only gives the company name. Queries that do not read it leave the join
    out; customers are unique by key, so the left join never changes the rows.
    """
    # Dealt by customer whatever the table's size: text work uses all cores, and the customer join
    # needs no other shuffle.
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate").repartition(
        int(spark.conf.get("spark.sql.shuffle.partitions")), "o_custkey")
    if not with_company:
        return posting_columns(orders, NO_COMPANY).drop("company")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
    return posting_columns(joined, "c_name")


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search page per posting, with a card whose marks differ from part to part."""
    company = ("CASE piece WHEN 0 THEN concat('<b data-automation=\"jobCompany\">', company, '</b>') "
               "WHEN 1 THEN concat('<i data-testid=\"company-name\">', company, '</i>') "
               "WHEN 2 THEN concat('<span data-automation=\"a-company-b\">', company, '</span>') "
               "ELSE concat('<a data-automation=\"company\">', company, '</a>') END")
    place = ("CASE piece WHEN 0 THEN concat('<b data-automation=\"jobLocation\">', location, '</b>') "
             "WHEN 1 THEN concat('<i data-testid=\"job-location\">', location, '</i>') "
             "ELSE concat('<span data-automation=\"location\">', location, '</span>') END")
    pay = ("CASE piece WHEN 0 THEN concat('<b data-automation=\"jobSalary\">', salary_text, '</b>') "
           "WHEN 1 THEN concat('<i data-testid=\"job-salary\">', salary_text, '</i>') "
           "ELSE concat('<p aria-label=\"gaji bulanan\">', salary_text, '</p>') END")
    return postings(spark, sf_dir).selectExpr(
        "pos AS page_id", "'https://jobs.example.org/cari' AS url",
        "concat_ws('', '<html><body><nav><a href=\"/cari\">Cari</a></nav><div><article><h3><a href=\"/job/', "
        f"cast(pos AS STRING), '?ref=1\">', job_title, '</a></h3> ', {company}, ' ', {place}, ' ', {pay}, "
        f"' <main><p>', job_description, '</p> <p>{FILLER}</p></main></article></div></body></html>') AS html")

"""Search keywords by batch, batch selection and the crawl frontier."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wageband.functions.once import with_columns_once
from wageband.functions.text import normalize_text, strip_blanks
from wageband.schemas import PAGES_PER_KEYWORD

# The keyword batches, in order.
KEYWORD_BATCHES = {
    "01_umum_fresh_graduate": [
        "fresh graduate s1", "fresh graduate", "lulusan baru", "entry level", "entry level s1",
        "junior fresh graduate", "staff fresh graduate", "officer fresh graduate",
        "associate fresh graduate",
    ],
    "02_trainee_program": [
        "management trainee fresh graduate", "graduate trainee", "officer development program",
        "management development program", "trainee program fresh graduate",
        "leader trainee fresh graduate", "management trainee s1",
    ],
    "03_it_software": [
        "junior programmer fresh graduate", "junior developer fresh graduate",
        "junior web developer fresh graduate", "backend developer fresh graduate",
        "frontend developer fresh graduate", "mobile developer fresh graduate",
        "software engineer fresh graduate", "it support fresh graduate",
        "system analyst fresh graduate", "qa tester fresh graduate", "programmer junior",
        "web developer junior", "qa tester junior", "it support junior",
    ],
    "04_data_business": [
        "data analyst fresh graduate", "junior data analyst fresh graduate",
        "business intelligence fresh graduate", "business analyst fresh graduate",
        "data analyst junior", "business analyst junior",
    ],
    "05_finance_accounting_tax_audit": [
        "finance staff fresh graduate", "accounting staff fresh graduate",
        "tax staff fresh graduate", "audit staff fresh graduate",
        "staff akuntansi fresh graduate", "staff finance fresh graduate",
        "staff pajak fresh graduate",
    ],
    "06_admin_operation_logistic": [
        "admin staff fresh graduate", "operation staff fresh graduate",
        "staff administrasi fresh graduate", "staff operasional fresh graduate",
        "staff gudang fresh graduate", "staff purchasing fresh graduate",
        "staff export import fresh graduate",
    ],
    "07_marketing_sales_hr_service": [
        "marketing staff fresh graduate", "sales executive fresh graduate",
        "customer service fresh graduate", "hr staff fresh graduate",
        "staff marketing fresh graduate", "staff sales fresh graduate",
        "customer service officer fresh graduate",
    ],
    "08_internship_banking": [
        "internship s1", "magang mahasiswa", "internship fresh graduate",
        "teller fresh graduate", "banking staff fresh graduate",
    ],
    "09_balance_salary": [
        "magang berbayar", "paid internship", "internship allowance", "magang uang saku",
        "internship mahasiswa", "magang mahasiswa", "part time mahasiswa", "part time admin",
        "part time customer service", "part time sales", "freelance admin",
        "freelance data entry", "data entry part time", "admin entry level",
        "admin staff fresh graduate", "staff administrasi fresh graduate",
        "customer service fresh graduate", "operator produksi fresh graduate",
        "sales promotor fresh graduate", "sales executive fresh graduate",
        "marketing staff fresh graduate", "finance staff fresh graduate",
        "accounting staff fresh graduate", "tax staff fresh graduate",
        "audit staff fresh graduate", "it support fresh graduate",
        "junior programmer fresh graduate", "junior web developer fresh graduate",
        "junior software engineer fresh graduate", "frontend developer fresh graduate",
        "backend developer fresh graduate", "mobile developer fresh graduate",
        "qa tester fresh graduate", "data analyst fresh graduate",
        "junior data analyst fresh graduate", "business analyst fresh graduate",
        "business intelligence fresh graduate", "management trainee fresh graduate",
        "graduate trainee", "officer development program", "management development program",
        "banking staff fresh graduate", "teller fresh graduate",
        "relationship officer fresh graduate", "account executive fresh graduate",
    ],
}

# Keywords of the low-wage search.
LOW_WAGE_KEYWORDS = [
    "magang berbayar", "magang uang saku", "paid internship", "internship allowance",
    "internship mahasiswa", "magang mahasiswa", "internship fresh graduate",
    "part time mahasiswa", "part time admin", "part time data entry", "data entry part time",
    "freelance data entry", "freelance admin", "freelance mahasiswa", "admin freelance",
    "admin part time", "customer service part time", "sales part time", "marketing part time",
    "content creator part time", "social media intern", "admin intern", "finance intern",
    "accounting intern", "hr intern", "marketing intern", "data analyst intern",
    "it support intern", "web developer intern", "programmer intern",
    "junior admin fresh graduate", "admin entry level", "staff administrasi entry level",
    "operator part time", "cashier part time", "kasir part time", "barista part time",
    "waiter part time", "crew part time", "crew outlet part time", "spg part time",
    "sales promotor part time", "gaji 500 ribu", "gaji 700 ribu", "gaji 800 ribu",
    "gaji 900 ribu", "gaji 1 juta", "gaji 1.5 juta", "gaji 1500000", "gaji 1800000",
    "uang saku 500", "uang saku 700", "uang saku 1000000", "honor 1 juta",
]

LOW_WAGE_BATCH = "low_wage"
# Fixed value: search pages per keyword of the low-wage search.
LOW_WAGE_PAGES = 40


def keyword_registry(spark: SparkSession,
                     batches: Mapping[str, Sequence[str]] = KEYWORD_BATCHES) -> DataFrame:
    """One row per batch and keyword, both numbered from 1."""
    rows = [(i, name, j, keyword) for i, (name, words) in enumerate(batches.items(), 1)
            for j, keyword in enumerate(words, 1)]
    return spark.createDataFrame(
        rows, "batch_no INT, batch_name STRING, keyword_no INT, keyword STRING")


def batch_listing(registry: DataFrame, postings: DataFrame) -> DataFrame:
    """Keywords per batch, and the stored postings that each batch's keywords found."""
    found = postings.groupBy(F.col("source_keyword").alias("keyword")).agg(
        F.count(F.lit(1)).alias("found"))
    return (
        registry.join(found, "keyword", "left").groupBy("batch_no", "batch_name").agg(
            F.count(F.lit(1)).alias("keywords"),
            F.coalesce(F.sum("found"), F.lit(0)).alias("postings"),
            F.array_join(F.transform(
                F.sort_array(F.collect_list(F.struct("keyword_no", "keyword"))),
                lambda k: k["keyword"]), ", ").alias("keyword_list"))
    )


def low_wage_frontier(postings: DataFrame, base_url: str, pages: int = LOW_WAGE_PAGES,
                      keywords: Sequence[str] = tuple(LOW_WAGE_KEYWORDS)) -> DataFrame:
    """Search pages of the low-wage search, with the stored postings whose title or text names the keyword.

    Each posting is looked through once for all keywords.
    """
    named = normalize_text(F.col("job_title"), F.col("job_description"))
    words = F.array(*[F.lit(k) for k in keywords])
    mentioned = with_columns_once(postings.select("job_title", "job_description"), {"_text": named}).select(
        F.explode(F.filter(words, lambda k: F.col("_text").contains(k))).alias("keyword"))
    found = mentioned.groupBy("keyword").agg(F.count(F.lit(1)).alias("mentioned"))
    listed = keyword_registry(postings.sparkSession, {LOW_WAGE_BATCH: list(keywords)}).join(
        found, "keyword", "left").select("keyword_no", "keyword", F.coalesce("mentioned", F.lit(0)).alias("mentioned"))
    return crawl_frontier(listed, base_url, pages)


def select_batch(argument: Column, names: Sequence[str] = tuple(KEYWORD_BATCHES)) -> Column:
    """Batch meant by a number, a full name or a unique part of a name.

    Gives ``(batch_name, problem)``; one of the two is null.
    """
    wanted = strip_blanks(argument)
    number = wanted.try_cast("int")
    all_names = F.array(*[F.lit(n) for n in names])
    hits = F.filter(all_names, lambda n: F.lower(n).contains(F.lower(wanted)))
    is_number = wanted.rlike("^[0-9]+$")
    in_range = number.between(1, len(names))
    name = (
        F.when(is_number, F.when(in_range, F.get(all_names, number - 1)))
        .when(wanted.isin(*names), wanted)
        .when(F.size(hits) == 1, F.get(hits, F.lit(0)))
    )
    problem = (
        F.when(is_number, F.when(F.coalesce(in_range, F.lit(False)), None).otherwise("no such number"))
        .when(wanted.isin(*names) | (F.size(hits) == 1), None)
        .when(F.size(hits) > 1, "ambiguous").otherwise("not found")
    )
    return F.struct(name.alias("batch_name"), problem.alias("problem"))


def batch_name_for(argument: str, names: Sequence[str] = tuple(KEYWORD_BATCHES),
                   spark: SparkSession | None = None) -> str:
    """The selected batch, or an error that says what is wrong with the argument."""
    session = spark or SparkSession.active()
    chosen = session.range(1).select(select_batch(F.lit(argument), names).alias("b")).first()["b"]
    if chosen["problem"] is not None:
        raise ValueError(f"batch {argument!r}: {chosen['problem']}")
    return chosen["batch_name"]


def query_encoded(text: Column) -> Column:
    """Percent encoding for a query string, blanks as plus signs."""
    # The built-in keeps the asterisk and encodes the tilde; the wanted form is the reverse.
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")),
                     F.lit("%7E"), F.lit("~"))


def crawl_frontier(keywords: DataFrame, base_url: str, pages: int = PAGES_PER_KEYWORD,
                   keyword: str = "keyword") -> DataFrame:
    """Search page addresses: every keyword with pages 1..N."""
    paged = keywords.withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(pages))))
    return paged.withColumn("search_url", F.concat(
        F.lit(f"{base_url}/jobs?keywords="), query_encoded(F.col(keyword)),
        F.lit("&page="), F.col("page").cast("string")))

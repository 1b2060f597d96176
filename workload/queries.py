"""Every operator as a query over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wageband.functions import features, text
from wageband.functions.salary import band_id, band_label, relabel_from_salary_avg, with_salary
from wageband.operators import balance, dedup, merge, ranking, report
from wageband.plans import datasets, metrics, training
from wageband.plans.quota_run import run_quota
from wageband.schemas import (
    BAND_LABELS, FIVE_BANDS, FLAG_COLUMNS, LOW_BAND_LABELS, TARGET_COLUMN, TARGET_PER_CLASS,
    WAGE_BANDS,
)
from wageband.session import shared_folder
from wageband.sources import alumni, delimited, files, pages, registry
from wageband.sources.buckets import BucketedTable
from wageband.sources.tables import PublishedTables
from wageband.streaming import ingest
from wageband.streaming.seen import SEED, SeenUrls
from workload.adapters import KEYWORDS, NO_COMPANY, listing_pages, posting_columns, postings, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Row target of the quota queries: at the size that is compared, it fills some classes and not all.
QUOTA = TARGET_PER_CLASS
# One that the first part of a stream fills for all classes.
SMALL_QUOTA = 20
SITE = "https://jobs.example.org"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _pay(spark: SparkSession, sf: str) -> DataFrame:
    """Postings with salary columns; the company plays no part in pay."""
    return datasets.with_pay(postings(spark, sf, with_company=False))


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return _pay(spark, sf).select("pos", "job_url", "salary_avg", TARGET_COLUMN)


# --- salary ---------------------------------------------------------------------------------

@query
def salary_parse(spark, sf):
    return _pay(spark, sf).select("pos", "salary_min", "salary_max", "salary_avg",
                                  "salary_available")


@query
def salary_parse_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    parsed = with_salary(docs.select("doc_id", text.normalize_text(F.col("text")).alias("t")), "t")
    return parsed.select("doc_id", "salary_min", "salary_max", "salary_avg", "salary_range_id",
                         TARGET_COLUMN)


@query
def salary_band_distribution(spark, sf):
    return report.distribution(_pay(spark, sf))


@query
def relabel_bands(spark, sf):
    k = F.col("o_orderkey")
    amount = F.floor(F.col("o_totalprice") * 30).cast("bigint")
    stored = table(spark, sf, "orders").select(
        k.alias("source_id"),
        F.when(k % 7 == 0, "x").when(k % 13 == 0, "inf").when(k % 17 == 0, "5000000d").when(
            k % 11 != 0, F.concat(amount.cast("string"), F.lit(".0")))
        .alias("salary_avg"),
        (k % 7).cast("int").alias("salary_range_id"), F.lit("old").alias(TARGET_COLUMN))
    return relabel_from_salary_avg(stored)


@query
def band_override(spark, sf):
    amount = F.floor(F.col("o_totalprice") * 30).cast("bigint")
    return table(spark, sf, "orders").select(
        "o_orderkey", band_id(amount, FIVE_BANDS).alias("range_id"),
        band_label(amount, FIVE_BANDS).alias("range_label"))


@query
def salary_snippet_window(spark, sf):
    cards = postings(spark, sf).select(
        "pos", F.when(F.col("pos") % 3 == 0, F.col("salary_text")).alias("salary_text"),
        text.clean_text(F.concat_ws(
            " ", "job_title", "company", "location", "salary_text", "job_description",
        )).alias("card_text"))
    return pages.with_pay_fallback(cards.withColumn(
        "salary_text", text.clean_text(F.col("salary_text")))).select("pos", "salary_text")


# --- text and categories --------------------------------------------------------------------

@query
def normalize_text(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    return docs.select(
        "doc_id", text.normalize_text(F.col("source"), F.col("text")).alias("normalized"),
        text.clean_text(F.col("text")).alias("cleaned"))


def _feature_text(spark, sf):
    return datasets.with_posting_text(postings(spark, sf))


@query
def min_gpa(spark, sf):
    return _feature_text(spark, sf).select(
        "pos", text.min_gpa(F.col("_feature_text")).alias("min_gpa"))


@query
def experience_years(spark, sf):
    return _feature_text(spark, sf).select(
        "pos", text.experience_years(F.col("_feature_text")).alias("experience_years"))


@query
def keyword_flags(spark, sf):
    return features.with_features(_feature_text(spark, sf)).select("pos", *FLAG_COLUMNS)


@query
def job_family(spark, sf):
    return _feature_text(spark, sf).select(
        "pos", features.job_family(F.col("_feature_text")).alias("job_family"))


def _regions(spark, sf):
    return features.with_region_group(postings(spark, sf, with_company=False))


@query
def region_group(spark, sf):
    return _regions(spark, sf).select("pos", "region_group")


@query
def region_repair(spark, sf):
    return datasets.repair_regions(_regions(spark, sf)).select("pos", "location", "region_group")


@query
def region_repair_diff(spark, sf):
    return report.region_repair_diff(_regions(spark, sf).select("location", "region_group"))


@query
def region_drilldown(spark, sf):
    return datasets.region_drilldown(postings(spark, sf))


@query
def slug_names(spark, sf):
    parts = table(spark, sf, "part")
    name = F.concat_ws(" / ", F.concat(F.lit(" "), "p_name", F.lit("! ")), "p_brand", "p_type")
    return parts.select("p_partkey", text.slug(name).alias("slug"))


# --- tables ---------------------------------------------------------------------------------

@query
def proxy_dataset(spark, sf):
    return datasets.build_proxy(postings(spark, sf))


@query
def row_id_null_groups(spark, sf):
    """Rows without a group or without a position are numbered too, nulls first."""
    rows = postings(spark, sf, with_company=False).select(
        F.when(F.col("pos") % 6 != 0, F.concat(F.lit("g"), F.col("piece"))).alias("grp"),
        F.when(F.col("pos") != 1, F.col("pos")).alias("pos"), "job_title")
    return ranking.with_row_id(rows, "pos", ["grp"])


@query
def rf_ready(spark, sf):
    return datasets.build_training_table(datasets.build_proxy(postings(spark, sf)))


@query
def dedup_keep_last(spark, sf):
    return dedup.keep_last(postings(spark, sf), ["pos"])


@query
def dedup_keep_first(spark, sf):
    return dedup.keep_first(postings(spark, sf), ["pos"])


@query
def dedup_keep_nulls(spark, sf):
    return dedup.keep_last_with_nulls(postings(spark, sf), ["pos"])


@query
def dedup_cascade(spark, sf):
    """Without a URL column the cascade ends at title and company."""
    rows = postings(spark, sf).drop("job_url").withColumnRenamed("job_title", "title")
    return dedup.keep_first_by_cascade(rows, ["pos"])


@query
def dedup_whole_rows(spark, sf):
    """No key column at all: whole rows are compared, the newest stays."""
    rows = postings(spark, sf).select("pos", "source_keyword", "job_title", "location")
    return dedup.keep_last(rows, ["pos"])


def _known(spark, sf):
    return postings(spark, sf, with_company=False).filter("piece < 2").select("job_url")


@query
def seen_url_anti_join(spark, sf):
    arrivals = postings(spark, sf).filter("piece >= 2")
    return dedup.skip_known(arrivals, _known(spark, sf), ["pos"])


def _pieces(spark, sf):
    rows = postings(spark, sf)
    return [rows.filter(F.col("piece") == i) for i in range(4)]


@query
def merge_session(spark, sf):
    """The last quarter comes in with the third, so that every posting takes part."""
    old, checkpoint, session, later = _pieces(spark, sf)
    return merge.merge_session(old.drop("scraped_at"), checkpoint, session.unionByName(later))


@query
def merge_latest_wins(spark, sf):
    combined, *batches = _pieces(spark, sf)
    return merge.merge_latest_wins(combined, batches)


@query
def merge_incremental(spark, sf):
    """The same batches merged one after another into a table of URL buckets."""
    merged = BucketedTable(shared_folder(spark, "buckets"))
    for piece in _pieces(spark, sf):
        merged.merge(piece)
    return merged.read(spark)


@query
def merge_first_wins(spark, sf):
    return merge.merge_first_wins(_with_file(postings(spark, sf)))


def _with_file(rows: DataFrame) -> DataFrame:
    return rows.withColumn("source_batch_file", F.format_string("raw_batch_%02d.csv", "piece"))


@query
def merge_existing_wins(spark, sf):
    existing, added, *others = _pieces(spark, sf)
    return merge.merge_existing_wins(existing, added.unionByName(others[0]).unionByName(others[1]))


@query
def merge_stats(spark, sf):
    before = _with_file(postings(spark, sf, with_company=False)).withColumn(
        "source_batch_file", F.when(F.col("piece") < 3, F.col("source_batch_file")))
    after = merge.merge_first_wins(before)
    return merge.merge_counts(before, after, "source_batch_file")


@query
def low_band_augment(spark, sf):
    """A quarter of the postings as the low-wage batch, a quarter as its checkpoint, the others as the base."""
    raw = postings(spark, sf).withColumn("part", F.when(F.col("piece") < 2, F.col("piece")).otherwise(0))
    return datasets.augment_low_bands(raw, F.col("piece") < 2, ["part", merge.POSITION], n=QUOTA).select(
        merge.PIECE, "pos", "job_url", "salary_avg", "salary_range_id", TARGET_COLUMN,
        "job_family", "region_group", "f_min_gpa")


@query
def low_band_tables(spark, sf):
    """The same from the single steps: the low batch merged, both training tables, their union."""
    old, checkpoint, *base = _pieces(spark, sf)
    low = datasets.low_training_table(merge.merge_low_batch(
        old.drop("piece"), checkpoint.drop("piece")).drop(merge.PIECE))
    stored = datasets.build_training_table_with_order(base[0].unionByName(base[1]))
    return datasets.add_low_bands(stored, low, n=QUOTA).select(
        merge.PIECE, "pos", "job_url", "salary_avg", "salary_range_id", TARGET_COLUMN,
        "job_family", "region_group", "f_min_gpa")


# --- balance --------------------------------------------------------------------------------

@query
def class_deficit(spark, sf):
    counts = report.class_counts(_pay(spark, sf))
    return report.class_deficits(counts).withColumn("capped", F.least("n", F.lit(TARGET_PER_CLASS)))


@query
def targets_done(spark, sf):
    rows = _pay(spark, sf)
    return report.targets_done(report.class_counts(rows, cap=TARGET_PER_CLASS))


@query
def balance_cap(spark, sf):
    return balance.cap_classes(_pay(spark, sf), ["pos"], QUOTA).select(
        "pos", "job_title", "job_url", "salary_avg", "salary_range_id", TARGET_COLUMN)


@query
def selective_cap(spark, sf):
    return balance.cap_some_classes(_labels(spark, sf), ["pos"], LOW_BAND_LABELS, QUOTA)


@query
def quota_accept(spark, sf):
    """Quotas partly filled by the first quarter; the other quarters arrive."""
    raw = postings(spark, sf, with_company=False)
    first, arrivals = raw.filter("piece = 0"), raw.filter("piece > 0")
    counts = report.class_counts(datasets.with_pay(first))
    return balance.quota_accept(
        arrivals, datasets.with_pay(arrivals), first.select("job_url"), counts, ["pos"], QUOTA,
    ).select("pos", "source_keyword", "job_title", "job_url", TARGET_COLUMN)


@query
def low_quota_accept(spark, sf):
    """Only the two lowest bands are wanted and nothing is known yet."""
    raw = postings(spark, sf, with_company=False)
    nothing = raw.filter("false")
    counts = report.class_counts(datasets.with_pay(nothing), LOW_BAND_LABELS)
    return balance.quota_accept(
        raw, datasets.with_pay(raw), nothing.select("job_url"), counts, ["pos"], QUOTA,
    ).select("pos", "job_url", TARGET_COLUMN)


@query
def quota_run(spark, sf):
    """The first quarter is published; a run fills the quotas from the others and publishes again."""
    tables = PublishedTables(shared_folder(spark, "quota-run"))
    raw = postings(spark, sf, with_company=False)
    tables.publish(raw.filter("piece = 0"))
    run_quota(tables, raw.filter("piece > 0"), target=QUOTA)
    return tables.training.read(spark).select("source_id", "job_url", "salary_avg", TARGET_COLUMN)


@query
def published_combined(spark, sf):
    """Four batches published one by one, then folded into the combined tables."""
    tables = PublishedTables(shared_folder(spark, "batches"))
    raw = postings(spark, sf, with_company=False)
    for part in range(4):
        tables.publish_batch(f"Raw batch {part}", raw.filter(F.col("piece") == part))
    tables.publish_combined(spark)
    return tables.training.read(spark).select("source_id", "job_url", "salary_avg", TARGET_COLUMN)


@query
def keyword_cap(spark, sf):
    numbered = {keyword: i + 1 for i, keyword in enumerate(KEYWORDS)}
    return balance.cap_keywords(postings(spark, sf, with_company=False), numbered, ["pos"]).select(
        "pos", "source_keyword", "job_title", "job_url")


@query
def keyword_cap_known(spark, sf):
    """The first quarter is known already; its URLs are no keyword's new ones."""
    rows = postings(spark, sf, with_company=False)
    numbered = {keyword: i + 1 for i, keyword in enumerate(KEYWORDS)}
    return balance.cap_keywords(rows.filter("piece > 0"), numbered, ["pos"],
                                known=rows.filter("piece = 0")).select(
        "pos", "source_keyword", "job_title", "job_url")


@query
def candidate_label(spark, sf):
    cards = postings(spark, sf).select(
        "pos", "job_title", "salary_text",
        F.concat_ws(" ", "job_title", "company", "location").alias("card_text"),
        F.col("job_description").alias("detail_text"))
    return datasets.candidate_label(cards).select("pos", "salary_avg", TARGET_COLUMN)


# --- registry and frontier ------------------------------------------------------------------

@query
def batch_listing(spark, sf):
    return registry.batch_listing(registry.keyword_registry(spark),
                                  postings(spark, sf, with_company=False))


@query
def batch_select(spark, sf):
    """Every word of the postings' keywords and titles, and every part size, as an argument."""
    rows = postings(spark, sf, with_company=False)
    words = rows.select(F.explode(F.split(F.concat_ws(
        " ", "source_keyword", "job_title"), " ")).alias("argument"))
    sizes = table(spark, sf, "part").select(F.col("p_size").cast("string").alias("argument"))
    chosen = words.unionByName(sizes).distinct()
    return chosen.withColumn("b", registry.select_batch(F.col("argument"))).select(
        "argument", "b.batch_name", "b.problem")


@query
def crawl_frontier(spark, sf):
    """Search pages for every keyword under which postings are stored, and every part name."""
    stored = postings(spark, sf, with_company=False).select(
        F.col("source_keyword").alias("keyword")).distinct()
    names = table(spark, sf, "part").select(F.concat_ws(
        " ~*", "p_name", "p_brand").alias("keyword")).distinct()
    return registry.crawl_frontier(stored.unionByName(names), SITE)


@query
def low_wage_frontier(spark, sf):
    return registry.low_wage_frontier(postings(spark, sf, with_company=False), SITE)


@query
def alumni_bands(spark, sf):
    k = F.col("c_custkey")
    survey = table(spark, sf, "customer").select(
        k.cast("int").alias("respondent_id"), F.col("c_mktsegment").alias("employment_industry"),
        F.when(k % 10 != 0, F.floor(F.col("c_acctbal") * 1000).cast("bigint"))
        .alias("starting_salary"))
    return alumni.with_alumni_band(survey)


# --- pages ----------------------------------------------------------------------------------

def _pages(spark, sf):
    return table(spark, sf, "pages")


@query
def page_links(spark, sf):
    """The test pages hold no posting links, so every link with a path counts."""
    return pages.extract_links(_pages(spark, sf), mark="/")


@query
def page_cards(spark, sf):
    return pages.extract_cards(_pages(spark, sf), mark="/")


@query
def listing_cards(spark, sf):
    """Cards of search pages made from the postings: company, place and pay by different marks."""
    return pages.extract_cards(listing_pages(spark, sf))


@query
def listing_details(spark, sf):
    """Detail sections of the same pages."""
    return pages.extract_details(listing_pages(spark, sf), keep=("page_id",))


@query
def page_text(spark, sf):
    return pages.extract_details(_pages(spark, sf))


@query
def page_postings(spark, sf):
    return pages.postings_of_pages(_pages(spark, sf), mark="/")


@query
def page_postings_joined(spark, sf):
    """The same with details that come from another table than the cards."""
    rows = _pages(spark, sf)
    cards = pages.extract_cards(rows, mark="/", keep=("page_id",))
    return pages.page_postings(cards, pages.extract_details(rows), ["page_id", "link_no"])


# --- delimited text -------------------------------------------------------------------------

@query
def delimited_round_trip(spark, sf):
    """Export, then read back with null tokens and declared types."""
    folder = shared_folder(spark, "export")
    delimited.write_delimited(postings(spark, sf), folder)
    layout = postings(spark, sf).schema
    return delimited.read_delimited(spark, folder, layout).drop(delimited.PROVENANCE)


@query
def delimited_layouts(spark, sf):
    """Parts exported with their own column order and separator, in files whose names need encoding, read
    back with a path that is not there. ``source`` is the part that the file's name gives."""
    folder = shared_folder(spark, "layouts")
    rows = postings(spark, sf)
    for part, sep in enumerate(delimited.SEPARATORS):
        columns = rows.columns[part:] + rows.columns[:part]
        delimited.write_delimited(rows.filter(F.col("piece") == part).select(*columns),
                                  f"{folder}/part={part}", sep=sep)
        for i, name in enumerate(files.names(spark, f"{folder}/part={part}")):
            if name.endswith(".csv"):
                files.rename(spark, f"{folder}/part={part}/{name}", f"raw batch {part} 50%-{i}.csv")
    paths = [f"{folder}/part={part}" for part in (2, 0, 3, 1)] + [f"{folder}/absent.csv"]
    back = delimited.read_delimited(spark, paths, rows.schema, sep=None)
    return back.withColumn("source", F.regexp_extract(delimited.PROVENANCE, "^(raw batch [0-9] 50%)-[0-9]+[.]csv$", 1)).drop(
        delimited.PROVENANCE)


# --- streaming ------------------------------------------------------------------------------

def _posting_stream(spark, sf):
    """The orders as a file stream; the folder or file of that name is the source."""
    schema = table(spark, sf, "orders").schema
    source = ingest.read_arrivals(spark, f"{sf}/orders.parque[t]", schema)
    # Dealt like the table of postings, so that a file of one block keeps all cores at work.
    dealt = source.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_custkey")
    return posting_columns(dealt, NO_COMPANY).drop("company")


@query
def stream_dedup_quota(spark, sf):
    ledger = ingest.Ledger(shared_folder(spark, "ledger"))
    raw = postings(spark, sf, with_company=False)
    nothing = datasets.with_pay(raw.filter("false"))
    ledger.seed(raw.filter("pos % 50 = 0"), report.class_counts(nothing))
    stream = _posting_stream(spark, sf)
    ingest.ingest_with_quota(stream, ledger, QUOTA).awaitTermination()
    return ledger.accepted(spark, stream.schema).select(
        "pos", "source_keyword", "job_title", "job_url", TARGET_COLUMN)


def _in_parts(arrivals: DataFrame, parts: int) -> list[DataFrame]:
    """The arrivals cut at places of their order, as they would come in one after another."""
    first, last = arrivals.agg(F.min("pos"), F.max("pos")).first()
    if first is None:
        return [arrivals]
    part = F.least(F.floor((F.col("pos") - first) * parts / (last - first + 1)), F.lit(parts - 1))
    return [arrivals.filter(part == i) for i in range(parts)]


@query
def stream_seen_ledger(spark, sf):
    """Three micro-batches, the stream started anew for each, against known URLs."""
    root = shared_folder(spark, "seen")
    seen = SeenUrls(f"{root}/urls", fan_in=2)
    seen.add(_known(spark, sf).filter("job_url IS NOT NULL").distinct(), SEED)
    arrivals = postings(spark, sf).filter("piece >= 2")
    for part, rows in enumerate(_in_parts(arrivals, 3)):
        rows.write.parquet(f"{root}/in/{part}")
        stream = ingest.read_arrivals(spark, f"{root}/in/*", arrivals.schema, 10_000)
        ingest.ingest_new(stream, seen, root).awaitTermination()
    return spark.read.schema(arrivals.schema).parquet(f"{root}/fresh").drop("batch_id")


def _quota_stream(spark, known: DataFrame, arrivals: DataFrame, target: int) -> DataFrame:
    """Quotas partly filled by known postings; the others come in three parts, with a restart for each."""
    ledger = ingest.Ledger(shared_folder(spark, "quotas"))
    ledger.seed(known, report.class_counts(datasets.with_pay(known), cap=target))
    for part, rows in enumerate(_in_parts(arrivals, 3)):
        rows.write.parquet(f"{ledger.root}/in/{part}")
        stream = ingest.read_arrivals(spark, f"{ledger.root}/in/*", arrivals.schema, 10_000)
        ingest.fill_quotas(stream, ledger, target)
    return ledger.accepted(spark, arrivals.schema).select(
        "pos", "source_keyword", "job_title", "job_url", TARGET_COLUMN)


@query
def stream_quota_batches(spark, sf):
    """The first quarter is known and counted; the others arrive."""
    raw = postings(spark, sf, with_company=False)
    return _quota_stream(spark, raw.filter("piece = 0"), raw.filter("piece > 0"), QUOTA)


@query
def stream_quota_full(spark, sf):
    """Quotas that the stream fills: it stops there, and later starts take nothing."""
    raw = postings(spark, sf, with_company=False)
    return _quota_stream(spark, raw.filter("false"), raw, SMALL_QUOTA)


@query
def stream_new_urls(spark, sf):
    root = shared_folder(spark, "urls")
    ingest.append_to(ingest.new_urls(_posting_stream(spark, sf)), root).awaitTermination()
    return spark.read.parquet(f"{root}/rows")


@query
def stream_class_counts(spark, sf):
    root = shared_folder(spark, "counts")
    labelled = datasets.with_pay(_posting_stream(spark, sf))
    ingest.running_counts(labelled, root).awaitTermination()
    return ingest.latest_counts(spark, root)


# --- training and metrics -------------------------------------------------------------------

@query
def class_weights(spark, sf):
    return training.class_weights(datasets.labelled_rows(_labels(spark, sf)))


@query
def stratified_split_sizes(spark, sf):
    return training.split_sizes(datasets.labelled_rows(_labels(spark, sf))).select(
        TARGET_COLUMN, "n", "n_train", "n_test", "stratified")


@query
def stratified_split(spark, sf):
    rows = datasets.labelled_rows(_labels(spark, sf)).select("pos", TARGET_COLUMN)
    return training.with_split(rows, "pos")


@query
def impute_median_mode(spark, sf):
    k = F.col("pos")
    table_ = datasets.proxy_columns(postings(spark, sf))
    holes = table_.select(
        F.when(k % 5 != 0, F.col("f_min_gpa")).alias("f_min_gpa"),
        F.when(k % 3 != 0, F.col("f_experience_years_min")).alias("f_experience_years_min"),
        F.when(k % 4 != 0, F.col("job_family")).alias("job_family"),
        F.when(k % 6 != 0, F.col("region_group")).alias("region_group"))
    return training.impute_values(holes, ["f_min_gpa", "f_experience_years_min"],
                                  ["job_family", "region_group"])


def _guesses(spark, sf):
    """Each labelled posting with a guess: its own band or, for some, the next one."""
    rows = datasets.labelled_rows(_pay(spark, sf))
    shift = F.when(F.col("pos") % 3 == 0, 1).otherwise(0)
    guess = F.get(F.array(*[F.lit(v) for v in BAND_LABELS]),
                  (F.col("salary_range_id") + shift) % len(WAGE_BANDS))
    return rows.select(F.col(TARGET_COLUMN).alias("actual"), guess.alias("predicted"))


@query
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(_guesses(spark, sf), BAND_LABELS)


@query
def confusion_cells(spark, sf):
    return metrics.confusion_cells(_guesses(spark, sf))


@query
def classification_report(spark, sf):
    return metrics.classification_report(_guesses(spark, sf))


@query
def prediction_accuracy(spark, sf):
    return metrics.accuracy(_guesses(spark, sf))


def _training_rows(spark, sf):
    return datasets.proxy_columns(postings(spark, sf)).withColumn("source_id", F.col("pos") + 1)


@query
def rf_train_metrics(spark, sf):
    """The full forest, fitted on every training row."""
    return training.train(_training_rows(spark, sf)).metrics


# The full forest, fitted on this many training rows; all other rows are split, filled and judged.
FIT_ROWS = 2_000


@query
def rf_importance(spark, sf):
    return training.train(_training_rows(spark, sf), fit_rows=FIT_ROWS).importance


@query
def rf_shape(spark, sf):
    """What a forest is fitted and judged on, and its feature names: all that does not depend on its trees."""
    made = training.train(_training_rows(spark, sf), trees=5, depth=3)
    sizes = made.metrics.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("value"))
        for c in ("n_rows", "n_train", "n_test", "n_classes")])))
    features = made.importance.select(F.concat(F.lit("feature "), "feature").alias("item"), F.lit(1.0).alias("value"))
    total = made.importance.select(F.lit("importance").alias("item"), "importance").groupBy("item").agg(
        F.round(F.sum("importance"), 6).alias("value"))
    support = made.report.filter(F.col("label").isin(BAND_LABELS) & (F.col("support") > 0)).select(
        F.concat(F.lit("support "), "label").alias("item"), F.col("support").cast("double").alias("value"))
    targets = made.targets.select(F.concat(F.lit("target "), TARGET_COLUMN).alias("item"),
                                  F.col("n").cast("double").alias("value"))
    return sizes.unionByName(features).unionByName(total).unionByName(support).unionByName(targets)


@query
def rf_embeddings_report(spark, sf):
    """The same report for a forest on the embedding components."""
    rows, names = _components(spark, sf)
    return training.train(rows, numeric=names, text=[], fit_rows=FIT_ROWS).report


def _components(spark, sf):
    """The embedding's components as columns, as many as the widest vector has."""
    vectors = table(spark, sf, "embeddings")
    names = [f"e{i}" for i in range(vectors.agg(F.max(F.size("embedding"))).first()[0] or 0)]
    parts = [F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)]
    return vectors.select(F.col("vec_id").alias("source_id"), *parts,
                          F.col("label").cast("string").alias(TARGET_COLUMN)), names


@query
def impute_embeddings(spark, sf):
    """Exact medians of continuous columns."""
    rows, names = _components(spark, sf)
    return training.impute_values(rows, names, ["salary_range_label"])

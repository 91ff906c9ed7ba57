"""Deterministic stratified sampling from a repository table.

The strata of a run are predicates over one scan of the population: each
repository carries the list of strata it meets, which replaces one search per
stratum and needs no join.  Ranks are cut by ``row_number() <= k``, which Spark
limits per task before anything is shuffled, so a hot stratum or repository
never reaches one task whole.

Seeded order is the MD5 text of ``seed:key``; it does not depend on the
process, the partitioning or the engine.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold import fixed_values as V


# --- seeds and rotation ------------------------------------------------------

def date_seed(run_date: Column, offset: int = 0) -> Column:
    """First 8 hex digits of SHA-256 of ``date:offset`` as a number."""
    text = F.concat(F.date_format(run_date, "yyyy-MM-dd"), F.lit(f":{offset}"))
    return _hex8(F.sha2(text, 256))


def _hex8(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def ordinal(run_date: Column) -> Column:
    """Day number counted from 0001-01-01 = 1."""
    return F.datediff(run_date, F.lit("0001-01-01").cast("date")) + 1


def rotation_index(run_date: Column, modulus: Column | int) -> Column:
    by = F.lit(modulus) if isinstance(modulus, int) else modulus
    return F.pmod(ordinal(run_date), by)


def seeded_order(seed: Column, *keys: Column) -> Column:
    return F.md5(F.concat_ws(":", seed.cast("string"), *[k.cast("string") for k in keys]))


# --- strata ------------------------------------------------------------------

def within(value: Column, low: int | None, high: int | None) -> Column:
    test = F.lit(True) if low is None else value >= low
    return test if high is None else test & (value <= high)


def _picked(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def star_block(run_date: Column) -> Column:
    """0 or 1: which half of the star buckets a date draws from."""
    return F.pmod(ordinal(run_date), F.lit(2))


def rotating_year(run_date: Column) -> Column:
    years = F.year(run_date) - V.FIRST_CREATED_YEAR + 1
    return F.lit(V.FIRST_CREATED_YEAR) + rotation_index(run_date, years)


def rotating_topic(run_date: Column) -> Column:
    return _picked(V.TOPICS, rotation_index(run_date, len(V.TOPICS)))


def _stratum(condition: Column, name: Column | str, label: Column | str, sort: Column | None = None) -> Column:
    as_col = lambda v: F.lit(v) if isinstance(v, str) else v
    sort_value = F.lit(None).cast("double") if sort is None else sort.cast("double")
    entry = F.struct(as_col(name).alias("strategy"), as_col(label).alias("stratum"), sort_value.alias("sort_value"))
    return F.when(condition, entry)


def star_strata(run_date: Column) -> list[Column]:
    """Three of six star buckets; two consecutive days cover all six."""
    half, stars = len(V.STAR_BUCKETS) // 2, F.col("stars")
    return [
        _stratum((star_block(run_date) == i // half) & within(stars, low, high), f"star_bucket_{label}", f"stars:{label}", stars)
        for i, (label, low, high) in enumerate(V.STAR_BUCKETS)
    ]


def recent_stratum(run_date: Column) -> Column:
    pushed = F.to_date("pushed_at")
    order = F.unix_timestamp(F.to_timestamp("pushed_at"))
    return _stratum((pushed > F.date_sub(run_date, 2)) & (F.col("stars") > 0), "recent_push", "activity:recent_push", order)


def created_stratum(run_date: Column) -> Column:
    year = rotating_year(run_date)
    label = F.concat(F.lit("age:created_"), year.cast("string"))
    return _stratum((F.year(F.to_date("created_at")) == year) & (F.col("stars") > 2), "created_window", label)


def topic_stratum(run_date: Column) -> Column:
    topic = rotating_topic(run_date)
    return _stratum(F.array_contains("topics", topic) & (F.col("stars") > 1), "topic", F.concat(F.lit("topic:"), topic))


def size_strata(run_date: Column) -> list[Column]:
    index = rotation_index(run_date, len(V.SIZE_BUCKETS))
    return [
        _stratum(
            (index == i) & within(F.col("size_kb"), low, high) & (F.col("stars") > 0), "size_bucket", f"repo_size:{label}"
        )
        for i, (label, low, high) in enumerate(V.SIZE_BUCKETS)
    ]


def daily_strata(run_date: Column) -> list[Column]:
    """The seven strata of a date, as conditional structs over a repository row."""
    return [
        *star_strata(run_date),
        recent_stratum(run_date),
        created_stratum(run_date),
        topic_stratum(run_date),
        *size_strata(run_date),
    ]


def cohort_topic(year: Column, k: int) -> Column:
    """First or second topic of a creation year."""
    return _picked(V.TOPICS, F.pmod(year * 2 + k, F.lit(len(V.TOPICS))))


def cohort_strata() -> list[Column]:
    """The strata of the creation-year cohort a repository belongs to."""
    stars, year = F.col("stars"), F.col("cohort_year")
    bands = [
        _stratum(within(stars, low, high), f"cohort_star_{label}", f"stars:{label}", stars)
        for label, low, high in V.COHORT_STAR_BANDS
    ]
    topics = []
    for k in range(2):
        topic = cohort_topic(year, k)
        topics.append(_stratum(F.array_contains("topics", topic), f"cohort_topic_{k}", F.concat(F.lit("topic:"), topic)))
    return [*bands, *topics]


def assign(repos: DataFrame, strata: list[Column]) -> DataFrame:
    """A row per repository and stratum it meets.  The outer form keeps Spark
    from testing all strata once more in a filter of its own."""
    met = repos.select(*repos.columns, F.inline_outer(F.array_compact(F.array(*strata))))
    return met.where(F.col("strategy").isNotNull())


def plan_rows(dates: DataFrame, seed_offset: int = 0) -> DataFrame:
    """What a daily run will draw, for every ``run_date``: seven rows, and the
    seeded key they are served by."""
    day = F.col("run_date")

    def entry(name: str, stratum: Column, sort: str) -> Column:
        return F.struct(F.lit(name).alias("name"), stratum.alias("stratum"), F.lit(sort).alias("sort"))

    half = len(V.STAR_BUCKETS) // 2
    stars = [
        F.when(star_block(day) == i // half, entry(f"star_bucket_{n}", F.lit(f"stars:{n}"), "stars"))
        for i, (n, _, _) in enumerate(V.STAR_BUCKETS)
    ]
    size = _picked(tuple(b[0] for b in V.SIZE_BUCKETS), rotation_index(day, len(V.SIZE_BUCKETS)))
    others = [
        entry("recent_push", F.lit("activity:recent_push"), "updated"),
        entry("created_window", F.concat(F.lit("age:created_"), rotating_year(day).cast("string")), "best_match"),
        entry("topic", F.concat(F.lit("topic:"), rotating_topic(day)), "best_match"),
        entry("size_bucket", F.concat(F.lit("repo_size:"), size), "best_match"),
    ]
    seed = date_seed(day, seed_offset)
    rows = dates.select(day, seed.alias("seed"), F.inline(F.array_compact(F.array(*stars, *others))))
    return rows.withColumn("served_by", seeded_order(F.col("seed"), F.col("name")))


def cohort_plan_rows(years: DataFrame, seed_offset: int = 0) -> DataFrame:
    """What a cohort run will draw, for every ``cohort_year``: five rows."""
    year = F.col("cohort_year")
    bands = [F.struct(F.lit(f"cohort_star_{n}").alias("name"), F.lit(f"stars:{n}").alias("stratum")) for n, _, _ in V.COHORT_STAR_BANDS]
    topics = [
        F.struct(F.lit(f"cohort_topic_{k}").alias("name"), F.concat(F.lit("topic:"), cohort_topic(year, k)).alias("stratum"))
        for k in range(2)
    ]
    run_date = F.make_date(year, F.lit(1), F.lit(1))
    rows = years.select(run_date.alias("run_date"), date_seed(run_date, seed_offset).alias("seed"), F.inline(F.array(*bands, *topics)))
    return rows.withColumn("served_by", seeded_order(F.col("seed"), F.col("name")))


def plan_strata(plan: DataFrame) -> DataFrame:
    """The strata of each run date as a list; a plan has at most seven."""
    return plan.groupBy("run_date").agg(F.array_sort(F.collect_list("stratum")).alias("strata"))


# --- windows, pool, caps -----------------------------------------------------

@dataclass(frozen=True)
class Quota:
    """How many rows each stratum gives: an even share of ``sample_size``, ten at least.

    ``result_cap`` restricts a stratum to its first ranks, as a service that
    shows no more results would; None (the default) draws from all its rows.
    """

    strata: int
    sample_size: int = V.REPO_SAMPLE_SIZE
    result_cap: int | None = None

    def __post_init__(self) -> None:
        if self.result_cap is not None and self.result_cap < self.per_stratum:
            raise ValueError(f"a stratum gives {self.per_stratum} rows, more than the result cap of {self.result_cap}")

    @property
    def per_stratum(self) -> int:
        return max(10, self.sample_size // max(1, self.strata))


@dataclass(frozen=True)
class Limits:
    """What a run takes at most per file, repository and date; None lifts a limit.

    The run report counts the documents that these leave out.
    """

    file_bytes: int | None = V.MAX_FILE_BYTES
    files_per_repo: int | None = V.MAX_FILES_PER_REPO
    documents: int | None = V.TARGET_DOCUMENTS


DEFAULT_LIMITS = Limits()


def start_rank(seed: Column, strategy: Column, spare: Column) -> Column:
    """Ranks to skip in a stratum that has ``spare`` rows beyond its quota."""
    return F.when(spare > 0, F.pmod(_hex8(seeded_order(seed, strategy, F.lit("page"))), spare + 1)).otherwise(0)


SALTS = 64


def top_ranked(rows: DataFrame, groups: list[str], order: list[Column], k: int, rank: str) -> DataFrame:
    """The first ``k`` rows of each group with their rank, for few, large groups.

    Every task keeps at most k rows of a group; those are ranked in salted parts
    and the parts' winners once more, so no task meets k rows of every other.
    The salt is the input partition, which changes nothing about the result.
    """
    salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    part = F.row_number().over(Window.partitionBy(*groups, "salt").orderBy(*order))
    kept = salted.withColumn(rank, part).where(F.col(rank) <= k).drop(rank, "salt")
    whole = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return kept.withColumn(rank, whole).where(F.col(rank) <= k)


LARGE = 10_000  # rows of a group that one task may rank
PREFIX = 4  # leading digits of a hash: 65,536 buckets a group


def first_hashed(rows: DataFrame, groups: list[str], order: list[Column], k: int, rank: str) -> DataFrame:
    """The first ``k`` rows of each group with their rank, for any ``k``, where ``order`` begins with a hash in hexadecimal.

    A histogram of the hashes' leading digits says in which bucket a group's k-th row lies and how many
    rows come before each bucket.  Rows beyond that bucket are cut in the scan, and rows are ranked inside their
    bucket, so a task holds buckets and never a group.  The rows are read twice.
    """
    bucketed = rows.withColumn("bucket", F.substring(order[0], 1, PREFIX))
    counts = bucketed.groupBy(*groups, "bucket").agg(F.count("*").alias("n"))
    begins = F.sum("n").over(Window.partitionBy(*groups).orderBy("bucket")) - F.col("n")
    needed = counts.withColumn("begins", begins).where(F.col("begins") < k).drop("n")
    place = F.row_number().over(Window.partitionBy(*groups, "bucket").orderBy(*order))
    placed = bucketed.join(needed, [*groups, "bucket"]).withColumn(rank, (F.col("begins") + place).cast("int"))
    return placed.where(F.col(rank) <= k).select(*rows.columns, rank)


def stratum_window(assigned: DataFrame, seed: Column, quota: Quota, by: tuple[str, ...] = ()) -> DataFrame:
    """The rows each stratum gives, with their rank; a stratum with fewer rows
    than its quota gives all of them.

    Without a result cap these are the first rows in seeded order, an even draw
    from the whole stratum.  With one, the stratum is ranked by its sort value
    and gives consecutive rows of its first ``result_cap`` from a seeded start.
    """
    group = [*by, "strategy", "stratum"]
    keyed = assigned.withColumn("order_key", seeded_order(seed, F.col("full_name")))
    drawn = [F.col("order_key"), F.col("full_name")]
    if quota.result_cap is None:
        first = top_ranked if quota.per_stratum <= LARGE else first_hashed
        return first(keyed, group, drawn, quota.per_stratum, "rank").drop("order_key")
    ranked = top_ranked(keyed, group, [F.desc_nulls_last("sort_value"), *drawn], quota.result_cap, "rank")
    spare = F.max("rank").over(Window.partitionBy(*group)) - quota.per_stratum  # over result_cap rows at most
    first = start_rank(seed, F.col("strategy"), spare)
    placed = ranked.withColumn("first", first).where((F.col("rank") > F.col("first")) & (F.col("rank") <= F.col("first") + quota.per_stratum))
    return placed.drop("first", "order_key")


def dedup_pool(windowed: DataFrame, seed: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per repository: the stratum served first in seeded order wins."""
    served = [seeded_order(seed, F.col("strategy")), F.col("strategy"), F.col("stratum")]
    ranked = windowed.withColumn("served", F.row_number().over(Window.partitionBy(*by, "full_name").orderBy(*served)))
    return ranked.where(F.col("served") == 1).drop("served")


def document_files(files: DataFrame) -> DataFrame:
    """Document files outside checkpoint folders."""
    path = F.col("path")
    return files.where((F.col("type") == "blob") & path.endswith(".ipynb") & ~path.contains(".ipynb_checkpoints/"))


def within_bytes(files: DataFrame, max_bytes: int | None) -> DataFrame:
    """Files up to a size; one of unknown size is taken."""
    return files if max_bytes is None else files.where(F.coalesce("size", F.lit(0)) <= max_bytes)


def eligible_files(files: DataFrame, max_bytes: int | None = V.MAX_FILE_BYTES) -> DataFrame:
    """Document files outside checkpoint folders, up to the size limit if there is one."""
    return within_bytes(document_files(files), max_bytes)


def cap_per_group(rows: DataFrame, groups: list[str], order: list[Column], cap: int = V.MAX_FILES_PER_REPO) -> DataFrame:
    """At most ``cap`` rows per group in the given order."""
    ranked = rows.withColumn("pick", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    return ranked.where(F.col("pick") <= cap)


def cap_total(rows: DataFrame, order: list[Column], cap: int = V.TARGET_DOCUMENTS) -> DataFrame:
    """The first ``cap`` rows of all, in an order that begins with a hash."""
    if cap > LARGE:
        return first_hashed(rows, [], order, cap, "place").drop("place")
    return rows.orderBy(*order).limit(cap)


def pooled_files(pool: DataFrame, files: DataFrame) -> DataFrame:
    """All document files of the pooled repositories.  The join is left to the
    planner's size check: a pool of any quota may be passed."""
    return document_files(files).join(pool, "full_name")


def draw_files(listed: DataFrame, seed: Column, limits: Limits = DEFAULT_LIMITS, by: tuple[str, ...] = ()) -> DataFrame:
    """The files of ``pooled_files`` that a run reads, within its limits."""
    order = [seeded_order(seed, F.col("full_name"), F.col("path")), F.col("path")]
    drawn = within_bytes(listed, limits.file_bytes)
    if limits.files_per_repo is not None:
        drawn = cap_per_group(drawn, [*by, "full_name"], order, limits.files_per_repo)
    if limits.documents is None:
        return drawn
    order = [seeded_order(seed, F.col("full_name")), F.col("full_name"), *order]
    if not by:
        return cap_total(drawn, order, limits.documents)
    if limits.documents > LARGE:
        return first_hashed(drawn, list(by), order, limits.documents, "draw")
    ranked = drawn.withColumn("draw", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("draw") <= limits.documents)


DAILY_QUOTA = Quota(strata=7)
COHORT_QUOTA = Quota(strata=5)


def day_pool(repos: DataFrame, run_date: date, seed_offset: int = 0, quota: Quota = DAILY_QUOTA) -> DataFrame:
    """Repositories that a daily run considers."""
    day = F.lit(run_date)
    seed = date_seed(day, seed_offset)
    return dedup_pool(stratum_window(assign(repos, daily_strata(day)), seed, quota), seed)


def sample_day(
    repos: DataFrame, files: DataFrame, run_date: date, seed_offset: int = 0, quota: Quota = DAILY_QUOTA, limits: Limits = DEFAULT_LIMITS
) -> tuple[DataFrame, DataFrame]:
    """Pool and drawn files of a daily run."""
    pool = day_pool(repos, run_date, seed_offset, quota)
    return pool, draw_files(pooled_files(pool, files), date_seed(F.lit(run_date), seed_offset), limits)


def cohort_seed(seed_offset: int = 0) -> Column:
    return date_seed(F.make_date("cohort_year", F.lit(1), F.lit(1)), seed_offset)


def cohort_pool(
    repos: DataFrame,
    start_year: int = V.FIRST_COHORT_YEAR,
    end_year: int | None = None,
    seed_offset: int = 0,
    quota: Quota = COHORT_QUOTA,
) -> DataFrame:
    """Repositories considered for every creation year in a range, in one job."""
    repos = repos.withColumn("cohort_year", F.year(F.to_date("created_at")))
    last = F.year(F.current_date()) if end_year is None else F.lit(end_year)
    repos = repos.where(F.col("cohort_year").between(F.lit(start_year), last))
    seed, by = cohort_seed(seed_offset), ("cohort_year",)
    return dedup_pool(stratum_window(assign(repos, cohort_strata()), seed, quota, by), seed, by)


def sample_cohorts(
    repos: DataFrame,
    files: DataFrame,
    start_year: int = V.FIRST_COHORT_YEAR,
    end_year: int | None = None,
    seed_offset: int = 0,
    quota: Quota = COHORT_QUOTA,
    limits: Limits = DEFAULT_LIMITS,
) -> tuple[DataFrame, DataFrame]:
    """Pool and drawn files of every creation year in a range, in one job."""
    pool = cohort_pool(repos, start_year, end_year, seed_offset, quota)
    return pool, draw_files(pooled_files(pool, files), cohort_seed(seed_offset), limits, ("cohort_year",))


def accounting(dates: DataFrame, pool: DataFrame, listed: DataFrame, drawn: DataFrame) -> DataFrame:
    """Counts per ``run_date``: repositories considered and reached with
    documents, documents read, errors (drawn files whose content could not be
    read) and documents that the run's limits left out."""
    considered = pool.groupBy("run_date").agg(F.countDistinct("full_name").alias("repos_considered"))
    reached = drawn.groupBy("run_date").agg(
        F.countDistinct("full_name").alias("repos_with_notebooks"),
        F.count_if(F.col("raw").isNotNull()).alias("notebooks_collected"),
        F.count_if(F.col("raw").isNull()).alias("errors"),
    )
    found = listed.groupBy("run_date").agg(F.count("*").alias("listed"))
    counts = dates.select("run_date")
    for part in (considered, reached, found):
        counts = counts.join(part, "run_date", "left")
    counts = counts.fillna(0)
    left_out = F.col("listed") - F.col("notebooks_collected") - F.col("errors")
    return counts.withColumn("documents_left_out", left_out).drop("listed")


def describe(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("strategy", "stratum").agg(F.count(F.lit(1)).alias("repos"))

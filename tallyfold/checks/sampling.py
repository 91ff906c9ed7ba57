"""Stratified sampling with ``customer`` as the population and ``orders`` as files.

Account balance stands for stars, the key for size and age, the segment and
nation for topics; every order is one file of its customer's repository.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold import fixed_values as V
from tallyfold.checks import bindings as B
from tallyfold.checks.registry import query
from tallyfold.operators import sampling as S

RUN_DATE = date(2024, 3, 10)
_DAY = f"DATE '{RUN_DATE.isoformat()}'"
_TOPICS = "[" + ", ".join(f"'{t}'" for t in V.TOPICS) + "]"


def repositories(spark, sf) -> DataFrame:
    key, topics = F.col("c_custkey"), F.array(*[F.lit(t) for t in V.TOPICS])
    size = len(V.TOPICS)
    return B.table(spark, sf, "customer").select(
        F.col("c_name").alias("full_name"),
        F.when(F.col("c_nationkey") < 5, "dev").otherwise("main").alias("default_branch"),
        F.floor(F.greatest(F.col("c_acctbal"), F.lit(0)) / 4).alias("stars"),
        (key * 37 % 60001).alias("size_kb"),
        F.date_format(F.date_add(F.lit(date(2013, 1, 1)), (key * 7 % 4700).cast("int")), "yyyy-MM-dd").alias("created_at"),
        F.date_format(F.date_sub(F.lit(RUN_DATE), (key % 9).cast("int")), "yyyy-MM-dd").alias("pushed_at"),
        F.array(
            F.element_at(topics, (key % size).cast("int") + 1), F.element_at(topics, (F.col("c_nationkey") % size) + 1)
        ).alias("topics"),
    )


def repository_files(spark, sf) -> DataFrame:
    """Every order as a file: some are folders, checkpoints, notes or too large."""
    path = F.concat(
        F.when(F.col("o_orderpriority") == "5-LOW", ".ipynb_checkpoints/").otherwise("nb/"),
        F.col("o_orderkey"),
        F.when(F.col("o_orderpriority") == "1-URGENT", ".md").otherwise(".ipynb"),
    )
    return B.table(spark, sf, "orders").select(
        F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("full_name"),
        F.when(F.col("o_orderstatus") == "P", "tree").otherwise("blob").alias("type"),
        path.alias("path"),
        F.floor(F.col("o_totalprice") * 10).alias("size"),
        F.col("o_orderdate"),
    )


def _hex8(text: str) -> str:
    return f"CAST('0x' || substr({text}, 1, 8) AS BIGINT)"


_SEED = _hex8("sha256('{0}:0')")
_REPOS_SQL = f"""repos AS (SELECT c_name AS full_name, floor(greatest(c_acctbal, 0) / 4)::BIGINT AS stars, c_custkey * 37 % 60001 AS size_kb,
    DATE '2013-01-01' + (c_custkey * 7 % 4700)::INT AS created_at, {_DAY} - (c_custkey % 9)::INT AS pushed_at,
    [{_TOPICS}[(c_custkey % 14)::INT + 1], {_TOPICS}[c_nationkey % 14 + 1]] AS topics FROM customer)"""
_FILES_SQL = """files AS (SELECT 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') AS full_name,
    CASE WHEN o_orderstatus = 'P' THEN 'tree' ELSE 'blob' END AS type,
    CASE WHEN o_orderpriority = '5-LOW' THEN '.ipynb_checkpoints/' ELSE 'nb/' END || o_orderkey
      || CASE WHEN o_orderpriority = '1-URGENT' THEN '.md' ELSE '.ipynb' END AS path, floor(o_totalprice * 10)::BIGINT AS size FROM orders),
documents_listed AS (SELECT * FROM files WHERE type = 'blob' AND path LIKE '%.ipynb' AND path NOT LIKE '%.ipynb_checkpoints/%'),
eligible AS (SELECT * FROM documents_listed WHERE size <= 4000000)"""

# Day facts worked out by hand in SQL: ordinal, parity, rotations.
_ORDINAL = "(date_diff('day', DATE '0001-01-01', {0}) + 1)"
_DAY_ORDINAL = _ORDINAL.format(_DAY)
_YEAR = f"(2015 + {_DAY_ORDINAL} % (year({_DAY}) - 2015 + 1))"
_TOPIC = f"{_TOPICS}[({_DAY_ORDINAL} % 14)::INT + 1]"
_STAR_SQL = f"""SELECT full_name, 'star_bucket_' || label AS strategy, 'stars:' || label AS stratum, stars::DOUBLE AS sort_value
  FROM repos JOIN (VALUES ('long_tail', 1, 5, 0), ('small', 6, 25, 0), ('medium', 26, 100, 0), ('popular', 101, 500, 1),
    ('very_popular', 501, 2000, 1), ('head', 2001, 1000000000, 1)) b(label, lo, hi, block)
    ON stars BETWEEN lo AND hi AND block = {{parity}}"""
_RECENT_SQL = f"""SELECT full_name, 'recent_push' AS strategy, 'activity:recent_push' AS stratum, epoch(pushed_at)::DOUBLE AS sort_value
  FROM repos WHERE pushed_at > {_DAY} - 2 AND stars > 0"""
_CREATED_SQL = f"""SELECT full_name, 'created_window' AS strategy, 'age:created_' || {_YEAR} AS stratum, NULL::DOUBLE AS sort_value
  FROM repos WHERE year(created_at) = {_YEAR} AND stars > 2"""
_TOPIC_SQL = f"""SELECT full_name, 'topic' AS strategy, 'topic:' || {_TOPIC} AS stratum, NULL::DOUBLE AS sort_value
  FROM repos WHERE list_contains(topics, {_TOPIC}) AND stars > 1"""
_SIZE_SQL = """SELECT full_name, 'size_bucket' AS strategy, 'repo_size:' || label AS stratum, NULL::DOUBLE AS sort_value
  FROM repos JOIN (VALUES (0, 'size:<500', 0, 499), (1, 'size:500..5000', 500, 5000), (2, 'size:5000..50000', 5000, 50000),
    (3, 'size:>50000', 50001, 1000000000)) b(i, label, lo, hi) ON size_kb BETWEEN lo AND hi AND stars > 0 {0}"""


def _assigned(spark, sf, *strata):
    return S.assign(repositories(spark, sf), [*strata]).select("full_name", "strategy", "stratum")


def _stratum_sql(*selects: str) -> str:
    body = " UNION ALL ".join(f"SELECT full_name, strategy, stratum FROM ({s})" for s in selects)
    return f"WITH {_REPOS_SQL} {body}"


# --- seeds, rotation and plans ------------------------------------------------------

def _order_dates(spark, sf):
    return B.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("run_date")).distinct()


_DATES_SQL = "dates AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS run_date FROM orders)"
_ISO = "strftime(run_date, '%Y-%m-%d')"
_DATE_SEED = _hex8(f"sha256({_ISO} || ':0')")


@query("date_seed", f"WITH {_DATES_SQL} SELECT {_ISO} AS run_date, {_DATE_SEED} AS seed FROM dates")
def date_seed(spark, sf):
    return _order_dates(spark, sf).select("run_date", S.date_seed(F.col("run_date")).alias("seed"))


@query(
    "rotation_index",
    f"""WITH {_DATES_SQL} SELECT {_ISO} AS run_date, {_ORDINAL.format('run_date')} % 2 AS star_block,
  {_ORDINAL.format('run_date')} % 14 AS topic_index, {_ORDINAL.format('run_date')} % 4 AS size_index FROM dates""",
)
def rotation_index(spark, sf):
    day = F.col("run_date")
    return _order_dates(spark, sf).select(
        "run_date",
        S.star_block(day).alias("star_block"),
        S.rotation_index(day, 14).alias("topic_index"),
        S.rotation_index(day, 4).alias("size_index"),
    )


@query(
    "sample_plan_day",
    f"""WITH dates AS (SELECT DISTINCT CAST(ts AS DATE) AS run_date FROM events),
  o AS (SELECT run_date, {_ORDINAL.format('run_date')} AS n, {_DATE_SEED} AS seed FROM dates),
  p AS (SELECT run_date, seed, 'star_bucket_' || label AS name, 'stars:' || label AS stratum, 'stars' AS sort
      FROM o JOIN (VALUES ('long_tail', 0), ('small', 0), ('medium', 0), ('popular', 1), ('very_popular', 1), ('head', 1)) b(label, block)
        ON block = n % 2
    UNION ALL SELECT run_date, seed, 'recent_push', 'activity:recent_push', 'updated' FROM o
    UNION ALL SELECT run_date, seed, 'created_window', 'age:created_' || (2015 + n % (year(run_date) - 2014)), 'best_match' FROM o
    UNION ALL SELECT run_date, seed, 'topic', 'topic:' || {_TOPICS}[(n % 14)::INT + 1], 'best_match' FROM o
    UNION ALL SELECT run_date, seed, 'size_bucket', 'repo_size:' ||
      ['size:<500', 'size:500..5000', 'size:5000..50000', 'size:>50000'][(n % 4)::INT + 1], 'best_match' FROM o)
  SELECT {_ISO} AS run_date, seed, name, stratum, sort, md5(seed || ':' || name) AS served_by FROM p""",
)
def sample_plan_day(spark, sf):
    days = B.table(spark, sf, "events").select(F.to_date("ts").alias("run_date")).distinct()
    return S.plan_rows(days)


_COHORT_TOPIC = f"{_TOPICS}[((2 * cohort_year + {{0}}) % 14)::INT + 1]"


@query(
    "cohort_plan",
    f"""WITH y AS (SELECT DISTINCT year(o_orderdate) AS cohort_year FROM orders),
  s AS (SELECT *, make_date(cohort_year, 1, 1) AS run_date FROM y),
  o AS (SELECT *, {_DATE_SEED} AS seed FROM s),
  p AS (SELECT run_date, seed, 'cohort_star_' || label AS name, 'stars:' || label AS stratum
      FROM o CROSS JOIN (VALUES ('notable'), ('mid'), ('long_tail')) b(label)
    UNION ALL SELECT run_date, seed, 'cohort_topic_0', 'topic:' || {_COHORT_TOPIC.format(0)} FROM o
    UNION ALL SELECT run_date, seed, 'cohort_topic_1', 'topic:' || {_COHORT_TOPIC.format(1)} FROM o)
  SELECT {_ISO} AS run_date, seed, name, stratum, md5(seed || ':' || name) AS served_by FROM p""",
)
def cohort_plan(spark, sf):
    years = B.table(spark, sf, "orders").select(F.year("o_orderdate").alias("cohort_year")).distinct()
    return S.cohort_plan_rows(years)


@query("seeded_order", f"SELECT o_orderkey, md5({_SEED.format(RUN_DATE)} || ':' || o_orderkey) AS seeded_key FROM orders")
def seeded_order(spark, sf):
    seed = S.date_seed(F.lit(RUN_DATE))
    keyed = B.table(spark, sf, "orders").select("o_orderkey", S.seeded_order(seed, F.col("o_orderkey")).alias("seeded_key"))
    return keyed.orderBy("seeded_key", "o_orderkey")


# --- strata ---------------------------------------------------------------------------

@query("stratum_star_buckets", _stratum_sql(_STAR_SQL.format(parity=f"{_DAY_ORDINAL} % 2")))
def stratum_star_buckets(spark, sf):
    return _assigned(spark, sf, *S.star_strata(F.lit(RUN_DATE)))


@query("stratum_star_two_days", _stratum_sql(_STAR_SQL.format(parity="0"), _STAR_SQL.format(parity="1")))
def stratum_star_two_days(spark, sf):
    today = F.lit(RUN_DATE)
    return _assigned(spark, sf, *S.star_strata(today), *S.star_strata(F.date_add(today, 1)))


@query("stratum_recent", _stratum_sql(_RECENT_SQL))
def stratum_recent(spark, sf):
    return _assigned(spark, sf, S.recent_stratum(F.lit(RUN_DATE)))


@query("stratum_created_year", _stratum_sql(_CREATED_SQL))
def stratum_created_year(spark, sf):
    return _assigned(spark, sf, S.created_stratum(F.lit(RUN_DATE)))


@query("stratum_topic", _stratum_sql(_TOPIC_SQL))
def stratum_topic(spark, sf):
    return _assigned(spark, sf, S.topic_stratum(F.lit(RUN_DATE)))


@query("stratum_size", _stratum_sql(_SIZE_SQL.format("")))
def stratum_size(spark, sf):
    """Four days in a row draw from every size range; 5000 KB lies in two."""
    today = F.lit(RUN_DATE)
    return _assigned(spark, sf, *[c for ahead in range(4) for c in S.size_strata(F.date_add(today, ahead))])


_COHORTS_SQL = f"""aged AS (SELECT *, year(created_at) AS cohort_year FROM repos),
cohort_assigned AS (SELECT cohort_year, full_name, 'cohort_star_' || label AS strategy, 'stars:' || label AS stratum, stars::DOUBLE AS sort_value
    FROM aged JOIN (VALUES ('notable', 51, 1000000000), ('mid', 5, 50), ('long_tail', 0, 4)) b(label, lo, hi) ON stars BETWEEN lo AND hi
  UNION ALL SELECT cohort_year, full_name, 'cohort_topic_0', 'topic:' || {_COHORT_TOPIC.format(0)}, NULL FROM aged
    WHERE list_contains(topics, {_COHORT_TOPIC.format(0)})
  UNION ALL SELECT cohort_year, full_name, 'cohort_topic_1', 'topic:' || {_COHORT_TOPIC.format(1)}, NULL FROM aged
    WHERE list_contains(topics, {_COHORT_TOPIC.format(1)}))"""


@query("cohort_strata", f"WITH {_REPOS_SQL}, {_COHORTS_SQL} SELECT cohort_year, full_name, strategy, stratum FROM cohort_assigned")
def cohort_strata(spark, sf):
    repos = repositories(spark, sf).withColumn("cohort_year", F.year(F.to_date("created_at")))
    return S.assign(repos, S.cohort_strata()).select("cohort_year", "full_name", "strategy", "stratum")


# --- window, pool, files, caps -----------------------------------------------------------

def _window_sql(source: str, seed: str, strata: int, by: str = "", cap: int | None = None, quota: S.Quota | None = None) -> str:
    """The rows each stratum gives, and the pool: one row per repository."""
    quota = quota or S.Quota(strata, result_cap=cap)
    drawn = f"md5({seed} || ':' || full_name), full_name"
    group = f"PARTITION BY {by} strategy, stratum"
    if cap is None:
        window = f"""windowed AS (SELECT * FROM (SELECT *, row_number() OVER ({group} ORDER BY {drawn}) AS rank FROM {source})
  WHERE rank <= {quota.per_stratum})"""
    else:
        start = _hex8(f"md5({seed} || ':' || strategy || ':page')")
        window = f"""ranked AS (SELECT *, row_number() OVER ({group} ORDER BY sort_value DESC NULLS LAST, {drawn}) AS rank FROM {source}),
shown AS (SELECT *, max(rank) OVER ({group}) - {quota.per_stratum} AS spare FROM ranked WHERE rank <= {cap}),
windowed AS (SELECT * EXCLUDE (spare, first_rank) FROM
  (SELECT *, CASE WHEN spare > 0 THEN {start} % (spare + 1) ELSE 0 END AS first_rank FROM shown)
  WHERE rank > first_rank AND rank <= first_rank + {quota.per_stratum})"""
    return f"""{window},
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} full_name
    ORDER BY md5({seed} || ':' || strategy), strategy, stratum) AS served FROM windowed) WHERE served = 1)"""


_RUN_SEED = _SEED.format(RUN_DATE)
_ASSIGNED_SQL = f"""WITH {_REPOS_SQL}, assigned AS ({" UNION ALL ".join((
    _STAR_SQL.format(parity=f"{_DAY_ORDINAL} % 2"), _RECENT_SQL, _CREATED_SQL, _TOPIC_SQL, _SIZE_SQL.format(f"AND i = {_DAY_ORDINAL} % 4")))})"""
_DAILY_SQL = f"{_ASSIGNED_SQL}, {_window_sql('assigned', _RUN_SEED, 7)}"
_SHOWN_SQL = f"{_ASSIGNED_SQL}, {_window_sql('assigned', _RUN_SEED, 7, cap=V.RESULT_CAP)}"
_DRAWN_SQL = f"""{_DAILY_SQL}, {_FILES_SQL},
picked AS (SELECT e.*, strategy, stratum, row_number() OVER (PARTITION BY full_name
    ORDER BY md5({_RUN_SEED} || ':' || full_name || ':' || path), path) AS pick FROM eligible e JOIN pool USING (full_name)),
drawn AS (SELECT * FROM picked WHERE pick <= 5 ORDER BY md5({_RUN_SEED} || ':' || full_name), full_name, pick LIMIT 400)"""


def _daily_window(spark, sf, quota=S.DAILY_QUOTA):
    today = F.lit(RUN_DATE)
    assigned = S.assign(repositories(spark, sf), S.daily_strata(today))
    return S.stratum_window(assigned, S.date_seed(today), quota)


@query("stratum_window", f"{_DAILY_SQL} SELECT full_name, strategy, stratum, rank FROM windowed")
def stratum_window(spark, sf):
    return _daily_window(spark, sf).select("full_name", "strategy", "stratum", "rank")


_LARGE = S.Quota(7, 7 * 12_000)  # beyond S.LARGE rows a stratum: by buckets of hashes


@query("stratum_window_large", f"{_ASSIGNED_SQL}, {_window_sql('assigned', _RUN_SEED, 7, quota=_LARGE)} SELECT full_name, strategy, stratum, rank FROM windowed")
def stratum_window_large(spark, sf):
    return _daily_window(spark, sf, _LARGE).select("full_name", "strategy", "stratum", "rank")


@query("stratum_window_shown", f"{_SHOWN_SQL} SELECT full_name, strategy, stratum, rank FROM windowed")
def stratum_window_shown(spark, sf):
    """The same strata as a service shows them that ends after 1000 results."""
    quota = S.Quota(strata=7, result_cap=V.RESULT_CAP)
    return _daily_window(spark, sf, quota).select("full_name", "strategy", "stratum", "rank")


@query("dedup_pool", f"{_DAILY_SQL} SELECT full_name, strategy, stratum FROM pool")
def dedup_pool(spark, sf):
    pool = S.dedup_pool(_daily_window(spark, sf), S.date_seed(F.lit(RUN_DATE)))
    return pool.select("full_name", "strategy", "stratum")


@query("filter_files", f"WITH {_FILES_SQL} SELECT full_name, type, path, size FROM eligible")
def filter_files(spark, sf):
    return S.eligible_files(repository_files(spark, sf)).drop("o_orderdate")


_KEY = f"md5({_RUN_SEED} || ':' || full_name || ':' || path)"


@query(
    "cap_per_group",
    f"""WITH {_FILES_SQL} SELECT full_name, path, pick FROM (SELECT full_name, path,
  row_number() OVER (PARTITION BY full_name ORDER BY {_KEY}, path) AS pick FROM files) WHERE pick <= 5""",
)
def cap_per_group(spark, sf):
    key = S.seeded_order(S.date_seed(F.lit(RUN_DATE)), F.col("full_name"), F.col("path"))
    rows = repository_files(spark, sf).select("full_name", "path")
    return S.cap_per_group(rows, ["full_name"], [key, F.col("path")])


@query(
    "cap_total",
    f"WITH {_FILES_SQL} SELECT full_name, path, size FROM eligible ORDER BY md5({_RUN_SEED} || ':' || full_name), full_name, {_KEY}, path LIMIT 400",
)
def cap_total(spark, sf):
    seed = S.date_seed(F.lit(RUN_DATE))
    order = [S.seeded_order(seed, F.col("full_name")), F.col("full_name"), S.seeded_order(seed, F.col("full_name"), F.col("path")), F.col("path")]
    return S.cap_total(S.eligible_files(repository_files(spark, sf)).select("full_name", "path", "size"), order)


@query(
    "cap_total_large",
    f"WITH {_FILES_SQL} SELECT full_name, path, size FROM eligible ORDER BY md5({_RUN_SEED} || ':' || full_name), full_name, {_KEY}, path LIMIT 12000",
)
def cap_total_large(spark, sf):
    """A target beyond what one task may rank."""
    seed = S.date_seed(F.lit(RUN_DATE))
    order = [S.seeded_order(seed, F.col("full_name")), F.col("full_name"), S.seeded_order(seed, F.col("full_name"), F.col("path")), F.col("path")]
    return S.cap_total(S.eligible_files(repository_files(spark, sf)).select("full_name", "path", "size"), order, 12_000)


@query("sample_day", f"{_DRAWN_SQL} SELECT full_name, path, size, strategy, stratum, pick FROM drawn")
def sample_day(spark, sf):
    _, drawn = S.sample_day(repositories(spark, sf), repository_files(spark, sf), RUN_DATE)
    return drawn.select("full_name", "path", "size", "strategy", "stratum", "pick")


_READ = "CASE WHEN size < 3500000 THEN path END"


@query(
    "run_accounting",
    f"""{_DRAWN_SQL} SELECT '{RUN_DATE.isoformat()}' AS run_date, (SELECT count(*) FROM pool) AS repos_considered,
  count(DISTINCT full_name) AS repos_with_notebooks, count({_READ}) AS notebooks_collected, count(*) - count({_READ}) AS errors,
  (SELECT count(*) FROM documents_listed JOIN pool USING (full_name)) - count(*) AS documents_left_out FROM drawn""",
)
def run_accounting(spark, sf):
    pool = S.day_pool(repositories(spark, sf), RUN_DATE).withColumn("run_date", F.lit(RUN_DATE))
    listed = S.pooled_files(pool, repository_files(spark, sf))
    drawn = S.draw_files(listed, S.date_seed(F.lit(RUN_DATE)))
    read = drawn.withColumn("raw", F.when(F.col("size") < 3500000, F.col("path")))
    return S.accounting(spark.range(1).select(F.lit(RUN_DATE).alias("run_date")), pool, listed, read)


_CONTENT = "o_totalprice >= 20000"


@query(
    "run_day_counts",
    f"""{_DRAWN_SQL}, read AS (SELECT {_CONTENT} AS found, year(o_orderdate) < 1999 AS whole
    FROM drawn JOIN orders ON path = 'nb/' || o_orderkey || '.ipynb')
  SELECT '{RUN_DATE.isoformat()}' AS run_date, count(*) FILTER (found) AS notebooks_collected,
  count(*) FILTER (found AND whole) AS notebooks_parsed, (SELECT count(*) FROM pool) AS repos_sampled,
  count(*) FILTER (NOT found) AS errors,
  (SELECT count(*) FROM documents_listed JOIN pool USING (full_name)) - count(*) AS documents_left_out FROM read""",
)
def run_day_counts(spark, sf):
    """A whole daily run: some contents cannot be found, some are cut off."""
    from tallyfold.plans import census
    from tallyfold.session import scratch_folder

    cut_off = F.when(F.year("o_orderdate") < 1999, F.lit('{"nbformat":4,"cells":[]}')).otherwise(F.lit('{"cells":['))
    files = repository_files(spark, sf)
    contents = files.where(F.col("size") >= 200000).select("full_name", "path", cut_off.alias("raw"))
    report = census.run_day(spark, repositories(spark, sf), files, contents, scratch_folder(spark, "run"), RUN_DATE)
    return report.select("run_date", "notebooks_collected", "notebooks_parsed", "repos_sampled", "errors", "documents_left_out")


_BACKFILL = (2012, 2026)


@query(
    "run_backfill_counts",
    f"""WITH {_REPOS_SQL}, {_COHORTS_SQL}, seeded AS (SELECT *, {_hex8("sha256(cohort_year || '-01-01:0')")} AS seed FROM cohort_assigned
    WHERE cohort_year BETWEEN {_BACKFILL[0]} AND {_BACKFILL[1]}), {_window_sql("seeded", "seed", 5, "cohort_year,")}, {_FILES_SQL},
  picked AS (SELECT e.full_name, path, cohort_year, seed, row_number() OVER (PARTITION BY cohort_year, full_name
      ORDER BY md5(seed || ':' || full_name || ':' || path), path) AS pick FROM eligible e JOIN pool USING (full_name)),
  ordered AS (SELECT *, row_number() OVER (PARTITION BY cohort_year ORDER BY md5(seed || ':' || full_name), full_name, pick) AS draw FROM picked WHERE pick <= 5),
  read AS (SELECT cohort_year, {_CONTENT} AS found, year(o_orderdate) < 1999 AS whole FROM ordered JOIN orders ON path = 'nb/' || o_orderkey || '.ipynb' WHERE draw <= 400),
  counts AS (SELECT cohort_year, count(*) FILTER (found) AS collected, count(*) FILTER (found AND whole) AS parsed, count(*) FILTER (NOT found) AS errors, count(*) AS drawn FROM read GROUP BY 1),
  considered AS (SELECT cohort_year, count(*) AS repos FROM pool GROUP BY 1),
  listed AS (SELECT cohort_year, count(*) AS files FROM documents_listed JOIN pool USING (full_name) GROUP BY 1)
  SELECT y || '-01-01' AS run_date, coalesce(collected, 0) AS notebooks_collected, coalesce(parsed, 0) AS notebooks_parsed, coalesce(repos, 0) AS repos_sampled,
    coalesce(errors, 0) AS errors, coalesce(files, 0) - coalesce(drawn, 0) AS documents_left_out, 5::BIGINT AS strata, 10::BIGINT AS top_libraries
  FROM range({_BACKFILL[0]}, {_BACKFILL[1] + 1}) t(y) LEFT JOIN counts c ON c.cohort_year = y LEFT JOIN considered p ON p.cohort_year = y LEFT JOIN listed l ON l.cohort_year = y""",
)
def run_backfill_counts(spark, sf):
    """All creation-year cohorts in one job, with its report: a row for each year, years without repositories included."""
    from tallyfold.plans import census
    from tallyfold.session import scratch_folder

    cut_off = F.when(F.year("o_orderdate") < 1999, F.lit('{"nbformat":4,"cells":[]}')).otherwise(F.lit('{"cells":['))
    files = repository_files(spark, sf)
    contents = files.where(F.col("size") >= 200000).select("full_name", "path", cut_off.alias("raw"))
    report = census.run_backfill(spark, repositories(spark, sf), files, contents, scratch_folder(spark, "backfill"), *_BACKFILL)
    counts = ("notebooks_collected", "notebooks_parsed", "repos_sampled", "errors", "documents_left_out")
    return report.select("run_date", *counts, *[F.size(c).cast("bigint").alias(c) for c in ("strata", "top_libraries")])


@query(
    "strata_described",
    _stratum_sql(_STAR_SQL.format(parity="0"), _STAR_SQL.format(parity="1")).replace("WITH", "WITH strata AS (WITH", 1)
    + ") SELECT strategy, stratum, count(*) AS repos FROM strata GROUP BY ALL",
)
def strata_described(spark, sf):
    today = F.lit(RUN_DATE)
    strata = [*S.star_strata(today), *S.star_strata(F.date_add(today, 1))]
    return S.describe(S.assign(repositories(spark, sf), strata))


_COHORT_SEED = _hex8("sha256(cohort_year || '-01-01:0')")


@query(
    "backfill_cohorts",
    f"""WITH {_REPOS_SQL}, {_COHORTS_SQL}, seeded AS (SELECT *, {_COHORT_SEED} AS seed FROM cohort_assigned WHERE cohort_year >= 2013),
  {_window_sql("seeded", "seed", 5, "cohort_year,")}, {_FILES_SQL},
  picked AS (SELECT e.full_name, path, size, cohort_year, seed, strategy, stratum, row_number() OVER (PARTITION BY cohort_year, full_name
      ORDER BY md5(seed || ':' || full_name || ':' || path), path) AS pick FROM eligible e JOIN pool USING (full_name)),
  ordered AS (SELECT *, row_number() OVER (PARTITION BY cohort_year ORDER BY md5(seed || ':' || full_name), full_name, pick) AS draw
      FROM picked WHERE pick <= 5)
  SELECT cohort_year, full_name, path, strategy, stratum, draw FROM ordered WHERE draw <= 400""",
)
def backfill_cohorts(spark, sf):
    _, drawn = S.sample_cohorts(repositories(spark, sf), repository_files(spark, sf), end_year=2030)
    rows = drawn.select("cohort_year", "full_name", "path", "strategy", "stratum", "draw")
    return rows.orderBy(F.desc("cohort_year"), "draw")

"""Sources, sinks, views and set operations over the test tables.

Queries that store something write a new folder under the shared checkpoint
root and return what a reader finds there afterwards.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.checks import bindings as B
from tallyfold.checks.aggregation import _ADOPTION, DAY, EV, HI
from tallyfold.checks.registry import query
from tallyfold.operators import aggregate as A
from tallyfold.operators import detect
from tallyfold.session import scratch_folder
from tallyfold.sources import landed, readers, sinks, views

def stored_events(spark, sf: str) -> str:
    """All event observations as date partitions; the last ten days are written
    by a later run with one more column."""
    rows = B.event_observations(spark, sf)
    late = F.col("run_date") >= F.lit(date(2024, 1, 21))

    def write(path: str) -> None:
        sinks.write_dates(rows.where(~late), path)
        sinks.write_dates(rows.where(late).withColumn("note", F.concat(F.lit("late "), F.col("event_type"))), path)

    return B.stored_once(spark, sf, "events", write)


def stored_census(spark, sf: str) -> str:
    """A census root: observations, snapshot history and adoption history."""

    def write(root: str) -> None:
        snapshots, adoption = B.history_tables(spark, sf)
        sinks.write_dates(B.event_observations(spark, sf), f"{root}/observations")
        sinks.write_dates(snapshots, f"{root}/daily_snapshots")
        sinks.write_dates(adoption, f"{root}/library_adoption")

    return B.stored_once(spark, sf, "census", write)


# --- sources --------------------------------------------------------------------

@query(
    "src_raw_documents",
    """SELECT doc_id, length(raw) AS chars, md5(raw) AS digest FROM
  (SELECT doc_id, CASE WHEN lang = 'fr' THEN text || chr(65533) ELSE text END AS raw FROM documents)""",
)
def src_raw_documents(spark, sf):
    stray = F.when(F.col("lang") == "fr", F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))
    landed = B.table(spark, sf, "documents").select("doc_id", F.concat(F.encode("text", "UTF-8"), stray).alias("content"))
    raw = landed.select("doc_id", readers.valid_text(F.col("content")).alias("raw"))
    return raw.select("doc_id", F.length("raw").alias("chars"), F.md5("raw").alias("digest"))


def landed_tree(spark, sf: str) -> str:
    """``documents`` as files, French ones with a stray byte at the end; the file of the first document is not there."""

    def write(root: str) -> None:
        docs = B.many_files(spark, sf, "documents")
        first = docs.agg(F.min("doc_id").alias("doc_id"))
        stray = F.when(F.col("lang") == "fr", F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))
        files = docs.select(*landed_name(), F.concat(F.encode("text", "UTF-8"), stray).alias("content"), "doc_id")
        landed.write_files(files.join(F.broadcast(first), "doc_id", "left_anti"), root)

    return B.stored_once(spark, sf, "landed-tree", write)


def landed_name() -> list:
    return [F.concat(F.lit("owner/"), "source").alias("full_name"), F.concat(F.col("lang"), F.lit("/"), F.col("doc_id"), F.lit(".ipynb")).alias("path")]


@query(
    "src_landed_files",
    """SELECT doc_id, full_name, octet_length(encode(raw)) - 2 * (lang = 'fr')::INT AS size_bytes, length(raw) AS chars, md5(raw) AS digest, 'read' AS state FROM
  (SELECT *, 'owner/' || source AS full_name, CASE WHEN lang = 'fr' THEN text || chr(65533) ELSE text END AS raw FROM documents WHERE doc_id > (SELECT min(doc_id) FROM documents))
  UNION ALL SELECT doc_id, 'owner/' || source, 0, 0, '', 'FileNotFoundError' FROM documents WHERE doc_id = (SELECT min(doc_id) FROM documents)""",
)
def src_landed_files(spark, sf):
    root = landed_tree(spark, sf)
    batches = scratch_folder(spark, "landed-batches")
    listing = B.table(spark, sf, "documents").select(*landed_name(), F.col("n_chars").alias("size"))
    landed.store_batches(listing, batches, batch_bytes=1 << 20)
    rows = landed.documents(spark, batches, root)
    return rows.select(
        F.regexp_extract("path", "([0-9]+)[.]ipynb$", 1).cast("bigint").alias("doc_id"),
        "full_name",
        F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"),
        F.coalesce(F.length("raw"), F.lit(0)).cast("bigint").alias("chars"),
        F.coalesce(F.md5("raw"), F.lit("")).alias("digest"),
        F.coalesce("error", F.lit("read")).alias("state"),
    )


@query(
    "src_repos",
    """SELECT c_name AS full_name, CASE WHEN c_nationkey < 5 THEN 'dev' ELSE 'main' END AS default_branch,
  CASE WHEN c_acctbal > 0 THEN floor(c_acctbal)::BIGINT ELSE 0 END AS stars,
  CASE WHEN c_nationkey > 20 THEN 0 ELSE c_custkey END AS size_kb, '' AS created_at, c_mktsegment AS pushed_at,
  CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment || ';repo' END AS topics FROM customer""",
)
def src_repos(spark, sf):
    c = B.table(spark, sf, "customer")
    nation = F.col("c_nationkey")
    landed = c.select(
        F.to_json(
            F.struct(
                F.col("c_name").alias("full_name"),
                F.when(nation < 5, "dev").alias("default_branch"),
                F.when(F.col("c_acctbal") > 0, F.floor("c_acctbal")).alias("stargazers_count"),
                F.when(nation <= 20, F.col("c_custkey")).alias("size"),
                F.col("c_mktsegment").alias("pushed_at"),
                F.when(F.col("c_mktsegment") != "BUILDING", F.array("c_mktsegment", F.lit("repo"))).alias("topics"),
            )
        ).alias("value")
    )
    return readers.with_repo_defaults(landed.select(F.from_json("value", readers.REPOS).alias("r")).select("r.*"))


@query(
    "src_repo_files",
    """SELECT 'repo/' || o_custkey AS full_name, 'blob' AS type, 'n/' || o_orderkey || '.ipynb' AS path,
  floor(o_totalprice)::BIGINT AS size FROM orders
  UNION ALL SELECT 'repo/' || o_custkey, 'tree', 'n', 0 FROM orders
  UNION ALL SELECT 'repo/' || o_custkey, '', o_orderpriority, 0 FROM orders""",
)
def src_repo_files(spark, sf):
    entry = "struct<type:string,path:string,size:bigint>"
    path = F.concat(F.lit("n/"), F.col("o_orderkey"), F.lit(".ipynb"))
    none = F.lit(None)
    tree = F.array(
        F.struct(F.lit("blob").alias("type"), path.alias("path"), F.floor("o_totalprice").alias("size")).cast(entry),
        F.struct(F.lit("tree").alias("type"), F.lit("n").alias("path"), none.alias("size")).cast(entry),
        F.struct(none.alias("type"), F.col("o_orderpriority").alias("path"), none.alias("size")).cast(entry),
    )
    listing = F.to_json(F.struct(F.concat(F.lit("repo/"), F.col("o_custkey")).alias("full_name"), tree.alias("tree")))
    landed = B.table(spark, sf, "orders").select(F.from_json(listing, readers.LISTINGS).alias("r"))
    return readers.flat_listing(landed.select("r.*"))


def part_registry(spark, sf) -> DataFrame:
    """``part`` as a registry: brands are libraries, words of names modules."""
    return B.table(spark, sf, "part").select(
        F.col("p_brand").alias("library"),
        F.split("p_name", " ").alias("modules"),
        F.when(F.col("p_type") != "PROMO", F.col("p_type")).alias("category"),
        F.concat(F.lit("sup-"), F.col("p_size")).alias("pypi"),
    )


@query(
    "registry_modules",
    """SELECT p_brand AS library, unnest(string_split(p_name, ' ')) AS module,
  CASE WHEN p_type <> 'PROMO' THEN p_type ELSE 'other' END AS category, 'sup-' || p_size AS pypi FROM part""",
)
def registry_modules(spark, sf):
    return detect.module_rows(part_registry(spark, sf))


@query(
    "registry_categories",
    "SELECT DISTINCT p_brand AS library, CASE WHEN p_type <> 'PROMO' THEN p_type ELSE 'other' END AS category FROM part",
)
def registry_categories(spark, sf):
    return detect.module_rows(part_registry(spark, sf)).select("library", "category").distinct()


@query(
    "enrich_registry",
    """SELECT p_partkey, p_brand AS library, 'sup-' || p_partkey AS pypi, s_suppkey || '.' || s_nationkey AS version,
  CASE WHEN s_acctbal > 0 THEN s_name END AS summary, NULL::VARCHAR AS requires_python,
  CASE WHEN s_suppkey IS NOT NULL THEN CASE WHEN s_acctbal > 0 THEN 2 ELSE 1 END END AS release_count
  FROM part LEFT JOIN supplier ON s_suppkey = p_partkey""",
    optional=("release_count",),
)
def enrich_registry(spark, sf):
    s = B.table(spark, sf, "supplier")
    version = F.concat_ws(".", "s_suppkey", "s_nationkey")
    releases = F.when(F.col("s_acctbal") > 0, F.create_map(version, F.lit("f"), F.lit("0"), F.lit("f")))
    landed = s.select(
        F.to_json(
            F.struct(
                F.struct(
                    F.concat(F.lit("sup-"), F.col("s_suppkey")).alias("name"),
                    version.alias("version"),
                    F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("summary"),
                ).alias("info"),
                F.coalesce(releases, F.create_map(version, F.lit("f"))).alias("releases"),
            )
        ).alias("value")
    )
    packages = readers.package_rows(landed.select(F.from_json("value", readers.PACKAGES).alias("p")).select("p.*"))
    parts = B.table(spark, sf, "part").select(
        "p_partkey", F.col("p_brand").alias("library"), F.concat(F.lit("sup-"), F.col("p_partkey")).alias("pypi")
    )
    return readers.enrich(parts, packages)


_NOTE = "CASE WHEN run_date >= DATE '2024-01-21' THEN 'late ' || event_type END AS note"


@query(
    "read_one_day",
    f"{EV} SELECT {DAY}, event_id, event_type, value, {_NOTE} FROM obs WHERE run_date = DATE '2024-01-15'",
)
def read_one_day(spark, sf):
    schema = B.event_observations(spark, sf).withColumn("note", F.lit("")).schema
    rows = readers.observations(spark, stored_events(spark, sf), date(2024, 1, 15), schema)
    return rows.select("run_date", "event_id", "event_type", "value", "note")


@query("read_all_days", f"{EV} SELECT {DAY}, event_id, event_type, value, {_NOTE} FROM obs")
def read_all_days(spark, sf):
    rows = readers.observations(spark, stored_events(spark, sf))
    return rows.select("run_date", "event_id", "event_type", "value", "note")


@query("view_observations", f"{EV} SELECT {DAY}, count(*) AS n, true AS in_partition FROM obs GROUP BY ALL")
def view_observations(spark, sf):
    views.register_views(spark, stored_census(spark, sf))
    return views.query(
        spark,
        """SELECT run_date, count(*) AS n, bool_and(contains(filename, concat('date=', run_date))) AS in_partition
        FROM observations GROUP BY run_date""",
    )


@query("view_adoption", f"{HI} SELECT {_ADOPTION.replace('run_date', DAY, 1)} FROM adoption")
def view_adoption(spark, sf):
    views.register_views(spark, stored_census(spark, sf))
    return views.query(spark, f"SELECT {_ADOPTION} FROM library_adoption")


@query(
    "sql_mean_by_day",
    f"{EV} SELECT {DAY}, count(*) AS n, round(sum(round(value * 100)::BIGINT)::DOUBLE / count(*)) / 100e0 AS mean_value FROM obs GROUP BY ALL",
)
def sql_mean_by_day(spark, sf):
    views.register_views(spark, stored_census(spark, sf))
    return views.query(
        spark,
        """SELECT run_date, count(*) AS n,
        round(cast(sum(cast(round(value * 100) AS bigint)) AS double) / count(*)) / 100e0 AS mean_value
        FROM observations GROUP BY run_date""",
    )


@query(
    "sql_top10",
    f"""{HI} SELECT {DAY}, library, adoption_pct FROM adoption ORDER BY adoption_pct DESC, run_date, library LIMIT 10""",
)
def sql_top10(spark, sf):
    views.register_views(spark, stored_census(spark, sf))
    return views.query(
        spark,
        "SELECT run_date, library, adoption_pct FROM library_adoption ORDER BY adoption_pct DESC, run_date, library LIMIT 10",
    )


# --- sinks ----------------------------------------------------------------------

@query(
    "sink_idempotent_days",
    f"""{EV} SELECT {DAY}, event_id, CASE WHEN run_date >= DATE '2024-01-21' THEN value * 2 ELSE value END AS value FROM obs""",
)
def sink_idempotent_days(spark, sf):
    rows = B.event_observations(spark, sf).select("run_date", "event_id", "value")
    again = rows.where(F.col("run_date") >= F.lit(date(2024, 1, 21))).withColumn("value", F.col("value") * 2)
    root = scratch_folder(spark, "idempotent")
    sinks.write_dates(rows, root)
    sinks.write_dates(again, root)
    sinks.write_dates(again, root)
    return readers.stored(spark, root).select("run_date", "event_id", "value")


_LATER = "run_date >= DATE '2024-01-25'"


@query(
    "upsert_by_date",
    f"""{EV} SELECT {DAY}, event_id, CASE WHEN {_LATER} THEN value + 1 ELSE value END AS value,
  CASE WHEN {_LATER} THEN event_type END AS note FROM obs""",
)
def upsert_by_date(spark, sf):
    rows = B.event_observations(spark, sf)
    new = rows.where(F.col("run_date") >= F.lit(date(2024, 1, 25)))
    new = new.select("run_date", "event_id", (F.col("value") + 1).alias("value"), F.col("event_type").alias("note"))
    return sinks.upsert(rows.select("run_date", "event_id", "value"), new)


@query(
    "union_by_name",
    f"""{EV} SELECT {DAY}, event_id, event_type, NULL::INT AS k FROM obs WHERE run_date < DATE '2024-01-16'
  UNION ALL SELECT {DAY}, event_id, NULL, k FROM obs WHERE run_date >= DATE '2024-01-16'""",
    optional=("k",),
)
def union_by_name(spark, sf):
    rows = B.event_observations(spark, sf)
    early = F.col("run_date") < F.lit(date(2024, 1, 16))
    old = rows.where(early).select("run_date", "event_id", "event_type")
    return old.unionByName(rows.where(~early).select("k", "event_id", "run_date"), allowMissingColumns=True)


@query("csv_mirror", f"{HI} SELECT {_ADOPTION.replace('run_date', DAY, 1)} FROM adoption")
def csv_mirror(spark, sf):
    root = scratch_folder(spark, "csv")
    sinks.write_csv(B.history_tables(spark, sf)[1], root)
    schema = "run_date date, collection_type string, library string, category string, notebook_count bigint, adoption_pct double"
    return spark.read.schema(schema).option("header", "true").csv(root)


@query(
    "run_report",
    f"""{EV}, d AS (SELECT * FROM event_days WHERE run_date = (SELECT max(run_date) FROM event_days)),
  o AS (SELECT * FROM obs WHERE run_date = (SELECT max(run_date) FROM event_days)),
  top AS (SELECT * FROM event_adoption WHERE run_date = (SELECT max(run_date) FROM event_days) ORDER BY adoption_pct DESC, library LIMIT 10)
  SELECT {DAY}, collected AS notebooks_collected, parsed AS notebooks_parsed, (SELECT count(DISTINCT repo_full_name) FROM o) AS repos_sampled,
  (SELECT string_agg(s, ';' ORDER BY s) FROM (SELECT DISTINCT stratum AS s FROM o)) AS strata,
  (SELECT string_agg(library, ';' ORDER BY adoption_pct DESC, library DESC) FROM top) AS top_libraries,
  collected AS notebooks_read, 0::BIGINT AS errors, 0::BIGINT AS documents_left_out FROM d""",
)
def run_report(spark, sf):
    from tallyfold.operators.sampling import accounting
    from tallyfold.operators.trends import latest_rows
    from tallyfold.plans.census import run_report, with_strata

    rows = latest_rows(B.event_observations(spark, sf))
    snapshot = rows.groupBy("run_date").agg(*A.volume())
    adoption = A.library_adoption(rows, B.EVENT_CATEGORIES)
    drawn = rows.select("run_date", F.col("repo_full_name").alias("full_name"), F.col("event_type").alias("raw"))
    report = run_report(snapshot, adoption, accounting(snapshot, drawn, drawn, drawn))
    report = with_strata(report, rows.select("run_date", "stratum").distinct())
    return report.withColumn("top_libraries", F.col("top_libraries.library")).select(
        *[c for c in report.columns if c != "client_stats"], F.col("client_stats.notebooks_read").alias("notebooks_read")
    )

"""Loading: GeoJSON files to street, intersection, document and posting tables."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from esquina.operators.address import best_blocks, street_segments
from esquina.operators.crossing import with_code_list
from esquina.operators.names import NameIndex, StreetIndex, name_grams, name_index, name_slices, street_codes
from esquina.operators.search import SearchIndex, search_index
from esquina.sources.geojson import INTERSECTION_SCHEMA, STREET_SCHEMA, read_geojson
from esquina.sources.tables import (
    LoadConfig,
    load_key,
    needs_import,
    street_docs,
    write_docs,
    write_state,
    write_table,
)


@dataclass(frozen=True)
class Store:
    """Where the tables live, below one root path."""

    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(self.path(name))


def load(
    spark: SparkSession,
    streets_path: str,
    intersections_path: str,
    store: Store,
    config: LoadConfig = LoadConfig(),
    layout: str = "collection",
    on_error: str = "skip",
) -> bool:
    """Loads both files unless nothing has changed; tells whether it did.

    Tables: streets, intersections (with code lists), street_docs (JSON lines), names and
    postings for search, the look-up tables of names and house numbers, and the rejected
    features of both files.
    """
    key = load_key(spark, [streets_path, intersections_path], config)
    if not needs_import(spark, key, store.path("state")):
        return False
    options = dict(src=config.src, dst=config.dst, promote=config.promote, layout=layout, on_error=on_error, settled=True)
    streets = read_geojson(spark, streets_path, STREET_SCHEMA, **options)
    crossings = read_geojson(spark, intersections_path, INTERSECTION_SCHEMA, **options)
    for name, rows in (("streets", streets.rows), ("intersections", with_code_list(crossings.rows))):
        write_table(numbered_on(rows, store.path(name)) if config.append else rows, store.path(name), config.append)
    write_table(streets.rejects.unionByName(crossings.rejects), store.path("rejects"), config.append)
    refresh_search(spark, store)
    refresh_names(spark, store, key)
    # Last, so that a load that broke off is done again.
    write_state(spark, key, store.path("state"))
    return True


def numbered_on(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` with ids, which are not negative, behind those of the stored table."""
    try:
        last = rows.sparkSession.read.parquet(path).agg(F.max("id")).first()[0]
    except AnalysisException:
        last = None
    return rows if last is None else rows.withColumn("id", F.col("id") + F.lit(last + 1))


def refresh_search(spark: SparkSession, store: Store) -> None:
    """Rebuilds the search documents and postings from the stored streets."""
    docs = street_docs(store.table(spark, "streets"))
    write_docs(docs, store.path("street_docs"), mode="overwrite")
    index = search_index(docs)
    write_table(index.names, store.path("search_names"))
    write_table(index.postings, store.path("search_postings"))
    write_table(index.documents, store.path("search_documents"))
    write_table(index.blocks, store.path("search_blocks"))
    write_table(index.bounds, store.path("search_bounds"))


def stored_search_index(spark: SparkSession, store: Store) -> SearchIndex:
    return SearchIndex(
        store.table(spark, "search_names"),
        store.table(spark, "search_postings"),
        store.table(spark, "search_documents"),
        store.table(spark, "search_blocks"),
        store.table(spark, "search_bounds"),
    )


# --- stored look-ups ---------------------------------------------------------

# Look-up tables and the columns whose equality they are joined by.
LOOKUPS = {
    "name_slices": ["key"],
    "name_grams": ["gram"],
    "street_codes": ["qcode"],
    "street_blocks": ["code", "even", "level", "block"],
    "street_segments": ["code", "id"],
}


class StaleIndex(Exception):
    """The stored look-ups belong to another load than the stored streets."""


def table_name(store: Store, name: str) -> str:
    return f"esquina_{hashlib.md5(store.root.rstrip('/').encode()).hexdigest()[:16]}_{name}"


def refresh_names(spark: SparkSession, store: Store, key: str, buckets: int | None = None) -> None:
    """Writes the look-up tables, dealt into buckets by their join columns, so that a job does not shuffle them.

    A job keeps the buckets if they are at least as many as its shuffle partitions, which are the default here.
    """
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    streets = store.table(spark, "streets")
    index = name_index(streets)
    tables = {
        "name_slices": name_slices(index.names),
        "name_grams": name_grams(index.names),
        "street_codes": street_codes(streets),
        "street_blocks": best_blocks(streets),
        "street_segments": street_segments(streets),
    }
    write_table(index.names, store.path("names"))
    for name, rows in tables.items():
        spark.sql(f"DROP TABLE IF EXISTS {table_name(store, name)}")
        # One file for each bucket.
        dealt = rows.repartition(count, *LOOKUPS[name])
        writer = dealt.write.mode("overwrite").format("parquet").bucketBy(count, *LOOKUPS[name]).sortBy(*LOOKUPS[name])
        writer.option("path", store.path(name)).saveAsTable(table_name(store, name))
    state = [(key, count, index.size, index.common)]
    described = spark.createDataFrame(state, "key string, buckets int, size long, common array<string>")
    described.write.mode("overwrite").json(store.path("names_state"))


def stored_street_index(spark: SparkSession, store: Store) -> StreetIndex:
    """The stored streets with their look-up tables, for suggestions, addresses, crossings and streams.

    Refused where the tables were not made by the load that made the streets.
    """
    state = spark.read.schema("key string, buckets int, size long, common array<string>").json(store.path("names_state")).first()
    if state is None or needs_import(spark, state["key"], store.path("state")):
        raise StaleIndex(store.root)

    def bucketed(name: str) -> DataFrame:
        """Another session does not know the table yet; its buckets are told anew."""
        if not spark.catalog.tableExists(table_name(store, name)):
            columns = store.table(spark, name).schema.toDDL()
            by = ", ".join(LOOKUPS[name])
            spark.sql(
                f"CREATE TABLE {table_name(store, name)} ({columns}) USING parquet"
                f" CLUSTERED BY ({by}) SORTED BY ({by}) INTO {state['buckets']} BUCKETS LOCATION '{store.path(name)}'"
            )
        return spark.table(table_name(store, name))

    names = NameIndex(store.table(spark, "names"), list(state["common"]), state["size"], bucketed("name_slices"), bucketed("name_grams"))
    return StreetIndex(store.table(spark, "streets"), names, bucketed("street_codes"), bucketed("street_blocks"), bucketed("street_segments"))

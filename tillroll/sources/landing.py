"""Landing: typed CSV -> Parquet layers, and reading the landed tables back.

The CSV options reproduce a PostgreSQL ``COPY ... (FORMAT csv, HEADER)``:
fields may span lines inside quotes, ``""`` is the escaped quote, a quoted
empty field is an empty string and an unquoted empty field is NULL (also for
numbers and timestamps).  Malformed rows fail the load, as a constraint
violation fails a ``COPY``.  Schemas are always given, never inferred.

A file is read by as many tasks as it has blocks, also where quoted fields span
lines (``csvsplit``).  Generated keys come from the places of the records
(``keyledger``).  A whole layer is loaded as one new version (``versions``): readers
see the old tables or the new ones, never a mix.  Landing runs once; every job then
reads the column-pruned, predicate-pushed Parquet.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.model import FOREIGN_KEYS, TABLES
from tillroll.operators import quality as Q
from tillroll.session import ensure_checkpoint_dir
from tillroll.sources.csvsplit import read_csv
from tillroll.sources.keyledger import keyed_csv
from tillroll.sources.versions import commit_version, current_version, folder_of, new_name, write_version

CSV_OPTIONS = {
    "header": "true",
    "multiLine": "true",
    "quote": '"',
    "escape": '"',
    "emptyValue": "",      # quoted "" stays an empty string
    "nullValue": "\\N",    # unquoted empty -> NULL (see module doc)
    "mode": "FAILFAST",
    "encoding": "UTF-8",
}

RAW, ANALYTICS = "raw", "analytics"
# Fixed value: the landing order of the source project (parents before children).
LOAD_ORDER = ("customers", "orders", "products", "order_items", "order_payments",
              "order_reviews", "product_category_translation")


class LandingError(ValueError):
    """The loaded tables break a key; nothing was replaced."""


def _fs(spark: SparkSession, path: str):
    """Hadoop file system and path object of ``path`` (any store Spark can reach)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _replace(spark: SparkSession, staged: str, out: str) -> None:
    """Puts the complete folder ``staged`` in the place of ``out``."""
    fs, new = _fs(spark, staged)
    _, old = _fs(spark, out)
    _, aside = _fs(spark, f"{out}__old-{uuid.uuid4().hex}")
    had = fs.exists(old)
    fs.mkdirs(old.getParent())
    if had and not fs.rename(old, aside):
        raise OSError(f"cannot move {out}")
    if not fs.rename(new, old):
        if had:
            fs.rename(aside, old)
        raise OSError(f"cannot move {staged} to {out}")
    if had:
        fs.delete(aside, True)


def create_layers(spark: SparkSession, root: str) -> dict[str, str]:
    """Creates the ``raw`` (landed) and ``analytics`` (published results) layer directories below ``root``."""
    layers = {layer: f"{root.rstrip('/')}/{layer}" for layer in (RAW, ANALYTICS)}
    for path in layers.values():
        fs, p = _fs(spark, path)
        if not fs.mkdirs(p):
            raise OSError(f"cannot create {path}")
    return layers


def land_csv(spark: SparkSession, path: str | list[str], table: str, multiline: bool = True,
             key_ledger: str | None = None, keys_after: int = 0) -> DataFrame:
    """Read source CSV (file, directory, glob or list of files) with the table's declared schema.

    ``multiline=False`` is for exports known to have no line breaks inside quoted
    fields: Spark's own reader then splits them by lines alone.  ``key_ledger`` names
    the stored ledger of generated keys; without it the keys are 1..N by file path and
    place in the file, as of a first load.  ``keys_after``: keys that are taken beside
    the ledger's.
    """
    t = TABLES[table]
    if not multiline:
        df = spark.read.schema(t.file_schema).options(**{**CSV_OPTIONS, "multiLine": "false"}).csv(path)
        return add_review_keys(df) if table == "order_reviews" else df
    if table == "order_reviews":
        return keyed_csv(spark, path, t.file_schema, CSV_OPTIONS, "review_sk", key_ledger, keys_after)
    return read_csv(spark, path, t.file_schema, CSV_OPTIONS).drop("_file", "_number")


def add_review_keys(reviews: DataFrame, name: str = "review_sk") -> DataFrame:
    """``BIGSERIAL``-style ``review_sk``: dense 1..N by file path, then place in the file.

    ``reviews`` is a scan of files.  A first pass counts the rows of every file block;
    the blocks before a block (in path and offset order) give its first number, and a
    row's place in its block is the distance of its ``monotonically_increasing_id``
    from the block's smallest, because a block is read by one task in order.  The
    review rows themselves are neither shuffled nor checkpointed.  Should the two
    passes have read the files in different splits, the row fails instead of getting
    a wrong number.
    """
    block = [F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start")]
    ensure_checkpoint_dir(reviews.sparkSession)
    # the same columns are read in both passes, so both have the same splits
    rows = reviews.select("*", *block).withColumn("_mid", F.monotonically_increasing_id())
    counts = rows.groupBy("_path", "_start").agg(F.min("_mid").alias("_least"), F.count(F.lit(1)).alias("_n"))
    # one row a file block, not a review
    before = Window.orderBy("_path", "_start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).checkpoint(eager=True)
    place = F.col("_mid") - F.col("_least")
    key = F.when((place >= 0) & (place < F.col("_n")), F.col("_off") + place + 1).otherwise(
        F.raise_error(F.lit("the files were split differently while reviews were numbered")).cast("long"))
    return (rows.join(F.broadcast(blocks), ["_path", "_start"])
            .withColumn(name, key).select(name, *reviews.columns))


# Tables keyed by the order: bucketed on it (same bucket count) they join and
# aggregate by order without any shuffle.
ORDER_KEYED = ("orders", "order_items", "order_payments", "order_reviews")


def _write(df: DataFrame, path: str, partition_by: list[str] | None, sort_within: list[str] | None,
           bucket_by: tuple[str, int] | None) -> None:
    """Writes a new folder; a bucketed one through a catalog entry that is dropped again."""
    if bucket_by:
        df = df.repartition(bucket_by[1], bucket_by[0])         # one file a bucket
    if sort_within:
        df = df.sortWithinPartitions(*sort_within)
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if bucket_by:
        entry = f"landing_{uuid.uuid4().hex}"
        w.bucketBy(bucket_by[1], bucket_by[0]).sortBy(bucket_by[0]).option("path", path).format("parquet").saveAsTable(entry)
        df.sparkSession.sql(f"DROP TABLE {entry}")              # external: the files stay
    else:
        w.parquet(path)


def write_table(df: DataFrame, layer_dir: str, name: str, partition_by: list[str] | None = None,
                sort_within: list[str] | None = None, bucket_by: tuple[str, int] | None = None,
                database: str | None = None) -> str:
    """Idempotent (re)load of one table: the previous version is replaced once the new one is complete.

    ``sort_within`` clusters each output file by a key so Parquet min/max
    statistics can skip row groups for selective filters.  ``bucket_by=(col, n)``
    writes a bucketed table registered as ``database.name`` (external, at the
    layer path; any table is registered where ``database`` is given): Spark then knows the hash layout and plans joins and
    aggregations on ``col`` between tables with the same ``n`` without an
    exchange.
    """
    spark, out = df.sparkSession, f"{layer_dir.rstrip('/')}/{name}"
    staged = f"{out}__new-{uuid.uuid4().hex}"
    _write(df, staged, partition_by, sort_within, bucket_by)
    _replace(spark, staged, out)
    if bucket_by or database:
        register_table(spark, out, database or RAW, name, bucket_by)
    return out


def register_table(spark: SparkSession, path: str, database: str, name: str,
                   bucket_by: tuple[str, int] | None = None) -> None:
    """(Re)registers the external table ``database.name`` at ``path``; an older location is replaced."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    if spark.catalog.tableExists(f"{database}.{name}"):
        if spark.catalog.getTable(f"`{database}`.`{name}`").tableType == "MANAGED":
            raise ValueError(f"{database}.{name} is a managed table; dropping it would delete its files")
        spark.sql(f"DROP TABLE `{database}`.`{name}`")
    if bucket_by:
        # A bucket declaration needs the column list; it is read from the files.
        col, n = bucket_by
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
        spark.sql(f"CREATE TABLE `{database}`.`{name}` ({cols}) USING parquet "
                  f"CLUSTERED BY ({col}) SORTED BY ({col}) INTO {n} BUCKETS LOCATION '{path}'")
    else:
        spark.sql(f"CREATE TABLE `{database}`.`{name}` USING parquet LOCATION '{path}'")


def register_layer(spark: SparkSession, raw_dir: str, database: str = RAW,
                   buckets: int | None = None) -> None:
    """Register landed tables in the catalog (a new session over an existing layer, or a moved one).

    Only metadata is written: the order-keyed tables are declared with the
    bucket layout they were landed with.  Of a versioned layer the current version is
    registered, also under the name that its manifest gives.
    """
    version = current_version(spark, raw_dir)
    named = version.notes.get(f"database:{database}") if version else None
    for t in LOAD_ORDER:
        path = version.tables[t] if version and t in version.tables else f"{raw_dir.rstrip('/')}/{t}"
        for db in filter(None, (database, named)):
            register_table(spark, path, db, t, ("order_id", buckets) if buckets and t in ORDER_KEYED else None)


def broken_keys(tables: dict[str, DataFrame]) -> list[str]:
    """What the tables break of their primary keys, NOT NULL columns and foreign keys."""
    out = []
    for name, t in TABLES.items():
        df = tables[name]
        if not Q.check_unique(df, t.primary_key).isEmpty():
            out.append(f"{name}: {', '.join(t.primary_key)} is not unique")
        columns = [*t.primary_key, *t.not_null]
        out += [f"{name}.{r.column_name} is NULL in {r.null_count} rows"
                for r in Q.check_not_null(df, columns, name).where("null_count > 0").collect()]
    for fk in FOREIGN_KEYS:
        if not Q.check_foreign_key(tables[fk.child], fk.columns, tables[fk.parent], fk.parent_columns).isEmpty():
            out.append(f"{fk.child}.{', '.join(fk.columns)} has values missing from {fk.parent}")
    return out


def key_ledger(raw_dir: str, table: str) -> str:
    """Where a layer keeps the ledger of the generated keys of ``table``."""
    return f"{raw_dir.rstrip('/')}/_keys/{table}"


def _version_database(database: str, version: str) -> str:
    return f"{database}__{version}"


def land_all(spark: SparkSession, csv_dir: str, raw_dir: str,
             file_names: dict[str, str] | None = None, buckets: int | None = None,
             database: str = RAW, multiline: bool = True, check_keys: bool = True, keep_keys: bool = False) -> dict[str, str]:
    """Land every source CSV of ``csv_dir`` as one new version of the layer ``raw_dir``.

    All tables are written into the version's own folders; with ``check_keys`` their keys
    are checked there.  One manifest then publishes all seven together, so a load that is
    stopped before - or that breaks a key and raises ``LandingError`` - leaves every table
    of the older version as it was.  With ``buckets`` the order-keyed tables are bucketed
    by ``order_id`` and registered in a database of the version's own, which the manifest
    names; ``database`` itself is pointed at the new files afterwards, for plain SQL.
    With ``keep_keys`` review files that the layer's key ledger knows keep their keys;
    without it every load numbers its reviews from 1.
    """
    names = {t: TABLES[t].csv_file for t in LOAD_ORDER}
    names.update(file_names or {})
    raw_dir = raw_dir.rstrip("/")
    bucket = {t: ("order_id", buckets) if buckets and t in ORDER_KEYED else None for t in LOAD_ORDER}
    version = new_name()
    paths = {t: folder_of(raw_dir, version, t) for t in LOAD_ORDER}
    for t in LOAD_ORDER:
        df = land_csv(spark, f"{csv_dir.rstrip('/')}/{names[t]}", t, multiline, key_ledger(raw_dir, t) if keep_keys else None)
        _write(df, paths[t], None, None, bucket[t])
    broken = broken_keys({t: spark.read.parquet(paths[t]) for t in LOAD_ORDER}) if check_keys else []
    if broken:
        fs, p = _fs(spark, paths[LOAD_ORDER[0]])
        fs.delete(p.getParent(), True)
        raise LandingError("; ".join(broken))
    notes = {}
    if buckets:
        own = _version_database(database, version)
        for t in LOAD_ORDER:
            register_table(spark, paths[t], own, t, bucket[t])
        notes[f"database:{database}"] = own
    commit_version(spark, raw_dir, version, paths, notes=notes)
    if buckets:
        for t in LOAD_ORDER:
            register_table(spark, paths[t], database, t, bucket[t])
    return paths


def publish(df: DataFrame, analytics_dir: str, name: str) -> str:
    """Hand a job result to clients: a new version of the ``analytics`` layer with this table; its folder.

    Clients read the (small) Parquet result instead of pulling rows through a
    database connection; converting to pandas is left to them.
    """
    return publish_all(analytics_dir, {name: df})[name]


def publish_all(analytics_dir: str, results: dict[str, DataFrame]) -> dict[str, str]:
    """Several results that belong together, published at once; table -> folder."""
    version = write_version(analytics_dir, results)
    return {name: version.tables[name] for name in results}


def published(spark: SparkSession, analytics_dir: str, name: str) -> DataFrame:
    """The current version of a published result."""
    version = current_version(spark, analytics_dir)
    if version is None or name not in version.tables:
        raise LookupError(f"{name} is not published in {analytics_dir}")
    return spark.read.parquet(version.tables[name])


@dataclass
class ParquetShop:
    """Canonical frames over a landed ``raw`` layer (same interface as ``TestShop``).

    All tables are of the version that was current when the shop was made, whatever is
    loaded meanwhile; tables that no version names are read from their plain folder.
    With ``database`` the tables are read through the catalog, which carries
    the bucket layout of the order-keyed tables; otherwise straight from the
    layer directory.
    """

    spark: SparkSession
    raw_dir: str
    database: str | None = None

    def __post_init__(self) -> None:
        self._pinned = current_version(self.spark, self.raw_dir)

    def refresh(self) -> ParquetShop:
        """A shop over what is current now; this one goes on with its version."""
        return ParquetShop(self.spark, self.raw_dir, self.database)

    def _t(self, name: str) -> DataFrame:
        pinned = self._pinned
        if self.database:                       # an unregistered table is an error, not another read path
            database = pinned.notes.get(f"database:{self.database}", self.database) if pinned else self.database
            df = self.spark.table(f"`{database}`.`{name}`")
        else:
            df = self.spark.read.parquet(pinned.tables[name] if pinned and name in pinned.tables
                                         else f"{self.raw_dir.rstrip('/')}/{name}")
        # Tables landed by the streaming loader carry their micro-batch number.
        return df.drop("_batch") if "_batch" in df.columns else df

    def customers(self, geo: bool = True) -> DataFrame:
        return self._t("customers")

    def orders(self, delivery: bool = True) -> DataFrame:
        return self._t("orders")

    def products(self) -> DataFrame:
        return self._t("products")

    def order_items(self) -> DataFrame:
        return self._t("order_items")

    def order_payments(self) -> DataFrame:
        return self._t("order_payments")

    def order_reviews(self) -> DataFrame:
        return self._t("order_reviews")

    def translation(self) -> DataFrame:
        return self._t("product_category_translation")

    def all_tables(self) -> dict[str, DataFrame]:
        return {t: self._t(t) for t in LOAD_ORDER}

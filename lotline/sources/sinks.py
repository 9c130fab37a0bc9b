"""Sinks: parquet / CSV / JSON reports, metric-file merges, truncate-and-reload
tables, the portfolio CSV and a batch change feed (survey 2.1)."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


POINTER = "current"  # no underscore: readers leave such files out


def _hadoop(spark, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish_parquet(df: DataFrame, base: str, keep: int = 2) -> str:
    """Write ``df`` as a new version of the table folder ``base`` and publish it.

    The version is written beside the older ones; then a pointer file that names it takes the
    place of the old pointer by one rename, which the file system makes whole or not at
    all. Readers see the old table or the new one. A writer that dies before leaves a
    folder that no pointer names; the next one to publish deletes it. The last
    ``keep`` published versions stay, for readers that are still at it."""
    spark = df.sparkSession
    jvm, folder, fs = _hadoop(spark, base)
    before = _pointed(spark, base)
    version = f"v-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(f"{base}/{version}")
    kept = [version, *before][:keep]
    mark = jvm.org.apache.hadoop.fs.Path(f"{base}/{POINTER}-{version}")
    out = fs.create(mark, True)
    out.write(bytearray("\n".join(kept).encode()))
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(mark, jvm.org.apache.hadoop.fs.Path(f"{base}/{POINTER}"), overwrite)
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("v-") and name not in kept:
            fs.delete(status.getPath(), True)
    return version


def _pointed(spark, base: str) -> list[str]:
    """The published versions of a table folder, newest first."""
    _, pointer, fs = _hadoop(spark, f"{base}/{POINTER}")
    if not fs.exists(pointer):
        return []
    return [r.value for r in spark.read.text(f"{base}/{POINTER}").collect()]  # ``keep`` lines


def read_published(spark, base: str, back: int = 0) -> DataFrame:
    """The published version of a table folder, or the one ``back`` versions before."""
    versions = _pointed(spark, base)
    if back >= len(versions):
        raise FileNotFoundError(f"{base} has no published version" + (f" {back} back" if back else ""))
    return spark.read.parquet(f"{base}/{versions[back]}")


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """A table bucketed and sorted by its key: joins of two such tables on the key, with
    as many buckets, need no shuffle."""
    writer = df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def write_csv(df: DataFrame, path: str) -> None:
    """Header CSV; quotes doubled inside quoted fields (RFC 4180), NULL -> empty."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option(
        "nullValue", "").option("emptyValue", "").csv(path)


def write_lines(df: DataFrame, path: str, head: Sequence[str] = ()) -> None:
    """One column of text as lines, every file beginning with the lines of ``head``."""
    if not head:
        df.write.mode("overwrite").text(path)
        return
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # of its task, so of its file
    value = F.col(df.columns[0])
    df.select(F.when(first, F.concat(F.lit("\n".join(head) + "\n"), value)).otherwise(value).alias("value")).write.mode("overwrite").text(path)


def write_json_report(df: DataFrame, path: str) -> None:
    """Nested report rows (structs / arrays kept) as JSON lines."""
    df.write.mode("overwrite").json(path)


def merge_metrics(existing: DataFrame, fresh: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Replace only the re-computed keys' rows, keep the rest, sort by key."""
    kept = existing.join(fresh.select(*key).distinct(), list(key), "left_anti")
    out = kept.unionByName(fresh, allowMissingColumns=True)
    return out.orderBy(*(order or key))


def truncate_reload(df: DataFrame, table: str, rename: Mapping[str, str], types: Mapping[str, str],
                    path: str | None = None) -> DataFrame:
    """Rename, coerce (bad value -> NULL) and replace the whole table (kept
    in the warehouse, or in the folder ``path``)."""
    out = df.withColumnsRenamed(dict(rename))
    out = out.select(*[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in out.columns])
    writer = out.write.mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return out.sparkSession.table(table)


def csv_field(c: Column) -> Column:
    """One CSV field: NULL / empty -> empty; quoted (inner quotes doubled)
    when it holds a quote, comma, CR or LF."""
    s = c.cast("string")
    needs = s.rlike('[",\\n\\r]')
    quoted = F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(s.isNull() | (s == ""), F.lit("")).when(needs, quoted).otherwise(s)


PORTFOLIO_COLUMNS = [
    ("property_id", "id"), ("address", "address"), ("zipcode", "zipcode"), ("bedrooms", "bedrooms"),
    ("bathrooms", "bathrooms"), ("sqft", "sqft"), ("listing_price", "listing_price"), ("saved_at", "created_at"),
    ("deal_label", "analysis.investment_analysis.deal_label"),
    ("investment_score", "analysis.investment_analysis.investment_score"),
    ("predicted_price", "analysis.valuation.predicted_price"), ("market_price", "analysis.valuation.market_price"),
    ("price_difference_pct", "analysis.valuation.price_difference_pct"),
    ("roi_estimate", "analysis.investment_analysis.roi_estimate"),
    ("recommendation", "analysis.investment_analysis.recommendation"),
    ("analysis_summary", "analysis.investment_analysis.analysis_summary"),
]


def portfolio_rows(df: DataFrame) -> DataFrame:
    """Flatten saved analyses to the 16 export columns (missing nested fields -> NULL)."""
    def held(path: str) -> bool:
        kind = df.schema
        for part in path.split("."):
            if not isinstance(kind, StructType) or part not in kind.fieldNames():
                return False
            kind = kind[part].dataType
        return True

    return df.select(*[(F.col(path) if held(path) else F.lit(None).cast("string")).alias(name) for name, path in PORTFOLIO_COLUMNS])


def number_text(c: Column) -> Column:
    """A number as the export writes it: whole numbers without a fraction."""
    return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("decimal(20,0)").cast("string")).otherwise(c.cast("string"))


def portfolio_csv_lines(df: DataFrame) -> DataFrame:
    """One escaped CSV line per saved property (header is PORTFOLIO_COLUMNS names)."""
    rows = portfolio_rows(df)
    kinds = dict(rows.dtypes)
    text = [number_text(F.col(n)) if kinds[n] in ("double", "float") else F.col(n) for n, _ in PORTFOLIO_COLUMNS]
    return rows.select(F.col("property_id"), F.concat_ws(",", *[csv_field(c) for c in text]).alias("line"))


def apply_changes(base: DataFrame, changes: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Batch change feed: ``changes`` has ``key``, ``op`` (insert / update /
    delete), the fields and ``sent`` (array of field names present in the
    request). Updates touch only sent fields; deletes drop the row; inserts
    add it. One full outer join on the key."""
    c = changes.select(F.col(key).alias("__k"), "op", "sent", *[F.col(f).alias(f"__c_{f}") for f in fields])
    j = base.join(c, base[key] == F.col("__k"), "full")
    is_upd = F.col("op") == "update"
    is_ins = F.col("op") == "insert"
    out = j.where(F.coalesce(F.col("op"), F.lit("")) != "delete").where(base[key].isNotNull() | is_ins)
    sel = [F.coalesce(base[key], F.col("__k")).alias(key)]
    for f in fields:
        sent = F.coalesce(F.array_contains("sent", f), F.lit(False))
        v = (F.when(is_ins, F.col(f"__c_{f}"))
             .when(is_upd & sent, F.col(f"__c_{f}"))
             .otherwise(base[f]))
        sel.append(v.alias(f))
    return out.select(*sel)

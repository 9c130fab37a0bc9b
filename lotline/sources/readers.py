"""Sources: multi-file CSV stacks with header offsets and tags, projected /
case-insensitive CSV, projected parquet, point lookups, catalog tables and
best-available routing (survey 2.1)."""

from __future__ import annotations

import csv
import logging
from collections.abc import Mapping, Sequence
from io import StringIO
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotline.operators.columns import norm_header, union_align
from lotline.session import ship_package

log = logging.getLogger(__name__)
csv.field_size_limit(1 << 30)  # a field may be as long as a text


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def read_csv_skipping(spark: SparkSession, path: str, skip_lines: int = 0) -> DataFrame:
    """All-string CSV file, or folder of files, each with ``skip_lines`` lines
    of preamble before its header. Line breaks inside quotes are part of a field;
    blank lines and empty fields are no rows and NULL. Files may have their columns
    in different orders; a file without a header is an error.

    Spark's line reader cuts files into splits; whether a split begins inside quotes
    depends on all that comes before it. So a first pass counts the quotes of
    every split (a row a split comes back), and the second one parses each
    split from the right state on. A record that reaches over the end of
    its split is put together from its pieces. Many tasks a file, in both passes.
    """
    ship_package(spark)
    skip = max(0, skip_lines)
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    lines = spark.read.option("lineSep", "\n").text(path).select("value", *meta)

    def survey(batches):
        for file, start, texts in _splits(batches):
            n, quotes, header, closes = 0, 0, None, False
            for t in texts:
                n += 1
                if start == 0 and n <= skip:
                    continue  # a preamble's quotes mean nothing
                if start == 0 and n == skip + 1:
                    header = t.rstrip("\r")
                quotes += t.count('"')
                closes = closes or (t.count('"') % 2 == 1)
            yield pa.RecordBatch.from_pylist([{"file": file, "start": start, "lines": n, "odd": quotes % 2 == 1, "closes": closes, "header": header}], schema=_SURVEY)

    found = sorted(lines.mapInArrow(survey, "file string, start long, lines long, odd boolean, closes boolean, header string").collect(), key=lambda r: (r.file, r.start))
    headers, inside, chain, state = {}, {}, {}, False
    for i, r in enumerate(found):  # a row a split
        if i == 0 or found[i - 1].file != r.file:
            names = next(csv.reader([r.header]), []) if r.header else []
            if not names:
                raise ValueError(f"{r.file} has no header after {skip} lines")
            headers[r.file], state, at = names, False, r.start
        # the split in which the record that is open at this one's start began
        inside[r.file, r.start], chain[r.file, r.start] = state, at
        # without a closing quote the same record stays open; whether one closed and another
        # opened is seen by the splits themselves, which name themselves as its beginning
        if not state or r.closes:
            at = r.start
        state = state != r.odd
    if not found:
        raise ValueError(f"{path} has no header after {skip} lines")
    names = list(dict.fromkeys(c for h in headers.values() for c in h))
    plan = spark.sparkContext.broadcast((headers, inside, chain))

    def parse(batches):
        heads, starts, chains = plan.value
        for file, start, texts in _splits(batches):
            out, pieces = [], []
            opened, held, first = starts[file, start], [], starts[file, start]
            for n, t in enumerate(texts):
                if start == 0 and n <= skip:
                    continue
                held.append(t)
                opened ^= t.count('"') % 2 == 1
                if opened:
                    continue
                text = "\n".join(held)
                if first:  # the end of a record that an earlier split began
                    pieces.append((chains[file, start], text))
                elif text.strip():
                    out.append(text)
                held, first = [], False
            if held:
                pieces.append((chains[file, start] if first else start, "\n".join(held)))
            rows = [_record(t, heads[file], names) for t in out]
            yield _record_batch(file, start, rows, pieces, names)

    fields = [f"c{i}" for i in range(len(names))]
    parsed = lines.mapInArrow(parse, f"file string, start long, chain long, piece string, row struct<{', '.join(f'{c}:string' for c in fields)}>")
    whole = parsed.where("row is not null").select("row.*")
    if not any(inside.values()):
        return whole.toDF(*names)

    def close(pdf):
        heads = plan.value[0]
        text = "\n".join(pdf.sort_values("start")["piece"])
        made = [_record(text, heads[pdf["file"].iloc[0]], names)] if text.strip() else []
        return pd.DataFrame(made, columns=fields)

    cut = parsed.where("piece is not null").groupBy("file", "chain").applyInPandas(close, ", ".join(f"{c} string" for c in fields))
    return whole.unionByName(cut).toDF(*names)


_SURVEY = pa.schema([("file", pa.string()), ("start", pa.int64()), ("lines", pa.int64()), ("odd", pa.bool_()), ("closes", pa.bool_()), ("header", pa.string())])


def _splits(batches):
    """The lines of each split of a partition, in order: file, start, lines."""
    def rows():
        for b in batches:
            yield from zip(*(b.column(i).to_pylist() for i in (1, 2, 0)), strict=True)

    for (file, start), group in groupby(rows(), key=lambda r: r[:2]):
        yield file, start, (r[2] for r in group)


def _record(text: str, header: Sequence[str], names: Sequence[str]) -> list:
    """The fields of one record, by the names of its file's header."""
    values = next(csv.reader(StringIO(text.rstrip("\r"), newline="")), [])
    by = dict(zip(header, values, strict=False))
    return [by.get(c) or None for c in names]


def _record_batch(file, start, rows, pieces, names) -> pa.RecordBatch:
    fields = [f"c{i}" for i in range(len(names))]
    n = len(rows) + len(pieces)
    cols = [pa.array([r[i] for r in rows] + [None] * len(pieces), pa.string()) for i in range(len(names))]
    row = pa.StructArray.from_arrays(cols, names=fields, mask=pa.array([False] * len(rows) + [True] * len(pieces), pa.bool_()))
    return pa.RecordBatch.from_arrays(
        [pa.array([file] * n, pa.string()), pa.array([start] * n, pa.int64()), pa.array([None] * len(rows) + [c for c, _ in pieces], pa.int64()),
         pa.array([None] * len(rows) + [t for _, t in pieces], pa.string()), row], names=["file", "start", "chain", "piece", "row"])


def read_multi_file(spark: SparkSession, specs: Sequence[Mapping], normalise: bool = True) -> DataFrame:
    """Stack many per-borough / per-year files.

    ``specs``: dicts with ``path``, optional ``skip`` (preamble lines before
    the header) and ``tags`` (literal columns such as borough / year / file
    type). Missing files are skipped with a warning; headers are normalised;
    columns are aligned by name (absent ones become NULL).
    """
    parts = []
    for spec in specs:
        path = spec["path"]
        if not _exists(spark, path):
            log.warning("missing input skipped: %s", path)
            continue
        df = read_csv_skipping(spark, path, int(spec.get("skip", 0)))
        if normalise:
            df = df.toDF(*[norm_header(c) for c in df.columns])
        for k, v in (spec.get("tags") or {}).items():
            df = df.withColumn(k, F.lit(v))
        parts.append(df)
    if not parts:
        raise FileNotFoundError("no input file found")
    return union_align(*parts)


def read_csv_projected(spark: SparkSession, path: str, wanted: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """CSV with the wanted columns that exist; returns (frame, missing names)."""
    df = spark.read.option("header", True).csv(path)
    have = [c for c in wanted if c in df.columns]
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        log.warning("columns absent, skipped: %s", missing)
    return df.select(*have), missing


def read_csv_case_insensitive(spark: SparkSession, path: str, wanted: Sequence[str]) -> DataFrame:
    """All-string CSV; pick wanted columns ignoring case, output lower-case names."""
    df = spark.read.option("header", True).csv(path)
    lower = {c.lower(): c for c in df.columns}
    return df.select(*[F.col(lower[w.lower()]).alias(w.lower()) for w in wanted if w.lower() in lower])


def read_parquet_projected(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Parquet with column pruning (ReadSchema holds only ``columns``)."""
    return spark.read.parquet(path).select(*columns)


def parquet_lookup_many(spark: SparkSession, path: str, key: str, keys: DataFrame) -> DataFrame:
    """Rows for many requested keys: a left-semi join (runtime filters /
    dynamic pruning can prune the scan)."""
    return spark.read.parquet(path).join(keys.select(F.col(keys.columns[0]).alias(key)).distinct(), key, "left_semi")


def read_table(spark: SparkSession, name: str, columns: Sequence[str]) -> DataFrame:
    """Catalog table projection (the reference's SQL projection)."""
    return spark.table(name).select(*columns)


def best_available(segment: str, specialised: Mapping[str, DataFrame], standard: DataFrame) -> DataFrame:
    """Plan-time routing: the segment's specialised dataset, else the standard one."""
    return specialised.get(segment, standard)

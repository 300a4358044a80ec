"""Writing facts, catalogs and result files."""

from __future__ import annotations

import csv
import json
import os
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_facts(facts: DataFrame, path: str) -> None:
    """Facts as parquet, partitioned by code and year."""
    # Ranges of code, year and table: a code and year with very many rows is cut, and goes to several files.
    facts.repartitionByRange("ticker", "year", *(c for c in ("table_ref", "row_idx") if c in facts.columns)).write.mode("overwrite").partitionBy("ticker", "year").parquet(path)


def upserted(old: DataFrame, new: DataFrame, key: str = "table_ref", order: str = "ingested_at") -> DataFrame:
    """The last row of each key of old and new. The newest order wins, then the new batch, then all other columns."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    return latest(both, key, order, "_batch").drop("_batch")


#: The keys of a catalog row.
CATALOG = (
    "table_ref", "doc_id", "position", "csv_path", "filename", "title", "section", "unit", "ticker", "year", "report_type", "card", "n_rows", "n_cols", "is_continuation", "group_id",
    "parent_table_ref", "next_table_ref", "published_at", "ingested_at", "page",
)


def catalog_rows(tables: DataFrame) -> DataFrame:
    """tables as catalog rows of the same 21 keys; those that are absent are null."""
    return tables.select(*((F.col(c) if c in tables.columns else F.lit(None).cast("string")).alias(c) for c in CATALOG))


def write_catalog(rows: DataFrame, path: str, mode: str = "full") -> None:
    """Write a catalog at path: full replaces it, upsert keeps the rows that rows doesn't name. Written beside the old one and moved into its place."""
    if mode not in ("full", "upsert"):
        raise ValueError(f"no such mode: {mode}")
    spark = rows.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    out = rows
    if mode == "upsert" and files.exists(where):
        out = upserted(spark.read.parquet(path), rows)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    out.write.mode("overwrite").parquet(f"{path}.part")
    if files.exists(where):
        files.delete(where, True)
    files.rename(part, where)


def export_tables(facts: DataFrame, folder: str) -> list[str]:
    """A CSV file for each table of facts(filename, ...), for a person; rows come to the driver one after the other and go to the file of their table."""
    target, columns = Path(folder), [c for c in facts.columns if c != "filename"]
    target.mkdir(parents=True, exist_ok=True)
    written, current, out = [], None, None
    for row in facts.orderBy("filename", *(c for c in ("row_idx",) if c in columns)).toLocalIterator():
        if row["filename"] != current:
            if out:
                out.close()
            current = row["filename"]
            written.append(str(target / current))
            out = open(target / current, "w", encoding="utf-8-sig", newline="")  # noqa: SIM115
            rows = csv.writer(out)
            rows.writerow(columns)
        rows.writerow(["" if row[c] is None else row[c] for c in columns])
    if out:
        out.close()
    return written


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row of each key: that with the greatest order. A partial aggregate, so that a hot key moves one row of each task."""
    rest = [c for c in rows.columns if c != key]
    kept = F.max_by(F.struct(*rest), F.struct(*order, F.xxhash64(*rest)))
    return rows.groupBy(key).agg(kept.alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(*rows.columns)


def write_json(rows: DataFrame, path: str) -> None:
    """All rows as one JSON list, written beside the target and moved into its place. For results that go to a person."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    with (part := target.with_suffix(".part")).open("w", encoding="utf-8") as out:
        out.write("[")
        for i, line in enumerate(rows.toJSON().toLocalIterator()):
            out.write((",\n" if i else "\n") + line)
        out.write("\n]\n")
    os.replace(part, target)


def write_json_lines(rows: DataFrame, path: str) -> None:
    """All rows as JSON lines, written beside the target and moved into its place; where it can't be moved there it is written in place."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_suffix(target.suffix + ".part")
    with part.open("w", encoding="utf-8") as out:
        out.writelines(line + "\n" for line in rows.toJSON().toLocalIterator())
    try:
        os.replace(part, target)
    except OSError:
        target.write_bytes(part.read_bytes())
        part.unlink()


def zip_results(path: str, results: str, tables: list[str], broken: DataFrame | None = None) -> None:
    """An archive of one result file and the tables that it refers to. broken(rule, severity, id): stop if any of it is an error."""
    json.loads(Path(results).read_text(encoding="utf-8"))
    errors = sorted({r["rule"] for r in broken.where("severity = 'error'").select("rule").distinct().collect()}) if broken is not None else []
    if errors:
        raise ValueError(f"broken rules: {', '.join(errors)}")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as out:
        out.write(results, Path(results).name)
        for t in sorted(set(tables)):
            out.write(t, f"data/{Path(t).name}")

"""Run registered queries beside their SQL in DuckDB: python tests/compare.py SF_DIR [NAME...]."""

from __future__ import annotations

import decimal
import math
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str):
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if Path(path).exists():
            db.execute(f"create view {t} as select * from '{path}{'/*.parquet' if Path(path).is_dir() else ''}'")
    return db


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    if isinstance(x, decimal.Decimal):
        return round(float(x), 9)
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    return x


def rows(columns: list[str], data) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([plain(r[i]) for i in order]) for r in data)


def difference(spark, db, sf_dir: str, query, sql: str) -> str | None:
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    res = db.execute(sql)
    names = [c[0] for c in res.description]
    want = rows(names, res.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {df.columns} and {names}"
    if got != want:
        odd = [(a, b) for a, b in zip(got, want, strict=False) if a != b][:2]
        return f"{len(got)} rows and {len(want)}; {str(odd)[:700]}"
    return None


def main() -> None:
    from pyspark.sql import SparkSession

    from siltstone.plans import catalog, contracts, files, judging, more, planner, selection  # noqa: F401

    spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(catalog.QUERIES)
    db = database(sf_dir)
    for name in names:
        try:
            if name in catalog.ORACLE_SQL:
                found = difference(spark, db, sf_dir, catalog.QUERIES[name], catalog.ORACLE_SQL[name])
            else:
                found = None if catalog.QUERIES[name](spark, sf_dir).count() else "no rows"
        except Exception as e:  # noqa: BLE001
            found = f"{type(e).__name__}: {str(e)[:600]}"
        if found:
            print("DIFFERS", name, found, flush=True)
    print(len(names), "compared")


if __name__ == "__main__":
    main()

"""Compare queries with their SQL twins. Run: python tests/check_oracle.py [folder] [names...]"""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(r) for r in df.itertuples(index=False, name=None)), key=repr)


def compare(spark, con, folder, name):
    """(equal, message) for one query."""
    frame = entry.queries()[name](spark, folder)
    found = frame.toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return len(found) > 0, f"{len(found)} rows, no SQL"
    relation = con.sql(sql)
    wanted = relation.df()
    if sorted(found.columns) != sorted(wanted.columns):
        return False, f"columns {sorted(found.columns)} != {sorted(wanted.columns)}"
    if len(found) != len(wanted):
        return False, f"rows {len(found)} != {len(wanted)}"
    types = dict(zip(relation.columns, map(str, relation.types)))
    names = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "float": "FLOAT", "boolean": "BOOLEAN"}
    wrong = [(c, t, types[c]) for c, t in frame.dtypes if names.get(t, t) != types[c]]
    a, b = rows(found.astype(object).where(found.notna(), None)), rows(wanted.astype(object).where(wanted.notna(), None))
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{len(bad)} rows differ, first {str(bad[0])[:400]}"
    return not wrong, f"{len(found)} rows" + (f", types {wrong}" if wrong else "")


def main():
    from lexitally.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(
        master="local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name in sys.argv[2:] or entry.queries():
        start = time.time()
        try:
            ok, message = compare(spark, con, folder, name)
        except Exception as error:
            ok, message = False, f"{type(error).__name__}: {str(error)[:600]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {time.time() - start:6.1f}s {message}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(bool(main()))

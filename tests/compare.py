"""Comparison of a query's rows with those of its SQL in DuckDB, whatever their order."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con.execute(sql).df()


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if hasattr(v, "isoformat"):
            return str(v)[:10] if str(v)[11:19] in ("", "00:00:00") else str(v)
        if isinstance(v, bool) or type(v).__name__ in ("bool", "bool_"):
            return str(bool(v))
        if isinstance(v, (int, float)) or hasattr(v, "item"):
            return float(v)
        return str(v)

    names = sorted(frame.columns)
    return sorted((tuple(plain(v) for v in row) for row in frame[names].itertuples(index=False, name=None)), key=repr)


def differences(mine: pd.DataFrame, theirs: pd.DataFrame) -> str:
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} and {sorted(theirs.columns)}"
    a, b = rows(mine), rows(theirs)
    if a == b:
        return ""
    only_a, only_b = [x for x in a if x not in set(b)], [x for x in b if x not in set(a)]
    return f"{len(a)} and {len(b)} rows; only Spark {len(only_a)}: {only_a[:3]}; only SQL {len(only_b)}: {only_b[:3]}"

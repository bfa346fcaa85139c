"""Run registered queries and their SQL side by side and compare whole results."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def norm(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    return v


def fam(t: str) -> str:
    t = t.lower()
    if "[]" in t or t.startswith("array"):
        return "array"
    for f, names in {"int": ("bigint", "int", "integer", "smallint", "tinyint", "hugeint", "ubigint", "long"),
                     "float": ("double", "float"), "str": ("string", "varchar"), "bool": ("boolean",)}.items():
        if t in names:
            return f
    return t


def compare(name, df, con, sql):
    t0 = time.time()
    rows = [tuple(norm(v) for v in r) for r in df.collect()]
    t1 = time.time()
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    dtypes = {d[0]: str(d[1]) for d in cur.description}
    drows = [tuple(norm(v) for v in r) for r in cur.fetchall()]
    t2 = time.time()
    scols = df.columns
    msgs = []
    if sorted(scols) != sorted(dcols):
        msgs.append(f"columns {sorted(scols)} vs {sorted(dcols)}")
        return msgs, len(rows), t1 - t0, t2 - t1
    st = dict(df.dtypes)
    for c in scols:
        if fam(st[c]) != fam(dtypes[c]):
            msgs.append(f"type {c}: {st[c]} vs {dtypes[c]}")
        elif "hugeint" in dtypes[c].lower():
            msgs.append(f"type {c}: hugeint in SQL")
    order = sorted(scols)
    si, di = [scols.index(c) for c in order], [dcols.index(c) for c in order]
    a = sorted((tuple(r[i] for i in si) for r in rows), key=repr)
    b = sorted((tuple(r[i] for i in di) for r in drows), key=repr)
    if len(a) != len(b):
        msgs.append(f"rows {len(a)} vs {len(b)}")
    if a != b:
        sa, sb = set(a), set(b)
        diff = [x for x in a if x not in sb][:2], [x for x in b if x not in sa][:2]
        msgs.append(f"values differ: {len([x for x in a if x not in sb])} {order}\n   spark {str(diff[0])[:700]}\n   sql   {str(diff[1])[:700]}")
    return msgs, len(rows), t1 - t0, t2 - t1


def main(sf, names):
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as E
    from decant.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, Q, O = duck(sf), E.queries(), E.oracle_sql()
    bad = 0
    picked = [q for q in Q if not names or any(q == n or (n.endswith("*") and q.startswith(n[:-1])) for n in names)]
    for q in picked:
        t0 = time.time()
        try:
            df = Q[q](spark, sf)
            if q in O:
                msgs, n, ts, td = compare(q, df, con, O[q])
            else:
                n, msgs, ts, td = len(df.collect()), [], time.time() - t0, 0
            tag = "ok  " if not msgs else "FAIL"
            if n == 0:
                tag = "EMPTY"
            if q not in O:
                tag = "rows"
            bad += tag in ("FAIL", "EMPTY")
            print(f"{tag} {q:28s} rows={n:7d} spark={ts:6.2f}s build={time.time() - t0 - ts - td:5.2f}s sql={td:5.2f}s", *msgs, sep="\n   " if msgs else " ")
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {q}: {type(e).__name__}: {str(e)[:900]}")
        sys.stdout.flush()
    print(f"{len(picked)} queries, {bad} bad")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])

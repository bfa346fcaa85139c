"""String pools, slots and embedding spaces.

Means of cosines over pair sets come from sums of unit vectors, so no pair is ever built. Nearest
neighbours need every pair once: they run as block products inside tasks and only k rows per query and
block leave a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decant.functions import dist as D
from decant.functions import hashing as H
from decant.operators.prefix import edge_buckets, hash_bucket, prefix
from decant.session import SMALL_BYTES, attach, materialise

BLOCK_ROWS, QUERY_ROWS = 2048, 256
#: Blocks on either side of a grid cell: fewer copies of the rows, one product at a time all the same.
SIDE = 8
# Fixed values of the closeness verdict.
TEACHER_RATIO, CHANCE_FACTOR, SEEN_RATIO = 0.70, 5.0, 0.80


# ---- strings and slots ---------------------------------------------------------------------

def verify_strings(shown: DataFrame, grid: DataFrame) -> DataFrame:
    """Check shown (text, tier, label) rows against the phrase table; adds the reason a row disagrees."""
    g = grid.groupBy("text", "label").agg(F.min("tier").alias("lo"), F.max("tier").alias("hi"))
    g = g.groupBy("text").agg(F.count(F.lit(1)).alias("n_labels"), F.min("label").alias("t_label"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return shown.join(g, "text", "left").withColumn(
        "reason", F.expr("""case when n_labels is null then 'string not in table' when n_labels > 1 then 'ambiguous'
            when tier not between lo and hi then 'tier mismatch' when t_label <> label then 'gold mismatch' else 'ok' end"""))


def slots(items: DataFrame) -> DataFrame:
    """One row per item and candidate position; ``h`` stands for the string."""
    d = items.selectExpr("item_id", "source", "split", "posexplode(candidates) as (pos, text)")
    return d.withColumn("h", F.sha1("text"))


def dictionary(slot: DataFrame) -> DataFrame:
    """Unique strings numbered in first-occurrence order (item, position), from 0. Item ids may be as sparse as they like."""
    first = slot.groupBy("h").agg(F.min_by("text", F.struct("item_id", "pos")).alias("text"), F.min(F.struct("item_id", "pos", "source")).alias("at"))
    d = edge_buckets(materialise(first.select("h", "text", "at.item_id", "at.pos", "at.source"), "first"), "item_id")
    d = prefix(d, ["item_id", "pos"], F.col("_bucket"), rank="uid").drop("_bucket")
    return d.withColumn("uid", F.col("uid") - 1)


def slot_ids(slot: DataFrame, strings: DataFrame) -> DataFrame:
    return slot.join(strings.select("h", "uid"), "h", "left").select("item_id", "source", "split", "pos", "h", "uid")


def leaks(slot: DataFrame, embedded: DataFrame) -> DataFrame:
    """Why a string set may not be embedded: held-out items among its slots, or held-out strings in it."""
    held = slot.filter("split <> 'train'")
    by_split = held.groupBy("split").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("slot of split "), F.col("split")).alias("problem"), "n")
    train = slot.filter("split = 'train'").select("h").distinct()
    only_held = embedded.join(train, "h", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("string without a train slot").alias("problem"), "n")
    return by_split.unionByName(only_held).filter("n > 0")


def slots_problems(expected: DataFrame, found: DataFrame, masked: bool = False) -> DataFrame:
    """Slots on one side only. Masked sets may lack slots but never have extra ones."""
    j = expected.select("item_id", "pos", F.lit(True).alias("e")).join(found.select("item_id", "pos", F.lit(True).alias("f")), ["item_id", "pos"], "full_outer")
    bad = F.when(F.col("e").isNull(), "extra").when(F.col("f").isNull() & F.lit(not masked), "missing")
    return j.select("item_id", "pos", bad.alias("problem")).filter("problem is not null")


def mask_long(slot: DataFrame, lengths: DataFrame, limit: int) -> DataFrame:
    """Slots whose string is longer than ``limit`` tokens lose their id."""
    d = slot.join(lengths.select("uid", "n_tokens"), "uid")
    return d.withColumns({"long": F.col("n_tokens") > limit, "masked_uid": F.when(F.col("n_tokens") <= limit, F.col("uid"))})


def string_pool(slot: DataFrame, tokens: DataFrame) -> DataFrame:
    """Strings still referenced by a valid slot, with tokens and source of their first slot."""
    first = slot.filter("uid is not null").groupBy("uid").agg(F.min(F.struct("item_id", "pos", "source")).alias("a"))
    return first.select("uid", "a.source", "a.item_id", "a.pos").join(tokens, "uid").filter(F.size("tokens") > 0)


# ---- pair means without pairs --------------------------------------------------------------

def vector_sum(vec: str, dims: int) -> Column:
    return F.expr(f"array({', '.join(f'sum({vec}[{i}])' for i in range(dims))})")


def group_sums(df: DataFrame, keys: Sequence[str], vec: str, dims: int) -> DataFrame:
    """Row count and sum of vectors per group; combined before the shuffle."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), vector_sum(vec, dims).alias("s"))


# ---- nearest neighbours --------------------------------------------------------------------

def _best(q: pd.DataFrame, p: pd.DataFrame, pm: np.ndarray, k: int, exclude: Sequence[str], require: Sequence[str]) -> pd.DataFrame:
    sim = np.round(np.stack(q["vec"].to_numpy()) @ pm.T, 6)
    ok = np.ones(sim.shape, bool)
    for c in exclude:
        ok &= q[c].to_numpy()[:, None] != p[c].to_numpy()[None, :]
    for c in require:
        ok &= q[c].to_numpy()[:, None] == p[c].to_numpy()[None, :]
    sim = np.where(ok, sim, -np.inf)
    ids = p["id"].to_numpy()
    out = []
    for i, row in enumerate(sim):
        cand = np.flatnonzero(row > -np.inf)
        if len(cand) > k:
            edge = np.partition(row[cand], len(cand) - k)[len(cand) - k]
            cand = cand[row[cand] >= edge]
        top = cand[np.lexsort((ids[cand], -row[cand]))[:k]]
        out.append((np.full(len(top), q["id"].iat[i]), ids[top], row[top]))
    cols = [np.concatenate(x) if out else np.array([]) for x in zip(*out)]
    return pd.DataFrame({"qid": cols[0].astype("int64"), "pid": cols[1].astype("int64"), "cos": cols[2].astype("float64")})


def _meet(queries: DataFrame, pool: DataFrame, kernel: Callable, merge: Callable, schema: str, block: int) -> DataFrame:
    """Run ``kernel(query rows, pool rows, pool matrix)`` so that every query meets every pool row exactly once.

    A pool counted to be small goes to every task as one matrix. Otherwise both sides are cut into blocks, each
    block is copied along the other side's blocks, and the pairs of blocks are separate tasks. Either way a product has
    ``QUERY_ROWS`` by ``block`` cells at most, and ``merge(so far, result)`` joins the results of one group of queries
    as they come, so a task holds one small product and what came of those before it.
    """
    first = pool.select(F.size("vec").alias("d")).first()
    dims = first.d if first else 1
    n_pool = pool.count()

    def products(q: pd.DataFrame, p: pd.DataFrame, pm: np.ndarray) -> Iterator[pd.DataFrame]:
        for i in range(0, len(q), QUERY_ROWS):
            part, got = q.iloc[i : i + QUERY_ROWS], None
            for j in range(0, len(p), block):
                new = kernel(part, p.iloc[j : j + block], pm[j : j + block])
                got = new if got is None else merge(got, new)
            if got is not None:
                yield got

    if n_pool * dims * 8 <= SMALL_BYTES:
        held = pool.toPandas()
        matrix = np.stack(held["vec"].to_numpy()) if len(held) else np.zeros((0, dims))
        shared = queries.sparkSession.sparkContext.broadcast((held.drop(columns="vec"), matrix))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            p, pm = shared.value
            for q in batches:
                yield from products(q, p, pm)

        return queries.mapInPandas(scan, schema)

    nq, np_ = (max(1, -(-n // (SIDE * block))) for n in (queries.count(), n_pool))
    side = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    q = queries.withColumns({"qb": side(nq), "pb": F.explode(F.sequence(F.lit(0), F.lit(np_ - 1)))})
    p = pool.withColumns({"pb": side(np_), "qb": F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))})
    empty = pool.sparkSession.createDataFrame([], schema).toPandas()

    def cell(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not (len(x) and len(y)):
            return empty
        return pd.concat(list(products(x, y, np.stack(y["vec"].to_numpy()))))

    # the product is the costly part and its result is small: written once, never computed again
    return materialise(q.groupBy("qb", "pb").cogroup(p.groupBy("qb", "pb")).applyInPandas(cell, schema), "blocks")


def _keep_best(k: int) -> Callable:
    """Best ``k`` per query of two lists."""
    def merge(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        both = {c: np.concatenate([a[c].to_numpy(), b[c].to_numpy()]) for c in ("qid", "pid", "cos")}
        order = np.lexsort((both["pid"], -both["cos"], both["qid"]))
        qid = both["qid"][order]
        starts = np.flatnonzero(np.append(True, qid[1:] != qid[:-1])) if len(qid) else np.zeros(0, int)
        rank = np.arange(len(qid)) - np.repeat(starts, np.diff(np.append(starts, len(qid))))
        order = order[rank < k]
        return pd.DataFrame({c: v[order] for c, v in both.items()})
    return merge


def nearest(queries: DataFrame, pool: DataFrame, k: int, exclude: Sequence[str] = ("id",), require: Sequence[str] = (), block: int = BLOCK_ROWS) -> DataFrame:
    """Exact top-k by cosine; both sides have (id, unit vector ``vec``) plus the columns named in the conditions.

    ``exclude``: pairs equal in that column never count; ``require``: only pairs equal in it count. Cosines
    are compared after rounding to six digits, ties go to the smaller id.
    """
    cols = ["id", "vec", *[c for c in (*exclude, *require) if c != "id"]]
    ex, rq = tuple(exclude), tuple(require)
    found = _meet(queries.select(*cols), pool.select(*cols), lambda q, p, pm: _best(q, p, pm, k, ex, rq), _keep_best(k), "qid bigint, pid bigint, cos double", block)
    return _ranked(found, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("cos"), "pid")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def pair_auc(queries: DataFrame, pool: DataFrame, digits: int = 4, require: Sequence[str] = ("lang",), label: str = "intent", block: int = BLOCK_ROWS) -> DataFrame:
    """AUC of same-label against other-label pair cosines, from counts per cosine rounded to ``digits``.

    Tasks emit one row per distinct cosine value, at most 2·10^digits + 1 of them, never the pairs.
    """
    from decant.operators.quantiles import auc_from_counts

    rq, unit = tuple(require), 10**digits

    def count(q: pd.DataFrame, p: pd.DataFrame, pm: np.ndarray) -> pd.DataFrame:
        at = np.rint(np.stack(q["vec"].to_numpy()) @ pm.T * unit).astype(np.int32)
        same = q[label].to_numpy()[:, None] == p[label].to_numpy()[None, :]
        ok = np.ones(at.shape, bool)
        for c in rq:
            ok &= q[c].to_numpy()[:, None] == p[c].to_numpy()[None, :]
        low = int(at.min()) if at.size else 0
        pos, all_ = (np.bincount(at[m] - low) for m in (ok & same, ok))
        v = np.flatnonzero(all_)
        pos = np.append(pos, np.zeros(len(all_) - len(pos), pos.dtype))[v]
        return pd.DataFrame({"v": (v + low) / unit, "pos": pos.astype("int64"), "neg": (all_[v] - pos).astype("int64")})

    cols = ["id", "vec", label, *require]
    add = lambda a, b: pd.concat([a, b]).groupby("v", as_index=False).sum()
    c = _meet(queries.select(*cols), pool.select(*cols), count, add, "v double, pos bigint, neg bigint", block)
    return auc_from_counts(c.groupBy("v").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))


def recall_at_k(queries: DataFrame, pool: DataFrame, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """Overlap of teacher-space (``vec``) and student-space (``svec``) neighbour lists, averaged over queries."""
    student = lambda d: d.drop("vec").withColumnRenamed("svec", "vec")
    k_max = max(ks)
    t = nearest(queries, pool, k_max).select("qid", "pid", F.col("rank").alias("rt"))
    s = nearest(student(queries), student(pool), k_max).select("qid", "pid", F.col("rank").alias("rs"))
    j = t.join(s, ["qid", "pid"])
    hits = j.agg(*[F.count_if((F.col("rt") <= k) & (F.col("rs") <= k)).alias(f"h{k}") for k in ks])
    nq, n_pool = queries.agg(F.count(F.lit(1)).alias("nq")), pool.agg(F.count(F.lit(1)).alias("np"))
    rows = [F.struct(F.lit(k).alias("k"), F.round(F.col(f"h{k}") / (F.col("nq") * k), 6).alias("recall"), F.round(F.lit(k) / (F.col("np") - 1), 6).alias("chance")) for k in ks]
    return attach(hits, nq, n_pool).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# ---- linear algebra over partial sums ------------------------------------------------------

def _moments(df: DataFrame, cols: Sequence[str], key: str | None = None) -> dict:
    """Per key: n, sums and cross-products of the concatenated columns. One row per task and key is shuffled."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[int, np.ndarray] = {}
        for b in batches:
            if not len(b):
                continue
            m = np.hstack([np.stack(b[c].to_numpy()).astype(float) for c in cols])
            m = np.hstack([np.ones((len(m), 1)), m])
            keys = b[key].to_numpy() if key else np.zeros(len(m), int)
            for k in np.unique(keys):
                x = m[keys == k]
                acc[int(k)] = acc.get(int(k), 0) + x.T @ x
        for k, g in acc.items():
            yield pd.DataFrame({"key": [k], "g": [g.ravel()]})

    d = df.select(*cols, *([key] if key else [])).mapInPandas(part, "key int, g array<double>")
    d = d.select("key", F.posexplode("g").alias("i", "x")).groupBy("key", "i").agg(F.sum("x").alias("x"))
    rows = d.orderBy("key", "i").toPandas()  # D x D numbers per key, whatever the row count
    out = {}
    for k, g in rows.groupby("key"):
        size = int(round(len(g) ** 0.5))
        out[int(k)] = g["x"].to_numpy().reshape(size, size)
    return out


@dataclass(frozen=True)
class Axes:
    """Orthonormal directions (rows) of falling variance about a mean."""

    mean: np.ndarray
    rows: np.ndarray
    variance: np.ndarray
    total: float
    n: int

    @property
    def share(self) -> np.ndarray:
        return self.variance / self.total if self.total > 0 else np.zeros_like(self.variance)


def principal_axes(df: DataFrame, vec: str, d: int) -> Axes:
    """The ``d`` main directions of the unit vectors; each points where its entries sum to more than zero."""
    sums = _moments(df.select(F.expr(D.unit(vec)).alias("u")), ["u"])[0]
    n, mean = int(sums[0, 0]), sums[0, 1:] / sums[0, 0]
    spread = (sums[1:, 1:] / n - np.outer(mean, mean)) * n / (n - 1)
    _, sizes, directions = np.linalg.svd((spread + spread.T) / 2, hermitian=True)
    most = min(d, mean.size, n - 1)
    turn = np.where(directions[:most].sum(axis=1) < 0, -1.0, 1.0)
    return Axes(mean, turn[:, None] * directions[:most], sizes[:most], float(sizes.sum()), n)


def project(df: DataFrame, vec: str, mean: np.ndarray, matrix: np.ndarray, out: str) -> DataFrame:
    """Rows times a small matrix (D x d), after unit length and centring."""
    shared = df.sparkSession.sparkContext.broadcast((mean, matrix))

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, b = shared.value
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[vec].to_numpy()).astype(float)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                yield pdf.assign(**{out: list((x - m) @ b)})

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return df.mapInPandas(apply, f"{schema}, `{out}` array<double>")


def gaussian_matrix(rows: int, cols: int, seed: str) -> np.ndarray:
    """Seeded Gaussian entries scaled by 1/sqrt(cols), from sha1 uniforms, equal on every machine."""
    import hashlib

    def u(*p):
        return (int(hashlib.sha1(":".join([str(H.SEED), seed, *map(str, p)]).encode()).hexdigest()[:8], 16) + 1) / 4294967297.0

    z = [[np.sqrt(-2 * np.log(u(i, j, 1))) * np.cos(2 * np.pi * u(i, j, 2)) for j in range(cols)] for i in range(rows)]
    return np.array(z) / np.sqrt(cols)


#: Penalties tried, as shares of the mean variance of an input.
PENALTIES = tuple(10.0 ** -k for k in (4, 3, 2, 1, 0))


@dataclass(frozen=True)
class Ridge:
    """Linear maps between two centred spaces for several penalties, from one eigenvalue problem."""

    at: np.ndarray
    to: np.ndarray
    basis: np.ndarray
    values: np.ndarray
    targets: np.ndarray  # inputs turned into the basis, times outputs

    @classmethod
    def of(cls, sums: np.ndarray, inputs: int) -> Ridge:
        mean = sums[0, 1:] / sums[0, 0]
        centred = sums[1:, 1:] - sums[0, 0] * np.outer(mean, mean)
        values, basis = np.linalg.eigh(centred[:inputs, :inputs])
        return cls(mean[:inputs], mean[inputs:], basis, values, basis.T @ centred[:inputs, inputs:])

    def __call__(self, x: np.ndarray, penalty: float) -> np.ndarray:
        shrunk = ((x - self.at) @ self.basis) / (self.values + penalty * self.values.mean())
        return shrunk @ self.targets + self.to


def ridge_by_groups(df: DataFrame, x: str, y: str, group: str, parts: int = 5):
    """Ridge maps from x to y judged on groups they have not seen: rows with ``part`` and ``pred``, penalty, scores.

    Groups are dealt out over ``parts`` in hash order. Sums over everything but a part are the total less that part's,
    so the data is read once to fit and once to judge, for all parts and penalties. Rows whose boolean ``seen`` is
    false (part -1) take no part in fitting and are predicted from all seen rows.
    """
    names = df.filter("seen").select(group).distinct().withColumn("_h", H.rank_key("fold", F.col(group)))
    dealt = prefix(names, ["_h"], hash_bucket("_h"), rank="_r").select(group, F.pmod(F.col("_r") - 1, F.lit(parts)).cast("int").alias("_p"))
    d = df.join(dealt, group, "left").withColumn("part", F.when(F.col("seen"), F.col("_p")).otherwise(-1)).drop("_p")
    sums = _moments(d.filter("part >= 0"), [x, y], "part")
    whole = np.sum(list(sums.values()), axis=0)
    inputs = len(df.select(x).first()[0])
    maps = df.sparkSession.sparkContext.broadcast({-1: Ridge.of(whole, inputs)} | {k: Ridge.of(whole - v, inputs) for k, v in sums.items()})

    def mapped(xs: np.ndarray, part: np.ndarray, penalty: float) -> np.ndarray:
        order = np.argsort(part, kind="stable")
        pieces = [maps.value[int(part[run[0]])](xs[run], penalty) for run in np.split(order, np.flatnonzero(np.diff(part[order])) + 1)]
        return np.concatenate(pieces)[np.argsort(order, kind="stable")]

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in filter(len, batches):
            xs, ys = (np.array(b[c].tolist(), dtype=float) for c in (x, y))
            for i, penalty in enumerate(PENALTIES):
                ps = mapped(xs, b["part"].to_numpy(), penalty)
                lengths = np.sqrt(np.einsum("ij,ij->i", ps, ps) * np.einsum("ij,ij->i", ys, ys))
                yield pd.DataFrame({"i": [i], "total": [(np.einsum("ij,ij->i", ps, ys) / np.maximum(lengths, 1e-12)).sum()], "n": [len(b)]})

    by = d.filter("part >= 0").select(x, y, "part").mapInPandas(judged, "i int, total double, n bigint").groupBy("i").agg((F.sum("total") / F.sum("n")).alias("mean"))
    scores = {PENALTIES[r["i"]]: r["mean"] for r in by.collect()}
    chosen = max(scores, key=lambda k: (scores[k], k))

    @F.pandas_udf("array<double>")
    def pred(xs: pd.Series, part: pd.Series) -> pd.Series:
        return pd.Series(list(mapped(np.array(xs.tolist(), dtype=float), part.to_numpy(), chosen)))

    return d.withColumn("pred", pred(x, "part")), chosen, scores


# ---- batch losses --------------------------------------------------------------------------

def _log_sum(x: np.ndarray) -> np.ndarray:
    """Logarithm of the sum of exponentials of each row; rows of minus infinity stay so."""
    top = np.maximum(x.max(axis=1), -1e300)
    return top + np.log(np.maximum(np.exp(x - top[:, None]).sum(axis=1), 1e-300))


def _relation(teacher: np.ndarray, student: np.ndarray, others: np.ndarray) -> float:
    """Mean over rows of the divergence between the softmax of two similarity matrices over ``others``.

    With weights w of the teacher's row it is the expected difference of the two similarities less the difference of
    their log sums. Rows without others do not count.
    """
    some = others.any(axis=1)
    if not some.any():
        return 0.0
    t, s, m = teacher[some], student[some], others[some]
    lt, ls = (_log_sum(np.where(m, v, -np.inf)) for v in (t, s))
    w = np.where(m, np.exp(np.minimum(t - lt[:, None], 0.0)), 0.0)
    return float(((w * (t - s)).sum(axis=1) - lt + ls).mean())


def pair_losses(df: DataFrame, batch: str, relation: tuple[float, float] = (0.1, 0.1), contrast: float = 0.07) -> DataFrame:
    """Relation and contrastive losses per mini-batch; a batch has a fixed number of rows by construction.

    ``df`` has uid, student vector z, aligned teacher vector t, and centred unit teacher vector e. ``relation`` holds
    the temperatures of teacher and student. Rows with one uid never count as each other's negatives.
    """
    def losses(rows: pd.DataFrame) -> pd.DataFrame:
        z, t, e = (np.array(rows[c].tolist(), dtype=float) for c in "zte")
        z, t = (v / np.sqrt(np.einsum("ij,ij->i", v, v) + 1e-12)[:, None] for v in (z, t))
        apart = np.not_equal.outer(rows["uid"].to_numpy(), rows["uid"].to_numpy())
        both = z @ t.T / contrast
        own = np.diag(both)
        seen = np.where(apart | np.eye(len(own), dtype=bool), both, -np.inf)
        nce = (_log_sum(seen) + _log_sum(seen.T) - 2 * own).mean() / 2
        rkd = _relation(e @ e.T / relation[0], z @ z.T / relation[1], apart)
        return pd.DataFrame({"batch": [int(rows[batch].iloc[0])], "n": [len(rows)], "rkd": [rkd], "infonce": [float(nce)]})

    return df.groupBy(batch).applyInPandas(losses, "batch bigint, n bigint, rkd double, infonce double")

"""A categorical column with any number of levels in the linear family.

Its one-hot columns are never built.  Among themselves they have a diagonal Gram block (a row
has one level), so a context's whole ``Z' Z`` is the dense block of ``grams`` plus, for every
level, one row of sums of [1, x, y] over its training rows: a table keyed by level, however
many there are.  Ridge eliminates the levels exactly: with ``v`` a level's sums,
``Z' Z - sum of v v' / (n + alpha)`` is p x p, added up in the tasks and solved in one row; each
level's effect then follows from its own row.  Neither levels nor effects reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import join_stats, stats_table
from ..functions.ranks import salted_row_number
from ..session import staged
from . import grams
from .prep import FOLD_CTX


def _q(c):
    return F.col("`" + c.replace("`", "``") + "`")


def modes(df: DataFrame, env: str, wide: str, n_folds: int) -> DataFrame:
    """(env, k, mode): the most frequent level of each context's training rows, ties -> smallest; from counts by level and fold."""
    counts = df.select(_q(env).cast("string").alias("env"), F.col("fold").cast("int").alias("fold"), _q(wide).cast("string").alias("level"))
    counts = counts.where("env is not null and level is not null").groupBy("env", "fold", "level").agg(F.count(F.lit(1)).alias("n"))
    others = F.array_remove(F.sequence(F.lit(0), F.lit(n_folds - 1)), F.col("fold"))
    trained = counts.withColumn(FOLD_CTX, F.explode(others)).groupBy("env", FOLD_CTX, "level").agg(F.sum("n").alias("n"))
    return trained.groupBy("env", FOLD_CTX).agg(F.min(F.struct(-F.col("n"), "level")).alias("m")).select("env", FOLD_CTX, F.col("m.level").alias("mode"))


def level_sums(df: DataFrame, contexts: grams.Contexts, wide: str, mode: DataFrame) -> DataFrame:
    """(env, k, level, g): sums of [1, x, y] over the training rows of every level of every context.

    One scan; a batch hands on one row per context and level, so a hot level leaves a task as
    a few rows.  Missing values count for the training mode; without one they have no level.
    """
    width = len(contexts.columns) + 2

    def step(state, env, t, batch, num, cats):
        fold, y = batch.column("fold").to_numpy(), batch.column("y").to_numpy()
        coded = pc.dictionary_encode(batch.column("level"), null_encoding="encode")
        at = coded.indices.to_numpy()
        order = np.argsort(at, kind="stable")
        starts = np.flatnonzero(np.diff(at[order], prepend=-1))
        for k in t.of:
            z = np.column_stack([t.design(k, num, cats), y]) * (fold != k)[:, None]
            sums = np.add.reduceat(z[order], starts, axis=0)
            trained = np.flatnonzero(sums[:, 0] > 0)
            ends = pa.array(np.arange(len(trained) + 1, dtype=np.int32) * width)
            yield [env] * len(trained), [k] * len(trained), coded.dictionary.take(pa.array(trained)), pa.ListArray.from_arrays(ends, pa.array(sums[trained].ravel()))

    parts = grams.scan(df, contexts, step, "env string, k int, level string, g array<double>", [_q(wide).cast("string").alias("level")])
    named = join_stats(parts, mode, ["env", FOLD_CTX], "left").withColumn("level", F.coalesce("level", "mode")).where("level is not null")
    total = named.groupBy("env", FOLD_CTX, "level").agg(*(F.sum(F.col("g")[i]).alias(f"s{i}") for i in range(width)))
    return staged(total.select("env", FOLD_CTX, "level", F.array(*(F.col(f"s{i}") for i in range(width))).alias("g")), "levels")


def level_codes(levels: DataFrame) -> DataFrame:
    """(level, code): a 0-based number of every distinct level, in the order of MD5 and level; a table, numbered by parts."""
    keyed = levels.select("level").distinct().withColumn("_all", F.lit(0)).withColumn("_hk", F.md5("level"))
    return salted_row_number(keyed, ["_all"], "_hk", "level", out="code").select("level", (F.col("code") - 1).cast("long").alias("code"))


def ridge(gram: DataFrame, sums: DataFrame, alpha: float = 1.0, name: str = "ridge_wide") -> DataFrame:
    """(env, k, name, w): intercept and dense weights of ridge on dense and wide columns together.

    ``alpha`` must be positive: the levels' indicators add up to the intercept's column.
    """
    if not alpha > 0:
        raise ValueError("alpha must be positive")

    def outer(batches):
        state: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            g = np.array(batch.column("g").flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1)
            env, k = batch.column("env").dictionary_encode(), batch.column("k").to_numpy()
            ids = env.indices.to_numpy().astype(np.int64) << 32 | k
            for one in np.unique(ids):
                own, key = g[ids == one], (env.dictionary[int(one >> 32)].as_py(), int(one & 0xFFFFFFFF))
                state[key] = state.get(key, 0) + (own / (own[:, :1] + alpha)).T @ own
        for (env, k), s in state.items():
            yield pa.RecordBatch.from_pydict({"env": [env], "k": pa.array([k], pa.int32()), "s": [s.ravel()]})

    taken = grams.summed(sums.select("env", "k", "g").mapInArrow(outer, "env string, k int, s array<double>"), ["env", "k"], "s")

    def solved(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                a = grams.square(r["g"])
                if r["s"] is not None:
                    a = a - grams.square(r["s"])
                a[range(1, len(a) - 1), range(1, len(a) - 1)] += alpha
                out.append((r["env"], r["k"], name, np.linalg.lstsq(a[:-1, :-1], a[:-1, -1], rcond=None)[0]))
            columns = list(zip(*out)) or [[]] * 4
            types = (pa.string(), pa.int32(), pa.string(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], ["env", "k", "name", "w"])

    both = gram.where(f"side = {grams.TRAIN}").select("env", "k", "g").join(taken, ["env", "k"], "left")
    return staged(both.select("env", "k", "g", "s").mapInArrow(solved, "env string, k int, name string, w array<double>"), "fits")


def effects(sums: DataFrame, fits: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(env, k, level, effect): each level's ridge coefficient given the dense weights."""
    width = F.size("w")
    fitted = F.aggregate(F.zip_with(F.slice("g", 1, width), "w", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    rows = join_stats(sums, fits.select("env", FOLD_CTX, "w"), ["env", FOLD_CTX])
    return rows.select("env", FOLD_CTX, "level", ((F.element_at("g", -1) - fitted) / (F.col("g")[0] + F.lit(float(alpha)))).alias("effect"))


def oof(df: DataFrame, spec, n_folds: int, wide: str, alpha: float = 1.0) -> DataFrame:
    """M15 for ridge with a wide column: (row_id, env, fold, model, y_true, y_pred) of held-out rows.

    A missing level stands for the training mode; a level that training did not see adds nothing.
    """
    contexts = grams.fit(df, spec, n_folds)
    mode = stats_table(modes(df, spec.env, wide, n_folds))
    sums = level_sums(df, contexts, wide, mode)
    fits = ridge(grams.cells(df, contexts), sums, alpha)
    dense = grams.predict(df, contexts, fits, [wide])
    keys = [spec.env, "fold"]
    own = dense.withColumn("level", _q(wide).cast("string"))
    own = join_stats(own, mode.withColumnsRenamed({"env": spec.env, FOLD_CTX: "fold"}), keys, "left").withColumn("level", F.coalesce("level", "mode"))
    own = join_stats(own, effects(sums, fits, alpha).withColumnsRenamed({"env": spec.env, FOLD_CTX: "fold"}), [*keys, "level"], "left")
    return own.select(spec.row_id, spec.env, "fold", "model", "y_true", (F.col("y_pred") + F.coalesce("effect", F.lit(0.0))).alias("y_pred"))

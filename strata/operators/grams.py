"""Linear models on rows that stay where they are (survey IDs M01-M04, M15, M16, L06, L09, B10).

What a context (environment, k) is fitted with -- medians, caps, scales, modes and levels of
its training rows -- is one row of a small table.  One scan puts every row through the
parameters of all contexts of its environment inside the task and adds up ``Z' Z`` with
``Z = [1, x, y]``, apart for training rows (fold <> k) and validation rows (fold = k): p x p
numbers per context leave a task, never a row.  Fits, sums of squared errors, blends of
learners and leave-out statistics follow from these sums; rows are scanned again only for
what is not quadratic in them (absolute errors, classes, clipped predictions).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from ..spec import FeatureSpec
from . import models, prep
from . import score as feature_score
from .metrics import ordinal_metrics
from .prep import FOLD_CTX

# Numbers that the contexts' parameters may hold to be handed to every task; beyond, each row carries those of its environment.
HANDED_OUT = 5_000_000
# Levels of all categorical columns together that get a column of their own.
DENSE_LEVELS = 512

TRAIN, VALID = 0, 1


def _q(c):
    return F.col("`" + c.replace("`", "``") + "`")


@dataclass(frozen=True)
class Contexts:
    """Fitted contexts: ``table`` (env, k, num, modes, seen), the features in order and the levels that have columns."""

    spec: FeatureSpec
    n_folds: int
    table: DataFrame
    levels: dict[str, list[str]]

    @property
    def columns(self) -> list[str]:
        """Names of the design columns: the numeric features, then ``feature=level``."""
        return [*self.spec.num_cols, *(f"{f}={v}" for f, vs in self.levels.items() for v in vs)]

    @property
    def owners(self) -> list[str]:
        """The feature that each design column belongs to."""
        return [*self.spec.num_cols, *(f for f, vs in self.levels.items() for _ in vs)]


def fit(df: DataFrame, spec: FeatureSpec, n_folds: int, categorical: bool = True) -> Contexts:
    """The parameters of every context: T07's numeric statistics, modes and levels of the training rows.

    Levels get columns up to DENSE_LEVELS; more raise, since a dense Gram of that width would
    not fit a task.
    """
    env = spec.env
    stats = prep.fit_numeric(prep.long_numeric(df, spec), env, n_folds)
    five = F.array("median", "lower", "upper", "center", "scale")
    table = stats.groupBy(env, FOLD_CTX).agg(F.map_from_entries(F.collect_list(F.struct("feature", five.alias("s")))).alias("m"))
    table = table.select(env, FOLD_CTX, F.flatten(F.array(*(F.coalesce(F.col("m")[f], F.array(*[F.lit(None).cast("double")] * 5)) for f in spec.num_cols))).alias("num"))
    levels: dict[str, list[str]] = {}
    if categorical and spec.cat_cols:
        long = prep.long_categorical(df, spec, extra=("fold",))
        mode = prep.small_table(prep.fit_mode(long, env, n_folds))
        seen = prep.small_table(prep.fit_levels(long, mode, env, n_folds).select(env, FOLD_CTX, "feature", "level"))
        found = seen.select("feature", "level").distinct().orderBy("feature", "level").limit(DENSE_LEVELS + 1).collect()
        if len(found) > DENSE_LEVELS:
            raise ValueError(f"more than {DENSE_LEVELS} levels")
        levels = {c: [r["level"] for r in found if r["feature"] == c] for c in spec.cat_cols}
        by_feature = lambda t, value, name: t.groupBy(env, FOLD_CTX).agg(F.map_from_entries(F.collect_list(F.struct("feature", value.alias("v")))).alias(name))
        modes = by_feature(mode, F.col("mode"), "mo")
        lists = by_feature(seen.groupBy(env, FOLD_CTX, "feature").agg(F.collect_list("level").alias("ls")), F.col("ls"), "le")
        table = table.join(modes, [env, FOLD_CTX], "left").join(lists, [env, FOLD_CTX], "left")
        pick = lambda m, kind: F.array(*(F.coalesce(F.col(m)[c], F.lit(None).cast(kind)) for c in spec.cat_cols))
        table = table.select(env, FOLD_CTX, "num", pick("mo", "string").alias("modes"), pick("le", "array<string>").alias("seen"))
    else:
        table = table.withColumns({"modes": F.array().cast("array<string>"), "seen": F.array().cast("array<array<string>>")})
    return Contexts(spec, n_folds, staged(table, "contexts"), levels)


class _Transform:
    """An environment's contexts as matrices; ``design(k, ...)`` gives [1, x] of raw rows under context k."""

    def __init__(self, rows: list[dict], levels: dict[str, list[str]]):
        at, self.index = 0, []
        for vs in levels.values():
            self.index.append({v: at + i for i, v in enumerate(vs)})
            at += len(vs)
        self.width, self.of = at, {}
        for r in rows:
            num = np.array([np.nan if v is None else v for v in r["num"]], float).reshape(-1, 5).T
            mode = [ix.get(m, -2) for ix, m in zip(self.index, r["modes"])]
            seen = np.zeros(at, bool)
            for ix, vs in zip(self.index, r["seen"]):
                seen[[ix[v] for v in vs or () if v in ix]] = True
            self.of[r["k"]] = (*num, mode, seen)
        self.row = {r["k"]: r for r in rows}
        self.packed: dict[int, tuple] = {}

    def predictors(self, k: int) -> tuple:
        """Names, weights (a column each), biases and clip flags of the predictors of context k."""
        if k not in self.packed:
            own = self.row[k]["predictors"]
            self.packed[k] = [x["name"] for x in own], np.column_stack([x["w"] for x in own]), np.array([x["bias"] for x in own]), np.array([x["clipped"] for x in own], bool)
        return self.packed[k]

    def codes(self, cats: list[list]) -> list[np.ndarray]:
        """Column of each row's level, -1 for a missing one, -2 for one without a column."""
        return [np.array([-1 if v is None else ix.get(v, -2) for v in col], np.int64) for ix, col in zip(self.index, cats)]

    def design(self, k: int, num: np.ndarray, codes: list[np.ndarray]) -> np.ndarray:
        median, lower, upper, center, scale, mode, seen = self.of[k]
        n, p = num.shape
        z = np.zeros((n, 1 + p + self.width))
        z[:, 0] = 1.0
        x = np.where(np.isnan(num), median, num)
        z[:, 1:1 + p] = (np.maximum(lower, np.minimum(upper, x)) - center) / scale
        for code, m in zip(codes, mode):
            at = np.where(code == -1, m, code)
            rows = np.flatnonzero((at >= 0) & seen[np.maximum(at, 0)]) if self.width else []
            z[rows, 1 + p + at[rows]] = 1.0
        return z


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list<double> column as a matrix, null as NaN."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(-1, width) if width else np.zeros((len(column), 0))


def scan(df: DataFrame, contexts: Contexts, step: Callable, schema: str, extra: Sequence[Column] = (), finish: Callable | None = None, more: DataFrame | None = None) -> DataFrame:
    """One pass over ``df``: ``step(state, env, transform, batch, num, codes)`` per environment of a batch yields the
    columns of rows to hand on at once, and ``finish(state)`` gives those of a partition's end.

    ``batch`` has fold, y and the ``extra`` columns; ``more`` adds columns (env, k, ...) to the
    contexts, which ``transform.row[k]`` holds.  The contexts go to every task where they are
    bounded by HANDED_OUT numbers; otherwise each row brings its environment's.
    """
    spec, levels = contexts.spec, contexts.levels
    p, n_cat = len(spec.num_cols), len(levels)
    rows = df.select(_q(spec.env).cast("string").alias("env"), F.col("fold").cast("int").alias("fold"), _q(spec.target).cast("double").alias("y"), *extra,
                     F.array(*(_q(c).cast("double") for c in spec.num_cols)).cast("array<double>").alias("num"),
                     F.array(*(_q(c).cast("string") for c in levels)).cast("array<string>").alias("cats")).where("env is not null and y is not null")
    table = contexts.table.withColumnRenamed(spec.env, "env")
    if more is not None:
        table = staged(table.join(more, ["env", FOLD_CTX]), "contexts")
    numbers = F.lit(5 * p + 2 * sum(map(len, levels.values())) + 1) + (F.lit(0) if more is None else F.expr("aggregate(predictors, 0L, (n, x) -> n + size(x.w) + 2)"))
    known = (table.agg(F.sum(numbers)).first()[0] or 0) <= HANDED_OUT
    handed: dict[str, list[dict]] = {}
    if known:
        for r in table.collect():
            handed.setdefault(r["env"], []).append(r.asDict(recursive=True))
    else:
        own = table.groupBy("env").agg(F.collect_list(F.struct(*(c for c in table.columns if c != "env"))).alias("contexts"))
        rows = rows.join(own, "env")
    fields = [tuple(f.split(" ", 1)) for f in schema.split(", ")]

    def emitted(columns):
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=_ARROW[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])

    def run(batches):
        state, transforms = {}, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            names, at = np.unique(batch.column("env").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            for i, env in enumerate(names):
                part = batch.take(pa.array(np.flatnonzero(at == i)))
                if env not in transforms:
                    transforms[env] = _Transform(handed.get(env, []) if known else part.column("contexts")[0].as_py(), levels)
                cats, t = part.column("cats").flatten().to_pylist(), transforms[env]
                for columns in step(state, str(env), t, part, _matrix(part.column("num"), p), t.codes([cats[c::n_cat] for c in range(n_cat)])) or ():
                    yield emitted(columns)
        if finish is not None and state:
            yield emitted(finish(state))

    return rows.mapInArrow(run, schema)


_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}


def _keyed(state: dict) -> list[list]:
    """Columns of the keys of ``state`` and of its arrays."""
    return [*([k[i] for k in state] for i in range(len(next(iter(state))))), [np.asarray(v).ravel() for v in state.values()]]


def summed(parts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value): arrays added up element by element; partial sums are combined before the shuffle."""
    long = parts.select(*keys, F.posexplode(value).alias("pos", "v")).groupBy(*keys, "pos").agg(F.sum("v").alias("v"))
    return long.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("l")).select(*keys, F.transform("l", lambda x: x.v).alias(value))


def cells(df: DataFrame, contexts: Contexts, cell: Column | None = None, weight: Column | None = None) -> DataFrame:
    """(env, k, side, cell, g): sums of Z' Z (row by row) over the training (side 0) and validation rows (side 1) of every context.

    ``cell`` is a further additive split of the rows; a leave-out over cells is a subtraction.
    """
    cell = F.lit(0) if cell is None else cell
    weight = F.lit(1.0) if weight is None else weight

    def step(state, env, t, batch, num, cats):
        fold, y = batch.column("fold").to_numpy(), batch.column("y").to_numpy()
        own, w = batch.column("cell").to_numpy(), batch.column("w").to_numpy()
        for k in t.of:
            z = np.column_stack([t.design(k, num, cats), y])
            for c in np.unique(own):
                for side in (TRAIN, VALID):
                    rows = (own == c) & ((fold == k) == side)
                    if rows.any():
                        zr = z[rows]
                        state[env, k, side, int(c)] = state.get((env, k, side, int(c)), 0) + zr.T @ (zr * w[rows, None])

    parts = scan(df, contexts, step, "env string, k int, side int, cell int, g array<double>", [cell.cast("int").alias("cell"), weight.cast("double").alias("w")], _keyed)
    return staged(summed(parts, ["env", "k", "side", "cell"], "g"), "gram")


def square(g) -> np.ndarray:
    g = np.asarray(g, float)
    return g.reshape(int(round(len(g) ** 0.5)), -1)


def solve(g: np.ndarray, kind: str, active=None, **par) -> np.ndarray:
    """[intercept, weights] of one learner from Z' Z; ``active`` are the design columns that take part."""
    n, p = g[0, 0], len(g) - 2
    w = np.zeros(p + 1)
    if n <= 0:
        return w
    idx = np.arange(p) if active is None else np.asarray(sorted(active), int)
    mx, my = g[0, 1:-1] / n, g[0, -1] / n
    if len(idx):
        a = g[1:-1, 1:-1][np.ix_(idx, idx)] - n * np.outer(mx[idx], mx[idx])
        b = g[1:-1, -1][idx] - n * mx[idx] * my
        w[1 + idx] = models.solve_centred(a, b, n, kind, **par)
    w[0] = my - mx @ w[1:]
    return w


def errors(g: np.ndarray, w: np.ndarray) -> dict[str, float]:
    """What Z' Z says of the errors of predictions [1, x] w: n, sum and sum of squares of the target, the error and the squared error."""
    v = np.append(-w, 1.0)
    return {"n": g[0, 0], "sy": g[0, -1], "syy": g[-1, -1], "se": g[0] @ v, "see": v @ g @ v}


def predictions_gram(g: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Z' Z of [1, predictions, y] from that of [1, x, y]; ``w`` has a column of [intercept, weights] per learner."""
    p = len(g) - 2
    t = np.zeros((p + 2, w.shape[1] + 2))
    t[0, 0], t[:-1, 1:-1], t[-1, -1] = 1.0, w, 1.0
    return t.T @ g @ t


# Sums of one predictor's rows: n, y, y^2, e, e^2, |e|, hits, then 7 x 7 counts of (true, predicted) class.
_SUMS = ("n", "sy", "syy", "se", "see", "sae", "hits")


def _class(v: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(v, -3, 3)).astype(int) + 3


def listed(predictors: DataFrame) -> DataFrame:
    """(env, k, predictors) from rows (env, k, name, w[, bias, clipped])."""
    has = lambda c, default: F.col(c) if c in predictors.columns else F.lit(default).alias(c)
    return predictors.groupBy("env", FOLD_CTX).agg(F.collect_list(F.struct("name", "w", has("bias", 0.0), has("clipped", 0))).alias("predictors"))


def score(df: DataFrame, contexts: Contexts, predictors: DataFrame, tol: float = 0.5, by_fold: bool = False, side: int = VALID) -> DataFrame:
    """Metrics (V01, V04-V08) of linear predictors over the rows of one side of their contexts, without a row leaving its task.

    ``predictors``: (env, k, name, w, bias, clipped): the prediction is [1, x] w + bias, clipped
    to [-3, 3] where clipped = 1; a name has one such row per context.  Result: (env, name, [k],
    metrics); ``name`` stands for as many runs as share it.
    """
    def step(state, env, t, batch, num, cats):
        fold, y = batch.column("fold").to_numpy(), batch.column("y").to_numpy()
        for k in t.of:
            own = (fold == k) == side
            if not own.any():
                continue
            names, w, bias, clipped = t.predictors(k)
            pred = t.design(k, num[own], [c[own] for c in cats]) @ w + bias
            pred = np.where(clipped, np.clip(pred, -3, 3), pred)
            e, true, got = y[own, None] - pred, _class(y[own]), _class(pred)
            of_y = np.array([len(e), y[own].sum(), (y[own] ** 2).sum()])
            for i, name in enumerate(names):
                x = e[:, i]
                both = np.concatenate([of_y, [x.sum(), (x * x).sum(), np.abs(x).sum(), (np.abs(x) <= tol).sum()], np.bincount(7 * true + got[:, i], minlength=49)])
                at = (env, name, k if by_fold else 0)
                state[at] = state.get(at, 0) + both

    keys = ["env", "name", "k"]
    sums = staged(summed(scan(df, contexts, step, "env string, name string, k int, s array<double>", finish=_keyed, more=listed(predictors)), keys, "s"), "score")
    at = {x: F.element_at("s", i + 1) for i, x in enumerate(_SUMS)}
    n, var = at["n"], at["syy"] / at["n"] - (at["sy"] / at["n"]) * (at["sy"] / at["n"])
    reg = sums.select(*keys, F.sqrt(at["see"] / n).alias("RMSE"), (at["sae"] / n).alias("MAE"), F.when(var >= 1e-12, 1 - at["see"] / (var * n)).alias("R2"), (at["hits"] / n).alias("Accuracy"),
                      F.sqrt(F.greatest(F.lit(0.0), at["see"] / n - (at["se"] / n) * (at["se"] / n))).alias("Residual_STD"), (at["se"] / n).alias("MBE"))
    table = sums.select(*keys, F.posexplode(F.slice("s", len(_SUMS) + 1, 49)).alias("cell", "cnt")).where("cnt > 0")
    table = table.select(*keys, F.expr("cast(cell div 7 - 3 as int)").alias("tc"), F.expr("cast(cell % 7 - 3 as int)").alias("pc"), F.col("cnt").cast("long").alias("cnt"))
    out = reg.join(ordinal_metrics(None, keys, cont=staged(table, "classes")), keys)
    return out if by_fold else out.drop("k")


def predict(df: DataFrame, contexts: Contexts, predictors: DataFrame, carry: Sequence[str] = (), features: Callable | None = None) -> DataFrame:
    """(row_id, env, fold, model, y_true, y_pred) of every validation row under every predictor (env, k, name, w) of its context,
    with the columns ``carry`` of the row; weights may belong to ``features`` of the design rows instead of these."""
    spec = contexts.spec

    def step(state, env, t, batch, num, cats):
        fold, ids, y = batch.column("fold").to_numpy(), batch.column("row"), batch.column("y")
        for k in sorted(set(fold.tolist()) & set(t.of)):
            own = np.flatnonzero(fold == k)
            names, w, _, _ = t.predictors(k)
            z = t.design(k, num[own], [c[own] for c in cats])
            pred, own_ids, own_y = (z if features is None else features(z)) @ w, ids.take(pa.array(own)), y.take(pa.array(own))
            carried = [batch.column(f"carry{i}").take(pa.array(own)) for i in range(len(carry))]
            for i, name in enumerate(names):
                yield own_ids, [env] * len(own), np.full(len(own), k), [name] * len(own), own_y, pred[:, i], *carried

    kinds = dict(df.dtypes)
    schema = ", ".join([f"row {kinds[spec.row_id]}, env string, fold int, model string, y_true double, y_pred double", *(f"carry{i} {kinds[c]}" for i, c in enumerate(carry))])
    out = scan(df, contexts, step, schema, [_q(spec.row_id).alias("row"), *(_q(c).alias(f"carry{i}") for i, c in enumerate(carry))], more=listed(predictors))
    return out.withColumnsRenamed({"row": spec.row_id, "env": spec.env, **{f"carry{i}": c for i, c in enumerate(carry)}})


def fits(gram: DataFrame, learners: dict[str, dict]) -> DataFrame:
    """(env, k, name, w) of every learner on the training sums of every context; solved on executors, a context a row."""
    def run(batches):
        for batch in batches:
            out = [(r["env"], r["k"], name, solve(square(r["g"]), **par)) for r in batch.to_pylist() for name, par in learners.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(list(zip(*out)) or [[]] * 4, (pa.string(), pa.int32(), pa.string(), _ARROW["array<double>"]))], ["env", "k", "name", "w"])

    return gram.where(f"side = {TRAIN}").select("env", "k", "g").mapInArrow(run, "env string, k int, name string, w array<double>")


def oof(df: DataFrame, spec: FeatureSpec, n_folds: int, learners: dict[str, dict], weight: Column | None = None) -> DataFrame:
    """M15 for the linear family: (row_id, env, fold, model, y_true, y_pred) of held-out rows; one scan for the sums, one for the predictions."""
    contexts = fit(df, spec, n_folds)
    return predict(df, contexts, staged(fits(cells(df, contexts, weight=weight), learners), "fits"))


def importance(df: DataFrame, contexts: Contexts, predictors: DataFrame, pos: str | None, repeats: int = 3, seed: int = 42, tol: float = 0.5) -> DataFrame:
    """(env, k, model, feature, dR2, dMAE, dAcc) of linear predictors (env, k, name, w) on the validation rows.

    Every row meets ``repeats`` partners of its fold (``score.permuted_rows``; ``pos`` numbers all
    rows of a fold); without ``pos`` each feature has partners of its own
    (``score.shuffled_rows``).  A feature's values are taken from the partner, all columns of a
    categorical together; what that does to the errors is added up in the task.  Drops are
    floored at 0 and averaged over repeats.
    """
    spec = contexts.spec
    feats = [*spec.num_cols, *contexts.levels]
    if pos is None:
        rows = feature_score.shuffled_rows(df, [spec.env, "fold"], spec.row_id, [spec.target], list(spec.num_cols), list(contexts.levels), repeats, seed)
    else:
        rows = feature_score.permuted_rows(df, [spec.env, "fold"], pos, [spec.target], feats, repeats, seed)
    owners = np.array(contexts.owners)
    columns = {f: 1 + np.flatnonzero(owners == f) for f in feats}
    n_cat = len(contexts.levels)
    extra = [F.col("rep").cast("int").alias("rep"), F.array(*(_q(f"{c}_perm").cast("double") for c in spec.num_cols)).cast("array<double>").alias("num_perm"),
             F.array(*(_q(f"{c}_perm").cast("string") for c in contexts.levels)).cast("array<string>").alias("cats_perm")]

    def sums(e):
        return np.array([(e * e).sum(), np.abs(e).sum(), (np.abs(e) <= tol).sum()])

    def step(state, env, t, batch, num, cats):
        fold, rep, y = (batch.column(c).to_numpy() for c in ("fold", "rep", "y"))
        other = batch.column("cats_perm").flatten().to_pylist()
        num2, cats2 = _matrix(batch.column("num_perm"), len(spec.num_cols)), t.codes([other[c::n_cat] for c in range(n_cat)])
        for k in sorted(set(fold.tolist()) & set(t.of)):
            for r in range(repeats):
                own = (fold == k) & (rep == r)
                if not own.any():
                    continue
                z, moved = t.design(k, num[own], [c[own] for c in cats]), t.design(k, num2[own], [c[own] for c in cats2])
                names, w, _, _ = t.predictors(k)
                e, true = y[own, None] - z @ w, y[own]
                of_y = np.array([len(true), true.sum(), (true * true).sum()])
                for f, at in columns.items():
                    shift = (moved[:, at] - z[:, at]) @ w[at]
                    for i, name in enumerate(names):
                        key = (env, k, name, f, r)
                        state[key] = state.get(key, 0) + np.concatenate([of_y, sums(e[:, i]), sums(e[:, i] - shift[:, i])])

    keys = ["env", "k", "model", "feature", "rep"]
    parts = scan(rows, contexts, step, "env string, k int, model string, feature string, rep int, s array<double>", extra, _keyed, listed(predictors))
    s = [F.element_at("s", i + 1) for i in range(9)]
    sst = s[2] - s[1] * s[1] / s[0]
    floored = lambda c: F.avg(F.greatest(F.lit(0.0), c))
    drops = summed(parts, keys, "s").groupBy("env", "k", "model", "feature").agg(
        floored(F.when(sst > 0, (s[6] - s[3]) / sst)).alias("dR2"), floored((s[7] - s[4]) / s[0]).alias("dMAE"), floored((s[5] - s[8]) / s[0]).alias("dAcc"))
    return drops.withColumnRenamed("env", spec.env)

"""Regression, clustering, neighbours, trees: the data stay distributed, small sums go to the driver."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from stratalith.operators.order import cumsums
from stratalith.plans.session import cut


class LinearRegression:
    """Least squares by the normal equations; one pass for means and central products, so that no small sum of squares is a difference of large ones."""

    def __init__(self, df: DataFrame, predictors: list[str], response: str, intercept: bool = True):
        names = predictors + (["_one"] if intercept else [])
        d = df.where(" and ".join(f"`{c}` is not null" for c in predictors + [response]))
        given = predictors + [response]
        c = [F.col(g).cast("double") for g in given]
        pairs = [(i, j) for i in range(len(c)) for j in range(i, len(c))]
        row = d.agg(*(F.covar_pop(c[i], c[j]).alias(f"s{i}_{j}") for i, j in pairs), *(F.avg(x).alias(f"m{i}") for i, x in enumerate(c)), F.count("*").alias("n")).first()
        self.n, self.k, self.names, self.intercept, self.response = row.n, len(names), names, intercept, response
        central, p = np.zeros((len(c),) * 2), len(predictors)
        for i, j in pairs:
            central[i, j] = central[j, i] = (row[f"s{i}_{j}"] or 0.0) * self.n
        mean = np.array([row[f"m{i}"] or 0.0 for i in range(len(c))])
        raw = central + self.n * np.outer(mean, mean)
        ones = np.append(mean[:p], 1.0)
        self.xtx, self.xty, self.yty = raw[:p, :p], raw[:p, p], raw[p, p]
        if intercept:
            self.xtx = np.block([[self.xtx, self.n * mean[:p, None]], [self.n * ones]])
            self.xty = np.append(self.xty, self.n * mean[p])
        self.mean_y = float(mean[p]) if intercept else math.nan
        inverse = self._inverse(central[:p, :p]) if intercept and self.n else None
        if inverse is None:  # the shortest of the solutions
            self.pinv = np.linalg.pinv(self.xtx)
            self.coefficients = self.pinv @ self.xty
        else:
            slopes, turned = inverse @ central[:p, p], inverse @ mean[:p]
            self.pinv = np.block([[inverse, -turned[:, None]], [-turned, np.array([1 / self.n + mean[:p] @ turned])]])
            self.coefficients = np.append(slopes, mean[p] - slopes @ mean[:p])
        self.tss = float(central[p, p]) if intercept else float(self.yty)
        self.model_sum_of_squares = float(self.coefficients[:p] @ (central[:p, p] if intercept else self.xty))
        self.rss = self.tss - self.model_sum_of_squares

    @staticmethod
    def _inverse(central: np.ndarray) -> np.ndarray | None:
        """By the correlations, so that the predictors' scales don't matter; None where they depend on one another."""
        scale = np.sqrt(np.diag(central))
        if not (scale > 0).all():
            return None
        correlation = central / np.outer(scale, scale)
        return np.linalg.inv(correlation) / np.outer(scale, scale) if np.linalg.matrix_rank(correlation) == len(scale) else None

    def predict(self) -> Column:
        return sum((F.col(c) * float(b) if c != "_one" else F.lit(float(b)) for c, b in zip(self.names, self.coefficients)), F.lit(0.0))

    def r_squared(self) -> float:
        return 1 - self.rss / self.tss

    def adjusted_r_squared(self) -> float:
        return 1 - (1 - self.r_squared()) * (self.n - int(self.intercept)) / (self.n - self.k)

    def sigma(self) -> float:
        return math.sqrt(self.rss / (self.n - self.k))

    def vcov(self) -> np.ndarray:
        return self.pinv * self.sigma() ** 2

    def std_errors(self) -> np.ndarray:
        return np.sqrt(np.diag(self.vcov()))

    def t_stats(self) -> np.ndarray:
        return self.coefficients / self.std_errors()

    def f_stat(self) -> float:
        p = self.k - int(self.intercept)
        return self.model_sum_of_squares / p / (self.rss / (self.n - self.k))

    # degrees of freedom and sums of squares
    df_total = property(lambda m: m.n - int(m.intercept))
    df_model = property(lambda m: m.k - int(m.intercept))
    df_residual = property(lambda m: m.n - m.k)
    total_sum_of_squares = property(lambda m: m.tss)
    residual_sum_of_squares = property(lambda m: m.rss)
    mean_total = property(lambda m: m.tss / m.df_total)
    mean_model = property(lambda m: m.model_sum_of_squares / m.df_model)
    mean_residual = property(lambda m: m.rss / m.df_residual)

    def is_full_rank(self) -> bool:
        return int(np.linalg.matrix_rank(self.xtx)) == self.k

    def is_underdetermined(self) -> bool:
        return self.n < self.k

    def predictor_names(self) -> list[str]:
        return ["intercept" if c == "_one" else c for c in self.names]

    def named_coefficients(self) -> dict[str, float]:
        return dict(zip(self.predictor_names(), map(float, self.coefficients)))

    def slopes_and_intercept(self) -> tuple[np.ndarray, float]:
        return (self.coefficients[:-1], float(self.coefficients[-1])) if self.intercept else (self.coefficients, 0.0)

    def confidence_intervals(self, level: float = 0.95) -> list[tuple[float, float]]:
        from stratalith.functions.mathfn import t_quantile

        wide = t_quantile(0.5 + level / 2, self.df_residual) * self.std_errors()
        return [(float(b - w), float(b + w)) for b, w in zip(self.coefficients, wide)]

    def residual(self) -> Column:
        return F.col(self.response) - self.predict()

    def residuals(self, df: DataFrame, name: str = "residual") -> DataFrame:
        return df.withColumn(name, self.residual())

    def residual_quantiles(self, df: DataFrame, at: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
        """p, q: exact."""
        from stratalith.functions.stats import quantiles

        return quantiles(df.select(self.residual().alias("_e")), "_e", list(at))

    def residual_quantiles_estimate(self, df: DataFrame, buckets: int = 10_000) -> DataFrame:
        """One row of min, q1, median, q3, max from a histogram."""
        from stratalith.functions.stats import estimate_five

        return estimate_five(df.select(self.residual().alias("_e")), "_e", buckets)

    def residual_range(self, df: DataFrame) -> tuple[float, float]:
        return tuple(df.agg(F.min(self.residual()), F.max(self.residual())).first())

    def summary(self, spark) -> DataFrame:
        """name, estimate, std_error, t: a row for each coefficient."""
        rows = zip(self.predictor_names(), map(float, self.coefficients), map(float, self.std_errors()), map(float, self.t_stats()))
        return spark.createDataFrame(list(rows), "name string, estimate double, std_error double, t double")

    def anova(self, spark) -> DataFrame:
        """source, df, sum_of_squares, mean_square, f."""
        rows = [("model", self.df_model, self.model_sum_of_squares, self.mean_model, self.f_stat()), ("residual", self.df_residual, self.rss, self.mean_residual, None), ("total", self.df_total, self.tss, self.mean_total, None)]
        return spark.createDataFrame(rows, "source string, df long, sum_of_squares double, mean_square double, f double")

    def __str__(self) -> str:
        lines = [f"{n:>16} {b:14.6g} {e:14.6g} {t:10.4g}" for n, b, e, t in zip(self.predictor_names(), self.coefficients, self.std_errors(), self.t_stats())]
        return "\n".join([f"{'':>16} {'estimate':>14} {'std. error':>14} {'t':>10}", *lines, f"R squared {self.r_squared():.6g}, adjusted {self.adjusted_r_squared():.6g}, F {self.f_stat():.6g} on {self.df_model} and {self.df_residual}"])


def logistic_regression(df: DataFrame, predictors: list[str], target: str, ridge: float = 1.0, tol: float = 1e-6, rounds: int = 50, solver: str = "newton") -> np.ndarray:
    """Coefficients, the intercept last (it isn't shrunk); one distributed pass a step.

    solver: newton; majorization (steps by the fixed bound X'X / 4 on the
    curvature, many but cheap); trust_region (conjugate gradients within a radius
    that grows and shrinks with the model's success).
    """
    if solver not in ("newton", "majorization", "trust_region"):
        raise ValueError("solver: newton, majorization or trust_region")
    names = predictors + ["_one"]
    d, k = df.withColumn("_one", F.lit(1.0)), len(predictors) + 1
    b, penalty = np.zeros(k), np.diag([ridge] * (k - 1) + [1e-9])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def look(b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Penalised log-likelihood, gradient, curvature."""
        z = sum((F.col(c) * float(w) for c, w in zip(names, b)), F.lit(0.0))
        e = d.withColumn("_z", z).withColumn("_p", 1 / (1 + F.exp(-F.col("_z"))))
        weight = F.col("_p") * (1 - F.col("_p")) if solver != "majorization" else F.lit(0.25)
        loss = F.sum(F.col(target) * F.col("_z") - F.greatest(F.col("_z"), F.lit(0.0)) - F.log1p(F.exp(-F.abs("_z"))))
        r = e.agg(loss.alias("l"), *(F.sum((F.col(target) - F.col("_p")) * F.col(c)).alias(f"g{i}") for i, c in enumerate(names)), *(F.sum(weight * F.col(names[i]) * F.col(names[j])).alias(f"h{i}_{j}") for i, j in pairs)).first()
        h = np.zeros((k, k))
        for i, j in pairs:
            h[i, j] = h[j, i] = r[f"h{i}_{j}"]
        return r.l - b @ penalty @ b / 2, np.array([r[f"g{i}"] for i in range(k)]) - penalty @ b, h + penalty

    value, g, h = look(b)
    radius = 1.0
    for _ in range(rounds if solver != "majorization" else 100 * rounds):
        step = np.linalg.solve(h, g) if solver != "trust_region" else _bounded_step(h, g, radius)
        new = look(b + step)
        if solver == "trust_region":
            gain = (new[0] - value) / max(g @ step - step @ h @ step / 2, 1e-300)
            radius = radius * 2 if gain > 0.75 else radius / 4 if gain < 0.25 else radius
            if gain < 0 and np.abs(step).max() >= tol:
                continue
        b, (value, g, h) = b + step, new
        if np.abs(step).max() < tol:
            break
    return b


def _bounded_step(h: np.ndarray, g: np.ndarray, radius: float) -> np.ndarray:
    """Conjugate gradients for h x = g, stopped at the edge of the ball."""
    x, r = np.zeros_like(g), g.copy()
    p = r.copy()
    for _ in range(3 * len(g)):
        if np.abs(r).max() < 1e-12:
            break
        a = (r @ r) / (p @ h @ p)
        if np.linalg.norm(x + a * p) >= radius:
            pp, px, xx = p @ p, p @ x, x @ x
            return x + p * ((-px + math.sqrt(px * px + pp * (radius**2 - xx))) / pp)
        x, new = x + a * p, r - a * (h @ p)
        p = new + p * ((new @ new) / (r @ r))
        r = new
    return x


def logistic_classes(df: DataFrame, predictors: list[str], target: str, ridge: float = 1.0) -> dict:
    """Coefficients of each class against the others; for two classes one fit serves both."""
    classes = [r[0] for r in df.select(target).where(F.col(target).isNotNull()).distinct().orderBy(target).limit(1001).collect()]
    if not 2 <= len(classes) <= 1000:
        raise ValueError("2 to 1,000 classes are needed")
    fit = lambda c: logistic_regression(df.withColumn("_y", (F.col(target) == F.lit(c)).cast("double")), predictors, "_y", ridge)
    if len(classes) == 2:
        b = fit(classes[1])
        return {classes[0]: -b, classes[1]: b}
    return {c: fit(c) for c in classes}


def predict_class(models: dict, predictors: list[str]) -> Column:
    """The class of largest score (of equal ones the least class)."""
    score = lambda b: sum((F.col(c) * float(w) for c, w in zip(predictors, b)), F.lit(float(b[-1])))
    return F.array_min(F.array(*(F.struct((-score(b)).alias("s"), F.lit(c).alias("c")) for c, b in models.items())))["c"]


def kmeans(df: DataFrame, vector: str, k: int, rounds: int = 300, tol: float = 1e-4, seed: int = 0, starts: int = 10) -> tuple[np.ndarray, DataFrame, float]:
    """Centers, df with `cluster`, inertia: the best of several starts, which go on side by side.

    Starts come from the k-means++ rule over a sample of 2,000 rows. A step is one
    pass: every task adds up its rows' vectors by start and cluster, and only
    those sums are shuffled. Null vectors have no cluster.
    """
    v = F.transform(vector, lambda x: x.cast("double"))
    d = df.where(F.col(vector).isNotNull()).select(v.alias("v"))
    rng = np.random.default_rng(seed)
    sample = np.array([r[0] for r in d.orderBy(F.xxhash64("v"), "v").limit(2000).collect()])
    if not len(sample):
        raise ValueError("no vectors")
    dims, centers = sample.shape[1], []
    for _ in range(starts):
        c = [sample[rng.integers(len(sample))]]
        while len(c) < k:
            far = np.min([((sample - x) ** 2).sum(axis=1) for x in c], axis=0)
            c.append(sample[rng.choice(len(sample), p=far / far.sum() if far.sum() else None)])
        centers.append(np.array(c))
    centers, live, inertia = np.array(centers), list(range(starts)), np.full(starts, np.inf)

    def near(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dist = np.maximum((x**2).sum(1)[:, None] + (c**2).sum(1)[None] - 2 * x @ c.T, 0)
        at = dist.argmin(axis=1)
        return at, dist[np.arange(len(x)), at]

    def sums(centers: np.ndarray, which: list[int]):
        def run(batches):
            total, n, cost = np.zeros((len(which), k, dims)), np.zeros((len(which), k)), np.zeros((len(which), k))
            for b in batches:
                x = np.stack(b["v"].to_numpy()) if len(b) else np.zeros((0, dims))
                for j, w in enumerate(which):
                    at, far = near(x, centers[w])
                    total[j] += (at == np.arange(k)[:, None]).astype(float) @ x
                    n[j] += np.bincount(at, minlength=k)
                    cost[j] += np.bincount(at, far, minlength=k)
            rows = [(w, c, [*total[j, c], n[j, c], cost[j, c]]) for j, w in enumerate(which) for c in range(k)]
            yield pd.DataFrame(rows, columns=["w", "c", "s"])

        def together(batches):
            held: dict[tuple, np.ndarray] = {}
            for b in batches:
                for w, c, s in b.itertuples(index=False, name=None):
                    held[w, c] = held[w, c] + s if (w, c) in held else np.array(s)
            if held:
                yield pd.DataFrame([(w, c, s.tolist()) for (w, c), s in held.items()], columns=["w", "c", "s"])

        schema = "w int, c int, s array<double>"
        return d.mapInPandas(run, schema).repartition("w", "c").mapInPandas(together, schema).collect()

    for step in range(rounds + 1):
        new, cost = centers.copy(), np.zeros(starts)
        for r in sums(centers, live):
            *total, n, far = r.s
            cost[r.w] += far
            if n:
                new[r.w, r.c] = np.array(total) / n
        for w in live:
            inertia[w] = cost[w]
        if step == rounds:
            break
        moved = [w for w in live if np.abs(new[w] - centers[w]).max() >= tol]
        if not moved:
            break
        for w in moved:
            centers[w] = new[w]
        live = moved
    best = centers[int(np.argmin(inertia))]

    @F.pandas_udf("int")
    def label(x: pd.Series) -> pd.Series:
        out = np.full(len(x), -1)
        known = x.notna().to_numpy()
        if known.any():
            out[known] = near(np.stack(x[known].to_numpy()), best)[0]
        return pd.Series(out).where(known).astype("Int32")

    return best, df.withColumn("cluster", label(v)), float(inertia.min())


def nearest(points: DataFrame, queries: DataFrame, k: int, vector: str, key: str, block: int = 8192, distance: str = "l2") -> DataFrame:
    """key of each query, neighbour, distance, place: exact search of a stated set of queries, a block at a time.

    A block's vectors go to every task (block * dimensions numbers), which keeps
    the k best of each query over all its batches; only those are shuffled. There
    is one pass over the points for each block. distance: l2 or l1.
    """
    rows, parts, tile = queries.where(F.col(vector).isNotNull()).select(key, vector).toLocalIterator(), [], 256
    while True:
        some = [r for _, r in zip(range(block), rows)]
        if not some:
            break
        shared = points.sparkSession.sparkContext.broadcast((np.array([r[0] for r in some]), np.array([r[1] for r in some], float)))

        def run(batches, shared=shared):
            ids, q = shared.value
            held = [(np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64))]
            for b in batches:
                for at in range(0, len(b), 1024):
                    part = b.iloc[at : at + 1024]
                    x, n = np.stack(part["v"].to_numpy()).astype(float), part["n"].to_numpy()
                    out_d, out_n = np.empty((len(ids), min(k, held[0][0].shape[1] + len(x)))), np.empty((len(ids), min(k, held[0][0].shape[1] + len(x))), np.int64)
                    for lo in range(0, len(ids), tile):
                        y = q[lo : lo + tile]
                        d = np.abs(y[:, None] - x[None]).sum(axis=2) if distance == "l1" else np.sqrt(np.maximum((y**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * y @ x.T, 0))
                        d, m = np.hstack([held[0][0][lo : lo + tile], d]), np.hstack([held[0][1][lo : lo + tile], np.broadcast_to(n, (len(y), len(n)))])
                        best = np.lexsort((m, np.round(d, 9)), axis=1)[:, :k]
                        out_d[lo : lo + tile], out_n[lo : lo + tile] = np.take_along_axis(d, best, 1), np.take_along_axis(m, best, 1)
                    held[0] = (out_d, out_n)
            d, n = held[0]
            yield pd.DataFrame({"query": np.repeat(ids, d.shape[1]), "neighbour": n.ravel(), "distance": d.ravel()})

        parts.append(points.where(F.col(vector).isNotNull()).select(F.col(key).alias("n"), F.col(vector).alias("v")).mapInPandas(run, "query long, neighbour long, distance double"))
    if not parts:
        raise ValueError("no queries")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = Window.partitionBy("query").orderBy(F.round("distance", 9), "neighbour")
    return out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


class Neighbours:
    """k nearest neighbours as a predictor; with_() gives a copy with another setting."""

    def __init__(self, points: DataFrame, vector: str, key: str, target: str, k: int = 5, distance: str = "l2"):
        self.points, self.vector, self.key, self.target, self.k, self.distance = points, vector, key, target, k, distance

    def with_(self, **changes) -> Neighbours:
        now = {n: getattr(self, n) for n in ("points", "vector", "key", "target", "k", "distance")}
        return Neighbours(**(now | changes))

    def _seen(self, queries: DataFrame) -> DataFrame:
        n = nearest(self.points, queries, self.k, self.vector, self.key, distance=self.distance)
        t = self.points.select(F.col(self.key).alias("neighbour"), F.col(self.target).alias("y"))
        return n.join(t, "neighbour")

    def probabilities(self, queries: DataFrame) -> DataFrame:
        """query, y, p: the share of each class among the neighbours."""
        return self._seen(queries).groupBy("query", "y").agg((F.count("*") / self.k).alias("p"))

    def classify(self, queries: DataFrame) -> DataFrame:
        """query, predicted: the most frequent class, of equal ones the least."""
        return self.probabilities(queries).groupBy("query").agg(F.min(F.struct(-F.col("p"), "y"))["y"].alias("predicted"))

    def regress(self, queries: DataFrame) -> DataFrame:
        """query, predicted: the neighbours' mean."""
        return self._seen(queries).groupBy("query").agg(F.avg("y").alias("predicted"))

    def accuracy(self, queries: DataFrame) -> float:
        truth = queries.select(F.col(self.key).alias("query"), F.col(self.target).alias("y"))
        return self.classify(queries).join(truth, "query").agg(F.avg((F.col("predicted") == F.col("y")).cast("double"))).first()[0]


def target_encode(df: DataFrame, category: str, target: Column, name: str) -> DataFrame:
    """df with the mean of the target in each row's category."""
    return df.join(df.groupBy(category).agg(F.avg(target.cast("double")).alias(name)), category)


class RegressionTree:
    """A tree grown level by level, all nodes of a level at once.

    split: histogram (each feature over each node's rows in `buckets` equal parts
    of their range, made again at every node) or exhaustive (every distinct
    value; running sums go by ranges, so no task holds a node's values). The best
    split of equal ones is that of the first feature and the least value. Rows
    with a null feature go to the right; a null target is no training row.
    """

    def __init__(self, df: DataFrame, features: list[str], target: str, max_depth: int = 3, min_split: int = 2, split: str = "histogram", buckets: int = 10_000):
        if split not in ("histogram", "exhaustive"):
            raise ValueError("split: histogram or exhaustive")
        self.features, self.buckets, self.split, self.min_split = features, buckets, split, min_split
        df = df.where(F.col(target).isNotNull()).select(*features, F.col(target).cast("double").alias("_y"))
        self.nodes: dict[int, tuple] = {0: ("leaf", float(df.agg(F.avg("_y")).first()[0] or 0.0))}
        self.gain, live = dict.fromkeys(features, 0.0), [0]
        for _ in range(max_depth):
            grown = []
            for r in self._best(df.withColumn("_node", self._place()).where(F.col("_node").isin(live))):
                self.gain[features[r.f]] += r.g
                self.nodes[r._node] = ("split", features[r.f], r.v)
                self.nodes[2 * r._node + 1], self.nodes[2 * r._node + 2] = ("leaf", r.left), ("leaf", r.right)
                grown += [2 * r._node + 1, 2 * r._node + 2]
            live = grown
            if not live:
                break

    def _best(self, d: DataFrame) -> list:
        """One row a node: feature, value, gain and the means on either side of its best split."""
        one = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("x")) for i, c in enumerate(self.features)))).alias("e")
        flat = d.select("_node", "_y", one).select("_node", "e.f", "e.x", "_y").where("x is not null and not isnan(x)")
        if self.split == "histogram":
            edges = d.groupBy("_node").agg(*(F.struct(F.min(c).cast("double"), F.max(c).cast("double")).alias(f"e{i}") for i, c in enumerate(self.features))).collect()
            rows = [(r._node, i, r[f"e{i}"][0], r[f"e{i}"][1]) for r in edges for i in range(len(self.features)) if r[f"e{i}"][0] is not None]
            if not rows:
                return []
            span = F.broadcast(d.sparkSession.createDataFrame(rows, "_node int, f int, lo double, hi double"))  # a row for each node and feature
            part = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * self.buckets), F.lit(self.buckets - 1))).otherwise(0)
            g = flat.join(span, ["_node", "f"]).groupBy("_node", "f", part.alias("b")).agg(F.max("x").alias("x"), F.count("*").alias("n"), F.sum("_y").alias("s"))
            w = Window.partitionBy("_node", "f").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)  # `buckets` rows at most
            g = g.withColumns({"_n": F.sum("n").over(w), "_s": F.sum("s").over(w)})
        else:
            g = flat.groupBy("_node", "f", "x").agg(F.count("*").alias("n"), F.sum("_y").alias("s"))
            g = cumsums(g, ["n", "s"], "_node", "f", "x")
            first = F.min(F.struct("x", (F.col("_n") - F.col("n")).alias("n0"), (F.col("_s") - F.col("s")).alias("s0"))).alias("m")
            g = g.join(F.broadcast(g.groupBy("_node", "f").agg(first)), ["_node", "f"]).withColumns({"_n": F.col("_n") - F.col("m.n0"), "_s": F.col("_s") - F.col("m.s0")})
        whole = d.groupBy("_node").agg(F.count("*").alias("n_all"), F.sum("_y").alias("s_all"))
        g = g.join(F.broadcast(whole), "_node").where((F.col("_n") < F.col("n_all")) & (F.col("n_all") >= self.min_split))
        left, right = F.col("_s") / F.col("_n"), (F.col("s_all") - F.col("_s")) / (F.col("n_all") - F.col("_n"))
        gain = left * F.col("_s") + right * (F.col("s_all") - F.col("_s")) - F.col("s_all") * F.col("s_all") / F.col("n_all")
        best = F.min(F.struct((-gain).alias("g"), "f", F.col("x").alias("v"), left.alias("left"), right.alias("right"))).alias("m")
        out = g.groupBy("_node").agg(best).select("_node", (-F.col("m.g")).alias("g"), "m.f", "m.v", "m.left", "m.right")
        return out.where("g > 1e-9").collect()

    def _walk(self, node: int, leaf) -> Column:
        x = self.nodes[node]
        if x[0] == "leaf":
            return leaf(node, x[1])
        return F.when(F.col(x[1]) <= x[2], self._walk(2 * node + 1, leaf)).otherwise(self._walk(2 * node + 2, leaf))

    def _place(self) -> Column:
        return self._walk(0, lambda n, v: F.lit(n))

    def predict(self) -> Column:
        return self._walk(0, lambda n, v: F.lit(v))

    def refit(self, df: DataFrame, value: Column) -> None:
        """Give each leaf another aggregate of its rows as its value."""
        for r in df.groupBy(self._place().alias("n")).agg(value.cast("double").alias("v")).collect():
            self.nodes[r.n] = ("leaf", float(r.v))

    def importances(self) -> dict[str, float]:
        total = sum(self.gain.values()) or 1.0
        return {f: g / total for f, g in self.gain.items()}

    def score(self, df: DataFrame, target: str) -> float:
        return r_squared(df, F.col(target), self.predict())


def r_squared(df: DataFrame, y: Column, predicted: Column) -> float:
    r = df.agg(F.sum((y - predicted) * (y - predicted)), F.var_pop(y) * F.count(y)).first()
    return 1 - r[0] / r[1]


def accuracy(df: DataFrame, y: Column, predicted: Column) -> float:
    return df.agg(F.avg((y == predicted).cast("double"))).first()[0]


class GradientBoosting:
    """Boosted regression trees: l2 or absolute loss, or binomial for a 0/1 target.

    The running score is a column of a frame that is cut off after each boost,
    so plans don't grow; next() goes on where a fit left off.
    """

    def __init__(self, df: DataFrame, features: list[str], target: str, loss: str = "l2", boosts: int = 100, max_depth: int = 3, rate: float = 1.0, split: str = "histogram", buckets: int = 10_000):
        if loss not in ("l2", "absolute", "binomial"):
            raise ValueError("loss: l2, absolute or binomial")
        self.features, self.loss, self.depth, self.rate, self.how, self.trees = features, loss, max_depth, rate, {"split": split, "buckets": buckets}, []
        y = F.col(target).cast("double")
        d = df.where(F.col(target).isNotNull()).select(*features, y.alias("_t"))
        start = self._median(d.select(F.col("_t").alias("_r"))) if loss == "absolute" else d.agg(F.avg("_t")).first()[0]
        self.start = float(math.log(max(start, 1e-9) / max(1 - start, 1e-9)) if loss == "binomial" else start)
        self.now = cut(d.withColumn("_f", F.lit(self.start)))
        for _ in range(boosts):
            self.next()

    @staticmethod
    def _median(d: DataFrame) -> float:
        from stratalith.functions.stats import quantiles

        return quantiles(d, "_r", [0.5]).first().q

    def next(self) -> RegressionTree:
        """One boost more."""
        y, f = F.col("_t"), F.col("_f")
        miss = {"l2": y - f, "absolute": F.signum(y - f), "binomial": y - 1 / (1 + F.exp(-f))}[self.loss]
        d = self.now.withColumn("_g", miss)
        tree = RegressionTree(d, self.features, "_g", self.depth, **self.how)
        if self.loss == "absolute":
            tree.refit(d, F.percentile_approx(y - f, F.lit(0.5), F.lit(1_000_000)))
        elif self.loss == "binomial":  # one Newton step
            p = 1 / (1 + F.exp(-f))
            tree.refit(d, F.sum("_g") / F.greatest(F.sum(p * (1 - p)), F.lit(1e-9)))
        self.trees.append(tree)
        self.now = cut(self.now.withColumn("_f", f + tree.predict() * self.rate))
        return tree

    def score_column(self) -> Column:
        return sum((t.predict() * self.rate for t in self.trees), F.lit(self.start))

    def predict(self) -> Column:
        """The value; for binomial loss the probability of 1."""
        return 1 / (1 + F.exp(-self.score_column())) if self.loss == "binomial" else self.score_column()

    def importances(self) -> dict[str, float]:
        total = {f: sum(t.gain[f] for t in self.trees) for f in self.features}
        return {f: g / (sum(total.values()) or 1.0) for f, g in total.items()}

    def deviance(self, df: DataFrame, target: str) -> float:
        """Mean binomial deviance."""
        p, y = self.predict(), F.col(target).cast("double")
        return -2 * df.agg(F.avg(y * F.log(p) + (1 - y) * F.log1p(-p))).first()[0]


class BoostedClassifier:
    """Boosted trees for any number of classes: softmax of one score a class, one tree a class and boost."""

    def __init__(self, df: DataFrame, features: list[str], target: str, boosts: int = 100, max_depth: int = 3, rate: float = 1.0, split: str = "histogram", buckets: int = 10_000):
        self.classes = [r[0] for r in df.select(target).where(F.col(target).isNotNull()).distinct().orderBy(target).limit(1001).collect()]
        if not 2 <= len(self.classes) <= 1000:
            raise ValueError("2 to 1,000 classes are needed")
        self.rate, k = rate, len(self.classes)
        self.trees: list[list[RegressionTree]] = []
        at = F.array_position(F.array(*map(F.lit, self.classes)), F.col(target)) - 1
        now = cut(df.where(F.col(target).isNotNull()).select(*features, at.alias("_c"), F.array(*[F.lit(0.0)] * k).alias("_f")))
        for _ in range(boosts):
            top = F.array_max("_f")
            e = F.transform("_f", lambda x: F.exp(x - top))
            p = F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))
            d, round_ = cut(now.withColumn("_p", p)), []
            for c in range(k):
                g = d.withColumn("_g", (F.col("_c") == c).cast("double") - F.col("_p")[c])
                tree = RegressionTree(g, features, "_g", max_depth, split=split, buckets=buckets)
                tree.refit(g, F.sum("_g") * ((k - 1) / k) / F.greatest(F.sum(F.abs("_g") * (1 - F.abs("_g"))), F.lit(1e-9)))
                round_.append(tree)
            self.trees.append(round_)
            now = cut(d.withColumn("_f", F.array(*(F.col("_f")[c] + t.predict() * rate for c, t in enumerate(round_)))).drop("_p"))

    def scores(self) -> Column:
        return F.array(*(sum((r[c].predict() * self.rate for r in self.trees), F.lit(0.0)) for c in range(len(self.classes))))

    def probabilities(self) -> Column:
        s = self.scores()
        e = F.transform(s, lambda x: F.exp(x - F.array_max(s)))
        return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))

    def predict(self) -> Column:
        s = self.scores()
        return F.element_at(F.array(*map(F.lit, self.classes)), F.array_position(s, F.array_max(s)).cast("int"))


class SupportVectors:
    """Kernel machines by dual coordinate ascent: classes (of two) or, with epsilon, values.

    The kernel matrix is held on the driver, so training takes at most `most`
    rows and is an error beyond; prediction is distributed, in Arrow batches. The
    offset is a part of the kernel (a one is added), as is usual for this method.
    """

    def __init__(self, df: DataFrame, features: list[str], target: str, kernel: str = "rbf", c: float = 1.0, gamma: float = 1.0, epsilon: float | None = None, rounds: int = 200, most: int = 5000):
        if kernel not in ("rbf", "linear"):
            raise ValueError("kernel: rbf or linear")
        rows = df.where(" and ".join(f"`{x}` is not null" for x in [*features, target])).select(*features, target).limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} training rows")
        rows = sorted(map(tuple, rows))
        self.features, self.kernel, self.gamma, self.epsilon = features, kernel, gamma, epsilon
        self.x = np.array([r[:-1] for r in rows], float)
        self.classes = None if epsilon is not None else sorted({r[-1] for r in rows})
        if self.classes is not None and len(self.classes) != 2:
            raise ValueError("two classes are needed")
        y = np.array([r[-1] if epsilon is not None else (1.0 if r[-1] == self.classes[1] else -1.0) for r in rows], float)
        q = self._k(self.x)
        self.a, f = np.zeros(len(y)), np.zeros(len(y))
        for _ in range(rounds):
            moved = 0.0
            for i in range(len(y)):
                if epsilon is None:  # maximise sum(b) - b y K y b / 2 for b in [0, c]; a = b y
                    new = y[i] * min(max(y[i] * self.a[i] + (1 - y[i] * f[i]) / q[i, i], 0.0), c)
                else:  # epsilon-insensitive: a in [-c, c], soft threshold
                    z = self.a[i] * q[i, i] + y[i] - f[i]
                    new = float(np.clip(np.sign(z) * max(abs(z) - epsilon, 0.0) / q[i, i], -c, c))
                if new != self.a[i]:
                    f += q[i] * (new - self.a[i])
                    moved, self.a[i] = max(moved, abs(new - self.a[i])), new
            if moved < 1e-6:
                break
        keep = self.a != 0
        self.x, self.a = self.x[keep], self.a[keep]

    def _k(self, z: np.ndarray) -> np.ndarray:
        if self.kernel == "linear":
            return z @ self.x.T + 1
        return np.exp(-self.gamma * np.maximum((z**2).sum(1)[:, None] + (self.x**2).sum(1)[None] - 2 * z @ self.x.T, 0)) + 1

    def decision(self) -> Column:
        me = self

        @F.pandas_udf("double")
        def run(t: pd.DataFrame) -> pd.Series:
            z = t.to_numpy(float)
            return pd.Series(np.concatenate([me._k(z[lo : lo + 4096]) @ me.a for lo in range(0, len(z), 4096)] or [np.zeros(0)]))

        return run(F.struct(*(F.col(c).cast("double").alias(c) for c in self.features)))

    def predict(self) -> Column:
        return self.decision() if self.classes is None else F.when(self.decision() > 0, F.lit(self.classes[1])).otherwise(F.lit(self.classes[0]))

"""Learning jobs: what grows with the data stays distributed; the driver only holds parameters."""

from __future__ import annotations

import base64
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.sources.mapping import ACTIONS
from tracewell.sources.staging import stage
from tracewell.streaming.folds import SCALE

WORD_SIZE, WORD_WINDOW, SEED = 64, 3, 23
KINDS = list(SCALE)


# --- word vectors -------------------------------------------------------------------------------------------------


def sentences(flow: DataFrame, words: DataFrame) -> DataFrame:
    """words: the tokens of each event's source, its action and the tokens of its destination; ``words`` has node_id and tokens."""
    own = words.select("node_id", "tokens")
    src, dst = (own.select(F.col("node_id").alias(f"info_{x}"), F.col("tokens").alias(f"{x}_tokens")) for x in ("src", "dst"))
    rows = flow.select("info_src", "info_dst", "action").join(src, "info_src").join(dst, "info_dst")
    return rows.select(F.concat("src_tokens", F.array(F.lower("action")), "dst_tokens").alias("words"))


def fit_word2vec(lines: DataFrame, size: int = WORD_SIZE, window: int = WORD_WINDOW, seed: int = SEED) -> DataFrame:
    """token and its vector, learned on ``lines`` (words); the token for unknown words is learned from a line of its own."""
    spark = lines.sparkSession
    lines = lines.unionByName(spark.createDataFrame([(["<unk>"],)], "words array<string>"))
    parts = max(1, spark.sparkContext.defaultParallelism // 2)
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=1, maxIter=1, seed=seed, inputCol="words", outputCol="v", numPartitions=parts).fit(lines)
    return model.getVectors().select(F.col("word").alias("token"), vector_to_array("vector").alias("embedding"))


def used_words(flow: DataFrame, words: DataFrame) -> DataFrame:
    """The words of the nodes that events touch."""
    used = flow.select(F.explode(F.array("info_src", "info_dst")).alias("node_id")).distinct()
    return words.join(used, "node_id", "left_semi")


def action_words(flow: DataFrame) -> DataFrame:
    return flow.select("action").distinct().select("action", F.array(F.lower("action")).alias("tokens"))


def word_bags(tokens: DataFrame, vectors: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """key and the number of its bag of words; and each bag's number with the unit mean of its words' vectors.

    Equal bags have one vector, which is computed once and needn't be carried by what has it. Unknown tokens take the vector of ``<unk>``.
    """
    words = F.array_sort(F.transform(F.flatten(F.collect_list("tokens")), lambda t: F.coalesce(t, F.lit("<unk>"))))
    rows = stage(tokens.where("size(tokens) > 0").groupBy(key).agg(words.alias("__bag")), "bags-of")
    bags = stage(rows.select("__bag").distinct().withColumn("bag", F.monotonically_increasing_id()), "bags")
    each = bags.select("bag", F.explode("__bag").alias("token"))
    known = each.join(vectors.select(F.col("token").alias("t")), F.col("token") == F.col("t"), "left").select("bag", F.coalesce("t", F.lit("<unk>")).alias("token"))
    counted = known.groupBy("bag", "token").agg(F.count("*").cast("double").alias("count"))
    mean = counted.join(vectors, "token").groupBy("bag").agg(Summarizer.mean(array_to_vector("embedding"), F.col("count")).alias("m")).select("bag", vector_to_array("m").alias("m"))
    norm = F.sqrt(F.aggregate("m", F.lit(0.0), lambda a, x: a + x * x))
    units = mean.withColumn("norm", norm).select("bag", F.when(F.col("norm") > 1e-8, F.transform("m", lambda x: x / F.col("norm"))).otherwise(F.col("m")).alias("embedding"))
    return rows.join(bags, "__bag").select(key, "bag"), stage(units, "bag-vectors")


def mean_vectors(tokens: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """The unit mean of each row's token vectors; unknown tokens take the vector of ``<unk>``."""
    of, bags = word_bags(tokens, vectors, key)
    return of.join(bags, "bag").select(key, "embedding")


# --- heads ----------------------------------------------------------------------------------------------------------


def summed(df: DataFrame, part: Callable[[pd.DataFrame], np.ndarray], size: int) -> np.ndarray:
    """The sum over all batches of an array of ``size`` numbers; it is added up in Spark, place by place."""

    def run_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for pdf in batches:
            if len(pdf):
                total += part(pdf)
        yield pd.DataFrame({"a": [total]})

    rows = df.mapInPandas(run_, "a array<double>").select(F.posexplode("a").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in rows:
        out[r["i"]] = r["v"]
    return out


def packed_sum(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, total.size], pa.int32()), pa.array(total))], names=["a"])


def summed_rows(df: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """As ``summed``, over Arrow batches; each task sends its sum packed, and sums of tasks are added up by place in Spark."""

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += part(b)
        yield packed_sum(total)

    return added_up(df.mapInArrow(run_, "a array<double>"), size)


def added_up(totals: DataFrame, size: int) -> np.ndarray:
    """The sum of the arrays ``a`` of ``size`` numbers, one from each task, place by place in Spark."""
    rows = totals.select(F.posexplode("a").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[rows.column("i").to_numpy()] = rows.column("v").to_numpy()
    return out


def matrix(column: pa.Array) -> np.ndarray:
    """A column of arrays of one length, or of such arrays packed in single precision."""
    if is_packed(column):
        size = np.int64 if pa.types.is_large_binary(column.type) else np.int32
        _, offsets, values = column.buffers()
        at = np.frombuffer(offsets, size)[column.offset : column.offset + len(column) + 1]
        return np.frombuffer(values, np.float32, (at[-1] - at[0]) // 4, at[0]).reshape(len(column), -1).astype(float)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def packed(v: np.ndarray) -> pa.Array:
    """Rows in single precision, for ``matrix``."""
    of = np.ascontiguousarray(v, np.float32)
    return pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(np.arange(len(of) + 1, dtype=np.int32) * 4 * of.shape[1]), pa.py_buffer(of)])


class Kept:
    """A task's rows of x and y, in a file that has no name and ends with the task: an epoch reads it block by block. Packed rows stay in single precision."""

    def __init__(self):
        self.file, self.inputs, self.outputs, self.rows, self.type = tempfile.TemporaryFile(), 0, 0, 0, np.float64

    def add(self, x: np.ndarray, y: np.ndarray, single: bool) -> None:
        self.inputs, self.outputs, self.type = x.shape[1], y.shape[1], np.float32 if single else np.float64
        self.file.write(np.column_stack((x, y)).astype(self.type).tobytes())
        self.rows += len(x)

    def blocks(self, size: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        width = self.inputs + self.outputs
        self.file.seek(0)
        while self.rows and (read := self.file.read(size * width * np.dtype(self.type).itemsize)):
            z = np.frombuffer(read, self.type).reshape(-1, width).astype(float)
            yield z[:, : self.inputs], z[:, self.inputs :]


def gathered(v: np.ndarray) -> list[np.ndarray]:
    """The numbers of all tasks of a barrier stage, in their order, once each task has given its own."""
    from pyspark import BarrierTaskContext

    return [np.frombuffer(base64.b64decode(m)) for m in BarrierTaskContext.get().allGather(base64.b64encode(np.asarray(v, float).tobytes()).decode())]


def learned_together(rows: DataFrame, learn: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None]) -> np.ndarray | None:
    """What ``learn`` finds over ``rows``, which are dealt once to as many tasks as run at a time; they go through the epochs together.

    Tasks keep their rows (``Kept``) and tell each other sums (``gathered``), which don't grow with the rows, so an epoch neither starts a job nor
    reads or sends rows. All tasks find the same. Tasks must run at the same time (a barrier stage): with dynamic allocation Spark refuses it.
    """
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    dealt = rows.withColumn("__i", F.monotonically_increasing_id()).repartition(tasks, "__i").drop("__i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import BarrierTaskContext

        found = learn(b for b in batches if b.num_rows)
        if found is not None and BarrierTaskContext.get().partitionId() == 0:
            yield packed_sum(found)

    got = dealt.mapInArrow(run, "a array<double>", barrier=True).collect()
    return np.array(got[0]["a"]) if got else None


def is_packed(column: pa.Array) -> bool:
    return pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)


def adam_step(parameters: list[np.ndarray], g: np.ndarray, moments: list[tuple[np.ndarray, np.ndarray]], t: int, rate: float, most: float = 5.0) -> None:
    """The ``t``-th Adam step of all parameters, in place, along a gradient summed over g[1] rows, whose mean is clipped to the norm ``most``."""
    grads, at = [], 2
    for p in parameters:
        grads.append(g[at : at + p.size].reshape(p.shape) / g[1])
        at += p.size
    clip = min(1.0, most / max(np.sqrt(sum((x * x).sum() for x in grads)), 1e-12))
    for p, x, (m, v) in zip(parameters, grads, moments):
        m += 0.1 * (clip * x - m)
        v += 0.001 * ((clip * x) ** 2 - v)
        p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)


@dataclass
class Moments:
    """What least squares needs of rows of x and y: their number, sums and products, which don't grow with the rows."""

    n: float
    x: np.ndarray
    y: np.ndarray
    xx: np.ndarray
    xy: np.ndarray
    yy: float

    @staticmethod
    def size(p: int, q: int) -> int:
        return (1 + p + q) ** 2

    @staticmethod
    def part(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = np.column_stack((np.ones(len(x)), x, y))
        return (z.T @ z).ravel()

    @classmethod
    def unpacked(cls, sums: np.ndarray, p: int, q: int) -> Moments:
        g = sums.reshape(1 + p + q, 1 + p + q)
        return cls(g[0, 0], g[0, 1 : p + 1], g[0, p + 1 :], g[1 : p + 1, 1 : p + 1], g[1 : p + 1, p + 1 :], float(np.trace(g[p + 1 :, p + 1 :])))

    @classmethod
    def of(cls, data: DataFrame | Moments) -> Moments:
        """Of x and y in one pass; moments are taken as they are."""
        if isinstance(data, Moments):
            return data
        first = data.first()
        if first is None:
            raise ValueError("there are no rows to learn from")
        p, q = len(first["x"]), len(first["y"])
        return cls.unpacked(summed_rows(data.select("x", "y"), lambda b: cls.part(matrix(b.column(0)), matrix(b.column(1))), cls.size(p, q)), p, q)

    def scaled(self, scale: np.ndarray) -> Moments:
        """Of x / scale."""
        return Moments(self.n, self.x / scale, self.y, self.xx / np.outer(scale, scale), self.xy / scale[:, None], self.yy)


class Head:
    """x W1 W2 + b, of rank ``rank``; learned with half the squared error or with 1 - cosine."""

    def __init__(self, inputs: int, outputs: int, rank: int = 32, seed: int = SEED, loss: str = "squared"):
        if loss not in ("squared", "cosine"):
            raise ValueError(f"no such loss: {loss}")
        rng = np.random.default_rng(seed)
        self.loss = loss
        self.w1, self.w2, self.b = rng.normal(size=(inputs, rank)) / np.sqrt(inputs), rng.normal(size=(rank, outputs)) / np.sqrt(rank), np.zeros(outputs)

    @property
    def parameters(self) -> list[np.ndarray]:
        return [self.w1, self.w2, self.b]

    @property
    def gradient_size(self) -> int:
        return 2 + sum(p.size for p in self.parameters)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w1 @ self.w2 + self.b

    def distance(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        p = self.predict(x)
        return 1 - np.clip((p * y).sum(1) / np.maximum(np.linalg.norm(p, axis=1) * np.linalg.norm(y, axis=1), 1e-8), -1, 1)

    def gradient(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Summed loss, rows, then the summed loss's gradient by the parameters in turn."""
        u = x @ self.w1
        p = u @ self.w2 + self.b
        if self.loss == "squared":
            d, loss = p - y, ((p - y) ** 2).sum() / 2
        else:
            norm = np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-8)
            target = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-8)
            cosine = (p * target).sum(1, keepdims=True) / norm
            d, loss = (cosine * p / norm - target) / norm, (1 - cosine).sum()
        return np.concatenate(([loss, len(x)], (x.T @ (d @ self.w2.T)).ravel(), (u.T @ d).ravel(), d.sum(0)))

    @property
    def packed(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parameters])

    def unpack(self, numbers: np.ndarray) -> Head:
        """Itself, with the parameters that ``packed`` gave."""
        self.w1, self.w2, self.b = (v.reshape(p.shape).copy() for v, p in zip(np.split(numbers, np.cumsum([p.size for p in self.parameters])[:-1]), self.parameters))
        return self

    def gradient_of(self, m: Moments) -> np.ndarray:
        """As ``gradient`` gives it for all rows that ``m`` is of, with the squared error."""
        if self.loss != "squared":
            raise ValueError("only squared errors follow from moments")
        a = self.w1 @ self.w2
        d = m.xx @ a + np.outer(m.x, self.b) - m.xy  # x.T @ (p - y)
        total = m.x @ a + m.n * self.b - m.y
        loss = ((m.xx @ a) * a).sum() + m.n * self.b @ self.b + m.yy + 2 * (m.x @ a) @ self.b - 2 * (m.xy * a).sum() - 2 * m.y @ self.b
        return np.concatenate(([loss / 2, m.n], (d @ self.w2.T).ravel(), (self.w1.T @ d).ravel(), total))

    def moved(self, g: np.ndarray, moments: list[tuple[np.ndarray, np.ndarray]], t: int, rate: float, most: float = 5.0) -> None:
        adam_step(self.parameters, g, moments, t, rate, most)


def fit_head(data: DataFrame | Moments, epochs: int = 15, rate: float = 0.05, patience: int = 5) -> tuple[Head, list[float]]:
    """Full-batch Adam on squared errors: every epoch's gradient follows from the moments of one pass."""
    m = Moments.of(data)
    head, losses = Head(len(m.x), len(m.y)), []
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in head.parameters]
    best, stale = np.inf, 0
    for t in range(1, epochs + 1):
        g = head.gradient_of(m)
        loss = g[0] / g[1]
        losses.append(float(loss))
        stale = 0 if loss < best - 1e-4 else stale + 1
        best = min(best, loss)
        if stale >= patience:
            break
        head.moved(g, moments, t, rate)
    return head, losses


def ridge(data: DataFrame | Moments, alpha: float = 1.0, rank: int = 16) -> np.ndarray:
    """Ridge coefficients from the distributed Gram matrix, truncated to ``rank`` by their singular values."""
    m = Moments.of(data)
    w = np.linalg.solve(m.xx + alpha * np.eye(len(m.x)), m.xy)
    u, s, vt = np.linalg.svd(w, full_matrices=False)
    return (u[:, :rank] * s[:rank]) @ vt[:rank]


def mean_cov(vectors: DataFrame) -> DataFrame:
    """i, mean, scale and row of the inverse ridge covariance of all dimensions of ``embedding``; rows without one are left out."""
    spark = vectors.sparkSession
    schema = "i int, mean double, scale double, inverse array<double>"
    data = vectors.where("embedding IS NOT NULL").select(F.col("embedding").cast("array<double>").alias("x"))
    lengths = data.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    if not lengths["most"]:
        return spark.createDataFrame([], schema)
    if lengths["least"] != lengths["most"]:
        raise ValueError(f"embeddings have from {lengths['least']} to {lengths['most']} dimensions")
    dims = lengths["most"]

    def part(pdf: pd.DataFrame) -> np.ndarray:
        x = np.stack(pdf["x"].to_numpy()).astype(float)
        return np.concatenate(([len(x)], x.sum(axis=0), (x.T @ x).ravel()))

    g = summed(data, part, 1 + dims + dims * dims)
    n, mean = g[0], g[1 : dims + 1] / g[0]
    cov = g[dims + 1 :].reshape(dims, dims) / n - np.outer(mean, mean)
    inverse = np.linalg.pinv(cov + 1e-3 * np.eye(dims))
    return spark.createDataFrame([(i, float(mean[i]), float(np.sqrt(max(cov[i, i], 0))), [float(v) for v in inverse[i]]) for i in range(dims)], schema)


# --- library models -------------------------------------------------------------------------------------------------


def pca_2d(vectors: DataFrame) -> DataFrame:
    """vec_id, its place on the two principal directions, and the shares of variance that they explain."""
    v = vectors.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    model = PCA(k=2, inputCol="v", outputCol="p").fit(v)
    ratio = [float(x) for x in model.explainedVariance]
    return model.transform(v).select("vec_id", vector_to_array("p").alias("point")).withColumn("explained", F.array(*map(F.lit, ratio)))


def isotonic_steps(rows: DataFrame) -> DataFrame:
    """boundary and value: steps of the isotonic fit of ``label`` (0 or 1) on ``score``."""
    model = IsotonicRegression(labelCol="label", featuresCol="score").fit(rows.select(F.col("label").cast("double"), "score"))
    return rows.sparkSession.createDataFrame([(float(a), float(b)) for a, b in zip(model.boundaries, model.predictions)], "boundary double, value double")


def leave_one_out(rows: DataFrame, features: list[str], group: str = "host", rounds: int = 20, ridge_weight: float = 1e-6) -> DataFrame:
    """Each row's probability of ``label`` 1 under a class-weighted logistic model of all other groups.

    All models are fitted at once. A round of Newton's method is one pass, in which each row adds its gradient and curvature to the model
    of every group but its own: sums are taken by group of rows and model, the own group's share never enters. The driver gets, for
    each group, as many numbers as the square of the features; the passes don't grow with the groups. Features are scaled to a
    standard deviation of 1 over all rows, and a group's rows are weighted by the share of the other class in it.
    """
    spark, p = rows.sparkSession, len(features) + 1
    share = F.avg("label").over(Window.partitionBy(group))
    stats = rows.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(features)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(features))).first()
    x = F.array(*((F.col(c) - F.lit(float(stats[f"m{i}"] or 0))) / F.lit(float(stats[f"s{i}"] or 1) or 1.0) for i, c in enumerate(features)), F.lit(1.0))
    weighted = rows.withColumn("__w", F.when(F.col("label") > 0, 1 - share).otherwise(share)).withColumn("__x", x)
    weighted = stage(weighted, "leave-one-out")
    groups = [r[0] for r in weighted.select(group).distinct().orderBy(group).collect()]
    place = {g: i for i, g in enumerate(groups)}
    beta = np.zeros((len(groups), p))
    for _ in range(rounds if groups else 0):
        now = beta.copy()

        def part(pdf: pd.DataFrame) -> np.ndarray:
            out = np.zeros((len(groups), p + p * p))
            data, w, y = np.stack(pdf["__x"].to_numpy()), pdf["__w"].to_numpy(), pdf["label"].to_numpy()
            own = pdf[group].map(place).to_numpy()
            for g in range(len(groups)):
                a, b, c = (v[own != g] for v in (data, w, y))  # noqa: B023
                q = 1 / (1 + np.exp(-np.clip(a @ now[g], -30, 30)))  # noqa: B023
                out[g, :p] = a.T @ (b * (c - q))
                out[g, p:] = ((a * (b * q * (1 - q))[:, None]).T @ a).ravel()
            return out.ravel()

        sums = summed(weighted.select(group, "__x", "__w", "label"), part, beta.shape[0] * (p + p * p)).reshape(len(groups), -1)
        steps = np.stack([np.linalg.solve(s[p:].reshape(p, p) + ridge_weight * np.eye(p), s[:p] - ridge_weight * b) for s, b in zip(sums, beta)])
        beta += np.clip(steps, -4, 4)
        if np.abs(steps).max() < 1e-8:
            break
    weights = spark.createDataFrame([(g, [float(v) for v in b]) for g, b in zip(groups, beta)], f"{group} {rows.schema[group].dataType.simpleString()}, __b array<double>")
    margin = F.aggregate(F.zip_with("__x", "__b", lambda u, v: u * v), F.lit(0.0), lambda u, v: u + v)
    return weighted.join(weights, group).withColumn("probability", 1 / (1 + F.exp(-margin))).drop("__w", "__x", "__b")


def action_nll(flow: DataFrame) -> DataFrame:
    """host, event_id and -ln P(action | kinds) of test events by a multinomial logistic model of training events."""
    x = F.array(*(F.when(F.col(c) == k, 1.0).otherwise(0.0) for c in ("src_kind", "dst_kind") for k in KINDS))
    ids = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action")) - 1
    rows = flow.select("host", "event_id", "split", ids.cast("double").alias("label"), array_to_vector(x).alias("x"))
    model = LogisticRegression(featuresCol="x", labelCol="label", family="multinomial", maxIter=15, regParam=1e-3).fit(rows.where("split = 'train'"))
    p = vector_to_array("probability")
    return model.transform(rows.where("split = 'test'")).select("host", "event_id", (-F.log(F.get(p, F.col("label").cast("int")))).alias("nll"))

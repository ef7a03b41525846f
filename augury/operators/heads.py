"""Linear heads over embeddings, kept as tables.

Vectors are read at unit length less the mean of their tier, at unit length again. A head is a logistic regression over the classes of one
target; its weights, a row a class, and the tiers' means are Parquet tables, so a score is a dot product that any engine
can repeat from them.

Rows fall in three parts by a hash of their id: 60 % fit the weights and means, 20 % set the thresholds, 20 % are judged. No row is judged
by a threshold that it helped to set.

On the driver: weights, means and counts of at most 10,001 rounded probabilities; their number doesn't grow with the rows.
Vectors without direction, and null ids, take no part.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from augury.functions.vectors import dot, norm, unit

from .cluster import mean_vectors

WEIGHTS = "head string, class string, intercept double, weights array<double>"
MEANS = "tier string, mean array<double>"
THRESHOLDS = "head string, tier string, threshold double"
STEPS = 4  # decimals of a threshold
#: Where no threshold reaches what is asked.
STRICT = 0.95


def part(id_: Column) -> Column:
    """fit, set or judge: six, two and two of ten parts of a multiplicative hash."""
    h = F.pmod(id_.cast("decimal(38,0)") * F.lit(2654435761), F.lit(1 << 32)).cast("long") % 10
    return F.when(h < 6, "fit").when(h < 8, "set").otherwise("judge")


def directed(df: DataFrame, *, id_col: str, vec_col: str, tier: Column, **more: Column) -> DataFrame:
    """``id, tier, vec, part`` and more, of rows with a direction."""
    rows = df.where(F.col(id_col).isNotNull() & (norm(vec_col) > 0))
    return rows.select(F.col(id_col).alias("id"), tier.cast("string").alias("tier"), unit(vec_col).alias("vec"), part(F.col(id_col)).alias("part"), *(c.alias(n) for n, c in more.items()))


def tier_means(rows: DataFrame) -> DataFrame:
    """``tier, mean`` of the part that fits; the row without tier is the mean of the tiers' means, for tiers never seen."""
    means = mean_vectors(rows.where("part = 'fit'").withColumn("tier", F.coalesce("tier", F.lit("none"))), ["tier"], "vec").select("tier", "mean")
    whole = mean_vectors(means.withColumn("one", F.lit(1)), ["one"], "mean").select(F.lit(None).cast("string").alias("tier"), "mean")
    return rows.sparkSession.createDataFrame(means.unionByName(whole).collect(), MEANS)  # a row a tier


def features(rows: DataFrame, means: DataFrame) -> DataFrame:
    """rows with ``f``, the centred vector."""
    known = F.broadcast(means.where("tier IS NOT NULL").select(F.col("tier").alias("_tier"), F.col("mean").alias("_own")))
    other = F.broadcast(means.where("tier IS NULL").select(F.col("mean").alias("_whole")))  # one row
    joined = rows.join(known, F.coalesce("tier", F.lit("none")) == F.col("_tier"), "left").crossJoin(other)
    return joined.withColumn("f", unit(F.zip_with("vec", F.coalesce("_own", "_whole"), lambda a, b: a - b))).drop("_tier", "_own", "_whole")


def fit_weights(rows: DataFrame, head: str, target: str, reg: float = 0.01) -> list[tuple[str, str, float, list[float]]]:
    """The weights of one head from rows (``f, part`` and the target, a string; null is unlabelled), classes weighing the same."""
    data = rows.where((F.col("part") == "fit") & F.col(target).isNotNull()).select(F.col(target).alias("y"), array_to_vector("f").alias("v"))
    counts = {r["y"]: r["n"] for r in data.groupBy("y").agg(F.count("*").alias("n")).orderBy("y").collect()}  # a row a class
    if len(counts) < 2:
        raise ValueError(f"head {head} needs two classes to tell apart")
    place = F.create_map(*(F.lit(x) for i, y in enumerate(counts) for x in (y, float(i))))
    weigh = F.create_map(*(F.lit(x) for y, n in counts.items() for x in (y, sum(counts.values()) / (len(counts) * n))))
    data = data.select("v", place[F.col("y")].alias("label"), weigh[F.col("y")].alias("w"))
    model = LogisticRegression(featuresCol="v", labelCol="label", weightCol="w", family="multinomial", regParam=reg, maxIter=50, standardization=False).fit(data)
    return [(head, y, float(b), [float(x) for x in row]) for y, b, row in zip(counts, model.interceptVector, model.coefficientMatrix.toArray(), strict=True)]


def probabilities(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """``id, tier, part, head, ps``: of every head the classes by probability, highest first, ties by name."""
    packed = weights.groupBy("head").agg(F.array_sort(F.collect_list(F.struct("class", "intercept", "weights"))).alias("cs")).agg(F.collect_list(F.struct("head", "cs")).alias("hs"))
    scored = rows.crossJoin(F.broadcast(packed))  # one row
    exps = lambda h, f: F.transform(h["cs"], lambda c: F.struct(F.exp(c["intercept"] + dot(c["weights"], f)).alias("e"), c["class"].alias("class")))
    per = scored.select("id", "tier", "part", F.explode(F.transform("hs", lambda h: F.struct(h["head"].alias("head"), exps(h, F.col("f")).alias("es")))).alias("h")).select("id", "tier", "part", "h.head", "h.es")
    total = F.aggregate("es", F.lit(0.0), lambda s, x: s + x["e"])
    ps = F.array_sort(F.transform("es", lambda x: F.struct((-F.round(x["e"] / total, 9)).alias("o"), x["class"].alias("class"))))
    return per.select("id", "tier", "part", "head", F.transform(ps, lambda x: F.struct((-x["o"]).alias("p"), x["class"].alias("class"))).alias("ps"))


def lowest_reaching(counts: DataFrame, keys: list[str], good: Column, target: float) -> DataFrame:
    """counts: ``keys, t`` (rounded down to STEPS), and what ``good`` divides after being summed over this t and all higher ones. ``keys, threshold``: the
    lowest t that reaches the target."""
    up = W.partitionBy(*keys).orderBy(F.desc("t"))  # at most 10,001 rows a key
    sums = [c for c in counts.columns if c not in (*keys, "t")]
    upto = counts.select(*keys, "t", *(F.sum(c).over(up).alias(c) for c in sums))
    return upto.where(good >= target).groupBy(*keys).agg(F.min("t").alias("threshold"))


def rounded(p: Column) -> Column:
    return F.floor(p * 10**STEPS) / 10**STEPS


def answer_thresholds(scored: DataFrame, truth: DataFrame, accuracy: float) -> DataFrame:
    """``head, tier (null), threshold``: the lowest confidence from which a head's answers reach the accuracy, on the part that sets. truth: ``id, head, y``."""
    best = scored.where("part = 'set'").join(truth, ["id", "head"]).select("head", rounded(F.col("ps")[0]["p"]).alias("t"), (F.col("ps")[0]["class"] == F.col("y")).alias("right"))
    counts = best.groupBy("head", "t").agg(F.count("*").alias("n"), F.count_if("right").alias("r"))
    found = lowest_reaching(counts, ["head"], F.col("r") / F.col("n"), accuracy)
    return truth.select("head").distinct().join(found, "head", "left").select("head", F.lit(None).cast("string").alias("tier"), F.coalesce("threshold", F.lit(STRICT)).alias("threshold"))


def recall_thresholds(scored: DataFrame, truth: DataFrame, recall: float, least: float = 0.0) -> DataFrame:
    """``head, tier, threshold``: for each tier with positives, and for all (null), the highest probability of class 1 from which the recall is reached, on the part that sets, ``least`` at the least."""
    p = F.filter("ps", lambda x: x["class"] == "1")[0]["p"]
    pos = scored.where("part = 'set'").join(truth.where("y = '1'"), ["id", "head"]).select("head", F.coalesce("tier", F.lit("none")).alias("tier"), rounded(p).alias("t"))
    at = F.percentile("t", 1 - recall)
    own = pos.groupBy("head", "tier").agg(at.alias("threshold"))
    whole = pos.groupBy("head").agg(at.alias("threshold")).select("head", F.lit(None).cast("string").alias("tier"), "threshold")
    return own.unionByName(whole).withColumn("threshold", F.greatest("threshold", F.lit(least)))


def precision_threshold(scored: DataFrame, truth: DataFrame, target: float, prevalence: float) -> DataFrame:
    """``head, threshold``: the lowest one whose precision, at the share that positives have of the whole rather than of this sample,
    reaches the target, on the part that sets; STRICT where none does."""
    p = F.filter("ps", lambda x: x["class"] == "1")[0]["p"]
    told = scored.where("part = 'set'").join(truth, ["id", "head"]).select("head", rounded(p).alias("t"), (F.col("y") == "1").alias("y"))
    whole = told.groupBy("head").agg(F.count_if("y").alias("P"), F.count_if(~F.col("y")).alias("N"))
    counts = told.groupBy("head", "t").agg(F.count_if("y").alias("tp"), F.count_if(~F.col("y")).alias("fp")).join(F.broadcast(whole), "head")  # a row a head
    counts = counts.select("head", "t", (F.col("tp") / F.col("P")).alias("tpr"), (F.col("fp") / F.col("N")).alias("fpr"))
    share = min(max(prevalence, 1e-4), 0.5)
    tp, fp = F.col("tpr") * share, F.col("fpr") * (1 - share)
    found = lowest_reaching(counts, ["head"], F.when(tp > 0, tp / (tp + fp)), target)
    return whole.select("head").join(found, "head", "left").select("head", F.coalesce("threshold", F.lit(STRICT)).alias("threshold"))


class Heads:
    """Weights, means and thresholds; saved as three tables and read again."""

    def __init__(self, weights: DataFrame, means: DataFrame, thresholds: DataFrame):
        self.weights, self.means, self.thresholds = weights, means, thresholds

    def save(self, path: str) -> None:
        for name in ("weights", "means", "thresholds"):
            getattr(self, name).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Heads:
        return cls(*(spark.read.schema(s).parquet(f"{path}/{n}") for n, s in (("weights", WEIGHTS), ("means", MEANS), ("thresholds", THRESHOLDS))))

    def score(self, rows: DataFrame) -> DataFrame:
        """``id, tier, part, head, ps`` of rows from ``directed``."""
        return probabilities(features(rows, self.means), self.weights)

    def answers(self, rows: DataFrame) -> DataFrame:
        """``id, head, answer, first, second, confidence, margin``: the answer is null under the head's threshold."""
        at = F.broadcast(self.thresholds.where("tier IS NULL").select("head", "threshold"))  # a row a head
        p = lambda i: F.col("ps")[i]
        return self.score(rows).join(at, "head").select("id", "part", "head", F.when(p(0)["p"] >= F.col("threshold"), p(0)["class"]).alias("answer"), p(0)["class"].alias("first"), p(1)["class"].alias("second"),
                                                        p(0)["p"].alias("confidence"), (p(0)["p"] - p(1)["p"]).alias("margin"))

    def members(self, rows: DataFrame) -> DataFrame:
        """``id, tier, part, head, p, member`` for heads of classes 0 and 1: against the row's own tier's threshold, that of all where the tier has none."""
        p = F.filter("ps", lambda x: x["class"] == "1")[0]["p"]
        own = F.broadcast(self.thresholds.where("tier IS NOT NULL").select("head", F.col("tier").alias("_tier"), F.col("threshold").alias("_own")))
        whole = F.broadcast(self.thresholds.where("tier IS NULL").select("head", F.col("threshold").alias("_whole")))
        scored = self.score(rows).withColumn("_tier", F.coalesce("tier", F.lit("none"))).join(own, ["head", "_tier"], "left").join(whole, "head")
        return scored.select("id", F.col("_tier").alias("tier"), "part", "head", p.alias("p"), (p >= F.coalesce("_own", "_whole")).alias("member"))


def truths(rows: DataFrame, targets: list[str]) -> DataFrame:
    """``id, head, y`` of every labelled row and target."""
    return rows.select("id", F.explode(F.array(*(F.struct(F.lit(h).alias("head"), F.col(h).cast("string").alias("y")) for h in targets))).alias("x")).select("id", "x.*").where("y IS NOT NULL")


def train(rows: DataFrame, targets: list[str], *, accuracy: float | None = None, recall: float | None = None, least: float = 0.0) -> Heads:
    """Heads for the targets (columns of rows from ``directed``), with thresholds for answers that reach an accuracy or for class 1 at a recall."""
    spark, means = rows.sparkSession, tier_means(rows)
    ready = features(rows, means)
    weights = spark.createDataFrame([w for h in targets for w in fit_weights(ready, h, h)], WEIGHTS)
    scored, truth = probabilities(ready, weights), truths(rows, targets)
    at = answer_thresholds(scored, truth, accuracy) if accuracy is not None else recall_thresholds(scored, truth, recall, least)
    return Heads(weights, means, spark.createDataFrame(at.select("head", "tier", F.col("threshold").cast("double")).collect(), THRESHOLDS))  # a row a head and tier

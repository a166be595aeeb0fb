"""N-gram counts, association measures, and a bigram language model with additive smoothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ngrams

K, BIGRAM_SHARE = 0.4, 0.7


def counts(docs: DataFrame, tokens: str, n: int) -> DataFrame:
    """(gram, n, count): how often each n-gram occurs. Summed before the shuffle."""
    return docs.select(F.explode(ngrams(tokens, n)).alias("gram")).groupBy("gram").agg(F.count("*").alias("count")).withColumn("n", F.lit(n))


def bigrams(docs: DataFrame, tokens: str, by: list[str] | None = None) -> DataFrame:
    """(by, w1, w2, c): counts of adjacent words."""
    t = F.col(tokens)
    pairs = F.when(F.size(t) >= 2, F.transform(F.sequence(F.lit(0), F.size(t) - 2), lambda i: F.struct(F.get(t, i).alias("w1"), F.get(t, i + 1).alias("w2"))))
    by = by or []
    return docs.select(*by, F.explode(pairs).alias("p")).groupBy(*by, F.col("p.w1").alias("w1"), F.col("p.w2").alias("w2")).agg(F.count("*").alias("c"))


def entropy(*cells: Column) -> Column:
    """Sum of x ln(x / total) over the cells, zeros left out."""
    total = sum(cells[1:], cells[0])
    return sum((F.when(x > 0, x * F.log(x / total)).otherwise(0.0) for x in cells), F.lit(0.0))


def association(docs: DataFrame, tokens: str, least: int = 5) -> DataFrame:
    """(w1, w2, c, pmi, llr): pointwise mutual information (0 for pairs rarer than `least`) against word frequencies, and
    Dunning's log likelihood ratio against the pair's own margins. Margins and totals come from the bigram and word counts
    in joins on the words; totals are single rows."""
    two = bigrams(docs, tokens)
    one = docs.select(F.explode(tokens).alias("w")).groupBy("w").agg(F.count("*").alias("f"))
    totals = two.agg(F.sum("c").alias("nb")).crossJoin(one.agg(F.sum("f").alias("nu")))  # one row each
    left = two.groupBy("w1").agg(F.sum("c").alias("l"))
    right = two.groupBy("w2").agg(F.sum("c").alias("r"))
    j = two.join(left, "w1").join(right, "w2").join(one.select(F.col("w").alias("w1"), F.col("f").alias("f1")), "w1").join(one.select(F.col("w").alias("w2"), F.col("f").alias("f2")), "w2").crossJoin(F.broadcast(totals))
    pmi = F.when(F.col("c") >= least, F.log2((F.col("c") / F.col("nb")) / ((F.col("f1") / F.col("nu")) * (F.col("f2") / F.col("nu"))))).otherwise(0.0)
    k11, k12, k21 = F.col("c"), F.col("l") - F.col("c"), F.col("r") - F.col("c")
    k22 = F.col("nb") - k11 - k12 - k21
    llr = 2 * (entropy(k11, k12, k21, k22) - entropy(k11 + k12, k21 + k22) - entropy(k11 + k21, k12 + k22))
    return j.select("w1", "w2", "c", pmi.alias("pmi"), llr.alias("llr"))


def padded(tokens: str) -> Column:
    return F.concat(F.array(F.lit("<s>")), F.col(tokens), F.array(F.lit("</s>")))


def probability(c: Column, ca: Column, cb: Column, v: Column, n: Column) -> Column:
    """Of a word after another: bigram and unigram estimates, both smoothed, mixed."""
    return BIGRAM_SHARE * (c + K) / (ca + K * v) + (1 - BIGRAM_SHARE) * (cb + K) / (n + K * v)


def log_probability(train: DataFrame, test: DataFrame, tokens: str, key: str) -> DataFrame:
    """(key, logp): the mean log probability of the word pairs of each test row, ends included, under a model of `train`. The
    vocabulary counts one unknown word; unseen words and pairs have count 0."""
    t = train.select(padded(tokens).alias("t"))
    two = bigrams(t, "t")
    one = t.select(F.explode("t").alias("w")).groupBy("w").agg(F.count("*").alias("f"))
    size = one.agg((F.count("*") + 1).alias("v"), F.sum("f").alias("n"))
    p = bigrams(test.select(key, padded(tokens).alias("t")), "t", [key]).withColumnRenamed("c", "m")
    j = p.join(two, ["w1", "w2"], "left").join(one.select(F.col("w").alias("w1"), F.col("f").alias("f1")), "w1", "left").join(one.select(F.col("w").alias("w2"), F.col("f").alias("f2")), "w2", "left").crossJoin(F.broadcast(size))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    lp = F.log(probability(z("c"), z("f1"), z("f2"), F.col("v"), F.col("n")))
    return j.groupBy(key).agg((F.sum(F.col("m") * lp) / F.sum("m")).alias("logp"))


def held_out(docs: DataFrame, tokens: str, key: str, fold: str, train: DataFrame | None = None) -> DataFrame:
    """(key, logp) where the model of each row leaves out the rows of its own fold: the fold's counts are subtracted from
    those of the whole, so nothing is fitted again. The vocabulary is what remains with a count. The model is of `train`
    (the same columns), or of the rows themselves; a row whose fold isn't in train is scored by the whole model."""
    d = docs.select(key, fold, padded(tokens).alias("t"))
    t = d if train is None else train.select(fold, padded(tokens).alias("t"))
    own2 = bigrams(t, "t", [fold])
    all2 = own2.groupBy("w1", "w2").agg(F.sum("c").alias("c"))
    own1 = t.select(fold, F.explode("t").alias("w")).groupBy(fold, "w").agg(F.count("*").alias("f"))
    all1 = own1.groupBy("w").agg(F.sum("f").alias("f"))
    total = all1.agg(F.count("*").alias("v"), F.sum("f").alias("n"))
    gone = own1.withColumnRenamed("f", "o").join(all1, "w").groupBy(fold).agg(F.sum((F.col("o") == F.col("f")).cast("bigint")).alias("dv"), F.sum("o").alias("dn"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    size = d.select(fold).distinct().join(gone, fold, "left").crossJoin(F.broadcast(total)).select(fold, (F.col("v") - z("dv") + 1).alias("v"), (z("n") - z("dn")).alias("n"))
    p = bigrams(d, "t", [key, fold]).withColumnRenamed("c", "m")
    j = p.join(all2, ["w1", "w2"], "left").join(own2.withColumnRenamed("c", "oc"), [fold, "w1", "w2"], "left")
    for w in ("w1", "w2"):
        j = j.join(all1.select(F.col("w").alias(w), F.col("f").alias(f"a{w}")), w, "left").join(own1.select(fold, F.col("w").alias(w), F.col("f").alias(f"o{w}")), [fold, w], "left")
    lp = F.log(probability(z("c") - z("oc"), z("aw1") - z("ow1"), z("aw2") - z("ow2"), F.col("v"), F.col("n")))
    return j.join(size, fold).groupBy(key).agg((F.sum(F.col("m") * lp) / F.sum("m")).alias("logp"))

"""Features of candidate relations, scoring by sparse weights, and weighted logistic regression."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut


def text_between(text: Column, head_end: Column, tail_start: Column, head_start: Column, tail_end: Column, sent_start: Column) -> Column:
    """The text between the ends in physical order, or from the start of the sentence for a person as head."""
    left = F.when(head_start < 0, sent_start).when(head_start <= tail_start, head_end).otherwise(tail_end)
    right = F.when((head_start < 0) | (head_start <= tail_start), tail_start).otherwise(head_start)
    return F.when(right > left, F.substring(text, left + 1, right - left)).otherwise("")


def structure() -> Column:
    """An array of (feature, value): types, pair of types, distance bucket and share, clause, person, comma. Needs
    head_entity_type, tail_entity_type, token_gap, same_clause, head_kind and between."""
    gap = F.col("token_gap")
    bucket = F.when(gap == 0, "0").when(gap <= 3, "1_3").when(gap <= 10, "4_10").otherwise("mais_10")
    one = F.lit(1.0)
    each = [
        (F.concat(F.lit("par:"), F.coalesce("head_entity_type", F.lit("Person")), F.lit("|"), "tail_entity_type"), one),
        (F.concat(F.lit("tipo_cabeca:"), F.coalesce("head_entity_type", F.lit("Person"))), one),
        (F.concat(F.lit("tipo_cauda:"), "tail_entity_type"), one),
        (F.concat(F.lit("distancia:"), bucket), one),
        (F.lit("n_palavras_entre"), F.least(gap, F.lit(20)) / 20.0),
        (F.when(F.col("same_clause"), "mesma_clausula"), one),
        (F.when(F.col("head_kind") == "Person", "paciente_cabeca"), one),
        (F.when(F.col("between").contains(","), "tem_virgula"), one),
    ]
    return F.filter(F.array(*[F.struct(n.alias("feature"), v.cast("double").alias("value")) for n, v in each]), lambda x: x["feature"].isNotNull())


def structural(r: DataFrame) -> DataFrame:
    """(rel_id, feature, value) of structure(). One generator over the array, no shuffle."""
    return r.select("rel_id", F.explode(structure()).alias("f")).select("rel_id", "f.feature", "f.value")


def scores(features: DataFrame, weights: DataFrame, bias: DataFrame) -> DataFrame:
    """(rel_id, class, z): linear scores, a sparse join and a sum. Weights (class, feature, weight) and bias (class, bias) are
    joined by feature; rows without a known feature have the bias alone."""
    s = features.join(weights, "feature").groupBy("rel_id", "class").agg(F.sum(F.col("value") * F.col("weight")).alias("s"))
    ids = features.select("rel_id").distinct()
    return ids.crossJoin(F.broadcast(bias)).join(s, ["rel_id", "class"], "left").select("rel_id", "class", (F.coalesce("s", F.lit(0.0)) + F.col("bias")).alias("z"))


def sigmoid(z: Column) -> Column:
    """Stable on both sides."""
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def decided(z: DataFrame) -> DataFrame:
    """(rel_id, class, probability): the class of the highest score, ties to the first name, with its normalised
    probability."""
    p = z.withColumn("p", sigmoid(F.col("z")))
    best = F.min(F.struct((-F.col("p")).alias("np"), "class")).alias("b")
    return p.groupBy("rel_id").agg(best, F.sum("p").alias("t")).select("rel_id", F.col("b.class").alias("class"), (-F.col("b.np") / F.col("t")).alias("probability"))


#: The weights of a model (classes x features) may number so many: they are on the driver and in every task.
MODEL = 50_000_000
#: Models of several folds are fitted together as long as they have no more weights than this (8 bytes each, four times on
#: the driver).
TOGETHER = 4_500_000
#: Examples are packed in blocks of so many.
BLOCK = 20_000
#: A feature that one example of so many in a block has is a dense column of the block.
DENSE = 16


def _blob(x: dict) -> tuple[bytes, int]:
    raw = pickle.dumps(x, 5)
    return pa.compress(raw, "lz4", asbytes=True), len(raw)


def _blobs(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in it:
        for blob, size in zip(b.column("blob"), b.column("size")):
            yield pickle.loads(pa.decompress(blob.as_buffer(), size.as_py(), "lz4"))


@dataclass(frozen=True)
class Packed:
    """Examples in compressed blocks, with the names of their features and how many examples have each. A block has its own
    numbers of features and labels; columns of blocks: names, counts, labels, support, blob, size."""

    blocks: DataFrame
    id_type: str
    features: pa.Table

    def only(self, keep: Callable[[str, int], bool]) -> Packed:
        """The features that `keep` takes by name and number of examples; blocks aren't written anew."""
        names, counts = self.features.column("name"), self.features.column("n")
        return replace(self, features=self.features.filter(pa.array([keep(k.as_py(), n.as_py()) for k, n in zip(names, counts)], pa.bool_())))


def packed(rows: DataFrame) -> Packed:
    """Of examples (id, label, fold, x), x an array of (feature, value): written once, so that features are counted, chosen
    and numbered without a table of a row a feature. A null label takes no part in a fit."""
    kind = dict(rows.dtypes)["id"]

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        x = t.column("x").combine_chunks()
        x = x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
        flat = x.flatten()
        code = flat.field("feature").dictionary_encode()
        label = t.column("label").combine_chunks().dictionary_encode()
        label = label.chunk(0) if isinstance(label, pa.ChunkedArray) else label
        y = label.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
        n = x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32)
        idx = code.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        fold, labels = t.column("fold").to_numpy().astype(np.int32), label.dictionary.to_pylist()
        support = [(int(f), labels[k], int(c)) for (f, k), c in zip(*np.unique(np.stack([fold, y], 1)[y >= 0], axis=0, return_counts=True))]
        blob, size = _blob({"ids": t.column("id").combine_chunks(), "y": y, "fold": fold, "n": n, "idx": idx, "val": flat.field("value").to_numpy(zero_copy_only=False)})
        counts = np.bincount(idx, minlength=len(code.dictionary))
        columns = [[code.dictionary.to_pylist()], [counts], [labels], [[{"fold": f, "label": k, "n": c} for f, k, c in support]], [blob], [size]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, shape)], schema=shape)

    shape = pa.schema([("names", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("support", pa.list_(pa.struct([("fold", pa.int32()), ("label", pa.string()), ("n", pa.int64())]))), ("blob", pa.binary()), ("size", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in it:
            held += [b] if b.num_rows else []
            if sum(x.num_rows for x in held) >= BLOCK:
                yield block(held)
                held = []
        if held:
            yield block(held)

    rows = rows.select("id", "label", F.col("fold").cast("int").alias("fold"), "x")
    blocks = cut(rows.mapInArrow(run, "names array<string>, counts array<bigint>, labels array<string>, support array<struct<fold:int,label:string,n:bigint>>, blob binary, size bigint"))
    names = blocks.select(F.explode(F.arrays_zip("names", "counts")).alias("f")).groupBy(F.col("f.names").alias("name")).agg(F.sum("f.counts").alias("n"))
    return Packed(blocks, kind, names.toArrow().sort_by("name"))


def _matrices(x: dict, at: np.ndarray, klass: np.ndarray) -> dict:
    """A block with the numbers that all blocks share: features that many examples have as dense columns (their places
    and values), the others in order of the feature. A feature of number -1 is left out; 0 is the intercept."""
    n = len(x["y"])
    idx, row, val = at[x["idx"]], np.repeat(np.arange(n, dtype=np.int32), x["n"]), x["val"]
    idx, row, val = (v[idx >= 0] for v in (idx, row, val))
    idx, row, val = np.concatenate([np.zeros(n, idx.dtype), idx]), np.concatenate([np.arange(n, dtype=np.int32), row]), np.concatenate([np.ones(n), val])
    order = np.lexsort((row, idx))
    idx, row, val = idx[order], row[order], val[order]
    cols, start, count = np.unique(idx, return_index=True, return_counts=True)
    twice = np.zeros(len(idx), bool)
    twice[1:] = (idx[1:] == idx[:-1]) & (row[1:] == row[:-1])  # a feature that an example has twice is summed, so never dense
    dense = (count * DENSE >= n) & (np.add.reduceat(twice, start) == 0)
    number, full = np.cumsum(dense) - 1, np.repeat(dense, count)
    place = row[full].astype(np.int64) * int(dense.sum()) + np.repeat(number[dense], count[dense])
    few = count[~dense]
    y = np.where(x["y"] >= 0, klass[x["y"]] if len(klass) else -1, -1)
    return {"ids": x["ids"], "y": y, "fold": x["fold"], "many": np.bincount(row, np.abs(val) > 0, n), "dense": cols[dense], "place": place, "full": val[full], "sparse": cols[~dense], "start": np.cumsum(few) - few, "col": np.repeat(np.arange(len(few)), few), "row": row[~full], "val": val[~full]}


def _filled(x: dict) -> np.ndarray:
    out = np.zeros((len(x["y"]), len(x["dense"])))
    out.ravel()[x["place"]] = x["full"]
    return out


def _potentials(x: dict, full: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Scores (examples x models) under weights (features x models)."""
    z, own = full @ w[x["dense"]], w[x["sparse"]]
    if len(own):
        for m in range(w.shape[1]):
            z[:, m] += np.bincount(x["row"], own[x["col"], m] * x["val"], len(z))
    return z


def _gathered(x: dict, full: np.ndarray, each: np.ndarray, g: np.ndarray, square: bool) -> None:
    """Adds to g (features x models) what `each` (examples x models) gives to the features, by their values or squares."""
    power = (lambda v: v * v) if square else (lambda v: v)
    g[x["dense"]] += power(full).T @ each
    if len(x["sparse"]):
        g[x["sparse"]] += np.add.reduceat(power(x["val"])[:, None] * each[x["row"]], x["start"], axis=0)


@dataclass(frozen=True)
class Fitted:
    """Models of the folds `first` on, (features x models) weights, a fold's classes side by side."""

    first: int
    weights: np.ndarray


@dataclass(frozen=True)
class Fit:
    names: pa.Array
    classes: list[str]
    data: DataFrame
    id_type: str
    folds: int

    def table(self, models: Fitted) -> DataFrame:
        """(fold, class, feature, weight), made in the tasks."""
        spark, classes, first = self.data.sparkSession, self.classes, models.first
        sent = spark.sparkContext.broadcast((self.names, models.weights))

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, w = sent.value
            for b in it:
                for m in b.column(0).to_pylist():
                    at = np.flatnonzero(w[:, m])
                    f, c = divmod(m, len(classes))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), first + f, np.int32)), pa.array([classes[c]] * len(at), pa.string()), names.take(pa.array(at)), pa.array(w[at, m])], ["fold", "class", "feature", "weight"])

        out = cut(spark.range(0, models.weights.shape[1], 1, models.weights.shape[1]).mapInArrow(run, "fold int, class string, feature string, weight double"))
        sent.unpersist()
        return out

    def classified(self, models: Fitted) -> DataFrame:
        """(id, fold, label, class, probability) of the examples of these folds, or of all where there is one model."""
        spark, classes, first, folds, count = self.data.sparkSession, self.classes, models.first, self.folds, models.weights.shape[1] // len(self.classes)
        sent = spark.sparkContext.broadcast(models.weights)

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in _blobs(it):
                z = np.clip(_potentials(x, _filled(x), sent.value), -700, 700).reshape(len(x["y"]), count, len(classes))
                own = x["fold"] - first if folds > 1 else np.zeros(len(z), np.int64)
                rows = np.flatnonzero((own >= 0) & (own < count))
                y = x["y"][rows]
                p = 1 / (1 + np.exp(-z[rows, own[rows]]))
                best = p.argmax(1)
                yield pa.RecordBatch.from_arrays([x["ids"].take(pa.array(rows)), pa.array(x["fold"][rows], pa.int32()), pa.array(classes, pa.string()).take(pa.array(y, mask=y < 0)), pa.array(classes, pa.string()).take(pa.array(best)), pa.array(p[np.arange(len(rows)), best] / p.sum(1))], ["id", "fold", "label", "class", "probability"])

        out = cut(self.data.mapInArrow(run, f"id {self.id_type}, fold int, label string, class string, probability double"))
        sent.unpersist()
        return out


def fitted(examples: Packed, folds: int, rounds: int, ridge: float, most: float, tolerance: float, use: Callable[[Fit, Fitted], DataFrame], schema: str) -> DataFrame:
    """What `use` makes of the models, folds after folds, in one table; see one_vs_rest."""
    spark = examples.blocks.sparkSession
    each = ["s.fold", "s.label"] if folds > 1 else [F.lit(-1).alias("fold"), "s.label"]
    support = {(r["fold"], r["label"]): r["n"] for r in examples.blocks.select(F.explode("support").alias("s")).groupBy(*each).agg(F.sum("s.n").alias("n")).collect()}
    classes = sorted({c for _, c in support})
    if not classes:
        return spark.createDataFrame([], schema)
    names = pa.concat_arrays([pa.array(["(bias)"]), examples.features.column("name").combine_chunks().cast(pa.string())])
    size, k = len(names), len(classes)
    if k * size > MODEL:
        raise ValueError(f"{(k, size)} weights are more than {MODEL}: drop rare features")
    known = spark.sparkContext.broadcast((names, classes))

    def number(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        names, classes = known.value
        for b in it:
            for i in range(b.num_rows):
                own = b.column("names")[i].values
                at = pc.index_in(own, value_set=names.slice(1)).fill_null(-2).to_numpy(zero_copy_only=False) + 1
                klass = np.array([classes.index(c) for c in b.column("labels")[i].as_py()], np.int32)
                x = next(_blobs(iter([b.slice(i, 1)])))
                blob, raw = _blob(_matrices(x, at, klass))
                yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary()), pa.array([raw], pa.int64())], ["blob", "size"])

    few = examples.blocks.coalesce(spark.sparkContext.defaultParallelism)
    fit = Fit(names, classes, cut(few.select("names", "labels", "blob", "size").mapInArrow(number, "blob binary, size bigint")), examples.id_type, folds)
    step, out = max(1, min(folds, TOGETHER // (k * size))), None
    for first in range(0, folds, step):
        held = list(range(first, min(folds, first + step))) if folds > 1 else [-2]
        made = use(fit, Fitted(first, _climb(fit, held, support, rounds, ridge, most, tolerance)))
        out = made if out is None else out.unionByName(made)
    return out


def _climb(fit: Fit, held: list[int], support: dict, rounds: int, ridge: float, most: float, tolerance: float) -> np.ndarray:
    """The weights (features x models) of the models that are fitted without the examples of each of the folds `held`."""
    spark, k, size = fit.data.sparkSession, len(fit.classes), len(fit.names)
    total = np.array([sum(n for (f, _), n in support.items() if f != m) for m in held], float)
    pos = np.array([[sum(n for (f, c), n in support.items() if f != m and c == own) for own in fit.classes] for m in held], float)
    heavy = np.clip((total[:, None] - pos) / np.maximum(pos, 1), 1, np.minimum(most, np.maximum(pos, 1)))

    def summed(weights: np.ndarray | None) -> np.ndarray:
        """The gradients at `weights`, or without them the bounds of the curvature."""
        sent = spark.sparkContext.broadcast(weights)

        def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g, w = np.zeros((size, len(held) * k)), sent.value
            for x in _blobs(it):
                hit = x["y"][:, None] == np.arange(k)
                cost = np.concatenate([np.where(hit, heavy[m], 1.0) * ((x["fold"] != f) & (x["y"] >= 0))[:, None] for m, f in enumerate(held)], 1)
                full = _filled(x)
                if w is None:
                    _gathered(x, full, cost * (x["many"] * 0.25)[:, None], g, True)
                else:
                    z = np.clip(_potentials(x, full, w), -30, 30)
                    _gathered(x, full, (np.tile(hit, len(held)) - 1 / (1 + np.exp(-z))) * cost, g, False)
            at = np.flatnonzero(g.any(1))
            for lo in range(0, len(at), 100_000):
                own = at[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([own.astype(np.int32).tobytes()], pa.binary()), pa.array([g[own].tobytes()], pa.binary())], ["at", "g"])

        out = np.zeros((size, len(held) * k))
        got = fit.data.mapInArrow(part, "at binary, g binary").toArrow()
        for at, g in zip(got.column("at"), got.column("g")):
            at = np.frombuffer(at.as_buffer(), np.int32)
            out[at] += np.frombuffer(g.as_buffer(), np.float64).reshape(len(at), -1)
        sent.destroy()
        return out

    curve, t, open_ = summed(None), [1.0] * len(held), [True] * len(held)
    own = [(m, slice(m * k, m * k + k)) for m in range(len(held))]
    for m, s in own:
        curve[:, s] /= max(total[m], 1)
    curve += ridge
    w, ahead = np.zeros(curve.shape), np.zeros(curve.shape)
    for _ in range(rounds):
        g = summed(ahead)
        for m, s in own:
            if not open_[m]:
                continue
            move = (g[:, s] / max(total[m], 1) - ridge * ahead[:, s]) / curve[:, s]
            new, faster = ahead[:, s] + move, (1 + math.sqrt(1 + 4 * t[m] * t[m])) / 2
            if (move * (new - w[:, s])).sum() < 0:  # past the top: begin the acceleration anew
                faster = 1.0
            ahead[:, s], w[:, s], t[m] = new + (t[m] - 1) / faster * (new - w[:, s]), new, faster
            open_[m] = np.abs(move).max() >= tolerance
        if not any(open_):
            break
    return w


def by_example(examples: DataFrame, folds: int) -> DataFrame:
    """(id, label, fold, x) of examples (id, feature, value, label, and with folds > 1 fold)."""
    fold = F.min("fold") if folds > 1 else F.lit(-1)
    return examples.groupBy("id").agg(F.collect_list(F.struct("feature", F.col("value").cast("double").alias("value"))).alias("x"), F.min("label").alias("label"), fold.alias("fold"))


def one_vs_rest(examples: DataFrame | Packed, folds: int = 1, rounds: int = 40, ridge: float = 1e-4, most: float = 20.0, tolerance: float = 5e-3) -> DataFrame:
    """(fold, class, feature, weight): logistic regressions of each class against the rest, on examples (id, feature, value,
    label, and with folds > 1 fold, 0 to folds - 1), or on packed ones. Model `fold` of several is fitted without the
    examples of its own fold, model 0 of one on all. An intercept is the feature '(bias)'.

    A pass over the packed examples sums the gradients of every class, and of as many folds as TOGETHER allows, in the tasks,
    which hand the driver one array each of the features that they met; steps are accelerated and scaled by a bound on each
    feature's curvature, until no weight of the fold would move by more than `tolerance`, or `rounds`. The positive class
    weighs clamp(negatives / positives, 1, most), most at least the number of its examples. The order of rows doesn't
    matter; no examples give no weights. The weights of a model (classes x features) are checked against MODEL; examples
    are a table of any size.
    """
    own = examples if isinstance(examples, Packed) else packed(by_example(examples, folds))
    return fitted(own, folds, rounds, ridge, most, tolerance, Fit.table, "fold int, class string, feature string, weight double")


def classified(examples: Packed, folds: int = 1, rounds: int = 40, ridge: float = 1e-4, most: float = 20.0, tolerance: float = 5e-3) -> DataFrame:
    """(id, fold, label, class, probability): the class that each example gets from the models of one_vs_rest (of its own fold, which
    were fitted without it): of the highest probability, ties to the first name, normalised by the sum over the classes.
    Models never become a table: they go from the driver to the packed examples."""
    return fitted(examples, folds, rounds, ridge, most, tolerance, Fit.classified, f"id {examples.id_type}, fold int, label string, class string, probability double")


def applied(features: DataFrame, weights: DataFrame) -> DataFrame:
    """(id, class, probability): the class that each row of features (id, feature, value, and fold where the weights have
    several) gets: of the highest probability, ties to the first name, normalised by the sum over the classes."""
    on = ["fold", "feature"] if "fold" in features.columns else ["feature"]
    w = weights if "fold" in features.columns else weights.drop("fold")
    few = F.broadcast(w)  # at most MODEL weights
    bias = w.filter("feature = '(bias)'").select(*on[:-1], "class", F.col("weight").alias("bias"))
    ids = features.select("id", *on[:-1]).distinct()
    start = ids.join(F.broadcast(bias), on[:-1]) if on[:-1] else ids.crossJoin(F.broadcast(bias))
    s = features.join(few, on).groupBy("id", "class").agg(F.sum(F.col("value") * F.col("weight")).alias("s"))
    z = start.join(s, ["id", "class"], "left").select(F.col("id").alias("rel_id"), "class", (F.coalesce("s", F.lit(0.0)) + F.col("bias")).alias("z"))
    return decided(z).withColumnRenamed("rel_id", "id")

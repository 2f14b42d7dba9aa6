"""Class masks as pixel relations (tile, r, c, v): components, boundaries, morphology and segmentation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .polygonize import mask_components


def component_areas(px: DataFrame, width: int = 1 << 12) -> DataFrame:
    """A row for each component with its area and box."""
    return mask_components(px, width).groupBy("component").agg(F.min("tile").alias("tile"), F.min("v").alias("v"), F.count(F.lit(1)).alias("area"), F.min("r").alias("top"), F.max("r").alias("bottom"), F.min("c").alias("left"), F.max("c").alias("right"))


def boundary_edges(px: DataFrame) -> DataFrame:
    """(tile, v, x1, y1, x2, y2): pixel sides on the outline of each value, where the neighbour has another one or none."""
    out = []
    for fixed, moving in (("r", "c"), ("c", "r")):
        w = Window.partitionBy("tile", fixed).orderBy(moving)
        for f, far in ((F.lag, 0), (F.lead, 1)):
            here = ~F.coalesce((f(moving).over(w) == F.col(moving) + (2 * far - 1)) & (f("v").over(w) == F.col("v")), F.lit(False))
            at = F.col(moving) + far
            ends = (at, F.col("r"), at, F.col("r") + 1) if moving == "c" else (F.col("c"), at, F.col("c") + 1, at)
            out.append(px.withColumn("edge", here).filter("edge").select("tile", "v", *(e.alias(n) for e, n in zip(ends, ("x1", "y1", "x2", "y2")))))
    return out[0].union(out[1]).union(out[2]).union(out[3])


def boundary_map(px: DataFrame, value: int) -> DataFrame:
    """(tile, r, c) of one-pixel boundaries of a class: where it differs from the pixel east, south or south-east."""
    flag = px.withColumn("b", (F.col("v") == value).cast("int"))
    row, col = Window.partitionBy("tile", "r").orderBy("c"), Window.partitionBy("tile", "c").orderBy("r")
    e = flag.withColumn("e", F.lead("b").over(row)).withColumn("s", F.lead("b").over(col))
    e = e.withColumn("se", F.lead("e").over(col))
    differs = lambda x: F.coalesce(F.col("b") != F.col(x), F.lit(False))
    return e.filter(differs("e") | differs("s") | (F.coalesce(F.col("b") != F.col("se"), F.lit(False)) & F.col("e").isNotNull() & F.col("s").isNotNull())).select("tile", "r", "c")


def dilate(px: DataFrame, radius: int, height: int, width: int) -> DataFrame:
    """(tile, r, c) within ``radius`` of a pixel given: a join with the disk's few offsets as an array, not a table."""
    disk = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]
    steps = F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in disk))
    moved = px.select("tile", "r", "c", F.explode(steps).alias("d")).select("tile", (F.col("r") + F.col("d.dr")).alias("r"), (F.col("c") + F.col("d.dc")).alias("c"))
    return moved.filter(F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1)).distinct()


def boundary_f(pred: DataFrame, truth: DataFrame, radius: int, height: int, width: int) -> DataFrame:
    """(tile, f): the boundary F-score of each tile of ``truth`` or ``pred`` (tile, r, c), matches within ``radius``."""
    tiles = pred.select("tile").union(truth.select("tile")).distinct()

    def share(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        near = dilate(b, radius, height, width).withColumn("hit", F.lit(1))
        return a.join(near, ["tile", "r", "c"], "left").groupBy("tile").agg((F.count("hit") / F.count(F.lit(1))).alias(name))

    both = tiles.join(share(pred, truth, "precision"), "tile", "left").join(share(truth, pred, "recall"), "tile", "left")
    p = F.coalesce("precision", F.lit(1.0))
    r = F.coalesce("recall", F.lit(1.0))
    p, r = F.when(F.col("precision").isNull() & F.col("recall").isNotNull(), 1.0).otherwise(p), F.when(F.col("recall").isNull() & F.col("precision").isNotNull(), 1.0).otherwise(r)
    p, r = F.when(F.col("recall").isNull() & F.col("precision").isNotNull(), 0.0).otherwise(p), F.when(F.col("precision").isNull() & F.col("recall").isNotNull(), 0.0).otherwise(r)
    return both.select("tile", F.when(p + r == 0, 0.0).otherwise(2.0 * p * r / (p + r)).alias("f"))


def confusion(pairs: DataFrame, n: int, truth: str = "truth", pred: str = "pred", ignore: int | None = None) -> DataFrame:
    """(truth, pred, n) for all class pairs, counted before the shuffle; labels outside 0..n-1 and ``ignore`` are left out."""
    ok = pairs.filter(F.col(truth).between(0, n - 1) & F.col(pred).between(0, n - 1))
    ok = ok if ignore is None else ok.filter(F.col(truth) != ignore)
    counted = ok.groupBy(F.col(truth).cast("int").alias("truth"), F.col(pred).cast("int").alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    spark = pairs.sparkSession
    full = spark.range(n * n).select(F.floor(F.col("id") / n).cast("int").alias("truth"), (F.col("id") % n).cast("int").alias("pred"))
    return full.join(counted, ["truth", "pred"], "left").select("truth", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def class_report(hist: DataFrame) -> DataFrame:
    """(cls, tp, fp, fn, iou, precision, recall, frequency) from a confusion matrix; ratios of nothing are null."""
    diagonal = F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)
    rows = hist.groupBy(F.col("truth").alias("cls")).agg(F.sum(diagonal).alias("tp"), F.sum("n").alias("actual"))
    cols = hist.groupBy(F.col("pred").alias("cls")).agg(F.sum("n").alias("predicted"))
    all_ = Window.partitionBy()
    tp, a, p = F.col("tp"), F.col("actual"), F.col("predicted")
    ratio = lambda x, y: x / F.nullif(y, F.lit(0))
    return rows.join(cols, "cls").select("cls", "tp", (p - tp).alias("fp"), (a - tp).alias("fn"), ratio(tp, a + p - tp).alias("iou"), ratio(tp, p).alias("precision"), ratio(tp, a).alias("recall"), ratio(a, F.sum("actual").over(all_)).alias("frequency"))


def image_failures(pairs: DataFrame) -> DataFrame:
    """(cls, tile, fp, fn, fail): wrong pixels of each class in each image, those of ``pairs`` (tile, truth, pred) that differ."""
    sides = F.array(F.struct(F.col("truth").alias("cls"), F.lit(0).alias("p")), F.struct(F.col("pred").alias("cls"), F.lit(1).alias("p")))
    wrong = pairs.filter("truth <> pred").select("tile", F.explode(sides).alias("s"))
    counted = wrong.groupBy(F.col("s.cls").alias("cls"), "tile").agg(F.sum("s.p").alias("fp"), F.count(F.lit(1)).alias("fail"))
    return counted.select("cls", "tile", "fp", (F.col("fail") - F.col("fp")).alias("fn"), "fail")


def image_errors(pairs: DataFrame) -> DataFrame:
    """(tile, wrong, correct): pixels of each image by whether the prediction is right."""
    return pairs.groupBy("tile").agg(F.count_if(F.col("truth") != F.col("pred")).alias("wrong"), F.count_if(F.col("truth") == F.col("pred")).alias("correct"))


def summary(report: DataFrame) -> DataFrame:
    """(mean_iou, accuracy, mean_recall, weighted_iou) over the classes that occur."""
    return report.select(F.avg("iou").alias("mean_iou"), (F.sum("tp") / F.sum(F.col("tp") + F.col("fn"))).alias("accuracy"), F.avg("recall").alias("mean_recall"), F.sum(F.col("frequency") * F.col("iou")).alias("weighted_iou"))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    raised = F.transform(logits, lambda v: F.exp(v - top))
    return F.transform(raised, lambda v: v / F.aggregate(raised, F.lit(0.0), lambda s, x: s + x))


def argmax(values: Column) -> Column:
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def class_centroids(px: DataFrame, tile_size: int) -> DataFrame:
    """(tile, tr, tc, v, cr, cc): centre of mass of each class in each square of the mask."""
    return px.groupBy("tile", F.floor(F.col("r") / tile_size).alias("tr"), F.floor(F.col("c") / tile_size).alias("tc"), "v").agg(F.floor(F.avg("r")).alias("cr"), F.floor(F.avg("c")).alias("cc"))


def class_weights(px: DataFrame, upper: float = 1.0) -> DataFrame:
    """(v, n, weight): weights that fall with a class's share."""
    counted = px.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("v", "n", (F.lit(upper) * (F.lit(1.0) - F.col("n") / F.sum("n").over(Window.partitionBy())) + F.lit(1.0)).alias("weight"))


def mostly_black(px: DataFrame, black: int = 0, share: float = 0.25) -> DataFrame:
    """Tiles of which more than ``share`` is black."""
    return px.groupBy("tile").agg(F.avg((F.col("v") == black).cast("double")).alias("black")).filter(F.col("black") > share)


def sliding_windows(sizes: DataFrame, crop: int, stride: int) -> DataFrame:
    """(id, r0, c0, height, width): crops over images (id, h, w); the last ones are shorter."""
    starts = lambda n: F.sequence(F.lit(0), F.greatest(F.ceil((F.col(n) - crop) / stride), F.lit(0)).cast("int") * stride, F.lit(stride))
    each = sizes.withColumn("r0", F.explode(starts("h"))).withColumn("c0", F.explode(starts("w")))
    return each.select("id", "r0", "c0", F.least(F.lit(crop), F.col("h") - F.col("r0")).alias("height"), F.least(F.lit(crop), F.col("w") - F.col("c0")).alias("width"))

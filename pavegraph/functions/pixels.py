"""Point operations on pixels and classes, and the scalar formulas around a segmentation model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Channel means and deviations of images scaled to 0..1. Fixed values.
MEAN = (0.485, 0.456, 0.406)
DEVIATION = (0.229, 0.224, 0.225)
#: Class colours: sidewalk, road, crosswalk, background. Fixed values.
PALETTE = ("0000ff", "008000", "ff0000", "000000")


def normalised(value: Column, channel: int) -> Column:
    return (value / F.lit(255.0) - F.lit(MEAN[channel])) / F.lit(DEVIATION[channel])


def restored(value: Column, channel: int) -> Column:
    return (value * F.lit(DEVIATION[channel]) + F.lit(MEAN[channel])) * F.lit(255.0)


def one_hot(value: Column, classes: int) -> Column:
    """An array of classes + 1 flags; the last stands for what is ignored."""
    return F.transform(F.sequence(F.lit(0), F.lit(classes)), lambda k: (k == value).cast("int"))


def colour(value: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, PALETTE)), value + 1)


def class_of_colour(rgb: Column) -> Column:
    return F.nullif(F.array_position(F.array(*map(F.lit, PALETTE)), rgb), F.lit(0)) - 1


#: The grey of a filler image. Fixed value.
GRAY = 50.0


def inverted(value: Column) -> Column:
    return F.lit(255) - value


def flipped(place: Column, size: int) -> Column:
    """The row or column of a pixel in the mirrored image."""
    return F.lit(size - 1) - place


def raw_id(train_id: Column) -> Column:
    """The label in files of a class in training."""
    return train_id + 1


def train_id(raw: Column, known: dict[int, int], ignore: int = 255) -> Column:
    """The class in training of a label in files; ``ignore`` for others, class 0 where there is no label."""
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return F.coalesce(F.when(raw.isNull(), F.lit(0)), F.try_element_at(table, raw), F.lit(ignore))


def has_alpha(channels: Column) -> Column:
    return channels == 4


def is_transparent(alphas: Column) -> Column:
    """Whether any of an image's alpha values is less than opaque."""
    return F.exists(alphas, lambda a: a < 255)


def flattened(value: Column, alpha: Column, ground: float = GRAY) -> Column:
    """A colour laid on an opaque ground by its alpha, rounded half up."""
    share = alpha / F.lit(255.0)
    return F.floor(value * share + F.lit(ground) * (F.lit(1.0) - share) + F.lit(0.5))


def blended(a: Column, b: Column, share: float) -> Column:
    """Rounded half up."""
    return F.floor(F.lit(1 - share) * a + F.lit(share) * b + F.lit(0.5))


def polynomial_rate(base: float, epoch: Column, epochs: int, power: float) -> Column:
    """The learning rate of a polynomial schedule."""
    return F.lit(base) * F.pow(F.lit(1.0) - epoch.cast("double") / F.lit(float(epochs)), F.lit(power))


def fused(predictions: Column, attention: Column) -> Column:
    """Predictions of scales, finest first, fused from the coarsest up: each one's attention weighs it against what is below."""
    pairs = F.reverse(F.arrays_zip(predictions.alias("p"), attention.alias("a")))
    rest = F.slice(pairs, 2, F.size(pairs) - 1)
    return F.aggregate(rest, F.element_at(pairs, 1)["p"], lambda s, x: x["a"] * x["p"] + (F.lit(1.0) - x["a"]) * s)

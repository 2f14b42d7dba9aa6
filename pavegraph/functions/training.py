"""The formulas around training a segmentation model, as columns: losses, weights, schedules, augmentation parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Operations of random augmentation with the ends of their ranges, in order. Fixed values.
AUGMENTATIONS = (
    ("Identity", 0.0, 1.0),
    ("ShearX", 0.0, 0.3),
    ("ShearY", 0.0, 0.3),
    ("TranslateX", 0.0, 0.33),
    ("TranslateY", 0.0, 0.33),
    ("Rotate", 0.0, 30.0),
    ("AutoContrast", 0.0, 1.0),
    ("Invert", 0.0, 1.0),
    ("Equalize", 0.0, 1.0),
    ("Solarize", 0.0, 110.0),
    ("Posterize", 4.0, 8.0),
    ("Color", 0.1, 1.9),
    ("Brightness", 0.1, 1.9),
    ("Sharpness", 0.1, 1.9),
)


def seeded(seed: int, *keys: Column | str) -> Column:
    """A number from 0 up to 1 that depends on the keys alone."""
    mixed = F.lit(seed).cast("long")
    for k in keys:
        mixed = (mixed * F.lit(31) + (F.col(k) if isinstance(k, str) else k)) % F.lit(2147483647)
    return ((mixed * F.lit(1103515245) + F.lit(12345)) % F.lit(2147483648)) / F.lit(2147483648.0)


def seeded_sql(seed: int, *keys: str) -> str:
    """The same number as SQL."""
    mixed = f"cast({seed} as bigint)"
    for k in keys:
        mixed = f"(({mixed} * 31 + {k}) % 2147483647)"
    return f"((({mixed} * 1103515245 + 12345) % 2147483648) / 2147483648e0)"


def log_softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    total = F.log(F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x))
    return F.transform(logits, lambda x: x - top - total)


def cross_entropy(logits: Column, target: Column, ignore: int | None = None) -> Column:
    """The loss of one pixel; null where the label is to be ignored."""
    loss = -F.get(log_softmax(logits), target)
    return loss if ignore is None else F.when(target != ignore, loss)


def binary_cross_entropy(logit: Column, target: Column) -> Column:
    """Of a logit and a target of 0 or 1, without overflow for large logits."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def balanced_weight(beta: Column, target: Column) -> Column:
    """The weight of a pixel when a share ``beta`` of the image is negative."""
    return F.lit(1.0) - beta + (F.lit(2.0) * beta - F.lit(1.0)) * target


def border_softmax(soft: Column, flags: Column) -> Column:
    """Log probabilities in which the classes flagged at a border share their sum."""
    shared = F.aggregate(F.zip_with(soft, flags, lambda p, f: p * f), F.lit(0.0), lambda s, x: s + x)
    return F.zip_with(soft, flags, lambda p, f: F.log(F.greatest(p, f * shared)))


def refined(target: Column, probability: Column, threshold: float, ignore: int) -> Column:
    """A label, or ``ignore`` where the model that made it was not sure enough."""
    return F.when(probability < threshold, F.lit(ignore)).otherwise(target)


def poly_rate(epoch: Column, epochs: int, power: float) -> Column:
    """The factor of a polynomial schedule."""
    return F.pow(F.lit(1.0) - epoch / F.lit(float(epochs)), F.lit(power))


def two_step_rate(epoch: Column, epochs: int, step: int, power: float, power2: float) -> Column:
    """A polynomial schedule with another power up to ``step``, at which both meet."""
    head = F.pow(F.lit(1.0) - epoch / F.lit(float(epochs)), F.lit(power))
    scale = (1 - step / epochs) ** power / (1 - step / epochs) ** power2
    return F.when(epoch < step, head).otherwise(F.lit(scale) * F.pow(F.lit(1.0) - epoch / F.lit(float(epochs)), F.lit(power2)))


def augmentation(choice: Column, level: float) -> tuple[Column, Column]:
    """Name and strength of the operation of number ``choice`` at a level of 0 to 30."""
    table = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(a).alias("low"), F.lit(b).alias("high")) for n, a, b in AUGMENTATIONS))
    op = F.get(table, choice)
    return op["name"], F.lit(level) / F.lit(30.0) * (op["high"] - op["low"]) + op["low"]


def jitter(number: Column, strength: float) -> Column:
    """A factor around 1 for a number of 0 to 1; never below 0."""
    low = max(0.0, 1.0 - strength)
    return F.lit(low) + number * F.lit(1.0 + strength - low)


def crop_start(number: Column, centre: Column, crop: Column, size: Column) -> Column:
    """Where a crop starts that covers a centre and lies in the image, for a number of 0 to 1."""
    start = centre - crop + F.floor(number * (crop + 1))
    return F.least(size - crop, F.greatest(F.lit(0), start))


def slide_margin(number: Column, size: Column, crop: Column) -> tuple[Column, Column]:
    """Margins before and after an image that is smaller than its crop, for a number of 0 to 1."""
    total = crop - size
    before = F.floor(number * (total + 1))
    return before, total - before


def centre_crop(size: Column, crop: Column) -> Column:
    """The start of a crop in the middle."""
    return F.round((size - crop) / F.lit(2.0)).cast("long")


def scaled_size(width: Column, height: Column, short: int) -> tuple[Column, Column]:
    """Width and height after the shorter side has become ``short``."""
    w = F.when(width <= height, F.lit(short)).otherwise(F.floor(F.lit(short) * width / height))
    h = F.when(width <= height, F.floor(F.lit(short) * height / width)).otherwise(F.lit(short))
    return w.cast("long"), h.cast("long")


def scale_key(prefix: str, scale: Column) -> Column:
    """The name of an output at a scale, such as pred_0.5x."""
    return F.concat(F.lit(prefix + "_"), scale.cast("string"), F.lit("x"))


def solarized(value: Column, threshold: float) -> Column:
    return F.when(value < threshold, value).otherwise(F.lit(255) - value)


def posterized(value: Column, bits: int) -> Column:
    """A byte with only its first bits."""
    return value.bitwiseAND(F.lit(256 - (1 << (8 - bits))))


def brightened(value: Column, factor: float) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor(value * factor)))

"""Model scoring over pages: input tensors, limits, user model, summaries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import indices, int_div, let, to_int
from .geometry import resize_nearest

MAX_ELEMENTS = 16 * 1024 * 1024
MAX_BATCH = 16
SAMPLE = 64
FLOATS = T.ArrayType(T.FloatType())


def tensor_size(height: Column, width: Column) -> Column:
    """Struct(h, w) for a model with free axes: aspect kept, 3*h*w capped."""
    h, w = (F.greatest(c, F.lit(1)).cast("bigint") for c in (height, width))
    scale = F.sqrt(F.lit(float(MAX_ELEMENTS)) / (F.lit(3) * h * w).cast("double"))
    big = h * w * 3 > MAX_ELEMENTS
    first = F.struct(
        F.when(big, F.greatest(F.floor(h * scale), F.lit(1))).otherwise(h).alias("h"),
        F.when(big, F.greatest(F.floor(w * scale), F.lit(1))).otherwise(w).alias("w"),
    )
    # Rounding can leave the product a step above the cap; the larger side gives way.
    def shrink(s: Column, _: Column) -> Column:
        over = (s["h"] * s["w"] * 3 > MAX_ELEMENTS) & (F.greatest(s["h"], s["w"]) > 1)
        taller = s["h"] >= s["w"]
        return F.struct(
            F.when(over & taller, s["h"] - 1).otherwise(s["h"]).alias("h"),
            F.when(over & ~taller, s["w"] - 1).otherwise(s["w"]).alias("w"),
        )

    def fit(s: Column) -> Column:
        """Sides so unequal that single steps do not do: the larger one is what the cap leaves it."""
        over = s["h"] * s["w"] * 3 > MAX_ELEMENTS
        left = lambda small: F.greatest(F.floor(F.lit(MAX_ELEMENTS) / (small * 3)), F.lit(1))
        return F.struct(
            F.when(over & (s["h"] >= s["w"]), left(s["w"])).otherwise(s["h"]).alias("h"),
            F.when(over & (s["h"] < s["w"]), left(s["h"])).otherwise(s["w"]).alias("w"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(4)), first, shrink, fit)


def resolve_layout(shape: list[int | None], layout: str = "auto") -> str:
    """nchw or nhwc; auto reads a last axis of 1 or 3 as channels."""
    if layout == "auto":
        return "nhwc" if len(shape) == 4 and shape[3] in (1, 3) else "nchw"
    return layout


def tensor_limits(batch: Column, channels: Column, height: Column, width: Column) -> Column:
    """First violated input rule, null when accepted."""
    cells = height.cast("decimal(38,0)") * width.cast("decimal(38,0)")
    return (
        F.when(~channels.isin(1, 3), F.concat(F.lit("channels not 1 or 3: "), channels.cast("string")))
        .when(batch > MAX_BATCH, F.concat(F.lit("batch over 16: "), batch.cast("string")))
        .when((cells * batch * channels > MAX_ELEMENTS) | (cells * 3 > MAX_ELEMENTS), "too many elements")
    )


def tensor_prepare(
    strips: DataFrame, height: int, width: int, channels: int = 3, layout: str = "nchw", scale: bool = True, batch: int = 1
) -> DataFrame:
    """page_id, shape, tensor ARRAY<FLOAT>.

    Lines are resampled without a shuffle; the only exchange gathers the
    (capped) model input of one page.
    """
    if channels not in (1, 3) or batch > MAX_BATCH or max(batch * channels, 3) * height * width > MAX_ELEMENTS:
        raise ValueError("model input outside the supported limits")
    small = resize_nearest(strips, width, height)
    bpp = F.col("bpp")

    def level(v: Column) -> Column:
        value = v.cast("float")
        return value / F.lit(255.0).cast("float") if scale else value

    def plane(c: int | None) -> Column:
        def sample(r: Column, x: Column) -> Column:
            part = [level(F.when(bpp == 1, r[x * bpp]).otherwise(F.get(r, x * bpp + k))).cast("float") for k in range(3)]
            if c is not None:
                return part[c]
            weight = [F.lit(w).cast("float") for w in (0.299, 0.587, 0.114)]
            red, green, blue = ((weight[k] * part[k]).cast("float") for k in range(3))
            return ((red + green).cast("float") + blue).cast("float")

        return let(F.col("row"), lambda r: F.transform(indices(F.col("width")), lambda x: sample(r, x)))

    names = [None] if channels == 1 else [0, 1, 2]
    lines = small.select("page_id", "y", F.array(*[plane(c) for c in names]).alias("planes"))
    page = lines.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("y", "planes"))).alias("lines"))
    if layout == "nhwc":
        one = F.flatten(
            F.transform(
                "lines",
                lambda line: F.flatten(
                    F.transform(indices(F.lit(width)), lambda x: F.transform(line["planes"], lambda p: p[x]))
                ),
            )
        )
        shape = [batch, height, width, channels]
    else:
        one = F.flatten(F.array(*[F.flatten(F.transform("lines", lambda line: line["planes"][c])) for c in range(channels)]))
        shape = [batch, channels, height, width]
    tensor = one if batch == 1 else F.flatten(F.array_repeat(one, batch))
    return page.select("page_id", F.array(*[F.lit(n) for n in shape]).alias("shape"), tensor.alias("tensor"))


def score_pages(
    tensors: DataFrame, make_predict_fn: Callable, shape: Sequence[int], output_type: T.DataType = FLOATS, batch_size: int = 16
) -> DataFrame:
    """Run a user model over prepared tensors in Arrow batches.

    ``shape`` is the one the tensors were prepared with.  The model sees the rows
    of a batch as the first axis; a leading 1 of the shape is left out, a larger
    one stays as an axis of each row.

    ``make_predict_fn`` follows ``pyspark.ml.functions.predict_batch_udf``: it
    loads the model once per Python worker and returns a NumPy batch function.
    """
    from pyspark.ml.functions import predict_batch_udf

    shape = list(shape[1:] if shape[0] == 1 else shape)
    predict = predict_batch_udf(
        make_predict_fn, return_type=output_type, batch_size=batch_size, input_tensor_shapes=[shape]
    )
    return tensors.withColumn("output", predict(F.col("tensor")))


def tensor_summary(df: DataFrame, column: str) -> DataFrame:
    """Attach size, min, max, mean and the first 64 values (non-finite null)."""
    values = F.col(column)
    # NaN never wins a minimum or maximum; an empty tensor is all zero.
    numbers = F.filter(values, lambda v: ~F.isnan(v))
    empty = F.size(values) == 0
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    finite = lambda v: ~F.isnan(v) & (F.abs(v) != float("inf"))
    return (
        df.withColumn("size", F.size(values))
        .withColumn("min", F.when(empty, 0.0).otherwise(F.coalesce(F.array_min(numbers).cast("double"), F.lit(float("inf")))))
        .withColumn("max", F.when(empty, 0.0).otherwise(F.coalesce(F.array_max(numbers).cast("double"), F.lit(float("-inf")))))
        .withColumn("mean", F.when(empty, 0.0).otherwise(F.try_divide(total, F.size(values))))
        .withColumn("sample", F.transform(F.slice(values, 1, SAMPLE), lambda v: F.when(finite(v), v.cast("double"))))
    )

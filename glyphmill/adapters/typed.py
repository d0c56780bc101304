"""Predictors whose answers are rows: points, masks or vectors, as a table function.

The function's columns follow from the predictor: those of the rows that it is
given, without prompt and image, and those of the predictor's kind.  A model is
made once in a worker process and serves all tasks that run there; inputs are put
into batches of like length inside a window, so that a batch isn't as slow as its
one long prompt; a batch that fails marks its own rows.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf

#: Columns of each kind of answer; a row for each item, and one of nulls where there is none.
KINDS = {
    "text": T.StructType([T.StructField("answer", T.StringType())]),
    "points": T.StructType([T.StructField("object_id", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]),
    "masks": T.StructType([T.StructField("mask_rle", T.StringType()), T.StructField("score", T.DoubleType())]),
    "vector": T.StructType([T.StructField("vector", T.ArrayType(T.DoubleType()))]),
}
#: Rows that are put into batches together; images that stay decoded in a process.
WINDOW, IMAGES = 512, 4


class Typed(Protocol):
    """What a model must offer: for each prompt and image path the rows of its kind."""

    def predict(self, prompts: list[str | None], images: list[str | None]) -> list[list[tuple]]: ...


@dataclass
class Maker:
    kind: str
    make: Callable[[], Typed]


#: Makers of predictors by name.
REGISTRY: dict[str, Maker] = {}


def register(name: str, kind: str, make: Callable[[], Typed]) -> None:
    if kind not in KINDS:
        raise KeyError(f"no kind {kind!r}; there are {', '.join(sorted(KINDS))}")
    REGISTRY[name] = Maker(kind, make)


_HELD: dict[str, Typed] = {}
_DECODED: OrderedDict[str, object] = OrderedDict()


def held(name: str, make: Callable[[], Typed]) -> Typed:
    """The model of a name, made once in this process; another one takes its place, so that two never fill a device."""
    if name not in _HELD:
        for model in _HELD.values():
            getattr(model, "unload", lambda: None)()
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def decoded(path: str, decode: Callable[[str], object]) -> object:
    """What ``decode`` makes of an image, kept for the last few images of this process."""
    if path in _DECODED:
        _DECODED.move_to_end(path)
    else:
        _DECODED[path] = decode(path)
        while len(_DECODED) > IMAGES:
            _DECODED.popitem(last=False)
    return _DECODED[path]


def batches(rows: list[tuple], size: int) -> list[list[int]]:
    """Numbers of rows (prompt, image) in batches of like length."""
    order = sorted(range(len(rows)), key=lambda k: len(rows[k][0] or ""))
    return [order[k : k + size] for k in range(0, len(order), size)]


def answered(model: Typed, rows: list[tuple], size: int, width: int) -> list[tuple[bool, str | None, list[tuple]]]:
    """(ok, error, items) of rows (prompt, image), in their order."""
    out: list = [None] * len(rows)
    for some in batches(rows, size):
        try:
            found = model.predict([rows[k][0] for k in some], [rows[k][1] for k in some])
            if len(found) != len(some) or any(len(item) != width for items in found for item in items):
                raise ValueError("the answers don't have the form of their kind")
            made = [(True, None, items) for items in found]
        except Exception as e:  # a model's failure is a result
            made = [(False, f"{type(e).__name__}: {e}", [])] * len(some)
        for k, one in zip(some, made):
            out[k] = one
    return out


def table_function(makers: dict[str, Maker] | None = None):
    """The table function (rows, name, batch) over the predictors that are registered now."""
    known = dict(REGISTRY if makers is None else makers)

    class Predict:
        @staticmethod
        def analyze(rows: AnalyzeArgument, name: AnalyzeArgument, batch: AnalyzeArgument) -> AnalyzeResult:
            if name.value not in known:
                raise KeyError(f"no predictor {name.value!r}; there are {', '.join(sorted(known))}")
            keys = [f for f in rows.dataType.fields if f.name not in ("prompt", "image")]
            ok = [T.StructField("ok", T.BooleanType()), T.StructField("error", T.StringType())]
            return AnalyzeResult(schema=T.StructType([*keys, *ok, *KINDS[known[name.value].kind].fields]))

        def __init__(self) -> None:
            self.waiting: list[Row] = []
            self.name, self.size = "", 1

        def eval(self, rows: Row, name: str, batch: int) -> Iterator[tuple]:
            self.name, self.size = name, batch
            self.waiting.append(rows)
            if len(self.waiting) >= WINDOW:
                yield from self.flush()

        def terminate(self) -> Iterator[tuple]:
            yield from self.flush()

        def flush(self) -> Iterator[tuple]:
            if not self.waiting:
                return
            maker, waiting, self.waiting = known[self.name], self.waiting, []
            from glyphmill.adapters import typed  # of this process, where models stay

            width = len(KINDS[maker.kind].fields)
            asked = [(getattr(r, "prompt", None), getattr(r, "image", None)) for r in waiting]
            for r, (ok, error, items) in zip(waiting, typed.answered(typed.held(self.name, maker.make), asked, self.size, width)):
                keys = [v for c, v in zip(r.__fields__, r) if c not in ("prompt", "image")]
                for item in items or [(None,) * width]:
                    yield (*keys, ok, error, *item)

    return udtf(Predict)


def predict(rows: DataFrame, name: str, batch: int = 32) -> DataFrame:
    """The columns of ``rows`` without prompt and image, then ok, error and those of the predictor's kind."""
    return table_function()(rows.asTable(), F.lit(name), F.lit(batch))


def similarities(pairs: DataFrame, name: str, key: str, one: str, other: str, batch: int = 32) -> DataFrame:
    """(key, similarity) of the images at two paths, by a predictor of vectors; null where one has none. Each image is embedded once."""
    from glyphmill.functions.vectors import cosine

    images = pairs.select(F.explode(F.array(one, other)).alias("image")).where(F.col("image").isNotNull()).distinct().withColumn("path", F.col("image"))
    vectors = predict(images, name, batch).where("ok").select("path", "vector")
    first, second = vectors.select(F.col("path").alias(one), F.col("vector").alias("v1")), vectors.select(F.col("path").alias(other), F.col("vector").alias("v2"))
    return pairs.select(key, one, other).join(first, one, "left").join(second, other, "left").select(key, cosine(F.col("v1"), F.col("v2")).alias("similarity"))

"""Masks as run lengths, column by column, and as numpy arrays.

A mask travels as STRUCT<h INT, w INT, counts ARRAY<INT>>: runs of clear and
set pixels in turn, down the columns.  The text form is the compressed
run-length string of the COCO format in JSON.

What is done with masks as columns, from text to set operations, overlap and
resizing, is expressions over their runs: two masks meet by the places where
either changes, in order, and no pixel is made.  The numpy forms are for images.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.functions.text import let

KIND = T.StructType([T.StructField("h", T.IntegerType()), T.StructField("w", T.IntegerType()), T.StructField("counts", T.ArrayType(T.IntegerType()))])


def encode(mask: np.ndarray) -> dict:
    """Run lengths of a boolean array."""
    flat = np.asarray(mask, bool).ravel(order="F")
    edges = np.flatnonzero(np.diff(flat)) + 1
    counts = np.diff(np.concatenate([[0], edges, [flat.size]]))
    if flat.size and flat[0]:
        counts = np.concatenate([[0], counts])
    return {"h": int(mask.shape[0]), "w": int(mask.shape[1]), "counts": counts.astype(np.int32).tolist()}


def decode(mask: dict) -> np.ndarray:
    """Boolean array of run lengths."""
    counts = np.asarray(mask["counts"], np.int64)
    return np.repeat(np.arange(len(counts)) % 2 == 1, counts).reshape((mask["h"], mask["w"]), order="F")


def to_text(mask: dict) -> str:
    """JSON with the compressed string: five bits a character, each run less the one two before it."""
    out = []
    counts = mask["counts"]
    for i, c in enumerate(counts):
        x = int(c) - (int(counts[i - 2]) if i > 2 else 0)
        while True:
            low, x = x & 31, x >> 5
            last = x == (-1 if low & 16 else 0)
            out.append(chr(48 + (low if last else low | 32)))
            if last:
                break
    return json.dumps({"size": [mask["h"], mask["w"]], "counts": "".join(out)})


def from_text(text: str) -> dict:
    form = json.loads(text)
    counts: list[int] = []
    value = shift = 0
    for ch in form["counts"]:
        bits = ord(ch) - 48
        value |= (bits & 31) << shift
        shift += 5
        if not bits & 32:
            if bits & 16:
                value -= 1 << shift
            counts.append(value + (counts[-2] if len(counts) > 2 else 0))
            value = shift = 0
    return {"h": form["size"][0], "w": form["size"][1], "counts": counts}


def area(mask: Column) -> Column:
    """Set pixels: the sum of every second run."""
    return F.aggregate(F.filter(mask["counts"], lambda c, i: i % 2 == 1), F.lit(0).cast("long"), lambda s, c: s + c)


def bbox(mask: Column | str) -> Column:
    """Struct (x0, y0, x1, y1, empty): extents of the set pixels, both ends inclusive, from the runs alone; zeros for an empty mask.

    A run that reaches into another column covers the whole height.
    """
    mask = F.col(mask) if isinstance(mask, str) else mask
    h = F.greatest(mask["h"], F.lit(1)).cast("long")
    none = F.lit(None).cast("long")

    def step(acc: Column, run: Column) -> Column:
        start, end = acc["at"], acc["at"] + run - 1
        left, right = F.floor(start / h), F.floor(end / h)
        across, counts = left != right, acc["set"] & (run > 0)
        least = lambda name, v: F.when(counts, F.least(acc[name], v)).otherwise(acc[name]).alias(name)
        most = lambda name, v: F.when(counts, F.greatest(acc[name], v)).otherwise(acc[name]).alias(name)
        return F.struct((acc["at"] + run).alias("at"), (~acc["set"]).alias("set"), least("x0", left), least("y0", F.when(across, 0).otherwise(start % h)), most("x1", right), most("y1", F.when(across, h - 1).otherwise(end % h)))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(False).alias("set"), *[none.alias(n) for n in ("x0", "y0", "x1", "y1")])
    sides = ("x0", "y0", "x1", "y1")
    return F.aggregate(mask["counts"], zero, step, lambda acc: F.struct(*[F.coalesce(acc[n].cast("double"), F.lit(0.0)).alias(n) for n in sides], acc["x0"].isNull().alias("empty")))


#: Elements of an array that a step of ``running`` puts together.
PIECE = 256


def running(values: Column, zero: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """The states after each of some values, of a type ``kind``; in pieces, so that a long array isn't copied at each step."""

    def one(acc: Column, v: Column) -> Column:
        return let(step(acc["state"], v), lambda s: F.struct(s.alias("state"), F.concat(acc["out"], F.array(s)).alias("out")))

    def piece(acc: Column, part: Column) -> Column:
        start = F.struct(acc["state"].alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
        return let(F.aggregate(part, start, one), lambda i: F.struct(i["state"].alias("state"), F.concat(acc["out"], F.array(i["out"])).alias("out")))

    def all_(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(v) - 1) / PIECE), F.lit(0)).cast("int")), lambda k: F.slice(v, k * PIECE + 1, PIECE))
        return F.flatten(F.aggregate(parts, F.struct(zero.cast(kind).alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out")), piece)["out"])

    return let(values, all_)


def _column(mask: Column | str) -> Column:
    return F.col(mask) if isinstance(mask, str) else mask


def _ends(mask: Column) -> Column:
    """Where each run ends."""
    return running(mask["counts"], F.lit(0), lambda s, c: s + c.cast("long"), "bigint")


def _of_flips(h: Column, w: Column, flips: Column) -> Column:
    """A mask of a size from the places, in order, where clear and set pixels change."""
    total = h.cast("long") * w
    return let(F.concat(F.filter(flips, lambda p: p < total), F.array(total)), lambda ends: F.struct(h.alias("h"), w.alias("w"), F.transform(ends, lambda e, i: (e - F.when(i > 0, F.get(ends, i - 1)).otherwise(0)).cast("int")).alias("counts")))


def _merged(a: Column, b: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the changes (at, mine) of two masks in order; null for masks of different sizes."""
    changes = lambda m, mine: let(_ends(m), lambda e: F.transform(F.slice(e, F.lit(1), F.size(e) - 1), lambda x: F.struct(x.alias("at"), F.lit(mine).alias("mine"))))
    return F.when((a["h"] == b["h"]) & (a["w"] == b["w"]), let(F.array_sort(F.concat(changes(a, True), changes(b, False))), body))


def overlap(a: Column | str, b: Column | str) -> Column:
    """Struct (both, either): pixels that are set in both masks, and in any; from their runs, without a pixel."""
    a, b = _column(a), _column(b)
    total = a["h"].cast("long") * a["w"]

    def upto(acc: Column, at: Column) -> list[Column]:
        d = at - acc["at"]
        return [(acc["both"] + F.when(acc["a"] & acc["b"], d).otherwise(0)).alias("both"), (acc["either"] + F.when(acc["a"] | acc["b"], d).otherwise(0)).alias("either")]

    def step(acc: Column, e: Column) -> Column:
        return F.struct(e["at"].alias("at"), F.when(e["mine"], ~acc["a"]).otherwise(acc["a"]).alias("a"), F.when(e["mine"], acc["b"]).otherwise(~acc["b"]).alias("b"), *upto(acc, e["at"]))

    no, none = F.lit(False), F.lit(0).cast("long")
    zero = F.struct(none.alias("at"), no.alias("a"), no.alias("b"), none.alias("both"), none.alias("either"))
    return _merged(a, b, lambda events: F.aggregate(events, zero, step, lambda acc: F.struct(*upto(acc, total))))


def iou(a: Column | str, b: Column | str) -> Column:
    """Intersection over union of two masks of a size; 1 where both are empty, null for masks of different sizes."""
    return let(overlap(a, b), lambda o: F.when(o["either"] > 0, o["both"] / o["either"]).when(o["either"] == 0, F.lit(1.0)))


def _combine(how: Callable[[Column, Column], Column]) -> Callable:
    def both(a: Column | str, b: Column | str) -> Column:
        a, b = _column(a), _column(b)
        kind = "struct<at:bigint,a:boolean,b:boolean>"
        step = lambda s, e: F.struct(e["at"].alias("at"), F.when(e["mine"], ~s["a"]).otherwise(s["a"]).alias("a"), F.when(e["mine"], s["b"]).otherwise(~s["b"]).alias("b"))
        zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("a"), F.lit(False).alias("b"))
        # of several changes at one place the last one tells, and only where the outcome changes there is a run's end
        settled = lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i + 1)["at"] != x["at"], F.lit(True)))
        out = lambda s: F.transform(s, lambda x: F.struct(x["at"].alias("at"), how(x["a"], x["b"]).alias("set")))
        flips = lambda s: F.transform(F.filter(s, lambda x, i: x["set"] != F.coalesce(F.get(s, i - 1)["set"], F.lit(False))), lambda x: x["at"])
        return _merged(a, b, lambda events: let(let(running(events, zero, step, kind), lambda s: out(settled(s))), lambda s: _of_flips(a["h"], a["w"], flips(s))))

    return both


union = _combine(lambda p, q: p | q)
intersection = _combine(lambda p, q: p & q)
difference = _combine(lambda p, q: p & ~q)


def resized(mask: Column | str, h: Column, w: Column) -> Column:
    """A mask at another size, each pixel that of the nearest place above and to the left; from the runs, column by column."""
    mask = _column(mask)
    old_h, old_w = mask["h"].cast("long"), mask["w"].cast("long")
    h, w = h.cast("long"), w.cast("long")
    up = lambda x, new, old: F.floor((x * new + old - 1) / old).cast("long")
    # exact for whole numbers of this size
    runs = let(_ends(mask), lambda e: F.filter(F.transform(e, lambda x, i: F.struct((i % 2 == 1).alias("set"), F.when(i > 0, F.get(e, i - 1)).otherwise(F.lit(0)).alias("start"), x.alias("end"))), lambda r: r["set"] & (r["end"] > r["start"])))
    column = lambda r, x: F.struct(x.alias("x"), F.greatest(r["start"] - x * old_h, F.lit(0)).alias("y0"), F.least(r["end"] - x * old_h, old_h).alias("y1"))
    columns = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.floor(r["start"] / old_h).cast("long"), F.floor((r["end"] - 1) / old_h).cast("long")), lambda x: column(r, x))))
    none = F.array().cast("array<array<bigint>>")

    def spread(c: Column) -> Column:
        x0, x1, y0, y1 = up(c["x"], w, old_w), up(c["x"] + 1, w, old_w) - 1, up(c["y0"], h, old_h), up(c["y1"], h, old_h)
        return F.when((x0 <= x1) & (y0 < y1), F.transform(F.sequence(x0, F.greatest(x0, x1)), lambda x: F.array(x * h + y0, x * h + y1))).otherwise(none)

    places = F.array_sort(F.flatten(F.flatten(F.transform(columns, spread))))
    # where one run ends and the next begins nothing changes
    alone = lambda p: F.filter(p, lambda x, i: ~F.coalesce(F.get(p, i - 1) == x, F.lit(False)) & ~F.coalesce(F.get(p, i + 1) == x, F.lit(False)))
    return _of_flips(h.cast("int"), w.cast("int"), let(places, alone))


def text_of(mask: Column | str) -> Column:
    """JSON with the compressed string: five bits a character, each run less the one two before it."""
    mask = _column(mask)

    def spelled(x: Column) -> Column:
        size = F.coalesce(*[F.when(x.between(-16 * 32**k, 16 * 32**k - 1), F.lit(k + 1)) for k in range(6)], F.lit(7))
        bits = lambda j: F.pmod(F.call_function("shiftright", x, j * 5), F.lit(32))
        return let(size, lambda n: F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.char(bits(j) + F.when(j < n - 1, 80).otherwise(48))), ""))

    counts = let(mask["counts"], lambda c: F.array_join(F.transform(c, lambda x, i: let(x.cast("long") - F.when(i > 2, F.get(c, i - 2)).otherwise(0), spelled)), ""))
    return F.concat(F.lit('{"size": ['), mask["h"].cast("string"), F.lit(", "), mask["w"].cast("string"), F.lit('], "counts": "'), F.replace(counts, F.lit("\\"), F.lit("\\\\")), F.lit('"}'))


#: Counts of the compressed form: characters with more to come, then one without; seven at most.
RUNS, RUN, LONGER = r"^(?:[0-o]*[0-O])?$", r"[P-o]*[0-O]", r"[P-o]{7}"


def of_text(text: Column | str) -> Column:
    """A mask of its text form; null for text that is none, or whose runs don't fill its size."""
    form = F.from_json(_column(text), "size array<int>, counts string")

    def run(chars: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("value"), F.lit(1).cast("long").alias("unit"), F.lit(0).alias("bits"))
        step = lambda acc, c: let(F.ascii(c) - 48, lambda b: F.struct((acc["value"] + F.pmod(b, F.lit(32)) * acc["unit"]).alias("value"), (acc["unit"] * 32).alias("unit"), F.pmod(b, F.lit(32)).alias("bits")))
        return F.aggregate(F.split(chars, ""), zero, step, lambda acc: acc["value"] - F.when(acc["bits"] >= 16, acc["unit"]).otherwise(0))

    kind = "struct<i:int,before:bigint,value:bigint>"
    step = lambda s, d: F.struct((s["i"] + 1).alias("i"), s["value"].alias("before"), (d + F.when(s["i"] > 2, s["before"]).otherwise(0)).alias("value"))
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("before"), F.lit(0).alias("value"))
    counts = lambda f: F.transform(running(F.transform(F.regexp_extract_all(f["counts"], F.lit(RUN), F.lit(0)), run), zero, step, kind), lambda s: s["value"])

    def whole(f: Column) -> Column:
        h, w = F.get(f["size"], F.lit(0)), F.get(f["size"], F.lit(1))
        sized = (F.size(f["size"]) == 2) & (h >= 0) & (w >= 0) & f["counts"].rlike(RUNS) & ~f["counts"].rlike(LONGER)
        full = lambda c: F.forall(c, lambda x: (x >= 0) & (x <= 2**31 - 1)) & (F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x) == h.cast("long") * w)
        return F.when(sized, let(counts(f), lambda c: F.when(full(c), F.struct(h.alias("h"), w.alias("w"), F.transform(c, lambda x: x.cast("int")).alias("counts")))))

    return let(form, whole)


def largest(rows: DataFrame, key: str, n: int = 0) -> DataFrame:
    """Rows with a mask by area, the largest first; ``n`` of them if given."""
    ordered = rows.withColumn("area", area(F.col("mask"))).orderBy(F.desc("area"), key)
    return ordered.limit(n) if n else ordered

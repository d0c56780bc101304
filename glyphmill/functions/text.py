"""Structured text: code blocks, JSON answers and tags in model output, ids, digests.

JSON answers of boxes and scores are read as VARIANT, item by item, so one bad
item costs only itself; edges are read so in Python, an Arrow batch at once.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

# Marks, prefixes, patterns and messages of the formats that are read.
THINK_END = "</think>"
FENCE = "```"
FORMATS = {
    "tikz": {"start": "\\documentclass", "end": "\\end{document}"},
    "svg": {"start": "<svg", "end": "</svg>"},
}
SAMPLE_ID = r"^([A-Za-z]+)_(\d{4})_(arch|pipe)(\d+)$"
COORDS = r'(?d)<(?:points|tracks).*? coords="([0-9\t:;, .]+)"/?>'
POINT = r"([0-9]+ [0-9]{3,4} [0-9]{3,4})"
NO_CODE, CUT_OFF = "no {start} found in model output", " -- likely truncated by max_new_tokens before reaching the answer"
BAD_SCORE, BAD_ANSWER = "score out of range: ", "could not parse judge output: "


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def after_thinking(text: Column) -> Column:
    """What follows the first end of a reasoning part, or all of it."""
    at = F.instr(text, THINK_END)
    return F.when(at > 0, F.substring(text, at + len(THINK_END), F.length(text))).otherwise(text)


def longest_block(text: Column) -> Column:
    """The longest part between pairs of fences, the first on a tie; the text itself where there is no fence."""
    inside = F.filter(F.split(text, FENCE, -1), lambda part, i: i % 2 == 1)
    longest = F.aggregate(inside, F.lit(""), lambda best, part: F.when(F.length(part) > F.length(best), part).otherwise(best))
    return F.when(F.contains(text, F.lit(FENCE)), longest).otherwise(text)


def extract_code(text: Column, kind: str) -> Column:
    """Code of a kind from model output, or null: from its start to its first end, or to the end of output that was cut off.

    A language's name at the start of a fenced block stands before the code's
    start, so it falls away with what else does.
    """
    start, end = (rf"\Q{FORMATS[kind][k]}\E" for k in ("start", "end"))
    body = longest_block(strip(after_thinking(strip(text))))
    return F.nullif(F.regexp_extract(strip(body), rf"(?s)({start}.*?{end}|{start}.*)", 1), F.lit(""))


def failure_reason(text: Column, kind: str = "tikz") -> Column:
    """Why no code was found: the output ends before the answer that follows the reasoning part, or there is no start of code."""
    none = NO_CODE.format(start=FORMATS[kind]["start"])
    cut = F.contains(text, F.lit(THINK_END)) & ~F.contains(after_thinking(text), F.lit(FORMATS[kind]["start"]))
    return F.when(extract_code(text, kind).isNotNull(), F.lit(None).cast("string")).when(cut, F.lit(none + CUT_OFF)).otherwise(F.lit(none))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: JSON as the standard has it, as models' answers are read.
STRICT = {"allowSingleQuotes": "false"}
#: Numbers as text: whole ones, and others; and underscores that don't stand between digits.  No group repeats, as those take stack by their repeats.
WHOLE = r"\s*[+-]?\d[\d_]*\s*"
REAL = r"(?i)^\s*[+-]?(?:(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:e[+-]?\d[\d_]*)?|inf(?:inity)?|nan)\s*$"
ASTRAY = r"(?<!\d)_|_(?!\d)"
#: JSON of answers that are read item by item in Python; whole numbers of more digits than any mark has are none.
PLAIN = json.JSONDecoder(parse_int=lambda digits: int(digits) if len(digits) < 100 else None)
EDGES = ArrayType(StructType([StructField("src", IntegerType()), StructField("dst", IntegerType())]))
LARGEST = 2**31


def real(text: Column) -> Column:
    """The number that a text is, null if it is none."""
    return F.when(text.rlike(REAL) & ~text.rlike(ASTRAY), F.regexp_replace(F.trim(text), "_", "").try_cast("double"))


def _span(text: Column, opening: str, closing: str) -> Column:
    """The widest span between the marks, null if there is none."""
    return F.nullif(F.regexp_extract(text, rf"(?s)\{opening}.*\{closing}", 0), F.lit(""))


def _read(span: Column, kind: str, empty: str) -> Column:
    """A span as one JSON value of a kind, else null.

    The parser stops after the first value, so the span is read as the first of
    two items, of which the other one is ``empty``.
    """
    items = F.from_json(F.concat(F.lit("["), span, F.lit(f",{empty}]")), f"array<{kind}>", STRICT)
    return let(items, lambda i: F.when(F.size(i) == 2, F.get(i, F.lit(0))))


def json_items(text: Column) -> Column:
    """Items of the widest JSON array in a text, as an array of VARIANT."""
    read = lambda span: F.try_variant_get(_read(span, "variant", "[]"), "$", "array<variant>")
    return F.coalesce(let(_span(text, "[", "]"), read), F.array().cast("array<variant>"))


def whole(x: Column) -> Column:
    """A whole number: numbers lose their fraction, true is 1, and text counts only if it is a whole number itself."""

    def read(t: Column) -> Column:
        quoted = F.when(t.rlike(f'^"{WHOLE}"$') & ~t.rlike(ASTRAY), F.regexp_replace(t, r'["\s+_]', "").try_cast("long"))
        return F.when(F.startswith(t, F.lit('"')), quoted).when(t.isin("true", "false"), (t == "true").cast("long")).otherwise(F.coalesce(t.try_cast("long"), t.try_cast("double").try_cast("long")))

    return let(F.to_json(x), read)


def _real(v: Column) -> Column:
    """A number, or text that is one."""
    kind, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    return F.when(kind == "STRING", real(text)).otherwise(F.try_variant_get(v, "$", "double"))


def _pairs(answer: str | None) -> list[tuple[int, int]]:
    """The edges of one answer."""
    if answer is None or not 0 <= (start := answer.find("[")) < (end := answer.rfind("]") + 1):
        return []
    try:
        items = PLAIN.decode(answer[start:end])
    except (ValueError, RecursionError):
        return []
    pairs = []
    for item in items:
        # what is no object, or has no "from", is known without an error, which costs more than reading the item
        if type(item) is not dict or "from" not in item or "to" not in item:
            continue
        try:
            src, dst = int(item["from"]), int(item["to"])
        except (TypeError, ValueError, OverflowError):
            continue
        if -LARGEST <= src < LARGEST and -LARGEST <= dst < LARGEST:
            pairs.append((src, dst))
    return pairs


@arrow_udf(EDGES)
def _edges(texts: pa.Array) -> pa.Array:
    found = [_pairs(t) for t in texts.to_pylist()]
    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
    src, dst = (pa.array([p[k] for pairs in found for p in pairs], pa.int32()) for k in (0, 1))
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([src, dst], ["src", "dst"]))


def edges(text: Column) -> Column:
    """Pairs (src, dst) of whole numbers under "from" and "to"; items without both are skipped, and numbers that no mark can have.

    Each answer is parsed once, whatever its items are; of keys that repeat the
    last one counts.
    """
    return _edges(text)


def boxes(text: Column, valid_ids: Column) -> Column:
    """Boxes (object_id, x0, y0, x1, y1) of known objects that have four sides in order; other items are skipped.

    Four digits as text are four sides, as any sequence of four numbers is.
    """

    def read(v: Column) -> Column:
        named = F.try_variant_get(v, "$.box", "array<variant>")
        digits = F.when(F.schema_of_variant(F.try_variant_get(v, "$.box", "variant")) == "STRING", F.try_variant_get(v, "$.box", "string"))
        spelled = F.when(digits.rlike(r"^\d{4}$"), F.transform(F.split(digits, ""), lambda c: c.try_cast("double")))
        return F.struct(whole(F.try_variant_get(v, "$.object_id", "variant")).try_cast("int").alias("object_id"), F.coalesce(F.transform(named, _real), spelled).alias("s"))

    # a side that is no number is out of order with none
    apart = lambda low, high: low.isNotNull() & high.isNotNull() & (F.isnan(low) | F.isnan(high) | (high > low))
    found = F.filter(F.transform(json_items(after_thinking(text)), read), lambda b: F.array_contains(valid_ids, b["object_id"]) & (F.size(b["s"]) == 4) & apart(b["s"][0], b["s"][2]) & apart(b["s"][1], b["s"][3]))
    return F.transform(found, lambda b: F.struct(b["object_id"].alias("object_id"), *[b["s"][k].alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))]))


def judge(text: Column) -> Column:
    """Struct (score, reason): a whole score from 1 to 5 and its rationale, else null and what is wrong.

    Of keys that repeat the last one counts.
    """

    def read(p: Column) -> Column:
        why = F.when(p["why"].isNull(), F.lit("")).when(~F.is_variant_null(p["why"]), F.try_variant_get(p["why"], "$", "string"))
        reason = F.when(p["score"].between(1, 5), why).when(p["score"].isNotNull(), F.concat(F.lit(BAD_SCORE), p["score"].cast("string"))).otherwise(F.concat(F.lit(BAD_ANSWER), F.substring(text, 1, 200)))
        return F.struct(F.when(p["score"].between(1, 5), p["score"].cast("int")).alias("score"), reason.alias("reason"))

    at = lambda a, path: F.try_variant_get(a, path, "variant")

    def parts(span: Column) -> Column:
        once = let(_read(span, "variant", "{}"), lambda a: F.when(a.isNotNull(), F.struct(whole(at(a, "$.score")).alias("score"), at(a, "$.rationale").alias("why"))))
        again = let(_read(span, "struct<score:variant,rationale:variant>", "{}"), lambda a: F.struct(whole(a["score"]).alias("score"), a["rationale"].alias("why")))
        return F.coalesce(once, again)

    return let(let(_span(text, "{", "}"), parts), read)


def point_tags(text: Column, width: Column, height: Column) -> Column:
    """Points (object_id, x, y) from coords of points and tracks tags in thousandths of the image; points outside are skipped, and ids beyond 64 bits."""
    lists = F.regexp_extract_all(text, F.lit(COORDS), F.lit(1))
    triples = F.flatten(F.transform(lists, lambda s: F.regexp_extract_all(s, F.lit(POINT), F.lit(1))))

    def read(s: Column) -> Column:
        part = F.split(s, " ")
        return F.struct(part[0].try_cast("long").alias("object_id"), (part[1].cast("double") / 1000 * width).alias("x"), (part[2].cast("double") / 1000 * height).alias("y"))

    return F.filter(F.transform(triples, read), lambda p: p["object_id"].isNotNull() & p["x"].between(F.lit(0), width) & p["y"].between(F.lit(0), height))


def sample_name(sample_id: Column) -> Column:
    """Struct (venue, year, kind) of an id like ``ICML_2020_arch12``; nulls for other ids."""
    return F.struct(*[captured(sample_id, SAMPLE_ID, k).alias(n) for k, n in enumerate(("venue", "year", "kind"), 1)])


def captured(text: Column, pattern: str, group: int) -> Column:
    """A group of a pattern, null where the pattern doesn't match."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def digest(text: Column, length: int = 16) -> Column:
    """The first hex digits of the SHA-256 of a text."""
    return F.substring(F.sha2(text, 256), 1, length)


def parse_box(text: Column) -> Column:
    """Four numbers separated by white space as a box; anything else raises."""
    part = F.split(strip(text), r"\s+")
    checked = F.when(F.size(part) == 4, part).otherwise(F.raise_error(F.concat(F.lit("not four numbers: "), text)))
    return F.struct(*[checked[k].cast("double").alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))])


@pandas_udf(StringType())
def fixed2(value: pd.Series) -> pd.Series:
    """Two decimals, rounding the exact binary value, as documents are printed."""
    return value.map(lambda x: None if x != x else f"{x:.2f}")


@pandas_udf(StringType())
def fixed4(value: pd.Series) -> pd.Series:
    """Four decimals, as confidences are printed."""
    return value.map(lambda x: None if x != x else f"{x:.4f}")


def box_text(b: Column) -> Column:
    return F.concat_ws(" ", *[fixed2(b[n]) for n in ("x0", "y0", "x1", "y1")])


def legend(names: Column) -> Column:
    """Numbered lines from 0 for an array of names."""
    return F.array_join(F.transform(names, lambda n, i: F.format_string("%d: %s", i, n)), "\n")

"""Sources and sinks: image folders, layouts of samples, JSON lines, XML documents, annotation tables, exports.

Readers go through Spark, so paths may be in any store that Spark reads.
"""

from __future__ import annotations

import io
import json
import os
import uuid
import zipfile
from collections.abc import Iterator
from xml.parsers import expat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import IntegerType, StructField, StructType

from glyphmill.functions import text as T
from glyphmill.operators import layout
from glyphmill.sources.numbers import file_system, take_number

# Endings, names and folders that hold the files of a sample.
IMAGE_TYPES = (".png", ".jpg", ".jpeg", ".PNG", ".JPG", ".JPEG")
PREFERRED_NAMES = ("input", "image", "gt", "ground_truth", "original", "target")
CODE_FOLDER, LAYOUT_FOLDER, IMAGE_FOLDER, CROPS_FOLDER = "tex_files", "xml_files", "original_images", "crops"
RENDERED_FOLDER, PDF_FOLDER, FAILED_FOLDER = "tex_images", "tex_pdfs", "failure_cases"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def listing(spark: SparkSession, root: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """Rows (path, name, id) of the files under a folder; the content isn't read.  No rows for a missing folder."""
    if not exists(spark, root):
        return spark.createDataFrame([], "path string, name string, id string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(root).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("id"))


def discover_images(spark: SparkSession, root: str, images: str = "images") -> DataFrame:
    """The ``.png`` images of a flat folder by name, with the layout and code that go with each, if there are any."""
    found = listing(spark, f"{root}/{images}", "*.png").select("id", F.col("path").alias("image_path"))
    tex = listing(spark, f"{root}/{CODE_FOLDER}", "*.tex").select("id", F.col("path").alias("gt_tex_path"))
    xml = listing(spark, f"{root}/{LAYOUT_FOLDER}", "layout_*.xml").select(F.regexp_replace("id", "^layout_", "").alias("id"), F.col("path").alias("gt_xml_path"))
    return found.join(tex, "id", "left").join(xml, "id", "left").orderBy("id")


def _qualified(spark: SparkSession, path: str) -> str:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def discover_samples(spark: SparkSession, root: str) -> DataFrame:
    """Samples of a folder: by id where it has code and image folders, else every code file below it; no rows without the folder."""
    if exists(spark, f"{root}/{CODE_FOLDER}") and exists(spark, f"{root}/{IMAGE_FOLDER}"):
        base = listing(spark, f"{root}/{CODE_FOLDER}", "*.tex").select("id", F.col("path").alias("tex_path"))
        for folder, pattern, column in ((IMAGE_FOLDER, "*.png", "image_path"), (RENDERED_FOLDER, "*.png", "rendered_path"), (PDF_FOLDER, "*.pdf", "pdf_path")):
            base = base.join(listing(spark, f"{root}/{folder}", pattern).select("id", F.col("path").alias(column)), "id", "left")
        failed = listing(spark, f"{root}/{FAILED_FOLDER}", "*.log").select("id", F.lit(True).alias("failed"))
        base = base.join(failed, "id", "left").withColumn("failed_compile", F.coalesce("failed", F.lit(False))).drop("failed").withColumn("named", T.sample_name(F.col("id")))
    else:
        whole = _qualified(spark, root).rstrip("/") + "/"
        base = listing(spark, root, "*.tex", True).select(F.regexp_replace(F.expr(f"substr(path, {len(whole) + 1})"), r"\.tex$", "").alias("id"), F.col("path").alias("tex_path"))
        base = base.join(best_images(listing(spark, root, "*", True), base), "id", "left")
        base = base.withColumns({"rendered_path": F.lit(None).cast("string"), "pdf_path": F.lit(None).cast("string"), "failed_compile": F.lit(False), "named": T.sample_name(F.lit(""))})
    return base.select("id", "tex_path", "image_path", "rendered_path", "pdf_path", "failed_compile", "named.*", F.col("rendered_path").isNotNull().alias("has_rendered")).orderBy("id")


def best_images(files: DataFrame, samples: DataFrame, preferred: tuple[str, ...] = PREFERRED_NAMES) -> DataFrame:
    """The likeliest image of each sample: of its name, else of a preferred name in its folder, else the first there, else the first among its crops, at any depth.

    Of images of one name the order of ``IMAGE_TYPES`` decides.
    """
    kind = F.regexp_extract("name", r"(\.[^.]*)$", 1)
    folder = folder_of("path")
    images = files.where(kind.isin(*IMAGE_TYPES)).select("path", F.col("id").alias("stem"), F.array_position(F.array(*map(F.lit, IMAGE_TYPES)), kind).alias("type_rank"), folder.alias("folder"))
    owner = samples.select("id", folder_of("tex_path").alias("home"), F.regexp_replace(F.element_at(F.split("tex_path", "/"), -1), r"\.tex$", "").alias("own"))
    # an image below a crops folder may belong to the folder above each of that name on its path
    step = F.split("folder", "/")
    above = F.filter(F.transform(step, lambda x, i: F.when(x == CROPS_FOLDER, F.array_join(F.slice(step, F.lit(1), i), "/"))), lambda x: x.isNotNull())
    crops = images.withColumn("home", F.explode(above)).withColumn("crop", F.lit(True))
    near = images.withColumns({"home": F.col("folder"), "crop": F.lit(False)}).unionByName(crops)
    place = F.array_position(F.array(*map(F.lit, preferred)), F.col("stem"))
    rank = F.when(F.col("crop"), len(preferred) + 2).when(F.col("stem") == F.col("own"), 0).when(place > 0, place.cast("int")).otherwise(len(preferred) + 1)
    by_name = F.when(rank <= len(preferred), F.col("type_rank")).otherwise(0)
    return owner.join(near, "home").groupBy("id").agg(F.min_by("path", F.struct(rank, by_name, F.split("path", "/"))).alias("image_path"))


def folder_of(path: str):
    return F.regexp_replace(path, r"/[^/]*$", "")


def image_of_id(files: DataFrame) -> DataFrame:
    """Rows (id, path): of the images of one id the first by type, ``.png``, then ``.jpg``, then ``.jpeg``."""
    types = IMAGE_TYPES[:3]
    rank = F.array_position(F.array(*map(F.lit, types)), F.regexp_extract("name", r"(\.[^.]*)$", 1))
    return files.where(rank > 0).groupBy("id").agg(F.min_by("path", rank).alias("path"))


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under an explicit schema."""
    return spark.read.schema(schema).json(path)


def append_lines(df: DataFrame, path: str) -> None:
    """Appends JSON lines; each task owns its file, so writers never share one."""
    df.write.mode("append").json(path)


def window(key: str, *order) -> WindowSpec:
    return Window.partitionBy(key).orderBy(*order)


def append_run(rows: DataFrame, path: str, key: str) -> DataFrame:
    """Appends rows as JSON lines of a new run, and returns the latest view.

    A run's number is taken by making a file of that name, so two writers never
    have the same one.
    """
    spark = rows.sparkSession
    number = take_number(spark, f"{path}/_runs")
    while exists(spark, f"{path}/run={number}"):  # of a time before numbers were taken
        number = take_number(spark, f"{path}/_runs")
    rows.write.mode("append").json(f"{path}/run={number}")
    return latest_runs(spark, path, key, rows.schema)


def latest_runs(spark: SparkSession, path: str, key: str, schema) -> DataFrame:
    """Of each key the row of its last run; earlier runs stay in the folder."""
    names = schema.names
    rows = spark.read.schema(StructType([*schema.fields, StructField("run", IntegerType())])).json(path)
    return rows.groupBy(key).agg(F.max_by(F.struct(*[n for n in names if n != key]), "run").alias("r")).select(key, "r.*").select(*names)


def replace_table(df: DataFrame, path: str) -> None:
    """Writes a new version beside the old one, then swaps the folders by two renames.

    Readers that open a table through ``table_at`` see the old or the new
    version, whole, also where a driver was lost between the renames; others
    may find none at that moment.
    """
    spark = df.sparkSession
    table_at(spark, path)
    new, old = f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").parquet(new)
    fs, path_of = file_system(spark, path)
    fs.delete(path_of(old), True)
    if fs.exists(path_of(path)):
        fs.rename(path_of(path), path_of(old))
    fs.rename(path_of(new), path_of(path))
    fs.delete(path_of(old), True)


def table_at(spark: SparkSession, path: str) -> str:
    """The folder where a replaced table is to be read: its own, or the old version's while a swap is under way or was broken off."""
    fs, path_of = file_system(spark, path)
    if fs.exists(path_of(path)) or not fs.exists(path_of(f"{path}.old")):
        return path
    # between the renames: the new version is whole, as the old one moves only after it is written
    if fs.exists(path_of(f"{path}.new/_SUCCESS")) and not fs.exists(path_of(path)):
        fs.rename(path_of(f"{path}.new"), path_of(path))
    return path if fs.exists(path_of(path)) else f"{path}.old"


# Layout documents as XML, with tags diagram, block, node, raster and arrow and attributes only.
PARTS = ("node", "raster", "arrow")
NO_BOX, NOT_XML, NOT_A_NUMBER = "0 0 0 0", "not XML", "not a number"


def _read_parts(of: list[dict[str, str]], tag: str) -> dict[str, pa.Array]:
    """The columns of some items, blocks or arrows from their attributes; raises where a number is none."""
    text = lambda name, default: pa.array([x.get(name, default) for x in of], pa.string())
    ends = {"conf": pa.array([float(c) if (c := x.get("conf")) is not None else None for x in of], pa.float64()), "src": text("src", "pointing" if tag == "raster" else "manual")}
    if tag == "arrow":
        return {"src_id": text("s", ""), "dst_id": text("d", ""), **ends}
    sides = [x.get("b", NO_BOX).split() for x in of]
    if any(len(s) != 4 for s in sides):
        raise ValueError(NOT_A_NUMBER)
    numbers = np.array([float(n) for s in sides for n in s], np.float64).reshape(-1, 4)
    box = pa.StructArray.from_arrays([pa.array(numbers[:, k]) for k in range(4)], ["x0", "y0", "x1", "y1"])
    return {"id": text("i", ""), "text": text("t", ""), "bbox": box, "mask": text("mask", None), **ends}


class _Documents:
    """Attributes of the blocks, nodes, rasters and arrows of documents in order, and where each document's or block's end."""

    def __init__(self) -> None:
        self.top, self.inner = ({tag: ([], [0]) for tag in tags} for tags in (("block", *PARTS), PARTS))
        self.depth, self.within = 0, False

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        self.depth += 1
        if self.depth == 2:
            self.within = tag == "block"
            if tag in self.top:
                self.top[tag][0].append(attributes)
        elif self.depth == 3 and self.within and tag in self.inner:
            self.inner[tag][0].append(attributes)

    def end(self, _tag: str) -> None:
        self.depth -= 1
        if self.depth == 1 and self.within:
            for found, ends in self.inner.values():
                ends.append(len(found))

    def read(self, text: str | None, numbered: bool = False) -> str | None:
        """Adds a document, an empty one for null and for one with a problem, which is returned; numbers are tried at once only if asked to."""
        places = [*self.top.items(), *self.inner.items()]
        before, problem = [(len(found), len(ends)) for _, (found, ends) in places], None
        if text is not None:
            parser = expat.ParserCreate(None, "}")
            parser.StartElementHandler, parser.EndElementHandler, self.depth = self.start, self.end, 0
            try:
                parser.Parse(text, True)
            except expat.ExpatError:
                problem = NOT_XML
            if problem is None and numbered and not all(_numbered(x, tag) for (tag, (found, _)), (n, _) in zip(places, before) for x in found[n:]):
                problem = NOT_A_NUMBER
            if problem is not None:
                for (_, (found, ends)), (n, m) in zip(places, before):
                    del found[n:], ends[m:]
        for found, ends in self.top.values():
            ends.append(len(found))
        return problem

    def arrays(self) -> dict[str, pa.Array]:
        """Lists of parts by their column; raises where a number is none."""

        def lists(of: dict[str, tuple[list, list]], inside: dict[str, pa.Array]) -> dict[str, pa.Array]:
            columns = {tag: _read_parts(found, tag) | (inside if tag == "block" else {}) for tag, (found, _) in of.items()}
            return {f"{tag}s": pa.ListArray.from_arrays(pa.array(of[tag][1], pa.int32()), pa.StructArray.from_arrays(list(c.values()), list(c))) for tag, c in columns.items()}

        return lists(self.top, lists(self.inner, {}))


def _numbered(attributes: dict[str, str], tag: str) -> bool:
    """Whether a part's box and confidence are made of numbers."""
    try:
        sides = [float(n) for n in (NO_BOX if tag == "arrow" else attributes.get("b", NO_BOX)).split()]
        float(attributes.get("conf", "0"))
    except ValueError:
        return False
    return len(sides) == 4


def _read_documents(texts: pa.Array) -> pa.StructArray:
    """Diagrams of documents with the problem of each; those with one are empty, as those that are null."""
    given = texts.to_pylist()
    documents = _Documents()
    problems = [documents.read(text) for text in given]
    try:
        parts = documents.arrays()
    except ValueError:
        documents = _Documents()
        problems = [documents.read(text, numbered=True) for text in given]
        parts = documents.arrays()
    return pa.StructArray.from_arrays([*parts.values(), pa.array(problems, pa.string())], [*parts, "problem"])


def parse_xml(documents: DataFrame, column: str = "xml", key: str = "image_id", strict: bool = True) -> DataFrame:
    """Diagrams of XML documents; unknown tags and nested blocks are skipped.

    A document that isn't XML, or holds a box or confidence that isn't made of
    numbers, raises; unless ``strict``, it is an empty diagram with its
    ``problem`` in a column of that name, and the others are read.
    """
    kinds = {"blocks": f"array<{layout.BLOCK}>", "nodes": f"array<{layout.ITEM}>", "rasters": f"array<{layout.ITEM}>", "arrows": f"array<{layout.ARROW}>"}

    @arrow_udf(", ".join(f"{n} {kind}" for n, kind in (kinds | {"problem": "string"}).items()))
    def read(texts: pa.Array) -> pa.Array:
        return _read_documents(texts)

    found = documents.select(key, read(column).alias("x")).select(key, "x.*")
    if not strict:
        return found
    problem = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.lit("document "), F.col(key).cast("string"), F.lit(": "), F.col("problem"))).cast("string"))
    return found.select(key, *[F.when(problem.isNull(), F.col(n)).otherwise(F.array().cast(kind)).alias(n) for n, kind in kinds.items()])


def _escaped(texts: pa.Array) -> pa.Array:
    """Texts as they stand in attributes; nulls are empty."""
    texts = texts.fill_null("")
    if pc.any(pc.match_substring_regex(texts, "[&<>\"\r\n\t]")).as_py():
        for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;"), ("\n", "&#10;"), ("\t", "&#9;")):
            texts = pc.replace_substring(texts, raw, name)
    return texts


def _decimals(numbers: pa.Array, places: int) -> pa.Array:
    """Numbers with so many decimals, rounding the exact binary value: equal ones once; what is near a tie, large or no number one by one."""
    # by their bits, as zero has two signs
    distinct = numbers.view(pa.int64()).dictionary_encode()
    return pc.take(_decimals_of(distinct.dictionary.view(pa.float64()).to_numpy(), places), distinct.indices)


def _decimals_of(v: np.ndarray, places: int) -> pa.Array:
    scaled = np.abs(v) * 10**places
    # the product is off by less than 2 ** -12, so all but near a half it is rounded as the exact one is
    scaled = np.where(scaled < 2.0**40, scaled, 0.5)
    sure = np.abs(scaled - np.floor(scaled) - 0.5) > 1e-3
    n = np.floor(scaled + 0.5).astype(np.int64)
    high, low = (pa.array(x).cast(pa.string()) for x in (n // 10**places, n % 10**places))
    sign = pc.if_else(pa.array(np.signbit(v)), "-", "")
    out = _joined(sign, high, ".", pc.utf8_lpad(low, places, "0"))
    return out if sure.all() else pc.replace_with_mask(out, pa.array(~sure), pa.array([f"{x:.{places}f}" for x in v[~sure].tolist()], pa.string()))


def _joined(*parts) -> pa.Array:
    """Texts side by side, without anything between them."""
    return pc.binary_join_element_wise(*parts, "")


def _if(test: pa.Array, *parts) -> pa.Array:
    return pc.if_else(test, _joined(*parts), "")


def _tags(name: str, of: pa.StructArray, depth: int) -> pa.Array:
    """The tags of some items, blocks or arrows, up to what ends them."""
    at = lambda field: pc.struct_field(of, field)
    if name == "arrow":
        head = _joined(' s="', _escaped(at("src_id")), '" d="', _escaped(at("dst_id")), '"')
    else:
        sides = [pc.struct_field(of, ["bbox", n]) for n in ("x0", "y0", "x1", "y1")]
        if any(s.null_count for s in sides):
            raise ValueError(f"a {name} without a box")
        b = [_decimals(s, 2) for s in sides]
        mask = at("mask")
        head = _joined(' i="', _escaped(at("id")), '" t="', _escaped(at("text")), '" b="', b[0], " ", b[1], " ", b[2], " ", b[3], '"', _if(mask.is_valid(), ' mask="', _escaped(mask), '"'))
    conf, src = at("conf").fill_null(float("nan")), at("src").fill_null("manual")
    return _joined("  " * depth + f"<{name}", head, _if(pc.invert(pc.is_nan(conf)), ' conf="', _decimals(conf, 4), '"'), _if(pc.not_equal(src, "manual"), ' src="', _escaped(src), '"'))


def _together(lists: pa.ListArray, texts: pa.Array) -> pa.Array:
    """The texts of each list's elements as one."""
    ends = lists.offsets.to_numpy()
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends - ends[0]), texts), "")


def _parts(of: dict[str, pa.ListArray], depth: int) -> pa.Array:
    """Nodes, rasters and arrows of diagrams or blocks."""
    if any(lists.null_count for lists in of.values()):
        raise ValueError("a diagram without lists of its parts")
    return _joined(*[_together(of[column], _joined(_tags(name, of[column].flatten(), depth), "/>\n")) for name, column in (("node", "nodes"), ("raster", "rasters"), ("arrow", "arrows"))])


def _rendered(blocks: pa.ListArray, **parts: pa.ListArray) -> pa.Array:
    """The documents of diagrams, all at once."""
    b = blocks.flatten()
    inside = _parts({n: pc.struct_field(b, n) for n in parts}, 2)
    whole = _joined(_tags("block", b, 1), pc.if_else(pc.equal(inside, ""), "/>\n", _joined(">\n", inside, "  </block>\n")))
    if blocks.null_count:
        raise ValueError("a diagram without a list of its blocks")
    body = _joined(_together(blocks, whole), _parts(parts, 1))
    return pc.if_else(pc.equal(body, ""), "<diagram/>\n", _joined("<diagram>\n", body, "</diagram>\n"))


def write_xml(diagrams: DataFrame, key: str = "image_id") -> DataFrame:
    """Rows (key, xml): boxes with two decimals, confidences with four, sources only where they aren't manual."""

    @arrow_udf("string")
    def render(blocks: pa.Array, nodes: pa.Array, rasters: pa.Array, arrows: pa.Array) -> pa.Array:
        return _rendered(blocks, nodes=nodes, rasters=rasters, arrows=arrows)

    return diagrams.select(key, render("blocks", "nodes", "rasters", "arrows").alias("xml"))


def export_zip(done: DataFrame, key: str, text: str, limit: int = 100_000) -> bytes:
    """A zip of the texts of done rows and a manifest by key, in order; raises beyond ``limit`` rows."""
    rows = done.orderBy(key).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("too many rows for one archive")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for r in rows:
            z.writestr(f"{r[key]}.tex", r[text] or "")
        z.writestr("manifest.json", json.dumps({str(r[key]): {k: str(v) for k, v in r.asDict().items() if k not in (key, text)} for r in rows}, sort_keys=True))
    return out.getvalue()


def write_each(rows: DataFrame, folder: str) -> None:
    """A file for each row (path, content) below a folder that all executors share, from the tasks that hold the rows.

    Each file is written beside its place and renamed, so a task that runs
    again replaces whole files.
    """

    def land(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}")
        for part in parts:
            for path, content in zip(part["path"], part["content"]):
                target = f"{root}/{path}"
                store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                beside = f"{target}.{uuid.uuid4().hex}"
                with store.open_output_stream(beside) as out:
                    out.write(content)
                store.move(beside, target)
            yield pd.DataFrame({"n": [len(part)]})

    rows.mapInPandas(land, "n long").agg(F.sum("n")).collect()


def write_single_json(df: DataFrame, path: str) -> None:
    """A summary of one row as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def stage_path(root: str, dataset: str, stage: str, variant: str) -> str:
    """Folder of a stage's output."""
    return f"{root.rstrip('/')}/{dataset}/{stage}/{variant}"

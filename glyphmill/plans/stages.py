"""The data engine's eight stages, each a function from DataFrame to DataFrame, and a pipeline that writes each before the next.

point, box, segment, assemble, edges, codegen, render, judge.  A sample whose
model call fails gives no rows in that stage, and its error is kept beside
them; others go on.  Models and renderers are adapters, named in the call.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.adapters import predictors
from glyphmill.functions import masks, png
from glyphmill.functions import text as T
from glyphmill.operators import aggregates, layout
from glyphmill.sources import files

Stage = Callable[[DataFrame], DataFrame]

#: What models are asked; callers may ask otherwise.
NODE_QUERY = "Point to every shape of this diagram that can hold a label."
RASTER_QUERY = "Point to every picture inside this diagram: photos, icons, logos, screenshots and charts."
BOX_QUERY = 'Hint points of pictures in this diagram:\n{points}\nAnswer with a JSON list of {{"object_id": <id>, "box": [x0, y0, x1, y1]}} in pixels, one for each picture that a hint is on.'
EDGE_QUERY = 'Numbered markers stand on the shapes of this diagram:\n{legend}\nAnswer with a JSON list of {{"from": <number>, "to": <number>}}, one for each arrow between them; [] if there is none.'
CODE_QUERY = {
    "tikz": "Draw this diagram as one standalone TikZ document that compiles.\nIts structure:\n",
    "svg": "Draw this diagram as one well-formed SVG document.\nIts structure:\n",
}
JUDGE_QUERY = 'Compare the drawing {png} with the image. Answer with {{"score": <1 to 5>, "rationale": "<one sentence>"}}.'
KEEP = 4


#: Bytes of an image that hold its size.
HEAD = 1 << 20


def sized(spark: SparkSession, samples: DataFrame) -> DataFrame:
    """Samples (id, image_path, ...) with width and height of their images, from the files' headers; samples whose image can't be read are left out."""
    folders = [r[0] for r in samples.select(files.folder_of("image_path")).distinct().limit(1_001).collect()]
    if len(folders) > 1_000:
        raise ValueError("images are in more than 1,000 folders")
    if not folders:
        return samples.withColumns({"width": F.lit(0), "height": F.lit(0)})
    heads = spark.read.format("binaryFile").load(folders).select(F.regexp_replace("path", "^file:/+", "/").alias("at"), png.image_size(F.substring("content", 1, HEAD)).alias("size")).where(F.col("size.width").isNotNull())
    return samples.withColumn("at", F.regexp_replace("image_path", "^file:/+", "/")).join(heads.select("at", "size.width", "size.height"), "at").drop("at")


def point(samples: DataFrame, model: str, node_query: str = NODE_QUERY, raster_query: str = RASTER_QUERY) -> DataFrame:
    """Rows (id, kind, object_id, x, y) from samples (id, image_path, width, height): shapes are of kind node, pictures of kind raster."""
    asked = samples.select("id", "width", "height", F.col("image_path").alias("image"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(q).alias("prompt")) for k, q in (("node", node_query), ("raster", raster_query))])).alias("q")).select("id", "width", "height", "image", "q.*")
    found = predictors.predict(asked, model, key=["id", "kind", "width", "height"]).where("ok")
    return found.select("id", "kind", F.inline(T.point_tags(F.col("answer"), F.col("width").cast("double"), F.col("height").cast("double"))))


def hints(points: Column) -> Column:
    """Lines of an array of points (object_id, x, y), as a prompt names them."""
    return F.array_join(F.transform(points, lambda p: F.format_string("- id %d: (%.1f, %.1f)", p["object_id"], p["x"], p["y"])), "\n")


def box(samples: DataFrame, points: DataFrame, model: str, query: str = BOX_QUERY) -> DataFrame:
    """Rows (id, object_id, x0, y0, x1, y1): boxes of the pictures that points hint at; a sample without such points costs no call."""
    hinted = points.where(F.col("kind") == "raster").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("object_id", "x", "y"))).alias("points"))
    asked = samples.select("id", F.col("image_path").alias("image")).join(hinted, "id").withColumn("prompt", F.replace(F.lit(query.format(points="{points}")), F.lit("{points}"), hints(F.col("points"))))
    answers = predictors.predict(asked, model).where("ok")
    ids = F.transform("points", lambda p: p["object_id"])
    return answers.join(hinted, "id").select("id", F.inline(T.boxes(F.col("answer"), ids)))


def mask_file(sample: Column, item: Column) -> Column:
    """Where the mask of an item belongs: a folder for each sample, a name from the id and its hash."""
    return F.concat(sample, F.lit("/"), item, F.lit("_"), T.digest(item, 8), F.lit(".png"))


def segment(samples: DataFrame, points: DataFrame, model: str) -> DataFrame:
    """The mask manifest (image_id, ord, id, text, box, mask, rle, conf, is_raster): one item for each point, nodes first.

    The model answers a point with JSON that holds size and counts of a
    compressed run-length mask, and a score (1 if there is none).
    """
    asked = points.join(samples.select("id", F.col("image_path").alias("image")), "id").withColumn("prompt", F.to_json(F.struct(F.array("x", "y").alias("point"))))
    answers = predictors.predict(asked, model, key=["id", "kind", "object_id"]).where("ok")
    item = F.concat_ws("_", "kind", "object_id")
    made = answers.select(F.col("id").alias("image_id"), "kind", "object_id", item.alias("item"), F.col("answer").alias("rle"), masks.of_text("answer").alias("m"), F.coalesce(F.get_json_object("answer", "$.score").cast("double"), F.lit(1.0)).alias("conf"))
    framed = made.withColumn("b", masks.bbox("m"))
    place = F.struct((F.col("kind") != "node").cast("int").alias("late"), "object_id")
    ranked = framed.withColumn("ord", F.row_number().over(files.window("image_id", place)))
    bounds = F.struct(*[F.col(f"b.{s}").alias(s) for s in ("x0", "y0", "x1", "y1")])
    return ranked.select("image_id", "ord", F.col("item").alias("id"), F.col("item").alias("text"), bounds.alias("box"), mask_file(F.col("image_id"), F.col("item")).alias("mask"), "rle", "conf", (F.col("kind") == "raster").alias("is_raster"))


def assemble(manifest: DataFrame) -> DataFrame:
    """Diagrams of a mask manifest."""
    return layout.assemble(manifest)


def legend(diagram: DataFrame) -> Column:
    """Numbered labels of all that gets a mark."""
    labels = lambda a: F.transform(a, lambda x: x["text"])
    return T.legend(F.concat(labels(F.col("blocks")), labels(F.col("nodes")), F.flatten(F.transform("blocks", lambda b: labels(b["nodes"])))))


def edges(samples: DataFrame, diagrams: DataFrame, model: str, query: str = EDGE_QUERY) -> DataFrame:
    """Diagrams whose arrows at the top are those the model sees between marks; a diagram without marks costs no call and stays as it is."""
    marked = diagrams.withColumn("marks", layout.markable(F.col("blocks"), F.col("nodes")))
    asked = marked.where(F.size("marks") > 0).withColumn("prompt", F.replace(F.lit(query.format(legend="{legend}")), F.lit("{legend}"), legend(marked)))
    asked = asked.select("image_id", "prompt").join(samples.select(F.col("id").alias("image_id"), F.col("image_path").alias("image")), "image_id")
    answers = predictors.predict(asked, model, key="image_id").where("ok").select("image_id", "answer")
    with_marks = marked.where(F.size("marks") > 0).join(answers, "image_id")
    drawn = with_marks.withColumn("arrows", layout.mark_edges(F.col("marks"), T.edges(F.col("answer")))).drop("answer")
    return drawn.unionByName(marked.where(F.size("marks") == 0)).drop("marks")


def codegen(samples: DataFrame, diagrams: DataFrame, model: str, backend: str = "tikz", query: str | None = None) -> DataFrame:
    """Rows (id, backend, raw, code): the model's whole answer, and the code in it if there is any."""
    if backend not in CODE_QUERY:
        raise ValueError(f"no backend {backend!r}; there are {', '.join(sorted(CODE_QUERY))}")
    asked = files.write_xml(diagrams).select(F.col("image_id").alias("id"), F.concat(F.lit(query or CODE_QUERY[backend]), F.col("xml")).alias("prompt"))
    asked = asked.join(samples.select("id", F.col("image_path").alias("image")), "id")
    answers = predictors.predict(asked, model).where("ok")
    return answers.select("id", F.lit(backend).alias("backend"), F.col("answer").alias("raw"), T.extract_code(F.col("answer"), backend).alias("code"))


def render(spark: SparkSession, codes: DataFrame, backend: str, cache: str) -> DataFrame:
    """Rows (id, digest, render_ok, png, log): each distinct code is rendered once; successes stay in ``cache``, failures are tried again next time."""
    wanted = codes.where(F.col("code").isNotNull()).select("id", "code", T.digest(F.col("code")).alias("digest"))
    held = spark.read.parquet(cache) if files.exists(spark, cache) else spark.createDataFrame([], "digest string, png binary")
    fresh = wanted.select("digest", "code").dropDuplicates(["digest"]).join(held.select("digest"), "digest", "left_anti")
    tried = f"{cache.rstrip('/')}.tried"
    predictors.render(fresh, backend).write.mode("overwrite").parquet(tried)
    new = spark.read.parquet(tried)
    new.where("ok").select("digest", "png").write.mode("append").parquet(cache)
    whole = spark.read.parquet(cache).select("digest", F.lit(True).alias("render_ok"), "png", F.lit("").alias("log")).unionByName(new.where("NOT ok").select("digest", F.lit(False).alias("render_ok"), F.lit(None).cast("binary").alias("png"), "log"))
    return wanted.select("id", "digest").join(whole, "digest").select("id", "digest", "render_ok", "png", "log")


def judge(samples: DataFrame, rendered: DataFrame, model: str, backend: str = "tikz", keep: int = KEEP, query: str = JUDGE_QUERY) -> DataFrame:
    """The summary (sample_id, backend, render_ok, render_png_path, judge_score, judge_rationale, kept); what wasn't rendered isn't judged and isn't kept."""
    named = rendered.withColumn("render_png_path", F.when(F.col("render_ok"), F.concat(F.col("digest"), F.lit(".png"))))
    asked = named.where("render_ok").join(samples.select("id", F.col("image_path").alias("image")), "id").select("id", "image", F.replace(F.lit(query.format(png="{png}")), F.lit("{png}"), F.col("render_png_path")).alias("prompt"))
    answers = predictors.predict(asked, model).where("ok").select("id", T.judge(F.col("answer")).alias("j"))
    judged = named.join(answers, "id", "left").where(~F.col("render_ok") | F.col("j").isNotNull())
    return judged.select(F.col("id").alias("sample_id"), F.lit(backend).alias("backend"), "render_ok", "render_png_path", F.col("j.score").alias("judge_score"), F.coalesce("j.reason", F.lit("")).alias("judge_rationale"), aggregates.keep_gate(F.col("j.score"), keep).alias("kept"))


class Engine:
    """The stages over one dataset, each read from what the one before it wrote below ``root``."""

    NAMES = ("point", "box", "segment", "assemble", "edges", "codegen", "render", "judge")

    def __init__(self, spark: SparkSession, root: str, dataset: str, samples: DataFrame, pointing: str = "stub", boxing: str = "stub", segmentation: str = "stub", edging: str = "stub", coding: str = "stub", judging: str = "stub", backend: str = "tikz", keep: int = KEEP):
        self.spark, self.root, self.dataset, self.samples = spark, root, dataset, samples
        self.pointing, self.boxing, self.segmentation, self.edging, self.coding, self.judging = pointing, boxing, segmentation, edging, coding, judging
        self.backend, self.keep = backend, keep

    def path(self, stage: str) -> str:
        """Where a stage's output is; its variant names the models it depends on."""
        seen = f"{self.pointing}__{self.segmentation}"
        variant = {"point": self.pointing, "box": f"{self.pointing}__{self.boxing}", "segment": seen, "assemble": seen, "edges": f"{seen}__{self.edging}", "codegen": f"{self.backend}/{self.coding}", "render": self.backend, "judge": self.backend}[stage]
        return files.stage_path(self.root, self.dataset, stage, variant)

    def load(self, stage: str) -> DataFrame:
        """A stage's output; an error names the stage to run first where there is none."""
        if not files.exists(self.spark, self.path(stage)):
            raise FileNotFoundError(f"nothing at {self.path(stage)}: run `{stage}` first")
        return self.spark.read.parquet(self.path(stage))

    def run(self, stage: str) -> DataFrame:
        """One stage; the judge's summary is appended run by run, all else is replaced."""
        if stage not in self.NAMES:
            raise KeyError(f"no stage {stage!r}; there are {', '.join(self.NAMES)}")
        if stage == "point":
            out = point(sized(self.spark, self.samples), self.pointing)
        elif stage == "box":
            out = box(self.samples, self.load("point"), self.boxing)
        elif stage == "segment":
            out = segment(self.samples, self.load("point"), self.segmentation)
        elif stage == "assemble":
            out = assemble(self.load("segment"))
        elif stage == "edges":
            out = edges(self.samples, self.load("assemble"), self.edging)
        elif stage == "codegen":
            out = codegen(self.samples, self.load("edges"), self.coding, self.backend)
        elif stage == "render":
            out = render(self.spark, self.load("codegen"), self.backend, f"{self.root.rstrip('/')}/{self.dataset}/renders/{self.backend}")
        else:
            return files.append_run(judge(self.samples, self.load("render"), self.judging, self.backend, self.keep), self.path("judge"), "sample_id")
        out.write.mode("overwrite").parquet(self.path(stage))
        return self.spark.read.parquet(self.path(stage))


class Pipeline:
    """Named stages in order; ``run`` writes each stage's output below ``root`` and reads it for the next."""

    def __init__(self, root: str, dataset: str, variant: str = "default"):
        self.root, self.dataset, self.variant = root, dataset, variant
        self.stages: dict[str, Stage] = {}

    def stage(self, name: str) -> Callable[[Stage], Stage]:
        def add(f: Stage) -> Stage:
            self.stages[name] = f
            return f

        return add

    def path(self, name: str) -> str:
        return files.stage_path(self.root, self.dataset, name, self.variant)

    def run(self, spark: SparkSession, samples: DataFrame, only: list[str] | None = None) -> DataFrame:
        """The output of the last stage that ran; an unknown stage is an error that lists them."""
        for name in only or []:
            if name not in self.stages:
                raise KeyError(f"no stage {name!r}; there are {', '.join(self.stages)}")
        out = samples
        for name, f in self.stages.items():
            if only and name not in only:
                continue
            f(out).write.mode("overwrite").parquet(self.path(name))
            out = spark.read.parquet(self.path(name))
        return out

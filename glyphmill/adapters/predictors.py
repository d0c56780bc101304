"""External capabilities behind adapters: models and renderers.

A predictor is loaded once in a task's worker and called for batches of rows;
it turns a prompt (and an image path) into text.  Tests and replays use the
stub, answers by rule, and the table of recorded answers.
"""

from __future__ import annotations

import hashlib
import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Predictor(Protocol):
    """What a model must offer."""

    def predict(self, prompts: list[str], images: list[str | None]) -> list[str]: ...

    def unload(self) -> None: ...


class Stub:
    """Answers that follow from the prompt alone."""

    def predict(self, prompts: list[str], images: list[str | None]) -> list[str]:
        return [hashlib.sha256(f"{p}|{i}".encode()).hexdigest() for p, i in zip(prompts, images)]

    def unload(self) -> None:
        pass


class Scripted:
    """The answer of the first rule whose mark the prompt holds; no rule is an error."""

    def __init__(self, rules: dict[str, str]):
        self.rules = rules

    def predict(self, prompts: list[str], images: list[str | None]) -> list[str]:
        out = []
        for p in prompts:
            found = [a for mark, a in self.rules.items() if mark in p]
            if not found:
                raise ValueError("no rule for this prompt")
            out.append(found[0])
        return out

    def unload(self) -> None:
        pass


class Interactive:
    """Masks of one image at a time, for a person who clicks: its embedding is kept, that of the image before it is let go.

    ``embed`` turns an image into what ``answer`` reads, once for each image
    that is opened; ``answer`` turns that, points (x, y, whether positive) and
    a box into a mask and a score.
    """

    def __init__(self, embed: Callable[[str], object], answer: Callable[[object, list, tuple | None], tuple[object, float]]):
        self.embed, self.answer, self.image, self.held = embed, answer, None, None

    def open(self, image: str) -> None:
        if image != self.image:
            self.image, self.held = None, None
            self.held, self.image = self.embed(image), image

    def segment(self, image: str, points: list[tuple[float, float, bool]] = (), box: tuple[float, float, float, float] | None = None) -> tuple[object, float]:
        if image != self.image:
            raise RuntimeError(f"{image} isn't embedded; open it first")
        if not points and box is None:
            raise ValueError("a mask needs points or a box")
        return self.answer(self.held, list(points), box)


#: Makers of predictors by name; an unknown name is an error that lists them.
REGISTRY: dict[str, Callable[[], Predictor]] = {"stub": Stub}


def get(name: str) -> Callable[[], Predictor]:
    if name not in REGISTRY:
        raise KeyError(f"no predictor {name!r}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]


def predict(rows: DataFrame, name: str, batch: int = 32, key: str | list[str] = "id", prompt: str = "prompt", image: str = "image") -> DataFrame:
    """Rows (key, answer, ok, error, seconds): a failing batch marks its own rows only; ``seconds`` is a row's share of its batch.

    Filter rows before this: nothing is pushed below a model.
    """
    make = get(name)
    keys = [key] if isinstance(key, str) else list(key)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        model = make()
        try:
            for part in parts:
                for at in range(0, len(part), batch):
                    some = part.iloc[at : at + batch]
                    began = time.perf_counter()
                    try:
                        answers, error = model.predict(some["prompt"].tolist(), some["image"].tolist()), None
                    except Exception as e:  # a model's failure is a result
                        answers, error = [None] * len(some), f"{type(e).__name__}: {e}"
                    yield some[keys].assign(answer=answers, ok=error is None, error=error, seconds=(time.perf_counter() - began) / len(some))
        finally:
            model.unload()

    given = rows.select(*keys, F.col(prompt).alias("prompt"), (F.col(image) if image in rows.columns else F.lit(None)).cast("string").alias("image"))
    shape = ", ".join(f"`{k}` {t}" for k, t in given.select(*keys).dtypes)
    return given.mapInPandas(run, f"{shape}, answer string, ok boolean, error string, seconds double")


def replayed(rows: DataFrame, answers: DataFrame, key: str = "id") -> DataFrame:
    """Recorded answers in place of a model: a left join; rows without one failed."""
    joined = rows.join(answers.select(key, "answer"), key, "left")
    return joined.withColumns({"ok": F.col("answer").isNotNull(), "error": F.when(F.col("answer").isNull(), "no recorded answer")})


# Fixed values of the renderer: resolution and seconds a step.
DPI, TIMEOUT = 150, 60


def render_tikz(source: str) -> tuple[bool, bytes | None, str]:
    """PNG of a TeX document, or the log of what failed."""
    if not (shutil.which("latexmk") and shutil.which("pdftoppm")):
        return False, None, "no TeX installation"
    with tempfile.TemporaryDirectory() as d:
        Path(d, "a.tex").write_text(source)
        for step in (["latexmk", "-pdf", "-interaction=nonstopmode", "-halt-on-error", "a.tex"], ["pdftoppm", "-png", "-r", str(DPI), "-singlefile", "a.pdf", "a"]):
            try:
                done = subprocess.run(step, cwd=d, capture_output=True, text=True, timeout=TIMEOUT)
            except subprocess.TimeoutExpired:
                return False, None, f"{step[0]} took more than {TIMEOUT} s"
            if done.returncode:
                return False, None, (done.stdout + done.stderr)[-2000:]
        return True, Path(d, "a.png").read_bytes(), ""


def render_svg(source: str) -> tuple[bool, bytes | None, str]:
    """PNG of an SVG document, or the log of what failed."""
    try:
        import cairosvg
    except ImportError:
        return False, None, "no SVG renderer"
    try:
        return True, cairosvg.svg2png(bytestring=source.encode(), dpi=DPI), ""
    except Exception as e:  # the renderer raises errors of many kinds
        return False, None, f"cairosvg render failed: {e}"


RENDERERS: dict[str, Callable[[str], tuple[bool, bytes | None, str]]] = {"tikz": render_tikz, "svg": render_svg}


def render(sources: DataFrame, kind: str, code: str = "code", digest: str = "digest") -> DataFrame:
    """Rows (digest, ok, png, log) of sources that were reduced to distinct digests first."""
    if kind not in RENDERERS:
        raise ValueError(f"no renderer {kind!r}; there are {', '.join(sorted(RENDERERS))}")
    one = RENDERERS[kind]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            done = [one(c) for c in part["code"]]
            yield pd.DataFrame({"digest": part["digest"], "ok": [d[0] for d in done], "png": [d[1] for d in done], "log": [d[2] for d in done]})

    return sources.select(F.col(digest).alias("digest"), F.col(code).alias("code")).mapInPandas(run, "digest string, ok boolean, png binary, log string")

"""Page images: grey preparation, crops, turns and ink, and reading by a recogniser that is plugged in.

An image is a struct of width, height and rgba (binary, 4 bytes a pixel). Pixel work is numpy inside Arrow batches; a
recogniser is a function of (grey image as a 2-d uint8 array, kind) that gives text. None is part of the package.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridextract.functions.pages import best_text, is_blank, try_more_orientations
from gridextract.functions.text import collapsed
from gridextract.operators.layout import DARK
from gridextract.sources.shared import once

# Weights of grey, bounds of preparation, what each kind of field can hold, scale and turns of readings.
GREY = (0.299, 0.587, 0.114)
BINARY_FROM, WHITE_FROM, BLACK_TO = 168, 200, 140
WHITELIST = {
    "name": "A-Za-z '.,-",
    "amount": "0-9.,$()-",
    "locate": "A-Za-z0-9$',./ -",
}
TURNS = (90, 270, 180)
INK_STEP, MOST_WIDTH = 16, 1100

Recogniser = Callable[[np.ndarray, str], str]


def pixels(rgba: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(rgba, np.uint8).reshape(height, width, 4)


def ink_share(image: np.ndarray) -> float:
    """Share of dark pixels among every 16th; 0 for an empty image."""
    some = image.reshape(-1, 4)[::INK_STEP, :3]
    return float((some.astype(np.int64).sum(1) < 3 * DARK).mean()) if len(some) else 0.0


def prepared(image: np.ndarray, mode: str = "contrast") -> np.ndarray:
    """Grey image for reading. raw: as it is; binary: black or white; contrast: light grey to white, dark grey to black."""
    grey = image[..., :3] @ np.array(GREY)
    if mode == "binary":
        grey = np.where(grey < BINARY_FROM, 0, 255)
    elif mode == "contrast":
        grey = np.where(grey > WHITE_FROM, 255, np.where(grey < BLACK_TO, 0, grey))
    elif mode != "raw":
        raise ValueError(f"unknown mode {mode}")
    return np.rint(grey).astype(np.uint8)


def cropped(image: np.ndarray, x: float, y: float, w: float, h: float) -> np.ndarray:
    """The part of an image inside a box, one pixel at least; what lies outside the image is transparent black."""
    left, top, width, height = int(x), int(y), max(1, int(w)), max(1, int(h))
    out = np.zeros((height, width, *image.shape[2:]), image.dtype)
    part = image[max(top, 0) : top + height, max(left, 0) : left + width]
    out[max(-top, 0) : max(-top, 0) + part.shape[0], max(-left, 0) : max(-left, 0) + part.shape[1]] = part
    return out


def turned(image: np.ndarray, degrees: int) -> np.ndarray:
    """Turned clockwise by quarters."""
    return np.rot90(image, -(degrees // 90) % 4)


def narrowed(image: np.ndarray, most: int = MOST_WIDTH) -> np.ndarray:
    """An image of `most` pixels width at most, by the nearest pixels."""
    height, width = image.shape[:2]
    if width <= most:
        return image
    rows = max(1, round(height * most / width))
    return image[np.arange(rows) * height // rows][:, np.arange(most) * width // most]


def upright_rotation(rotation: Column) -> Column:
    """Turn to render a page with: pages stored sideways are rendered as stored, others by their own turn (null)."""
    return F.when(rotation.isin(90, 270), F.lit(0))


def allowed(text: Column, kind: str) -> Column:
    """Only the characters that a kind of field can hold, white space collapsed. kind line: all."""
    return collapsed(F.regexp_replace(text, f"[^\\s{WHITELIST[kind]}]", "") if kind in WHITELIST else text)


def ink(images: DataFrame) -> DataFrame:
    """images (width, height, rgba and others) with column ink."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            yield d.assign(ink=[ink_share(pixels(*x)) for x in zip(d["rgba"], d["width"], d["height"], strict=True)])

    return images.mapInPandas(run, T.StructType([*images.schema.fields, T.StructField("ink", T.DoubleType())]))


def pixel_rows(images: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, ink of each line of images: share of dark pixels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for i, row in enumerate(d.itertuples(index=False)):
                dark = pixels(row.rgba, row.width, row.height)[..., :3].astype(np.int64).sum(2) < 3 * DARK
                yield pd.concat([d.iloc[[i] * row.height][keys].reset_index(drop=True), pd.DataFrame({"y": np.arange(row.height, dtype=np.int32), "ink": dark.mean(1) if row.width else 0.0})], axis=1)

    kinds = ", ".join(f"{k} {images.schema[k].dataType.simpleString()}" for k in keys)
    return images.select(*keys, "width", "height", "rgba").mapInPandas(run, f"{kinds}, y int, ink double")


def _read(images: DataFrame, recognise: Recogniser, turns: tuple[int, ...], mode: str) -> DataFrame:
    """file_name, page, texts (one for each turn), error. A page is first turned as it is to be shown: by its rotation, where
    images have one and the page is not stored sideways."""
    turn = F.coalesce(upright_rotation(F.col("rotation")), F.col("rotation"), F.lit(0)) if "rotation" in images.columns else F.lit(0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            out = []
            for row in d.itertuples(index=False):
                try:
                    image = turned(prepared(pixels(row.rgba, row.width, row.height), mode), row.turn)
                    out.append((row.file_name, row.page, [recognise(turned(image, t), "locate") for t in turns], None))
                except Exception as e:  # one bad page is a row, not a failed job
                    out.append((row.file_name, row.page, None, f"Page {row.page} OCR failed: {e}"))
            yield pd.DataFrame(out, columns=["file_name", "page", "texts", "error"])

    return images.select("file_name", "page", "width", "height", "rgba", turn.cast("int").alias("turn")).mapInPandas(run, "file_name string, page int, texts array<string>, error string")


def locate_text(images: DataFrame, recognise: Recogniser, mode: str = "contrast") -> DataFrame:
    """file_name, page, text, error of scanned pages. Blank ones are not read; a page is read upright, and only those that
    show no heading that way are read in the other three turns as well, of which the best text counts."""
    # what several branches read is written once, so that no page is looked at or read twice
    inked = once(ink(images.select("file_name", "page", "width", "height", "rgba")).select("file_name", "page", "ink"))
    blank = is_blank(F.col("ink"))
    seen = images.join(inked.where(~blank), ["file_name", "page"], "left_semi")
    upright = once(_read(seen, recognise, (0,), mode)).withColumn("first", F.get("texts", F.lit(0)))
    more = upright.where(F.col("error").isNull() & try_more_orientations(F.col("first"))).select("file_name", "page")
    others = _read(seen.join(more, ["file_name", "page"], "left_semi"), recognise, TURNS, mode)
    both = upright.select("file_name", "page", "first", "error").join(others.select("file_name", "page", F.col("texts").alias("more"), F.col("error").alias("e2")), ["file_name", "page"], "left")
    text = best_text(F.concat(F.array("first"), F.coalesce("more", F.array().cast("array<string>"))))
    read = both.select("file_name", "page", F.when(F.col("error").isNull(), text).alias("text"), F.coalesce("error", "e2").alias("error"))
    none = inked.where(blank).select("file_name", "page", F.lit("").alias("text"), F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit(" rendered blank")).alias("error"))
    return read.unionByName(none)


def field_reader(images: DataFrame, recognise: Recogniser, mode: str = "contrast") -> Callable[[DataFrame], DataFrame]:
    """A reader for reread.second_look: name_text and rest_text (codes, then amount) of the boxes in crops, read from the
    images (file_name, page, width, height, rgba) of their tables. What cannot be read is null."""

    def read(found: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for d in batches:
                out = []
                for row in d.itertuples(index=False):
                    try:
                        image = prepared(pixels(row.rgba, row.width, row.height), mode)
                        out.append([recognise(cropped(image, *(row.crops[part][c] for c in "xywh")), kind) for part, kind in (("name", "name"), ("codes", "line"), ("amount", "amount"))])
                    except Exception:  # the member stays missing
                        out.append([None] * 3)
                texts = pd.DataFrame(out, columns=["t_name", "t_codes", "t_amount"], dtype=object)
                yield pd.concat([d[["file_name", "row_index", "name", "page"]].reset_index(drop=True), texts], axis=1)

        both = found.join(images.select("file_name", "page", "width", "height", "rgba"), ["file_name", "page"]).select("file_name", "row_index", "name", "page", "crops", "width", "height", "rgba")
        got = both.mapInPandas(run, "file_name string, row_index int, name string, page int, t_name string, t_codes string, t_amount string")
        rest = F.concat_ws(" ", allowed(F.col("t_codes"), "line"), allowed(F.col("t_amount"), "amount"))
        return got.select("file_name", "row_index", "name", "page", allowed(F.col("t_name"), "name").alias("name_text"), rest.alias("rest_text"))

    return read

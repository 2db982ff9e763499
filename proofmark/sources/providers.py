"""Pluggable recognition and measurement: functions from image bytes to rows.

No engine is a dependency.  A provider is registered under a name and applied to
a table of images by ``mapInPandas``, one instance per worker; a failing image
gives a row with an error and not a failed job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Recognise = Callable[[bytes], dict]
ALIASES = {"stub": "stub", "none": "stub", "paddle": "paddle", "paddleocr": "paddle"}
REGISTRY: dict[str, Callable[[], Recognise]] = {}


def register(name: str, make: Callable[[], Recognise]) -> None:
    REGISTRY[name] = make


def _stub() -> Recognise:
    def refuse(content: bytes) -> dict:
        raise RuntimeError("no recognition engine is configured; text is not invented")

    return refuse


register("stub", _stub)


def available() -> list[str]:
    return sorted(REGISTRY)


def provider(name: str) -> Callable[[], Recognise]:
    key = ALIASES.get(name.lower(), name.lower())
    if key not in REGISTRY:
        raise ValueError(f"unknown provider {name!r}; there are {', '.join(available())}")
    return REGISTRY[key]


def recognise(images: DataFrame, make: Callable[[], Recognise]) -> DataFrame:
    """(item_id, content) to (item_id, full_text, error)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = make()
        for f in frames:
            out = []
            for item, content in zip(f["item_id"], f["content"], strict=True):
                try:
                    out.append((item, engine(bytes(content)).get("full_text", ""), None))
                except Exception as e:  # noqa: BLE001  an item's failure is its row
                    out.append((item, None, f"{type(e).__name__}: {e}"[:240]))
            yield pd.DataFrame(out, columns=["item_id", "full_text", "error"])

    return images.select("item_id", "content").mapInPandas(run, "item_id string, full_text string, error string")


def measure(gray: np.ndarray) -> dict[str, float]:
    """Blur (variance of the four-neighbour Laplacian, edges mirrored), brightness, contrast and clipping of a grey image."""
    g = np.pad(gray.astype(np.float64), 1, mode="reflect") if min(gray.shape) > 1 else np.pad(gray.astype(np.float64), 1, mode="edge")
    laplacian = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    return {
        "laplacian_variance": round(float(laplacian.var()), 3),
        "mean_brightness": round(float(gray.mean()), 3),
        "contrast_std": round(float(gray.std()), 3),
        "near_black_fraction": round(float((gray <= 5).mean()), 4),
        "near_white_fraction": round(float((gray >= 250).mean()), 4),
    }


def measured(pixels: DataFrame) -> DataFrame:
    """(item_id, width, height, gray as bytes) to the measurements."""
    names = ["laplacian_variance", "mean_brightness", "contrast_std", "near_black_fraction", "near_white_fraction"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for item, w, h, raw in zip(f["item_id"], f["width"], f["height"], f["gray"], strict=True):
                m = measure(np.frombuffer(bytes(raw), np.uint8).reshape(h, w))
                rows.append((item, *(m[n] for n in names)))
            yield pd.DataFrame(rows, columns=["item_id", *names])

    return pixels.mapInPandas(run, "item_id long, " + ", ".join(f"{n} double" for n in names))

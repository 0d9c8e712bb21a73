"""Synthetic image cases: noise on a gradient, bright ridges, and blurred discs as lesions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "case_id string, patient_id string, site string, density_band string, age_band string, label int, h int, w int, pixels array<float>, lesion_boxes array<struct<x0:int,y0:int,x1:int,y1:int>>"


def phantom(rng: np.random.Generator, size: int, lesion: bool) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    y, x = np.mgrid[:size, :size]
    image = 0.25 + 0.1 * x / size + rng.normal(0, 0.02, (size, size))
    at, wide = rng.integers(size), rng.integers(2, 4)
    image[np.abs((x - at + (y - size / 2) * rng.normal(0, 0.2))) < wide] += 0.05
    boxes = []
    if lesion:
        r = int(rng.integers(size // 20, size // 11))
        cx, cy = (int(v) for v in rng.integers(2 * r + 2, size - 2 * r - 2, 2))
        image += rng.uniform(0.25, 0.4) * np.exp(-(((x - cx) ** 2 + (y - cy) ** 2) / (2 * r * r)) ** 2)
        boxes.append((cx - r, cy - r, cx + r, cy + r))
    return np.clip(image, 0, 1).astype(np.float32), boxes


def generate(spark: SparkSession, patients: int | DataFrame = 60, images: int = 2, prevalence: float = 0.3, sites: tuple[str, ...] = ("site_a", "site_b"), size: int = 128, seed: int = 7) -> DataFrame:
    """A table of cases. Labels are by patient; each patient has a random stream of its own, so patients come in parallel.

    patients is their number, or a table with their whole, not negative numbers as id.
    """

    def make(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for p in b["id"].tolist():
                rng = np.random.default_rng([seed, p])
                label = int(rng.random() < prevalence)
                for k in range(images):
                    image, boxes = phantom(rng, size, bool(label))
                    rows.append((f"P{p:04d}_img{k}", f"P{p:04d}", sites[p % len(sites)], "abc"[p % 3], ("40-49", "50-59")[p % 2], label, size, size, image.ravel().tolist(), boxes))
            yield pd.DataFrame(rows, columns=["case_id", "patient_id", "site", "density_band", "age_band", "label", "h", "w", "pixels", "lesion_boxes"])

    ids = spark.range(patients) if isinstance(patients, int) else patients.select("id").where("id >= 0")
    return ids.mapInPandas(make, SCHEMA)

"""Encoding profiles: immutable manifests whose digest is their identity."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from lodestone.types import DIMENSIONS, LodestoneError

BACKENDS = ("cpu", "coreml", "cuda")


def canonical_json(value: object) -> str:
    """Keys sorted, no white space; manifests hold ASCII only."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    if not text.isascii():
        raise ValueError("a manifest holds ASCII only")
    return text


def profile_id(manifest: dict) -> str:
    return "sha256:" + hashlib.sha256(canonical_json(manifest).encode()).hexdigest()


@dataclass(frozen=True)
class Profile:
    name: str
    family: str
    dimensions: int
    status: str = "active"
    requires_model: bool = False
    settings: dict = field(default_factory=dict, hash=False)
    calibration_status: str = "uncalibrated"
    default_threshold: float | None = None
    dtype: str = "float32_le"

    @property
    def manifest(self) -> dict:
        return {"name": self.name, "family": self.family, "dimensions": self.dimensions, "dtype": self.dtype, "metric": "cosine", "settings": self.settings}

    @property
    def profile_id(self) -> str:
        return profile_id(self.manifest)

    def row(self) -> tuple:
        return (self.profile_id, self.name, self.family, self.dimensions, self.dtype, self.status, self.calibration_status, self.default_threshold, self.requires_model, canonical_json(self.manifest))


SCHEMA = "profile_id string, name string, family string, dimensions int, dtype string, status string, calibration_status string, default_threshold double, requires_model boolean, manifest string"

_GRAMS = {"features": "character_1_to_5_grams", "hash": "fnv1a64_seeded_by_length", "bucket": "low_12_bits", "sign": "bit_63", "normalization": "f64_l2_then_f32", "text": "bom_newlines_nfc", "unicode": unicodedata.unidata_version}
_LANDMARKS = {"rate": 16000, "fft": 1024, "hop": 256, "window": "hann_periodic", "bins": [6, 256], "peaks": 5, "triples": [[7, 3], [15, 7], [31, 15], [63, 31]], "pooling": "signed_sqrt_then_l2", "windows": "up_to_32_of_8_seconds"}


def registry() -> list[Profile]:
    """All known profiles; historic ones stay readable but encode nothing new."""
    out = [
        Profile("text-grams-v1", "text", DIMENSIONS, "historic", settings=_GRAMS),
        Profile("document-grams-v1", "text", DIMENSIONS, settings=_GRAMS | {"readers": ["utf8", "docx"]}),
        Profile("audio-landmarks-v1", "audio", DIMENSIONS, settings=_LANDMARKS),
    ]
    for backend in BACKENDS:
        out.append(Profile(f"image-embedding-{backend}-v1", "image", 512, requires_model=True, settings={"backend": backend}))
        out.append(Profile(f"video-frame-mean-{backend}-v1", "video", 512, requires_model=True, settings={"backend": backend, "frames": 32}))
    return out


def active_profiles(backend: str = "cpu") -> dict[str, Profile]:
    """The profile that each family is encoded under with this backend."""
    if backend not in BACKENDS:
        raise LodestoneError("invalid_request", "request", f"no backend {backend}")
    return {p.family: p for p in registry() if p.status == "active" and (not p.requires_model or p.settings["backend"] == backend)}


def find_profile(profile_id_: str) -> Profile:
    for p in registry():
        if p.profile_id == profile_id_:
            return p
    raise LodestoneError("unknown_profile", "profile", f"no profile {profile_id_}")


def registry_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([p.row() for p in registry()], SCHEMA)

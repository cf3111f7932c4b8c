"""Tasks, precisions, devices and options of a prediction, with the spellings that are understood."""

from __future__ import annotations

import re
from dataclasses import dataclass


class InferenceError(Exception):
    """Anything that stops a prediction; subclasses say at what."""


class ModelLoadError(InferenceError):
    pass


class ImageError(InferenceError):
    pass


class ConfigError(InferenceError):
    pass


class PostprocessError(InferenceError):
    pass


TASKS = {
    "detect": ("detect", "detection"),
    "segment": ("segment", "segmentation"),
    "pose": ("pose", "keypoint", "keypoints"),
    "classify": ("classify", "classification", "cls"),
    "obb": ("obb", "oriented"),
    "semantic": ("semantic", "semantic_segmentation", "semseg"),
    "depth": ("depth", "depth_estimation"),
}
TASK_SUFFIX = {"detect": "", "segment": "-seg", "pose": "-pose", "classify": "-cls", "obb": "-obb", "semantic": "-sem", "depth": "-depth"}
#: What a task's results hold.
CAPABILITIES = {
    "boxes": {"detect", "segment", "pose", "obb"},
    "masks": {"segment"},
    "keypoints": {"pose"},
    "probs": {"classify"},
    "obb": {"obb"},
    "semantic_mask": {"semantic"},
    "depth": {"depth"},
}
PRECISIONS = {"8": ("8", "int8", "w8a8"), "16": ("16", "fp16", "w16a16"), "32": ("32", "fp32", "w32a32"), "w8a16": ("w8a16",), "w8a32": ("w8a32",)}
PRECISION_LABELS = {"8": "INT8", "16": "FP16", "32": "FP32", "w8a16": "W8A16", "w8a32": "W8A32", None: "FP32"}
_PLAIN_DEVICES = ("cpu", "coreml", "xnnpack", "intel:cpu", "intel:gpu", "intel:npu")
_INDEXED_DEVICES = ("cuda", "directml", "tensorrt", "rocm")
_PROVIDERS = {"coreml": "CoreML", "cuda": "CUDA", "tensorrt": "TensorRT", "directml": "DirectML", "rocm": "ROCm", "openvino": "OpenVINO"}


def _known(table: dict[str, tuple[str, ...]], text: str, what: str) -> str:
    low = text.lower()
    for name, spellings in table.items():
        if low in spellings:
            return name
    raise ConfigError(f"unknown {what}: {text!r}")


def parse_task(text: str) -> str:
    return _known(TASKS, text, "task")


def parse_precision(text: str) -> str:
    return _known(PRECISIONS, text, "precision")


def parse_device(text: str) -> str:
    """The device's full name, with its index; a malformed index is an error, not device 0."""
    low = text.lower()
    if low in _PLAIN_DEVICES:
        return low
    m = re.fullmatch(rf"({'|'.join(_INDEXED_DEVICES)})(?::\+?(\d+))?", low)
    if not m:
        raise ConfigError(f"unknown device: {text!r}")
    return f"{m[1]}:{int(m[2] or 0)}"


def parse_colormap(text: str) -> str:
    return _known({"inferno": ("inferno",), "jet": ("jet",), "spectral": ("spectral", "spectral_r"), "gray": ("gray", "grey", "grayscale")}, text, "colormap")


def parse_depth_viz(text: str) -> str:
    return _known({"metric": ("metric",), "disparity": ("disparity", "depthanything")}, text, "depth visualisation")


def provider_label(provider: str) -> str:
    low = provider.lower()
    return next((label for key, label in _PROVIDERS.items() if key in low), "CPU")


def parse_classes(text: str) -> list[int]:
    """Class ids of "1,2", "[1, 2]" or "(1,2)", quoted or not; blank is the empty list."""
    inner = text.strip().strip("[]()\"'")
    if not inner:
        return []
    try:
        out = [int(p.strip()) for p in inner.split(",")]
    except ValueError as bad:
        raise ConfigError(f"bad class ids: {text!r}") from bad
    if min(out) < 0:
        raise ConfigError(f"bad class ids: {text!r}")
    return out


@dataclass(frozen=True)
class InferenceConfig:
    """Options of a prediction. classes: None keeps all, an empty tuple keeps none."""

    conf: float = 0.25
    iou: float = 0.7
    max_det: int = 300
    imgsz: tuple[int, int] | None = None
    batch: int | None = None
    precision: str | None = None
    device: str = "cpu"
    rect: bool = True
    classes: tuple[int, ...] | None = None
    save: bool = True
    save_frames: bool = False

    def keeps(self, cls: int) -> bool:
        return self.classes is None or cls in self.classes

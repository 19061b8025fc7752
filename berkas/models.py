"""Where models lie, and detectors and recognisers made of them. No weights come along; whoever has them gives a folder.

A detector is a function from one input tensor (1, 3, h, w) to its map (h, w); a recogniser one from crops (colour arrays)
to (text, confidence) each. Both are opened once per worker, on first use, since sessions cannot travel."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

import numpy as np

from berkas.config import Config
from berkas.operators import vision

# Names under which models and their characters are looked for, in this order.
DETECTION = ["PP-OCRv6_det_small.onnx", "ppocrv6_small_det.onnx"]
RECOGNITION = ["PP-OCRv6_rec_small.onnx", "ppocrv6_small_rec.onnx"]
CHARACTERS = ["ppocrv6_keys.txt", "ppocr_keys_v1.txt"]
FOLDERS = ["./models", "./models/ocr", "../ocr/models/ocr", "../models"]
LIBRARIES = ["./libs", "../libs", "../ocr/libs", "./bin"]
LIBRARY_NAMES = ["libpdfium.so", "libpdfium.dylib", "pdfium.dll"]
_OPEN: dict[tuple, object] = {}


def cache_folder() -> Path:
    """BERKAS_CACHE, else a folder of the user."""
    return Path(os.environ.get("BERKAS_CACHE") or Path.home() / ".cache" / "berkas")


def model_folder() -> Path:
    """OCR_MODEL_DIR if it exists, else the first usual folder that does, else one in the cache."""
    named = os.environ.get("OCR_MODEL_DIR")
    if named and Path(named).exists():
        return Path(named)
    return next((Path(f) for f in FOLDERS if Path(f).exists()), cache_folder() / "models")


def pdf_library(config: Config) -> str | None:
    """The file of a PDF renderer: the one that is set, PDFIUM_PATH, or one in a usual folder; None where there is none. What
    opens it is given to the engine as its parser."""
    named = [config.pdf_library_path, os.environ.get("PDFIUM_PATH")]
    usual = [str(Path(f) / n) for f in (*LIBRARIES, str(cache_folder() / "libs")) for n in LIBRARY_NAMES]
    return next((p for p in [*named, *usual] if p and Path(p).is_file()), None)


def resolved(config: Config) -> Config:
    """The settings with paths of models and characters filled in where they are not set; the first name stands for one
    that does not exist."""
    folder = model_folder()
    pick = lambda names: str(next((folder / n for n in names if (folder / n).exists()), folder / names[0]))
    return config.with_(
        detection_model_path=config.detection_model_path or pick(DETECTION),
        recognition_model_path=config.recognition_model_path or pick(RECOGNITION),
        dictionary_path=config.dictionary_path or pick(CHARACTERS),
    )


def characters(path: str) -> list[str]:
    """The alphabet of a recogniser, a character a line; where the file is missing, the one of the usual name beside it."""
    p = Path(path) if Path(path).exists() else Path(path).parent / CHARACTERS[0]
    if not p.exists():
        raise FileNotFoundError(f"Model not found: no characters at {path}")
    return p.read_text(encoding="utf-8").splitlines()


def _session(path: str, config: Config):
    intra, inter = config.threads()
    key = (path, intra, inter)
    if key not in _OPEN:
        if not Path(path).exists():
            raise FileNotFoundError(f"Model not found: {path}")
        import onnxruntime as ort

        o = ort.SessionOptions()
        o.intra_op_num_threads, o.inter_op_num_threads = intra, inter
        o.execution_mode = ort.ExecutionMode.ORT_SEQUENTIAL
        _OPEN[key] = ort.InferenceSession(path, o, providers=["CPUExecutionProvider"])
    return _OPEN[key]


def onnx_detector(config: Config) -> Callable[[np.ndarray], np.ndarray]:
    """A detector from a model file."""
    config = resolved(config)

    def run(tensor: np.ndarray) -> np.ndarray:
        s = _session(config.detection_model_path, config)
        out = s.run(None, {s.get_inputs()[0].name: tensor.astype(np.float32)})[0]
        return np.asarray(out).reshape(-1)[: tensor.shape[2] * tensor.shape[3]].reshape(tensor.shape[2], tensor.shape[3])

    return run


def onnx_recogniser(config: Config) -> Callable[[list], list[tuple[str, float]]]:
    """A recogniser from a model file: crops padded to one width, greedy decoding."""
    config = resolved(config)

    def run(crops: list[np.ndarray]) -> list[tuple[str, float]]:
        s = _session(config.recognition_model_path, config)
        alphabet = _OPEN.setdefault((config.dictionary_path,), None) or characters(config.dictionary_path)
        _OPEN[(config.dictionary_path,)] = alphabet
        batch = vision.recogniser_batch(crops)
        probs = np.asarray(s.run(None, {s.get_inputs()[0].name: batch})[0])
        used = [min(int(np.ceil(vision.recogniser_input(c).shape[2] / batch.shape[3] * probs.shape[1])) + 2, probs.shape[1]) for c in crops]
        return [greedy(p[:n], alphabet) for p, n in zip(probs, used)]

    return run


def greedy(probs: np.ndarray, alphabet: list[str]) -> tuple[str, float]:
    """Text and confidence of the scores (steps, classes) of one crop, as `recognition.greedy_text` has them."""
    best = probs.argmax(1)
    top = probs.max(1).astype(float)
    soft = 1 / np.exp(probs.astype(float) - top[:, None]).sum(1)
    sure = np.where((top >= 0) & (top <= 1), top, soft)
    text, scores, before = [], [], 0
    for k, c in zip(best, sure):
        if k != before and k != 0:
            letter = alphabet[k - 1] if k <= len(alphabet) else " "
            if not (letter == " " and text and text[-1] == " "):
                text.append(letter)
                scores.append(c)
        before = k
    return "".join(text).strip(), float(np.mean(scores)) if scores else 0.0


def warmed(detector: Callable | None, recogniser: Callable | None) -> None:
    """Opens the models on an empty image; errors stay for the first real one."""
    for f in (lambda: detector(np.zeros((1, 3, 32, 32), np.float32)), lambda: recogniser([np.zeros((48, 48, 3), np.uint8)])):
        try:
            f()
        except Exception:  # noqa: BLE001, S110
            pass

"""Recognition engines and the choice between them.

An engine takes a crop and returns its text and a confidence from 0 to 1; a
text that can't be read is empty with confidence 0.  The libraries behind the
engines are optional: they are loaded in the worker that first asks for them,
and an engine whose library or model isn't there reads nothing.
"""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from collections.abc import Callable

import numpy as np

from vestry.config import DEFAULT

NOTHING = ("", 0.0)


def _rgb(img: np.ndarray) -> np.ndarray:
    return img[..., ::-1] if img.ndim == 3 else np.repeat(img[..., None], 3, axis=2)


class _Lazy:
    """Loads once a process; what is loaded isn't pickled."""

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_loaded"}

    def loaded(self):
        if "_loaded" not in self.__dict__:
            try:
                self._loaded = self.load()
            except Exception:  # noqa: BLE001  an engine that isn't there reads nothing
                self._loaded = None
        return self._loaded

    def load(self):
        raise NotImplementedError


class TrOCR(_Lazy):
    """A vision encoder with a text decoder, for handwriting and old print; it gives no confidence of its own."""

    #: Generation limits, and the confidence of any text.
    LIMITS = {"max_length": 128, "num_beams": 4, "early_stopping": True}
    CONFIDENCE = 0.8

    def __init__(self, model: str):
        self.model = model

    def load(self):
        import torch
        from PIL import Image
        from transformers import TrOCRProcessor, VisionEncoderDecoderModel

        return torch, Image, TrOCRProcessor.from_pretrained(self.model), VisionEncoderDecoderModel.from_pretrained(self.model).eval()

    def __call__(self, crop: np.ndarray) -> tuple[str, float]:
        if (got := self.loaded()) is None:
            return NOTHING
        torch, image, processor, model = got
        with torch.no_grad():
            ids = model.generate(processor(image.fromarray(np.ascontiguousarray(_rgb(crop))), return_tensors="pt").pixel_values, **self.LIMITS)
        return processor.batch_decode(ids, skip_special_tokens=True)[0].strip(), self.CONFIDENCE


class EasyOCR(_Lazy):
    """Detects and reads lines; the confidence is the lines' mean to four places."""

    def __init__(self, languages: tuple[str, ...] = (DEFAULT.language,), gpu: bool = False):
        self.languages, self.gpu = languages, gpu

    def load(self):
        import easyocr

        return easyocr.Reader(list(self.languages), gpu=self.gpu)

    def __call__(self, crop: np.ndarray) -> tuple[str, float]:
        reader = self.loaded()
        found = reader.readtext(np.ascontiguousarray(_rgb(crop))) if reader else []
        if not found:
            return NOTHING
        return " ".join(text for _, text, _ in found).strip(), round(sum(c for *_, c in found) / len(found), 4)


class Tesseract:
    """The command-line program on a block of text; any text has confidence 0.5."""

    def __init__(self, language: str = "rus", timeout: float = 30, program: str = "tesseract"):
        self.language, self.timeout, self.program = language, timeout, program

    def __call__(self, crop: np.ndarray) -> tuple[str, float]:
        if shutil.which(self.program) is None:
            return NOTHING
        h, w = crop.shape[:2]
        body = np.ascontiguousarray(_rgb(crop) if crop.ndim == 3 else crop).tobytes()
        with tempfile.NamedTemporaryFile(suffix=".pnm") as f:  # read by a program on the same machine, gone after it
            f.write(b"P%d %d %d 255\n" % (6 if crop.ndim == 3 else 5, w, h) + body)
            f.flush()
            try:
                got = subprocess.run([self.program, f.name, "stdout", "-l", self.language, "--psm", "6"], capture_output=True, text=True, timeout=self.timeout)
            except (OSError, subprocess.SubprocessError):
                return NOTHING
        text = got.stdout.strip()
        return text, 0.5 if text else 0.0


class Cascade:
    """The first engine's text if any, else the second's; with ``voting`` a second of little confidence yields to a longer third.

    An engine that fails reads nothing; without a second the third stands in for it.
    """

    def __init__(self, primary: Callable | None = None, secondary: Callable | None = None, fallback: Callable | None = None, voting: bool = False):
        self.primary, self.secondary, self.fallback, self.voting = primary, secondary or fallback, fallback, voting

    @staticmethod
    def _ask(engine: Callable | None, crop: np.ndarray) -> tuple[str, float] | None:
        try:
            return engine(crop) if engine else NOTHING
        except Exception:  # noqa: BLE001  reading goes on with the next engine
            return None

    def __call__(self, crop: np.ndarray) -> tuple[str, float]:
        first = self._ask(self.primary, crop)
        if first and first[0]:
            return first
        second = self._ask(self.secondary, crop)
        if second is None:  # failed: the third takes its place
            second = self._ask(self.fallback, crop) or NOTHING
        if self.voting and second[1] < DEFAULT.ocr_second:
            third = self._ask(self.fallback, crop) or NOTHING
            return third if len(third[0]) > len(second[0]) else second
        return second


def registered(backends: dict, voting: bool = False) -> Cascade:
    """The cascade of the engines that are registered as ``ocr:trocr``, ``ocr:easyocr`` and ``ocr:tesseract``."""
    return Cascade(*(backends.get(f"ocr:{name}") for name in ("trocr", "easyocr", "tesseract")), voting=voting)

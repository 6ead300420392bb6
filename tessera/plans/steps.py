"""Steps of an extraction run: names, titles, explanations, and the driver-side log."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

_HEAD, _ENGINES = ("start", "cache_check"), ("extract_text", "extract_blocks", "extract_rects")
_MODEL, _PLAIN = ("build_context", "llm_call", "parse_response", "bind_provenance", "detect_issues", "apply_schema", "complete"), ("pair_fields", "apply_schema", "complete")
#: Step names in order, with a model and without; with the engines bundled in one; from the cache.
MODEL_STEPS, PLAIN_STEPS = (*_HEAD, *_ENGINES, "fuse", *_MODEL), (*_HEAD, *_ENGINES, "fuse", *_PLAIN)
BUNDLED_MODEL_STEPS, BUNDLED_PLAIN_STEPS = (*_HEAD, "extract_all", "fuse", *_MODEL), (*_HEAD, "extract_all", "fuse", *_PLAIN)
CACHE_STEPS = (*_HEAD, "cache_hit", "complete")
#: Titles (es, en).
TITLES = {
    "start": ("Inicio", "Start"), "cache_check": ("Comprobando caché", "Checking cache"), "cache_hit": ("Caché encontrada", "Found in cache"),
    "extract_text": ("Extracción texto", "Text extraction"), "extract_blocks": ("Análisis semántico", "Semantic analysis"), "extract_rects": ("Análisis visual", "Visual analysis"),
    "extract_all": ("Extracción paralela", "Parallel extraction"), "fuse": ("Fusión 3 motores", "Fusion of 3 engines"), "build_context": ("Preparando contexto LLM", "Preparing model context"),
    "llm_call": ("Consultando modelo", "Asking the model"), "parse_response": ("Parseando respuesta", "Reading the answer"), "bind_provenance": ("Vinculando provenance", "Binding provenance"),
    "detect_issues": ("Detectando problemas", "Detecting issues"), "apply_schema": ("Tipando valores", "Typing values"), "pair_fields": ("Emparejando campos", "Pairing fields"), "complete": ("Listo", "Done"),
    "error": ("Error", "Error"),
}
#: What a step does (es, en).
EXPLANATIONS = {
    "start": ("Llegan los documentos de esta ejecución.", "The documents of this run have come in."),
    "cache_check": ("Se separan los documentos cuyo resultado ya está guardado.", "Documents whose result is stored already are set apart."),
    "cache_hit": ("Se reutiliza un resultado guardado.", "A stored result is used again."),
    "extract_text": ("Cada trozo de texto con su sitio y su letra.", "Every run of text with its place and font."),
    "extract_blocks": ("Títulos, párrafos, listas y tablas.", "Headings, paragraphs, lists and tables."),
    "extract_rects": ("Recuadros, casillas y rejillas dibujadas.", "Drawn boxes, checkboxes and grids."),
    "extract_all": ("Las tres lecturas a la vez.", "All three readings at once."),
    "fuse": ("Cada texto recibe su bloque, su recuadro y su celda.", "Every text gets its block, box and cell."),
    "build_context": ("Se resume el documento por secciones para el modelo.", "The document is put by sections for the model."),
    "llm_call": ("El modelo propone valores para los campos.", "The model proposes values for the fields."),
    "parse_response": ("Se lee el JSON de la respuesta.", "The answer's JSON is read."),
    "bind_provenance": ("Cada valor vuelve a su sitio en el documento.", "Every value is taken back to its place in the document."),
    "detect_issues": ("Se señalan valores que no constan o constan mal.", "Values that aren't there, or hardly, are marked."),
    "apply_schema": ("Los textos pasan a fechas, importes y demás tipos.", "Texts become dates, amounts and other types."),
    "pair_fields": ("Cada etiqueta se une con su valor, sin modelo.", "Every label is joined with its value, without a model."),
    "complete": ("Ha terminado la ejecución.", "The run is over."),
    "error": ("La ejecución se ha interrumpido.", "The run has broken off."),
}


def explanation_for(name: str, language: str = "es") -> str:
    """Spanish where the language isn't known, nothing for an unknown step."""
    pair = EXPLANATIONS.get(name, ("", ""))
    return pair[1] if language == "en" else pair[0]


def title_for(name: str, language: str = "es") -> str:
    """Spanish where the language isn't known."""
    pair = TITLES.get(name, (name, name))
    return pair[1] if language == "en" else pair[0]


@dataclass(frozen=True)
class Step:
    name: str
    title: str
    index: int
    total: int
    elapsed_s: float
    cumulative_s: float
    #: counts are relations too: nothing runs before somebody reads them
    payload: dict = field(default_factory=dict)
    is_terminal: bool = False

    def explanation(self, language: str = "es") -> str:
        return explanation_for(self.name, language)

    @property
    def progress(self) -> float:
        """Steps so far of those that a full run has: below 1 at the end of a shorter run."""
        return (self.index + 1) / self.total if self.total else 0.0


class StepLog:
    """Numbers and times steps, keeps them, and tells a callback."""

    def __init__(self, total: int, language: str = "es", callback: Callable[[Step], None] | None = None, clock: Callable[[], float] = time.perf_counter):
        self.total, self.language, self.callback, self.clock = total, language, callback, clock
        self.steps: list[Step] = []
        self.began = self.last = clock()

    def emit(self, name: str, **payload: object) -> Step:
        now = self.clock()
        step = Step(name, title_for(name, self.language), len(self.steps), self.total, now - self.last, now - self.began, payload, name in ("complete", "error"))
        self.last = now
        self.steps.append(step)
        if self.callback:
            self.callback(step)
        return step

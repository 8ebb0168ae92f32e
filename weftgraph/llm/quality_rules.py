"""Quality rules: line-first cleaning.

Every line is judged by itself: navigation (menu bars of short items, lines of
links), boilerplate (licence, copyright, cookie, legal and share lines in the
corpus's languages) and punctuation (symbols stuck to words, shouting with
repeated marks, more marks than letters, one word over and over). Short lines
that end without a mark are navigation too where several follow each other.
Lines that fail are removed, and a document that loses too much of its text
with them is rejected, as is one that fails the base rules on length and on
repeated passages. Rows are judged in place; there is no shuffle.

A null or empty text has no words and is rejected. Texts of any length are
judged whole; a share that equals its limit fails a line and keeps a document.
Rows with null or repeated ids are judged one by one; extra columns are
ignored, or carried through by ``clean_documents``; an empty table gives no
rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import slices

WINDOW = 8
_SYMBOLS, _SPACES = b"#*$%&|<>", b" \t\n\r\x0b\x0c"
#: Phrases of boilerplate lines, in English, French, German and Spanish; what ends a sentence.
BOILERPLATE = (
    r"\b(licen[sc]ed under|released under the|all rights reserved|copyright \(c\)|terms of (use|service)|privacy policy|accept (all )?cookies|share (this|on)"
    r"|tous droits r(é|É)serv(é|É)s|mentions l(é|É)gales|conditions d'utilisation|politique de confidentialit(é|É)"
    r"|alle rechte vorbehalten|nutzungsbedingungen|datenschutzerkl(ä|Ä)rung|impressum"
    r"|todos los derechos reservados|aviso legal|condiciones de uso|pol(í|Í)tica de privacidad)"
)
MARKED = r"[#*$%&<>]{2,}|!!"
LINK = r"://|^www\."
ENDS = ".!?:;\"')]}"
_BOILERPLATE, _MARKED, _LINK = (re.compile(x.encode(), re.I) for x in (BOILERPLATE, MARKED, LINK))
_LAST = frozenset(ENDS.encode())
_MARKS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())


@dataclass(frozen=True)
class Rules:
    """Limits for lines, and last those for documents."""

    menu_share: float = 0.3  # of words that are a separating bar
    marked_share: float = 0.3  # of words with symbols in a row or doubled exclamation marks
    same_share: float = 0.6  # of words equal to the word before, in lines of min_same words
    min_same: int = 8
    link_share: float = 0.5  # of words that are links
    mark_share: float = 0.5  # of characters that are ASCII marks
    short_line: int = 3  # words of a line that may be an item of a list of links
    min_run: int = 3  # such lines in a row, blank ones aside, from which on they are
    max_lost: float = 0.6  # of word characters in removed lines
    min_words: int = 20
    max_repeat_percent: int = 30


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of so many words which the text has twice or more."""
    n = len(words) - window + 1
    if n < 2 or len(set(words)) == len(words):
        return 0
    number: dict[bytes, int] = {}
    rank = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    width = 1
    while width < window:  # equal rank: equal sequence of so many words
        step = min(width, window - width)
        rank = np.unique(rank[: len(rank) - step] * (len(words) + 1) + rank[step:], return_inverse=True)[1].astype(np.int64)
        width += step
    twice = np.bincount(rank)[rank] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def line_fault(line: bytes, words: list[bytes], rules: Rules) -> str | None:
    """The rule that a line with words fails, if any."""
    n = len(words)
    if b"|" in line and sum(w == b"|" for w in words) >= rules.menu_share * n:
        return "navigation"
    if _BOILERPLATE.search(line):
        return "boilerplate"
    if _MARKED.search(line) and sum(_MARKED.search(w) is not None for w in words) >= rules.marked_share * n:
        return "punctuation"
    if n >= rules.min_same and sum(map(bytes.__eq__, words, words[1:])) >= rules.same_share * (n - 1):
        return "repetition"
    if (b"://" in line or b"www." in line) and sum(_LINK.search(w) is not None for w in words) >= rules.link_share * n:
        return "navigation"
    marks = len(line) - len(line.translate(None, _MARKS))
    if marks >= rules.mark_share * (len(line) // 4) and marks >= rules.mark_share * len(b"".join(words).decode()):
        return "punctuation"
    return None


def is_item(line: bytes, words: list[bytes], rules: Rules) -> bool:
    return len(words) <= rules.short_line and words[-1][-1] not in _LAST


def _mark(fails: list[bool], run: list[int], rules: Rules) -> None:
    """At a run's end: its lines fail together if they are many."""
    if len(run) >= rules.min_run:
        for k in run:
            fails[k] = True
    run.clear()


def judge(text: str | None, rules: Rules) -> tuple:
    text = text or ""
    raw = text.encode()
    words = raw.split()
    word_chars = len(text) - (len(raw) - len(raw.translate(None, _SPACES)))
    seen: set[bytes] = set()
    n_dup = 0
    lines, fails, run = raw.split(b"\n"), [], []
    for number, line in enumerate(lines):
        own = line.split()
        fails.append(bool(own) and line_fault(line, own, rules) is not None)
        if own:
            n_dup += line in seen
            seen.add(line)
            if is_item(line, own, rules):
                run.append(number)
            elif run:
                _mark(fails, run, rules)
    _mark(fails, run, rules)
    lost = sum(len(b"".join(x.split()).decode()) for x, bad in zip(lines, fails, strict=True) if bad)
    kept = [x for x, bad in zip(lines, fails, strict=True) if not bad]
    n_symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    n_repeat = repeated_words(words)
    failed = len(words) < rules.min_words or 100 * n_repeat > rules.max_repeat_percent * len(words)
    return len(words), word_chars, n_symbols, n_dup, n_repeat, failed, not failed and lost <= rules.max_lost * word_chars, b"\n".join(kept).decode(), lost


def apply_rules(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_chars)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                judged = list(zip(*((*j[:7], j[8]) for j in (judge(t, rules) for t in part.column(1).to_pylist())), strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, t) for x, t in zip(judged, _TYPES, strict=True))], [id_col, *_NAMES])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost_chars long")


def clean_documents(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text") -> DataFrame:
    """The kept rows of ``docs``, all columns, with the text of their kept lines."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                judged = [judge(t, rules) for t in part.column(at).to_pylist()]
                text = pa.array([j[7] for j in judged], pa.string())
                columns = [text if i == at else c for i, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names).filter(pa.array([j[6] for j in judged], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")
_TYPES = (pa.int64(),) * 5 + (pa.bool_(),) * 2 + (pa.int64(),)

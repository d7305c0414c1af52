"""Language identification of mixed text: script ranges, per-word scores and a Viterbi path.

A word's script narrows the languages that it can be in. Each remaining language scores the word by its
letters' pairs and triples, counted over training documents in hashed cells. A Viterbi pass over the
words of a document, in which every change of language costs a penalty, labels spans; the document's
language is the one with most letters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sample_by_id, text_batches

#: The most training documents (those with the smallest hash of the identifier), hashed cells and
#: characters whose cells are scored at once; words of a text that are followed one after another.
MOST_DOCS, CELLS, SLICE, STRETCH = 20_000, 1 << 16, 1 << 19, 4096
SWITCH, SMOOTH, RARE_SCRIPT = 12.0, 0.5, 0.002
#: First code points of script ranges, each up to the next, and their names.
SCRIPTS = (
    (0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"),
    (0x700, "other"), (0x900, "devanagari"), (0x980, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"),
    (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "other"), (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"), (0x32000, "other"),
)
_NAMES = sorted({n for _, n in SCRIPTS})
_STARTS = np.array([s for s, _ in SCRIPTS], np.int64)
_SCRIPT_OF = np.array([_NAMES.index(n) for _, n in SCRIPTS], np.int8)
_tables: dict[str, np.ndarray] = {}


def _letters(points: np.ndarray) -> np.ndarray:
    """Whether code points are letters or marks; beyond the basic plane all but symbols count."""
    if "letter" not in _tables:
        _tables["letter"] = np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x10000)])
    low = points < 0x10000
    out = _tables["letter"][np.where(low, points, 0)]
    return np.where(low, out, (points >= 0x20000) | (points < 0x1F000))


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters' hashed cells of concatenated lower-case texts, and the words that they form.

    Gives (pair cells, triple cells, first letter of each word, its text, its script, its start and its
    end in characters of its text). Letters are numbered over all texts.
    """
    line = "\n".join(t.lower() if len(t.lower()) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t) for t in texts)
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    is_letter = _letters(points)
    padded = np.zeros(len(points) + 2, np.uint32)
    padded[1:-1] = np.where(is_letter, points, 0)
    at = np.flatnonzero(is_letter)
    before, here, after = padded[at], padded[at + 1], padded[at + 2]
    pair = (before * np.uint32(0x9E3779B1) ^ here) * np.uint32(0x85EBCA6B)
    triple = (pair ^ after * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)
    pair, triple = (pair >> np.uint32(16)).astype(np.int32), (triple >> np.uint32(16)).astype(np.int32)
    first = np.flatnonzero(before == 0)
    base = np.concatenate(([0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))))
    text = np.searchsorted(base, at[first], "right") - 1
    last = np.append(first[1:], len(at)) - 1
    script = _SCRIPT_OF[np.searchsorted(_STARTS, here[first].astype(np.int64), "right") - 1]
    return pair, triple, first, text, script, at[first] - base[text], at[last[: len(first)]] + 1 - base[text]


@dataclass
class Model:
    """languages, log-probabilities (pairs, then triples) by cell and language, scripts in use."""

    languages: list[str]
    pairs: np.ndarray
    triples: np.ndarray
    scripts: np.ndarray


def fit_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", most_docs: int = MOST_DOCS) -> Model:
    """Learn from the rows with a text and a language, about ``most_docs`` of them at most.

    Spark counts cells; a table of languages times cells, bounded by the number of languages, reaches
    the driver.
    """
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    chosen = sample_by_id(known, id_col, most_docs, known.count())

    def count(batches: Iterator) -> Iterator:
        held: dict[str, np.ndarray] = {}
        for batch in text_batches(batches):
            texts, langs = batch.column("text").to_pylist(), np.array(batch.column("lang").to_pylist(), object)
            for lang in dict.fromkeys(langs.tolist()):
                pair, triple, first, _, script, _, _ = words_of([t for t, x in zip(texts, langs, strict=True) if x == lang])
                cells = held.setdefault(lang, np.zeros(2 * CELLS + len(_NAMES), np.int64))
                cells[:CELLS] += np.bincount(pair, minlength=CELLS)
                cells[CELLS : 2 * CELLS] += np.bincount(triple, minlength=CELLS)
                cells[2 * CELLS :] += np.bincount(script, minlength=len(_NAMES))
        for lang, cells in held.items():
            k = np.flatnonzero(cells)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(cells[k])], names=["lang", "cell", "n"])

    cells = chosen.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).mapInArrow(count, "lang string, cell long, n long")
    found = cells.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique())
    table = np.zeros((2 * CELLS + len(_NAMES), len(languages)))
    for j, lang in enumerate(languages):
        own = found[found["lang"] == lang]
        table[own["cell"].to_numpy(), j] = own["n"].to_numpy()
    logs = lambda x: np.log((x + SMOOTH) / (x.sum(0) + SMOOTH * CELLS)).astype(np.float32)
    scripts = table[2 * CELLS :]
    return Model(languages, logs(table[:CELLS]), logs(table[CELLS : 2 * CELLS]), scripts >= RARE_SCRIPT * np.maximum(1, scripts.sum(0)))


def word_scores(model: Model, pair: np.ndarray, triple: np.ndarray, first: np.ndarray, script: np.ndarray) -> np.ndarray:
    """Log-probability of each word in each language; languages that its script rules out get -1e4."""
    total = np.zeros((len(first), len(model.languages)), np.float32)
    k = 0
    while k < len(first):
        to = max(k + 1, int(np.searchsorted(first, first[k] + SLICE)))
        a, b = first[k], first[to] if to < len(first) else len(pair)
        letters = model.pairs[pair[a:b]] + model.triples[triple[a:b]]
        total[k:to] = np.add.reduceat(letters, first[k:to] - a, axis=0)
        k = to
    allowed = model.scripts[script]
    allowed[~allowed.any(1)] = True
    return np.where(allowed, total, np.float32(-1e4))


def _lanes(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches from the longest on, and how many of them have more than t words, for each t."""
    order = np.argsort(-sizes, kind="stable")
    return order, np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), "left")


def _forward(scores: np.ndarray, back: np.ndarray, begins: np.ndarray, sizes: np.ndarray, enter: np.ndarray, switch: float) -> np.ndarray:
    """Follow stretches in lock step from the scores that they are entered with to those that they are left with; fills ``back``."""
    order, active = _lanes(sizes)
    begins, best = begins[order], enter[order]
    own = np.arange(scores.shape[1], dtype=np.int16)
    for t, n in enumerate(active):
        at, held = begins[:n] + t, best[:n]
        top = held.argmax(1)
        peak = held[np.arange(n), top][:, None]
        stay = held >= peak - switch
        back[at] = np.where(stay, own, top[:, None])
        best[:n] = np.where(stay, held, peak - np.float32(switch)) - peak + scores[at]
    leave = np.empty_like(best)
    leave[order] = best
    return leave


def _backward(labels: np.ndarray, back: np.ndarray, begins: np.ndarray, sizes: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Label stretches in lock step from their last words' languages; the languages of the words before them."""
    order, active = _lanes(sizes)
    begins, state = begins[order], last[order]
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = begins[:n] + t
        labels[at] = state[:n]
        state[:n] = back[at, state[:n]]
    before = np.empty_like(state)
    before[order] = state
    return before


def viterbi(scores: np.ndarray, counts: np.ndarray, switch: float, stretch: int = STRETCH) -> np.ndarray:
    """Best language of each word; ``counts`` words for each text.

    All stretches of at most ``stretch`` words run in lock step. A stretch that follows another one of its
    text is run again as long as what it was entered with is not what the one before was left with, so
    the path is that of one pass over the text. After few words a path hardly depends on its start, so
    a second run mostly settles it, and a very long text takes some thousand steps and not one a word.
    """
    pieces = -(-counts // stretch)
    text = np.repeat(np.arange(len(counts)), pieces)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begins = (np.cumsum(counts) - counts)[text] + nth * stretch
    sizes, follows = np.minimum(stretch, counts[text] - nth * stretch), np.flatnonzero(nth > 0)
    labels, back = np.zeros(len(scores), np.int16), np.zeros(scores.shape, np.int16)
    enter = np.zeros((len(text), scores.shape[1]), np.float32)
    leave, todo = enter.copy(), np.arange(len(text))
    while len(todo):
        leave[todo] = _forward(scores, back, begins[todo], sizes[todo], enter[todo], switch)
        todo = follows[(enter[follows] != leave[follows - 1]).any(1)]
        enter[todo] = leave[todo - 1]
    last, before, todo = leave.argmax(1).astype(np.int16), np.zeros(len(text), np.int16), np.arange(len(text))
    while len(todo):
        before[todo] = _backward(labels, back, begins[todo], sizes[todo], last[todo])
        todo = follows[before[follows] != last[follows - 1]] - 1
        last[todo] = before[todo + 1]
    return labels


def identify_languages(docs: DataFrame, model: Model, text_col: str = "text", *keep: Column, switch: float = SWITCH) -> DataFrame:
    """The ``keep`` columns, lang_pred, score and spans (start, end, lang; in characters) of each row.

    score: the share of the text's letters that lie in words of lang_pred. A text that is null or has no
    letter, or a model that learned no language, gives ``und``, 0.0 and no spans. Ties go to the language
    that is first by code point. Repeated rows give equal results; an empty table gives no rows.
    """
    handle = docs.sparkSession.sparkContext.broadcast(model)  # languages x cells, whatever the corpus
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator) -> Iterator:
        m = handle.value
        names = np.array([*m.languages, "und"], object)
        for batch in text_batches(batches, 1 << 22):
            n = batch.num_rows
            pair, triple, first, text, script, start, end = words_of([t or "" for t in batch.column("text").to_pylist()])
            if not m.languages:
                first, text, start, end = first[:0], text[:0], start[:0], end[:0]
            counts = np.bincount(text, minlength=n)
            letters = np.diff(np.append(first, len(pair)))
            labels = viterbi(word_scores(m, pair, triple, first, script[: len(first)]), counts, switch) if len(first) else np.zeros(0, np.int16)
            share = np.zeros((n, len(names)))
            np.add.at(share, (text, labels), letters)
            total = share.sum(1)
            top = np.where(total > 0, share.argmax(1), len(names) - 1)
            score = np.where(total > 0, share[np.arange(n), top] / np.maximum(total, 1), 0.0)
            new = np.flatnonzero(np.concatenate(([True], (labels[1:] != labels[:-1]) | (text[1:] != text[:-1])))) if len(labels) else np.zeros(0, np.int64)
            last = np.append(new[1:], len(labels)) - 1 if len(labels) else new
            offsets = np.concatenate(([0], np.cumsum(np.bincount(text[new], minlength=n)))).astype(np.int32)
            values = pa.StructArray.from_arrays(
                [pa.array(start[new], pa.int32()), pa.array(end[last], pa.int32()), pa.array(names[labels[new]], pa.string())], fields=list(span_type.value_type)
            )
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(names[top], pa.string()), pa.array(score), pa.ListArray.from_arrays(pa.array(offsets), values, type=span_type)],
                names=[*batch.schema.names[:-1], "lang_pred", "score", "spans"],
            )

    cut = docs.select(*keep, F.col(text_col).alias("text"))
    schema = "".join(f"`{name}` {kind}, " for name, kind in cut.dtypes[:-1])
    return cut.mapInArrow(run, schema + "lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")

"""Language identification by hyperdimensional letter n-gram profiles."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatewise.llm.common import in_arrow, keep, rows_of

#: Symbols: 0 stands between words, 1-26 for a-z, the others share the rest of the letters.
SYMBOLS = 48
DIMENSIONS = 512
SEED = 20240101
#: Prototypes that the driver holds and sends at once; documents meet more languages in as many rounds as it takes.
LANGUAGES = 4096
#: Languages whose letters a task counts at once.
COUNTED = 32


@functools.cache
def symbol_table() -> np.ndarray:
    """Code point -> symbol."""
    letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    table = (27 + (np.arange(0x110000, dtype=np.uint64) * np.uint64(2654435761) >> np.uint64(13)) % np.uint64(SYMBOLS - 27)).astype(np.uint8)
    table[~letters] = 0
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return table


@functools.cache
def letter_vectors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols' random vectors of +1 and -1 as they stand at each place of a trigram: permuted by 2, 1 and 0."""
    letters = np.random.default_rng(SEED).choice(np.array([-1, 1], dtype=np.int8), size=(SYMBOLS, DIMENSIONS))
    return np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1), letters


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    """A row of +1 and -1 per trigram: its letters' vectors, permuted by place and bound by product."""
    first, second, third = letter_vectors()
    return first[codes // (SYMBOLS * SYMBOLS)] * second[codes // SYMBOLS % SYMBOLS] * third[codes % SYMBOLS]


def bundle(codes: np.ndarray, n: np.ndarray, step: int = 2048) -> np.ndarray:
    """The sum of the vectors of trigrams ``codes``, each ``n`` times."""
    own = np.zeros(DIMENSIONS, dtype=np.float64)
    for i in range(0, len(codes), step):
        own += n[i : i + step].astype(np.float32) @ trigram_vectors(codes[i : i + step]).astype(np.float32)
    return own


def trigrams(text: str) -> np.ndarray:
    """Trigram codes of the lower-cased text; whatever lies between letters is one boundary."""
    s = symbol_table()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    s = np.concatenate([[0], s, [0]]).astype(np.int32)
    s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
    if len(s) < 3:
        return np.empty(0, dtype=np.int32)
    return (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]


def prototypes(docs: DataFrame) -> DataFrame:
    """(lang, total array<double>): the bundled n-gram vectors of the documents of each language of ``docs`` (text, lang).

    Every task counts trigrams by language, of COUNTED languages at once, and sends a sum of vectors for each.
    Null texts and languages teach nothing."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            totals = []
            for held in counts.values():
                at = np.flatnonzero(held)
                totals.append(np.rint(bundle(at, held[at])).astype(np.int64))
            n = len(totals)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(list(counts), DIMENSIONS), pa.string()), pa.array(np.tile(np.arange(DIMENSIONS, dtype=np.int32), n)), pa.array(np.concatenate(totals))], names=["lang", "place", "total"])

        for batch in rows_of(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text and lang is not None:
                    codes = trigrams(text)
                    if lang not in counts and len(counts) == COUNTED:
                        yield flush()
                        counts.clear()
                    held = counts.setdefault(lang, np.zeros(SYMBOLS**3, dtype=np.int64))
                    np.add.at(held, codes, 1) if len(codes) < 2000 else held.__iadd__(np.bincount(codes, minlength=SYMBOLS**3))
        if counts:
            yield flush()

    places = in_arrow(docs.select("text", F.col("lang").cast("string").alias("lang")), sums, "lang string, place int, total long").groupBy("lang", "place").agg(F.sum("total").alias("total"))
    whole = places.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "total"))).alias("v"))
    return whole.select("lang", F.transform("v", lambda x: x["total"].cast("double")).alias("total"))


def learn(docs: DataFrame) -> DataFrame:
    """A kept table of the prototypes of ``docs`` (text, lang); see prototypes."""
    return keep(prototypes(docs), "prototypes")


def predict(docs: DataFrame, learned: DataFrame, keep_text: bool = False) -> DataFrame:
    """``docs`` (any columns with text; it goes unless ``keep_text``) plus lang_pred and score, the cosine with the
    nearest prototype of ``learned`` from 0 to 1. Columns of these names are replaced.

    Languages are sent LANGUAGES at a time, by name; each round keeps the better of its nearest and that of the
    rounds before. Ties go to the first language by name. ``und`` with score 0: null text, no letter, or an empty model."""
    docs = docs.drop("lang_pred", "score").withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    n = learned.count()
    after = None
    for at in range(0, max(n, 1), LANGUAGES):
        rows = (learned if after is None else learned.where(F.col("lang") > after)).orderBy("lang").limit(LANGUAGES).toArrow()
        names = rows["lang"].to_pylist()
        after = names[-1] if names else None
        against = rows["total"].combine_chunks().values.to_numpy().reshape(len(names), DIMENSIONS) if names else np.zeros((0, DIMENSIONS))
        against = against / np.maximum(np.linalg.norm(against, axis=1, keepdims=True), 1e-12)
        docs = _nearer(docs, names, against, keep_text or at + LANGUAGES < n)
    return docs


def _nearer(docs: DataFrame, names: list[str], against: np.ndarray, keep_text: bool) -> DataFrame:
    """``docs`` with lang_pred and score where one of ``names`` is nearer than what they hold."""
    model = docs.sparkSession.sparkContext.broadcast((names, against.T.astype(np.float32)))
    place, held, score = (docs.columns.index(c) for c in ("text", "lang_pred", "score"))

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, against = model.value
        for batch in rows_of(batches):
            best, scores = batch.column(held).to_pylist(), batch.column(score).to_pylist()
            for i, text in enumerate(batch.column(place).to_pylist()):
                codes = trigrams(text) if text and names else ()
                if not len(codes):
                    continue
                own = bundle(*np.unique(codes, return_counts=True)).astype(np.float32)
                cosines = own @ against / max(float(np.linalg.norm(own)), 1e-12)
                k = int(np.argmax(cosines))
                near = min(1.0, max(0.0, float(cosines[k])))
                if best[i] == "und" or near > scores[i]:
                    best[i], scores[i] = names[k], near
            kept = [i for i in range(batch.num_columns) if i not in (held, score) and (keep_text or i != place)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(best, pa.string()), pa.array(scores, pa.float64())], names=[*(batch.schema.names[i] for i in kept), "lang_pred", "score"])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in ("lang_pred", "score") and (keep_text or f.name != "text")]
    return in_arrow(docs, guess, ", ".join([*schema, "lang_pred string", "score double"]))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the documents that teach nothing: crc32 of the id as text leaves no rest by 5. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs`` (doc_id, text, lang), learned from those not held out.

    A null id neither teaches nor is held out. Repeated rows are answered each; an empty table gives no
    rows; other columns are not read."""
    named = docs.select("doc_id", "text", "lang", held_out().alias("held_out"))
    return predict(named.select("doc_id", "text", "held_out"), learn(named.where("not held_out and doc_id is not null")))

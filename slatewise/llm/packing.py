"""Packing tokenized documents into sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import contextlib
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slatewise.llm.common import in_arrow, keep, let_go, per_task, rows_of

CAPACITY = 2048
SEPARATOR = 0
#: Documents of one problem; the islands of a problem share them.
PROBLEM = 4096
ISLANDS, POPULATION, GENERATIONS, EPOCHS = 3, 4, 6, 2
#: Bins below this share of the capacity are opened and dealt again over all problems, LEVELS times at most.
WELL_FILLED, LEVELS = 0.97, 3
#: Parts of texts whose ids a worker remembers.
REMEMBERED = 300_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Letters, digits and white space of the tokenizer's word pattern up to U+02AF.
LETTERS, DIGITS, WHITE = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\\t\\n\\v\\f\\r \u0085\u00a0"
WORDS = re.compile(f" ?[{LETTERS}]+| ?[{DIGITS}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{WHITE}{LETTERS}{DIGITS}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
OTHER = re.compile("[^\\x00-\u02af]")


class Encoder:
    """Ids of whole texts, those of the tokenizer file. Its pattern cuts a text into words before merges are
    looked at, so a word's ids don't depend on its neighbours: those of the first words met are remembered,
    the others merged anew from the same vocabulary's ranks. Texts with special tokens or letters beyond
    U+02AF go through the tokenizer whole."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        units = {u: bytes([b]) for b, u in byte_units().items()}
        ranks = {b"".join(units[c] for c in word): i for word, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        self.ranks = tiktoken.Encoding("words", pat_str=r"[^\x00]+|\x00", mergeable_ranks=ranks, special_tokens={})
        self.zero = ranks[b"\0"]
        self.known: dict[str, bytes] = {}

    def _merge(self, words: list[str]) -> list[bytes]:
        """Ids of each word: all go through the ranks at once, a zero byte between them."""
        ids = self.ranks.encode_to_numpy("\0".join(words))
        ends = [*np.flatnonzero(ids == self.zero).tolist(), len(ids)]
        raw, at, out = ids.astype("<u4").tobytes(), 0, []
        for end in ends:
            out.append(raw[4 * at : 4 * end])
            at = end + 1
        if len(self.known) < REMEMBERED:
            self.known.update(zip(words, out, strict=True))
        return out

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of ``text``."""
        if (not text.isascii() and OTHER.search(text)) or "\0" in text or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        words = WORDS.findall(text)
        ids = list(map(self.known.get, words))
        new, at = [], -1
        with contextlib.suppress(ValueError):  # after the last unknown word
            while True:
                at = ids.index(None, at + 1)
                new.append(at)
        if new:
            for at, merged in zip(new, self._merge([words[at] for at in new]), strict=True):
                ids[at] = merged
        return b"".join(ids)


def byte_units() -> dict[int, str]:
    """Byte -> the character that stands for it in byte-level vocabularies: itself where it prints, else one from U+0100 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


let_go(__name__, encoder.cache_clear)


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the token pieces of each document.

    A document is its ids and one SEPARATOR; a null text has the separator alone. Longer ones than
    ``capacity`` are cut so that all pieces but the first are full."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        last = SEPARATOR.to_bytes(4, "little")
        for batch in rows_of(batches):
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = code.encode(text or "") + last
                n = len(ids) // 4
                start, piece = 0, 0
                while start < n:
                    length = (n - start) % capacity or capacity
                    out.append((doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                    start, piece = start + length, piece + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, order: np.ndarray, bins: np.ndarray, fill: list[int], capacity: int) -> np.ndarray:
    """Put the items of ``order`` one by one into the fullest bin that still takes them, else a new one.
    ``bins`` (item -> bin) is filled in; ``fill`` has the bins' fill and grows."""
    free: dict[int, list[int]] = {}
    mask = 0
    for b, f in enumerate(fill):
        if f < capacity:
            free.setdefault(capacity - f, []).append(b)
            mask |= 1 << (capacity - f)
    for item, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            held = free[room]
            b = held.pop()
            if not held:
                mask ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[item] = b
        fill[b] += size
        if room > size:
            free.setdefault(room - size, []).append(b)
            mask |= 1 << (room - size)
    return bins


def fitness(sizes: np.ndarray, bins: np.ndarray) -> tuple[int, float]:
    """Fewer bins first, then fuller ones: smaller is better."""
    fill = np.bincount(bins, weights=sizes)
    return len(fill), -float((fill * fill).sum())


def crossover(sizes: np.ndarray, mother: np.ndarray, father: np.ndarray, rng: np.random.Generator, capacity: int) -> np.ndarray:
    """Whole well-filled bins of the father go into the mother; her bins that hold any of their items are
    opened; what that displaces is best-fitted, largest first."""
    fill = np.bincount(father, weights=sizes)
    good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    chosen = np.zeros(len(fill), dtype=bool)
    chosen[rng.choice(good, size=max(1, int(len(good) * rng.uniform(0.2, 0.6))), replace=False)] = True
    injected = chosen[father]
    opened = np.zeros(int(mother.max()) + 1, dtype=bool)
    opened[mother[injected]] = True
    displaced = np.flatnonzero(opened[mother] & ~injected)
    label = np.where(injected, len(opened) + father, mother)
    label[displaced] = -1
    names, child = np.unique(label[label >= 0], return_inverse=True)
    bins = np.full(len(sizes), -1, dtype=np.int64)
    bins[label >= 0] = child
    filled = np.bincount(child, weights=sizes[label >= 0], minlength=len(names)).astype(np.int64).tolist()
    return best_fit(sizes, displaced[np.argsort(-sizes[displaced], kind="stable")], bins, filled, capacity)


def evolve(sizes: np.ndarray, population: list[np.ndarray], seed: int, capacity: int) -> list[np.ndarray]:
    """GENERATIONS steps of one island, best first. An empty population starts from best-fit decreasing and disturbed orders of it."""
    rng = np.random.default_rng(seed)
    least = -(-int(sizes.sum()) // capacity)
    empty = lambda: np.full(len(sizes), -1, dtype=np.int64)
    while len(population) < POPULATION:
        noise = rng.uniform(0, 0.15 * len(population), len(sizes)) if population else 0.0
        population = [*population, best_fit(sizes, np.argsort(-sizes * (1 - noise), kind="stable"), empty(), [], capacity)]
    ranked = sorted(population, key=lambda p: fitness(sizes, p))
    for _ in range(GENERATIONS):
        if fitness(sizes, ranked[0])[0] <= least:
            break
        a, b = rng.choice(len(ranked), size=2, replace=False)
        mother, father = ranked[min(a, b)], ranked[max(a, b)]
        children = [crossover(sizes, mother, father, rng, capacity), crossover(sizes, father, mother, rng, capacity)]
        ranked = sorted([*ranked, *children], key=lambda p: fitness(sizes, p))[:POPULATION]
    return ranked


ISLAND = "problem long, island int, items array<long>, sizes array<int>, population array<array<int>>"


def _epoch(islands: DataFrame, epoch: int, capacity: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 1):
            row = batch.to_pylist()[0]
            sizes = np.array(row["sizes"], dtype=np.int64)
            start = [np.array(p, dtype=np.int64) for p in row["population"] or []]
            seed = (row["problem"] * 1009 + row["island"] * 31 + epoch) & 0x7FFFFFFF
            found = evolve(sizes, start, seed, capacity)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([[p.tolist() for p in found]], pa.list_(pa.list_(pa.int32())))], names=batch.schema.names)

    return in_arrow(islands, run, ISLAND)


def _solve(items: DataFrame, n: int, capacity: int) -> DataFrame:
    """(item, length, bin) of ``items`` (item, length): problems of about PROBLEM items, each on ISLANDS islands.
    After an epoch each island's elite takes the place of the last of the next island's population."""
    problems = max(1, -(-n // PROBLEM))
    dealt = items.withColumn("problem", F.pmod(F.xxhash64("item"), F.lit(problems)))
    rows = dealt.groupBy("problem").agg(F.sort_array(F.collect_list(F.struct((-F.col("length")).alias("l"), "item"))).alias("x"))
    rows = rows.select("problem", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"), F.col("x.item").alias("items"), F.transform("x", lambda x: (-x["l"]).cast("int")).alias("sizes"), F.lit(None).cast("array<array<int>>").alias("population"))
    rows = rows.repartition(min(problems * ISLANDS, max(per_task(items), problems)), "problem", "island")
    islands = keep(_epoch(rows, 0, capacity), "islands")
    for epoch in range(1, EPOCHS):
        elite = islands.select("problem", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.element_at("population", 1).alias("elite"))
        met = islands.join(elite, ["problem", "island"]).withColumn("population", F.concat(F.slice("population", 1, POPULATION - 1), F.array("elite")))
        islands = keep(_epoch(met.select(*[c.split()[0] for c in ISLAND.split(", ")]), epoch, capacity), "islands")
    best = islands.withColumn("elite", F.element_at("population", 1)).groupBy("problem").agg(F.min_by(F.struct("items", "sizes", "elite"), F.struct(F.array_max("elite"), "island")).alias("b"))
    flat = best.select("problem", F.inline(F.arrays_zip(F.col("b.items").alias("item"), F.col("b.sizes").alias("length"), F.col("b.elite").alias("at"))))
    return flat.select("item", F.col("length").cast("long").alias("length"), (F.col("problem") * (1 << 20) + F.col("at")).alias("bin"))


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece of every document and its place.

    Full pieces are sequences of their own. The others are dealt over problems at random; a problem's
    islands evolve groupings of it and hand on their elites. Bins that stay below WELL_FILLED are opened,
    and their pieces dealt again over fewer problems, so that what many problems leave over meets.
    Repeated rows and ids are packed each; an empty table gives no rows; other columns are not read."""
    cut = keep(pieces(docs, tokenizer, capacity).withColumn("item", F.monotonically_increasing_id()), "pieces")
    left = cut.where(F.col("length") < capacity).select("item", "length")
    n, placed = left.count(), None
    for level in range(LEVELS):
        if n == 0:
            break
        found = keep(_solve(left, n, capacity), "bins")
        last = n <= PROBLEM or level == LEVELS - 1
        full = found.groupBy("bin").agg(F.sum("length").alias("fill"))
        full = full.where(F.lit(last) | (F.col("fill") >= capacity * WELL_FILLED)).select("bin")
        own = found.join(full, "bin", "left_semi").select("item", F.lit(level).alias("level"), "bin")
        placed = own if placed is None else placed.unionByName(own)
        if last:
            break
        left = keep(found.join(full, "bin", "left_anti").select("item", "length"), "left")
        n = left.count()
    done = cut.withColumns({"level": F.lit(-1), "bin": F.col("item")}) if placed is None else cut.join(placed, "item", "left").withColumns({"level": F.coalesce("level", F.lit(-1)), "bin": F.coalesce("bin", "item")})
    done = done.withColumn("sequence_id", (F.col("level") + 1).cast("long") * F.lit(1 << 58) + F.col("bin"))
    before = Window.partitionBy("sequence_id").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    return done.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))

"""Packing of token sequences: shortest pack first over the histogram of lengths, patterns joined back to documents by rank.

Every text gets its token ids and an end id, and is cut into pieces of at most ``size`` ids. The pieces are counted by length;
that histogram has at most ``size`` rows at any size of the corpus. Lengths are placed longest first, each into the packs with
the most free space, for all packs of one pattern at a time, so only patterns and their counts are kept. A piece's rank
among those of its length then tells its pack.

Space that is left over is filled too: the emptiest packs are dissolved, their pieces are laid end to end and cut at the edges
of the gaps in the other packs, which is arithmetic on ranks and pattern counts. What remains, less than one sequence, goes
to sequences of powers of two. So no sequence needs padding, and only pieces of dissolved packs are cut.

Hot keys: one length may hold any share of the pieces, as ranks are counted over a global sort (``ranks.ranked``). What the
driver and each task hold are the patterns, bounded by ``size``.

Defined results: a null text is an empty one and has the end id only. Special strings of the tokenizer inside a text become their
ids, as the library does by default. Repeated rows are packed each on its own; null ids are kept. An empty table gives an
empty result. Reruns on equal rows agree up to the order of equal rows. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from array import array
from bisect import insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from klimawerk.llm.ranks import ranked
from klimawerk.llm.storage import written
from klimawerk.llm.tokens import _SIMPLE, Cutter, _cut_by, _vocabulary

SIZE = 4096
END = 2
MEMO = 200_000
CHUNK = 1 << 24
"""Bytes of text that are encoded together; a longer text is taken alone."""


# --- token ids -------------------------------------------------------------------------------------------------------

def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, the rest follow 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Token ids of many texts, each distinct blank-separated word of plain text once."""

    def __init__(self, cutter: Cutter):
        self.cutter = cutter
        self.letters = _byte_letters()
        self.memo: dict[str, bytes] = {}

    def _keep(self, word: str, ids: bytes) -> bytes:
        if len(self.memo) < MEMO:  # frequent words come early
            self.memo[word] = ids
        return ids

    def _of_pre_token(self, pre_token: str) -> bytes:
        letters = pre_token if pre_token.isascii() else pre_token.encode().decode("latin-1").translate(self.letters)
        return self._keep(pre_token, array("I", [t.id for t in self.cutter.tokenizer.model.tokenize(letters)]).tobytes())

    def of_words(self, found: list[str]) -> list[bytes]:
        """The ids of each blank-separated word; a pre-token is the word that cuts into itself."""
        known = self.memo.get
        out = [known(w) for w in found]
        for i, ids in enumerate(out):
            if ids is None:
                word = found[i]
                if word.isalpha():
                    out[i] = self._of_pre_token(word)
                else:
                    parts = self.cutter.pattern.findall(word)
                    out[i] = self._keep(word, b"".join([known(p) or self._of_pre_token(p) for p in parts]))
        return out

    def _plain(self, text: str) -> bool:
        special = self.cutter.special
        return self.cutter.pattern is not None and _SIMPLE.fullmatch(text) is not None and not (special and special.search(text))

    def __call__(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by ``end``, and where each text begins and ends in them."""
        plain = [self._plain(t) for t in texts]
        lists = pc.utf8_split_whitespace(pc.utf8_lower(pa.array([t if p else "" for t, p in zip(texts, plain)], pa.large_string())))
        found = lists.flatten().dictionary_encode()
        of_word = self.of_words(found.dictionary.to_pylist())
        # Texts that are not plain, and the end id, are further words.
        of_word += [
            array("I", self.cutter.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t, p in zip(texts, plain) if not p
        ]
        other = len(found.dictionary) + np.cumsum(~np.array(plain)) - 1
        of_word.append(array("I", [end]).tobytes())
        closing = np.where(plain, len(of_word) - 1, other)
        limits = lists.offsets.to_numpy()
        word = np.insert(found.indices.to_numpy(zero_copy_only=False).astype(np.int64), limits[1:] - limits[0], closing)
        closed = limits[1:] - limits[0] + np.arange(len(texts))
        late = np.flatnonzero(~np.array(plain))
        word = np.insert(word, closed[late] + 1, len(of_word) - 1)
        closed = closed + np.cumsum(~np.array(plain))

        sizes = np.fromiter(map(len, of_word), dtype=np.int64, count=len(of_word)) // 4
        flat = np.frombuffer(b"".join(of_word), dtype=np.uint32)
        start = np.cumsum(sizes) - sizes
        count = sizes[word]
        total = np.cumsum(count)
        ids = flat[np.arange(total[-1]) + np.repeat(start[word] - (total - count), count)]
        return ids, np.concatenate([[0], total[closed]])


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END) -> DataFrame:
    """(piece, doc_id, start, length, doc_tokens, ids) of every text's pieces, written; ``ids`` are little-endian 32-bit numbers."""
    cut_by = _cut_by(_vocabulary(vocabulary))
    fields = ["doc_id", "start", "length", "doc_tokens", "ids"]

    def encoded(encoder: Encoder, doc_ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        ids, edges = encoder(texts, end)
        n = np.diff(edges)
        parts = -(-n // size)
        doc = np.repeat(np.arange(len(texts)), parts)
        start = size * (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts))
        length = np.minimum(n[doc] - start, size)
        places = np.append(edges[doc] + start, len(ids)).astype(np.int32) * 4
        data = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(places), pa.py_buffer(ids.astype("<u4"))])
        return pa.RecordBatch.from_arrays([doc_ids.take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(n[doc]), data], fields)

    def encode(batches) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(cut_by())
        for batch in batches:
            bytes_ = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
            begin = 0
            while begin < batch.num_rows:
                before = int(bytes_[begin - 1]) if begin else 0
                stop = max(int(np.searchsorted(bytes_, before + CHUNK, "right")), begin + 1)
                yield encoded(encoder, batch.column(0).slice(begin, stop - begin), batch.column(1).slice(begin, stop - begin).to_pylist())
                begin = stop

    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    cut = source.mapInArrow(encode, "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary")
    return written(cut.select(F.monotonically_increasing_id().alias("piece"), *fields), "pieces", "zstd")


# --- patterns --------------------------------------------------------------------------------------------------------

class Pattern(NamedTuple):
    """``count`` packs that hold the same lengths, each so many times, and their free space."""

    count: int
    held: dict[int, int]
    gap: int


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> list[Pattern]:
    """Packs for ``histogram[length]`` pieces of each length: longest first, each piece into the pack with the most free space."""
    open_: dict[int, list[Pattern]] = {}
    gaps: list[int] = []
    full: list[Pattern] = []

    def keep(count: int, held: dict[int, int], gap: int) -> None:
        if not gap:
            full.append(Pattern(count, held, 0))
        elif gap in open_:
            open_[gap].append(Pattern(count, held, gap))
        else:
            open_[gap] = [Pattern(count, held, gap)]
            insort(gaps, gap)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if gaps and gaps[-1] >= length:
                gap = gaps[-1]
                count, held, _ = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap], gaps[-1]
                below = gaps[-1] if gaps else 0
                # As many at a time as leave each pack at the space of the next emptiest ones.
                times = min(max(1, -(-(gap - below) // length)), gap // length, max(1, left // count))
                filled = min(count, left)
                if filled < count:
                    keep(count - filled, dict(held), gap)
                held[length] = held.get(length, 0) + times
                keep(filled, held, gap - times * length)
                left -= filled * times
            else:
                times = min(size // length, left)
                keep(left // times, {length: times}, size - times * length)
                left -= left // times * times
    return full + [p for gap in gaps for p in open_[gap]]


class Layout(NamedTuple):
    """Where a piece goes by its length and rank, as sorted arrays; and the line of gaps that takes dissolved packs."""

    key: np.ndarray  # length and first rank of a run of pieces
    rank: np.ndarray  # that first rank
    times: np.ndarray  # pieces of this length in each pack
    offset: np.ndarray  # place of the first of them in its pack
    base: np.ndarray  # first sequence of kept packs; place on the line of dissolved ones
    used: np.ndarray  # 0 for kept packs, else ids in a pack
    line: np.ndarray  # places where equal gaps begin
    gap: np.ndarray  # their size
    sequence: np.ndarray  # sequence of the first of them
    inside: np.ndarray  # where the gap begins in its sequence


_RANKS = 46


def layout(patterns: list[Pattern], size: int = SIZE) -> Layout:
    """Kept and dissolved packs: the emptiest are dissolved, as few as fill the gaps of all others."""
    emptiest = sorted(patterns, key=lambda p: -p.gap)
    gaps = sum(p.count * p.gap for p in patterns)
    laid = 0
    dissolved: list[Pattern] = []
    kept: list[Pattern] = []
    for p in emptiest:
        n = min(p.count, max(0, -(-(gaps - laid) // size)))
        if n:
            dissolved.append(p._replace(count=n))
            laid += n * (size - p.gap)
            gaps -= n * p.gap
        if n < p.count:
            kept.append(p._replace(count=p.count - n))

    runs, spaces = [], []
    ranks: dict[int, int] = {}

    def lay(p: Pattern, base: int, used: int) -> None:
        offset = 0
        for length in sorted(p.held, reverse=True):
            rank = ranks.get(length, 0)
            runs.append((length << _RANKS | rank, rank, p.held[length], offset, base, used))
            ranks[length] = rank + p.count * p.held[length]
            offset += length * p.held[length]

    sequence = place = 0
    for p in kept:
        lay(p, sequence, 0)
        if p.gap:
            spaces.append((place, p.gap, sequence, size - p.gap))
            place += p.count * p.gap
        sequence += p.count
    for power in range(size.bit_length() - 1, -1, -1):
        if laid - place >= 1 << power:
            spaces.append((place, 1 << power, sequence, 0))
            place += 1 << power
            sequence += 1
    base = 0
    for p in dissolved:
        lay(p, base, size - p.gap)
        base += p.count * (size - p.gap)
    columns = [np.array(sorted(runs), dtype=np.int64).reshape(-1, 6), np.array(spaces, dtype=np.int64).reshape(-1, 4)]
    return Layout(*columns[0].T.copy(), *columns[1].T.copy())


def placed(where: Layout, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """(number of the piece, first id, ids, sequence, offset) of each part of the given pieces."""
    run = np.searchsorted(where.key, length << _RANKS | rank, "right") - 1
    pack, nth = np.divmod(rank - where.rank[run], where.times[run])
    offset = where.offset[run] + nth * length
    stays = where.used[run] == 0
    whole = np.flatnonzero(stays)
    parts = [[whole, np.zeros_like(whole), length[whole], (where.base[run] + pack)[whole], offset[whole]]]
    cut = []
    for i in np.flatnonzero(~stays).tolist():
        at = int(where.base[run[i]] + pack[i] * where.used[run[i]] + offset[i])
        done, ids = 0, int(length[i])
        while done < ids:
            space = int(np.searchsorted(where.line, at + done, "right")) - 1
            gap = int(where.gap[space])
            nth_gap, into = divmod(at + done - int(where.line[space]), gap)
            take = min(gap - into, ids - done)
            cut.append((i, done, take, int(where.sequence[space]) + nth_gap, int(where.inside[space]) + into))
            done += take
    parts.append(list(np.array(cut, dtype=np.int64).reshape(-1, 5).T))
    return tuple(np.concatenate(column) for column in zip(*parts))


# --- all of it -------------------------------------------------------------------------------------------------------

def packed(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END
) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset of every piece."""
    if size < 1 or size & (size - 1):
        raise ValueError("the size of a sequence must be a power of two")
    cut = pieces(docs, vocabulary, id_col, text_col, size, end)
    # At most ``size`` rows reach the driver.
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = layout(shortest_pack_first(histogram, size), size)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(where))
    names = ["piece", "first", "take", "sequence_id", "offset"]

    def place(batches) -> Iterator[pa.RecordBatch]:
        found = Layout(*shared.value)
        for batch in batches:
            piece, length, rank = (batch.column(c).to_numpy() for c in range(3))
            i, *rest = placed(found, length, rank)
            yield pa.RecordBatch.from_arrays([pa.array(piece[i]), *map(pa.array, rest)], names)

    numbered = ranked(cut.select("length", "doc_id", "start", "piece"), "length", ["doc_id", "start", "piece"], "ranked-pieces")
    parts = numbered.select("piece", "length", "rank").mapInArrow(place, ", ".join(f"{n} bigint" for n in names))
    return cut.join(parts, "piece").select(
        "doc_id", (F.col("start") + F.col("first")).alias("start"), F.col("take").alias("length"),
        F.expr("substring(ids, CAST(4 * first + 1 AS INT), CAST(4 * take AS INT))").alias("ids"), "doc_tokens", "sequence_id", "offset",
    )

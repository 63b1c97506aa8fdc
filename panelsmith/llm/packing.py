"""Best-fit packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import RecentValues, materialise

#: Signs that tokenizers cut from the letters before them; probed before that is relied on.
STOPS = ".,;:!?"
LAST_LETTER = 0x17F
#: Text worked on at once inside a task.
SLICE_BYTES = 1 << 21


def small_letters(word: str) -> bool:
    """Whether a word consists of small letters of the Latin blocks up to LAST_LETTER, none of which Unicode composes further."""
    return word.isalpha() and word.islower() and (word.isascii() or ord(max(word)) <= LAST_LETTER)


#: Byte-level vocabularies write a byte as a visible letter: printable ones as themselves, the rest in order from U+0100.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LETTERS = dict(zip(_SHOWN, map(chr, _SHOWN), strict=True)) | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))} | {0x20: " "}


def in_byte_letters(text: str) -> str:
    return text.encode("utf-8").decode("latin-1").translate(_BYTE_LETTERS)


class WordTokenizer:
    """Ids by the tokenizers library, worked out once for words met again.

    For tokenizers that drop white space and never join across it, ids of a text
    are those of its words one after the other; ``__init__`` tests this.  Words
    are cut at ASCII white space and told apart by Arrow, so that only the distinct
    words of a batch become Python objects.  New ones are encoded many at a time, with a
    mark between them whose id tells where a word ends.
    """

    MARK, AT_ONCE = "\x01", 128

    def __init__(self, path: str, most_words: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # For words of small Latin letters alone nothing is to be normalised or split: the same model behind a cut at blanks.
        plain = json.loads(self.library.to_str()) | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}
        self.plain = Tokenizer.from_str(json.dumps(plain))
        self.mark, self.plain_mark = self._ids(self.library, [self.MARK])[0], self._ids(self.plain, ["!"])[0]
        small = [c for c in map(chr, range(LAST_LETTER + 1)) if small_letters(c)]
        letters = [" ".join(a + b for b in "aeiounthzßéüñ") + " ".join(small) for a in small]
        self.by_letters = len(self.plain_mark) == 1 and [x.tolist() for x in self._ids(self.plain, [in_byte_letters(x) for x in letters])] == [x.tolist() for x in self._ids(self.library, letters)]
        self.stops = {c: x.tobytes() for c, x in zip(STOPS, self._ids(self.library, list(STOPS)), strict=True)}
        ended = self._ids(self.library, [f"ab{c} thing{c}" for c in STOPS])
        apart = self._ids(self.library, [f"ab {c} thing {c}" for c in STOPS])
        self.by_letters = self.by_letters and [x.tolist() for x in ended] == [x.tolist() for x in apart]
        self.recent = RecentValues(self._work_out, most_words)
        probe = pa.array(["Ab,  c\td.\n<|x é l'a's  9 1.2, ...\x0b#!. z", " A B ", "", "É Ab"])
        self.by_words = len(self.mark) == 1
        ids, ends = self.encode(probe)
        self.by_words = self.by_words and [x.tolist() for x in np.split(ids, ends[:-1])] == [x.tolist() for x in self._ids(self.library, probe.to_pylist())]

    @staticmethod
    def _ids(tokenizer, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _work_out(self, words: list[str]) -> list[bytes]:
        """Ids of each word; letters with one stop behind them are two words to the tokenizer, as it cuts letters from other signs."""
        if not self.by_letters:
            return self._marked(self.library, self.MARK, self.mark, words)
        heads = [w[:-1] if w[-1:] in STOPS and len(w) > 1 else w for w in words]
        letters = list({h for h in heads if small_letters(h)})
        known = dict(zip(letters, self._marked(self.plain, "!", self.plain_mark, [w if w.isascii() else in_byte_letters(w) for w in letters]), strict=True))
        rest = [w for w, h in zip(words, heads, strict=True) if h not in known]
        known.update(zip(rest, self._marked(self.library, self.MARK, self.mark, rest), strict=True))
        return [known[w] if h is w or h not in known else known[h] + self.stops[w[-1]] for w, h in zip(words, heads, strict=True)]

    def _marked(self, tokenizer, mark: str, mark_id: np.ndarray, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        groups = [words[s : s + self.AT_ONCE] for s in range(0, len(words), self.AT_ONCE)]
        for group, ids in zip(groups, self._ids(tokenizer, [f" {mark} ".join(g) for g in groups]), strict=True):
            ends = np.flatnonzero(ids == mark_id[0])
            if len(ends) == len(group) - 1:
                data, cuts = ids.tobytes(), [-4, *(4 * ends).tolist(), 4 * len(ids)]
                out += [data[a + 4 : b] for a, b in pairwise(cuts)]
            else:  # a word holds the mark itself
                out += [x.tobytes() for x in self._ids(tokenizer, group)]
        return out

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The unsigned 32-bit ids of all texts in a row, and where each text's ids end."""
        if not self.by_words:
            ids = self._ids(self.library, texts.to_pylist())
            return np.concatenate([np.empty(0, dtype="<u4"), *ids]), np.cumsum([len(x) for x in ids], dtype=np.int64)
        # A special token's name keeps its case; other case is dropped by the tokenizer too.
        lowered = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        cut = pc.ascii_split_whitespace(lowered)
        words = cut.flatten().dictionary_encode()
        found, at = self.recent.values(words.dictionary.to_numpy(zero_copy_only=False).tolist()), words.indices.to_numpy()
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        flat, starts = np.frombuffer(b"".join(found), dtype="<u4"), np.cumsum(sizes) - sizes
        lengths = sizes[at]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        ids = flat[np.repeat(starts[at] - upto[:-1], lengths) + np.arange(upto[-1])]
        offsets = cut.offsets.to_numpy()
        return ids, upto[offsets[1:] - offsets[0]]


def text_slices(batch: pa.RecordBatch) -> Iterator[tuple[list, pa.StringArray]]:
    """(ids, texts) of consecutive rows with at most SLICE_BYTES of text, or one row with more."""
    ids, texts = batch.column(0), pc.fill_null(batch.column(1), "")
    sizes = pc.binary_length(texts).to_numpy()
    at = 0
    while at < len(sizes):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:], dtype=np.int64), SLICE_BYTES, side="right")))
        yield ids.slice(at, n).to_pylist(), texts.slice(at, n)
        at += n


def tokenised_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str, text_col: str, with_ids: bool, most_words: int
) -> DataFrame:
    """Pieces of at most ``capacity`` tokens with their task and their number within task and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(tokenizer_path, most_words)
        end = np.array([end_id], dtype="<u4").tobytes()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            for docs_here, texts in text_slices(batch):
                flat, ends = tokenizer.encode(texts)
                data, rows, start = flat.tobytes(), [], 0
                for doc, stop in zip(docs_here, (4 * ends).tolist(), strict=True):
                    own, start = data[start:stop] + end, stop
                    for k, at in enumerate(range(0, len(own), 4 * capacity)):
                        piece = own[at : at + 4 * capacity]
                        n = len(piece) // 4
                        rows.append((doc, k, at // 4, n, zlib.crc32(piece), part, int(seen[n]), piece if with_ids else None))
                        seen[n] += 1
                columns = list(zip(*rows, strict=True))
                yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    arrow = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("number", pa.int64()), ("ids", pa.binary())])
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = source.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long, part int, number long, ids binary")
    return out if with_ids else out.drop("ids")


class RoomTree:
    """A segment tree over remaining capacities: which of them some open bin has."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.some = [False] * (2 * self.leaves)

    def set(self, room: int, some: bool) -> None:
        i = room + self.leaves
        while i and self.some[i] != some:
            self.some[i] = some
            i >>= 1
            some = i > 0 and (self.some[2 * i] or self.some[2 * i + 1])

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity of at least ``least``."""
        i = least + self.leaves
        if self.some[i]:
            return least
        while i > 1:
            if not i & 1 and self.some[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.some[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit_runs(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing over a histogram of lengths; rows (length, first number, bins' first, pieces a bin, offset).

    Pieces of a length are numbered from 0.  As in one-by-one best fit, a piece
    goes to the open bin with the least room that holds it, and its equals follow
    into the same bin while they fit; bins with equal room are handled as one
    range.  A range at least halves its room with each use, so the rows number at most
    a few times ``capacity`` * log(``capacity``), however many pieces there are.
    """
    tree, rooms, runs, bins = RoomTree(capacity), [[] for _ in range(capacity + 1)], [], 0

    def put(room: int, first: int, n: int) -> None:
        if n:
            rooms[room].append((first, n))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        done, total = 0, counts[length]
        while done < total:
            room = tree.tightest(length)
            if room is None:
                per_bin = capacity // length
                room, first, n = capacity, bins, -(-(total - done) // per_bin)
                bins += n
            else:
                first, n = rooms[room].pop()
                if not rooms[room]:
                    tree.set(room, False)
                per_bin = room // length
            full = min(n, (total - done) // per_bin)
            rest = min(total - done - full * per_bin, per_bin) if full < n else 0
            runs.append((length, done, first, per_bin, capacity - room))
            done += full * per_bin + rest
            put(room - per_bin * length, first, full)
            if rest:
                put(room - rest * length, first + full, 1)
            put(room, first + full + (rest > 0), n - full - (rest > 0))
    return np.array(runs, dtype=np.int64).reshape(-1, 5)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
    most_words: int = 800_000,
) -> DataFrame:
    """Pieces with their sequence and offset: (id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``[, ``ids``]).

    A document's tokens are its ids and ``end_id``; only documents longer than
    ``capacity`` are cut.  All pieces of the table are packed together by
    best-fit decreasing: the driver packs the histogram of lengths (at most
    ``capacity`` numbers), executors number the pieces of each length and look
    their places up.  ``with_ids`` adds the ids themselves (little-endian unsigned
    32-bit).  Null and empty texts are the end id alone; repeated rows are packed
    as often as they occur; an empty table gives no rows; other columns are not
    carried.  ``most_words`` bounds the memory of a worker only.
    """
    pieces = materialise(tokenised_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, with_ids, most_words), "pieces")
    counts = materialise(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    runs = best_fit_runs({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = pieces.join(firsts.hint("merge"), ["length", "part"]).withColumn("number", F.col("number") + F.col("before")).drop("part", "before")
    order = np.lexsort((runs[:, 1], runs[:, 0])) if len(runs) else np.empty(0, np.int64)
    runs = runs[order]
    keys = runs[:, 0] * (1 << 50) + runs[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            _, done, first, per_bin, offset = runs[np.searchsorted(keys, length * (1 << 50) + number, side="right") - 1].T
            placed = {"sequence_id": first + (number - done) // per_bin, "offset": offset + (number - done) % per_bin * length}
            kept = {c: batch.column(c) for c in batch.schema.names if c != "number"}
            yield pa.record_batch({**kept, **{k: pa.array(v) for k, v in placed.items()}})

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema if f.name != "number"]
    out = numbered.mapInArrow(place, ", ".join([*fields, "sequence_id long", "offset long"]))
    shown = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    return out.select(*shown).withColumnRenamed("id", id_col)

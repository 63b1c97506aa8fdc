"""Encoding and decoding with merge-type sentencepiece vocabularies: an agenda of adjacent pairs, ordered by score."""

from __future__ import annotations

import re
from array import array
from functools import partial
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RecentValues, map_columns

SPACE = "▁"
SHORT, NONE = 40, float("inf")
_LETTERS = "a-zA-ZÀ-ÖØ-öø-ɏ"


class MergeVocabulary:
    """Pieces, scores and byte pieces of a merge-type model.

    The model file is read through the sentencepiece library; encoding and
    decoding are done here.  Models with another normalisation than none, or
    without the leading blank, are refused.
    """

    def __init__(self, model_path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.ranks = {p: -sp.get_score(i) for p, i in self.ids.items()}  # low: merged early
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.of_byte = {i: b for b, i in self.bytes.items()}
        self.text_of = {i: p.replace(SPACE, " ") for p, i in self.ids.items()}
        if sp.encode("ﬁ a  ", out_type=str)[0] != SPACE or sp.decode(sp.encode(" ﬁ  a ")) != " ﬁ  a " or len(self.bytes) != 256:
            raise ValueError("only models with a leading blank, byte pieces and without normalisation are supported")
        self.split = re.compile(self._barriers())

    def _barriers(self) -> str:
        """A pattern that cuts a text only where no piece reaches across, so that the parts merge independently."""
        letter = re.compile(f"[{_LETTERS}]")
        apart = True
        for p in self.ids:
            body = p.lstrip(SPACE)
            if SPACE in body:
                return r"(?s).+"
            apart &= len({letter.match(c) is None for c in body}) < 2
        if apart:
            return f"{SPACE}*[{_LETTERS}]+|{SPACE}*[^{SPACE}{_LETTERS}]+|{SPACE}+"
        return f"{SPACE}*[^{SPACE}]+|{SPACE}+"

    def merge(self, part: str) -> list[str]:
        """Symbols of ``part`` after all merges: the agenda gives the pair of the highest score, leftmost among equals."""
        return self._merge_short(list(part)) if len(part) <= SHORT else self._merge_long(list(part))

    def _merge_short(self, symbols: list[str]) -> list[str]:
        """The agenda as an array beside the symbols: cheapest while a part has few pairs."""
        get = self.ranks.get
        agenda = [get(a + b, NONE) for a, b in pairwise(symbols)]
        while agenda and (best := min(agenda)) != NONE:
            i = agenda.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del agenda[i]
            if i < len(agenda):
                agenda[i] = get(symbols[i] + symbols[i + 1], NONE)
            if i:
                agenda[i - 1] = get(symbols[i - 1] + symbols[i], NONE)
        return symbols

    def _merge_long(self, symbols: list[str]) -> list[str]:
        """The agenda as a heap over linked symbols: n log n however long the part."""
        get = self.ranks.get
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(r, i, pair) for i in range(n - 1) if (r := get(pair := symbols[i] + symbols[i + 1])) is not None]
        heapify(agenda)
        while agenda:
            _, i, pair = heappop(agenda)
            left, j = symbols[i], after[i]
            if left is None or j >= n or left + symbols[j] != pair:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = pair, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                longer = pair + symbols[k]
                if (r := get(longer)) is not None:
                    heappush(agenda, (r, i, longer))
            h = before[i]
            if h >= 0:
                longer = symbols[h] + pair
                if (r := get(longer)) is not None:
                    heappush(agenda, (r, h, longer))
        return [x for x in symbols if x is not None]

    def encode_part(self, part: str) -> list[int]:
        """Ids of one part; symbols outside the vocabulary fall back to their bytes."""
        ids = []
        for symbol in self.merge(part):
            if (i := self.ids.get(symbol)) is not None:
                ids.append(i)
            else:
                ids += [self.bytes[b] for b in symbol.encode("utf-8")]
        return ids

    def parts(self, text: str) -> list[str]:
        """The parts of a whole text, the blank put before it included."""
        return self.split.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for p in self.parts(text) for i in self.encode_part(p)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: byte pieces as UTF-8 (faulty bytes as U+FFFD each), the leading blank dropped."""
        out, run = [], bytearray()
        for i in ids:
            if (b := self.of_byte.get(i)) is not None:
                run.append(b)
                continue
            if run:
                out.append(_utf8(run))
                run = bytearray()
            out.append(self.text_of.get(i, ""))
        if run:
            out.append(_utf8(run))
        text = "".join(out)
        return text if ids and ids[0] in self.of_byte else text.removeprefix(" ")


def _utf8(run: bytearray) -> str:
    try:
        return run.decode("utf-8")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):  # the longest well-formed sequence at each place, else one mark per byte
            for n in (1, 2, 3, 4):
                try:
                    out.append(bytes(run[at : at + n]).decode("utf-8"))
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


def work_out(v: MergeVocabulary, check: bool, parts: list[str]) -> list[tuple[bytes, str]]:
    """(ids as bytes, text) of parts; with ``check`` their ids are held against the library, all in one call.

    The library puts a blank before each text, so a part with a leading blank is
    given without it, any other behind a line break.
    """
    every = [v.encode_part(p) for p in parts]
    if check and parts:
        lead = v.library.encode("\n")
        given = [p[1:].replace(SPACE, " ") if p[0] == SPACE else "\n" + p for p in parts]
        for p, ids, theirs in zip(parts, every, v.library.encode(given, num_threads=1), strict=True):
            ours = (ids if p != SPACE else []) if p[0] == SPACE else lead + ids
            if ours != theirs:
                raise ValueError(f"ids of {p!r} differ from the library's: {ours} and {theirs}")
    return [(array("i", ids).tobytes(), v.decode([v.ids[SPACE], *ids])) for ids in every]


SCHEMA = "ids array<int>, decoded string"


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", most_parts: int = 500_000, check: bool = True) -> DataFrame:
    """Ids of every whole text and the text decoded from them, one row per input row: (id, ``ids``, ``decoded``).

    A text is cut where no piece of the vocabulary can reach across, each
    distinct part of a batch is merged once by the agenda, and with ``check``
    every newly merged part is held against the sentencepiece library, batch by
    batch; a difference ends the job.  ``most_parts`` bounds the memory of a
    worker, not what is encoded.  Null texts count as empty; an empty text has no
    ids; repeated rows give repeated rows; other columns are not carried.
    """

    def make():
        v = MergeVocabulary(model_path)
        recent = RecentValues(partial(work_out, v, check), most_parts)

        def fn(ids, texts):
            texts = [t or "" for t in texts]
            parts = [v.parts(t) for t in texts]
            known = recent.hold(parts)
            rows, decoded = [], []
            for p in parts:
                found = [known[x] for x in p]
                rows.append(b"".join([x for x, _ in found]))
                decoded.append("".join([t for _, t in found]).removeprefix(" "))
            ends = np.cumsum([0, *map(len, rows)]) // 4
            values = pa.array(np.frombuffer(b"".join(rows), dtype=np.int32))
            return [ids, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values), decoded]

        return fn

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    arrow = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
    return map_columns(source, make, f"id long, {SCHEMA}", arrow).withColumnRenamed("id", id_col)

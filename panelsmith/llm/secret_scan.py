"""Secret scan: fixed patterns, and random strings told by how few characters a token of a vocabulary covers."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns

#: The patterns of the contract; letters of the first stand for either case.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
BASE_KINDS = ("assign", "access", "hex")

_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{20,}")
#: Hexadecimal digits of common digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512).
DIGEST_DIGITS = frozenset((32, 40, 56, 64, 96, 128))
_DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Names joined by marks or humps: every part a word with a vowel or a short number.
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_VOWEL = re.compile(r"[aeiouyAEIOUY]")
_MARKS = "/=._-+"
#: Letters from which a part is a word only if the vocabulary knows it; by how much a window's
#: score falls behind its best before the window ends there, some three long words.
LONG_WORD, FALL = 12, 20.0
_KNOWN_FORM = re.compile(rf"(?<![A-Za-z0-9])(?:{_UUID.pattern}|[0-9a-f]{{32,}}|[0-9A-F]{{32,}})(?![A-Za-z0-9])")


def is_identifier(s: str, is_word=lambda w: True) -> bool:
    """Paths, host names, snake, kebab and camel case names, numbers, dates and UUIDs; ``is_word`` judges parts of LONG_WORD letters or more."""
    if _UUID.fullmatch(s) or len(re.findall(r"[A-Za-z]", s)) < 4:
        return True
    runs = re.split(r"[+/_=.-]+", s)
    parts = [p for r in runs for p in _PART.findall(r)]
    words = [p for p in parts if not p.isdigit()]
    humps = len(parts) - len([r for r in runs if r])
    if not all(is_word(w) for w in words if len(w) >= LONG_WORD):
        return False
    return all(_VOWEL.search(w) or len(w) <= 3 for w in words) and all(len(p) <= 8 for p in parts if p.isdigit()) and sum(map(len, words)) >= 3 * len(parts) and humps <= max(3, len(s) // 8)


def is_digest(s: str) -> bool:
    return len(s) in DIGEST_DIGITS and _DIGEST.fullmatch(s) is not None


def load_encoding(ranks_path: str, pattern: str):
    """A tiktoken encoding from a file of base64 tokens and ranks."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("secret-scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the contract's patterns, each kind leftmost and without overlaps, failing matches dropped."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], x[2]))


def low_windows(lengths: list[int], most: float) -> list[tuple[int, int]]:
    """(start, end) of runs of tokens with under ``most`` characters a token, each as far as its lead over ``most`` grows."""
    found, i = [], 0
    while i < len(lengths):
        if lengths[i] >= most:
            i += 1
            continue
        total = best = 0.0
        end = i + 1
        for j in range(i, len(lengths)):
            total += most - lengths[j]
            if total > best:
                best, end = total, j + 1
            elif total <= 0 or total < best - FALL:
                break
        found.append((i, end))
        i = end
    return found


def _pieces(text: str, a: int, b: int, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What of a run is left beside spans taken, UUIDs and digests, without marks at its ends."""
    cuts = [(max(a, x), min(b, y)) for x, y, _ in taken if x < b and a < y]
    cuts += [m.span() for m in _KNOWN_FORM.finditer(text, a, b) if is_digest(m[0]) or _UUID.fullmatch(m[0])]
    left = []
    for x, y in [*sorted(cuts), (b, b)]:
        if x > a:
            s = text[a:x]
            left.append((a + len(s) - len(s.lstrip(_MARKS)), a + len(s.rstrip(".-="))))
        a = max(a, y)
    return [(x, y) for x, y in left if y - x >= 20]


def random_spans(text: str, encoding, most: float, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Parts of candidate runs with under ``most`` characters a token that are no digest or identifier and overlap no span taken.

    A part is a whole run; or, where the words around it raise the run's figure, a segment between
    two of ``/ = . _ - +``, or a window of tokens, widened to the ends of the segments it begins and ends in.
    """

    def low(s):
        return len(s) / len(encoding.encode_ordinary(s)) < most

    def is_random(s):
        return len(s) >= 20 and not is_digest(s) and not is_identifier(s, lambda w: not low(w))

    found = []
    for m in _CANDIDATE.finditer(text):
        whole = m[0].rstrip(".-=")
        clear = not any(x < m.start() + len(whole) and m.start() < y for x, y, _ in taken)
        if clear and len(whole) >= 20 and not is_digest(whole) and low(whole) and is_random(whole):
            found.append((m.start(), m.start() + len(whole)))
            continue
        parts = []
        for a, b in _pieces(text, m.start(), m.end(), taken):
            segments = [(a + x.start(), a + x.end()) for x in re.finditer(r"[A-Za-z0-9]+", text[a:b])]
            parts += [(x, y) for x, y in segments if y - x >= 20 and low(text[x:y]) and is_random(text[x:y])]
            if len(segments) == 1 and (segment := text[a:b]).isalpha() and (segment.islower() or segment.istitle()):
                continue
            ends = [a]
            for token in encoding.decode_tokens_bytes(encoding.encode_ordinary(text[a:b])):
                ends.append(ends[-1] + len(token))
            for i, j in low_windows([y - x for x, y in zip(ends, ends[1:], strict=False)], most):
                s = text[ends[i] : ends[j]]
                x, y = ends[i] + len(s) - len(s.lstrip(_MARKS)), ends[i] + len(s.rstrip(".-="))
                if is_random(text[x:y]):
                    while x > a and text[x - 1] not in _MARKS:
                        x -= 1
                    while y < b and text[y] not in _MARKS:
                        y += 1
                    parts.append((x, y))
        end = -1
        for a, b in sorted(parts):
            if a < end:
                found[-1] = (found[-1][0], max(end, b))
            else:
                found.append((a, b))
            end = found[-1][1]
    return found


SCHEMA = "spans array<struct<kind string, start long, end long>>"
ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_secrets(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chars_per_token: float = 2.0) -> DataFrame:
    """Spans of secrets in every whole text, one row per input row: (id, ``spans``).

    Spans are in code points, end exclusive, by start and then kind; kinds
    ``assign``, ``access``, ``hex`` are the fixed patterns, ``random`` are runs of
    20 or more code characters on which the vocabulary spends a token for fewer
    than ``chars_per_token`` characters, or segments and windows of as many characters within
    longer runs (``random_spans``), unless they are digests, identifiers or
    overlap a fixed pattern.  Null and empty texts have no span; repeated rows
    give repeated rows; other columns are not carried.
    """

    def make():
        encoding = load_encoding(ranks_path, pattern)

        def one(text):
            if not text:
                return []
            spans = base_spans(text)
            out = [(s, k, BASE_KINDS[k], e) for s, e, k in spans] + [(s, 9, "random", e) for s, e in random_spans(text, encoding, chars_per_token, spans)]
            return [{"kind": kind, "start": s, "end": e} for s, _, kind, e in sorted(out)]

        return lambda ids, texts: [ids, [one(t) for t in texts]]

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = map_columns(source, make, f"id long, {SCHEMA}", pa.schema([("id", pa.int64()), ("spans", ARROW)]))
    return out.withColumnRenamed("id", id_col)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with each merged span replaced by a mark naming its first kind."""
    out, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", size_col: str | None = None, chars_per_token: float = 2.0) -> DataFrame:
    """``docs`` with the secrets of ``text_col`` masked; all columns and rows stay, null texts stay null.

    ``size_col`` names a column to hold the length of the masked text in code
    points; it keeps its type, and its value where the text is null.
    """

    @F.pandas_udf("string")
    def masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = load_encoding(ranks_path, pattern)
        for texts in batches:
            yield texts.map(lambda t: _masked(t, encoding, chars_per_token), na_action="ignore")

    out = docs.withColumn(text_col, masked(F.col(text_col)))
    if size_col is None:
        return out
    return out.withColumn(size_col, F.coalesce(F.char_length(text_col).cast(docs.schema[size_col].dataType), F.col(size_col)))


def _masked(text: str, encoding, most: float) -> str:
    spans = base_spans(text)
    more = random_spans(text, encoding, most, spans)
    if not spans and not more:
        return text
    return redact(text, sorted([(s, e, BASE_KINDS[k]) for s, e, k in spans] + [(s, e, "random") for s, e in more]))

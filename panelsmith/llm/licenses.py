"""License scan: Aho-Corasick over the words of a text, and a shunting-yard parser for licence expressions."""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns

#: The notice phrases of the contract and their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Notice phrases the method adds, and their labels.
MORE_PHRASES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "common development and distribution license": "cddl",
    "server side public license": "sspl",
    "business source license": "busl",
    "elastic license": "elastic",
    "licensed under the apache license": "apache",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd 2 clause license": "bsd-2-clause",
    "bsd 3 clause license": "bsd-3-clause",
    "new bsd license": "bsd-3-clause",
    "simplified bsd license": "bsd-2-clause",
    "isc license": "isc",
    "zlib license": "zlib",
    "boost software license": "bsl",
    "artistic license": "artistic",
    "academic free license": "afl",
    "open software license": "osl",
    "microsoft public license": "ms-pl",
    "python software foundation license": "psf",
    "sil open font license": "ofl",
    "open database license": "odbl",
    "universal permissive license": "upl",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "released into the public domain": "public-domain",
    "free and unencumbered software": "unlicense",
    "all rights reserved": "all-rights-reserved",
}

TAG_WORDS = "spdx license identifier"
_TAG = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)", re.IGNORECASE | re.ASCII)
_TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9.+:-]+)", re.ASCII)
_BINDING = {"or": 1, "and": 2, "with": 3}

#: Licence identifiers, lower-cased; families with versions are spelt out below.
_SINGLE = """
    0bsd afl-1.1 afl-1.2 afl-2.0 afl-2.1 afl-3.0 apache-1.0 apache-1.1 apache-2.0 artistic-1.0 artistic-1.0-perl artistic-2.0 beerware blueoak-1.0.0 bsd-1-clause
    bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-4-clause bsl-1.0 busl-1.1 cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.1 cpl-1.0 curl ecl-2.0 elastic-2.0 epl-1.0
    epl-2.0 eupl-1.0 eupl-1.1 eupl-1.2 hpnd icu ipl-1.0 isc json libpng mit mit-0 mpl-1.0 mpl-1.1 mpl-2.0 mpl-2.0-no-copyleft-exception ms-pl ms-rl mulanpsl-2.0 ncsa odbl-1.0
    odc-by-1.0 ofl-1.0 ofl-1.1 openssl osl-1.0 osl-2.0 osl-2.1 osl-3.0 pddl-1.0 php-3.0 php-3.01 postgresql psf-2.0 python-2.0 ruby sleepycat sspl-1.0 tcl unicode-3.0
    unicode-dfs-2016 unlicense upl-1.0 vim w3c wtfpl x11 zlib zpl-2.1
""".split()
_GNU = {"gpl": ("1.0", "2.0", "3.0"), "lgpl": ("2.0", "2.1", "3.0"), "agpl": ("1.0", "3.0"), "gfdl": ("1.1", "1.2", "1.3")}
_COMMONS = [f"cc-by{nc}{other}-{v}" for nc in ("", "-nc") for other in ("", "-nd", "-sa") for v in ("1.0", "2.0", "2.5", "3.0", "4.0")]
IDENTIFIERS = frozenset([*_SINGLE, *_COMMONS, *(f"{k}-{v}{end}" for k, vs in _GNU.items() for v in vs for end in ("", "-only", "-or-later"))])
#: What may stand behind ``with``.
EXCEPTIONS = frozenset("""
    autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-2.2 bootloader-exception classpath-exception-2.0 ecos-exception-2.0 fltk-exception font-exception-2.0
    gcc-exception-2.0 gcc-exception-3.1 gpl-cc-1.0 libtool-exception linux-syscall-note llvm-exception ocaml-lgpl-linking-exception openjdk-assembly-exception-1.0
    openvpn-openssl-exception qt-gpl-exception-1.0 qt-lgpl-exception-1.1 swift-exception u-boot-exception-2.0 universal-foss-exception-1.0 wxwindows-exception-3.1
""".split())
#: The label of what a tag names and nobody knows.
UNKNOWN = "unknown"

#: Licences whose terms a corpus may take without more; what ``accepted`` is evaluated against.
PERMISSIVE = frozenset("""
    0bsd afl-3.0 apache-1.1 apache-2.0 artistic-2.0 blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsl-1.0 cc-by-3.0 cc-by-4.0 cc0-1.0
    curl ecl-2.0 hpnd icu isc libpng mit mit-0 ms-pl ncsa pddl-1.0 php-3.01 postgresql psf-2.0 python-2.0 unicode-3.0 unicode-dfs-2016 unlicense upl-1.0 vim w3c wtfpl x11 zlib zpl-2.1
""".split())


def known_licence(name: str) -> str:
    """The identifier (a ``+`` behind it means later versions too) or reference of a licence, else UNKNOWN."""
    return name if name.removesuffix("+") in IDENTIFIERS or name.startswith(("licenseref-", "documentref-")) else UNKNOWN


#: To words of the contract: A-Z lower-cased, digits, letters and all bytes from 0x80 kept, the rest blanks.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def parse_expression(text: str) -> list[str]:
    """Reverse Polish form of the longest well-formed licence expression that ``text`` begins with ([]: none).

    ``with`` binds before ``and``, ``and`` before ``or``; operators in either case.
    """
    tokens, at, depth, good, operand_next = [], 0, 0, 0, True
    while m := _TOKEN.match(text, at):
        t, at = m[1].lower(), m.end()
        if (t == "(" or t not in _BINDING and t != ")") != operand_next or t == ")" and not depth:
            break
        tokens.append(t)
        depth += (t == "(") - (t == ")")
        operand_next = t == "(" or t in _BINDING
        if not operand_next and not depth:
            good = len(tokens)
    return _to_rpn(tokens[:good])


def _to_rpn(tokens: list[str]) -> list[str]:
    """Shunting-yard over a well-formed token list."""
    out, stack = [], []
    for t in tokens:
        if t == "(":
            stack.append(t)
        elif t == ")":
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif t in _BINDING:
            while stack and stack[-1] != "(" and _BINDING[stack[-1]] >= _BINDING[t]:
                out.append(stack.pop())
            stack.append(t)
        else:
            out.append(t)
    return out + stack[::-1]


def evaluate_expression(rpn: list[str], accepted: frozenset[str] = PERMISSIVE) -> bool:
    """Whether some choice that the expression allows consists of accepted licences; a known exception adds permissions only, an unknown one may not."""
    stack: list[bool] = []
    for i, t in enumerate(rpn):
        if t == "with":
            stack.pop()
            stack[-1] &= rpn[i - 1] in EXCEPTIONS
        elif t in ("and", "or"):
            b, a = stack.pop(), stack.pop()
            stack.append(a and b if t == "and" else a or b)
        else:
            stack.append(t.removesuffix("+") in accepted)
    return bool(stack) and stack[-1]


def licences_of(rpn: list[str]) -> list[str]:
    """The licences named, an exception written after its licence; UNKNOWN for those that are no identifiers."""
    stack: list[list[str]] = []
    for i, t in enumerate(rpn):
        if t == "with":
            _, inner = stack.pop(), stack.pop()
            exception = rpn[i - 1] if rpn[i - 1] in EXCEPTIONS else UNKNOWN
            stack.append([f"{x} with {exception}" for x in inner])
        elif t in ("and", "or"):
            b, a = stack.pop(), stack.pop()
            stack.append(a + b)
        else:
            stack.append([known_licence(t)])
    return stack[-1] if stack else []


def automaton(phrases: dict[str, str]) -> ahocorasick.Automaton:
    """Phrases framed by blanks, so that only whole words match."""
    found = ahocorasick.Automaton()
    for phrase, label in {**phrases, TAG_WORDS: None}.items():
        found.add_word(f" {phrase} ", (label, phrase, len(phrase) + 1, phrase.count(" ") + 1))
    found.make_automaton()
    return found


def scan_text(text: str | None, machine: ahocorasick.Automaton, accepted: frozenset[str]) -> tuple:
    """(words, places as (label, phrase, first word, words), licences of tags, verdict of the last tag, score)."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()
    line = b" " + b" ".join(words) + b" "
    line = line.decode("latin-1")
    places, tags, verdict, tagged, at, word = [], [], None, False, 0, 0
    for end, (label, phrase, length, n) in machine.iter(line):
        begin = end - length
        if begin >= at:
            word += line.count(" ", at, begin)
            at = begin
            first = word
        else:
            first = word - line.count(" ", begin, at)
        if label is None:
            tagged = True
        else:
            places.append((label, phrase, first, n))
    if tagged:
        for m in _TAG.finditer(text):
            if rpn := parse_expression(m[1]):
                tags += licences_of(rpn)
                verdict = evaluate_expression(rpn, accepted)
    sure = 0.0 if not tags else 0.5 if any(UNKNOWN in t for t in tags) else 1.0
    return len(words), places, tags, verdict, max(sure, 1.0 - 0.5 ** min(len(places), 60))


SCHEMA = "n_words long, places array<struct<label string, phrase string, word long, n_words long>>, tag_licences array<string>, accepted boolean, score double"
ARROW = pa.schema([
    ("n_words", pa.int64()),
    ("places", pa.list_(pa.struct([("label", pa.string()), ("phrase", pa.string()), ("word", pa.int64()), ("n_words", pa.int64())]))),
    ("tag_licences", pa.list_(pa.string())),
    ("accepted", pa.bool_()),
    ("score", pa.float64()),
])


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: dict[str, str] | None = None,
    accepted: frozenset[str] = PERMISSIVE,
) -> DataFrame:
    """Places of licence notices and the licences of identifier tags, one row per input row.

    A-Z are lower-cased; words are runs of digits, letters a-z and non-ASCII
    characters.  ``places`` are all places where a phrase's words stand
    consecutively (overlaps included), by their last word.  A phrase that marks an identifier tag sends the
    raw line after it to the expression parser; ``accepted`` is the verdict on
    the last tag, null without one; a tag's operands must be identifiers, others are labelled UNKNOWN and never accepted.
    ``score``: the larger of 1 - 2^-places and, for tags, 1 (a half if one names an unknown licence).  A null or empty text has no words, no places and score 0;
    repeated rows give repeated rows; other columns are not carried.
    """
    chosen = {**MORE_PHRASES, **BASE_PHRASES} if phrases is None else phrases

    def make():
        machine = automaton(chosen)

        def fn(ids, texts):
            rows = [scan_text(t, machine, accepted) for t in texts]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            named = [[{"label": a, "phrase": b, "word": c, "n_words": d} for a, b, c, d in p] for p in cols[1]]
            return [ids, cols[0], named, *cols[2:]]

        return fn

    kind = docs.schema[id_col].dataType
    id_arrow = pa.string() if kind.typeName() == "string" else pa.int64()
    source = docs.select(F.col(id_col).cast("string" if id_arrow == pa.string() else "long").alias("id"), F.col(text_col).alias("text"))
    out = map_columns(source, make, f"id {'string' if id_arrow == pa.string() else 'long'}, {SCHEMA}", pa.schema([("id", id_arrow), *ARROW]))
    return out.withColumnRenamed("id", id_col)

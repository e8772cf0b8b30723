"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty for what they miss.

Base findings are three patterns, each matched leftmost and without overlap: assignments of long values to names like
password or api_key, access-key ids, and long hex strings. Further candidates are tokens of LEAST characters or more, three of
them letters, in a sensitive context: a word such as secret, key or bearer shortly before or after, or joined to the token
(NAME=value, bearer_value). Such words count only whole, or as a part of a name_with_signs or a nameInCamelCase: not the auth of
author. Tokens of letters in one case alone (or with a capital) are taken from WORDLIKE characters on.

A candidate's novelty is the number of bytes by which it lengthens the zstandard frame of its surroundings (without further
copies of itself), over its length. Capitals throughout count as small letters, and numbers of up to four digits that stand
between signs count nothing: neither tells a NAME_OF_THIS_KIND or a dated path from another. The compressor is primed with a trained dictionary: identifiers and prose of Python's own
library and reference, and words of the corpus (counted over all its distinct texts; the WORDS most frequent that stand in three
of them or more, since a dictionary has a size). Its content makes known names cheap, and its entropy tables
price letters by how usual they are, so that unknown words cost little, too, and random strings nearly all their bytes.
Candidates whose novelty reaches a threshold are reported as kind `novel`. The threshold is fitted: words that the dictionary has
not seen, joined to names and paths, are set against random strings, and the cut with the fewest errors is taken. Base findings
carry their novelty too, and stay whatever it is.

Positions are code points, end exclusive.

Defined cases: null and empty texts have no findings; equal texts and repeated rows have equal findings; where spans start
together, kinds go in the order assign, access, hex, novel; other columns are kept or ignored, never read, and a kept column
named findings leaves the result an underscore before its name; an empty table has no findings and fits a scanner on the
library's texts alone.
"""

from __future__ import annotations

import builtins
import inspect
import json
import logging
import random
import re
import string
import sys
import urllib.parse
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pydoc_data import topics

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, results, sent_if_small, settle, text_batches

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 18
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "novel")

#: Words that make a context sensitive (also in the plural), and how many characters may stand between one and a candidate on
#: either side; how many characters of the surroundings are compressed with it.
SENSITIVE = ("password", "passwd", "passphrase", "pwd", "secret", "token", "key", "apikey", "credential", "bearer", "private", "auth")
REACH, AROUND = 64, 256
_LOW, _TITLE, _UP = ("|".join(map(f, SENSITIVE)) for f in (str.lower, str.title, str.upper))
_CONTEXT = re.compile(f"(?<![A-Za-z])(?:{_LOW})s?(?![a-z])|(?:{_TITLE})s?(?![a-z])|(?<![A-Za-z])(?:{_UP})S?(?![A-Za-z])")
LEAST, WORDLIKE, LETTERS = 12, 20, 3
# '=' is padding at the end only, so that the value of NAME=value is a token of its own.
_CANDIDATE = re.compile(r"""(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}(?:={1,6}(?![A-Za-z0-9+/_"'=-]))?""")
_WORD = re.compile("[A-Z]?(?:[a-z]+|[A-Z]+)")
_NUMBER = re.compile("(?<![A-Za-z0-9])[0-9]{1,4}(?![A-Za-z0-9])[/_-]?")
SIGNS = "+/_-"
_GIVEN = re.compile(r"""["']?\s*[:=]""")
#: The size of the model: words kept, bytes of the dictionary.
WORDS, DICTIONARY = 20_000, 65_536
LEVEL = 3


def library() -> tuple[list[str], list[str]]:
    """Lines of the language reference, and public names of the standard library."""
    lines = [x.strip() for t in topics.topics.values() for x in t.split("\n") if len(x.strip()) > 20]
    named = {n for m in (builtins, inspect, json, logging, random, re, string, urllib.parse) for n in dir(m)}
    named |= {n for c in (*vars(builtins).values(), *vars(logging).values(), *vars(inspect).values()) if inspect.isclass(c) for n in dir(c)}
    return lines, sorted(named | set(sys.stdlib_module_names))


class Novelty:
    """Marginal compressed size under one dictionary."""

    def __init__(self, dictionary: bytes):
        d = zstandard.ZstdCompressionDict(dictionary)
        d.precompute_compress(level=LEVEL)
        self.z = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False)
        self.filler = " ".join(library()[0][:4])  # so that there are always surroundings

    def bytes_of(self, text: str, start: int, end: int) -> int:
        """How many bytes text[start:end] adds to its surroundings, further copies of it there blanked out: a secret
        that is repeated is no less one."""
        own, wide = text[start:end], AROUND + end - start  # so wide that no copy is cut at the edge of AROUND
        blank = " " * (end - start)
        left = text[max(0, start - wide) : start].replace(own, blank)[-AROUND:]
        right = text[end : end + wide].replace(own, blank)[:AROUND]
        near = f"{self.filler}\n{left}{right}".encode("utf-8", "replace")
        told = _NUMBER.sub("", own.lower() if own.isupper() else own)
        return max(0, len(self.z.compress(near + b"\n" + told.encode())) - len(self.z.compress(near + b"\n")))

    def per_character(self, text: str, start: int, end: int) -> float:
        return self.bytes_of(text, start, end) / (end - start)


@dataclass(frozen=True)
class Scanner:
    """What fit() learns: a dictionary for the compressor and the least novelty of a secret."""

    dictionary: bytes
    threshold: float


def _odd(word: str) -> bool:
    return zlib.crc32(word.encode()) % 2 == 1


def trained(lines: list[str], words: list[str]) -> bytes:
    grouped, rng = [], random.Random(0)
    for _ in range(16):  # in several orders, so that the words and not their neighbours recur
        mixed = rng.sample(words, len(words))
        grouped += [" ".join(mixed[i : i + 6]) for i in range(0, len(mixed), 6)]
    return zstandard.train_dictionary(DICTIONARY, [x.encode("utf-8", "replace") for x in [*lines, *grouped]]).as_bytes()


def names_and_strings(words: list[str], count: int, seed: int) -> tuple[list[str], list[str]]:
    """Names and paths made of words, and random strings in the alphabets of keys, of LEAST to 48 characters."""
    rng, letters, digits = random.Random(seed), string.ascii_letters, string.digits
    kinds = (letters + digits, letters + digits + "+/", letters + digits + "_-", string.ascii_uppercase + "234567", string.ascii_lowercase + digits, "0123456789ABCDEF")
    joins = ("_".join, "-".join, "/".join, lambda w: "".join(x.title() for x in w), "".join, lambda w: "_".join(w).upper(), lambda w: "/" + "/".join(w), lambda w: "-".join(w) + f"-{rng.randrange(100)}", lambda w: f"{w[0]}/{rng.randrange(1990, 2040)}/{rng.randrange(1, 13):02d}/{'-'.join(w)}")
    plain = []
    while len(plain) < count:
        t = rng.choice(joins)([rng.choice(words) for _ in range(rng.randrange(1, 6))])
        if LEAST <= len(t) <= 48 and _may_be(t):
            plain.append(t)
    keys = ["".join(rng.choices(rng.choice(kinds), k=rng.randrange(LEAST, 49))) for _ in range(count)]
    return plain, keys


def calibrated(lines: list[str], words: list[str], names: list[str]) -> float:
    """The cut with the fewest errors between names made of words that a dictionary of the other half of the lines and
    words has not seen, and random strings; half-way where several have as few."""
    seen, rest = [x for x in lines if not _odd(x)], [x for x in lines if _odd(x)]
    known = {w for x in seen for w in re.findall("[A-Za-z]+", x)} | {w for w in (*words, *names) if not _odd(w)}
    unseen = sorted({w for x in rest for w in re.findall("[A-Za-z]{4,}", x)} - known | {w for w in words if _odd(w)})
    novelty = Novelty(trained(seen, sorted({w for w in (*words, *names) if not _odd(w)})))
    plain, keys = names_and_strings(unseen, 1500, 1)
    rng = random.Random(2)

    def of(token: str) -> float:
        left = f"{rng.choice(rest)} {rng.choice(SENSITIVE)} "
        return novelty.per_character(f"{left}{token} {rng.choice(rest)}", len(left), len(left) + len(token))

    a, b = sorted(map(of, plain)), sorted(map(of, keys))
    cuts = sorted({*a, *b})
    errors = [len(a) - bisect_left(a, c) + bisect_left(b, c) for c in cuts]
    best = [c for c, e in zip(cuts, errors, strict=True) if e == min(errors)]
    return (best[0] + best[-1]) / 2


@lru_cache(maxsize=4)
def learnt(words: tuple[str, ...]) -> Scanner:
    """A scanner of the library's texts and these words."""
    lines, names = library()
    return Scanner(trained(lines, sorted({*words, *names})), calibrated(lines, list(words), names))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(w, n): in how many distinct texts of docs, of all of them, each word stands. Texts are not exchanged, except one copy (a
    task) of those that stand in several rows."""
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("t")).filter("t is not null").select(F.xxhash64("t").alias("h"), "t")
    repeated = sent_if_small(settle(rows.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")))
    once = rows.join(repeated, "h", "left_anti").select("t")
    copies = rows.join(repeated, "h", "left_semi").groupBy("h").agg(F.first("t").alias("t")).select("t")
    words = once.unionAll(copies).select(F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(r"(?<![A-Za-z0-9+/_=-])([A-Za-z]{4,24})(?![A-Za-z0-9+/_=-])"), 1))).alias("w"))
    return words.groupBy("w").agg(F.count("*").alias("n"))


def fit(docs: DataFrame, text_col: str = "text") -> Scanner:
    """A scanner whose dictionary also knows the most frequent words of docs."""
    top = settle(word_counts(docs, text_col).filter("n >= 3").orderBy(F.desc("n"), "w").limit(WORDS).select("w"))
    return learnt(tuple(sorted(r["w"] for r in top.collect())))


def base(text: str, low: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base findings; low: text in lower case, for quick looks only."""
    found = []
    if any(k in low for k in ("passw", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def _may_be(token: str) -> bool:
    """False for tokens that are numbers, dates or short words by their looks."""
    return sum(map(str.isalpha, token)) >= LETTERS and (len(token) >= WORDLIKE or not _WORD.fullmatch(token))


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the tokens with a sensitive word within REACH before or after them. Of a token to which
    such a word is joined by a sign, the long parts beside the word; without long parts it is taken whole, unless it is
    a name to which a value is given."""
    words = [m.span() for m in _CONTEXT.finditer(text)]
    if not words:
        return
    starts, ends = [s for s, _ in words], [e for _, e in words]
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        before, inside, after = bisect_right(ends, start), bisect_left(starts, start), bisect_left(starts, end)
        parts, at = [], start
        for s, e in words[inside:after]:
            if (s > start and text[s - 1] in SIGNS) or (e < end and text[e] in SIGNS):
                parts.append((at, s - (s > at and text[s - 1] in SIGNS)))
                at = e + (e < end and text[e] in SIGNS)
        long = [(s, e) for s, e in [*parts, (at, end)] if e - s >= LEAST]
        if parts and (long or _GIVEN.match(text, end)):
            yield from (p for p in long if _may_be(text[p[0] : p[1]]))
        elif (before and start - ends[before - 1] <= REACH or after < len(words) and starts[after] - end <= REACH) and _may_be(m[0]):
            yield start, end


def findings(text: str, novelty: Novelty, threshold: float) -> list[dict]:
    """All findings of a text, by start and kind."""
    low = text.lower()
    spans = base(text, low)
    if any(k in low for k in SENSITIVE):
        taken = sorted((s, e) for s, _, e in spans)
        for start, end in candidates(text):
            if not any(s < end and e > start for s, e in taken) and novelty.per_character(text, start, end) >= threshold:
                spans.append((start, 3, end))
    spans.sort(key=lambda x: (x[0], x[1]))
    return [{"kind": KINDS[k], "start": s, "end": e, "novelty": novelty.per_character(text, s, e)} for s, k, e in spans]


_KIND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("novelty", pa.float64())]))


def scan(docs: DataFrame, keep: list[str], text_col: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """keep and findings: an array of (kind, start, end, novelty). scanner: as fit(docs) makes it, if not given."""
    text_batches(docs.sparkSession)
    scanner = scanner or fit(docs, text_col)
    (name,) = results(keep, "findings")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(scanner.dictionary)
        for batch in batches:
            found = [findings(t or "", novelty, scanner.threshold) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, _KIND)], names=[*keep, name])

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("_text")).mapInArrow(lean(run), f"{schema}`{name}` array<struct<kind: string, start: int, `end`: int, novelty: double>>")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", scanner: Scanner | None = None) -> DataFrame:
    """docs with every found span replaced by mark (overlapping spans by one)."""
    text_batches(docs.sparkSession)
    scanner = scanner or fit(docs, text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(scanner.dictionary)
        for batch in batches:
            out = []
            for t in batch.column(at).to_pylist():
                pieces, last = [], 0
                for f in findings(t, novelty, scanner.threshold) if t else ():
                    if f["start"] >= last:
                        pieces += [t[last : f["start"]], mark]
                    last = max(last, f["end"])
                out.append(t if not pieces else "".join(pieces) + t[last:])
            cols = list(batch.columns)
            cols[at] = pa.array(out, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(lean(run), docs.schema)

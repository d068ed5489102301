"""Secret scans: fixed patterns, and zstandard novelty for what they miss.

A candidate is a long run of key characters near a sensitive word. Its novelty is the number of
bytes that it adds to the compressed size of the text around it, with the compressor primed by a
dictionary of code and identifier words: words that are known or stand nearby compress well, keys do
not. Long words, identifiers and links of rarer words are told from keys by their pieces and letter pairs.
Copies of the candidate, or of 16 characters of it, in that text are blanked out first, so that a key
that stands twice does not prime itself. Every candidate is measured.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._common import bounded_batches

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: Runs that fail the least length are consumed whole in either form, so it stands in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")
#: Sensitive words; a longer word that only begins like one ("author", "authentic", "privately") is none, ``authToken`` and ``secret_key`` are.
CUE = re.compile(r"(?:passw|api_?key|credential)|(?:secret|token|auth|authorization|authentication|private|bearer|signature)(?:s|_|(?![A-Za-z]))|(?:[Ss]ecret|[Tt]oken|[Aa]uth|[Pp]rivate|[Bb]earer|[Ss]ignature)(?=[A-Z])")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
#: Characters after a sensitive word in which a candidate may start, and of text that primes it.
REACH, AROUND = 64, 512
#: Least length of a candidate, and of a piece of it that counts as its copy.
LEAST = 16
#: Parts of a candidate: letters of one case (also capitalised), digits.
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Share of a candidate's letter pairs that are known where it is made of words.
WORD_PAIRS = 0.75
CUE_PARTS = ("passw", "secret", "token", "api_key", "apikey", "credential", "auth", "private", "bearer", "signature")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Compressed bits that a character of a candidate must add (letters of prose add 2 to 3).
NOVEL_BITS = 4.2
#: Words that source code and configuration files are full of.
CODE_WORDS = """
import from class return function public private static void const string int bool true false null none self this new
def lambda async await try except finally raise throw catch if else elif for while switch case break continue export
require module package include namespace struct enum interface extends implements config settings environment variable
name value key token secret password username client server host port url path file directory version release build
index count total length size width height color background button request response header content type application
json xml html text plain charset utf-8 http https www example com org net localhost user admin root home var usr bin
get set put post delete update insert select where order group create table database connection session cookie
id uuid hash md5 sha1 sha256 base64 encode decode encrypt decrypt signature certificate public_key private_key api_key
access_key secret_key access_token refresh_token client_id client_secret aws_access_key_id aws_secret_access_key
the and of to in is that for with as was are by this from be on not or have an which you at his her they were
der die das und ist nicht mit ein eine für auf den von zu le la les des une dans que qui pour est el los las una por con
"""


@lru_cache(maxsize=1)
def _compressor():
    import zstandard

    words = zstandard.ZstdCompressionDict(CODE_WORDS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=6, dict_data=words, write_checksum=False, write_content_size=False)


def without_copies(text: str, candidate: str) -> str:
    """The text with every piece of at least ``LEAST`` characters that the candidate holds too blanked out."""
    out, at = [], 0
    for m in RUN.finditer(text):
        for i in range(m.start(), m.end() - LEAST + 1):
            if text[i : i + LEAST] in candidate:
                start = max(i, at)
                out += [text[at:start], " " * (i + LEAST - start)]
                at = i + LEAST
    return "".join([*out, text[at:]])


def novelty_bits(before: str, candidate: str, after: str) -> float:
    """Compressed bits that each character of the candidate adds to the text around it."""
    c = _compressor()
    around = without_copies(before, candidate)[-AROUND:] + without_copies(after, candidate)[:AROUND]
    plain = len(c.compress(around.encode("utf-8", "surrogatepass")))
    whole = len(c.compress((around + candidate).encode("utf-8", "surrogatepass")))
    return 8 * (whole - plain) / len(candidate)


def cue_ends(text: str) -> list[int]:
    """Where sensitive words end, in either case, ascending."""
    low, out = text.lower(), set()
    if len(low) != len(text):
        low = text.translate(_LOWER)
    for w in CUE_PARTS:
        at = low.find(w)
        while at >= 0:
            out |= {m.end() for t in (low, text) if (m := CUE.match(t, at))}
            at = low.find(w, at + 1)
    return sorted(out)


def _pairs(text: str) -> set[str]:
    return {p for p in map("".join, zip(text, text[1:])) if p.isalpha()}


@lru_cache(maxsize=1)
def _known_pairs() -> frozenset[str]:
    return frozenset(_pairs(CODE_WORDS))


def reads_as_words(before: str, candidate: str, after: str) -> bool:
    """Whether a candidate is long words, an identifier or a link: pieces of four letters and more in the mean, of one
    case each, few short numbers, and letter pairs of which most stand in the dictionary or the text around."""
    pieces = PIECE.findall(candidate)
    letters = [p for p in pieces if p.isalpha()]
    if not letters or any(p.isdigit() and len(p) > 4 for p in pieces) or sum(p.isdigit() for p in pieces) > len(letters) or sum(map(len, letters)) < 4 * len(letters):
        return False
    near = _pairs((without_copies(before, candidate)[-AROUND:] + " " + without_copies(after, candidate)[:AROUND]).translate(_LOWER))
    found = [p[i : i + 2] for p in map(str.lower, letters) for i in range(len(p) - 1)]
    return sum(p in near or p in _known_pairs() for p in found) >= WORD_PAIRS * len(found)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    out = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "key")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def novel_spans(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Incompressible candidates near a sensitive word that no fixed pattern has covered."""
    out, done = [], 0
    # Spans of one kind don't overlap; of all kinds, how far any that starts before reaches.
    starts, reach_of, far = [], [], 0
    for start, _, end in sorted(known):
        far = max(far, end)
        starts.append(start)
        reach_of.append(far)
    for cue in cue_ends(text):
        while (m := RUN.search(text, max(cue, done), cue + REACH + 16)) and m.start() <= cue + REACH:
            s, e = m.start(), RUN.match(text, m.start()).end()
            done = e
            if (before := bisect_left(starts, e)) and reach_of[before - 1] > s:
                continue
            cand = text[s:e]
            # Longer than what primes it, so that a copy which its edge cuts is still seen.
            reach = AROUND + LEAST - 1
            sides = text[max(0, s - reach) : s], cand, text[e : e + reach]
            if novelty_bits(*sides) >= NOVEL_BITS and not reads_as_words(*sides):
                out.append((s, 3, e))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan_text(text: str | None) -> tuple[list, list]:
    text = text or ""
    base = base_spans(text)
    return base, novel_spans(text, base)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id n_assign n_access n_hex base_sha256 spans``.

    Nulls count as empty texts, which have no spans (``spans`` is then empty). Positions are code
    points of the whole text; spans that start together stand in the order of their kinds. Repeated rows give
    repeated results; an empty table gives none; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, t in zip(b["doc_id"], b["text"], strict=True):
                base, more = scan_text(t)
                n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                rows.append((d, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
            out = pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """The same rows and columns with every span of the text replaced by a mark; nulls stay null.

    Overlapping spans become one mark. Rows without a span keep their text as it is.
    """
    bounded_batches(docs.sparkSession)

    def clean(text: str | None) -> str | None:
        if not isinstance(text, str):
            return None
        out, at = [], 0
        for s, _, e in sorted(x for part in scan_text(text) for x in part):
            if e <= at:
                continue
            if s >= at:
                out += [text[at:s], mark]
            at = e
        return "".join([*out, text[at:]]) if out else text

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return texts.map(clean, na_action="ignore")

    return docs.withColumn(text_col, cleaned(F.col(text_col)))


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Secret scans: known forms by pattern, and random strings by their token efficiency.

A string of random characters falls into short tokens, so it has few characters a token under a public vocabulary, where words
and identifiers have many. Candidates are runs of 20 or more of the characters that keys are made of; shorter ones, and those
without a digit or without a letter, are not tried. Of those with few characters a token, digests of the usual lengths, UUIDs and
identifiers are known and left out. An identifier is made of real words, which have many letters a token themselves.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{16,}")  # runs are maximal, so shorter ones drop out
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = re.compile("[A-Za-z0-9+/_=-]{20,}")
UUID = re.compile("[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
DIGEST = re.compile("([0-9a-f]+|[0-9A-F]+)")
DIGEST_CHARS = (32, 40, 56, 64, 96, 128)
LETTERS = re.compile("[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
SWITCH = re.compile("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
#: A run of letters is a word from so many letters on, at so many letters a token.
WORD_CHARS = 3


@dataclass(frozen=True)
class TokenEfficiency:
    """A candidate is random below ``chars_per_token`` characters a token."""

    chars_per_token: float = 2.3
    path: str | None = None


def _encoding(path: str | None):
    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("secret-scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


_LOADED: dict = {}


def encoding(path: str | None):
    if path not in _LOADED:
        _LOADED[path] = _encoding(path)
    return _LOADED[path]


def identifier(candidate: str, path: str | None = None) -> bool:
    """Numbers with separators, or mostly real words: three quarters of the letters stand in words, which are a third of the
    characters at least, with at most three switches between letters and digits. Capitals count as words only by their tokens."""
    letters = sum(c.isalpha() for c in candidate)
    if not letters:
        return True
    if len(SWITCH.findall(candidate)) > 3:
        return False
    runs = [r for r in LETTERS.findall(candidate) if len(r) >= WORD_CHARS]
    words = sum(len(r) for r in runs if len(r) >= WORD_CHARS * len(encoding(path).encode_ordinary(" " + r.lower())))
    return words * 4 >= letters * 3 and words * 3 >= len(candidate)


def known(candidate: str, path: str | None = None) -> bool:
    """A digest of a usual length, a UUID, or an identifier of words and numbers."""
    return bool((DIGEST.fullmatch(candidate) and len(candidate) in DIGEST_CHARS) or UUID.fullmatch(candidate)) or identifier(candidate, path)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the known forms, leftmost and not overlapping within a kind."""
    found = []
    lowered = text.lower()
    if any(k in lowered for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def random_spans(text: str, taken: list[tuple[int, int, int]], test: TokenEfficiency) -> list[tuple[int, int, int]]:
    """The candidates that meet no span of ``taken``, have a digit and a letter, fall into short tokens, and aren't known."""
    found = []
    spans = sorted((a, z) for a, _, z in taken)
    k = reach = 0  # spans before the k-th begin before the candidate ends; they end at ``reach`` at the latest
    for m in CANDIDATE.finditer(text):
        s = m[0]
        while k < len(spans) and spans[k][0] < m.end():
            reach = max(reach, spans[k][1])
            k += 1
        if reach > m.start() or s.isalpha() or not any(c.isdigit() for c in s):
            continue
        if len(s) < test.chars_per_token * len(encoding(test.path).encode_ordinary(s)) and not known(s, test.path):
            found.append((m.start(), 3, m.end()))
    return found


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in sorted(spans))


def secret_scan(docs: DataFrame, test: TokenEfficiency = TokenEfficiency(), text: str = "text") -> DataFrame:
    """Adds the struct ``secrets`` to every row: n_assign, n_access, n_hex, n_random (long), base (string) and spans (string).

    ``base`` and ``spans`` write spans as kind:start:end, in code points with the end excluded, by start and then kind, joined by
    commas; ``spans`` also has the random strings. A null text is an empty one and has none. Rows are scanned one by one, within
    the row; repeated rows get equal results, an empty table gives an empty table, other columns pass through, and a column
    named ``secrets`` is replaced.
    """
    fields = [pa.field(n, pa.int64()) for n in ("n_assign", "n_access", "n_hex", "n_random")] + [pa.field("base", pa.string()), pa.field("spans", pa.string())]

    @F.arrow_udf("n_assign long, n_access long, n_hex long, n_random long, base string, spans string")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for value in batch:
                t = value.as_py() or ""
                base = base_spans(t)
                more = random_spans(t, base, test)
                counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                rows.append((*counts, len(more), written(base), written(base + more)))
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], fields=fields)

    return docs.withColumn("secrets", scan(F.col(f"`{text}`").cast("string")))


def sha256_hex(column: str):
    return F.sha2(F.encode(F.col(column), "UTF-8"), 256)

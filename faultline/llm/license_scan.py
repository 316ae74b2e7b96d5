"""License scans: identifier tags and notice phrases by an Aho-Corasick automaton, licence expressions by a shunting-yard parser.

A text becomes its words with single blanks between, and one pass of the automaton finds all phrases in it. Where it finds the
words of an identifier tag, the tag's expression is read from the text behind them and evaluated. Only identifiers of a public
list, and ``LicenseRef-`` ones, are licences; a tag that names others is an unsure one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases of the base and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Phrases of notices: their label and how surely they license the text.
NOTICES = {
    "permission is hereby granted free of charge": ("mit", 0.95),
    "redistribution and use in source and binary forms": ("bsd", 0.95),
    "bsd license": ("bsd", 0.8),
    "isc license": ("isc", 0.8),
    "mozilla public license": ("mpl", 0.9),
    "lesser general public license": ("lgpl", 0.9),
    "affero general public license": ("agpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "creative commons attribution": ("cc-by", 0.8),
    "licensed under cc by": ("cc-by", 0.9),
    "licensed under cc by nc": ("cc-by-nc", 0.9),
    "licensed under cc by sa": ("cc-by-sa", 0.9),
    "licensed under cc0": ("cc0", 0.9),
    "public domain": ("public-domain", 0.5),
}
BASE_SCORE, TAG_SCORE, BROKEN_TAG_SCORE = 0.9, 1.0, 0.3
TAG = "spdx license identifier"
TAG_TEXT = re.compile(rb":[ \t]*([^\n]*)")
SOLID = re.compile(rb"[^ ]+")
# Identifiers of the SPDX licence list in wide use, and of its list of exceptions, in lower case.
LICENSES = frozenset(
    """0bsd aal afl-3.0 agpl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.0 apache-1.1 apache-2.0 apsl-2.0 artistic-1.0 artistic-2.0
    blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-3-clause-lbnl bsd-4-clause
    bsl-1.0 busl-1.1 bzip2-1.0.6 cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc-by-nc-2.0 cc-by-nc-3.0 cc-by-nc-4.0
    cc-by-nc-nd-3.0 cc-by-nc-nd-4.0 cc-by-nc-sa-3.0 cc-by-nc-sa-4.0 cc-by-nd-3.0 cc-by-nd-4.0 cc-by-sa-2.0 cc-by-sa-2.5
    cc-by-sa-3.0 cc-by-sa-4.0 cc-pddc cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.1 cecill-b cecill-c cpal-1.0 cpl-1.0 curl ecl-2.0
    efl-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 fsfap gfdl-1.2 gfdl-1.3 gfdl-1.3-only gfdl-1.3-or-later gpl-1.0 gpl-1.0-only
    gpl-1.0-or-later gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later hpnd icu ijg imagemagick ipl-1.0
    isc json lgpl-2.0 lgpl-2.0-only lgpl-2.0-or-later lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only
    lgpl-3.0-or-later libpng libpng-2.0 libtiff lppl-1.3c mit mit-0 mit-cmu mpl-1.0 mpl-1.1 mpl-2.0
    mpl-2.0-no-copyleft-exception ms-pl ms-rl mulanpsl-2.0 ncsa odbl-1.0 odc-by-1.0 ofl-1.0 ofl-1.1 openssl osl-3.0 php-3.01
    postgresql psf-2.0 python-2.0 qpl-1.0 ruby sgi-b-2.0 sissl sleepycat sspl-1.0 tcl unicode-3.0 unicode-dfs-2016 unlicense
    upl-1.0 vim w3c wtfpl x11 zend-2.0 zlib zpl-2.1""".split()
)
EXCEPTIONS = frozenset(
    """autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-2.2 bootloader-exception classpath-exception-2.0
    font-exception-2.0 gcc-exception-2.0 gcc-exception-3.1 libtool-exception linux-syscall-note llvm-exception
    openjdk-assembly-exception-1.0 qt-gpl-exception-1.0 swift-exception u-boot-exception-2.0""".split()
)
#: How far a licence binds those who use the text: 0 free, 1 weak copyleft, 2 strong copyleft, 3 restricted or unknown.
BINDING = {"mit": 0, "apache": 0, "bsd": 0, "isc": 0, "cc0": 0, "unlicense": 0, "zlib": 0, "mpl": 1, "lgpl": 1, "epl": 1, "gpl": 2, "agpl": 2}
TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
OPERATORS = {"or": 1, "and": 2, "with": 3}


@dataclass(frozen=True)
class Expression:
    """A parsed expression: its licences in order (without exceptions), its postfix form, how far it binds, and whether all its
    names are on the lists."""

    identifiers: tuple[str, ...]
    postfix: tuple[str, ...]
    binding: int
    listed: bool


def listed(name: str, exception: bool = False) -> bool:
    """If a lower-case name is on the list of licences (with ``+`` for later versions) or of exceptions."""
    return name in EXCEPTIONS if exception else name.removesuffix("+") in LICENSES or name.startswith("licenseref-")


def parse(text: str) -> Expression | None:
    """The expression that ``text`` begins with; None if it has none or is malformed.

    ``with`` binds closest, then ``and``, then ``or``. ``or`` lets the reader choose the side that binds less, ``and`` asks for
    both; an exception after ``with`` loosens a licence by one step.
    """
    output: list[str] = []
    stack: list[str] = []
    want = True  # an operand comes next
    for m in TOKEN.finditer(text.split("*/")[0].split("-->")[0]):
        t = m[0].lower()
        if t == "(":
            if not want:
                break
            stack.append(t)
        elif t == ")":
            if want or "(" not in stack:
                return None
            while stack[-1] != "(":
                output.append(stack.pop())
            stack.pop()
        elif t in OPERATORS:
            if want:
                return None
            while stack and stack[-1] != "(" and OPERATORS[stack[-1]] >= OPERATORS[t]:
                output.append(stack.pop())
            stack.append(t)
            want = True
        else:
            if not want:
                break  # prose after the expression
            output.append(t)
            want = False
    if want or "(" in stack:
        return None
    output += reversed(stack)
    values: list[tuple[int, str]] = []
    exceptions: list[int] = []
    names: list[str] = []
    for t in output:
        if t in OPERATORS:
            (b, k), (a, j) = values.pop(), values.pop()
            if t == "with":
                exceptions.append(k)
                a = max(a - 1, 0) if a < 3 else a
            values.append((min(a, b) if t == "or" else max(a, b) if t == "and" else a, j))
        else:
            values.append((BINDING.get(re.split(r"[-.0-9]", t)[0], 3), len(names)))
            names.append(t)
    licences = tuple(t for k, t in enumerate(names) if k not in exceptions)
    return Expression(licences, tuple(output), values[0][0], all(listed(t, k in exceptions) for k, t in enumerate(names)))


_TABLE = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b > 127 else b + 32 if 65 <= b < 91 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z lowered."""
    return text.encode().translate(_TABLE).split()


_AUTOMATA: dict = {}


def automaton():
    """One for each worker process."""
    if "a" not in _AUTOMATA:
        import ahocorasick

        a = ahocorasick.Automaton()
        phrases = {p: ("base", label, BASE_SCORE) for p, label in BASE_PHRASES.items()} | {p: ("notice", *v) for p, v in NOTICES.items()} | {TAG: ("tag", "", 0.0)}
        for phrase, value in phrases.items():
            a.add_word(f" {phrase} ", (len(phrase) + 2, *value))
        a.make_automaton()
        _AUTOMATA["a"] = a
    return _AUTOMATA["a"]


def scan(text: str) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, binding) of a text."""
    data = text.encode()
    plain = data.translate(_TABLE)
    words = plain.split()
    line = " " + b" ".join(words).decode() + " "
    places, base, labels, score, tags = [], set(), set(), 0.0, []
    longest: dict[int, tuple[int, str]] = {}  # of the notices that begin at a place
    for end, (size, kind, label, s) in automaton().iter(line):
        if kind == "tag":
            tags.append(end)
            continue
        score = max(score, s)
        if kind == "base":
            base.add(label)
            places.append(end - size + 1)
        else:
            longest[end - size] = max(longest.get(end - size, (0, "")), (size, label))
    labels |= base | {label for _, label in longest.values()}
    expressions, binding = [], None
    if tags:  # the number of blanks up to a tag's end is that of words up to its last one
        ends = [m.end() for m in SOLID.finditer(plain)]
    counted = at_word = 0
    for end in tags:
        at_word += line.count(" ", counted, end)
        counted = end
        m = TAG_TEXT.match(data, ends[at_word - 1])
        found = parse(m[1].decode()) if m else None
        if m:
            score = max(score, TAG_SCORE if found and found.listed else BROKEN_TAG_SCORE)
        if found:
            labels.update(t for t in found.identifiers if listed(t))
            expressions.append(" ".join(found.postfix))
            binding = max(binding or 0, found.binding)
    at = lambda p: line.count(" ", 0, p)
    return len(words), len(places), at(min(places)) if places else None, at(max(places)) if places else None, ",".join(sorted(base)), ",".join(sorted(labels)), score, expressions, binding


def license_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the struct ``license`` to every row: n_words, n_base, first_word, last_word (long), base_labels, labels (distinct,
    sorted, joined by commas; empty for none), score (0 to 1), expressions (postfix, one for each tag) and binding (int, of the
    tag that binds most; null without one).

    A null text is an empty one: no words, no labels, score 0. Rows are scanned one by one, within the row; repeated rows get
    equal results, an empty table gives an empty table, other columns pass through, and a column named ``license`` is replaced.
    """
    types = (("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.list_(pa.string())), ("binding", pa.int32()))
    fields = [pa.field(*x) for x in types]

    @F.arrow_udf("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, binding int")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [scan(value.as_py() or "") for value in batch]
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], fields=fields)

    return docs.withColumn("license", run(F.col(f"`{text}`").cast("string")))

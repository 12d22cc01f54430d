"""Secrets: fixed patterns, and strings that a tokenizer's vocabulary cannot shorten.

The patterns give the base spans, which always stay. In the gaps between them,
runs of 16 or more characters of the usual alphabets of keys (with up to two
closing equals signs) are encoded with a byte-level vocabulary. Merges are
learned from written language and code, so words and names take few tokens for
their length and random strings take many: a run is added as `random` if it has at
most 2 characters a token, or 1.6 if it is shorter than 20 or of letters alone.
Not taken are

* known digests: 32, 40, 56, 64, 96 or 128 hexadecimal digits of one case, what
  follows the name of a digest (`sha256-...`), and data after `base64,`;
* identifiers: digits alone, UUIDs, runs that separators cut into parts of 6
  characters or fewer on average (dates, versions, host and file names), letters
  alone unless small and capital ones change more than once in four places, and
  runs of fewer than 8 different characters.

Added runs with a single dot between them become one span (signed web tokens).

Null and empty texts have no spans. Whole texts are read: long runs are encoded
512 characters at a time, so time and memory grow with the length alone. Each row
stands for itself, repeated or not, with or without an id. Extra columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from panelwise.llm.common import bounded, col, slices, strings

KINDS = ("assign", "access", "hex", "random")
SHORTEST, SHORT = 16, 20
FEW, FEWER = 2.0, 1.6  # characters a token
PART = 6
DIFFERENT = 8
AT_ONCE = 512
Span = tuple[int, int, int]  # start, kind, end

# The base patterns, lengths of digests in hexadecimal digits, their names.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
DIGESTS = (32, 40, 56, 64, 96, 128)
_NAMED = re.compile(r"(?:md5|sha-?(?:1|224|256|384|512)|blake[23][bs]?|crc32c?|base64)[-_:=,]\s?$", re.I)

_RUN = re.compile(r"[A-Za-z0-9+/][A-Za-z0-9+/_~-]{15,}={0,2}")
_NAMED_RUN = re.compile(r"(?:md5|sha(?:1|224|256|384|512))[-_]", re.I)
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_ONE_CASE_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_SEPARATOR = re.compile(r"[+/_~-]")
_CASE = re.compile(r"[a-z](?=[A-Z])|[A-Z](?=[a-z])")


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start and kind.

    A run of hexadecimal digits or of capitals is matched whole or, if it is too
    short, nowhere, so asking for the least length finds what a filter would leave.
    """
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def known(run: str, before: str) -> bool:
    """Whether a run is a known digest, named data or an identifier; `before` is the text ahead of it."""
    core = run.rstrip("=")
    if core.replace("-", "").replace("_", "").isdigit() or _UUID.fullmatch(core):
        return True
    if len(core) in DIGESTS and _ONE_CASE_HEX.fullmatch(core):
        return True
    if _NAMED.search(before) or _NAMED_RUN.match(core):
        return True
    if len(core) <= PART * (1 + len(_SEPARATOR.findall(core))) or len(set(core)) < DIFFERENT:
        return True
    return core.isalpha() and len(_CASE.findall(core)) * 4 < len(core)


def vocabulary(lines: bytes, pattern: str) -> tiktoken.Encoding:
    """Encoding from the lines of a tiktoken file."""
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines())}
    return tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def characters_per_token(encoding: tiktoken.Encoding, run: str) -> float:
    parts = [run[i : i + AT_ONCE] for i in range(0, len(run), AT_ONCE)]
    return len(run) / sum(map(len, map(encoding.encode_ordinary, parts)))


def inefficient(encoding: tiktoken.Encoding, run: str) -> bool:
    """Whether the vocabulary needs as many tokens for a run as random characters take."""
    core = run.rstrip("=")
    return characters_per_token(encoding, core) <= (FEWER if len(core) < SHORT or core.isalpha() else FEW)


def random_spans(encoding: tiktoken.Encoding, text: str, base: list[Span]) -> list[Span]:
    """Runs outside the base spans that are neither known nor efficient to encode."""
    out: list[Span] = []
    low = 0
    for high, end in [*((a, b) for a, _, b in base), (len(text), len(text))]:
        for m in _RUN.finditer(text, low, high):
            a, b = m.span()
            if known(m.group(), text[max(0, a - 16) : a]) or not inefficient(encoding, m.group()):
                continue
            if out and a == out[-1][2] + 1 and text[a - 1] == ".":
                a = out.pop()[0]
            out.append((a, 3, b))
        low = max(low, end)
    return out


def find(encoding: tiktoken.Encoding, text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and the spans that the token-efficiency test adds."""
    base = base_spans(text)
    return base, random_spans(encoding, text, base)


def notation(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


_encodings: dict[str, tiktoken.Encoding] = {}


def _run(raw: bytes, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = hashlib.sha256(raw + pattern.encode()).hexdigest()
        if name not in _encodings:
            _encodings.clear()
            _encodings[name] = vocabulary(raw, pattern)
        encoding = _encodings[name]
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc, text in zip(part.column("doc_id").to_pylist(), strings(part.column("text")).to_pylist()):
                    base, added = find(encoding, text)
                    counts = [sum(s[1] == k for s in base) for k in range(3)]
                    digest = hashlib.sha256(notation(base).encode()).hexdigest()
                    rows.append((doc, *counts, digest, notation(base + added), len(added)))
                types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=_NAMES)

    return run


_NAMES = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"]


def find_secrets(docs: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """Per row: doc_id, base spans by kind, their digest, all spans, and how many the test added.

    The vocabulary file is read on the driver and its lines sent along, so
    executors need no copy of it; `pattern` is what its merges were learned within.
    """
    with open(vocabulary_path, "rb") as f:
        raw = f.read()
    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_random bigint"
    rows = bounded(docs).select(col("doc_id").cast("bigint").alias("doc_id"), col("text").alias("text"))
    return rows.mapInArrow(_run(raw, pattern), schema)

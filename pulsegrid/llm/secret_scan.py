"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

A run of 20 or more characters that mixes at least two of lower case, upper case and digits is
random if a tiktoken vocabulary spends a token on fewer than `max_ratio` characters: vocabularies
are learned from language and code, so random strings fall apart into short tokens. Digests
(hexadecimal of a known digest's length) and UUIDs are left out before the test, and identifiers after
it (words joined by separators or case, if the vocabulary knows the words and few numbers stand among
them without separators), as is whatever the fixed patterns have found.

Offsets are code points, ends exclusive. Null texts are empty; repeated rows come back each; no documents give no
rows. Texts are read whole, in time that grows with their length, however many spans they hold. Spans of one start
are listed by kind. Columns other than doc_id and text are not read (redact() keeps all columns).
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\Z")
#: A segment of an identifier: letters of one case, a capitalised word, or digits.
SEGMENT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Characters a token of an identifier's letters at least; digits of a number, and numbers without separators around, at most.
WORD_RATIO, NUMBER, NUMBERS = 2.5, 4, 2
CLASSES = (re.compile("[a-z]"), re.compile("[A-Z]"), re.compile("[0-9]"))
#: Characters a token, below which a run is random.
MAX_RATIO = 1.9
TOKENIZER = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def encoding(path: str | None = None) -> tiktoken.Encoding:
    """The vocabulary of ranks at `path` (by default the public one that is installed)."""
    import public_tokenizers

    with open(path or public_tokenizers.path(TOKENIZER), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_identifier(run: str, vocabulary: tiktoken.Encoding) -> bool:
    """Whether a run is made of words of two letters or more that take few tokens, and of few short numbers."""
    letters = tokens = inside = 0
    for m in SEGMENT.finditer(run):
        segment = m.group()
        if segment.isdigit():
            inside += (m.start() > 0 and run[m.start() - 1].isalpha()) or (m.end() < len(run) and run[m.end()].isalpha())
            if len(segment) > NUMBER or inside > NUMBERS:
                return False
        elif len(segment) < 2:
            return False
        else:
            letters += len(segment)
            tokens += len(vocabulary.encode_ordinary(segment))
    return letters > 0 and letters >= WORD_RATIO * tokens


def is_random(run: str, vocabulary: tiktoken.Encoding, max_ratio: float = MAX_RATIO) -> bool:
    """Whether a run is neither a digest nor an identifier and takes a token for few characters."""
    if sum(bool(c.search(run)) for c in CLASSES) < 2:
        return False
    if UUID.match(run) or len(run) in DIGEST_LENGTHS and DIGEST.match(run):
        return False
    return len(run) < max_ratio * len(vocabulary.encode_ordinary(run)) and not is_identifier(run, vocabulary)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the fixed patterns find, in order."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if long_word(text):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def long_word(text: str) -> bool:
    """Whether a run of 20 non-blank characters can be there at all."""
    return max(map(len, text.split()), default=0) >= 20


def random_spans(text: str, base: list[tuple[int, int, int]], path: str | None = None, max_ratio: float = MAX_RATIO) -> list[tuple[int, int, int]]:
    """(start, kind, end) of random runs that no fixed pattern has touched."""
    if not long_word(text):
        return []
    out = []
    nth = reach = 0  # of the spans, which are in order: those that start before a run's end, and the last place that they reach
    for m in RUN.finditer(text):
        while nth < len(base) and base[nth][0] < m.end():
            reach = max(reach, base[nth][2])
            nth += 1
        if reach <= m.start() and is_random(m.group(), encoding(path), max_ratio):
            out.append((m.start(), 3, m.end()))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, path: str | None = None, max_ratio: float = MAX_RATIO) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans of every document."""

    def run(batches: shared.Batches) -> shared.Batches:
        for batch in batches:
            ids, texts = shared.columns(batch, "doc_id", "text")
            rows = []
            for text in texts:
                base = base_spans(text or "")
                more = random_spans(text or "", base, path, max_ratio)
                counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                rows.append((*counts, len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more))))
            a, b, c, d, e, f = zip(*rows, strict=True) if rows else ((),) * 6
            long = pa.int64()
            yield shared.batch_of(doc_id=pa.array(ids, long), n_assign=pa.array(a, long), n_access=pa.array(b, long), n_hex=pa.array(c, long), n_random=pa.array(d, long), base_sha256=pa.array(e, pa.string()), spans=pa.array(f, pa.string()))

    return shared.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def redacted(text: str | None, path: str | None = None, max_ratio: float = MAX_RATIO, mark: str = "[SECRET]") -> str | None:
    """The text with `mark` in place of every span; spans that overlap share one."""
    if not text:
        return text
    base = base_spans(text)
    out, at = [], 0
    for start, _, end in sorted(base + random_spans(text, base, path, max_ratio)):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, path: str | None = None, max_ratio: float = MAX_RATIO) -> DataFrame:
    """The documents with secrets replaced in `text`, and n_chars of changed texts counted anew."""

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: redacted(t, path, max_ratio), na_action="ignore")

    kinds = dict(docs.dtypes)
    (new_text,) = shared.free(docs, "_clean")
    new = docs.withColumn(new_text, clean("text"))
    if "n_chars" in kinds:
        new = new.withColumn("n_chars", F.when(F.col(new_text) != F.col("text"), F.length(new_text).cast(kinds["n_chars"])).otherwise(F.col("n_chars")))
    return new.withColumn("text", F.col(new_text)).select(*docs.columns)

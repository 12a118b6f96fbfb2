"""Quality rules on tokeniser fertility.

Public vocabularies measure each text word by word: characters per token of a
byte-level BPE, the share of byte-fallback pieces and the entropy (bits) of the
pieces of a BPE with byte fallback.  A text is kept if the measures lie inside
the band of its dominant script.  Six base measures that need no vocabulary
come with them.

All work is one pass over the texts without a shuffle; a worker keeps the
token counts of recent words in a bounded table (``CACHE_WORDS``), which only
saves time.

Defined cases: a null text is the empty text; a text without words has no
tokens, all measures 0 and ``base_failed`` true; a long text is measured
whole, as one value; repeated rows are judged alike; an empty table gives an
empty result; ``measure`` ignores other columns, ``keep_good`` carries all of
them through untouched, whatever their names.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from costmart.llm.common import WORD, pairs, pieces

#: Words whose token counts a worker remembers.
CACHE_WORDS = 200_000


@dataclass(frozen=True)
class Band:
    """Accepted range of the measures of one script."""

    min_chars_per_token: float
    max_chars_per_token: float
    max_fallback_share: float
    min_entropy: float = 2.0


#: Rejection bands per script: fixed values between clean text and random letters of the
#: script, as measured with the two vocabularies (the test has samples of both).  Where the
#: piece vocabulary spells a script, random letters fall back more often; where it spells all
#: letters, they take more byte-level tokens.  ``latin_marked`` is Latin with many letters
#: beyond ASCII.  ``other`` has the scripts that the vocabularies do not spell: clean and
#: random letters measure alike there, so its band rejects by entropy only.
BANDS = {
    "latin": Band(1.6, 12.0, 0.30),
    "latin_marked": Band(0.6, 12.0, 0.30),
    "greek": Band(0.71, 12.0, 0.20),
    "cyrillic": Band(0.69, 12.0, 0.20),
    "hebrew": Band(0.64, 12.0, 0.20),
    "arabic": Band(0.50, 12.0, 0.09),
    "indic": Band(0.30, 12.0, 0.35),
    "cjk": Band(0.30, 12.0, 0.36),
    "armenian": Band(0.40, 12.0, 0.27),
    "georgian": Band(0.30, 12.0, 0.09),
    "thai": Band(0.40, 12.0, 0.20),
    "symbols": Band(0.20, 12.0, 0.50),
    "other": Band(0.1, 12.0, 1.00),
}
#: Share of Latin letters beyond ASCII from which ``latin_marked`` holds.
MARKED = 0.04

#: First code point of each script range (fixed values of the Unicode blocks).
SCRIPT_STARTS = [
    (0x0000, "none"), (0x0041, "latin"), (0x005B, "none"), (0x0061, "latin"), (0x007B, "none"),
    (0x00C0, "latin"), (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"),
    (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"),
    (0x0750, "arabic"), (0x0780, "other"), (0x08A0, "arabic"), (0x0900, "indic"),
    (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "indic"),
    (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"),
    (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "none"), (0x2190, "symbols"),
    (0x2C00, "none"), (0x2E80, "cjk"), (0xA000, "other"), (0xAC00, "cjk"), (0xD7B0, "other"),
    (0xF900, "cjk"), (0xFB00, "other"), (0xFF66, "cjk"), (0xFFE0, "other"), (0x20000, "cjk"),
    (0x323B0, "other"),
]
_STARTS = np.array([s for s, _ in SCRIPT_STARTS])
_NAMES = [n for _, n in SCRIPT_STARTS]
_IS_LATIN = np.array([n == "latin" for n in _NAMES])


def dominant_script(text: str) -> str:
    """The script of most letters; ``latin`` wins ties, ``other`` without letters."""
    if text.isascii():
        return "latin" if any(map(str.isalpha, text)) else "other"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    ranges = np.bincount(np.searchsorted(_STARTS, points, side="right") - 1,
                         minlength=len(_NAMES))
    totals: Counter = Counter()
    for name, n in zip(_NAMES, ranges.tolist()):
        if name != "none":
            totals[name] += n
    best = max(totals.values(), default=0)
    if not best:
        return "other"
    return "latin" if totals["latin"] == best else min(k for k, v in totals.items() if v == best)


def band_of(text: str, script: str, bands: dict[str, Band]) -> Band:
    """The band of a text of a script; a script without a band has that of ``other``."""
    if script == "latin" and "latin_marked" in bands and not text.isascii():
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        latin = _IS_LATIN[np.searchsorted(_STARTS, points, side="right") - 1]
        if (latin & (points > 127)).sum() >= MARKED * latin.sum():
            return bands["latin_marked"]
    return bands.get(script, bands["other"])


class Vocabularies:
    """Per word: tokens of the byte-level BPE, and ids of the piece BPE as bytes."""

    def __init__(self, byte_bpe: str, piece_bpe: str):
        import base64

        import public_tokenizers
        import sentencepiece
        import tiktoken
        with open(byte_bpe, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        self._byte = tiktoken.Encoding("fertility", pat_str=public_tokenizers.PATTERN,
                                       mergeable_ranks=ranks, special_tokens={})
        self._piece = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        self.fallback = np.array([self._piece.is_byte(i)
                                  for i in range(self._piece.get_piece_size())])
        self._seen: dict[str, tuple[int, bytes]] = {}

    def words(self, words: set[str]) -> dict[str, tuple[int, bytes]]:
        seen = self._seen
        new = list(words.difference(seen))
        if new:
            if len(seen) + len(new) > CACHE_WORDS:
                seen = self._seen = {w: seen[w] for w in words if w in seen}
            tokens = self._byte.encode_ordinary
            for w, ids in zip(new, self._piece.encode(new, num_threads=1)):
                seen[w] = (len(tokens(f" {w}")), array("I", ids).tobytes())
        return seen


@lru_cache(maxsize=2)
def _vocabularies(byte_bpe: str, piece_bpe: str) -> Vocabularies:
    return Vocabularies(byte_bpe, piece_bpe)


def repeated_words(words: list[str], width: int = 5) -> int:
    """Words inside ``width``-word windows that occur twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i:] for i in range(width))))
    if len(set(windows)) == n:
        return 0
    counts = Counter(windows)
    total = end = 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + width - max(i, end)
            end = i + width
    return total


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(lines) - len(set(lines))


def entropy(ids: np.ndarray) -> float:
    """Bits per token of the token counts."""
    if not len(ids):
        return 0.0
    ends = np.flatnonzero(np.diff(np.sort(ids), append=np.uint32(0xFFFFFFFF)))
    counts = np.diff(ends, prepend=-1)
    return float(math.log2(len(ids)) - (counts * np.log2(counts)).sum() / len(ids))


SYMBOLS = "#*$%&|<>"

RESULT = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, base_failed boolean, kept boolean, script string, "
          "n_tokens long, chars_per_token double, fallback_share double, token_entropy double")


def judge(text: str | None, vocabularies: Vocabularies, bands: dict[str, Band]) -> tuple:
    """The values of ``RESULT`` after doc_id for one text."""
    text = text or ""
    words = WORD.findall(text)
    n, chars = len(words), sum(map(len, words))
    repeats = repeated_words(words)
    failed = n < 10 or 100 * repeats > 20 * n
    known = vocabularies.words(set(words))
    counts = [known[w] for w in words]
    tokens = sum([c[0] for c in counts])
    ids = np.frombuffer(b"".join([c[1] for c in counts]), np.uint32)
    fallback = float(vocabularies.fallback[ids].mean()) if len(ids) else 0.0
    rate = chars / tokens if tokens else 0.0
    bits = entropy(ids)
    script = dominant_script(text)
    band = band_of(text, script, bands)
    good = (band.min_chars_per_token <= rate <= band.max_chars_per_token
            and fallback <= band.max_fallback_share and bits >= band.min_entropy)
    return (n, chars, sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeats,
            failed, good and not failed, script, tokens, rate, fallback, bits)


def _paths(byte_bpe: str | None, piece_bpe: str | None) -> tuple[str, str]:
    import public_tokenizers
    return (byte_bpe or public_tokenizers.path("byte_bpe_50k.tiktoken"),
            piece_bpe or public_tokenizers.path("piece_bpe_32k.model"))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            bands: dict[str, Band] = BANDS, byte_bpe: str | None = None,
            piece_bpe: str | None = None) -> DataFrame:
    """Measures and verdict (``RESULT``) of every row."""
    paths = _paths(byte_bpe, piece_bpe)
    names = [f.split()[0] for f in RESULT.split(", ")]
    types = [{"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(),
              "double": pa.float64()}[f.split()[1]] for f in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = _vocabularies(*paths)
        for b in pieces(batches, "text"):
            rows = [judge(t, vocabularies, bands) for t in b.column("text").to_pylist()]
            columns = [b.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows), types[1:]))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(*pairs(id_col, text_col)).mapInArrow(run, RESULT)


def keep_good(docs: DataFrame, text_col: str = "text", bands: dict[str, Band] = BANDS,
              byte_bpe: str | None = None, piece_bpe: str | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is kept."""
    paths = _paths(byte_bpe, piece_bpe)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = _vocabularies(*paths)
        for b in pieces(batches, at):
            kept = [judge(t, vocabularies, bands)[6] for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

"""SentencePiece BPE encoding by backtracking over longest matches, and decoding.

A BPE encoding is the one sequence of pieces whose neighbours are compatible:
merging the characters of two neighbours by the vocabulary's scores must give
the two back.  So the pieces of a text can be found from left to right without
a merge queue:

1. An Aho-Corasick automaton lists the pieces that begin at each position.
2. The longest one that is compatible with the piece before it is taken; shorter
   ones are tried next, and if none fits, the position is marked in a bitfield
   of failed positions (a prefix has one encoding only, so the mark holds for
   good) and the piece before is shortened.
3. Compatibility re-merges the two pieces: their merges are undone from the
   last to the first, and a pair across the border that would have been merged
   earlier shows that they do not stand side by side.  Where scores are tied
   (runs of blanks) or a piece is not built by ever later merges, the
   characters of both are merged literally.

Each position is visited a bounded number of times, so time grows with the
length of a text, whether it has blanks or not.  Blanks begin pieces or fill
them (checked on the vocabulary), so a text is cut before each run of blanks
and the ids of its parts are remembered; a vocabulary without that property is
encoded in whole texts.

Defined cases: a null text is the empty text: begin and end id alone, decoded
as empty; characters outside the vocabulary become their UTF-8 bytes; U+2581
in a text is a blank, as in the library; repeated rows get equal results; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from costmart.llm.common import pairs, pieces

BLANK = "▁"
#: Parts of texts that a worker remembers (choices: four times as many), and their greatest length.
REMEMBERED, LONGEST_REMEMBERED = 400_000, 64
#: Positions whose matches are listed at a time.
WINDOW = 4096
NORMAL, CONTROL, UNKNOWN, BYTE = 1, 3, 2, 6      # piece types of the file format


def trim(known: dict, most: int) -> None:
    """Forget the older half of a full memory."""
    if len(known) > most:
        for key in list(known)[:len(known) - most // 2]:
            del known[key]


class Pieces:
    """The pieces of a vocabulary file, and how the library's merges build them."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as model_pb2
        model = model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules = model.normalizer_spec
        if (model.trainer_spec.model_type != 2 or rules.precompiled_charsmap
                or rules.remove_extra_whitespaces or not rules.add_dummy_prefix
                or model.trainer_spec.treat_whitespace_as_suffix
                or {p.type for p in model.pieces} - {NORMAL, CONTROL, UNKNOWN, BYTE}):
            raise ValueError("only BPE vocabularies with the identity normaliser and a blank "
                             "put in front are supported")
        library = SentencePieceProcessor(model_file=path)
        self.begin, self.end = library.bos_id(), library.eos_id()
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.spelled: list[bytes | None] = []   # None: control pieces are not spelled
        self.is_byte = []
        byte_ids = {}
        for i, p in enumerate(model.pieces):
            self.is_byte.append(p.type == BYTE)
            if p.type == BYTE:
                byte_ids[int(p.piece[3:5], 16)] = i
                self.spelled.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == UNKNOWN:
                self.spelled.append(model.trainer_spec.unk_surface.encode())
            else:
                self.spelled.append(None if p.type == CONTROL
                                    else p.piece.replace(BLANK, " ").encode())
        self._byte_ids = [byte_ids[b] for b in range(256)]
        self.codes = {p: i.to_bytes(4, "little") for i, p in enumerate(
            p.piece if p.type == NORMAL else "" for p in model.pieces) if p}

        # Ranks: the best score first.  Pieces of equal score share a rank and are "tied".
        ranks = {s: i for i, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.rank = {p: ranks[s] for p, s in self.score.items() if len(p) > 1}
        seen: dict[int, int] = {}
        for r in self.rank.values():
            seen[r] = seen.get(r, 0) + 1
        self.born: dict[str, int] = {}
        self.halves: dict[str, tuple[str, str]] = {}
        self.literal: set[str] = set()
        self.automaton = ahocorasick.Automaton()
        self.longest = 1
        for p in sorted(self.rank, key=lambda p: self.rank[p]):
            merged, last = self.merge(p)
            if merged != [p]:
                continue                         # no text is ever merged to this piece
            self.halves[p], self.born[p] = last, self.rank[p]
            if seen[self.rank[p]] > 1 or any(
                    len(h) > 1 and (h in self.literal or self.born.get(h, 1 << 60) >= self.rank[p])
                    for h in last):
                self.literal.add(p)
            self.automaton.add_word(p, (len(p) - 1, p))
            self.longest = max(self.longest, len(p))
        self.automaton.make_automaton()
        # The next shorter piece with which a piece begins; a character alone is always one.
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 1, -1) if p[:n] in self.born),
                                p[0]) for p in self.born}
        self.cuts = all(BLANK not in p.lstrip(BLANK) and (p[0] != BLANK or p[1] != BLANK
                                                          or not p.strip(BLANK))
                        for p in self.born)
        # Marks that no piece has after an ASCII letter: a text may be cut there too.
        joined = {b for p in self.born for a, b in zip(p, p[1:]) if a.isascii() and a.isalpha()}
        marks = re.escape("".join(c for c in string.punctuation + "\n" if c not in joined))
        self.parts = re.compile(
            (f"{BLANK}*[A-Za-z]+(?=[{marks}])|" if marks else "")
            + f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")

    def byte_codes(self, character: str) -> bytes:
        """Ids of the UTF-8 bytes of a character, little-endian unsigned 32-bit."""
        return np.array([self._byte_ids[b] for b in character.encode()], "<u4").tobytes()

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The pieces that merging by score makes of a short text, and the last merge."""
        parts, last = list(text), None
        while len(parts) > 1:
            best = None
            for i, (a, b) in enumerate(zip(parts, parts[1:])):
                r = self.rank.get(a + b)
                if r is not None and (best is None or r < best[0]):
                    best = (r, i)
            if best is None:
                break
            i = best[1]
            last = (parts[i], parts[i + 1])
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts, last

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging the characters of ``a + b`` gives the pieces ``a`` and ``b``."""
        if a in self.literal or b in self.literal:
            return self.merge(a + b)[0] == [a, b]
        rank, born, limit = self.rank, self.born, 1 << 60
        while True:
            r = rank.get(a + b)
            if r is not None and r < limit:
                return False
            at_a, at_b = born.get(a, -1), born.get(b, -1)
            if at_a > at_b:
                limit, a = at_a, self.halves[a][1]
            elif at_b >= 0:                      # of equal pieces the left one is made first
                limit, b = at_b + 1, self.halves[b][0]
            else:
                return True


class Encoder:
    """Encodes and decodes texts; ids of short parts are remembered."""

    def __init__(self, vocabulary: Pieces):
        self.pieces = vocabulary
        self._choices: dict[str, dict[str, tuple[str, dict]]] = {"": {}}
        self._n_choices = 0
        self._parts: dict[str, bytes] = {}

    def _longest(self, text: str, start: int) -> list[str]:
        """The longest piece that begins at each position of a window."""
        part = text[start:start + WINDOW]
        longest = list(part)
        if len(text) <= WINDOW:
            for at, (back, piece) in self.pieces.automaton.iter(text):
                longest[at - back] = piece       # ends ascend, so the longest comes last
        else:
            part = text[start:start + WINDOW + self.pieces.longest - 1]
            for at, (back, piece) in self.pieces.automaton.iter(part):
                if at - back < len(longest):
                    longest[at - back] = piece
        return longest

    def _longest_at(self, text: str, pos: int) -> str:
        """The same for one position, met again before the window."""
        part = text[pos:pos + self.pieces.longest]
        return max([p for at, (back, p) in self.pieces.automaton.iter(part) if at == back],
                   key=len, default=text[pos])

    def _first(self, after: dict, previous: str, piece: str) -> tuple[str, dict]:
        """The longest piece that ``piece`` begins with and ``previous`` bears, "" if there is none.

        With it comes the memory of what may follow it.
        """
        choice, compatible = piece, self.pieces.compatible
        while previous and not compatible(previous, choice):
            if len(choice) == 1:
                choice = ""
                break
            choice = self.pieces.shorter[choice]
        found = after[piece] = (choice, self._choices.setdefault(choice, {}))
        self._n_choices += 1
        return found

    def split(self, text: str) -> list[str]:
        """The pieces of a text whose blanks are U+2581."""
        if not text:
            return []
        if self._n_choices > 4 * REMEMBERED:
            self._choices, self._n_choices = {"": {}}, 0
        choices, shorter, size = self._choices, self.pieces.shorter, len(text)
        window, longest = 0, self._longest(text, 0)
        failed = None                            # the bitfield of failed positions
        out: list[str] = []
        pos, after, piece = 0, choices[""], longest[0]
        while True:
            found = after.get(piece)
            if found is None:
                found = self._first(after, out[-1] if out else "", piece)
            choice, following = found
            end = pos + len(choice)
            if choice and (failed is None or not failed[end >> 3] >> (end & 7) & 1):
                out.append(choice)
                if end == size:
                    return out
                pos, after = end, following
                if pos >= window + WINDOW:
                    window, longest = pos, self._longest(text, pos)
                piece = longest[pos - window] if pos >= window else self._longest_at(text, pos)
            else:
                if failed is None:
                    failed = bytearray(size // 8 + 1)
                while len(choice) < 2:           # nothing fits here: the piece before is wrong
                    failed[pos >> 3] |= 1 << (pos & 7)
                    choice = out.pop()
                    pos -= len(choice)
                after = choices[out[-1] if out else ""]
                piece = shorter[choice]

    def _part(self, part: str) -> bytes:
        codes, split = self.pieces.codes, self.split(part)
        try:
            return b"".join([codes[p] for p in split])
        except KeyError:                         # a character outside the vocabulary: its bytes
            return b"".join([codes[p] if p in codes else self.pieces.byte_codes(p) for p in split])

    def encode(self, texts: Iterable[str], ends: bool = True) -> list[bytes]:
        """Ids of each text, little-endian unsigned 32-bit, with begin and end id if ``ends``."""
        first, last = (np.array([i], "<u4").tobytes() if ends else b""
                       for i in (self.pieces.begin, self.pieces.end))
        known, out = self._parts, []
        for text in texts:
            text = (BLANK + text).replace(" ", BLANK) if text else ""
            parts = self.pieces.parts.findall(text) if self.pieces.cuts else [text]
            long = {}
            for p in set(parts).difference(known):
                ids = self._part(p)
                (known if len(p) <= LONGEST_REMEMBERED else long)[p] = ids
            if long:
                body = b"".join([known[p] if p in known else long[p] for p in parts])
            else:
                body = b"".join([known[p] for p in parts])
            out.append(first + body + last)
            trim(known, 4 * REMEMBERED)
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids: control pieces are silent, one leading blank is dropped."""
        listed = np.frombuffer(ids, "<u4").tolist()
        spelled = self.pieces.spelled
        first, last = 0, len(listed)
        while first < last and spelled[listed[first]] is None:
            first += 1
        while first < last and spelled[listed[last - 1]] is None:
            last -= 1
        if first == last:
            return ""
        listed = listed[first:last]
        try:
            text = b"".join([spelled[i] for i in listed]).decode()
        except (TypeError, UnicodeDecodeError):  # a control piece between others, or odd bytes
            text = self._decode_loose(listed)
        # The blank that encoding puts in front belongs to the first piece, not to a byte.
        if not self.pieces.is_byte[listed[0]] and text.startswith(" "):
            text = text[1:]
        return text

    def _decode_loose(self, ids: list[int]) -> str:
        """Runs of byte pieces decoded on their own; each byte that fits nowhere is U+FFFD."""
        out, run = [], b""
        for i in [*ids, None]:
            if i is not None and self.pieces.is_byte[i]:
                run += self.pieces.spelled[i]
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[:n].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    n = 1
                    out.append("�")
                run = run[n:]
            if i is not None:
                out.append((self.pieces.spelled[i] or b"").decode())
        return "".join(out)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """This worker's encoder of a vocabulary file."""
    return Encoder(Pieces(path))


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
           outputs: bool = True) -> DataFrame:
    """doc_id, n_tokens and digests of every row; with ``outputs`` the ids and the decoded text."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if outputs:
        schema += ", ids binary, decoded string"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for b in pieces(batches, "text"):
            ids = coder.encode(t or "" for t in b.column("text").to_pylist())
            decoded = [coder.decode(i) for i in ids]
            columns = [
                b.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()),
                pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string())]
            if outputs:
                columns += [pa.array(ids, pa.binary()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(*pairs(id_col, text_col)).mapInArrow(run, schema)

"""SentencePiece encoding and decoding: exact merge-type encoding by backtracking.

An encoding is a chain of vocabulary tokens. Merging symbol pairs by priority is local, so a chain is the encoding of a
text exactly if every token merges to itself and every adjacent pair, merged again from its characters, gives back that
pair. The encoder walks the text with the longest match at each place (Aho-Corasick), takes the next shorter prefix where
a neighbour isn't compatible, and steps back otherwise; a bitfield of failed positions makes it linear. No vocabulary
entry has a word mark after another character (checked when the model is read), so a text falls into independent segments
there, and into smaller ones if none joins letters with digits or signs either; segments are cached in the worker up to a bound.

Edge cases: null counts as empty; an empty text has only the begin and end ids; a character outside the vocabulary is
its UTF-8 bytes; extra columns are ignored; very long segments aren't cached; repeated rows repeat.
"""

from __future__ import annotations

import hashlib
import re
import sys
from array import array

import ahocorasick
import numpy as np
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from .common import held, map_rows

MARK = "▁"
#: Bounds of the caches in one worker: segments, their characters, token pairs.
MAX_SEGMENTS, MAX_SEGMENT_CHARS, MAX_PAIRS = 100_000, 48, 200_000
UNKNOWN_SURFACE = " ⁇ "


def kind(c: str) -> str:
    """Word mark, letter, digit or other."""
    return "mark" if c == MARK else "digit" if c.isdigit() or c.isdecimal() else "letter" if re.match(r"[^\W\d_]", c) else "other"


class Codec:
    """Encoder and decoder over the vocabulary of a BPE model file with byte fallback.

    Inside the encoder a token is a vocabulary id, or the vocabulary size plus the code point of a character outside it.
    """

    def __init__(self, model_file: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.begin, self.end, self.unknown, self.size = model.bos_id(), model.eos_id(), model.unk_id(), model.vocab_size()
        self.ids, self.score, self.surface, self.byte_ids, self.of_byte = {}, {}, [], [0] * 256, {}
        self.matcher = ahocorasick.Automaton()
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.of_byte[i] = i, value
                self.surface.append(bytes([value]))
            elif model.is_control(i):
                self.surface.append(b"")
            elif model.is_unknown(i):
                self.surface.append(UNKNOWN_SURFACE.encode())
            else:
                self.ids[piece], self.score[piece] = i, model.get_score(i)
                self.surface.append(piece.replace(MARK, " ").encode())
        self.piece = {i: p for p, i in self.ids.items()}
        for p, i in self.ids.items():
            if len(p) == 1 or self.merged(p) == [p]:  # some entries are never produced
                self.matcher.add_word(p, (len(p), i))
        self.matcher.make_automaton()
        joined = {(kind(x), kind(y)) for p in self.ids for x, y in zip(p, p[1:])}
        if joined <= {("mark", k) for k in ("mark", "letter", "digit", "other")} | {("letter", "letter"), ("other", "other")}:
            self.segments = re.compile(f"{MARK}+(?:[^\\W\\d_{MARK}]+|\\d|(?:[^\\w{MARK}]|_)+)?|[^\\W\\d_{MARK}]+|\\d|(?:[^\\w{MARK}]|_)+")
        elif all(y != "mark" or x == "mark" for x, y in joined):
            self.segments = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        else:
            raise ValueError("a vocabulary entry has a word mark after another character: segments would not be independent")
        self.pairs: dict[int, bool] = {}
        self.shorter: dict[int, int] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def text(self, token: int) -> str:
        return self.piece[token] if token < self.size else chr(token - self.size)

    def merged(self, text: str) -> list[str]:
        """The symbols left after joining, again and again, the leftmost adjacent pair of the highest score."""
        symbols = list(text)
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = self.score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens, merged again from their characters, give back just those two."""
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        x, y = self.text(left), self.text(right)
        found = self.pairs[left << 32 | right] = self.merged(x + y) == [x, y]
        return found

    def prefix(self, token: int) -> int:
        """The longest proper prefix that is a usable token; -1 for one character."""
        found = self.shorter.get(token)
        if found is None:
            text = self.text(token)
            found = next((self.matcher.get(text[:n], (0, -1))[1] for n in range(len(text) - 1, 0, -1) if self.matcher.exists(text[:n])), -1)
            if found < 0 and len(text) > 1:
                found = self.size + ord(text[0])
            self.shorter[token] = found
        return found

    def tokens(self, segment: str) -> list[int]:
        """The tokens of a segment by backtracking."""
        length, pairs = len(segment), self.pairs
        size, token_at = [1] * length, [-1] * length
        for last, (n, i) in self.matcher.iter(segment):
            start = last - n + 1
            if token_at[start] < 0 or n > size[start]:
                size[start], token_at[start] = n, i
        failed = bytearray(length + 1)
        out: list[int] = []
        ends: list[int] = []
        at = 0
        while at < length:
            token, n = token_at[at], size[at]
            if token < 0:
                token = self.size + ord(segment[at])
            before = out[-1] if out else -1
            while True:
                if token >= 0 and not failed[at + n]:
                    if before < 0:
                        break
                    fits = pairs.get(before << 32 | token)
                    if fits or fits is None and self.compatible(before, token):
                        break
                if token >= 0:
                    token = self.prefix(token)
                if token < 0:  # nothing fits here: step back and shorten the token before
                    failed[at] = 1
                    token = out.pop()
                    ends.pop()
                    at = ends[-1] if ends else 0
                    before = out[-1] if out else -1
                    token = self.prefix(token)
                n = len(self.piece[token]) if 0 <= token < self.size else 1
            out.append(token)
            at += n
            ends.append(at)
        return out

    def packed(self, segment: str) -> bytes:
        found = self.older.get(segment)
        if found is None:
            ids: list[int] = []
            for t in self.tokens(segment):
                if t < self.size:
                    ids.append(t)
                else:
                    ids.extend(self.byte_ids[b] for b in chr(t - self.size).encode())
            found = array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()
        if len(segment) <= MAX_SEGMENT_CHARS:
            if len(self.known) >= MAX_SEGMENTS:  # two generations: what is used again moves to the young one
                self.older, self.known = self.known, {}
            self.known[segment] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """The ids, begin and end included, as little-endian unsigned 32-bit integers."""
        body = MARK + text.replace(" ", MARK) if text else ""
        known = self.known.get
        parts = [known(s) or self.packed(s) for s in self.segments.findall(body)]
        return b"".join((self.begin.to_bytes(4, "little"), *parts, self.end.to_bytes(4, "little")))

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 text of packed ids. The first piece loses its word mark; a byte that is no part of a character is U+FFFD."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        raw = b"".join(map(self.surface.__getitem__, numbers))
        first = next((i for i in numbers if self.surface[i]), None)
        cut = 1 if first is not None and first not in self.of_byte and first != self.unknown and raw[:1] == b" " else 0
        try:
            raw.decode()
        except UnicodeDecodeError:
            raw = self.repaired(numbers)
        return raw[cut:]

    def repaired(self, numbers: list[int]) -> bytes:
        out, run = [], bytearray()
        for i in [*numbers, None]:
            if i in self.of_byte:
                run.append(self.of_byte[i])
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[:n]).decode().encode())
                        del run[:n]
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�".encode())
                    del run[:1]
            if i is not None:
                out.append(self.surface[i])
        return b"".join(out)


def codec(model_file: str) -> Codec:
    """One codec for each worker process and model."""
    return held(model_file, lambda: Codec(model_file))


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ids (packed little-endian unsigned 32-bit), decoded (UTF-8 text of those ids)."""

    def make():
        c = codec(model_file)

        def work(b):
            ids = [c.encode(t) for t in b["t"]]
            return {id_col: b["i"], "ids": ids, "decoded": [c.decode(x).decode() for x in ids]}

        return work

    return map_rows(docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")), make, f"{id_col} long, ids binary, decoded string")


def encode_digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256, without moving ids or texts out of the worker."""

    def make():
        c = codec(model_file)

        def work(b):
            ids = [c.encode(t) for t in b["t"]]
            return {
                id_col: b["i"],
                "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(c.decode(x)).hexdigest() for x in ids],
            }

        return work

    return map_rows(docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")), make, f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string")

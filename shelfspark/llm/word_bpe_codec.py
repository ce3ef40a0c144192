"""BPE encoding and decoding: speculate and verify.

A text is normalised and split into words as the tokenizer's file says. Words that a worker hasn't met are worked out
together, as one flat array of bytes:

1. speculate: greedy longest matches. All places walk a trie of the vocabulary in step; then all words hop from token to
   token in step.
2. verify: every adjacent pair is tested at once. Merges are ordered so that a part always comes before the token that it is
   joined into, so a merge across the border of a pair happens exactly if the pair's inner ends, at some time before either
   is joined into more, form an earlier merge. The test undoes the later of the two again and again. Tokens that can't be
   made from their own characters aren't proposed. A chain of makeable tokens whose pairs all hold is the encoding.
3. only words with a failing pair undergo exact merging, lowest rank first, leftmost of equal ones.

Edge cases: null counts as empty; an empty text has no ids and decodes to an empty text; repeated rows repeat; extra columns
are ignored; special tokens' strings in a text are those tokens, as the library has it. Decoding joins the tokens' strings by
one space: the file names no decoder. Texts are worked on in stretches cut at white space, so memory is a multiple of the
longest run without white space (or of a stretch), not of the text; digests are fed stretch by stretch.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from .common import held, map_rows

#: Characters of a stretch; words and their characters that a worker's cache holds.
STRETCH, MAX_WORDS, MAX_WORD_CHARS = 1 << 17, 300_000, 48
#: Fixed values of the tokenizer's format: its word pattern, with letters, numbers and white space spelled out for Python's
#: matcher, and the white space of Unicode.
WORD = "'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{S}{L}{N}]+"
WORD_AS_FILED = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE = "\t-\r \x85\xa0  -     　"
END, NONE = 256, 1 << 30
NEVER = (NONE, -1)
#: Bytes of a word up to which exact merging looks through all pairs for the next one.
SHORT = 64


def byte_letters() -> list[str]:
    """The character that stands for each byte: visible Latin-1 characters for themselves, the others from U+0100 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]


def classes(stop: int) -> dict[str, str]:
    """Ranges of the letters, numbers and unassigned code points below stop, by Python's Unicode tables, as parts of a character class."""
    found: dict[str, list[list[int]]] = {"L": [], "N": [], "C": []}
    for i in range(stop):
        kind = unicodedata.category(chr(i))
        key = "C" if kind == "Cn" else kind[0]
        if key in found and (key != "C" or kind == "Cn"):
            ranges = found[key]
            if ranges and ranges[-1][1] == i - 1:
                ranges[-1][1] = i
            else:
                ranges.append([i, i])
    return {k: "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in v) for k, v in found.items()}


class Codec:
    """Encoder and decoder over a vocabulary file of byte-level BPE with word ends."""

    def __init__(self, file: str):
        self.library = Tokenizer.from_file(file)
        with open(file, encoding="utf-8") as f:
            filed = json.load(f)
        model, split = filed["model"], filed["pre_tokenizer"]["pretokenizers"][0]
        steps = [n["type"] for n in filed["normalizer"]["normalizers"]]
        if steps != ["NFC", "Replace", "Lowercase"] or split["pattern"] != {"Regex": WORD_AS_FILED} or filed["decoder"] or model["byte_fallback"] or model["ignore_merges"]:
            raise ValueError("another kind of tokenizer than the one this codec is made for")
        special = {t["content"]: t["id"] for t in filed["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")")
        every, basic = classes(0x110000), classes(0x10000)
        self.wide_words, self.words = (re.compile(WORD.format(L=x["L"], N=x["N"], S=SPACE)) for x in (every, basic))
        # classes of the basic plane are looked up in one table: the others are for texts that need them
        self.spaces, self.unusual, self.unsettled = re.compile(f"[{SPACE}]"), re.compile(f"[{basic['C']}\\U00010000-\\U0010ffff]"), re.compile(f"[{every['C']}]")
        self.vocabulary(model, special)
        self.known: dict[str, tuple[int, str, str]] = {w: (1, str(i), w) for w, i in special.items()}
        self.kept, self.older = dict(self.known), {}
        self.long: list[str] = []

    def vocabulary(self, model: dict, special: dict[str, int]) -> None:
        ids, letters = model["vocab"], byte_letters()
        byte_of, end = {c: b for b, c in enumerate(letters)}, model["end_of_word_suffix"]
        size = max([*ids.values(), *special.values()]) + 1
        self.name = [""] * size
        for w, i in [*ids.items(), *special.items()]:
            self.name[i] = w
        codes = {w: [byte_of[c] for c in (w.removesuffix(end) if w.endswith(end) and w != end else w)] + [END] * (w.endswith(end) and w != end) for w in ids}
        single = np.full((256, 2), -1)  # the token of a byte inside and at the end of a word
        for w, c in codes.items():
            if len(c) == 1 or len(c) == 2 and c[1] == END:
                single[c[0], len(c) - 1] = ids[w]
        if (single < 0).any():
            raise ValueError("a byte has no token")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        pairs = np.array([(ids[a], ids[b]) for a, b in merges], np.int64)
        made = np.array([ids[a + b] for a, b in merges], np.int64)
        self.rank, self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        if len(np.unique(made)) < len(made):
            raise ValueError("two merges make one token")
        self.rank[made], self.left[made], self.right[made] = np.arange(len(made)), pairs[:, 0], pairs[:, 1]
        if (self.rank[pairs].max(1) >= np.arange(len(made))).any():
            raise ValueError("a merge comes before one that makes its parts")
        keys = pairs[:, 0] * size + pairs[:, 1]
        order = np.argsort(keys)
        self.singles = single[:, 0].tolist(), single[:, 1].tolist()
        self.size, self.pair_keys, self.pair_rank, self.single = size, keys[order], order, single
        self.merge = {(a, b): (r, m) for r, ((a, b), m) in enumerate(zip(pairs.tolist(), made.tolist(), strict=True))}
        holds, good = self.compatible(pairs[:, 0], pairs[:, 1], made), np.zeros(size, bool)
        good[single] = True
        for (a, b), m, fine in zip(pairs.tolist(), made.tolist(), holds.tolist(), strict=True):
            good[m] = fine and good[a] and good[b]
        self.trie([(codes[w], i) for w, i in ids.items() if good[i]])

    def trie(self, entries: list[tuple[list[int], int]]) -> None:
        nodes: dict[tuple[int, int], int] = {}
        token = [-1]
        for codes, i in entries:
            at = 0
            for c in codes:
                step = nodes.get((at, c))
                if step is None:
                    step = nodes[at, c] = len(token)
                    token.append(-1)
                at = step
            token[at] = i
        keys = np.array([a * 257 + c for a, c in nodes], np.int64)
        order = np.argsort(keys)
        self.edge_keys, self.edge_to, self.token_at = keys[order], np.array(list(nodes.values()), np.int64)[order], np.array(token, np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair; NONE if there is none."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_rank[at], NONE)

    def compatible(self, left: np.ndarray, right: np.ndarray, into: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge crosses the border of each pair; with into, none before the merge that makes that token.

        Both ends start whole. A merge of the two crosses if it is earlier than what the left end is joined into, and not
        later than what the right end is joined into (of equal merges the leftmost comes first). Then the end that was made
        later is undone: before that merge, its inner part stood at the border.
        """
        out, which = np.ones(len(left), bool), np.arange(len(left))
        a, b = left.copy(), right.copy()
        until_a = self.rank[into].copy() if into is not None else np.full(len(a), NONE - 1)
        until_b = until_a - 1 if into is not None else until_a.copy()
        while len(which):
            found = self.ranks(a, b)
            crossed = (found < until_a) & (found <= until_b)
            out[which[crossed]] = False
            rank_a, rank_b = self.rank[a], self.rank[b]
            go = ~crossed & ((rank_a >= 0) | (rank_b >= 0))
            which, a, b, until_a, until_b, rank_a, rank_b = (x[go] for x in (which, a, b, until_a, until_b, rank_a, rank_b))
            undo = rank_a > rank_b
            # one merge made both: the left one was made first, so the right one is undone first
            until_a, until_b = np.where(undo, rank_a, until_a), np.where(undo, until_b, rank_b)
            a, b = np.where(undo, self.right[a], a), np.where(undo, b, self.left[b])
        return out

    def speculated(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all words: the word and the token of each proposal, in order."""
        sizes = np.array([len(w) + 1 for w in words])
        ends = np.cumsum(sizes)
        codes = np.zeros(ends[-1], np.int64)
        inner = np.ones(ends[-1], bool)
        inner[ends - 1] = False
        codes[inner] = np.frombuffer(b"".join(words), np.uint8)
        codes[ends - 1] = END
        place_end = np.repeat(ends, sizes)
        best, step = np.full(len(codes), -1), np.zeros(len(codes), np.int64)
        place, node, depth = np.flatnonzero(inner), np.zeros(inner.sum(), np.int64), 0
        while len(place):
            keys = node * 257 + codes[place + depth]
            at = np.minimum(np.searchsorted(self.edge_keys, keys), len(self.edge_keys) - 1)
            on = self.edge_keys[at] == keys
            place, node, depth = place[on], self.edge_to[at[on]], depth + 1
            token, stop = self.token_at[node], place + depth
            # the word's last byte carries the word's end: a token can't stop between the two
            hit = (token >= 0) & (stop != place_end[place] - 1)
            best[place[hit]], step[place[hit]] = token[hit], depth
            more = stop < place_end[place]
            place, node = place[more], node[more]
        at, which, out = ends - sizes, np.arange(len(words)), []
        while len(which):
            out.append((which, best[at]))
            at = at + step[at]
            on = at < ends[which]
            at, which = at[on], which[on]
        word, token = np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])
        order = np.argsort(word, kind="stable")
        return word[order], token[order]

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: the lowest rank first, the leftmost of equal ones."""
        inner, last = self.singles
        tokens = [inner[b] for b in word[:-1]] + [last[word[-1]]]
        if len(word) > SHORT:
            return self.merged_long(tokens)
        merge = self.merge.get
        ranks = [merge(p, NEVER)[0] for p in zip(tokens, tokens[1:])]
        while ranks and (best := min(ranks)) < NONE:
            i = ranks.index(best)
            tokens[i : i + 2] = [merge((tokens[i], tokens[i + 1]))[1]]
            del ranks[i]
            if i:
                ranks[i - 1] = merge((tokens[i - 1], tokens[i]), NEVER)[0]
            if i < len(ranks):
                ranks[i] = merge((tokens[i], tokens[i + 1]), NEVER)[0]
        return tokens

    def merged_long(self, tokens: list[int]) -> list[int]:
        """The same with a heap, for words of any length."""
        after, before = list(range(1, len(tokens) + 1)), list(range(-1, len(tokens) - 1))
        heap = [(m[0], i) for i, pair in enumerate(zip(tokens, tokens[1:])) if (m := self.merge.get(pair))]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            m = self.merge.get((tokens[i], tokens[j])) if tokens[i] >= 0 and j < len(tokens) else None
            if not m or m[0] != rank:
                continue  # one of the two has been joined meanwhile
            tokens[i], tokens[j], after[i] = m[1], -1, after[j]
            if after[i] < len(tokens):
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < len(tokens) and (m := self.merge.get((tokens[x], tokens[y]))):
                    heapq.heappush(heap, (m[0], x))
        return [t for t in tokens if t >= 0]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The tokens of each word (not empty)."""
        if not words:
            return []
        word, token = self.speculated(words)
        same = word[1:] == word[:-1]
        pairs, back = np.unique(token[:-1][same] * self.size + token[1:][same], return_inverse=True)
        bad = np.zeros(len(words), bool)
        bad[word[1:][same][~self.compatible(pairs // self.size, pairs % self.size)[back]]] = True
        starts = np.searchsorted(word, np.arange(len(words) + 1))
        tokens, bounds = token.tolist(), starts.tolist()
        return [self.merged(w) if failed else tokens[a:b] for w, a, b, failed in zip(words, bounds[:-1], bounds[1:], bad.tolist(), strict=True)]

    def learn(self, words: set[str]) -> None:
        """Puts words into the cache: number of ids, the ids' and the tokens' strings, joined by a space."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > MAX_WORDS:  # two generations: what is used again moves to the young one
            self.older, self.known, new = self.known, dict(self.kept), [w for w in words if w not in self.kept]
        self.known.update((w, self.older[w]) for w in new if w in self.older)
        new = [w for w in new if w not in self.known]
        self.long += [w for w in new if len(w) > MAX_WORD_CHARS]
        for w, tokens in zip(new, self.encode_words([w.encode() for w in new]), strict=True):
            self.known[w] = (len(tokens), " ".join(map(str, tokens)), " ".join([self.name[t] for t in tokens]))

    def split(self, text: str) -> list[str]:
        """Normalised words of a stretch. Code points newer than Python's tables are left to the library's own tables."""
        words = self.words
        if not text.isascii():
            if self.unusual.search(text):
                if self.unsettled.search(text):
                    normal = self.library.normalizer.normalize_str(text)
                    letters = {c: b for b, c in enumerate(byte_letters())}
                    return [bytes(map(letters.__getitem__, w)).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
                words = self.wide_words
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # sigma as any other letter, also at a word's end
        return words.findall(text.lower())

    def stretches(self, text: str) -> Iterator[str]:
        """The text in parts, cut before white space."""
        start = 0
        while start < len(text):
            cut = self.spaces.search(text, start + STRETCH)
            stop = cut.start() if cut else len(text)
            yield text[start:stop] if start or stop < len(text) else text
            start = stop

    def words_of(self, text: str) -> Iterator[list[str]]:
        """The words of each stretch; special tokens as one word each."""
        for part in self.stretches(text):
            if "<|" in part and self.special.search(part):
                yield [w for i, p in enumerate(self.special.split(part)) for w in ([p] if i % 2 else self.split(p))]
            else:
                yield self.split(part)

    def encoded(self, texts: list[str | None]) -> Iterator[Iterator[list[tuple[int, str, str]]]]:
        """For each text its stretches' words as cached; the words of short texts are learned together."""
        short = [list(self.words_of(t)) if t and len(t) <= STRETCH else None for t in texts]
        self.learn({w for parts in short if parts for words in parts for w in words})
        for text, parts in zip(texts, short, strict=True):
            yield self.looked_up(parts if parts is not None else self.words_of(text or ""))

    def looked_up(self, parts) -> Iterator[list[tuple[int, str, str]]]:
        for words in parts:
            try:
                yield [self.known[w] for w in words]
            except KeyError:  # a long text's, or the cache was emptied meanwhile
                self.learn(set(words))
                yield [self.known[w] for w in words]

    def trim(self) -> None:
        """Long words don't stay in the cache."""
        for w in self.long:
            self.known.pop(w, None)
        self.long = []

    def decode(self, ids) -> str:
        return " ".join(self.name[i] for i in ids)


def codec(file: str) -> Codec:
    """One codec for each worker process and file."""
    return held(file, lambda: Codec(file))


def encode_documents(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ids, decoded (text of those ids)."""

    def make():
        c = codec(file)

        def work(b):
            ids = [[int(i) for words in parts for _, s, _ in words for i in s.split()] for parts in c.encoded(b["t"])]
            c.trim()
            return {id_col: b["i"], "ids": ids, "decoded": [c.decode(x) for x in ids]}

        return work

    return map_rows(docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")), make, f"{id_col} long, ids array<long>, decoded string")


def encode_digests(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256 (decimal ids, a space between), decoded_sha256; texts and ids don't leave the worker."""

    def make():
        c = codec(file)

        def digests(parts) -> tuple[int, str, str]:
            count, ids, decoded, gap = 0, hashlib.sha256(), hashlib.sha256(), ""
            for words in parts:
                if words:
                    count += sum([n for n, _, _ in words])
                    ids.update((gap + " ".join([s for _, s, _ in words])).encode())
                    decoded.update((gap + " ".join([s for _, _, s in words])).encode())
                    gap = " "
            return count, ids.hexdigest(), decoded.hexdigest()

        def work(b):
            found = [digests(parts) for parts in c.encoded(b["t"])]
            c.trim()
            return {id_col: b["i"], "n_tokens": [x[0] for x in found], "ids_sha256": [x[1] for x in found], "decoded_sha256": [x[2] for x in found]}

        return work

    return map_rows(docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")), make, f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string")

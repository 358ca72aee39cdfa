"""BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a word there is exactly one token that can end its encoding. It is found among the tokens that are suffixes of
the prefix (longest first, from an automaton over all tokens) by testing whether merging would keep it apart from the last token
of the shorter prefix. Following the stored tokens backwards from the end of the word gives the ids. The work is linear in the
word, needs no queue of merges, and here runs over thousands of different words at once, as numpy columns.

Texts are cut at white space; each different word of a block of texts is encoded once and kept in a table of bounded size. A text
that isn't in normal form C, or has code points that this Python's character tables don't know, is normalised and cut by the file's
own normaliser and pre-tokenizer instead, whose tables are of another version; its pieces are encoded like all others.

Edge cases: null and empty texts have no ids and decode to ''; texts of any length are encoded whole, in blocks; ids of the
added tokens are emitted where their strings stand in a text, as the tokenizers library does. Repeated rows give repeated rows;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import held
from quire.llm.words import WordTable, in_blocks, oddly_spaced

END = "</w>"
#: Fixed value: the pattern of the tokenizer file's pre-tokenizer.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
CACHE = 600_000  # words that a worker remembers, some 60 bytes each
PIECES = 20_000  # pieces of words that it remembers apart
BLOCK_BYTES = 2_000_000  # of the texts that are encoded together
CELLS = 400_000  # words times longest word that one pass handles


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next code point from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    letters = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class IntMap:
    """Integers to integers by open addressing, looked up in whole arrays; -1 where there is none."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.values = np.full(self.mask + 1, -1, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            spot = at[left]
            free = self.keys[spot] == -1
            first = np.zeros(len(left), bool)
            first[np.unique(spot, return_index=True)[1]] = True
            put = free & first
            self.keys[spot[put]], self.values[spot[put]] = keys[left[put]], values[left[put]]
            left = left[~put]
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        found = self.keys[at]
        out = self.values[at]
        odd = np.flatnonzero((found != keys) & (found != -1))
        out[found == -1] = -1
        while len(odd):
            at[odd] = (at[odd] + 1) & self.mask
            found = self.keys[at[odd]]
            out[odd] = np.where(found == keys[odd], self.values[at[odd]], -1)
            odd = odd[(found != keys[odd]) & (found != -1)]
        return out


class Codec:
    """Encodes and decodes as the tokenizer file says. The file: byte-level BPE with a word end, ids in order of merging."""

    def __init__(self, path: str, cache: int = CACHE, block: int = BLOCK_BYTES):
        self.block = block
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.path, self.letters, self.library = path, byte_of, None
        self.assigned: set[str] = set()  # characters met so far that unicodedata has a category for
        self.tokens = {i: t for t, i in vocab.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.added_cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        n = max(vocab.values()) + 1

        def symbols(t: str) -> list[int]:
            ends = t.endswith(END) and t != END
            out = [byte_of[c] for c in (t[: -len(END)] if ends else t)]
            return out[:-1] + [out[-1] + 256] if ends else out

        self.left, self.right = np.arange(n, dtype=np.int64), np.arange(n, dtype=np.int64)  # a symbol is its own halves
        pairs, made = np.empty(len(merges), np.int64), np.empty(len(merges), np.int64)
        for k, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.left[z], self.right[z], pairs[k], made[k] = x, y, x << 17 | y, z
        if (np.diff(made) <= 0).any():
            raise ValueError("ids aren't in order of merging")
        self.pairs = IntMap(pairs, made)
        self._automaton({i: symbols(t) for t, i in vocab.items()}, n)
        self.table = WordTable(2, cache)
        self.pieces: dict[str, tuple[bytes, bytes]] = {}
        self.decimals = {i: b"%d " % i for i in self.tokens}
        self.spaced = {i: f"{t} ".encode() for i, t in self.tokens.items()}

    def _automaton(self, spelled: dict[int, list[int]], n: int) -> None:
        edges: dict[int, int] = {}
        depth, token_at, state_of = [0], [-1], np.zeros(n, np.int64)
        self.length = np.zeros(n, np.int64)
        for i, spelling in spelled.items():
            at = 0
            for c in spelling:
                key = at << 9 | c
                if key not in edges:
                    edges[key] = len(depth)
                    depth.append(depth[at] + 1)
                    token_at.append(-1)
                at = edges[key]
            token_at[at], state_of[i], self.length[i] = i, at, len(spelling)
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        to = np.fromiter(edges.values(), np.int64, len(edges))
        self.edges, self.fail = IntMap(keys, to), np.zeros(len(depth), np.int64)
        self.longest = np.array(token_at, np.int64)
        level = np.array(depth)[to]
        for d in range(2, int(level.max(initial=1)) + 1):  # each level's links follow from the levels above
            now = level == d
            self.fail[to[now]] = self._step(self.fail[keys[now] >> 9], keys[now] & 511)
        for d in range(1, int(level.max(initial=1)) + 1):
            now = to[level == d]
            self.longest[now] = np.where(self.longest[now] < 0, self.longest[self.fail[now]], self.longest[now])
        self.shorter = self.longest[self.fail[state_of]]  # of each token, the longest token that is a proper suffix of it

    def _step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        out, left, at = np.zeros(len(state), np.int64), np.arange(len(state)), state.copy()
        while len(left):
            to = self.edges.get(at << 9 | symbol[left])
            out[left] = np.maximum(to, 0)
            on = (to < 0) & (at != 0)
            left, at = left[on], self.fail[at[on]]
        return out

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether BPE leaves each pair of neighbouring tokens as it is: undo both sides' merges, latest first, and see that at no point an earlier merge across the border was possible."""
        out = np.ones(len(first), bool)
        a, b, limit, left = first.astype(np.int64), second.astype(np.int64), np.full(len(first), 1 << 40, np.int64), np.arange(len(first))
        while len(left):
            across = self.pairs.get(a << 17 | b)
            bad = (across >= 0) & (across < limit)
            out[left[bad]] = False
            # undo the later of the two merges; at a tie the right one, which came last
            undo_a = a > b
            a2, b2 = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
            limit2 = np.where(undo_a, a, b + 1)
            stuck_a, stuck_b = undo_a & (a2 == a), ~undo_a & (b2 == b)
            # a symbol can't be undone: turn to the other side, and end where that is a symbol, too
            b3, a3 = np.where(stuck_a, self.left[b], b2), np.where(stuck_b, self.right[a], a2)
            limit2 = np.where(stuck_a, b + 1, np.where(stuck_b, a, limit2))
            done = (stuck_a & (b3 == b)) | (stuck_b & (a3 == a))
            go = ~bad & ~done
            left, a, b, limit = left[go], a3[go], b3[go], limit2[go]
        return out

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word (bytes, not empty), as one piece of the pre-tokenizer."""
        out: list = [None] * len(words)
        order = sorted(range(len(words)), key=lambda k: -len(words[k]))
        at = 0
        while at < len(order):
            take = order[at : at + max(1, CELLS // len(words[order[at]]))]
            at += len(take)
            for k, ids in zip(take, self._solve([words[k] for k in take]), strict=True):
                out[k] = ids
        return out

    def _solve(self, words: list[bytes]) -> list[np.ndarray]:
        """words: longest first."""
        size = np.array([len(w) for w in words])
        wide = int(size[0])
        cells = np.zeros((len(words), wide), np.int64)
        cells[np.arange(wide)[None, :] < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        cells[np.arange(len(words)), size - 1] += 256
        last = np.full((len(words), wide + 1), -1, np.int32)
        state = np.zeros(len(words), np.int64)
        for i in range(wide):
            m = int(np.searchsorted(-size, -i, side="left"))  # words with more than i bytes
            state[:m] = self._step(state[:m], cells[:m, i])
            left, token = np.arange(m), self.longest[state[:m]]
            while len(left):
                before = last[left, i + 1 - self.length[token]].astype(np.int64)
                fits = before < 0
                ask = np.flatnonzero(~fits)
                fits[ask] = self.compatible(before[ask], token[ask])
                last[left[fits], i + 1] = token[fits]
                left, token = left[~fits], self.shorter[token[~fits]]
        back = np.zeros((len(words), wide), np.int32)  # tokens from the last to the first
        left, at, n = np.arange(len(words)), size.copy(), np.zeros(len(words), np.int64)
        step = 0
        while len(left):
            back[left, step] = last[left, at[left]]
            at[left] -= self.length[back[left, step]]
            n[left] += 1
            left, step = left[at[left] > 0], step + 1
        return [row[k - 1 :: -1] for row, k in zip(back[:, :step].tolist(), n.tolist(), strict=True)]

    def _spaced_words(self, text: str) -> str:
        """Words with single spaces between them whose encodings, one after the other, are the text's; a carriage return marks an added token, a tab a whole piece."""
        if self.added_cut and any(a in text for a in self.added):
            parts = self.added_cut.split(text)
            return " ".join([w for k, part in enumerate(parts) if (w := "\r" + part if k % 2 else self._plain(part))])
        return self._plain(text)

    def _plain(self, text: str) -> str:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text) or self._has_unassigned(text):
                return self._cut_by_library(text)
            text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()  # a final sigma isn't told apart
        else:
            text = text.lower()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space for str.split, not for the tokenizer
            return " ".join(regex.findall(r"(?:[^\s]|[\x1c-\x1f])+", text))
        return " ".join(text.split())

    def _has_unassigned(self, text: str) -> bool:
        """Whether some code point is without a category in unicodedata. Of texts in normal form, the tokenizer may cut only these otherwise."""
        for c in set(text).difference(self.assigned):
            if unicodedata.category(c) == "Cn":
                return True
            self.assigned.add(c)
        return False

    def _cut_by_library(self, text: str) -> str:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return " ".join(["\t" + bytes(map(self.letters.__getitem__, piece)).decode() for piece, _ in found])

    def _learn(self, words: list[str]) -> list[list[bytes]]:
        """Decimal ids and tokens of words, a space after each; all new pieces are encoded at once."""
        parts = [(w,) if w.isalpha() else (w[1:],) if w[0] in "\r\t" else PIECE.findall(w) for w in words]
        if len(self.pieces) > PIECES:
            self.pieces = {}
        own = dict(self.pieces)
        todo = list({p for ps in parts for p in ps}.difference(own))
        decimal, spaced = self.decimals.__getitem__, self.spaced.__getitem__
        for p, ids in zip(todo, self.encode_words([p.encode() for p in todo]) if todo else [], strict=True):
            own[p] = b"".join(map(decimal, ids)), b"".join(map(spaced, ids))
        self.pieces.update((p, own[p]) for ps in parts if len(ps) > 1 for p in ps)
        out: list[list[bytes]] = [[], []]
        for w, ps in zip(words, parts, strict=True):
            if w[0] == "\r":
                i = self.added[w[1:]]
                got = [(self.decimals[i], self.spaced[i])]
            else:
                got = [own[p] for p in ps]
            for k in (0, 1):
                out[k].append(got[0][k] if len(got) == 1 else b"".join([g[k] for g in got]))
        return out

    def blocks(self, texts: pa.Array) -> Iterator[tuple[bytes, bytes]]:
        """For each text its ids (decimal, joined by one space) and the decoded text in UTF-8."""
        for block in in_blocks(texts.fill_null(""), self.block):
            odd = oddly_spaced(block)
            for a in self.added:
                odd |= pc.match_substring(block, a).to_numpy(zero_copy_only=False)
            odd |= ~pc.string_is_ascii(block).to_numpy(zero_copy_only=False)
            flat = pc.ascii_lower(pc.replace_substring(block, "\n", " "))
            if odd.any():
                own = pa.array([self._spaced_words(block[k].as_py()) for k in np.flatnonzero(odd).tolist()], block.type)
                flat = pc.replace_with_mask(flat, pa.array(odd), own)
            full = np.flatnonzero(pc.binary_length(flat).to_numpy() > 0)
            out = [(b"", b"")] * len(block)
            if len(full):
                for k, ids, decoded in zip(full.tolist(), *self.table.joined(flat.take(pa.array(full)), self._learn), strict=True):
                    out[k] = ids[:-1], decoded[:-1]
            yield from out

    def encode(self, text: str | None) -> list[int]:
        return [int(x) for x in next(self.blocks(pa.array([text], pa.string())))[0].split()]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def codec(path: str, cache: int = CACHE, block: int = BLOCK_BYTES) -> Codec:
    """This worker's codec of the file."""
    return held(("bpe", path, cache, block), lambda: Codec(path, cache, block))


def encoded(docs: DataFrame, path: str, outputs: tuple[str, ...] = ("ids_sha256", "decoded_sha256"), text_col: str = "text", cache: int = CACHE, block: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens and of these the outputs: ids, decoded (the decoded text), ids_sha256 (of the decimal ids joined by one space), decoded_sha256 (of the text in UTF-8)."""
    kinds = {"ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}

    def column(name: str, got: list[tuple[bytes, bytes]]) -> pa.Array:
        if name == "ids":
            ids = [np.array(a.split(), np.int32) for a, _ in got]
            return pa.ListArray.from_arrays(np.cumsum([0, *map(len, ids)], dtype=np.int32), np.concatenate([np.zeros(0, np.int32), *ids]))
        if name == "decoded":
            return pa.array([b.decode() for _, b in got], pa.string())
        return pa.array([hashlib.sha256(a if name == "ids_sha256" else b).hexdigest() for a, b in got], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, cache, block)
        for whole in batches:
            got = own.blocks(whole.column(1))
            for at in range(0, whole.num_rows, 500):
                some = list(islice(got, 500))
                n = pa.array([a.count(b" ") + 1 if a else 0 for a, _ in some], pa.int64())
                yield pa.RecordBatch.from_arrays([whole.column(0).slice(at, 500), n, *(column(c, some) for c in outputs)], names=["doc_id", "n_tokens", *outputs])

    schema = ", ".join(["doc_id bigint", "n_tokens bigint", *(f"{c} {kinds[c]}" for c in outputs)])
    return docs.select("doc_id", F.col(text_col).alias("text")).mapInArrow(run, schema)

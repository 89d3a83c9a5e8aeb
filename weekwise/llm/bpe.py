"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A leaf holds ``rank * width + position`` of the pair that starts at its symbol (a large value where the pair has
no merge), an inner node the smaller child; so the root is the leftmost pair of lowest rank. A merge updates at most three
leaves and their paths: a word of n symbols takes O(n log n), however long it is.

The words of a slice of text that are not known yet are encoded together: words of one tree width are the rows of an array of trees, and each
round takes the root of every row that still has a pair. Words, and the stretches between blanks that they come from, keep their ids and their
decoded text once known, so a text is two joins.
"""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from ._common import map_slices

SCHEMA = "doc_id BIGINT, n_tokens BIGINT, ids ARRAY<INT>, decoded STRING"
DIGESTS = "doc_id BIGINT, n_tokens BIGINT, ids_sha256 STRING, decoded_sha256 STRING"
NONE = 1 << 62
CACHED_BYTES = 48 << 20  # of the words a worker keeps, in each of two generations; results do not depend on it
WORD_BYTES = 300  # what a known word takes besides its letters, about
SLICE_BYTES = 2 << 20  # text whose words are looked up together
TOGETHER = 64  # words of up to so many bytes are encoded together
ROWS = 1 << 14  # trees in one array
# characters whose case or order of marks changed after this Python's Unicode tables; unassigned ones count as newer too
CHANGED = {0x1DF6, 0x1E4EC, 0x1E4ED}
Key = str | bytes | int
_LOADED: dict[str, "Bpe"] = {}


def byte_letters() -> list[str]:
    """The printable letter for each byte value in byte-level vocabularies: itself where printable, else 256 upwards."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


@lru_cache(1 << 16)
def _newer(letter: str) -> bool:
    return unicodedata.category(letter) == "Cn" or ord(letter) in CHANGED


class Bpe:
    """A vocabulary file with word ends, its special tokens, and a bounded cache of encoded words."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, self.end = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        letters = byte_letters()
        self.path, self.byte_of, self.library = path, {c: b for b, c in enumerate(letters)}, None
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + self.end] for c in letters]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        # merges by sorted pair, for arrays
        pairs = np.array([a << 32 | b for a, b in self.merge], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.ranks = pairs[order], np.array([r for r, _ in self.merge.values()], np.int64)[order]
        self.made = np.zeros(max(self.ranks, default=-1) + 1, np.int64)
        self.made[self.ranks] = np.array([m for _, m in self.merge.values()], np.int64)[order]
        self.inner_of, self.last_of = np.array(self.inner, np.int64), np.array(self.last, np.int64)
        # a pattern that takes no blank finds the same words in each stretch between blanks
        self.apart = " " not in pattern and r"\s" not in pattern.replace(r"[^\s", "")
        # stretch of text, bytes of a word or id of a special token -> ids as little-endian words, decoded text; the
        # generation in use and the one before
        self.young: dict[Key, tuple[bytes, str]] = {}
        self.old: dict[Key, tuple[bytes, str]] = {}
        self.held = 0

    def encode_word(self, raw: bytes) -> tuple[int, ...]:
        """Ids of one word: merge the root of the tree until no pair has a rank."""
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        n, merge = len(ids), self.merge
        if n == 1:
            return (ids[0],)
        width = 1 << (n - 1).bit_length()
        tree = [NONE] * (2 * width)
        for i in range(n - 1):
            if hit := merge.get((ids[i], ids[i + 1])):
                tree[width + i] = hit[0] * width + i
        for node in range(width - 1, 0, -1):
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            node = width + i
            tree[node] = value
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                low = a if a < b else b
                if tree[node] == low:
                    return
                tree[node] = low
                node >>= 1

        while (root := tree[1]) < NONE:
            i = root % width
            j = after[i]
            ids[i] = merge[ids[i], ids[j]][1]
            ids[j] = -1
            k = after[i] = after[j]
            put(j, NONE)
            if k < n:
                before[k] = i
                hit = merge.get((ids[i], ids[k]))
                put(i, hit[0] * width + i if hit else NONE)
            else:
                put(i, NONE)
            if (h := before[i]) >= 0:
                hit = merge.get((ids[h], ids[i]))
                put(h, hit[0] * width + h if hit else NONE)
        return tuple(x for x in ids if x >= 0)

    def _words_by_library(self, part: str) -> list[bytes]:
        """Words of a text with characters that the local Unicode tables do not know."""
        if self.library is None:
            self.library = Tokenizer.from_file(self.path)
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
        return [bytes(self.byte_of[c] for c in piece) for piece, _ in pieces]

    def _rank_at(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        """Leaf values of pairs that start at ``at``."""
        key = left << 32 | right
        place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[place] == key, self.ranks[place] * width + at, NONE)

    def encode_rows(self, words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of 2 to ``width`` bytes, one after the other, and the number of each word: a tree per row, one merge a round."""
        many = len(words)
        size = np.array([len(w) for w in words])
        place, row = np.arange(width), np.arange(many)
        letters = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(many, width)
        ids = np.where(place < size[:, None], self.inner_of[letters], -1)
        ids[row, size - 1] = self.last_of[letters[row, size - 1]]
        tree = np.full((many, 2 * width), NONE, np.int64)
        pair = place[:-1] + 1 < size[:, None]
        tree[:, width:-1] = np.where(pair, self._rank_at(ids[:, :-1], ids[:, 1:], place[:-1], width), NONE)
        low = width
        while low > 1:
            tree[:, low // 2 : low] = np.minimum(tree[:, low : 2 * low : 2], tree[:, low + 1 : 2 * low : 2])
            low //= 2
        after, before = np.tile(place + 1, (many, 1)), np.tile(place - 1, (many, 1))
        row = np.flatnonzero(tree[:, 1] < NONE)
        while len(row):
            root = tree[row, 1]
            i = root % width
            j = after[row, i]
            k = after[row, j]
            ids[row, i] = made = self.made[root // width]
            ids[row, j] = -1
            after[row, i] = k
            inside, h = k < size[row], before[row, i]
            next_at = np.where(inside, k, 0)
            tree[row, width + j] = NONE
            tree[row, width + i] = np.where(inside, self._rank_at(made, ids[row, next_at], i, width), NONE)
            before[row[inside], k[inside]] = i[inside]
            left = h >= 0
            tree[row[left], width + h[left]] = self._rank_at(ids[row[left], h[left]], made[left], h[left], width)
            paths = [i + width, j + width, np.where(left, h, i) + width]
            step = width
            while step > 1:
                step //= 2
                for n, node in enumerate(paths):
                    paths[n] = node = node >> 1
                    tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
            row = row[tree[row, 1] < NONE]
        own = ids >= 0
        return ids[own], own.sum(1)

    def _keep(self, key: Key, value: tuple[bytes, str]) -> tuple[bytes, str]:
        self.young[key] = value
        self.held += WORD_BYTES + 12 * (0 if isinstance(key, int) else len(key))
        return value

    def _learn(self, new: list[bytes]) -> None:
        """Encode words and keep them in the generation in use."""
        by_width: dict[int, list[bytes]] = {}
        for raw in new:
            by_width.setdefault(1 << max(1, (len(raw) - 1).bit_length()) if len(raw) <= TOGETHER else 0, []).append(raw)
        for width, words in by_width.items():
            for start in range(0, len(words), ROWS):
                part = words[start : start + ROWS]
                if width:
                    flat, counts = self.encode_rows(part, width)
                    flat, packed = flat.tolist(), flat.astype("<u4").tobytes()
                    ends = np.cumsum(counts).tolist()
                    for raw, a, b in zip(part, [0, *ends[:-1]], ends, strict=True):
                        self._keep(raw, (packed[4 * a : 4 * b], self.decode(flat[a:b])))
                else:
                    for raw in part:
                        ids = list(self.encode_word(raw))
                        self._keep(raw, (np.array(ids, "<u4").tobytes(), self.decode(ids)))

    def know(self, keys: set[Key]) -> dict[Key, tuple[bytes, str]]:
        """The generation in use, with all of ``keys`` in it."""
        if self.held > CACHED_BYTES:
            self.old, self.young, self.held = self.young, {}, 0
        words: dict[Key, list[bytes]] = {}
        for key in keys - self.young.keys():
            if (found := self.old.get(key)) is not None:
                self._keep(key, found)
            elif isinstance(key, int):
                self._keep(key, (np.array([key], "<u4").tobytes(), self.token[key]))
            else:
                words[key] = [key] if isinstance(key, bytes) else [w.encode() for w in self.words.findall(key)]
        new = []
        for raw in {raw for part in words.values() for raw in part} - self.young.keys():
            if (found := self.old.get(raw)) is not None:
                self._keep(raw, found)
            else:
                new.append(raw)
        self._learn(new)
        for key, part in words.items():
            if isinstance(key, str):
                got = [self.young[raw] for raw in part]
                self._keep(key, got[0] if len(got) == 1 else (b"".join([g[0] for g in got]), " ".join([g[1] for g in got])))
        return self.young

    def keys_of(self, text: str) -> list[Key]:
        """The stretches of a text between blanks, normalised; special tokens in it as their ids."""
        out: list[Key] = []
        for part in self.split.split(text) if "<|" in text else (text,):
            if part in self.special:
                out.append(self.special[part])
                continue
            if not part.isascii():
                if any(map(_newer, set(part))):
                    out += self._words_by_library(part)
                    continue
                # lower case letter by letter, so a final sigma is an ordinary one
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            out += part.lower().replace("\n", " ").split(" ") if self.apart else [part.lower()]
        return out

    def encode_all(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Ids as little-endian unsigned 32-bit numbers, and the decoded text, of each text."""
        collects = gc.isenabled()
        gc.disable()  # nothing here makes a cycle, and each search for cycles would walk through all known words
        try:
            split = [self.keys_of(x) for x in texts]
            known = self.know(set().union(*split))
            out = []
            for keys in split:
                pairs = [known[k] for k in keys]
                out.append((b"".join([p[0] for p in pairs]), " ".join([p[1] for p in pairs if p[1]])))
            return out
        finally:
            if collects:
                gc.enable()

    def encode(self, text: str) -> list[int]:
        """Ids of a text; special tokens in it are their own ids."""
        return np.frombuffer(self.encode_all([text])[0][0], "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, special tokens kept; the vocabulary file names no decoder."""
        return " ".join(map(self.token.__getitem__, ids))


def load(path: str) -> Bpe:
    """The vocabulary at ``path``, read once per worker."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def bpe_encode(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """Encode and decode every text with the vocabulary file ``vocabulary`` (a path all executors have).

    One row per input row: ids and decoded text, or with ``digests`` their SHA-256 (ids as little-endian
    unsigned 32-bit integers). NULL and empty texts have no tokens; repeated rows stay; other columns are not read.
    No shuffle: each text is encoded where it is read.
    """

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = load(vocabulary).encode_all([x or "" for x in batch.column(1).to_pylist()])
        counts = [len(ids) // 4 for ids, _ in found]
        if digests:
            first = pa.array([hashlib.sha256(ids).hexdigest() for ids, _ in found], pa.string())
            second = pa.array([hashlib.sha256(decoded.encode()).hexdigest() for _, decoded in found], pa.string())
        else:
            flat = np.frombuffer(b"".join(ids for ids, _ in found), "<i4")
            first = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat))
            second = pa.array([decoded for _, decoded in found], pa.string())
        names = ["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), first, second], names)

    rows = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].alias("text"))
    return map_slices(rows, encode, DIGESTS if digests else SCHEMA, limit=SLICE_BYTES)

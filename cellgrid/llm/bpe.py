"""Byte-level BPE by speculation and verification, and its inverse.

Greedy longest match proposes the tokens of all new words of a batch at once.  A
sequence of tokens is the BPE encoding exactly if no merge ever crosses a border
of two neighbours, and that depends on the two tokens alone.  So each different
pair is tested once, all pairs of the batch together in arrays, and only words
with a failing pair are merged one by one in the order of the merges.

The test goes back in time.  Just before the later of the two tokens next to the
border was made, its nearer part stood there; a merge of the two that stood
there crosses the border if it comes before the merge that took one of them
away.  Of equal merges the left one comes first.

Nulls: a null text is empty.  Special tokens in a text get their ids, as the
tokenizers library does.  Repeated rows get equal results.  An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import map_texts, prepare
from cellgrid.llm.tokens import Encoder

# Words of more bytes are proposed one by one.
LONG_WORD = 200
# Failing words of at most so many bytes are merged side by side.
SHORT_WORD = 32
# The pre-tokenisation pattern of byte-level BPE (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = np.int64(1 << 40)


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens, merges and a byte trie as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        letters = byte_alphabet()
        vocab = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.texts = [str(i) for i in range(size)]
        self.of_byte = np.zeros(256, np.int64)
        for token, i in vocab.items():
            if len(token) == 1:
                self.of_byte[letters[token]] = i
        merges = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        rank = np.arange(len(merges))
        # how a token was made: its first merge
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        self.rank[made[::-1]], self.left[made[::-1]], self.right[made[::-1]] = rank[::-1], left[::-1], right[::-1]
        self.merge = {(a, b): (r, m) for a, b, r, m in zip(left.tolist(), right.tolist(), rank.tolist(), made.tolist())}
        keys = left << 32 | right
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], rank[order]
        self.made = made
        self.byte_pairs = self._merge_rank(
            np.repeat(self.of_byte, 256), np.tile(self.of_byte, 256)
        )
        usable = self._usable(made)
        self.by_bytes = {self.bytes[i]: i for i in vocab.values() if usable[i]}
        self.longest = max(map(len, self.by_bytes))
        self._trie()

    def _merge_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        keys = x << 32 | y
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NEVER)

    def border_holds(self, x: np.ndarray, y: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge before ``until`` crosses the border between each ``x`` and ``y``."""
        x, y = x.copy(), y.copy()
        # doubled ranks: an odd limit lets a merge of the same rank come first
        limit = np.full(len(x), 2 * NEVER) if until is None else 2 * until
        holds = np.ones(len(x), bool)
        live = np.arange(len(x))
        while len(live):
            a, b = x[live], y[live]
            crossed = 2 * self._merge_rank(a, b) < limit[live]
            holds[live[crossed]] = False
            back_left = self.rank[a] > self.rank[b]
            # two single bytes: nothing happened before
            go = ~crossed & ((self.rank[a] >= 0) | (self.rank[b] >= 0))
            one, two = live[go & back_left], live[go & ~back_left]
            limit[one] = 2 * self.rank[x[one]]
            x[one] = self.right[x[one]]
            limit[two] = 2 * self.rank[y[two]] + 1
            y[two] = self.left[y[two]]
            live = live[go]
        return holds

    def _usable(self, made: np.ndarray) -> np.ndarray:
        """Tokens that the encoding of their own bytes yields."""
        good = np.ones(len(self.rank), bool)
        good[made] = self.border_holds(self.left[made], self.right[made], self.rank[made])
        for i in made.tolist():
            good[i] = good[i] and good[self.left[i]] and good[self.right[i]]
        return good

    def _trie(self) -> None:
        nodes: dict[tuple[int, int], int] = {}
        ends = [-1]
        for token, i in self.by_bytes.items():
            node = 0
            for b in token:
                if (node, b) not in nodes:
                    nodes[node, b] = len(ends)
                    ends.append(-1)
                node = nodes[node, b]
            ends[node] = i
        keys = np.array([n << 8 | b for n, b in nodes], np.int64)
        order = np.argsort(keys)
        self.trie_keys, self.trie_next = keys[order], np.array(list(nodes.values()), np.int64)[order]
        self.trie_end = np.array(ends, np.int64)
        # the first two bytes by direct lookup
        self.start = np.full(65536, -1, np.int64)
        for (n, b), child in nodes.items():
            if n == 0:
                for c in range(256):
                    self.start[b << 8 | c] = nodes.get((child, c), -1)

    def propose(self, words: list[bytes]) -> list[list[int]]:
        """Greedy longest match of every word, one token of all words per step."""
        sizes = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words) + b"\0\0", np.uint8).astype(np.int64)
        stop = np.cumsum(sizes)
        at = stop - sizes
        live = np.flatnonzero(sizes)
        found_word, found_token = [], []
        while len(live):
            here, end = at[live], stop[live]
            token, length = self.of_byte[data[here]], np.ones(len(live), np.int64)
            node = np.where(here + 1 < end, self.start[data[here] << 8 | data[here + 1]], -1)
            depth = 2
            open_ = np.flatnonzero(node >= 0)
            node = node[open_]
            while len(open_):
                hit = self.trie_end[node]
                full = hit >= 0
                token[open_[full]], length[open_[full]] = hit[full], depth
                more = here[open_] + depth < end[open_]
                open_, node = open_[more], node[more]
                keys = node << 8 | data[here[open_] + depth]
                place = np.minimum(np.searchsorted(self.trie_keys, keys), len(self.trie_keys) - 1)
                same = self.trie_keys[place] == keys
                open_, node = open_[same], self.trie_next[place[same]]
                depth += 1
            found_word.append(live)
            found_token.append(token)
            at[live] += length
            live = live[at[live] < stop[live]]
        owner = np.concatenate(found_word) if found_word else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        tokens = (np.concatenate(found_token) if found_token else owner)[order]
        cuts = np.cumsum(np.bincount(owner, minlength=len(words)))[:-1]
        return [t.tolist() for t in np.split(tokens, cuts)]

    def propose_long(self, word: bytes) -> list[int]:
        out, at = [], 0
        while at < len(word):
            for size in range(min(self.longest, len(word) - at), 0, -1):
                token = self.by_bytes.get(word[at : at + size])
                if token is not None:
                    break
            out.append(token)
            at += size
        return out

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: the earliest merge first, of equal ones the leftmost."""
        ids: list[int] = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        after = [*range(1, len(ids)), -1]
        before = list(range(-1, len(ids) - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (m := self.merge.get((ids[i], ids[j]))):
                heapq.heappush(heap, (m[0], i, ids[i], ids[j], m[1]))

        for i in range(len(ids)):
            offer(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [i for i in ids if i >= 0]

    def merged_short(self, words: list[bytes]) -> list[list[int]]:
        """Exact merging of many short words, one merge of every word per step."""
        out: list[list[int]] = [[]] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        width = int(sizes.max())
        inside = np.arange(width) < sizes[:, None]
        raw = np.zeros((len(words), width), np.int64)
        raw[inside] = np.frombuffer(b"".join(words), np.uint8)
        ids = np.where(inside, self.of_byte[raw], -1)
        ranks = np.full((len(words), width), NEVER)
        ranks[:, :-1] = np.where(inside[:, 1:], self.byte_pairs[raw[:, :-1] << 8 | raw[:, 1:]], NEVER)
        row, column = np.arange(len(words)), np.arange(width)
        while len(row):
            lane = np.arange(len(row))
            k = ranks.argmin(axis=1)  # of equal merges the leftmost
            best = ranks[lane, k]
            done = best == NEVER
            for i, found in zip(row[done].tolist(), ids[done].tolist()):
                out[i] = [t for t in found if t >= 0]
            row, ids, ranks, k, best = row[~done], ids[~done], ranks[~done], k[~done], best[~done]
            lane = np.arange(len(row))
            # close the gap behind the merged pair
            source = np.minimum(column + (column > k[:, None]), width - 1)
            ids, ranks = np.take_along_axis(ids, source, 1), np.take_along_axis(ranks, source, 1)
            ids[:, -1], ranks[:, -1] = -1, NEVER
            ids[lane, k] = self.made[best]
            for at in (k - 1, k):
                ok = (at >= 0) & (at + 1 < width)
                a, b = ids[lane, np.maximum(at, 0)], ids[lane, np.minimum(at + 1, width - 1)]
                ok &= b >= 0
                ranks[lane[ok], at[ok]] = self._merge_rank(a[ok], b[ok])
                gone = ~ok & (at >= 0)
                ranks[lane[gone], at[gone]] = NEVER
        return out

    def encode_words(self, words: list[bytes]) -> tuple[list[list[int]], int]:
        """Tokens of every word, and how many words had to be merged."""
        short = [i for i, w in enumerate(words) if len(w) <= LONG_WORD]
        out: list[list[int]] = [[]] * len(words)
        for i, ids in zip(short, self.propose([words[i] for i in short])):
            out[i] = ids
        for i, w in enumerate(words):
            if len(w) > LONG_WORD:
                out[i] = self.propose_long(w)
        sizes = np.array([len(o) for o in out], np.int64)
        flat = np.fromiter((t for o in out for t in o), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(out)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[inner] << 32 | flat[inner + 1], return_inverse=True)
        holds = self.border_holds(pairs >> 32, pairs & 0xFFFFFFFF)
        wrong = np.unique(owner[inner[~holds[back]]]).tolist()
        small = [i for i in wrong if len(words[i]) <= SHORT_WORD]
        for at in range(0, len(small), 20_000):
            part = small[at : at + 20_000]
            for i, ids in zip(part, self.merged_short([words[i] for i in part])):
                out[i] = ids
        for i in wrong:
            if len(words[i]) > SHORT_WORD:
                out[i] = self.merged(words[i])
        return out, len(wrong)


_READY: dict[str, "SpeculativeEncoder"] = {}


class SpeculativeEncoder(Encoder):
    """The unit cache of :class:`Encoder` over this module's own encoding."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.spaced = True
        self.kept = {}
        self.pattern = regex.compile(PATTERN)
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.words = self.merged = 0

    def _many(self, texts: list[str]) -> list[np.ndarray]:
        special = self.vocabulary.special
        cut = []
        for text in texts:
            parts = self.split.split(text) if self.split and any(s in text for s in special) else [text]
            words: list = []
            for part in parts:
                words += [part] if part in special else self.pattern.findall(part)
            cut.append(words)
        new = list({w for words in cut for w in words}.difference(special))
        ids, merged = self.vocabulary.encode_words([w.encode("utf-8", "surrogatepass") for w in new])
        self.words, self.merged = self.words + len(new), self.merged + merged
        known = dict(zip(new, ids)) | {s: [i] for s, i in special.items()}
        return [np.array([t for w in words for t in known[w]], np.uint32) for words in cut]

    def _raw(self, text: str) -> np.ndarray:
        return self._many([text])[0]

    def _learn(self, units: set[str]) -> dict[str, bytes]:
        order = list(units)
        found = self._many([u if u[:1] == "\n" else f" {u}" for u in order])
        return {u: ids.tobytes() for u, ids in zip(order, found)}

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``; bytes that are not UTF-8 become replacement characters."""
        return b"".join(map(self.vocabulary.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def speculative_encoder(path: str) -> SpeculativeEncoder:
    """The encoder of a vocabulary file in this process."""
    if path not in _READY:
        _READY[path] = SpeculativeEncoder(path)
    return _READY[path]


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, n_tokens, tokens binary, decoded)``: ids as little-endian unsigned 32-bit integers and their text."""
    prepare(docs.sparkSession)

    def run(part):
        coder = speculative_encoder(vocabulary)
        ids = coder.encode(part["text"])
        yield {
            "id": part["id"],
            "n_tokens": [len(i) for i in ids],
            "tokens": [i.astype("<u4").tobytes() for i in ids],
            "decoded": [coder.decode(i) for i in ids],
        }

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return map_texts(rows, run, f"id {kind}, n_tokens bigint, tokens binary, decoded string")


def digest(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Like :func:`encode`, with hashes in place of the ids and the text."""
    prepare(docs.sparkSession)

    def run(part):
        coder = speculative_encoder(vocabulary)
        texts = coder.vocabulary.texts
        ids = coder.encode(part["text"])
        yield {
            "doc_id": part["id"],
            "n_tokens": [len(i) for i in ids],
            "ids_sha256": [
                hashlib.sha256(",".join(map(texts.__getitem__, i.tolist())).encode()).hexdigest() for i in ids
            ],
            "decoded_sha256": [hashlib.sha256(coder.decode(i).encode()).hexdigest() for i in ids],
        }

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return map_texts(rows, run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")

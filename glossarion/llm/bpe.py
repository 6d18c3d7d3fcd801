"""BPE encoding and decoding.

A pretoken's symbols are leaves of a segment tree. Leaf i holds rank * width + i of the pair that
starts at symbol i, so that the root's minimum is the leftmost pair of the lowest rank. A merge sets
at most three leaves and repairs their paths to the root; it ends when no pair can be merged.
Pretokens of like width are merged together, one numpy row each; wide ones one by one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .text import slices

#: How the byte-level vocabularies cut a text into pretokens: a fixed value.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"""
#: Characters whose class is the same in all Unicode versions in use; other texts are cut by the tokenizer's own rules.
SETTLED = [*range(0x530), *range(0x2010, 0x2060), *range(0x20A0, 0x20C0)]
WIDEST_BATCH = 64
WORDS_AT_ONCE = 4096
#: The word cache is emptied beyond so many characters and words (the words of one batch come on top).
CACHED_CHARS, CACHED_WORDS = 1 << 24, 800_000
#: Of the hash table from pairs to ranks: slots, a multiplier that spreads keys, and what takes a product to a slot.
SLOTS, SPREAD, SHIFT, MASK = 1 << 18, 0x9E3779B97F4A7C15, 64 - 18, (1 << 64) - 1


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def settled_patterns() -> tuple[re.Pattern, re.Pattern]:
    """What matches texts of settled characters only, and PRETOKEN for these with its classes spelt out."""
    found = {k: [chr(c) for c in SETTLED if regex.match(p, chr(c))] for k, p in (("L", r"\p{L}"), ("N", r"\p{N}"), ("S", r"\s"))}
    inner = {k: "".join(map(re.escape, v)) for k, v in found.items()}
    pretoken = PRETOKEN.replace("[^{S}{L}{N}]", f"[^{''.join(inner.values())}]").replace("{L}", f"[{inner['L']}]").replace("{N}", f"[{inner['N']}]").replace("{S}", inner["S"])
    return re.compile("[" + "".join(re.escape(chr(c)) for c in SETTLED) + "]*+"), re.compile(pretoken)


class Bpe:
    """A byte-level BPE vocabulary read from a tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, back = spec["model"]["vocab"], byte_chars()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.byte_id = np.zeros(256, np.int32)
        for char, b in back.items():
            self.byte_id[b] = vocab[char]
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])]
        left, right, merged = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        keys = (left << 32) | right
        self.merged = merged.astype(np.int32)
        self.rank = {int(k): r for r, k in reversed(list(enumerate(keys)))}
        self.slot_key, self.slot_rank = np.full(SLOTS, -1, np.int64), np.full(SLOTS, -1, np.int32)
        for k, r in self.rank.items():  # linear probing; probes: the longest run that a lookup must follow
            at, run = ((k * SPREAD) & MASK) >> SHIFT, 1
            while self.slot_key[at] >= 0:
                at, run = (at + 1) % SLOTS, run + 1
            self.slot_key[at], self.slot_rank[at], self.probes = k, r, max(run, getattr(self, "probes", 1))
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.library_cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.settled, self.pretoken = settled_patterns()
        self.cache: dict[str, bytes] = {}
        self.cached_chars = 0

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it can't be merged; a negative id is no symbol."""
        want = (left.astype(np.int64) << 32) | right
        want[(left < 0) | (right < 0)] = -2
        at = ((want.view(np.uint64) * np.uint64(SPREAD)) >> np.uint64(SHIFT)).view(np.int64)
        out = np.where(self.slot_key[at] == want, self.slot_rank[at], np.int32(-1))
        for step in range(1, self.probes):
            more = np.flatnonzero((out < 0) & (self.slot_key[(at + step - 1) % SLOTS] >= 0))
            if not len(more):
                break
            there = (at[more] + step) % SLOTS
            out[more] = np.where(self.slot_key[there] == want[more], self.slot_rank[there], np.int32(-1))
        return out

    def merge_batch(self, words: list[bytes], width: int) -> list[bytes]:
        """Ids of words of at most `width` bytes (a power of two), as little-endian uint32."""
        n, none = len(words), np.iinfo(np.int32).max
        lengths = np.fromiter(map(len, words), np.int32, n)
        # one spare column on the right takes the writes that fall off a word's end
        row = width + 1
        ids = np.full((n, row), -1, np.int32)
        ids[np.arange(row) < lengths[:, None]] = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        ahead = np.minimum(np.arange(1, row + 1, dtype=np.int32), lengths[:, None]).ravel()
        behind = np.tile(np.arange(-1, width, dtype=np.int32), n)
        tree = np.full((n, 2 * width), none, np.int32)
        word, start = np.nonzero(ids[:, 1:] >= 0)
        r = self.ranks(ids[word, start], ids[word, start + 1])
        tree[word, width + start] = np.where(r >= 0, r * np.int32(width) + start.astype(np.int32), none)
        for level in range(width.bit_length() - 2, -1, -1):
            lo = 1 << level
            tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
        ids, tree = ids.ravel(), tree.ravel()
        act = np.flatnonzero(tree[1 :: 2 * width] < none)
        while len(act):
            at, top, end = act * row, act * (2 * width), lengths[act]
            root = tree[top + 1]
            pos, rank = root % width, root // width
            gone = ahead[at + pos]
            after, before = ahead[at + gone], behind[at + pos]
            new = self.merged[rank]
            ids[at + pos], ids[at + gone] = new, -1
            ahead[at + pos], behind[at + after] = after, pos
            # the pair that now starts here, and the one that ends here; a word's first symbol has none before it
            rank2 = self.ranks(np.concatenate([new, np.where(before >= 0, ids[at + before], -1)]), np.concatenate([np.where(after < end, ids[at + after], -1), new]))
            leaf = np.concatenate([pos, before])
            value = np.where(rank2 >= 0, rank2 * np.int32(width) + leaf, none)
            tree[top + width + gone] = none
            tree[top + width + pos] = value[: len(act)]
            has = before >= 0
            tree[(top + width + before)[has]] = value[len(act) :][has]
            base = np.concatenate([top, top, top])
            node = np.concatenate([gone, pos, np.maximum(before, 0)]) + width
            for _ in range(width.bit_length() - 1):
                node = node >> 1
                child = base + 2 * node
                tree[base + node] = np.minimum(tree[child], tree[child + 1])
            act = act[tree[top + 1] < none]
        ids = ids.reshape(n, row)
        kept = ids >= 0
        flat, ends = ids[kept].astype("<u4").tobytes(), (4 * np.cumsum(kept.sum(1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def merge_one(self, word: bytes) -> bytes:
        """The same for one wide word, in O(log n) steps a merge."""
        n = len(word)
        width, none = 1 << max(1, (n - 1).bit_length()), 1 << 62
        ids, ahead, behind = self.byte_id[np.frombuffer(word, np.uint8)].tolist(), list(range(1, n + 1)), list(range(-1, n))
        tree, rank, merged = [none] * (2 * width), self.rank, self.merged.tolist()

        def leaf(i: int) -> int:
            j = ahead[i]
            r = rank.get(ids[i] << 32 | ids[j], -1) if j < n else -1
            return none if r < 0 else r * width + i

        tree[width : width + n] = map(leaf, range(n))
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, value: int) -> None:
            k = width + i
            tree[k] = value
            while k > 1:
                k >>= 1
                a, b = tree[2 * k], tree[2 * k + 1]
                low = a if a < b else b
                if tree[k] == low:
                    break
                tree[k] = low

        while (root := tree[1]) < none:
            r, pos = divmod(root, width)
            gone = ahead[pos]
            after = ahead[gone]
            ids[pos], ids[gone] = merged[r], -1
            ahead[pos] = after
            behind[after] = pos
            put(gone, none)
            put(pos, leaf(pos))
            if behind[pos] >= 0:
                put(behind[pos], leaf(behind[pos]))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        """Encode pretokens that the cache lacks."""
        by_width: dict[int, list[str]] = {}
        for w in words:
            n = len(w.encode())
            self.cached_chars += n
            by_width.setdefault(4 if n <= 4 else 1 << (n - 1).bit_length(), []).append(w)
        for width, group in by_width.items():
            if width > WIDEST_BATCH:
                self.cache.update((w, self.merge_one(w.encode())) for w in group)
                continue
            for i in range(0, len(group), WORDS_AT_ONCE):
                part = group[i : i + WORDS_AT_ONCE]
                self.cache.update(zip(part, self.merge_batch([w.encode() for w in part], width), strict=True))

    def cut(self, text: str) -> list[str]:
        if self.settled.fullmatch(text):
            return self.pretoken.findall(text)
        return [text[a:b] for _, (a, b) in self.library_cut(text)]

    def encode_batch(self, texts: list[str], count: bool = False) -> list[bytes] | list[int]:
        """Ids of each text as little-endian uint32, or how many; special tokens' strings become their ids."""
        cut = []
        for text in texts:
            if self.split is not None and any(s in text for s in self.special):
                cut.append([(x, None) if x in self.special else (None, self.cut(x)) for x in self.split.split(text) if x])
            else:
                cut.append([(None, self.cut(text))])
        if len(self.cache) > CACHED_WORDS or self.cached_chars > CACHED_CHARS:
            self.cache.clear()
            self.cached_chars = 0
        self.learn(set().union(*(words for parts in cut for _, words in parts if words)) - self.cache.keys())
        get = self.cache.__getitem__
        if count:
            return [sum(1 if s else sum(map(len, map(get, words))) // 4 for s, words in parts) for parts in cut]
        return [b"".join(self.special[s].to_bytes(4, "little") if s else b"".join(map(get, words)) for s, words in parts) for parts in cut]

    def decode(self, ids: bytes) -> str:
        """Text of little-endian uint32 ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Bpe:
    return Bpe(path)


def encode_decode(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, then ids (binary, little-endian unsigned 32-bit) and decoded (string) of each row's whole text.

    path names a byte-level BPE tokenizer file that every executor can open (it is installed, not data).
    A null text counts as empty; an empty text has no ids. Rows aren't merged: repeated rows come out
    repeated. An empty table gives no rows. Other columns are dropped, so their names can't clash.
    One pass, no shuffle; a worker holds about 4 MB of text, or one text, and a bounded word cache.
    """
    kept = df.select(*keep)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + ["ids binary", "decoded string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in slices(batches, "_text"):
            ids = bpe.encode_batch([x or "" for x in batch.column("_text").to_pylist()])
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())], names=[*keep, "ids", "decoded"])

    return df.select(*keep, df[text].alias("_text")).mapInArrow(run, schema)


def token_counts(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` and n_tokens (long), the number of ids of each row's whole text; all else as in encode_decode."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema] + ["n_tokens bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in slices(batches, "_text"):
            counts = bpe.encode_batch([x or "" for x in batch.column("_text").to_pylist()], count=True)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(counts, pa.int64())], names=[*keep, "n_tokens"])

    return df.select(*keep, df[text].alias("_text")).mapInArrow(run, schema)

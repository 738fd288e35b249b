"""Byte-level BPE encoding and decoding with a two-tier lookup.

A pre-token (one match of the pattern) that is a vocabulary entry is resolved by a minimal perfect
hash. The others are merged from single bytes: neighbours form a linked list, a heap gives
the pair of lowest rank, the leftmost of equals first. Results are memoised per worker.

The engine that runs the pattern knows letters and numbers of a later Unicode version than the tiktoken library's. Where the two differ
the pattern is made to follow the library, which is asked once what its classes hold.

Defined results. Null text is the empty text: no ids. Texts are taken whole. Repeated rows give repeated
results; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_worker, read, texts, tokenizer_file

MEMO = 400_000  # with MEMO_LENGTH, under 200 MB
MEMO_LENGTH = 32


class PerfectHash:
    """Minimal perfect hash over byte strings: hash and displace, n keys on n slots."""

    def __init__(self, keys: list[bytes], values: list[int]) -> None:
        import numpy as np
        import xxhash

        n = len(keys)
        self.n, self.m = n, max(1, n // 4)
        self.shift = np.zeros(self.m, np.int64)
        buckets: dict[int, list[tuple[int, int]]] = {}
        for k, key in enumerate(keys):
            h = xxhash.xxh64_intdigest(key)
            buckets.setdefault(h % self.m, []).append((h, k))
        place = [-1] * n
        for b, found in sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(found) == 1:
                break
            d = 0
            while True:
                slots = [self.slot(h, d) for h, _ in found]
                if len(set(slots)) == len(slots) and all(place[s] < 0 for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for s, (_, k) in zip(slots, found):
                place[s] = k
        free = (s for s in range(n) if place[s] < 0)
        for b, found in sorted(buckets.items()):
            if len(found) == 1:
                s = next(free)
                self.shift[b], place[s] = -s - 1, found[0][1]
        self.keys, self.values = [keys[k] for k in place], [values[k] for k in place]
        self.shift = self.shift.tolist()

    def slot(self, h: int, d: int) -> int:
        x = (h ^ (d * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        x = (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        return (x ^ (x >> 32)) % self.n

    def find(self, key: bytes) -> int:
        """The key's value, or -1."""
        import xxhash

        h = xxhash.xxh64_intdigest(key)
        d = self.shift[h % self.m]
        s = -d - 1 if d < 0 else self.slot(h, d)
        return self.values[s] if self.keys[s] == key else -1


class Memo(dict):
    """Pre-token to its ids as little-endian 32-bit bytes. Holds at most MEMO pre-tokens of at most MEMO_LENGTH characters; then it begins anew."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        found = self.encode(word)
        if len(word) <= MEMO_LENGTH:
            if len(self) >= MEMO:
                self.clear()
            self[word] = found
        return found


def as_the_library(pattern: str) -> tuple[str, str]:
    """The pattern with each character class \\\\p{...} cut to what the tiktoken library takes for it, and the least character that was cut."""
    import re

    import regex
    import tiktoken

    least = chr(0x10FFFF)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for name in sorted(set(re.findall(r"\\p\{\w+\}", pattern))):
        library = tiktoken.Encoding("class", pat_str=name, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        theirs = set(library.decode_bytes(library.encode_ordinary(every)).decode())
        extra = [ord(c) for c in regex.findall(name, every) if c not in theirs]
        runs = []
        for c in extra:
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
        if runs:
            least = min(least, chr(runs[0][0]))
            pattern = pattern.replace(name, f"[{name}--[{''.join(f'{chr(92)}U{a:08x}-{chr(92)}U{b:08x}' for a, b in runs)}]]")
    return pattern, least


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.whole = PerfectHash(list(ranks), list(ranks.values()))
        self.plain = regex.compile(pattern)
        exact, self.least = as_the_library(pattern)
        self.pattern = regex.compile(exact, regex.V1)
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.single = [ranks[bytes([i])] for i in range(256)]
        #: (left id, right id) to the merged id
        self.pairs = {}
        for whole, rank in ranks.items():
            for i in range(1, len(whole)):
                left, right = ranks.get(whole[:i]), ranks.get(whole[i:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank
        self.memo = Memo(self.word)

    def word(self, word: str) -> bytes:
        raw = word.encode()
        found = self.whole.find(raw)
        if found >= 0:
            return struct.pack("<I", found)
        ids = self.merge(raw)
        return struct.pack(f"<{len(ids)}I", *ids)

    def merge(self, raw: bytes) -> list[int]:
        get = self.pairs.get
        ids = [self.single[b] for b in raw]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i) for i in range(n - 1) if (rank := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or get(ids[i] << 32 | ids[j]) != rank:
                continue  # one of the pair has been merged since
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (right := get(rank << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (right, i))
            if (k := before[i]) >= 0 and (left := get(ids[k] << 32 | rank)) is not None:
                heapq.heappush(heap, (left, k))
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> bytes:
        """All ids, little-endian unsigned 32-bit."""
        return b"".join(map(self.memo.__getitem__, (self.plain if text.isascii() or max(text) < self.least else self.pattern).findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I").tolist()))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """id, ids (little-endian 32-bit, binary) and decoded (binary: the bytes that the ids give back).

    The vocabulary's ranks are broadcast: their size is that of the vocabulary, not of the data.
    """

    def row(codec, text):
        ids = codec.encode(text)
        return ids, codec.decode(ids)

    return _coded(docs, id_col, text_col, vocabulary, pattern, row, {"ids": "binary", "decoded": "binary"})


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """As encode_documents, with digests in place of the ids and bytes, which then need not leave the worker."""

    def row(codec, text):
        ids = codec.encode(text)
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()

    return _coded(docs, id_col, text_col, vocabulary, pattern, row, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"})


def _coded(docs, id_col, text_col, vocabulary, pattern, row, kinds):
    import public_tokenizers

    path, pattern = vocabulary or tokenizer_file("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    shipped = docs.sparkSession.sparkContext.broadcast(load_ranks(path))
    key = "codec_" + hashlib.md5(f"{path}\0{pattern}".encode()).hexdigest()

    def run(batches):
        import pyarrow as pa

        codec = per_worker(key, lambda: Codec(shipped.value, pattern))
        arrow = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                columns = list(zip(*(row(codec, t) for t in texts(part.column(1)))))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, arrow[k]) for c, k in zip(columns, kinds.values()))], ["doc_id", *kinds])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join(["doc_id long", *(f"{c} {k}" for c, k in kinds.items())]))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(read(spark, sf_dir, "documents"))


QUERIES = {"op10_byte_bpe": op10_byte_bpe}
SQL: dict[str, str] = {}

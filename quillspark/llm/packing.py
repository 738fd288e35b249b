"""Packing of token sequences by bounded-space online best fit.

Every partition keeps a fixed number of open windows. A document's full windows leave at once; its
rest goes to the open window with the smallest gap that holds it. When none fits and no further
window may be opened, the fullest one is emitted, its gap first filled with a cut of the rest unless
the gap is below MIN_CUT. At its end a partition merges its open windows, so at most one part-filled
window is left of each; those are merged in rounds of up to MERGE windows a task. Memory per task is
that of its open windows, and only the last windows of partitions are ever moved.

Token ids are those of the `tokenizers` file byte_bpe_50k.json; they are computed from the same
vocabulary as ranks, byte_bpe_50k.tiktoken, which is several times faster (the tests compare the two).
An added token's string in a text is that token's id. Each document ends with END_ID. The fast library's engine backtracks and gives up on runs of about a
million white-space characters; a text on which it does goes, whole, through the engine and merges of `bpe`, which do not.

Defined results. Null and empty text: the one id END_ID. Texts are taken whole, however long. A repeated row is
packed each time. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import json
import math
import os
import struct
import zlib
from bisect import bisect_left, insort

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Codec, load_ranks
from .common import cut, per_worker, read, texts, tokenizer_file

WINDOW = 1024
OPEN_WINDOWS = 64
MIN_CUT = 16
END_ID = 0
MERGE = 4096

COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
SCHEMA = ", ".join(f"{c} long" for c in COLUMNS) + ", still_open boolean, ids binary"


class Packer:
    """Pieces are (doc_id, start, ids, doc_tokens); a closed window is a list of them."""

    def __init__(self, window: int, open_windows: int, min_cut: int) -> None:
        self.window, self.most, self.min_cut = window, open_windows, min_cut
        self.gaps: list[tuple[int, int]] = []  # (gap, number), ascending
        self.open: dict[int, list] = {}
        self.opened = 0

    def place(self, piece):
        """Put a piece shorter than a window somewhere; yields windows that this closes."""
        doc, start, ids, total = piece
        at = bisect_left(self.gaps, (len(ids), -1))
        if at == len(self.gaps) and len(self.gaps) >= self.most:
            gap, number = self.gaps.pop(0)
            pieces = self.open.pop(number)
            if gap >= self.min_cut:
                pieces.append((doc, start, ids[:gap], total))
                start, ids = start + gap, ids[gap:]
            yield pieces
            at = bisect_left(self.gaps, (len(ids), -1))
        if at < len(self.gaps):
            gap, number = self.gaps.pop(at)
        else:
            gap, number = self.window, self.opened
            self.opened += 1
            self.open[number] = []
        self.open[number].append((doc, start, ids, total))
        if gap == len(ids):
            yield self.open.pop(number)
        else:
            insort(self.gaps, (gap - len(ids), number))

    def merge(self):
        """The open windows' pieces in as few windows as hold them; all but the last are full."""
        pieces, used = [], 0
        for _, number in self.gaps:
            for doc, start, ids, total in self.open[number]:
                while used + len(ids) >= self.window:
                    gap = self.window - used
                    yield [*pieces, (doc, start, ids[:gap], total)]
                    start, ids, pieces, used = start + gap, ids[gap:], [], 0
                if len(ids):
                    pieces.append((doc, start, ids, total))
                    used += len(ids)
        if pieces:
            yield pieces


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of the `tokenizers` file that lies beside a vocabulary, if there is one."""
    beside = f"{path.removesuffix('.tiktoken')}.json"
    if not os.path.exists(beside):
        return {}
    with open(beside, encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in found):
        raise ValueError(f"{beside}: added tokens are matched as they are written only")
    return {t["content"]: t["id"] for t in found}


def load_encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path.rpartition("/")[2], pat_str=pattern, mergeable_ranks=ranks, special_tokens=added_tokens(path))


class Encoder:
    """Ids of whole texts, added tokens included."""

    def __init__(self, path: str, pattern: str) -> None:
        self.path, self.pattern, self.patient = path, pattern, None
        self.fast = load_encoder(path, pattern)

    def ids(self, text: str):
        import numpy as np

        try:
            return self.fast.encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype("<u4")
        except ValueError:  # the stack of its pattern engine is full
            return np.frombuffer(self.slowly(text), "<u4")

    def slowly(self, text: str) -> bytes:
        import re

        if self.patient is None:
            added = added_tokens(self.path)
            split = re.compile(f"({'|'.join(map(re.escape, sorted(added, key=len, reverse=True)))})") if added else None
            self.patient = Codec(load_ranks(self.path), self.pattern), added, split
        codec, added, split = self.patient
        parts = split.split(text) if split else [text]
        return b"".join(struct.pack("<I", added[part]) if i % 2 else codec.encode(part) for i, part in enumerate(parts))


def packed(windows, first_id: int, ids_of: str, last_open: bool):
    """Record batches of closed windows; with last_open the last window that isn't full is marked. ids_of: "all" or "open"."""
    import pyarrow as pa

    def batch():
        arrays = [pa.array(c, pa.int64()) for c in columns] + [pa.array(marks, pa.bool_()), pa.array(kept, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, [*COLUMNS, "still_open", "ids"])

    columns, marks, kept = [[] for _ in COLUMNS], [], []
    for number, (pieces, full) in enumerate(windows):
        offset, is_open = 0, last_open and not full
        for doc, start, ids, total in pieces:
            raw = ids.tobytes()
            for column, value in zip(columns, (doc, start, len(ids), zlib.crc32(raw), total, first_id + number, offset)):
                column.append(value)
            marks.append(is_open)
            kept.append(raw if is_open or ids_of == "all" else None)
            offset += len(ids)
        if len(marks) >= 4000:
            yield batch()
            columns, marks, kept = [[] for _ in COLUMNS], [], []
    if marks:
        yield batch()


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, open_windows: int = OPEN_WINDOWS, min_cut: int = MIN_CUT, with_ids: bool = True, vocabulary: str | None = None, pattern: str | None = None, merge: int = MERGE) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, unless with_ids is false, ids (little-endian unsigned 32-bit)."""
    import public_tokenizers

    path, pattern = vocabulary or tokenizer_file("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    ids_of = "all" if with_ids else "open"

    def first(batches):
        import numpy as np
        from pyspark import TaskContext

        encoder = per_worker(f"packing_{path}", lambda: Encoder(path, pattern))
        packer = Packer(window, open_windows, min_cut)

        def windows():
            for batch in batches:
                for begin in range(0, batch.num_rows, 500):
                    part = batch.slice(begin, 500)
                    for doc, text in zip(part.column(0).to_pylist(), texts(part.column(1))):
                        ids = np.append(encoder.ids(text), END_ID).astype("<u4")
                        n = len(ids)
                        for start in range(0, n - n % window, window):
                            yield [(doc, start, ids[start : start + window], n)], True
                        if n % window:
                            for pieces in packer.place((doc, n - n % window, ids[n - n % window :], n)):
                                yield pieces, True
            for pieces in packer.merge():
                yield pieces, sum(len(p[2]) for p in pieces) == window

        yield from packed(windows(), TaskContext.get().partitionId() << 32, ids_of, True)

    def again(turn: int, last: bool):
        def run(batches):
            import numpy as np
            from pyspark import TaskContext

            packer = Packer(window, 1 << 60, min_cut)

            def windows():
                for batch in batches:
                    for doc, start, total, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
                        for pieces in packer.place((doc, start, np.frombuffer(raw, "<u4"), total)):
                            yield pieces, True
                for pieces in packer.merge():
                    yield pieces, last or sum(len(p[2]) for p in pieces) == window

            yield from packed(windows(), turn << 56 | TaskContext.get().partitionId() << 32, ids_of, not last)

        return run

    out = COLUMNS + ["ids"] * with_ids
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    current, done = cut(rows.mapInArrow(first, SCHEMA)), []
    for turn in range(1, 100):
        done.append(current.where("not still_open").select(*out))
        rest = current.where("still_open")
        left = rest.where("offset = 0").count()
        if not left:
            break
        tasks = math.ceil(left / merge)
        rest = rest.repartition(1) if tasks == 1 else rest.repartition(tasks, "sequence_id")
        rest = rest.sortWithinPartitions("sequence_id", "offset").select("doc_id", "start", "doc_tokens", "ids")
        current = cut(rest.mapInArrow(again(turn, tasks == 1), SCHEMA))
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), with_ids=False)


QUERIES = {"op2_packing": op2_packing}
SQL: dict[str, str] = {}

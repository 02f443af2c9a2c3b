"""Packing of tokenised documents into sequences of equal size, shortest pack first over the length histogram.

Documents are tokenised where they lie and cut into pieces of at most ``size``
tokens. The histogram of piece lengths, at most ``size`` rows however many
pieces there are, is packed on the driver: lengths are placed longest first,
each into the shortest open packs that have room, as counts of packing
patterns. Patterns are joined back to the pieces by the rank of a piece among
those of its length.

Defined cases: a null text counts as empty; an empty text is its end token
alone; a document without an id is packed like any other; repeated rows are
packed each; pieces of equal length are ranked by the given order, ties in any
fixed order; an empty table gives no rows. Other columns are not returned.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans import stage
from .common import ROWS, map_rows, ranked, table

SIZE = 2048
END = 1
#: Characters after which a longer text is cut at the next border.
SPAN = 100_000

# A byte-level BPE splits a text at white space before anything else: no token goes from another
# character to the white space after it. The control characters are white space for Python only.
_BORDER = re.compile(r"(?<=[^\s\x1c-\x1f])(?=[ \n])")


def spans(text: str) -> Iterator[str]:
    """The text in parts of ``SPAN`` characters and what is left to the next border."""
    at = 0
    while len(text) - at > SPAN and (border := _BORDER.search(text, at + SPAN)):
        yield text[at : border.start()]
        at = border.start()
    yield text[at:]


def merge_ranks(tokenizer_json: str) -> dict[bytes, int] | None:
    """Ids of the byte strings of a byte-level BPE file whose merges come in the order of their ids; else none."""
    parsed = json.loads(tokenizer_json)
    vocabulary, merges = parsed["model"]["vocab"], parsed["model"]["merges"]
    # The vocabulary writes each byte as a printable character.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    special = {t["id"] for t in parsed.get("added_tokens", [])}
    ranks = {
        bytes(map(byte_of.__getitem__, entry)): i
        for entry, i in vocabulary.items()
        if i not in special and all(c in byte_of for c in entry)
    }
    order = [vocabulary.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in merges]
    usual = order == sorted(order) and all(i >= 0 for i in order) and len(ranks) == 256 + len(merges)
    return ranks if usual else None


class Encoder:
    """Token ids of texts as little-endian bytes, four for each id; remembers no text.

    Where ``merge_ranks`` finds the file to be of the usual kind, ``tiktoken`` gives the ids of
    ``tokenizers`` in less time; that library is left with what holds no border for long.
    """

    def __init__(self, tokenizer_json: str, ranks: dict[bytes, int] | None = None):
        import public_tokenizers
        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer_json = tokenizer_json
        ranks = ranks or merge_ranks(tokenizer_json)
        self.fast = ranks and tiktoken.Encoding(
            "packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        found = Tokenizer.from_str(self.tokenizer_json)
        # The string of a special token in a text is ordinary text.
        found.encode_special_tokens = True
        return found

    def _ids(self, span: str) -> bytes:
        # Patterns with a look ahead end early on very long white space in the faster library.
        if self.fast is None or len(span) > 4 * SPAN:
            return np.array(self.library.encode(span, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return self.fast.encode_to_numpy(span, disallowed_special=()).astype("<u4", copy=False).tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self._ids, spans(text)))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(
    docs: DataFrame,
    tokenizer: str | None = None,
    size: int = SIZE,
    end: int = END,
    keep: Sequence[str] = (),
    ids: bool = False,
) -> DataFrame:
    """Pieces of the documents ``(doc_id, text, *keep)``, in the order of their tokens.

    ``(doc_id, *keep, start, length, ids_crc32, doc_tokens)`` and, where asked for, ``ids``.
    """
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as file:
        content = file.read()
    model = docs.sparkSession.sparkContext.broadcast((content, merge_ranks(content)))
    last = np.array([end], dtype="<u4").tobytes()
    columns = ["doc_id", *keep]

    def start():
        encoder = Encoder(*model.value)

        def run(batch):
            out = {name: [] for name in [*columns, "start", "length", "ids_crc32", "doc_tokens", "ids"]}
            for row in zip(*[batch[c] for c in columns], batch["text"]):
                data = encoder.encode(row[-1] or "") + last
                total = len(data) // 4
                for at in range(0, total, size):
                    piece = data[4 * at : 4 * (at + size)]
                    for name, value in zip(columns, row):
                        out[name].append(value)
                    out["start"].append(at)
                    out["length"].append(len(piece) // 4)
                    out["ids_crc32"].append(zlib.crc32(piece))
                    out["doc_tokens"].append(total)
                    if ids:
                        out["ids"].append(np.frombuffer(piece, dtype="<u4").astype(np.int32))
            return out

        return run

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    schema = f"{kinds}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * ids
    return map_rows(docs.select(*columns, "text"), schema, start, rows=ROWS)


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns with their counts; each length of the histogram is placed as often as it says."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    spaces: list[int] = []  # of open packs, ascending
    done: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], count: int, space: int) -> None:
        if not space:
            done.append((pattern, count))
            return
        if space not in room:
            room[space] = []
            insort(spaces, space)
        room[space].append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not spaces or spaces[-1] < length:
                # No open pack has room. A new one takes as many of this length as it can hold.
                each = size // length
                if left >= each:
                    put((length,) * each, left // each, size - each * length)
                if left % each:
                    put((length,) * (left % each), 1, size - left % each * length)
                break
            space = spaces[-1]
            pattern, count = room[space].pop()
            used = min(count, left)
            if used < count:
                room[space].append((pattern, count - used))
            elif not room[space]:
                del room[space]
                spaces.pop(bisect_left(spaces, space))
            put(pattern + (length,), used, space - length)
            left -= used
    return done + [p for packs in room.values() for p in packs]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, offset) by rank; a row holds up to the next one's rank."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            rank = used.get(length, 0)
            rows.setdefault(length, []).append((rank, base, offset))
            used[length] = rank + count
            offset += length
        base += count
    return {length: np.array(r, dtype=np.int64) for length, r in rows.items()}


def pack(cut: DataFrame, size: int = SIZE, order: Sequence[str] = ("doc_id", "start")) -> DataFrame:
    """Pieces ``cut`` with ``sequence_id`` and ``offset``; ``order`` ranks the pieces of a length."""
    cut = stage(cut)
    numbered = ranked(cut, ["length"], order, "_rank")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    found = slots(shortest_pack_first(histogram, size))

    def start():
        def run(batch):
            lengths = np.array(batch["length"], dtype=np.int64)
            ranks = np.array(batch["_rank"], dtype=np.int64)
            sequence, offset = np.zeros(len(ranks), dtype=np.int64), np.zeros(len(ranks), dtype=np.int64)
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                table = found[int(length)]
                at = np.searchsorted(table[:, 0], ranks[rows], side="right") - 1
                sequence[rows] = table[at, 1] + ranks[rows] - table[at, 0]
                offset[rows] = table[at, 2]
            return batch | {"sequence_id": sequence, "offset": offset}

        return run

    schema = StructType([*cut.schema.fields, *StructType.fromDDL("sequence_id long, offset long").fields])
    return map_rows(numbered, schema, start)


def pack_in_file_order(docs: DataFrame) -> DataFrame:
    """Sequences of documents read from Parquet files: of the pieces of a length, those that come first there are packed first."""
    place = {"_file": F.col("_metadata.file_name"), "_line": F.col("_metadata.row_index")}
    placed = docs.select("doc_id", "text", *[c.alias(name) for name, c in place.items()])
    return pack(pieces(placed, keep=list(place)), order=[*place, "start"]).drop(*place)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")))

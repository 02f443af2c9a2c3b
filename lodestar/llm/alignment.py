"""Alignment of two tokenizers' tokens, as a monoid of fragments.

Tokenizer A is a byte-level BPE, B a sentencepiece model; both read a space and
the text. Byte offsets where tokens of both end cut the tokens into groups; the
A and B tokens of a group are linked. A fragment is what a byte range of a text
knows of this by itself: an open prefix (the tokens up to the first common end,
whose group may have begun before), closed groups, and an open suffix (those
after the last common end). A token belongs to the range of its last byte, so a
common end is seen by one range, and fragments compose associatively (``join``):
a suffix and the next prefix make one group.

Texts longer than ``CHUNK`` bytes are dealt over tasks as byte ranges, and their
fragments are composed in a tree, ``FAN`` neighbours at a time; no task gets more
of a text than one composition needs. A range is tokenised with the stretches at
its ends (from one white space to the next, ``_UNITS``). Neither tokenizer has a
token across the borders of stretches: A's pattern splits there, and B's
vocabulary is checked for it. Shorter texts are tokenised whole; the fragment of
many of them, one after the other, is taken at once, since both tokenizers end a
token where a text ends.

Texts are tokenised once and their ids staged. How many documents hold a pair of
ids linked is counted in tasks, then summed; a second pass over the ids sums up.
The table of counts is sent to all tasks while it has at most ``SENT_PAIRS`` rows
(counted first); a larger one is joined with the documents' pairs.

Defined cases: null and empty texts have no tokens, nor has a text whose joined
tokens differ from a space and the text in A or B (as where it holds U+2581): all
numbers are 0 and the digest is empty, and it counts for no pair; repeated rows
count once each; an id repeats as often as its rows; an empty table gives no
rows; other columns are ignored. Token ids are below 2^31.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..plans import fresh_dir, stage
from ..plans.skew import join_sized
from .common import buckets, table

#: Bytes of a range of a long text.
CHUNK = 1 << 16
#: Fragments composed at once.
FAN = 8
#: Bytes of shorter texts that are aligned at once.
SLICE = 1 << 20
#: Rows of the table of counts, 17 bytes each, that is sent to all tasks.
SENT_PAIRS = 2_000_000
#: Pairs that a task holds before it adds them up.
HELD_PAIRS = 2_000_000

# A stretch begins at a space or line feed after a character that is not white space.
_UNITS = re.compile(r"[ \n]\s*(?:\S+(?:[^\S \n]\s*\S*)*)?", re.DOTALL)
_BREAK = re.compile(rb"[ \n]")


class Fragment(NamedTuple):
    """Tokens of a byte range; ``cut`` tells whether both tokenizers end a token together anywhere in it.

    Without a common end all tokens are in the prefix. ``a`` and ``b`` are the ids of the closed groups, one
    after the other, ``n_a`` and ``n_b`` how many each group has.
    """

    sound: bool
    cut: bool
    prefix_a: np.ndarray
    prefix_b: np.ndarray
    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    suffix_a: np.ndarray
    suffix_b: np.ndarray


_NONE = np.zeros(0, dtype=np.int32)
NEUTRAL = Fragment(True, False, *[_NONE] * 8)
_ARRAYS = Fragment._fields[2:]


def fragment(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray, sound: bool = True) -> Fragment:
    """The fragment of tokens with ascending ends, of a whole number of bytes each."""
    # Both ends ascend: a table of the bytes from the first to the last end tells which are common.
    base = min(a_ends[0], b_ends[0]) if len(a) and len(b) else 0
    marks = np.zeros(max(a_ends[-1], b_ends[-1]) - base + 1 if len(a) and len(b) else 0, dtype=np.int8)
    if len(marks):
        marks[a_ends - base] += 1
        marks[b_ends - base] += 1
    cuts_a, cuts_b = ((np.flatnonzero(marks[e - base] == 2) + 1 if len(marks) else _NONE) for e in (a_ends, b_ends))
    if not len(cuts_a):
        return NEUTRAL._replace(sound=sound, prefix_a=a, prefix_b=b)
    return Fragment(
        sound, True, a[: cuts_a[0]], b[: cuts_b[0]], a[cuts_a[0] : cuts_a[-1]], b[cuts_b[0] : cuts_b[-1]],
        np.diff(cuts_a).astype(np.int32), np.diff(cuts_b).astype(np.int32), a[cuts_a[-1] :], b[cuts_b[-1] :],
    )


def join(parts: list[Fragment]) -> Fragment:
    """The composition of fragments that follow each other."""
    sound, out = all(p.sound for p in parts), None
    open_a, open_b = [], []
    a, b, n_a, n_b = [], [], [], []
    for part in parts:
        open_a.append(part.prefix_a)
        open_b.append(part.prefix_b)
        if not part.cut:
            continue
        first_a, first_b = np.concatenate(open_a), np.concatenate(open_b)
        if out is None:
            out = (first_a, first_b)
        else:
            # What was open on both sides of a border is one group.
            a.append(first_a)
            b.append(first_b)
            n_a.append(np.array([len(first_a)], dtype=np.int32))
            n_b.append(np.array([len(first_b)], dtype=np.int32))
        for held, own in zip((a, b, n_a, n_b), (part.a, part.b, part.n_a, part.n_b)):
            held.append(own)
        open_a, open_b = [part.suffix_a], [part.suffix_b]
    rest = [np.concatenate([_NONE, *x]) for x in (open_a, open_b)]
    if out is None:
        return NEUTRAL._replace(sound=sound, prefix_a=rest[0], prefix_b=rest[1])
    return Fragment(sound, True, *out, *[np.concatenate([_NONE, *x]) for x in (a, b, n_a, n_b)], *rest)


class Groups(NamedTuple):
    """The groups of a whole text."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray


def groups_of(whole: Fragment) -> Groups | None:
    """The groups of a text of which ``whole`` is the fragment: its prefix has nothing before it. None if unsound."""
    if not whole.sound or not whole.cut or len(whole.suffix_a) or len(whole.suffix_b):
        return None
    first = lambda x: np.array([len(x)], dtype=np.int32)
    return Groups(
        np.concatenate([whole.prefix_a, whole.a]), np.concatenate([whole.prefix_b, whole.b]),
        np.concatenate([first(whole.prefix_a), whole.n_a]), np.concatenate([first(whole.prefix_b), whole.n_b]),
    )


@lru_cache(maxsize=2)
def _numbers(size: int) -> list[str]:
    return [f"{i}{sign}" for sign in ",|;" for i in range(size)]


def written(groups: Groups, owner: np.ndarray, count: int) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each of ``count`` texts; ``owner`` tells the text of each group."""
    n = np.stack([groups.n_a, groups.n_b], axis=1).astype(np.int64)
    # Where the ids of each side go in the row of all: A's of a group, then B's.
    begin = np.cumsum(n.ravel()) - n.ravel()
    total = int(n.sum())
    ids, marks = np.zeros(total, dtype=np.int64), np.zeros(total, dtype=np.int64)
    for side, found in enumerate((groups.a, groups.b)):
        size = n[:, side]
        at = np.repeat(begin[side::2] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        ids[at] = found
        marks[begin[side::2] + size - 1] = 1 + side
    ends = np.searchsorted(owner, np.arange(count), side="right")
    last = np.append(0, np.cumsum(n.sum(axis=1)))[ends]
    size = 1 << int(ids.max(initial=0)).bit_length()
    if size <= 1 << 20:
        words = list(map(_numbers(size).__getitem__, (marks * size + ids).tolist()))
    else:
        words = [f"{i}{',|;'[m]}" for i, m in zip(ids.tolist(), marks.tolist())]
    return ["".join(words[x:y])[:-1].encode() for x, y in zip([0, *last[:-1].tolist()], last.tolist())]


def linked(groups: Groups, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct linked pairs of each text, A's id in the upper half of a key, the text and how often there; by key."""
    size = groups.n_a.astype(np.int64) * groups.n_b
    small = size <= 4_096
    start_a, start_b = (np.cumsum(n) - n for n in (groups.n_a.astype(np.int64), groups.n_b.astype(np.int64)))
    # All pairs of small groups at once: row k of a group pairs a's number k // n_b with b's number k % n_b.
    n_b = groups.n_b[small].astype(np.int64)
    of = np.repeat(np.arange(len(n_b)), size[small])
    k = np.arange(len(of)) - np.repeat(np.cumsum(size[small]) - size[small], size[small])
    x = groups.a[start_a[small][of] + k // n_b[of]].astype(np.int64)
    y = groups.b[start_b[small][of] + k % n_b[of]].astype(np.int64)
    bits_b, bits_owner = int(groups.b.max(initial=0)).bit_length(), int(owner.max(initial=0)).bit_length()
    packed = (x << (bits_b + bits_owner)) | (y << bits_owner) | owner[small][of]
    packed, times = np.unique(packed, return_counts=True)
    large = []
    for g in np.flatnonzero(~small):
        # Of a large group only the distinct ids are paired.
        a, times_a = np.unique(groups.a[start_a[g] : start_a[g] + groups.n_a[g]], return_counts=True)
        b, times_b = np.unique(groups.b[start_b[g] : start_b[g] + groups.n_b[g]], return_counts=True)
        both = (a.astype(np.int64) << (bits_b + bits_owner))[:, None] | (b.astype(np.int64) << bits_owner) | owner[g]
        large.append((both.ravel(), (times_a[:, None] * times_b).ravel()))
    if large:
        packed, place = np.unique(np.concatenate([packed, *[p for p, _ in large]]), return_inverse=True)
        each, times = np.concatenate([times, *[t for _, t in large]]), np.zeros(len(packed), dtype=np.int64)
        np.add.at(times, place, each)
    keys = (packed >> (bits_b + bits_owner) << 32) | ((packed >> bits_owner) & ((1 << bits_b) - 1))
    return keys, packed & ((1 << bits_owner) - 1), times.astype(np.int64)


# Tokens of texts


class Sizes:
    """Bytes that the ids of both tokenizers stand for, by id: enough to align ids."""

    def __init__(self, a_sizes: np.ndarray, b_sizes: np.ndarray):
        self.a_sizes, self.b_sizes = a_sizes, b_sizes
        self.kind = "<u2" if max(len(a_sizes), len(b_sizes)) <= 1 << 16 else "<i4"

    def groups(self, a: list[np.ndarray], b: list[np.ndarray]) -> tuple[Groups, np.ndarray]:
        """The groups of sound texts, given by their ids, one after the other, and the text of each group."""
        flat_a, flat_b = np.concatenate([_NONE, *a]), np.concatenate([_NONE, *b])
        ends = np.cumsum(self.a_sizes[flat_a])
        found = groups_of(fragment(flat_a, ends, flat_b, np.cumsum(self.b_sizes[flat_b])))
        if found is None:
            return Groups(_NONE, _NONE, _NONE, _NONE), np.zeros(0, dtype=np.int64)
        last = np.cumsum([len(x) for x in a])
        return found, np.searchsorted(last, np.cumsum(found.n_a), side="left")


class Aligner(Sizes):
    """Both tokenizers, with the bytes that their ids stand for."""

    def __init__(self, a_json: str, b_model: bytes):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_str(a_json)
        # The string of a special token in a text is ordinary text.
        self.library.encode_special_tokens = True
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
        parsed = json.loads(a_json)
        plain = {bytes(map(byte_of.__getitem__, entry)): i for entry, i in parsed["model"]["vocab"].items() if all(c in byte_of for c in entry)}
        special = {t["id"]: t["content"].encode() for t in parsed.get("added_tokens", [])}
        self.a_bytes = [b""] * (max([*plain.values(), *special]) + 1)
        for entry, i in [*plain.items(), *zip(special.values(), special)]:
            self.a_bytes[i] = entry
        # Where merges come in the order of their ids, as in files of the usual kind, a faster library gives the same ids.
        merges = [m.split(" ") if isinstance(m, str) else m for m in parsed["model"]["merges"]]
        order = [parsed["model"]["vocab"].get("".join(m), -1) for m in merges]
        ranks = {entry: i for entry, i in plain.items() if i not in special}
        self.fast = None
        if order == sorted(order) and all(r >= 0 for r in order) and len(ranks) == 256 + len(merges):
            self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.model = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        ids = range(self.model.vocab_size())
        pieces = [self.model.id_to_piece(i) for i in ids]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, pieces)]
        super().__init__(*(np.array([len(t) for t in x], dtype=np.int64) for x in (self.a_bytes, self.b_bytes)))
        # No piece goes on behind a space that follows something else, or holds a line feed.
        self.lead = self.model.encode("\n")
        self.separable = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces) and len(self.lead) == 2

    def _in_a(self, text: str) -> list[int]:
        # Patterns with a look ahead end early on very long white space in the faster library.
        if self.fast is None or len(text) > 4 * CHUNK:
            return self.library.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def _checked(self, raw: bytes, a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray, bool]:
        sound = b"".join(map(self.a_bytes.__getitem__, a)) == raw and b"".join(map(self.b_bytes.__getitem__, b)) == raw
        return np.array(a, dtype=np.int32), np.array(b, dtype=np.int32), sound

    def texts(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, bool]]:
        """Ids of whole texts in A and B, and whether both stand for the very bytes of a space and the text."""
        whole = [f" {t}" for t in texts]
        return [self._checked(w.encode("utf-8", "replace"), self._in_a(w), b) for w, b in zip(whole, self.model.encode(texts, num_threads=1))]

    def span(self, span: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """The same for a part of a text (with its space) from border to border."""
        if self.separable:
            b = self.model.encode(f"\n{span}")[len(self.lead) :]
        else:
            b = self.model.encode(span[1:])
        return self._checked(span.encode(), self._in_a(span), b)


def _cut_after(raw: bytes, at: int) -> int:
    """The first border of stretches at or after ``at``."""
    while (found := _BREAK.search(raw, max(at, 1))) is not None:
        at, lead = found.start(), found.start() - 1
        while raw[lead] & 0xC0 == 0x80:
            lead -= 1
        if not raw[lead:at].decode().isspace():
            return at
        at += 1
    return len(raw)


def _cut_before(raw: bytes, at: int) -> int:
    """The last border of stretches at or before ``at``, looked for in steps of growing length."""
    step = 64
    while True:
        begin = max(0, at - step)
        cut, last = _cut_after(raw, begin) if begin else 0, -1
        while cut <= at and cut < len(raw):
            last, cut = cut, _cut_after(raw, cut + 1)
        if last >= 0:
            return last
        if not begin:
            return 0
        step *= 4


def ranges(raw: bytes, chunk: int) -> Iterator[tuple[int, int, int, int]]:
    """Byte ranges ``(low, high]`` of a text with the span, from border to border, whose tokens end in them.

    A stretch longer than a range gets its own, so that no byte is in more than three spans.
    """
    low = 0
    while low < len(raw):
        high = min(len(raw), low + chunk)
        begin, end = _cut_before(raw, low), _cut_after(raw, high)
        if _cut_before(raw, high) <= low:
            high = end
        yield low, high, begin, end
        low = high


_FRAGMENT = "sound boolean, cut boolean, " + ", ".join(f"{name} binary" for name in _ARRAYS)


def _row(part: Fragment) -> list:
    return [part.sound, part.cut, *[x.astype("<i4").tobytes() for x in part[2:]]]


def _from_row(values) -> Fragment:
    return Fragment(values[0], values[1], *[np.frombuffer(x, dtype="<i4") for x in values[2:]])


class Models(NamedTuple):
    """Both models, as read by the driver from the given files and sent to the tasks, and what it knows of them."""

    a: object
    b: object
    sizes: object
    separable: bool

    def aligner(self) -> Aligner:
        return Aligner(self.a.value, self.b.value)


def models(spark: SparkSession, a_file: str | None = None, b_file: str | None = None) -> Models:
    if a_file is None or b_file is None:
        import public_tokenizers

        a_file = a_file or public_tokenizers.path("byte_bpe_50k.json")
        b_file = b_file or public_tokenizers.path("piece_bpe_32k.model")
    with open(a_file, encoding="utf-8") as file:
        a = file.read()
    with open(b_file, "rb") as file:
        b = file.read()
    known = Aligner(a, b)
    send = spark.sparkContext.broadcast
    return Models(send(a), send(b), send(Sizes(known.a_sizes, known.b_sizes)), known.separable)


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def long_fragments(docs: DataFrame, both: Models, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """``(uid, doc_id, fragment columns)`` of the texts longer than ``chunk`` bytes, a row for each, staged."""
    texts = docs.where(F.octet_length("text") > chunk).select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), "text")
    spans = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("begin", pa.int64()), ("span", pa.binary())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, doc_id, text in zip(*batch.columns):
                raw = b" " + text.as_py().encode("utf-8", "replace")
                cuts = ranges(raw, chunk) if both.separable else [(0, len(raw), 0, len(raw))]
                for part, (low, high, begin, end) in enumerate(cuts):
                    yield _batch([(uid.as_py(), doc_id.as_py(), part, low, high, begin, raw[begin:end])], spans)

    kinds = "uid long, doc_id long, part long, "
    out = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int64()), ("sound", pa.bool_()), ("cut", pa.bool_()), *[(n, pa.binary()) for n in _ARRAYS]])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = both.aligner()
        for batch in batches:
            for uid, doc_id, part, low, high, begin, span in zip(*[c.to_pylist() for c in batch.columns]):
                a, b, sound = aligner.span(span.decode("utf-8"))
                a_ends, b_ends = begin + np.cumsum(aligner.a_sizes[a]), begin + np.cumsum(aligner.b_sizes[b])
                own_a, own_b = (a_ends > low) & (a_ends <= high), (b_ends > low) & (b_ends <= high)
                made = fragment(a[own_a], a_ends[own_a], b[own_b], b_ends[own_b], sound)
                yield _batch([(uid, doc_id, part, *_row(made))], out)

    def compose(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")
        parts = [_from_row(v) for v in zip(*[rows.column(c).to_pylist() for c in Fragment._fields])]
        first = [rows.column(c)[0].as_py() for c in ("uid", "doc_id", "above")]
        return pa.Table.from_batches([_batch([(*first, *_row(join(parts)))], out)])

    totals = texts.agg(F.count("*"), F.max(F.octet_length("text")), F.sum(F.octet_length("text"))).first()
    tasks = buckets(totals[2] or 0, 64 * chunk)
    dealt = texts.mapInArrow(deal, kinds + "low long, high long, begin long, span binary").repartition(tasks, "uid", "part")
    found = dealt.mapInArrow(align, kinds + _FRAGMENT)
    # The greatest number of ranges, each of ``chunk`` bytes at least but the last, gives the height of the tree.
    left = buckets((totals[1] or 0) + 1, chunk)
    while left > 1:
        found = found.withColumn("above", F.floor(F.col("part") / fan)).groupBy("uid", "above").applyInArrow(compose, kinds + _FRAGMENT)
        left = buckets(left, fan)
    return stage(found.drop("part"))


def _slices(texts: list[str | None]) -> Iterator[slice]:
    begin, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size > SLICE:
            yield slice(begin, k + 1)
            begin, size = k + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def _ids(docs: DataFrame, both: Models, chunk: int) -> DataFrame:
    """``(doc_id, a, b)`` of the texts of at most ``chunk`` bytes, staged: ids, of four bytes or two, or null.

    Rows with ``n`` besides count, for a number of documents, those that hold the pair ``key`` linked.
    """
    schema = "doc_id long, a binary, b binary, key long, n long"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    short = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= chunk)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = both.aligner()
        held, size = [], 0
        for batch in batches:
            every, all_texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for piece in _slices(all_texts):
                ids, texts = every[piece], all_texts[piece]
                filled = [k for k, t in enumerate(texts) if t]
                a, b = [None] * len(ids), [None] * len(ids)
                found = aligner.texts([texts[k] for k in filled])
                sound = [(x, y) for x, y, fine in found if fine]
                for k, (x, y, fine) in zip(filled, found):
                    if fine:
                        a[k], b[k] = x.astype(aligner.kind).tobytes(), y.astype(aligner.kind).tobytes()
                none = [None] * len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip((ids, a, b, none, none), arrow)], schema=arrow)
                keys = linked(*aligner.groups([x for x, _ in sound], [y for _, y in sound]))[0]
                held.append(np.unique(keys, return_counts=True))
                size += len(held[-1][0])
                if size > HELD_PAIRS:
                    yield _counted(held, arrow)
                    held, size = [], 0
        if held:
            yield _counted(held, arrow)

    path = fresh_dir(docs.sparkSession, "ids")
    short.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def _counted(held: list[tuple[np.ndarray, np.ndarray]], schema: pa.Schema) -> pa.RecordBatch:
    """Rows of counts: the sum of counts by key."""
    keys, n = (np.concatenate(c) for c in zip(*held))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    columns = {"key": keys[first], "n": np.add.reduceat(n, first) if len(first) else n}
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * len(first)), type=f.type) for f in schema], schema=schema)


def pair_counts(ids: DataFrame, long: DataFrame) -> DataFrame:
    """``(key, n, best)``: how many documents hold a pair linked, and whether no pair of its A id is in more; staged."""
    schema = "key long, n long"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def of_fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns):
                if groups := groups_of(_from_row([x.as_py() for x in row])):
                    keys = linked(groups, np.zeros(len(groups.n_a), dtype=np.int64))[0]
                    yield _counted([(keys, np.ones(len(keys), dtype=np.int64))], arrow)

    whole = long.select(*Fragment._fields).mapInArrow(of_fragments, schema)
    counts = stage(ids.where("n IS NOT NULL").select("key", "n").unionByName(whole).groupBy("key").agg(F.sum("n").alias("n")))
    # A's ids are few; a hot one has its highest count found before the exchange.
    highest = counts.groupBy(F.shiftright("key", 32).alias("a")).agg(F.max("n").alias("most"))
    marked = counts.withColumn("a", F.shiftright("key", 32)).join(highest, "a")
    return stage(marked.select("key", "n", (F.col("n") == F.col("most")).alias("best")))


_NUMBERS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "


def _described(ids: DataFrame, long: DataFrame, both: Models, tail: str, describe) -> DataFrame:
    """A row for each document: the numbers of its alignment, its digest and what ``describe()`` adds (``tail``).

    ``describe()`` runs once a task; its function takes groups, the text of each and their number, and gives a
    list for each column. No groups at all are those of the texts without tokens.
    """
    schema = f"doc_id long, {_NUMBERS}{tail}"
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def rows(doc_ids: list, groups: Groups, owner: np.ndarray, more) -> pa.RecordBatch:
        count = len(doc_ids)
        n_a, n_b = groups.n_a.astype(np.int64), groups.n_b.astype(np.int64)
        sums = [np.zeros(count, dtype=np.int64) for _ in range(4)]
        for total, each in zip(sums, (n_a, n_b, np.ones(len(n_a), dtype=np.int64), n_a * n_b)):
            np.add.at(total, owner, each)
        digests = [hashlib.sha256(text).hexdigest() if text else "" for text in written(groups, owner, count)]
        columns = [doc_ids, *sums, digests, *more(groups, owner, count)]
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, kinds)], schema=kinds)

    def of_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, more = both.sizes.value, describe()
        for batch in batches:
            every, a, b = (c.to_pylist() for c in batch.columns)
            for piece in _slices(a):
                # Texts without tokens own no groups.
                sides = [[np.frombuffer(x or b"", dtype=sizes.kind).astype(np.int32) for x in side[piece]] for side in (a, b)]
                yield rows(every[piece], *sizes.groups(*sides), more)

    def of_fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = describe()
        for batch in batches:
            for doc_id, *values in zip(*batch.columns):
                groups = groups_of(_from_row([x.as_py() for x in values])) or Groups(_NONE, _NONE, _NONE, _NONE)
                yield rows([doc_id.as_py()], groups, np.zeros(len(groups.n_a), dtype=np.int64), more)

    whole = long.select("doc_id", *Fragment._fields).mapInArrow(of_fragments, schema)
    return ids.where("n IS NULL").select("doc_id", "a", "b").mapInArrow(of_ids, schema).unionByName(whole)


def _with_sent_counts(ids: DataFrame, long: DataFrame, both: Models, counts: DataFrame) -> DataFrame:
    found = counts.orderBy("key").toArrow()
    sent = ids.sparkSession.sparkContext.broadcast([found.column(c).to_numpy(zero_copy_only=False) for c in ("key", "n", "best")])

    def describe():
        known, n, best = sent.value

        def sums(groups: Groups, owner: np.ndarray, count: int) -> list:
            keys, owner, times = linked(groups, owner)
            at = np.searchsorted(known, keys)
            totals = [np.zeros(count, dtype=np.int64) for _ in range(2)]
            for total, each in zip(totals, (times * best[at], times * n[at])):
                np.add.at(total, owner, each)
            return totals

        return sums

    return _described(ids, long, both, "n_best long, count_sum long", describe)


def _with_joined_counts(ids: DataFrame, long: DataFrame, both: Models, counts: DataFrame) -> DataFrame:
    def describe():
        def pairs(groups: Groups, owner: np.ndarray, count: int) -> list:
            keys, owner, times = linked(groups, owner)
            order = np.argsort(owner, kind="stable")
            borders = np.searchsorted(owner[order], np.arange(1, count))
            return [np.split(keys[order], borders), np.split(times[order], borders)]

        return pairs

    found = _described(ids, long, both, "keys array<bigint>, times array<bigint>", describe)
    found = stage(found.withColumn("uid", F.monotonically_increasing_id()))
    each = found.select("uid", F.explode(F.arrays_zip("keys", "times")).alias("_p")).select("uid", F.col("_p.keys").alias("key"), "_p.times")
    # A pair comes once for each document that holds it, so its count tells how hot it is.
    total = counts.agg(F.sum("n")).first()[0] or 0
    met = join_sized(each, counts.withColumn("size", F.col("n")), ["key"], "size", total)
    sums = met.groupBy("uid").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    columns = [f.name for f in found.schema if f.name not in ("uid", "keys", "times")]
    return found.drop("keys", "times").join(sums, "uid", "left").select(*columns, zero("n_best"), zero("count_sum"))


def aligned(
    docs: DataFrame, a_file: str | None = None, b_file: str | None = None, chunk: int = CHUNK, fan: int = FAN, sent_pairs: int = SENT_PAIRS
) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum)`` of documents ``(doc_id, text)``.

    ``n_best`` counts the links whose pair is in as many documents as any pair of its A id, ``count_sum`` adds
    up the documents of the links' pairs.
    """
    both = models(docs.sparkSession, a_file, b_file)
    long, ids = long_fragments(docs, both, chunk, fan), _ids(docs, both, chunk)
    counts = pair_counts(ids, long)
    way = _with_sent_counts if counts.count() <= sent_pairs else _with_joined_counts
    return way(ids, long, both, counts)


def groups(docs: DataFrame, a_file: str | None = None, b_file: str | None = None, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """``(doc_id, ..., a, b, n_a_each, n_b_each)``: the ids of the documents, and how many of each the groups have, in order."""
    both = models(docs.sparkSession, a_file, b_file)

    def describe():
        def columns(found: Groups, owner: np.ndarray, count: int) -> list:
            borders = np.searchsorted(owner, np.arange(1, count))
            each = [np.append(0, np.cumsum(n))[borders] for n in (found.n_a, found.n_b)]
            return [np.split(c, at) for c, at in zip(found, (*each, borders, borders))]

        return columns

    tail = "a array<int>, b array<int>, n_a_each array<int>, n_b_each array<int>"
    return _described(_ids(docs, both, chunk), long_fragments(docs, both, chunk, fan), both, tail, describe)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"))

"""Sum-of-squares online packing of tokenised documents into fixed windows.

Every document becomes its token ids followed by one end id. Full windows are cut off a long document first; what is
left is placed, whole, into the window level (tokens already used) that keeps the sum of squared counts of partially
filled windows smallest; ties go to the fullest level. Levels are tracked in one array. Partitions pack on their own, so
no row is shuffled.

At the end of a partition windows stand as they were placed if they miss no more than PADDING tokens, or if their length
is a power of two. The gaps of the others, fullest first, are filled from the emptiest, the only ones that are cut anew;
what is left at last is cut into powers of two. The same is done, but for the last window, when more than OPEN_WINDOWS are
open, which bounds a task's memory.

Nulls: a null text is the empty text and gives the end id alone; a null doc_id is kept. Repeated rows are packed once
each. Very long texts are encoded whole and cut into full windows. An empty table gives no rows. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long"
ARROW = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_tokens", pa.int64())]
)

#: Open windows kept at most (4 * size bytes of ids each) before the emptiest fill the others.
OPEN_WINDOWS = 8192
#: Tokens that a window may miss when it is closed at the end; they are padding.
PADDING = 16

#: Cached words of a tokenising task, about 200 bytes each; as many of their pieces.
CACHED = 400_000

_ODD_SPACE = re.compile("[\x1c-\x1f]")  # white space to str.split() only
# printable ASCII and the accented letters of Latin-1 and Latin Extended-A, on which all Unicode tables agree
_PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ž]*")
_SPLIT = "[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_LETTERS = "a-zß-öø-ž"


class Memo(dict):
    """Values of a function, forgotten when there are CACHED of them."""

    def __init__(self, work: Callable[[str], bytes]):
        super().__init__()
        self.work = work

    def __missing__(self, key: str) -> bytes:
        if len(self) >= CACHED:
            self.clear()
        value = self[key] = self.work(key)
        return value


class Encoder:
    """Token ids of whole texts as little-endian uint32 bytes, word by word with a cache.

    Holds for tokenizers whose tokens never cross white space and that fold NFC then lower case, like word_bpe_49k; others
    encode the text as it is. Words of printable ASCII and common accented letters are split here, all others are the
    tokenizer's own work, so that no second table of Unicode properties has a say.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_word = kinds == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in steps] == ["Split", "ByteLevel"]
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        if self.by_word:
            # what comes before the letters, numbers and the rest are plain strings, the contractions
            given = steps[0]["pattern"]["Regex"]
            self.by_word = given.endswith(_SPLIT)
            self.split = re.compile(f"{given.removesuffix(_SPLIT)}[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")
            shown = ByteLevel(add_prefix_space=False, use_regex=False)
            # what a byte of an accented letter's UTF-8 looks like to the model; printable ASCII is as it is
            self.alphabet = {b: x for c in range(0xC0, 0x180) for b, x in zip(chr(c).encode(), shown.pre_tokenize_str(chr(c))[0][0], strict=True)}
        self.pieces = Memo(self.piece)
        self.words = Memo(self.word)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def piece(self, text: str) -> bytes:
        shown = text if text.isascii() else text.encode().decode("latin-1").translate(self.alphabet)
        return b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(shown)])

    def word(self, text: str) -> bytes:
        if not _PLAIN.fullmatch(text) or ("<" in text and any(s in text for s in self.special)):
            return self.whole(text)
        folded = text.lower()
        pieces = self.pieces
        if folded == text and text.isalpha():
            return self.piece(text)  # remembered as a word already
        return pieces[folded] if folded.isalpha() else b"".join([pieces[x] for x in self.split.findall(folded)])

    def forget(self) -> None:
        self.words.clear()
        self.pieces.clear()

    def encode(self, text: str) -> bytes:
        if not self.by_word or _ODD_SPACE.search(text):
            return self.whole(text)
        known = self.words
        return b"".join([known[p] for p in text.split()])


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Packer:
    """Windows of `size` tokens. add() and finish() yield closed windows: lists of (document, start, ids bytes)."""

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size, dtype=np.int64)  # by level: partially filled windows
        self.open: list[list[list]] = [[] for _ in range(size)]
        self.held = 0

    def place(self, item: tuple, n: int) -> Iterator[list]:
        """Into the level h with the smallest rise of the sum of squares; a new window is level 0; ties: the fullest."""
        c, size = self.count, self.size
        rise = np.full(size, np.iinfo(np.int64).max)
        rise[0] = 2 * c[n] + 1
        last = size - n
        if last > 0:
            had = c[1:last] > 0
            rise[1:last] = np.where(had, 2 * (c[1 + n : size] - c[1:last]) + 2, rise[1:last])
            if c[last] > 0:
                rise[last] = 1 - 2 * c[last]
        h = size - 1 - int(np.argmin(rise[::-1]))
        window = self.open[h].pop() if h else []
        c[h] -= bool(h)
        self.held += not h
        window.append(item)
        if h + n == size:
            self.held -= 1
            yield window
        else:
            self.open[h + n].append(window)
            c[h + n] += 1
            if self.held > OPEN_WINDOWS:
                yield from self.settle(final=False)

    def add(self, document: tuple, ids: bytes) -> Iterator[list]:
        n, full = len(ids) // 4, self.size
        at = 0
        while n - at >= full:
            yield [(document, at, ids[4 * at : 4 * (at + full)])]
            at += full
        if n > at:
            yield from self.place((document, at, ids[4 * at :]), n - at)

    def settle(self, final: bool) -> Iterator[list]:
        """Closes the open windows: those that may stand as they are, the others filled from the emptiest.

        The last one stays open, or is cut into powers of two at the end.
        """
        size = self.size
        queue = deque((level, window) for level in range(size - 1, 0, -1) for window in self.open[level])
        self.open = [[] for _ in range(size)]
        self.count[:] = 0
        self.held = 0
        while queue:
            level, window = queue.popleft()
            if final and (size - level <= PADDING or level & (level - 1) == 0):
                yield window
                continue
            while level < size and queue:
                low, source = queue.pop()
                document, start, ids = source.pop()
                take = min(size - level, len(ids) // 4)
                window.append((document, start, ids[: 4 * take]))
                level += take
                if 4 * take < len(ids):
                    source.append((document, start + take, ids[4 * take :]))
                if source:
                    queue.append((low - take, source))
            if level == size:
                yield window
            elif final:
                yield from self.powers(window)
            else:
                self.open[level].append(window)
                self.count[level] += 1
                self.held += 1

    def powers(self, window: list) -> Iterator[list]:
        """The window's pieces cut into sequences whose lengths are powers of two."""
        total = sum(len(p[2]) // 4 for p in window)
        for bit in range(total.bit_length() - 1, -1, -1):
            if total >> bit & 1:
                out, room = [], 1 << bit
                while room:
                    document, start, ids = window.pop()
                    take = min(room, len(ids) // 4)
                    out.append((document, start, ids[: 4 * take]))
                    room -= take
                    if 4 * take < len(ids):
                        window.append((document, start + take, ids[4 * take :]))
                yield out

    def finish(self) -> Iterator[list]:
        yield from self.settle(final=True)


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, ids (little-endian uint32 bytes), doc_tokens, sequence_id, offset, sequence_tokens.

    Sequences are full or miss PADDING tokens at most, but for those whose length is a power of two.
    Memory: at most OPEN_WINDOWS open windows, the word cache and one document's ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(tokenizer_path), Packer(size)
        end = np.array([end_id], dtype="<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)
            rows.clear()
            return out

        def emit(windows: Iterator[list]) -> Iterator[pa.RecordBatch]:
            nonlocal sequence, held
            for window in windows:
                offset, total = 0, sum(len(p[2]) for p in window) // 4
                for (doc_id, tokens), start, ids in window:
                    rows.append((doc_id, start, ids, tokens, sequence, offset, total))
                    offset += len(ids) // 4
                held += 4 * total
                sequence += 1
                if held > 8_000_000:
                    held = 0
                    yield flush()

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = enc.encode(text or "") + end
                    yield from emit(packer.add((doc_id, len(ids) // 4), ids))
        enc.forget()  # the process serves other stages too
        yield from emit(packer.finish())
        if rows:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def op4_packing(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    return pack(docs, tokenizer_path).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )

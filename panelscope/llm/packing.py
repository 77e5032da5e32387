"""Cost-balanced packing of token sequences.

Attention makes a piece of n tokens cost LINEAR * n + QUADRATIC * n * n.  Each
task packs its documents in runs of about RUN_TOKENS tokens: full-length pieces
of long documents become sequences of their own; what is left goes, longest
first, to the sequence of least cost that still has room; pieces that fit
nowhere whole are cut to fill the room that is left.  A run pads less than one
sequence.
"""

from __future__ import annotations

import gc
import json
import os
import re
import secrets
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from . import textscan
from .common import small_batches

SEQUENCE_TOKENS = 4096
END_ID = 2
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
RUN_TOKENS = 500_000
CACHE_WORDS = 500_000
#: Characters of texts that are encoded together.
BATCH_CHARS = 500_000
#: White space on which Python and the tokenizer's \\s could differ: such texts are encoded whole.
_ODD = re.compile("[\x1c-\x1f\x85]")
#: Words that are not split here: beyond Latin letters, where Unicode tables could differ, or with a special token.
_WHOLE = re.compile("[^\x00-\u024f]|<\\|")
# How a tokenizer file must normalise and split texts for its words to be looked up.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
_PARTS = regex.compile(_PATTERN)

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class _Pool:
    """Arrays of token ids (or bytes) by number, in one growing array."""

    def __init__(self, dtype: type = np.uint32):
        self.ids, self.starts, self.sizes, self.used = np.empty(1 << 16, dtype), np.empty(0, np.int64), np.empty(0, np.int64), 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.empty_like(self.ids)))
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts = np.concatenate((self.starts, self.used + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.used += len(ids)

    def put(self, numbers: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Other ids for numbers that are there."""
        n = len(self.sizes)
        self.add(ids, sizes)
        self.starts[numbers], self.sizes[numbers] = self.starts[n:], self.sizes[n:]
        self.starts, self.sizes = self.starts[:n], self.sizes[:n]

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all the numbers in a row, their sizes)."""
        sizes = self.sizes[numbers]
        before = np.cumsum(sizes) - sizes
        return self.ids[np.repeat(self.starts[numbers] - before, sizes) + np.arange(int(sizes.sum()))], sizes


class _Numbers(dict):
    """Numbers strings in the order in which they are first looked up; fresh holds those not learnt yet."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.fresh.append(key)
        return n

    def of(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))


class WordEncoder:
    """Token ids of texts, by the tokenizers library.

    The tokenizer drops white space and never looks across it, nor across the
    parts that its pre-tokenizer splits words into.  So words are looked up, by
    64-bit keyed hashes from array arithmetic under a key of the encoder's own, and
    so are the parts of new words; only parts not seen yet are handed to the
    library, many at once.  A hash only finds a word: its bytes are compared with
    those of the word that the ids were made for, and texts in which two words
    share a hash are handed over whole.
    Words outside plain Latin, or that hold what looks like a special token, are
    handed over whole.  So are all texts where the tokenizer file normalises or
    splits in any other way than this relies on.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        spec = json.loads(self.tokenizer.to_str())
        special = all(t["special"] and t["content"].startswith("<|") for t in spec["added_tokens"])
        self.by_words = special and spec["normalizer"] == _NORMALIZER and spec["pre_tokenizer"] == _SPLIT and spec["model"].get("end_of_word_suffix") == "</w>"
        del spec
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a part
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.reset()

    def reset(self) -> None:
        self.key = secrets.randbits(64), secrets.randbits(64)
        self.known, self.number = np.empty(0, np.uint64), np.empty(0, np.int64)  # hashes of words in order, and the words' numbers
        self.parts = _Numbers()
        self.of_word, self.of_part, self.spelling = _Pool(), _Pool(), _Pool(np.uint8)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter((i for ids in got for i in ids), np.uint32), np.array([len(ids) for ids in got], np.int64)

    def _learn(self, fresh: list[str]) -> None:
        """Ids of the words that were looked up for the first time."""
        whole = [i for i, w in enumerate(fresh) if _WHOLE.search(w)] if _WHOLE.search(" ".join(fresh)) else []
        words = fresh.copy()
        for i in whole:
            words[i] = ""
        lowered = " ".join(words).lower()
        if not lowered.isascii():
            lowered = unicodedata.normalize("NFC", lowered)
        split = [(w,) if w.isalpha() else _PARTS.findall(w) for w in lowered.split(" ")]  # letters alone are one part
        counts = np.fromiter(map(len, split), np.int64, len(split))
        numbers = self.parts.of(list(chain.from_iterable(split)))
        if unseen := self.parts.fresh:
            self.parts.fresh = []
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(unseen)], add_special_tokens=False)[0].ids, np.uint32)
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(unseen) and last[-1] == len(ids) - 1:
                self.of_part.add(ids, np.diff(np.concatenate(([-1], last))))
            else:
                self.of_part.add(*self._library(unseen))
        ids, sizes = self.of_part.take(numbers)
        total = np.concatenate(([0], np.cumsum(sizes)))
        edge = np.concatenate(([0], np.cumsum(counts)))
        at = len(self.of_word.sizes)
        self.of_word.add(ids, total[edge[1:]] - total[edge[:-1]])
        if whole:
            ids, sizes = self._library([fresh[i] for i in whole])
            self.of_word.put(at + np.array(whole), ids, sizes)

    def _whole(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of whole texts, each with the end id, by the library alone."""
        got = self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
        return [np.array([*e.ids, self.end_id], np.uint32) for e in got]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text with the end id."""
        end = np.array([self.end_id], np.uint32)
        if not self.by_words:
            return self._whole(texts)
        if len(self.known) > CACHE_WORDS:
            self.reset()
        odd = [bool(t) and bool(_ODD.search(t)) for t in texts]
        words = textscan.scan([b"" if o or not t else t.encode() for t, o in zip(texts, odd, strict=True)])
        keys, first, inverse = np.unique(words.prf(self.key), return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, keys)
        found = np.append(self.known, np.uint64(0))[at] == keys if len(self.known) else np.zeros(len(keys), bool)
        found &= at < len(self.known)
        numbers, new = np.empty(len(keys), np.int64), np.flatnonzero(~found)
        numbers[found] = self.number[at[found]]
        alike = zip(words.bytes_of(first[found]), self.spelling.take(numbers[found]), strict=True)
        if not (words.same(first[inverse]).all() and all(np.array_equal(a, b) for a, b in alike)):
            self.reset()  # under another key
            return self._whole(texts)
        if len(new):
            numbers[new] = np.arange(len(self.known), len(self.known) + len(new))
            self.known, self.number = np.insert(self.known, at[new], keys[new]), np.insert(self.number, at[new], numbers[new])
            self.spelling.add(*words.bytes_of(first[new]))
            raw = words.data.tobytes()
            self._learn([raw[a:b].decode() for a, b in zip(words.start[first[new]].tolist(), words.end[first[new]].tolist(), strict=True)])
        ids, sizes = self.of_word.take(numbers[inverse])
        total = np.concatenate(([0], np.cumsum(sizes)))
        edge = words.first
        out = [np.append(ids[a:b], end) for a, b in zip(total[edge[:-1]].tolist(), total[edge[1:]].tolist(), strict=True)]
        for i in np.flatnonzero(odd):
            out[i] = np.array([*self.tokenizer.encode(texts[i], add_special_tokens=False).ids, self.end_id], np.uint32)
        return out


def assign(sizes: np.ndarray, limit: int = SEQUENCE_TOKENS) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for documents of the given sizes, each at least 1."""
    out = []
    whole = sizes // limit
    n = 0
    for doc in np.flatnonzero(whole):
        for k in range(whole[doc]):
            out.append((int(doc), k * limit, limit, n, 0))
            n += 1
    rest = sizes - whole * limit
    order = np.argsort(-rest, kind="stable")
    order = order[rest[order] > 0]
    count = -(-int(rest.sum()) // limit)
    cost, room = np.zeros(count), np.full(count, limit)

    def put(doc: int, start: int, length: int, at: int) -> None:
        out.append((doc, start, length, n + at, limit - int(room[at])))
        room[at] -= length
        cost[at] += LINEAR * length + QUADRATIC * length * length

    cut = []
    for doc in order:
        size = int(rest[doc])
        at = int(np.argmin(np.where(room >= size, cost, np.inf)))
        if room[at] >= size:
            put(int(doc), int(whole[doc]) * limit, size, at)
        else:
            cut.append(int(doc))
    for doc in cut:
        start, size = int(whole[doc]) * limit, int(rest[doc])
        while size:
            at = int(np.argmax(room))
            length = min(size, int(room[at]))
            put(doc, start, length, at)
            start, size = start + length, size - length
    return out


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = SEQUENCE_TOKENS, run_tokens: int = RUN_TOKENS) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ids are the piece's token ids as little-endian unsigned 32-bit integers.
    tokenizer is the path of a tokenizers file.  A null or empty text is the end
    id alone.  Repeated rows are packed as often as they come; a null id stays
    null.  Sequence ids hold the number of the task's partition in their upper
    bits, so a task that is run again gives the same ids.  No row is shuffled.
    Extra columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)

    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        gc.disable()  # millions of small lists, none of them in cycles
        try:
            yield from packed(batches)
        finally:  # also where the task fails or is abandoned: the worker is used again
            gc.enable()
            textscan.release()

    def packed(batches):
        encoder = WordEncoder(tokenizer)
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 33
        ids, pieces, tokens, used = [], [], 0, 0

        def flush():
            nonlocal ids, pieces, tokens, used
            rows = np.array(assign(np.array([len(p) for p in pieces], np.int64), limit), np.int64)
            for at in range(0, len(rows), 4096):
                doc, start, length, sequence, offset = rows[at : at + 4096].T
                parts = [pieces[d][s : s + n].astype("<u4").tobytes() for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
                columns = [pa.array([ids[d] for d in doc.tolist()], pa.int64()), start, length, pa.array(parts, pa.binary()), [len(pieces[d]) for d in doc.tolist()], sequence + (base + used), offset]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names)
            ids, pieces, tokens, used = [], [], 0, used + int(rows[:, 3].max()) + 1

        def take(some, texts):
            nonlocal tokens
            for doc, got in zip(some, encoder.encode(texts), strict=True):
                ids.append(doc)
                pieces.append(got)
                tokens += len(got)
                if tokens >= run_tokens:
                    yield from flush()

        for batch in batches:
            some, texts, chars = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                some.append(doc)
                texts.append(text.as_py())
                chars += len(texts[-1] or "")
                if chars >= BATCH_CHARS:
                    yield from take(some, texts)
                    some, texts, chars = [], [], 0
            yield from take(some, texts)
        if pieces:
            yield from flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)

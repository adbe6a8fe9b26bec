"""Cost-balanced packing of token sequences.

A piece of ``n`` tokens costs ``LINEAR * n + QUADRATIC * n * n`` (projections and MLP grow with the
tokens, attention within a document with their square). Documents are taken in descending length;
each goes to the cheapest sequence with room for the whole of it, or else is cut to fill the
cheapest sequence with any room, and its rest goes back among the documents. The sequences'
capacities add up to the tokens of a block: whole sequences of ``capacity`` tokens, and for the
last block of a task sequences whose sizes are the powers of two of the remainder, so nothing is
padded.

Blocks are cut within a scan task, so packing needs no shuffle; a task holds the ids of one block.
A repeated task reads the same rows and gives the same sequences.

Defined results: a null or empty text is the end token alone; a row without id is packed with a
null id; repeated rows are packed as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import gc
import heapq
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

CAPACITY = 4096
END_ID = 2
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
#: Sequences that are balanced against each other: the ids in memory are this times CAPACITY.
BLOCK_SEQUENCES = 256

TYPES = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(), "sequence_length": pa.int64(), "ids": pa.binary()}
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, sequence_length long, ids binary"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: After lower-casing: what the vocabulary's pre-tokenizer makes of characters up to U+00FF.
PLAIN = re.compile("[\x21-\x7e\xa1-\xff]+")
PRETOKEN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\\sa-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")


#: Marks a chunk that goes to the tokenizer as it is; chunks hold no white space.
ASIS = " "
#: Chunks, and pre-tokens, whose ids a worker keeps.
WORDS = 400_000


class Encoder:
    """Ids of whole texts; the tokenizer runs once per distinct pre-token.

    The vocabulary's pre-tokenizer never joins characters across white space, so a text's ids
    are its chunks' ids in order, and a chunk's ids are its pre-tokens'. Chunks with a character
    beyond U+00FF, or that spell a special token, go to the tokenizer as they are.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.light = Tokenizer.from_file(path)
        self.light.normalizer = None
        self.light.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.words = common.WordTable(self._chunks, limit=WORDS)
        self.parts = common.WordTable(self._pretokens, limit=WORDS)

    def _chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The chunks' ids, joined, and how many each has, by way of the table of pre-tokens."""
        plain = [PLAIN.fullmatch(c) and not ("<" in c and any(s in c for s in self.special)) for c in chunks]
        split = [PRETOKEN.findall(c.lower()) if p else [ASIS + c] for c, p in zip(chunks, plain)]
        rows = self.parts.rows(list(chain.from_iterable(split)))
        per = np.fromiter(map(len, split), np.int64, len(split))
        size = np.add.reduceat(self.parts.size[rows].astype(np.int64), np.cumsum(per) - per) if len(rows) else per
        return self.parts.gather(rows), size

    def _pretokens(self, parts: list[str]) -> list[list[int]]:
        fresh = [p for p in parts if not p.startswith(ASIS)]
        joined = [" ".join(fresh[k : k + 2000]) for k in range(0, len(fresh), 2000)]
        ids = [i for e in self.light.encode_batch_fast(joined, add_special_tokens=False) for i in e.ids]
        ends = (np.flatnonzero(self.ends[ids]) + 1).tolist() if ids else []
        if len(ends) != len(fresh):
            raise RuntimeError("a pre-token has no end mark in the vocabulary")
        spans = iter(zip([0, *ends], ends))
        return [ids[slice(*next(spans))] if not p.startswith(ASIS) else self.tokenizer.encode(p[len(ASIS) :], add_special_tokens=False).ids for p in parts]

    def __call__(self, text: str) -> np.ndarray:
        return self.all(pa.array([text]))[0]

    def all(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, null as empty; the texts' distinct chunks are looked up, each once."""
        chunks = pc.ascii_split_whitespace(pc.fill_null(texts, ""))  # the tokenizer separates there too
        coded = chunks.flatten().dictionary_encode()
        at = np.asarray(coded.indices)
        gc.disable()  # long lists of strings and no cycles
        try:
            rows = self.words.rows(coded.dictionary.to_pylist())[at]
        finally:
            gc.enable()
        ids = self.words.gather(rows)
        ends = np.concatenate([[0], np.cumsum(self.words.size[rows], dtype=np.int64)])[np.asarray(chunks.offsets) - chunks.offsets[0].as_py()].tolist()
        return [ids[a:b] for a, b in zip(ends, ends[1:])]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cost(n: float) -> float:
    return LINEAR * n + QUADRATIC * n * n


def capacities(total: int, capacity: int = CAPACITY) -> list[int]:
    """Full sequences, then the powers of two of what remains."""
    full, rest = divmod(total, capacity)
    return [capacity] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(pieces: list[tuple[int, int, int]], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length) pieces to (document, start, length, sequence, offset)."""
    room = np.array(capacities(sum(p[2] for p in pieces), capacity), np.int64)
    size, spent = room.copy(), np.zeros(len(room))
    waiting = [(-n, d, s) for d, s, n in pieces if n]
    heapq.heapify(waiting)
    out = []
    while waiting:
        n, d, s = heapq.heappop(waiting)
        n = -n
        price = np.where(room >= n, spent, np.inf)
        k = int(price.argmin())
        if price[k] == np.inf:
            k = int(np.where(room > 0, spent, np.inf).argmin())
        part = min(n, int(room[k]))
        out.append((d, s, part, k, int(size[k] - room[k])))
        room[k] -= part
        spent[k] += cost(part)
        if part < n:
            heapq.heappush(waiting, (part - n, d, s + part))
    return out


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, block_sequences: int = BLOCK_SEQUENCES) -> DataFrame:
    """One row per piece, with its ids as little-endian unsigned 32-bit integers."""
    path, block = tokenizer or default_tokenizer(), capacity * block_sequences

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        context = TaskContext.get()
        first = (context.partitionId() if context else 0) << 32
        names, ids, begun, held = [], [], [], 0  # documents of the open block; begun: ids already packed

        def close(last: bool):
            nonlocal first, held
            pieces, left = [], block if not last else held
            for k in range(len(ids)):
                n = min(len(ids[k]) - begun[k], left)
                pieces.append((k, begun[k], n))
                left -= n
            rows = pack(pieces, capacity)
            lengths = capacities(sum(p[2] for p in pieces), capacity)
            yield common.arrow_batch(
                {
                    "doc_id": [names[d] for d, *_ in rows],
                    "start": [r[1] for r in rows],
                    "length": [r[2] for r in rows],
                    "doc_tokens": [len(ids[d]) for d, *_ in rows],
                    "sequence_id": [first + r[3] for r in rows],
                    "offset": [r[4] for r in rows],
                    "sequence_length": [lengths[r[3]] for r in rows],
                    "ids": [ids[d][s : s + n].tobytes() for d, s, n, *_ in rows],
                },
                TYPES,
            )
            first += len(lengths)
            taken = pieces[-1][1] + pieces[-1][2]
            rest = len(ids[-1]) - taken
            keep = (names[-1], ids[-1], taken) if rest else None
            names.clear(), ids.clear(), begun.clear()
            if keep:
                names.append(keep[0]), ids.append(keep[1]), begun.append(keep[2])
            held = rest

        for batch in common.blocks(batches):
            for name, own in zip(batch.column(0).to_pylist(), encode.all(batch.column(1))):
                own = np.append(own, END_ID).astype("<u4")
                names.append(name), ids.append(own), begun.append(0)
                held += len(own)
                while held >= block:
                    yield from close(False)
        if held:
            yield from close(True)

    return common.map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, SCHEMA)

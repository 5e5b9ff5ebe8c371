"""Best-fit decreasing packing of token sequences, with a segment tree over remaining capacities.

Documents become token ids; only those longer than the capacity are cut, into full pieces and a last one.
Pieces of one length are interchangeable, so best-fit decreasing over the whole corpus is fixed by the
number of pieces of each length: a table of at most ``capacity`` rows, whatever the corpus. The driver packs
that table: open bins are counted by remaining capacity, a segment tree finds the tightest that fits, and
runs of equal bins are filled together. The plan it makes (runs of ranks within a length to runs of bins)
is bounded by the capacity alone. Executors then number their pieces within each length and look them up.

Defined results: a null or empty text is one piece holding the end id alone; repeated rows are packed each;
rows with a null doc_id are packed too; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, frugal

CAPACITY = 4096
END_ID = 1
#: Words, in Arrow, and stems whose ids a worker keeps; each memo starts anew beyond that, with the same results.
MEMO_WORDS, MEMO_STEMS = 600_000, 200_000
#: Bytes of texts that are encoded together.
TOGETHER = 4 << 20
#: A stem of Latin-1 letters, then perhaps punctuation: either is one run of tokens, closed by a token that ends a run.
PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+([!-&(-/:-@\\[-`{-~]*)")
_WORKER: dict = {}


class WordEncoder:
    """Texts to ids, equal to the tokenizer's own.

    The tokenizer drops white space before merging, so the ids of a text are those of its space-separated words; each
    distinct word is encoded once. Only separators that both know are split at. Words are told apart and looked up in
    Arrow, a batch of texts at a time, so that only new ones become Python objects.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.stems = Tokenizer.from_file(path), {"": b""}
        self._forget()
        settings = json.loads(self.tokenizer.to_str())
        suffix, lowers = settings["model"]["end_of_word_suffix"], '"Lowercase"' in json.dumps(settings["normalizer"])
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if suffix and token.endswith(suffix)]] = True
        self.plain_word = PLAIN.fullmatch if suffix and lowers else lambda _: None

    def _forget(self) -> None:
        # Known words, all their ids in a row, and where each word's begin and end.
        self.known, self.ids, self.bounds = pa.array([], pa.large_string()), np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _ids_of(self, texts: list[str]) -> list[bytes]:
        return [np.array(found.ids, "<u4").tobytes() for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_stems(self, new: list[str]) -> None:
        for at in range(0, len(new), 2000):  # many in one call; the tokens that end a run tell them apart
            some = new[at : at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            raw = ids.tobytes()
            pieces = [raw[a:b] for a, b in zip([0, *cuts], cuts)]
            self.stems.update(zip(some, pieces if len(pieces) == len(some) else self._ids_of(some)))

    def _encoded(self, words: list[str]) -> list[bytes]:
        """The ids of words, by way of their stems."""
        if len(self.stems) > MEMO_STEMS:
            self.stems = {"": b""}
        found, stems = list(map(self.plain_word, words)), self.stems
        plain = [(w[: m.start(1)].lower(), m[1]) if m else None for w, m in zip(words, found)]
        self._learn_stems(list({s for p in plain if p for s in p}.difference(stems)))
        other = [w for w, p in zip(words, plain) if not p]
        rest = (x for at in range(0, len(other), 4096) for x in self._ids_of(other[at : at + 4096]))
        return [stems[p[0]] + stems[p[1]] if p else next(rest) for p in plain]

    def _places(self, distinct: pa.Array) -> np.ndarray:
        """Where the known words are that equal ``distinct``; new ones become known."""
        at = pc.fill_null(pc.index_in(distinct, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if (at < 0).any() and len(self.known) and len(self.known) + len(distinct) > MEMO_WORDS:
            self._forget()
            at[:] = -1
        new = np.flatnonzero(at < 0)
        if len(new):
            words = distinct.take(pa.array(new))
            pieces = self._encoded(words.to_pylist())
            at[new] = len(self.known) + np.arange(len(new))
            sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
            self.known = pa.concat_arrays([self.known, words])
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(pieces), "<u4")])
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])
        return at

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text begins and ends."""
        split = pc.ascii_split_whitespace(texts.fill_null("").cast(pa.large_string()))
        coded = split.flatten().dictionary_encode()
        place = self._places(coded.dictionary)
        starts, sizes = self.bounds[place], self.bounds[place + 1] - self.bounds[place]
        codes = coded.indices.to_numpy(zero_copy_only=False)
        own = sizes[codes]
        ends = np.cumsum(own)
        at = np.repeat(starts[codes] - (ends - own), own)
        at += np.arange(len(at))
        words = np.cumsum(np.r_[0, pc.list_value_length(split).to_numpy(zero_copy_only=False)])
        return self.ids[at], np.r_[0, ends][words]

    def __call__(self, texts: list[str]) -> list[bytes]:
        ids, bounds = self.flat(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]


def word_encoder(path: str) -> WordEncoder:
    """The encoder of this process for a tokenizer's file."""
    if path not in _WORKER:
        _WORKER[path] = WordEncoder(path)
    return _WORKER[path]


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at least TOGETHER bytes, but for the last."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held, size = [*held, batch], size + batch.nbytes
        if size >= TOGETHER:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, with _part and _rank: the place among its partition's pieces of that length."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("_part", pa.int32()), ("_rank", pa.int64())])
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = word_encoder(path), TaskContext.get().partitionId(), defaultdict(int)
        for batch in gathered(batches):
            ids, bounds = encoder.flat(batch.column("text"))
            rows = []
            for doc, first, last in zip(batch.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                own = ids[first:last].tobytes() + end
                for piece, start in enumerate(range(0, len(own), 4 * capacity)):
                    some = own[start : start + 4 * capacity]
                    n = len(some) // 4
                    rows.append((doc, piece, start // 4, n, zlib.crc32(some), part, seen[n]))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, _part int, _rank long"
    return docs.select("doc_id", "text").mapInArrow(frugal(cut), ddl)


class Capacities:
    """A segment tree over remaining capacities 0..n: the runs of open bins that have each, and the tightest that fits."""

    def __init__(self, n: int):
        self.width = 1 << n.bit_length()
        self.count = [0] * (2 * self.width)
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def add(self, capacity: int, first: int, n: int) -> None:
        self.runs[capacity].append((first, n))
        at = self.width + capacity
        while at:
            self.count[at] += n
            at >>= 1

    def take(self, capacity: int) -> tuple[int, int]:
        first, n = self.runs[capacity].pop()
        at = self.width + capacity
        while at:
            self.count[at] -= n
            at >>= 1
        return first, n

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that an open bin has."""
        at = self.width + least
        while not self.count[at]:
            while at & 1:  # a right child: the wanted leaf lies beyond the parent
                at >>= 1
                if at <= 1:
                    return None
            at += 1
        while at < self.width:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.width


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """The plan: (length, first rank, first bin, pieces in each bin, offset); a run ends where the next of its length starts.

    ``counts``: pieces of each length. The same bins as best-fit decreasing, one piece at a time: a piece goes to the
    tightest open bin, which then stays the tightest until the length no longer fits, so bins are filled in turn.
    """
    open_bins, plan, bins = Capacities(capacity), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = open_bins.tightest(length)
            if room is None:
                room = capacity
                first, n = bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = open_bins.take(room)
            each = room // length
            used = min(n, -(-left // each))
            if used < n:
                open_bins.add(room, first + used, n - used)
            plan.append((length, rank, first, each, capacity - room))
            placed = min(left, used * each)
            last = placed - (used - 1) * each  # pieces in the last bin
            if used > 1 and room - each * length:
                open_bins.add(room - each * length, first, used - 1)
            if room - last * length:
                open_bins.add(room - last * length, first + used - 1, 1)
            rank, left = rank + placed, left - placed
    return plan


def pack(spark: SparkSession, docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces with sequence_id and offset."""
    scratch = Scratch(spark, "packing")
    cut = scratch.save(pieces(docs, path, capacity, end_id), "pieces")
    blocks = cut.groupBy("_part", "length").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = scratch.save(blocks.withColumn("_before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "blocks")
    counts = {r["length"]: r["n"] for r in blocks.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = np.array(best_fit(counts, capacity) or [(0, 0, 0, 1, 0)], np.int64)
    # For one sorted search over (length, rank): lengths get slots of ranks, one after another.
    lengths = np.array(sorted(counts), np.int64)
    slots = np.concatenate([[0], np.cumsum([counts[n] for n in lengths.tolist()])]).astype(np.int64)
    keys = slots[np.searchsorted(lengths, plan[:, 0])] + plan[:, 1] if counts else plan[:, 1]
    order = np.argsort(keys, kind="stable")
    table = spark.sparkContext.broadcast((lengths, slots, keys[order], plan[order]))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lengths, slots, keys, plan = table.value
        for rows in batches:
            key = slots[np.searchsorted(lengths, rows["length"].to_numpy())] + (rows["_before"] + rows["_rank"]).to_numpy()
            run = np.searchsorted(keys, key, side="right") - 1
            within, each = key - keys[run], plan[run, 3]
            out = rows[["doc_id", "piece", "start", "length", "ids_crc32"]].copy()
            out["sequence_id"] = plan[run, 2] + within // each
            out["offset"] = plan[run, 4] + within % each * plan[run, 0]
            yield out

    # Blocks grow with the corpus, up to a row for each length of each partition, so they are merged at every size.
    ranked = cut.join(blocks.select("_part", "length", "_before").hint("merge"), ["_part", "length"])
    return ranked.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every piece of every document, with its sequence and place."""
    return pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))

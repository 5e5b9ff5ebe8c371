"""Near-duplicate documents by MinHash with an LSH forest.

A document's shingles are its distinct runs of ``width`` words, as 64-bit hashes. Documents with one set are one class.
A class gets ORDERS * DEPTH minimum hashes; each of the ORDERS runs of DEPTH hashes is a key. All classes are sorted by
each key, and a run of classes with a common prefix of LEAST hashes is a branch. Depth adapts to how full a branch is:

* Within a branch a class takes its WINDOW neighbours on either side, which share the longest prefixes. A branch of at
  most WINDOW + 1 classes is thereby complete. Candidates are confirmed on the full sets, most alike first.
* The rest of a fuller branch is compared exactly: classes outside the branch's largest component with all of the
  branch, in blocks. A class goes no further once too few of its shingles occur on the other side of its block.

So each linked pair that shares LEAST hashes in one of the orders ends in one component, but for what the sketches say
wrongly of neighbours in small branches. Orders are range-sorted, so a branch that holds a third of all classes is
spread over tasks; the branches at the ends of a range may go on in the next one and count as full.

Defined results: a text without words (null and empty too) has an empty set, 0 shingles and no links; fewer words than
``width`` are one shingle; repeated rows are copies of each other; a null doc_id takes part in links but names no
component and is not kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import Scratch, components, frugal, partitions

ORDERS, DEPTH, LEAST = 16, 8, 4
HASHES = ORDERS * DEPTH
#: Neighbours that a class takes on each side of each order.
WINDOW = 3
#: Neighbours of a lower similarity by the one-bit sketches are over eight standard deviations under a threshold of 0.85, and 6.6 under 0.8.
SKETCH_BITS, SKETCH_LEAST = 128, 0.45
#: Neighbours that are confirmed first for each class, the most alike ones; of the others only those that would join components.
FIRST = 4
#: Classes, and shingles, of one side of a block.
BLOCK, BLOCK_SHINGLES, COLUMNS = 512, 1 << 20, 8192

_rng = np.random.default_rng(20240229)
FACTORS = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADDENDS = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
MIXERS = _rng.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; A-Z count as a-z."""
    split = [(t or "").encode().lower().split() for t in texts]
    flat = np.empty(sum(map(len, split)), object)
    flat[:] = [w for words in split for w in words]
    hashes = pd.util.hash_array(flat, categorize=False) if len(flat) else np.zeros(0, np.uint64)
    joined = np.zeros(max(0, len(flat) - width + 1), np.uint64)
    for k in range(width):
        joined += hashes[k : len(flat) - width + 1 + k] * MIXERS[k]
    joined, out, at = mixed(joined), [], 0
    for words in split:
        n = len(words)
        if n >= width:
            own = joined[at : at + n - width + 1]
        else:  # the whole sequence, told from longer ones by its length
            own = mixed((hashes[at : at + n] * MIXERS[:n]).sum(keepdims=True) + np.uint64(n)) if n else joined[:0]
        out.append(np.unique(own))
        at += n
    return out


def digest(values: np.ndarray) -> bytes:
    return hashlib.md5(values.tobytes(), usedforsecurity=False).digest()


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, HASHES) minimum hashes; every set has an element."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(((flat * FACTORS[k] + ADDENDS[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def sketch(signature: np.ndarray) -> np.ndarray:
    """(rows, 16) bytes: one bit of each minimum hash."""
    return np.packbits((mixed(signature.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)[:, :SKETCH_BITS], axis=1)


def row_key() -> Column:
    """The 128-bit name of a row: the MD5 of its id and text."""
    return F.unhex(F.md5(F.concat_ws("\0", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit("")))))


def signed(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, row (its name), n_shingles, set (digest) and signature of each document; no digest for an empty set."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.binary()), ("n_shingles", pa.int64()), ("set", pa.binary()), ("signature", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                sets = shingle_sets(batch.column("text").to_pylist(), width)
                full = [k for k, s in enumerate(sets) if len(s)]
                names, signs = [None] * len(sets), [None] * len(sets)
                if full:
                    found = signatures([sets[k] for k in full])
                    for k, s in zip(full, found):
                        names[k], signs[k] = digest(sets[k]), s.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), pa.array(signs, pa.binary())], schema=schema)

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), "text")
    return keyed.mapInArrow(frugal(run), "doc_id long, row binary, n_shingles long, set binary, signature binary")


def orders(classes: DataFrame) -> DataFrame:
    """(part, key, set, n, sketch): each class once in each order."""
    schema = pa.schema([("part", pa.int32()), ("key", pa.binary()), ("set", pa.binary()), ("n", pa.int64()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            signs = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(n, HASHES)
            sketches = pa.array([s.tobytes() for s in sketch(signs)], pa.binary())
            # Big-endian, so that the order of the bytes is the order of the hashes.
            keys = signs.reshape(n, ORDERS, DEPTH).astype(">u4")
            for k in range(ORDERS):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int32)), pa.array([x.tobytes() for x in keys[:, k]], pa.binary()), batch.column("set").cast(pa.binary()), batch.column("n"), sketches], schema=schema)

    return classes.select("set", "n", "signature").mapInArrow(frugal(run), "part int, key binary, set binary, n long, sketch binary")


def neighbours(branch: np.ndarray, sets: np.ndarray, sketches: np.ndarray, window: int, known: int = 0) -> pd.DataFrame:
    """Candidate pairs (a, b, alike) of sorted rows within ``window`` places of one branch; the first ``known`` rows have met already."""
    out = [pd.DataFrame({"a": [], "b": [], "alike": []})]
    for step in range(1, min(window, len(branch) - 1) + 1):
        at = np.flatnonzero(branch[step:] == branch[:-step])
        at = at[at + step >= known]
        alike = 1 - 2 * np.bitwise_count(sketches[at] ^ sketches[at + step]).sum(axis=1) / SKETCH_BITS
        at, alike = at[alike >= SKETCH_LEAST], alike[alike >= SKETCH_LEAST]
        first, second = sets[at], sets[at + step]
        turned = first > second
        out.append(pd.DataFrame({"a": np.where(turned, second, first), "b": np.where(turned, first, second), "alike": alike}))
    return pd.concat(out[1:] or out)


def walk(batches: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    """Sorted rows of a range to candidate pairs (a, b, alike) and to members (branch, a, n) of full branches.

    The first and the last branch of a range may go on in another range, so they count as full.
    """
    names = ["a", "b", "alike", "branch", "n"]

    def members(rows: pd.DataFrame) -> pd.DataFrame:
        branch = [bytes([p]) + k[: 4 * LEAST] for p, k in zip(rows["part"], rows["key"])]
        return pd.DataFrame({"a": rows["set"], "b": None, "alike": None, "branch": branch, "n": rows["n"]})[names]

    # tail: the last rows; held: those of the last branch, unless it is full and has been given out.
    tail, held, full, begun = None, [], True, False
    for rows in batches:
        if not len(rows):
            continue
        known = 0 if tail is None else len(tail)
        joined = rows if tail is None else pd.concat([tail, rows], ignore_index=True)
        keys = np.frombuffer(b"".join(joined["key"]), np.uint8).reshape(len(joined), 4 * DEPTH)[:, : 4 * LEAST]
        parts = joined["part"].to_numpy()
        new = (parts[1:] != parts[:-1]) | (keys[1:] != keys[:-1]).any(axis=1)
        branch = np.r_[0, np.cumsum(new)]
        sketches = np.frombuffer(b"".join(joined["sketch"]), np.uint64).reshape(len(joined), -1)
        yield neighbours(branch, joined["set"].to_numpy(object), sketches, window, known).assign(branch=None, n=None)[names]
        tail = joined.tail(window)
        own = branch[known:]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        sizes = np.diff(np.r_[starts, len(own)])
        give, out = np.repeat(sizes > window + 1, sizes), []
        goes_on = bool(known) and own[0] == branch[known - 1]
        if not goes_on:
            held, full = [], not begun
        begun = True
        if full or sum(map(len, held)) + sizes[0] > window + 1:
            out, held, full = [*held], [], True
            give[: sizes[0]] = True
        if len(starts) > 1:
            held, full = [], bool(give[-1])
        if not full:
            held = [*held, rows.iloc[starts[-1] :]]
        out.append(rows[give])
        yield members(pd.concat(out))
    if held:
        yield members(pd.concat(held))


def candidates(scratch: Scratch, rows: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, alike), a < b, of neighbours in any order, and the members (branch, set, n) of full branches."""
    order = ["part", "key", "set"]
    ranged = rows.repartitionByRange(partitions(scratch.spark), *order).sortWithinPartitions(*order)
    walked = ranged.mapInPandas(frugal(lambda batches: walk(batches, window)), "a binary, b binary, alike double, branch binary, n long")
    found = scratch.save(walked, "forest")
    pairs = found.where("b IS NOT NULL").groupBy("a", "b").agg(F.max("alike").alias("alike"))
    return scratch.save(pairs, "pairs"), found.where("b IS NULL").select("branch", F.col("a").alias("set"), "n")


def elements(docs: DataFrame, width: int) -> DataFrame:
    """(set, shingles): the sorted hashes of one text of each class; ``docs`` has (set, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                sets = shingle_sets(batch.column("text").to_pylist(), width)
                yield pa.RecordBatch.from_arrays([batch.column("set").cast(pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["set", "shingles"])

    return docs.mapInArrow(frugal(run), "set binary, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with _linked: whether 100 * intersection >= percent * union on the full sets."""
    columns = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("left"), batch.column("right")):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                n = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * n >= percent * (len(x) + len(y) - n))
            yield batch.select(columns).append_column("_linked", pa.array(good, pa.bool_()))

    left = sets.select(F.col("set").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("set").alias("b"), F.col("shingles").alias("right"))
    return pairs.join(left, "a").join(right, "b").select(*columns, "left", "right").mapInArrow(frugal(run), T.StructType([*pairs.schema.fields, T.StructField("_linked", T.BooleanType())]))


def best(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of each class with its FIRST most alike candidates."""
    both = pairs.select(F.explode(F.array(F.struct("a", "b", "alike"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "alike"))).alias("e")).select("e.*")
    # A class has at most 2 * WINDOW * ORDERS candidates in its own orders, and is in as many windows of others.
    most = both.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("alike", "b")), asc=False), 1, FIRST).alias("_best"))
    flat = most.select("a", F.explode("_best.b").alias("b"))
    return flat.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def possible(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which sets of either side have enough elements on the other side to reach the threshold with any set there."""
    sides, on = [left, right], [np.ones(len(left), bool), np.ones(len(right), bool)]
    while True:
        before = [x.copy() for x in on]
        for k in (0, 1):
            there = [s for s, alive in zip(sides[1 - k], on[1 - k]) if alive]
            mine = np.flatnonzero(on[k])
            if not there or not len(mine):
                return np.zeros(len(left), bool), np.zeros(len(right), bool)
            sizes = np.array([len(sides[k][i]) for i in mine])
            hits = np.isin(np.concatenate([sides[k][i] for i in mine]), np.unique(np.concatenate(there)))
            found = np.add.reduceat(hits.astype(np.int64), np.cumsum(sizes) - sizes)
            on[k][mine] = 100 * found >= percent * sizes
        if all((x == y).all() for x, y in zip(before, on)):
            return on[0], on[1]


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """(left, right) sizes of the intersections, by products of membership matrices over the elements on both sides."""
    flat = [np.concatenate(x) for x in (left, right)]
    both = np.intersect1d(*map(np.unique, flat), assume_unique=True)
    places = []
    for sets, values in zip((left, right), flat):
        at = np.searchsorted(both, values)
        known = at < len(both)
        known[known] = both[at[known]] == values[known]
        places.append((np.repeat(np.arange(len(sets)), [len(x) for x in sets])[known], at[known]))
    out = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, len(both), COLUMNS):
        part = []
        for sets, (rows, at) in zip((left, right), places):
            member = np.zeros((len(sets), COLUMNS), np.float32)
            inside = (at >= first) & (at < first + COLUMNS)
            member[rows[inside], at[inside] - first] = 1
            part.append(member)
        out += part[0] @ part[1].T
    return np.rint(out).astype(np.int64)


def meet(percent: int):
    """applyInPandas function over one block: links (a, b) between components of its two sides."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        q, t = (rows[rows["_side"] == k] for k in (1, 0))
        none = pd.DataFrame({"a": [], "b": []})
        if not len(t) or not len(q):
            return none
        left, right = ([np.frombuffer(s, np.uint64) for s in x["shingles"]] for x in (q, t))
        some_q, some_t = possible(left, right, percent)
        if not some_q.any():
            return none
        names, place = np.unique(np.r_[q["component"].to_numpy(object)[some_q], t["component"].to_numpy(object)[some_t]], return_inverse=True)
        left, right = ([s for s, alive in zip(x, on) if alive] for x, on in ((left, some_q), (right, some_t)))
        common = common_counts(left, right)
        total = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])
        u, v = np.nonzero(100 * common >= percent * (total - common))
        ends = np.unique(np.column_stack([place[: len(left)][u], place[len(left) :][v]]), axis=0)
        ends = ends[ends[:, 0] != ends[:, 1]]
        return pd.DataFrame({"a": names[ends[:, 0]], "b": names[ends[:, 1]]})

    return run


def rest_of_branches(scratch: Scratch, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components within full branches: all that are not within one component already.

    ``members``: (branch, set, n, component). Every class outside its branch's largest component is compared with all
    classes of the branch, in blocks by hash of about BLOCK classes a side, however large the branch.
    """
    sizes = members.groupBy("branch", "component").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    whole = sizes.groupBy("branch").agg(F.max(F.struct("c", "component", "s")).alias("_m"), F.count("*").alias("_parts"), F.sum("c").alias("_c"), F.sum("s").alias("_s"))
    blocks = lambda c, s: F.greatest(F.lit(1), F.ceil(c / BLOCK), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    mixed_branches = whole.where("_parts > 1").select("branch", F.col("_m.component").alias("_largest"), blocks(F.col("_c"), F.col("_s")).alias("_t"), blocks(F.col("_c") - F.col("_m.c"), F.col("_s") - F.col("_m.s")).alias("_q"))
    mixed_branches = scratch.save(mixed_branches, "mixed-branches")
    # A class is a target in one t, for each q, and, outside the largest component, a query in one q, for each t.
    spot, at = F.pmod(F.xxhash64("set"), F.lit(1 << 20)), lambda t, q, side: F.struct(t.cast("int").alias("t"), q.cast("int").alias("q"), F.lit(side).alias("_side"))
    target = F.transform(F.sequence(F.lit(0), F.col("_q") - 1), lambda q: at(spot % F.col("_t"), q, 0))
    query = F.transform(F.sequence(F.lit(0), F.col("_t") - 1), lambda t: at(t, spot % F.col("_q"), 1))
    placed = members.join(mixed_branches, "branch").join(sets, "set").select("branch", "component", "shingles", F.explode(F.when(F.col("component") == F.col("_largest"), target).otherwise(F.concat(target, query))).alias("_at"))
    return placed.select("branch", "component", "shingles", "_at.*").groupBy("branch", "t", "q").applyInPandas(meet(percent), "a binary, b binary")


def linked(scratch: Scratch, pairs: DataFrame, full: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(set, component) of all classes that have links."""
    first = scratch.save(confirmed(best(pairs), sets, percent), "links")
    named = scratch.save(components(scratch, first.where("_linked"), "linked").select(F.col("id").alias("set"), "component"), "named")
    of = lambda c: named.select(F.col("set").alias(c), F.col("component").alias(f"_{c}"))
    apart = pairs.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    apart = apart.select("a", "b", F.coalesce("_a", "a").alias("_a"), F.coalesce("_b", "b").alias("_b")).where("_a <> _b").join(first, ["a", "b"], "left_anti")
    others = confirmed(apart, sets, percent).where("_linked").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    members = full.join(named, "set", "left").withColumn("component", F.coalesce("component", "set"))
    members = scratch.save(members, "members-of-branches")
    # Components that further links connect, as links between their names.
    further = scratch.save(others.union(rest_of_branches(scratch, members, sets, percent)), "further")
    joined = components(scratch, further, "joined").select(F.col("id").alias("_of"), F.col("component").alias("_joined"))
    both = named.join(joined, F.col("component") == F.col("_of"), "left").select("set", F.coalesce("_joined", "component").alias("component"))
    # Classes that only a further link connects are their own component so far.
    return both.union(joined.join(named.select(F.col("set").alias("_of")), "_of", "left_anti").select(F.col("_of").alias("set"), F.col("_joined").alias("component")))


def grouped(scratch: Scratch, docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, row (its name), n_shingles, component (null without shingles)."""
    rows = scratch.save(signed(docs, width), "signed")
    classes = rows.where("set IS NOT NULL").groupBy("set", F.col("n_shingles").alias("n"), "signature").agg(F.lit(1).alias("_"))
    pairs, full = candidates(scratch, orders(classes))
    # One text of each class that has candidates. What is wanted grows with the corpus, so it is merged at every size.
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set")).union(full.select("set")).distinct()
    chosen = rows.where("set IS NOT NULL").groupBy("set").agg(F.min("row").alias("row")).join(wanted.hint("merge"), "set")
    texts = docs.select(row_key().alias("row"), "text").join(chosen.hint("merge"), "row").select("set", "text").dropDuplicates(["set"])
    sets = scratch.save(elements(texts, width), "sets")
    named = linked(scratch, pairs, full, sets, percent)
    members = rows.select("doc_id", "row", "n_shingles", "set").join(named, "set", "left")
    members = members.select("doc_id", "row", "n_shingles", F.coalesce("component", "set").alias("component"))
    return scratch.save(members, "members")


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, row, n_shingles, component_id, kept."""
    scratch = Scratch(spark, "minhash")
    members = grouped(scratch, docs, width, percent)
    # Written, so that the join deals both sides anew and can split a component that holds a third of all rows.
    least = scratch.save(members.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    out = members.join(least, "component", "left")
    component = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "row", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def link_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: components of all documents at three words and a similarity of 0.85."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(spark, docs, 3, 85).drop("row")


LINK_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS total, count(*) AS common FROM shingles a JOIN shingles b
  ON a.g = b.g AND a.doc_id <> b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 85 GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * common >= 85 * (total - common)),
reach AS (SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a),
least_id AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM sets s JOIN least_id ON s.doc_id = id
"""

"""N-gram Jaccard join through a token-group matrix.

Documents are sets of five-word shingles (tokens). The join finds every pair of different
sets with a Jaccard similarity of at least 0.75, up to connectivity: pairs already known to
be connected are not opened again. Four steps, each exact:

1. *Overlap bound against everything.* A set that links with another holds at least
   ``ceil(0.75 n)`` of its tokens in common with it. The holders of every token in half of
   the token space are counted (one shuffle of packed postings); a set whose shared tokens
   there cannot reach the bound links with nothing and leaves the join.
2. *Leaders.* Sets with an equal minimum hash meet the least of them; verified sets link to
   it. A set whose tokens outside its own component of these links cannot reach the bound
   leaves as well.
3. *Token-group matrix.* The sets left are cut into groups of similar ones (order of the
   minimum hash). The matrix holds, per token, the groups whose union has it; it gives every
   set's overlap with every group's union, and only groups at or above the bound are opened.
4. *Opened groups*: the set is compared with all members on whole sets, inside one task; only
   links to other components leave it.

Exact copies are one set throughout, so a group of copies of any size costs one posting list.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lexiloom.llm.components import connected_components
from lexiloom.llm.tables import only_ids, query, table, without_ids
from lexiloom.llm.words import WordIds, mixed, shingles
from lexiloom.session import cut_lineage

#: Minimum hashes per set, each a chance to meet a leader.
HASHES = 6
#: A minimum hash of more than this share of the sets is hot.
HOT_SHARE = 1 / 256
#: Text bytes whose postings are sorted and packed together; bounds the memory of a task.
PACK_BYTES = 4 << 20
#: Documents per token bucket.
DOCS_PER_BUCKET = 2048
#: Sets of a group in the matrix, as a power of two.
GROUP_BITS = 8

_MARK = np.uint64((1 << 40) - 1)
_SIGNED = np.int64
_SETS = "bucket int, doc_id long, n long, fp long, keys array<long>, mark long, shared long, postings binary"


def needed(n: np.ndarray | int, percent: int = 75):
    """The least number of tokens a set of ``n`` has in common with a set it links with."""
    return (n * percent + 99) // 100


def document_set(text: bytes | None, ids: WordIds, width: int = 5) -> np.ndarray:
    return shingles(ids.of(text.lower().split()), width) if text else np.empty(0, np.uint64)


def fingerprint(tokens: np.ndarray) -> int:
    return int.from_bytes(blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _minimum_hashes(tokens: np.ndarray) -> list[int]:
    return [int(mixed(tokens ^ np.uint64(0xA5A5 * (r + 1))).min().astype(_SIGNED)) for r in range(HASHES)]


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the runs of equal values in a sorted array."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, int)
    return starts, np.diff(np.append(starts, len(keys)))


_ROW_SCHEMA = pa.schema([
    ("bucket", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64())),
    ("mark", pa.int64()), ("shared", pa.int64()), ("postings", pa.binary()),
])


def _rows(columns: dict) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in _ROW_SCHEMA],
        schema=_ROW_SCHEMA,
    )


def _packed(tokens: list[np.ndarray], marks: list[int], bits: int) -> Iterator[pa.RecordBatch]:
    """Postings of a block of sets: one binary per token bucket, plus counts settled here.

    A posting is one integer: 24 token bits above the 40-bit mark of its set. A token with
    many holders in this block keeps two postings; the other holders are counted as sharing
    it on the spot, so that a token of very many sets stays small in the shuffle. So are
    tokens of one set with the same posting: the counts may be too high, never too low.
    """
    lengths = [len(t) for t in tokens]
    if not sum(lengths):
        return
    token = np.concatenate(tokens)
    mark = np.repeat(np.array(marks, dtype=np.uint64), lengths)
    # The top bit chose the half of the token space, the next `bits` are the bucket.
    bucket = (token >> np.uint64(63 - bits)).astype(np.int64)
    posting = ((token >> np.uint64(39 - bits)) << np.uint64(40)) | mark
    order = np.lexsort((posting, bucket))
    bucket, posting = bucket[order], posting[order]
    fresh = np.concatenate([[True], (posting[1:] != posting[:-1]) | (bucket[1:] != bucket[:-1])])
    doubles = posting[~fresh]
    bucket, posting = bucket[fresh], posting[fresh]
    starts, sizes = _runs((bucket << 24) | (posting >> np.uint64(40)).astype(np.int64))
    nth = np.arange(len(posting)) - np.repeat(starts, sizes)
    settled = nth >= 2
    if settled.any() or len(doubles):
        found, counts = np.unique(np.concatenate([posting[settled], doubles]) & _MARK, return_counts=True)
        yield _rows({"bucket": (found % np.uint64(1 << bits)).astype(np.int32), "mark": found.astype(_SIGNED), "shared": counts})
        bucket, posting = bucket[~settled], posting[~settled]
    starts, sizes = _runs(bucket)
    yield _rows({
        "bucket": bucket[starts].astype(np.int32),
        "postings": [posting[a : a + n].tobytes() for a, n in zip(starts, sizes)],
    })


def _lower_half(tokens: np.ndarray) -> np.ndarray:
    return tokens[: np.searchsorted(tokens, np.uint64(1 << 63))]


def _describe(bits: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            doc_ids = batch.column("doc_id")
            rows, tokens, marks, held, packed = [], [], [], 0, set()
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                own = document_set(text, ids, width)
                fp = fingerprint(own) if len(own) else None
                doc_id = doc_ids[i].as_py()
                rows.append((doc_id, len(own), fp, _minimum_hashes(own) if len(own) else None, len(_lower_half(own))))
                if len(own) and fp not in packed:
                    packed.add(fp)
                    tokens.append(_lower_half(own))
                    marks.append(fp & int(_MARK))
                held += len(text or b"")
                if held >= PACK_BYTES or i == batch.num_rows - 1:
                    yield from _packed(tokens, marks, bits)
                    doc, n, fps, keys, half = map(list, zip(*rows))
                    yield _rows({"bucket": [(d or 0) % (1 << bits) for d in doc], "doc_id": doc, "n": n, "fp": fps, "keys": keys, "shared": half})
                    rows, tokens, marks, held, packed = [], [], [], 0, set()

    return run


def _count_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass described sets on; turn each bucket's postings into shared-token counts per mark.

    Buckets arrive one after the other; one bucket is held at a time.
    """
    current, pending = None, []
    found: list[np.ndarray] = []

    def close() -> None:
        if not pending:
            return
        posting = np.sort(np.frombuffer(b"".join(pending), dtype=np.uint64))
        posting = posting[np.concatenate([[True], posting[1:] != posting[:-1]])]
        starts, sizes = _runs(posting >> np.uint64(40))
        found.append(posting[np.repeat(sizes >= 2, sizes)] & _MARK)
        pending.clear()

    def counted() -> Iterator[pa.RecordBatch]:
        if found:
            marks, counts = np.unique(np.concatenate(found), return_counts=True)
            found.clear()
            for low in range(0, len(marks), 50_000):
                part = slice(low, low + 50_000)
                yield _rows({"bucket": np.zeros(len(marks[part]), np.int32), "mark": marks[part].astype(_SIGNED), "shared": counts[part]})

    for batch in batches:
        postings = batch.column("postings")
        plain = postings.is_null()
        if plain.true_count:
            yield pa.RecordBatch.from_arrays(
                [c.cast(f.type) for c, f in zip(batch.filter(plain).columns, _ROW_SCHEMA)], schema=_ROW_SCHEMA
            )
        packed = batch.filter(postings.is_valid())
        for bucket, blob in zip(packed.column("bucket").to_pylist(), packed.column("postings")):
            if bucket != current:
                close()
                current = bucket
                if sum(map(len, found)) > 2_000_000:
                    yield from counted()
            pending.append(blob.as_py())
    close()
    yield from counted()


def describe(docs: DataFrame, percent: int = 75, width: int = 5) -> tuple[DataFrame, DataFrame]:
    """Sets of all documents and, for sets that can link at all, one representative each.

    First: ``doc_id, n, fp``. Second: ``rep, n, keys`` for the distinct sets that pass the
    overlap bound, ``rep`` being the least document with that set.
    """
    count = docs.count()
    bits = max(2, min(22, (max(count, 1) // DOCS_PER_BUCKET).bit_length()))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packed = rows.mapInArrow(_describe(bits, width), _SETS).repartition("bucket").sortWithinPartitions("bucket")
    told = cut_lineage(packed.mapInArrow(_count_shared, _SETS).drop("bucket", "postings"))
    sets = told.where("mark is null").select("doc_id", "n", "fp")
    shared = told.where("mark is not null").groupBy("mark").agg(F.sum("shared").alias("common"))
    distinct = (
        told.where("mark is null and fp is not null and doc_id is not null").groupBy("fp")
        .agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("shared").alias("half"), F.min("keys").alias("keys"))
        .withColumn("mark", F.col("fp").bitwiseAND(F.lit((1 << 40) - 1)))
    )
    # Of the tokens in the half, all that the set may lack could lie there.
    lacking = F.col("n") - F.floor((F.col("n") * percent + 99) / 100)
    able = distinct.join(shared, "mark").where(F.col("common") >= F.greatest(F.lit(0), F.col("half") - lacking))
    # A set with next to nothing in the half has no bound there and stays in the join.
    loose = distinct.where(F.col("half") <= lacking).join(shared, "mark", "left_anti")
    keep = ["rep", "n", "keys"]
    return sets, cut_lineage(able.select(keep).union(loose.select(keep)))


def _store_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            for low in range(0, batch.num_rows, 256):
                part = texts.slice(low, 256)
                own = [document_set(part[i].as_py(), ids, width) for i in range(len(part))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, 256), pa.array([len(t) for t in own], pa.int64()),
                     pa.array([_minimum_hashes(t)[0] if len(t) else 0 for t in own], pa.int64()), pa.array([t.tobytes() for t in own], pa.binary())],
                    names=["rep", "n", "likeness", "tokens"],
                )

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("left"), batch.column("right")):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (left, right))
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            chosen = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(chosen) for c in ("a", "b")], names=["a", "b"])

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int = 75) -> DataFrame:
    """The pairs ``a, b`` whose whole sets reach the similarity."""
    first = sets.select(F.col("rep").alias("a"), F.col("tokens").alias("left"))
    second = sets.select(F.col("rep").alias("b"), F.col("tokens").alias("right"))
    return pairs.join(second, "b").join(first, "a").select("a", "b", "left", "right").mapInArrow(_linked(percent), "a long, b long")


def leader_pairs(able: DataFrame, percent: int = 75) -> DataFrame:
    """Every set with the least set that has the same minimum hash, for each of the hashes.

    A hash held by more than ``HOT_SHARE`` of the sets meets its leader by a broadcast; there
    are fewer than ``HASHES / HOT_SHARE`` such hashes. The others are shuffled.
    """
    keyed = able.select("rep", "n", F.posexplode("keys").alias("nth", "key"))
    leaders = keyed.groupBy("nth", "key").agg(F.min(F.struct("rep", "n")).alias("lead"), F.count("*").alias("size")).where("size > 1")
    leaders = cut_lineage(leaders)
    hot = F.col("size") > able.count() * HOT_SHARE
    told = keyed.join(F.broadcast(leaders.where(hot).select("nth", "key", F.col("lead").alias("own"))), ["nth", "key"], "left")
    met = told.where("own is not null").select("rep", "n", F.col("own").alias("lead")).union(
        told.where("own is null").join(leaders.where(~hot), ["nth", "key"]).select("rep", "n", "lead")
    )
    return (
        met.where(f"rep <> lead.rep and 100 * least(n, lead.n) >= {percent} * greatest(n, lead.n)")
        .select(F.col("lead.rep").alias("a"), F.col("rep").alias("b")).distinct()
    )


_MATRIX = "bucket int, heads binary, tokens binary"


def _token_columns(bits: int):
    """Cut sets into token buckets, keeping whole tokens: one row per bucket and block of sets.

    ``heads`` holds set, group, size and number of tokens here of every set in the row, in the
    order of ``tokens``.
    """

    def packed(carried: list[tuple], tokens: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        token = np.concatenate(tokens)
        owner = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
        bucket = (token >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        token, owner, bucket = token[order], owner[order], bucket[order]
        first, sizes = _runs(bucket * len(tokens) + owner)
        heads = np.column_stack([np.array(carried, dtype=np.int64)[owner[first]], sizes])
        starts, lengths = _runs(bucket)
        cuts = np.searchsorted(first, np.append(starts, len(token)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket[starts].astype(np.int32)), pa.array([heads[x:y].tobytes() for x, y in zip(cuts, cuts[1:])], pa.binary()),
             pa.array([token[x : x + k].tobytes() for x, k in zip(starts, lengths)], pa.binary())],
            names=["bucket", "heads", "tokens"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, tokens, held = [], [], 0
        for batch in batches:
            for *own, blob in zip(*(batch.column(c).to_pylist() for c in ("rep", "grp", "n", "tokens"))):
                carried.append(own)
                tokens.append(np.frombuffer(blob, dtype=np.uint64))
                held += len(blob)
                if held >= PACK_BYTES:
                    yield from packed(carried, tokens)
                    carried, tokens, held = [], [], 0
        if held:
            yield from packed(carried, tokens)

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Tokens, sets, groups and figures of one bucket after the other, sorted by token and group."""
    current, held = None, []

    def close():
        heads = np.concatenate([np.frombuffer(h, dtype=np.int64).reshape(-1, 4) for h, _ in held])
        token = np.concatenate([np.frombuffer(t, dtype=np.uint64) for _, t in held])
        carried = np.repeat(heads[:, :3], heads[:, 3], axis=0)
        order = np.lexsort((carried[:, 1], token))
        held.clear()
        token, carried = token[order], carried[order]
        return token, carried[:, 0], carried[:, 1], carried[:, 2:]

    for batch in batches:
        for bucket, heads, tokens in zip(*(batch.column(c).to_pylist() for c in ("bucket", "heads", "tokens"))):
            if bucket != current and held:
                yield close()
            current = bucket
            held.append((heads, tokens))
    if held:
        yield close()


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of the stacked keys and the sums of their counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    rows, place = np.unique(key, axis=0, return_inverse=True)
    return rows, np.bincount(place.ravel(), weights=count, minlength=len(rows)).astype(np.int64)


def _flushing(parts: Iterator[tuple[np.ndarray, np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Sum keyed counts over the buckets of a task; what is held is summed whenever it is large."""
    keys, counts = [], []
    for key, count in parts:
        keys.append(key)
        counts.append(count)
        if sum(map(len, counts)) > 1_000_000:
            rows, sums = _summed(keys, counts)
            keys, counts = [rows], [sums]
            if len(rows) > 500_000:
                yield pa.RecordBatch.from_arrays([*map(pa.array, rows.T), pa.array(sums)], names=names)
                keys, counts = [], []
    if keys:
        rows, sums = _summed(keys, counts)
        yield pa.RecordBatch.from_arrays([*map(pa.array, rows.T), pa.array(sums)], names=names)


def _cross_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per set, how many of its tokens some other group holds."""

    def parts():
        for token, rep, grp, _ in _buckets(batches):
            starts, sizes = _runs(token)
            several = grp[starts] != grp[starts + sizes - 1]
            found, counts = np.unique(rep[np.repeat(several, sizes)], return_counts=True)
            yield found[:, None], counts

    yield from _flushing(parts(), ["rep", "n_cross"])


def _group_overlaps(slices: int):
    """Per group, the sets that meet its token union and in how many tokens, packed.

    In a token's run every set meets every group that holds the token. The meetings are summed
    over all buckets of the task; one row leaves per group and slice of the sets.
    """

    def parts(batches):
        for token, rep, grp, carried in _buckets(batches):
            starts, sizes = _runs(token)
            reps, first, rep_at = np.unique(rep, return_index=True, return_inverse=True)
            grps, grp_at = np.unique(grp, return_inverse=True)
            n = carried[first, 0]
            block, held = [], 0

            def summed():
                codes, counts = np.unique(np.concatenate(block), return_counts=True)
                at = codes // len(grps)
                return np.stack([grps[codes % len(grps)], reps[at], n[at]], axis=1), counts

            for a, k in zip(starts, sizes):
                if k < 2:
                    continue
                unions = np.unique(grp_at[a : a + k])
                for low in range(a, a + k, 4096):
                    mine = rep_at[low : min(low + 4096, a + k)]
                    block.append((mine[:, None] * len(grps) + unions[None, :]).ravel())
                    held += len(block[-1])
                    if held > 1_000_000:
                        yield summed()
                        block, held = [], 0
            if held:
                yield summed()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _flushing(parts(batches), ["grp", "rep", "n", "common"]):
            grp, rep, n, common = (c.to_numpy() for c in batch.columns)
            part = (mixed(rep.astype(np.uint64)) % np.uint64(slices)).astype(np.int64)
            order = np.lexsort((part, grp))
            starts, sizes = _runs(grp[order] * slices + part[order])
            rows = [order[a : a + k] for a, k in zip(starts, sizes)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([grp[r[0]] for r in rows], pa.int64()), pa.array([part[r[0]] for r in rows], pa.int64()),
                 pa.array([np.stack([rep[r], n[r], common[r]]).tobytes() for r in rows], pa.binary())],
                names=["grp", "part", "met"],
            )

    return run


def _qualifying(percent: int):
    """Sets whose overlap with a group's token union reaches what a link needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def close():
            met = np.concatenate(held, axis=1)
            rows, sums = _summed([met[:2].T], [met[2]])
            keep = rows[sums >= needed(rows[:, 1], percent)]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(keep[:, 0]), pa.array(np.full(len(keep), current[0], dtype=np.int64))], names=["rep", "grp"]
            )

        for batch in batches:
            for grp, part, met in zip(*(batch.column(c).to_pylist() for c in ("grp", "part", "met"))):
                if (grp, part) != current and held:
                    yield close()
                current = (grp, part)
                held.append(np.frombuffer(met, dtype=np.int64).reshape(3, -1))
        if held:
            yield close()

    return run


def _open_groups(percent: int):
    """Compare every query set with all members of a group, one group (and part) after the other.

    Rows arrive with a group's members first. The members' tokens form one sorted list; a
    query's overlaps with all of them are one lookup and one count. One link per component
    other than the query's own leaves; more would connect nothing new.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, loaded, members = None, None, []

        def load():
            sizes = np.array([len(t) // 8 for _, _, t in members])
            token = np.concatenate([np.frombuffer(t, dtype=np.uint64) for _, _, t in members])
            owner = np.repeat(np.arange(len(members)), sizes)
            order = np.argsort(token, kind="stable")
            rep, comp = (np.array([m[i] for m in members], dtype=np.int64) for i in (0, 1))
            return token[order], owner[order], sizes, rep, comp

        for batch in batches:
            a, b = [], []
            for grp, part, is_query, rep, comp, tokens in zip(*(batch.column(c).to_pylist() for c in ("grp", "part", "is_query", "rep", "comp", "tokens"))):
                if (grp, part) != current:
                    current, loaded, members = (grp, part), None, []
                if not is_query:
                    members.append((rep, comp, tokens))
                    continue
                if loaded is None:
                    loaded = load()
                token, owner, sizes, reps, comps = loaded
                if (comps == comp).all():
                    continue
                own = np.frombuffer(tokens, dtype=np.uint64)
                low, high = np.searchsorted(token, own, "left"), np.searchsorted(token, own, "right")
                width = high - low
                hits = owner[np.repeat(low - np.cumsum(width) + width, width) + np.arange(width.sum())]
                both = np.bincount(hits, minlength=len(sizes))
                linked = np.flatnonzero((100 * both >= percent * (sizes + len(own) - both)) & (comps != comp))
                for at in linked[np.unique(comps[linked], return_index=True)[1]]:
                    a.append(rep)
                    b.append(int(reps[at]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def components_of_sets(docs: DataFrame, able: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """``node, component`` over the representatives that link with some other set."""
    sets = cut_lineage(
        only_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), able.select(F.col("rep").alias("doc_id")))
        .mapInArrow(_store_sets(width), "rep long, n long, likeness long, tokens binary")
    )
    star = cut_lineage(verified(leader_pairs(able, percent), sets, percent))
    groups = connected_components(star)

    bits = max(2, min(22, (max(able.count(), 1) // DOCS_PER_BUCKET).bit_length() + 2))
    grouped = sets.join(groups.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))

    def matrix(rows: DataFrame, group: str) -> DataFrame:
        columns = rows.select("rep", F.col(group).alias("grp"), "n", "tokens")
        return columns.mapInArrow(_token_columns(bits), _MATRIX).repartition("bucket").sortWithinPartitions("bucket")

    # Sets that the components of the star links could not still connect to any other leave.
    crossing = (
        matrix(grouped, "comp").mapInArrow(_cross_counts, "rep long, n_cross long")
        .groupBy("rep").agg(F.sum("n_cross").alias("n_cross"))
    )
    left = (
        grouped.join(crossing, "rep").where(F.col("n_cross") >= F.floor((F.col("n") * percent + 99) / 100))
        .select("rep", "n", "likeness", "comp", "tokens")
    )
    # Groups of similar sets: neighbours in the order of the minimum hash, 2 ** GROUP_BITS each,
    # however the rows are partitioned: a row's rank is its place in its partition plus the rows
    # of the partitions before it.
    ordered = left.repartitionByRange("likeness", "rep").sortWithinPartitions("likeness", "rep")
    placed = cut_lineage(ordered.withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    rank = F.col("offset") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    left = cut_lineage(
        placed.join(F.broadcast(offsets), "part").withColumn("grp", F.shiftright(rank, GROUP_BITS)).drop("at", "part", "offset")
    )

    slices = max(1, left.count() // 16_384)
    query_groups = cut_lineage(
        matrix(left, "grp").mapInArrow(_group_overlaps(slices), "grp long, part long, met binary")
        .repartition("grp", "part").sortWithinPartitions("grp", "part").mapInArrow(_qualifying(percent), "rep long, grp long")
    )
    # A group that many sets ask for is opened in several places, so that no task gets them all.
    asked = query_groups.groupBy("grp").agg(F.ceil(F.count("*") / 2048).alias("parts"))
    queries = (
        query_groups.join(asked, "grp").join(left.select("rep", "comp", "tokens"), "rep")
        .select("grp", F.pmod(F.xxhash64("rep"), "parts").alias("part"), F.lit(True).alias("is_query"), "rep", "comp", "tokens")
    )
    members = left.join(asked, "grp").select(
        "grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(False).alias("is_query"), "rep", "comp", "tokens"
    )
    opened = (
        queries.union(members).repartition("grp", "part").sortWithinPartitions("grp", "part", "is_query")
        .mapInArrow(_open_groups(percent), "a long, b long")
    )
    return connected_components(star.union(opened))


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per document; the component is its least ``doc_id``.

    Null and empty texts and texts without words have no shingles and a component of their
    own. A text of fewer than ``width`` words is one shingle. Rows that share a ``doc_id`` are
    taken for the same document; a row with a null id keeps a null component. Ties cannot
    occur: a pair at exactly the similarity links. An empty table gives no rows; further
    columns of ``docs`` are not read.
    """
    sets, able = describe(docs, percent, width)
    components = components_of_sets(docs, able, percent, width)
    classes = (
        sets.where("fp is not null and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"))
        .join(components.withColumnRenamed("node", "rep"), "rep", "left")
        .select("fp", F.coalesce("component", "rep").alias("component_id"))
    )
    return sets.join(classes, "fp", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The documents without those that a smaller ``doc_id`` of their component stands for."""
    removed = cut_lineage(near_duplicates(docs, percent).where("component_id < doc_id").select("doc_id").distinct())
    return without_ids(docs, removed.select(F.col("doc_id"))).select(docs.columns)


_ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN ws IS NULL OR len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh
  FROM w
), d AS (SELECT min(doc_id) AS rep, sh, len(sh) AS n FROM (SELECT doc_id, list_sort(sh) AS sh FROM s) GROUP BY sh HAVING len(sh) > 0),
t AS (SELECT rep, n, unnest(sh) AS tok FROM d),
e AS (
  SELECT a.rep AS x, b.rep AS y FROM t a JOIN t b ON a.tok = b.tok AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), g AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach AS (
  WITH RECURSIVE r(x, y) AS (SELECT x, y FROM g UNION SELECT r.x, g.y FROM r JOIN g ON r.y = g.x)
  SELECT x, least(x, min(y)) AS component FROM r GROUP BY x
), c AS (SELECT d.sh, coalesce(component, rep) AS component FROM d LEFT JOIN reach ON rep = x)
SELECT doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(c.component, doc_id) AS component_id
FROM s LEFT JOIN c ON list_sort(s.sh) = c.sh
"""


@query("op8_ngram_jaccard_join", _ORACLE)
def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

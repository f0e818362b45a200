"""N-gram Jaccard join: grouped prefix join over word shingles, to connected groups of near copies.

A document's set holds the hashes of its distinct n-word shingles. Sets are ordered by document frequency, rarest first.
A pair that reaches the similarity shares a shingle of both prefixes, and a shingle that only one document holds can't be
shared, so only prefix shingles of frequency two and more are indexed: ordinary documents index nothing.

1. Frequencies. Documents are dealt into chunks of about CHUNK_BYTES of text; a chunk sends its distinct shingle keys to the
   owners of key ranges (RANGE_BYTES of text each) as sorted blocks, the owners add them up and send one byte a key back.
   A block without keys isn't sent, so there are never more blocks than keys. Keys have 56 bits: two of 2**44 distinct
   shingles (100 TB of text) seldom collide, and a collision only raises a frequency, alike for all documents.
2. Prefixes. Equal sets become one, with a number of its own as its identity, whatever the ids of its documents; sets with
   the same indexed prefix and size become one group.
3. Group pairs. The groups that share a prefix shingle (a bucket) are first compared with one pivot of the bucket and size
   band. Most buckets of near copies are connected by that, and a pair of documents that are connected needs no check.
   What stays between different components is paired group by group within neighbouring size bands, under length and
   position filters, expanded to members and held against parity bitmaps of the sets. Their difference is a lower bound of the
   sets' own, so pairs above the limit go, and the likeliest pairs are verified first: those that differ by at most a first
   share of the limit, then, between the components that are still apart, by the whole limit. So no link
   between different components can be lost, whatever the size of a bucket, and a cloud of thousands of near copies costs
   some comparisons a document, not all its links.
4. Components by large-star and small-star steps.

Defined results: null and empty texts and texts without words have an empty set and link with nothing; fewer than n words
make one shingle of the whole sequence; repeated ids are separate rows, whether their texts are equal or not, and each gets
its own text's component; rows without an id take part, and their component is the least id they reach, null if there is
none; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.llm.common import drop_table, keep_rows, read, text_bytes, write_table
from litsieve.llm.components import connected_components
from litsieve.llm.kernel import mix, shingle_sets
from litsieve.session import collect_garbage

CHUNK_BYTES = 4 << 20
RANGE_BYTES = 16 << 20
KEYS_AT_ONCE = 1 << 18
FEW_CHUNKS = 64  # so that small tables are not one task
KEY_BITS = 56
PIVOT_ROUNDS = 6
BITMAP = 256
SHARES = (0.7, 1.0)  # of the most members that linked sets may differ in, stage by stage; the last has to be 1
FEW_PAIRS = 50_000  # so many pairs of groups at most are compared in one stage
BEFORE = 32  # shingles before a posting's own that it remembers
PAIRS_PER_POSTING = 100  # another round of pivots costs more than to filter this many pairs of groups


def prefix_length(n: int, percent: int) -> int:
    """Members of a set of n that have to be indexed so that no similar pair is missed."""
    return n - (percent * n + 99) // 100 + 1


def _keys(s: np.ndarray, bits: int) -> np.ndarray:
    return s >> np.uint64(64 - bits)


def _chunk_keys(sets: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a chunk in order, and in how many of its documents each occurs."""
    joined = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return np.unique(_keys(joined, bits), return_counts=True)


def _cuts(keys: np.ndarray, ranges: int, bits: int) -> np.ndarray:
    """Where each key range begins in sorted keys."""
    edges = np.array([(r << bits) // ranges for r in range(ranges + 1)], np.uint64)
    return np.searchsorted(keys, edges)


def _packed(keys: np.ndarray) -> bytes:
    """56-bit keys as seven bytes each, the bytes of one place together."""
    return keys.view(np.uint8).reshape(-1, 8)[:, :7].T.tobytes()


def _unpacked(planes: np.ndarray) -> np.ndarray:
    """Keys of seven rows of bytes."""
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :7] = planes.T
    return out.view(np.uint64).ravel()


def _send_keys(words: int, ranges: int, bits: int):
    def run(table: pa.Table) -> pa.Table:
        keys, counts = _chunk_keys(list(_sets(table.column("body"), words)), bits)
        counts = np.minimum(counts, 255).astype(np.uint8)
        cuts = _cuts(keys, ranges, bits)
        full = np.flatnonzero(cuts[1:] > cuts[:-1]).tolist()
        return pa.table(
            {
                "key_range": pa.array(full, pa.int32()),
                "chunk": pa.array(np.full(len(full), table.column("chunk")[0].as_py() if len(table) else 0), pa.int64()),
                "sent_keys": pa.array([_packed(keys[cuts[r] : cuts[r + 1]]) for r in full], pa.binary()),
                "counts": pa.array([counts[cuts[r] : cuts[r + 1]].tobytes() for r in full], pa.binary()),
            }
        )

    return run


def _add_frequencies(table: pa.Table) -> pa.Table:
    """Frequency classes of the keys of one range, block by block as they came; a part of the range at a time, to bound memory."""
    planes = [np.frombuffer(x.as_buffer(), np.uint8).reshape(7, -1) for x in table.column("sent_keys")]
    counts = [np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("counts")]
    classes = [np.zeros(p.shape[1], np.uint8) for p in planes]
    n = sum(p.shape[1] for p in planes)
    ends = [_unpacked(p[:, [0, -1]]) for p in planes]
    low, high = min(int(e[0]) for e in ends), max(int(e[1]) for e in ends)
    pieces = max(1, -(-n // KEYS_AT_ONCE))
    edges = np.array([low + (high - low + 1) * k // pieces for k in range(pieces + 1)], np.uint64)
    cuts = [np.searchsorted(_unpacked(p), edges) for p in planes]
    for k in range(pieces):
        keys = np.concatenate([_unpacked(p[:, c[k] : c[k + 1]]) for p, c in zip(planes, cuts, strict=True)])
        if not len(keys):
            continue
        _, inverse = np.unique(keys, return_inverse=True)
        frequency = np.bincount(inverse, weights=np.concatenate([x[c[k] : c[k + 1]] for x, c in zip(counts, cuts, strict=True)]))
        found = np.where(frequency > 1, 1 + np.floor(2 * np.log2(np.maximum(frequency, 1))), 0).astype(np.uint8)[inverse]
        at = 0
        for x, c in zip(classes, cuts, strict=True):
            x[c[k] : c[k + 1]] = found[at : at + c[k + 1] - c[k]]
            at += c[k + 1] - c[k]
    return pa.table({"key_range": table.column("key_range"), "chunk": table.column("chunk"), "classes": pa.array([x.tobytes() for x in classes], pa.binary())})


def _sets(column: pa.ChunkedArray, words: int) -> Iterator[np.ndarray]:
    for piece in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        yield from shingle_sets(piece, words)


def _prefixes(words: int, ranges: int, percent: int, bits: int):
    """Per row n (set size), signature of the set, digest of the text, indexed prefix, its first position, and what
    verification needs: parity bitmap and members, kept with the first row of each set in the chunk."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        sets = list(_sets(docs.column("body"), words))
        keys, _ = _chunk_keys(sets, bits)
        cuts = _cuts(keys, ranges, bits)
        classes = np.zeros(len(keys), np.uint8)
        answered = 0
        for r, block in zip(answers.column("key_range").to_pylist(), answers.column("classes"), strict=True):
            classes[cuts[r] : cuts[r + 1]] = (own := np.frombuffer(block.as_py(), np.uint8))
            answered += len(own)
        if answered != len(keys):
            raise RuntimeError("a chunk has other rows than before: the input isn't the same each time it is read")
        sizes, signatures, prefixes, places, bitmaps, stored, seen = [], [], [], [], [], [], set()
        for s in sets:
            n = len(s)
            sizes.append(n)
            signatures.append(np.array([n, s.sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], np.uint64).tobytes() if n else b"")
            ahead = np.zeros(0, np.uint64)
            length = prefix_length(n, percent) if n else 0
            if n and signatures[-1] not in seen:
                seen.add(signatures[-1])
                of = classes[np.searchsorted(keys, _keys(s, bits))].astype(np.uint64)
                if of.any():
                    ahead = np.sort((of << np.uint64(56)) | (s >> np.uint64(8)))[:length]
                    ahead = ahead[ahead >= np.uint64(1 << 56)]
            prefixes.append(ahead.view(np.int64).tolist())
            places.append(length - len(ahead))
            parity = np.bincount((s & np.uint64(BITMAP - 1)).astype(np.int64), minlength=BITMAP) & 1 if len(ahead) else np.zeros(0, np.int64)
            bitmaps.append(np.packbits(parity.astype(np.uint8)).view(np.int64).tolist())
            stored.append(s.tobytes() if len(ahead) else b"")
        digests = [hashlib.sha256(x.as_py().lower()).digest() for x in docs.column("body")]
        return pa.table(
            {
                "doc_id": docs.column("doc_id"), "digest": pa.array(digests, pa.binary()), "n": pa.array(sizes, pa.int64()),
                "signature": pa.array(signatures, pa.binary()), "prefix": pa.array(prefixes, pa.list_(pa.int64())), "place": pa.array(places, pa.int64()),
                "bitmap": pa.array(bitmaps, pa.list_(pa.int64())), "members": pa.array(stored, pa.binary()),
            }
        )

    return run


def _linked(percent: int):
    """Keeps the pairs (a, b) whose sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                shared = int((y[at] == x).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(m := pa.array(keep, pa.bool_())), batch.column(1).filter(m)], ["a", "b"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    one = sets.select(F.col("rep").alias("a"), F.col("members").alias("members_a"))
    two = sets.select(F.col("rep").alias("b"), F.col("members").alias("members_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "members_a", "members_b").mapInArrow(_linked(percent), "a long, b long")


def indexed_sets(docs: DataFrame, words: int, percent: int, id_col: str = "doc_id", text_col: str = "text", key_bits: int = KEY_BITS) -> DataFrame:
    """Steps 1 and 2: per row doc_id, digest, n, signature, prefix (indexed shingles), place (of the first of them), bitmap, members."""
    n_bytes = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
    chunks, ranges = max(FEW_CHUNKS, -(-n_bytes // CHUNK_BYTES)), max(16, -(-n_bytes // RANGE_BYTES))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("body"))
    # by its task besides, so that a row which repeats whole doesn't meet in one chunk
    slim = slim.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "body", F.spark_partition_id()), F.lit(chunks)))
    sent = slim.groupBy("chunk").applyInArrow(_send_keys(words, ranges, key_bits), "key_range int, chunk long, sent_keys binary, counts binary")
    answers = sent.groupBy("key_range").applyInArrow(_add_frequencies, "key_range int, chunk long, classes binary")
    return slim.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _prefixes(words, ranges, percent, key_bits),
        "doc_id long, digest binary, n long, signature binary, prefix array<long>, place long, bitmap array<long>, members binary",
    )


def _band(n: str, percent: int) -> F.Column:
    """Sizes that can link lie in the same band or in neighbouring ones."""
    return F.floor(F.log(F.col(n)) / float(-np.log(percent / 100)) * (1 - 1e-9)).cast("int")


def grouped_rows(docs: DataFrame, words: int, percent: int, id_col: str = "doc_id", text_col: str = "text", key_bits: int = KEY_BITS) -> tuple[DataFrame, DataFrame]:
    """Every row of docs as doc_id, digest, n, signature, and every set's signature with its component and the least id there."""
    spark = docs.sparkSession
    table = write_table(indexed_sets(docs, words, percent, id_col, text_col, key_bits).withColumn("row", F.monotonically_increasing_id()), "sets")
    # a set is named by a row that holds its members, if any does; rows are numbered once, in the written table
    reps = table.where("n > 0").groupBy("signature").agg(F.min(F.struct(F.length("members") == 0, "row")).alias("first"), F.min("doc_id").alias("least"))
    owner = write_table(reps.select("signature", F.col("first.row").alias("rep"), "least"), "owners")
    sets = table.where("size(prefix) > 0").join(owner.select(F.col("rep").alias("row")), "row", "left_semi")
    sets = write_table(sets.select(F.col("row").alias("rep"), "n", "prefix", "place", "bitmap", "members"), "indexed")

    # documents with the same indexed prefix and size are one group, named by its least member
    members = sets.select("rep", "n", "place", "bitmap", F.xxhash64("n", "prefix").alias("g"), F.hash("prefix").alias("h"), "prefix")
    groups = members.groupBy("g", "h").agg(F.min("rep").alias("gid"), F.first("prefix").alias("prefix"), F.first("n").alias("n"), F.first("place").alias("place"))
    groups = write_table(groups, "groups")
    members = write_table(members.select("rep", "g", "h", "n", "bitmap").join(groups.select("g", "h", "gid"), ["g", "h"]).select("rep", "gid", "n", "bitmap"), "members")
    postings = groups.select("gid", "n", "place", F.posexplode("prefix").alias("k", "shingle"))
    postings = postings.select("shingle", "gid", "n", "k", (F.col("place") + F.col("k")).alias("at"), _band("n", percent).alias("band"))
    # a shingle of one group alone pairs nothing but the members of that group
    postings = write_table(postings, "postings")
    drop_table(groups)

    labels = members.select("rep", F.col("rep").alias("component"))
    edges, last, settled = spark.createDataFrame([], "a long, b long"), float("inf"), False
    used: list[DataFrame] = []
    for salt in range(PIVOT_ROUNDS + 1):
        at = postings
        if salt:
            at = write_table(_open(postings, members, labels), "open")
            used.append(at)
            aside = F.sum((~((F.col("low") == F.col("main")) & (F.col("high") == F.col("main")))).cast("long"))
            sizes = at.groupBy("shingle").agg(aside.alias("x"), F.count("*").alias("y"))
            pairs, rows = sizes.agg(F.sum(F.col("x") * F.col("y")), F.sum("y")).first()
            settled = rows is None
            if settled or salt == PIVOT_ROUNDS or pairs <= PAIRS_PER_POSTING * rows or pairs > 0.7 * last:
                break
            last = pairs
        # pivots: the group with the least salted hash in a bucket's size band, for that band and the next
        least = at.groupBy("shingle", "band").agg(F.min_by("gid", F.struct(F.xxhash64("gid", F.lit(salt)), "gid")).alias("pivot"))
        pivots = least.unionByName(least.withColumn("band", F.col("band") + 1))
        pairs = at.select("shingle", "band", "gid").join(pivots, ["shingle", "band"]).select("gid", "pivot").distinct()
        pairs = pairs.join(members, "gid").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).where("a <> b").distinct()
        if salt:
            own = labels.select(F.col("rep").alias("a"), F.col("component").alias("ca"))
            other = labels.select(F.col("rep").alias("b"), F.col("component").alias("cb"))
            pairs = pairs.join(own, "a").join(other, "b").where("ca <> cb").select("a", "b")
        edges, labels = _labelled(_verified(pairs, sets, percent).unionByName(edges), members, used)
    shares = () if settled else SHARES if pairs > FEW_PAIRS else SHARES[-1:]
    for share in shares:
        if share > shares[0]:
            at = write_table(_open(postings, members, labels), "open")
            used.append(at)
            if at.isEmpty():
                break
        edges, labels = _labelled(_rest(at, members, labels, sets, percent, share).unionByName(edges), members, used)

    component = owner.join(labels, "rep", "left").select("signature", "least", F.coalesce("component", "rep").alias("component"))
    ids = component.groupBy("component").agg(F.min("least").alias("least_id"))
    component = write_table(component.select("signature", "component").join(ids, "component"), "found")
    for done in (*used, sets, members, postings, owner):
        drop_table(done)
    return table.select("doc_id", "digest", "n", "signature"), component


def similar_groups(docs: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    rows, component = grouped_rows(docs, words, percent, id_col, text_col)
    rows = rows.select("doc_id", F.col("n").alias("n_shingles"), "signature").join(component, "signature", "left")
    return rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _labelled(edges: DataFrame, members: DataFrame, used: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The edges as a table, and the component of every indexed set; tables that nothing reads any more go."""
    edges = write_table(edges, "links")
    labels = members.select("rep").join(connected_components(edges).withColumnRenamed("vertex", "rep"), "rep", "left")
    labels = write_table(labels.select("rep", F.coalesce("component", "rep").alias("component")), "labels")
    while used:
        drop_table(used.pop())
    collect_garbage(edges.sparkSession)
    used += [edges, labels]
    return edges, labels


def _difference(sizes: F.Column, percent: int) -> F.Column:
    """The most members in which two linked sets with so many members together differ."""
    return sizes - 2 * F.ceil(sizes * percent / (100 + percent))


def _open(postings: DataFrame, members: DataFrame, labels: DataFrame) -> DataFrame:
    """The postings of buckets with more than one component: least and largest component of the group, main one of the bucket."""
    state = members.join(labels, "rep").groupBy("gid").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    placed = postings.join(state, "gid")
    buckets = placed.groupBy("shingle").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least <> most")
    main = placed.groupBy("shingle", "low").agg(F.count("*").alias("c")).groupBy("shingle").agg(F.max_by("low", F.struct("c", "low")).alias("main"))
    return placed.join(buckets.join(main, "shingle").select("shingle", "main"), "shingle")


def _rest(open_postings: DataFrame, members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, share: float) -> DataFrame:
    """Links between documents of different components that share a bucket, of those whose parity bitmaps differ by at most
    `share` of the limit."""
    settled = (F.col("low") == F.col("main")) & (F.col("high") == F.col("main"))
    # of a group's parity bitmaps the bits that all members have and those that any has
    words = range(BITMAP // 64)
    told = [f(F.get("bitmap", F.lit(k))).alias(f"{name}{k}") for k in words for name, f in (("all", F.bit_and), ("any", F.bit_or))]
    bits = members.groupBy("gid").agg(*told)
    told = [f"{name}{k}" for k in words for name in ("all", "any")]
    rows = open_postings.withColumn("settled", settled).join(bits, "gid").join(sets.select(F.col("rep").alias("gid"), "prefix"), "gid")
    # a pair is taken at the first shingle that it shares, or not at all: if that bucket isn't open, the pair is connected. Where
    # more than BEFORE others lie between two that it shares, it may be taken again, so what a posting carries is bounded
    begin = F.greatest(F.lit(0), F.col("k") - BEFORE)
    rows = rows.withColumn("before", F.slice("prefix", begin + 1, F.col("k") - begin)).drop("prefix", "k")
    x = rows.where(~F.col("settled")).select("shingle", "band", *(F.col(c).alias(f"{c}_x") for c in ("gid", "n", "at", "low", "high", "before", *told)))
    # sizes that can link lie in the same band or in neighbouring ones, so a bucket is split by bands
    y = rows.select("shingle", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), *(F.col(c).alias(f"{c}_y") for c in ("gid", "n", "at", "low", "high", "settled", "before", *told)))
    # each bit in which two parity bitmaps differ is a shingle that one set lacks: too many of them rule a link out, and so do
    # bits that no two members of a pair of groups share
    lacking = lambda a, b, k: F.col(f"all{k}_{a}").bitwiseAND(F.bitwise_not(F.col(f"any{k}_{b}")))
    groups_apart = sum(F.bit_count(lacking("x", "y", k)) + F.bit_count(lacking("y", "x", k)) for k in words)
    need = (F.col("n_x") + F.col("n_y")) * percent
    most = 1 + F.least(F.col("n_x") - F.col("at_x") - 1, F.col("n_y") - F.col("at_y") - 1)
    pairs = x.join(y, ["shingle", "band"]).where(
        (F.col("settled_y") | (F.col("gid_x") <= F.col("gid_y")))
        & (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y"))
        & ~((F.col("low_x") == F.col("high_x")) & (F.col("low_y") == F.col("high_y")) & (F.col("low_x") == F.col("low_y")))
        & ~F.arrays_overlap("before_x", "before_y")
        # after the first shared shingle in order at most that many more are shared
        & (most * (100 + percent) >= need)
        & (groups_apart <= share * _difference(F.col("n_x") + F.col("n_y"), percent))
    )
    pairs = pairs.select("gid_x", "gid_y").distinct()
    member = members.join(labels, "rep")
    one = member.select(F.col("gid").alias("gid_x"), F.col("rep").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("bitmap").alias("bits_a"))
    two = member.select(F.col("gid").alias("gid_y"), F.col("rep").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("bitmap").alias("bits_b"))
    apart = sum(F.bit_count(F.get("bits_a", F.lit(k)).bitwiseXOR(F.get("bits_b", F.lit(k)))) for k in words)
    near = apart <= share * _difference(F.col("na") + F.col("nb"), percent)
    pairs = pairs.join(one, "gid_x").join(two, "gid_y").where((F.col("ca") != F.col("cb")) & near)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return _verified(pairs, sets, percent)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(read(spark, sf_dir, "documents"), words=4, percent=85)


def keep_one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, with all its columns, for every component: that of the least id, and of the least text hash among
    rows that share it; a row without an id only where none has one. Rows without words all stay, equal rows as one."""
    rows, component = grouped_rows(docs, words, percent, id_col, text_col)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    first = rows.where("n > 0").groupBy("signature").agg(F.min(order).alias("first"))  # before the join: copies are many
    first = first.join(component.select("signature", "component"), "signature").groupBy("component").agg(F.min("first").alias("first"))
    wordless = rows.where("n = 0").select("doc_id", "digest").distinct()
    return keep_rows(docs, first.select("first.doc_id", "first.digest").unionByName(wordless), id_col, text_col)

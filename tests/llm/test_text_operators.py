"""Exact dedup, packing, BPE, Jaccard join and chat perspectives against brute force, and on awkward inputs."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from litsieve.llm import byte_bpe, chat_perspectives, exact_dedup, jaccard_join, kernel, packing, registry
from litsieve.llm.bpe import PairMerger
from litsieve.llm.components import connected_components
from tests.llm import cases


def lowered(text):
    return (text or "").encode().lower()


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_queries_equal_sql(spark, duck, sf, name):
    got = registry.QUERIES[name](spark, sf)
    cursor = duck.cursor().execute(registry.SQL[name])
    order = sorted(d[0] for d in cursor.description)
    names = [d[0] for d in cursor.description]
    want = sorted(tuple(r[names.index(c)] for c in order) for r in cursor.fetchall())
    assert sorted(tuple(r[c] for c in order) for r in got.collect()) == want


def test_trie():
    r = random.Random(1)
    keys = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 6))) for _ in range(400)]
    trie, want = exact_dedup.PatriciaTrie(), defaultdict(list)
    for k, key in enumerate(keys):
        trie.insert(key, k, k, 1)
        want[key].append(k)
    assert {k: tuple(v) for k, v in trie.terminals()} == {k: (min(v), max(v), len(v)) for k, v in want.items()}


@pytest.mark.parametrize("spill", [1, 64 << 20])
def test_exact_dedup_awkward(spark, spill):
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(cases.docs(spark), spill_bytes=spill).collect()), key=repr)
    groups = defaultdict(list)
    for doc_id, text, *_ in cases.DOCS:
        groups[lowered(text)].append(doc_id)
    want = []
    for doc_id, text, *_ in cases.DOCS:
        own = groups[lowered(text)]
        keep = max((x for x in own if x is not None), default=None)
        want.append((doc_id, keep, len(own), doc_id == keep, hashlib.sha256(lowered(text)).hexdigest()))
    assert got == sorted(want, key=repr)
    assert exact_dedup.exact_dedup(cases.empty(spark)).count() == 0


def test_keep_first_copies(spark):
    kept = exact_dedup.keep_first_copies(cases.docs(spark))
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 3, 4, 5, 6, 7, None], key=repr)
    assert kept.columns == cases.docs(spark).columns


def test_copies_under_repeated_ids(spark):
    rows = [(3, "beta"), (5, "beta"), (7, "Gamma"), (7, "gamma"), (3, "other"), (None, "lone"), (None, "LONE"), (None, "beta")]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _digest int")
    kept = exact_dedup.keep_first_copies(df)
    got = sorted(((r.doc_id, r.text.lower()) for r in kept.collect()), key=repr)
    assert kept.columns == df.columns and got == sorted([(5, "beta"), (7, "gamma"), (3, "other"), (None, "lone")], key=repr)


@pytest.mark.parametrize("spill", [1, 3000, 1 << 20])
def test_owner_spills_subtrees(spill):
    r = random.Random(2)
    owner, got, most = exact_dedup.Owner(spill), defaultdict(list), 0
    keys = [bytes(r.choice(b"abcd") for _ in range(r.randint(0, 9))) for _ in range(500)]
    for k, key in enumerate(keys):
        owner.insert(key, k, k, 1)
        for text, terminal in owner.spilled():
            got[text].append(terminal)
        most = max(most, owner.held)
    for text, terminal in owner.rest():
        got[text].append(terminal)
    assert most <= max(spill, exact_dedup.PatriciaTrie.NODE_BYTES * 2)
    assert {k: (min(t[0] for t in v), max(t[1] for t in v), sum(t[2] for t in v)) for k, v in got.items()} == {
        key: (keys.index(key), len(keys) - 1 - keys[::-1].index(key), keys.count(key)) for key in set(keys)
    }


def shingles(text, n):
    words = re.findall(rb"[^\x20\x09-\x0D]+", lowered(text))
    if len(words) >= n:
        return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
    return frozenset([tuple(words)]) if words else frozenset()


def brute_groups(rows, n, percent):
    sets = {i: shingles(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i in sets if sets[i]]
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {(i, len(sets[i]), find(i)) for i in sets}


def near_copies(n_groups=12, seed=4):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    shared = [r.choice(words) for _ in range(60)]
    rows, k = [], 0
    for g in range(n_groups):
        base = [r.choice(words) for _ in range(r.choice([3, 5, 30, 80, 200]))] + (shared if g % 2 else [])
        for _ in range(r.choice([1, 2, 3, 25])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((k, " ".join(copy)))
            k += 1
    return rows


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_jaccard_join(spark, n, percent):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {tuple(r) for r in jaccard_join.similar_groups(df, n, percent).collect()} == brute_groups(rows, n, percent)


@pytest.mark.parametrize("bits", [56, 12])
def test_jaccard_join_with_repeated_ids(spark, bits):
    """Ids say nothing about identity: rows may share one with other texts; short keys collide and may not lose a link."""
    texts = [t for _, t in near_copies(8, seed=9)]
    r = random.Random(1)
    texts += [r.choice(texts) for _ in range(60)]  # whole copies
    rows = [(k % 40, t) for k, t in enumerate(texts)] + [(3, texts[5])] * 20
    brute = {k: c for k, _, c in brute_groups(list(enumerate(t for _, t in rows)), 4, 85)}
    least = defaultdict(lambda: 10**9)
    for k, (i, _) in enumerate(rows):
        least[brute[k]] = min(least[brute[k]], i)
    want = sorted((i, len(shingles(t, 4)), least[brute[k]]) for k, (i, t) in enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found, component = jaccard_join.grouped_rows(df, 4, 85, key_bits=bits)
    got = found.join(component, "signature").select("doc_id", "n", "least_id").collect()
    assert sorted(map(tuple, got)) == want
    kept = jaccard_join.keep_one_of_each(df, 4, 85).collect()
    assert len(kept) == len(set(brute.values()))


def cloud(n, seed, words=150, edits=4):
    """Copies of one text with some words changed, many pairs of which lie about the threshold."""
    r = random.Random(seed)
    base = [f"w{r.randrange(400)}" for _ in range(words)]
    rows = []
    for k in range(n):
        copy = list(base)
        for _ in range(r.randint(0, edits)):
            copy[r.randrange(words)] = f"x{r.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    return rows


@pytest.mark.parametrize("before", [1, 32])
def test_stages_of_what_pivots_leave(spark, monkeypatch, before):
    """A cloud whose links few pivots find: the stages find the rest, and compare fewer pairs from one to the next."""
    monkeypatch.setattr(jaccard_join, "PIVOT_ROUNDS", 1)
    monkeypatch.setattr(jaccard_join, "BEFORE", before)
    monkeypatch.setattr(jaccard_join, "FEW_PAIRS", 0)
    rest, shares, compared = jaccard_join._rest, [], []

    def counted(at, members, labels, sets, percent, share):
        shares.append(share)
        compared.append(labels.select("component").distinct().count())
        return rest(at, members, labels, sets, percent, share)

    monkeypatch.setattr(jaccard_join, "_rest", counted)
    rows = cloud(160, before) + [(1000 + k, t) for k, t in cloud(60, 50 + before, words=40, edits=3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {tuple(r) for r in jaccard_join.similar_groups(df, 5, 80).collect()} == brute_groups(rows, 5, 80)
    assert shares == list(jaccard_join.SHARES) and compared == sorted(compared, reverse=True)


def test_another_reading_of_the_input_is_noticed():
    words = "one two three four five six seven"
    docs = pa.table({"doc_id": [1], "body": pa.array([words.encode()], pa.binary())})
    run = jaccard_join._prefixes(4, 16, 85, 56)
    with pytest.raises(RuntimeError, match="other rows"):
        run(docs, pa.table({"key_range": pa.array([0], pa.int32()), "chunk": pa.array([0]), "classes": pa.array([b"\0"], pa.binary())}))


def test_only_shared_shingles_are_indexed(spark):
    """Postings a document don't grow with the number of unrelated documents."""
    r = random.Random(3)
    for n in (100, 800):
        rows = [(k, " ".join(f"w{r.randrange(10**9)}" for _ in range(50))) for k in range(n)]
        sets = jaccard_join.indexed_sets(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85)
        assert sets.where("size(prefix) > 0").count() == 0


def test_packed_keys():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 56, 1000, dtype=np.uint64))
    packed = jaccard_join._packed(keys)
    assert (jaccard_join._unpacked(np.frombuffer(packed, np.uint8).reshape(7, -1)) == keys).all() and len(packed) == 7000


def test_frequencies_in_parts(monkeypatch):

    r = np.random.default_rng(2)
    blocks = [np.unique(r.integers(0, 60, 40, dtype=np.uint64) << np.uint64(48)) for _ in range(5)]
    counts = [r.integers(1, 4, len(b)).astype(np.uint8) for b in blocks]
    table = pa.table({"key_range": [0] * 5, "chunk": list(range(5)), "sent_keys": [jaccard_join._packed(b) for b in blocks], "counts": [c.tobytes() for c in counts]})
    total = defaultdict(int)
    for b, c in zip(blocks, counts, strict=True):
        for key, n in zip(b.tolist(), c.tolist(), strict=True):
            total[key] += n
    want = [bytes(0 if total[k] < 2 else int(1 + np.floor(2 * np.log2(total[k]))) for k in b.tolist()) for b in blocks]
    for at_once in (1 << 18, 7, 1):
        monkeypatch.setattr(jaccard_join, "KEYS_AT_ONCE", at_once)
        assert jaccard_join._add_frequencies(table).column("classes").to_pylist() == want


def test_jaccard_awkward(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(cases.docs(spark)).collect()}
    assert got[0] == (0, 0) and got[1] == (0, 1) and got[2] == (1, 2) and got[3] == (1, 2) and got[None] == (1, None)
    assert jaccard_join.similar_groups(cases.empty(spark)).count() == 0
    kept = jaccard_join.keep_one_of_each(cases.docs(spark))
    assert 3 not in [r.doc_id for r in kept.collect()] and kept.columns == cases.docs(spark).columns


def test_components(spark):
    r = random.Random(3)
    edges = [(k, k + 1) for k in range(100, 160)] + [(r.randrange(60), r.randrange(60)) for _ in range(50)] + [(5, 5), (160, 100)]
    got = {x.vertex: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    parent = {v: v for e in edges for v in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert got == {v: find(v) for e in edges if e[0] != e[1] for v in e}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_kernel_words():

    texts = [b"", b" a\tb\x0bc ", b"one", b"x" * 5000, "ä é\n漢".encode(), b"  "]
    for size in (1, 7, 1 << 20):
        got = [w for i, j, data, offsets in kernel.parts(pa.array(texts, pa.binary()), size) for w in [data[a:b].tobytes() for a, b, in zip(*kernel.word_spans(data, offsets)[:2])]]
        assert got == [w for t in texts for w in re.findall(rb"[^\x20\x09-\x0D]+", t)]


def test_packing_awkward(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.word_vocabulary())
    rows = cases.DOCS + [(90, "hello <|endoftext|> world<|startoftext|>x <|", "en", "x"), (91, "\u03a3\u0130x \u1e9b\u0323 \u00df\u00c4 \u00e9,e\u0301", "en", "x")] + [(100 + k, "w " * (k % 9), "en", "x") for k in range(300)]
    pieces = packing.pack(cases.docs(spark, rows).repartition(2), packing.word_vocabulary(), max_segments=5).collect()
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t, *_ in rows}
    count = defaultdict(int)
    for i, *_ in rows:
        count[i] += 1
    seen, sequences = defaultdict(lambda: defaultdict(int)), defaultdict(list)
    for p in pieces:
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert len(part) == p.length > 0 and zlib.crc32(part.tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids[p.doc_id])
        for k in range(p.start, p.start + p.length):
            seen[p.doc_id][k] += 1
        sequences[p.sequence_id].append((p.offset, p.length))
    assert {i: dict(s) for i, s in seen.items()} == {i: {k: count[i] for k in range(len(v))} for i, v in ids.items()}
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert len(own) <= 5 and (at == 4096 or at & (at - 1) == 0)
    assert packing.pack(cases.empty(spark), packing.word_vocabulary()).count() == 0


def test_word_ids_equal_the_library(spark):
    from tokenizers import Tokenizer

    library, encoder = Tokenizer.from_file(packing.word_vocabulary()), packing.WordEncoder(packing.word_vocabulary())
    r = random.Random(4)
    points = [c for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    texts = [x.text or "" for x in cases.documents("/root/testdata/sf0.01", spark).select("text").collect()]
    texts += ["".join(map(chr, r.choices(points, k=20))) for _ in range(2000)] + ["a" + chr(c) + "b " + chr(c) for c in points[:20_000]]
    texts += [" ".join(letter + chr(mark) + "x" for letter in "AEHJTWYaehjtwy") for mark in range(0x300, 0x370)]
    texts += ["<|endoftext|>", "x<|startoftext|>y", "<|end oftext|>", "<|ENDOFTEXT|>"]
    want = library.encode_batch_fast(texts, add_special_tokens=False)
    assert all(np.frombuffer(a, "<u4").tolist() == b.ids for a, b in zip(encoder.encode([t.encode() for t in texts]), want, strict=True))
    plain = packing.WordEncoder(packing.word_vocabulary(), True).encode([b"<|endoftext|>"])[0]
    assert len(plain) > 4 == len(encoder.encode([b"<|endoftext|>"])[0])


def test_loss_bearing_packing_of_conversations(spark, sf):
    """Prompts bear no loss: limits on loss-bearing tokens hold besides those on tokens and segments."""
    from pyspark.sql import functions as F

    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = turns.select(F.col("conv_id").alias("doc_id"), "text", F.when(F.col("role") == "assistant", 3).otherwise(10**6).alias("prompt"))
    pieces = packing.pack(rows, packing.word_vocabulary(), loss_from_col="prompt", max_tokens=512, max_segments=12, max_loss_tokens=200).collect()
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
    for own in sequences.values():
        used = sum(p.length for p in own)
        assert (used == 512 or used & (used - 1) == 0) and len(own) <= 12 and sum(p.loss_tokens for p in own) <= 200
    assert sum(p.loss_tokens for p in pieces) > 0
    whole = packing.pack(rows, packing.word_vocabulary()).collect()
    assert sum(p.length for p in whole) == sum(p.length for p in pieces)


def test_packing_query_on_real_documents(spark, sf):
    """Each id of the library lies in exactly one piece, sequences have no gaps and, but for powers of two, no padding."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.word_vocabulary())
    ids = {r.doc_id: np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4") for r in cases.documents(sf, spark).collect()}
    documents, sequences = defaultdict(list), defaultdict(list)
    for p in packing.op2_packing(spark, sf).collect():
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert zlib.crc32(part.tobytes()) == p.ids_crc32 and len(part) == p.length > 0 and p.doc_tokens == len(ids[p.doc_id])
        documents[p.doc_id].append((p.start, p.length))
        sequences[p.sequence_id].append((p.offset, p.length))
    for own, total in [*((documents[i], len(x)) for i, x in ids.items()), *((x, None) for x in sequences.values())]:
        at = 0
        for start, length in sorted(own):
            assert start == at
            at += length
        assert at == total if total is not None else at == 4096 or at & (at - 1) == 0


def test_jaccard_query_on_real_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in cases.documents(sf, spark).collect()]
    assert {tuple(r) for r in jaccard_join.op8_jaccard_join(spark, sf).collect()} == brute_groups(rows, 4, 85)


def test_bpe_query_on_real_documents(spark):
    import public_tokenizers
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(byte_bpe.multilingual_ranks()), special_tokens={})
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.op4_byte_bpe(spark, sf).collect()}
    for r in cases.documents(sf, spark).collect():
        ids = library.encode_ordinary(r.text or "")
        assert got[r.doc_id] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())


def test_packing_limits():
    r = random.Random(5)

    class Example:
        def __init__(self, n, loss_from):
            self.n, self.loss_from = n, loss_from

    done = []
    packer = packing.Packer(done.append, tokens=64, segments=4, loss=40)
    examples = [Example(r.choice([1, 2, 10, 64, 90, 200]), r.choice([0, 1, 5, 100])) for _ in range(500)]
    for e in examples:
        packer.add(e, e.n)
    packer.finish()
    placed = defaultdict(list)
    for sequence in done:
        assert sum(n for _, _, n in sequence) <= 64 and len(sequence) <= 4
        assert sum(packing.Packer._loss(e, s, n) for e, s, n in sequence) <= 40
        for e, s, n in sequence:
            placed[id(e)].append((s, n))
    for e in examples:
        at = 0
        for s, n in sorted(placed[id(e)]):
            assert s == at
            at += n
        assert at == e.n


def test_bpe_equals_library(spark, sf):
    import public_tokenizers
    import tiktoken

    path = byte_bpe.multilingual_ranks()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    rows = [(i, t) for i, t, *_ in cases.DOCS] + [(r.doc_id, r.text) for r in cases.documents(sf, spark).limit(60).collect()]
    df = cases.docs(spark, [(i, t, None, None) for i, t in rows])
    want = sorted([(i, library.encode_ordinary(t or "")) for i, t in rows], key=repr)
    encoded = byte_bpe.encode(df, path)
    assert sorted([(r.doc_id, r.ids) for r in encoded.collect()], key=repr) == want
    back = byte_bpe.decode(encoded, path).collect()
    assert sorted([(r.doc_id, bytes(r.decoded)) for r in back], key=repr) == sorted([(i, (t or "").encode()) for i, t in rows], key=repr)
    digests = byte_bpe.round_trip(df, path).collect()
    assert sorted([(r.doc_id, r.n_tokens, r.ids_sha256) for r in digests], key=repr) == sorted([(i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()) for i, x in want], key=repr)
    assert byte_bpe.round_trip(cases.empty(spark), path).count() == 0


def test_native_bpe_equals_the_other(spark):
    ranks = {bytes([k]): k for k in range(256)} | {t: 256 + k for k, t in enumerate([b"th", b" t", b"he", b"the", b" the", b"er", b"aa", b"aaa"])}
    rows = [(1, "the there aaaaaa  \n x"), (2, ""), (3, "äthe"), (4, None)]
    got = {r.doc_id: (r.ids, bytes(r.decoded)) for r in byte_bpe.encode_native(spark.createDataFrame(rows, "doc_id long, text string"), ranks).collect()}
    import public_tokenizers
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert got == {i: (library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows}


def test_pair_merger():
    merger = PairMerger(np.array([0, 2, 1]), np.array([1, 2, 1]), np.array([0, 1, 2]), np.array([2, 3, 4]))
    out, sizes = merger.merge(np.array([0, 1, 0, 1, 5, 1, 1, 1]), np.array([4, 1, 3]))
    assert out.tolist() == [3, 5, 4, 1] and sizes.tolist() == [1, 1, 2]


def rendered(rows, speaker):
    """One speaker's rendering, message by message."""
    seen, messages = set(), []
    for turn, role, text in sorted(((t, r or "unknown", x or "") for _, t, r, x in rows), key=lambda m: (m[0] is not None, m[0] or 0, m[1].encode(), m[2].encode())):
        if turn is None or (turn, role, text) not in seen:
            seen.add((turn, role, text))
            messages.append((role, text))
    out, mask, spans = "", "", []
    for role, text in messages:
        out += "<|system|>\n" if role == "system" else "<|assistant|>\n" if role == speaker else f"<|user:{role.replace('<|', '< |')}|>\n"
        begin, out = len(out), out + text.replace("<|", "< |") + "<|end|>\n"
        mask += "1" if role == speaker else "0"
        spans += [f"{begin}-{len(out) - 1}"] if role == speaker else []
    return out, len(messages), mask, ",".join(spans), sum(int(s.split("-")[1]) - int(s.split("-")[0]) for s in spans)


def test_chat(spark):
    rows = [(1, 0, "system", "Be <|end|> kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 3, None, "x"), (2, 0, "system", "alone"), (None, 1, "ann", "lost"), (1, None, "ann", "first"), (1, None, "ann", "first"), (3, 600, "user", "late"), (3, 1, "assistant", "early")]
    rows += [(4, 7, r, t) for k in range(300) for r, t in (("ann", f"same turn {k}"), ("<|b|>", "\u6f22\u5b57 \U0001f600" * 9))]  # one turn number for all
    rows += [(5, 0, "system", "rules")] + [(5, k, "ann" if k % 2 else "bob", f"turn {k}") for k in range(1, 1100)] + [(6, 1, "ann", cases.LONG), (6, 2, "bob", cases.LONG)]
    df = spark.createDataFrame([(*r, 0, 0, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, copies int, speaker string")
    got = {(r.conv_id, r.speaker): (r.text, r.n_messages, r["mask"], r.loss_spans, r.loss_chars) for r in chat_perspectives.perspectives(df).collect()}
    by_id = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            by_id[r[0]].append(r)
    want = {(i, s): rendered(own, s) for i, own in by_id.items() for s in {r[2] or "unknown" for r in own} - {"system"}}
    assert got == want
    assert got[1, "ann"][2] == "110100" and got[5, "ann"][1] == 1100 and got[5, "ann"][0].startswith("<|system|>\nrules")
    assert chat_perspectives.perspectives(df.limit(0)).count() == 0


def test_chat_in_parts(spark):
    rows = [(5, 0, "system", "rules")] + [(5, k, "ann" if k % 2 else "bob", f"turn {k}") for k in range(1, 1100)]
    got = {(r.part, r.speaker): r for r in chat_perspectives.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), part_turns=512).collect()}
    assert set(got) == {(p, s) for p in range(3) for s in ("ann", "bob")}
    for r in got.values():
        spans = [tuple(map(int, s.split("-"))) for s in r.loss_spans.split(",")]
        assert r.text.startswith("<|system|>\nrules<|end|>\n") and all(r.text[a:b].startswith("turn ") and r.text[:a].endswith("<|assistant|>\n") for a, b in spans)
        assert r.loss_chars == sum(b - a for a, b in spans)
    assert sum(r.n_messages for (_, s), r in got.items() if s == "ann") == 1100 + 2

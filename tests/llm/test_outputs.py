"""Sharding, mixing, token files and the pipeline."""

import importlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textorigin.llm import mixing, queries, sharding, tokens

ANY = r"[^\x20\x09-\x0D]+"


def check_shards(rows, docs, shards=8):
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=repr) == sorted(
        ((d.doc_id, len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in docs), key=repr
    )
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    sizes = [len(by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_sharding(spark, documents, odd, empty):
    for docs in (documents, odd):
        rows = sharding.op4(docs).collect()
        check_shards(rows, docs.collect())
        groups = defaultdict(set)
        for r in rows:
            groups[r.text_crc32, r.size].add(r.shard)
        copies = Counter((r.text_crc32, r.size) for r in rows)
        room = len(rows) // 8
        assert all(len(groups[g]) == 1 for g, n in copies.items() if 1 < n <= room // 2 and g[1] > 1)
    assert sharding.op4(empty).count() == 0


def test_sharding_of_hot_and_full_groups(spark):
    rng = random.Random(1)
    texts = ["hot"] * 150 + [f"pair {i // 2}" for i in range(200)] + ["lone %d" % i for i in range(50)] + [None] * 30
    rows = [(i % 300 if i % 7 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rng.sample(rows, len(rows)), "doc_id long, text string")
    out = sharding.op4(docs).collect()
    check_shards(out, docs.collect())
    pairs = defaultdict(set)
    for r in out:
        pairs[r.text_crc32].add(r.shard)
    # a group above the room of a shard takes as few as it can; pairs are together but for a few at borders
    assert len(pairs[zlib.crc32(b"hot")]) <= 5
    assert sum(len(pairs[zlib.crc32(f"pair {i}".encode())]) > 1 for i in range(100)) <= 10
    # every document linked: no free place, so only exchanges are left
    full = spark.createDataFrame([(i, f"pair {i % 64}") for i in range(128)], "doc_id long, text string")
    out = sharding.op4(full).collect()
    check_shards(out, full.collect())


def test_grants():
    wanted = [[0, 5, 0], [2, 0, 4], [0, 0, 0]]
    grant = sharding._grants(wanted, [0, 0, 3])
    for s in range(3):
        moved_in, out = sum(grant[k][s] for k in range(3)), sum(grant[s])
        assert moved_in - out <= [0, 0, 3][s] and all(g <= w for g, w in zip(grant[s], wanted[s]))
    assert grant == [[0, 5, 0], [2, 0, 3], [0, 0, 0]]


def test_targets():
    assert mixing.targets([100, 100], [5, 2], 300, 2) == [200.0, 100.0]
    got = mixing.targets([10, 1000, 1000, 0], [5, 2, 1, 5], 1.5 * 2010, 2)
    assert got[0] == 20 and got[3] == 0 and np.allclose(got[1:3], [2995 * 2 / 3, 2995 / 3])
    assert mixing.targets([], [], 0, 2) == []


def test_splitting_tree():
    quotas = np.array([700, 120, 0, 1])
    out = mixing.split_quotas(quotas, 12, 3)
    assert (out.sum(0) == quotas).all() and out.sum(1).max() - out.sum(1).min() <= 3 and (out >= 0).all()
    assert (mixing.split_quotas(quotas, 12, 3) == out).all()


def test_mixing(spark, documents, odd, empty):
    for docs in (documents, odd):
        given = sorted(((r.doc_id, r.source, len(re.findall(ANY, r.text or ""))) for r in docs.collect()), key=repr)
        plan = mixing.mix(docs)
        rows = plan.collect()
        assert sorted(((r.doc_id, r.source, r["size"]) for r in rows), key=repr) == given
        sizes, taken, goal, longest = Counter(), Counter(), {}, Counter()
        for r in rows:
            sizes[r.source] += r["size"]
            taken[r.source] += r.copies * r["size"]
            goal[r.source] = r.target
            longest[r.source] = max(longest[r.source], r["size"])
            assert r.copies in (0, 1, 2) and len(r.places) == r.copies
        names = sorted(sizes, key=lambda s: (s is None, s or ""))
        want = mixing.targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(sizes.values()), 2)
        for s, t in zip(names, want):
            assert abs(goal[s] - t) < 1e-6 * max(1, t) and abs(taken[s] - t) <= longest[s] / 2 + 1
        # each shard has about the same words, and a rerun agrees
        assert sorted(map(repr, mixing.mix(docs).drop("row").collect())) == sorted(map(repr, plan.drop("row").collect()))
    assert mixing.op8(empty).count() == 0
    copies = {(r.doc_id): r.copies for r in mixing.mix(documents).collect()}
    made = mixing.mixed_documents(documents).collect()
    assert Counter(r.doc_id for r in made) == Counter({k: v for k, v in copies.items() if v})
    assert len({r.mix_shard for r in made}) > 8 and all(0 <= r.mix_shard < mixing.SHARDS for r in made)


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_encoder_equals_whole_texts(plain, odd_rows):
    import pyarrow as pa

    rng = random.Random(1)
    signs = [*" \n\tab'sé.1　\x85\x1cǅß", "<|endoftext|>", " ", "\n", "don't", " word", "…", "“", " ", "​"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(3_000)] + [r[1] or "" for r in odd_rows]
    want = [np.array(e.ids + [0], "<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
    encoder = tokens.Encoder(queries.tokenizer_path())
    assert list(encoder.encode(pa.array(texts))) == want
    assert list(encoder.encode(pa.array(texts))) == want
    assert list(encoder.encode(pa.array(["a", None, ""], pa.string()))) == [want_of(plain, x) for x in ("a", "", "")]


def want_of(plain, text):
    return np.array(plain.encode(text, add_special_tokens=False).ids + [0], "<u4").tobytes()


def test_full_caches_give_the_same_ids(plain, odd_rows, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "KEPT_PIECES", 5)
    monkeypatch.setattr(tokens, "PIECE_BYTES", 300)
    monkeypatch.setattr(tokens, "SLOTS", 4)
    texts = [r[1] or "" for r in odd_rows]
    encoder = tokens.Encoder(queries.tokenizer_path())
    for _ in range(2):
        assert list(encoder.encode(pa.array(texts))) == [want_of(plain, x) for x in texts]


def test_files(tmp_path):
    raw = [np.arange(n, dtype="<u4").tobytes() for n in (5, 0, 1_000, 3)]
    path = str(tmp_path / "x.zst")
    assert tokens.write_file(path, zip([3, None, 8, 9], raw)) == (4, 1_008)
    assert [(d, r) for _, d, r in tokens.read_frames(path)] == list(zip([3, None, 8, 9], raw))
    assert {k: v.tolist() for k, v in tokens.read_documents(path, [9, 3, 77]).items()} == {3: list(range(5)), 9: [0, 1, 2]}
    # a frame stands alone: damage to another one is not seen
    data = bytearray((tmp_path / "x.zst").read_bytes())
    with open(path, "rb") as f:
        import pyarrow as pa

        table, _ = tokens.read_table(pa.PythonFile(f, "r"))
    at = int(table["f0"][:2].sum()) + int(table["f0"][2]) - 2
    data[at] ^= 255
    (tmp_path / "bad.zst").write_bytes(data)
    assert list(tokens.read_documents(str(tmp_path / "bad.zst"), [9])) == [9]
    with pytest.raises(Exception):
        list(tokens.read_frames(str(tmp_path / "bad.zst")))
    # the frames are ordinary zstandard
    import zstandard

    with open(path, "rb") as f:
        assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read(20) == raw[0]


def test_token_files(spark, plain, odd, odd_rows, empty):
    rows = tokens.tokens(odd, queries.tokenizer_path(), 5).collect()
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)] == sorted((r[0] for r in odd_rows), key=lambda i: (i is not None, i or 0))
    at, by = 0, Counter()
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        by[r.doc_id, r.n_tokens, r.ids_crc32] += 1
    assert by == Counter((i, len(w := want_of(plain, t or "")) // 4, zlib.crc32(w)) for i, t, *_ in odd_rows)
    assert tokens.tokens(empty, queries.tokenizer_path(), 5).count() == 0


def test_pipeline(spark, sf, documents, odd, empty):
    names = [n for n, _ in corpus_pipeline.STAGES]
    docs, kept = documents, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == documents.columns, name
        docs = after.cache()
        kept.append(docs.count())
    assert documents.count() > kept[0] > kept[1] >= kept[2] > 0 and len(names) == 5
    assert {r.doc_id for r in docs.collect()} <= {r.doc_id for r in documents.collect()}
    for table in (odd.withColumn("items", F.lit(1)).withColumn("shard", F.lit("x")), empty):
        after = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, after, sf)
            assert after.columns == table.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, after, sf).count() == after.count()


SQL = sorted(queries.ORACLES)


@pytest.mark.parametrize("name", SQL)
def test_query_equals_duckdb(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    cur = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    df = queries.QUERIES[name](spark, sf)
    assert sorted(names) == sorted(df.columns)
    assert sorted(repr(tuple(r[n] for n in names)) for r in df.collect()) == sorted(map(repr, cur.fetchall()))


def test_queries():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline_against_brute_force(spark, sf, documents, plain):
    """Every stage on what its predecessor kept, in plain Python, and the rows of run()."""
    from test_pairs_and_passages import brute_components, brute_hits

    from textorigin.llm import compression

    labels, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    rows = {r.doc_id: r for r in documents.collect()}
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    m = compression.fit(documents, labels, train=~compression.held_out("doc_id"))
    x = (compression.features([r.text.encode() for r in rows.values()], m.good, m.bad) - np.array(m.mean)) / np.array(m.scale)
    good = [i for i, z in zip(rows, m.weights[0] + x @ np.array(m.weights[1:])) if z >= 0]
    docs = stages["quality classifier"](spark, documents, sf).cache()
    assert ids(docs) == sorted(good)

    kept = [i for i, _, _, keep in brute_components([(i, rows[i].text) for i in good], 5, 80) if keep]
    docs = stages["minhash near-dedup"](spark, docs, sf).cache()
    assert ids(docs) == sorted(kept)

    clean = [r[0] for r in brute_hits([(i, rows[i].text) for i in kept], [(r.item_id, r.text) for r in items.collect()]) if not r[5]]
    docs = stages["benchmark decontamination"](spark, docs, sf).cache()
    assert ids(docs) == sorted(clean)

    docs = stages["source mixing"](spark, docs, sf).cache()
    copies, sizes = Counter(ids(docs)), {i: len(re.findall(ANY, rows[i].text)) for i in clean}
    names = sorted({rows[i].source for i in clean})
    per = {s: sum(sizes[i] for i in clean if rows[i].source == s) for s in names}
    want = mixing.targets([per[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(per.values()), 2)
    assert set(copies) <= set(clean) and max(copies.values()) <= 2
    for s, t in zip(names, want):
        own = [i for i in clean if rows[i].source == s]
        assert abs(sum(copies[i] * sizes[i] for i in own) - t) <= max(sizes[i] for i in own) / 2 + 1

    expected, at = [], 0
    for i in sorted(copies.elements()):
        raw = want_of(plain, rows[i].text)
        expected.append((i, at, len(raw) // 4, zlib.crc32(raw)))
        at += len(raw) // 4
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == expected


def test_near_duplicates_of_null_and_repeated_ids(spark):
    """Copies without ids, repeated rows, and one id for two texts: one row of each group stays, the others' texts are not lost."""
    text = lambda name, n=60: " ".join(f"{name}{i}" for i in range(n))
    rows = [(None, text("a")), (None, text("a")), (3, text("b")), (3, text("b")), (5, text("c")), (7, text("c") + " end"), (7, text("d"))]
    rows += [(9, text("e")), (None, text("e") + " end"), (None, None), (None, ""), (11, text("f"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = dict(corpus_pipeline.STAGES)["minhash near-dedup"](spark, docs, "")
    want = [(None, text("a")), (3, text("b")), (5, text("c")), (7, text("d")), (9, text("e")), (None, None), (None, ""), (11, text("f"))]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)

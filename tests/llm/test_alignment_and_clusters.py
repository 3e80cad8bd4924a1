"""Tokenizer alignment, SimHash and centroid clustering against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textorigin.llm import alignment, hot, queries, simhash, subvectors

LOWER = {c: c + 32 for c in range(65, 91)}
ANY = r"[^\x20\x09-\x0D]+"
show = lambda rows: sorted(map(repr, map(tuple, rows)))


# ---- tokenizer alignment

def brute_alignment(rows, a_path, b_path):
    """Whole texts through both tokenizers, tokens compared pairwise."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    byte = alignment._byte_characters()
    docs, total = [], Counter()
    for i, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        raw_a = [bytes(byte[c] for c in a.id_to_token(x)) for x in ids_a]
        raw_b = [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ids_b]
        if not (b"".join(raw_a) == b"".join(raw_b) == (" " + (text or "")).encode()):
            docs.append((i, [], [], [], []))
            continue
        ends = lambda raw: np.cumsum([len(x) for x in raw]).tolist()
        end_a, end_b = ends(raw_a), ends(raw_b)
        links = [(x, y) for x, e, m in zip(ids_a, end_a, raw_a) for y, f, n in zip(ids_b, end_b, raw_b) if e - len(m) < f and f - len(n) < e]
        groups, low = [], 0
        for cut in sorted({*end_a} & {*end_b}):
            inside = lambda ids, at: ",".join(str(x) for x, e in zip(ids, at) if low < e <= cut)
            groups.append(f"{inside(ids_a, end_a)}|{inside(ids_b, end_b)}")
            low = cut
        total.update(links)
        docs.append((i, ids_a, ids_b, groups, links))
    most = {}
    for (_, y), n in total.items():
        most[y] = max(n, most.get(y, 0))
    return [(i, len(x), len(y), len(g), len(k), sum(total[p] == most[p[1]] for p in k), sum(total[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if x else "") for i, x, y, g, k in docs], total, docs


STRANGE = [" two  blanks", "line\nend\n\nmore", "tab\tand　wide  x", "a ▁ sign", "<|endoftext|> </s> <0x41> <s>", "日本語 текст ελλη", "\n", " ", "a \n b", "🎉🎉 party", "x" * 300, "don't can't 12,345.67",
           "trailing ", "\nfirst", "é ﬁ \x1c y", "word\nWord\nword", "a▁b"]


@pytest.fixture(scope="module")
def paths():
    return queries.tokenizer_path(), queries.tokenizer_path(queries.PIECES)


@pytest.fixture(scope="module")
def aligned_rows(odd_rows):
    return [(r[0], r[1][:4_000] if r[1] else r[1]) for r in odd_rows] + [(100 + i, t) for i, t in enumerate(STRANGE)] + [(100, STRANGE[0])]


def test_alignment(spark, aligned_rows, paths, monkeypatch):
    want, total, docs = brute_alignment(aligned_rows, *paths)
    table = spark.createDataFrame(aligned_rows, "doc_id long, text string").withColumns({"row": F.lit("x"), "bits": F.lit(None), "a": F.lit(1)}).repartition(3)
    found, pairs = alignment.align(table, *paths)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert show(found.select(columns).collect()) == show(want)
    assert any(r[7] == "" for r in want if r[0] is not None and r[0] >= 100) and sum(r[1] > 0 for r in want) > 30
    held = Counter(p for d in docs for p in set(d[4]))
    assert {(r.a, r.b): (r.links, r.documents) for r in pairs.collect()} == {p: (n, held[p]) for p, n in total.items()}


def test_alignment_of_odd_tables(spark, odd, empty, paths):
    assert alignment.op11(empty, *paths).count() == 0
    got = {r.doc_id: r for r in alignment.op11(odd, *paths).collect()}
    assert got[30].groups_sha256 == "" == got[31].groups_sha256 and got[41].n_a > 0 and got[32].n_links > 0


def test_aligner_without_memory(aligned_rows, paths, monkeypatch):
    """Pieces beyond the remembered ones, slices of a few bytes and containers written in parts give the same rows."""
    from pyarrow import array, int64, record_batch, string

    def run():
        alignment._aligner.cache_clear()
        batch = record_batch([array(range(len(aligned_rows)), int64()), array([r[0] for r in aligned_rows], int64()), array([r[1] for r in aligned_rows], string())], ["row", "doc_id", "text"])
        rows = [r for b in alignment._align(*paths)(iter([batch])) for r in b.to_pylist()]
        links = Counter()
        for r in rows:
            if r["kind"]:
                for _, low in zip(*alignment.documents_of(array([r["bits"]]))):
                    links[r["container"], r["a"], r["b"], int(low)] += 1 << r["plane"]
        return [tuple(r.values())[1:8] for r in rows if not r["kind"]], links

    want = run()
    monkeypatch.setattr(alignment, "KEPT_PIECES", 5)
    monkeypatch.setattr(alignment, "SLICE", 50)
    monkeypatch.setattr(alignment, "ENTRIES", 20)
    assert run() == want
    alignment._aligner.cache_clear()


def test_bitmaps():
    rng = np.random.default_rng(1)
    sets = [np.sort(rng.choice(alignment.DOCUMENTS, n, replace=False)) for n in (1, 3, 255, 256, 4096, 2)]
    runs = np.cumsum([0, *map(len, sets)])
    made = alignment.bitmaps(runs, np.concatenate(sets))
    assert [len(x) for x in made.to_pylist()] == [2, 6, 510, 512, 512, 4]
    of, low = alignment.documents_of(made)
    assert [np.sort(low[of == k]).tolist() for k in range(6)] == [s.tolist() for s in sets]


# ---- SimHash

def brute_print(text):
    w = re.findall(ANY, (text or "").translate(LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints, ids):
    label = list(range(len(prints)))

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for i, a in enumerate(prints):
        for j in range(i):
            if bin(a ^ prints[j]).count("1") <= 4:
                label[find(i)] = find(j)
    names = {}
    for k, i in enumerate(ids):
        if i is not None:
            names[find(k)] = min(i, names.get(find(k), i))
    return [names.get(find(k)) for k in range(len(ids))]


def test_simhash(spark, odd_rows, empty):
    rng = random.Random(4)
    words = odd_rows[0][1].split()
    rows = [(r[0], r[1]) for r in odd_rows]
    for i in range(60):  # a family that drifts
        words[rng.randrange(len(words))] = f"w{i}"
        rows.append((200 - i, " ".join(words)))
    prints = [brute_print(t) for _, t in rows]
    names = brute_groups(prints, [i for i, _ in rows])
    want = [(i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, names)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fingerprint": F.lit("x"), "component_id": F.lit(1), "bits": F.lit(2)})
    assert show(simhash.op12(table).collect()) == show(want)
    assert simhash.op12(empty).count() == 0
    assert len({c for _, _, c in want}) < len({p for _, p, _ in want})


def clouds(rng, n):
    """Fingerprints in clouds: many share long runs of bits, and chains lead on from one to the next."""
    out = set()
    while len(out) < n:
        x = rng.getrandbits(64) if rng.random() < 0.3 or not out else rng.choice(sorted(out)[:50])
        for _ in range(rng.randint(0, 7)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def test_tree_and_shards(spark, monkeypatch):
    prints = clouds(random.Random(6), 700)
    own = np.array(prints, np.uint64)
    away = np.bitwise_count(own[:, None] ^ own[None, :])
    q, k = simhash.Tree(own).within(own, 4)
    assert sorted(zip(q.tolist(), k.tolist())) == sorted(zip(*(x.tolist() for x in np.nonzero(away <= 4))))
    monkeypatch.setattr(simhash, "SLICE", 37)
    want = brute_groups(prints, list(range(len(prints))))
    assert simhash.joined(own, 4).tolist() == want
    # small shards: every pair within the radius still meets in one
    monkeypatch.setattr(simhash, "ABOUT", 8)
    monkeypatch.setattr(simhash, "MOST", 24)
    table = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fingerprint long")
    met, sizes = set(), Counter()
    number = {simhash._signed(p): i for i, p in enumerate(prints)}
    groups = {}
    for r in simhash.shards(table, 4).collect():
        groups.setdefault((r.mask, r.bits), set()).add(number[r.fingerprint])
    for members in groups.values():
        sizes[len(members)] += 1
        met |= {(a, b) for a in members for b in members if a < b}
    assert max(sizes) <= 24
    assert {(a, b) for a, b in zip(*np.nonzero(away <= 4)) if a < b} <= met


def test_joins_of_hot_keys(spark):
    rows = spark.range(3_000).select(F.when(F.col("id") < 1_500, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    names = rows.groupBy("k").agg(F.count(F.lit(1)).alias("rows")).withColumn("name", F.col("k") * 2)
    got = hot.join_counted(rows, names, ["k"])
    assert got.columns == ["k", "v", "name"] and got.count() == 3_000 and got.filter("name != 2 * k").count() == 0


# ---- clustering

def brute_clusters(rows, clusters=16, rounds=3):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [r[1] for r in start[:clusters]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), k) for k, c in enumerate(centres))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        members = [[v for (_, v), k in zip(kept, own) if k == j] for j in range(len(centres))]
        centres = [[sum(x) // len(m) for x in zip(*m)] if m else c for m, c in zip(members, centres)]
    last = [nearest(v) for _, v in kept]
    inertia = [sum(d for d, k in last if k == j) for j in range(len(centres))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, k, d, inertia[k], sum(inertia), names[k]) for (i, _), (d, k) in zip(kept, last)]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 0.2, 64).round(3).tolist()) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(30)]  # one common vector
    rows += [(300, None), (301, []), (302, [0.5] * 63), (303, [0.5] * 65), (304, [float("nan")] + [0.1] * 63), (305, [float("inf")] + [0.1] * 63), (306, [None] + [0.1] * 63)]
    rows += [(None, rows[3][1]), (None, [1e5] * 64), (7, rows[7][1]), (7, [-0.0] * 64), (400, [-1e-9] * 64), (401, [1e6, -1e6] * 32)]
    return rows


@pytest.mark.parametrize("chunk", [8_192, 7])
def test_clusters(spark, vectors, chunk, monkeypatch):
    monkeypatch.setattr(subvectors, "CHUNK", chunk)
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumns({"cluster": F.lit("x"), "e": F.lit(1), "distance": F.lit(None)})
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert show(subvectors.op13(table).select(columns).collect()) == show(brute_clusters(vectors))


def test_few_vectors_and_widths(spark, vectors):
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    few = subvectors.op13(table.filter("vec_id < 5"))
    assert few.count() == 5 and few.filter("distance != 0").count() == 0
    assert subvectors.op13(table.limit(0)).count() == 0
    assert show(subvectors.cluster(table, width=5).drop("centroid").collect()) == show(subvectors.cluster(table, width=64).drop("centroid").collect())
    with pytest.raises(Exception, match="a component of"):
        subvectors.op13(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")).collect()

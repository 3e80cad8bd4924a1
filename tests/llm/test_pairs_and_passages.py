"""Decontamination, near-duplicates and line dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textorigin.llm import decontamination, graph, lines, minhash, words

LOWER = {c: c + 32 for c in range(65, 91)}
ITEM, ANY = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+"


def test_words_and_hashes():
    texts = ["", "a b", " A  b\n", "é\x1cx ", "a", "\x0b"]
    raw = [t.encode() for t in texts]
    data, borders = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    begin, end, at = words.spans(data, borders)
    got = [[bytes(data[b:e]).decode() for b, e in zip(begin[x:y], end[x:y])] for x, y in zip(at[:-1], at[1:])]
    assert got == [re.findall(ANY, t) for t in texts]
    flat = [w.translate(LOWER) for t in texts for w in re.findall(ANY, t)]
    h = words.hashes(data, begin, end)
    assert len({(a, b) for a, b in zip(flat, h.tolist())}) == len(set(flat)) == len(set(h.tolist()))
    assert list(words.slices(np.array([0, 5, 5, 9, 30]), 8)) == [(0, 2), (2, 3), (3, 4)] and list(words.slices(np.array([0]))) == []


def brute_hits(docs, items):
    windows = {}
    for name, text in items:
        w = re.findall(ITEM, (text or "").translate(LOWER))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(name)
    sizes, out = {len(w) for w in windows}, []
    for i, text in docs:
        w, hit, names = re.findall(ITEM, (text or "").translate(LOWER)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                found = windows.get(tuple(w[k : k + n]))
                if found is not None:
                    hit |= set(range(k, k + n))
                    names |= found
        names = sorted(str(x) for x in names if x is not None)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def bench(spark, odd_rows):
    base = [r[1] for r in odd_rows[:3]]
    items = [(1, " ".join(base[0].split()[5:30])), (2, "One, TWO"), (3, None), (4, ""), (None, " ".join(base[1].split()[:12])), (5, "..."), (6, " ".join(base[0].split()[20:40])),
             (6, "tail1"), (10, "one two")]
    return items, spark.createDataFrame(items, "item_id long, text string")


def test_decontamination(odd, odd_rows, bench, empty, monkeypatch):
    items, table = bench
    want = brute_hits([r[:2] for r in odd_rows], items)
    got = lambda: sorted(map(tuple, decontamination.op1(odd, table).collect()), key=repr)
    assert got() == want and any(r[5] for r in want)
    # several automata, and several passes over the text
    monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", 7)
    assert got() == want
    monkeypatch.setattr(decontamination, "PASS_BYTES", 2_000)
    assert got() == want
    assert decontamination.op1(empty, table).count() == 0
    assert not any(r.contaminated for r in decontamination.op1(odd, table.limit(0)).collect())


def test_decontamination_spans_and_clashing_columns(odd, bench):
    given = odd.withColumn("items", F.lit(1)).withColumn("n_hit", F.lit("x"))
    out = decontamination.decontaminate(given, bench[1]).collect()
    row = next(r for r in out if r.doc_id == 0)
    first = row.text[row.spans[0].begin : row.spans[0].end].split()
    assert first == row.text.split()[5:40] and row.lang == "en" and {"1", "6"} <= set(row["items"])
    short = next(r for r in out if r.doc_id == 35)
    assert [short.text[s.begin : s.end] for s in short.spans] == [short.text]


def brute_components(rows, size, percent):
    sets = []
    for _, text in rows:
        w = re.findall(ANY, (text or "").translate(LOWER))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    names = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            names[find(k)] = min(i, names.get(find(k), i))
    return sorted(((i, len(s), names.get(find(k)), i == names.get(find(k))) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=repr)


@pytest.fixture(scope="module")
def family():
    """Texts that drift apart: neighbours are linked, the ends are not; and a crowd around one text whose members are hardly linked."""
    rng = random.Random(8)
    bank = [f"w{i}" for i in range(900)]
    text = [rng.choice(bank) for _ in range(160)]
    rows = []
    for i in range(25):
        text = text.copy()
        text[(7 * i) % 160] = f"new{i}"
        rows.append((100 + i, " ".join(text)))
    core = [rng.choice(bank) for _ in range(160)]
    for i in range(60):
        own = core.copy()
        for k in rng.sample(range(160), 5):
            own[k] = f"own{i}x{k}"
        rows.append((300 - i, " ".join(own)))
    rows.append((1000, " ".join(core)))
    return rows


def test_near_duplicates(spark, odd_rows, family, monkeypatch):
    rows = [r[:2] for r in odd_rows] + family
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size, percent in ((3, 85), (5, 80)):
        want = brute_components(rows, size, percent)
        assert sorted(map(tuple, minhash.near_duplicates(docs, size, percent).collect()), key=repr) == want
    # buckets compared in many chunks
    monkeypatch.setattr(minhash, "CHUNK", 8)
    assert sorted(map(tuple, minhash.near_duplicates(docs, 3, 85).collect()), key=repr) == brute_components(rows, 3, 85)


def test_near_duplicates_of_nothing(empty):
    assert minhash.op3(empty).count() == 0


def test_bit_estimate():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.6, 0.9):
        n = 2_000
        both = rng.integers(0, 1 << 63, int(n * share), dtype=np.uint64)
        a, b = (np.concatenate([both, rng.integers(0, 1 << 63, n - len(both), dtype=np.uint64)]) for _ in range(2))
        true = len(both) / (2 * n - len(both))
        x, y = (np.frombuffer(minhash.packed(minhash.minima(v)), np.uint8) for v in (a, b))
        assert abs(float(minhash.estimate(x, y)) - true) < 0.2
        assert float(minhash.estimate(x, x)) == 1.0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 300), (50, 50)] + [(7, k) for k in range(400, 460)]
    out = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(31)) and out[459] == 0 and out[300] == 100 and out[50] == 50
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def cut_units(text, unit):
    """(start of the white space before, begin, end) of every unit, character by character."""
    white, out, at, start = " \t\n\x0b\x0c\r", [], 0, 0
    while at < len(text):
        if text[at] in white:
            at += 1
            continue
        begin = at
        while at < len(text):
            c, rest = text[at], text[at + 1 :]
            if unit == "paragraph" and c == "\n" and (not rest or rest[0] == "\n"):
                break
            if unit != "paragraph" and c == "\n":
                break
            at += 1
            if unit == "sentence" and c in ".!?" and (not rest or rest[0] in white):
                break
        out.append((start, begin, at))
        start = at
    return out


def brute_units(rows, unit, least):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    first, out, known = set(), [], {}
    for k in order:
        i, text = rows[k]
        if (i, text) not in known:
            units = cut_units(text or "", unit)
            names = [" ".join((text[b:e]).translate(LOWER).split()) for _, b, e in units]
            again = [n in first or n in names[:j] for j, n in enumerate(names)]
            first |= set(names)
            gone = []
            for j in range(len(units)):
                low, high = j, j
                while low > 0 and again[low - 1]:
                    low -= 1
                while high < len(units) and again[high]:
                    high += 1
                if again[j] and sum(len(n.split()) for n in names[low:high]) >= least:
                    gone.append(j)
            kept = "".join(c for p, c in enumerate(text or "") if not any(units[j][0] <= p < units[j][2] for j in gone))
            known[i, text] = None if text is None else kept, [units[j][1:] for j in gone]
        out.append((i, *known[i, text]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("unit, least", [("sentence", 8), ("sentence", 1), ("line", 6), ("paragraph", 5)])
def test_unit_dedup(spark, unit, least, empty):
    rng = random.Random(4)
    bank = [f"this is sentence number {i}." for i in range(12)] + ["Short", "", " This  is SENTENCE number 3.", "été ñ ü 一 二 三!", "3.14 is pi?! yes", "...", "end  "]
    rows = [(i, "".join(rng.choice(bank) + rng.choice([" ", "\n", "  ", "\n\n", ""]) for _ in range(rng.randint(0, 12)))) for i in range(40)]
    rows += [(7, rows[7][1]), (None, rows[3][1]), (90, None), (91, ""), (92, " \n "), (93, bank[0]), (94, bank[0] + "\n")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, digest string, _id int").withColumns({"number": F.lit("a"), "place": F.lit(None)})
    out = lines.remove_repeats(docs, unit, least)
    assert out.columns == ["doc_id", "text", "digest", "_id", "number", "place", "removed"] and out.filter("digest != 'x' or number != 'a'").count() == 0
    got = sorted(((r.doc_id, r.text, [tuple(s) for s in r.removed]) for r in out.collect()), key=repr)
    assert got == brute_units(rows, unit, least)
    assert lines.op9(empty).count() == 0


def test_passage_inside_lines(spark):
    """A passage of 60 words that begins and ends inside lines goes from the later document; short common lines stay."""
    rng = random.Random(12)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passage = ". ".join(words(10) for _ in range(6)) + "."
    rows = [(1, f"{words(9)}. {passage} {words(5)}.\nall rights reserved here now"), (2, f"{words(12)} so. {passage} {words(9)}\nall rights reserved here now"), (3, f"{words(40)}.\nall rights reserved here now")]
    got = {r.doc_id: r for r in lines.op9(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == rows[0][1] and got[3].text == rows[2][1] and got[2].n_removed == 6
    assert passage not in got[2].text and got[2].text.endswith("all rights reserved here now")

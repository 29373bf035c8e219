"""Line dedup, prefix trie and resampling against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerlens.llm import line_dedup, prefix_trie, resampling

# ------------------------------------------------------------------------------------------------ line dedup


def lines_by_hand(rows, chars=40, least=5):
    """Texts after dedup, in order of rows, and the numbers of dropped lines."""
    key = lambda line: line.strip(" \t\n\r\x0b\x0c").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holders = defaultdict(set)
    small = lambda d: -(1 << 63) if d is None else d
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= chars:
                holders[key(line)].add(small(doc))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if len(holders[key(x)]) < least or max(holders[key(x)]) == small(doc)]
        out.append((doc, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


def line_rows(prose):
    rng = random.Random(5)
    shared = [prose(i, 9) + " tail of a line" for i in range(30)] + ["ü" * 39, "Ü" * 40, "x" * 40, " " * 60, "short"]
    rows = []
    for d in range(200):
        lines = [rng.choice(["", " ", "\t"]) + rng.choice([str, str.upper])(rng.choice(shared)) + rng.choice(["", "\r"]) for _ in range(rng.randint(0, 9))]
        lines.insert(0, "the one line that stands in every document of this corpus")
        rows.append((d, "\n".join(lines + [prose(1000 + d, 12)] * rng.randint(0, 2))))
    rows += [(500, None), (501, ""), (502, "\n\n"), (None, rows[0][1]), (None, rows[3][1]), (7, rows[9][1]), (7, rows[9][1])]
    return rows


def test_line_report_equals_brute_force(spark, make_docs, prose):
    rows = line_rows(prose)
    got = Counter(map(tuple, line_dedup.line_report(make_docs(rows).repartition(7)).collect()))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == Counter((d, n, dropped, sha(kept)) for d, n, dropped, kept in lines_by_hand(rows))
    assert sum(r[2] for r in lines_by_hand(rows)) > 300


def test_cleaned_documents_keep_their_columns(spark, make_docs, prose):
    rows = line_rows(prose)
    docs = make_docs(rows)
    got = line_dedup.deduplicated(docs)
    assert got.columns == docs.columns
    want = Counter((d, None if text is None else kept) for (d, text), (_, _, _, kept) in zip(rows, lines_by_hand(rows), strict=True))
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == want


def test_bitmaps_round_trip():
    rng = random.Random(1)
    for n in (1, 7, 8, 9, 64, 1000):
        dropped = np.array(sorted(rng.sample(range(n), max(1, n // 3))))
        keep = line_dedup.unpack_bitmap(line_dedup.pack_bitmap(dropped), n)
        assert np.array_equal(np.flatnonzero(~keep), dropped)
    assert line_dedup.unpack_bitmap(None, 3).all()


@pytest.mark.parametrize("batch", [1, 3, 7, 1000])
@pytest.mark.parametrize("cuts", [1, 2, 5, 40])
def test_streams_decide_alike_however_rows_are_cut(batch, cuts):
    """The first-occurrence stream over any partition and batch borders, against counting."""
    import pyarrow as pa

    rng = random.Random(batch * 100 + cuts)
    rows = sorted({(k, 0, -rng.randint(0, 12), 0, n) for k in range(25) for n in range(rng.choice([1, 2, 9, 40]))})
    rows = [(k, lo, -d, t, n) for k, lo, d, t, n in rows]
    docs = defaultdict(set)
    for k, _, d, _, _ in rows:
        docs[k].add(d)
    # a partition border never parts the rows of one hash and document
    borders = [i for i in range(1, len(rows)) if rows[i][:3] != rows[i - 1][:3]]
    ends = [0, *sorted(rng.sample(borders, min(cuts - 1, len(borders)))), len(rows)]
    dropped, undecided, totals = [], [], defaultdict(lambda: [0, -1])
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        arrays = [pa.array(c, t) for c, t in zip(zip(*rows[a:b], strict=True), [pa.int64()] * 4 + [pa.int32()], strict=True)]
        table = pa.Table.from_arrays(arrays, names=["hi", "lo", "doc", "text_hash", "line"])
        for out in line_dedup._first_occurrences(5)(iter(table.to_batches(max_chunksize=batch))):
            for r in out.to_pylist():
                if r["kind"] == 0:
                    dropped.append((r["hi"], r["doc"], r["line"]))
                elif r["kind"] == 1:
                    undecided.append((r["hi"], r["doc"], r["line"]))
                else:
                    totals[r["hi"]][0] += r["n_docs"]
                    totals[r["hi"]][1] = max(totals[r["hi"]][1], r["doc"])
    dropped += [(k, d, n) for k, d, n in undecided if totals[k][0] >= 5 and totals[k][1] != d]
    assert sorted(dropped) == sorted((k, d, n) for k, _, d, _, n in rows if len(docs[k]) >= 5 and d != max(docs[k]))


# ------------------------------------------------------------------------------------------------ prefix trie

CONVERSATIONS = "conv_id long, turn long, role string, text string, node string, up long, key string"


def trie_by_hand(rows):
    turn_key = lambda r: hashlib.md5(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).digest()
    own = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            own[r[0]].append(r)
    for c in own:
        own[c].sort(key=lambda r: ((-1, 0) if r[1] is None else (0, r[1]), turn_key(r)))
        own[c] = [(r[2] or "", r[3] or "") for r in own[c]]
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    sums = {n: [0, 0] for n in members}
    children = Counter(n[:-1] for n in members if n)
    for n, convs in members.items():
        for d in range(len(n) + 1):
            sums[n[:d]][0] += children[n] == 0
            sums[n[:d]][1] += (len(convs) - 1) * len(n[-1][1]) if n else 0
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return Counter(
        (min(convs), len(n), min(members[n[:-1]]) if n else None, len(convs), children[n], *sums[n],
         digest([c for c in convs if len(rebuilt[c]) == len(n)]))
        for n, convs in members.items()
    )


def conversation_rows():
    rng = random.Random(3)
    rows = []
    for c in [*range(230), 350, 351, 1207, -5, -130, 10**12 + 7]:
        for t in range(rng.choice([1, 1, 2, 3, 6, 9])):
            text = rng.choice(["hello", "hello", "why", "ok 🙂", "", None])
            rows.append((c, t, rng.choice(["user", "user", None]), text))
    for c in (300, 301, 302, 417):  # deep ones that part late
        rows += [(c, t, "user", f"step {t}" if t < 150 + c % 100 else f"{c} {t}") for t in range(170 + c % 100)]
    rows += [(20, None, "system", "first"), (20, 1, "b", "tie"), (20, 1, "a", "tie"), (21, 3, "a", "same"), (21, 3, "a", "same")]
    rows += [(None, 0, "user", "hello")]
    return rows


@pytest.mark.parametrize("height", [2, 5, 32])
def test_trie_equals_brute_force(spark, height):
    rows = conversation_rows()
    frame = spark.createDataFrame([(*r, "n", 1, "k") for r in rows], CONVERSATIONS).repartition(5)
    assert Counter(map(tuple, prefix_trie.trie_report(frame, height).collect())) == trie_by_hand(rows)


def test_trie_of_many_equal_conversations_and_of_none(spark, monkeypatch):
    rows = [(c, t, "user", f"t{t}") for c in range(300) for t in range(6)] + [(1000 + c, 0, "user", "t0") for c in range(40)]
    frame = spark.createDataFrame([(*r, "n", 1, "k") for r in rows], CONVERSATIONS)
    assert Counter(map(tuple, prefix_trie.trie_report(frame).collect())) == trie_by_hand(rows)
    assert prefix_trie.trie_report(frame.limit(0)).count() == 0


# ------------------------------------------------------------------------------------------------ resampling

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams_by_hand(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = WORDS.findall(low)
    runs = words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    return len(words), [zlib.crc32(r.encode()) % 10000 for r in runs]


def resampled_by_hand(rows, items, percent=25):
    corpus, target = Counter(), Counter()
    for _, text in rows:
        corpus.update(grams_by_hand(text)[1])
    for _, text in items:
        target.update(grams_by_hand(text)[1])
    s, t = float(corpus.total()), float(target.total())
    gain = [math.floor(1000 * math.log((target[b] + 1.0) * (s + 10000) / ((corpus[b] + 1.0) * (t + 10000)))) for b in range(10000)]
    out = []
    for doc, text in rows:
        n, found = grams_by_hand(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(found), weight, score, None, n])
    open_rows = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for rank, r in enumerate(open_rows[: len(open_rows) * percent // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in out]


def resampling_rows(prose, edge_rows):
    rows = [(100 + i, prose(i % 90, 10 + i % 40)) for i in range(300)]
    rows += [(r[0], r[1]) for r in edge_rows] + [(None, prose(4, 30)), (None, prose(4, 30)), (900, "漢" * 90 + " é " + "w" * 5000 + " Z")]
    return rows, [(i, prose(i, 60)) for i in range(20)] + [(99, None)]


def test_resampling_report_equals_brute_force(spark, make_docs, prose, edge_rows):
    rows, items = resampling_rows(prose, edge_rows)
    got = resampling.resampling_report(make_docs(rows).repartition(6), make_docs(items).select("doc_id", "text"))
    want = resampled_by_hand(rows, items)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert sum(r[4] is not None for r in want) > 50


def test_drawn_documents_have_their_columns(spark, make_docs, prose, edge_rows):
    rows, items = resampling_rows(prose, edge_rows)
    docs = make_docs(rows)
    got = resampling.resampled(docs, make_docs(items), percent=40)
    assert got.columns == docs.columns
    want = Counter(r[0] for r in resampled_by_hand(rows, items, 40) if r[4] is not None)
    assert Counter(r["doc_id"] for r in got.collect()) == want


def test_joined_crc_equals_zlib():
    rng = random.Random(2)
    pairs = [(rng.randbytes(rng.randint(1, 9)), rng.randbytes(rng.choice([1, 5, 63, 64, 65, 200, 5000]))) for _ in range(200)]
    left, right = (np.array([zlib.crc32(p[k]) for p in pairs], np.uint32) for k in (0, 1))
    got = resampling.joined_crc(left, right, np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b" " + b) for a, b in pairs]


def test_empty_tables(spark, make_docs, prose):
    none = make_docs([])
    assert line_dedup.line_report(none).count() == 0 and line_dedup.deduplicated(none).count() == 0
    assert resampling.resampling_report(none, none).count() == 0
    one = resampling.resampling_report(make_docs([(1, prose(1, 30))]), none).collect()
    assert one[0]["rank"] is None and one[0]["n_features"] == 59

"""Winnowing, mixing, near-duplicates, repeated strings and passages against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import common as C
from ledgerlens.llm import compact_windows, lsh_forest, mixing, suffix_merge, winnowing

SPACED = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def edited(text: str, every: int, mark: str) -> str:
    words = text.split(" ")
    return " ".join(mark + w if i % every == every // 2 else w for i, w in enumerate(words))


def by_id(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r["doc_id"] is None, r["doc_id"], str(r)))


def test_words_match_the_patterns(edge_rows):
    texts = [r[1] for r in edge_rows]
    data, offsets = C.text_bytes(pa.array(texts, pa.string()))
    for kind, pattern in ((C.SPACED, SPACED), (C.ALNUM, ALNUM)):
        _, bounds, start, end = C.words(C.SPACED[1][data], offsets, kind)
        for i, t in enumerate(texts):
            got = [data[a:b].tobytes().decode() for a, b in zip(start[bounds[i] : bounds[i + 1]], end[bounds[i] : bounds[i + 1]])]
            assert [g.translate(LOWER) for g in got] == pattern.findall((t or "").translate(LOWER))


def test_sliced_null_column():
    column = pa.array(["ab", None, "c", "", "dé"], pa.string()).slice(1, 4)
    data, offsets = C.text_bytes(column)
    assert data.tobytes() == "cdé".encode() and offsets.tolist() == [0, 0, 1, 1, 4]


# ---- winnowing


def brute_hits(docs, items):
    windows = defaultdict(lambda: defaultdict(set))
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[n][tuple(w[k : k + n])].add(i)
    out = []
    for i, t in docs:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, names = set(), set()
        for n, table in windows.items():
            for k in range(len(w) - n + 1):
                found = table.get(tuple(w[k : k + n]))
                if found:
                    names |= found
                    hit |= set(range(k, k + n))
        out.append((i, len(w), len(hit), len(names), winnowing.digest(names), bool(hit)))
    return out


def test_winnowing_against_brute_force(spark, make_docs, prose, edge_rows):
    passage = prose(50, 40)
    items = [(1, passage), (2, prose(51, 10)), (3, "tiny item"), (4, None), (5, ""), (6, passage), (12, prose(52, 9))]
    words = passage.split(" ")
    docs = [
        *[(r[0], r[1]) for r in edge_rows],
        (20, "x y " + passage.upper() + " z"),
        (21, " ".join(words[5:15])),
        (22, " ".join(words[5:14])),  # nine words only
        (23, "a,tiny-ITEM b"),
        (24, prose(52, 9) + " " + prose(51, 10)),
        (25, "the the the the the the the the the the the the"),
        (26, passage + " ! " + passage),
    ]
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    got = winnowing.contamination_report(make_docs(docs), bench)
    want = brute_hits(docs, items)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(tuple(r[c] for c in columns) for r in by_id(got)) == sorted(want)
    # the same in several passes, each with a part of the items
    a = winnowing.contaminated_spans(make_docs(docs), bench)
    b = winnowing.contaminated_spans(make_docs(docs), bench, part_words=60)
    assert by_id(a) == by_id(b)
    clean = {r["doc_id"] for r in winnowing.clean_documents(make_docs(docs), bench, part_words=60).collect()}
    assert clean == {w[0] for w in want if not w[5]}


def test_winnowing_empty_tables(spark, make_docs, edge_rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(not r["contaminated"] for r in by_id(winnowing.contamination_report(make_docs(edge_rows), none)))
    assert winnowing.contamination_report(make_docs([]), none).count() == 0
    assert winnowing.clean_documents(make_docs(edge_rows), none).columns == make_docs(edge_rows).columns


@pytest.mark.parametrize("seed", range(5))
def test_every_shared_span_keeps_a_fingerprint(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 6, 200).astype(np.uint64), rng.integers(0, 6, 200).astype(np.uint64)
    b[50:60] = a[100:110]
    marks = [winnowing.fingerprints(x, 5, 6, np.array([0, 200])) for x in (a, b)]
    keys = [set(C.grams(x, 5)[p].tolist()) for x, p in zip((a, b), marks)]
    inside = {int(C.grams(a, 5)[p]) for p in marks[0] if 100 <= p <= 105}
    assert inside & keys[1]


# ---- mixing


def test_targets_and_copies(spark, make_docs, prose):
    rows = [(i, prose(i, 5 + i % 40), "en", f"s{i % 5}") for i in range(600)]
    rows += [(1000 + i, prose(i, 3), "en", None) for i in range(4)]
    rows += [(2000, None, "en", "s1"), (2001, "", "en", "zero"), (None, "a b c", "en", "s2"), (3, rows[3][1], "en", "s3")]
    got = mixing.mixed_report(make_docs(rows)).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(SPACED.findall(r[1] or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        open_weight = sum(weight[s] for s in names if s not in capped)
        more = {s for s in names if s not in capped and 3 * sizes[s] * open_weight < rest * weight[s]}
        if not more:
            break
        capped |= more
    want = {s: 3.0 * sizes[s] if s in capped else rest * weight[s] / open_weight for s in names}
    assert None in capped  # the cap is exercised
    taken, by_size = Counter(), {}
    for r in got:
        assert r["taken"] <= 3 * r["size"]
        by_size[r["source_size"]] = r["target"]
    for s in names:
        assert by_size[sizes[s]] == pytest.approx(want[s])
    out = make_docs(rows).select("doc_id", "source").dropDuplicates(["doc_id"])
    for r in mixing.mixed_report(make_docs(rows)).filter("doc_id is not null").join(out, "doc_id").collect():
        taken[r["source"]] += r["taken"]
    for s in names:
        if sizes[s] > 1000:
            assert taken[s] == pytest.approx(want[s], rel=0.1)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed_report(make_docs(rows)).collect()))


def test_mix_repeats_whole_rows(make_docs, edge_rows):
    docs = make_docs(edge_rows)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.schema["key"].dataType == docs.schema["key"].dataType
    report = mixing.mixed_report(docs).groupBy("doc_id").agg(F.sum("taken").alias("t"), F.max("size").alias("s"))
    copies = {r["doc_id"]: r["t"] // r["s"] for r in report.collect() if r["s"]}
    got = Counter(r["doc_id"] for r in mixed.collect())
    assert all(got[i] == n for i, n in copies.items())
    assert mixing.mixed_documents(make_docs([])).count() == 0
    assert mixing.mixed_report(make_docs([])).count() == 0
    assert mixing.mixed_report(make_docs([(1, None), (2, "")])).filter("taken = 0 and target = 0").count() == 2


# ---- near-duplicates


def shingles_of(text):
    w = SPACED.findall((text or "").translate(LOWER))
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def brute_components(rows):
    sets = {i: shingles_of(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 85 * len(x | y) and root(a) != root(b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def near_copies(prose):
    rows = [(1, None), (2, ""), (3, "  "), (4, "one"), (5, "ONE"), (6, "two words"), (7, prose(3, 12000)), (8, prose(3, 12000) + " end")]
    base = prose(9, 300)
    rows += [(100 + k, edited(base, 30 + k, f"q{k}")) for k in range(40)]  # a chain of near and less near copies
    rows += [(200 + k, base + " " + prose(500 + k, 250)) for k in range(30)]  # one shared passage, not alike
    rows += [(300 + k, prose(900 + k // 5, 60 + k // 5)) for k in range(50)]  # groups of five equal texts
    return rows


def test_forest_against_brute_force(make_docs, prose):
    rows = near_copies(prose)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in lsh_forest.near_duplicates(make_docs(rows)).collect()}
    assert got == brute_components(rows)


def test_forest_dense_regions(monkeypatch, make_docs, prose):
    """Regions and groups above their bounds are cut into blocks and give the same components."""
    monkeypatch.setattr(lsh_forest, "REGION", 4)
    monkeypatch.setattr(lsh_forest, "BLOCK", 900)
    rows = near_copies(prose)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in lsh_forest.near_duplicates(make_docs(rows)).collect()}
    assert got == brute_components(rows)


def test_dense_region_compares_all_components(spark, monkeypatch):
    """Documents of a dense region that share LEAST values and no more meet in a group, unless of one component."""
    monkeypatch.setattr(lsh_forest, "REGION", 4)
    shared = b"region!!"
    assert len(shared) == 2 * lsh_forest.LEAST
    trees = spark.createDataFrame([(0, bytearray(shared + bytes([i] * 8)), i) for i in range(40)], "tree int, key binary, id long")
    members = spark.createDataFrame([(i, 0 if i < 20 else i // 2) for i in range(30)], "id long, component long")
    scratch = C.Scratch(spark, "dense")
    rows = lsh_forest.region_rows(trees, members, scratch).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r["group"]].append(r)
    met = Counter()
    for g in groups.values():
        for k, x in enumerate(g):
            for y in g[k + 1 :]:
                if x["component"] != y["component"] and (x["side"] != y["side"] or x["side"] < 0):
                    met[min(x["id"], y["id"]), max(x["id"], y["id"])] += 1
    part = {i: 0 if i < 20 else i // 2 if i < 30 else i for i in range(40)}
    assert met == Counter({(i, j): 1 for i in range(40) for j in range(i + 1, 40) if part[i] != part[j]})


def test_forest_edges(make_docs, edge_rows):
    got = by_id(lsh_forest.near_duplicates(make_docs([*edge_rows, (None, "x y")])))
    assert [r["doc_id"] for r in got] == [1, 2, 3, 4, 5, 6, 6, 7, 8]
    assert [r["component_id"] for r in got] == [1, 2, 3, 4, 4, 6, 6, 7, 8]
    assert lsh_forest.near_duplicates(make_docs([])).count() == 0
    assert lsh_forest.near_duplicates(make_docs([(1, None)])).collect()[0]["kept"]


# ---- repeated strings


def brute_repeats(texts, length=400):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_strings_against_brute_force(make_docs, prose):
    p, q = prose(70, 90), prose(71, 200)
    texts = [
        None, "", "short", "a" * 1500, "zu " * 400, p, "x" + p, p[:399], p[:400], "é" + p[3:] + "漢字",
        q + " " + p + " " + q, q[:700], q[100:900], "".join(chr(0x4E00 + i % 50) for i in range(700)), prose(72, 3000),
        p[:250] + "!" + p[251:], "a" * 399, "b" * 401, "b" * 400, q, q,
    ]
    rows = list(enumerate(texts)) + [(len(texts), q), (19, q)]
    got = suffix_merge.repeat_report(make_docs(rows)).collect()
    want = brute_repeats([t for _, t in rows])
    columns = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted((r["doc_id"], *[r[c] for c in columns]) for r in got) == sorted((i, *w) for (i, _), w in zip(rows, want))


@pytest.mark.parametrize("marked", [0, 1, 2])
def test_witness_of_a_repeated_row_is_kept(spark, marked):
    """Whichever copy of a row carries the mark of the witness, its windows are compared."""
    kind = "r1 long, r2 long, near long, x0 array<long>, x1 array<long>, sure array<boolean>, asked array<boolean>"
    top = (1 << 63) - 1
    copies = [(1, 2, 5 if i == marked else top, [0, 9], [8, 20], [True, True], [False, i == marked]) for i in range(3)]
    other = (3, 4, 7, [0], [8], [False], [True])
    got = suffix_merge._one_per_row(spark.createDataFrame([*copies, other], kind).coalesce(1)).orderBy("r1").collect()
    assert [(r["near"], r["sure"], r["asked"]) for r in got] == [(5, [True, True], [False, True]), (7, [False], [True])]


def test_repeated_rows_in_several_shards(make_docs, prose):
    """A third document that holds part of a passage loses it wherever the copies of the repeated row lie."""
    q = prose(73, 400)
    texts = [(1, q), (2, prose(74, 200)), (1, q), (3, prose(75, 50) + " " + q[500:1300] + " " + prose(76, 50)), (1, q), (4, prose(77, 90) + q[900:1400])]
    got = suffix_merge.repeat_report(make_docs(texts).repartition(6)).collect()
    want = brute_repeats([t for _, t in texts])
    columns = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted((r["doc_id"], *[r[c] for c in columns]) for r in got) == sorted((i, *w) for (i, _), w in zip(texts, want, strict=True))


def test_repeated_strings_empty(make_docs):
    assert suffix_merge.repeat_report(make_docs([])).count() == 0
    assert by_id(suffix_merge.repeat_report(make_docs([(None, None), (1, "x")])))[-1]["n_bytes"] == 0


# ---- repeated passages


def test_compact_windows_against_brute_force():
    rng = np.random.default_rng(3)
    for n, top in ((5, 9), (46, 20), (300, 12), (400, 10**9)):
        v = rng.integers(0, top, n).astype(np.uint64)
        want = set()
        for c in range(n):
            a, b = c, c
            while a > 0 and v[a - 1] > v[c]:
                a -= 1
            while b < n - 1 and v[b + 1] >= v[c]:
                b += 1
            if b - a + 1 >= 7:
                want.add((a, c, b))
        assert set(compact_windows.compact_windows(v, 7)) == want


def test_passages(make_docs, prose, edge_rows):
    passage = prose(80, 60)
    near = edited(passage, 60, "z")
    rows = [(r[0], r[1]) for r in edge_rows]
    rows += [
        (100, prose(81, 120) + " " + passage + " " + prose(82, 80)),
        (101, prose(83, 10) + " " + passage.upper()),
        (102, prose(84, 200) + " " + near),
        (103, prose(85, 300)),
        (104, prose(86, 60) + " " + prose(86, 60)),  # repeated in one document only
        (105, " ".join(passage.split(" ")[:40]) + " " + prose(87, 50)),  # too short
        (106, prose(88, 55)),
        (107, prose(88, 55)),
        (108, prose(88, 55)),
    ]
    got = {r["doc_id"]: r for r in compact_windows.passage_report(make_docs(rows)).collect()}
    assert set(got) == {100, 101, 102, 106, 107, 108}
    assert got[101]["n_repeated_words"] == pytest.approx(60, abs=8)
    assert got[106]["n_repeated_words"] == 55 and got[107]["first_other"] == 106
    assert compact_windows.passage_report(make_docs([])).count() == 0


def test_passages_behind_shared_boilerplate(make_docs, prose):
    """Two documents in the middle of a group share more than the paragraph that all of the group begin with."""
    rows, want = [], set()
    for g in range(40):
        common, more = prose(5000 + g, 40), prose(6000 + g, 20)
        for d in range(30):
            doc = 100 * g + d
            rows.append((doc, f"{prose(9000 + doc, 25)} {common} {more + ' ' if d in (13, 17) else ''}{prose(20000 + doc, 25)}"))
            want |= {doc} if d in (13, 17) else set()
    got = {r["doc_id"]: r for r in compact_windows.passage_report(make_docs(rows).repartition(5)).collect()}
    assert set(got) == want
    # alike is 0.8 or more, so a few words around the passage may come along
    assert all(60 <= r["n_repeated_words"] <= 72 and {r["doc_id"] % 100, r["first_other"] % 100} == {13, 17} for r in got.values())


def test_edited_passages_behind_shared_boilerplate(make_docs, prose):
    """As above, but one word of the longer passage differs, inside the paragraph that all of the group begin with."""
    rows, want = [], set()
    for g in range(40):
        common, more = prose(45000 + g, 40), prose(46000 + g, 20)
        changed = " ".join("zz" + w if i == 30 else w for i, w in enumerate(common.split(" ")))
        for d in range(30):
            doc = 100 * g + d
            middle = f"{common if d != 17 else changed} {more + ' ' if d in (13, 17) else ''}"
            rows.append((doc, f"{prose(49000 + doc, 25)} {middle}{prose(60000 + doc, 25)}"))
            want |= {doc} if d in (13, 17) else set()
    got = {r["doc_id"]: r for r in compact_windows.passage_report(make_docs(rows).repartition(5)).collect()}
    # a start is looked at if two of four min-hashes meet anything: a few in a hundred of edited passages may not be
    assert set(got) <= want and len(got) >= 0.95 * len(want)
    assert all({r["doc_id"] % 100, r["first_other"] % 100} == {13, 17} for r in got.values())


def test_near_copies_meet_in_pairs_that_grow_with_their_number(make_docs, prose, monkeypatch):
    """Every document has the passage with one word of its own, the first and the last ones only halves of it."""
    counts = {}
    write = compact_windows.C.Scratch.write

    def counted(self, df, name):
        out = write(self, df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(compact_windows.C.Scratch, "write", counted)
    passage, made = prose(71000, 160).split(), []
    for n in (40, 160):
        rows = []
        for d in range(n):
            words = list(passage)
            for at in random.Random(d).sample(range(160), 3):
                words[at] = f"own{d}x{at}"
            words = words[:75] if d in (0, n - 1) else words
            rows.append((d, f"{prose(72000 + d, 20)} {' '.join(words)} {prose(73000 + d, 20)}"))
        counts.clear()
        got = {r["doc_id"] for r in compact_windows.passage_report(make_docs(rows).repartition(4)).collect()}
        assert len(got) >= 0.9 * n
        pairs = sum(v for k, v in counts.items() if k.endswith("pairs") or k == "left-over")
        made.append((pairs, sum(v for k, v in counts.items() if k.endswith("spans"))))
    (pairs, spans), (more_pairs, more_spans) = made
    assert more_pairs <= 6 * pairs and more_spans <= 6 * spans, made


def test_shared_distances_against_counting():
    rng = np.random.default_rng(5)
    shift, least = compact_windows.SHIFT, compact_windows.SPAN - compact_windows.MISSING
    for top in (3, 1 << 31):
        for _ in range(20):
            x = rng.integers(0, top, rng.integers(46, 120)).astype(np.int32)
            y = np.r_[rng.integers(0, top, rng.integers(0, 30)), x[rng.integers(0, 60) :]].astype(np.int32)
            gaps = [i - j for i in range(len(x)) for j in range(len(y)) if x[i] == y[j]]
            want = [g for g in sorted(set(gaps)) if sum(abs(h - g) <= shift for h in gaps) >= least]
            assert compact_windows.shared_distances(x, y).tolist() == want


def test_matches_alone_give_the_alike_runs():
    """As laying the sides beside each other at all their distances, also in portions; the 46 shingles count once."""
    rng = np.random.default_rng(6)
    xs, ys = [], []
    for k in range(60):
        line = rng.integers(0, 1 << 31, rng.integers(3, 70))
        x = np.r_[rng.integers(0, 1 << 31, rng.integers(0, 40)), np.tile(line, rng.integers(1, 9)), rng.integers(0, 1 << 31, rng.integers(0, 60))]
        y = np.delete(np.r_[rng.integers(0, 5, rng.integers(0, 30)), x[rng.integers(0, 20) :]], slice(60, 60 + k % 7))
        y[rng.integers(0, len(y), len(y) // 30)] = 7
        xs.append((x if k % 9 else x[:30]).astype(np.int32)), ys.append((y if k % 10 else rng.integers(0, 9, 80)).astype(np.int32))
    x_sizes, y_sizes = (np.array([len(v) for v in side]) for side in (xs, ys))
    pair, part, gaps = [], [], []
    for k, (x, y) in enumerate(zip(xs, ys, strict=True)):
        at = compact_windows.shared_distances(x, y).astype(np.int64)
        pair.append(np.full(len(at), k)), part.append(np.arange(len(at)) // 64), gaps.append(at)
    pair, part, gaps = (np.concatenate(v) for v in (pair, part, gaps))
    flat = np.concatenate(xs), np.concatenate(ys)
    want = []
    for own, own_sizes, other, other_sizes, d in ((flat[0], x_sizes, flat[1], y_sizes, gaps), (flat[1], y_sizes, flat[0], x_sizes, -gaps)):
        which, first, last = compact_windows.alike_runs(own, own_sizes, other, other_sizes, pair, d)
        want.append(sorted(zip(pair[which].tolist(), part[which].tolist(), first.tolist(), last.tolist(), strict=True)))
    for most in (compact_windows.MATCHED, 2000):
        large, found = compact_windows.alike_sides(flat[0], x_sizes, flat[1], y_sizes, most)
        kept = [[r for r in rows if r[0] not in set(large.tolist())] for rows in want]
        assert [sorted(zip(*(c.tolist() for c in rows), strict=True)) for rows in found] == kept and all(map(len, kept))
        assert (len(large) == 0) == (most > 2000)
        _, found = compact_windows.alike_sides(flat[0], x_sizes, flat[1], y_sizes, most, widest=True)
        for rows, all_rows in zip(found, kept, strict=True):  # fewer distances, the same starts
            less = list(zip(*(c.tolist() for c in rows), strict=True))
            assert len(less) < len(all_rows)
            covered = [{(k, i) for k, _, a, b in some for i in range(a, b + compact_windows.SPAN)} for some in (less, all_rows)]
            assert covered[0] == covered[1]
    # 64 matches of eight places with eight others
    side = np.r_[np.arange(20), np.full(8, 99), np.arange(30, 60)].astype(np.int32)
    other = np.where(side == 99, side, side + 1000).astype(np.int32)
    size = np.array([len(side)])
    assert len(compact_windows.shared_distances(side, other))
    assert [len(c) for rows in compact_windows.alike_sides(side, size, other, size)[1] for c in rows] == [0] * 8


def test_slices_have_the_windows_of_every_function():
    """One tree over all functions gives each function's windows, none of which crosses the zero behind a document."""
    rng = np.random.default_rng(8)
    documents = [rng.integers(1, 1 << 63, n, dtype=np.uint64) for n in (60, 46, 200, 91)]
    documents[2][70:140] = documents[2][:70]
    flat = np.concatenate([np.r_[d, np.uint64(0)] for d in documents])
    want, begin = [], 0
    for d in documents:
        for j, seed in enumerate(compact_windows._SEEDS):
            values = compact_windows.C.mix(d ^ seed)
            key = lambda c, v=values, j=j: int(v[c]) & ~(compact_windows.HASHES - 1) | j
            want += [(key(c), begin + a, begin + c, begin + b) for a, c, b in compact_windows.compact_windows(values)]
        begin += len(d) + 1
    assert sorted(zip(*(c.tolist() for c in compact_windows.slice_windows(flat)), strict=True)) == sorted(want) and want


def test_joined_ranges():
    owner, first, last = (np.array(v) for v in ([2, 1, 1, 1, 2, 1], [0, 5, 0, 30, 4, 9], [3, 9, 4, 40, 6, 20]))
    got = [v.tolist() for v in compact_windows.joined_ranges(owner, first, last)]
    assert got == [[1, 1, 1, 2, 2], [0, 5, 30, 0, 4], [4, 20, 40, 3, 6]]


def test_rarest_places_against_brute_force():
    rng = np.random.default_rng(12)
    span, percent, missing = compact_windows.SPAN, compact_windows.PERCENT, compact_windows.MISSING
    assert [100 * (span - m) >= percent * (span + m) for m in (missing, missing + 1)] == [True, False]
    for n in (46, 60, 200):
        often = rng.permutation(n) + 1  # no ties, the place of 1 is held by nobody else
        want = set()
        for start in range(n - 4):
            rare = sorted(range(start, start + 5), key=lambda i: often[i])[:3]
            want |= {i for i in rare if often[i] > 1} if often[rare[-1]] > 1 else set()
        assert set(compact_windows.rarest_places(often, 5, 2).tolist()) == want
    assert compact_windows.rarest_places(np.array([1, 1, 1, 9, 9]), 5, 2).tolist() == []


def test_every_verbatim_passage_is_found(make_docs, prose):
    """Brute force over all 50 words in a row of documents put together from shared pieces of 10 to 70 words."""
    rng = random.Random(6)
    pieces = [prose(30000 + i, rng.randint(10, 70)) for i in range(60)]
    rows = [(d, " ".join([prose(40000 + d, 5), *(rng.choice(pieces) for _ in range(rng.randint(2, 9)))])) for d in range(150)]
    rows += [(d, "a b c d e f " * 30) for d in (900, 901)] + [(902, "z " * 200)]
    holders = {}
    for doc, text in rows:
        words = text.split()
        for i in range(len(words) - 49):
            holders.setdefault(tuple(words[i : i + 50]), set()).add(doc)
    at_least = {}
    for doc, text in rows:
        words = text.split()
        hit = {j for i in range(len(words) - 49) if len(holders[tuple(words[i : i + 50])]) > 1 for j in range(i, i + 50)}
        if hit:
            at_least[doc] = len(hit)
    got = {r["doc_id"]: r["n_repeated_words"] for r in compact_windows.passage_report(make_docs(rows).repartition(4)).collect()}
    assert set(at_least) <= set(got) and all(got[d] >= n for d, n in at_least.items())
    # 41 of 46 shingles make a stretch alike, so up to five words at either end of a shared stretch may come along
    assert len(at_least) > 60 and sum(got.values()) <= 1.25 * sum(at_least.values())


def test_alike_runs_equal_counting():
    rng = np.random.default_rng(9)
    span, percent, shift = compact_windows.SPAN, compact_windows.PERCENT, compact_windows.SHIFT
    sides = []
    for _ in range(25):
        x = rng.integers(0, 60 if rng.random() < 0.3 else 1 << 31, rng.integers(46, 160)).astype(np.int32)
        y = np.r_[rng.integers(0, 1 << 31, rng.integers(0, 30)), x[rng.integers(0, 9) :]].astype(np.int32)
        y[rng.integers(0, len(y), rng.integers(0, 8))] = 7
        sides.append((x, y))
    pair, distance = np.repeat(np.arange(25), 3), rng.integers(-40, 12, 75)
    flat = [np.concatenate([s[k] for s in sides]) for k in (0, 1)]
    sizes = [np.array([len(s[k]) for s in sides]) for k in (0, 1)]
    which, first, last = compact_windows.alike_runs(flat[0], sizes[0], flat[1], sizes[1], pair, distance)
    want = []
    for k, (p, d) in enumerate(zip(pair, distance, strict=True)):
        x, y = sides[p]
        same = [any(0 <= i - d + e < len(y) and y[i - d + e] == x[i] for e in range(-shift, shift + 1)) for i in range(len(x))]
        starts = [i for i in range(len(x) - span + 1) if 100 * sum(same[i : i + span]) >= percent * (2 * span - sum(same[i : i + span]))]
        for i, s in enumerate(starts):
            if i == 0 or s - starts[i - 1] > span:
                want.append([k, s, s])
            want[-1][2] = s
    assert [list(map(int, r)) for r in zip(which, first, last, strict=True)] == want and want

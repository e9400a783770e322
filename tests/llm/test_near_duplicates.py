import random
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest

from lexiquarry.llm import near_duplicates as nd
from lexiquarry.workspace import shared_root

VOCABULARY = [f"w{i}" for i in range(60)]


def edited(draw, ws):
    ws = list(ws)
    for _ in range(draw.randint(0, 6)):
        at = draw.randrange(len(ws))
        kind = draw.random()
        if kind < 0.4:
            ws[at] = draw.choice(VOCABULARY)
        elif kind < 0.7:
            ws.insert(at, draw.choice(VOCABULARY))
        else:
            ws = ws[at:] + ws[:at]
    return ws


def brute(sets, limit):
    return {(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and (c := len(sets[a] & sets[b])) * limit.under >= (len(sets[a]) + len(sets[b]) - c) * limit.over}


@pytest.mark.parametrize("width, limit", [(3, nd.Threshold(3, 5)), (5, nd.Threshold(4, 5)), (1, nd.Threshold(9, 10)), (2, nd.Threshold(1, 1))])
def test_all_pairs_are_found(spark, width, limit):
    draw = random.Random(width)
    base = [[draw.choice(VOCABULARY) for _ in range(draw.choice([4, 12, 40, 90]))] for _ in range(25)]
    rows = [(i, "t", " ".join(edited(draw, draw.choice(base)))) for i in range(220)]
    rows += [(300 + i, None, "w1") for i in range(3)] + [(400, "w1 w2", None), (401, None, None), (402, "", "  ")] + [(500 + i, "same", "text as before and after it") for i in range(30)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, title string, body string, id string, tokens int")
    members, links = nd.near_duplicates(df, "doc_id", ["title", "body"], width, limit)
    got = {tuple(r) for r in nd.record_pairs(members, links, "doc_id").collect()}
    sets = {r.id: set(r.tokens) for r in nd.shingle_sets(df, "doc_id", ["title", "body"], width).collect()}
    assert got == brute(sets, limit) and len(got) > 435
    per_doc = {r.doc_id: r for r in nd.record_links(members, links, "doc_id").collect()}
    classes = {}
    for i, s in sets.items():
        classes.setdefault(frozenset(s), []).append(i)
    assert {i: r.class_id for i, r in per_doc.items()} == {i: min(c) for c in classes.values() for i in c}
    reps = {min(c): set(s) for s, c in classes.items()}
    linked = brute(reps, limit)
    assert all(r.n_links == sum(r.class_id in p for p in linked) for r in per_doc.values())


def test_repeated_rows_required_part_and_empty_table(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(1, text, 1), (1, text, 2), (2, text + " eight", 1), (3, None, 1), (None, text, 1)], "doc_id long, body string, loaded_at int")
    members, links = nd.near_duplicates(df, "doc_id", ["body"], 3, nd.Threshold(3, 5), "loaded_at", "body")
    assert [tuple(r) for r in nd.record_pairs(members, links, "doc_id").collect()] == [(1, 2)] and members.count() == 2
    members, links = nd.near_duplicates(df.limit(0), "doc_id", ["body"])
    assert nd.record_pairs(members, links, "doc_id").collect() == [] and nd.record_links(members, links, "doc_id").collect() == []


def test_very_long_texts(spark):
    ws = [f"x{i}" for i in range(60_000)]
    rows = [(1, " ".join(ws)), (2, " ".join(ws[:-200])), (3, " ".join(ws[20_000:])), (4, "short text of five words")]
    members, links = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, body string"), "doc_id", ["body"])
    assert [(r.a, r.b) for r in links.collect()] == [(1, 2)]


def test_signatures_meet_for_every_pair_within_the_limit():
    """The pigeonhole itself, without fingerprints or joins, under adverse frequencies, at several numbers of segments."""
    draw = np.random.default_rng(3)
    for over, under in ((3, 5), (4, 5), (1, 2)):
        limit = nd.Threshold(over, under)
        cells = draw.integers(0, 1000, nd.CELLS)
        for free in (0.5, nd.FREE, 2.0):
            bands, lacking = nd.Bands(limit, 800, free), 0
            for trial in range(300):
                n = int(draw.integers(1, 12 if trial % 3 else 300))
                both = draw.integers(0, 2**63, n).astype(np.uint64)
                extra = [draw.integers(0, 2**63, int(draw.integers(0, n // 2 + 1))).astype(np.uint64) for _ in range(2)]
                r, s = (np.unique(np.concatenate((both, e))) for e in extra)
                if len(both) * under < (len(r) + len(s) - len(both)) * over:
                    continue
                if len(r) < len(s):
                    r, s = s, r
                probed, _, weight, short = nd.probe_signatures(r, np.array([len(r)]), bands, cells)
                lacking += short[0]
                indexed = nd.index_signatures(s, np.array([len(s)]), bands)[0]
                assert len(np.unique(probed)) == len(probed) and len(np.unique(indexed)) == len(indexed)
                assert short[0] or weight[np.isin(probed, indexed)].sum() > min(len(r) // nd.SHARE, nd.SURPLUS)
            assert lacking == 0 or free < 1


def test_batches_give_the_signatures_of_single_sets():
    draw = np.random.default_rng(4)
    sets = [np.unique(draw.integers(0, 2**63, int(n)).astype(np.uint64)) for n in draw.integers(1, 90, 40)]
    sizes, bands, cells = np.array([len(s) for s in sets]), nd.Bands(nd.Threshold(3, 5), 90), 100 * draw.permutation(nd.CELLS)  # no ties
    for make in (lambda t, n: nd.index_signatures(t, n, bands), lambda t, n: nd.probe_signatures(t, n, bands, cells)[:2]):
        sigs, of = make(np.concatenate(sets), sizes)
        for i, s in enumerate(sets):
            assert sorted(sigs[of == i]) == sorted(make(s, sizes[i : i + 1])[0])


@pytest.mark.parametrize("free", [0.4, 0.8])
def test_sets_that_lack_segments_are_compared_all_the_same(spark, free):
    draw = random.Random(6)
    base = [[draw.choice(VOCABULARY) for _ in range(draw.choice([4, 12, 40]))] for _ in range(12)]
    df = spark.createDataFrame([(i, " ".join(edited(draw, draw.choice(base)))) for i in range(120)], "doc_id long, body string")
    sets = nd.shingle_sets(df, "doc_id", ["body"], 2)
    limit = nd.Threshold(3, 5)
    got = {tuple(r) for r in nd.record_pairs(*nd.similar_sets(sets, limit, free), "doc_id").collect()}
    assert got == brute({r.id: set(r.tokens) for r in sets.collect()}, limit)


def test_intermediate_files_stay_below_four_times_the_input(spark, tmp_path):
    """Shuffles and tables of a whole run, together, against the Parquet file of texts with common words and rare names."""
    draw = np.random.default_rng(7)
    words = np.array([f"{a}{b}{c}" for a in "bdfglmnprst" for b in ("a", "e", "ir", "on") for c in ("", "k", "lan", "mor", "te", "ving")])
    rank = np.minimum(draw.zipf(1.2, 2000 * 180) - 1, len(words) - 1)
    texts = [" ".join([f"{words[i % 97]}{words[i % 89]}x{i}", *words[own]]) for i, own in enumerate(rank.reshape(2000, 180))]
    texts += [f"{t} and a changed end" for t in texts[:200]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, body string").write.parquet(str(tmp_path / "in"))
    size = sum(p.stat().st_size for p in (tmp_path / "in").rglob("*.parquet"))
    shared = Path(shared_root(spark))
    tables = lambda: sum(p.stat().st_size for p in shared.rglob("*.parquet"))
    before, last = tables(), max((s.stageId() for s in stages(spark)), default=-1)
    members, links = nd.near_duplicates(spark.read.parquet(str(tmp_path / "in")), "doc_id", ["body"], 3, nd.Threshold(3, 5))
    found = nd.record_pairs(members, links, "doc_id").collect()
    shuffled = sum(s.shuffleWriteBytes() for s in stages(spark) if s.stageId() > last)
    assert len(found) > 100
    assert 0 < tables() - before + shuffled < 4 * size


def stages(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), spark.sparkContext._jvm.java.util.ArrayList())
    return [found.apply(i) for i in range(found.size())]


@pytest.mark.parametrize("over, under", [(3, 5), (4, 5), (1, 2), (1, 6), (1, 1)])
def test_prefixes_of_every_pair_within_the_limit_meet(over, under):
    """Prefixes, packed and joined part by part, under adverse frequencies, with many sets of few shingles; nothing rests on what comes behind."""
    draw = np.random.default_rng(over * 10 + under)
    limit = nd.Threshold(over, under)
    prefixes, cells = nd.Prefixes(limit), draw.integers(0, 4, 1 << 12)
    sets, base = [], [draw.integers(0, 400 if i % 2 else 2**63, int(n)).astype(np.uint64) for i, n in enumerate(draw.choice([1, 2, 5, 17, 60, 300], 40))]
    for _ in range(250):
        own = base[draw.integers(len(base))]
        kept = own[draw.random(len(own)) < draw.choice([0.5, 0.8, 0.95, 1])]
        sets.append(np.unique(np.concatenate((kept, draw.integers(0, 2**63, int(draw.integers(0, max(1, len(own) // 3)) + (len(kept) == 0))).astype(np.uint64)))))
    cells[np.unique(np.concatenate(sets) % np.uint64(len(cells))).astype(np.int64)] += 2  # no shingle is said to be in one set
    ids, sizes = draw.permutation(10_000)[: len(sets)].astype(np.int64) - 5_000, np.array([len(s) for s in sets])
    shared, needed = {}, {}
    hashes, of, ranks = nd.prefix_rows(np.concatenate(sets), sizes, prefixes, cells, np.ones(len(sets), bool))
    by_id = np.argsort(ids.view(np.uint64))
    place = np.argsort(by_id)
    for part in range(3):
        some = hashes % np.uint64(3) == part
        data = nd._pack(ids[by_id], sizes[by_id], (hashes[some] >> np.uint64(32)).astype(np.uint32), place[of[some]], ranks[some])
        back = nd._unpack(data)
        for probing in (back[0] % 2 == 0, back[0] % 2 == 1):  # in two passes
            for r, s, n, need in nd.prefix_matches(*back, prefixes, probing):
                for pair, x, y in zip(zip(back[0][r].tolist(), back[0][s].tolist()), n.tolist(), need.tolist()):
                    key = tuple(sorted(pair))
                    shared[key], needed[key] = shared.get(key, 0) + x, y
    true = brute({int(i): set(s.tolist()) for i, s in zip(ids, sets)}, limit)
    assert len(true) > 30 and all(shared.get(pair, 0) >= needed[pair] for pair in true)


def test_several_passes_give_the_same_pairs(spark, monkeypatch):
    """Every pass takes a slice of the sets, the first one slice; later ones as many as the pairs so far allow."""
    draw = random.Random(8)
    base = [[draw.choice(VOCABULARY) for _ in range(draw.choice([4, 12, 40]))] for _ in range(12)]
    df = spark.createDataFrame([(i, " ".join(edited(draw, draw.choice(base)))) for i in range(120)], "doc_id long, body string")
    monkeypatch.setattr(nd, "ONE_PASS", 0)
    monkeypatch.setattr(nd, "SLICES", 4)
    monkeypatch.setattr(nd, "PAIRED", 7)
    monkeypatch.setattr(nd, "BROADCAST_BYTES", 0)
    sets = nd.shingle_sets(df, "doc_id", ["body"], 2)
    got = [tuple(r) for r in nd.record_pairs(*nd.similar_sets(sets, nd.Threshold(3, 5)), "doc_id").collect()]
    assert len(got) == len(set(got)) and set(got) == brute({r.id: set(r.tokens) for r in sets.collect()}, nd.Threshold(3, 5))

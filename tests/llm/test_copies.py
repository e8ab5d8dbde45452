"""Line dedup, Jaccard join, decontamination, the pipeline."""

import pickle
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orrery.llm import common, decontaminate, jaccard_join, line_dedup
from orrery.llm.common import table


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def brute_lines(docs, floor=line_dedup.MIN_CHARS):
    first = {}
    for d in sorted(docs):
        for i, line in enumerate((docs[d] or "").split("\n")):
            if re.search(r"[^\x20\x09-\x0D]", line):
                first.setdefault(line, (d, i))
    long = [x for x in first if len(x) >= floor]
    near = {max(a, b, key=first.get) for i, a in enumerate(long) for b in long[:i] if within_one(a, b)}
    out = {}
    for d, text in docs.items():
        numbered = [(i, x) for i, x in enumerate((text or "").split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)]
        out[d] = (len(numbered), [i for i, x in numbered if first[x] != (d, i)], [i for i, x in numbered if first[x] == (d, i) and x in near])
    return out


def test_lines(docs_of, prose):
    rng, base = random.Random(4), [prose(9, i) for i in range(30)]
    texts = []
    for i in range(120):
        lines = []
        for _ in range(rng.randint(1, 5)):
            line = rng.choice(base)
            at = rng.randrange(len(line))
            lines.append(rng.choice([line, line[:at] + line[at + 1 :], line[:at] + "z" + line[at + 1 :], line[:at] + "é" + line[at:], line[:at] + "zz" + line[at:], line[:5], "  "]))
        texts.append("\n".join(lines))
    texts += ["𝒳" + base[0], base[0] + "𝒴", None, ""]
    docs = docs_of(texts)
    got = {r.doc_id: (r.n_lines, r.exact, r.near) for r in line_dedup.mark(docs).collect()}
    want = brute_lines(dict(enumerate(texts)))
    assert got == want and any(n for _, _, n in want.values())
    left = {r.doc_id: r.text for r in line_dedup.dedup(docs).collect()}
    for d, text in enumerate(texts):
        gone = {*want[d][1], *want[d][2]}
        lines = [x for i, x in enumerate((text or "").split("\n")) if i not in gone]
        if gone and not any(x.strip() for x in lines):
            assert d not in left
        else:
            assert left[d] == (text if not gone else "\n".join(lines))


def test_short_lines(docs_of):
    """One edit in lines of 12 characters or more, whatever the operator's floor says."""
    texts = ["Der, einge\u00e4 erer.", "Der einge\u00e4 erer.", "The, anhely eran.\nThe anhely eran.", "abcdefghijkl\nabcdefghijk", "abcdefghijkl\nabcdefghijkm\nxabcdefghijkl", "A.\nAn.", "mnopqrstuvw\nmnopqrstuvx"]
    got = {r.doc_id: (r.exact, r.near) for r in line_dedup.mark(docs_of(texts)).collect()}
    assert got == {0: ([], []), 1: ([], [0]), 2: ([], [1]), 3: ([], []), 4: ([0], [1, 2]), 5: ([], []), 6: ([], [])}


def test_lines_without_a_floor(docs_of):
    """Lines of any length within one edit, single letters among them."""
    rng = random.Random(8)
    lines = ["".join(rng.choice("abé𝒳") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    texts = ["\n".join(rng.choices(lines, k=3)) for _ in range(30)] + ["A.\nAn.", "hello worl\nhello world", "q", None]
    got = {r.doc_id: (r.n_lines, r.exact, r.near) for r in line_dedup.mark(docs_of(texts), 1).collect()}
    assert got == brute_lines(dict(enumerate(texts)), 1) and got[30][2] == [1] and got[31][2] == [1]


def test_lines_odd_rows(odd):
    assert line_dedup.mark(odd).count() == odd.count()
    assert line_dedup.dedup(odd).columns == odd.columns
    assert line_dedup.mark(odd.limit(0)).count() == 0 and line_dedup.dedup(odd.limit(0)).count() == 0


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute_classes(texts, k=4, a=85):
    sets = [shingles(t, k) for t in texts]
    up, links = list(range(len(texts))), Counter()

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= a * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), links[i]) for i in range(len(texts))}


def copies(prose, n=260):
    rng = random.Random(8)
    bases, out = [prose(rng.choice([3, 12, 60, 200]), i) for i in range(12)], []
    for i in range(n):
        words = rng.choice(bases).split() if i % 3 else prose(40, 1000 + i).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
            words[rng.randrange(len(words))] = rng.choice(["zog", "ZOG", "zug"])
        out.append(" ".join(words))
    return out + [None, "", " ", "one two three", "ONE  two\tthree", "one two"]


def test_jaccard(docs_of, prose, monkeypatch):
    texts = copies(prose)
    want = brute_classes(texts)
    for block in (None, 7):  # the second splits lists and groups into blocks
        if block:
            monkeypatch.setattr(jaccard_join, "LIST_BLOCK", block)
            monkeypatch.setattr(jaccard_join, "GROUP_BLOCK", block)
            monkeypatch.setattr(common, "HOT_ROWS", block)
            monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.join(docs_of(texts).repartition(5)).collect()}
        assert got == want
    assert max(n for *_, n in want.values()) >= 10


def test_components(spark, monkeypatch):
    """Paths, stars and rings, with hot targets dealt out or not."""
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(70)] + [(100, 101 + i) for i in range(90)] + [(300 + i, 300 + (i + 1) % 40) for i in range(40)]
    rng.shuffle(pairs)
    want = {i: 0 for i in range(71)} | {i: 100 for i in range(100, 191)} | {i: 300 for i in range(300, 340)}
    for hot in (1000, 3):
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        got = jaccard_join.components(spark.createDataFrame(pairs, "a long, b long").repartition(5)).collect()
        assert {r.id: r.root for r in got} == want and len(got) == len(want)


def test_one_of_each_class_stays(docs_of, prose):
    texts = copies(prose, 120)
    classes = brute_classes(texts, 5, 80)
    left = {r.doc_id for r in jaccard_join.keep_one(docs_of(texts), 5, True, (80, 100)).collect()}
    assert left == {i for i, (n, root, _) in classes.items() if not n or i == root}
    twice = docs_of([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (2, None)])
    assert sorted(jaccard_join.keep_one(twice).select("doc_id").collect()) == [(1,), (2,), (2,)]


def test_jaccard_odd_rows(odd):
    rows = jaccard_join.join(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.component_id == r.doc_id for r in rows if r.n_shingles == 0)
    assert {r.component_id for r in rows if r.n_shingles == 1 and r.doc_id in (3, None)} == {3}
    assert jaccard_join.join(odd.limit(0)).count() == 0
    assert jaccard_join.keep_one(odd).columns == odd.columns


def test_required_overlap():
    for n in range(1, 60):
        for m in range(1, 60):
            o = int(jaccard_join.required(n, m, (85, 100)))
            assert 100 * o >= 85 * (n + m - o) and 100 * (o - 1) < 85 * (n + m - o + 1)


@pytest.fixture(scope="module")
def bench(spark, prose):
    items = [(i, prose(n, 500 + i)) for i, n in enumerate([6, 15, 20, 33, 33, 58])] + [(90, None), (91, "too few words"), (92, "")]
    return spark.createDataFrame(items, "item_id long, text string"), dict(items)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def brute_hits(texts, items):
    out = {}
    for d, text in enumerate(texts):
        words = decontaminate.words_of(text)
        for i, item in items.items():
            w = decontaminate.words_of(item)
            if not w:
                continue
            near = [(e, p) for p in range(len(words) - len(w) + 1) if (e := edits(words[p : p + len(w)], w)) <= len(w) // 5]
            if len(w) - len(w) // 5 <= len(words) < len(w) and (e := edits(words, w)) <= len(w) // 5:
                near = [(e, 0)]
            if near:
                out[d, i] = min(near)
    return out


def test_decontamination(docs_of, prose, bench):
    table_, items = bench
    rng, texts = random.Random(3), []
    for i in range(90):
        words = items[i % 6].split()
        for _ in range(rng.randint(0, len(words) // 5 + 2)):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([["zog"], [], [words[at], "zug"], [words[at].upper() + ","]])
        texts.append(" ".join([prose(rng.randint(0, 40), i), *words, prose(rng.randint(0, 40), i + 7)]))
    texts += [None, "", items[2], prose(4000, 77), prose(300, 1) + " " + items[5] + " " + items[0]]
    for i in range(6):  # documents of fewer words than the item: first, last or inner words missing
        w = items[i].split()
        texts += [" ".join(x) for k in (1, 2, len(w) // 5, len(w) // 5 + 1) for x in (w[k:], w[:-k], w[:3] + w[3 + k :])]
    texts += ["far too, FEW words", "too few", "too few words", "some words too few words more"]
    want = brute_hits(texts, items)
    rows = decontaminate.find(docs_of(texts), table_).collect()
    got = {(r.doc_id, r.item_id): (r.distance, r.start_word) for r in rows}
    assert set(got) <= set(want)
    assert len(got) >= 0.97 * len(want) and sum(got[k][0] == want[k][0] for k in got) >= 0.97 * len(got)
    verbatim = {k for k, (e, _) in want.items() if e == 0}
    assert verbatim <= set(got)
    blocks = decontaminate.with_hits(docs_of(texts), table_, held=200).select("row.doc_id", F.explode("hits.item_id")).collect()
    assert verbatim <= set(blocks) <= set(want) and len(set(blocks)) == len(blocks) >= 0.97 * len(want)
    clean = {r.doc_id for r in decontaminate.clean(docs_of(texts), table_).collect()}
    assert clean == set(range(len(texts))) - {d for d, _ in got}


def test_decontamination_odd_rows(odd, bench):
    assert decontaminate.clean(odd, bench[0]).columns == odd.columns
    assert decontaminate.clean(odd, bench[0]).count() == odd.count()
    assert decontaminate.clean(odd.limit(0), bench[0]).count() == 0
    assert decontaminate.clean(odd, bench[0].limit(0)).count() == odd.count()


def test_items_are_sent_as_plain_values():
    items = decontaminate.Items([(1, "one two three four five six"), (2, "seven eight")])
    sent = pickle.dumps(vars(items))
    assert b"orrery" not in sent
    texts = ["zero one two three four six", "seven eight"]
    assert decontaminate.hits_of(texts, decontaminate.Items.of(pickle.loads(sent))) == decontaminate.hits_of(texts, items) != [[], []]


def test_edit_distance_rows():
    import numpy as np

    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 4, (40, 12)), rng.integers(0, 4, (40, 12))
    n, m = rng.integers(7, 13, 40), rng.integers(7, 13, 40)
    want = [min(edits(list(x[:i]), list(y[:j])), 6) for x, y, i, j in zip(a, b, n, m, strict=True)]
    assert decontaminate.edit_distance(a, b, n, m, 5).tolist() == want


def test_equal_items_and_portions(docs_of, prose, spark, monkeypatch):
    """Many equal items and small portions give every match once."""
    monkeypatch.setattr(decontaminate, "STEPS_HELD", 500)
    monkeypatch.setattr(decontaminate, "PAIRS_HELD", 7)
    items = decontaminate.Items([(i, prose(30, 5)) for i in range(25)] + [(50, "lone")])
    found = decontaminate.hits_of([prose(10, 1) + " " + prose(30, 5) + " zog", prose(30, 5)[:-4], "a lone word"], items)
    assert [[h["item_id"] for h in hits] for hits in found] == [list(range(25)), list(range(25)), [50]]


def test_one_row_of_equal_texts(spark):
    """Which of the rows of equal id and text stays does not hang on their partitions."""
    rows = [(1, "a b c d e f", x) for x in range(12)]
    stays = {jaccard_join.keep_one(spark.createDataFrame(rows[i:] + rows[:i], "doc_id long, text string, x long").repartition(i + 1)).first().x for i in (0, 3, 7)}
    assert len(stays) == 1


@pytest.mark.parametrize("at", range(5))
def test_stages_on_odd_rows(spark, small, odd, at):
    """Nulls, empty and long texts, repeated rows, clashing columns, no rows."""
    stage = corpus_pipeline.STAGES[at][1]
    some = stage(spark, odd, small)
    if at < 4:
        assert some.columns == odd.columns
    rows = some.collect()
    assert len(rows) <= odd.count() and (at == 0 or rows)
    assert stage(spark, odd.limit(0), small).count() == 0


def test_pipeline(spark, small):
    docs = table(spark, small, "documents")
    before = {r.doc_id: r.text for r in docs.collect()}
    frame, seen = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, small)
        assert frame.columns == docs.columns
        frame = frame.cache()
        seen.append(frame.count())
    assert len(before) > seen[0] >= seen[1] >= seen[2] >= seen[3] > 0
    rows = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in frame.collect()}
    assert corpus_pipeline.ORACLE_SQL is None


def rows_read_by_a_task(spark, run):
    """What run() returns, and the most shuffled rows that one task of its jobs read."""
    store, jvm, name = spark.sparkContext._jsc.sc().statusStore(), spark._jvm, f"rows-{random.random()}"
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    most, status = 0, spark.sparkContext.statusTracker()
    for job in status.getJobIdsForGroup(name):
        for stage in status.getJobInfo(job).stageIds:
            tasks = store.taskList(stage, 0, 1 << 30)
            for i in range(tasks.size()):
                metrics = tasks.apply(i).taskMetrics()
                if metrics.isDefined():
                    most = max(most, metrics.get().shuffleReadMetrics().recordsRead())
    return out, most


def test_many_equal_texts_beyond_a_broadcast(spark, docs_of, prose, monkeypatch):
    """With no broadcast of candidates, 10,000 equal texts and lines still never meet in one task."""
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    text, other = prose(40, 1), prose(40, 2)
    docs = docs_of([text] * 10_000 + [text + " zog", other, other + " zug", prose(40, 3)]).repartition(16)
    (found, n), most = rows_read_by_a_task(spark, lambda: jaccard_join.classes(docs))
    rows = found.collect()
    assert n == 10_004 and most < 1_000
    assert sorted((r.copies, r.links, r.members, r["first"].doc_id) for r in rows) == [(1, 0, 1, 10_003), (1, 1, 2, 10_001), (1, 1, 2, 10_001), (1, 10_000, 2, 0), (10_000, 10_000, 2, 0)]
    line, other = prose(8, 1), prose(8, 2)  # short, as every place of a distinct line gives a variant, which is a row
    lines = docs_of([line] * 10_000 + [line + "z", "y" + other, other]).repartition(16)
    marked, most = rows_read_by_a_task(spark, lambda: line_dedup.drops(lines))
    assert most < 1_000
    assert marked.select(F.sum(F.size("exact")), F.sum(F.size("near"))).first() == (9_999, 2)


def test_sifted_loses_nothing(spark, monkeypatch):
    """Every wanted row passes, with few others, or with more when the filter is small for its keys."""
    rows = spark.range(-5_000, 5_000).select(F.col("id").alias("key"), F.lit("x").alias("_bit"))
    wanted = rows.where("key % 50 = 0").select("key")
    for bits, most in ((common.SIFT_BITS, 210), (64, 10_000)):
        monkeypatch.setattr(common, "SIFT_BITS", bits)
        got = [r.key for r in common.sifted(rows, wanted, "key").collect()]
        assert {k for k in range(-5_000, 5_000) if k % 50 == 0} <= set(got) and len(set(got)) == len(got) <= most
    assert common.sifted(rows, wanted.limit(0), "key").count() == 0

"""Quality, URLs, mixing, token counts."""

import base64
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from orrery.llm import mixing, quality, tokens, url_filter


def base_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered.update(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words)


def test_quality(spark, odd, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for table in (docs, odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        want = {r.doc_id: base_quality(r.text) for r in table.collect()}
        rows = quality.judge(table).collect()
        assert {r.doc_id: tuple(r[1:7]) for r in rows} == want
        assert not any(r.kept and r.base_failed for r in rows)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns


def test_fertility_figures(spark, odd, small):
    """Characters per token, byte share and entropy, counted token by token."""
    import math

    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{small}/documents.parquet").unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is not null").dropDuplicates(["doc_id"]).withColumn("doc_id", F.col("doc_id") + 10**6))
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for row in docs.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", row.text or "")
        tokens = [t for w in words for t in model.encode(w, out_type=str)]
        count = Counter(tokens)
        bits = sum(-c / len(tokens) * math.log2(c / len(tokens)) for c in count.values())
        r = got[row.doc_id]
        byte = sum(bool(re.fullmatch("<0x[0-9A-F]{2}>", t)) for t in tokens)
        want = (sum(map(len, words)) / max(1, len(tokens)), byte / max(1, len(tokens)), bits)
        assert (r.chars_per_token, r.byte_share, r.token_entropy) == pytest.approx(want, abs=2e-6)


def test_bands(docs_of, prose):
    import random

    rng = random.Random(2)
    noise = " ".join("".join(rng.choice("ABCDEFGHJKLMNPQRSTVWXYZ0123456789+/") for _ in range(40)) for _ in range(60))
    clean = [prose(200, i) for i in range(10)]
    wrong = " ".join("".join(chr(rng.randint(0x1A00, 0x1CFF)) for _ in range(6)) for _ in range(60))
    rows = quality.judge(docs_of([*clean, noise, wrong, " ".join(f"a{'b' * (i % 2)}" for i in range(7)) + " the" * 60])).orderBy("doc_id").collect()
    assert all(r.kept for r in rows[:10])
    assert not rows[10].base_failed and not rows[10].kept
    assert not rows[11].base_failed and not rows[11].kept


def test_derived_bands(spark):
    """Junk with words in it goes by its language's own figures; clean text of a language that
    measures as low as another's junk stays."""
    import random

    rng = random.Random(3)
    syllables = {"en": "the ing ation and er on ly est ed sh wh tion ment ous ive al ble to or is an it of in at".split(), "fr": "é eux è que ç oi la ê ée â î ou ai er re le ô û en ir ez as on ui ë".split()}
    words = {k: ["".join(rng.choice(v) for _ in range(rng.randint(1, 3))) for _ in range(300)] for k, v in syllables.items()}

    def text(lang, end=""):
        return " ".join(rng.choice(words[lang]) + end * 3 for _ in range(rng.randint(185, 250)))

    def runs(lang):
        return " ".join(w for w in rng.sample(sorted(set(words[lang])), 28) for _ in range(8))

    rows = [(lang, "clean", text(lang)) for lang in words for _ in range(150)]
    rows += [(lang, "symbols", text(lang, end)) for lang in words for end in "#$&*%"]
    rows += [(lang, "runs", runs(lang)) for lang in words for _ in range(5)]
    docs = spark.createDataFrame([(i, t, lang, kind) for i, (lang, kind, t) in enumerate(rows)], "doc_id long, text string, lang string, kind string")
    got = quality.judge(docs, carry=("doc_id", "lang", "kind")).collect()
    assert not any(r.base_failed for r in got)
    assert not any(r.kept for r in got if r.kind != "clean")
    kept = [r for r in got if r.kind == "clean" and r.kept]
    assert len(kept) >= 297
    least = {lang: min(r.chars_per_token for r in got if r.lang == lang and r.kept) for lang in words}
    assert least["fr"] < min(r.chars_per_token for r in got if r.lang == "en" and r.kind == "symbols")
    copied = docs.unionByName(docs.where("doc_id = 0").crossJoin(spark.range(500)).select(*docs.columns)).repartition(7)
    again = {r.doc_id: r.kept for r in quality.judge(copied).collect()}
    assert again == {r.doc_id: r.kept for r in got}
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == {r.doc_id for r in got if r.kept}


def test_thin_classes_are_pooled(spark):
    """A few long documents are held against the next lengths of their band: clean ones stay and plain junk
    goes, as with many of their own length. What is near the fence, or far from any other length, is only
    told by documents of its own length."""
    import random

    rng = random.Random(4)
    words = ["".join(rng.choice("the ing ation and er on ly est ed sh wh tion ment ous ive al ble".split()) for _ in range(rng.randint(1, 3))) for _ in range(300)]

    def text(n, end=""):
        return " ".join(rng.choice(words) + end for _ in range(n))

    def verdicts(rows):
        docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(rows)], "doc_id long, text string, lang string")
        return [r.kept for r in quality.judge(docs).orderBy("doc_id").collect()]

    asked = [text(400) for _ in range(6)] + [text(400, "###"), text(400, "$$$$")] + [text(23)] + [text(23, "%%%%")]
    others, own = [text(rng.randint(185, 250)) for _ in range(120)], [text(n) for n in (400, 23) for _ in range(60)]
    alone, in_small, in_large = verdicts(asked[:6]), verdicts(asked + others), verdicts(asked + others + own)
    assert alone == [True] * 6
    assert in_small[: len(asked)] == [True] * 6 + [True, False] + [True, True]
    assert in_large[: len(asked)] == [True] * 6 + [False, False] + [True, False]
    assert not any(verdicts(["the " * 25] * 2 + [" ".join(["the"] * 3 + ["of"]) + " x the" * 11]))  # little entropy, few tokens


def test_trend(spark):
    """Least squares over the length classes, copies of a figure counted; one class has no trend."""
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [("en", int(x), "f", round(float(0.9 - 0.023 * x + rng.normal(0, 0.01)), 3), int(n)) for x, n in zip(rng.integers(8, 25, 40), rng.integers(1, 9, 40), strict=True)] + [("fr", 9, "f", 0.5, 3), ("fr", 9, "f", 0.7, 1)]
    got = {r.band: r.slope for r in quality.trends(spark.createDataFrame(rows, "band string, other long, figure string, value double, n long")).collect()}
    x, y, n = (np.array([r[i] for r in rows if r[0] == "en"], float) for i in (1, 3, 4))
    assert got == pytest.approx({"en": np.polyfit(x, y, 1, w=np.sqrt(n))[0], "fr": 0.0}, abs=1e-9)


def test_pools(spark):
    """Classes join by distance, both of one distance together, until there are enough."""
    rows = [("en", 9, 29), ("en", 10, 500), ("en", 8, 1), ("en", 14, 3), ("fr", 3, 2), ("fr", 20, 4), ("de", 5, 30)]
    got = {}
    for r in quality.pools(spark.createDataFrame(rows, "band string, length_class long, size long")).collect():
        got.setdefault((r.band, r.length_class), set()).add(r.other)
    want = {}
    for band, c, _ in rows:
        for d in range(60):
            pool = {o for b, o, _ in rows if b == band and abs(o - c) <= d}
            if sum(n for b, o, n in rows if b == band and o in pool) >= quality.MIN_DOCS:
                break
        want[band, c] = pool
    assert got == want and got["en", 9] == {8, 9, 10} and got["en", 10] == {10} and got["fr", 3] == {3, 20}


def test_quality_odd_rows(odd):
    assert quality.judge(odd).count() == odd.count()
    assert quality.keep_good(odd).columns == odd.columns
    assert quality.judge(odd.limit(0)).count() == 0
    no_lang = odd.withColumn("lang", F.lit(None).cast("string"))
    assert quality.judge(no_lang).count() == odd.count()


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


URLS = [
    None, "", "nothing", "http://", "http://net", "http://net/", "http://a.net?x=/en/", "https://EXAMPLE.net/en/x", "http://m.example.net/en", "http://xexample.net/en/", "http://notnet/",
    "http://example.com/de/1", "http://b.example.com/de/1?q=://z", "http://example.org/fr/#a", "http://É.org/fr/", "ftp://a.example.com/en/%20?a=1&b=2#c", "x://y://z.net/",
]


def test_urls(spark, small):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string").union(spark.read.parquet(f"{small}/pages.parquet").selectExpr("page_id + 1000", "url"))
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    for r in (rows := {r.page_id: r for r in url_filter.verdicts(pages).collect()}).values():
        assert r.verdict in ("allow", "block")
    for page in pages.collect():
        host, path = split_url(page.url)
        fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda x: len(x[0]), default=None)
        r = rows[page.page_id]
        assert (r.host, r.path, r.rule) == (host, path, best and best[0])
        assert best is None or r.verdict == best[1]


def labelled_urls(n):
    """URLs of many hosts, blocked by the look of the host or the parameters and not by suffix."""
    import random

    rng, out = random.Random(6), []
    for i in range(n):
        bad = rng.random() < 0.4
        name = "-".join(f"{rng.choice(['win', 'best', 'go'])}{rng.randrange(10**4)}" for _ in range(3)) if bad and i % 2 else "".join(rng.choice(["ta", "re", "lo", "mi"]) for _ in range(4))
        query = "?" + "&".join(f"{k}={rng.randrange(10**6)}" for k in "abcde") if bad and not i % 2 else rng.choice(["", "?page=2", "#top"])
        out.append((f"https://{name}{i % 97}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'fr'])}/{rng.randrange(10**4)}{query}", float(bad)))
    return out


def test_trees_on_held_out_hosts(spark):
    """Whole hosts are held out, and the label is in no rule."""
    rows = url_filter.parts(spark.createDataFrame(labelled_urls(3000), "url string, label double")).cache()
    held = F.pmod(F.xxhash64("host", F.lit(3)), F.lit(4)) == 0
    judged = url_filter.Judge(rows.where(~held)).judge(rows.where(held))
    right, blocked = judged.agg(F.avg(((F.col("model_verdict") == "block").cast("double") == F.col("label")).cast("double")), F.avg((F.col("model_verdict") == "block").cast("double"))).first()
    assert right > 0.95 and 0.3 < blocked < 0.5


def test_trees_decide_what_no_rule_does(spark):
    """On the whole table the verdict of URLs without a rule is the trees': suffixes whose labelled URLs
    of other hosts were blocked are blocked, those whose were allowed are allowed."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    rows = url_filter.verdicts(pages).where("rule is null").groupBy(F.substring_index("host", ".", -1).alias("suffix")).agg(F.avg((F.col("verdict") == "block").cast("double")).alias("blocked")).collect()
    assert {r.suffix: round(r.blocked) for r in rows} == {"com": 1, "org": 0}


def test_urls_odd_rows(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] * 2 + [(None, "http://example.net/x")], "page_id long, url string")
    for name in ("host", "path", "rule", "prediction", "fold", "features", "label", "n", "blocked", "suffix", "verdict"):
        pages = pages.withColumn(name, F.lit(1))
    rows = url_filter.verdicts(pages).collect()
    assert len(rows) == 2 * len(URLS) + 1
    assert len({(r.page_id, r.verdict, r.rule) for r in rows}) == len(URLS) + 1


def test_urls_without_labels(spark):
    pages = spark.createDataFrame([(0, "http://a.com/x"), (1, None)], "page_id long, url string")
    assert {r.verdict for r in url_filter.verdicts(pages).collect()} == {"allow"}
    assert url_filter.verdicts(pages.limit(0)).count() == 0
    blocked = spark.createDataFrame([("http://b.com/", 1.0)], "url string, label double")
    assert {r.verdict for r in url_filter.verdicts(pages, blocked).collect()} == {"block"}


def test_suffix_rates_of_all_labelled_urls(spark, monkeypatch):
    """Rates count rows that the trees' sample leaves out, and one hot URL does not fill the sample."""
    urls = [(f"http://h{i % 7}.t{i % 5}/s{i % 3}/{i}", float(i % 5 < 2)) for i in range(300)]
    rows = urls + [urls[0]] * 200
    labelled = spark.createDataFrame(rows, "url string, label double")
    want = defaultdict(lambda: [0.0, 0])
    for url, label in rows:
        want[url.split("/")[2].split(".")[1]][0] += label
        want[url.split("/")[2].split(".")[1]][1] += 1
    mean = sum(x for _, x in rows) / len(rows)
    judged = []
    for bound in (url_filter.BROADCAST_ROWS, 0):
        monkeypatch.setattr(url_filter, "BROADCAST_ROWS", bound)
        judge = url_filter.Judge(labelled, sample=40)
        got = {r.suffix: r.suffix_rate for r in judge.rates["suffix"].where(F.col("fold") == url_filter.FOLDS).collect()}
        assert got == pytest.approx({k: (b + url_filter.PRIOR * mean) / (n + url_filter.PRIOR) for k, (b, n) in want.items()})
        fold = {u: f for u, f in spark.createDataFrame(sorted(set(rows)), "url string, label double").selectExpr("url", f"pmod(xxhash64(split_part(url, '/', 3)), {url_filter.FOLDS})").collect()}
        for k in want:
            other = [x for u, x in rows if u.split("/")[2].endswith("." + k) and fold[u] != 0]
            if any(u.split("/")[2].endswith("." + k) and fold[u] == 0 for u, _ in rows):
                rate = judge.rates["suffix"].where((F.col("fold") == 0) & (F.col("suffix") == k)).first().suffix_rate
                assert rate == pytest.approx((sum(other) + url_filter.PRIOR * mean) / (len(other) + url_filter.PRIOR))
        judged.append({(r.url, r.model_verdict) for r in judge.judge(url_filter.ruled(url_filter.parts(labelled))).collect()})
    assert judged[0] == judged[1] == {(u, "block" if x else "allow") for u, x in urls}


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, total, full = {s: i % 3 + 1 for i, s in enumerate(order)}, sum(sizes.values()), set()
    while True:
        left, w = total - sum(3 * sizes[s] for s in full), sum(weight[s] for s in sizes if s not in full)
        aim = {s: 3.0 * sizes[s] if s in full else left * weight[s] / w for s in sizes}
        over = {s for s in sizes if s not in full and aim[s] > 3 * sizes[s]}
        if not over:
            return aim
        full |= over


def test_mixing(spark, docs_of, prose):
    rows = [(i, prose(10 + i % 90, i), ["a", "b", "c", "d", None][min(4, i % 40 // 8)] if i % 3 else "a") for i in range(400)] + [(1000, None, "a"), (1001, "", "e"), (1002, prose(3, 1), "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, again = (sorted(map(tuple, mixing.allot(docs.repartition(n), shard_words=2000).collect()), key=str) for n in (3, 5))
    assert first == again
    sizes, took = defaultdict(int), defaultdict(int)
    for _, source, size, _, _, taken in first:
        sizes[source] += size
        took[source] += taken
        assert 0 <= taken <= 3 * size
    aim = brute_targets(sizes)
    for _, source, _, source_size, target, _ in first:
        assert source_size == sizes[source] and target == pytest.approx(aim[source])
    assert all(abs(took[s] - aim[s]) <= 2 * mixing.BLOCK for s in sizes)


@pytest.mark.parametrize("name, value", [("FAN", 2), ("BROADCAST_ROWS", 1)])
def test_mixing_at_scale(spark, docs_of, prose, monkeypatch, name, value):
    """Many shards are dealt to run by run, many sources met by a shuffle; totals and reruns hold."""
    rows = [(i, prose(10 + i % 90, i), ["a", "b", None][min(2, i % 10 // 4)]) for i in range(300)] + [(1000 + i, None, "empty") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plain = {r.doc_id: (r.source, r.size, r.source_size, r.target, r.taken) for r in mixing.allot(docs, shard_words=800).collect()}
    monkeypatch.setattr(mixing, name, value)
    got = {r.doc_id: (r.source, r.size, r.source_size, r.target, r.taken) for r in mixing.allot(docs.repartition(4), shard_words=800).collect()}
    assert len(got) == len(rows) and {k: v[:4] for k, v in got.items()} == {k: v[:4] for k, v in plain.items()}
    if name == "BROADCAST_ROWS":
        assert got == plain
    took, aim = defaultdict(int), {v[0]: v[3] for v in got.values()}
    for source, size, _, _, taken in got.values():
        took[source] += taken
        assert 0 <= taken <= 3 * size
    assert all(abs(took[s] - aim[s]) <= 2 * mixing.BLOCK for s in aim)


def test_apportionment(spark):
    """Against dealing seat by seat."""
    votes = {"a": 53.0, "b": 24.0, "c": 23.0, "d": 0.5, "e": 0.0}
    for seats in (0, 1, 2, 7, 100):
        won = dict.fromkeys(votes, 0)
        for _ in range(seats):
            won[max(votes, key=lambda k: (votes[k] / (2 * won[k] + 1), -ord(k)))] += 1
        rows = spark.createDataFrame([(k, v, seats) for k, v in votes.items()], "k string, v double, seats long")
        assert {r.k: r.out for r in mixing.apportion(rows, [], ["k"], "v", "seats", "out").collect()} == won


def test_mixing_odd_rows(odd):
    assert mixing.allot(odd).count() == odd.count()
    assert mixing.allot(odd.limit(0)).count() == 0


def test_tokens(spark, odd, small):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{small}/documents.parquet")
    lengths = [len(encoding.encode_ordinary(r.text or "")) for r in docs.collect()]
    hist = tokens.histogram(docs)
    assert {r.length: r.n_docs for r in hist.collect()} == Counter(lengths)
    sums = tokens.suffix_sums(hist)
    for r in sums.collect():
        assert (r.docs_from, r.tokens_from) == (sum(x >= r.length for x in lengths), sum(x for x in lengths if x >= r.length))
        assert r.tokens_cut_here == sum(min(x, r.length) for x in lengths)
    for r in tokens.at_limits(hist, [0, 128, 2048, 10**6]).collect():
        assert (r.n_docs, r.n_tokens, r.docs_over, r.tokens_kept) == (len(lengths), sum(lengths), sum(x > r.context_limit for x in lengths), sum(min(x, r.context_limit) for x in lengths))
    ordered = sorted(lengths)
    assert {r.p: r.length for r in tokens.quantiles(sums, [0.5, 1.0]).collect()} == {0.5: ordered[(len(ordered) + 1) // 2 - 1], 1.0: ordered[-1]}
    assert tokens.histogram(odd).agg(F.sum("n_docs")).first()[0] == odd.count()
    none = tokens.histogram(odd.limit(0))
    assert tokens.suffix_sums(none).count() == 0 and [r.n_docs for r in tokens.at_limits(none, [5]).collect()] == [0]

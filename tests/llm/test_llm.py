"""The training-data operators against brute force on small fixtures, and their defined edge cases."""

import glob
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from ratelake.llm import chat_format, decontamination, line_dedup, mixing, ordinal_classifier, quality_rules, simhash, substring_dedup, textkernel, token_output, url_filter
from ratelake.llm.common import shared_path
from ratelake.llm.components import connected_components

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
WORDS = "the quick brown fox jumps over lazy dogs while seven clever ravens watch from old stone walls and nobody says a word about it".split()


def make_docs(n=60, seed=0):
    """Texts with copies, near copies, shared passages, nulls, empties, repeated rows and null ids."""
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ",", "é"]) for _ in range(k))
    passage = text(70)
    rows = [(i, text(rng.randint(1, 200)).replace(" w", "\nw")) for i in range(n)]
    rows += [(n + i, rows[i][1]) for i in range(5)]
    rows += [(n + 10 + i, f"{text(20)} {passage} {text(20)}") for i in range(5)]
    rows += [(n + 20 + i, " ".join(w if rng.random() > 0.01 else "changed" for w in rows[i][1].split(" "))) for i in range(10)]
    rows += [(n + 40, None), (n + 41, ""), (n + 42, " \n\t "), (n + 43, "\n".join(["same line here"] * 4)), (n + 43, "\n".join(["same line here"] * 4)), (None, passage)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{(i or 0) % 3}" if i != 7 else None, 0, 1.5) for i, t in make_docs()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, hash double").repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 5 > 0), int(i % 7 == 0)) for i in range(60)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_kernel_words():
    texts = [t or "" for _, t in make_docs()] + ["\x1c\x85a\u00a0b c", "x" * 5000]
    for limit in (1, 500, 1 << 20):
        got = []
        for c in textkernel.chunks(pa.array(texts), limit):
            start, end, first = c.words()
            raw = c.data.tobytes()
            got += [[raw[i:j].decode() for i, j in zip(start[a:b], end[a:b])] for a, b in zip(first, first[1:])]
        assert got == [WORD.findall(t) for t in texts]


def base_stats(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_op1(spark, docs, labels, nothing):
    out = quality_rules.score(docs, labels).collect()
    exp = sorted((i, *base_stats(t)) for i, t in make_docs() if i is not None)
    assert sorted(tuple(r)[:6] for r in out if r.doc_id is not None) == exp
    assert all(r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) and not (r.base_failed and r.kept) for r in out)
    again = quality_rules.score(docs.repartition(7), labels)
    assert rows_of(again) == rows_of(quality_rules.score(docs, labels))
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in out)
    assert quality_rules.score(nothing, labels).count() == 0
    assert all(r.llr == 0 for r in quality_rules.score(docs, labels.where("false")).collect())


def test_op1_repeated_ids(spark, labels):
    """An id that many rows share sets the threshold once."""
    rng = random.Random(21)
    text = lambda: " ".join(rng.choice(WORDS) for _ in range(80))
    rows = [(i % 40, text()) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sample = quality_rules.trusted_sample(labels)
    ratios = quality_rules.log_ratios(df, sample)
    held = {r.doc_id for r in sample.where("not trusted").collect()}
    lowest = {}
    for i, t in rows:
        if i in held:
            llr = float(quality_rules.judge(pa.array([t]), ratios, 0.0)["llr"][0])
            lowest[i] = min(llr, lowest.get(i, llr))
    scores = np.array(sorted(lowest.values()))
    assert quality_rules.threshold_of(df, sample, ratios) == pytest.approx(2 * np.quantile(scores, quality_rules.LOW) - np.median(scores))


def test_op1_all_trusted(spark, monkeypatch):
    """Every good document is trusted or held out, and the threshold is numpy's, however ids are joined."""
    many = spark.range(30_000).selectExpr("id as doc_id", "1 as quality", "cast(id % 10 = 0 as int) as toxic")
    assert quality_rules.trusted_sample(many).count() == 27_000
    rng = random.Random(31)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(40, 90)))) for i in range(500)]
    df, sample = spark.createDataFrame(rows, "doc_id long, text string"), quality_rules.trusted_sample(many)
    held = {r.doc_id for r in sample.where("not trusted and doc_id < 500").collect()}
    for most in (1 << 20, 0):
        monkeypatch.setattr(quality_rules, "MAX_BROADCAST", most)
        ratios = quality_rules.log_ratios(df, sample)
        out = quality_rules.judge(pa.array([t for i, t in rows if i in held]), ratios, 0.0)
        scores = np.sort(out["llr"][out["n_words"] >= 50])
        assert quality_rules.threshold_of(df, sample, ratios) == pytest.approx(2 * np.quantile(scores, quality_rules.LOW) - np.median(scores), rel=1e-12)
    values = np.array([-3.5, -0.0, 0.0, 1e-300, 2.0, 2.0, 2.0, -7.25, 1e9, -1e-9])
    codes = spark.createDataFrame([(int(c),) for c in quality_rules._ordered(values)], "code long")
    got = np.array(quality_rules.at_ranks(codes, range(10)), np.int64)
    assert (quality_rules._ordered(got.view(np.float64)).view(np.float64) == np.sort(values)).all()


def test_op1_ratio(docs, labels):
    """Log ratios from plain counting of hashed n-grams."""
    sample = quality_rules.trusted_sample(labels)
    trusted = {r.doc_id for r in sample.where("trusted").collect()}
    counts = np.zeros((2, quality_rules.BUCKETS))
    for i, t in make_docs():
        (c,) = textkernel.chunks(pa.array([t or ""]))
        start, end, _ = c.words()
        h = textkernel.span_hashes(c.prefix(), start, end, textkernel.POWERS)
        grams = [*h, *textkernel.combine(h[:-1], h[1:])] if len(h) else []
        for g in grams:
            counts[0, int(g) % quality_rules.BUCKETS] += 1
            counts[1, int(g) % quality_rules.BUCKETS] += i in trusted
    p = (counts + 1) / (counts.sum(axis=1, keepdims=True) + quality_rules.BUCKETS)
    assert np.allclose(quality_rules.log_ratios(docs, sample), np.log(p[1] / p[0]), atol=1e-6)


def test_op2(spark, docs, nothing):
    out = mixing.mix(docs).collect()
    assert len(out) == docs.count()
    total = sum(r.size for r in out)
    sources = {r.source: r for r in out}
    order = sorted((s for s in sources if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, rest = {}, set(order), float(total)
    while True:
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 3 * sources[s].source_size}
        if not full:
            break
        for s in full:
            target[s] = 3.0 * sources[s].source_size
        open_, rest = open_ - full, total - sum(target.values())
    target |= {s: weight[s] * level for s in open_}
    for s in order:
        assert sources[s].target == pytest.approx(target[s])
        assert abs(sum(r.taken for r in out if r.source == s) - target[s]) <= mixing.BLOCK
    assert all(0 <= r.taken <= 3 * r.size for r in out)
    assert rows_of(mixing.mix(docs.repartition(5))) == sorted(map(tuple, out), key=repr)
    assert mixing.mix(nothing).count() == 0
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0


def test_op2_equal_rows(spark):
    """A source of 2,000 equal rows: spread over shards, and taken to within a document of its target."""
    rows = [(7, "same words in every row of it " * 8 + "end", "a", k) for k in range(2000)] + [(100 + k, f"w{k} " * 40, "b", k) for k in range(700)] + [(None, None, None, 0)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, k int").repartition(5)
    out = mixing.mix(df).collect()
    own = [r for r in out if r.source == "a"]
    size, target = own[0].size, own[0].target
    assert size == 57 and len(own) == 2000 and abs(sum(r.taken for r in own) - target) <= mixing.BLOCK and max(r.taken for r in own) <= 3 * size
    mixed = mixing.apply_mix(df).collect()
    taken = [r for r in mixed if r.source == "a"]
    assert abs(len(taken) * size - target) <= size + mixing.BLOCK
    per = np.bincount([r.k for r in taken], minlength=2000)
    assert per.max() - per.min() <= 1  # each row has its share
    assert rows_of(mixing.mix(df.repartition(3))) == sorted(map(tuple, out), key=repr)
    assert len(mixing._told_apart(mixing._sized(df, 1), 1).select("__hash").distinct().collect()) == 2000 + 700 + 3


def test_op2_clashing_names(spark, docs):
    """Columns of any name come back as they were."""
    odd = docs.selectExpr("*", "doc_id * 3 as __hash", "'x' as __id", "doc_id as copy", "doc_id as copies", "1 as row", "2 as shard")
    mixed = mixing.apply_mix(odd)
    assert mixed.columns == odd.columns
    assert all(r["__hash"] == 3 * r.doc_id and r.copies == r.copy == r.doc_id and (r.row, r.shard) == (1, 2) for r in mixed.where("doc_id is not null").collect())


def test_op2_many_partitions(spark):
    """Places in an order from thousands of sorted partitions."""
    from ratelake.operators.shared import with_position

    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "2000")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = with_position(spark.range(5000).select((F.col("id") * 7 % 5000).alias("k")), "k", name="rank")
        assert got.where("k <> rank").count() == 0 and got.count() == 5000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_op2_shards(spark, monkeypatch):
    """Every shard's quota against seat by seat, group by group."""
    monkeypatch.setattr(mixing, "GROUP", 4)
    rng = random.Random(5)
    sizes = [rng.randrange(1, 1000) for _ in range(11)]
    df = spark.createDataFrame([(False, "a", i, n, sum(sizes), 77) for i, n in enumerate(sizes)], "__null boolean, __source string, shard long, shard_size long, source_size long, quota long")
    got = [r.shard_quota for r in mixing.shard_quotas(df).orderBy("shard").collect()]
    groups = [sizes[i : i + 4] for i in range(0, 11, 4)]
    exp = [q for g, n in zip(groups, sainte_lague([sum(g) for g in groups], 77)) for q in sainte_lague(g, n)]
    assert got == exp


def sainte_lague(targets, n):
    seats = [0] * len(targets)
    for _ in range(n):
        best = max(range(len(targets)), key=lambda i: (targets[i] / (2 * seats[i] + 1), -i))
        seats[best] += 1
    return seats


def test_op2_quotas(spark):
    for seed in range(3):
        rng = random.Random(seed)
        targets = [rng.random() ** 3 * 100 + 0.01 for _ in range(15)]
        df = spark.createDataFrame([(False, f"{i:02}", t) for i, t in enumerate(targets)], "__null boolean, __source string, target double")
        got = [r.quota for r in mixing.quotas(df, 101).orderBy("__source").collect()]
        assert got == sainte_lague(targets, 101)


def test_op3(spark):
    hard = ["</s>[INST] ok [/INST]", "\\l<s>\\", "", None, "é[b\\b]", "x\n" * 3]
    rng = random.Random(1)
    rows = [(c, k, rng.choice(["user", "assistant", "system", None]), rng.choice(hard)) for c in range(30) for k in range(rng.randint(1, 6))] + [(1, 0, "user", "twice"), (1, 0, "user", "twice"), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat_format.examples(df)
    got = {r.conv_id: r for r in chat_format.digest(made).collect()}
    for c in [*range(30), None]:
        turns = sorted((k, r or "", t or "") for i, k, r, t in rows if i == c)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
        own = made.where(F.col("conv_id").eqNullSafe(F.lit(c))).orderBy("example").collect()
        assert sum(len(r.text) for r in own) == got[c].formatted_chars
        for r in own:
            back = chat_format.read_turns(r.text)
            assert back == [(a, b) for _, a, b in turns][: len(back)]
    assert len(got) == 31 and chat_format.examples(df.where("false")).count() == 0


def test_op4(spark):
    urls = ["http://www.A.example.com/en/77?x", "https://example.com/en/8#y", "http://x.net/de/1", "http://example.net/de/80", "http://notexample.net/de/8", "ftp://com", "nohost/en/", None, "http://org/es/", "http://Cheap-Pills.example.org/", "http://a://b/c", "http://news.example.org?q=/es/"]
    df = spark.createDataFrame([(i, u, "<p>cheap news pills pills</p>") for i, u in enumerate(urls)] + [(None, "http://com/en/", None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    assert [got[i].rule for i in range(len(urls))] == ["example.com/en/7", "com/en/", "net/de/", "example.net/de/8", "net/de/", None, None, None, "org/es/", None, None, None]
    assert (got[0].host, got[0].path, got[0].verdict) == ("www.a.example.com", "/en/77", "allow")
    assert (got[6].host, got[7].host, got[5].path, got[10].host, got[10].path) == ("", "", "", "a:", "//b/c")
    assert got[9].verdict == "block" and got[11].verdict == "allow" and got[None].rule == "com/en/"
    assert url_filter.judge(df.where("false")).count() == 0


def test_op4_segments():
    """Viterbi against all ways to split."""
    s = url_filter.Segmenter({"cheap": -3.0, "pills": -3.0, "che": -4.0, "ap": -4.0, "p": -5.0, "ill": -2.5, "s": -4.0})
    assert s.split("cheappills") == ["cheap", "pills"]
    assert "".join(s.split("zzzcheapq" * 9)) == "zzzcheapq" * 9
    cost = lambda words: sum(s.words.get(w, s.floor - np.log(10) * len(w)) for w in words)

    def ways(x):
        yield [x]
        for k in range(1, len(x)):
            for rest in ways(x[k:]):
                yield [x[:k], *rest]

    for name in ("cheappills", "pillsche", "apillsx", "qcheapz", "s"):
        assert cost(s.split(name)) == pytest.approx(max(map(cost, ways(name))))


def test_op4_words():
    html = "<html><script>var casino = '</p>';</script><!-- poker --><p>F\u00fcr <b>Caf\u00e9</b> x <style>bingo{}</style>\u5b57 WORDS</p>"
    assert url_filter.visible_words(html) == ["fur", "cafe", "words"]


def test_op4_most_frequent(spark):
    rng = random.Random(2)
    counts = {f"w{i}": rng.randrange(1, 9) for i in range(60)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    for size in (0, 1, 7, 30, 60, 99):
        exp = sorted(counts, key=lambda w: (-counts[w], w))[:size]
        assert url_filter.most_frequent(df, size) == {w: counts[w] for w in exp}


def test_op4_ordinary_words(spark):
    """Names that are ordinary words stay whole, whatever listed word stands in them; words that were never listed are found."""
    text = " ".join(f"{a}{b}{c}" for a in "tnsr" for b in "aeiou" for c in ("th", "nd", "ing", "ment", "eau", "keit", "schen", "ando", "ique", "ough"))  # 200 others, so "es" is one word in 200
    words = url_filter.vocabulary(spark.createDataFrame([(1, "u", f"<p>es the er in {text}</p>")], "page_id long, url string, html string"), url_filter.training_names())
    s = url_filter.Segmenter(words)
    for name in ("essex", "sussex", "therapist", "cryptography", "adulthood"):
        assert s.split(name) == [name]
    assert s.split("freemoviestorrent") == ["free", "movies", "torrent"] and s.split("museumofmodernart") == ["museum", "of", "modern", "art"]
    assert s.split("schoollibrary") == ["school", "library"] and s.split("casinojackpot") == ["casino", "jackpot"]


def brute_judge(rows):
    """(host, path, verdict, score) by plain rules: all ways to split, counts of words instead of buckets."""
    import functools
    import json
    import math

    lower = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x)
    names = url_filter.training_names()
    with open(url_filter.words_path(), encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    ordinary = {}
    for token, i in ids.items():
        if re.fullmatch("\u0120[A-Za-z]+", token):
            ordinary[token[1:].lower()] = max(ordinary.get(token[1:].lower(), 0), 1 / (i + 1))
    text, made = {}, {}
    for _, html in rows:
        for w in re.findall("[a-z]{2,}", re.sub("<[^>]*>", " ", html or "").lower()):
            text[w] = text.get(w, 0) + 1
    for _, ws in names:
        for w in ws:
            made[w] = made.get(w, 0) + 1
    parts = [(a, c, sum(c.values())) for a, c in ((0.7, ordinary), (0.29, text), (0.01, made))]
    log = {w: math.log(sum(a * c.get(w, 0) / n for a, c, n in parts)) for w in {*ordinary, *text, *made}}
    floor = min(log.values()) - 2

    @functools.cache
    def split(name):
        if not name:
            return 0.0, ()
        found = []
        for k in range(1, len(name) + 1):
            w, (rest, after) = name[:k], split(name[k:])
            found.append((log.get(w, floor - math.log(10) * k) + rest, (w, *after)))
        return max(found)

    tokens = lambda host, path: [("h", w) for n in re.findall("[a-z]+", host) for w in split(n)[1]] + [("p", w) for n in re.findall("[a-z]+", path.lower()) for w in split(n)[1]] + [("p", "0")] * len(re.findall("[0-9]+", path))
    urls = []
    for url, _ in rows:
        m = re.match("[^:]*(?::(?!//)[^:]*)*://([^/?#]*)([^?#]*)", url or "")
        urls.append((lower(m[1]), m[2]) if m else ("", ""))
    places = sorted({u for u in urls if u[0]})
    random.Random(4).shuffle(places)
    often = {}
    for host, _ in places:
        for label in set(host.split(".")):
            often[label] = often.get(label, 0) + 1
    first = ({}, {})
    for k, (unwanted, ws) in enumerate(names):
        host, path = places[k % len(places)]
        rarest = min(host.split("."), key=lambda x: (often[x], x))
        for token in [*tokens(".".join(x for x in host.split(".") if x != rarest), ""), *(("h", w) for w in ws), *tokens("", path)]:
            first[unwanted][token] = first[unwanted].get(token, 0) + 1

    def odds(bad, good):
        used, n, m = len({*bad, *good}), sum(bad.values()), sum(good.values())
        return {t: math.log((bad.get(t, 0) + 0.5) / (n + 0.5 * used)) - math.log((good.get(t, 0) + 0.5) / (m + 0.5 * used)) for t in {*bad, *good}}

    one = odds(first[1], first[0])
    found = ({}, {})
    for u in urls:
        own = tokens(*u)
        bad = sum(one.get(t, 0) for t in own) >= 3
        for t in own:
            found[bad][t] = found[bad].get(t, 0) + 1
    weight = min(1.0, sum(first[1].values()) / sum(found[1].values())) if found[1] else 0.0
    both = odds({t: first[1].get(t, 0) + weight * found[1].get(t, 0) for t in {*first[1], *found[1]}}, {t: first[0].get(t, 0) + found[0].get(t, 0) for t in {*first[0], *found[0]}})
    out = []
    for host, path in urls:
        score = sum(both.get(t, 0) for t in tokens(host, path))
        fits = [(len(h) + len(p), kind) for kind, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        out.append((host, path, max(fits)[1] if fits else "block" if score >= 3 else "allow", score))
    return out


def test_op4_brute_force(spark):
    rng = random.Random(21)
    heads, tails = ["casino-win", "tionther", "freebets", "essex", "www.newsmuseum", "m.thther", "schoolpoker", "blog.xyzzyq", "CASINO"], ["example.com", "example.net", "example.org", "com"]
    rows = [(f"http://{rng.choice(heads)}.{rng.choice(tails)}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.randrange(9999)}{rng.choice(['', '?a=1', '#top', '.html'])}", "<p>the casino er es tion</p>" if k % 3 else None) for k in range(150)]
    rows += [(None, None), ("no url", "<p>ther ther</p>"), ("x://", ""), ("http://Ünï.example.com/en/7", None)] * 2
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    for k, (host, path, verdict, score) in enumerate(brute_judge(rows)):
        assert (got[k].host, got[k].path, got[k].verdict) == (host, path, verdict) and got[k].score == pytest.approx(score, abs=1e-6)
    assert {r.verdict for r in got.values() if r.rule is None} == {"allow", "block"}


def test_op4_model(spark):
    """Odds against plain counting; names that were not learnt from, written in one; no word decides alone."""
    hosts = [f"{p}{a}{b}.example.{t}" for p in ("", "www.") for a in ("tion", "thth", "ther") for b in ("her", "on", "ing") for t in ("com", "org")]
    pages = spark.createDataFrame([(i, f"http://{h}/en/{i}", "<p>tion thth ther her on ing the and for with her own words</p>") for i, h in enumerate(hosts)], "page_id long, url string, html string")
    names = url_filter.training_names()
    train = [x for x in names if sum(map(ord, "".join(x[1]))) % 5]
    held = sorted({x for x in names if not sum(map(ord, "".join(x[1]))) % 5 and len(x[1]) > 1})
    words = url_filter.vocabulary(pages, train)
    urls = url_filter.with_parts(pages)
    odds = url_filter.train(urls, words, train)
    s = url_filter.Segmenter(words)
    score = lambda host: odds[url_filter.buckets(*s.tokens(host, "/en/7"))].sum()
    verdicts = [(unwanted, score(f"www.{''.join(w)}.example.com") >= url_filter.THRESHOLD) for unwanted, w in held]
    blocked = [u for u, v in verdicts if v]
    assert sum(blocked) / len(blocked) > 0.95 and sum(blocked) / sum(u for u, _ in verdicts) > 0.9
    assert score("casinomuseumlibrary.example.com") < url_filter.THRESHOLD <= score("casinojackpot.example.com")
    first = url_filter.corpus_counts(urls, words, np.zeros(url_filter.BUCKETS))
    exp = np.zeros(url_filter.BUCKETS)
    for i, h in enumerate(hosts):
        for b in url_filter.buckets(*s.tokens(h, f"/en/{i}")):
            exp[b] += 1
    assert (first[0] == exp).all() and not first[1].any()
    u, w = np.array([3.0, 0, 1, 0]), np.array([1.0, 2, 0, 0])
    assert np.allclose(url_filter.log_odds(u, w), [np.log((3.5 / 5.5) / (1.5 / 4.5)), np.log((0.5 / 5.5) / (2.5 / 4.5)), np.log((1.5 / 5.5) / (0.5 / 4.5)), 0])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_op5(spark, nothing):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = ordinal_classifier.train(docs, labels.where("doc_id % 4 <> 0"))
    assert (np.diff(model.cuts) >= 0).all()
    held = ordinal_classifier.score(docs, model).join(labels.where("doc_id % 4 = 0"), "doc_id").collect()
    good = [r.kept for r in held if r.quality == 1 and r.toxic == 0]
    assert np.mean(good) > 0.9
    rest = [r.kept for r in held if not (r.quality == 1 and r.toxic == 0)]
    assert np.mean(rest) < np.mean(good)
    assert ordinal_classifier.score(nothing, model).count() == 0
    prior = ordinal_classifier.score(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), model).collect()
    assert prior[0].p_good == prior[1].p_good
    assert ordinal_classifier.train(docs, labels.where("false")).weights.sum() == 0


def test_op5_bounded(spark, monkeypatch):
    """Repeated ids are learnt from once, and features beyond the budget are left out."""
    rows = [(i % 20, " ".join(WORDS[: 3 + i % 20])) for i in range(600)] + [(30, " ".join(f"w{k}" for k in range(3000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rated = spark.createDataFrame([(i, i % 3) for i in range(31)], "doc_id long, grade int")
    grades, cells, at = ordinal_classifier.rated_features(df, rated)
    assert len(grades) == 21 and len(at) == 22 and at[-1] == len(cells)
    monkeypatch.setattr(ordinal_classifier, "MAX_BYTES", 2000)
    grades, cells, at = ordinal_classifier.rated_features(df, rated)
    assert 0 < len(grades) < 21 and 4 * len(cells) <= 2000


def test_op5_gradient():
    """The fitted model has a higher likelihood than its neighbours on data whose cells are all telling."""
    rng = np.random.default_rng(3)
    grades = np.repeat([0, 1, 2], 1000)
    rows = [np.array([int(g) if rng.random() < 0.7 else int(rng.integers(3))]) for g in grades]
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    model = ordinal_classifier.fit(grades, np.concatenate(rows), at)

    def likelihood(weights, cuts):
        tail = ordinal_classifier.OrdinalModel(weights, cuts).tail(np.array([weights[r].sum() for r in rows]))
        above = np.concatenate([np.ones((len(rows), 1)), tail, np.zeros((len(rows), 1))], axis=1)
        p = above[np.arange(len(rows)), grades] - above[np.arange(len(rows)), grades + 1]
        return np.log(np.maximum(p, 1e-12)).mean() - ordinal_classifier._DECAY / 2 * (weights**2).sum()

    best = likelihood(model.weights, model.cuts)
    assert model.weights[0] < model.weights[1] < model.weights[2] and best > likelihood(np.zeros_like(model.weights), model.cuts)
    for k in (0, 1, 2):
        for step in (-0.5, 0.5):
            other = model.weights.copy()
            other[k] += step
            assert likelihood(other, model.cuts) < best


def test_op5_against_another_optimiser():
    """The fit against plain gradient ascent over a dense matrix, on the same penalised likelihood."""
    rng = np.random.default_rng(14)
    n, width = 900, 6
    x = rng.random((n, width)) < 0.4
    latent = x @ np.array([2.0, -2.0, 1.5, -1.5, 1.0, 0.0]) + rng.logistic(size=n)
    grades = (latent > -0.5).astype(int) + (latent > 1.0)
    rows = [np.flatnonzero(r) for r in x]
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    model = ordinal_classifier.fit(grades, np.concatenate(rows), at)
    chosen = ordinal_classifier.telling(grades, np.concatenate(rows), at)[:width]
    dense = x[:, chosen].astype(float)
    weights, cuts = np.zeros(dense.shape[1]), np.array([-0.5, 0.5])

    def probability(w, c):
        upto = 1 / (1 + np.exp(-(np.concatenate([[-50.0], c, [50.0]])[None, :] - (dense @ w)[:, None])))
        return upto[np.arange(n), grades + 1] - upto[np.arange(n), grades]

    value = lambda w, c: np.log(np.maximum(probability(w, c), 1e-12)).mean() - ordinal_classifier._DECAY / 2 * (w**2).sum()
    step = 1e-5
    for _ in range(1500):
        both = np.concatenate([weights, cuts])
        grow = np.array([(value(*np.split(both + step * e, [len(weights)])) - value(*np.split(both - step * e, [len(weights)]))) / (2 * step) for e in np.eye(len(both))])
        weights, cuts = weights + 2.0 * grow[: len(weights)], cuts + 2.0 * grow[len(weights) :]
    tails = 1 / (1 + np.exp(-(dense @ weights)[:, None] + cuts[None, :]))
    got = model.tail(np.array([model.weights[r].sum() for r in rows]))
    # Batches leave some noise: the likelihood is within a fifth of a percent of the best one, probabilities within a tenth.
    best, own = value(weights, cuts), value(model.weights[:width][chosen], model.cuts)
    assert chosen.sum() >= 4 and best - 0.002 * abs(best) <= own <= best + 1e-6
    assert np.abs(got - tails).max() < 0.1 and np.abs(got - tails).mean() < 0.02


def test_op5_brute_force_scores(spark):
    """Cells are those of a text's distinct words, one by one, and of their last three bytes; scores are their weights' sums."""
    texts = [t for _, t in make_docs(12)] + ["ends ends Ends! é né", "x" * 5000]
    alone = lambda w: ordinal_classifier.features(next(textkernel.chunks(pa.array([w]))))[0].tolist()

    def cells(text):
        words = {w for w in WORD.findall(text or "")}
        out = {c for w in words for c in alone(w)}
        return sorted(out)

    found = {}
    for c in textkernel.chunks(pa.array([t or "" for t in texts]), 400):
        got, first = ordinal_classifier.features(c)
        for k in range(c.lo, c.hi):
            found[k] = got[first[k - c.lo] : first[k - c.lo + 1]].tolist()
    assert [found[k] for k in range(len(texts))] == [cells(t) for t in texts]
    assert len(alone("abcdef")) == 2 and set(alone("xxdef")) & set(alone("abcdef")) and not set(alone("abcdef")) & set(alone("abcdeg"))
    rng = np.random.default_rng(15)
    model = ordinal_classifier.OrdinalModel(rng.normal(0, 0.3, ordinal_classifier.DIMENSIONS), np.array([-1.0, 0.5]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in ordinal_classifier.score(df, model).collect():
        total = model.weights[cells(texts[r.doc_id])].astype(np.float32).astype(float).sum()
        tails = 1 / (1 + np.exp(model.cuts - total))
        assert r.p_good == pytest.approx(tails[1], abs=1e-6) and r.expected_grade == pytest.approx(tails.sum(), abs=1e-6) and r.kept == (r.p_good >= 0.5)


def test_op5_tails():
    model = ordinal_classifier.OrdinalModel(np.zeros(4), np.array([-1.0, 1.0]))
    tail = model.tail(np.array([0.0, 5.0]))
    assert (tail[:, 0] >= tail[:, 1]).all() and (tail[1] > tail[0]).all()


def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, near):
    label = dict.fromkeys(nodes)
    for n in nodes:
        label[n] = n
    changed = True
    while changed:
        changed = False
        for a, b in near:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


def test_op6(spark, docs, nothing):
    got = {r.doc_id: r for r in simhash.op6_groups(docs).collect()}
    fp = {i: fingerprint(t) for i, t in make_docs()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == fp
    null, ids = max(fp, key=lambda i: i or 0) + 1, {i for i in fp if i is not None}
    fp = {null if i is None else i: x for i, x in fp.items()}
    near = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4]
    exp = components(list(fp), near)
    assert {i: r.component_id for i, r in got.items() if i in ids} == {i: exp[i] for i in ids}
    assert simhash.op6_groups(nothing).count() == 0
    # Fingerprints 0x00 and 0xff are only linked by 0x0f, which has no id.
    fps = spark.createDataFrame([(2, [0xFF]), (1, [0]), (None, [0x0F]), (None, [0x7FFFFFFF00000000])], "doc_id long, fp array<long>")
    bridged = simhash.near_groups(fps, (21, 21, 22), (1, 1, 0), 4).collect()
    assert {(r.fp[0], r.component_id) for r in bridged} == {(0, 1), (0x0F, 1), (0xFF, 1), (0x7FFFFFFF00000000, None)}
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and not {60, 61, 62, 63, 64} & {r.doc_id for r in kept.select("doc_id").collect()}


@pytest.mark.parametrize("hot", [1 << 16, 20])
def test_op6_dense_group(spark, hot):
    """A crowd of close fingerprints gives few links, whose components are those of all pairs."""
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = list({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (2**64 - 1) for b in base for _ in range(80)})
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame([(i, [x]) for i, x in enumerate(signed)], "node long, fp array<long>")
    links = simhash.hamming_links(nodes, (21, 21, 22), (1, 1, 0), 4, hot_rows=hot).collect()
    near = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4]
    assert all((fps[r.a] ^ fps[r.b]).bit_count() <= 4 for r in links) and len(links) < len(near)
    assert components(range(len(fps)), [tuple(r) for r in links]) == components(range(len(fps)), near)


def changed(words, rng, share):
    """A copy in which ``share`` of the words, evenly spaced, are others."""
    step = round(1 / share)
    return " ".join(f"w{rng.randrange(10**6)}" if k % step == step // 2 else w for k, w in enumerate(words))


def jaccard(x, y, width=5):
    a, b = ({tuple(t.lower().split()[k : k + width]) for k in range(max(1, len(t.split()) - width + 1))} for t in (x, y))
    return len(a & b) / len(a | b)


def test_near_copies_found(spark):
    """Every pair of similarity 0.8 or more loses one, also those just above."""
    rng = random.Random(11)
    rows = []
    for i in range(300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, changed(words, rng, 1 / 46))]
    assert all(0.8 <= jaccard(rows[k][1], rows[k + 1][1]) < 0.85 for k in range(0, 600, 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in simhash.drop_near_copies(docs).orderBy("doc_id").collect()] == list(range(0, 600, 2))


def test_fingerprint_links(spark):
    """Links of the stage's fingerprints join what all pairs within four bits do, also of equal ones."""
    rng = random.Random(6)
    fps = [rng.getrandbits(64) for _ in range(40)]
    fps += [fps[k % 40] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for k in range(60)] + fps[:10]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    named = spark.createDataFrame([(k, 9, f) for k, f in enumerate(signed)] + [(900, 0, signed[0])], "node long, n long, fp long")
    links = [tuple(r) for r in simhash.fingerprint_links(named).collect()]
    near = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4]
    assert components(range(len(fps)), links) == components(range(len(fps)), near) and len(near) > 60


def test_near_copies_by_fingerprint(spark, monkeypatch):
    """Texts whose fingerprints are near are joined by them, without bands and without rounds of stars."""
    def never(*_):
        raise AssertionError

    monkeypatch.setattr(simhash, "_met", never)
    monkeypatch.setattr(simhash, "connected_components", never)
    rng = random.Random(14)
    rows = []
    for i in range(30):
        words = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join(words[:-1])), (3 * i + 2, " ".join(words[1:]))]
    got = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i - i % 3 for i, _ in rows}


@pytest.mark.parametrize("hot", [1 << 16, 20])
def test_near_copies_kept_below(spark, hot):
    """Pairs below 0.8 stay apart, and a crowd of near copies gives the groups of all pairs."""
    rng = random.Random(12)
    rows = []
    for i in range(100):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, changed(words, rng, 1 / 34))]
    assert all(0.65 <= jaccard(rows[k][1], rows[k + 1][1]) < 0.8 for k in range(0, 200, 2))
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows += [(1000 + k, " ".join(w if rng.random() > 0.015 else "other" for w in base)) for k in range(80)]
    near = [(i, j) for i, x in rows for j, y in rows if i < j and jaccard(x, y) >= 0.8]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), hot_rows=hot).collect()}
    assert got == components([i for i, _ in rows], near)


def test_odd_sketches():
    """Pairs of similarity 0.8 and more always pass, such of 0.6 hardly ever."""
    rng = np.random.default_rng(9)
    passed = {0.8: 0, 0.6: 0}
    for n in (1, 5, 40, 200, 3000):
        for share in passed:
            for _ in range(200):
                both = max(1, round(n * 2 * share / (1 + share)))
                own = rng.integers(0, 1 << 63, 2 * n, np.uint64)
                x, y = own[:n], np.concatenate([own[:both], own[n : 2 * n - both]])
                j = both / (2 * n - both)
                good = simhash.OddSketches(np.array([n, n]), [simhash.odd_sketch(z).tobytes() for z in (x, y)]).near(np.array([0]), np.array([1]))[0]
                assert good or j < 0.8
                passed[share] += good and n >= 200
    assert passed[0.6] < 20


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == components(sorted({x for e in real for x in e}), real)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_op7(spark, docs, nothing):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_output.tokenizer_path())
    rows = sorted(((-1 if i is None else i), x or "") for i, x in make_docs())
    exp, start = [], 0
    for i, x in rows:
        ids = [*t.encode(x, add_special_tokens=False).ids, 2]
        exp.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_output.digest(spark, token_output.write_tokens(docs, shared_path(spark, "tokens"))).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == sorted(exp)
    assert token_output.digest(spark, token_output.write_tokens(nothing, shared_path(spark, "tokens"))).count() == 0


def test_op7_pieces():
    e = token_output.PieceEncoder(token_output.tokenizer_path())
    rng = random.Random(5)
    parts = ["a", "B", " ", "  ", "\n", "\n\n", "\t", "é", "1", "!", "'s", "\r", "word ", "\xa0", "\u2003", "\x1c", "\x85", "«", "字", "\x00"]
    for special in ([], ["<|endoftext|>"]):
        texts = ["".join(rng.choice(parts + special) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
        exp = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
        got = []
        for c in textkernel.chunks(pa.array(texts), 3000):
            ids, sizes = e.encode(c)
            got += [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
        assert got == exp


def test_op7_other_tokenizer(spark):
    """A tokenizer that cuts and normalises otherwise gives its own ids, and they come back whole."""
    from tokenizers import Tokenizer

    path = token_output.tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = [(i, x or "") for i, x in make_docs() if i is not None and i < 30]
    folder = token_output.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), shared_path(spark, "tokens"), path)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in token_output.read_tokens(spark, folder).collect()}
    assert got == {i: [*t.encode(x, add_special_tokens=False).ids, 2] for i, x in rows}


def test_op7_codes():
    x = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 7], np.uint32)
    for n in range(len(x) + 1):
        assert (token_output.decode_block(*token_output.encode_block(x[:n]), n) == x[:n]).all()


def edit_distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
        p = c
    return p[-1]


def reach(x, y):
    """The edits within which two lines are linked."""
    n = min(len(x), len(y))
    return -1 if n < line_dedup.SHORT_CHARS else 1 if n < line_dedup.MIN_CHARS else 2


def test_op8(spark, docs, nothing):
    rng = random.Random(3)
    lines = {"".join(rng.choice("abé ") for _ in range(rng.randint(24, 32))) for _ in range(30)}
    for x in sorted(lines):
        for _ in range(3):
            y = list(x)
            for _ in range(rng.randint(1, 4)):
                i = rng.randrange(len(y))
                y[i : i + rng.choice([0, 1, 1])] = rng.choice(["", "a", "b"])
            lines.add("".join(y))
    lines = sorted(x for x in lines if x.strip())
    found = line_dedup.lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    text = {(r.a, r.b): r.line for r in found.collect()}
    got = {frozenset((text[r.a, r.b], text[r.c, r.d])): r.distance for r in line_dedup.links(found).collect()}
    exp = {frozenset((x, y)): d for i, x in enumerate(lines) for y in lines[:i] if (d := edit_distance(x, y)) <= reach(x, y)}
    assert exp and got == exp
    out = line_dedup.dedup(docs).collect()
    every = [(x, i, k) for i, t in make_docs() for k, x in enumerate((t or "").split("\n")) if WORD.search(x)]
    assert len(out) == len({x for x, _, _ in every}) and sum(r.copies for r in out) == len(every)
    assert line_dedup.dedup(nothing).count() == 0 == line_dedup.members(nothing).count()


def test_op8_brute_force(spark):
    """n_links, class_id and copies of every place, with variants, ties, repeats, empty and very long lines."""
    rng = random.Random(8)
    base = ["".join(rng.choice("etanirsohd lu") for _ in range(n)) + "x" for n in (7, 8, 12, 22, 23, 24, 25, 60, 200, 3000)]
    pool = []
    for x in base:
        for edits in (0, 1, 1, 2, 2, 3):
            y = list(x)
            for _ in range(edits):
                i = rng.randrange(len(y))
                y[i : i + rng.choice([0, 1, 1])] = rng.choice(["", "e", "q", "é"])
            pool.append("".join(y))
    rows = [(i if i % 11 else None, "\n".join(rng.choice([*pool, "", "  \t"]) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    places = [(i, k, x) for i, t in rows for k, x in enumerate(t.split("\n")) if WORD.search(x)]
    lines = sorted({x for _, _, x in places})
    near = [(x, y) for i, x in enumerate(lines) for y in lines[:i] if edit_distance(x, y) <= reach(x, y)]
    exp = components(lines, near)
    found = line_dedup.lines(spark.createDataFrame(rows, "doc_id long, text string"))
    text = {r.line: (r.a, r.b) for r in found.collect()}
    name = {x: f"{text[x][0] % 2**64:016x}{text[x][1] % 2**64:016x}" for x in lines}
    least = {c: min(name[x] for x in lines if exp[x] == c) for c in set(exp.values())}
    want = [(i, k, name[x], least[exp[x]], sum(x in p for p in near), sum(x == y for _, _, y in places)) for i, k, x in places]
    got = line_dedup.members(spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit(1)).repartition(5))
    assert rows_of(got.select("doc_id", "line_no", "line_id", "class_id", "n_links", "copies")) == sorted(want, key=repr)
    firsts = {c: min((i, k) for i, k, x in places if least[exp[x]] == c and i is not None) for c in {least[exp[x]] for i, _, x in places if i is not None}}
    assert all(r.kept == (r.doc_id is None or (r.doc_id, r.line_no) == firsts[r.class_id]) for r in got.collect())


def test_op8_members(spark):
    """Every place of a line has its class, and documents lose the lines that stand elsewhere before."""
    one, near, two = "a line that is long enough to be linked", "a line that is long enough to be linkt!", "another line, quite different from it"
    rows = [(1, f"{one}\nshort"), (2, f"{two}\n\n{near}"), (3, f"{one}\n{two}\nlast"), (4, None), (None, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.members(docs).collect()
    places = sorted((i or 0, k) for i, t in rows for k, x in enumerate((t or "").split("\n")) if x)
    assert sorted((r.doc_id or 0, r.line_no) for r in got) == places
    at = {(r.doc_id, r.line_no): r for r in got}
    assert len({at[p].class_id for p in [(1, 0), (2, 2), (3, 0), (None, 0)]}) == 1 and at[2, 2].line_id != at[1, 0].line_id
    assert {p for p, r in at.items() if not r.kept} == {(2, 2), (3, 0), (3, 1)}
    exp = {1: f"{one}\nshort", 2: f"{two}\n", 3: "last", 4: None, None: one}
    assert {r.doc_id: r.text for r in line_dedup.without_copies(docs).collect()} == exp


def test_op8_short_lines(spark):
    """Short lines are linked at one edit, also to a line of MIN_CHARS; shorter ones only if equal."""
    rng = random.Random(6)
    base = ["Are is anwh reenen.", "Der eingea erer.", "contact", "abcdefgh", "x" * 23] + ["".join(rng.choice("abcdef") for _ in range(rng.randint(5, 24))) for _ in range(30)]
    lines = list(dict.fromkeys([*base, "Are, is anwh reenen.", "Der, eingea erer.", "x" * 24, *(x[:2] + "z" + x[3:] for x in base), *(x[1:] for x in base), *(x + "yy" for x in base)]))
    found = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    near = [(i, j) for i, x in enumerate(lines) for j, y in enumerate(lines[:i]) if edit_distance(x, y) <= reach(x, y)]
    got = {r.doc_id: r for r in line_dedup.dedup(found).collect()}
    assert all(r.n_links == sum(i in p for p in near) for i, r in got.items())
    exp = components(range(len(lines)), near)
    assert len({(r.class_id, exp[i]) for i, r in got.items()}) == len({r.class_id for r in got.values()}) == len(set(exp.values()))


def test_op9(spark, docs, nothing, monkeypatch):
    least = {}
    rows = [(i, (t or "").split()) for i, t in make_docs()]
    for i, w in rows:
        for k in range(len(w) - 49) if i is not None else ():
            key = tuple(w[k : k + 50])
            least[key] = min(i, least.get(key, i))
    exp = []
    for i, w in rows:
        gone = set()
        for k in range(len(w) - 49) if i is not None else ():
            if least[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        exp.append((i, len(w), len(gone), kept))
    assert rows_of(substring_dedup.without_repeats(docs)) == sorted(exp, key=repr) and any(x[2] for x in exp)
    assert substring_dedup.without_repeats(nothing).count() == 0
    with monkeypatch.context() as m:
        m.setattr(substring_dedup, "MAX_IDS", 0)  # too many to broadcast
        assert rows_of(substring_dedup.without_repeats(docs)) == sorted(exp, key=repr)
    windows = lambda most: sorted((r.doc_id, r.tag, *sorted(set(r.places))) for r in substring_dedup.repeated_windows(docs, max_cells=most).collect())
    assert windows(1 << 28) == windows(1)  # a sketch dealt to tasks


def test_op10(spark, docs, nothing):
    item = "If Maria buys 12 apples for 3 dollars each and gives Maria some of them to her brother how much money does she spend today"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (4, "a completely different question about rivers that nobody ever asked in this corpus"), (5, "What is the capital of France?"), (6, "12 3.5 1,000 17 99 2 3 4 5 6 7 8")], "item_id long, text string")
    swap = lambda **k: re.sub("|".join(k), lambda m: k[m[0]], item)
    cases = {
        1: item,
        2: swap(Maria="Johanna"),
        3: item.replace("12", "99").replace("dollars", "euros"),
        4: item.upper(),
        5: "noise before. " + item + " and after",
        6: item.replace("Maria", "Johanna", 1),  # one name stands for two
        7: "nothing of the kind",
        8: None,
        9: "",
        10: swap(Maria="Mary Ann").replace("12", "two hundred"),  # slots of several words
        11: item.replace("12", "\u0661\u0662"),  # other digits
        12: item.replace("12", "3"),  # two numbers became one
        13: "so, what is the capital of France? she said",
        14: "so, what is the capital of Spain? she said",
        15: "and 12 3.5 1,000 17 99 2 3 4 5 6 7 8 more",
        16: "and 13 3.5 1,001 18 90 2 4 4 5 7 7 8 more",
        17: "too short",
        18: "this is too short to tell",
        19: "x " * 40 + ". " + item[: len(item) * 2 // 3] + " and something else altogether",
        20: item.replace("12", "99") + " . " + "y " * 5 + item.replace("12", "77"),  # two copies, each of its own numbers
    }
    df = spark.createDataFrame([(i, t, 0) for i, t in cases.items()] + [(None, item, 0), (None, "clean text", 0), (1, item, 0)], "doc_id long, text string, item_id int").withColumns({"raw": F.lit(1), "doc": F.lit(2)})
    got = {(r.doc_id, r.item_id): r for r in decontamination.matches(df, bench).collect()}
    exp = {(i, 1) for i in (1, 2, 3, 4, 5, 10, 11, 19, 20, None)} | {(13, 5), (15, 6), (17, 3)}
    assert set(got) == exp
    assert got[1, 1].coverage == got[5, 1].coverage == got[2, 1].coverage == got[10, 1].coverage == 1 and got[1, 1].n_slots == 4
    kept = decontamination.decontaminate(df, bench)
    assert kept.columns == df.columns
    left = {(r.doc_id, r.text) for r in kept.collect()}
    assert left == {(i, t) for i, t in cases.items() if i not in {d for d, _ in exp}} | {(None, "clean text")}
    assert decontamination.matches(nothing, bench).count() == 0 and decontamination.matches(docs, bench).count() == 0
    assert decontamination.matches(df, bench.where("false")).count() == 0


@pytest.mark.parametrize("items", [16, 17, 400])
def test_op10_shared_preamble(spark, items):
    """However many items share a passage, a document that holds it is found for each."""
    preamble = "read the following passage about old stone walls and the seven clever ravens that watch them every day and then answer"
    ends = [f"which bird{chr(97 + k % 26)}{chr(97 + k // 26)} sat there" for k in range(items)]
    bench = spark.createDataFrame([(k, f"{preamble} {e}") for k, e in enumerate(ends)], "item_id long, text string")
    df = spark.createDataFrame([(1, f"before it . {preamble} and nothing else"), (2, f"{preamble} {ends[3]}"), (3, "only old stone walls and the seven clever ravens")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.matches(df, bench).collect()}
    assert got == {(i, k) for i in (1, 2) for k in range(items)}


def test_op10_parts_of_numbers(spark):
    """The part of an item that is numbers and names is found as it stands, other numbers in its place are not."""
    words = "the clerk of the old mill wrote the sums of that week into her long book before"
    tail = " ".join(str(31 + 7 * k) for k in range(9)) + " for Anna 12 13 Bela 15 16 17 18 19"
    other = " ".join(str(50 + 3 * k) for k in range(9)) + " for Carl 22 23 Dora 25 26 27 28 29"
    bench = spark.createDataFrame([(1, f"{words} {tail}")], "item_id long, text string")
    df = spark.createDataFrame([(1, f"{words} {tail}"), (2, f"so {tail}"), (3, f"so {other}"), (4, f"{words} {other}"), (5, words)], "doc_id long, text string")
    assert {r.doc_id for r in decontamination.matches(df, bench).collect()} == {1, 2, 4, 5}


def test_op10_long_runs(spark):
    """Runs of very many numbers, number words or names are one token and need no deep stack; shorter runs end where they did."""
    runs = {"numbers": "1" + ".2" * 20_000, "counted": "one" + " two" * 20_000, "scaled": "5" + " hundred" * 20_000, "names": "so Anna" + " Bela" * 20_000}
    ends = {"twenty one twox": ["twenty one", "twox"], "one twox": ["one", "twox"], "3 hundredx": ["3", "hundredx"], "1.5.x": ["1.5", "x"], "so Anna Bela x": ["so", "Anna Bela", "x"]}
    df = spark.createDataFrame(list(enumerate([*runs.values(), *ends])), "doc_id long, text string")
    got = [r.raw for r in decontamination._tokens(df, "doc_id").orderBy("doc_id").collect()]
    assert [len(x) for x in got[: len(runs)]] == [1, 1, 1, 2] and got[len(runs) :] == list(ends.values())
    item = "the old mill by the river turned all day and all night"
    docs = spark.createDataFrame([(1, f"{runs['numbers']} {item}"), (2, runs["names"])], "doc_id long, text string")
    assert {r.doc_id for r in decontamination.matches(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()} == {1}


def shape(raw):
    """Templates by plain rules, for texts of one sentence without units and number words."""
    return ["#number" if t[0].isdigit() else "#name" if t[0].isupper() and k else t.lower() for k, t in enumerate(raw)]


@pytest.mark.parametrize("most", [1 << 18, 0])
def test_op10_brute_force(spark, monkeypatch, most):
    """Documents with exchanged values, consistently or not, cut pieces and inserted words, against plain search."""
    monkeypatch.setattr(decontamination, "MAX_BROADCAST", most)
    rng = random.Random(17)
    names, plain = ["Anna", "Bela", "Carl", "Dora", "Emil"], [w for w in WORDS if w not in ("seven",)]
    token = lambda: rng.choice(names) if (x := rng.random()) < 0.12 else str(rng.randrange(2, 9)) if x < 0.25 else rng.choice(plain)
    items = [[rng.choice(plain), *(token() for _ in range(rng.randint(14, 30)))] for _ in range(12)]
    items = [[t if k == 0 or not (t[0].isupper() and x[k - 1][0].isupper()) else "the" for k, t in enumerate(x)] for x in items]
    texts = []
    for k in range(150):
        x = list(rng.choice(items))
        kind = k % 5
        if kind in (1, 2):  # one value for another, throughout or at one place
            slots = [t for t in x if t[0].isdigit() or t[0].isupper()]
            for old in dict.fromkeys(slots[:2]):
                new = rng.choice(names) if old[0].isupper() else str(rng.randrange(20, 90))
                places = [i for i, t in enumerate(x) if t == old and i]
                for i in places if kind == 1 else places[:1]:
                    x[i] = new
        if kind == 3:
            i = rng.randrange(len(x))
            x = x[i:] if rng.random() < 0.5 else x[: i + 1]
        if kind == 4:
            x.insert(rng.randrange(1, len(x)), "inserted")
        lead = [rng.choice(plain) for _ in range(rng.randint(1, 4))]
        x = lead + x + [rng.choice(plain) for _ in range(rng.randint(0, 3))]
        texts.append([t if i == 0 or not (t[0].isupper() and x[i - 1][0].isupper()) else "of" for i, t in enumerate(x)])

    def one_to_one(pairs):
        return len({(k, a) for k, a, _ in pairs}) == len({(k, b) for k, _, b in pairs}) == len(pairs)

    def found(doc, item):
        a, b, w = shape(doc), shape(item), decontamination.WINDOW
        good = [i for i in range(len(b) - w + 1) if sum(x[0].islower() for x in item[i : i + w]) >= decontamination.MIN_LITERALS]
        hard = not good
        if hard:
            a, b, good = [t.lower() for t in doc], [t.lower() for t in item], list(range(len(b) - w + 1))
        parts = []
        for shift in range(-len(b), len(a)):
            same = [0 <= shift + j < len(a) and a[shift + j] == b[j] for j in range(len(b))]
            whole = [i for i in range(len(b) - w + 1) if all(same[i : i + w])]
            # A place is told by a window of ordinary words, or one of the very same tokens.
            if not any(i in good or [t.lower() for t in doc[shift + i : shift + i + w]] == [t.lower() for t in item[i : i + w]] for i in whole):
                continue
            pairs = {(b[j], item[j].lower(), doc[shift + j].lower()) for j in range(whole[0], whole[-1] + w) if same[j] and b[j][0] == "#"}
            if one_to_one(pairs):
                parts.append((set(whole), pairs))
        if not parts:
            return False
        n = max(len(x) for x, _ in parts)
        if one_to_one(set().union(*(p for _, p in parts))):
            n = max(n, len(set().union(*(x for x, _ in parts))))
        return n / (len(b) - w + 1) >= decontamination.MIN_COVERAGE

    exp = {(i, j) for i, d in enumerate(texts) for j, x in enumerate(items) if found(d, x)}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(j, " ".join(t)) for j, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.matches(df, bench).collect()}
    assert got == exp and 40 < len(exp) < 150


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        path = shared_path(spark, name)
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
    last = corpus_pipeline.tokens(spark, docs, SF)
    assert last.count() == docs.count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_sql(spark):
    from ratelake.llm.queries import ORACLE_SQL, QUERIES

    duck = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        duck.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    for name, sql in ORACLE_SQL.items():
        cursor = duck.execute(sql)
        names = [d[0] for d in cursor.description]
        out = QUERIES[name](spark, SF)
        assert sorted(out.columns) == sorted(names)
        assert rows_of(out.select(*names)) == sorted(cursor.fetchall(), key=repr)


def test_hash_sample(spark):
    from ratelake.llm.common import hash_sample

    df = spark.range(5000).withColumnRenamed("id", "k")
    for most in (1, 100, 5000, 9000):
        got = {r.k for r in hash_sample(df, "k", most).collect()}
        assert len(got) == min(most, 5000) and got == {r.k for r in hash_sample(df.repartition(5), "k", most).collect()}

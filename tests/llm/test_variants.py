"""Spelling variants, fill-in-middle examples and the Jaccard join against brute force, with their defined edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_edges import CLASHING
from test_llm import WORD, make_docs, rows_of

from ratelake.llm import components, fill_middle, ngram_join, spelling, textkernel

SCHEMA = "doc_id long, text string"


def widened(df, *more):
    return df.withColumns({c: F.lit(f"own {c}") for c in [*CLASHING, *more]}).repartition(5)


# Spelling variants.


def brute_words(rows, typo=97):
    counts = Counter()
    for doc_id, text in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % typo == 0 else run] += 1
    return counts


def brute_variants(counts):
    def near(a, b):
        edits = {a[:i] + a[i + 1 :] for i in range(len(a))}
        return a != b and (b in edits or a in {b[:i] + b[i + 1 :] for i in range(len(b))} or len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1)

    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    by_form, out = {}, []
    for w, n in words.items():
        others = [o for o in words if abs(len(o) - len(w)) < 2 and near(w, o)]
        best = min(others, key=lambda o: (-words[o], o), default=None)
        by_form[w] = (best if best and words[best] >= 2 * n else None, len(others))
    for w, n in words.items():
        root = w
        while by_form[root][0]:
            root = by_form[root][0]
        out.append((w, by_form[w][0], root, n, by_form[w][1], words[by_form[w][0]] if by_form[w][0] else None))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def spelt():
    rng = random.Random(5)
    letters = "abcdeé"
    pool = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(80)]
    pool += [w[:i] + rng.choice(letters) + w[i + rng.randint(0, 1) :] for w in pool for i in (1, 4)] + ["aaaaa", "aaaaaa", "aaaaaaa", "abaaaaa", "Élan×x", "q" * 4000, "q" * 4001]
    rows = [(i, " ".join(rng.choice(pool[: 3 + i * 8]).title() if rng.random() < 0.2 else rng.choice(pool) for _ in range(200))) for i in range(40)]
    return [*rows, (41, None), (42, ""), (43, "12 34"), (None, "aaaaa aaaaa aaaaa"), *[(44, "Straßenbahn straßenbahn " + "q" * 4000 + " " + "q" * 4001)] * 3, (-7, "aaaaa")]


def test_op11_brute_force(spark, spelt):
    df = spark.createDataFrame(spelt, SCHEMA).repartition(3)
    wanted = brute_variants(brute_words(spelt))
    counts = spelling.vocabulary(df)
    got = rows_of(spelling.variants(counts))
    assert got == wanted and len(got) > 100 and any(r[2] != (r[1] or r[0]) for r in got)
    assert rows_of(spelling.variants(spelling.vocabulary(widened(df)))) == wanted
    assert rows_of(spelling.variants(spelling.vocabulary(df.limit(0)))) == []
    pairs = rows_of(spelling.near_pairs(counts))
    assert rows_of(spelling.near_pairs(counts, block_words=2)) == pairs  # hot keys in blocks


def test_op11_all_runs_lose_a_letter(spark):
    rows = [(i, "wonder wanderer wonders") for i in range(9)]
    got = {r["word"]: r["n"] for r in spelling.counted(spark.createDataFrame(rows, SCHEMA), typo=1).collect()}
    assert got == dict(brute_words(rows, typo=1))


def test_merged_skips_nothing():
    rng = random.Random(2)
    for _ in range(200):
        lists = [sorted(rng.sample(range(30), rng.randint(1, 20))) for _ in range(rng.randint(1, 9))]
        for least in range(1, 10):
            counts = Counter(x for one in lists for x in one)
            assert list(spelling.merged(lists, least)) == sorted(x for x, n in counts.items() if n >= least)


def test_index_keys_meet():
    """Words one edit apart share a key, whatever the counts of grams."""
    rng = random.Random(3)
    for _ in range(3000):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(5, 12)))
        at, new = rng.randrange(len(a)), rng.choice("abc")
        b = rng.choice([a[:at] + new + a[at + 1 :], a[:at] + new + a[at:]])
        count = {g: rng.randint(1, 4) for g in {*spelling.grams(a), *spelling.grams(b)}}
        x, y = (set(spelling.index_keys(spelling.grams(w), count)) for w in (a, b))
        shifted = y | {(g, p - 1) for g, p in y} if len(b) > len(a) else y
        assert a == b or x & shifted


# Fill-in-middle.


def brute_example(doc_id, text, seed=1):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    lo, hi = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_op12_brute_force(spark):
    rng = random.Random(6)
    odd = ["é", "中", "\U0001f600", "<", "P", ">", " ", "\n", "a", "Bc", "9", "́", "<P", "S>", "\x00"]
    rows = [(i, "".join(rng.choice(odd) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [*make_docs(20), (901, "has <S> inside"), (902, "x" * 300_000), (903, "é" * 150_000), (903, "é" * 150_000), (-7, "below zero"), (None, None), (None, "no id")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    made = fill_middle.fill_in_middle(df)
    got = rows_of(made.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", "output"))
    assert got == sorted([(i, *brute_example(i, t)) for i, t in rows], key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert made.where(fill_middle.restored() != F.coalesce("row.text", F.lit(""))).count() == 0
    wide = fill_middle.fill_in_middle(widened(df, "output", "form", "prefix_chars"))
    assert rows_of(wide.select("row.doc_id", "n", wide["form"], "prefix_chars", "middle_chars", "output")) == got and wide.select("row.*").columns[:2] == ["doc_id", "text"]
    assert fill_middle.fill_in_middle(df.limit(0)).count() == 0


def test_op12_runs():
    texts = ["ab1é中cd", "", "é", "a" * 9, "-" * 9]
    (c,) = textkernel.chunks(pa.array(texts))
    runs = fill_middle.Runs(c)
    assert runs.n.tolist() == [5, 0, 1, 1, 9]
    for k, text in enumerate(texts):
        units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
        for cut in range(len(units) + 1 if units else 0):
            byte, char = runs.cut(np.array([k]), np.array([cut]))
            head = "".join(units[:cut])
            assert (byte[0] - c.offsets[k], char[0]) == (len(head.encode()), len(head))


# Jaccard join.


def shingle_set(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def brute_groups(rows, percent=90):
    sets = [shingle_set(t) for _, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    known = [(i, s) for (i, _), s in zip(rows, sets) if i is not None and s]
    for k, (i, a) in enumerate(known):
        for j, b in known[:k]:
            if 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return sorted([(i, len(s), None if i is None else root(i) if s else i) for (i, _), s in zip(rows, sets)], key=repr)


@pytest.fixture(scope="module")
def near_rows():
    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(300)]
    rows, at = [], 0
    for size in (9, 10, 12, 14, 20, 30, 60, 200, 700, 3000):
        base = [rng.choice(vocab) for _ in range(size)]
        for _ in range(6):
            own, edits = list(base), rng.randint(0, max(1, size // 25))
            for _ in range(edits):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            rows.append((at, " ".join(own) if rng.random() < 0.7 else "\n".join(own).upper()))
            at += rng.randint(1, 4)
        rows.append((at, " ".join(base + base[: size // 12])))
        at += 1
    rows += [(at + 5, rows[0][1]), (at + 6, None), (at + 7, " "), (at + 8, "one"), (at + 9, "One"), (at + 10, "one two"), (at + 11, "one two one two"), (None, rows[30][1]), (None, None)]
    rows += [(at + 12, rows[3][1]), (at + 12, rows[40][1]), (at + 12, rows[40][1])]  # one document of two texts
    return rows + [(10_000 + i, t) for i, t in make_docs(30) if i is not None]


def test_op13_brute_force(spark, near_rows):
    df = spark.createDataFrame(near_rows, SCHEMA).repartition(3)
    wanted = brute_groups(near_rows)
    got = rows_of(ngram_join.jaccard_groups(df))
    assert got == wanted and sum(r[0] is not None and r[0] != r[2] for r in got) > 20
    assert rows_of(ngram_join.jaccard_groups(widened(df))) == wanted
    assert rows_of(ngram_join.jaccard_groups(df.limit(0))) == []


@pytest.mark.parametrize("links", [components.MAX_LINKS, 0])
def test_op13_blocks(spark, near_rows, monkeypatch, links):
    """Clusters of many blocks, some of whose sets are similar and some not, joined up in one task and by rounds."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 3)
    monkeypatch.setattr(components, "MAX_LINKS", links)
    rng = random.Random(9)
    base = [f"v{k}" for k in range(120)]
    crowd = []
    for k in range(40):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(120)] = f"x{rng.randrange(40)}"
        crowd.append((20_000 + k, " ".join(own)))
    rows = crowd + near_rows[:40]
    got = rows_of(ngram_join.jaccard_groups(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    assert got == brute_groups(rows)


@pytest.mark.parametrize("percent", [60, 80, 95])
def test_op13_signatures_meet(percent):
    """Every two sets at the threshold share a signature, for all sizes and any differences."""
    rng = np.random.default_rng(percent)
    bands = ngram_join.Bands.upto(2000, percent)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        both = rng.integers(0, 1 << 64, n, np.uint64)
        most = n * (100 - percent) // percent  # elements beside the shared ones at the threshold
        extra = int(rng.integers(0, most + 1))
        own, other = rng.integers(0, 1 << 64, extra, np.uint64), rng.integers(0, 1 << 64, most - extra, np.uint64)
        found = []
        for one in (np.concatenate([both, own]), np.concatenate([both, other])):
            first, band = np.array([0, len(one)]), int(np.searchsorted(bands.last, len(one)))
            found.append({int(k) for b in (band, band + 1) for k in ngram_join.signatures(np.sort(one), first, np.array([b]), bands)[0]})
        assert most == 0 or found[0] & found[1]


def test_op13_counts():
    rng = np.random.default_rng(1)
    for m in (2, 3, 40):
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(m)]
        got = ngram_join.shared_counts(sets)
        assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(m) for j in range(m) if i != j)

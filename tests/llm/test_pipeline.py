"""Each stage of the pipeline against a brute-force version, on a fixture with every kind of trouble."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm import WORD, WORDS, base_stats, components, jaccard, rows_of, sainte_lague

import corpus_pipeline
from ratelake.llm import mixing, quality_rules, textkernel, token_output

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, __hash long, row string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with copies, near copies, benchmark passages, nulls, empties, ties, repeated rows and one very long text."""
    rng = random.Random(33)
    word = lambda: rng.choice(WORDS) + rng.choice(["", "", "", ",", "é"]) + str(rng.randrange(40))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [" ".join(rng.choice(WORDS) + rng.choice("abc") for _ in range(20)) for _ in range(4)]
    rows = [(i, text(rng.randint(60, 200)).replace(" w", "\nw")) for i in range(70)]
    rows += [(80 + i, rows[i][1]) for i in range(6)]
    rows += [(90 + i, " ".join("changed" if k == 30 else w for k, w in enumerate(rows[i][1].split(" ")))) for i in range(10)]
    rows += [(100 + i, f"{text(60)} {items[i % 4]} {text(30)}") for i in range(8)]
    rows += [(110, None), (111, ""), (112, "short"), (113, "again and again " * 60), (114, text(30_000)), (None, text(90)), (None, None), (3, rows[3][1]), (5, text(80))]
    table = [(i, t, "en", None if k % 9 == 4 else f"s{k % 4}", 0, k, "x") for k, (i, t) in enumerate(rows)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(table, COLUMNS).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 > 0), int(i % 11 == 3)) for i in range(70)] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)) + [(9, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def key(r):
    return (r["doc_id"], r["text"], r["source"], r["__hash"], r["row"])


def everything(df):
    return sorted((key(r) for r in df.collect()), key=repr)


def ngrams(text):
    (c,) = textkernel.chunks(pa.array([text or ""]), 1 << 30)
    start, end, _ = c.words()
    h = textkernel.span_hashes(c.prefix(), start, end, textkernel.POWERS)
    return [int(g) % quality_rules.BUCKETS for g in (*h, *(textkernel.combine(h[:-1], h[1:]) if len(h) else ()))]


def test_quality(spark, folder, docs):
    rows = docs.collect()
    sample = {r.doc_id: r.trusted for r in quality_rules.trusted_sample(spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    counts = np.zeros((2, quality_rules.BUCKETS))
    for r in rows:
        for g in ngrams(r.text):
            counts[0, g] += 1
            counts[1, g] += sample.get(r.doc_id, False)
    share = (counts + 1) / (counts.sum(axis=1, keepdims=True) + quality_rules.BUCKETS)
    ratio = np.log(share[1] / share[0])
    llr = lambda t: float(np.mean(ratio[ngrams(t)])) if ngrams(t) else 0.0
    held = {}
    for r in rows:
        if sample.get(r.doc_id) is False and len(WORD.findall(r.text or "")) >= 50:
            held[r.doc_id] = min(llr(r.text), held.get(r.doc_id, 9.0))
    scores = np.array(sorted(held.values()))
    threshold = 2 * np.quantile(scores, quality_rules.LOW) - np.median(scores)
    stats = {r.text: base_stats(r.text) if r.text is None or len(r.text) < 20_000 else None for r in rows}
    good = lambda t: llr(t) >= threshold and (stats[t] is None or stats[t][0] >= 50 and 2 * stats[t][4] <= stats[t][0])
    assert all(abs(llr(r.text) - threshold) > 1e-5 for r in rows)
    got = everything(corpus_pipeline.quality(spark, docs, folder))
    assert got == sorted((key(r) for r in rows if good(r.text)), key=repr) and 0 < len(got) < len(rows)


def test_near_dedup(spark, folder, docs):
    rows = docs.where("doc_id <> 114 or doc_id is null").collect()
    texts = {}
    for r in rows:
        texts.setdefault(r.doc_id, set()).add(r.text or "")
    ids = [i for i in texts if i is not None]
    full = lambda t: bool(WORD.search(t))
    near = [(i, j) for i in ids for j in ids if i < j and any(full(x) and full(y) and jaccard(x, y) >= 0.8 for x in texts[i] for y in texts[j])]
    # Texts without a word are equal sets of shingles, and so one group.
    near += [(110, 111)]
    group = components(ids, near)
    got = everything(corpus_pipeline.near_dedup(spark, docs.where("doc_id <> 114 or doc_id is null"), folder))
    assert got == sorted((key(r) for r in rows if r.doc_id is None or group[r.doc_id] == r.doc_id), key=repr) and len(near) > 10


def test_decontamination(spark, folder, docs):
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r.text]
    rows = docs.collect()
    holds = lambda t: any(f" {x} " in f" {t or ''} " for x in items)
    got = everything(corpus_pipeline.clean_of_benchmark(spark, docs, folder))
    assert got == sorted((key(r) for r in rows if not holds(r.text)), key=repr) and len(got) == len(rows) - 8


def test_mixing(spark, folder, docs):
    """Quotas by counting seat after seat; a shard's run of blocks by walking over its words."""
    rows = docs.select("*", mixing.order_hash(mixing.SEED).alias("place"), F.pmod(F.xxhash64(F.lit(mixing.SEED), F.col("source").isNull(), F.coalesce("source", F.lit("")), F.lit(0).cast("long")), F.lit(1 << 40)).alias("_"), F.array(*[F.xxhash64(mixing.order_hash(mixing.SEED), F.lit(k).cast("long")) for k in range(9)]).alias("later")).collect()
    size = lambda r: len(WORD.findall(r.text or ""))
    sources = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(size(r) for r in rows if r.source == s) for s in sources}
    total, weight = sum(sizes.values()), {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, open_, rest = {}, set(sources), float(total)
    while full := {s for s in open_ if weight[s] * rest / sum(weight[x] for x in open_) > 3 * sizes[s]}:
        target |= {s: 3.0 * sizes[s] for s in full}
        open_, rest = open_ - full, total - sum(target.values())
    level = rest / sum(weight[x] for x in open_)
    target |= {s: weight[s] * level for s in open_}
    block = max(1, min(mixing.BLOCK, total // mixing.MIN_BLOCKS))
    quota = dict(zip(sources, sainte_lague([target[s] for s in sources], total // block)))
    starts = {r.source: r.first for r in docs.select("source").distinct().select("source", F.xxhash64(F.lit(mixing.SEED), F.col("source").isNull(), F.coalesce("source", F.lit("")), F.lit(0).cast("long")).alias("first")).collect()}
    exp = []
    for s in sources:
        # Equal rows, all but one of each, have places of their own.
        own, met = [], {}
        for r in (r for r in rows if r.source == s):
            n = met[r.doc_id, r.place] = met.get((r.doc_id, r.place), -1) + 1
            own.append((r.later[n] if n else r.place, r.doc_id or -1, size(r), r))
        own = [x[-1] for x in sorted(own, key=lambda x: x[:3])]
        words = [k for k, r in enumerate(own) for _ in range(size(r))]
        taken, n = [0] * len(own), len(words)
        first = starts[s] % max(-(-n // block), 1) * block
        for w in range(min(quota[s] * block, 3 * n)):
            taken[words[(first + w) % n if first + w < n else (first + w - n) % n]] += 1
        # Equal rows share out what is taken of them all.
        shares = {}
        for k, r in enumerate(own):
            shares.setdefault((r.doc_id, r.place), []).append((taken[k], r))
        for parts in shares.values():
            exp += [key(parts[0][1])] * int(sum(n for n, _ in parts) / max(size(parts[0][1]), 1) + 0.5)
    assert everything(corpus_pipeline.mixed(spark, docs, folder)) == sorted(exp, key=repr) and exp


def test_tokens(spark, folder, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_output.tokenizer_path())
    got = corpus_pipeline.tokens(spark, docs, folder).orderBy("start").collect()
    ids = {i: [] for i in {r.doc_id for r in docs.collect()}}
    for r in docs.collect():
        x = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        ids[r.doc_id].append((len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    assert [-1 if r.doc_id is None else r.doc_id for r in got] == sorted(-1 if r.doc_id is None else r.doc_id for r in got)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == sorted(((i, *x) for i, xs in ids.items() for x in xs), key=repr)


def test_empty(spark, folder, docs):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), folder)
        assert out.count() == 0 and (name == "tokens" or out.columns == docs.columns)


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0 and rows_of(out.select("doc_id")) and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]

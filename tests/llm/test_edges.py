"""Every operator with extra columns of clashing names, very long texts, ties, repeated rows, nulls and empty tables."""

import random

import pytest
from pyspark.sql import functions as F
from test_llm import WORDS, make_docs, rows_of

from ratelake.llm import chat_format, decontamination, line_dedup, mixing, ordinal_classifier, quality_rules, simhash, substring_dedup, token_output, url_filter
from ratelake.llm.common import shared_path

CLASHING = "key line n raw soft hard doc item node fp hash rank size shard target llr kept at tag a b c signature copies class_id places place trusted bucket id bands sketch odd component one two words host path score verdict rule example turns loss chars part row ids __hash __id __source __null __found __gone __raw __tag __same_doc_id".split()


def cases(spark, labels, bench, model):
    return {
        "quality_rules": lambda d: quality_rules.score(d, labels),
        "mixing": lambda d: mixing.mix(d).drop("__hash"),
        "apply_mix": lambda d: mixing.apply_mix(d).select("doc_id", "text", "source"),
        "classifier": lambda d: ordinal_classifier.score(d, model),
        "simhash": simhash.op6_groups,
        "near_groups": simhash.similar_groups,
        "near_dedup": lambda d: simhash.drop_near_copies(d).select("doc_id", "text", "source"),
        "tokens": lambda d: token_output.digest(spark, token_output.write_tokens(d, shared_path(spark, "tokens"))),
        "line_dedup": line_dedup.members,
        "without_copies": lambda d: line_dedup.without_copies(d).select("doc_id", "text", "source"),
        "substring_dedup": substring_dedup.without_repeats,
        "decontamination": lambda d: decontamination.matches(d, bench),
        "decontaminate": lambda d: decontamination.decontaminate(d, bench).select("doc_id", "text", "source"),
    }


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(40)
    rows = [(i, t, f"s{k % 3}" if k % 7 else None) for k, (i, t) in enumerate(make_docs(20, seed=3))]
    long = " ".join(rng.choice(WORDS) + str(rng.randrange(500)) for _ in range(60_000))
    rows += [(500, long, "s0"), (501, long.replace(" w", "\nw"), "s0"), (502, "x" * 300_000, None), (500, long, "s0")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)


@pytest.fixture(scope="module")
def made(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 5 > 0), int(i % 7 == 0)) for i in range(20)] + [(None, 1, 0)] * 2, "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, " ".join(WORDS)), (None, " ".join(WORDS[::-1])), (2, None), (3, ""), (1, " ".join(WORDS))], "item_id long, text string")
    return cases(spark, labels, bench, ordinal_classifier.train(docs, labels))


@pytest.mark.parametrize("name", ["quality_rules", "mixing", "apply_mix", "classifier", "simhash", "near_groups", "near_dedup", "tokens", "line_dedup", "without_copies", "substring_dedup", "decontamination", "decontaminate"])
def test_extra_columns(docs, made, name):
    plain = rows_of(made[name](docs))
    wide = docs.withColumns({c: F.lit(f"own {c}") for c in CLASHING})
    assert rows_of(made[name](wide.repartition(5))) == plain
    assert rows_of(made[name](docs.limit(0))) == []
    assert plain or name == "decontamination"


def test_url_columns(spark):
    rows = [(i, f"http://{h}.example.com/en/{i}", "<p>casino news</p>" if i % 3 else None) for i, h in enumerate(["casino-jackpot", "news", "a" * 50_000, "", "casinojackpot"] * 3)] + [(None, None, None), (3, "x://", "")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    plain = rows_of(url_filter.judge(df))
    assert rows_of(url_filter.judge(df.withColumns({c: F.lit("x") for c in CLASHING}).repartition(4))) == plain and len(plain) == len(rows)


def test_chat_columns(spark):
    rows = [(c, k, "assistant" if k % 2 else "user", "y" * 200_000 if (c, k) == (1, 1) else f"t{k}") for c in range(4) for k in range(6)] + [(2, 3, "user", "tie"), (2, 3, "user", "tie"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    plain = rows_of(chat_format.digest(chat_format.examples(df)))
    assert rows_of(chat_format.digest(chat_format.examples(df.withColumns({c: F.lit("x") for c in CLASHING}).repartition(4)))) == plain and len(plain) == 5

"""The catalogue of queries over the test tables, each with the SQL that gives the same rows.

Stand-ins: events are ratings (clip = user and type), documents with labels are rated clips, part is a score map,
lineitem has clip pairs, embeddings are waveforms or frames.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelake.functions import columns as C
from ratelake.operators import arrays, checkpoint_table, existence, feature_store, heads, metrics, normalize, ranking, runs, sampling, scoring
from ratelake.operators.shared import ensure_checkpoint_dir
from ratelake.plans import inference, manifest
from ratelake.sources import readers, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NAN = "'nan'::double"


def query(sql: str | None = None) -> Callable:
    """Registers a query under its name, with its SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def _clips(spark: SparkSession, sf: str) -> DataFrame:
    """(path, acr, source, system) of the events' clips."""
    rated = t(spark, sf, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("acr"))
    path = C.join_path("event_type", F.col("user_id").cast("string"))
    return rated.select(path.alias("path"), "acr", F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("system"))


_CLIPS = "select event_type || '/' || user_id::varchar as path, avg(value) as acr, event_type as source, user_id::varchar as system from events group by user_id, event_type"


def _split_sql(rows: str, group: str, key: str) -> str:
    return f"""select * exclude (rn, n), case when rn <= n * 9 // 10 then 'train' else 'dev' end as split from (
        select *, row_number() over (partition by {group} order by md5('42' || {key}::varchar), {key}) as rn, count(*) over (partition by {group}) as n from ({rows}))"""


def _norm_sql(rows: str, group: str, value: str, fit_where: str = "split = 'train'") -> str:
    return f"""select r.* exclude ({value}), case when s.m is null then {value} else ({value} - m) / sd end as {value} from ({rows}) r left join (
        select {group} as g, avg({value}) as m, case when stddev_pop({value}) <= 1e-12 * abs(avg({value})) then 1.0::double else stddev_pop({value}) end as sd
        from ({rows}) where {fit_where} group by {group}) s on r.{group} = s.g"""


@query(f"select path, round(acr, 6) as acr, null::double as ccr, 'en' as language, system, split, source from ({_norm_sql(_split_sql(_CLIPS, 'source', 'path'), 'source', 'acr')})")
def manifest_build(spark, sf):
    clips = _clips(spark, sf)
    made = clips.select("path", "acr", F.lit(None).cast("double").alias("ccr"), F.lit("en").alias("language"), "system", F.lit("train").alias("split"), "source")
    return manifest.build({"events": made}, per_source_z=True).withColumn("acr", r6("acr"))


@query("select user_id, event_type, round(avg(value), 6) as acr from events group by all")
def utt_mean(spark, sf):
    return t(spark, sf, "events").groupBy("user_id", "event_type").agg(r6(F.avg("value")).alias("acr"))


@query("select doc_id, source from documents semi join labels using (doc_id)")
def exists_semi(spark, sf):
    return existence.existing(t(spark, sf, "documents").select("doc_id", "source"), t(spark, sf, "labels"), "doc_id")


@query("select doc_id, source from documents anti join labels using (doc_id)")
def missing_anti(spark, sf):
    return existence.missing(t(spark, sf, "documents").select("doc_id", "source"), t(spark, sf, "labels"), "doc_id")


@query("select source, count(*) filter (l.doc_id is not null) as n_kept, count(*) filter (l.doc_id is null) as n_missing from documents d left join (select distinct doc_id from labels) l using (doc_id) group by source")
def missing_count(spark, sf):
    return existence.kept_and_missing(t(spark, sf, "documents").select("doc_id", "source"), t(spark, sf, "labels"), "doc_id", "source")


@query("select p_partkey, p_brand from part where starts_with(p_brand, 'Brand#1') or starts_with(p_brand, 'Brand#2')")
def prefix_filter(spark, sf):
    b = F.col("p_brand")
    return t(spark, sf, "part").where(b.startswith("Brand#1") | b.startswith("Brand#2")).select("p_partkey", "p_brand")


_PROJECTED = "select source || '/' || doc_id::varchar as path, quality::double as acr, null::double as ccr, lang as language, string_split(source, '-')[1] as system, 'train' as split, source from documents join labels using (doc_id)"


def _projected(spark, sf):
    rows = t(spark, sf, "documents").select("doc_id", "source", "lang").join(t(spark, sf, "labels"), "doc_id")
    made = rows.select(C.join_path("source", F.col("doc_id").cast("string")).alias("path"), F.col("quality").cast("double").alias("acr"), F.col("lang").alias("language"), C.first_token(F.col("source"), "-").alias("system"), F.lit("train").alias("split"), "source")
    return manifest.as_manifest(made)


@query(_PROJECTED)
def canonical_project(spark, sf):
    return _projected(spark, sf)


@query("select page_id, string_split(url, '/')[-1] as base, regexp_replace(string_split(url, '/')[-1], '(.)\\.[^.]*$', '\\1') as stem from pages")
def basename_stem(spark, sf):
    return t(spark, sf, "pages").select("page_id", C.base_name(F.col("url")).alias("base"), C.stem(F.col("url")).alias("stem"))


@query("select doc_id, md5(source || '/' || doc_id::varchar) || '.npy' as cache_key from documents")
def content_key(spark, sf):
    return t(spark, sf, "documents").select("doc_id", C.content_key(C.join_path("source", F.col("doc_id").cast("string"))).alias("cache_key"))


@query("select doc_id, source from (select *, row_number() over (partition by source order by md5('42' || doc_id::varchar), doc_id) as rn from documents) where rn <= 25")
def cap_per_source(spark, sf):
    return sampling.cap(t(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 25)


_ORDERS = "select o_orderkey, o_orderpriority, o_totalprice from orders"


def _orders_split(spark, sf):
    return sampling.split(t(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderpriority", "o_orderkey")


@query(f"select o_orderkey, o_orderpriority, split from ({_split_sql(_ORDERS, 'o_orderpriority', 'o_orderkey')})")
def split_90_10(spark, sf):
    return _orders_split(spark, sf).select("o_orderkey", "o_orderpriority", "split")


@query(f"select o_orderpriority, split, count(*) as n from ({_split_sql(_ORDERS, 'o_orderpriority', 'o_orderkey')}) group by all")
def split_counts(spark, sf):
    return _orders_split(spark, sf).groupBy("o_orderpriority", "split").agg(F.count("*").alias("n"))


@query(f"select o_orderkey, o_orderpriority, round(o_totalprice, 6) as z, split from ({_norm_sql(_split_sql(_ORDERS, 'o_orderpriority', 'o_orderkey'), 'o_orderpriority', 'o_totalprice')})")
def znorm_train_fit(spark, sf):
    out = normalize.normalized(_orders_split(spark, sf), "o_orderpriority", "o_totalprice")
    return out.select("o_orderkey", "o_orderpriority", r6("o_totalprice").alias("z"), "split")


_UNSEEN = "split = 'train' and o_orderpriority <> '1-URGENT'"


@query(f"select o_orderkey, o_orderpriority, round(o_totalprice, 6) as z, split from ({_norm_sql(_split_sql(_ORDERS, 'o_orderpriority', 'o_orderkey'), 'o_orderpriority', 'o_totalprice', _UNSEEN)})")
def znorm_unseen_source(spark, sf):
    out = normalize.normalized(_orders_split(spark, sf), "o_orderpriority", "o_totalprice", _UNSEEN)
    return out.select("o_orderkey", "o_orderpriority", r6("o_totalprice").alias("z"), "split")


@query("select doc_id, quality::double as acr, null::varchar as source from labels union all select doc_id, null::double, source from documents")
def union_sources(spark, sf):
    a = t(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("acr"))
    return a.unionByName(t(spark, sf, "documents").select("doc_id", "source"), allowMissingColumns=True)


@query("select k as path, min(i) as input from (select l_partkey as k, 0 as i from lineitem union all select p_partkey, 1 from part) group by k")
def dedupe_first(spark, sf):
    return sampling.dedupe_first([t(spark, sf, "lineitem").select(F.col("l_partkey").alias("path")), t(spark, sf, "part").select(F.col("p_partkey").alias("path"))], "path")


@query("select path, md5(path) || '.npy' as cache_key from (select source || '/' || doc_id::varchar as path, doc_id from documents) where doc_id % 3 <> 0")
def resume_skip(spark, sf):
    rows = t(spark, sf, "documents").select(C.join_path("source", F.col("doc_id").cast("string")).alias("path"), "doc_id")
    store = rows.where("doc_id % 3 = 0").select(C.content_key(F.col("path")).alias("cache_key"))
    return existence.still_to_do(rows.select("path"), store).select("path", "cache_key")


@query("select count(*) as n_different, count(*) = 0 as equal from ((select doc_id from documents except select doc_id from labels) union all (select doc_id from labels except select doc_id from documents))")
def path_set_equal(spark, sf):
    return sampling.same_set(t(spark, sf, "documents").select("doc_id"), t(spark, sf, "labels").select("doc_id"))


@query("select source, count(*) as n from documents group by source")
def value_counts(spark, sf):
    return t(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))


_RATED = "select doc_id, source, n_chars / 1000.0::double as pred, quality::double as target, (row_number() over (order by doc_id) - 1) // 16 as batch_id from labels join documents using (doc_id)"


def _rated(spark, sf):
    rows = t(spark, sf, "labels").join(t(spark, sf, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    return sampling.with_batches(rows.select("doc_id", "source", (F.col("n_chars") / 1000.0).alias("pred"), F.col("quality").cast("double").alias("target")), "doc_id", 16)


@query(f"select doc_id, batch_id, source, dense_rank() over (partition by batch_id order by source) - 1 as source_id from ({_RATED})")
def dense_source_id(spark, sf):
    return sampling.dense_ids(_rated(spark, sf), "source", "batch_id").select("doc_id", "batch_id", "source", "source_id")


@query("select doc_id, (row_number() over (order by doc_id) - 1) // 16 as batch_id from labels")
def batch_assign(spark, sf):
    return sampling.with_batches(t(spark, sf, "labels").select("doc_id"), "doc_id", 16)


#: One walk of the permutation of positions, for a grid of ``across`` columns and ``down`` rows.
_WALK = """list_reduce([[{x} % across, {x} // across], [0], [1], [2], [3], [4], [5]],
    lambda s, r: [s[2], (s[1] + ('0x' || substr(md5('7/' || epoch::varchar || ':' || r[1]::varchar || ':' || s[2]::varchar), 1, 8))::bigint) % case r[1] % 2 when 0 then across else down end])"""
_SHUFFLED = f"""with recursive g as (select count(*) as n, floor(sqrt(count(*) - 1))::bigint + 1 as across from labels),
    p as (select doc_id, epoch, row_number() over (partition by epoch order by doc_id) - 1 as place, n, across, (n + across - 1) // across as down from labels, g, range(3) e(epoch)),
    w as (select doc_id, epoch, n, across, down, {_WALK.format(x="place")} as s from p
        union all select doc_id, epoch, n, across, down, {_WALK.format(x="(s[1] + s[2] * across)")} from w where s[1] + s[2] * across >= n)
    select doc_id, epoch::integer as epoch, (s[1] + s[2] * across) // 16 as batch_id, (s[1] + s[2] * across) % 16 as slot from w where s[1] + s[2] * across < n"""


@query(_SHUFFLED)
def shuffled_batches(spark, sf):
    """Three epochs of batches of 16, each in another order."""
    return sampling.shuffled_batches(t(spark, sf, "labels").select("doc_id"), "doc_id", 16, range(3), seed=7)


_LINES = "select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem"


@query("select l_orderkey, l_linenumber, l_suppkey, l_partkey, p_retailprice as score from lineitem join part on l_partkey = p_partkey")
def score_lookup(spark, sf):
    rows = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    return scoring.lookup(rows, t(spark, sf, "part"), "l_partkey", "p_partkey", "p_retailprice", "score")


_PAIRS = f"select x.*, a.p_retailprice - b.p_retailprice as diff from ({_LINES}) x join part a on a.p_partkey = l_partkey join part b on b.p_partkey = (l_partkey * 7 + l_linenumber) % (select count(*) from part)"


def _pairs(spark, sf):
    part = t(spark, sf, "part")
    n = part.agg(F.count("*").alias("n_parts"))
    rows = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(F.broadcast(n))
    rows = rows.withColumn("other", (F.col("l_partkey") * 7 + F.col("l_linenumber")) % F.col("n_parts")).drop("n_parts")
    return scoring.pair_difference(rows, part, "l_partkey", "other", "p_partkey", "p_retailprice").drop("other")


@query(f"select * replace (round(diff, 6) as diff) from ({_PAIRS})")
def pair_difference(spark, sf):
    return _pairs(spark, sf).withColumn("diff", r6("diff"))


@query("select p_partkey, least(5.0::double, greatest(1.0::double, p_retailprice / 300.0::double)) as acr from part")
def clamp_acr(spark, sf):
    rows = t(spark, sf, "part").select("p_partkey", (F.col("p_retailprice") / 300.0).alias("acr"))
    return scoring.clamped(rows, "acr", *C.ACR_RANGE)


@query(f"select * replace (round(least(3.0::double, greatest(-3.0::double, diff)), 6) as diff) from ({_PAIRS})")
def clamp_ccr(spark, sf):
    return scoring.clamped(_pairs(spark, sf), "diff", *C.CCR_RANGE).withColumn("diff", r6("diff"))


@query("select p_partkey, round(1.0::double + (p_retailprice - mn) / (mx - mn) * 4.0::double, 6) as acr from part, (select min(p_retailprice) as mn, max(p_retailprice) as mx from part)")
def rescale_acr(spark, sf):
    rows = t(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("acr"))
    return scoring.rescaled(rows, "acr", *C.ACR_RANGE).withColumn("acr", r6("acr"))


@query("select p_partkey, p_brand, case when mx = mn then 1.0::double else round(1.0::double + (v - mn) / (mx - mn) * 4.0::double, 6) end as acr from (select *, min(v) over (partition by p_brand) as mn, max(v) over (partition by p_brand) as mx from (select p_partkey, p_brand, case when p_brand = 'Brand#11' then 7.0::double else p_retailprice end as v from part))")
def rescale_constant(spark, sf):
    rows = t(spark, sf, "part").select("p_partkey", "p_brand", F.when(F.col("p_brand") == "Brand#11", 7.0).otherwise(F.col("p_retailprice")).alias("acr"))
    return scoring.rescaled(rows, "acr", *C.ACR_RANGE, group=["p_brand"]).withColumn("acr", r6("acr"))


@query(f"select 'acr-' || p_partkey::varchar as sample_id, round(least(5.0::double, greatest(1.0::double, p_retailprice / 300.0::double)), 6) as pred_score from part union all select 'ccr-' || l_orderkey::varchar || '-' || l_linenumber::varchar, round(least(3.0::double, greatest(-3.0::double, diff)), 6) from ({_PAIRS})")
def stack_predictions(spark, sf):
    acr = clamp_acr(spark, sf).select(F.concat(F.lit("acr-"), F.col("p_partkey").cast("string")).alias("sample_id"), r6("acr").alias("pred_score"))
    ccr = clamp_ccr(spark, sf).select(F.concat_ws("-", F.lit("ccr"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("sample_id"), F.col("diff").alias("pred_score"))
    return scoring.stacked(acr, ccr)


@query("select l_returnflag, round(avg(power(l_quantity - l_discount * 100, 2)), 6) as mse from lineitem group by l_returnflag")
def mse_by_group(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_returnflag").agg(r6(F.avg(F.pow(F.col("l_quantity") - F.col("l_discount") * 100, 2))).alias("mse"))


def _corr_sql(x: str, y: str) -> str:
    return f"case when count(*) < 2 or var_pop({x}) * var_pop({y}) = 0 then {NAN} else round(covar_pop({x}, {y}) / sqrt(var_pop({x}) * var_pop({y})), 6) end"


@query(f"select l_returnflag, {_corr_sql('l_quantity', 'l_extendedprice')} as lcc from lineitem group by l_returnflag")
def pearson_by_group(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_returnflag").agg(r6(metrics.pearson("l_quantity", "l_extendedprice")).alias("lcc"))


def _metrics_sql(rows: str, group: str, p: str, q: str) -> str:
    rank = lambda c: f"rank() over (partition by {group} order by {c}) + (count(*) over (partition by {group}, {c}) - 1) / 2.0::double"
    return f"""select {group}, count(*) as n, {_corr_sql('rp', 'rq')} as srcc, {_corr_sql(p, q)} as lcc, case when count(*) < 2 then {NAN} else round(avg(power({p} - {q}, 2)), 6) end as mse
        from (select *, {rank(p)} as rp, {rank(q)} as rq from ({rows}) where {p} is not null and {q} is not null) group by {group}"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: r6(c) for c in ("srcc", "lcc", "mse")})


@query(_metrics_sql("select event_type, value, user_id::double as user_id from events", "event_type", "value", "user_id"))
def spearman_by_group(spark, sf):
    return _rounded(metrics.compute(t(spark, sf, "events").select("event_type", "value", "user_id"), ["event_type"], "value", "user_id"))


@query(_metrics_sql("select l_returnflag, case when l_orderkey % 7 = 0 then null else l_quantity end as p, case when l_partkey % 11 = 0 then null else l_extendedprice / 1000.0::double end as q from lineitem", "l_returnflag", "p", "q"))
def metrics_nan_pairs(spark, sf):
    rows = t(spark, sf, "lineitem").select("l_returnflag", F.when(F.col("l_orderkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity")).alias("p"), F.when(F.col("l_partkey") % 11 != 0, F.col("l_extendedprice") / 1000.0).alias("q"))
    return _rounded(metrics.compute(rows, ["l_returnflag"], "p", "q"))


@query(_metrics_sql("select s_suppkey, s_acctbal as p, s_nationkey::double as q from supplier", "s_suppkey", "p", "q"))
def metrics_small_n(spark, sf):
    return _rounded(metrics.compute(t(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("p"), F.col("s_nationkey").alias("q")), ["s_suppkey"], "p", "q"))


@query("select event_type, count(*) as n, count(*) filter (event_id % 10 = 0) as n_missing, round(stddev_pop(value) filter (event_id % 10 <> 0), 6) as std, min(value) filter (event_id % 10 <> 0) as least, max(value) filter (event_id % 10 <> 0) as most from events group by event_type")
def degeneracy_profile(spark, sf):
    rows = t(spark, sf, "events").withColumn("value", F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    return metrics.profile(rows, ["event_type"], "value").withColumn("std", r6("std"))


@query(f"select round(avg(m), 6) as epoch_loss, count(*) as n_batches from (select batch_id, avg(power(pred - target, 2)) as m from ({_RATED}) group by batch_id)")
def batch_mean_of_means(spark, sf):
    rows = _rated(spark, sf).withColumn("loss", F.pow(F.col("pred") - F.col("target"), 2))
    return metrics.mean_of_batch_means(rows, "batch_id", "loss").withColumn("epoch_loss", r6("epoch_loss"))


def _rank_sql(source: bool) -> str:
    same = "and a.source = b.source" if source else ""
    return f"""select batch_id, coalesce(n_pairs, 0) as n_pairs, round(coalesce(rank_loss, 0.0::double), 6) as rank_loss from (select distinct batch_id from ({_RATED})) left join (
        select a.batch_id, count(*) as n_pairs, avg(greatest(0.0::double, -sign(a.target - b.target) * (a.pred - b.pred))) as rank_loss
        from ({_RATED}) a join ({_RATED}) b on a.batch_id = b.batch_id {same} and a.doc_id < b.doc_id and a.target <> b.target group by a.batch_id) using (batch_id)"""


@query(_rank_sql(True))
def pair_rank_source(spark, sf):
    return ranking.pair_rank(_rated(spark, sf), "batch_id", "doc_id", "pred", "target", "source").withColumn("rank_loss", r6("rank_loss"))


@query(_rank_sql(False))
def pair_rank_all(spark, sf):
    return ranking.pair_rank(_rated(spark, sf), "batch_id", "doc_id", "pred", "target").withColumn("rank_loss", r6("rank_loss"))


@query(f"select batch_id, round(mse + 0.5::double * s.rank_loss + 0.25::double * a.rank_loss, 5) as total_loss from (select batch_id, avg(power(pred - target, 2)) as mse from ({_RATED}) group by batch_id) join ({_rank_sql(True)}) s using (batch_id) join ({_rank_sql(False)}) a using (batch_id)")
def mos_loss(spark, sf):
    out = ranking.rating_loss(_rated(spark, sf), "batch_id", "doc_id", ("pred", "target"), ("pred", "target"), "source", alpha=0.5, weight=0.25)
    return out.withColumn("total_loss", F.round("total_loss", 5))


def _history(spark, sf):
    daily = t(spark, sf, "events").groupBy(F.col("event_type").alias("run"), F.dayofmonth("ts").cast("long").alias("epoch"))
    return daily.agg(r6(metrics.pearson("value", "user_id")).alias("dev")).withColumn("dev", C.missing_as_null(F.col("dev")))


_HISTORY = f"select event_type as run, day(ts)::bigint as epoch, nullif({_corr_sql('value', 'user_id')}, {NAN}) as dev from events group by all"
_PROGRESS = f"""select *, epoch - coalesce(max(case when improved then epoch end) over (partition by run order by epoch), min(epoch) over (partition by run order by epoch) - 1) as no_improve from (
    select *, coalesce(dev > greatest(-1.0::double, coalesce(max(dev) over (partition by run order by epoch rows between unbounded preceding and 1 preceding), -1.0::double)), false) as improved from ({_HISTORY}))"""


def _stopped_sql(patience: int) -> str:
    return f"select * from (select *, min(case when no_improve >= {patience} then epoch end) over (partition by run) as stop from ({_PROGRESS})) where stop is null or epoch <= stop"


@query(f"select run, epoch, round(least(0.5::double, epoch * 0.05::double), 6) as weight from ({_HISTORY})")
def ramp_schedule(spark, sf):
    return _history(spark, sf).select("run", "epoch", r6(C.ramp(F.col("epoch"), 0.5, 10)).alias("weight"))


@query(f"select run, epoch, round(0.001::double * power(0.95::double, epoch - 1), 9) as rate, 'epoch_' || lpad(epoch::varchar, 3, '0') as name from ({_HISTORY})")
def lr_decay(spark, sf):
    return _history(spark, sf).select("run", "epoch", F.round(C.decayed_rate(F.col("epoch"), 0.001, 0.95), 9).alias("rate"), C.epoch_name(F.col("epoch")).alias("name"))


@query(f"select run, max(epoch) filter (improved) as best_epoch, max(dev) filter (improved) as best_dev from ({_PROGRESS}) group by run")
def best_epoch(spark, sf):
    return runs.best_epoch(_history(spark, sf))


@query(f"select run, epoch, dev, improved, no_improve from ({_stopped_sql(3)})")
def early_stop(spark, sf):
    return runs.stopped(_history(spark, sf), 3).select("run", "epoch", "dev", "improved", "no_improve")


@query(f"""select run, kind, epoch, 'epoch_' || lpad(epoch::varchar, 3, '0') as name from (
    select run, 'last' as kind, max(epoch) as epoch from ({_stopped_sql(5)}) group by run union all
    select run, 'best', coalesce(max(epoch) filter (improved), max(epoch)) from ({_stopped_sql(5)}) group by run union all
    select run, 'periodic', epoch from ({_stopped_sql(5)}) where epoch % 2 = 0)""")
def checkpoint_set(spark, sf):
    return runs.checkpoints(_history(spark, sf), patience=5, every=2)


@query(f"select run, epoch, dev from ({_HISTORY}) where dev is not null qualify row_number() over (partition by run order by dev desc, epoch) = 1")
def run_compare(spark, sf):
    return runs.compare(_history(spark, sf))


_EMB = "select vec_id, i, x::double as x from (select vec_id, unnest(embedding) as x, unnest(range(len(embedding))) as i from embeddings)"


def _long(df: DataFrame, value: Column) -> DataFrame:
    return df.select("vec_id", F.posexplode(value).alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), r6(F.col("x").cast("double")).alias("x"))


@query(f"select vec_id, i, round(case when p > 0 then x / p else x end, 6) as x from (select *, max(abs(x)) over (partition by vec_id) as p from ({_EMB}))")
def peak_normalize(spark, sf):
    return _long(t(spark, sf, "embeddings"), arrays.peak_normalized(F.col("embedding").cast("array<double>")))


def _pad_sql(n: int) -> str:
    return f"select vec_id, {n} as n, i, round(coalesce(list_extract(embedding, (i + 1)::int), 0.0::float)::double, 6) as x from embeddings, range({n}) r(i)"


@query(f"{_pad_sql(100)} union all {_pad_sql(32)}")
def pad_or_clip(spark, sf):
    e = t(spark, sf, "embeddings")
    parts = [_long(e, arrays.pad_or_clip(F.col("embedding"), n)).select("vec_id", F.lit(n).alias("n"), "i", "x") for n in (100, 32)]
    return parts[0].unionByName(parts[1])


@query(f"select vec_id, round(sum(w * x) / sum(w), 6) as x, round(sum(w * i) / sum(w), 6) as at from (select *, exp(x - max(x) over (partition by vec_id)) as w from ({_EMB})) group by vec_id")
def attn_pool(spark, sf):
    frames = t(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("at", "x")).withColumn("x", F.col("x").cast("double")).withColumn("score", F.col("x"))
    return arrays.attention_pool(frames, "vec_id", "score", ["x", "at"]).select("vec_id", r6("x").alias("x"), r6("at").alias("at"))


@query(f"""with b as (select vec_id, i // 16 as f, list(x order by i) as v from ({_EMB}) group by all),
    w as (select *, exp(v[1] - max(v[1]) over (partition by vec_id)) as e from b)
    select vec_id, i, round(sum(e * v[i + 1]) / sum(e), 6) as x from w, range(16) r(i) group by vec_id, i""")
def attn_pool_blocks(spark, sf):
    """Four frames of 16 values, read as two blocks of two; a frame's first value is its score."""
    x = F.col("embedding").cast("array<double>")
    block = lambda k: F.struct(F.array(F.get(x, F.lit(32 * k)), F.get(x, F.lit(32 * k + 16))).alias("scores"), F.slice(x, 32 * k + 1, 32).alias("frames"))
    blocks = t(spark, sf, "embeddings").select("vec_id", F.explode(F.array(block(0), block(1))).alias("b")).select("vec_id", "b.*")
    pooled = arrays.attention_pool_blocks(blocks, "vec_id", "scores", "frames")
    return pooled.select("vec_id", F.posexplode("pooled").alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), r6("x").alias("x"))


@query(f"select vec_id, round(sum(x * ((i % 7)::double - 3.0::double) / 10.0::double) + 3.0::double, 6) as acr from ({_EMB}) group by vec_id")
def linear_head(spark, sf):
    return t(spark, sf, "embeddings").select("vec_id", r6(arrays.head(F.col("embedding"), [(i % 7 - 3) / 10 for i in range(64)], 3.0)).alias("acr"))


@query(f"select vec_id, i, round((x - m) / sqrt(v + 1e-5::double), 6) as x from (select *, avg(x) over (partition by vec_id) as m, var_pop(x) over (partition by vec_id) as v from ({_EMB}))")
def layer_norm(spark, sf):
    return _long(t(spark, sf, "embeddings"), arrays.layer_norm(F.col("embedding")))


@query(f"""with v as (select vec_id, i, case when i % 5 = 3 then null else x end as x from ({_EMB}))
    select vec_id, count(x) as n, round(sum(x), 6) as total from v group by vec_id""")
def valid_values(spark, sf):
    """What is left of a vector with missing values, some null and some not a number."""
    gaps = F.transform(F.col("embedding").cast("array<double>"), lambda x, i: F.when(i % 5 != 3, x).when(i % 2 == 0, F.lit(float("nan"))))
    rows = t(spark, sf, "embeddings").select("vec_id", arrays.without_missing(gaps).alias("x"))
    return rows.select("vec_id", F.size("x").cast("long").alias("n"), r6(arrays.total(F.col("x"))).alias("total"))


@query(f"""with f as (select vec_id, i // 16 as f, list(x order by i) as x from ({_EMB}) group by all),
    m as (select vec_id, list(x order by i) as y from (select vec_id, i % 4 as i, avg(x) as x from ({_EMB}) group by all) group by vec_id)
    select vec_id, f, o, round(case o when 0 then list_sum(list_transform(list_concat(x, y), lambda v, k: v * (k % 3 - 1))) + 0.5 else list_sum(list_transform(list_concat(x, y), lambda v, k: v * k / 10.0)) end, 6) as x
    from f join m using (vec_id), range(2) r(o)""")
def dense_layer(spark, sf):
    """Frames of 16 values, each with the clip's vector of four behind it, through a layer with two outputs."""
    x = F.col("embedding").cast("array<double>")
    frames = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda f: F.slice(x, f * 16 + 1, F.lit(16)))
    vector = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: arrays.total(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda j: F.get(x, j * 4 + k))) / 16)
    whole = t(spark, sf, "embeddings").select("vec_id", F.posexplode(arrays.with_repeated(frames, vector)).alias("f", "v"))
    # A list's places count from one in the SQL.
    weights = [[float((k + 1) % 3 - 1) for k in range(20)], [(k + 1) / 10 for k in range(20)]]
    out = whole.select("vec_id", "f", F.posexplode(arrays.affine(F.col("v"), weights, [0.5, 0.0])).alias("o", "x"))
    return out.select("vec_id", F.col("f").cast("long").alias("f"), F.col("o").cast("long").alias("o"), r6("x").alias("x"))


@query("select 'clip' || vec_id::varchar as sample_id, md5('sound of ' || vec_id::varchar) as sound from embeddings")
def clips_kept_once(spark, sf):
    """Undecoded clips of a table with embedded audio, kept as files' bytes; a second run finds them there."""
    table, kept = _scratch(spark, "embedded"), _scratch(spark, "clips")
    audio = F.struct(F.encode(F.concat(F.lit("sound of "), F.col("vec_id").cast("string")), "UTF-8").alias("bytes"), F.lit(None).cast("string").alias("path"))
    t(spark, sf, "embeddings").select(F.concat(F.lit("clip"), F.col("vec_id").cast("string")).alias("sample_id"), audio.alias("audio")).write.parquet(table)
    clips = readers.embedded_audio(spark, table)
    writers.save_clips(clips.where("sample_id < 'clip5'"), kept)
    for _ in range(2):
        writers.save_clips(clips, kept)
    return spark.read.parquet(kept).select("sample_id", F.md5("content").alias("sound"))


@query("select p_brand || '.' || p_partkey::varchar as param, p_retailprice as value from part where not starts_with(p_brand, 'Brand#1')")
def trainable_state(spark, sf):
    """Parameters worth saving; those of one maker stand for the frozen encoder's."""
    parameters = t(spark, sf, "part").select(F.concat_ws(".", "p_brand", F.col("p_partkey").cast("string")).alias("param"), F.col("p_retailprice").alias("value"))
    return heads.trainable(parameters, frozen="Brand#1")


@query("select c_custkey, case c_mktsegment when 'BUILDING' then 384 when 'MACHINERY' then 512 else 1024 end as size from customer")
def default_lookup(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", C.default_lookup(F.col("c_mktsegment"), {"BUILDING": 384, "MACHINERY": 512}, C.DEFAULT_ENCODER_SIZE).alias("size"))


@query("select vec_id, layer from (select vec_id, vec_id % 3 as layer, (vec_id // 3)::varchar as path from embeddings) qualify layer = max(layer) over (partition by path)")
def last_layer(spark, sf):
    rows = t(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 3).alias("layer"), F.expr("cast(vec_id div 3 as string)").alias("path"))
    return arrays.layer_of(rows, -1).select("vec_id", "layer")


@query("select distinct path from (select l_partkey as path from lineitem union all select l_suppkey from lineitem)")
def pair_paths(spark, sf):
    return scoring.paths_of_pairs(t(spark, sf, "lineitem"), "l_partkey", "l_suppkey")


_HALF_STEP = "case when abs(x) < 6.103515625e-05 then 5.9604644775390625e-08 else power(2.0::double, floor(log2(abs(x))) - 10) end"


@query(f"select vec_id, i, round(case when x = 0 then x else round_even(x / ({_HALF_STEP}), 0) * ({_HALF_STEP}) end, 6) as x from ({_EMB})")
def half_round_trip(spark, sf):
    from ratelake.operators.signal import half_round_trip as half

    return _long(t(spark, sf, "embeddings"), half("embedding"))


_LOUDNESS = f"""
with s as (select vec_id, list_concat(list_transform(range(4096), lambda z: 0.0::double), flatten(list_transform(range(64), lambda z: list_transform(embedding, lambda y: power(y::double, 2))))) as sq from embeddings),
f as (select vec_id, k, list_sum(sq[greatest(k * 512 - 1024, 0) + 1 : least(k * 512 + 1024, 8192)]) / 2048 as m from s, range(17) r(k)),
l as (select vec_id, k, 10 * log10(greatest(m, 1e-20)) > 10 * log10(greatest(max(m) over (partition by vec_id), 1e-20)) - 30 as loud from f)
select vec_id, (least(8192, (max(k) + 1) * 512) - min(k) * 512)::integer as n from l where loud group by vec_id"""


@query(_LOUDNESS)
def edge_trim(spark, sf):
    from ratelake.operators.signal import trimmed

    return t(spark, sf, "embeddings").select("vec_id", F.size(trimmed(F.concat(F.array_repeat(F.lit(0.0).cast("float"), 4096), F.flatten(F.array_repeat(F.col("embedding"), 64))))).alias("n"))


# 64 samples, reflected by 16 at either end, in 5 frames of 32; 17 frequencies, 6 triangles between 8 borders.
_MEL = """
with p as (select vec_id, list_concat(list_reverse(embedding[2:17]), embedding, list_reverse(embedding[48:63])) as x from embeddings),
w as (select vec_id, f, j, x[f * 16 + j + 1]::double * (0.5 - 0.5 * cos(2 * pi() * j / 32)) as v from p, range(5) a(f), range(32) b(j)),
d as (select vec_id, f, k, power(sum(v * cos(2 * pi() * j * k / 32)), 2) + power(sum(v * sin(2 * pi() * j * k / 32)), 2) as e from w, range(17) c(k) group by all),
b as (select m, 700 * (power(10, (2595 * log10(1 + 8000 / 700.0::double)) * m / 7 / 2595) - 1) as hz from range(8) r(m)),
t as (select lo.m as m, k, greatest(0, least((k * 500 - lo.hz) / (mid.hz - lo.hz), (hi.hz - k * 500) / (hi.hz - mid.hz))) as h from b lo join b mid on mid.m = lo.m + 1 join b hi on hi.m = lo.m + 2, range(17) c(k))
select vec_id, m * 5 + f as i, round(10 * log10(greatest(sum(e * h), 1e-10)), 6) as x from d join t using (k) group by vec_id, m, f"""


@query(_MEL)
def mel_db(spark, sf):
    from ratelake.operators.signal import mel_db_flat

    mel = t(spark, sf, "embeddings").select("vec_id", F.posexplode(mel_db_flat(n_fft=32, hop=16, n_mels=6)("embedding")).alias("i", "x"))
    return mel.select("vec_id", F.col("i").cast("long").alias("i"), r6("x").alias("x"))


_WEIGHTS = heads.make_weights(16, 8)


def _forward_sql(w: heads.Weights, width: int, frames: int, n: int, digits: int = 6) -> str:
    """The forward pass over lists, its recurrence written out step by step."""
    names = ("adapter_w", "adapter_b", "norm_gain", "norm_bias", "pool_w", "acr_w", "ccr_w", *(f"{d}_{k}" for d in ("forward", "backward") for k in "xhb"))
    given = ", ".join(f"{w[k].tolist()}::double{'[]' * w[k].ndim} as {k}" for k in names)
    sql = f"""with w as (select {given}),
    a as (select vec_id, list_transform(range({frames}), lambda f: list_transform(adapter_w, lambda r, i: list_dot_product(r, embedding[f * {width} + 1 : f * {width} + {width}]::double[]) + adapter_b[i])) as y from embeddings, w),
    x as (select vec_id, list_transform(y, lambda v: list_transform(v, lambda u, i: (u - list_avg(v)) / sqrt(list_var_pop(v) + 1e-5) * norm_gain[i] + norm_bias[i])) as x from a, w)"""
    for d, order in (("forward", range(1, frames + 1)), ("backward", range(frames, 0, -1))):
        before = f"(select vec_id, x, list_transform(range({n}), lambda j: 0.0::double) as h, list_transform(range({n}), lambda j: 0.0::double) as c from x)"
        for t in order:
            sql += f""",
    {d}z{t} as (select vec_id, x, c, list_transform({d}_x, lambda r, i: list_dot_product(r, x[{t}]) + list_dot_product({d}_h[i], h) + {d}_b[i]) as z from {before}, w),
    {d}c{t} as (select vec_id, x, z, list_transform(range(1, {n + 1}), lambda j: c[j] / (1 + exp(-z[{n} + j])) + tanh(z[{2 * n} + j]) / (1 + exp(-z[j]))) as c from {d}z{t}),
    {d}h{t} as (select vec_id, x, c, list_transform(range(1, {n + 1}), lambda j: tanh(c[j]) / (1 + exp(-z[{3 * n} + j]))) as h from {d}c{t})"""
            before = f"{d}h{t}"
    parts = " union all ".join(f"select a.vec_id, list_concat(a.h, b.h) as h from forwardh{t} a join backwardh{t} b using (vec_id)" for t in range(1, frames + 1))
    heads_ = ", ".join(f"round(sum(e * list_dot_product(h, {k}_w)) / sum(e) + {w[f'{k}_b'][0]}::double, {digits}) as {k}" for k in ("acr", "ccr"))
    return f"{sql} select vec_id::varchar as path, {heads_} from (select vec_id, h, exp(list_dot_product(h, pool_w)) as e, acr_w, ccr_w from ({parts}), w) group by vec_id"


@query(_forward_sql(_WEIGHTS, 16, 4, 8))
def model_forward(spark, sf):
    clips = t(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("path"), F.col("embedding").alias("features"))
    return heads.score_clips(clips, _WEIGHTS, 16).select("path", r6("acr").alias("acr"), r6("ccr").alias("ccr"))


_CHECKPOINTS = {"first": _WEIGHTS, "second": heads.make_weights(16, 8, seed=1)}
_SCORED = " union all ".join(f"select '{name}' as checkpoint, path, acr from ({_forward_sql(w, 16, 4, 8, 12)})" for name, w in _CHECKPOINTS.items())


@query(f"""with s as materialized ({_SCORED})
    select checkpoint, 'r' || path as sample_id, round(least(5.0::double, greatest(1.0::double, acr)), 5) as pred_score from s
    union all select a.checkpoint, 'p' || a.path, round(least(3.0::double, greatest(-3.0::double, a.acr - b.acr)), 5) from s a join s b on a.checkpoint = b.checkpoint and b.path = (a.path::bigint // 2)::varchar""")
def predict_checkpoints(spark, sf):
    """Rated and compared clips by two checkpoints, from one scan of the features."""
    clips = t(spark, sf, "embeddings")
    path = F.col("vec_id").cast("string")
    store = clips.select(C.content_key(path).alias("cache_key"), F.col("embedding").alias("features"))
    rated = clips.select(F.concat(F.lit("r"), path).alias("sample_id"), path.alias("path"))
    compared = clips.select(F.concat(F.lit("p"), path).alias("sample_id"), path.alias("path_a"), F.expr("cast(vec_id div 2 as string)").alias("path_b"))
    out = inference.predict(rated, compared, store, heads.weights_table(spark, _CHECKPOINTS), 16)
    return out.withColumn("pred_score", F.round("pred_score", 5))


@query("select 'emb/' || vec_id::varchar as path, (vec_id % 5)::float as acr, case when vec_id % 2 = 0 then 0.5::float end as ccr, 'unknown' as source, len(embedding) as n_feats, round(embedding[1]::double, 6) as first, 1 as n_wave from embeddings")
def cached_or_not(spark, sf):
    """Items whose features are stored: one kind of features, and a placeholder for the waveform, so that no clip is opened."""
    path = C.join_path(F.lit("emb"), F.col("vec_id").cast("string"))
    rows = t(spark, sf, "embeddings")
    made = rows.select(path.alias("path"), (F.col("vec_id") % 5).alias("acr"), F.when(F.col("vec_id") % 2 == 0, 0.5).otherwise(F.lit(float("nan"))).alias("ccr"))
    store = rows.select(C.content_key(path).alias("cache_key"), F.col("embedding").alias("features"))
    items = inference.items(made, store, load_waveform=False)
    return items.select("path", "acr", "ccr", "source", F.size("encoder_feats").alias("n_feats"), r6(F.get("encoder_feats", F.lit(0)).cast("double")).alias("first"), F.size("waveform").alias("n_wave"))


@query("select 'emb/' || vec_id::varchar as path, len(embedding) as n, round(embedding[1]::double, 6) as first from embeddings")
def store_round_trip(spark, sf):
    """Features written by three appends, one of them run twice and one left without its commit, and read by path."""
    path = C.join_path(F.lit("emb"), F.col("vec_id").cast("string")).alias("path")
    rows = t(spark, sf, "embeddings").select(path, F.col("embedding").alias("features"), "vec_id")
    store = feature_store.FeatureStore(spark, _scratch(spark, "store"), feature_store.store_schema(), buckets=16)
    store.append("even", rows.where("vec_id % 2 = 0"))
    store.write_part(rows.where("vec_id % 4 = 1"))  # its job dies here
    for _ in range(2):
        store.append("odd", rows.where("vec_id % 2 = 1"))
    left = existence.still_to_do(rows.select("path"), store.read())
    found = existence.read_features(rows.select("path"), store.read()).join(left, "path", "left_anti")
    return found.select("path", F.size("features").alias("n"), r6(F.get("features", F.lit(0)).cast("double")).alias("first"))


_WANTED = ("click", "purchase", "absent")


@query(f"select path, source from ({_CLIPS}) where source in {_WANTED}")
def source_gate(spark, sf):
    """Sources that are both asked for and there."""
    return _clips(spark, sf).select("path", "source").where(F.col("source").isin(*_WANTED))


@query("select count(*) as n, count(distinct event_type) as n_types from events")
def nonempty_required(spark, sf):
    rows = sampling.required(t(spark, sf, "events"), "events")
    return rows.agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("n_types"))


@query("select doc_id, p_partkey from (select doc_id, row_number() over (order by doc_id) as k from labels) join (select p_partkey, row_number() over (order by p_partkey) as k from part) using (k)")
def position_zip(spark, sf):
    return sampling.zipped(t(spark, sf, "labels").select("doc_id"), t(spark, sf, "part").select("p_partkey"), "doc_id", "p_partkey")


@query(f"select run, max(epoch) + 1 as next_epoch, arg_max(best, epoch) as best_dev from (select *, greatest(-1.0::double, coalesce(max(dev) over (partition by run order by epoch), -1.0::double)) as best from ({_HISTORY})) where epoch % 5 = 0 group by run")
def resume_point(spark, sf):
    """Where each run goes on after its last periodic checkpoint."""
    return runs.resume_point(runs.with_progress(_history(spark, sf)).where("epoch % 5 = 0"))


@query("select 's' || doc_id::varchar as sample_id, '/dev/acr/s' || doc_id::varchar || '.flac' as path from labels")
def dev_rated(spark, sf):
    return manifest.dev_acr(t(spark, sf, "labels").select(F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("sample_id")), "/dev/acr")


@query("select 's' || doc_id::varchar as sample_id, '/dev/ccr/s' || doc_id::varchar || '_a.flac' as path_a, '/dev/ccr/s' || doc_id::varchar || '_b.flac' as path_b from labels")
def dev_compared(spark, sf):
    return manifest.dev_ccr(t(spark, sf, "labels").select(F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("sample_id")), "/dev/ccr")


@query("select count(*) = 0 as equal from (select distinct r_name from region where r_name not in ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'))")
def literal_set(spark, sf):
    same = sampling.is_set(t(spark, sf, "region"), "r_name", ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))
    return spark.range(1).select(F.lit(same).alias("equal"))


@query(f"select *, count(*) over (partition by batch_id) as n_in_batch from (select path, (row_number() over (order by path) - 1) // 16 as batch_id, round(acr, 6) as acr from ({_CLIPS}))")
def batched_predictions(spark, sf):
    """Predictions batch by batch, in order, the last batch short; collecting them is a union of rows."""
    batched = sampling.with_batches(_clips(spark, sf).select("path", "acr"), "path", 16)
    sizes = batched.groupBy("batch_id").agg(F.count("*").alias("n_in_batch"))
    return batched.join(sizes, "batch_id").select("path", "batch_id", r6("acr").alias("acr"), "n_in_batch")


def _scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared storage."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid4().hex}"


def _shown(rows: DataFrame) -> DataFrame:
    """Manifest rows with the file's name for its path, which is another one at every run."""
    return rows.select(C.base_name(F.col("path")).alias("clip"), r6("acr").alias("acr"), "ccr", "language", "system", "split", "source")


def _listening_tests(spark: SparkSession, sf: str) -> manifest.Parsed:
    """Events as ratings without a header, in two tables; of 50 lines one has no number, one too many values, one no score."""
    e, folder = t(spark, sf, "events"), _scratch(spark, "ratings")
    clip = F.concat(F.col("event_type"), F.lit("-"), F.col("user_id").cast("string"), F.lit(".wav"))
    kind = F.col("event_id") % 50
    score = F.when(kind == 0, "loud").when(kind == 2, "").otherwise(F.col("value").cast("string"))
    line = F.concat_ws(",", F.col("event_type"), clip, score, F.lit("s"), F.when(kind == 1, "young,left").otherwise("old"))
    label = F.when(F.col("event_id") % 2 == 0, "train").otherwise("dev")
    e.select(line.alias("value"), label.alias("label")).write.partitionBy("label").text(folder)
    there = e.where("user_id % 3 <> 0").select(C.join_path(F.lit("wav"), clip).alias("path"))
    return manifest.parse_bvcc(spark, {x: f"{folder}/label={x}" for x in ("train", "dev")}, "wav", there)


@query("""select event_type || '-' || user_id::varchar || '.wav' as clip, round(avg(value) filter (event_id % 50 <> 2), 6) as acr, null::double as ccr, 'en' as language, event_type as system, case when event_id % 2 = 0 then 'train' else 'dev' end as split, 'bvcc' as source
    from events where event_id % 50 not in (0, 1) and user_id % 3 <> 0 group by event_type, user_id, event_id % 2""")
def parse_listening_tests(spark, sf):
    return _shown(_listening_tests(spark, sf).rows)


@query("select case when event_id % 50 = 0 then 'score is not double' else 'columns' end as reason, case when event_id % 2 = 0 then 'label=train' else 'label=dev' end as folder, count(*) as n from events where event_id % 50 in (0, 1) group by all")
def rejected_lines(spark, sf):
    """The lines that the parser put aside."""
    bad = _listening_tests(spark, sf).rejected
    return bad.groupBy("reason", F.element_at(F.split("file", "/"), -2).alias("folder")).agg(F.count("*").alias("n"))


@query("select l_returnflag || '_' || l_suppkey::varchar || '.wav' as clip, round(avg(l_quantity), 6) as acr, null::double as ccr, 'zh' as language, l_returnflag as system, 'train' as split, 'tmhint' as source from lineitem where l_linenumber <> 7 and l_suppkey % 4 <> 0 group by l_returnflag, l_suppkey")
def parse_named_clips(spark, sf):
    rows, folder = t(spark, sf, "lineitem"), _scratch(spark, "named")
    name = F.concat_ws("_", "l_returnflag", F.col("l_suppkey").cast("string"))
    score = F.when(F.col("l_linenumber") == 7, "n/a").otherwise(F.col("l_quantity").cast("string"))
    rows.select(name.alias("file_name"), F.lit("x").alias("rater"), score.alias("quality_score")).write.option("header", True).csv(folder)
    there = rows.where("l_suppkey % 4 <> 0").select(C.join_path(F.lit("wav"), F.concat(name, F.lit(".wav"))).alias("path"))
    return _shown(manifest.parse_tmhint(spark, folder, "wav", there).rows)


@query("select 'c' || p_partkey::varchar || '.wav' as clip, round(p_retailprice / 300.0::double, 6) as acr, null::double as ccr, 'en' as language, 'unknown' as system, 'train' as split, 'audiomos' as source from part where p_partkey % 10 <> 3 and p_partkey % 5 <> 0")
def parse_single_scores(spark, sf):
    rows, folder = t(spark, sf, "part"), _scratch(spark, "single")
    name = F.concat(F.lit("c"), F.col("p_partkey").cast("string"), F.lit(".wav"))
    rate = F.when(F.col("p_partkey") % 10 == 3, "16k").otherwise("16000")
    rows.select(name.alias("filename"), (F.col("p_retailprice") / 300.0).cast("string").alias("mos"), rate.alias("sr")).write.option("header", True).csv(folder)
    there = rows.where("p_partkey % 5 <> 0").select(C.join_path(F.lit("wav"), name).alias("path"))
    return _shown(manifest.parse_audiomos(spark, folder, "wav", there).rows)


@query("select 'c' || p_partkey::varchar || '.wav' as clip, round(p_retailprice / 300.0::double, 6) as acr, null::double as ccr, 'en' as language, case p_partkey % 3 when 0 then 'NISQA_TRAIN_SIM' else 'NISQA_VAL_LIVE' end as system, 'train' as split, 'nisqa' as source from part where p_partkey % 3 <> 2 and p_partkey % 7 <> 0")
def parse_subsets(spark, sf):
    """The corpus' table is found among others by its columns, and its test subset is left out."""
    rows, folder = t(spark, sf, "part"), _scratch(spark, "subsets")
    name = F.concat(F.lit("deg/c"), F.col("p_partkey").cast("string"), F.lit(".wav"))
    subset = F.element_at(F.array(F.lit("NISQA_TRAIN_SIM"), F.lit("NISQA_VAL_LIVE"), F.lit("NISQA_TEST_P501")), (F.col("p_partkey") % 3 + 1).cast("int"))
    rows.limit(1).select(subset.alias("db"), F.lit(1).alias("con")).write.option("header", True).csv(f"{folder}/a")
    # One file, as the corpus has it; a table of millions would be a folder of its own for ``checked_csv``.
    rows.select(subset.alias("db"), name.alias("filepath_deg"), (F.col("p_retailprice") / 300.0).cast("string").alias("mos")).coalesce(1).write.option("header", True).csv(f"{folder}/b")
    there = rows.where("p_partkey % 7 <> 0").select(C.join_path(F.lit(folder), name).alias("path"))
    return _shown(manifest.parse_nisqa(spark, folder, there, "*.csv").rows)


@query(f"""select run, max(epoch) + 1 as next_epoch, max(best) filter (epoch = last) as best_dev, round(max(w) filter (epoch = last), 6) as weight from (
    select h.*, w, max(h.epoch) over (partition by h.run) as last, greatest(-1.0::double, coalesce(max(dev) over (partition by h.run order by h.epoch), -1.0::double)) as best
    from ({_HISTORY}) h join (select event_type as run, day(ts)::bigint as epoch, avg(value) as w from events group by all) using (run, epoch) where epoch <= 20) group by run""")
def resume_after_abort(spark, sf):
    """Where runs go on after two saves and a third one that died before its pointer moved."""
    weight = t(spark, sf, "events").groupBy(F.col("event_type").alias("run"), F.dayofmonth("ts").cast("long").alias("epoch")).agg(F.array(F.avg("value")).alias("values"))
    rows = _history(spark, sf).join(weight, ["run", "epoch"]).withColumn("param", F.lit("head.w"))
    table = checkpoint_table.CheckpointTable(spark, _scratch(spark, "runs"))
    table.save(rows.where("epoch <= 10"))
    table.save(rows.where("epoch > 9 and epoch <= 20"))
    table.write(rows.where("epoch > 20"))
    return table.resume().select("run", "next_epoch", "best_dev", r6(F.get("values", F.lit(0))).alias("weight"))


@query(f"select path, acr, null::double as ccr, null::varchar as language, system, null::varchar as split, case when starts_with(source, 'c') then 'unknown' else source end as source from (select path, round(acr, 6) as acr, system, source from ({_CLIPS}))")
def manifest_csv(spark, sf):
    """A manifest of fewer columns through CSV and back: missing ones are empty, a missing source reads as unknown."""
    folder = _scratch(spark, "manifest")
    rows = _clips(spark, sf).withColumns({"acr": r6("acr"), "source": F.when(~F.startswith("source", F.lit("c")), F.col("source"))})
    writers.write_manifest(rows, folder)
    return readers.manifest(spark, folder)


@query("select 'p,' || p_partkey::varchar as sample_id, round(p_retailprice / 7.0::double, 6) as pred_score from part")
def predictions_csv(spark, sf):
    """Predictions through CSV and back, with commas in the ids."""
    folder = _scratch(spark, "predictions")
    rows = t(spark, sf, "part").select(F.concat(F.lit("p,"), F.col("p_partkey").cast("string")).alias("sample_id"), r6(F.col("p_retailprice") / 7.0).alias("pred_score"))
    writers.write_predictions(rows, folder)
    good, _ = readers.checked_csv(spark, folder, "sample_id string, pred_score double", "sample_id")
    return good

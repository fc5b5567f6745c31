"""Queries over seeded choices, positions, samples and sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from evalloom.functions import seeded, text
from evalloom.operators import positions, stratify
from evalloom.plans.common import derive, duck, okey, registry, scratch, shuffled, table, u32, write_named
from evalloom.sinks import writers
from evalloom.sources import readers

QUERIES, query = registry()


@query("seeded_key", f"select o_orderkey, {okey(42, 'o_orderkey', 'o_orderpriority')} as okey from orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", seeded.seeded_key(42, "o_orderkey", "o_orderpriority").alias("okey"))


@query("global_index", "select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1 as pos from orders")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return positions.global_index(df, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "pos")


@query("index_by_key", f"select event_id, row_number() over (order by {okey(7, 'event_id')}) - 1 as pos from events")
def _(spark, sf):
    return positions.index_by_key(table(spark, sf, "events").select("event_id"), 7, "event_id")


@query("sample_exact", f"select o_orderkey, o_totalprice from orders order by {okey(11, 'o_orderkey')} limit 500")
def _(spark, sf):
    return positions.sample_exact(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 500, 11, "o_orderkey")


@query(
    "sample_two_way",
    f"""select doc_id, case when rn <= 60 then 'first' else 'second' end as part from (
        select doc_id, row_number() over (order by {okey(12, 'doc_id')}) as rn from documents) where rn <= 100""",
)
def _(spark, sf):
    return positions.sample_two_way(table(spark, sf, "documents").select("doc_id"), 60, 40, 12, "doc_id")


@query(
    "shuffle_array",
    f"""select event_id, array_to_string({shuffled("['a', 'b', 'c', event_type]", 5, 'event_id')}, ',') as shuffled from events""",
)
def _(spark, sf):
    arr = F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.col("event_type"))
    return table(spark, sf, "events").select("event_id", F.array_join(seeded.shuffle_array(arr, 5, "event_id"), ",").alias("shuffled"))


@query(
    "pick_one",
    f"""select p_partkey, list_extract(string_split(p_name || ' ' || lower(p_type), ' '),
        ({u32(9, 'p_partkey')} % len(string_split(p_name || ' ' || lower(p_type), ' ')) + 1)::int) as word from part""",
)
def _(spark, sf):
    words = F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " ")
    return table(spark, sf, "part").select("p_partkey", seeded.pick_one(words, 9, "p_partkey").alias("word"))


@query("shuffle_rows", "select o_orderkey, o_orderstatus from orders")
def _(spark, sf):
    return positions.shuffle_rows(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), 3, "o_orderkey")


@query("keyed_bernoulli", f"select event_id, {u32(21, 'event_id')} / 4294967296.0 < 0.3 as keep from events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", seeded.keyed_bernoulli(0.3, 21, "event_id").alias("keep"))


@query(
    "fraction_split",
    f"""select o_orderkey, case when rn <= round_even((select count(*) from orders) * (1.0 - 0.2), 0) then 'train' else 'test' end as split
        from (select o_orderkey, row_number() over (order by {okey(178430, 'o_orderkey')}) as rn from orders)""",
)
def _(spark, sf):
    return positions.fraction_split(table(spark, sf, "orders").select("o_orderkey"), 0.2, 178430, "o_orderkey")


@query(
    "stratified_split",
    f"""with p as (select p_partkey, p_type, p_brand,
            row_number() over (order by p_type, p_brand, {okey(4, 'p_partkey')}, p_partkey) - 1 as pos from part)
        select p_partkey, p_type, p_brand, case when pos * 0.6180339887498949::double - floor(pos * 0.6180339887498949::double) < 0.25::double
            then 'test' else 'train' end as split from p""",
)
def _(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_type", "p_brand")
    return positions.stratified_split(df, ["p_type", "p_brand"], 0.25, 4, "p_partkey")


PAIR_LABELS = ("o_orderstatus", "o_orderpriority", "zone")
PAIR_ROWS = "select o_orderkey, o_orderstatus, o_orderpriority, cast(o_custkey % 7 as string) as zone from {orders}"
PAIR_SUMS = [(a, b) for i, a in enumerate(PAIR_LABELS) for b in PAIR_LABELS[i:]]


@query("stratified_split_pairs", f"""with r as ({duck(PAIR_ROWS)}) select 'all' as labels, '-' as value, count(*)::bigint as n, true as within_one from r union all """ + " union all ".join(
    f"select '{a},{b}', coalesce({a}, '-') || ',' || coalesce({b}, '-'), count(*)::bigint, true from r group by {a}, {b}" for a, b in PAIR_SUMS))
def _(spark, sf):
    """Every row of the split in the sums of each label and pair of labels, and whether its test rows are within one of three tenths."""
    rows = stratify.stratified_split_pairs(derive(spark, sf, PAIR_ROWS), list(PAIR_LABELS), "0.3", 4, "o_orderkey")
    near = (F.abs(10 * F.count_if(F.col("split") == "test") - 3 * F.count("*")) <= 10).alias("within_one")
    sums = [rows.groupBy(F.lit("all").alias("labels"), F.lit("-").alias("value")).agg(F.count("*").alias("n"), near)]
    for a, b in PAIR_SUMS:
        sums.append(rows.groupBy(F.lit(f"{a},{b}").alias("labels"), F.concat(F.coalesce(a, F.lit("-")), F.lit(","), F.coalesce(b, F.lit("-"))).alias("value")).agg(F.count("*").alias("n"), near))
    return reduce(lambda x, y: x.unionByName(y), sums)


# ---------------------------------------------------------------- sources, sinks
ORDER_ROWS = """select o_orderkey, o_orderpriority, o_orderstatus,
    case when o_orderkey % 5 = 0 then null else o_custkey end as o_custkey from {orders}"""


@query("jsonl_round_trip", f"select o_orderkey, o_orderpriority, coalesce(o_custkey, -1) as o_custkey from ({duck(ORDER_ROWS)})")
def _(spark, sf):
    path = scratch(spark)
    writers.write_jsonl(derive(spark, sf, ORDER_ROWS).drop("o_orderstatus"), path)
    back = readers.read_jsonl(spark, path, "o_orderkey long, o_orderpriority string, o_custkey long")
    return back.withColumn("o_custkey", F.coalesce("o_custkey", F.lit(-1)))


LINES = "select case when p_partkey % 10 = 0 then '  ' else concat(p_partkey, ' ', p_name) end as value from {part}"


@query("read_lines", f"select value from ({duck(LINES)}) where trim(value) <> ''")
def _(spark, sf):
    path = scratch(spark)
    derive(spark, sf, LINES).write.text(path)
    return readers.read_lines(spark, path).select("value")


@query("read_keyed_documents", "select concat('c', o_custkey) as doc, concat('o', o_orderkey) as doc_key, o_orderstatus as status, o_orderpriority as priority from orders")
def _(spark, sf):
    record = F.struct(F.concat(F.lit("c"), "o_custkey").alias("doc"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    docs = table(spark, sf, "orders").select(F.to_json(F.struct(F.create_map(F.concat(F.lit("o"), "o_orderkey"), record).alias("posters"))).alias("value"))
    path = scratch(spark)
    docs.write.text(path)
    schema = "doc string, status string, priority string"
    return readers.read_keyed_documents(spark, path, "posters", schema, one_per_line=True).drop("file")


@query("read_json_arrays", "select c_custkey, c_mktsegment from customer")
def _(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    # arrays of at most 100 records, one file each
    arrays = rows.groupBy(F.floor(F.col("c_custkey") / 100).alias("block")).agg(F.to_json(F.collect_list(F.struct("*"))).alias("value"))
    path = scratch(spark)
    arrays.write.partitionBy("block").text(path)
    return readers.read_json_arrays(spark, f"{path}/*", "c_custkey long, c_mktsegment string", "*.txt")


@query("read_yearly_csv", "select o_orderpriority as name, o_orderstatus as gender, o_orderkey as count, year(o_orderdate)::int as year from orders")
def _(spark, sf):
    path = scratch(spark)
    rows = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("gender"), F.col("o_orderkey").alias("count"), F.year("o_orderdate").alias("y")
    )
    rows.write.partitionBy("y").csv(path)
    return readers.read_yearly_csv(spark, f"{path}/y=*", "name string, gender string, count long", r"/y=(\d{4})/").drop("line")


SPLIT_ROWS = "select c_custkey, c_mktsegment, case when c_custkey % 4 = 0 then 'test' else 'train' end as split from {customer}"


@query("split_table", f"select * from ({duck(SPLIT_ROWS)}) where split = 'test'")
def _(spark, sf):
    path = scratch(spark)
    writers.write_split_table(derive(spark, sf, SPLIT_ROWS), path)
    return readers.read_split_table(spark, path, ["test"])


@query("metric_csv", "select l_returnflag, count(*)::bigint as n from lineitem group by 1")
def _(spark, sf):
    path = scratch(spark)
    writers.write_metric_csv(table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n")), path)
    return spark.read.schema("l_returnflag string, n long").option("header", True).csv(path)


PROVENANCE = "select doc_id, concat('data/', source, case when lang = 'de' then '-heldout.tar' else '.tar' end) as file from {documents}"


@query("keep_sources", f"select doc_id, file, regexp_replace(regexp_replace(file, '^.*/', ''), '\\.tar$', '') as source from ({duck(PROVENANCE)}) where not contains(file, 'heldout')")
def _(spark, sf):
    return readers.keep_sources(derive(spark, sf, PROVENANCE), "file", "heldout")


RUN_FILES = "select event_id, concat('out/', event_type, '_exp', event_id % 3, '_', event_id % 4, '.jsonl') as file from {events}"
RUN_PATTERN = r"([^/_]+)_([^/_]+)_(\d+)\.jsonl$"


@query("runs_of_files", f"select event_id, regexp_extract(file, '{RUN_PATTERN}', 1) as model, regexp_extract(file, '{RUN_PATTERN}', 2) as experiment, regexp_extract(file, '{RUN_PATTERN}', 3) as seed from ({duck(RUN_FILES)})")
def _(spark, sf):
    df = derive(spark, sf, RUN_FILES)
    return df.select("event_id", *readers.run_of_file(F.col("file"), RUN_PATTERN, ("model", "experiment", "seed")))


EXPECTED_RUNS = "select distinct event_type as model, concat('exp', event_id % 5) as experiment, cast(event_id % 4 as string) as seed from {events}"


@query("missing_runs", f"""select model, experiment, seed from ({duck(EXPECTED_RUNS)}) except
    select regexp_extract(file, '{RUN_PATTERN}', 1), regexp_extract(file, '{RUN_PATTERN}', 2), regexp_extract(file, '{RUN_PATTERN}', 3) from ({duck(RUN_FILES)})""")
def _(spark, sf):
    fields = ("model", "experiment", "seed")
    df = derive(spark, sf, RUN_FILES).select(*readers.run_of_file(F.col("file"), RUN_PATTERN, fields))
    return readers.missing_runs(df, derive(spark, sf, EXPECTED_RUNS), fields)


@query("read_with_source", "select o_orderkey, o_totalprice, 'prio' || substr(o_orderpriority, 1, 1) as source from orders where substr(o_orderpriority, 1, 1) <> '5'")
def _(spark, sf):
    """Files of one priority each, read back with their names; the file that is held out is never opened."""
    root, orders = scratch(spark), table(spark, sf, "orders")
    for p in "12345":
        name = f"prio{p}.jsonl" if p < "5" else "prio5-heldout.jsonl"
        write_named(orders.filter(F.col("o_orderpriority").startswith(p)).select("o_orderkey", "o_totalprice"), f"{root}/{name}")
    return readers.read_with_source(spark, f"{root}/*.jsonl", orders.select("o_orderkey", "o_totalprice").schema, "heldout")


@query("read_runs", """with e as (select event_id, event_type, event_id % 3 as m, event_id % 4 as s from events)
    select event_id, event_type, 'm' || m as model, 'exp' as experiment, s::varchar as seed, 'row' as kind from e where not (m = 2 and s > 1)
    union all select -1, '-', m, 'exp', s, 'missing' from (values ('m2', '2'), ('m2', '3'), ('m3', '0')) t(m, s)""")
def _(spark, sf):
    """Ten of the thirteen expected runs have a file; each row knows its run, absent runs are listed."""
    root = scratch(spark)
    events = table(spark, sf, "events").select("event_id", "event_type")
    for m in range(3):
        for s in range(4):
            if not (m == 2 and s > 1):
                write_named(events.filter((F.col("event_id") % 3 == m) & (F.col("event_id") % 4 == s)), f"{root}/m{m}_exp_{s}.jsonl")
    runs = [(f"m{m}", "exp", str(s)) for m in range(3) for s in range(4)] + [("m3", "exp", "0")]
    expected = spark.createDataFrame(runs, "model string, experiment string, seed string")
    rows, missing = readers.read_runs(spark, f"{root}/*.jsonl", "event_id long, event_type string", expected=expected)
    gone = missing.select(F.lit(-1).cast("long").alias("event_id"), F.lit("-").alias("event_type"), "model", "experiment", "seed", F.lit("missing").alias("kind"))
    return rows.withColumn("kind", F.lit("row")).unionByName(gone)


SHARD_PATHS = "select event_id, concat('root/shard_', case when event_id % 9 = 0 then 'recovered' else cast(event_id % 12 as string) end, '/run/f.jsonl') as path from {events}"


@query("shard_numbers", f"select event_id, coalesce(try_cast(regexp_extract(path, 'shard_([0-9]+)/', 1) as int), 1000000000) as shard from ({duck(SHARD_PATHS)})")
def _(spark, sf):
    return derive(spark, sf, SHARD_PATHS).select("event_id", readers.shard_number(F.col("path")).alias("shard"))


@query("read_shards", "select event_id as sample_id, event_type, (event_id % 3 * 5)::int as shard from events")
def _(spark, sf):
    root = scratch(spark)
    rows = table(spark, sf, "events").select(F.col("event_id").alias("sample_id"), "event_type")
    for i in range(3):
        writers.write_jsonl(rows.filter(F.col("sample_id") % 3 == i), f"{root}/shard_{i * 5}/run/results.jsonl")
    back = readers.read_shards(spark, root, "run", "results.jsonl", "sample_id long, event_type string")
    return back.select("sample_id", "event_type", "shard")


@query("join_sidecar", """select d.doc_id, concat('img/', d.doc_id, '.jpg') as path, concat('q', l.quality) as caption
    from documents d left join labels l on d.doc_id = l.doc_id where l.doc_id is not null
    union all select d.doc_id, concat('img/', d.doc_id, '.jpg'), null from documents d where d.doc_id not in (select doc_id from labels)""")
def _(spark, sf):
    df = derive(spark, sf, "select doc_id, concat('img/', doc_id, '.jpg') as path from {documents}")
    side = derive(spark, sf, "select concat('img/', doc_id, '.txt') as path, concat('q', quality) as caption from {labels}")
    return readers.join_sidecar(df, side, "path", "caption", by_stem=True)


CANDIDATES = "select o_orderkey, concat('c', o_custkey, '.jpg') as a, concat('o', o_orderkey, '.jpeg') as b, concat('o', o_orderkey % 100, '.png') as c from {orders}"
FILES = """select concat('o', doc_id, '.jpeg') as path from {labels} where quality = 1
    union all select concat('c', doc_id, '.jpg') from {labels} where toxic = 1
    union all select concat('o', doc_id, '.png') from {labels} where quality = 0"""


@query("resolve_first_existing", f"""with f as ({duck(FILES)})
    select o_orderkey, coalesce(case when a in (select path from f) then a when b in (select path from f) then b
        when c in (select path from f) then c end, 'none') as resolved from ({duck(CANDIDATES)})""")
def _(spark, sf):
    df = derive(spark, sf, CANDIDATES).select("o_orderkey", F.array("a", "b", "c").alias("candidates"))
    found = readers.resolve_first_existing(df, "o_orderkey", "candidates", derive(spark, sf, FILES))
    return found.select("o_orderkey", F.coalesce("resolved", F.lit("none")).alias("resolved"))


@query("first_valid", "select doc_id, n_chars from documents where n_chars > 500 and lang = 'en' order by doc_id limit 50")
def _(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    return readers.first_valid(df, (F.col("n_chars") > 500) & (F.col("lang") == "en"), ["doc_id"], 50).select("doc_id", "n_chars")


@query("verify_content_hash", """select doc_id, case when doc_id % 10 = 3 then 'missing' when doc_id % 7 = 0 then 'mismatch' else 'ok' end as status from documents""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    digest = F.when(F.col("doc_id") % 7 == 0, F.sha2(F.lit("other").cast("binary"), 256)).otherwise(F.sha2("content", 256))
    expected = docs.select("doc_id", digest.alias("sha256_hash"))
    files = docs.filter(F.col("doc_id") % 10 != 3)
    return readers.verify_content_hash(expected, files, "doc_id", "content", "sha256_hash").select("doc_id", "status")


@query("bucket_path", "select o_orderkey, lpad((o_orderkey // 1000)::varchar, greatest(4, length((o_orderkey // 1000)::varchar))::int, '0') || '/' || o_orderkey || '.jpg' as path from orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", text.bucket_path("o_orderkey").alias("path"))


@query("write_summary", "select (select count(*) from orders)::bigint as orders, (select count(distinct o_custkey) from orders)::bigint as customers")
def _(spark, sf):
    path = scratch(spark)
    one = table(spark, sf, "orders").agg(F.count("*").alias("orders"), F.countDistinct("o_custkey").alias("customers"))
    writers.write_summary(one, path)
    return spark.read.schema("orders long, customers long").option("multiLine", True).json(path)

"""Inputs of the registered queries: derivations written once for Spark and for the SQL check.

``{table}`` placeholders name the given tables; the text between them is plain
SQL that both engines read the same way.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evalloom.context import use_checkpoint_dir

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
)


def registry() -> tuple[dict, Callable]:
    """(queries of a module, decorator that adds one with the SQL that checks it)."""
    found: dict[str, tuple] = {}

    def query(name: str, sql: str | None = None):
        def add(fn):
            found[name] = (fn, sql)
            return fn

        return add

    return found, query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run a derivation over the tables it names."""
    used = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in used})


def duck(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", text)


def scratch(spark: SparkSession) -> str:
    """A fresh folder next to the checkpoints, which all executors share."""
    return f"{use_checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"


def write_named(df: DataFrame, path: str) -> None:
    """JSON lines in one file of that name: result files of earlier runs, whose names the readers take apart."""
    spark = df.sparkSession
    folder = f"{path}.parts"
    df.coalesce(1).write.json(folder)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(conf)
    (part,) = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/part-*"))
    fs.rename(part.getPath(), jvm.org.apache.hadoop.fs.Path(path))


# ------------------------------------------------- SQL text of seeded choices
def okey(seed, *cols: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(cols)}))"


def u32(seed, *cols: str) -> str:
    return f"('0x' || substr({okey(seed, *cols)}, 1, 8))::bigint"


def permuted(place: str, n: str, seed, tweak: str = "0") -> str:
    """SQL of the rounds of a seeded permutation of 0..n-1 over columns ``place``, ``n`` and ``tweak``."""
    p = 2147483647
    a, b = f"(floor(sqrt({n}::double))::bigint + 1)", f"(({n} + floor(sqrt({n}::double))::bigint) // (floor(sqrt({n}::double))::bigint + 1))"
    keys = [int(hashlib.md5(f"{seed}|{r}".encode()).hexdigest()[:7], 16) * 2 + r % 2 for r in range(6)]
    h = lambda v: f"(({v} + k + (({tweak})::bigint % {p} * 1103515245 + 12345) % {p}) % {p})"
    mixed = lambda v: f"(({h(v)} * {h(v)} + 48271 * {h(v)}) % {p})"
    step = f"""case when k % 2 = 0 then (z % {a} + {mixed(f'(z // {a})')}) % {a} + {a} * (z // {a})
        else z % {a} + {a} * ((z // {a} + {mixed(f'(z % {a})')}) % {b}) end"""
    one = lambda z: f"list_reduce(list_prepend(({z})::bigint, {keys}::bigint[]), lambda z, k: {step})"
    return f"list_reduce(list_prepend({one(place)}, range(20)::bigint[]), lambda w, i: case when w < {n} then w else {one('w')} end)"


def shuffled(arr: str, seed, *keys: str) -> str:
    key = okey(seed, *keys, "v")
    return f"list_transform(list_sort(list_transform({arr}, lambda v: {{'k': {key}, 'v': v}})), lambda s: s.v)"


def lettered(arr: str, before: str = "", after: str = ": ", joint: str = "chr(10)") -> str:
    return f"array_to_string(list_transform({arr}, lambda v, i: '{before}' || chr((64 + i)::int) || '{after}' || v), {joint})"


def key_of(arr: str, value: str) -> str:
    return f"chr((64 + list_position({arr}, {value}))::int)"


STRIP = r"[\s\p{Z}]"


def stripped(c: str) -> str:
    return rf"regexp_replace({c}, '^{STRIP}+|{STRIP}+$', '', 'g')"


def parse_md(values: dict[str, str]) -> str:
    """Literal SQL map."""
    keys = ", ".join("'" + k.replace("'", "''") + "'" for k in values)
    vals = ", ".join("'" + v.replace("'", "''") + "'" for v in values.values())
    return f"map([{keys}], [{vals}])"
